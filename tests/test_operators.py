"""Operators on rows made by hand, where the outcome is known."""

import pytest
from pyspark.sql import functions as F

from codelode.functions import text
from codelode.operators import architecture, derive, governance, history, lookup, projects, retrieval, runtime, traverse
from codelode.sources import files

SYMBOL = "id string, project_id string, symbol_key string, module_id string, file_id string, kind string, name string, qualified_name string, signature string, language string, start_line int, start_column int, end_line int, external boolean, generated boolean"
RELATION = "id string, project_id string, source_type string, source_id string, target_type string, target_id string, unresolved_target string, kind string, resolution_status string, nature string, confidence double, file_id string, start_line int"


def symbol(i, name, file="src/main/java/a/A.java", kind="CLASS", qualified=None, external=False, generated=False):
    return (i, "p", f"k{i}", None, file, kind, name, qualified, None, "java", 1, 0, 9, external, generated)


def relation(i, source, target, kind, nature="FACTUAL", confidence=None, status="RESOLVED"):
    return (i, "p", "SYMBOL", source, "SYMBOL" if target else None, target, None if target else "x.Y", kind, status, nature, confidence, "f", 1)


def test_search_ranks_matches_before_it_limits(spark):
    rows = spark.createDataFrame([symbol("a", "Alpha", qualified="x.Alpha"), symbol("b", "AlphaTwo", qualified="x.AlphaTwo"), symbol("c", "Other", qualified="alpha"), symbol("d", "None")], SYMBOL)
    found = lookup.search_symbols(rows, "p", "alpha", limit=2).orderBy("position").collect()
    assert [(r["id"], r["match_rank"]) for r in found] == [("c", 0), ("a", 1)]
    with pytest.raises(ValueError):
        lookup.search_symbols(rows, "p")


def test_a_loop_is_outgoing(spark):
    rows = spark.createDataFrame([relation("1", "a", "a", "CALLS"), relation("2", "b", "a", "CALLS"), relation("3", "a", None, "CALLS")], RELATION)
    found = lookup.relationships(rows, "p", "a").orderBy("position").collect()
    assert [(r["id"], r["direction_rank"]) for r in found] == [("1", 0), ("3", 0), ("2", 1)]


@pytest.mark.parametrize(("path", "test"), [("src/test/java/A.java", True), ("a/Tests/x", True), ("x/__tests__/a.ts", True), ("a/b.spec.ts", True), ("a/spec.ts", False), ("src\\test\\A.java", True), ("contest/a", False)])
def test_test_paths(spark, path, test):
    assert spark.createDataFrame([(path,)], "p string").select(lookup.is_test_path("p")).first()[0] is test


def test_dependencies_join_the_facts_of_a_pair(spark):
    rows = spark.createDataFrame([relation("2", "a", "b", "CALLS"), relation("1", "a", "b", "IMPORTS"), relation("3", "a", "a", "CALLS"), relation("4", "a", "b", "CALLS", "HEURISTIC", 0.5), relation("5", "a", "b", "DECLARES")], RELATION)
    (row,) = derive.dependencies(rows).collect()
    assert (row["source_id"], row["target_id"], row["facts"], row["first_fact"], row["nature"]) == ("a", "b", 2, "1", "DERIVED")


def test_related_tests_have_the_known_confidences(spark):
    symbols = [symbol("prod", "Greeter", qualified="a.Greeter"), symbol("test", "GreeterTest", "src/test/java/a/GreeterTest.java", qualified="a.GreeterTest"), symbol("far", "Sender", "src/main/java/b/S.java", qualified="b.Sender"), symbol("fartest", "SenderTest", "src/test/java/c/SenderTest.java", qualified="c.SenderTest")]
    occ = spark.createDataFrame([("o", "p", "prod", "src/test/java/a/GreeterTest.java", ["REFERENCE"], "RESOLVED")], "id string, project_id string, symbol_id string, file_id string, roles array<string>, resolution_status string")
    found = {r["production_id"]: (r["test_id"], r["nature"], r["confidence"]) for r in derive.related_tests(spark.createDataFrame(symbols, SYMBOL), occ, spark.createDataFrame([], RELATION)).collect()}
    assert found == {"prod": ("test", "DERIVED", 0.887), "far": ("fartest", "HEURISTIC", 0.595)}


def test_impact_prefers_short_then_sure_paths(spark):
    symbols = spark.createDataFrame([symbol(x, x) for x in "rabcd"] + [symbol("x", "x", external=True)], SYMBOL)
    rows = spark.createDataFrame([relation("1", "a", "r", "CALLS"), relation("2", "b", "r", "REFERENCES", "DERIVED", 0.82), relation("3", "c", "a", "CALLS", "HEURISTIC", 0.7), relation("4", "c", "b", "CALLS"), relation("5", "r", "c", "CALLS"), relation("6", "x", "r", "CALLS"), relation("7", "d", "c", "RELATED_TEST", status="HEURISTIC")], RELATION)
    impacts, tests = traverse.impact(symbols, rows, "r", 4, 200)
    assert [(r["symbol_id"], r["depth"], r["confidence"]) for r in impacts.orderBy("depth", F.desc("confidence"), "path").collect()] == [("a", 1, 1.0), ("b", 1, 0.82), ("c", 2, 0.82), ("d", 3, 0.82)]
    assert [r["symbol_id"] for r in tests.collect()] == ["d"]
    assert traverse.impact(symbols, rows, "r", 1, 1)[0].count() == 1


def test_impacted_tests_are_those_of_the_impact_without_its_bound(spark):
    symbols = spark.createDataFrame([symbol(x, x) for x in "rabcde"] + [symbol("x", "x", external=True)], SYMBOL)
    rows = spark.createDataFrame([relation("1", "a", "r", "CALLS"), relation("2", "b", "r", "RELATED_TEST", status="HEURISTIC"), relation("3", "c", "a", "RELATED_TEST"), relation("4", "b", "a", "CALLS"), relation("5", "r", "a", "RELATED_TEST"), relation("6", "x", "r", "RELATED_TEST"), relation("7", "d", "c", "CALLS"), relation("8", "a", "d", "RELATED_TEST"), relation("9", "e", "a", "CALLS", status="HEURISTIC")], RELATION)
    got = lambda depth: sorted(r[0] for r in traverse.impacted_tests(symbols, rows, "r", depth).collect())
    assert [got(n) for n in (1, 2, 3, 4)] == [["b"], ["b", "c"], ["b", "c"], ["a", "b", "c"]]
    assert got(4) == sorted(r["symbol_id"] for r in traverse.impact(symbols, rows, "r", 4, 200)[1].collect())
    assert traverse.impacted_tests(symbols, rows, "none", 4).count() == 0


def edges(spark, *rows):
    return spark.createDataFrame([(i, s, t, k, "FACTUAL", None) for i, s, t, k in rows], "id string, source_node_id string, target_node_id string, kind string, nature string, confidence double")


def test_flow_paths_report_a_cycle_once(spark):
    found = traverse.flow_paths(edges(spark, ("1", "a", "b", "DATA_FLOW"), ("2", "b", "a", "DATA_FLOW"), ("3", "a", "c", "CONTROL_FLOW")), "a", 5, 100).collect()
    assert [(r["nodes"], r["cycle"]) for r in found] == [(["a", "b"], False), (["a", "b", "a"], True)]


def test_security_paths_carry_sanitizers(spark):
    nodes = spark.createDataFrame([("s", "SOURCE"), ("m", "SANITIZER"), ("t", "SINK"), ("u", "SYMBOL")], "id string, kind string")
    found = traverse.security_paths(nodes, edges(spark, ("1", "s", "m", "TAINT_FLOW"), ("2", "m", "t", "TAINT_FLOW"), ("3", "s", "t", "TAINT_FLOW"), ("4", "t", "u", "TAINT_FLOW"), ("5", "u", "t", "TAINT_FLOW")), 6, 50).collect()
    assert [(r["sink"], r["depth"], r["sanitized"]) for r in found] == [("t", 1, False), ("t", 2, True)]


def test_conflicting_rows_under_one_id_are_an_error(spark):
    a, b = edges(spark, ("1", "a", "b", "CALL")), edges(spark, ("1", "a", "c", "CALL"))
    assert traverse.compose([a, a]).count() == 1
    with pytest.raises(Exception, match="conflicting rows under 1"):
        traverse.compose([a, b]).collect()


@pytest.mark.parametrize(("pairs", "incoming", "outgoing", "most_in", "most_out"), [
    ([("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "a", 1)], 0.25, 0.25, 0.25, 0.25),
    ([("a", "d", 8), ("b", "d", 1), ("c", "d", 1)], 1.0, 0.66, 1.0, 0.8),
])
def test_shares_of_modules(spark, pairs, incoming, outgoing, most_in, most_out):
    e = spark.createDataFrame(pairs, "source_module string, target_module string, dependency_count long")
    m = spark.createDataFrame([(x,) for x in "abcd"], "module_id string")
    rows = architecture.concentration(m, e).collect()
    assert sum(r["incoming_share"] ** 2 for r in rows) == pytest.approx(incoming)
    assert sum(r["outgoing_share"] ** 2 for r in rows) == pytest.approx(outgoing)
    assert (max(r["incoming_share"] for r in rows), max(r["outgoing_share"] for r in rows)) == (pytest.approx(most_in), pytest.approx(most_out))


def test_module_graphs_are_drawn_with_escaped_labels(spark):
    e = spark.createDataFrame([('a"x', "b", 2)], "source_module string, target_module string, dependency_count long")
    assert architecture.render_graph(e, "dot") == 'digraph modules {\n  m0 [label="a\\"x"];\n  m1 [label="b"];\n  m0 -> m1 [label="2"];\n}\n'
    assert "m0 -->|2| m1" in architecture.render_graph(e)


def test_runtime_references_resolve_by_key_then_name_then_line(spark):
    s = spark.createDataFrame([symbol("a", "A", qualified="x.A"), symbol("b", "B", qualified="x.B"), symbol("c", "C", "g.java", qualified="x.B")], SYMBOL)
    refs = spark.createDataFrame([("1", "ka", "x.B", None, None), ("2", None, "x.B", None, None), ("3", None, None, "g.java", 9), ("4", None, None, "g.java", 10), ("5", "nokey", "x.A", None, None)], "ref_id string, key string, name string, file string, line int")
    assert {r["ref_id"]: (r["status"], r["symbol_id"]) for r in runtime.resolve(refs, s).collect()} == {"1": ("RESOLVED", "a"), "2": ("AMBIGUOUS", None), "3": ("RESOLVED", "c"), "4": ("UNRESOLVED", None), "5": ("UNRESOLVED", None)}


def test_history_stops_at_the_first_old_commit(spark):
    c = spark.createDataFrame([("a", 0, "2024-03-01"), ("b", 1, "2023-01-01"), ("c", 2, "2024-02-01")], "commit_id string, scan_pos long, d string").withColumn("committed_at", F.to_timestamp("d"))
    assert [r["commit_id"] for r in history.newest_until(c, "2024-01-01").collect()] == ["a"]


def test_retrieval_measures_count_a_repeat_once_in_recall(spark):
    ranked = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (1, 3, "a")], "query_id int, rank int, key string")
    (r,) = retrieval.retrieval_metrics(ranked, spark.createDataFrame([(1, "a"), (1, "b")], "query_id int, key string"), 3).collect()
    assert (r["found"], r["recall"], r["mrr"]) == (1, 0.5, 0.5)
    assert r["ndcg"] == pytest.approx((1 / 1.5849625 + 0.5) / (1 + 1 / 1.5849625))


def test_a_context_lets_later_documents_in_after_a_cut(spark):
    rows = spark.createDataFrame([("a", "x" * 4000, 0.9), ("b", "y" * 40, 0.8), ("c", "z" * 4000, 0.7)], "stable_key string, content string, score double")
    found = retrieval.hybrid_context(rows, 3, 200, 100).orderBy("position").collect()
    assert [(f["stable_key"], f["tokens"], f["truncated"]) for f in found] == [("a", 100, True), ("b", 10, False), ("c", 58, True)]


def test_audit_prefix_stops_at_the_first_fresh_event(spark):
    e = spark.createDataFrame([("t", i, d) for i, d in enumerate(["2023-01-01", "2024-02-01", "2023-01-02"], 1)], "tenant_id string, sequence long, d string").withColumn("occurred_at", F.to_timestamp("d"))
    cut = F.lit("2024-01-01").cast("timestamp")
    assert [history.audit_prefix(e, cut, n).first()["remove"] for n in (10, 1)] == [1, 2]


def test_tokens():
    key = b"k"
    token = governance.issue_token(key, "t", "u", "k1", 1000, 60, "id")
    assert governance.authenticate(key, token, 1001)["principal"] == "u"
    for bad, now in ((token + "x", 1001), (token, 1060), (token, 900)):
        with pytest.raises(PermissionError):
            governance.authenticate(key, bad, now)


def test_a_tenant_keeps_an_owner(spark):
    m = spark.createDataFrame([("t", "u", "OWNER")], "tenant_id string, principal_id string, role string")
    with pytest.raises(Exception, match="needs an owner"):
        governance.upsert_members(m, spark.createDataFrame([("t", "u", "VIEWER")], m.schema)).collect()


def test_a_tenant_may_have_more_members_where_its_bound_is_higher(spark):
    m = spark.range(1500).selectExpr("'t' AS tenant_id", "concat('u', id) AS principal_id", "CASE WHEN id = 0 THEN 'OWNER' ELSE 'VIEWER' END AS role")
    change = spark.createDataFrame([("t", "u1", None)], "tenant_id string, principal_id string, role string")
    with pytest.raises(Exception, match="at most 1024 members"):
        governance.upsert_members(m, change).collect()
    assert governance.upsert_members(m, change, 1500).count() == 1499


def test_every_symbol_of_a_file_has_its_position(spark):
    s = spark.range(1700).selectExpr("'p' AS project_id", "'f' AS file_id", "format_string('s%05d', id) AS id", "CASE WHEN id % 7 > 0 THEN CAST(id % 5 AS INT) END AS start_line", "CAST(id % 3 AS INT) AS start_column", "CAST(NULL AS STRING) AS qualified_name", "'n' AS name")
    got = [(r["id"], r["position"]) for r in lookup.file_symbols(s, "p", "f", None).orderBy("position").collect()]
    want = sorted(s.collect(), key=lambda r: (2**31 - 1 if r["start_line"] is None else r["start_line"], r["start_column"], r["id"]))
    assert got == [(r["id"], k) for k, r in enumerate(want, 1)]
    assert lookup.file_symbols(s, "p", "f").count() == 200


def test_published_ranges_grow_with_their_sources_and_hold_no_rows_without_a_target(spark, tmp_path, monkeypatch):
    from codelode import store
    from codelode.plans.registry import DERIVED

    rows = spark.range(40000).selectExpr("CAST(id AS STRING) AS id", "CASE WHEN id % 4 > 0 THEN sha2(CAST(id AS STRING), 256) END AS target_id")
    rows.write.parquet(f"{tmp_path}/rows")
    monkeypatch.setattr(store, "PUBLISHED_BYTES", 1 << 15)

    class Some:
        relationships = spark.read.parquet(f"{tmp_path}/rows")

    make, order = DERIVED["relationships_by_target"]
    got = store.published(spark, str(tmp_path), "some", lambda: make(Some), order)
    files = len(list((tmp_path / "rows").glob("*.parquet")))
    assert len(got.inputFiles()) > max(16, files) and got.filter("target_id IS NULL").count() == 0 and got.count() == 30000


def test_pairs_of_a_name_come_once_and_are_not_shuffled(spark):
    row = lambda i, file, name: (i, "p", file, "CLASS", name, f"a.{name}", False, False)
    rows = [row(f"t{i}", f"src/test/T{i}.java", "WidgetTest") for i in range(3)] + [row(f"s{i}", "src/main/W.java", "Widget") for i in range(4)]
    rows += [row("twice", "src/main/W.java", "Widget"), row("twice", "src/main/W.java", "t 0"), row("u", "src/main/U.java", "Other")]
    s = spark.createDataFrame(rows, "id string, project_id string, file_id string, kind string, name string, qualified_name string, external boolean, generated boolean")
    got = derive.naming_candidates(s, derive.test_anchors(s)).collect()
    assert len(got) == len(set(got)) == 3 * 5
    none = spark.createDataFrame([], "project_id string, symbol_id string, file_id string, resolution_status string, roles array<string>")
    facts = spark.createDataFrame([("p", "t0", "s1", "CALLS", "FACTUAL"), ("p", "t1", "u", "REFERENCES", "FACTUAL")], "project_id string, source_id string, target_id string, kind string, nature string")
    found = derive.related_tests(s, none, facts)
    kinds = {(r["test_id"], r["production_id"]): (r["nature"], r["evidence_types"]) for r in found.filter("production_id <> 'twice'").collect()}
    assert len(kinds) == 13 and kinds["t0", "s1"] == ("DERIVED", 4) and kinds["t1", "u"] == ("DERIVED", 3) and kinds["t2", "s1"] == ("HEURISTIC", 3)


def test_pairs_of_a_name_are_made_by_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    monkeypatch.setattr(derive, "BLOCK", 8)
    monkeypatch.setattr(derive, "TASK_PAIRS", 100)
    row = lambda i, file, name: (i, "p", file, "CLASS", name, f"a.{name}", False, False)
    rows = [row(f"t{i}", f"src/test/T{i}.java", "WidgetTest") for i in range(30)] + [row(f"s{i}", "src/main/W.java", "Widget") for i in range(50)] + [row("v", "src/test/V.java", "OtherTest"), row("u", "src/main/U.java", "Other")]
    s = spark.createDataFrame(rows, "id string, project_id string, file_id string, kind string, name string, qualified_name string, external boolean, generated boolean")
    found = derive.naming_candidates(s, derive.test_anchors(s))
    tasks = found.select("test_id", "production_id", F.spark_partition_id().alias("task")).collect()
    assert len({r[:2] for r in tasks}) == len(tasks) == 30 * 50 + 1 and len({r["task"] for r in tasks}) > 8


def test_related_and_impacted_tests_publish_nothing_and_broadcast_no_table(spark, monkeypatch):
    from codelode.plans import catalog, registry

    def publish(*_):
        raise AssertionError("published")

    monkeypatch.setattr(registry, "published", publish)
    catalog.QUERIES["d13_impacted_tests_semi_join"](spark, "/root/testdata/sf0.001")
    for name in ("d03_naming_join", "e02_related_tests"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") >= 2  # the list of large names, once a side


def test_what_many_references_ask_is_cut_once(spark, monkeypatch):
    monkeypatch.setattr(runtime, "MAX_CANDIDATES", 3)
    asked = []
    whole = runtime.hits_of
    monkeypatch.setattr(runtime, "hits_of", lambda r, s: (asked.append(r.count()), whole(r, s))[1])
    s = spark.range(5).selectExpr("concat('s', id) AS id", "concat('k', id) AS symbol_key", "'q' AS qualified_name", "'f' AS file_id", "CAST(id AS INT) AS start_line", "CAST(id + 1 AS INT) AS end_line")
    refs = spark.range(40).selectExpr("concat('r', id) AS ref_id", "CASE WHEN id = 0 THEN 'k1' END AS key", "CASE WHEN id < 30 THEN 'q' END AS name", "'f' AS file", "CASE WHEN id % 2 > 0 THEN 2 END AS line")
    got = [(r["id"], r["k"]) for r in runtime.candidate_ids(refs, s).filter("ref_id = 'r7'").orderBy("k").collect()]
    assert got == [("s0", 1), ("s1", 2), ("s2", 3)] and asked == [4] and runtime.named_ids(refs, s).count() == 29 * 3
    assert {r["id"] for r in runtime.candidate_ids(refs, s).filter("ref_id = 'r31'").collect()} == {"s1", "s2"} and runtime.candidate_ids(refs, s).filter("ref_id = 'r0'").count() == 0


def test_queries_of_one_pass_publish_no_relations(spark, monkeypatch):
    from codelode.plans import catalog, registry

    def publish(_, __, name, make, order):
        assert name in ("symbols", "placed_symbols"), name
        return make()

    monkeypatch.setattr(registry, "published", publish)
    for name in ("h03_distinct_union", "d08_cross_project", "a20_capability_check", "e07_module_edges", "f09_bounded_sample"):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")


def test_lookups_of_relationships_publish_nothing(spark, monkeypatch):
    from codelode.plans import catalog, registry

    def publish(*_):
        raise AssertionError("published")

    monkeypatch.setattr(registry, "published", publish)
    for name in ("c07_relationships", "c08_direction_any", "c09_implementations", "c12_dependencies", "c14_related_tests", "g04_relationship_order"):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")


def test_lifecycle_keeps_the_old_snapshot():
    def fails():
        raise RuntimeError("no")

    fine = dict.fromkeys(projects.LIFECYCLE[:-1], lambda: None)
    assert projects.run_lifecycle(fine, False) == ("COMPLETED", "READY")
    assert projects.run_lifecycle(fine | {"STAGING": fails}, True) == ("STAGING", "STALE")
    assert projects.run_lifecycle(fine | {"PROMOTION": fails}, False) == ("PROMOTION", "FAILED")


def test_scalar_kernels(spark):
    assert [text.estimate(x) for x in (None, "", "a", "abcde", "éé")] == [0, 0, 1, 2, 1]
    assert text.truncate("ab" + "😀" * 3, 2) == "ab😀"
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(text.zone(F.lit("a/b/c.txt"), 1)) == "a" and get(text.zone(F.lit("c.txt"), 3)) == "(root)"
    assert get(text.namespace(F.lit("a.B.c"), F.lit("METHOD"))) == "a" and get(text.namespace(F.lit("a.B"), F.lit("CLASS"))) == "a"
    assert get(text.safe_relative_path(F.lit("a\\b//c"))) == "a/b/c"
    assert [get(text.safe_relative_path(F.lit(p))) for p in ("/a", "C:/a", "file:a", "a/../b")] == [None] * 4
    assert get(text.sanitize_remote(F.lit("https://u:p@h.org/r.git?x#y"))) == "https://h.org/r"
    assert get(text.lexical_score(F.lit("The Alpha-beta."), "alpha BETA gamma")) == pytest.approx(2 / 3)
    assert get(text.lexical_score(F.lit("xalpha betax"), "alpha beta")) == pytest.approx(0.25)
    v = text.hash_vector("alpha beta")
    assert len(v) == 384 and (v**2).sum() == pytest.approx(1)
    assert get(text.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_candidates_of_every_kind_of_ambiguous_reference(spark):
    rows = [symbol("a", "A", qualified="x.A"), symbol("b", "B", qualified="x.A"), symbol("c", "C", file="C.java", qualified="x.C")]
    symbols = spark.createDataFrame([*rows, ("d", *rows[0][1:])], SYMBOL)
    refs = spark.createDataFrame([("key", "ka", None, None, None), ("name", None, "x.A", None, None), ("single", None, "x.C", None, None), ("file", None, None, "src/main/java/a/A.java", None), ("line", None, None, "src/main/java/a/A.java", 4), ("past", None, None, "src/main/java/a/A.java", 40), ("none", "z", "x.A", None, None)], "ref_id string, key string, name string, file string, line int")
    got = sorted(tuple(r) for r in runtime.candidate_ids(refs, symbols).collect())
    want = {"key": "ad", "name": "abd", "file": "abd", "line": "abd"}
    assert got == sorted((r, i, k + 1) for r, ids in want.items() for k, i in enumerate(ids))
    status = {r["ref_id"]: r["candidates"] for r in runtime.resolve(refs, symbols).filter("status = 'AMBIGUOUS'").collect()}
    assert status == {r: len(ids) for r, ids in want.items()}


def test_chunks_are_excerpts_of_placed_symbols(spark):
    rows = [symbol("a", "A", file="A.java"), symbol("b", "B", file="B.java"), symbol("c", "C", file=None), symbol("x", "X", external=True)]
    symbols = spark.createDataFrame(rows, SYMBOL).withColumns({"start_line": F.lit(4), "end_line": F.lit(5)})
    lines = spark.createDataFrame([("A.java", i, f"line {i}") for i in range(1, 20)], "file_id string, line int, text string")
    for given, want in ((lines, "\n".join(f"line {i}" for i in range(2, 8))), (None, "CLASS A")):
        got = {r["stable_key"]: r["content"] for r in retrieval.semantic_documents(symbols, given).filter("kind = 'CHUNK'").collect()}
        assert got == {"chunk:a:4:5": want, "chunk:b:4:5": "CLASS B"}


def test_excerpts_are_those_of_the_plain_rule(spark):
    import random

    rng, cases = random.Random(5), []
    for i in range(300):
        lines = [rng.choice(["", "x", "ab" * rng.randint(0, 9), "é漢" * rng.randint(0, 5)]) for _ in range(rng.randint(0, 12))]
        start = rng.randint(1, 13)
        cases.append((i, lines, start, start + rng.randint(0, 5)))
    df = spark.createDataFrame(cases, "i int, lines array<string>, start int, end int")
    for around, budget in ((0, 3), (2, 4), (3, 12), (5, 0)):
        got = df.select("i", text.excerpt_of(F.col("lines"), F.col("start"), F.col("end"), around, budget).alias("e"))
        assert {r["i"]: r["e"] for r in got.collect()} == {i: files.excerpt(own, a, b, around, budget)[2] for i, own, a, b in cases}


def test_spans_meet_the_lines_they_cover(spark):
    spans = [(f"s{i}", f"f{i % 2}", a, b) for i, (a, b) in enumerate([(1, 1), (64, 64), (60, 200), (2, 40_000), (399, 405), (500, 501)])]
    placed = spark.createDataFrame(spans, "id string, file_id string, start_line int, end_line int")
    lines = spark.range(1, 401).select(F.explode(F.array(F.lit("f0"), F.lit("f1"))).alias("file_id"), F.col("id").cast("int").alias("line"), F.format_string("l%d", "id").alias("text"))
    got = {r["id"]: (r["first"], r["covered"]) for r in retrieval.covered_lines(placed, lines, 2, 768).collect()}
    want = {i: [n for n in range(max(1, a - 2), b + 3) if n <= 400] for i, _, a, b in spans}
    assert got == {i: (own[0], [f"l{n}" for n in own]) for i, own in want.items() if own}
    long = spark.range(1, 20_001).select(F.lit("f1").alias("file_id"), F.col("id").cast("int").alias("line"), F.lit("").alias("text"))
    docs = retrieval.semantic_documents(spark.createDataFrame([symbol("a", "A", file="f1")], SYMBOL).withColumns({"start_line": F.lit(5), "end_line": F.lit(19_000)}), long.withColumn("text", F.when(F.col("line") == 9, "nine").otherwise("")))
    chunk = docs.filter("kind = 'CHUNK'").first()["content"]
    assert chunk == files.excerpt(["nine" if n == 9 else "" for n in range(1, 20_001)], 5, 19_000, 2, 768)[2] and len(chunk) == 4 * 768
    assert "Python" not in docs._jdf.queryExecution().executedPlan().toString()


def test_an_indexer_must_fit_the_build_and_have_the_capabilities(spark):
    rows = [("gradle", ["gradle"], ["calls", "types"], 9), ("weak", [], ["calls"], 8), ("fit", ["maven", "ant"], ["types", "calls"], 7), ("any", None, ["calls", "types"], 6)]
    indexers = spark.createDataFrame(rows, "indexer_id string, build_systems array<string>, capabilities array<string>, priority int").withColumns({"languages": F.array(F.lit("java")), "qualified": F.lit(True)})
    languages = spark.createDataFrame([("java",)], "language string")
    got = {r["indexer_id"]: (r["status"], r["chosen"]) for r in history.negotiate(languages, indexers, ("maven",), ("calls", "types")).collect()}
    assert got == {"gradle": ("BUILD_SYSTEM", False), "weak": ("MISSING_CAPABILITIES", False), "fit": ("COMPATIBLE", True), "any": ("COMPATIBLE", False)}


def test_another_models_vectors_are_not_reused(spark):
    documents, index = (spark.createDataFrame(rows, "stable_key string, checksum string") for rows in ([("a", "1"), ("b", "2")], [("a", "1"), ("c", "3")]))
    status = lambda *models: sorted(tuple(r) for r in retrieval.reuse_vectors(documents, index, *models).collect())
    assert status(("p", "m", 64), ("p", "m", 64)) == [("a", "REUSED"), ("b", "ADDED"), ("c", "REMOVED")]
    assert status(("p", "m", 64), ("p", "m", 32)) == [("a", "ADDED"), ("a", "REMOVED"), ("b", "ADDED"), ("c", "REMOVED")]
