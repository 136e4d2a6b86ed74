"""Readers and stores on files made here."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from codelode.operators import context
from codelode.sources import envelopes, files, git, scip
from codelode.operators import discovery
from codelode.sources import trees
from codelode.store import SessionLog, SnapshotStore
from codelode.streaming import sessions


def varint(n):
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


A, B = "scip-java maven g 1 a/A#", "scip-java maven g 1 a/A#run()."


def index_bytes():
    rel = field(1, A) + field(2, 1) + field(3, 1)
    s1 = field(1, A) + field(5, 7) + field(6, "A")
    s2 = field(1, B) + field(6, "run") + field(4, rel) + field(4, field(1, "scip-java maven g 1 z/Z#") + field(4, 1)) + field(7, field(5, "void run()"))
    o1 = field(1, b"".join(map(varint, (2, 4, 5)))) + field(2, A) + field(3, 1)
    o2 = field(1, b"".join(map(varint, (7, 0, 8, 3)))) + field(2, B) + field(3, 8)
    o3 = field(1, b"".join(map(varint, (9, 1, 2)))) + field(2, "scip-java maven g 1 z/Z#") + field(3, 0)
    doc = field(1, "a/A.java") + field(4, "java") + b"".join(field(2, o) for o in (o1, o2, o3)) + field(3, s1) + field(3, s2)
    return field(1, field(3, "root")) + field(2, doc)


def test_scip_index(spark, tmp_path):
    (tmp_path / "index.scip").write_bytes(index_bytes())
    docs = scip.read_index(spark, f"file://{tmp_path}/index.scip").cache()
    known = scip.symbols(docs, "p").cache()
    got = {r["name"]: (r["kind"], r["qualified_name"], r["start_line"], r["identity_quality"]) for r in known.collect()}
    assert got == {"A": ("CLASS", "a.A", 3, "STRUCTURAL_FALLBACK"), "run": ("METHOD", "a.A.run", None, "STRUCTURAL_FALLBACK")}
    occ = sorted((r["start_line"], r["end_line"], r["roles"], r["resolution_status"], r["unresolved_name"]) for r in scip.occurrences(docs, known, "p").collect())
    assert occ == [(3, 3, ["DEFINITION"], "RESOLVED", None), (8, 9, ["READ", "REFERENCE"], "RESOLVED", None), (10, 10, ["REFERENCE"], "UNRESOLVED", "Z")]
    rel = sorted((r["kind"], r["target_id"] is not None, r["unresolved_target"]) for r in scip.relationships(known, "p").collect())
    assert rel == [("IMPLEMENTS", True, None), ("REFERENCES", True, None), ("TYPE_DEFINITION", False, "z.Z")]
    with pytest.raises(ValueError):
        scip.decode(index_bytes()[:-3])


@pytest.mark.parametrize(("raw", "language", "name", "kind"), [
    ("scip-java maven g 1 a/B#c().", "java", "a.B.c", "METHOD"), ("scip-java maven g 1 a/f(+1).", "java", "a.f", "OTHER"), ("scip-java maven g 1 a/f().", "java", "a.f", "FUNCTION"),
    ("scip-typescript npm p 1 src/`x.ts`/K#`<constructor>`().", "typescript", "K.constructor", "CONSTRUCTOR"), ("local 3", "java", None, "OTHER"), ("a b c", "java", None, "OTHER"), ("s m a  b 1 `x``y`#", "java", "x`y", "TYPE"), ("s m g 1 a/B#(", "java", None, "OTHER"),
])
def test_descriptors(raw, language, name, kind):
    assert (scip.qualified_name(raw, language), scip.descriptor_kind(raw)) == (name, kind)


SESSION = "runtime-observations-v1\nsession\ts1\nproject\tp\nsnapshot\tn\nstarted\t2024-01-01T00:00:00Z\nended\t2024-01-01T01:00:00Z\ncollector\tc\t1\nenvironment\ttest\ncompleteness\tPARTIAL\n"


def test_session_files(spark, tmp_path):
    (tmp_path / "s.tsv").write_text(SESSION + "symbol\tk\t\t\t\t3\t50\ncall\t\tq.A\t\t\t\t\tf.java\t7\t2\t9\nline\tf.java\t4\t1\n")
    rows = envelopes.read_sessions(spark, f"file://{tmp_path}/s.tsv").orderBy("line_number").collect()
    assert [(r["type"], r["hits"], r["nanos"], r["source_line"], r["target_line"]) for r in rows] == [("SYMBOL_EXECUTION", 3, 50, None, None), ("CALL", 2, 9, None, 7), ("LINE_COVERAGE", 1, 0, 4, None)]


@pytest.mark.parametrize("tail", ["", "\n", "symbol\tk\t\t\t\t0\t50\n", "other\tk\n", "line\tf\tx\t1\n", "symbol\t\t\t\t\t1\t1\n"])
def test_session_files_with_errors(tail):
    with pytest.raises(ValueError):
        envelopes.parse_session(SESSION + tail)


def test_program_graph_sidecar(spark, tmp_path):
    head, edge = "\t".join(envelopes.NODES), "\t".join(envelopes.EDGES)
    (tmp_path / "metadata.properties").write_text("formatVersion=1\nsnapshotId=n\n")
    (tmp_path / "nodes.tsv").write_text(f"{head}\nn1\ts1\tSYMBOL\tA\t\t\t\t\t\t\nn2\t\tVARIABLE\tv\t\t\t\t\t\t\n")
    (tmp_path / "edges.tsv").write_text(f"{edge}\ne1\tn1\tn2\tDEF_USE\n")
    known = spark.createDataFrame([("s1",)], "id string")
    nodes, edges, _ = envelopes.read_program_graph(spark, f"file://{tmp_path}", "n", known)
    assert (nodes.count(), edges.count()) == (2, 1)
    assert envelopes.read_program_graph(spark, f"file://{tmp_path}", "other", known)[2] == ["SIDECAR_STALE_SNAPSHOT"]
    (tmp_path / "edges.tsv").write_text(f"{edge}\ne1\tn1\tgone\tDEF_USE\n")
    with pytest.raises(ValueError, match="end is unknown"):
        envelopes.read_program_graph(spark, f"file://{tmp_path}", "n", known)


@pytest.mark.parametrize(("rules", "path", "folder", "out"), [
    ("*.log", "a/b.log", False, True), ("/b.log", "a/b.log", False, False), ("build/", "build", False, False), ("build/", "build", True, True), ("build/", "x/build/y", False, True), ("*.log\n!keep.log", "keep.log", False, False),
    ("a/**/z", "a/b/c/z", False, True), ("a/**/z", "a/z", False, True), ("[!a].c", "b.c", False, True), ("\\#x", "#x", False, True), ("# note", "# note", False, False), ("?.c", "ab.c", False, False), ("a.c", "axc", False, False),
])
def test_ignore_rules(rules, path, folder, out):
    assert files.ignored(path, folder, [files.IgnoreRules(rules)]) is out


def test_discovery_and_fingerprints(spark, tmp_path):
    for p, body in {"pom.xml": "<p/>", "m/pom.xml": "<p/>", "m/src/main/java/A.java": "class A {}", "web/package.json": "{}", "web/src/a.ts": "1", "yarn.lock": "", "target/x.class": "x", ".gitignore": "*.tmp\n", "a.tmp": "x"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(body)
    paths = files.list_project(str(tmp_path))
    assert "a.tmp" not in paths and "target/x.class" not in paths and ".gitignore" in paths
    table = spark.createDataFrame([("p", x) for x in paths] + [("lone", "a/b.go"), ("lone", "README")], "project_id string, path string")
    modules = discovery.modules(table)
    assert sorted((m["project_id"], m["module_path"], m["name"], m["build_systems"]) for m in modules.collect()) == [("lone", "", "lone", []), ("p", "", "p", ["MAVEN", "YARN"]), ("p", "m", "m", ["MAVEN", "YARN"]), ("p", "web", "web", ["YARN"])]
    assert {(r["project_id"], r["root"], r["language"]) for r in discovery.source_roots(table, modules).collect()} == {("p", "m/src/main/java", "JAVA"), ("p", "web/src", "TYPESCRIPT"), ("lone", "", "GO")}
    assert discovery.modules(table.limit(0)).count() == 0 and discovery.source_roots(table.limit(0), modules).count() == 0
    found = {r["path"]: r["size"] for r in files.fingerprints(spark, f"file://{tmp_path}").collect()}
    assert found["m/src/main/java/A.java"] == 10
    assert files.source_lines(spark, f"file://{tmp_path}", "*.java").first()["text"] == "class A {}"
    assert files.excerpt([f"line {i}" for i in range(1, 30)], 10, 10, 3, 8) == (9, 12, "line 9\nline 10\nline 11\nline 12")


def test_ignored_paths_are_those_of_the_rules(spark):
    rules = [files.IgnoreRules("*.log\n!keep.log\nbuild/\n/top.txt\na[0-9].c\nd\\#x\n"), files.IgnoreRules("**/gen/*.java\n")]
    paths = ["x.log", "a/keep.log", "build", "build/x", "b/build/c/x", "top.txt", "a/top.txt", "a1.c", "ab.c", "q/d#x", "s/gen/A.java", "s/gen/t/A.java", "node_modules/x", "a/.git/x", "a.git/x", "out", "layout/x"]
    got = {r["path"]: r["i"] for r in spark.createDataFrame([(p,) for p in paths], "path string").select("path", discovery.is_ignored(F.col("path"), rules).alias("i")).collect()}
    assert got == {p: files.ignored(p, False, rules) for p in paths}


def test_files_are_read_in_pieces(spark, tmp_path):
    import hashlib

    big = ("line é of a long file\n" * 9000).encode()
    made = {"a/big.txt": big, "a/empty.txt": b"", "b.bin": bytes(range(256)) * 3, "c/win.txt": b"one\r\ntwo\rthree\n\nlast", "c/cut.txt": "é".encode() * 400 + b"\xff!"}
    for p, body in made.items():
        (tmp_path / "tree" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / p).write_bytes(body)
    (tmp_path / "outside.txt").write_text("secret")
    (tmp_path / "tree/link.txt").symlink_to(tmp_path / "outside.txt")
    (tmp_path / "tree/linked").symlink_to(tmp_path)
    root = f"file://{tmp_path}/tree"
    found = {r["path"]: (r["size"], r["sha"]) for r in files.fingerprints(spark, root, chunk=1000, pack=2000).collect()}
    assert found == {p: (len(b), hashlib.sha256(b).hexdigest()) for p, b in made.items()}  # and nothing through links
    lines = trees.read(spark, root, lines=True, chunk=7)
    for p in ("a/big.txt", "c/win.txt", "c/cut.txt", "a/empty.txt"):
        want = made[p].decode(errors="replace").replace("\r\n", "\n").replace("\r", "\n").split("\n")
        assert [r["text"] for r in lines.filter(F.col("path") == p).orderBy("line").collect()] == want
    pieces = trees.read(spark, root, pieces=True, chunk=1000).filter("path = 'a/big.txt'").orderBy("piece").collect()
    assert b"".join(bytes(r["data"]) for r in pieces) == big and max(len(r["data"]) for r in pieces) == 1000
    assert trees.read(spark, root, chunk=1000, pack=1).rdd.getNumPartitions() == 5 and trees.read(spark, root).rdd.getNumPartitions() == 1
    assert {r["path"] for r in trees.read(spark, root, pattern="*.txt", most=5000).collect()} == {"a/empty.txt", "c/win.txt", "c/cut.txt"}
    with pytest.raises(ValueError, match="outside"):
        trees.read(spark, root, paths=["../outside.txt"])
    with pytest.raises(ValueError, match="link"):
        trees.read(spark, root, paths=["linked/outside.txt"])
    assert trees.read(spark, root, paths=["b.bin"]).first()["size"] == 768


def test_git_history(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=N", "-c", "user.email=N@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.txt").write_text("one\ntwo\nthree\n")
    run("add", "."), run("commit", "-qm", "first")
    (tmp_path / "a.txt").rename(tmp_path / "b.txt")
    run("add", "-A"), run("commit", "-qm", "second")
    commits, changed, limits = git.read_history(spark, str(tmp_path))
    assert limits == [] and git.read_history(spark, str(tmp_path), 1)[2] == ["HISTORY_TRUNCATED"] and git.read_history(spark, str(tmp_path), 1)[0].count() == 1
    assert [r["message"] for r in commits.orderBy("scan_pos").collect()] == ["second", "first"]
    assert sorted(r["path"] for r in changed.collect()) == ["a.txt", "b.txt"]
    assert git.repository_facts(str(tmp_path))["clean"]


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    rows = lambda n: spark.range(n).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"))
    assert store.active("p") is None
    store.publish("p", "one", {"symbols": rows(3)})
    store.publish("p", "two", {"symbols": rows(5)})
    assert (store.active("p"), store.load("p", "symbols").count()) == ("two", 5)
    with pytest.raises(ValueError, match="duplicate id"):
        store.publish("p", "bad", {"symbols": rows(1).union(rows(1))})
    assert store.active("p") == "two"
    session = spark.createDataFrame([("p", "s", "sha", 1)], "project_id string, session_id string, source_sha256 string, hits int")
    assert store.append_session(session) and not store.append_session(session)
    with pytest.raises(ValueError, match="other content"):
        store.append_session(session.withColumn("source_sha256", F.lit("x")))


def test_sessions_are_added_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = {"session_id": "s", "project_id": "p", "hits": 1, "nanos": 2, "source_sha256": "a"}
    out, check = f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    for k in range(2):
        (tmp_path / f"in/{k}.json").write_text(json.dumps(row | {"session_id": f"s{k}"}) + "\n" + json.dumps(row) + "\n")
        sessions.ingest(spark, f"file://{tmp_path}/in", out, check).awaitTermination()
    kept = SessionLog(spark, out).load().select("session_id").collect()
    assert sorted(r["session_id"] for r in kept) == ["s", "s0", "s1"]


def test_code_search_keeps_its_budget(spark):
    symbols = spark.createDataFrame([(f"s{i}", "p", f"k{i}", None, "f", "CLASS", f"Alpha{i}", f"x.Alpha{i}", None, "java", 1, 0, 2, False, False) for i in range(4)], "id string, project_id string, symbol_key string, module_id string, file_id string, kind string, name string, qualified_name string, signature string, language string, start_line int, start_column int, end_line int, external boolean, generated boolean")
    relations = spark.createDataFrame([(f"r{i}", "p", "SYMBOL", "s0", "SYMBOL", f"s{i}", None, "CALLS", "RESOLVED", "FACTUAL", None, "f", 1) for i in range(1, 4)], "id string, project_id string, source_type string, source_id string, target_type string, target_id string, unresolved_target string, kind string, resolution_status string, nature string, confidence double, file_id string, start_line int")
    occurrences = spark.createDataFrame([("o1", "p", "s0", "f", 1, 1, ["CALL"])], "id string, project_id string, symbol_id string, file_id string, start_line int, start_column int, roles array<string>")
    excerpts = symbols.select(F.col("id").alias("root"), F.lit("code " * 100).alias("source"))
    first, *others = context.search(symbols, occurrences, relations, "p", "alpha", limit=2, per_node=2, max_tokens=300, excerpts=excerpts).orderBy("position").collect()
    assert (first["symbol_id"], len(first["relations"]), first["usages"], first["truncated"], others) == ("s0", 2, ["o1"], True, [])
    rest = 300 - 24 - (first["tokens"] - -(-len(first["source"]) // 4))  # what relations and usages left of the budget
    assert len(first["source"]) == 4 * rest and first["tokens"] == 276 and first["response_truncated"]
    whole = context.search(symbols, occurrences, relations, "p", "alpha", limit=4, per_node=5, max_tokens=4000, excerpts=excerpts).orderBy("position").collect()
    assert [r["symbol_id"] for r in whole] == ["s0", "s1", "s2", "s3"] and all(r["source"] == "code " * 100 and not r["truncated"] and not r["response_truncated"] for r in whole)
    assert [[x["direction"] for x in r["relations"]] for r in whole] == [["OUTGOING"] * 3, *[["INCOMING"]] * 3]
    deep = context.symbol_contexts(symbols.filter("id = 's1'"), occurrences, relations, depth=3, per_node=5).first()
    assert [(x["level"], x["from_node"], x["id"]) for x in deep["relations"]] == [(1, "s1", "r1"), (2, "s0", "r2"), (2, "s0", "r3")]
    assert context.symbol_contexts(symbols.limit(0), occurrences, relations).count() == 0
    none = context.symbol_contexts(symbols, occurrences, relations, depth=0, usages=0)
    assert none.count() == 4 and none.filter("truncated OR size(relations) + size(usages) > 0 OR source IS NOT NULL").count() == 0


def test_a_node_of_very_many_relations_is_no_task_of_its_own(spark):
    relations = spark.range(20_000).select(F.format_string("r%06d", "id").alias("id"), F.lit("p").alias("project_id"), F.lit("SYMBOL").alias("source_type"), F.format_string("s%d", "id").alias("source_id"), F.lit("SYMBOL").alias("target_type"), F.lit("hub").alias("target_id"), F.lit(None).cast("string").alias("unresolved_target"), F.lit("CALLS").alias("kind"), F.lit("FACTUAL").alias("nature"), F.lit(None).cast("string").alias("file_id"), F.lit(None).cast("int").alias("start_line"))
    near = context.around(relations, spark.createDataFrame([("hub",), ("s7",)], "node string"), 5)
    assert "WindowGroupLimit" in near._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["node"], r["position"]) for r in near.collect()) == [("hub", k) for k in range(1, 6)] + [("s7", 1)]
    walk = context.walks(relations, spark.createDataFrame([("s7",), ("nobody",)], "root string"), 2, 3).collect()
    assert {r["root"]: len(r["steps"]) for r in walk} == {"s7": 4, "nobody": 0} and {r["root"]: r["first_over"] for r in walk}["s7"] == 1


def test_walks_of_many_roots_go_through_the_relations_once(spark):
    ends = [("a", "b"), ("a", "c"), ("a", "d"), ("a", "a"), ("b", "a"), ("b", None), ("c", "b"), ("d", "b"), ("d", "b"), ("e", "a"), ("f", "d"), ("b", "b"), (None, "b")] + [(f"x{i}", "hub") for i in range(9)]
    rows = [(f"r{i:02d}", "p", "SYMBOL", s, t and "SYMBOL", t, None if t else "ext", ("CALLS", "READS", "IMPORTS")[i % 3], "FACTUAL", None, i % 4) for i, (s, t) in enumerate(ends)]
    relations = spark.createDataFrame(rows, "id string, project_id string, source_type string, source_id string, target_type string, target_id string, unresolved_target string, kind string, nature string, file_id string, start_line int")
    roots = spark.createDataFrame([(x,) for x in (*"abcdef", "hub", "x1", "nobody")], "root string")
    read = lambda df: {r["root"]: (r["steps"], r["first_over"]) for r in df.collect()}
    for depth, each in ((0, 3), (1, 1), (2, 3), (3, 2), (2, 50)):
        assert read(context.walks(relations, roots, depth, each, many=True)) == read(context.walks(relations, roots, depth, each))


def test_contexts_of_all_files_and_symbols_publish_nothing(spark, monkeypatch):
    from codelode.plans import catalog, registry

    def publish(*_):
        raise AssertionError("published")

    monkeypatch.setattr(registry, "published", publish)
    for name in ("n06_file_contexts", "n07_symbol_contexts", "i07_all_walks"):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")


def test_a_session_file_is_read_one_observation_after_another():
    from codelode.sources import envelopes

    head = f"{envelopes.FORMAT}\nsession\ts\nproject\tp\nsnapshot\tx\nstarted\ta\nended\tb\ncollector\tagent\t1\nenvironment\te\ncompleteness\tPARTIAL\n"
    rows = envelopes.session_rows(head + "symbol\tk\t\t\t\t1\t0\nbad\n")
    assert next(rows)["source_key"] == "k"
    with pytest.raises(ValueError, match="line 11"):
        next(rows)
