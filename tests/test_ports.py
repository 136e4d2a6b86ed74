"""Extension points, the snapshot store, PostgreSQL statements and published tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from codelode import graphs, ports, store
from codelode.operators import traverse
from codelode.sources import databases, java, scip


def test_providers_are_found_by_name(spark):
    embedding = ports.provider("embedding", "hash")
    assert isinstance(embedding, ports.EmbeddingProvider) and embedding.key == ("hash", "v1", 384)
    ports.register("graph", "none", lambda: None)
    with pytest.raises(ValueError, match="already"):
        ports.register("graph", "none", lambda: None)
    with pytest.raises(LookupError, match="no indexer provider x"):
        ports.provider("indexer", "x")
    reader = ports.provider("source", "lines", {"A": ["one", "two", "three"]})
    assert isinstance(reader, ports.SourceReader) and reader.excerpt("A", 2, 2, 0, 10) == "two" and reader.full("A")[0] == "one"
    assert isinstance(ports.provider("discovery", "default"), ports.Discovery)


def test_vector_stores_replace_and_delete(spark, tmp_path):
    vectors = ports.provider("vectors", "parquet", spark, f"file://{tmp_path}/v")
    index = spark.createDataFrame([("a", "1", [1.0, 0.0]), ("b", "2", [0.0, 1.0])], "stable_key string, checksum string, vector array<double>")
    vectors.replace("p", index)
    assert isinstance(vectors, ports.VectorStore) and [r["stable_key"] for r in vectors.search("p", [1.0, 0.1], 2).collect()] == ["a", "b"]
    vectors.replace("p", index.limit(1))
    assert vectors.load("p").count() == 1
    vectors.delete("p")
    assert vectors.load("p").count() == 0


def test_of_two_writers_one_moves_the_pointer(spark, tmp_path):
    rows = spark.createDataFrame([("a",)], "id string")
    one, two = (store.SnapshotStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    one.publish("p", "s1", {"t": rows})
    with pytest.raises(RuntimeError, match="not s0"):
        two.publish("p", "s2", {"t": rows}, expected="s0")
    seen = two._pointer
    two._pointer = lambda project: (0, {})  # what it read before the other wrote
    with pytest.raises(RuntimeError, match="another writer"):
        two.promote("p", "s2")
    two._pointer = seen
    two.promote("p", "s2", expected="s1")
    assert one.active("p") == "s2" and one.active("q") is None and one.counts("p") == {}
    with pytest.raises(ValueError, match="exactly one"):
        one.append_session(spark.createDataFrame([], "project_id string, session_id string, source_sha256 string"))


def test_published_tables_are_made_once(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(1000).withColumn("x", F.col("id") % 7)
    for source in ("a", "a", "b"):
        assert store.published(spark, source, "numbers", make, ["x"]).filter("x = 3").count() == 143
    assert len(made) == 2
    (tmp_path / "f").write_text("1")
    mark = store.files_mark(spark, f"file://{tmp_path}")
    (tmp_path / "f").write_text("22")
    assert store.files_mark(spark, f"file://{tmp_path}") != mark


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        applicationId, master = "other-app", "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="must name a folder"):
        store.shared_folder(Session())


def test_statements_make_and_merge_the_tables():
    con = duckdb.connect()
    for s in databases.ddl("k"):
        if "EXTENSION" not in s:
            con.execute(s.replace("vector(384)", "FLOAT[384]").replace("timestamptz", "TIMESTAMP"))
    tables = {r[0] for r in con.execute("SELECT table_name FROM information_schema.tables WHERE table_schema = 'k'").fetchall()}
    assert tables == set(databases.TABLES) and con.execute("SELECT version FROM k.schema_version").fetchall() == [(1,)]
    con.execute("CREATE TABLE k.staging AS SELECT 'p' AS project_id, 's' AS snapshot_id, 'x' AS sha256, now()::TIMESTAMP AS created_at, '{}' AS contents")
    for _ in range(2):  # what is there stays
        con.execute(databases.merge_sql("k", "snapshots", "staging"))
    assert con.execute("SELECT count(*) FROM k.snapshots").fetchone() == (1,)
    for snapshot in ("s", "t"):
        for statement in databases.promote_sql("k"):
            con.execute(statement, ["p", snapshot])
    assert con.execute("SELECT * FROM k.active_snapshots").fetchall() == [("p", "t")]


@pytest.fixture
def derby(spark):
    import uuid

    db = databases.Database(spark, f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true")
    db.migrate()
    db.migrate()  # what is there stays
    return db


def _facts(spark, n, name="n"):
    return spark.range(n).select(F.format_string("s%d", "id").alias("id"), *[F.lit(None).cast("string").alias(c) for c in ("symbol_key", "module_id", "signature", "qualified_name")], F.lit("f").alias("file_id"), F.lit("CLASS").alias("kind"), F.lit(f"{name} é '").alias("name"), F.lit("java").alias("language"), F.lit(1).alias("start_line"), F.lit(None).cast("int").alias("start_column"), F.lit(2).alias("end_line"), (F.col("id") % 2 == 0).alias("external"), F.lit(False).alias("generated"))


def test_a_database_publishes_all_or_nothing(spark, derby):
    assert derby.active("p") is None
    with pytest.raises(LookupError):
        derby.load_snapshot("p", "symbols")
    assert derby.publish_snapshot("p", "one", {"symbols": _facts(spark, 500)})
    assert not derby.publish_snapshot("p", "one", {"symbols": _facts(spark, 500).repartition(3)})  # the same rows in another order
    with pytest.raises(ValueError, match="other content"):
        derby.publish_snapshot("p", "one", {"symbols": _facts(spark, 500, "changed")})
    got = derby.load_snapshot("p", "symbols")
    assert got.count() == 500 and {r["name"] for r in got.collect()} == {"n é '"} and dict(got.dtypes)["external"] == "boolean"
    assert derby.publish_snapshot("p", "two", {"symbols": _facts(spark, 3)}) and derby.load_snapshot("p", "symbols").count() == 3
    assert not derby.publish_snapshot("p", "one", {"symbols": _facts(spark, 500)}) and derby.active("p")[0] == "one"  # active again
    assert derby.publish_snapshot("it's", "one", {"symbols": _facts(spark, 2)}) and derby.load_snapshot("it's", "symbols").count() == 2
    left = []
    derby.transaction(lambda run: left.extend(run("SELECT tablename FROM sys.systables WHERE tablename LIKE 'STAGING%'")))
    assert not left
    derby.transaction(lambda run: run('UPDATE codelode.symbols SET "name" = \'x\' WHERE "id" = \'s7\''))
    with pytest.raises(ValueError, match="isn't what was published"):
        derby.load_snapshot("p", "symbols")
    derby.transaction(lambda run: run('UPDATE codelode.snapshots SET "contents" = \'{}\' WHERE "project_id" = \'p\''))
    with pytest.raises(ValueError, match="header"):
        derby.active("p")


def test_a_cluster_keeps_rows_in_parts_beside_the_database(spark, derby):
    db = databases.Database(spark, derby.url, parted=True)
    db.migrate()
    assert db.load_vectors("p").count() == 0
    assert db.publish_snapshot("p", "one", {"symbols": _facts(spark, 500)}) and not db.publish_snapshot("p", "one", {"symbols": _facts(spark, 500).repartition(3)})
    with pytest.raises(ValueError, match="other content"):
        db.publish_snapshot("p", "one", {"symbols": _facts(spark, 500, "changed")})
    got = db.load_snapshot("p", "symbols")
    assert got.exceptAll(_facts(spark, 500).select(*got.drop("project_id", "snapshot_id").columns).selectExpr("'p' AS project_id", "'one' AS snapshot_id", "*")).count() == 0 and got.count() == 500 and dict(got.dtypes)["external"] == "boolean"
    with pytest.raises(Exception, match="UNIQUE"):
        db.publish_snapshot("p", "twice", {"symbols": _facts(spark, 3).union(_facts(spark, 3))})
    assert db.active("p")[0] == "one"
    index = lambda n: spark.range(n).select(F.format_string("d%d", "id").alias("stable_key"), F.lit("SYMBOL").alias("kind"), F.lit("c").alias("checksum"), F.array(F.col("id").cast("float"), F.lit(-2.5e-8).cast("float")).alias("vector"))
    for n in (30, 7, 0):
        db.replace_vectors("p", index(n))
        assert db.load_vectors("p").exceptAll(index(n)).count() == 0 and db.load_vectors("p").count() == n


def test_parts_of_a_table_are_kept_compressed(spark, tmp_path):
    rows = databases.staged(_facts(spark, 20000).withColumns({"project_id": F.lit("p"), "snapshot_id": F.lit("one"), "part": F.lit(0)}), "symbols")
    databases.write_parts(rows, "symbols", f"file://{tmp_path}/parts")
    assert sum(p.stat().st_size for p in (tmp_path / "parts").iterdir() if p.is_file()) < 20000 * 40
    assert databases.read_parts(spark, "symbols", f"file://{tmp_path}/parts").exceptAll(rows).count() == 0


def test_a_snapshot_published_thrice_is_made_once(spark, monkeypatch):
    from codelode.plans import library, registry

    def publish(*_):
        raise AssertionError("published")

    made, load = [], registry.load
    monkeypatch.setattr(registry, "published", publish)
    monkeypatch.setattr(registry, "load", lambda *a: (made.append(a[2]), load(*a))[1])
    got = library.database_publishes(registry.Tables(spark, "/root/testdata/sf0.001"))
    assert [r["outcome"] for r in got.filter("name = 'symbols'").collect()] == ["added", "there", "refused"] and made == ["symbols", "relationships"]


def test_a_transaction_that_fails_changes_nothing(spark, derby, monkeypatch):
    derby.publish_snapshot("p", "one", {"symbols": _facts(spark, 5)})
    monkeypatch.setattr(databases, "promote_sql", lambda *_: ["INSERT INTO codelode.nowhere VALUES (?, ?)"])
    with pytest.raises(Exception, match="(?i)nowhere"):
        derby.publish_snapshot("p", "two", {"symbols": _facts(spark, 9)})
    rows = []
    derby.transaction(lambda run: rows.extend(run('SELECT "snapshot_id", count(*) FROM codelode.symbols GROUP BY "snapshot_id"')))
    assert rows == [("one", "5")] and derby.active("p")[0] == "one"


def test_a_database_replaces_vectors(spark, derby):
    index = lambda n: spark.range(n).select(F.format_string("d%d", "id").alias("stable_key"), F.lit("SYMBOL").alias("kind"), F.lit("c").alias("checksum"), F.array(F.col("id").cast("float"), F.lit(0.1).cast("float"), F.lit(-2.5e-8).cast("float")).alias("vector"))
    derby.replace_vectors("p", index(1200))
    derby.replace_vectors("q", index(2))
    derby.replace_vectors("p", index(700))
    got = derby.load_vectors("p")
    assert got.exceptAll(index(700)).count() == 0 and got.count() == 700 and derby.load_vectors("q").count() == 2
    derby.replace_vectors("p", index(0))
    assert derby.load_vectors("p").count() == 0


def test_rows_are_staged_as_the_tables_are(spark):
    index = spark.createDataFrame([("p", "a", "SYMBOL", "1", [1.0, 0.5])], "project_id string, stable_key string, kind string, checksum string, vector array<double>")
    assert tuple(databases.staged(index, "semantic_vectors").first()) == ("p", "a", "SYMBOL", "1", "[1.0,0.5]")
    with pytest.raises(Exception, match="kind"):
        databases.staged(index.drop("kind"), "semantic_vectors")


def test_fragments_of_providers_are_joined(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = lambda *rows: spark.createDataFrame([(i, s, t, k) for i, s, t, k in rows], "id string, source_node_id string, target_node_id string, kind string")
    one, two = ports.GraphFragment(nodes, edges(("1", "a", "b", "CALL")), [], ["PARTIAL"]), ports.GraphFragment(nodes, edges(("1", "a", "b", "CALL"), ("2", "b", "a", "TAINT_FLOW")))
    _, both, declared = traverse.assemble([one, None, two], ["x", "y", "z"])
    assert both.count() == 2 and {tuple(r) for r in declared.collect()} == {("CAPABILITY", "CALL_GRAPH"), ("CAPABILITY", "TAINT_ANALYSIS"), ("LIMITATION", "PARTIAL"), ("LIMITATION", "Y_UNAVAILABLE")}
    bad = ports.GraphFragment(nodes, edges(("1", "b", "a", "CALL")))
    with pytest.raises(Exception, match="conflicting rows under 1"):
        traverse.assemble([one, bad], ["x", "y"])[1].collect()
    assert [tuple(r) for r in traverse.conflicts([one.edges, bad.edges]).collect()] == [("1", 2)]


class Counted(ports.RelationsGraph):
    """A provider that counts what it is asked."""

    def __init__(self):
        self.version, self.asked = "1", 0

    def cache_key(self, snapshot):
        return self.version

    def analyze(self, symbols, relationships, snapshot):
        self.asked += 1
        return super().analyze(symbols, relationships, snapshot)


def test_graphs_are_kept_by_key_within_a_bound(spark):
    import os

    symbols = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    relation = "id string, source_id string, target_id string, target_type string, kind string, resolution_status string, nature string, confidence double"
    rows = spark.createDataFrame([("1", "a", "b", "SYMBOL", "CALLS", "RESOLVED", "FACTUAL", None)], relation)
    provider = Counted()
    assert isinstance(provider, ports.GraphProvider)
    cache = graphs.GraphCache(spark, {"counted": provider}, most=2)
    read = lambda project, snapshot="s": cache.lease(project, snapshot, symbols, rows)
    with read("p") as g:
        assert not g.hit and g.edges.count() == 1 and g.nodes.count() == 2
        names = {r["name"] for r in g.declared.collect()}
        assert names == {"CALL_GRAPH", *graphs.LACKING.values()} - {"CALL_GRAPH_UNAVAILABLE"}
        with read("q"), read("p") as again:
            assert again.hit and provider.asked == 2
        with read("r"):  # q was read longest ago
            assert [k[0] for k in cache.keys()] == ["p", "r"]
        provider.version = "2"
        with read("p") as new:  # the old one has a reader still
            assert not new.hit and g.edges.count() == 1 and [k[0] for k in cache.keys()] == ["r", "p"]
        folder = g.edges.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
        assert os.path.isdir(folder)
    assert not os.path.exists(folder) and (cache.hits, cache.misses) == (1, 4) and [k[0] for k in cache.removed] == ["q", "p"]
    provider.version = " "
    with pytest.raises(ValueError, match="no cache key"), read("p"):
        pass
    provider.version = "3"
    with pytest.raises(Exception), cache.lease("z", "s", symbols, rows.drop("kind")):  # noqa: B017
        pass
    with read("z") as g:  # what failed isn't kept
        assert not g.hit and g.edges.count() == 1


def test_a_workspace_has_bounds(spark):
    symbols = spark.createDataFrame([("a.java",), ("b.java",), ("c.kt",)], "file_id string")
    sizes = spark.createDataFrame([("a.java", 10), ("b.java", 20)], "path string, size long")
    limit = lambda files, **o: java.workspace(symbols, files, **o).first()["limitation"]
    assert [limit(sizes), limit(sizes, most_files=1), limit(sizes, most_file_bytes=15), limit(sizes, most_bytes=25), limit(sizes.limit(1))] == [None, "TOO_MANY_SOURCE_FILES", "SOURCE_FILE_TOO_LARGE", "SOURCES_TOO_LARGE", "SOURCE_FILE_MISSING"]


def test_index_files_hold_what_was_written():
    symbol = {"symbol": "s m p v a/B#", "kind": 7, "display_name": "B", "signature": "class B", "signature_language": "java", "enclosing_symbol": "", "relationships": [{"symbol": "x", "is_reference": True, "is_implementation": False, "is_type_definition": True, "is_definition": False}]}
    one = {"position": 0, "relative_path": "B.java", "language": "java", "encoding": 1, "occurrences": [{"range": [300, 0, 7], "symbol": "s m p v a/B#", "roles": 65}], "symbols": [symbol], "external": False}
    outside = {"position": 1, "relative_path": "", "language": "", "encoding": 0, "occurrences": [], "symbols": [symbol | {"relationships": []}], "external": True}
    assert scip.decode(scip.encode([one, outside])) == [one, outside]


def test_an_index_is_written_and_read_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scip, "PART", 4)
    monkeypatch.setattr(scip, "SPAN", 200)
    symbol = lambda k: (f"s m p v a/B{k}#", 7, f"B{k}", "", "", "", [])
    rows = [(f"ix{i % 2}", i // 2, f"B{i}.java", "java", 0, False, [([i, 0, 7], f"s m p v a/B{i}#", 1)], [symbol(i)]) for i in range(42)]
    rows += [("ix0", 21, "", "", 0, True, [], [symbol(90), symbol(91)])]
    documents = spark.createDataFrame(rows, scip.DOCUMENTS)
    scip.write_index(documents, f"file://{tmp_path}/x")
    files = sorted(p.name for p in (tmp_path / "x").glob("*.scip"))
    assert len(files) == 12  # six of each: no task has an index whole
    got = scip.read_index(spark, f"file://{tmp_path}/x").drop("index").orderBy("external", "position", "relative_path").collect()
    want = documents.drop("index").orderBy("external", "position", "relative_path").collect()
    assert got == want and scip.read_index(spark, f"file://{tmp_path}/x").select("index").distinct().count() == 2
    one = tmp_path / "one.scip"
    one.write_bytes(b"".join((tmp_path / "x" / f).read_bytes() for f in files if f[:64] == files[0][:64]))
    assert scip.read_index(spark, f"file://{one}").filter("NOT external").count() == 21
    own = scip.read_index(spark, f"file://{one}").drop("index").orderBy("position").collect()
    assert [r.asDict(True) for r in own] == [{k: d[k] for k in got[0].asDict()} for d in scip.decode(one.read_bytes())]
    one.write_bytes(one.read_bytes()[:-3])
    with pytest.raises(Exception, match="beyond its message"):
        scip.read_index(spark, f"file://{one}").count()
