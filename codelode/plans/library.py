"""Queries of what else the library computes: index files, snapshots, exports, orders, assembled graphs, searches, scalar kernels, lifecycles and membership."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ports
from ..functions import text
from ..graphs import GraphCache
from ..model import ENTITY_TYPES, NATURES, RELATIONSHIP_KINDS, ordinal_sql
from ..operators import architecture, audit, context, derive, discovery, governance, history, lookup, projects, retrieval, traverse
from ..sources import databases, envelopes, files, java, scip
from ..store import SessionLog, SnapshotStore, scratch, stored
from ..streaming import audit as audit_streams
from ..streaming import sessions
from .history import hash_pad
from .lookups import FILE, SYMBOL, occurrences
from .projection import cte
from .registry import Registry, Tables
from .retrieval import _HYBRID as HYBRID
from .retrieval import VECTOR, hybrid, vectors
from .structure import rounded

R = Registry()
U = "chr(31)"

# --- index files -----------------------------------------------------------------------------------------------------


def documents(t: Tables) -> DataFrame:
    """The flat rows of indexes as their documents."""
    no = F.lit(False)
    related = F.when(F.col("target").isNotNull(), F.array(F.struct(F.col("target").alias("symbol"), F.lit(True).alias("is_reference"), F.col("implementing").alias("is_implementation"), no.alias("is_type_definition"), no.alias("is_definition"))))
    none = F.array().cast("array<struct<symbol:string,is_reference:boolean,is_implementation:boolean,is_type_definition:boolean,is_definition:boolean>>")
    symbol = F.struct(F.col("raw").alias("symbol"), "kind", F.col("display").alias("display_name"), "signature", F.lit("").alias("signature_language"), F.lit("").alias("enclosing_symbol"), F.coalesce(related, none).alias("relationships"))
    own = lambda rows, order, cell, name: rows.groupBy("idx", "doc").agg(F.array_sort(F.collect_list(F.struct(*order, cell.alias("cell")))).alias("all")).select("idx", "doc", F.transform("all", lambda x: x["cell"]).alias(name))
    line, col = F.col("line"), F.col("col")
    place = F.when(~F.col("readable"), F.array(line, col)).when(F.col("l_linenumber") % 2 == 0, F.array(line, col, line + 2, col + 1)).otherwise(F.array(line, col, col + 5))
    use = F.struct(place.alias("range"), F.col("raw").alias("symbol"), F.col("bits").alias("roles"))
    symbols, uses = own(t.index_symbols, ["k"], symbol, "symbols"), own(t.index_uses, ["l_orderkey", "l_linenumber", "l_suppkey", "raw", "bits", "line", "col"], use, "occurrences")
    head = t.index_symbols.select("idx", "doc", "path", "lang").distinct()
    both = head.join(symbols, ["idx", "doc"]).join(uses, ["idx", "doc"], "left")
    return both.select(F.col("idx").alias("index"), F.col("doc").alias("position"), F.col("path").alias("relative_path"), F.col("lang").alias("language"), F.lit(0).alias("encoding"), F.lit(False).alias("external"), F.coalesce("occurrences", F.array().cast("array<struct<range:array<int>,symbol:string,roles:int>>")).alias("occurrences"), "symbols")


def reread(t: Tables) -> DataFrame:
    """The documents written as index files and read back."""
    folder = scratch(t.spark, "indexes")
    scip.write_index(documents(t), folder)
    return scip.read_index(t.spark, folder)


_LOC = "CASE WHEN l_linenumber % 2 = 0 THEN {'start_line': line + 1, 'start_column': col, 'end_line': line + 3, 'end_column': col + 1} ELSE {'start_line': line + 1, 'start_column': col, 'end_line': line + 1, 'end_column': col + 5} END"
_KEY = "CASE WHEN starts_with(raw, 'local ') THEN 'src/main/D' || doc || CASE WHEN doc % 40 = 0 THEN '.kt' ELSE '.java' END ELSE '' END || chr(31) || raw"
_QN = "CASE size % 3 WHEN 0 THEN 'a.b.T' || k WHEN 1 THEN 'a.b.T' || doc || '.m' || k END"
_INDEX = f"""{cte('index_symbols', 'index_uses')}, uses AS (SELECT *, {_KEY} AS key, {_LOC} AS loc FROM index_uses),
defs AS (SELECT idx, key, arg_min(loc, (doc, l_orderkey, l_linenumber, l_suppkey, raw, bits, line, col)) AS loc, bool_or(bits >= 16) AS generated FROM uses WHERE readable AND bits % 2 = 1 GROUP BY idx, key),
facts AS (SELECT s.*, {_KEY} AS key, CASE WHEN lang <> '' THEN lang WHEN ends_with(path, '.kt') THEN 'kotlin' ELSE 'java' END AS language, {_QN} AS qualified_name,
  CASE kind WHEN 0 THEN CASE size % 3 WHEN 0 THEN 'TYPE' WHEN 1 THEN 'METHOD' ELSE 'OTHER' END WHEN 7 THEN 'CLASS' WHEN 26 THEN 'METHOD' ELSE 'VARIABLE' END AS kind_name FROM index_symbols s WHERE trim(display) <> ''),
placed AS (SELECT facts.*, loc, coalesce(generated, false) AS generated, CASE WHEN loc IS NULL THEN '' ELSE loc.start_line || ':' || loc.start_column || '-' || loc.end_line || ':' || loc.end_column END AS spot FROM facts LEFT JOIN defs USING (idx, key)),
keyed AS (SELECT *, 'structural:' || sha256('proj' || {U} || language || {U} || kind_name || {U} || CASE WHEN qualified_name IS NOT NULL THEN qualified_name || {U} || signature || {U} || CASE WHEN signature = '' THEN spot ELSE '' END ELSE path || {U} || display || {U} || signature || {U} || spot END) AS symbol_key FROM placed),
syms AS (SELECT *, 'sym:' || sha256('proj' || {U} || symbol_key) AS id FROM keyed)"""


def shown_key():
    """A symbol's key with a visible separator."""
    return F.replace("key", F.lit("\u001f"), F.lit("|")).alias("key")


R.add("a01_index_files", lambda t: reread(t).filter("NOT external").select("relative_path", F.size("symbols").cast("bigint").alias("symbols"), F.size("occurrences").cast("bigint").alias("occurrences"), F.array_join(F.transform("occurrences", lambda o: o["symbol"]), "|").alias("used")),
      f"{_INDEX}, u AS (SELECT doc, count(*) AS occurrences, string_agg(raw, '|' ORDER BY l_orderkey, l_linenumber, l_suppkey, raw, bits, line, col) AS used FROM index_uses GROUP BY doc) SELECT path AS relative_path, n AS symbols, coalesce(occurrences, 0) AS occurrences, coalesce(used, '') AS used FROM (SELECT path, doc, count(*) AS n FROM index_symbols GROUP BY path, doc) LEFT JOIN u USING (doc)")
R.add("a02_symbol_catalog", lambda t: scip.symbols(documents(t), "proj").select("index", shown_key(), "name", "language", "file_id"), f"{_INDEX} SELECT idx AS \"index\", replace(key, chr(31), '|') AS key, display AS name, language, path AS file_id FROM syms")
R.add("a03_symbol_ids", lambda t: scip.symbols(documents(t), "proj").select("id", "symbol_key", "identity_quality", "start_line", "end_column", "signature"),
      f"{_INDEX} SELECT id, symbol_key, 'STRUCTURAL_FALLBACK' AS identity_quality, loc.start_line AS start_line, loc.end_column AS end_column, nullif(signature, '') AS signature FROM syms")
R.add("a04_symbol_kinds", lambda t: scip.symbols(documents(t), "proj").select("raw_symbol", "kind"), f"{_INDEX} SELECT raw AS raw_symbol, kind_name AS kind FROM syms")
R.add("a05_descriptor_kinds", lambda t: t.index_symbols.select("k", scip._names(F.col("raw"), F.lit("java"))["descriptor_kind"].alias("kind")), f"{cte('index_symbols')} SELECT k, CASE size % 3 WHEN 0 THEN 'TYPE' WHEN 1 THEN 'METHOD' ELSE 'OTHER' END AS kind FROM index_symbols")
R.add("a06_qualified_names", lambda t: t.index_symbols.select("k", scip._names(F.col("raw"), F.lit("java"))["qualified_name"].alias("qualified_name")), f"{cte('index_symbols')} SELECT k, {_QN} AS qualified_name FROM index_symbols")


def index_uses(t: Tables) -> DataFrame:
    docs = documents(t)
    return scip.occurrences(docs, scip.symbols(docs, "proj"), "proj")


_LAST = "CASE WHEN starts_with(raw, 'local ') THEN substr(raw, 7) ELSE regexp_extract(raw, '([A-Za-z0-9]+)[#().]*$', 1) END"
_ROLES = "list_filter([CASE WHEN bits % 2 = 1 THEN 'DEFINITION' END, CASE WHEN bits & 8 <> 0 THEN 'READ' END, CASE WHEN bits & 16 <> 0 THEN 'GENERATED' END, CASE WHEN bits % 2 = 0 THEN 'REFERENCE' END], lambda r: r IS NOT NULL)"
R.add("a07_index_occurrences", lambda t: index_uses(t).select("file_id", "symbol_id", "unresolved_name", "start_line", "start_column", F.array_join(F.array_sort("roles"), ",").alias("roles")),
      f"{_INDEX} SELECT 'src/main/D' || uses.doc || CASE WHEN uses.doc % 40 = 0 THEN '.kt' ELSE '.java' END AS file_id, syms.id AS symbol_id, CASE WHEN syms.id IS NULL THEN {_LAST.replace('raw', 'uses.raw')} END AS unresolved_name, uses.loc.start_line AS start_line, uses.loc.start_column AS start_column, array_to_string(list_sort({_ROLES}), ',') AS roles FROM uses LEFT JOIN syms ON syms.idx = uses.idx AND syms.key = uses.key WHERE readable AND trim(uses.raw) <> ''")
R.add("a08_role_bits", lambda t: t.base("lineitem").select((F.col("l_partkey") % 128).cast("int").alias("bits")).distinct().withColumn("roles", F.array_join(F.array_sort(scip.roles(F.col("bits"), F.col("bits") % 3 != 0)), ",")),
      "WITH b AS (SELECT DISTINCT (l_partkey % 128)::INTEGER AS bits FROM lineitem), r AS (SELECT bits, list_filter([CASE WHEN bits & 1 <> 0 THEN 'DEFINITION' END, CASE WHEN bits & 64 <> 0 THEN 'FORWARD_DEFINITION' END, CASE WHEN bits & 2 <> 0 THEN 'IMPORT' END, CASE WHEN bits & 4 <> 0 THEN 'WRITE' END, CASE WHEN bits & 8 <> 0 THEN 'READ' END, CASE WHEN bits & 16 <> 0 THEN 'GENERATED' END, CASE WHEN bits & 32 <> 0 THEN 'TEST' END, CASE WHEN bits & 65 = 0 AND bits % 3 <> 0 THEN 'REFERENCE' END], lambda x: x IS NOT NULL) AS l FROM b) SELECT bits, CASE WHEN len(l) = 0 THEN 'OTHER' ELSE array_to_string(list_sort(l), ',') END AS roles FROM r")
_RANGE = ("CASE l_linenumber % 4 WHEN 0 THEN array(1) WHEN 1 THEN array(CAST(l_orderkey AS INT), 2, 9) WHEN 2 THEN array(CAST(l_orderkey AS INT), 2, CAST(l_orderkey AS INT) + l_linenumber, 0) ELSE array(1, 2, 3, 4, 5) END")
R.add("a09_ranges", lambda t: t.base("lineitem").select("l_orderkey", "l_linenumber", scip.location(F.expr(_RANGE)).alias("p")).select("l_orderkey", "l_linenumber", "p.start_line", "p.start_column", "p.end_line", "p.end_column"),
      "SELECT l_orderkey, l_linenumber, CASE WHEN m IN (1, 2) THEN (l_orderkey + 1)::INTEGER END AS start_line, CASE WHEN m IN (1, 2) THEN 2 END AS start_column, CASE m WHEN 1 THEN (l_orderkey + 1)::INTEGER WHEN 2 THEN (l_orderkey + l_linenumber + 1)::INTEGER END AS end_line, CASE m WHEN 1 THEN 9 WHEN 2 THEN 0 END AS end_column FROM (SELECT *, l_linenumber % 4 AS m FROM lineitem)")
_RELATED = """, rels AS (SELECT syms.idx, syms.id AS source_id, unnest(CASE WHEN implementing THEN ['REFERENCES', 'IMPLEMENTS'] ELSE ['REFERENCES'] END) AS kind, target FROM syms WHERE target IS NOT NULL),
linked AS (SELECT rels.source_id, rels.kind, known.id AS target_id, CASE WHEN known.id IS NULL THEN replace(regexp_extract(rels.target, ' ([^ ]*)#$', 1), '/', '.') END AS unresolved_target FROM rels LEFT JOIN syms known ON known.idx = rels.idx AND known.raw = rels.target)"""
R.add("a10_index_relationships", lambda t: scip.relationships(scip.symbols(documents(t), "proj"), "proj").select("source_id", "kind", "target_id", "unresolved_target", "nature"), f"{_INDEX}{_RELATED} SELECT *, 'FACTUAL' AS nature FROM linked")
R.add("a11_first_definitions", lambda t: scip.definitions(documents(t)).select("index", shown_key(), "loc.start_line", "loc.start_column", "loc.end_line", "loc.end_column", "generated"),
      f"{_INDEX} SELECT idx AS \"index\", replace(key, chr(31), '|') AS key, loc.start_line AS start_line, loc.start_column AS start_column, loc.end_line AS end_line, loc.end_column AS end_column, generated FROM defs WHERE key <> chr(31) || ' ' OR true")
R.add("a12_unresolved_targets", lambda t: scip.relationships(scip.symbols(documents(t), "proj"), "proj").filter("target_id IS NULL").groupBy("unresolved_target").agg(F.count("*").alias("relations")), f"{_INDEX}{_RELATED} SELECT unresolved_target, count(*) AS relations FROM linked WHERE target_id IS NULL GROUP BY unresolved_target")

# --- files -----------------------------------------------------------------------------------------------------------

_GLOBS = ["*.java", "src/**/1*.txt", "**/2?.java", "src/main/[A-S]*/*7.java"]
R.add("a14_globs", lambda t: t.files_after.select("path", *[F.col("path").rlike(f"^(?:{files.glob_regex(g)})$").alias(f"g{i}") for i, g in enumerate(_GLOBS)]),
      f"{cte('files_after')} SELECT path, regexp_full_match(path, '[^/]*\\.java') AS g0, regexp_full_match(path, 'src/(.*/)?1[^/]*\\.txt') AS g1, regexp_full_match(path, '(.*/)?2[^/]\\.java') AS g2, regexp_full_match(path, 'src/main/[A-S][^/]*/[^/]*7\\.java') AS g3 FROM files_after")


def written_tree(t: Tables) -> str:
    """A folder in which tasks have written every document as a file, below one of 50 folders."""
    root = scratch(t.spark, "tree")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store.create_dir(f"{base}/d{key % 50}", recursive=True)
                with store.open_output_stream(f"{base}/d{key % 50}/{key}.txt", compression=None) as out:
                    out.write((body or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["doc_id"])

    t.base("documents").select("doc_id", "text").mapInArrow(run, "doc_id long").count()
    return root


_FILES = "SELECT 'd' || (doc_id % 50) || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS body FROM documents"
R.add("a17_file_fingerprints", lambda t: files.fingerprints(t.spark, written_tree(t)), f"SELECT path, strlen(body) AS size, sha256(body) AS sha FROM ({_FILES})")
R.add("a26_source_lines", lambda t: files.source_lines(t.spark, written_tree(t), "*7.txt", 50_000).groupBy("path").agg(F.max("line").alias("lines"), F.sum(F.length("text")).alias("chars"), F.md5(F.max_by("text", "line")).alias("last")),
      f"SELECT path, len(l)::INTEGER AS lines, list_sum(list_transform(l, lambda x: length(x)))::BIGINT AS chars, md5(l[-1]) AS last FROM (SELECT path, regexp_split_to_array(body, '\r\n|\n|\r') AS l FROM ({_FILES}) WHERE ends_with(path, '7.txt') AND strlen(body) <= 50000)")


def kept_paths(t: Tables) -> DataFrame:
    rules = [files.IgnoreRules("*.txt\n!*3.txt\n# a remark\n/src/main/SMALL/1*.java\n")]
    return t.files_after.select("path").filter(~discovery.is_ignored(F.col("path"), rules))


#: A tree of eleven projects: modules two folders deep with files of many kinds, and lock files above some.
_TREE = """SELECT 'p' || (p_partkey % 11) AS project_id, CASE WHEN p_partkey % 101 = 0 THEN 'pnpm-lock.yaml' WHEN p_partkey % 97 = 0 THEN 'm' || (p_partkey % 40) || '/yarn.lock' ELSE 'm' || (p_partkey % 40) || '/n' || (p_partkey % 6) || '/' ||
    CASE p_partkey % 29 WHEN 0 THEN 'pom.xml' WHEN 1 THEN 'package.json' WHEN 2 THEN 'go.mod' WHEN 3 THEN 'App.CSPROJ' WHEN 4 THEN 'CMakeLists.txt' WHEN 5 THEN 'src/main/java/x/A.java' WHEN 6 THEN 'src/test/java/T.JAVA' WHEN 7 THEN 'src/a/b.ts' WHEN 8 THEN 'tests/t.py'
      WHEN 9 THEN 'include/x.h' WHEN 10 THEN 'cmd/main.go' WHEN 11 THEN 'src/lib.rs' WHEN 12 THEN 'include/y.hpp' WHEN 13 THEN 'src/tests/pom.xml' WHEN 14 THEN 'src/tests/tests/z.cpp' WHEN 15 THEN 'x.pom.xml' ELSE 'docs/readme.md' END END AS path FROM part WHERE p_partkey % 11 <> 10 OR p_partkey % 29 IN (7, 10, 20)"""
_SYSTEMS = ", ".join(f"('{b}', '{m.lower()[1:] if m.startswith('*') else m}', {m.startswith('*')}, {b in files.INHERITED}, {i})" for i, (b, markers) in enumerate(files.BUILD_MARKERS.items()) for m in markers)
_MODULES = f"""WITH paths AS ({_TREE}), f AS (SELECT project_id, path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS folder, regexp_extract(path, '[^/]*$') AS name FROM paths),
      own AS (SELECT DISTINCT project_id, folder AS module_path FROM f WHERE {" OR ".join(f"ends_with(lower(name), '{m[1:]}')" if m.startswith("*") else f"name = '{m}'" for m in files.MODULE_MARKERS)}),
      modules AS (SELECT * FROM own UNION ALL SELECT DISTINCT project_id, '' FROM f WHERE project_id NOT IN (SELECT project_id FROM own))"""


def tree(t: Tables) -> DataFrame:
    return t.base("part").selectExpr("*").transform(lambda df: df.sparkSession.sql(_TREE.replace("FROM part", "FROM {part}"), part=df))


R.add("a15_modules", lambda t: discovery.modules(tree(t)).select("project_id", "module_path", "name", F.array_join("build_systems", ",").alias("build_systems")),
      f"""{_MODULES}, s(system, marker, ending, inherited, rank) AS (VALUES {_SYSTEMS}), met AS (SELECT DISTINCT m.project_id, module_path, system, rank FROM modules m JOIN f ON f.project_id = m.project_id JOIN s ON CASE WHEN ending THEN ends_with(lower(f.name), marker) ELSE f.name = marker END
        WHERE f.folder = module_path OR inherited AND (f.folder = '' OR starts_with(module_path, f.folder || '/')))
      SELECT project_id, module_path, CASE WHEN module_path = '' THEN project_id ELSE regexp_extract(module_path, '[^/]*$') END AS name, coalesce(string_agg(system, ',' ORDER BY rank), '') AS build_systems FROM modules LEFT JOIN met USING (project_id, module_path) GROUP BY ALL""")
R.add("a16_source_roots", lambda t: (lambda paths: discovery.source_roots(paths, discovery.modules(paths)))(tree(t)),
      f"""{_MODULES}, c(convention, root_kind, language, ending) AS (VALUES {", ".join(str((root, kind, language, e)) for root, kind, language, endings in discovery.CONVENTIONS for e in endings.split())})
      SELECT DISTINCT m.project_id, module_path, root, root_kind, language FROM modules m, c, LATERAL (SELECT CASE WHEN convention = '.' THEN module_path WHEN module_path = '' THEN convention ELSE module_path || '/' || convention END AS root) JOIN f ON f.project_id = m.project_id AND ends_with(lower(f.name), ending) AND (root = '' OR starts_with(f.path, root || '/'))""")


R.add("a13_kept_paths", kept_paths, f"{cte('files_after')} SELECT path FROM files_after WHERE NOT (ends_with(path, '.txt') AND NOT ends_with(path, '3.txt')) AND NOT (starts_with(path, 'src/main/SMALL/1') AND ends_with(path, '.java'))")
R.add("a27_workspace_bounds", lambda t: java.workspace(t.symbols, t.symbols.select(F.col("file_id").alias("path")).distinct().withColumn("size", F.length("path") * 100)),
      f"{cte('symbols')}, f AS (SELECT DISTINCT file_id, length(file_id) * 100 AS size FROM symbols WHERE ends_with(file_id, '.java')), n AS (SELECT count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM f) SELECT files, bytes, 0::BIGINT AS missing, CASE WHEN files > 2000 THEN 'TOO_MANY_SOURCE_FILES' WHEN bytes > 67108864 THEN 'SOURCES_TOO_LARGE' END AS limitation FROM n")


def session_texts(t: Tables) -> DataFrame:
    """Session files of the observations of calls and executions by key, a text for each."""
    o = t.observations.filter("source_key IS NOT NULL AND type <> 'LINE_COVERAGE' AND (type <> 'CALL' OR target_key IS NOT NULL)")
    tail = F.concat_ws("\t", F.col("hits").cast("string"), F.greatest("nanos", F.lit(0)).cast("string"))
    own = F.concat(F.col("source_key"), F.lit("\t\t\t"))
    line = F.when(F.col("type") == "CALL", F.concat_ws("\t", F.lit("call"), own, F.concat(F.col("target_key"), F.lit("\t\t\t")), tail)).otherwise(F.concat_ws("\t", F.lit("symbol"), own, tail))
    meta = F.concat(F.lit(f"{envelopes.FORMAT}\nsession\t"), "session_id", F.lit("\nproject\tproj\nsnapshot\tsnap:1\nstarted\t2024-01-01\nended\t2024-01-02\ncollector\tagent\t1\nenvironment\ttest\ncompleteness\tPARTIAL\n"))
    return o.groupBy("session_id").agg(F.concat(F.first(meta), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n")).alias("content"))


def read_texts(t: Tables) -> DataFrame:
    def run(batches):
        import pandas as pd

        names = ["session_id", "type", "source_key", "target_key", "hits", "nanos"]
        for batch in batches:
            for content in batch.pop("content"):
                rows = envelopes.session_rows(content)
                while piece := [[r[c] for c in names] for r in itertools.islice(rows, 10_000)]:
                    yield pd.DataFrame(piece, columns=names)

    return session_texts(t).select("content").mapInPandas(run, "session_id string, type string, source_key string, target_key string, hits long, nanos long")


R.add("a18_session_files", read_texts, f"{cte('observations')} SELECT session_id, type, source_key, CASE WHEN type = 'CALL' THEN target_key END AS target_key, hits, greatest(nanos, 0) AS nanos FROM observations WHERE source_key IS NOT NULL AND type <> 'LINE_COVERAGE' AND (type <> 'CALL' OR target_key IS NOT NULL)")


def sidecar(t: Tables) -> DataFrame:
    """The program graph's calls below some nodes, written as a sidecar and read back."""
    folder = scratch(t.spark, "sidecar")
    edges = t.graph_edges.filter("kind = 'CALL'").orderBy("id").limit(500)
    nodes = t.graph_nodes.join(edges.select(F.explode(F.array("source_node_id", "target_node_id")).alias("id")).distinct(), "id")
    empty = [F.lit("").alias(c) for c in envelopes.NODES[4:]]
    nodes.select("id", "symbol_id", "kind", "label", *empty).coalesce(1).write.csv(f"{folder}/nodes.tsv", sep="\t", header=True, emptyValue="")
    edges.select(*envelopes.EDGES).coalesce(1).write.csv(f"{folder}/edges.tsv", sep="\t", header=True)
    t.spark.createDataFrame([("snapshotId=snap:1",)], "value string").coalesce(1).write.text(f"{folder}/metadata.properties")
    return envelopes.read_program_graph(t.spark, folder, "snap:1", t.symbols)[1]


_GRAPH = """, graph AS (SELECT CASE kind WHEN 'CALLS' THEN 'call:' WHEN 'READS' THEN 'read-flow:' ELSE 'write-flow:' END || r.id AS id, 'symbol:' || CASE WHEN kind = 'READS' THEN target_id ELSE source_id END AS source_node_id,
  'symbol:' || CASE WHEN kind = 'READS' THEN source_id ELSE target_id END AS target_node_id, CASE WHEN kind = 'CALLS' THEN 'CALL' ELSE 'DATA_FLOW' END AS kind, CASE WHEN kind = 'CALLS' THEN nature ELSE 'DERIVED' END AS nature FROM relationships r WHERE resolution_status = 'RESOLVED' AND kind IN ('CALLS', 'WRITES', 'READS') AND target_id IS NOT NULL
  AND source_id IN (SELECT id FROM symbols) AND target_id IN (SELECT id FROM symbols))"""
R.add("a19_graph_sidecar", sidecar, f"{cte('symbols', 'relationships')}{_GRAPH} SELECT id, source_node_id, target_node_id, kind FROM graph WHERE kind = 'CALL' ORDER BY id LIMIT 500")

# --- snapshots, exports ----------------------------------------------------------------------------------------------


def snapshots(t: Tables) -> SnapshotStore:
    return SnapshotStore(t.spark, scratch(t.spark, "snapshots"))


def published_symbols(t: Tables) -> DataFrame:
    store = snapshots(t)
    store.publish("proj", "s1", {"symbols": t.symbols})
    return store.load("proj", "symbols").select("id", "name", "file_id")


def promoted(t: Tables) -> DataFrame:
    """Two snapshots; the pointer goes to the second and, while that one is active, back to the first."""
    store = snapshots(t)
    store.publish("proj", "java", {"symbols": t.symbols.filter("language = 'java'")})
    store.publish("proj", "other", {"symbols": t.symbols.filter("language <> 'java'")}, expected="java")
    store.promote("proj", "java", expected="other")
    return store.load("proj", "symbols").select("id", "language")


def kept_vectors(t: Tables) -> DataFrame:
    store = ports.provider("vectors", "parquet", t.spark, scratch(t.spark, "vectors"))
    store.replace("proj", vectors(t).limit(0))
    store.replace("proj", vectors(t))
    return store.load("proj").select("stable_key", F.size("vector").alias("dims"), F.element_at("vector", 1).cast("double").alias("first"), F.element_at("vector", -1).cast("double").alias("last"))


#: The given tables put every day into one project, whatever their size: its sessions are all kept, so no bound of a project applies.
UNBOUNDED = {"most_sessions": 1 << 62, "most_bytes": 1 << 62, "most_session_bytes": 1 << 62}


def appended(t: Tables) -> DataFrame:
    """Every session saved twice: only the first time adds it."""
    log = SessionLog(t.spark, scratch(t.spark, "sessions"), **UNBOUNDED)
    rows = t.observations.withColumns({"project_id": F.lit("proj"), "source_sha256": F.sha2("session_id", 256)})
    first, again = log.append(rows), log.append(rows)
    counts = log.load().groupBy("session_id").agg(F.count("*").alias("observations"))
    both = first.select("session_id", (~F.col("already_present")).alias("added")).join(again.select("session_id", (~F.col("already_present")).alias("again")), "session_id")
    return both.join(counts, "session_id").select("session_id", "added", "again", "observations")


def streamed(t: Tables) -> DataFrame:
    """Every session delivered twice in a folder, and the folder read by two streams one after another: each session is in the log once."""
    folder, root = scratch(t.spark, "delivered"), scratch(t.spark, "session-log")
    rows = t.observations.withColumns({"project_id": F.lit("proj"), "source_sha256": F.sha2("session_id", 256)}).repartition("session_id")
    for _ in range(2):
        rows.write.mode("append").json(folder)
    for _ in range(2):
        sessions.ingest(t.spark, folder, root, scratch(t.spark, "checkpoint"), **UNBOUNDED).awaitTermination()
    return SessionLog(t.spark, root).load().groupBy("session_id").agg(F.count("*").alias("observations"))


def baseline_changes(t: Tables) -> DataFrame:
    """Changes against the fingerprints that were promoted as a baseline."""
    store = snapshots(t)
    store.publish("proj", "f1", {"files": t.files_before})
    return history.file_changes(store.load("proj", "files"), t.files_after).groupBy("status").agg(F.count("*").alias("files"))


R.add("a24_loaded_snapshot", published_symbols, f"{cte('symbols')} SELECT id, name, file_id FROM symbols")
R.add("b01_published_counts", lambda t: (lambda s: (s.publish("proj", "s1", {"symbols": t.symbols, "relationships": t.relationships.dropDuplicates(["id"])}), t.spark.createDataFrame(sorted(s.counts("proj").items()), "name string, rows long"))[1])(snapshots(t)),
      f"{cte('symbols', 'relationships')} SELECT 'symbols' AS name, count(*) AS \"rows\" FROM symbols UNION ALL SELECT 'relationships', count(DISTINCT id) FROM relationships")
R.add("b02_promoted_snapshot", promoted, f"{cte('symbols')} SELECT id, language FROM symbols WHERE language = 'java'")
R.add("b04_semantic_index", kept_vectors, "SELECT 'doc:' || vec_id AS stable_key, len(embedding)::INTEGER AS dims, embedding[1]::DOUBLE AS \"first\", embedding[-1]::DOUBLE AS \"last\" FROM embeddings")
R.add("b05_saved_sessions", appended, f"{cte('observations')} SELECT session_id, true AS added, false AS again, count(*) AS observations FROM observations GROUP BY session_id")
R.add("b13_baseline_changes", baseline_changes, f"{cte('files_before', 'files_after')} SELECT CASE WHEN b.sha IS NULL THEN 'added' WHEN a.sha IS NULL THEN 'deleted' WHEN a.sha = b.sha AND a.size = b.size THEN 'unchanged' ELSE 'modified' END AS status, count(*) AS files FROM files_after a FULL JOIN files_before b ON a.path = b.path GROUP BY 1")


def database(t: Tables) -> databases.Database:
    """A database of this session's own; it lives in the driver's JVM, so local sessions alone can write to it."""
    out = databases.Database(t.spark, f"jdbc:derby:memory:q{uuid.uuid4().hex};create=true")
    out.migrate()
    return out


def loaded_from_database(t: Tables) -> DataFrame:
    """The symbols of the active snapshot, the second of two."""
    db = database(t)
    db.publish_snapshot("proj", "s1", {"symbols": t.symbols.filter("language = 'java'")})
    db.publish_snapshot("proj", "s2", {"symbols": t.symbols})
    return db.load_snapshot("proj", "symbols").select("id", "name", "file_id", "external")


def database_publishes(t: Tables) -> DataFrame:
    """A snapshot published, published again, and refused with other rows: what each attempt gave and the rows that the active one has then."""
    db, out = database(t), []
    # written once, as each attempt goes through all of them
    facts = {"symbols": t.projected("symbols"), "relationships": stored(t.projected("relationships").dropDuplicates(["id"]), "relationships", compression="zstd")}
    for attempt, tables in (("first", facts), ("again", facts), ("other", facts | {"symbols": facts["symbols"].withColumn("name", F.lower("name"))})):
        try:
            said = "added" if db.publish_snapshot("proj", "s1", tables) else "there"
        except ValueError:
            said = "refused"
        out += [(attempt, said, name, db.load_snapshot("proj", name).count()) for name in facts]
    return t.spark.createDataFrame(out, "attempt string, outcome string, name string, rows long")


def database_vectors(t: Tables) -> DataFrame:
    db = database(t)
    index = vectors(t).withColumns({"kind": F.lit("SYMBOL"), "checksum": F.md5("stable_key")})
    db.replace_vectors("proj", index.filter("stable_key LIKE '%1'"))
    db.replace_vectors("proj", index)
    return db.load_vectors("proj").select("stable_key", F.size("vector").alias("dims"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double"))), 6).alias("total"))


R.add("a25_database_snapshot", loaded_from_database, f"{cte('symbols')} SELECT id, name, file_id, external FROM symbols")
R.add("b06_database_publishes", database_publishes,
      f"{cte('symbols', 'relationships')}, n AS (SELECT 'symbols' AS name, count(*) AS \"rows\" FROM symbols UNION ALL SELECT 'relationships', count(DISTINCT id) FROM relationships) SELECT attempt, outcome, name, \"rows\" FROM n, (VALUES ('first', 'added'), ('again', 'there'), ('other', 'refused')) a(attempt, outcome)")
R.add("b07_database_vectors", database_vectors, "SELECT 'doc:' || vec_id AS stable_key, len(embedding)::INTEGER AS dims, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS total FROM embeddings")


def exported(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    paths = t.symbols.select("file_id").distinct().filter("length(file_id) % 5 > 0").withColumn("path", F.concat(F.lit("/"), "file_id"))
    return history.export_facts(t.symbols, t.relationships, paths, 5000)


_EXPORT = f"""{cte('symbols', 'relationships')}, known AS (SELECT * FROM symbols WHERE NOT external AND length(file_id) % 5 > 0), kept AS (SELECT * FROM known ORDER BY id LIMIT 5000), inside AS (SELECT * FROM relationships WHERE target_id IS NOT NULL AND source_id IN (SELECT id FROM kept) AND target_id IN (SELECT id FROM kept)), edges AS (SELECT * FROM inside ORDER BY id LIMIT 5000)"""
R.add("b09_exported_symbols", lambda t: exported(t)[0], f"{_EXPORT} SELECT id, kind, name, qualified_name, language, '/' || file_id AS path, start_line, end_line FROM kept")
R.add("b09_exported_relations", lambda t: exported(t)[1], f"{_EXPORT} SELECT id, source_id, target_id, kind, nature FROM edges")
R.add("b09_omissions", lambda t: exported(t)[2],
      f"{_EXPORT}, n AS (SELECT (SELECT count(*) FROM symbols) AS a, (SELECT count(*) FROM symbols WHERE NOT external) AS b, (SELECT count(*) FROM known) AS d, (SELECT count(*) FROM kept) AS e, (SELECT count(*) FROM relationships) AS f, (SELECT count(*) FROM relationships WHERE target_id IS NOT NULL) AS g, (SELECT count(*) FROM inside) AS h, (SELECT count(*) FROM edges) AS i) SELECT omission, \"rows\" FROM (SELECT unnest(['EXTERNAL_SYMBOLS', 'SYMBOLS_WITHOUT_PATH', 'SYMBOLS_BEYOND_LIMIT', 'RELATIONS_NOT_BETWEEN_SYMBOLS', 'RELATIONS_WITHOUT_BOTH_ENDS', 'RELATIONS_BEYOND_LIMIT']) AS omission, unnest([a - b, b - d, d - e, f - g, g - h, h - i]) AS \"rows\" FROM n) WHERE \"rows\" > 0")
R.add("b10_signal_export", lambda t: rounded(retrieval.signal_export(hybrid(t, True), 40).select("position", "stable_key", "kind", "limitations", "lexical"), 8),
      f"{HYBRID} SELECT position, stable_key, kind, concat_ws(',', CASE WHEN semantic = 0 THEN 'NO_SEMANTIC_SIGNAL' END, CASE WHEN graph = 0 THEN 'NO_GRAPH_SIGNAL' END, CASE WHEN lexical = 0 THEN 'NO_LEXICAL_SIGNAL' END) AS limitations, round(lexical, 8) AS lexical FROM (SELECT *, row_number() OVER (ORDER BY score DESC, stable_key)::INTEGER AS position FROM (SELECT *, least(1, greatest(0, 0.5::DOUBLE * greatest(0, least(1, semantic)) + 0.35::DOUBLE * lexical + 0.15::DOUBLE * graph)) AS score FROM sig WHERE lexical > 0 OR semantic > 0)) WHERE position <= 40")
_EDGE_ROWS = ", e AS (SELECT 'B' || (p_size % 4) AS s, 'B' || (p_size % 7) AS t, count(*) AS n FROM part WHERE p_size % 4 <> p_size % 7 GROUP BY ALL), m AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM (SELECT s AS x FROM e UNION SELECT t FROM e))"


def drawn(t: Tables) -> DataFrame:
    edges = t.base("part").select(F.concat(F.lit("B"), F.col("p_size") % 4).alias("source_module"), F.concat(F.lit("B"), F.col("p_size") % 7).alias("target_module")).filter("source_module <> target_module").groupBy("source_module", "target_module").agg(F.count("*").alias("dependency_count"))
    lines = architecture.render_graph(edges).splitlines()
    return t.spark.createDataFrame(list(enumerate(lines, 1)), "line int, text string")


R.add("b11_mermaid", drawn, f"WITH z AS (SELECT 1){_EDGE_ROWS}, l AS (SELECT 0 AS a, '' AS b, '' AS c, 'graph LR' AS text UNION ALL SELECT 1, x, '', '  m' || i || '[\"' || x || '\"]' FROM m UNION ALL SELECT 2, s, t, '  m' || a.i || ' -->|' || n || '| m' || b.i FROM e JOIN m a ON a.x = s JOIN m b ON b.x = t) SELECT row_number() OVER (ORDER BY a, b, c)::INTEGER AS line, text FROM l")
R.add("b12_json", lambda t: t.symbols.select("id", F.to_json(F.struct("id", "kind", "name", "start_line", "external", F.struct("file_id", "language").alias("place"))).alias("json")),
      f"{cte('symbols')} SELECT id, '{{\"id\":\"' || id || '\",\"kind\":\"' || kind || '\",\"name\":\"' || name || '\",\"start_line\":' || start_line || ',\"external\":' || external::VARCHAR || ',\"place\":{{\"file_id\":\"' || file_id || '\",\"language\":\"' || language || '\"}}}}' AS json FROM symbols")

# --- joins, orders ---------------------------------------------------------------------------------------------------

R.add("d15_verified_sources", lambda t: history.verified_sources(t.files_before, t.files_after),
      f"{cte('files_before', 'files_after')}, m AS (SELECT count(*) AS files, count_if(a.sha IS NULL OR a.sha <> b.sha OR a.size <> b.size)::BIGINT AS different FROM files_before b LEFT JOIN files_after a ON a.path = b.path WHERE ends_with(b.path, '.java')) SELECT files, different, different = 0 AS exact, CASE WHEN different > 0 THEN 'SOURCE_FINGERPRINT_MISMATCH' END AS limitation FROM m")
R.add("d16_resolved_paths", lambda t: history.resolve_paths(history.file_ids(t.files_before.select("path"), "proj").select("file_id"), t.files_after, "proj"),
      f"{cte('files_before', 'files_after')} SELECT 'file:' || sha256('proj' || {U} || b.path) AS file_id, a.path FROM files_before b LEFT JOIN files_after a ON a.path = b.path")
R.add("f08_priority_pick", lambda t: history.negotiate(t.symbols.select("language").distinct(), t.base("supplier").select(F.col("s_name").alias("indexer_id"), F.array(F.when(F.col("s_nationkey") % 3 == 0, "java").otherwise("python")).alias("languages"), (F.col("s_acctbal") > 0).alias("qualified"), (F.col("s_nationkey") % 5).alias("priority"))).filter("chosen").select("language", "indexer_id"),
      f"{cte('symbols')}, o AS (SELECT s_name, CASE WHEN s_nationkey % 3 = 0 THEN 'java' ELSE 'python' END AS language, s_nationkey % 5 AS p FROM supplier WHERE s_acctbal > 0) SELECT language, arg_min(s_name, (-p, s_name)) AS indexer_id FROM o WHERE language IN (SELECT language FROM symbols) GROUP BY language")
R.add("g02_file_symbol_order", lambda t: lookup.file_symbols(t.symbols.withColumn("start_line", F.when(F.col("start_line") % 7 > 0, F.col("start_line"))), "proj", FILE, None).select("id", "position"),
      f"{cte('symbols')} SELECT id, row_number() OVER (ORDER BY CASE WHEN start_line % 7 > 0 THEN start_line ELSE 2147483647 END, start_column, qualified_name NULLS LAST, name, id)::INTEGER AS position FROM symbols WHERE file_id = '{FILE}'")
R.add("g03_usage_order", lambda t: lookup.usages(occurrences(t), "proj", "sym:20", 1000).select("id", "position"),
      f"{cte('occurrences')} SELECT id, row_number() OVER (ORDER BY file_id, start_line, start_column, id)::INTEGER AS position FROM occurrences WHERE symbol_id = 'sym:20' AND role NOT IN ('DEFINITION', 'FORWARD_DEFINITION')")
R.add("g05_fact_order", lambda t: derive.top_per_group(t.relationships.filter("nature = 'FACTUAL'"), ["source_id"], derive.fact_order(), 3, "position").select("source_id", "id", "position"),
      f"{cte('relationships')} SELECT source_id, id, position FROM (SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY project_id, {ordinal_sql('source_type', ENTITY_TYPES)}, {ordinal_sql('kind', RELATIONSHIP_KINDS)}, target_id IS NULL, target_id NULLS LAST, unresolved_target NULLS LAST, id)::INTEGER AS position FROM relationships WHERE nature = 'FACTUAL') WHERE position <= 3")
_DIST = "v AS (SELECT 'doc:' || vec_id AS stable_key, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT list_transform(range(64), lambda i: CASE WHEN i % 3 = 0 THEN 1.0 ELSE -0.5 END::DOUBLE) AS q), sem AS (SELECT stable_key, list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q))) AS score FROM v, q)"
R.add("g08_distance_top_k", lambda t: rounded(retrieval.distance_top_k(vectors(t), VECTOR, 30)), f"WITH {_DIST} SELECT stable_key, round(1 - score, 9) AS distance, round(score, 9) AS score FROM sem ORDER BY 1 - sem.score, stable_key LIMIT 30")

# --- graphs ----------------------------------------------------------------------------------------------------------


def fragments(t: Tables) -> list:
    """Two providers that agree on the edges both have, and one that is not at hand."""
    calls, flows = t.graph_edges.filter("kind = 'CALL' OR id LIKE '%7'"), t.graph_edges.filter("kind <> 'CALL'")
    return [ports.GraphFragment(t.graph_nodes, calls, ["CALL_GRAPH"], ["STATIC_ONLY"]), ports.GraphFragment(t.graph_nodes.filter("length(id) % 2 = 0"), flows, [], ["NO_CONTROL_FLOW"]), None]


def assembled(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    return traverse.assemble(fragments(t), ["relations", "flows", "sidecar"])


R.add("i13_assembled_declarations", lambda t: assembled(t)[2], f"{cte('symbols', 'relationships')}{_GRAPH} SELECT DISTINCT 'CAPABILITY' AS what, CASE kind WHEN 'CALL' THEN 'CALL_GRAPH' ELSE 'LOCAL_DATA_FLOW' END AS name FROM graph UNION SELECT 'CAPABILITY', 'CALL_GRAPH' UNION ALL SELECT 'LIMITATION', unnest(['STATIC_ONLY', 'NO_CONTROL_FLOW', 'SIDECAR_UNAVAILABLE'])")
R.add("i13_assembled_graph", lambda t: assembled(t)[1].select("id", "source_node_id", "target_node_id", "kind", "nature"), f"{cte('symbols', 'relationships')}{_GRAPH} SELECT id, source_node_id, target_node_id, kind, nature FROM graph")
def requested_graphs(t: Tables) -> DataFrame:
    """Requests for the graphs of three projects, which share the relations by the length of their ids, to a cache of two: what each request found, what it removed, and how many edges it got."""
    cache, rows = GraphCache(t.spark, {"relations": ports.provider("graph", "relations")}, most=2), []
    for i, (project, snapshot) in enumerate(zip("01020", "aaaab", strict=True), 1):
        before = len(cache.removed)
        own = t.projected("relationships").filter(F.length("id") % 3 == int(project))
        with cache.lease(project, snapshot, t.symbols, own) as graph:
            rows.append(graph.edges.agg(F.lit(i).alias("request"), F.lit(project).alias("project"), F.lit(graph.hit).alias("hit"), F.lit(" ".join(f"{p}{s}" for p, s, _ in cache.removed[before:])).alias("removed"), F.count("*").alias("edges")).first())
    return t.spark.createDataFrame(rows, "request int, project string, hit boolean, removed string, edges long")


#: What a cache of two does with 0a 1a 0a 2a 0b, worked out by hand.
R.add("i14_graph_requests", requested_graphs,
      f"{cte('symbols', 'relationships')}{_GRAPH}, q AS (SELECT * FROM (VALUES (1, '0', false, ''), (2, '1', false, ''), (3, '0', true, ''), (4, '2', false, '1a'), (5, '0', false, '0a')) q(request, project, hit, removed)), n AS (SELECT (length(r.id) % 3)::VARCHAR AS project, count(*) AS edges FROM relationships r WHERE resolution_status = 'RESOLVED' AND kind IN ('CALLS', 'WRITES', 'READS') AND target_type = 'SYMBOL' AND source_id IN (SELECT id FROM symbols) AND target_id IN (SELECT id FROM symbols) GROUP BY ALL) SELECT request, q.project, hit, removed, coalesce(edges, 0) AS edges FROM q LEFT JOIN n ON n.project = q.project")
R.add("i14_cached_graph", lambda t: t.graph_edges.groupBy("kind", "nature").agg(F.count("*").alias("edges"), F.countDistinct("source_node_id").alias("sources")), f"{cte('symbols', 'relationships')}{_GRAPH} SELECT kind, nature, count(*) AS edges, count(DISTINCT source_node_id) AS sources FROM graph GROUP BY kind, nature")


def changed(t: Tables) -> DataFrame:
    return t.graph_edges.filter("kind = 'CALL'").withColumn("nature", F.when(F.col("id").endswith("3"), "HEURISTIC").otherwise(F.col("nature")))


R.add("h01_graph_conflicts", lambda t: traverse.conflicts([t.graph_edges, changed(t)]), f"{cte('symbols', 'relationships')}{_GRAPH} SELECT id, 2::BIGINT AS \"rows\" FROM graph WHERE kind = 'CALL' AND ends_with(id, '3') AND nature <> 'HEURISTIC'")
R.add("h02_provider_union", lambda t: traverse.compose([t.symbols.filter("CAST(substring(id, 5) AS BIGINT) % 3 <> 0"), t.symbols.filter("CAST(substring(id, 5) AS BIGINT) % 3 <> 1")]).select("id", "language", "name"), f"{cte('symbols')} SELECT id, language, name FROM symbols")

#: Java classes made of three templates; what is known of each.
_TEMPLATES = [
    "class C{k} {{ int f(int a) {{ int x = a; if (x > 1) {{ x = x + 1; }} return x; }} }}",
    "class C{k} {{ void g() {{ String s = input(); String t = clean(s); run(t); run(s); }} }}",
    "class C{k} {{ int h(int n) {{ int i = 0; while (i < n) {{ i = i + 1; }} return i; }} }}",
]


def java_sources(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    body = F.when(k % 3 == 0, _TEMPLATES[0]).when(k % 3 == 1, _TEMPLATES[1]).otherwise(_TEMPLATES[2])
    return t.base("part").select(F.concat(F.lit("C"), k.cast("string"), F.lit(".java")).alias("path"), F.replace(F.replace(F.replace(body, F.lit("{k}"), k.cast("string")), F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}")).alias("content"))


RULES = {"sources": ["input"], "sanitizers": ["clean"], "sinks": ["run"]}


def edge_counts(t: Tables, kind: str) -> DataFrame:
    """Edges of a kind of each file, by the file in their source's id."""
    return java.edge_counts(java_sources(t), kind, RULES)


def template_counts(a: int, b: int, c: int) -> str:
    """The same number for every file of a template."""
    return f"SELECT path, edges::BIGINT AS edges FROM (SELECT 'C' || p_partkey || '.java' AS path, CASE p_partkey % 3 WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END AS edges FROM part) WHERE edges > 0"


R.add("i09_control_flow", lambda t: edge_counts(t, "CONTROL_FLOW"), template_counts(5, 4, 5))
R.add("i10_def_use", lambda t: edge_counts(t, "DEF_USE"), template_counts(5, 3, 6))
R.add("i12_taint", lambda t: edge_counts(t, "TAINT_FLOW"), template_counts(0, 3, 0))

# --- searches --------------------------------------------------------------------------------------------------------

R.add("n02_semantic_search", lambda t: rounded(retrieval.semantic_search(vectors(t), "READY", VECTOR, 25, 0.0)), f"WITH {_DIST} SELECT stable_key, round(score, 9) AS score, 'HEURISTIC' AS nature, 'EXACT_LINEAR_SCAN' AS limitation FROM sem WHERE score >= 0 ORDER BY sem.score DESC, stable_key LIMIT 25")
R.add("n02_stale_search", lambda t: retrieval.semantic_search(vectors(t), "STALE", VECTOR, 25).select("stable_key"), "SELECT 'doc:' || vec_id AS stable_key FROM embeddings WHERE false")


def one_context(t: Tables) -> DataFrame:
    found = context.symbol_contexts(lookup.symbol_by_id(t.symbols, "proj", SYMBOL), occurrences(t), t.relationships, depth=1, per_node=4, usages=3, by_target=t.relationships_by_target)
    return found.select("symbol_id", F.posexplode("relations").alias("i", "r")).select("symbol_id", "r.id", "r.direction", (F.col("i") + 1).alias("position"))


_REL_ORDER = f"direction_rank, {ordinal_sql('kind', RELATIONSHIP_KINDS)}, target_id IS NULL, {ordinal_sql('source_type', ENTITY_TYPES)}, source_id, {ordinal_sql('target_type', ENTITY_TYPES)} NULLS LAST, target_id NULLS LAST, unresolved_target NULLS LAST, file_id NULLS LAST, start_line NULLS LAST, id"
R.add("n07_symbol_context", one_context,
      f"{cte('relationships')}, m AS (SELECT *, CASE WHEN source_id = '{SYMBOL}' THEN 0 ELSE 1 END AS direction_rank FROM relationships WHERE source_id = '{SYMBOL}' OR target_id = '{SYMBOL}'), r AS (SELECT *, row_number() OVER (ORDER BY {_REL_ORDER})::INTEGER AS position FROM m) SELECT '{SYMBOL}' AS symbol_id, id, CASE WHEN direction_rank = 0 THEN 'OUTGOING' ELSE 'INCOMING' END AS direction, position FROM r WHERE position <= 4")

# --- scalar kernels --------------------------------------------------------------------------------------------------

_NAMES = "CASE p_partkey % 6 WHEN 0 THEN p_name || 'Tests' WHEN 1 THEN p_name || 'Specification' WHEN 2 THEN p_name || 'IT' WHEN 3 THEN p_name || '.spec' WHEN 4 THEN 'audit' ELSE p_name END"
R.add("s05_test_suffixes", lambda t: t.base("part").select("p_partkey", F.expr(_NAMES).alias("n")).select("p_partkey", text.strip_test_suffix("n").alias("name"), F.regexp_replace("n", text.TEST_FILE_SUFFIX, "").alias("stem")),
      f"SELECT p_partkey, regexp_replace(n, '(tests?|spec(ification)?s?|it)$', '', 'i') AS name, regexp_replace(n, '[._-](tests?|spec(ification)?s?|it)$', '', 'i') AS stem FROM (SELECT p_partkey, {_NAMES} AS n FROM part)")
_PATHS = "CASE p_partkey % 5 WHEN 0 THEN 'a/b/' || p_name || '.java' WHEN 1 THEN p_name WHEN 2 THEN 'x/.hidden' WHEN 3 THEN p_name || '.d.ts' ELSE 'x.y/z' END"
R.add("s06_file_stems", lambda t: t.base("part").select("p_partkey", F.expr(_PATHS).alias("p")).select("p_partkey", text.file_stem("p").alias("stem")),
      f"SELECT p_partkey, CASE WHEN f = '.hidden' THEN f ELSE regexp_replace(f, '\\.[^.]*$', '') END AS stem FROM (SELECT p_partkey, regexp_replace({_PATHS}, '^.*/', '') AS f FROM part)")
_QNAMES = "CASE p_partkey % 4 WHEN 0 THEN 'a.b.' || p_name WHEN 1 THEN 'a/b.C.' || p_brand WHEN 2 THEN p_brand ELSE NULL END"
R.add("s07_namespaces", lambda t: t.base("part").select("p_partkey", text.namespace(F.expr(_QNAMES), F.when(F.col("p_size") % 2 == 0, "METHOD").otherwise("CLASS")).alias("namespace")),
      f"SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN regexp_replace(o, '[./][^./]*$', '') ELSE o END AS namespace FROM (SELECT *, CASE WHEN regexp_matches(coalesce(q, ''), '[./]') THEN regexp_replace(q, '[./][^./]*$', '') ELSE '' END AS o FROM (SELECT *, {_QNAMES} AS q FROM part))")
R.add("s12_worst_natures", lambda t: t.relationships.groupBy("source_id").agg(F.max(traverse.ordinal("nature", NATURES)).alias("n")).select("source_id", F.element_at(F.array(*[F.lit(n) for n in NATURES]), F.col("n") + 1).alias("nature")),
      f"{cte('relationships')} SELECT source_id, list_extract(['FACTUAL', 'DERIVED', 'HEURISTIC'], max({ordinal_sql('nature', NATURES)}) + 1) AS nature FROM relationships GROUP BY source_id")
R.add("s13_path_signatures", lambda t: traverse.flow_paths(t.graph_edges, "symbol:sym:40", 2, 500).select(F.md5(F.replace("path", F.lit(traverse.SEP), F.lit("\u0000"))).alias("signature"), "depth"),
      f"{cte('symbols', 'relationships')}{_GRAPH}, a AS (SELECT id, target_node_id AS n, id AS path, 1 AS depth, target_node_id = 'symbol:sym:40' AS cycle FROM graph WHERE source_node_id = 'symbol:sym:40'), b AS (SELECT a.path || chr(0) || g.id AS path, 2 AS depth, a.path || chr(1) || g.id AS o FROM a JOIN graph g ON g.source_node_id = a.n WHERE NOT a.cycle) SELECT md5(path) AS signature, depth FROM (SELECT path, depth, path AS o FROM a UNION ALL SELECT path, depth, o FROM b) ORDER BY depth, o LIMIT 500")
_UNSAFE = "CASE p_partkey % 7 WHEN 0 THEN '/a/' || p_name WHEN 1 THEN 'C:/x' WHEN 2 THEN 'a/../b' WHEN 3 THEN './a//' || p_brand WHEN 4 THEN 'file:/x' WHEN 5 THEN 'a/./b' ELSE 'src/' || p_name END"
R.add("s16_safe_paths", lambda t: t.base("part").select("p_partkey", text.safe_relative_path(F.expr(_UNSAFE)).alias("path")), "SELECT p_partkey, CASE p_partkey % 7 WHEN 3 THEN 'a/' || p_brand WHEN 5 THEN 'a/b' WHEN 6 THEN 'src/' || p_name END AS path FROM part")


def windows(t: Tables) -> DataFrame:
    """Excerpts of made-up files of p_size lines around one line, under a budget."""
    lines = F.transform(F.sequence(F.lit(1), F.col("p_size").cast("int")), lambda i: F.concat(F.lit("line "), F.lpad(i.cast("string"), 3, "0")))
    at = (F.col("p_partkey") % F.col("p_size") + 1).cast("int")
    return t.base("part").select("p_partkey", text.excerpt_of(lines, at, at, 2, 12).alias("excerpt"))


#: Lines have eight characters: twelve tokens take five of them with their ends.
R.add("s17_excerpts", windows, "WITH p AS (SELECT p_partkey, p_size::BIGINT AS n, (p_partkey % p_size + 1)::BIGINT AS spot FROM part) SELECT p_partkey, array_to_string(list_transform(range(greatest(1, spot - 2), least(n, spot + 2) + 1), lambda i: 'line ' || lpad(i::VARCHAR, 3, '0')), chr(10)) AS excerpt FROM p")
R.add("s18_retention_cutoffs", lambda t: t.audit.groupBy("tenant_id").agg(F.max("occurred_at").alias("now")).select("tenant_id", governance.cutoff(F.col("now"), 30).alias("month"), governance.cutoff(F.col("now"), 1).alias("day")),
      f"{cte('audit')} SELECT tenant_id, max(occurred_at) - INTERVAL 30 DAY AS month, max(occurred_at) - INTERVAL 1 DAY AS day FROM audit GROUP BY tenant_id")

# --- lifecycles, membership ------------------------------------------------------------------------------------------


def refreshes(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.base("orders").select(F.concat(F.lit("p"), k.cast("string")).alias("project_id"), F.element_at(F.array(*[F.lit(x) for x in ("NONE", "INCREMENTAL", "FULL")]), (k % 3 + 1).cast("int")).alias("scope"), F.concat(F.lit("h"), (k % 5).cast("string")).alias("before"), F.concat(F.lit("h"), (k % 7).cast("string")).alias("after"), F.lit("h0").alias("baseline"))


R.add("t04_refresh_outcomes", lambda t: projects.refresh_outcomes(refreshes(t)), "SELECT 'p' || o_orderkey AS project_id, CASE WHEN o_orderkey % 3 = 0 THEN 'NONE' WHEN o_orderkey % 5 <> o_orderkey % 7 THEN 'UNSTABLE' WHEN o_orderkey % 3 = 1 THEN 'INCREMENTAL' ELSE 'FULL' END AS outcome, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 <> o_orderkey % 7 THEN 'h0' ELSE 'h' || (o_orderkey % 5) END AS baseline FROM orders")


def failing(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.base("orders").select(F.concat(F.lit("r"), k.cast("string")).alias("id"), F.when(k % 4 < 3, F.element_at(F.array(*[F.lit(x) for x in projects.LIFECYCLE[:3]]), (k % 4 + 1).cast("int"))).alias("failed_step"), F.when(k % 3 > 0, F.concat(F.lit("s"), k.cast("string"))).alias("snapshot_id"))


R.add("t05_lifecycle_states", lambda t: projects.lifecycle_states(failing(t)), "SELECT 'r' || o_orderkey AS id, list_extract(['PROVIDER_EXECUTION', 'STAGING', 'PROMOTION', 'COMPLETED'], o_orderkey % 4 + 1) AS last_step, CASE WHEN o_orderkey % 4 = 3 THEN 'READY' WHEN o_orderkey % 3 > 0 THEN 'STALE' ELSE 'FAILED' END AS state, CASE WHEN o_orderkey % 4 = 3 THEN 'snap:r' || o_orderkey WHEN o_orderkey % 3 > 0 THEN 's' || o_orderkey END AS active_snapshot FROM orders")


def synchronized(t: Tables) -> DataFrame:
    """An index of older checksums brought up to date; its vectors are told apart from new ones by their first component."""
    old = t.semantic_documents.filter("length(content) % 13 <> 5").select("stable_key", F.when(F.length("content") % 11 == 0, F.lit("stale")).otherwise(F.col("checksum")).alias("checksum"), F.array(F.lit(-1.0), F.length("content").cast("double")).alias("vector"))
    now = t.semantic_documents.filter("length(content) % 17 <> 3")
    done = retrieval.synchronize(old, now, lambda c: F.array(F.lit(1.0), F.length(c).cast("double")), ("p", "m", 2), ("p", "m", 2))
    return done.select("stable_key", "checksum", "reused", F.element_at("vector", 1).alias("first"), F.element_at("vector", 2).alias("second"))


R.add("t06_synchronized_index", synchronized, f"{cte('semantic_documents')}, n AS (SELECT *, length(content) % 13 <> 5 AND length(content) % 11 <> 0 AS reused FROM semantic_documents WHERE length(content) % 17 <> 3) SELECT stable_key, checksum, reused, CASE WHEN reused THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS \"first\", length(content)::DOUBLE AS \"second\" FROM n")
R.add("t07_appended_sessions", streamed, f"{cte('observations')} SELECT session_id, count(*) AS observations FROM observations GROUP BY session_id")


def placed_indexers(t: Tables) -> DataFrame:
    m = t.base("nation").select(F.when(F.col("n_nationkey") == 0, "").otherwise(F.concat(F.lit("m"), F.col("n_nationkey").cast("string"))).alias("module_path"), F.array(F.when(F.col("n_regionkey") % 2 == 0, "MAVEN").otherwise("GRADLE")).alias("build_systems"), "n_regionkey")
    roots = m.select("module_path", F.when(F.col("n_regionkey") < 3, "java").otherwise("python").alias("language"))
    k = F.col("s_suppkey")
    own = t.base("supplier").select(F.concat(F.lit("i"), k.cast("string")).alias("indexer_id"), F.array(F.when(k % 2 == 0, "java").otherwise("python")).alias("languages"), F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.when(k % 3 == 1, "MAVEN").otherwise("GRADLE"))).alias("build_systems"), (k % 5 < 2).alias("multi_module"))
    return projects.scopes(m.drop("n_regionkey"), roots, own)


R.add("t08_execution_scopes", placed_indexers,
      """WITH m AS (SELECT CASE WHEN n_nationkey = 0 THEN '' ELSE 'm' || n_nationkey END AS path, CASE WHEN n_regionkey % 2 = 0 THEN 'MAVEN' ELSE 'GRADLE' END AS build, CASE WHEN n_regionkey < 3 THEN 'java' ELSE 'python' END AS lang FROM nation),
      i AS (SELECT 'i' || s_suppkey AS indexer_id, CASE WHEN s_suppkey % 2 = 0 THEN 'java' ELSE 'python' END AS lang, CASE s_suppkey % 3 WHEN 1 THEN 'MAVEN' WHEN 2 THEN 'GRADLE' END AS build, s_suppkey % 5 < 2 AS multi FROM supplier),
      able AS (SELECT i.*, m.path, m.build AS own FROM i JOIN m ON m.lang = i.lang), root AS (SELECT DISTINCT indexer_id FROM able, (SELECT build AS b FROM m WHERE path = '') WHERE multi AND able.build = b)
      SELECT indexer_id, '' AS scope FROM root UNION ALL SELECT indexer_id, path FROM able WHERE (build IS NULL OR build = own) AND indexer_id NOT IN (SELECT indexer_id FROM root)""")


def audit_events(t: Tables) -> DataFrame:
    """Audit events as they come in, without their places in a chain."""
    said = {"principal_id": "u", "resource_type": "event", "outcome": "ALLOWED", "key_id": "k"}
    own = {"resource_id": F.col("event_id").cast("string"), "request_id": F.format_string("q%012d", "event_id")}
    return t.audit.select("tenant_id", F.col("occurred_at").cast("timestamp").alias("occurred_at"), "action", *[F.lit(v).alias(k) for k, v in said.items()], *[c.alias(k) for k, c in own.items()])


def audited(t: Tables) -> DataFrame:
    """Each tenant's chain checked: how many events it has, and the first one with a problem, once as it is and once with the last event changed."""
    chain = stored(audit.append(b"key", audit_events(t)), "audit-chain")
    last = F.col("sequence") == F.col("end")
    changed = chain.join(audit.heads(chain).select("tenant_id", F.col("sequence").alias("end")), "tenant_id").withColumn("action", F.when(last, "other").otherwise(F.col("action"))).drop("end")
    first = lambda rows, name: audit.verify(b"key", rows, ends=audit.heads(chain)).groupBy("tenant_id").agg(F.min("sequence").alias(name))
    counts = chain.groupBy("tenant_id").agg(F.count("*").alias("events"))
    return counts.join(first(chain, "broken"), "tenant_id", "left").join(first(changed, "broken_changed"), "tenant_id", "left")


def trimmed(t: Tables) -> DataFrame:
    """What is wrong with chains, the first of whose events retention removed and some of whose others were tampered with: a third of the anchors is lost, a few events are gone and a few have another outcome."""
    chain = stored(audit.append(b"key", audit_events(t)), "audit-chain")
    id_ = F.col("resource_id").cast("long")
    kept, gone = chain.filter("sequence > 3"), chain.filter("sequence <= 3")
    known = audit.anchors(gone).filter(F.substring("tenant_id", 2, 20).cast("long") % 3 > 0)
    bad = kept.filter(id_ % 29 != 1).withColumn("outcome", F.when(id_ % 31 == 2, "DENIED").otherwise(F.col("outcome")))
    return audit.verify(b"key", bad, known, audit.heads(chain))


def streamed_chains(t: Tables) -> DataFrame:
    """Events that arrive in two deliveries, the second after the stream was stopped and started again, as chains."""
    folder, chain, checkpoint = (scratch(t.spark, name) for name in ("audit-events", "audit-chains", "audit-checkpoint"))
    late = F.col("occurred_at") >= F.lit("2024-01-16").cast("timestamp")
    for part in (~late, late):
        audit_events(t).filter(part).write.mode("append").parquet(folder)
        audit_streams.extend(t.spark, b"key", folder, chain, checkpoint).awaitTermination()
    return t.spark.read.schema(audit.CHAIN).parquet(chain).select("tenant_id", "sequence", "previous_hash", "hash")


#: Chains event by event; the keyed hash is spelt out with SHA-256.
_HMAC = lambda said: f"sha256(unhex('{hash_pad(0x5C)}') || unhex(sha256(unhex('{hash_pad(0x36)}') || encode({said}))))"
_SAID = "n.tenant_id || chr(0) || n.secs || chr(0) || n.nanos || chr(0) || 'u' || chr(0) || n.action || chr(0) || 'event' || chr(0) || n.event_id || chr(0) || 'ALLOWED' || chr(0) || 'q' || lpad(n.event_id::VARCHAR, 12, '0') || chr(0) || 'k' || chr(0)"
CHAINS = f"""{cte('audit').replace('WITH ', 'WITH RECURSIVE ', 1)}, told AS (SELECT *, epoch_us(occurred_at) // 1000000 AS secs, epoch_us(occurred_at) % 1000000 * 1000 AS nanos FROM audit),
      chain AS (SELECT n.tenant_id, n.sequence, n.event_id, repeat('0', 64) AS previous_hash, {_HMAC(f"'1' || chr(0) || {_SAID} || repeat('0', 64)")} AS hash FROM told n WHERE n.sequence = 1
      UNION ALL SELECT n.tenant_id, n.sequence, n.event_id, c.hash, {_HMAC(f"n.sequence || chr(0) || {_SAID} || c.hash")} FROM told n JOIN chain c ON c.tenant_id = n.tenant_id AND c.sequence + 1 = n.sequence)"""
R.add("v03_audit_chains", audited, f"{cte('audit')} SELECT tenant_id, count(*) AS events, NULL::BIGINT AS broken, count(*) AS broken_changed FROM audit GROUP BY tenant_id")
R.add("v03_audit_hashes", lambda t: audit.append(b"key", audit_events(t)).select("tenant_id", "sequence", "previous_hash", "hash"), f"{CHAINS} SELECT tenant_id, sequence, previous_hash, hash FROM chain")
R.add("v03_streamed_chains", streamed_chains, f"{CHAINS} SELECT tenant_id, sequence, previous_hash, hash FROM chain")
R.add("f05_trimmed_chains", trimmed,
      f"""{cte('audit')}, k AS (SELECT *, min(sequence) OVER (PARTITION BY tenant_id) AS low, lag(sequence) OVER (PARTITION BY tenant_id ORDER BY sequence) AS before FROM audit WHERE sequence > 3 AND event_id % 29 <> 1),
      ends AS (SELECT tenant_id, max(sequence) AS whole, max(sequence) FILTER (WHERE sequence > 3 AND event_id % 29 <> 1) AS is_ FROM audit GROUP BY tenant_id)
      SELECT tenant_id, sequence, 'SEQUENCE' AS problem FROM k WHERE sequence > low AND before <> sequence - 1
      UNION ALL SELECT tenant_id, sequence, 'CHAIN' FROM k WHERE sequence = low AND (substr(tenant_id, 2)::BIGINT % 3 = 0 OR sequence > 4)
      UNION ALL SELECT tenant_id, sequence, 'AUTHENTICATION' FROM k WHERE event_id % 31 = 2
      UNION ALL SELECT tenant_id, coalesce(is_, whole), 'END' FROM ends WHERE is_ IS NULL OR is_ <> whole""")


def changed_members(t: Tables) -> DataFrame:
    k, tenant = F.col("s_suppkey"), F.concat(F.lit("t"), (F.col("s_suppkey") % 7).cast("string")).alias("tenant_id")
    own = t.base("supplier").select(tenant, F.concat(F.lit("u"), k.cast("string")).alias("principal_id"), F.when(k < 8, "OWNER").otherwise("VIEWER").alias("role"))
    changes = t.base("supplier").filter((k % 3 == 0) & (k >= 8)).select(tenant, F.concat(F.lit("u"), (k + k % 2 * 1000).cast("string")).alias("principal_id"), F.when(k % 6 > 0, "ADMIN").alias("role"))
    return governance.upsert_members(own, changes, 1 << 62)  # seven tenants share all suppliers, however many


R.add("v04_members", changed_members,
      "WITH own AS (SELECT 't' || (s_suppkey % 7) AS tenant_id, 'u' || s_suppkey AS principal_id, CASE WHEN s_suppkey < 8 THEN 'OWNER' ELSE 'VIEWER' END AS role FROM supplier), ch AS (SELECT 't' || (s_suppkey % 7) AS tenant_id, 'u' || (s_suppkey + s_suppkey % 2 * 1000) AS principal_id, CASE WHEN s_suppkey % 6 > 0 THEN 'ADMIN' END AS role FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey >= 8) SELECT * FROM own WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.tenant_id = own.tenant_id AND ch.principal_id = own.principal_id) UNION ALL SELECT * FROM ch WHERE role IS NOT NULL")


def changed_workspaces(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    name = lambda n: F.concat(F.lit("w"), n.cast("string")).alias("workspace_id")
    old = t.base("supplier").select(name(k), F.col("s_name").alias("name"), F.lit("ACTIVE").alias("status"), F.lit(None).cast("timestamp").alias("archived_at"))
    at = F.lit("2024-01-01").cast("timestamp").alias("at")
    changes = t.base("supplier").filter(k % 4 == 0).select(name(k), F.lit(None).cast("string").alias("name"), F.lit("ARCHIVE").alias("action"), at).union(t.base("supplier").filter(k % 5 == 0).select(name(k + 10**6), F.col("s_name"), F.lit("CREATE"), at))
    after = governance.change_workspaces(old, changes)
    bound = governance.bind(after.limit(0).select("workspace_id", F.lit("").alias("project_id"), F.lit("").alias("snapshot_id")), after.select("workspace_id", F.lit("p").alias("project_id"), F.concat(F.lit("s"), "name").alias("snapshot_id")), after)
    return after.join(bound, "workspace_id", "left").select("workspace_id", "name", "status", "snapshot_id")


R.add("v07_workspaces", changed_workspaces, "SELECT 'w' || s_suppkey AS workspace_id, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status, CASE WHEN s_suppkey % 4 > 0 THEN 's' || s_name END AS snapshot_id FROM supplier UNION ALL SELECT 'w' || (s_suppkey + 1000000), s_name, 'ACTIVE', 's' || s_name FROM supplier WHERE s_suppkey % 5 = 0")

# --- extension points ------------------------------------------------------------------------------------------------

_PIECES = """w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM benchmark), m AS (SELECT item_id, word, '^' || word || '$' AS marked FROM w),
p AS (SELECT item_id, word AS piece, 1.0::DOUBLE AS weight FROM m UNION ALL SELECT item_id, substr(marked, i::INTEGER, n::INTEGER), 0.35::DOUBLE FROM m, (VALUES (3), (4), (5)) t(n), range(1, 100) r(i) WHERE i + n - 1 <= length(marked)),
d AS (SELECT DISTINCT piece FROM p), h AS (SELECT piece, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, strlen(piece)), lambda i: ('0x' || substr(hex(encode(piece)), (1 + 2 * i)::BIGINT, 2))::BIGINT)), lambda a, b: (xor(a, b) * 16777619) % 4294967296) AS h FROM d),
v AS (SELECT item_id, (((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 384) + 384) % 384 AS slot, sum(CASE WHEN (h // 1073741824) % 2 = 0 THEN weight ELSE -weight END) AS x FROM p JOIN h USING (piece) GROUP BY 1, 2), l AS (SELECT item_id, sqrt(sum(x * x)) AS length FROM v GROUP BY item_id)"""
_SLOTS = f"WITH {_PIECES} SELECT item_id, slot, round(x / length, 6) AS x FROM v JOIN l USING (item_id) WHERE round(x / length, 6) <> 0"


def slots(vector: Callable) -> Callable[[Tables], DataFrame]:
    """A query of the components that aren't zero of the benchmark's vectors."""
    return lambda t: t.base("benchmark").select("item_id", F.posexplode(vector(F.col("text"))).alias("slot", "x")).select("item_id", F.col("slot").cast("bigint").alias("slot"), F.round("x", 6).alias("x")).filter("x <> 0")


R.add("s10_hash_embedding", slots(text.hash_embedding), _SLOTS)
R.add("u01_embedding_provider", slots(lambda c: ports.provider("embedding", "hash").embed(c)), _SLOTS)
