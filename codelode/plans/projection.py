"""The engine's tables as projections of the given ones, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The given tables.
BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _file(p: str) -> str:
    """The file of a part's symbol: a test file for two parts in ten, shared by few; else one of 40 a type."""
    return (
        f"CASE WHEN {p}.p_partkey % 10 < 2 THEN 'src/test/' || {p}.p_type || '/T' || CAST({p}.p_partkey - {p}.p_partkey % 10 AS STRING) || '.java' "
        f"ELSE 'src/main/' || {p}.p_type || '/F' || CAST({p}.p_partkey % 40 AS STRING) || '.java' END"
    )


def _raw(p: str) -> str:
    """A part's symbol as an index spells it: a type, a method or a local one."""
    k, doc = f"CAST({p}.p_partkey AS STRING)", f"CAST({p}.p_partkey - {p}.p_partkey % 20 AS STRING)"
    head = "'scip-java maven g 1.0 a/b/T'"
    return f"CASE {p}.p_size % 3 WHEN 0 THEN {head} || {k} || '#' WHEN 1 THEN {head} || {doc} || '#m' || {k} || '().' ELSE 'local ' || {k} END"


_KINDS = "CALLS REFERENCES IMPORTS EXTENDS IMPLEMENTS READS WRITES INSTANTIATES DEPENDS_ON RELATED_TEST RETURNS DECLARES".split()

VIEWS = {
    "symbols": f"""SELECT 'sym:' || CAST(p_partkey AS STRING) AS id, 'key:' || CAST(p_partkey AS STRING) AS symbol_key, 'proj' AS project_id, p_brand AS module_id,
        {_file("part")} AS file_id,
        CASE p_size % 5 WHEN 0 THEN 'CLASS' WHEN 1 THEN 'METHOD' WHEN 2 THEN 'FUNCTION' WHEN 3 THEN 'FIELD' ELSE 'INTERFACE' END AS kind,
        CASE WHEN p_partkey % 10 < 2 THEN p_name || 'Test' ELSE p_name END AS name,
        CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE p_brand || '.' || p_type || '.' || p_name END AS qualified_name,
        CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '(' || CAST(p_size AS STRING) || ')' END AS signature,
        CASE p_partkey % 3 WHEN 0 THEN 'java' WHEN 1 THEN 'kotlin' ELSE 'python' END AS language,
        CAST(p_size AS INT) AS start_line, CAST(p_partkey % 80 AS INT) AS start_column, CAST(p_size + 10 AS INT) AS end_line,
        (p_partkey % 17 = 0) AS external, (p_partkey % 23 = 0) AS generated FROM part""",
    "occurrences": f"""SELECT 'occ:' || CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) || ':' || CAST(l_partkey AS STRING) || ':' || CAST(l_suppkey AS STRING) AS id, 'proj' AS project_id,
        CASE WHEN l_linestatus = 'F' THEN 'sym:' || CAST(l_partkey AS STRING) END AS symbol_id, {_file("f")} AS file_id,
        CAST(l_linenumber AS INT) AS start_line, CAST(l_quantity AS INT) AS start_column,
        CASE l_returnflag WHEN 'A' THEN 'DEFINITION' WHEN 'N' THEN 'REFERENCE' ELSE 'CALL' END AS role,
        CASE WHEN l_linestatus = 'F' THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS resolution_status
        FROM lineitem JOIN part f ON f.p_partkey = CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey * 10 ELSE l_partkey END""",
    "relationships": f"""SELECT id, 'proj' AS project_id, 'SYMBOL' AS source_type, 'sym:' || CAST(s AS STRING) AS source_id,
        CASE WHEN t IS NOT NULL THEN 'SYMBOL' END AS target_type, 'sym:' || CAST(t AS STRING) AS target_id,
        CASE WHEN t IS NULL THEN 'ext.' || CAST(s % 50 AS STRING) END AS unresolved_target,
        CASE (s + coalesce(t, 0)) % 12 {" ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS))} END AS kind,
        CASE WHEN t IS NULL THEN 'UNRESOLVED' WHEN l_returnflag = 'R' AND (s + t) % 12 = 9 THEN 'HEURISTIC' ELSE 'RESOLVED' END AS resolution_status,
        CASE l_returnflag WHEN 'A' THEN 'FACTUAL' WHEN 'N' THEN 'FACTUAL' ELSE 'HEURISTIC' END AS nature,
        CASE WHEN l_returnflag = 'R' THEN round(0.5 + l_discount, 2) END AS confidence,
        'src/main/' || CAST(l_suppkey AS STRING) || '.java' AS file_id, CAST(l_linenumber AS INT) AS start_line
        FROM (SELECT 'rel:' || CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) || ':' || CAST(l_partkey AS STRING) || ':' || CAST(l_suppkey AS STRING) AS id,
          l_partkey AS s, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS t, l_returnflag, l_discount, l_suppkey, l_linenumber FROM lineitem) q""",
    "modules": """SELECT p_type AS module_id, 'src/main/' || p_type AS root, 'SOURCE' AS root_kind FROM part GROUP BY p_type UNION ALL SELECT p_type, 'src/test/' || p_type, 'TEST' FROM part GROUP BY p_type""",
    "sessions": """SELECT DISTINCT 'ses:' || CAST(date_trunc('day', ts) AS STRING) AS session_id, CASE WHEN extract(day FROM ts) % 4 = 0 THEN 'snap:old' ELSE 'snap:1' END AS snapshot_id FROM events""",
    "observations": """SELECT event_id AS observation_id, 'ses:' || CAST(date_trunc('day', ts) AS STRING) AS session_id,
        CASE event_type WHEN 'click' THEN 'CALL' WHEN 'view' THEN 'LINE_COVERAGE' ELSE 'SYMBOL_EXECUTION' END AS type,
        CASE WHEN event_id % 4 < 2 THEN 'key:' || CAST(user_id AS STRING) END AS source_key,
        CASE WHEN event_id % 4 = 2 THEN 'Brand#' || CAST(user_id % 25 + 1 AS STRING) || '.SMALL.red widget' END AS source_name,
        CASE WHEN event_id % 4 = 3 THEN 'src/main/SMALL/F' || CAST(user_id % 60 AS STRING) || '.java' END AS source_file,
        CASE WHEN event_id % 8 = 3 THEN CAST(user_id % 50 + 1 AS INT) END AS source_line,
        CASE WHEN event_type = 'click' THEN 'key:' || CAST(user_id * 7 AS STRING) END AS target_key,
        CAST(user_id % 9 + 1 AS BIGINT) AS hits, CAST(round(value * 1000) AS BIGINT) AS nanos FROM events""",
    "commits": """SELECT 'c' || CAST(o_orderkey AS STRING) AS commit_id, o_orderdate AS committed_at, o_orderkey AS scan_pos,
        CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 'User' || CAST(o_custkey AS STRING) || '@Mail' END AS author_email, 'user' || CAST(o_custkey AS STRING) AS author_name FROM orders""",
    "commit_files": """SELECT DISTINCT 'c' || CAST(l_orderkey AS STRING) AS commit_id,
        CASE WHEN l_partkey % 7 = 0 THEN 'README' || CAST(l_partkey AS STRING) ELSE 'd' || CAST(l_partkey % 11 AS STRING) || '/e' || CAST(l_partkey % 3 AS STRING) || '/f' || CAST(l_partkey AS STRING) END AS path FROM lineitem""",
    "files_before": """SELECT CASE WHEN doc_id % 9 = 0 THEN '.gitignore' || CAST(doc_id AS STRING) ELSE 'src/main/SMALL/' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 4 = 0 THEN '.java' ELSE '.txt' END END AS path, n_chars AS size, sha256(text) AS sha FROM documents WHERE doc_id % 7 <> 1""",
    "files_after": """SELECT CASE WHEN doc_id % 9 = 0 THEN '.gitignore' || CAST(doc_id AS STRING) ELSE 'src/main/SMALL/' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 4 = 0 THEN '.java' ELSE '.txt' END END AS path, n_chars AS size,
        CASE WHEN doc_id % 10 = 3 THEN sha256(text || 'x') ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 7 <> 2""",
    "semantic_documents": """SELECT 'doc:' || CAST(doc_id AS STRING) AS stable_key, CASE doc_id % 3 WHEN 0 THEN 'SYMBOL' WHEN 1 THEN 'FILE' ELSE 'CHUNK' END AS kind,
        'sym:' || CAST(doc_id AS STRING) AS source_id, text AS content, sha256(text) AS checksum FROM documents""",
    "runs": """SELECT 'run:' || CAST(o_orderkey AS STRING) AS id, 'p' || CAST(o_custkey % 50 AS STRING) AS project_id, CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'FAILED' ELSE 'CANCELLED' END AS status,
        o_orderdate AS created_at, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate + INTERVAL 1 DAY END AS completed_at FROM orders""",
    "snapshot_files": """SELECT 'p' || CAST(o_custkey AS STRING) AS project_id, 's' || CAST(o_orderkey AS STRING) AS file_name, o_orderdate AS modified_at, (o_orderkey % 20 = 0) AS active FROM orders""",
    "audit": """SELECT 't' || CAST(user_id AS STRING) AS tenant_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS sequence, ts AS occurred_at, event_id, event_type AS action FROM events""",
}
#: Indexes as flat rows, twenty parts a document: its symbols, and their uses.
VIEWS["index_symbols"] = f"""SELECT 'ix' || CAST((p_partkey - p_partkey % 20) % 60 AS STRING) AS idx, CAST(p_partkey - p_partkey % 20 AS INT) AS doc, p_partkey AS k, CAST(p_size AS INT) AS size,
        'src/main/D' || CAST(p_partkey - p_partkey % 20 AS STRING) || CASE WHEN (p_partkey - p_partkey % 20) % 40 = 0 THEN '.kt' ELSE '.java' END AS path, CASE WHEN (p_partkey - p_partkey % 20) % 3 = 0 THEN '' ELSE 'java' END AS lang, {_raw("part")} AS raw,
        CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_size % 3 = 0 THEN 7 WHEN p_size % 3 = 1 THEN 26 ELSE 61 END AS kind, CASE WHEN p_partkey % 31 = 0 THEN ' ' ELSE p_name END AS display, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '(' || CAST(p_size AS STRING) || ')' END AS signature,
        CASE WHEN p_partkey % 4 = 0 THEN 'scip-java maven g 1.0 a/b/T' || CAST(p_partkey + 3 AS STRING) || '#' END AS target, (p_partkey % 8 = 0) AS implementing FROM part"""
VIEWS["index_uses"] = f"""SELECT 'ix' || CAST((f.p_partkey - f.p_partkey % 20) % 60 AS STRING) AS idx, CAST(f.p_partkey - f.p_partkey % 20 AS INT) AS doc, l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber, l_suppkey,
        CASE WHEN l_linenumber = 6 THEN ' ' WHEN l_linenumber % 5 = 0 THEN 'scip-java maven g 1.0 x/y/Ext' || CAST(l_partkey % 50 AS STRING) || '#' ELSE {_raw("f")} END AS raw,
        CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0 ELSE 8 END + CASE WHEN l_linenumber = 3 THEN 16 ELSE 0 END AS bits, CAST(l_orderkey % 500 AS INT) AS line, CAST(l_quantity AS INT) AS col, (CAST(l_quantity AS INT) % 9 <> 0) AS readable FROM lineitem JOIN part f ON f.p_partkey = l_partkey"""


def load(spark: SparkSession, sf_dir: str, view: str, merged: str | None = None) -> DataFrame:
    """A projected table. The given tables come in as named views of this call only. merged: the table that joins must not broadcast."""
    sql = VIEWS[view]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
    frames |= {t: frames[t].hint("merge") for t in frames if t == merged}
    for t in frames:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b( [a-z]\b)?", lambda m, t=t: f"{m[1]} {{{t}}} AS {(m[2] or ' ' + t).strip()}", sql)
    return spark.sql(sql.replace("sha256(", "sha2_256(").replace("sha2_256(text || 'x')", "sha2(text || 'x', 256)").replace("sha2_256(text)", "sha2(text, 256)"), **frames)


def cte(*views: str) -> str:
    """WITH … for DuckDB."""
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views)
