"""Queries of runtime observations, repositories, file changes and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import history, runtime
from .projection import cte
from .registry import Registry, Tables
from .structure import rounded

R = Registry()
ACTIVE = "snap:1"


def both(t: Tables) -> DataFrame:
    chosen = t.observations.join(runtime.active_sessions(t.sessions, ACTIVE).select("session_id"), "session_id", "left_semi")
    return runtime.correlated(chosen, t.symbols)


_RESOLVE = """, refs AS (SELECT 's' || observation_id AS ref_id, source_key AS key, source_name AS name, source_file AS file, source_line AS line FROM observations UNION ALL SELECT 't' || observation_id, target_key, NULL, NULL, NULL FROM observations WHERE target_key IS NOT NULL),
hits AS (SELECT ref_id, id FROM refs JOIN symbols ON refs.key = symbol_key UNION ALL SELECT ref_id, id FROM refs JOIN symbols ON refs.name = qualified_name WHERE refs.key IS NULL UNION ALL
  SELECT ref_id, id FROM refs JOIN symbols ON refs.file = file_id AND (refs.line IS NULL OR refs.line BETWEEN start_line AND end_line) WHERE refs.key IS NULL AND refs.name IS NULL),
resolved AS (SELECT refs.*, coalesce(n, 0) AS candidates, CASE WHEN n IS NULL THEN 'UNRESOLVED' WHEN n = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status, CASE WHEN n = 1 THEN first END AS symbol_id FROM refs LEFT JOIN (SELECT ref_id AS r, count(*) AS n, min(id) AS first FROM hits GROUP BY ref_id) h ON h.r = ref_id)"""
_BOTH = f"""{cte('symbols', 'observations', 'sessions')}{_RESOLVE}, obs AS (SELECT o.*, a.symbol_id AS source_symbol, a.status AS source_status, b.symbol_id AS target_symbol, b.status AS target_status,
  coalesce(source_key, source_name, source_file || coalesce(':' || source_line, '')) AS shown FROM observations o JOIN resolved a ON a.ref_id = 's' || observation_id LEFT JOIN resolved b ON b.ref_id = 't' || observation_id
  WHERE session_id IN (SELECT session_id FROM sessions WHERE snapshot_id = '{ACTIVE}'))"""
R.add("d06_reference_resolution", lambda t: runtime.resolve(runtime.sources(t.observations).union(runtime.targets(t.observations)), t.symbols).select("ref_id", "status", "symbol_id", "candidates"), f"{cte('symbols', 'observations')}{_RESOLVE} SELECT ref_id, status, symbol_id, candidates FROM resolved")
R.add("d06_candidate_ids", lambda t: runtime.named_ids(runtime.sources(t.observations), t.symbols), f"{cte('symbols', 'observations')}{_RESOLVE} SELECT ref_id, id, k FROM (SELECT ref_id, id, row_number() OVER (PARTITION BY ref_id ORDER BY id)::INTEGER AS k FROM refs JOIN symbols ON refs.name = qualified_name WHERE refs.key IS NULL) WHERE k <= 1000")
R.add("d06_ambiguous_ids", lambda t: runtime.candidate_ids(runtime.sources(t.observations).union(runtime.targets(t.observations)), t.symbols), f"{cte('symbols', 'observations')}{_RESOLVE} SELECT ref_id, id, k FROM (SELECT ref_id, id, row_number() OVER (PARTITION BY ref_id ORDER BY id)::INTEGER AS k, count(*) OVER (PARTITION BY ref_id) AS n FROM hits) WHERE n > 1 AND k <= 1000")
R.add("d07_line_containment", lambda t: runtime.resolve(runtime.sources(t.observations).filter("line IS NOT NULL"), t.symbols).select("ref_id", "line", "status", "candidates"), f"{cte('symbols', 'observations')}{_RESOLVE} SELECT ref_id, line, status, candidates FROM resolved WHERE line IS NOT NULL")
R.add("e13_runtime_report", lambda t: rounded(runtime.report(both(t), t.symbols)),
      f"""{_BOTH} SELECT sum(hits)::BIGINT AS total_hits, sum(nanos)::BIGINT AS total_nanos, count(DISTINCT CASE WHEN type = 'LINE_COVERAGE' THEN coalesce(source_file, 'null') || ':' || coalesce(source_line::VARCHAR, 'null') END) AS covered_lines,
      (SELECT count(DISTINCT s) FROM (SELECT source_symbol AS s FROM obs UNION ALL SELECT target_symbol FROM obs)) AS observed_symbols, (SELECT count(*) FROM symbols) AS symbols,
      round((SELECT count(DISTINCT s) FROM (SELECT source_symbol AS s FROM obs UNION ALL SELECT target_symbol FROM obs)) / (SELECT count(*) FROM symbols)::DOUBLE, 9) AS ratio FROM obs""")
R.add("g09_hot_paths", lambda t: runtime.hot_paths(both(t), 100), f"{_BOTH} SELECT coalesce(source_symbol, shown) AS key, sum(hits)::BIGINT AS hits, sum(nanos)::BIGINT AS nanos FROM obs GROUP BY 1 ORDER BY 3 DESC, 2 DESC, 1 LIMIT 100")
R.add("g09_observed_calls", lambda t: runtime.observed_calls(both(t), 100), f"{_BOTH} SELECT shown AS source, target_key AS target, sum(hits)::BIGINT AS hits, sum(nanos)::BIGINT AS nanos FROM obs WHERE type = 'CALL' GROUP BY 1, 2 ORDER BY 4 DESC, 3 DESC, 1, 2 LIMIT 100")
R.add("e14_symbol_report", lambda t: runtime.symbol_report(both(t)),
      f"""{_BOTH}, a AS (SELECT source_symbol AS symbol_id, sum(CASE WHEN type = 'SYMBOL_EXECUTION' THEN hits ELSE 0 END)::BIGINT AS execution_hits, sum(CASE WHEN type = 'SYMBOL_EXECUTION' THEN nanos ELSE 0 END)::BIGINT AS execution_nanos, sum(CASE WHEN type = 'LINE_COVERAGE' THEN hits ELSE 0 END)::BIGINT AS line_hits, sum(CASE WHEN type = 'CALL' THEN hits ELSE 0 END)::BIGINT AS outgoing_calls FROM obs WHERE source_symbol IS NOT NULL GROUP BY 1),
      b AS (SELECT target_symbol AS symbol_id, sum(CASE WHEN type = 'CALL' THEN hits ELSE 0 END)::BIGINT AS incoming_calls FROM obs WHERE target_symbol IS NOT NULL GROUP BY 1)
      SELECT coalesce(a.symbol_id, b.symbol_id) AS symbol_id, coalesce(execution_hits, 0) AS execution_hits, coalesce(execution_nanos, 0) AS execution_nanos, coalesce(line_hits, 0) AS line_hits, coalesce(outgoing_calls, 0) AS outgoing_calls, coalesce(incoming_calls, 0) AS incoming_calls FROM a FULL JOIN b ON a.symbol_id = b.symbol_id""")
R.add("e15_correlation_counts", lambda t: runtime.correlation_counts(both(t)), f"{_BOTH} SELECT status, count(*) AS \"references\" FROM (SELECT source_status AS status FROM obs UNION ALL SELECT target_status FROM obs WHERE target_status IS NOT NULL) GROUP BY status")
R.add("c19_session_selection", lambda t: runtime.active_sessions(t.sessions, ACTIVE), f"{cte('sessions')} SELECT * FROM sessions WHERE snapshot_id = '{ACTIVE}'")
R.add("c20_session_listing", lambda t: runtime.list_sessions(t.sessions, runtime.correlated(t.observations, t.symbols), ACTIVE),
      f"{cte('symbols', 'observations', 'sessions')}{_RESOLVE}, n AS (SELECT session_id, count(*) AS observations, count_if(status = 'RESOLVED')::BIGINT AS resolved FROM observations JOIN resolved ON ref_id = 's' || observation_id GROUP BY session_id) SELECT session_id, snapshot_id, coalesce(n.observations, 0) AS observations, coalesce(n.resolved, 0) AS resolved, snapshot_id = '{ACTIVE}' AS aligned FROM sessions LEFT JOIN n USING (session_id) ORDER BY session_id LIMIT 128")
R.add("s20_runtime_display", lambda t: t.observations.select("observation_id", runtime.display("source_key", "source_name", "source_file", "source_line").alias("shown")), f"{cte('observations')} SELECT observation_id, coalesce(source_key, source_name, source_file || coalesce(':' || source_line, '')) AS shown FROM observations")

_TOUCH = f"{cte('commits', 'commit_files')}, touched AS (SELECT c.*, coalesce(lower(author_email), author_name) AS author, path FROM commits c JOIN commit_files USING (commit_id))"
_FILES = f"{_TOUCH}, files AS (SELECT path, count(*) AS commits, count(DISTINCT author) AS authors, max(committed_at) AS last_changed_at, arg_max(commit_id, (committed_at, -scan_pos)) AS last_commit FROM touched GROUP BY path)"
R.add("e16_file_activity", lambda t: history.file_activity(t.commits, t.commit_files), f"{_FILES} SELECT * FROM files")
R.add("f06_first_wins_argmax", lambda t: history.file_activity(t.commits, t.commit_files).select("path", "last_commit"), f"{_FILES} SELECT path, last_commit FROM files")
R.add("g10_top_files", lambda t: history.top_files(history.file_activity(t.commits, t.commit_files), 100), f"{_FILES} SELECT * FROM files ORDER BY commits DESC, last_changed_at DESC, path LIMIT 100")
_ZONE = "CASE WHEN contains(path, '/') THEN array_to_string(string_split(path, '/')[1:least({0}, len(string_split(path, '/')) - 1)], '/') ELSE '(root)' END"
R.add("e17_zone_activity", lambda t: history.zone_activity(t.commits, t.commit_files, 1), f"{_TOUCH} SELECT {_ZONE.format(1)} AS zone, count(*) AS touches, count(DISTINCT path) AS files, max(committed_at) AS last_changed_at FROM touched GROUP BY 1")
R.add("s14_directory_zone", lambda t: t.commit_files.select("path").distinct().withColumn("zone", text.zone(F.col("path"), 2)), f"{cte('commit_files')} SELECT DISTINCT path, {_ZONE.format(2)} AS zone FROM commit_files")
R.add("a21_history_cut", lambda t: history.newest_until(t.commits, "1995-02-01").select("commit_id", "scan_pos"), f"{cte('commits')} SELECT commit_id, scan_pos FROM commits WHERE scan_pos < coalesce((SELECT min(scan_pos) FROM commits WHERE committed_at < TIMESTAMP '1995-02-01'), 9223372036854775807)")


def relations(t: Tables) -> DataFrame:
    return t.projected("relationships").filter("target_id IS NULL").select("id", F.concat(F.lit("r"), F.col("start_line").cast("string")).alias("project_id"), F.lit("scip").alias("provider_id"), "unresolved_target")


def references(t: Tables) -> DataFrame:
    key = F.substring("id", 5, 20).cast("long")
    return t.symbols.filter("NOT external").select(F.concat(F.lit("r"), (key % 7 + 1).cast("string")).alias("project_id"), F.col("id").alias("symbol_id"), F.lit("scip").alias("provider_id"), F.concat(F.lit("ext."), F.when(key < 40, key).otherwise(key % 10).cast("string")).alias("external_id"))


_CROSS = f"""{cte('symbols', 'relationships')}, rel AS (SELECT id, 'r' || start_line AS project_id, unresolved_target FROM relationships WHERE target_id IS NULL),
ref AS (SELECT 'r' || (k % 7 + 1) AS project_id, id AS symbol_id, 'ext.' || CASE WHEN k < 40 THEN k ELSE k % 10 END AS external_id FROM (SELECT id, substr(id, 5)::BIGINT AS k FROM symbols WHERE NOT external)),
crossed AS (SELECT rel.id, rel.project_id, count(ref.symbol_id) AS n, min(ref.project_id) AS p, min(symbol_id) AS s FROM rel LEFT JOIN ref ON external_id = unresolved_target AND ref.project_id <> rel.project_id GROUP BY rel.id, rel.project_id),
done AS (SELECT id, project_id, CASE n WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'EXACT' ELSE 'AMBIGUOUS' END AS status, CASE WHEN n = 1 THEN p END AS target_project, CASE WHEN n = 1 THEN s END AS target_symbol, CASE WHEN n = 1 THEN 1.0::DOUBLE END AS confidence FROM crossed)"""
R.add("d08_cross_project", lambda t: history.cross_project(relations(t), references(t)), f"{_CROSS} SELECT * FROM done")
R.add("e18_resolution_counts", lambda t: history.cross_project(relations(t), references(t)).groupBy("project_id", "status").agg(F.count("*").alias("relations")), f"{_CROSS} SELECT project_id, status, count(*) AS relations FROM done GROUP BY project_id, status")

_CHANGES = f"{cte('files_before', 'files_after')}, changes AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.sha IS NULL THEN 'added' WHEN a.sha IS NULL THEN 'deleted' WHEN a.sha = b.sha AND a.size = b.size THEN 'unchanged' ELSE 'modified' END AS status FROM files_after a FULL JOIN files_before b ON a.path = b.path)"


def changes(t: Tables) -> DataFrame:
    return history.file_changes(t.files_before, t.files_after)


def areas(t: Tables) -> DataFrame:
    roots = t.modules.select("root", "root_kind").withColumn("ending", F.lit(".java"))
    return history.classify_paths(changes(t).select("path"), roots)


_AREAS = """, areas AS (SELECT path, CASE WHEN starts_with(path, '.gitignore') THEN 'IGNORE_POLICY' ELSE coalesce((SELECT arg_max(root_kind, length(root)) FROM modules WHERE starts_with(path, root || '/') AND ends_with(path, '.java')), 'UNQUALIFIED') END AS area FROM changes)"""
_WITH_MODULES = _CHANGES.replace("WITH ", cte("modules") + ", ", 1)
R.add("d09_fingerprint_diff", changes, f"{_CHANGES} SELECT * FROM changes")
R.add("t02_path_classification", areas, f"{_WITH_MODULES}{_AREAS} SELECT * FROM areas")
R.add("t01_invalidation", lambda t: history.invalidation(changes(t), areas(t)),
      f"{_WITH_MODULES}{_AREAS} SELECT *, CASE WHEN changed = 0 THEN 'NONE' WHEN ignore_policy + build + unqualified > 0 THEN 'FULL_REQUIRED' ELSE 'PARTIAL_CANDIDATE' END AS scope FROM (SELECT count(*) AS changed, count_if(area = 'IGNORE_POLICY')::BIGINT AS ignore_policy, count_if(area = 'BUILD')::BIGINT AS build, count_if(area = 'SOURCE')::BIGINT AS source, count_if(area = 'TEST')::BIGINT AS test, count_if(area = 'UNQUALIFIED')::BIGINT AS unqualified FROM changes JOIN areas USING (path) WHERE status <> 'unchanged')")
def plans(t: Tables) -> DataFrame:
    """Each scope with indexers that all can work incrementally, some that can't, and none at all."""
    every = t.spark.createDataFrame([("NONE",), ("PARTIAL_CANDIDATE",), ("FULL_REQUIRED",)], "scope string").union(history.invalidation(changes(t), areas(t)).select("scope"))
    own = t.base("nation").select(F.col("n_name").alias("id"), (F.col("n_regionkey") != 3).alias("incremental"), "n_regionkey")
    sets = [own.filter("n_regionkey <> 3"), own, own.limit(0)]
    out = [history.incremental_plan(every, s.drop("n_regionkey")).withColumn("indexers", F.lit(i)) for i, s in enumerate(sets)]
    return out[0].unionByName(out[1]).unionByName(out[2])


R.add("t03_incremental_plan", plans,
      f"""{_WITH_MODULES}{_AREAS}, found AS (SELECT CASE WHEN count(*) = 0 THEN 'NONE' WHEN count_if(area IN ('IGNORE_POLICY', 'BUILD', 'UNQUALIFIED')) > 0 THEN 'FULL_REQUIRED' ELSE 'PARTIAL_CANDIDATE' END AS scope FROM changes JOIN areas USING (path) WHERE status <> 'unchanged'),
      every AS (SELECT unnest(['NONE', 'PARTIAL_CANDIDATE', 'FULL_REQUIRED']) AS scope UNION ALL SELECT scope FROM found), ables AS (SELECT 0 AS indexers, true AS able UNION ALL SELECT 1, false UNION ALL SELECT 2, false)
      SELECT scope, able, CASE WHEN scope = 'NONE' THEN 'NONE' WHEN scope = 'PARTIAL_CANDIDATE' AND able THEN 'INCREMENTAL' ELSE 'FULL' END AS plan, indexers FROM every, ables""")
R.add("e23_aggregate_hash", lambda t: history.aggregate_hash(t.files_after), f"{cte('files_after')} SELECT sha256(string_agg(path || chr(0) || size || chr(0) || sha || chr(10), '' ORDER BY path)) AS sha256, count(*) AS files FROM files_after")
R.add("f02_snapshot_retention", lambda t: history.keep_snapshots(t.snapshot_files).select("project_id", "file_name", "keep"), f"{cte('snapshot_files')} SELECT project_id, file_name, active OR row_number() OVER (PARTITION BY project_id, active ORDER BY modified_at DESC, file_name) <= 2 AS keep FROM snapshot_files")
R.add("f03_run_retention", lambda t: history.keep_runs(t.runs).select("id", "keep"), f"{cte('runs')} SELECT id, row_number() OVER (PARTITION BY project_id, status = 'SUCCEEDED' ORDER BY coalesce(completed_at, created_at) DESC, id DESC) <= CASE WHEN status = 'SUCCEEDED' THEN 20 ELSE 10 END AS keep FROM runs")
R.add("f04_audit_prefix", lambda t: history.audit_prefix(t.audit, F.lit("2024-01-08").cast("timestamp"), 40),
      f"{cte('audit')} SELECT tenant_id, count(*) AS events, greatest(coalesce(min(sequence) FILTER (WHERE occurred_at >= TIMESTAMP '2024-01-08') - 1, count(*)), count(*) - 40, 0)::BIGINT AS remove FROM audit GROUP BY tenant_id")


def chained(t: Tables) -> DataFrame:
    """Audit events with hashes, some of whose links are broken."""
    own = lambda s: F.sha2(F.concat_ws("|", "tenant_id", s.cast("string")), 256)
    s = F.col("sequence")
    broken = F.col("event_id") % 101 == 5
    return t.audit.withColumns({"hash": own(s), "previous_hash": F.when(broken, "?").when(s == 1, "").otherwise(own(s - 1))})


R.add("f05_audit_chain", lambda t: history.chain_breaks(chained(t)), f"{cte('audit')} SELECT tenant_id, sequence FROM audit WHERE event_id % 101 = 5")
hash_pad = lambda x: bytes(b ^ x for b in b"key".ljust(64, b"\0")).hex()
R.add("s19_hmac", lambda t: t.audit.select("event_id", text.hmac_sha256(F.lit("key"), F.concat_ws("|", "tenant_id", F.col("sequence").cast("string"))).alias("mac")),
      f"{cte('audit')} SELECT event_id, sha256(unhex('{hash_pad(0x5C)}') || unhex(sha256(unhex('{hash_pad(0x36)}') || encode(tenant_id || '|' || sequence)))) AS mac FROM audit")
R.add("h03_distinct_union", lambda t: t.projected("relationships").filter("source_id = 'sym:42' OR target_id = 'sym:42'").dropDuplicates(["project_id", "id"]).select("id", "kind"), f"{cte('relationships')} SELECT id, kind FROM relationships WHERE source_id = 'sym:42' UNION SELECT id, kind FROM relationships WHERE target_id = 'sym:42'")
R.add("h06_duplicate_rejection", lambda t: history.reject_duplicates(t.base("lineitem").select(F.col("l_orderkey"), F.col("l_linenumber")), ["l_orderkey", "l_linenumber"]), 'SELECT l_orderkey, l_linenumber, count(*) AS "rows" FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1')
R.add("s03_stable_ids", lambda t: t.symbols.select("id", text.stable_id("sym", F.col("project_id"), F.col("qualified_name"), F.col("signature")).alias("stable_id")), f"{cte('symbols')} SELECT id, 'sym:' || sha256(project_id || chr(31) || coalesce(qualified_name, '') || chr(31) || coalesce(signature, '')) AS stable_id FROM symbols")
R.add("s04_normalized_names", lambda t: t.symbols.select("id", text.normalized_name(text.strip_test_suffix("name")).alias("normalized"), text.file_stem("file_id").alias("stem")),
      f"{cte('symbols')} SELECT id, regexp_replace(lower(regexp_replace(name, '(tests?|spec(ification)?s?|it)$', '', 'i')), '[^a-z0-9]', '', 'g') AS normalized, regexp_replace(regexp_replace(file_id, '^.*/', ''), '\\.[^.]*$', '') AS stem FROM symbols")
R.add("d17_negotiation", lambda t: history.negotiate(t.symbols.select("language").distinct(), t.base("supplier").select(F.col("s_name").alias("indexer_id"), F.array(F.when(F.col("s_nationkey") % 2 == 0, "java").otherwise("python"), F.lit("rust")).alias("languages"), (F.col("s_acctbal") > 0).alias("qualified"), F.col("s_nationkey").alias("priority"))),
      f"""{cte('symbols')}, r AS (SELECT language, s_name AS indexer_id, s_nationkey AS priority, CASE WHEN language <> CASE WHEN s_nationkey % 2 = 0 THEN 'java' ELSE 'python' END THEN 'UNSUPPORTED_LANGUAGE' WHEN NOT s_acctbal > 0 THEN 'NOT_QUALIFIED' ELSE 'COMPATIBLE' END AS status FROM (SELECT DISTINCT language FROM symbols), supplier)
      SELECT language, indexer_id, status, status = 'COMPATIBLE' AND row_number() OVER (PARTITION BY language, status ORDER BY priority DESC, indexer_id) = 1 AS chosen FROM r""")
