"""Queries of project states, governance, code context and scalar kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..model import ENTITY_TYPES, RELATIONSHIP_KINDS, ordinal_sql
from ..operators import context, governance, history, projects
from .lookups import _ORDER, _RANK, SYMBOL, occurrences
from .projection import cte
from .registry import Registry, Tables

R = Registry()


def project_table(t: Tables) -> DataFrame:
    return t.base("customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("project_id"), F.concat(F.lit("name"), (F.col("c_custkey") - F.col("c_custkey") % F.when(F.col("c_custkey") % 3 == 0, 2).otherwise(1)).cast("string")).alias("name"), F.when(F.col("c_nationkey") % 5 > 0, F.concat(F.lit("s"), (F.col("c_custkey") % 4).cast("string"))).alias("snapshot_id"))


_PROJECTS = "projects AS (SELECT 'p' || c_custkey AS project_id, 'name' || (c_custkey - c_custkey % CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END) AS name, CASE WHEN c_nationkey % 5 > 0 THEN 's' || (c_custkey % 4) END AS snapshot_id FROM customer)"


def asked(t: Tables) -> DataFrame:
    return t.base("customer").select(F.explode(F.array(F.concat(F.lit("p"), F.col("c_custkey").cast("string")), F.concat(F.lit("name"), F.col("c_custkey").cast("string")))).alias("reference"))


R.add("c18_project_resolution", lambda t: projects.resolve_projects(asked(t), project_table(t)),
      f"WITH {_PROJECTS}, asked AS (SELECT 'p' || c_custkey AS reference FROM customer UNION ALL SELECT 'name' || c_custkey FROM customer), n AS (SELECT name, count(*) AS n, min(project_id) AS p FROM projects GROUP BY name) SELECT reference, CASE WHEN i.project_id IS NOT NULL OR n = 1 THEN 'RESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'UNKNOWN' END AS status, coalesce(i.project_id, CASE WHEN n = 1 THEN p END) AS project_id FROM asked LEFT JOIN projects i ON i.project_id = reference LEFT JOIN n ON n.name = reference")


def run_table(t: Tables) -> DataFrame:
    return t.runs.select(F.concat(F.lit("p"), F.substring("id", 5, 20).cast("long").cast("string")).alias("x"), "id", "status", "project_id", F.coalesce("completed_at", "created_at").alias("at")).drop("x")


R.add("c21_index_states", lambda t: projects.index_states(project_table(t).select("project_id"), project_table(t).filter("snapshot_id IS NOT NULL").select("project_id", "snapshot_id"), run_table(t)),
      f"""{cte('runs')}, {_PROJECTS}, last AS (SELECT project_id, arg_max(status, (coalesce(completed_at, created_at), id)) AS last_status, arg_max(id, (coalesce(completed_at, created_at), id)) FILTER (WHERE status = 'SUCCEEDED') AS last_success FROM runs GROUP BY project_id)
      SELECT project_id, snapshot_id, last_success, CASE WHEN snapshot_id IS NOT NULL AND (last_status = 'SUCCEEDED' OR last_status IS NULL) THEN 'READY' WHEN snapshot_id IS NOT NULL THEN 'STALE' WHEN last_status <> 'SUCCEEDED' THEN 'FAILED' ELSE 'NOT_INDEXED' END AS state FROM projects LEFT JOIN last USING (project_id)""")


def index_table(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.base("customer").filter(k % 6 != 1).select(F.concat(F.lit("p"), k.cast("string")).alias("project_id"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("index_snapshot"), F.lit("hash").alias("provider"), F.when(k % 7 == 0, "v0").otherwise("v1").alias("model"), F.lit(384).alias("dims"))


R.add("c22_semantic_states", lambda t: projects.semantic_states(project_table(t).select("project_id", "snapshot_id"), index_table(t), "hash", "v1", 384),
      f"""WITH {_PROJECTS}, idx AS (SELECT 'p' || c_custkey AS project_id, 's' || (c_custkey % 3) AS index_snapshot, CASE WHEN c_custkey % 7 = 0 THEN 'v0' ELSE 'v1' END AS model FROM customer WHERE c_custkey % 6 <> 1),
      st AS (SELECT project_id, snapshot_id, index_snapshot, model, CASE WHEN snapshot_id IS NULL THEN 'NO_ACTIVE_SNAPSHOT' WHEN index_snapshot IS NULL THEN 'MISSING' WHEN model = 'v1' AND snapshot_id = index_snapshot THEN 'READY' ELSE 'STALE' END AS state FROM projects LEFT JOIN idx USING (project_id))
      SELECT project_id, state, CASE WHEN state = 'STALE' THEN concat_ws(',', CASE WHEN snapshot_id <> index_snapshot THEN 'SEMANTIC_INDEX_SNAPSHOT_STALE' END, CASE WHEN model <> 'v1' THEN 'SEMANTIC_INDEX_MODEL_STALE' END) ELSE '' END AS limitations FROM st""")


def members(t: Tables) -> DataFrame:
    role = F.element_at(F.array(*[F.lit(r) for r in governance.ROLES]), (F.col("s_nationkey") % 5 + 1).cast("int"))
    return t.base("supplier").select(F.concat(F.lit("t"), (F.col("s_suppkey") % 7).cast("string")).alias("tenant_id"), F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("principal_id"), role.alias("role"))


def requests(t: Tables) -> DataFrame:
    ask = F.element_at(F.array(*[F.lit(p) for p in governance.PERMISSIONS]), (F.col("event_id") % 9 + 1).cast("int"))
    return t.base("events").select(F.col("event_id").alias("request_id"), F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")).alias("tenant_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("principal_id"), ask.alias("permission"))


_GRANTS = " UNION ALL ".join(f"SELECT '{r}' AS role, '{p}' AS permission" for r, own in governance.ROLES.items() for p in own)
_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
R.add("v01_authorization", lambda t: governance.authorize(requests(t), members(t)),
      f"""WITH grants AS ({_GRANTS}), m AS (SELECT 't' || (s_suppkey % 7) AS tenant_id, 'u' || s_suppkey AS principal_id, list_extract({_LIST(governance.ROLES)}, s_nationkey % 5 + 1) AS role FROM supplier),
      r AS (SELECT event_id AS request_id, 't' || (user_id % 7) AS tenant_id, 'u' || user_id AS principal_id, list_extract({_LIST(governance.PERMISSIONS)}, event_id % 9 + 1) AS permission FROM events)
      SELECT request_id, r.tenant_id, r.principal_id, r.permission, m.role, g.role IS NOT NULL AS allowed FROM r LEFT JOIN m ON m.tenant_id = r.tenant_id AND m.principal_id = r.principal_id LEFT JOIN grants g ON g.role = m.role AND g.permission = r.permission""")
R.add("v02_role_matrix", lambda t: governance.role_matrix(t.spark), f"{_GRANTS}")
R.add("v08_audit_read", lambda t: governance.newest_events(t.audit, "t8", 50).select("sequence", "action"), f"{cte('audit')} SELECT sequence, action FROM audit WHERE tenant_id = 't8' ORDER BY sequence DESC LIMIT 50")


def methods(t: Tables) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    return t.base("part").select(k.alias("method_id"), F.concat("p_name", (F.col("p_partkey") % 40).cast("string")).alias("name"), F.transform(F.sequence(F.lit(1), F.col("p_size") % 3 + 1), lambda i: F.concat(F.lit("p"), k, F.lit("_"), i.cast("string"))).alias("parameters"), F.array(F.concat(F.lit("r"), k)).alias("returns"))


def calls(t: Tables) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    return t.base("part").select(k.alias("call_id"), F.concat("p_name", ((F.col("p_partkey") * 7) % 40).cast("string")).alias("name"), F.transform(F.sequence(F.lit(1), F.col("p_partkey").cast("int") % 3 + 1), lambda i: F.concat(F.lit("a"), k, F.lit("_"), i.cast("string"))).alias("arguments"), F.concat(F.lit("x"), k).alias("result"))


R.add("i11_interprocedural_edges", lambda t: projects.interprocedural_edges(methods(t), calls(t)).select("source_node_id", "target_node_id", "kind"),
      """WITH m AS (SELECT p_partkey AS k, p_name || (p_partkey % 40) AS name, p_size % 3 + 1 AS arity FROM part), one AS (SELECT name, arity, min(k) AS k FROM m GROUP BY name, arity HAVING count(*) = 1),
      c AS (SELECT p_partkey AS k, p_name || (p_partkey * 7 % 40) AS name, p_partkey % 3 + 1 AS arity FROM part), met AS (SELECT c.k AS ck, one.k AS mk, c.arity FROM c JOIN one USING (name, arity))
      SELECT 'a' || ck || '_' || i AS source_node_id, 'p' || mk || '_' || i AS target_node_id, 'ARGUMENT_FLOW' AS kind FROM met, range(1, 4) r(i) WHERE i <= arity UNION ALL SELECT 'r' || mk, 'x' || ck, 'RETURN_FLOW' FROM met""")


def counted(contexts: DataFrame, *keys: str) -> DataFrame:
    return contexts.select(*keys, "position", "symbol_id", F.size("relations").alias("relations"), F.size("usages").alias("usages"), "tokens", "truncated")


def code_search(t: Tables) -> DataFrame:
    return counted(context.search(t.symbols, occurrences(t), t.relationships, "proj", "small ring", limit=3, per_node=5, usages=3, max_tokens=4096, by_target=t.relationships_by_target))


def projected_occurrences(t: Tables) -> DataFrame:
    """occurrences(), for queries that go through them once."""
    return t.projected("occurrences").withColumn("roles", F.array("role"))


def file_contexts(t: Tables) -> DataFrame:
    """What a budget shows of the first three symbols of every file."""
    order = Window.partitionBy("file_id").orderBy(F.desc("start_line"), "id")
    roots = t.projected("symbols").withColumn("position", F.row_number().over(order)).filter("position <= 4").withColumn("query", F.col("file_id"))
    found = context.contexts(roots, projected_occurrences(t), t.projected("relationships"), 3, depth=2, per_node=3, usages=2, max_tokens=900, many=True)
    return found.select(F.col("query").alias("file_id"), "position", "symbol_id", F.transform("relations", lambda r: r["id"]).alias("r"), F.array_join("usages", ",").alias("usages"), "tokens", "truncated", "response_truncated").withColumn("relations", F.array_join("r", ",")).drop("r")


def walked(steps: DataFrame) -> DataFrame:
    return steps.select("root", F.posexplode("steps").alias("i", "x")).select("root", (F.col("i") + 1).alias("position"), F.col("x.level").alias("depth"), F.col("x.from_node").alias("node"), "x.direction", "x.id")


def relation_walk(t: Tables) -> DataFrame:
    roots = t.symbols.filter(F.col("id") == SYMBOL).select(F.col("id").alias("root"))
    return walked(context.walks(t.relationships, roots, 2, 3, t.relationships_by_target)).drop("root")


def all_walks(t: Tables) -> DataFrame:
    """The relations around all symbols, at most two levels and three of each node."""
    return walked(context.walks(t.projected("relationships"), t.projected("symbols").select(F.col("id").alias("root")), 2, 3, many=True))


_ROLL = f"direction_rank, {ordinal_sql('kind', RELATIONSHIP_KINDS)}, target_id IS NULL, {ordinal_sql('source_type', ENTITY_TYPES)}, source_id, {ordinal_sql('target_type', ENTITY_TYPES)} NULLS LAST, target_id NULLS LAST, unresolved_target NULLS LAST, file_id NULLS LAST, start_line NULLS LAST, id"
_EST = lambda *names: " + ".join(f"ceil(coalesce(strlen({n}), 0) / 4.0)::INTEGER" for n in names)
#: Every node's first four relations, and the usages of every symbol.
_NEAR = f"""ranked AS (SELECT node, id, direction_rank, CASE WHEN direction_rank = 0 THEN target_id ELSE source_id END AS other, 36 + {_EST('id', 'source_id', 'target_id', 'unresolved_target', 'kind', 'nature')} AS price,
        row_number() OVER (PARTITION BY node ORDER BY {_ROLL}) AS k FROM (SELECT *, source_id AS node, 0 AS direction_rank FROM relationships UNION ALL SELECT *, target_id, 1 FROM relationships WHERE target_id <> source_id)),
      used AS (SELECT symbol_id AS root, id, k, sum(price) OVER (PARTITION BY symbol_id ORDER BY k)::INTEGER AS spent FROM (SELECT symbol_id, id, 20 + {_EST('id', 'symbol_id', 'file_id')} + ceil((strlen(role) + 2) / 4.0)::INTEGER AS price, row_number() OVER (PARTITION BY symbol_id ORDER BY file_id, start_line, start_column, id) AS k FROM occurrences WHERE role NOT IN ('DEFINITION', 'FORWARD_DEFINITION')))"""


def _context_sql(roots: str, depth: int, per_node: int, usages: int) -> str:
    """steps (root, n, level, node, direction_rank, id, spent) and facts of each root: its lists of sums and ids, and before which step a node has too many."""
    two = f"""two AS (SELECT o.root, 2 AS level, r.node, o.place, r.k, r.direction_rank, r.id, r.price FROM (SELECT root, other, min(k) AS place FROM one WHERE k <= {per_node} AND other <> root GROUP BY ALL) o JOIN ranked r ON r.node = o.other
        WHERE {2 <= depth}), fresh AS (SELECT * FROM two WHERE k > {per_node} OR NOT EXISTS (SELECT 1 FROM one WHERE one.root = two.root AND one.id = two.id AND one.k <= {per_node}) QUALIFY k > {per_node} OR row_number() OVER (PARTITION BY root, id, k > {per_node} ORDER BY place, k) = 1)"""
    return f"""{_NEAR}, one AS (SELECT node AS root, 1 AS level, node, 0 AS place, k, direction_rank, id, price, other FROM ranked WHERE k <= {per_node + 1} AND node IN (SELECT id FROM {roots})), {two},
      every AS (SELECT root, level, node, place, k, direction_rank, id, price FROM one UNION ALL SELECT root, level, node, place, k, direction_rank, id, price FROM fresh WHERE k <= {per_node + 1}),
      steps AS (SELECT root, level, place, node, direction_rank, id, row_number() OVER w AS n, sum(price) OVER w::INTEGER AS spent FROM every WHERE k <= {per_node} WINDOW w AS (PARTITION BY root ORDER BY level, place, k)),
      over AS (SELECT root, min((level, place)) AS cut_at FROM every WHERE k > {per_node} GROUP BY root),
      walked AS (SELECT root, list(spent ORDER BY n) AS spent, list(id ORDER BY n) AS ids, CASE WHEN bool_or(cut_at IS NOT NULL) THEN count(*) FILTER ((level, place) < cut_at) ELSE 1000000 END AS first_over FROM steps LEFT JOIN over USING (root) GROUP BY root),
      shown AS (SELECT root, list(spent ORDER BY k) FILTER (k <= {usages}) AS use_spent, list(id ORDER BY k) FILTER (k <= {usages}) AS use_ids, max(k) > {usages} AS more FROM used GROUP BY root),
      facts AS (SELECT s.*, 32 + {_EST('s.id', 'symbol_key', 'module_id', 'file_id', 's.name', 'qualified_name', 'signature', 'language')} AS price, coalesce(spent, []) AS spent, ids, coalesce(first_over, 1000000) AS first_over, coalesce(use_spent, []) AS use_spent, use_ids, coalesce(more, false) AS more FROM {roots} s LEFT JOIN walked w ON w.root = s.id LEFT JOIN shown u ON u.root = s.id)"""


def _fold_sql(tokens: int) -> str:
    """The roots of each query (facts with query and position) that a budget reaches."""
    return f"""fold AS (
      SELECT query, 0::BIGINT AS position, 24 AS used, false AS stopped, NULL::VARCHAR AS id, 0 AS taken, 0 AS n, 0 AS tokens, false AS truncated FROM (SELECT DISTINCT query FROM facts)
      UNION ALL
      SELECT query, f.position, s.used + price + a + b, s.used + price + a + b >= {tokens}, f.id, taken, m, (price + a + b)::INTEGER, taken < len(spent) OR first_over <= taken OR room <= 0 OR m < len(use_spent) OR more
      FROM (SELECT query, position + 1 AS position, used FROM fold WHERE NOT stopped) s JOIN facts f USING (query, position), LATERAL (SELECT {tokens} - s.used - price AS room), LATERAL (SELECT len(list_filter(spent, lambda c: c <= room)) AS taken), LATERAL (SELECT CASE WHEN taken > 0 THEN spent[taken] ELSE 0 END AS a),
        LATERAL (SELECT len(list_filter(use_spent, lambda c: c <= room - a)) AS m), LATERAL (SELECT CASE WHEN m > 0 THEN use_spent[m] ELSE 0 END AS b) WHERE room >= 0)"""


_ALL_CONTEXTS = cte('symbols', 'relationships', 'occurrences').replace("WITH", "WITH RECURSIVE", 1)
R.add("n06_code_search", code_search,
      f"""{_ALL_CONTEXTS}, ranks AS (SELECT *, {_RANK.format(q='small ring')} AS match_rank FROM symbols), roots AS (SELECT 1 AS query, row_number() OVER (ORDER BY {_ORDER}) AS position, * EXCLUDE (match_rank) FROM ranks WHERE match_rank IS NOT NULL QUALIFY position <= 3), {_context_sql('roots', 1, 5, 3)}, {_fold_sql(4096)}
      SELECT position::INTEGER AS position, id AS symbol_id, taken::INTEGER AS relations, n::INTEGER AS usages, tokens, truncated FROM fold WHERE position > 0""")
R.add("n06_file_contexts", file_contexts,
      f"""{_ALL_CONTEXTS}, ordered AS (SELECT file_id AS query, row_number() OVER (PARTITION BY file_id ORDER BY start_line DESC, id) AS position, * FROM symbols), roots AS (SELECT * FROM ordered WHERE position <= 3), {_context_sql('roots', 2, 3, 2)}, {_fold_sql(900)},
      said AS (SELECT query, max(position) = 4 AS beyond FROM (SELECT query, position FROM ordered WHERE position <= 4) GROUP BY query), ended AS (SELECT query, bool_or(truncated) OR count(*) FILTER (position > 0) < any_value(k) AS cut FROM fold JOIN (SELECT query, count(*) AS k FROM roots GROUP BY query) USING (query) GROUP BY query)
      SELECT query AS file_id, position::INTEGER AS position, fold.id AS symbol_id, coalesce(array_to_string(ids[1:taken], ','), '') AS relations, coalesce(array_to_string(use_ids[1:n], ','), '') AS usages, tokens, truncated, beyond OR cut AS response_truncated FROM fold JOIN facts USING (query, position) JOIN said USING (query) JOIN ended USING (query) WHERE position > 0""")
R.add("n07_symbol_contexts", lambda t: counted(context.symbol_contexts(t.projected("symbols"), projected_occurrences(t), t.projected("relationships"), depth=1, per_node=4, usages=3, max_tokens=600, many=True)).drop("position"),
      f"""{_ALL_CONTEXTS}, roots AS (SELECT id AS query, 1::BIGINT AS position, * FROM symbols), {_context_sql('roots', 1, 4, 3)}, {_fold_sql(600)} SELECT id AS symbol_id, taken::INTEGER AS relations, n::INTEGER AS usages, tokens, truncated FROM fold WHERE position > 0""")
R.add("i07_all_walks", all_walks,
      f"""{cte('symbols', 'relationships', 'occurrences')}, {_context_sql('symbols', 2, 3, 2)} SELECT root, n::INTEGER AS position, level AS depth, node, CASE WHEN direction_rank = 0 THEN 'OUTGOING' ELSE 'INCOMING' END AS direction, id FROM steps""")
R.add("i07_context_traversal", relation_walk,
      f"""{cte('relationships')}, ends AS (SELECT *, source_id AS node, 0 AS direction_rank FROM relationships UNION ALL SELECT *, target_id, 1 FROM relationships WHERE target_id <> source_id),
      one AS (SELECT *, row_number() OVER (ORDER BY {_ROLL}) AS k FROM ends WHERE node = '{SYMBOL}' QUALIFY k <= 3), others AS (SELECT CASE WHEN direction_rank = 0 THEN target_id ELSE source_id END AS node, min(k) AS place FROM one GROUP BY 1 HAVING node IS NOT NULL AND node <> '{SYMBOL}'),
      two AS (SELECT ends.*, place, row_number() OVER (PARTITION BY ends.node ORDER BY {_ROLL}) AS k FROM ends JOIN others USING (node) QUALIFY k <= 3), fresh AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place, k) AS nth FROM two WHERE id NOT IN (SELECT id FROM one)),
      every AS (SELECT 1 AS depth, 0 AS place, k, node, direction_rank, id FROM one UNION ALL SELECT 2, place, k, node, direction_rank, id FROM fresh WHERE nth = 1)
      SELECT row_number() OVER (ORDER BY depth, place, k)::INTEGER AS position, depth, node, CASE WHEN direction_rank = 0 THEN 'OUTGOING' ELSE 'INCOMING' END AS direction, id FROM every""")
R.add("s02_truncated", lambda t: t.base("documents").select("doc_id", F.md5(text.truncated("text", F.lit(64))).alias("digest")), "SELECT doc_id, md5(substr(text, 1, (SELECT max(i) FROM range(0, 257) r(i) WHERE strlen(substr(text, 1, i)) <= 256)::INTEGER)) AS digest FROM documents")
R.add("s15_sanitized_remote", lambda t: t.base("pages").select("page_id", text.sanitize_remote(F.replace("url", F.lit("://"), F.lit("://user:secret@"))).alias("remote")), "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', ''), '\\.git$', '') AS remote FROM pages")
_LEVELS = list(projects.SUPPORT)
R.add("e22_conformance", lambda t: projects.conformance(t.base("supplier").select(F.col("s_nationkey").cast("string").alias("provider_id"), F.col("s_name").alias("capability"), F.element_at(F.array(*[F.lit(x) for x in _LEVELS]), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("level"))),
      "SELECT s_nationkey::VARCHAR AS provider_id, count(*) AS capabilities, round(100.0::DOUBLE * sum(3 - s_suppkey % 4) / (3 * count(*)))::INTEGER AS percent FROM supplier GROUP BY 1")


def retained(t: Tables) -> DataFrame:
    none = t.spark.createDataFrame([], "workspace_id string, status string, archived_at timestamp")
    plan = history.audit_prefix(t.audit, F.lit("2024-01-08").cast("timestamp"), 40)
    return governance.apply_retention(t.audit, plan, none, F.current_timestamp())[0].groupBy("tenant_id").agg(F.count("*").alias("events"), F.min("sequence").alias("first"))


R.add("v05_retention", retained,
      f"{cte('audit')}, plan AS (SELECT tenant_id, greatest(coalesce(min(sequence) FILTER (WHERE occurred_at >= TIMESTAMP '2024-01-08') - 1, count(*)), count(*) - 40, 0) AS remove FROM audit GROUP BY tenant_id) SELECT tenant_id, count(*) AS events, min(sequence) AS first FROM audit JOIN plan USING (tenant_id) WHERE sequence > remove GROUP BY tenant_id")
