"""Queries of derived relations and of module architecture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..model import CONTAINER_KINDS, DEPENDENCY_KINDS, MEMBER_KINDS, RELATIONSHIP_KINDS, ordinal_sql
from ..operators import architecture, derive
from ..store import stored
from .lookups import occurrences
from .projection import cte
from .registry import Registry, Tables

R = Registry()


def quoted(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


_U = "chr(31)"
_DEPS = f""", facts AS (SELECT * FROM relationships WHERE nature = 'FACTUAL' AND kind IN ({quoted(DEPENDENCY_KINDS)}) AND source_id IS DISTINCT FROM target_id),
deps AS (SELECT 'rel:' || sha256(project_id || {_U} || source_id || {_U} || 'DEPENDS_ON' || {_U} || coalesce(target_id, '') || {_U} || coalesce(unresolved_target, '')) AS id, project_id, source_id, target_id, unresolved_target,
  count(*) AS facts, count(DISTINCT kind) AS kinds, arg_min({{f}}, ({ordinal_sql("kind", RELATIONSHIP_KINDS)}, id)) AS first_row
  FROM (SELECT *, {{{{'id': id, 'status': resolution_status, 'file': file_id, 'line': start_line}}}} AS f FROM facts) GROUP BY project_id, source_id, target_id, unresolved_target)"""
_DEPS = _DEPS.replace("{f}", "f").replace("{{", "{").replace("}}", "}")

R.add("e01_dependencies", lambda t: derive.dependencies(t.relationships),
      f"{cte('relationships')}{_DEPS} SELECT id, project_id, source_id, target_id, unresolved_target, 'DEPENDS_ON' AS kind, 'DERIVED' AS nature, 1.0::DOUBLE AS confidence, facts, kinds, first_row.id AS first_fact, first_row.status AS resolution_status, first_row.file AS file_id, first_row.line AS start_line FROM deps")

_TEST = "coalesce(contains('/' || lower(file_id), '/src/test/'), false)"
_NORM = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_STRIP = "regexp_replace({}, '(?:tests?|spec(?:ification)?s?|it)$', '', 'i')"
_STEM = "regexp_replace(regexp_replace(file_id, '^.*/', ''), '\\.[^.]*$', '')"
_ANCHORS = f""", known AS (SELECT * FROM symbols WHERE NOT external AND NOT generated),
tiers AS (SELECT *, CASE WHEN kind IN ({quoted(CONTAINER_KINDS)}) THEN 0 WHEN kind = 'FUNCTION' THEN 1 WHEN kind = 'OTHER' THEN 2 END AS tier FROM known WHERE {_TEST}),
anchors AS (SELECT *, count(*) OVER (PARTITION BY project_id, file_id) AS anchors FROM (SELECT *, min(tier) OVER (PARTITION BY project_id, file_id) AS best FROM tiers WHERE tier IS NOT NULL) WHERE tier = best),
uniq AS (SELECT project_id, file_id, id AS test_id FROM anchors WHERE anchors = 1),
production AS (SELECT * FROM known WHERE NOT {_TEST})"""
_NAMING = f""", keys AS (SELECT project_id, id AS test_id, {_NORM.format(_STRIP.format("name"))} AS key FROM anchors UNION SELECT project_id, id, {_NORM.format("regexp_replace(" + _STEM + ", '(?:[._-](?:tests?|spec(?:ification)?s?|it))$', '', 'i')")} FROM anchors),
naming AS (SELECT DISTINCT k.project_id, k.test_id, p.id AS production_id, 'NAMING_CONVENTION' AS type FROM keys k JOIN production p ON p.project_id = k.project_id AND {_NORM.format("p.name")} = k.key WHERE k.key <> '')"""
_USES = """, uses AS (SELECT DISTINCT o.project_id, u.test_id, o.symbol_id AS production_id, CASE WHEN o.role = 'CALL' THEN 'DIRECT_CALL' ELSE 'DIRECT_REFERENCE' END AS type
  FROM occurrences o JOIN uniq u ON u.project_id = o.project_id AND u.file_id = o.file_id JOIN production p ON p.id = o.symbol_id WHERE o.resolution_status = 'RESOLVED' AND o.role <> 'DEFINITION')"""
_CALLS = f""", calls AS (SELECT DISTINCT r.project_id, CASE WHEN s.kind IN ({quoted([*CONTAINER_KINDS, "FUNCTION", "OTHER"])}) THEN r.source_id ELSE u.test_id END AS test_id, r.target_id AS production_id, CASE WHEN r.kind = 'CALLS' THEN 'DIRECT_CALL' ELSE 'DIRECT_REFERENCE' END AS type
  FROM relationships r JOIN known s ON s.id = r.source_id JOIN production p ON p.id = r.target_id LEFT JOIN uniq u ON u.file_id = s.file_id
  WHERE r.nature = 'FACTUAL' AND r.kind IN ('CALLS', 'REFERENCES') AND contains('/' || lower(s.file_id), '/src/test/'))"""

R.add("e04_test_anchors", lambda t: derive.test_anchors(t.symbols).select("id", "file_id", "tier", "anchors"), f"{cte('symbols')}{_ANCHORS} SELECT id, file_id, tier, anchors FROM anchors")
R.add("d03_naming_join", lambda t: (lambda symbols: derive.naming_candidates(symbols, derive.test_anchors(symbols)))(t.projected("symbols")), f"{cte('symbols')}{_ANCHORS}{_NAMING} SELECT * FROM naming")
R.add("d01_occurrence_join", lambda t: derive.occurrence_candidates(t.symbols, occurrences(t), derive.test_anchors(t.symbols)), f"{cte('symbols', 'occurrences')}{_ANCHORS}{_USES} SELECT * FROM uses")
R.add("d02_relationship_join", lambda t: derive.relationship_candidates(t.symbols, t.relationships, derive.test_anchors(t.symbols)), f"{cte('symbols', 'relationships')}{_ANCHORS}{_CALLS} SELECT * FROM calls WHERE test_id IS NOT NULL")

_NS = f"CASE WHEN kind IN ({quoted(MEMBER_KINDS)}) THEN regexp_replace(ns0, '[./][^./]*$', '') ELSE ns0 END"
_NSTABLE = f""", spaces AS (SELECT id, {_NS} AS ns FROM (SELECT id, kind, CASE WHEN regexp_matches(coalesce(qualified_name, ''), '[./]') THEN regexp_replace(qualified_name, '[./][^./]*$', '') ELSE '' END AS ns0 FROM known))"""
_RELATED = f"""{_NSTABLE}, candidates AS (SELECT * FROM naming UNION SELECT * FROM uses UNION SELECT * FROM calls WHERE test_id IS NOT NULL),
pairs AS (SELECT project_id, test_id, production_id, max((type = 'NAMING_CONVENTION')::INT) AS a, max((type = 'DIRECT_REFERENCE')::INT) AS b, max((type = 'DIRECT_CALL')::INT) AS c FROM candidates GROUP BY ALL),
near AS (SELECT p.*, (x.ns = y.ns AND x.ns <> '')::INT AS d FROM pairs p JOIN spaces x ON x.id = p.test_id JOIN spaces y ON y.id = p.production_id)
SELECT 'rel:' || sha256(project_id || {_U} || test_id || {_U} || 'RELATED_TEST' || {_U} || production_id) AS id, project_id, test_id, production_id, CASE WHEN b + c > 0 THEN 'DERIVED' ELSE 'HEURISTIC' END AS nature,
round(1 - 0.9::DOUBLE * (CASE WHEN a = 1 THEN 0.45::DOUBLE ELSE 1 END) * (CASE WHEN b = 1 THEN 0.35::DOUBLE ELSE 1 END) * (CASE WHEN c = 1 THEN 0.2::DOUBLE ELSE 1 END) * (CASE WHEN d = 1 THEN 0.8::DOUBLE ELSE 1 END), 3) AS confidence, 1 + a + b + c + d AS evidence_types FROM near"""
R.add("e02_related_tests", lambda t: derive.related_tests(t.projected("symbols"), t.projected("occurrences", "part").withColumn("roles", F.array("role")), t.projected("relationships")), f"{cte('symbols', 'occurrences', 'relationships')}{_ANCHORS}{_NAMING}{_USES}{_CALLS}{_RELATED}")
R.add("e03_noisy_or", lambda t: derive.noisy_or(t.relationships.filter("confidence IS NOT NULL"), ["source_id"], "confidence"),
      f"{cte('relationships')} SELECT source_id, round(round(1 - product(1 - confidence), 9)::DECIMAL(18, 9), 3)::DOUBLE AS confidence FROM relationships WHERE confidence IS NOT NULL GROUP BY source_id")
R.add("e05_context_evidence", lambda t: t.symbols.filter("NOT external").select("id", text.namespace(F.col("qualified_name"), F.col("kind")).alias("namespace")),
      f"{cte('symbols')}, known AS (SELECT * FROM symbols WHERE NOT external){_NSTABLE} SELECT id, ns AS namespace FROM spaces")
R.add("e06_distinct_evidence", lambda t: derive.distinct_evidence(t.relationships.select(F.col("source_id").alias("relationship_id"), F.col("kind").alias("type"), F.coalesce("target_id", F.lit("-")).alias("description"), "file_id", "start_line")),
      f"{cte('relationships')} SELECT DISTINCT source_id AS relationship_id, kind AS type, coalesce(target_id, '-') AS description, file_id, start_line FROM relationships")
R.add("e12_graph_degree", lambda t: t.relationships.select(F.explode(F.array_compact(F.array("source_id", "target_id"))).alias("symbol_id")).groupBy("symbol_id").agg(F.count("*").alias("degree")),
      f"{cte('relationships')} SELECT symbol_id, count(*) AS degree FROM (SELECT source_id AS symbol_id FROM relationships UNION ALL SELECT target_id FROM relationships WHERE target_id IS NOT NULL) GROUP BY symbol_id")
R.add("e24_index_metrics", lambda t: t.symbols.agg(F.countDistinct("id").alias("ids"), F.countDistinct("qualified_name").alias("qualified_names"), F.countDistinct("name").alias("names"), F.countDistinct("file_id").alias("files"), F.count("*").alias("total")),
      f"{cte('symbols')} SELECT count(DISTINCT id) AS ids, count(DISTINCT qualified_name) AS qualified_names, count(DISTINCT name) AS names, count(DISTINCT file_id) AS files, count(*) AS total FROM symbols")
R.add("e25_ingestion_report", lambda t: derive.ingestion_report(t.symbols, t.occurrences, t.relationships),
      f"{cte('symbols', 'occurrences', 'relationships')} SELECT " + ", ".join(f"(SELECT {what} FROM {table}) AS {table}_{name}" for table, state in (("symbols", "'RESOLVED'"), ("occurrences", "resolution_status"), ("relationships", "resolution_status")) for name, what in (("rows", "count(*)"), ("repeated", "count(*) - count(DISTINCT id)"), ("without_file", "count_if(file_id IS NULL)::BIGINT"), ("resolved", f"count_if({state} = 'RESOLVED')::BIGINT"), ("other", f"count_if({state} <> 'RESOLVED')::BIGINT"))) + ", (SELECT count_if(external)::BIGINT FROM symbols) AS symbols_external")


def placed(t: Tables) -> DataFrame:
    return t.placed_symbols


def classified(t: Tables) -> DataFrame:
    """Dependencies with the modules of their ends. They are made from a pass over the relations and not published: every reader takes all of them."""
    return architecture.classify_dependencies(derive.dependencies(t.projected("relationships")), placed(t))


_PLACED = """, placed AS (SELECT symbols.*, m.module_key, m.module_root FROM symbols LEFT JOIN (SELECT file_id, arg_min(module_id, (root_kind = 'MODULE', -length(root), module_id)) AS module_key, arg_min(root, (root_kind = 'MODULE', -length(root), module_id)) AS module_root
  FROM (SELECT DISTINCT file_id FROM symbols) f JOIN modules ON file_id = root OR starts_with(file_id, root || '/') GROUP BY file_id) m ON m.file_id = symbols.file_id AND NOT external)"""
_SCOPES = """, classified AS (SELECT d.*, x.module_key AS source_module, y.module_key AS target_module, CASE WHEN x.module_key IS NULL OR y.module_key IS NULL THEN 'UNASSIGNED' WHEN x.module_key = y.module_key THEN 'INTRA' ELSE 'INTER' END AS scope
  FROM deps d LEFT JOIN placed x ON x.id = d.source_id LEFT JOIN placed y ON y.id = d.target_id),
edges AS (SELECT source_module, target_module, count(*) AS dependency_count, count(DISTINCT source_id) AS source_symbols, count(DISTINCT target_id) AS target_symbols, 1.0::DOUBLE AS confidence,
  array_to_string(list_sort(list(id))[1:5], ',') AS sample_ids, 'module-dependency:' || sha256(source_module || chr(31) || target_module) AS id FROM classified WHERE scope = 'INTER' GROUP BY source_module, target_module)"""
_ARCH = f"{cte('symbols', 'modules', 'relationships')}{_DEPS}{_PLACED}{_SCOPES}"
R.add("d05_module_assignment", lambda t: architecture.assign_modules(t.symbols, t.modules).select("id", "module_key"), f"{cte('symbols', 'modules')}{_PLACED} SELECT id, module_key FROM placed")
R.add("d04_dependency_scopes", lambda t: classified(t).groupBy("scope").agg(F.count("*").alias("dependencies")), f"{_ARCH} SELECT scope, count(*) AS dependencies FROM classified GROUP BY scope")
R.add("e07_module_edges", lambda t: architecture.module_edges(classified(t)), f"{_ARCH} SELECT * FROM edges")
R.add("f09_bounded_sample", lambda t: derive.top_per_group(classified(t).filter("scope = 'INTER'"), ["source_module", "target_module"], ["id"], 5).select("source_module", "target_module", "id", "k"),
      f"{_ARCH} SELECT source_module, target_module, id, k FROM (SELECT *, row_number() OVER (PARTITION BY source_module, target_module ORDER BY id)::INTEGER AS k FROM classified WHERE scope = 'INTER') WHERE k <= 5")
_NSF = "CASE WHEN folder = '' THEN '<default>' ELSE replace(folder, '/', '.') END"
_SPACES = f", inside AS (SELECT *, {_NSF} AS namespace FROM (SELECT *, regexp_replace(substr(file_id, length(module_root) + 2), '/?[^/]*$', '') AS folder FROM placed WHERE module_key IS NOT NULL))"
R.add("e08_topology", lambda t: architecture.topology(placed(t)),
      f"{cte('symbols', 'modules')}{_PLACED}{_SPACES} SELECT module_key, count(*) AS symbols, array_to_string(list_sort(list_distinct(list(upper(language)))), ',') AS languages, count(DISTINCT namespace) AS namespaces FROM inside GROUP BY module_key")
R.add("e08_topology_totals", lambda t: architecture.topology_totals(placed(t)),
      f"{cte('symbols', 'modules')}{_PLACED} SELECT count_if(NOT external AND module_key IS NOT NULL)::BIGINT AS local, count_if(external)::BIGINT AS external, count_if(NOT external AND module_key IS NULL)::BIGINT AS unassigned FROM placed")
R.add("e09_namespaces", lambda t: architecture.namespaces(placed(t)), f"{cte('symbols', 'modules')}{_PLACED}{_SPACES} SELECT module_key, namespace, count(*) AS symbols, count(DISTINCT file_id) AS files FROM inside GROUP BY module_key, namespace")


def metrics(t: Tables) -> DataFrame:
    """Written once, as the few edges between modules are read three times."""
    return architecture.concentration(t.modules, stored(architecture.module_edges(classified(t)), "module-edges"))


_METRICS = f"""{_ARCH}, total AS (SELECT coalesce(sum(dependency_count), 0) AS n FROM edges),
inc AS (SELECT target_module AS module_key, count(*) AS incoming_modules, sum(dependency_count)::BIGINT AS incoming_count, sum(dependency_count * dependency_count) / (sum(dependency_count) * sum(dependency_count))::DOUBLE AS incoming_hhi, max(dependency_count) / sum(dependency_count)::DOUBLE AS incoming_max_share FROM edges GROUP BY target_module),
outg AS (SELECT source_module AS module_key, count(*) AS outgoing_modules, sum(dependency_count)::BIGINT AS outgoing_count, sum(dependency_count * dependency_count) / (sum(dependency_count) * sum(dependency_count))::DOUBLE AS outgoing_hhi, max(dependency_count) / sum(dependency_count)::DOUBLE AS outgoing_max_share FROM edges GROUP BY source_module),
metrics AS (SELECT m.module_key, coalesce(incoming_modules, 0) AS incoming_modules, coalesce(incoming_count, 0) AS incoming_count, coalesce(incoming_hhi, 0) AS incoming_hhi, coalesce(incoming_max_share, 0) AS incoming_max_share,
  coalesce(outgoing_modules, 0) AS outgoing_modules, coalesce(outgoing_count, 0) AS outgoing_count, coalesce(outgoing_hhi, 0) AS outgoing_hhi, coalesce(outgoing_max_share, 0) AS outgoing_max_share,
  CASE WHEN n > 0 THEN coalesce(incoming_count, 0) / n::DOUBLE ELSE 0 END AS incoming_share, CASE WHEN n > 0 THEN coalesce(outgoing_count, 0) / n::DOUBLE ELSE 0 END AS outgoing_share
  FROM (SELECT DISTINCT module_id AS module_key FROM modules) m LEFT JOIN inc ON inc.module_key = m.module_key LEFT JOIN outg ON outg.module_key = m.module_key, total)"""


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """Doubles to so many places, as the SQL beside it has them."""
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


_ROUNDED = ", ".join(f"round({w}_{m}, 9) AS {w}_{m}" for w in ("incoming", "outgoing") for m in ("hhi", "max_share", "share"))
R.add("e10_concentration", lambda t: rounded(metrics(t)), f"{_METRICS} SELECT module_key, incoming_modules, incoming_count, outgoing_modules, outgoing_count, {_ROUNDED} FROM metrics")
R.add("f01_directional_ranks", lambda t: architecture.directional_ranks(metrics(t)).select("module_key", "incoming_rank", "outgoing_rank"),
      f"{_METRICS} SELECT module_key, CASE WHEN incoming_count > 0 THEN dense_rank() OVER (ORDER BY incoming_count DESC) ELSE 0 END::INTEGER AS incoming_rank, CASE WHEN outgoing_count > 0 THEN dense_rank() OVER (ORDER BY outgoing_count DESC) ELSE 0 END::INTEGER AS outgoing_rank FROM metrics")
R.add("c17_module_context", lambda t: architecture.module_context(architecture.module_edges(classified(t)), metrics(t), "SMALL").select("way", "module_key", "dependency_count", "incoming_count", "outgoing_count"),
      f"{_METRICS} SELECT way, e.module_key, dependency_count, incoming_count, outgoing_count FROM (SELECT CASE WHEN source_module = 'SMALL' THEN 'OUTGOING' ELSE 'INCOMING' END AS way, CASE WHEN source_module = 'SMALL' THEN target_module ELSE source_module END AS module_key, dependency_count FROM edges WHERE 'SMALL' IN (source_module, target_module)) e JOIN metrics USING (module_key)")
_LANGS = "SELECT DISTINCT upper(language) AS name, module_key FROM placed WHERE module_key IS NOT NULL"
R.add("e11_technologies", lambda t: architecture.technologies(placed(t).filter("module_key IS NOT NULL").select("module_key", F.upper("language").alias("name")), t.modules.select(F.col("module_id").alias("module_key"), F.lit("MAVEN").alias("name"))),
      f"{cte('symbols', 'modules')}{_PLACED}, both_ AS (SELECT 'LANGUAGE' AS category, name, module_key FROM ({_LANGS}) UNION ALL SELECT DISTINCT 'BUILD_SYSTEM', 'MAVEN', module_id FROM modules) SELECT category, name, count(*) AS modules, array_to_string(list_sort(list(module_key)), ',') AS module_keys FROM both_ GROUP BY category, name")
R.add("d18_architecture_composition", lambda t: architecture.topology(placed(t)).join(architecture.directional_ranks(metrics(t)), "module_key").select("module_key", "symbols", "namespaces", "incoming_count", "outgoing_count", "incoming_rank"),
      f"{_METRICS}{_SPACES}, top AS (SELECT module_key, count(*) AS symbols, count(DISTINCT namespace) AS namespaces FROM inside GROUP BY module_key) SELECT module_key, symbols, namespaces, incoming_count, outgoing_count, CASE WHEN incoming_count > 0 THEN dense_rank() OVER (ORDER BY incoming_count DESC) ELSE 0 END::INTEGER AS incoming_rank FROM top JOIN metrics USING (module_key)")
