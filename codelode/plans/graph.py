"""Queries of traversals over relations and the program graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import NATURES, PROPAGATING_KINDS, ordinal_sql
from ..operators import traverse
from ..store import stored
from .projection import cte
from .registry import Registry, Tables
from .structure import quoted, rounded

R = Registry()
ROOT, DEPTH = "sym:40", 3

_EDGES = f"""{cte('symbols', 'relationships')}, edges AS (SELECT r.id, r.kind, r.source_id, r.target_id, coalesce(r.confidence, 1.0) AS ec FROM relationships r JOIN symbols a ON a.id = r.source_id JOIN symbols b ON b.id = r.target_id
  WHERE r.kind IN ({quoted(PROPAGATING_KINDS)}) AND (r.resolution_status = 'RESOLVED' OR (r.kind = 'RELATED_TEST' AND r.resolution_status = 'HEURISTIC'))),
entered AS (SELECT id FROM symbols WHERE NOT external AND NOT generated)"""


def _levels() -> str:
    out = [f", f0 AS (SELECT '{ROOT}' AS symbol_id, 0 AS depth, 1.0::DOUBLE AS confidence, '' AS path), seen0 AS (SELECT * FROM f0)"]
    for i in range(1, DEPTH + 1):
        out.append(f"""c{i} AS (SELECT e.source_id AS symbol_id, {i} AS depth, least(f.confidence, e.ec) AS confidence, CASE WHEN f.path = '' THEN e.id ELSE f.path || chr(1) || e.id END AS path, e.kind
  FROM f{i - 1} f JOIN edges e ON e.target_id = f.symbol_id JOIN entered n ON n.id = e.source_id WHERE e.source_id <> '{ROOT}'),
f{i} AS (SELECT symbol_id, depth, confidence, path FROM c{i} WHERE symbol_id NOT IN (SELECT symbol_id FROM seen{i - 1}) QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY confidence DESC, path) = 1),
seen{i} AS (SELECT * FROM seen{i - 1} UNION ALL SELECT * FROM f{i})""")
    return ",\n".join(out)


_IMPACT = f"{_EDGES}{_levels()}, impacts AS (SELECT * FROM seen{DEPTH} WHERE depth > 0)"


def impact(t: Tables) -> tuple[DataFrame, DataFrame]:
    return traverse.impact(t.symbols, t.relationships, ROOT, DEPTH, 10_000, t.impact_edges)


def readable(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.replace("path", F.lit(traverse.SEP), F.lit(" > ")))


_PATH = "replace(path, chr(1), ' > ') AS path"
R.add("i01_impact", lambda t: rounded(readable(impact(t)[0])), f"{_IMPACT} SELECT symbol_id, depth, round(confidence, 9) AS confidence, {_PATH} FROM impacts ORDER BY depth, confidence DESC, impacts.path LIMIT 10000")
R.add("f07_best_candidate", lambda t: rounded(impact(t)[0].select("symbol_id", "depth", "confidence", F.element_at(F.split("path", traverse.SEP), -1).alias("last_edge"))),
      f"{_IMPACT} SELECT symbol_id, depth, round(confidence, 9) AS confidence, list_extract(string_split(path, chr(1)), -1) AS last_edge FROM impacts ORDER BY depth, impacts.confidence DESC, impacts.path LIMIT 10000")
_TESTS = " UNION ALL ".join(f"SELECT * FROM c{i} WHERE kind = 'RELATED_TEST'" for i in range(1, DEPTH + 1))
R.add("i02_impacted_tests", lambda t: rounded(readable(impact(t)[1])), f"{_IMPACT}, tests AS ({_TESTS}) SELECT symbol_id, depth, round(confidence, 9) AS confidence, {_PATH} FROM (SELECT * FROM tests QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY depth, confidence DESC, path) = 1) WHERE symbol_id IN (SELECT symbol_id FROM impacts)")
R.add("i03_impact_limitations", lambda t: traverse.impact_limitations(t.symbols, t.relationships),
      f"{cte('symbols', 'relationships')} SELECT bool_or(resolution_status = 'UNRESOLVED') AS unresolved_relationships_ignored, coalesce(bool_or(target_id IS NOT NULL AND (a.id IS NULL OR b.id IS NULL)), false) AS external_targets_not_traversed FROM relationships r LEFT JOIN symbols a ON a.id = r.source_id LEFT JOIN symbols b ON b.id = r.target_id WHERE r.kind IN ({quoted(PROPAGATING_KINDS)})")
R.add("d12_traversable_edges", lambda t: traverse.traversable(t.relationships, t.symbols).select("id", "kind", "source_id", "target_id"), f"{_EDGES} SELECT id, kind, source_id, target_id FROM edges")
R.add("d13_impacted_tests_semi_join", lambda t: traverse.impacted_tests(t.projected("symbols"), t.projected("relationships"), ROOT, DEPTH), f"{_IMPACT}, tests AS ({_TESTS}) SELECT DISTINCT symbol_id FROM tests WHERE symbol_id IN (SELECT symbol_id FROM impacts)")
R.add("g11_impact_order", lambda t: readable(traverse.impact(t.symbols, t.relationships, ROOT, 2, 50, t.impact_edges)[0]).select("symbol_id", "depth", "path"), f"{_IMPACT} SELECT symbol_id, depth, {_PATH} FROM impacts WHERE depth <= 2 ORDER BY depth, confidence DESC, impacts.path LIMIT 50")

_GRAPH = """, graph AS (SELECT CASE kind WHEN 'CALLS' THEN 'call:' WHEN 'READS' THEN 'read-flow:' ELSE 'write-flow:' END || r.id AS id, 'symbol:' || CASE WHEN kind = 'READS' THEN target_id ELSE source_id END AS source_node_id,
  'symbol:' || CASE WHEN kind = 'READS' THEN source_id ELSE target_id END AS target_node_id, CASE WHEN kind = 'CALLS' THEN 'CALL' ELSE 'DATA_FLOW' END AS kind, CASE WHEN kind = 'CALLS' THEN nature ELSE 'DERIVED' END AS nature,
  CASE WHEN kind = 'CALLS' THEN confidence ELSE least(0.9::DOUBLE, 0.9::DOUBLE * coalesce(confidence, 1.0)) END AS confidence FROM relationships r WHERE resolution_status = 'RESOLVED' AND kind IN ('CALLS', 'WRITES', 'READS') AND target_id IS NOT NULL
  AND source_id IN (SELECT id FROM symbols) AND target_id IN (SELECT id FROM symbols))"""


def graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.graph_nodes, t.graph_edges


def edges_once(t: Tables) -> DataFrame:
    """The program graph's edges for queries that go through them once: not published."""
    return traverse.program_graph(t.symbols, t.projected("relationships"))[1]


def quality(t: Tables) -> DataFrame:
    """How well factual and derived edges meet the calls; the graph is made once and its ends written as a step."""
    made = stored(edges_once(t).select("source_node_id", "target_node_id", "kind", "nature"), "quality-edges")
    return traverse.edge_quality(made.filter("nature <> 'HEURISTIC'"), made.filter("kind = 'CALL'"))


R.add("i08_program_graph_edges", lambda t: rounded(traverse.program_graph(t.symbols, t.relationships)[1]), f"{cte('symbols', 'relationships')}{_GRAPH} SELECT id, source_node_id, target_node_id, kind, nature, round(confidence, 9) AS confidence FROM graph")
R.add("i08_program_graph_nodes", lambda t: traverse.program_graph(t.symbols, t.relationships)[0], f"{cte('symbols', 'relationships')}{_GRAPH} SELECT 'symbol:' || s.id AS id, s.id AS symbol_id, s.name AS label, 'SYMBOL' AS kind FROM symbols s WHERE 'symbol:' || s.id IN (SELECT source_node_id FROM graph UNION SELECT target_node_id FROM graph)")


def _advanced() -> str:
    nat = ordinal_sql("nature", NATURES)
    out = [f", steps AS (SELECT CASE WHEN kind = 'CALL' THEN target_node_id ELSE source_node_id END AS node, CASE WHEN kind = 'CALL' THEN source_node_id ELSE target_node_id END AS nxt, id, coalesce(confidence, 1.0) AS ec, {nat} AS en FROM graph)",
           f"a0 AS (SELECT 'symbol:{ROOT}' AS node, '' AS path, 0 AS depth, 1.0::DOUBLE AS conf, 0 AS nat), v0 AS (SELECT * FROM a0)"]
    for i in range(1, DEPTH + 1):
        out.append(f"""a{i} AS (SELECT s.nxt AS node, CASE WHEN a.path = '' THEN s.id ELSE a.path || chr(1) || s.id END AS path, {i} AS depth, least(a.conf, s.ec) AS conf, greatest(a.nat, s.en) AS nat FROM a{i - 1} a JOIN steps s ON s.node = a.node
  WHERE s.nxt NOT IN (SELECT node FROM v{i - 1}) QUALIFY row_number() OVER (PARTITION BY s.nxt ORDER BY CASE WHEN a.path = '' THEN s.id ELSE a.path || chr(1) || s.id END) = 1), v{i} AS (SELECT * FROM v{i - 1} UNION ALL SELECT * FROM a{i})""")
    return ",\n".join(out)


R.add("i04_advanced_impact", lambda t: rounded(readable(traverse.advanced_impact(*graph(t), ROOT, impact(t)[0].filter("depth = 1"), DEPTH, 10_000))),
      f"{_IMPACT}{_GRAPH}{_advanced()} SELECT substr(node, 8) AS symbol_id, depth, round(conf, 9) AS confidence, list_extract(['FACTUAL', 'DERIVED', 'HEURISTIC'], nat + 1) AS nature, {_PATH} FROM v{DEPTH} WHERE depth > 0 AND substr(node, 8) NOT IN (SELECT symbol_id FROM impacts WHERE depth = 1)")


def _flows() -> str:
    out = [", flow AS (SELECT source_node_id AS node, target_node_id AS nxt, id FROM graph), p0 AS (SELECT ? AS node, [?] AS nodes, '' AS path, false AS cycle, 0 AS depth)".replace("?", f"'symbol:{ROOT}'")]
    for i in (1, 2):
        out.append(f"p{i} AS (SELECT f.nxt AS node, list_append(p.nodes, f.nxt) AS nodes, CASE WHEN p.path = '' THEN f.id ELSE p.path || chr(1) || f.id END AS path, list_contains(p.nodes, f.nxt) AS cycle, {i} AS depth FROM p{i - 1} p JOIN flow f ON f.node = p.node WHERE NOT p.cycle)")
    return ",\n".join(out)


R.add("i05_flow_paths", lambda t: readable(traverse.flow_paths(graph(t)[1], f"symbol:{ROOT}", 2, 10_000)).select(F.array_join("nodes", " > ").alias("nodes"), "path", "cycle", "depth"),
      f"{cte('symbols', 'relationships')}{_GRAPH}{_flows()} SELECT array_to_string(nodes, ' > ') AS nodes, {_PATH}, cycle, depth FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) ORDER BY depth, path LIMIT 10000")


def annotated(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The program graph with some of its nodes marked as sources, sinks and sanitizers."""
    nodes, edges = graph(t)
    key = F.substring("symbol_id", 5, 20).cast("long")
    return nodes.withColumn("kind", F.when(key % 97 == 0, "SOURCE").when(key % 31 == 0, "SINK").when(key % 11 == 0, "SANITIZER").otherwise("SYMBOL")), edges


def _security() -> str:
    nat = ordinal_sql("nature", NATURES)
    out = [f""", marks AS (SELECT 'symbol:' || id AS node, CASE WHEN k % 97 = 0 THEN 'SOURCE' WHEN k % 31 = 0 THEN 'SINK' WHEN k % 11 = 0 THEN 'SANITIZER' ELSE 'SYMBOL' END AS kind FROM (SELECT id, substr(id, 5)::BIGINT AS k FROM symbols) WHERE 'symbol:' || id IN (SELECT source_node_id FROM graph UNION SELECT target_node_id FROM graph)),
flow AS (SELECT source_node_id AS node, target_node_id AS nxt, id, coalesce(confidence, 1.0) AS ec, {nat} AS en FROM graph),
s0 AS (SELECT node AS source, node, [node] AS nodes, '' AS path, '' AS san, 1.0::DOUBLE AS conf, 0 AS nat FROM marks WHERE kind = 'SOURCE'), z0 AS (SELECT '' AS source, '' AS node, '' AS san WHERE false)"""]
    for i in range(1, DEPTH + 1):
        out.append(f"""m{i} AS (SELECT s.source, f.nxt AS node, list_append(s.nodes, f.nxt) AS nodes, CASE WHEN s.path = '' THEN f.id ELSE s.path || chr(1) || f.id END AS path, CASE WHEN k.kind = 'SANITIZER' THEN s.san || '|' || f.nxt ELSE s.san END AS san, least(s.conf, f.ec) AS conf, greatest(s.nat, f.en) AS nat, k.kind, {i} AS depth
  FROM s{i - 1} s JOIN flow f ON f.node = s.node JOIN marks k ON k.node = f.nxt WHERE NOT list_contains(s.nodes, f.nxt)),
s{i} AS (SELECT source, node, nodes, path, san, conf, nat FROM m{i} m WHERE NOT EXISTS (SELECT 1 FROM z{i - 1} z WHERE z.source = m.source AND z.node = m.node AND z.san = m.san) QUALIFY row_number() OVER (PARTITION BY source, node, san ORDER BY path) = 1),
z{i} AS (SELECT * FROM z{i - 1} UNION ALL SELECT source, node, san FROM s{i})""")
    hits = " UNION ALL ".join(f"SELECT * FROM m{i} WHERE kind = 'SINK'" for i in range(1, DEPTH + 1))
    return ",\n".join([*out, f"hits AS ({hits})"])


R.add("i06_security_paths", lambda t: rounded(readable(traverse.security_paths(*annotated(t), DEPTH, 1000))),
      f"{cte('symbols', 'relationships')}{_GRAPH}{_security()} SELECT source, node AS sink, depth, {_PATH}, san AS sanitizers, san <> '' AS sanitized, round(conf, 9) AS confidence, list_extract(['FACTUAL', 'DERIVED', 'HEURISTIC'], nat + 1) AS nature FROM hits ORDER BY source, depth, hits.path LIMIT 1000")
R.add("d14_induced_subgraph", lambda t: traverse.induced_subgraph(*graph(t), 500, 1000)[1].select("id", "source_node_id", "target_node_id"),
      f"{cte('symbols', 'relationships')}{_GRAPH}, kept AS (SELECT DISTINCT node FROM (SELECT source_node_id AS node FROM graph UNION SELECT target_node_id FROM graph) ORDER BY node LIMIT 500) SELECT id, source_node_id, target_node_id FROM graph WHERE source_node_id IN (SELECT node FROM kept) AND target_node_id IN (SELECT node FROM kept) ORDER BY id LIMIT 1000")
R.add("h01_graph_union", lambda t: rounded(traverse.compose([graph(t)[1].filter("kind = 'CALL'"), graph(t)[1]])), f"{cte('symbols', 'relationships')}{_GRAPH} SELECT id, source_node_id, target_node_id, kind, nature, round(confidence, 9) AS confidence FROM graph")
R.add("e21_graph_quality", lambda t: rounded(quality(t)),
      f"{cte('symbols', 'relationships')}{_GRAPH}, o AS (SELECT DISTINCT source_node_id, target_node_id, kind FROM graph WHERE nature <> 'HEURISTIC'), e AS (SELECT DISTINCT source_node_id, target_node_id, kind FROM graph WHERE kind = 'CALL'), n AS (SELECT (SELECT count(*) FROM o) AS observed, (SELECT count(*) FROM e) AS expected, (SELECT count(*) FROM (SELECT * FROM o INTERSECT SELECT * FROM e)) AS matched) SELECT *, round(matched / observed::DOUBLE, 9) AS precision, round(matched / expected::DOUBLE, 9) AS recall FROM n")
R.add("d19_edge_ground_truth", lambda t: graph(t)[1].filter("nature <> 'HEURISTIC'").select("source_node_id", "target_node_id", "kind").intersect(graph(t)[1].filter("kind = 'CALL'").select("source_node_id", "target_node_id", "kind")),
      f"{cte('symbols', 'relationships')}{_GRAPH} SELECT source_node_id, target_node_id, kind FROM graph WHERE nature <> 'HEURISTIC' INTERSECT SELECT source_node_id, target_node_id, kind FROM graph WHERE kind = 'CALL'")
R.add("h05_set_intersection", lambda t: graph(t)[1].select("source_node_id").intersect(graph(t)[1].select("target_node_id")), f"{cte('symbols', 'relationships')}{_GRAPH} SELECT source_node_id FROM graph INTERSECT SELECT target_node_id FROM graph")
R.add("a20_capability_check", lambda t: traverse.missing_capabilities(edges_once(t), ["CALL_GRAPH", "TAINT_ANALYSIS"]), f"{cte('symbols', 'relationships')}{_GRAPH} SELECT 'LOCAL_DATA_FLOW' AS capability, 'UNDECLARED' AS problem WHERE EXISTS (SELECT 1 FROM graph WHERE kind = 'DATA_FLOW') UNION ALL SELECT 'TAINT_ANALYSIS', 'WITHOUT_FACTS'")
