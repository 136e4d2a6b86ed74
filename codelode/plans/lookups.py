"""Queries of symbols, usages and relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DEPENDENCY_KINDS, ENTITY_TYPES, RELATIONSHIP_KINDS, ordinal_sql
from ..operators import lookup
from .projection import cte
from .registry import Registry, Tables

R = Registry()
SYMBOL, FILE = "sym:42", "src/main/SMALL/F2.java"


def occurrences(t: Tables) -> DataFrame:
    return t.occurrences.withColumn("roles", F.array("role"))


R.add("c01_symbol_by_id", lambda t: lookup.symbol_by_id(t.symbols, "proj", SYMBOL), f"{cte('symbols')} SELECT * FROM symbols WHERE id = '{SYMBOL}'")

_RANK = """CASE WHEN lower(qualified_name) = '{q}' THEN 0 WHEN lower(name) = '{q}' THEN 1 WHEN starts_with(lower(name), '{q}') THEN 2 WHEN starts_with(lower(qualified_name), '{q}') THEN 3
  WHEN contains(lower(name), '{q}') THEN 4 WHEN contains(lower(qualified_name), '{q}') THEN 5 WHEN contains(lower(symbol_key), '{q}') THEN 6 END"""
_ORDER = "match_rank, external, generated, qualified_name NULLS LAST, name, signature NULLS LAST, id"
R.add("c02_symbol_search", lambda t: lookup.search_symbols(t.symbols, "proj", "Ring", kind="CLASS", limit=50).select("id", "match_rank", "position"),
      f"{cte('symbols')}, m AS (SELECT *, {_RANK.format(q='ring')} AS match_rank FROM symbols WHERE kind = 'CLASS') SELECT id, match_rank, position FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER})::INTEGER AS position FROM m WHERE match_rank IS NOT NULL) WHERE position <= 50")
R.add("c03_match_rank", lambda t: lookup.ranked_symbols(t.symbols, "small ring").select("id", "match_rank"), f"{cte('symbols')} SELECT * FROM (SELECT id, {_RANK.format(q='small ring')} AS match_rank FROM symbols) WHERE match_rank IS NOT NULL")
R.add("g01_symbol_order", lambda t: lookup.search_symbols(t.symbols, "proj", module="Brand#7", limit=500).select("id", "position"),
      f"{cte('symbols')}, m AS (SELECT *, 0 AS match_rank FROM symbols WHERE module_id = 'Brand#7') SELECT id, position FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER})::INTEGER AS position FROM m) WHERE position <= 500")
R.add("c04_file_symbols", lambda t: lookup.file_symbols(t.symbols, "proj", FILE).select("id", "start_line", "position"),
      f"{cte('symbols')} SELECT id, start_line, position FROM (SELECT *, row_number() OVER (ORDER BY start_line, start_column, qualified_name NULLS LAST, name, id)::INTEGER AS position FROM symbols WHERE file_id = '{FILE}') WHERE position <= 200")
R.add("c05_usages", lambda t: lookup.usages(occurrences(t), "proj", SYMBOL).select("id", "file_id", "start_line", "start_column", "role", "position"),
      f"{cte('occurrences')} SELECT id, file_id, start_line, start_column, role, position FROM (SELECT *, row_number() OVER (ORDER BY file_id, start_line, start_column, id)::INTEGER AS position FROM occurrences WHERE symbol_id = '{SYMBOL}' AND role NOT IN ('DEFINITION', 'FORWARD_DEFINITION')) WHERE position <= 200")
R.add("c06_definitions", lambda t: occurrences(t).filter(lookup.is_definition()).groupBy("symbol_id").agg(F.count("*").alias("definitions")),
      f"{cte('occurrences')} SELECT symbol_id, count(*) AS definitions FROM occurrences WHERE role IN ('DEFINITION', 'FORWARD_DEFINITION') GROUP BY symbol_id")

_REL_ORDER = f"direction_rank, {ordinal_sql('kind', RELATIONSHIP_KINDS)}, target_id IS NULL, {ordinal_sql('source_type', ENTITY_TYPES)}, source_id, {ordinal_sql('target_type', ENTITY_TYPES)} NULLS LAST, target_id NULLS LAST, unresolved_target NULLS LAST, file_id NULLS LAST, start_line NULLS LAST, id"


def _relations(where: str, rank: str, limit: int = 200) -> str:
    return f"{cte('relationships')}, m AS (SELECT *, {rank} AS direction_rank FROM relationships WHERE {where}) SELECT id, kind, direction_rank, position FROM (SELECT *, row_number() OVER (ORDER BY {_REL_ORDER})::INTEGER AS position FROM m) WHERE position <= {limit}"


# one lookup is one pass over the projection: publishing the relations in two orders moves all of them twice more than the pass does
_COLUMNS = ["id", "kind", "direction_rank", "position"]
R.add("c07_relationships", lambda t: lookup.relationships(t.projected("relationships"), "proj", SYMBOL, "ANY", DEPENDENCY_KINDS, "RESOLVED", "FACTUAL").select(*_COLUMNS),
      _relations(f"(source_id = '{SYMBOL}' OR target_id = '{SYMBOL}') AND kind IN ({', '.join(repr(k) for k in DEPENDENCY_KINDS)}) AND resolution_status = 'RESOLVED' AND nature = 'FACTUAL'", f"CASE WHEN source_id = '{SYMBOL}' THEN 0 ELSE 1 END"))
R.add("c08_direction_any", lambda t: lookup.relationships(t.projected("relationships"), "proj", SYMBOL, "ANY", limit=1000).select(*_COLUMNS), _relations(f"source_id = '{SYMBOL}' OR target_id = '{SYMBOL}'", f"CASE WHEN source_id = '{SYMBOL}' THEN 0 ELSE 1 END", 1000))
for _code, _name in zip(("c09", "c10", "c11", "c12", "c13", "c14"), lookup.PRESETS, strict=True):
    _way, _kinds = lookup.PRESETS[_name]
    R.add(f"{_code}_{_name}", lambda t, n=_name: lookup.preset(n, t.projected("relationships"), "proj", SYMBOL).select(*_COLUMNS), _relations(f"{'target_id' if _way == 'IN' else 'source_id'} = '{SYMBOL}' AND kind = '{_kinds[0]}'", "0"))
R.add("c15_usage_projection", lambda t: occurrences(t).filter("resolution_status = 'RESOLVED'").select("symbol_id", "file_id", "start_line", "start_column", "role"),
      f"{cte('occurrences')} SELECT symbol_id, file_id, start_line, start_column, role FROM occurrences WHERE resolution_status = 'RESOLVED'")
R.add("c16_test_paths", lambda t: t.symbols.select("file_id").distinct().withColumn("is_test", lookup.is_test_path("file_id")),
      f"{cte('symbols')} SELECT DISTINCT file_id, ('/' || lower(replace(file_id, '\\', '/'))) SIMILAR TO '.*(/src/test/|/test/|/tests/|/__tests__/).*' OR regexp_matches(lower(file_id), '\\.(test|spec)\\.[^/.]+$') AS is_test FROM symbols")
R.add("g04_relationship_order", lambda t: lookup.relationships(t.projected("relationships"), "proj", SYMBOL, "OUT", limit=1000).select(*_COLUMNS), _relations(f"source_id = '{SYMBOL}'", "0", 1000))
R.add("g06_truncation_probe", lambda t: lookup.usages(occurrences(t), "proj", SYMBOL, 4).agg((F.count("*") > 3).alias("truncated"), F.least(F.count("*"), F.lit(3)).alias("shown")),
      f"{cte('occurrences')} SELECT count(*) > 3 AS truncated, least(count(*), 3) AS shown FROM (SELECT * FROM occurrences WHERE symbol_id = '{SYMBOL}' AND role <> 'DEFINITION' LIMIT 4)")
