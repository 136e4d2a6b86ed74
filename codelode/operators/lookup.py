"""Point lookups, lexical search, usages and relationships, each in a total deterministic order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import DEFINITION_ROLES, ENTITY_TYPES, RELATIONSHIP_KINDS, ordinal


def positioned(df: DataFrame, order: list, limit: int | None) -> DataFrame:
    """The first limit rows in an order, numbered from 1. Limited before numbering, so the one task that numbers holds limit rows."""
    if limit is not None:
        df = df.orderBy(*order).limit(limit)
    return df.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("int"))


def numbered(df: DataFrame, lead: Column, order: list) -> DataFrame:
    """Every row of df, numbered from 1 in an order that lead begins: the rows before its value of lead, of which there is a count for each, and its place among those that share it, so that no task holds all rows."""
    rows = df.withColumn("_lead", lead)
    ahead = Window.orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_lead").agg(F.count("*").alias("_n")).select("_lead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_lead").orderBy(*order))
    return rows.join(before, "_lead").withColumn("position", (F.col("_before") + place).cast("int")).drop("_lead", "_before")


def symbol_by_id(symbols: DataFrame, project: str, symbol: str) -> DataFrame:
    return symbols.filter((F.col("project_id") == project) & (F.col("id") == symbol))


def match_rank(text: str) -> Column:
    """0 qualified name equals, 1 name equals, 2 name starts, 3 qualified name starts, 4 name contains, 5 qualified name contains, 6 key contains; else null. In lower case; the text is no pattern."""
    q, name, qualified, key = text.lower(), F.lower("name"), F.lower("qualified_name"), F.lower("symbol_key")
    tests = [qualified == q, name == q, name.startswith(q), qualified.startswith(q), name.contains(q), qualified.contains(q), key.contains(q)]
    return F.coalesce(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)])


def ranked_symbols(symbols: DataFrame, text: str) -> DataFrame:
    return symbols.withColumn("match_rank", match_rank(text)).filter("match_rank IS NOT NULL")


def search_symbols(symbols: DataFrame, project: str, text: str | None = None, kind: str | None = None, module: str | None = None, qualified_name: str | None = None, limit: int = 50) -> DataFrame:
    """Symbols that meet every criterion given, best match first; one criterion at least."""
    if limit < 1 or not any((text, kind, module, qualified_name)):
        raise ValueError("a search needs a criterion and a limit of at least 1")
    found = symbols.filter(F.col("project_id") == project)
    for column, value in (("kind", kind), ("module_id", module), ("qualified_name", qualified_name)):
        if value is not None:
            found = found.filter(F.col(column) == value)
    found = ranked_symbols(found, text) if text else found.withColumn("match_rank", F.lit(0))
    return positioned(found, ["match_rank", "external", "generated", F.asc_nulls_last("qualified_name"), "name", F.asc_nulls_last("signature"), "id"], limit)


def file_symbols(symbols: DataFrame, project: str, file: str, limit: int | None = 200) -> DataFrame:
    """Symbols declared in a file, or located there, in their order of appearance; without a limit all of them."""
    here = F.col("file_id") == file
    if "location_file_id" in symbols.columns:
        here = here | (F.col("location_file_id") == file)
    found, line = symbols.filter((F.col("project_id") == project) & here), F.coalesce("start_line", F.lit(2**31 - 1))
    order = [F.asc_nulls_last("start_column"), F.asc_nulls_last("qualified_name"), "name", "id"]
    return numbered(found, line, order) if limit is None else positioned(found, [line, *order], limit)


def is_definition(roles: str = "roles") -> Column:
    return F.arrays_overlap(F.col(roles), F.array(*[F.lit(r) for r in DEFINITION_ROLES]))


def usages(occurrences: DataFrame, project: str, symbol: str, limit: int = 200) -> DataFrame:
    """Resolved occurrences of a symbol that don't define it."""
    found = occurrences.filter((F.col("project_id") == project) & (F.col("symbol_id") == symbol) & ~is_definition())
    return positioned(found, ["file_id", "start_line", "start_column", "id"], limit)


def relationships(rows: DataFrame, project: str, anchor: str, direction: str = "ANY", kinds: list[str] | None = None, resolution: str | None = None, nature: str | None = None, limit: int = 200, by_target: DataFrame | None = None) -> DataFrame:
    """Relationships of an anchor. Filters come before the limit; with ANY, outgoing rows come first, and a loop is outgoing.

    by_target: the same rows as a table in the order of their targets. With it each direction reads the table whose row groups its anchor's rows lie in."""
    out, into = F.col("source_id") == anchor, F.col("target_id") == anchor
    if by_target is None:
        found = rows.filter({"OUT": out, "IN": into, "ANY": out | into}[direction])
    else:
        found = by_target.filter(into) if direction == "IN" else rows.filter(out)
        if direction == "ANY":
            found = found.unionByName(by_target.filter(into & ~out))
    found = found.filter(F.col("project_id") == project)
    for column, value in (("resolution_status", resolution), ("nature", nature)):
        if value is not None:
            found = found.filter(F.col(column) == value)
    if kinds:
        found = found.filter(F.col("kind").isin(kinds))
    found = found.withColumn("direction_rank", F.when(out, 0).otherwise(1) if direction == "ANY" else F.lit(0))
    return positioned(found, relation_order(), limit)


def relation_order() -> list:
    """The order of an anchor's relationships: direction_rank, kind, resolved targets first, ends, place, id."""
    return [
        "direction_rank", ordinal("kind", RELATIONSHIP_KINDS), F.col("target_id").isNull(), ordinal("source_type", ENTITY_TYPES), "source_id", F.asc_nulls_last(ordinal("target_type", ENTITY_TYPES)),
        F.asc_nulls_last("target_id"), F.asc_nulls_last("unresolved_target"), F.asc_nulls_last("file_id"), F.asc_nulls_last("start_line"), "id",
    ]


def around(rows: DataFrame, project: str, anchors: list[str], each: int, by_target: DataFrame | None = None) -> DataFrame:
    """The first relationships in either direction of every anchor (node), each of them at most, in one pass over rows: a rank filter, which is cut in each task before the shuffle."""
    out = rows.filter(F.col("source_id").isin(anchors)).withColumns({"node": F.col("source_id"), "direction_rank": F.lit(0)})
    into = (rows if by_target is None else by_target).filter(F.col("target_id").isin(anchors) & (F.col("source_id") != F.col("target_id"))).withColumns({"node": F.col("target_id"), "direction_rank": F.lit(1)})
    both = out.unionByName(into).filter(F.col("project_id") == project)
    return both.withColumn("position", F.row_number().over(Window.partitionBy("node").orderBy(*relation_order())).cast("int")).filter(F.col("position") <= each)


#: Named relationship questions: direction and kinds.
PRESETS = {
    "implementations": ("IN", ["IMPLEMENTS"]), "callers": ("IN", ["CALLS"]), "callees": ("OUT", ["CALLS"]), "dependencies": ("OUT", ["DEPENDS_ON"]), "dependents": ("IN", ["DEPENDS_ON"]), "related_tests": ("IN", ["RELATED_TEST"]),
}


def preset(name: str, rows: DataFrame, project: str, anchor: str, limit: int = 200, by_target: DataFrame | None = None) -> DataFrame:
    direction, kinds = PRESETS[name]
    return relationships(rows, project, anchor, direction, kinds, limit=limit, by_target=by_target)


def is_test_path(path: Column | str) -> Column:
    """A path below a test folder, or of a file named *.test.x or *.spec.x; in lower case, with either slash."""
    p = F.concat(F.lit("/"), F.lower(F.replace(F.col(path) if isinstance(path, str) else path, F.lit("\\"), F.lit("/"))))
    return p.contains("/src/test/") | p.contains("/test/") | p.contains("/tests/") | p.contains("/__tests__/") | p.rlike(r"\.(test|spec)\.[^/.]+$")
