"""Contexts of symbols: relations around them, usages and source under a token budget, for any number of roots at once.

What a root could show is found by joins, a level of relations at a time, each bounded for a node or symbol; what the budget lets through is
a fold over each query's few roots, in an expression on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate, truncated
from ..store import stored
from . import lookup

RESPONSE_TOKENS, SYMBOL_TOKENS, RELATION_TOKENS, USAGE_TOKENS = 24, 32, 36, 20
MAX_DEPTH, MAX_PER_NODE, MAX_ROOTS = 3, 50, 200
#: Nodes that are broadcast to the relations; more are joined.
MAX_BROADCAST = 100_000
_NEVER = (1 << 31) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _cost(base: int, df: DataFrame, *names: str) -> Column:
    return sum((token_estimate(n) for n in names if n in df.columns), F.lit(base)).cast("int")


def around(relations: DataFrame, nodes: DataFrame, each: int, by_target: DataFrame | None = None) -> DataFrame:
    """The first relations in either direction of every node (column node, distinct), each of them at most: position numbers them. The rank filter is cut in each task before the shuffle, so a node of very many relations is no task of its own."""
    out = relations.join(nodes, F.col("source_id") == F.col("node")).withColumn("direction_rank", F.lit(0))
    into = (relations if by_target is None else by_target).join(nodes, F.col("target_id") == F.col("node")).filter("source_id <> target_id").withColumn("direction_rank", F.lit(1))
    ranked = out.unionByName(into).withColumn("position", F.row_number().over(Window.partitionBy("node").orderBy(*lookup.relation_order())).cast("int"))
    return ranked.filter(F.col("position") <= each)


def _price(relations: DataFrame) -> Column:
    return _cost(RELATION_TOKENS, relations, "id", "source_id", "target_id", "unresolved_target", "kind", "nature")


def _ends(rows: DataFrame) -> DataFrame:
    """Of relations with their node and direction_rank what their order and a walk need, the price beforehand: the rest isn't shuffled."""
    return rows.select("node", "direction_rank", "id", "kind", "source_type", "source_id", "target_type", "target_id", "unresolved_target", "file_id", "start_line", _price(rows).alias("price"))


def _kept(rows: DataFrame) -> DataFrame:
    out = F.col("direction_rank") == 0
    return rows.select("node", "position", "id", "kind", F.when(out, F.col("target_id")).otherwise(F.col("source_id")).alias("other"), F.when(out, "OUTGOING").otherwise("INCOMING").alias("direction"), "price")


def outgoing(relations: DataFrame, each: int) -> DataFrame:
    """The first outgoing relations of every node, each of them at most, as walks keep them: one pass over the relations, written once."""
    rank = F.row_number().over(Window.partitionBy("node").orderBy(*lookup.relation_order())).cast("int")
    rows = _ends(relations.withColumns({"node": F.col("source_id"), "direction_rank": F.lit(0)}).filter("node IS NOT NULL"))
    return stored(_kept(rows.withColumn("position", rank).filter(F.col("position") <= each)), "context-outgoing")


def around_all(relations: DataFrame, first: DataFrame, nodes: DataFrame, each: int) -> DataFrame:
    """around() for nodes that may be most of all, as walks keep it, from the first outgoing relations of every node (see outgoing).

    Outgoing relations come first, so incoming ones are asked for only by nodes that have fewer than each of those; where there is none, the relations aren't read again."""
    have = first.groupBy("node").agg(F.count("*").cast("int").alias("ahead"))
    short = stored(nodes.join(have, "node", "left").select("node", F.coalesce("ahead", F.lit(0)).alias("ahead")).filter(F.col("ahead") < each), "context-short")
    near = first.join(nodes, "node", "left_semi")
    n = short.count()
    if not n:
        return near
    into = relations.filter("source_id <> target_id").withColumns({"node": F.col("target_id"), "direction_rank": F.lit(1)})
    into = _ends(into).join(F.broadcast(short) if n <= MAX_BROADCAST else short, "node")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(*lookup.relation_order()))
    into = into.withColumn("k", rank).filter(F.col("k") <= each).withColumn("position", (F.col("ahead") + F.col("k")).cast("int")).filter(F.col("position") <= each)
    return near.unionByName(_kept(into))


def walks(relations: DataFrame, roots: DataFrame, depth: int, per_node: int, by_target: DataFrame | None = None, many: bool = False) -> DataFrame:
    """The relations around every root (column root, distinct), breadth first in either direction: the first per_node of each node, each relation once.

    root, steps (level, from_node, direction, id, kind, spent: tokens up to here) in order, and first_over: before which step (from 0) a
    node has more than per_node relations. A level is two joins with the relations and one written step for all roots together.

    many: roots are a good part of all nodes. Then relations are gone through once, for all nodes, and each level joins what is left."""
    if not 0 <= depth <= MAX_DEPTH or not 0 <= per_node <= MAX_PER_NODE:
        raise ValueError("depth up to 3, up to 50 relations a node")
    frontier = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("place"))
    seen, known, levels = frontier.select("root", "node"), None, []
    first_out = outgoing(relations, per_node + 1) if many and depth else None
    for level in range(1, depth + 1):
        nodes = frontier.select("node").distinct()
        if many:
            slim = around_all(relations, first_out, nodes, per_node + 1)
        else:
            near = around(relations, nodes, per_node + 1, by_target)
            slim = _kept(near.withColumn("price", _price(near)))
        met = frontier.join(slim, "node").withColumn("level", F.lit(level))
        if known is not None:
            met = met.join(known.withColumn("old", F.lit(True)), ["root", "id"], "left").filter(f"old IS NULL OR position > {per_node}").drop("old")
        first = F.row_number().over(Window.partitionBy("root", "id").orderBy(F.col("position") > per_node, "place", "position"))
        met = stored(met.withColumn("nth", first).filter(f"nth = 1 OR position > {per_node}").drop("nth"), "context-level")
        levels.append(met)
        if level < depth:
            taken = met.filter(F.col("position") <= per_node)
            known = taken.select("root", "id") if known is None else known.union(taken.select("root", "id"))
            fresh = taken.filter("other IS NOT NULL").groupBy("root", F.col("other").alias("node")).agg(F.min(F.struct("place", "position")).alias("at"))
            fresh = fresh.join(seen, ["root", "node"], "left_anti")
            frontier = stored(fresh.select("root", "node", (F.row_number().over(Window.partitionBy("root").orderBy("at")) - 1).alias("place")), "context-frontier")
            seen = seen.union(frontier.select("root", "node"))
    if not levels:
        return roots.select("root", F.expr("CAST(array() AS array<struct<level: int, from_node: string, direction: string, id: string, kind: string, spent: int>>)").alias("steps"), F.lit(_NEVER).alias("first_over"))
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("root").orderBy("level", "place", "position")
    kept = every.filter(F.col("position") <= per_node).withColumns({"spent": F.sum("price").over(order).cast("int"), "n": F.row_number().over(order)})
    over = every.filter(F.col("position") > per_node).groupBy("root").agg(F.min(F.struct("level", "place")).alias("over"))
    steps = kept.join(over, "root", "left").groupBy("root").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "level", F.col("node").alias("from_node"), "direction", "id", "kind", "spent"))), lambda x: F.struct(*[x[c].alias(c) for c in ("level", "from_node", "direction", "id", "kind", "spent")])).alias("steps"),
        F.coalesce(F.when(F.max("over").isNotNull(), F.count_if(F.struct("level", "place") < F.col("over"))), F.lit(_NEVER)).cast("int").alias("first_over"),
    )
    return roots.join(steps, "root", "left").select("root", F.coalesce("steps", F.expr("CAST(array() AS array<struct<level: int, from_node: string, direction: string, id: string, kind: string, spent: int>>)")).alias("steps"), F.coalesce("first_over", F.lit(_NEVER)).alias("first_over"))


def uses(occurrences: DataFrame, roots: DataFrame, each: int) -> DataFrame:
    """root, uses (id, spent) of each root's first usages, each at most, and whether it has more."""
    found = occurrences.filter(~lookup.is_definition()).join(roots, F.col("symbol_id") == F.col("root"), "left_semi").withColumn("root", F.col("symbol_id"))
    found = found.withColumn("k", F.row_number().over(Window.partitionBy("root").orderBy("file_id", "start_line", "start_column", "id"))).filter(F.col("k") <= each + 1)
    price = _cost(USAGE_TOKENS, found, "id", "symbol_id", "file_id") + token_estimate(F.concat(F.lit("["), F.array_join("roles", ", "), F.lit("]")))
    spent = F.sum(price).over(Window.partitionBy("root").orderBy("k")).cast("int")
    return found.select("root", "k", "id", spent.alias("spent")).groupBy("root").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= each, F.struct("k", "id", "spent")))), lambda x: F.struct(x["id"].alias("id"), x["spent"].alias("spent"))).alias("uses"), (F.max("k") > each).alias("more_uses")
    )


def contexts(roots: DataFrame, occurrences: DataFrame, relations: DataFrame, limit: int = 5, depth: int = 1, per_node: int = 10, usages: int = 5, max_tokens: int = 4096, excerpts: DataFrame | None = None, by_target: DataFrame | None = None, many: bool = False) -> DataFrame:
    """The contexts of every query: query, position, symbol_id, relations, usages, source, tokens, truncated; of those that the budget reaches.

    roots: query, position (from 1) and a symbol's columns (id and more); those beyond limit only count as cut. Each root has its own price,
    then relations, then usages, as long as the query's budget lasts, then what it still allows of its excerpt (excerpts: root, source). The
    first root that does not fit ends its query, as does one that spends the rest. response_truncated says so of the whole query. many: see walks."""
    if not 256 <= max_tokens <= 32_768 or not 1 <= limit <= MAX_ROOTS:
        raise ValueError("256 to 32768 tokens, 1 to 200 roots")
    price = _cost(SYMBOL_TOKENS, roots, "id", "symbol_key", "module_id", "file_id", "name", "qualified_name", "signature", "language")
    asked = roots.filter(F.col("position") <= limit + 1).select("query", "position", F.col("id").alias("root"), price.alias("price"))
    asked = stored(asked, "context-roots") if many else asked
    distinct = asked.filter(F.col("position") <= limit).select("root").distinct()
    whole = asked.join(walks(relations, distinct, depth, per_node, by_target, many), "root", "left")
    found = uses(occurrences, distinct, usages) if usages else distinct.select("root", F.expr("CAST(array() AS array<struct<id: string, spent: int>>)").alias("uses"), F.lit(False).alias("more_uses"))
    whole = whole.join(found, "root", "left")
    whole = whole.join(excerpts.select("root", "source"), "root", "left") if excerpts is not None else whole.withColumn("source", F.lit(None).cast("string"))
    item = F.struct("position", "root", "price", F.coalesce(F.transform("steps", lambda x: x["spent"]), F.array().cast("array<int>")).alias("spent"), "first_over", F.coalesce(F.transform("uses", lambda x: x["spent"]), F.array().cast("array<int>")).alias("use_spent"), F.coalesce("more_uses", F.lit(False)).alias("more_uses"), token_estimate("source").alias("source_tokens"), F.col("source").isNotNull().alias("has_source"), "steps", "uses", "source")
    grouped = whole.groupBy("query").agg(F.array_sort(F.collect_list(item)).alias("items"))
    asked_for = F.filter("items", lambda x: x["position"] <= limit)
    walking, integer = depth > 0 and per_node > 0, lambda c: c.cast("int")
    upto = lambda sums, n: F.when(n > 0, F.element_at(sums, n)).otherwise(F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        room = F.lit(max_tokens) - acc["used"] - x["price"]

        def with_relations(taken: Column) -> Column:
            cut = F.when(room > 0, (taken < F.size(x["spent"])) | (x["first_over"] <= taken)).otherwise(F.lit(True)) if walking else F.lit(False)
            return _let(room - upto(x["spent"], taken), lambda left: _let(F.size(F.filter(x["use_spent"], lambda s: s <= left)), lambda n: with_usages(taken, cut, left, n)))

        def with_usages(taken: Column, cut: Column, left: Column, n: Column) -> Column:
            rest = left - upto(x["use_spent"], n)
            shown = F.when(x["has_source"], F.greatest(F.lit(0), F.least(x["source_tokens"], rest))).otherwise(F.lit(0))
            short = cut | (n < F.size(x["use_spent"])) | x["more_uses"] | (x["has_source"] & (x["source_tokens"] > rest))
            used = F.lit(max_tokens) - rest + shown
            one = F.struct(integer(taken).alias("taken"), integer(n).alias("n"), integer(shown).alias("shown"), integer(used - acc["used"]).alias("tokens"), F.coalesce(short, F.lit(False)).alias("truncated"))
            return F.struct(integer(used).alias("used"), (used >= max_tokens).alias("stopped"), F.concat(acc["out"], F.array(one)).alias("out"))

        stop = F.struct(acc["used"].alias("used"), F.lit(True).alias("stopped"), acc["out"].alias("out"))
        go = _let(F.when(F.lit(walking) & (room > 0), F.size(F.filter(x["spent"], lambda s: s <= room))).otherwise(F.lit(0)), with_relations)
        return F.when(acc["stopped"] | (room < 0), stop).otherwise(go)

    start = F.expr(f"CAST(named_struct('used', {RESPONSE_TOKENS}, 'stopped', false, 'out', array()) AS struct<used: int, stopped: boolean, out: array<struct<taken: int, n: int, shown: int, tokens: int, truncated: boolean>>>)")
    folded = grouped.withColumn("asked", asked_for).withColumn("fold", F.aggregate("asked", start, step))
    cut = (F.size("items") > F.size("asked")) | (F.size("fold.out") < F.size("asked")) | F.exists("fold.out", lambda x: x["truncated"])
    each = folded.select("query", "asked", cut.alias("response_truncated"), F.posexplode("fold.out").alias("i", "o")).withColumn("r", F.element_at("asked", F.col("i") + 1))
    steps = F.slice("r.steps", F.lit(1), F.col("o.taken"))
    return each.select("query", F.col("r.position").alias("position"), F.col("r.root").alias("symbol_id"), steps.alias("relations"), F.coalesce(F.transform(F.slice("r.uses", F.lit(1), F.col("o.n")), lambda u: u["id"]), F.array().cast("array<string>")).alias("usages"), truncated("r.source", F.col("o.shown")).alias("source"), F.col("o.tokens").alias("tokens"), F.col("o.truncated").alias("truncated"), "response_truncated")


def search(symbols: DataFrame, occurrences: DataFrame, relations: DataFrame, project: str, text: str | None = None, qualified_name: str | None = None, limit: int = 5, **options) -> DataFrame:
    """The contexts of the symbols that match, best first, under one budget."""
    roots = lookup.search_symbols(symbols, project, text, qualified_name=qualified_name, limit=limit + 1).withColumn("query", F.lit(1))
    return contexts(roots, occurrences, relations, limit, **options)


def symbol_contexts(symbols: DataFrame, occurrences: DataFrame, relations: DataFrame, **options) -> DataFrame:
    """The context of each symbol, whose id is its query, under a budget of its own. No symbols give no contexts."""
    return contexts(symbols.withColumns({"query": F.col("id"), "position": F.lit(1)}), occurrences, relations, 1, **options)
