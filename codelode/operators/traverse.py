"""Bounded, deterministic traversals: one DataFrame step a level, each written before the next.

Orders are those of the paths of edge ids: within a level, breadth-first order is the order of these paths, so no global numbering is
needed to say which path came first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import EDGE_KINDS, FLOW_KINDS, NATURES, PROPAGATING_KINDS, ordinal
from ..store import stored

SEP = "\u0001"
#: What facts of each edge kind make a graph able to answer.
CAPABILITY_OF = dict(zip(EDGE_KINDS, ["CALL_GRAPH", "CONTROL_FLOW_GRAPH", "LOCAL_DATA_FLOW", "LOCAL_DATA_FLOW", "INTERPROCEDURAL_FLOW", "INTERPROCEDURAL_FLOW", "TAINT_ANALYSIS"], strict=True))
MAX_DEPTH, MAX_RESULTS = 32, 10_000


def _bounded(depth: int, results: int, most: int = MAX_RESULTS) -> None:
    if not 1 <= depth <= MAX_DEPTH or not 1 <= results <= most:
        raise ValueError(f"depth is 1 to {MAX_DEPTH}, results 1 to {most}")


def _propagating(rows: DataFrame) -> DataFrame:
    """Resolved relations of the propagating kinds, related tests heuristic, too."""
    kept = rows.filter(F.col("kind").isin(PROPAGATING_KINDS) & (F.col("source_type") == "SYMBOL") & (F.col("target_type") == "SYMBOL"))
    return kept.filter((F.col("resolution_status") == "RESOLVED") | ((F.col("kind") == "RELATED_TEST") & (F.col("resolution_status") == "HEURISTIC")))


def traversable(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges that impact follows: relations that propagate between symbols of the snapshot."""
    kept = _propagating(rows)
    ids = symbols.select("id")
    kept = kept.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return kept.select("id", "kind", "source_id", "target_id", F.coalesce("confidence", F.lit(1.0)).alias("edge_confidence"))


def entered(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges whose source impact may enter: no external and no generated symbol."""
    return edges.join(symbols.filter("NOT external AND NOT generated").select(F.col("id").alias("source_id")), "source_id", "left_semi")


#: A frontier of so many nodes at most is pushed into the scan of the edges; one of so many is broadcast; a larger one is joined.
PUSHED, BROADCAST = 200, 100_000


def _meet(frontier: DataFrame, nodes: list[str], more: bool, edges: DataFrame, key: str) -> DataFrame:
    """frontier joined with edges on key. nodes: the frontier's first PUSHED nodes; more: whether it has others."""
    if not more:
        return F.broadcast(frontier).join(edges.filter(F.col(key).isin(nodes)), key)
    return (F.broadcast(frontier) if frontier.count() <= BROADCAST else frontier).join(edges, key)


def _front(level: DataFrame, key: str) -> tuple[list[str], bool]:
    """The first PUSHED nodes of a written level, and whether it has more."""
    nodes = [r[0] for r in level.select(key).distinct().limit(PUSHED + 1).collect()]
    return nodes[:PUSHED], len(nodes) > PUSHED


def _longer() -> Column:
    """A path with one edge more."""
    return F.when(F.col("path") == "", F.col("id")).otherwise(F.concat_ws(SEP, "path", "id"))


def impact(symbols: DataFrame, rows: DataFrame, root: str, depth: int = 4, results: int = 200, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What a change of root may reach against the direction of relations, and the tests among it.

    impacts: symbol_id, depth, confidence (the least of its path), path; the shortest path, then the surest, then the first by ids.
    tests: the best way to each impacted test over a RELATED_TEST relation. External and generated symbols aren't entered. Depth leads the
    order, so a level's best is final and the loop is exact. edges: a written table of traversable edges that may be entered, if there is one.

    A level is one aggregation, written once: the best way to each symbol it finds, and the best over a RELATED_TEST relation."""
    _bounded(depth, results)
    spark = symbols.sparkSession
    if edges is None:
        edges = stored(entered(traversable(rows, symbols), symbols), "impact-edges")
    frontier = spark.range(1).select(F.lit(root).alias("symbol_id"), F.lit(1.0).alias("confidence"), F.lit("").alias("path"))
    nodes, more, levels = [root], False, []
    for level in range(1, depth + 1):
        step = _meet(frontier.withColumnRenamed("symbol_id", "target_id"), nodes, more, edges, "target_id").filter(F.col("source_id") != root)
        way = F.struct((-F.least("confidence", "edge_confidence")).alias("c"), _longer().alias("path"))
        found = step.groupBy(F.col("source_id").alias("symbol_id")).agg(F.min(way).alias("b"), F.min(F.when(F.col("kind") == "RELATED_TEST", way)).alias("t"))
        if levels:
            seen = levels[0].select("symbol_id")
            for before in levels[1:]:
                seen = seen.union(before.select("symbol_id"))
            found = found.join(seen.distinct().withColumn("known", F.lit(True)), "symbol_id", "left")
        else:
            found = found.withColumn("known", F.lit(None).cast("boolean"))
        levels.append(stored(found.withColumn("depth", F.lit(level)), "impact-level"))
        frontier = levels[-1].filter("known IS NULL").select("symbol_id", (-F.col("b.c")).alias("confidence"), F.col("b.path").alias("path"))
        nodes, more = _front(frontier, "symbol_id")
        if not nodes:
            break
    every = levels[0]
    for after in levels[1:]:
        every = every.unionByName(after)
    impacts = every.filter("known IS NULL").select("symbol_id", "depth", (-F.col("b.c")).alias("confidence"), F.col("b.path").alias("path")).orderBy("depth", F.desc("confidence"), "path", "symbol_id").limit(results)
    best = every.filter("t IS NOT NULL").groupBy("symbol_id").agg(F.min(F.struct("depth", "t.c", "t.path")).alias("b"))
    tests = best.select("symbol_id", F.col("b.depth").alias("depth"), (-F.col("b.c")).alias("confidence"), F.col("b.path").alias("path")).join(impacts.select("symbol_id"), "symbol_id", "left_semi")
    return impacts, tests


def impacted_tests(symbols: DataFrame, rows: DataFrame, root: str, depth: int = 4) -> DataFrame:
    """symbol_id of all tests that a change of root may reach: those of impact(), with no bound on its results.

    Nothing is asked of paths, so the ends of relations are written once, and a level looks up only what it finds among the symbols. These are
    merged, not broadcast: Spark takes them for as small as their compressed files."""
    _bounded(depth, 1)
    enter = symbols.filter("NOT external AND NOT generated").select(F.col("id").alias("symbol_id")).hint("merge")
    edges = stored(_propagating(rows).select("source_id", "target_id", (F.col("kind") == "RELATED_TEST").alias("test")), "impact-ends")
    frontier, levels, seen = symbols.filter(F.col("id") == root).select(F.col("id").alias("symbol_id")).distinct(), [], None
    nodes, more = [root], False
    for _ in range(depth):
        step = _meet(frontier.withColumnRenamed("symbol_id", "target_id"), nodes, more, edges, "target_id").filter(F.col("source_id") != root)
        # written before it meets the symbols: Spark would put that join below this one, on all edges
        found = stored(step.groupBy(F.col("source_id").alias("symbol_id")).agg(F.max("test").alias("test")), "impacted-found")
        levels.append(stored(found.join(enter, "symbol_id", "left_semi"), "impacted-level"))
        new = levels[-1].select("symbol_id")
        frontier = new if seen is None else stored(new.join(seen.hint("merge"), "symbol_id", "left_anti"), "impacted-front")
        seen = new if seen is None else seen.union(frontier)
        nodes, more = _front(frontier, "symbol_id")
        if not nodes:
            break
    every = levels[0]
    for after in levels[1:]:
        every = every.union(after)
    return every.filter("test").select("symbol_id").distinct()


def impact_limitations(symbols: DataFrame, rows: DataFrame) -> DataFrame:
    """The limitations that a snapshot puts on every impact, as flags."""
    ids = symbols.select(F.col("id").alias("known"))
    kept = rows.filter(F.col("kind").isin(PROPAGATING_KINDS))
    ends = kept.join(ids.withColumnRenamed("known", "s"), F.col("source_id") == F.col("s"), "left").join(ids.withColumnRenamed("known", "t"), F.col("target_id") == F.col("t"), "left")
    outside = F.col("target_id").isNotNull() & (F.col("s").isNull() | F.col("t").isNull() | (F.col("source_type") != "SYMBOL") | (F.col("target_type") != "SYMBOL"))
    return ends.agg(F.coalesce(F.bool_or(F.col("resolution_status") == "UNRESOLVED"), F.lit(False)).alias("unresolved_relationships_ignored"), F.coalesce(F.bool_or(outside), F.lit(False)).alias("external_targets_not_traversed"))


def program_graph(symbols: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the program graph that relations give: calls, and data flow of writes (forward) and reads (back), which is derived and at most 0.9 sure."""
    ids = symbols.select("id")
    kept = rows.filter((F.col("resolution_status") == "RESOLVED") & F.col("kind").isin("CALLS", "WRITES", "READS") & (F.col("target_type") == "SYMBOL"))
    kept = kept.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    call, read = F.col("kind") == "CALLS", F.col("kind") == "READS"
    node = lambda c: F.concat(F.lit("symbol:"), c)
    edges = kept.select(
        F.concat(F.when(call, "call:").when(read, "read-flow:").otherwise("write-flow:"), "id").alias("id"), node(F.when(read, F.col("target_id")).otherwise(F.col("source_id"))).alias("source_node_id"),
        node(F.when(read, F.col("source_id")).otherwise(F.col("target_id"))).alias("target_node_id"), F.when(call, "CALL").otherwise("DATA_FLOW").alias("kind"), F.when(call, F.col("nature")).otherwise("DERIVED").alias("nature"),
        F.when(call, F.col("confidence")).otherwise(F.least(F.lit(0.9), 0.9 * F.coalesce("confidence", F.lit(1.0)))).alias("confidence"),
    )
    ends = edges.select(F.explode(F.array("source_node_id", "target_node_id")).alias("id")).distinct()
    nodes = ends.join(symbols.select(node(F.col("id")).alias("id"), F.col("id").alias("symbol_id"), F.col("name").alias("label")), "id").withColumn("kind", F.lit("SYMBOL"))
    return nodes, edges


def _steps(edges: DataFrame, forward: Column | bool = True) -> DataFrame:
    """Edges as steps: node, next, id, edge_confidence and edge_nature. Those that aren't forward go from target to source."""
    ahead = F.lit(forward) if isinstance(forward, bool) else forward
    return edges.select(F.when(ahead, F.col("source_node_id")).otherwise(F.col("target_node_id")).alias("node"), F.when(ahead, F.col("target_node_id")).otherwise(F.col("source_node_id")).alias("next"), "id", F.coalesce("confidence", F.lit(1.0)).alias("edge_confidence"), ordinal("nature", NATURES).alias("edge_nature"))


def _nature() -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in NATURES]), F.col("nature") + 1)


def advanced_impact(nodes: DataFrame, edges: DataFrame, root: str, baseline: DataFrame, depth: int = 4, results: int = 200) -> DataFrame:
    """Symbols reached on the program graph beyond the baseline (symbol_id): calls backwards, other flows forwards, control flow not at all.

    Breadth first; the path that comes first stays, with its least confidence and worst nature."""
    _bounded(depth, results)
    steps = stored(_steps(edges.filter("kind <> 'CONTROL_FLOW'"), F.col("kind") != "CALL").repartitionByRange("node"), "advanced-steps")
    frontier = nodes.sparkSession.range(1).select(F.lit(f"symbol:{root}").alias("node"), F.lit("").alias("path"), F.lit(0).alias("depth"), F.lit(1.0).alias("confidence"), F.lit(0).alias("nature"))
    seen, front, more = frontier, [f"symbol:{root}"], False
    for level in range(1, depth + 1):
        moved = _meet(frontier, front, more, steps, "node")
        found = moved.select(F.col("next").alias("node"), _longer().alias("path"), F.lit(level).alias("depth"), F.least("confidence", "edge_confidence").alias("confidence"), F.greatest("nature", "edge_nature").alias("nature"))
        first = found.groupBy("node").agg(F.min(F.struct("path", "depth", "confidence", "nature")).alias("b")).select("node", "b.*")
        frontier = stored(first.join(seen.select("node"), "node", "left_anti"), "advanced-front")
        seen = seen.unionByName(frontier)
        front, more = _front(frontier, "node")
        if not front:
            break
    added = seen.filter("depth > 0").join(nodes.select(F.col("id").alias("node"), "symbol_id"), "node").join(baseline.select("symbol_id"), "symbol_id", "left_anti")
    return added.orderBy("depth", "path").limit(results).select("symbol_id", "depth", "confidence", _nature().alias("nature"), "path")


def flow_paths(edges: DataFrame, start: str, depth: int = 4, results: int = 200) -> DataFrame:
    """Every simple path from start over the flow kinds, breadth first by edge ids. An edge that closes a cycle ends its path, marked as such."""
    _bounded(depth, results)
    steps = stored(edges.filter(F.col("kind").isin(FLOW_KINDS)).select(F.col("source_node_id").alias("node"), F.col("target_node_id").alias("next"), "id").repartitionByRange("node"), "flow-steps")
    frontier = edges.sparkSession.range(1).select(F.lit(start).alias("node"), F.array(F.lit(start)).alias("nodes"), F.lit("").alias("path"))
    out, front, more = None, [start], False
    for level in range(1, depth + 1):
        moved = _meet(frontier, front, more, steps, "node")
        found = moved.select(F.col("next").alias("node"), F.array_append("nodes", F.col("next")).alias("nodes"), _longer().alias("path"), F.array_contains("nodes", F.col("next")).alias("cycle"), F.lit(level).alias("depth"))
        found = stored(found.orderBy("path").limit(results), "flow-level")  # what comes later in this level is cut off by the limit in any case
        out = found if out is None else out.unionByName(found)
        frontier = found.filter("NOT cycle").select("node", "nodes", "path")
        front, more = _front(frontier, "node")
        if not front:
            break
    return out.orderBy("depth", "path").limit(results)


def security_paths(nodes: DataFrame, edges: DataFrame, depth: int = 8, results: int = 200) -> DataFrame:
    """Paths from sources to sinks with the sanitizers on them. Sources by id, each breadth first; a state is a node with the sanitizers passed, entered once, after what it finds is reported; cycles are dropped.

    Once the first sources have results paths among them, later sources can't add any and are left."""
    _bounded(depth, results, 1000)
    kinds = nodes.select(F.col("id").alias("next"), F.col("kind").alias("next_kind"))
    steps = stored(_steps(edges.filter(F.col("kind").isin(FLOW_KINDS))).join(kinds, "next").repartitionByRange("node"), "security-steps")
    begin = nodes.filter("kind = 'SOURCE'")
    frontier = begin.select(F.col("id").alias("source"), F.col("id").alias("node"), F.array("id").alias("nodes"), F.lit("").alias("path"), F.lit("").alias("sanitizers"), F.lit(1.0).alias("confidence"), F.lit(0).alias("nature"))
    state = ["source", "node", "sanitizers"]
    front, more = _front(frontier, "node")
    seen, out = None, None
    for level in range(1, depth + 1):
        moved = _meet(frontier, front, more, steps, "node").filter(~F.array_contains("nodes", F.col("next")))
        clean = F.when(F.col("next_kind") == "SANITIZER", F.concat("sanitizers", F.lit("|"), "next")).otherwise(F.col("sanitizers"))
        found = moved.select("source", F.col("next").alias("node"), F.array_append("nodes", F.col("next")).alias("nodes"), _longer().alias("path"), clean.alias("sanitizers"), F.least("confidence", "edge_confidence").alias("confidence"), F.greatest("nature", "edge_nature").alias("nature"), "next_kind")
        found = found.withColumn("first", F.row_number().over(Window.partitionBy(*state).orderBy("path")) == 1)
        if seen is not None:
            found = found.join(seen.withColumn("known", F.lit(True)), state, "left").withColumn("first", F.col("first") & F.col("known").isNull()).drop("known")
        found = stored(found, "security-level")
        hits = found.filter("next_kind = 'SINK'").withColumn("depth", F.lit(level)).drop("next_kind", "nodes", "first")
        out = hits if out is None else out.unionByName(hits)
        enough, last = out.select("source").orderBy("source").limit(results).agg(F.count("*"), F.max("source")).first()
        frontier = found.filter("first").select("source", "node", "nodes", "path", "sanitizers", "confidence", "nature")
        if enough == results:
            frontier = frontier.filter(F.col("source") <= last)
        states = frontier.select(*state)
        seen = states if seen is None else seen.union(states)
        front, more = _front(frontier, "node")
        if not front:
            break
    return out.orderBy("source", "depth", "path").limit(results).select("source", F.col("node").alias("sink"), "depth", "path", "sanitizers", (F.col("sanitizers") != "").alias("sanitized"), "confidence", _nature().alias("nature"))


def induced_subgraph(nodes: DataFrame, edges: DataFrame, max_nodes: int, max_edges: int) -> tuple[DataFrame, DataFrame]:
    """The first nodes by id, and the first edges by id with both ends among them."""
    kept = nodes.orderBy("id").limit(max_nodes)
    ids = kept.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "source_node_id"), "source_node_id", "left_semi").join(ids.withColumnRenamed("id", "target_node_id"), "target_node_id", "left_semi")
    return kept, inside.orderBy("id").limit(max_edges)


def missing_capabilities(edges: DataFrame, declared: list[str]) -> DataFrame:
    """Edge kinds whose capability isn't declared, and declared ones without facts."""
    got = edges.select(F.element_at(F.create_map(*[F.lit(x) for pair in CAPABILITY_OF.items() for x in pair]), F.col("kind")).alias("capability")).distinct()
    want = edges.sparkSession.createDataFrame([(c,) for c in declared], "capability string")
    return got.subtract(want).select("capability", F.lit("UNDECLARED").alias("problem")).union(want.subtract(got).select("capability", F.lit("WITHOUT_FACTS")))


def compose(parts: list[DataFrame], key: str = "id") -> DataFrame:
    """The union of graph parts by id. Equal rows are one; rows that differ under one id are an error when the result is read."""
    columns = parts[0].columns
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    rows = both.groupBy(key).agg(F.min(F.struct(*[c for c in columns if c != key])).alias("a"), F.max(F.struct(*[c for c in columns if c != key])).alias("b"))
    same = F.when(F.col("a").eqNullSafe(F.col("b")), F.col("a")).otherwise(F.raise_error(F.concat(F.lit("conflicting rows under "), F.col(key))))
    return rows.select(key, same.alias("a")).select(key, "a.*").select(*columns)


def conflicts(parts: list[DataFrame], key: str = "id") -> DataFrame:
    """The keys under which parts have rows that differ, and how many different rows each has."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.distinct().groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1")


def assemble(fragments: list, providers: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and what is declared about them (what: CAPABILITY or LIMITATION, name) of fragments, None for a provider that is not at hand.

    Rows of one id must be equal. Capabilities are the fragments' own and those that edge kinds give; a provider without a fragment is a limitation."""
    there = [f for f in fragments if f is not None]
    nodes, edges = compose([f.nodes for f in there]), compose([f.edges for f in there])
    return nodes, edges, declarations(fragments, providers, edges)


def declarations(fragments: list, providers: list[str], edges: DataFrame) -> DataFrame:
    """What fragments declare (what, name), what the kinds of the composed edges give, and which providers are not at hand."""
    there = [f for f in fragments if f is not None]
    spark = edges.sparkSession
    declared = [("CAPABILITY", c) for f in there for c in f.capabilities] + [("LIMITATION", x) for f in there for x in f.limitations] + [("LIMITATION", f"{name.upper()}_UNAVAILABLE") for name, f in zip(providers, fragments, strict=True) if f is None]
    names = F.create_map(*[F.lit(x) for pair in CAPABILITY_OF.items() for x in pair])
    found = edges.select(F.lit("CAPABILITY").alias("what"), F.element_at(names, F.col("kind")).alias("name"))
    return found.unionByName(spark.createDataFrame(declared, "what string, name string")).distinct()


def edge_quality(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Precision and recall of edges (source_node_id, target_node_id, kind): both 1 if nothing is expected and nothing found; precision 0 if only nothing is found."""
    key = ["source_node_id", "target_node_id", "kind"]
    o, e = observed.select(*key).distinct(), expected.select(*key).distinct()
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = n(o, "observed").crossJoin(n(e, "expected")).crossJoin(n(o.intersect(e), "matched"))  # one row each
    precision = F.when((F.col("observed") == 0) & (F.col("expected") == 0), 1.0).when(F.col("observed") == 0, 0.0).otherwise(F.col("matched") / F.col("observed"))
    recall = F.when(F.col("expected") == 0, 1.0).otherwise(F.col("matched") / F.col("expected"))
    return one.select("observed", "expected", "matched", precision.alias("precision"), recall.alias("recall"))
