"""Connected components of a graph given as edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, own_exchange, stored

#: Edges that one task connects or writes.
TASK_EDGES = 500_000


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a task's edges with the smallest one that they reach over these."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = list(up)
    for k in range(0, len(nodes), 1 << 16):
        some = nodes[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], ["node", "component"])


def components(edges: DataFrame, written: bool = False) -> DataFrame:
    """node, component (the smallest node it reaches), for every node of edges (a, b: bigint); nodes without an edge to another are left out. written: edges is a table.

    Up to TASK_EDGES edges one task connects them. More go through alternating large-star and small-star steps: each links neighbours to
    the smallest of them, so a chain of n nodes takes about log n rounds. Neighbour minima are pre-aggregated and joined back, so a node
    with very many edges is no task of its own. Rounds are written to the shared folder; only a count and a checksum come to the driver."""
    now = edges.filter("a <> b") if written else stored(edges.filter("a <> b").select("a", "b"), "edges")
    sign = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
    last = sign(now)
    if last[0] <= TASK_EDGES:
        return stored(now.repartition(1).mapInArrow(lean(_connect), "node long, component long"), "components", tasks=1)
    now = stored(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while last[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(own_exchange(least, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(own_exchange(low, "a"), "a").select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b")).union(low.select("a", "m")).distinct()
        now = stored(small, "edges", tasks=1 + last[0] // TASK_EDGES)
        if (this := sign(now)) == last:
            break
        last = this
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct()).distinct()
