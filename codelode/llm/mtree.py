"""Exact top-k inner-product search with M-trees: paged metric nodes searched best first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, small_batches, stored, table

#: Vectors of a leaf page, routing entries of an inner page, vectors and bytes of one tree, queries that go down a tree together, and that one copy of a tree's pages serves.
LEAF, FANOUT, TREE_ROWS, TREE_BYTES, BATCH, SERVED = 1024, 16, 16_384, 8 << 20, 128, 65_536
#: Vectors from which the pivots of clusters are taken, and pivots of vectors of one length at most.
SAMPLE, CLUSTERS = 4096, 64
SCALE, TOP, EVERY = 64, 20, 20
#: Largest whole number up to which doubles are exact, the range of a long, and the share by which bounds are widened against rounding.
EXACT, LOW, HIGH, SLACK = 2**53, -(2**63), 2**63 - 1, 1e-9


@dataclass(slots=True)
class Page:
    """A node: its entries (vectors of a leaf, pivots of an inner page) with their numbers (ids, or pages), covering radii, distances to the page's own pivot, and squared lengths."""

    leaf: bool
    numbers: np.ndarray
    entries: np.ndarray
    radii: np.ndarray
    to_parent: np.ndarray
    norms: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        self.norms = squares(self.entries)


def squares(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (x * x).sum(1)


def distances(x: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """From each row of x to the pivot; infinite where doubles can't tell."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(np.sqrt(((x - pivot) ** 2).sum(1)), nan=np.inf, posinf=np.inf)


def spread(vectors: np.ndarray, most: int, rng: np.random.Generator) -> np.ndarray:
    """Up to most pivots, each the farthest from those before it."""
    chosen = [int(rng.integers(len(vectors)))]
    nearest = distances(vectors, vectors[chosen[0]])
    while len(chosen) < most and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(vectors, vectors[chosen[-1]]))
    return vectors[chosen]


def nearest_of(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        gaps = squares(vectors)[:, None] - 2 * vectors @ pivots.T + squares(pivots)
    return np.nan_to_num(gaps, nan=np.inf, posinf=np.inf).argmin(1)


def build(ids: np.ndarray, vectors: np.ndarray, pivot: np.ndarray, seed: int = 3) -> list[Page]:
    """The pages of a tree over vectors, page 0 its root around the pivot.

    Inner pages spread their routing pivots by farthest-first choice from a sample and give each vector to the nearest; vectors that can't
    be told apart are cut evenly."""
    pages: list[Page] = []

    def add(own: np.ndarray, pivot: np.ndarray, seed: int) -> int:
        number, some = len(pages), vectors[own]
        if len(own) <= LEAF:
            pages.append(Page(True, ids[own], some, np.zeros(len(own)), distances(some, pivot)))
            return number
        pages.append(None)
        rng = np.random.default_rng(seed + len(own))
        pivots = spread(some[rng.choice(len(own), min(len(own), 32 * FANOUT), replace=False)], FANOUT, rng)
        owner = nearest_of(some, pivots) if len(pivots) > 1 else np.zeros(len(own), np.int64)
        if (owner == owner[0]).all():
            owner = np.arange(len(own)) * FANOUT // len(own)
            pivots = np.repeat(pivots[:1], FANOUT, 0)
        children, kept, radii = [], [], []
        for k in range(len(pivots)):
            part = np.flatnonzero(owner == k)
            if len(part):
                kept.append(pivots[k])
                radii.append(distances(some[part], pivots[k]).max())
                children.append(add(own[part], pivots[k], seed + k + 1))
        pages[number] = Page(False, np.array(children, np.int64), np.array(kept), np.array(radii), distances(np.array(kept), pivot))
        return number

    add(np.arange(len(ids)), pivot, seed)
    return pages


def whole_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of the vectors v with one query, held to the range of a long. Components are whole numbers."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(len(q), 1) < EXACT:
        return (v @ q).astype(np.int64)
    whole = [int(x) for x in q]
    return np.array([min(max(sum(a * int(b) for a, b in zip(whole, row, strict=True)), LOW), HIGH) for row in v.tolist()], np.int64)


def below(score: int) -> float:
    """The greatest double that isn't above a score."""
    near = float(score)
    return near if near <= score else float(np.nextafter(near, -np.inf))


def possible(bounds: np.ndarray) -> np.ndarray:
    """Upper bounds of scores held to a long's least value; infinite where doubles can't tell."""
    return np.maximum(np.nan_to_num(bounds, nan=np.inf, posinf=np.inf, neginf=LOW), LOW)


def search(pages: list[Page], pivot: np.ndarray, queries: np.ndarray, own: np.ndarray, top: int, given: np.ndarray | None = None) -> tuple[list[list[tuple[int, int]]], int]:
    """For each query the top (score, id) of a tree but for its own id, ties to smaller ids, if they reach the score given (that of its top already found elsewhere); and how many inner products were computed.

    Queries go down together, best page first; a page is opened for those of them that it may still serve. Over a page with pivot p and
    radius r no inner product exceeds q.p + |q| r. Where q's distance to the parent's pivot is known, the stored distance of p to it bounds
    q.p without computing it: |q - p| >= | |q - parent| - |p - parent| |. What doubles can't tell counts as possible."""
    norms = squares(queries)
    lengths = np.sqrt(norms)
    least = np.full(len(queries), -np.inf) if given is None else given.astype(np.float64)
    best: list[list[tuple[int, int]]] = [[] for _ in queries]  # ascending (score, -id)
    count = computed = 0
    open_: list[tuple] = [(-np.inf, 0, 0, np.arange(len(queries)), np.full(len(queries), np.inf), distances(queries, pivot))]
    with np.errstate(over="ignore", invalid="ignore"):
        while open_:
            _, _, number, who, reach, away = heapq.heappop(open_)
            live = reach >= least[who]
            who, away, page = who[live], away[live], pages[number]
            if not len(who):
                continue
            if page.leaf:
                # what any of these queries could reach at each entry, from the range of their distances to the page's pivot
                gap = np.nan_to_num(np.maximum(np.maximum(away.min() - page.to_parent, page.to_parent - away.max()), 0), nan=0.0, posinf=0.0)
                size = float(norms[who].max())
                limit = possible((size + page.norms - gap**2) / 2 + SLACK * (size + page.norms) + 1e-6)
                maybe = np.flatnonzero(limit >= least[who].min())
                computed += len(maybe) * len(who)
                whole = len(maybe) == len(page.numbers)
                ids, vectors, asked = (page.numbers if whole else page.numbers[maybe]), (page.entries if whole else page.entries[maybe]), queries[who]
                exact = float(np.abs(asked).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(queries.shape[1], 1) < EXACT
                close = asked @ vectors.T if exact else np.minimum(possible(asked @ vectors.T), float(HIGH))
                room = np.zeros(len(who)) if exact else possible(2 * SLACK * lengths[who] * np.sqrt(page.norms.max(initial=0)) + 1e-6)
                hit = (close >= (least[who] - room)[:, None]).any(1)
                for k in np.flatnonzero(hit).tolist():
                    q, line = int(who[k]), close[k]
                    at = np.flatnonzero((line >= least[q] - room[k]) & (ids != own[q]))
                    if len(at) > top:
                        at = at[line[at] >= np.partition(line[at], -top)[-top] - 2 * room[k]]
                    if len(at):
                        scores = line[at].astype(np.int64) if exact else whole_products(queries[q], vectors[at])
                        best[q] = sorted(best[q] + list(zip(scores.tolist(), (-ids[at]).tolist(), strict=True)))[-top:]
                        if len(best[q]) == top:
                            least[q] = max(least[q], below(best[q][0][0]))
                continue
            slack = SLACK * lengths[who, None] * (np.sqrt(page.norms) + page.radii) + SLACK * (norms[who, None] + page.norms) + 1e-6
            limit = possible((norms[who, None] + page.norms - (away[:, None] - page.to_parent) ** 2) / 2 + slack)
            inner = queries[who] @ page.entries.T
            computed += inner.size
            reaches = possible(np.minimum(possible(inner + slack), limit) + lengths[who, None] * page.radii + slack)
            gaps = np.nan_to_num(np.sqrt(np.maximum(norms[who, None] + page.norms - 2 * inner, 0)), nan=np.inf, posinf=np.inf)
            for i, child in enumerate(page.numbers.tolist()):
                some = reaches[:, i] >= least[who]
                if some.any():
                    count += 1
                    heapq.heappush(open_, (-float(reaches[some, i].max()), count, child, who[some], reaches[some, i], gaps[some, i]))
    floor = np.full(len(queries), -np.inf) if given is None else given.astype(np.float64)
    return [[(score, -other) for score, other in reversed(rows) if score >= f] for rows, f in zip(best, floor, strict=True)], computed


def whole_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """_id and _v, floor(SCALE * x) as doubles, of the rows that take part: those with an id and a vector of finite components, one at least (a vector without any has no products)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    doubles = F.transform(vector, lambda x: x.cast("double"))
    kept = df.select(F.col(key).cast("bigint").alias("_id"), doubles.alias("_v")).filter(F.col("_id").isNotNull() & (F.size("_v") > 0)).filter(F.forall("_v", finite))
    # 64 x may be beyond doubles, and is whole already where it is large
    return kept.withColumn("_v", F.transform("_v", lambda x: F.when(F.abs(x) < 2.0**46, F.floor(x * SCALE).cast("double")).otherwise(F.greatest(F.lit(-1.7e308), F.least(F.lit(1.7e308), x * SCALE)))))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


class Clusters:
    """Pivots by the length of vectors. A length that the sample lacked has one cluster around zero."""

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots = pivots

    def of(self, dim: int) -> np.ndarray:
        return self.pivots.get(dim, np.zeros((1, dim)))


def _by_length(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """The batches' rows, those of equal vector lengths together."""
    for batch in batches:
        lengths = batch.column(name).value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths).tolist():
            part = batch if (lengths == dim).all() else batch.filter(pa.array(lengths == dim))
            yield part, dim, _matrix(part.column(name))


PAGES = "_tree int, _page int, leaf boolean, dim int, numbers binary, entries binary, radii binary, to_parent binary, pivot binary"


def _pages(groups: pa.Table) -> pa.Table:
    """A tree's vectors as its pages."""
    rows = groups.combine_chunks()
    vectors = _matrix(rows.column("_v").combine_chunks())
    order = np.argsort(rows.column("_id").to_numpy(), kind="stable")
    ids, vectors = rows.column("_id").to_numpy()[order], vectors[order]
    with np.errstate(over="ignore"):
        pivot = np.nan_to_num(vectors.mean(axis=0), posinf=0, neginf=0)
    pages, tree, dim = build(ids, vectors, pivot), rows.column("_tree")[0].as_py(), vectors.shape[1]
    cells = [(tree, k, p.leaf, dim, p.numbers.astype(np.int64).tobytes(), p.entries.tobytes(), p.radii.tobytes(), p.to_parent.tobytes(), None if k else pivot.tobytes()) for k, p in enumerate(pages)]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), [pa.int32(), pa.int32(), pa.bool_(), pa.int32(), *[pa.binary()] * 5], strict=True)], names=[x.split()[0] for x in PAGES.split(", ")])


FOUND = "query_id long, _row long, vec_id long, score long"


def _search(pages: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """FOUND rows of queries (_tree, _row, _id, _q: the vector's bytes, _least) in the trees they ask.

    A tree's pages come to a task once for SERVED queries, ahead of them; the queries stream by in batches."""
    chunks = asked.groupBy("_tree").agg(F.ceil(F.count("*") / SERVED).cast("int").alias("_chunks"))
    left = pages.join(chunks, "_tree").select("*", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk")).drop("_chunks").withColumns({"_row": F.lit(None).cast("long"), "_id": F.lit(None).cast("long"), "_q": F.lit(None).cast("binary"), "_least": F.lit(None).cast("long")})
    right = asked.join(chunks, "_tree").withColumn("_chunk", F.pmod(F.xxhash64("_row"), F.col("_chunks")).cast("int")).drop("_chunks")
    both = left.unionByName(right, allowMissingColumns=True).repartition("_tree", "_chunk").sortWithinPartitions("_tree", "_chunk", F.col("_page").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, pivot = None, [], None
        doubles = lambda cell: np.frombuffer(cell.as_buffer(), np.float64)
        for batch in batches:
            keys = list(zip(batch.column("_tree").to_pylist(), batch.column("_chunk").to_pylist(), batch.column("_page").to_pylist(), strict=True))
            at = 0
            while at < len(keys):
                key, page = keys[at][:2], keys[at][2]
                if key != now:
                    now, tree = key, []
                if page is not None:
                    cell = lambda name, i=at: batch.column(name)[i]
                    entries = doubles(cell("entries")).reshape(-1, cell("dim").as_py())
                    tree.append(Page(cell("leaf").as_py(), np.frombuffer(cell("numbers").as_buffer(), np.int64), entries, doubles(cell("radii")), doubles(cell("to_parent"))))
                    if page == 0:
                        pivot = doubles(cell("pivot"))
                    at += 1
                    continue
                to = at
                while to < len(keys) and to - at < BATCH and keys[to] == keys[at]:
                    to += 1
                part = batch.slice(at, to - at)
                queries = np.array([doubles(x) for x in part.column("_q")])
                own = part.column("_id").to_numpy()
                given = np.array([-np.inf if x is None else below(x) for x in part.column("_least").to_pylist()])
                found, _ = search(tree, pivot, queries, own, top, given)
                rows = [(q, r, other, score) for q, r, some in zip(own.tolist(), part.column("_row").to_pylist(), found, strict=True) for score, other in some]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 4)], ["query_id", "_row", "vec_id", "score"])
                at = to

    small_batches(pages.sparkSession)
    return both.mapInArrow(lean(run), FOUND)


def top_inner(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, top: int = TOP, tree_rows: int = TREE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose key is divisible by every, the top other rows by inner product of floor(64 * x), ties to the smaller key.

    All vectors are indexed: those near one of a sample's pivots form a cluster, cut by hash into M-trees of about tree_rows (fewer where
    vectors are long), built once and written as pages. Each query first searches one tree, of the cluster that may hold its best; with the
    score of its top-th row there it then goes to the trees of those clusters that may still reach it. Pages of a tree are copied once for
    SERVED queries.

    Rows with a null key or vector, an empty vector, or a component that is null or isn't finite take no part; vectors of different lengths
    aren't compared; rows of a repeated key are never each other's partners, and as queries their lists are ranked together. Products are
    exact; those beyond a long count as its least or greatest value. An empty table gives no rows; other columns are left out."""
    spark = df.sparkSession
    small_batches(spark)
    rows = stored(whole_vectors(df, key, vector).withColumn("_row", F.xxhash64("_id", "_v")), "mtree-vectors")
    sample = rows.orderBy(F.xxhash64(F.lit(5), "_row"), "_row").limit(SAMPLE).select("_v").toArrow()
    rng, pivots = np.random.default_rng(7), {}
    for _, dim, vectors in _by_length(sample.to_batches(), "_v"):
        own = np.vstack([pivots[dim], vectors]) if dim in pivots else vectors
        pivots[dim] = own
    clusters = Clusters({dim: spread(v, max(1, min(CLUSTERS, len(v) // 32)), rng) for dim, v in pivots.items()})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, dim, vectors in _by_length(batches, "_v"):
            own = clusters.of(dim)
            nearest = nearest_of(vectors, own)
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_row"), part.column("_v"), pa.array([dim] * len(nearest), pa.int32()), pa.array(nearest, pa.int32()), pa.array(distances(vectors, own[nearest]), pa.float64())], ["_id", "_row", "_v", "_dim", "_cluster", "_away"])

    placed = stored(rows.mapInArrow(lean(assign), "_id long, _row long, _v array<double>, _dim int, _cluster int, _away double"), "mtree-clusters")
    # a row for each cluster and vector length
    stats = sorted(map(tuple, placed.groupBy("_dim", "_cluster").agg(F.count("*"), F.max("_away")).collect()))
    sizes, first, known = {}, 0, {}
    for dim, cluster, n, radius in stats:
        trees = -(-n // max(LEAF, min(tree_rows, TREE_BYTES // (8 * dim)))) if tree_rows >= LEAF else -(-n // tree_rows)
        sizes[dim, cluster] = (first, trees)
        known.setdefault(dim, []).append((cluster, radius * (1 + SLACK) + 1e-6, first, trees))
        first += trees
    if not stats:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    table_ = spark.createDataFrame([(d, c, f, t) for (d, c), (f, t) in sizes.items()], "_dim int, _cluster int, _first int, _trees int")
    tree = (F.col("_first") + F.pmod(F.xxhash64("_row", F.lit(5)), F.col("_trees"))).cast("int")
    planted = placed.join(F.broadcast(table_), ["_dim", "_cluster"]).select("_id", "_v", tree.alias("_tree"))
    pages = stored(planted.groupBy("_tree").applyInArrow(_pages, PAGES), "mtree-pages")

    def ask(begin: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The trees that each query asks: one of the cluster with the greatest bound to begin with, then all others that may reach _least."""
            for part, dim, vectors in _by_length(batches, "_v"):
                own = clusters.of(dim)
                with np.errstate(over="ignore", invalid="ignore"):
                    lengths = np.sqrt(squares(vectors))
                    bounds = np.array([vectors @ own[c] + lengths * r + SLACK * lengths * (np.sqrt((own[c] ** 2).sum()) + r) for c, r, _, _ in known[dim]]).T
                bounds, out = possible(bounds), []
                ids, marks = part.column("_id").to_pylist(), part.column("_row").to_pylist()
                leasts = [None] * len(ids) if begin else part.column("_least").to_pylist()
                for k, (i, mark, least) in enumerate(zip(ids, marks, leasts, strict=True)):
                    best = int(bounds[k].argmax())
                    seen = known[dim][best][2] + mark % known[dim][best][3]
                    if begin:
                        asked = [seen]
                    else:
                        asked = [t for (_, _, f, n), b in zip(known[dim], bounds[k], strict=True) if least is None or b >= below(least) for t in range(f, f + n) if t != seen]
                    out += [(t, mark, i, k, least) for t in asked]
                    if len(out) >= 4096 or k == len(ids) - 1:
                        t, m, i_, v, low = zip(*out, strict=True) if out else [()] * 5
                        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(m, pa.int64()), pa.array(i_, pa.int64()), pa.array([vectors[x].tobytes() for x in v], pa.binary()), pa.array(low, pa.int64())], ["_tree", "_row", "_id", "_q", "_least"])
                        out = []

        return lean(run)

    asked = "_tree int, _row long, _id long, _q binary, _least long"
    queries = placed.filter(F.col("_id") % every == 0).select("_id", "_row", "_v")
    begun = stored(_search(pages, queries.mapInArrow(ask(True), asked), top), "mtree-begun")
    own = Window.partitionBy("query_id", "_row").orderBy(F.desc("score"), "vec_id")
    least = begun.withColumn("k", F.row_number().over(own)).filter(F.col("k") == top).select(F.col("query_id").alias("_id"), "_row", F.col("score").alias("_least"))
    rest = queries.join(least, ["_id", "_row"], "left").select("_id", "_row", "_v", "_least")
    found = begun.unionByName(_search(pages, rest.mapInArrow(ask(False), asked), top))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # with the filter, tasks pass on their first rows of a query only
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op10(spark, sf_dir: str) -> DataFrame:
    """The 20 best partners of every twentieth vector among all others; awkward rows as top_inner has them."""
    return top_inner(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
