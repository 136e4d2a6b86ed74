"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import literal_rows, own_names, renamed, stored, table, with_names

#: Words of a block, and the most blocks of all sources together (more where there are more sources).
BLOCK_WORDS, MAX_BLOCKS = 4096, 131_072
#: So many blocks on either side of the one in which a source's target falls may make up for what its rows miss, and more where that block is long.
AROUND = 8
#: Sources are dealt over so many families; the driver knows the families' blocks only, and a task deals those of a family's sources.
FAMILIES = 1024
#: Tables of so many rows at most are broadcast to the documents, larger ones are joined.
BROADCAST = 200_000
#: Sources that one task numbers, and words' takes of a slice of a shard.
NUMBERED, SLICE_ROWS, MAX_SLICES = 100_000, 4096, 16_384
#: Smallest rows that are decided together where a fit still misses its words, and their words together.
DECIDED, DECIDED_WORDS = 64, 1 << 22
#: No document is taken more often.
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Slots of a shard in one partition of ordered rows.
SLOTS_PER_PART = 50_000


def _words(text: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def _text_hash(text: str) -> Column:
    """Tells rows apart that share a key, so that those of a null one don't all fall into one block."""
    return F.xxhash64(F.col(text))


def level(total: float, sums: Callable[[float], tuple[float, float]]) -> float:
    """The words that a weight of 1 gets, so that all sources get total together and none more than it has. sums(x): what sources have that x a weight would overfill, and the weight of the others.

    The level rises from round to round, as the excess of full sources is reshared, until no further source is full; infinite if all are."""
    now = -math.inf
    while True:
        full, weight = sums(now)
        if weight <= 0:
            return math.inf
        after = (total - full) / weight
        if after <= now:
            return now
        now = after


def targets(sizes: list[float], weights: list[float], most: int = MOST) -> list[float]:
    """Words per source: all words shared by weight, no source above most times its size, the excess reshared by weight."""
    caps, weight = most * np.array(sizes, np.float64), np.array(weights, np.float64)

    def sums(x: float) -> tuple[float, float]:
        full = x * weight > caps
        return float(caps[full].sum()), float(weight[~full].sum())

    x = level(float(sum(sizes)), sums)
    return np.where(x * weight > caps, caps, np.minimum(x, 1e300) * weight).tolist() if len(caps) else []


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """quotas[s] blocks of each source dealt over the shards, as a uniform shuffle of all blocks would: a row of counts for each shard.

    A tree: a node's blocks are halved (as exactly as the number of its shards allows) by one multivariate hypergeometric draw."""
    if shards == 1:
        return quotas[None, :]
    low = shards // 2
    total = int(quotas.sum())
    here = rng.multivariate_hypergeometric(quotas, total * low // shards, method="marginals") if total else quotas.copy()
    return np.vstack([split_quotas(here, low, rng), split_quotas(quotas - here, shards - low, rng)])


def plan(words: np.ndarray, goal: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a source takes of its blocks, whose words are given: takes (whole passes of a block's rows), rest (further words to take from its rows), what _fill does with it, and how many shards it is dealt to.

    Blocks are random sets of rows, so their numbers are a random order. Each pass takes the blocks in that order until the target is met;
    the block in which it is met gets the rest (role 1). Beside it lie those that may make up for what its rows miss: before it blocks taken
    once more (role 2, may give up rows) than those after it (role 3, may add rows, to the shard of the rest); on either side AROUND of them
    at least, and as many words as that block has. The others have role 0."""
    total = int(words.sum())
    passes, rest = divmod(goal, total) if total else (0, 0)
    ends = words.cumsum()
    whole = int(np.searchsorted(ends, rest, "right")) if rest else 0
    takes = np.full(len(words), passes, np.int64)
    takes[:whole] += 1
    more, role = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    if rest and whole < len(words):
        more[whole] = rest - int(ends[whole - 1] if whole else 0)
    draws = takes + (more > 0)
    if more.any():
        role[whole] = 1
        for side, kind in ((range(whole - 1, -1, -1), 2), (range(whole + 1, len(words)), 3)):
            near = 0
            for k, other in enumerate(side):
                if k >= AROUND and near >= words[whole]:
                    break
                near += int(words[other])
                role[other] = kind
    return takes, more, role, draws


def deal(draws: list[np.ndarray], quotas: np.ndarray, rng: np.random.Generator) -> list[list[list[int]]]:
    """The shards of each block of each source of a family, whose shards have quotas blocks together: for each source one multivariate hypergeometric draw from what the shards have left, then disjoint runs of its permuted blocks."""
    left, out = quotas.copy(), []
    for own in draws:
        n = int(own.sum())
        mine = rng.multivariate_hypergeometric(left, n, method="marginals") if n else np.zeros_like(left)
        left = left - mine
        flat = np.repeat(np.arange(len(own)), own)[rng.permutation(n)]
        dealt: list[list[int]] = [[] for _ in own]
        for block, shard in zip(flat.tolist(), np.repeat(np.arange(len(mine)), mine).tolist(), strict=True):
            dealt[block].append(shard)
        out.append(dealt)
    return out


def _settle(sizes: np.ndarray, order: np.ndarray, picked: np.ndarray, left: int) -> tuple[np.ndarray, int]:
    """picked and what it then misses (below zero: has too much), after rows were flipped, largest first, as long as one brings it nearer to zero."""
    picked = picked.copy()
    while left:
        before = abs(left)
        adds = left > 0
        for i in order:  # from the largest
            if picked[i] != adds and sizes[i] <= abs(left):
                picked[i] = adds
                left -= int(sizes[i]) if adds else -int(sizes[i])
        if left:
            more = order[(picked[order] != adds) & (sizes[order] > abs(left))]
            if len(more) and sizes[more[-1]] - abs(left) < abs(left):
                picked[more[-1]] = adds
                left -= int(sizes[more[-1]]) if adds else -int(sizes[more[-1]])
        if abs(left) >= before:
            break
    return picked, left


def _decide(sizes: np.ndarray, order: np.ndarray, picked: np.ndarray, left: int) -> np.ndarray:
    """picked with the DECIDED smallest rows decided anew, so that what is missing is as near to zero as they allow: by all sums that they can have, as bits of a number."""
    small = order[::-1][:DECIDED]
    small = small[sizes[small].cumsum() <= DECIDED_WORDS]
    sums = [1]
    for n in sizes[small].tolist():
        sums.append(sums[-1] | sums[-1] << n)
    want = int(sizes[small][picked[small]].sum()) + left
    for miss in range(abs(left)):
        for goal in (want - miss, want + miss):
            if goal >= 0 and sums[-1] >> goal & 1:
                picked = picked.copy()
                for k in range(len(small) - 1, -1, -1):
                    picked[small[k]] = not sums[k] >> goal & 1
                    goal -= int(sizes[small[k]]) * int(picked[small[k]])
                return picked
    return picked


def _fill(group: pa.Table) -> pa.Table:
    """Of the block with the rest, the rows that come nearest to it: largest first, each that still fits, then the one whose words are nearest to what is missing. What is then missing or too much is made up by rows of the blocks around, so the miss is at most half of the smallest row that could change it.

    Where that isn't zero, flipping the next larger row and making up for it is tried too: a very long row may be the way to the target. Last, the smallest rows are decided anew together."""
    sizes, ids, role = (group.column(c).to_numpy() for c in ("size", "_hash", "_role"))
    rest, start = int(group.column("rest").to_numpy().max()), role == 2
    order = np.lexsort((ids, -sizes))
    order = order[sizes[order] > 0]
    picked, left = _settle(sizes, order[role[order] == 1], start, rest)
    picked, left = _settle(sizes, order, picked, left)
    while left:
        more = order[(picked[order] != (left > 0)) & (sizes[order] > abs(left))]
        if not len(more):
            break
        other = picked.copy()
        other[more[-1]] = left > 0
        other, missed = _settle(sizes, order, other, left - int(np.sign(left)) * int(sizes[more[-1]]))
        if abs(missed) >= abs(left):
            break
        picked, left = other, missed
    if left:
        picked = _decide(sizes, order, picked, left)
    return group.drop_columns(["rest", "_role"]).append_column("_more", pa.array(picked.astype(np.int32) - start))


def _numbered(sources: DataFrame) -> DataFrame:
    """sources (_source) with _s, their place by code point from 0, null last. Ranges of them are numbered apart; the driver knows how many each has."""
    parts = max(1, -(-sources.count() // NUMBERED))
    cut = stored(sources.repartitionByRange(parts, F.col("_source").isNull(), "_source").withColumn("_range", F.spark_partition_id()), "mix-ranges")
    counts = dict(cut.groupBy("_range").count().collect())  # a row for each range
    before = literal_rows(sources.sparkSession, [[r, sum(n for q, n in counts.items() if q < r)] for r in sorted(counts)], "_range int, _before bigint")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.asc_nulls_last("_source")))
    return cut.withColumn("_s", inside - 1).join(F.broadcast(before), "_range").withColumn("_s", (F.col("_s") + F.col("_before")).cast("bigint")).drop("_range", "_before")


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


_BLOCKS = "_s long, _block int, _family int, takes int, rest long, _role int, draws int"


def _planned(blocks: DataFrame) -> DataFrame:
    """Every block (_s, _block, words, _cut, target) with what its source takes of it."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("_block")
        words = np.zeros(rows.column("_cut")[0].as_py(), np.int64)
        words[rows.column("_block").to_numpy()] = rows.column("words").to_numpy()
        takes, rest, role, draws = plan(words, round(rows.column("target")[0].as_py()))
        s = rows.column("_s")[0].as_py()
        n = len(words)
        columns = [np.full(n, s), np.arange(n), np.full(n, s % FAMILIES), takes, rest, role, draws]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()], strict=True)], names=[x.split()[0] for x in _BLOCKS.split(", ")])

    return stored(blocks.groupBy("_s").applyInArrow(run, _BLOCKS), "mix-plan")


def _dealt(planned: DataFrame, shards: int, seed: int) -> DataFrame:
    """planned with dealt, the shards of each block's takes and, last, of its rest."""
    counts = dict(planned.groupBy("_family").agg(F.sum("draws")).collect())  # at most FAMILIES rows
    families = sorted(counts)
    quotas = dict(zip(families, split_quotas(np.array([counts[f] for f in families], np.int64), shards, np.random.default_rng(seed)).T, strict=True)) if families else {}

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("_s", "ascending"), ("_block", "ascending")])
        family, s, draws = rows.column("_family")[0].as_py(), rows.column("_s").to_numpy(), rows.column("draws").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        given = [x for own in deal(np.split(draws, cuts[1:]), quotas[family], np.random.default_rng([seed, family])) for x in own]
        role, rest, at = rows.column("_role").to_numpy(), rows.column("rest").to_numpy(), np.searchsorted(cuts, np.arange(len(s)), "right") - 1
        last = {int(at[i]): given[i][-1] for i in np.flatnonzero(rest > 0).tolist()}
        given = [[*g, last[int(at[i])]] if role[i] == 3 else g for i, g in enumerate(given)]
        return rows.append_column("dealt", pa.array(given, pa.list_(pa.int32())))

    return stored(planned.groupBy("_family").applyInArrow(run, _BLOCKS + ", dealt array<int>"), "mix-dealt")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), shards: int = 64, seed: int = 29, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """key, size, text_hash, source, source_size, target, takes (how often the mix has the document), shards (the output shard of each take), slots (its place in that shard's random order, from 0).

    Size is the number of words of the text (null: 0). Sources in code point order, null last, get the weights in turn and share the words
    of the whole table; none gets more than MOST times its own. The rows of a source fall into blocks by a hash of their key and text. A task sets
    how often each block of a source is taken; the splitting tree deals the blocks of families of sources over the shards, and a task those
    of a family to its sources. In the one block where a source's target falls, rows are fitted to the words missing, and rows of the
    blocks around it make up for what that fit misses. Last, each shard's takes are shuffled: a slot is a rank inside one of many slices of
    a random key plus the slice's offset.

    Any number of sources can be mixed, and one may hold most rows: no step gathers a source, only AROUND blocks on either side of one, and
    as many words as that one has. Rows equal in key and text may swap places. A null key is a value like others; an empty table gives no
    rows; other columns are left out. Reruns agree."""
    spark = docs.sparkSession
    sized = docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), _words(text).alias("size"), _text_hash(text).alias("text_hash"))
    slim = stored(sized.withColumns({"_hash": F.xxhash64(F.lit(seed), "_key", "size", "text_hash"), "_row": F.monotonically_increasing_id()}), "mix-sizes")
    sources = stored(_numbered(slim.groupBy("_source").agg(F.sum("size").alias("source_size"))).withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_s") % len(weights) + 1).cast("int"))), "mix-sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    cap = MOST * F.col("source_size")

    def sums(x: float) -> tuple[float, float]:
        full = F.lit(x) * F.col("_weight") > cap
        return tuple(float(v or 0) for v in sources.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("_weight")))).first())

    x = level(float(total), sums)
    step = max(BLOCK_WORDS, -(-total // MAX_BLOCKS))
    goal = F.when(F.lit(x) * F.col("_weight") > cap, cap.cast("double")).otherwise(F.lit(min(x, 1e300)) * F.col("_weight"))
    names = sources.select(F.col("_source").alias("_name"), "_s", F.greatest(F.lit(1), F.ceil(F.col("source_size") / step)).alias("_cut"), "source_size", goal.alias("target"))
    placed = slim.join(_small(names), F.col("_source").eqNullSafe(F.col("_name"))).withColumn("_block", F.pmod("_hash", "_cut").cast("int")).drop("_name")
    blocks = placed.groupBy("_s", "_block").agg(F.sum("size").alias("words"), F.max("_cut").alias("_cut"), F.max("target").alias("target"))
    chosen = _dealt(_planned(blocks), shards, seed).select("_s", "_block", "takes", "rest", "dealt", "_role")
    planned = placed.join(_small(chosen), ["_s", "_block"])
    columns = ["_key", "size", "_source", "text_hash", "_hash", "_row", "source_size", "target", "takes", "dealt"]
    whole = planned.filter("_role = 0").select(*columns, F.lit(0).alias("_more"))
    part = planned.filter("_role > 0").select("_s", *columns, "rest", "_role")
    schema = "_s long, " + ", ".join(f"{c} {dict(part.dtypes)[c]}" for c in columns) + ", _more int"
    fitted = part.groupBy("_s").applyInArrow(_fill, schema).select(*whole.columns)
    both = whole.unionByName(fitted).withColumn("takes", F.col("takes") + F.col("_more"))
    both = stored(both.withColumn("shards", F.slice("dealt", F.lit(1), F.col("takes"))).drop("dealt", "_more"), "mix-takes")
    slots = _shuffled(both.select("_row", "_hash", F.posexplode("shards").alias("_take", "_shard")), shards, seed)
    shown = both.join(slots, "_row", "left")
    return shown.select(F.col("_key").alias(key), "size", "text_hash", F.col("_source").alias(source), "source_size", "target", "takes", "shards", F.coalesce("slots", F.array().cast("array<bigint>")).alias("slots"))


def _shuffled(taken: DataFrame, shards: int, seed: int) -> DataFrame:
    """_row and slots, the place of each of its takes (_row, _hash, _take, _shard) in the random order of its shard."""
    rows = taken.count()
    slices = max(1, min(MAX_SLICES // shards, -(-rows // (shards * SLICE_ROWS))))
    mixed = taken.withColumns({"_order": F.xxhash64(F.lit(seed + 1), "_hash", "_take"), "_slice": F.pmod(F.xxhash64(F.lit(seed + 2), "_hash", "_take"), F.lit(slices)).cast("int")})
    before = Window.partitionBy("_shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = mixed.groupBy("_shard", "_slice").count().select("_shard", "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))  # at most MAX_SLICES rows
    inside = mixed.withColumn("_rank", F.row_number().over(Window.partitionBy("_shard", "_slice").orderBy("_order", "_hash", "_take", "_row")) - 1)
    placed = inside.join(F.broadcast(starts), ["_shard", "_slice"]).select("_row", F.struct("_take", (F.col("_start") + F.col("_rank")).cast("bigint").alias("slot")).alias("x"))
    return placed.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["slot"]).alias("slots"))  # at most MOST takes a row


def _takes(docs: DataFrame, **options) -> DataFrame:
    """_mix_id, _mix_size, _mix_hash (of the text) and _mix_takes, the shards and slots of what the mix takes of such a row."""
    taken = mix(docs, **options).filter("takes > 0").groupBy(F.col(options.get("key", "doc_id")).alias("_mix_id"), F.col("size").alias("_mix_size"), F.col("text_hash").alias("_mix_hash"))
    return taken.agg(F.max(F.arrays_zip("shards", "slots")).alias("_mix_takes"))


def _taken_rows(docs: DataFrame, taken: DataFrame, **options) -> DataFrame:
    key, text = options.get("key", "doc_id"), options.get("text", "text")
    sized = docs.withColumns({"_mix_words": _words(text), "_mix_text": _text_hash(text)})
    both = sized.join(taken, F.col(key).eqNullSafe(F.col("_mix_id")) & (F.col("_mix_words") == F.col("_mix_size")) & (F.col("_mix_text") == F.col("_mix_hash")))
    kept = both.select(*docs.columns, F.explode("_mix_takes").alias("_mix_take"))
    return kept.select(*docs.columns, F.col("_mix_take.shards").alias("_mix_shard"), F.col("_mix_take.slots").alias("_mix_slot"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """docs' rows, each as often as the mix takes it, with _mix_shard and _mix_slot, its place in the shard.

    Rows equal in key and text share one row's takes and so its slots. Columns of docs whose names begin with _mix_ are replaced; mixed_in_order keeps all."""
    docs = own_names(docs, "_mix_id", "_mix_size", "_mix_hash", "_mix_text", "_mix_words", "_mix_takes", "_mix_take", "_mix_shard", "_mix_slot")
    return _taken_rows(docs, _takes(docs, **options), **options)


def in_order(mixed: DataFrame, shards: int = 64, slots_per_part: int = SLOTS_PER_PART, longest: int | None = None) -> DataFrame:
    """mixed_rows' rows in partitions that each hold a run of slots_per_part slots of one shard, in the shard's order: so does each file written of them.

    longest: the slots of the longest shard, if known; else they are found first. Partitions, not their rows, grow with the data."""
    if longest is None:
        longest = (mixed.agg(F.max("_mix_slot")).first()[0] or 0) + 1
    runs = max(1, -(-longest // slots_per_part))
    part = F.col("_mix_shard") * runs + F.floor(F.col("_mix_slot") / slots_per_part)
    return mixed.repartitionById(shards * runs, part.cast("int")).sortWithinPartitions("_mix_shard", "_mix_slot")


def mixed_in_order(docs: DataFrame, shards: int = 64, **options) -> DataFrame:
    """docs' rows, each as often as the mix takes it, in partitions that follow the shards' random orders. All columns stay and none is added."""
    df, at = renamed(docs)
    options = {name: at[options.get(name, default)] for name, default in (("key", "doc_id"), ("source", "source"), ("text", "text"))} | {"shards": shards, **{k: v for k, v in options.items() if k not in ("key", "source", "text")}}
    taken = stored(_takes(df, **options), "mix-places")
    longest = (taken.agg(F.max(F.array_max("_mix_takes.slots"))).first()[0] or 0) + 1
    return with_names(in_order(_taken_rows(df, taken, **options), shards, longest=longest), at, {})


def op3(spark, sf_dir: str) -> DataFrame:
    """All documents mixed; shards and slots say where each take stands. A null text has no words and is never missed; rows of a null or repeated doc_id each have their own takes; very long texts are counted whole; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("takes")).alias("taken"), "shards", "slots")
