"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import literal_rows, own_names, stored, table

#: Rows of a virtual partition, and the most of them: the matrix on the driver has at most MAX_PARTS rows.
PART_ROWS, MAX_PARTS = 4096, 16_384
#: Virtual partitions of so many times the mean hold very many rows of one key.
HEAVY = 4
#: Deviations from its mode to which a law is drawn.
WIDTH = 12


def communication_matrix(counts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """How many rows each partition sends to each shard if all rows were dealt uniformly into shards of the given sizes.

    Row p sums to counts[p], column s to sizes[s]; drawn partition by partition from the multivariate hypergeometric law of what is left."""
    rng, left = np.random.default_rng(seed), sizes.astype(np.int64).copy()
    out = np.zeros((len(counts), len(sizes)), np.int64)
    for p, n in enumerate(counts):
        rest, pool = int(n), int(left.sum())
        for s in range(len(left)):
            pool -= int(left[s])
            take = rest if pool == 0 else _hypergeometric(rng, int(left[s]), pool, rest)
            out[p, s] = take
            rest -= take
        left -= out[p]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of draws from good and bad items are good, at any size: by inversion of the law around its mode.

    The law's terms follow from each other by exact ratios; those further than WIDTH deviations from the mode are below what doubles tell
    from zero."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = (draws + 1) * (good + 1) // (total + 2)
    deviation = (draws * (good / total) * (bad / total) * ((total - draws) / max(total - 1, 1))) ** 0.5
    reach = int(WIDTH * deviation) + 40
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)  # the ratio of the term at k + 1 to that at k
    logs = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weights = np.concatenate([[0.0], logs.cumsum()])
    sums = np.exp(weights - weights.max()).cumsum()
    return first + int(np.searchsorted(sums, rng.random() * sums[-1], "right"))


def _spread(df: DataFrame, key: list[str], parts: list[int], part: Column) -> DataFrame:
    """df with _copy: in the virtual partitions given, which hold very many rows of one key, a number for each row of a key from 0 on, so that they hash apart; elsewhere 0.

    Rows are numbered inside their key and input partition; input partitions follow each other by their counts, so no task holds a key."""
    if not parts:
        return df.withColumn("_copy", F.lit(0).cast("bigint"))
    marked = df.withColumn("_heavy", part.isin(parts))
    heavy = stored(marked.filter("_heavy").withColumn("_input", F.spark_partition_id()), "heavy-rows")
    counts = heavy.groupBy(*key, "_input").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy("_input").rowsBetween(Window.unboundedPreceding, -1)  # a row for each input partition
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = heavy.withColumn("_copy", F.row_number().over(Window.partitionBy(*key, "_input").orderBy(F.lit(0))) - 1)
    same = [inside[c].eqNullSafe(starts[c]) for c in [*key, "_input"]]
    numbered = inside.join(starts, same).select(*[inside[c] for c in df.columns], (inside["_copy"] + starts["_before"]).cast("bigint").alias("_copy"))
    numbered = stored(numbered, "numbered-rows")  # which of equal rows has which number must not change when a task runs again
    return marked.filter("NOT _heavy").drop("_heavy").withColumn("_copy", F.lit(0).cast("bigint")).unionByName(numbered)


def shard_rows(df: DataFrame, key: list[str], shards: int = 8, seed: int = 17, part_rows: int = PART_ROWS) -> DataFrame:
    """df's rows with shard (0..shards-1), slot (gapless from 0 in each shard): a uniform random order, shard sizes at most one apart.

    Rows fall into virtual partitions by a hash of their key columns. The driver knows only the partitions' counts and draws the matrix of
    how many rows each sends to each shard. A partition ranks its rows in random order and deals them by its matrix row; a second random
    key orders each shard. Shards may be few: a slot is a row's rank inside one of many slices of that key plus the slice's offset, so no
    task holds a shard. Rows of a key that very many rows share are numbered first and so fall into partitions of their own.

    Nulls in key columns count as a value of their own; rows equal in all key columns may swap places; an empty df gives no rows. Columns
    of df called shard or slot are replaced, and so are _part, _order, _slice, _rank, _cuts, _start, _copy, _heavy and _input. Reruns agree
    whatever the layout of df."""
    spark = df.sparkSession
    df = own_names(df, "shard", "slot", "_part", "_order", "_slice", "_rank", "_cuts", "_start", "_copy", "_heavy", "_input")
    word = lambda salt, *more: F.xxhash64(F.lit(seed * 1000 + salt), *[c for k in key for c in (F.col(k), F.col(k).isNull())], *more)
    rows = df.count()
    parts = max(1, min(MAX_PARTS, -(-rows // part_rows)))
    slices = max(1, min(MAX_PARTS // shards, -(-rows // (shards * part_rows))))
    part = lambda *more: F.pmod(word(1, *more), F.lit(parts)).cast("int")
    zero = F.lit(0).cast("bigint")
    first = df.groupBy(part(zero).alias("_part")).count().collect()  # at most MAX_PARTS rows
    heavy = [p for p, n in first if n > HEAVY * max(part_rows, rows // parts)]
    copied = _spread(df, key, heavy, part(zero))
    copy = F.col("_copy")
    placed = copied.withColumns({"_part": part(copy), "_order": word(2, copy)})
    counts = np.zeros(parts, np.int64)
    for p, n in placed.groupBy("_part").count().collect() if heavy else first:
        counts[p] = n
    sizes = np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)
    cuts = communication_matrix(counts, sizes, seed).cumsum(axis=1)
    matrix = literal_rows(spark, [[p, list(map(int, row))] for p, row in enumerate(cuts)], "_part int, _cuts array<bigint>")
    tie = [*[F.col(k).asc_nulls_first() for k in key], "_copy"]
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("_order", *tie)))
    dealt = ranked.join(F.broadcast(matrix), "_part").withColumn("shard", F.size(F.filter("_cuts", lambda c: c < F.col("_rank"))))
    # the second permutation: _slice is the high part of a random key, _order its low part
    mixed = dealt.drop("_part", "_rank", "_cuts", "_order").withColumns({"_slice": F.pmod(word(3, copy), F.lit(slices)).cast("int"), "_order": word(4, copy)})
    rest = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = mixed.groupBy("shard", "_slice").count().select("shard", "_slice", F.coalesce(F.sum("count").over(rest), F.lit(0)).alias("_start"))  # at most MAX_PARTS rows
    inside = mixed.withColumn("_rank", F.row_number().over(Window.partitionBy("shard", "_slice").orderBy("_order", *tie)))
    return inside.join(F.broadcast(starts), ["shard", "_slice"]).withColumn("slot", (F.col("_start") + F.col("_rank") - 1).cast("bigint")).drop("_slice", "_order", "_start", "_rank", "_copy")


def write_shards(sharded: DataFrame, path: str, shards: int = 8, files_per_shard: int = 64) -> None:
    """Files below path/shard=s, each a range of slots in order: reading a shard's files by name gives its slots in order."""
    step = F.col("slot") % files_per_shard
    sharded.repartition(shards * files_per_shard, "shard", step).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7, counts at most one apart. A null text has no bytes; rows of a repeated or null doc_id each have a place; an empty table gives no rows."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard_rows(docs, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
