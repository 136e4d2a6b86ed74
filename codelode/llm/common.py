"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import ARROW_BATCH_BYTES, scratch, small_batches, source_bytes, stored

__all__ = ["ARROW_BATCH_BYTES", "scratch", "small_batches", "source_bytes", "stored"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Give what this process no longer holds back to the machine, not only to its allocators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not with every C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for a Python worker that other tasks use later: what it held goes back to the machine at its end, not only to the worker's allocators."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def own_exchange(df: DataFrame, *keys: str) -> DataFrame:
    """df whose join on keys (bigint) is dealt anew: Spark splits skewed partitions only where both sides come straight from an exchange of the join."""
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0).cast("bigint")) for k in keys})


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def literal_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Driver-side rows as a DataFrame made of SQL expressions alone. rows: lists in the schema's order."""
    names = [f.split()[0] for f in schema.split(", ")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in schema.split(', '))}>>")))


def own_names(df: DataFrame, *added: str) -> DataFrame:
    """df without columns that clash (in any letter case) with those an operator adds."""
    taken = {x.lower() for x in added}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns called in0, in1, ..., so that none can clash with an operator's own, and the new name of each."""
    at = {c: f"in{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*at.values()), at


def with_names(df: DataFrame, at: dict[str, str], added: dict[str, Column]) -> DataFrame:
    """The columns that renamed() renamed under their names again, but for those (in any letter case) of the added ones, which follow."""
    taken = {x.lower() for x in added}
    return df.select(*[F.col(new).alias(old) for old, new in at.items() if old.lower() not in taken], *[c.alias(name) for name, c in added.items()])


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
