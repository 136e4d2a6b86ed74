"""Audit chains: every event of a tenant carries a keyed hash of what it says and of the event before it.

The key travels in functions, never as a literal: query plans and event logs don't show it."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .governance import MAX_EVENTS

#: The hash before a tenant's first event, and the fields of an event that its hash covers beside sequence, tenant, time and the hash before.
GENESIS = "0" * 64
SAID = ["principal_id", "action", "resource_type", "resource_id", "outcome", "request_id", "key_id"]
EVENT = "tenant_id string, occurred_at timestamp, principal_id string, action string, resource_type string, resource_id string, outcome string, request_id string, key_id string"
CHAIN = f"{EVENT}, sequence long, previous_hash string, hash string"
_NAMES = [f.split()[0] for f in EVENT.split(", ")]


class CapacityError(ValueError):
    """A tenant's chain would get more events than it may have; retention has to be applied first."""


def covered() -> Column:
    """What an event's hash covers between its sequence and the hash before it: tenant, whole seconds and nanoseconds of its time, and SAID, joined by NUL. Null where a field is."""
    micros = F.unix_micros("occurred_at")
    rest = F.pmod(micros, F.lit(1_000_000))
    parts = [F.col("tenant_id"), ((micros - rest) / 1_000_000).cast("long").cast("string"), (rest * 1000).cast("string"), *map(F.col, SAID)]
    return F.concat(*[x for p in parts for x in (F.lit("\0"), p)][1:])


def keyed_hash(key: bytes, sequence: int, said: str, previous: str) -> str:
    return hmac.new(key, f"{sequence}\0{said}\0{previous}".encode(), hashlib.sha256).hexdigest()


def prepared(events: DataFrame) -> DataFrame:
    """Events with what their hashes cover; reading one that has a null field is an error."""
    told = F.coalesce(covered(), F.raise_error(F.lit("an audit event has no null fields")).cast("string"))
    return events.select(*_NAMES, told.alias("said"))


def follow(key: bytes, rows: pd.DataFrame, sequence: int, last: str, most: int = MAX_EVENTS) -> pd.DataFrame:
    """Prepared events of one tenant as the continuation of its chain, in the order of time, request and what they say; constant work an event."""
    if len(rows) > most:
        raise CapacityError(f"a chain has at most {most} events")
    rows = rows.sort_values(["occurred_at", "request_id", "said"], kind="stable").reset_index(drop=True)
    before, own = [], []
    for n, said in enumerate(rows["said"], sequence + 1):
        before.append(last)
        own.append(last := keyed_hash(key, n, said, last))
    return rows[_NAMES].assign(sequence=range(sequence + 1, sequence + 1 + len(rows)), previous_hash=before, hash=own)


def append(key: bytes, events: DataFrame, heads: DataFrame | None = None, most: int = MAX_EVENTS) -> DataFrame:
    """events as they continue the chains whose heads (tenant_id, sequence, hash, and how many events the chain holds) are given; tenants without one begin a chain.

    A chain can't be split, so a tenant's new events are one group of at most most rows: more, or more than there is room for beside those
    held, is a CapacityError. An empty table gives no rows; equal events are each an event."""
    rows = prepared(events)
    if heads is None:
        heads = events.sparkSession.createDataFrame([], "tenant_id string, sequence long, hash string, held long")
    met = rows.join(heads.select("tenant_id", "sequence", "hash", "held"), "tenant_id", "left").select(*rows.columns, "sequence", "hash", "held")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        old = pd.notna(first["hash"])
        return follow(key, group, int(first["sequence"]) if old else 0, first["hash"] if old else GENESIS, most - (int(first["held"]) if old else 0))

    return met.groupBy("tenant_id").applyInPandas(run, CHAIN)


def heads(chain: DataFrame) -> DataFrame:
    """The head of each tenant's chain: sequence and hash of the last event, and how many events are held."""
    return chain.groupBy("tenant_id").agg(F.max("sequence").alias("sequence"), F.max_by("hash", "sequence").alias("hash"), F.count("*").alias("held"))


def anchors(removed: DataFrame) -> DataFrame:
    """What a trimmed chain follows: the last hash of the events that retention removed, by tenant."""
    return removed.groupBy("tenant_id").agg(F.max_by("hash", "sequence").alias("anchor"))


def authentic(key: bytes) -> object:
    """A function of sequence, covered(), previous hash and hash: whether the hash is that of the event."""

    @F.pandas_udf("boolean")
    def same(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sequence, said, previous, own in parts:
            rows = zip(sequence, said, previous, own, strict=True)
            yield pd.Series([None not in (s, p, h) and pd.notna(n) and hmac.compare_digest(keyed_hash(key, int(n), s, p), h) for n, s, p, h in rows], dtype=bool)

    return same


def verify(key: bytes, chain: DataFrame, known: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """What is wrong with chains: tenant_id, sequence and problem, no row for whole ones.

    problem is SEQUENCE where the event before is missing, the sequence is null or another event has it, CHAIN where the hash before is
    not that of the event before (a tenant's first event follows its anchor in known, else GENESIS), AUTHENTICATION where the hash is not
    that of the event; one event may have several. With ends (heads of before), END where a chain ends at another sequence or is gone.
    Each event meets the one before by equality, so a tenant with very many events is no task of its own."""
    spark = chain.sparkSession
    rows = chain.withColumn("said", covered())
    low = chain.groupBy("tenant_id").agg(F.min("sequence").alias("low"))
    if known is None:
        known = spark.createDataFrame([], "tenant_id string, anchor string")
    first = low.join(known.select("tenant_id", "anchor"), "tenant_id", "left")
    at = chain.groupBy("tenant_id", "sequence").agg(F.max("hash").alias("last"), F.count("*").alias("same"))
    before = at.select("tenant_id", (F.col("sequence") + 1).alias("sequence"), "last")
    met = rows.join(at.select("tenant_id", "sequence", "same"), ["tenant_id", "sequence"], "left").join(before, ["tenant_id", "sequence"], "left").join(first, "tenant_id", "left")
    begins = F.col("sequence").eqNullSafe(F.col("low"))
    follows = F.when(begins, F.coalesce("anchor", F.lit(GENESIS))).otherwise(F.col("last"))
    alone = F.coalesce(F.col("same") == 1, F.lit(False))
    fine = authentic(key)("sequence", "said", "previous_hash", "hash")
    found = met.select("tenant_id", "sequence", F.array_compact(F.array(
        F.when(~alone | (~begins & F.col("last").isNull()), "SEQUENCE"),
        F.when(follows.isNotNull() & ~follows.eqNullSafe(F.col("previous_hash")), "CHAIN"),
        F.when(~fine, "AUTHENTICATION"),
    )).alias("problems"))
    out = found.select("tenant_id", "sequence", F.explode("problems").alias("problem"))
    if ends is not None:
        is_ = chain.groupBy("tenant_id").agg(F.max("sequence").alias("is"))
        other = ends.select("tenant_id", "sequence").join(is_, "tenant_id", "left").filter(~F.col("is").eqNullSafe(F.col("sequence")))
        out = out.union(other.select("tenant_id", F.coalesce("is", "sequence"), F.lit("END")))
    return out
