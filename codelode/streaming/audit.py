"""Audit chains as a stream: each tenant's last sequence and hash are its state, so an event costs the same however long its chain is."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.audit import CHAIN, EVENT, GENESIS, MAX_EVENTS, CapacityError, follow, prepared

#: The state store that stateful processors need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Chains(StatefulProcessor):
    """Continues each tenant's chain from the head in its state."""

    def __init__(self, key: bytes, most: int = MAX_EVENTS):
        self.key, self.most = key, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "sequence long, hash string, held long")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.head.update((int(row["sequence"]), row["hash"], int(row["held"])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sequence, last, held = self.head.get() if self.head.exists() else (0, GENESIS, 0)
        frames, room = [], self.most - held
        for frame in rows:
            frames.append(frame)
            room -= len(frame)
            if room < 0:  # before more of them are held
                raise CapacityError(f"a chain has at most {self.most} events")
        made = follow(self.key, pd.concat(frames), sequence, last, self.most)
        self.head.update((sequence + len(made), made["hash"].iloc[-1], held + len(made)))
        yield made

    def close(self) -> None:
        pass


def chained(key: bytes, events: DataFrame, heads: DataFrame | None = None, most: int = MAX_EVENTS) -> DataFrame:
    """A stream of events as chains: events of a batch in the order of time, request and what they say, after those of earlier batches.

    heads (tenant_id, sequence, hash, held; one row a tenant) are where chains stand when the stream first starts; later starts go on from
    the checkpoint. A tenant's chain holds at most most events, those of heads included: after retention a stream starts anew from heads."""
    if heads is not None:
        heads = heads.select("tenant_id", "sequence", "hash", "held").groupBy("tenant_id")
    return prepared(events).groupBy("tenant_id").transformWithStateInPandas(Chains(key, most), CHAIN, "Append", "None", heads)


def extend(spark: SparkSession, key: bytes, folder: str, chain: str, checkpoint: str, heads: DataFrame | None = None, most: int = MAX_EVENTS, files: int = 1000) -> StreamingQuery:
    """Append the audit events that arrive in a folder (Parquet, at most files a batch) to the chain table below a path, as long as there are new files.

    State, offsets and the table's files are committed by batch: one that is run again after a failure leaves each event in the chain once."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    arriving = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).parquet(folder)
    written = chained(key, arriving, heads, most).writeStream.format("parquet").option("path", chain)
    return written.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
