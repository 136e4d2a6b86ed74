"""Composed program graphs, kept by project, snapshot and what their providers say of themselves."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.traverse import compose, declarations
from .ports import GraphProvider
from .store import remove, scratch, stored_at

#: What a graph lacks that no provider and no edge gives a capability for.
LACKING = {
    "CALL_GRAPH": "CALL_GRAPH_UNAVAILABLE", "CONTROL_FLOW_GRAPH": "CONTROL_FLOW_UNAVAILABLE", "LOCAL_DATA_FLOW": "LOCAL_DATA_FLOW_UNAVAILABLE",
    "INTERPROCEDURAL_FLOW": "INTERPROCEDURAL_DATA_FLOW_UNAVAILABLE", "TAINT_ANALYSIS": "SECURITY_ANNOTATIONS_UNAVAILABLE",
}
Key = tuple[str, str, str]


@dataclass
class Graph:
    """A composed graph as written tables, and whether it was at hand."""

    key: Key
    nodes: DataFrame
    edges: DataFrame
    declared: DataFrame
    hit: bool


@dataclass
class _Entry:
    folder: str
    tables: dict[str, DataFrame]
    readers: int = 0
    retired: bool = field(default=False)


def limitations(declared: DataFrame) -> DataFrame:
    """declared (what, name) with a limitation for each capability that it lacks."""
    names = declared.filter("what = 'CAPABILITY'").select(F.col("name").alias("capability"))
    all_ = declared.sparkSession.createDataFrame(list(LACKING.items()), "capability string, name string")
    lacking = all_.join(names, "capability", "left_anti").select(F.lit("LIMITATION").alias("what"), "name")
    return declared.select("what", "name").union(lacking).distinct()


class GraphCache:
    """At most most composed graphs, each written once to the shared folder; of a project only that of the last key asked for stays, and the least recently read goes first.

    A graph is read inside a lease. One that goes while it is leased keeps its files until its last reader is done."""

    def __init__(self, spark: SparkSession, providers: dict[str, GraphProvider], most: int = 16):
        if not providers or most < 1:
            raise ValueError("a cache of graphs needs a provider and room for a graph")
        self.spark, self.providers, self.most = spark, providers, most
        self.hits = self.misses = 0
        self.removed: list[Key] = []
        self._entries: OrderedDict[Key, _Entry] = OrderedDict()
        self._lock = threading.Lock()

    def key(self, project: str, snapshot: str) -> Key:
        keys = {name: p.cache_key(snapshot) for name, p in self.providers.items()}
        for name, k in keys.items():
            if not k or not k.strip():
                raise ValueError(f"graph provider {name} gives no cache key")
        return project, snapshot, ",".join(sorted(f"{n}={k}" for n, k in keys.items()))

    def keys(self) -> list[Key]:
        """The keys at hand, the one that goes first first."""
        return list(self._entries)

    @contextmanager
    def lease(self, project: str, snapshot: str, symbols: DataFrame, relationships: DataFrame) -> Iterator[Graph]:
        """The graph of a project's snapshot, composed of its facts where it isn't at hand. It is composed under the lock, so two readers never compose the same."""
        key = self.key(project, snapshot)
        with self._lock:
            hit = key in self._entries
            if hit:
                self.hits += 1
                self._entries.move_to_end(key)
            else:
                self.misses += 1
                made = self._compose(symbols, relationships, snapshot)
                for k in [k for k in self._entries if k[0] == project]:
                    self._retire(k)
                self._entries[key] = made
                while len(self._entries) > self.most:
                    self._retire(next(iter(self._entries)))
            entry = self._entries[key]
            entry.readers += 1
        try:
            yield Graph(key, entry.tables["nodes"], entry.tables["edges"], entry.tables["declared"], hit)
        finally:
            with self._lock:
                entry.readers -= 1
                if entry.retired and not entry.readers:
                    remove(self.spark, entry.folder)

    def _compose(self, symbols: DataFrame, relationships: DataFrame, snapshot: str) -> _Entry:
        folder = scratch(self.spark, "graph")
        try:
            parts = [p.analyze(symbols, relationships, snapshot) for p in self.providers.values()]
            there = [f for f in parts if f is not None]
            tables = {name: stored_at(compose([getattr(f, name) for f in there]), f"{folder}/{name}") for name in ("nodes", "edges")}
            tables["declared"] = stored_at(limitations(declarations(parts, list(self.providers), tables["edges"])), f"{folder}/declared", 1)  # a few names
        except BaseException:
            remove(self.spark, folder)
            raise
        return _Entry(folder, tables)

    def _retire(self, key: Key) -> None:
        entry = self._entries.pop(key)
        self.removed.append(key)
        entry.retired = True
        if not entry.readers:
            remove(self.spark, entry.folder)
