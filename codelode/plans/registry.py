"""The tables that queries read, and where the modules of queries are gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import normalized_text
from ..operators import architecture, derive, retrieval, traverse
from ..store import files_mark, published
from .projection import VIEWS, load

#: The order in which projected tables are published; the others are projected for each query.
ORDER: dict[str, list[str]] = {"symbols": ["id"], "occurrences": ["symbol_id", "file_id"], "relationships": ["source_id"], "commit_files": ["commit_id"]}
#: What an index derives from them once, with its order.
DERIVED: dict[str, tuple[Callable[[Tables], DataFrame], list[str]]] = {
    # rows without a target, of which there are very many, are no target's and would all lie in one range
    "relationships_by_target": (lambda t: t.relationships.filter("target_id IS NOT NULL"), ["target_id"]),
    "dependencies": (lambda t: derive.dependencies(t.relationships), ["source_id"]),
    "impact_edges": (lambda t: traverse.entered(traverse.traversable(t.relationships, t.symbols), t.symbols), ["target_id"]),
    "graph_edges": (lambda t: traverse.program_graph(t.symbols, t.relationships)[1], ["source_node_id"]),
    "graph_nodes": (lambda t: traverse.program_graph(t.symbols, t.relationships)[0], ["id"]),
    "placed_symbols": (lambda t: architecture.assign_modules(t.symbols, t.modules), ["id"]),
    "degrees": (lambda t: retrieval.graph_degree(t.relationships), ["source_id"]),
    "semantic_index": (lambda t: t.semantic_documents.withColumn("normalized", normalized_text("content")), ["stable_key"]),
}


class Tables:
    """The projected tables of one folder. Facts and what is derived from them are published once, in the order in which lookups ask for them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, view: str) -> DataFrame:
        if view in DERIVED:
            make, order = DERIVED[view]
        elif view in ORDER:
            make, order = (lambda t: load(t.spark, t.sf_dir, view)), ORDER[view]
        elif view in VIEWS:
            return load(self.spark, self.sf_dir, view)
        else:
            raise AttributeError(view)
        return published(self.spark, files_mark(self.spark, self.sf_dir), view, lambda: make(self), order)

    def projected(self, view: str, merged: str | None = None) -> DataFrame:
        """A projected table that is not published: for queries that go through it once, which sorting and writing it would cost more than they ask. merged: see load."""
        return load(self.spark, self.sf_dir, view, merged)

    def base(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
        self.queries[name] = lambda spark, sf_dir: query(Tables(spark, sf_dir))
        if sql is not None:
            self.sql[name] = sql
