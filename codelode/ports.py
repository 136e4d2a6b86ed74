"""Extension points: what a provider of each kind gives, and where providers are registered by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession

from .functions.text import hash_embedding
from .operators.retrieval import cosine_top_k
from .operators import discovery
from .operators.traverse import program_graph
from .sources.files import excerpt
from .store import SnapshotStore


@runtime_checkable
class EmbeddingProvider(Protocol):
    """Texts to vectors. key names provider, model and dimensions: an index made under another key isn't read."""

    key: tuple[str, str, int]

    def embed(self, text: Column) -> Column: ...


@runtime_checkable
class GraphProvider(Protocol):
    """A snapshot's program graph fragment. cache_key changes whenever the fragment may."""

    def cache_key(self, snapshot: str) -> str: ...

    def analyze(self, symbols: DataFrame, relationships: DataFrame, snapshot: str) -> GraphFragment: ...


@runtime_checkable
class KnowledgeStore(Protocol):
    """Snapshots of fact tables."""

    def publish(self, project: str, snapshot: str, tables: dict[str, DataFrame], expected: str | None = None) -> None: ...

    def active(self, project: str) -> str | None: ...

    def load(self, project: str, table: str) -> DataFrame: ...


@runtime_checkable
class IndexerProvider(Protocol):
    """An indexer: its descriptor is a row of the table that history.negotiate reads."""

    descriptor: dict

    def execute(self, root: str, publish: str) -> str: ...


@runtime_checkable
class Discovery(Protocol):
    """Modules and source roots of projects, from a table of their paths (project_id, path)."""

    def modules(self, paths: DataFrame) -> DataFrame: ...

    def source_roots(self, paths: DataFrame, known: DataFrame) -> DataFrame: ...


@runtime_checkable
class SourceReader(Protocol):
    """The lines of a file, and an excerpt of them under a token budget."""

    def full(self, file: str) -> list[str]: ...

    def excerpt(self, file: str, start: int, end: int, around: int, budget: int) -> str: ...


@runtime_checkable
class VectorStore(Protocol):
    """A project's semantic index (stable_key, checksum, vector)."""

    def load(self, project: str) -> DataFrame: ...

    def replace(self, project: str, index: DataFrame) -> None: ...

    def delete(self, project: str) -> None: ...

    def search(self, project: str, query: list[float], limit: int, least: float = -1.0) -> DataFrame: ...


@dataclass
class GraphFragment:
    """Nodes and edges of one provider, with what it declares about them."""

    nodes: DataFrame
    edges: DataFrame
    capabilities: list[str] = field(default_factory=list)
    limitations: list[str] = field(default_factory=list)


class HashEmbedding:
    """The bundled provider: hashed words and their pieces."""

    key = ("hash", "v1", 384)

    def embed(self, text: Column) -> Column:
        return hash_embedding(text)


class RelationsGraph:
    """A graph provider over relations: calls, and the data flow of writes and reads."""

    def cache_key(self, snapshot: str) -> str:
        return "relations-v1"

    def analyze(self, symbols: DataFrame, relationships: DataFrame, snapshot: str) -> GraphFragment:
        return GraphFragment(*program_graph(symbols, relationships))


class LinesReader:
    """A source reader over lines that are already at hand."""

    def __init__(self, files: dict[str, list[str]]):
        self.files = files

    def full(self, file: str) -> list[str]:
        return self.files[file]

    def excerpt(self, file: str, start: int, end: int, around: int, budget: int) -> str:
        return excerpt(self.files[file], start, end, around, budget)[2]


class ParquetVectors:
    """Semantic indexes as Parquet folders, vectors in 32 bits, sorted by key. A replacement is written beside the old index before the pointer moves."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, SnapshotStore(spark, root)

    def _next(self, project: str) -> str:
        return f"v{int((self.store.active(project) or 'v0')[1:]) + 1}"

    def load(self, project: str) -> DataFrame:
        return self.store.load(project, "index")

    def replace(self, project: str, index: DataFrame) -> None:
        slim = index.withColumn("vector", index["vector"].cast("array<float>")).repartitionByRange("stable_key").sortWithinPartitions("stable_key")
        self.store.publish(project, self._next(project), {"index": slim}, expected=self.store.active(project))

    def delete(self, project: str) -> None:
        self.replace(project, self.load(project).limit(0))

    def search(self, project: str, query: list[float], limit: int, least: float = -1.0) -> DataFrame:
        return cosine_top_k(self.load(project), query, limit, least)


class MarkerDiscovery:
    """Marker files make modules, and conventional folders source roots."""

    modules, source_roots = staticmethod(discovery.modules), staticmethod(discovery.source_roots)


#: Providers by kind and name.
PROVIDERS: dict[str, dict[str, Callable]] = {
    "embedding": {"hash": HashEmbedding}, "store": {"parquet": SnapshotStore}, "vectors": {"parquet": ParquetVectors}, "discovery": {"default": MarkerDiscovery}, "source": {"lines": LinesReader}, "graph": {"relations": RelationsGraph}, "indexer": {},
}


def register(kind: str, name: str, make: Callable) -> None:
    """Add a provider; one of that name is an error."""
    if name in PROVIDERS[kind]:
        raise ValueError(f"there is a {kind} provider {name} already")
    PROVIDERS[kind][name] = make


def provider(kind: str, name: str, *args, **options):
    """A provider by name, made with the arguments given."""
    if name not in PROVIDERS[kind]:
        raise LookupError(f"no {kind} provider {name}; there are {', '.join(sorted(PROVIDERS[kind])) or 'none'}")
    return PROVIDERS[kind][name](*args, **options)
