"""In-house text formats: runtime observations, program-graph sidecars, security rules."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDGE_KINDS, NODE_KINDS

MAX_BYTES, MAX_OBSERVATIONS, MAX_NODES, MAX_EDGES = 64 << 20, 1_000_000, 100_000, 500_000
#: The metadata lines of a session file, in order, behind its first line, the format's name.
METADATA = ["session", "project", "snapshot", "started", "ended", "collector", "environment", "completeness"]
FORMAT = "runtime-observations-v1"

OBSERVATIONS = "session_id string, project_id string, snapshot_id string, started_at string, ended_at string, collector string, environment string, line_number int, type string, source_key string, source_name string, source_file string, source_line int, target_key string, target_name string, target_file string, target_line int, hits long, nanos long"


def parse_session(text: str, formats: tuple[str, ...] = (FORMAT,)) -> list[dict]:
    """The observations of one file with its metadata on each; anything out of place is an error that names the line."""
    return list(session_rows(text, formats))


def session_rows(text: str, formats: tuple[str, ...] = (FORMAT,)) -> Iterator[dict]:
    """parse_session one observation after another: a file's rows are never held together."""
    if text.startswith("\ufeff"):
        raise ValueError("a byte order mark leads the file")
    lines = [x.removesuffix("\r") for x in text.removesuffix("\n").split("\n")]
    if "" in lines:
        raise ValueError(f"line {lines.index('') + 1} is blank")
    if len(lines) <= 1 + len(METADATA):
        raise ValueError("the file has no observations")
    if len(lines) - 1 - len(METADATA) > MAX_OBSERVATIONS:
        raise ValueError(f"the file has more than {MAX_OBSERVATIONS} observations")
    if lines[0] not in formats:
        raise ValueError("line 1: unknown format")
    meta = {}
    for k, name in enumerate(METADATA):
        cells = lines[k + 1].split("\t")
        if cells[0] != name or len(cells) != (3 if name == "collector" else 2) or not all(c.strip() for c in cells):
            raise ValueError(f"line {k + 2}: expected {name}")
        meta[name] = " ".join(cells[1:])
    if meta["completeness"] != "PARTIAL":
        raise ValueError("line 9: completeness must be PARTIAL")
    head = {"session_id": meta["session"], "project_id": meta["project"], "snapshot_id": meta["snapshot"], "started_at": meta["started"], "ended_at": meta["ended"], "collector": meta["collector"], "environment": meta["environment"]}

    def number(cell: str, least: int, at: int) -> int:
        if not cell.isdigit() or int(cell) < least:
            raise ValueError(f"line {at}: expected a number of at least {least}")
        return int(cell)

    def end(cells: list[str], name: str, at: int) -> dict:
        key, qualified, file, line = (c or None for c in cells)
        if not (key or qualified or file):
            raise ValueError(f"line {at}: a reference names nothing")
        return {f"{name}_key": key, f"{name}_name": qualified, f"{name}_file": file, f"{name}_line": number(line, 1, at) if line else None}

    columns = [x.split()[0] for x in OBSERVATIONS.split(", ")]
    for at, raw in enumerate(itertools.islice(lines, 1 + len(METADATA), None), 2 + len(METADATA)):
        cells = raw.split("\t")
        want = {"symbol": 7, "call": 11, "line": 4}.get(cells[0])
        if want != len(cells):
            raise ValueError(f"line {at}: unknown kind or wrong number of fields")
        row = dict.fromkeys(columns) | head | {"line_number": at}
        if cells[0] == "line":
            row |= end(["", "", *cells[1:3]], "source", at) | {"type": "LINE_COVERAGE", "hits": number(cells[3], 1, at), "nanos": 0}
        else:
            row |= end(cells[1:5], "source", at) | {"type": "SYMBOL_EXECUTION" if cells[0] == "symbol" else "CALL", "hits": number(cells[-2], 1, at), "nanos": number(cells[-1], 0, at)}
            if cells[0] == "call":
                row |= end(cells[5:9], "target", at)
        yield row


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The observations of every session file below path, with the SHA-256 of the file. A file over 64 MiB or with an error fails the read."""
    files = spark.read.format("binaryFile").load(path)
    size = F.when(F.col("length").between(1, MAX_BYTES), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("a session file must have 1 byte to 64 MiB: "), "path")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in OBSERVATIONS.split(", ")]
        for batch in batches:
            for content, sha in zip(batch["content"], batch["sha"], strict=True):
                rows = parse_session(bytes(content).decode("utf-8"))
                yield pd.DataFrame(rows, columns=names).astype({"source_line": "Int32", "target_line": "Int32"}).assign(source_sha256=sha)

    return files.select(size.alias("content"), F.sha2("content", 256).alias("sha")).mapInPandas(run, OBSERVATIONS + ", source_sha256 string")


def read_properties(text: str) -> dict[str, str]:
    out = {}
    for raw in text.splitlines():
        line = raw.strip()
        if line and line[0] not in "#!":
            key, _, value = line.replace(":", "=", 1).partition("=") if "=" not in line else line.partition("=")
            out[key.strip()] = value.strip()
    return out


def security_rules(text: str) -> dict[str, list[str]]:
    """Names of source, sink and sanitizer calls of a project's rules."""
    found = read_properties(text)
    return {k: sorted({x.strip() for x in found.get(k, "").split(",") if x.strip()}) for k in ("sources", "sinks", "sanitizers")}


NODES = ["id", "symbol_id", "kind", "label", "file_id", "start_line", "start_column", "end_line", "end_column", "position_encoding"]
EDGES = ["id", "source_node_id", "target_node_id", "kind"]


def read_program_graph(spark: SparkSession, folder: str, snapshot: str, symbols: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Nodes, edges and limitations of a sidecar folder (metadata.properties, nodes.tsv, edges.tsv). Of another snapshot it is stale and gives nothing; unknown kinds, symbols or ends, repeated ids and too many rows are errors."""
    meta = read_properties("\n".join(r[0] for r in spark.read.text(f"{folder}/metadata.properties").collect()))  # a few lines
    read = lambda name, columns: spark.read.option("comment", "#").csv(f"{folder}/{name}", sep="\t", header=True, schema=", ".join(f"{c} string" for c in columns), mode="FAILFAST", enforceSchema=False)
    nodes, edges = read("nodes.tsv", NODES), read("edges.tsv", EDGES)
    if meta.get("snapshotId") != snapshot:
        return nodes.limit(0), edges.limit(0), ["SIDECAR_STALE_SNAPSHOT"]
    problems = [
        ("nodes exceed their limit", nodes.limit(MAX_NODES + 1).groupBy().count().filter(F.col("count") > MAX_NODES)),
        ("edges exceed their limit", edges.limit(MAX_EDGES + 1).groupBy().count().filter(F.col("count") > MAX_EDGES)),
        ("a node id repeats", nodes.groupBy("id").count().filter("count > 1")), ("an edge id repeats", edges.groupBy("id").count().filter("count > 1")),
        ("a kind is unknown", nodes.filter(~F.col("kind").isin(NODE_KINDS)).select("id").union(edges.filter(~F.col("kind").isin(EDGE_KINDS)).select("id"))),
        ("a node's symbol is unknown", nodes.filter("symbol_id IS NOT NULL").join(symbols.select(F.col("id").alias("symbol_id")), "symbol_id", "left_anti")),
        ("an edge's end is unknown", edges.select(F.explode(F.array("source_node_id", "target_node_id")).alias("id")).join(nodes.select("id"), "id", "left_anti")),
    ]
    for what, found in problems:
        if not found.isEmpty():
            raise ValueError(f"program graph: {what}")
    return nodes, edges, ["SIDECAR_FACTS_PROVIDER_ASSERTED"]
