"""A tree of files as a Spark data source: read in pieces by tasks, hashed as it is read, never leaving its root."""

from __future__ import annotations

import codecs
import fnmatch
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes read at a time, and of small files that one task reads together.
CHUNK, PACK = 4 << 20, 128 << 20
FORMAT = "codelode_tree"
_SCHEMAS = {"files": "path string, size long, sha string", "lines": "path string, size long, line int, text string", "pieces": "path string, size long, piece int, data binary"}


@dataclass
class Files(InputPartition):
    """What one task reads: paths below the root, with their sizes."""

    files: list[tuple[str, int]]


def _store(root: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
    return store, path.rstrip("/")


def _is_link(store: fs.FileSystem, path: str) -> bool:
    import os

    return isinstance(store, fs.LocalFileSystem) and os.path.islink(path)


def _confined(store: fs.FileSystem, root: str, path: str) -> str:
    """A path below root, none of whose parts is a link or leads out; else an error."""
    parts = path.split("/")
    if path.startswith("/") or any(p in ("", ".", "..") for p in parts) or "\\" in path:
        raise ValueError(f"{path} is outside the tree")
    for i in range(len(parts)):
        if _is_link(store, f"{root}/{'/'.join(parts[: i + 1])}"):
            raise ValueError(f"{path} goes through a link")
    return f"{root}/{path}"


def listed(root: str) -> list[tuple[str, int]]:
    """Paths and sizes of a tree's files in order, folder by folder; links aren't followed."""
    store, base = _store(root)
    out, folders = [], [base]
    while folders:
        for x in store.get_file_info(fs.FileSelector(folders.pop(), recursive=False)):
            if _is_link(store, x.path):
                continue
            if x.type == fs.FileType.Directory:
                folders.append(x.path)
            elif x.type == fs.FileType.File:
                out.append((x.path.removeprefix(base).lstrip("/"), x.size))
    return sorted(out)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.kind = options["path"], options.get("kind", "files")
        self.chunk, self.pack = int(options.get("chunk", CHUNK)), int(options.get("pack", PACK))
        self.pattern, self.most = options.get("pattern", "*"), int(options.get("most", 1 << 62))
        self.named = options["only"].split("\n") if options.get("only") else None

    def partitions(self) -> list[Files]:
        """A large file is a task of its own; small ones are packed."""
        store, base = _store(self.root)
        if self.named is not None:
            found = [(p, store.get_file_info(_confined(store, base, p)).size) for p in self.named]
        else:
            found = listed(self.root)
        out, now, size = [], [], 0
        for path, n in found:
            if n > self.most or not fnmatch.fnmatchcase(path.rpartition("/")[2], self.pattern):
                continue
            if now and size + n > self.pack:
                out.append(Files(now))
                now, size = [], 0
            now.append((path, n))
            size += n
        return [*out, Files(now)] if now else out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, base = _store(self.root)
        for path, size in partition.files:
            with store.open_input_stream(_confined(store, base, path), compression=None) as stream:
                yield from getattr(self, f"_{self.kind}")(path, size, stream)

    def _chunks(self, stream) -> Iterator[bytes]:
        while block := stream.read(self.chunk):
            yield block

    def _files(self, path: str, _: int, stream) -> Iterator[tuple]:
        digest, size = hashlib.sha256(), 0
        for block in self._chunks(stream):
            digest.update(block)
            size += len(block)
        yield path, size, digest.hexdigest()

    def _pieces(self, path: str, size: int, stream) -> Iterator[tuple]:
        for i, block in enumerate(self._chunks(stream)):
            yield path, size, i, block

    def _lines(self, path: str, size: int, stream) -> Iterator[tuple]:
        """Lines as \\n, \\r\\n and \\r end them, decoded piece by piece; what isn't UTF-8 becomes the replacement character."""
        decoder, rest, number = codecs.getincrementaldecoder("utf-8")("replace"), "", 0
        for block in self._chunks(stream):
            text = rest + decoder.decode(block)
            held = text.endswith("\r")  # a line feed may follow
            *whole, rest = re.split("\r\n|\n|\r", text[: len(text) - held])
            rest += "\r" * held
            for line in whole:
                number += 1
                yield path, size, number, line
        for line in re.split("\r\n|\n|\r", rest + decoder.decode(b"", True)):
            number += 1
            yield path, size, number, line


class Tree(DataSource):
    """format("codelode_tree").load(root): files with sizes and digests, or with kind lines or pieces what is in them."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("kind", "files")]

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def read(spark: SparkSession, root: str, lines: bool = False, pieces: bool = False, pattern: str = "*", most: int | None = None, paths: list[str] | None = None, chunk: int = CHUNK, pack: int = PACK) -> DataFrame:
    """The files of a tree: path, size and sha; or path, size and the lines (from 1); or path, size and pieces of chunk bytes.

    No file is held whole, however large. A file's name must fit pattern and its size be at most most; these are decided before a task is
    made. paths: only these, which must lie in the tree and behind no link, else an error. A file beyond pack bytes is a task of its own."""
    store, base = _store(root)
    for path in paths or []:
        _confined(store, base, path)
    spark.dataSource.register(Tree)
    options = {"kind": "lines" if lines else "pieces" if pieces else "files", "pattern": pattern, "chunk": str(chunk), "pack": str(pack)}
    options |= ({"most": str(most)} if most is not None else {}) | ({"only": "\n".join(paths)} if paths else {})
    return spark.read.format(FORMAT).options(**options).load(root)
