"""A log of small commits in a folder: one file for each, whole or not there, of two writers of the same one only the first."""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer committed first."""


class CommitLog:
    """Numbered entries below a folder, the newest of which is what holds.

    An entry is written aside, ends with the digest of what stands before it, and is moved to its number only if no file has it: by a hard
    link in a local folder, elsewhere by the store's rename, which HDFS makes atomic (an object store without such a rename needs one
    writer at a time). A reader takes the newest entry whose digest holds, so a writer that dies at any point harms nobody, even where its
    file is in place and torn. Of old entries KEEP stay."""

    KEEP = 8

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        at = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.folder = self.fs.makeQualified(at).toString()
        self.local = self.folder.removeprefix("file:").replace("//", "", 1) if self.folder.startswith("file:///") else self.folder.removeprefix("file:") if self.folder.startswith("file:") else None

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def numbers(self) -> list[int]:
        """Numbers that a file has, whole or torn, in order."""
        at = self._path(".")
        if not self.fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(at)]
        return sorted(int(n) for n in names if n.isdigit())

    def read(self, number: int) -> dict | None:
        """An entry, or None if it is torn or gone."""
        try:
            stream = self.fs.open(self._path(f"{number:012d}"))
        except Exception:
            if number in self.numbers():
                raise
            return None
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        body, _, digest = text.rpartition("\n")
        return json.loads(body) if hashlib.sha256(body.encode()).hexdigest() == digest else None

    def last(self) -> tuple[int, dict] | None:
        """The newest whole entry and its number."""
        while True:
            numbers = self.numbers()
            for n in reversed(numbers):
                if (row := self.read(n)) is not None:
                    return n, row
            if numbers == self.numbers():  # else entries went while they were read, since newer ones came
                return None

    def write_aside(self, row: dict) -> str:
        """The name of a new file that holds row and is no entry yet."""
        body = json.dumps(row, sort_keys=True)
        data, name = f"{body}\n{hashlib.sha256(body.encode()).hexdigest()}".encode(), f"aside-{uuid.uuid4().hex}"
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            with open(f"{self.local}/{name}", "wb") as out:
                out.write(data)
                out.flush()
                os.fsync(out.fileno())
        else:
            out = self.fs.create(self._path(name), False)
            out.write(bytearray(data))
            out.close()
        return name

    def move(self, name: str, number: int) -> None:
        """Make a file that was written aside an entry; Conflict if its number is taken."""
        try:
            if self.local is not None:
                os.link(f"{self.local}/{name}", f"{self.local}/{number:012d}")
            else:
                context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
                options = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                context.rename(self._path(name), self._path(f"{number:012d}"), options)
        except Exception as e:
            if self.fs.exists(self._path(f"{number:012d}")):
                raise Conflict(f"commit {number} of {self.folder} is another writer's") from e
            raise
        finally:
            self.fs.delete(self._path(name), False)

    def append(self, row: dict, after: int) -> int:
        """Commit row, if no entry came after that number; else Conflict. Files of torn entries don't count."""
        numbers = self.numbers()
        if any(self.read(n) is not None for n in numbers if n > after):
            raise Conflict(f"{self.folder} has commits after {after}")
        number = max([after, *numbers]) + 1
        self.move(self.write_aside(row), number)
        for old in numbers[: -self.KEEP]:
            self.fs.delete(self._path(f"{old:012d}"), False)
        return number
