"""Tables in the shared folder: written steps of iterative operators, published projections, and snapshots with an active pointer."""

from __future__ import annotations

import gc
import json
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commits import CommitLog, Conflict

#: Bytes of a row group of a published table: a lookup reads those whose range holds its key.
ROW_GROUP = 4 << 20
#: Bytes of a step's sources for each task that writes it.
STEP_BYTES = 64 << 20
#: Bytes of a published table's sources for each range of its order, so that a task sorts its range in memory whatever the table's size.
PUBLISHED_BYTES = 8 << 20
#: Bytes of one Arrow batch sent to a Python worker, so that very long texts don't pile up there.
ARROW_BATCH_BYTES = 4 << 20
#: Rows that a scan decodes at a time where texts are read: Spark's 4,096 of a few KB each are arrays of 16 to 32 MB for every open scan, and very long texts make them larger.
SCAN_ROWS = 256
#: Bytes of a row group of what is written where texts are read (so much a task holds while it writes and while it reads), of a page, and of one read. An array of half a
#: region of the heap (512 KB below 2 GB of it) gets whole regions in a row: many such arrays make the heap grow to its limit, however little of it is in use.
SMALL_FILES = {"parquet.block.size": 8 << 20, "parquet.page.size": 256 << 10, "parquet.read.allocation.size": 256 << 10, "parquet.hadoop.vectored.io.enabled": "false"}
#: Share of its limit that the driver's heap may hold after a step before its garbage is collected, and seconds from one such collection to the next at least.
HEAP_SHARE, COLLECT_SECONDS = 0.5, 5
#: Snapshots whose counts and digests a pointer holds.
KNOWN = 64
#: Sessions of a project, bytes of them together and of one.
MOST_SESSIONS, MOST_PROJECT_BYTES, MOST_SESSION_BYTES = 128, 1 << 30, 64 << 20
_folders: dict[str, str] = {}
_tables: dict[tuple[str, str, str], tuple[str, object]] = {}
_collected = float("-inf")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application below the cluster's spark.checkpoint.dir, a URI; it is removed when the application ends.

    Where the setting is unset a local session makes a folder; on a cluster that is an error, since executors would write to their own disks."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", "")
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="codelode-")
            spark.conf.set("spark.checkpoint.dir", base)
        if "://" not in base:  # a path of the cluster's default store
            fs, at = _fs(spark, base)
            whole = fs.makeQualified(at).toString()
            base = whole if "://" in whole else whole.replace(":", "://", 1)
        fs, at = _fs(spark, f"{base.rstrip('/')}/codelode-{app}")
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _folders[app] = f"{base.rstrip('/')}/codelode-{app}"
    return _folders[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> None:
    """Remove every step and published table of this application now, not only when it ends. DataFrames made of them can't be read any more."""
    folder = shared_folder(spark)
    for key in [k for k in _tables if k[0] == folder]:
        del _tables[key]
    fs, at = _fs(spark, folder)
    fs.delete(at, True)
    fs.mkdirs(at)


def source_bytes(df: DataFrame) -> int:
    """Bytes of the sources of a DataFrame, as Spark knows them before anything runs: files by their size; very many where a source has none (rows of the driver, RDDs)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def step_tasks(df: DataFrame) -> int:
    """How many tasks write df as a step at most: one for STEP_BYTES of its sources, so they grow with the data; of small steps one for each core, or for two shuffle partitions where these are more, so that they don't become very many tiny files."""
    spark = df.sparkSession
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    return min(max(least, -(-source_bytes(df) // STEP_BYTES)), (1 << 31) - 1)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes and a scan's batches by rows, and read and write files in small pieces: 10,000 rows of long texts would not fit a Python worker, nor 4,096 an executor's heap beside all else."""
    bounds = {"spark.sql.execution.arrow.maxBytesPerBatch": ARROW_BATCH_BYTES, "spark.sql.parquet.columnarReaderBatchSize": SCAN_ROWS} | SMALL_FILES
    for key, value in bounds.items():
        spark.conf.set(key, str(value))


def collect_garbage(spark: SparkSession) -> None:
    """Collect the driver's garbage where its heap has grown past HEAP_SHARE of its limit: plans, results and broadcast tables of steps that are over.

    A JVM takes what it may before it looks for what is left over, and gives memory back only after a whole collection. Python goes first, as its DataFrames hold the
    JVM's; shuffle files and broadcast blocks that nothing refers to any more go with them."""
    global _collected
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory() and time.monotonic() - _collected >= COLLECT_SECONDS:
        gc.collect()
        spark._jvm.java.lang.System.gc()
        _collected = time.monotonic()


def stored(df: DataFrame, name: str, tasks: int | None = None, compression: str | None = None) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here, and a lost executor costs no step before it.

    So many tasks write at most (see step_tasks), each one partition after another."""
    return stored_at(df, scratch(df.sparkSession, name), tasks, compression)


def stored_at(df: DataFrame, path: str, tasks: int | None = None, compression: str | None = None) -> DataFrame:
    """stored() at a path of its own."""
    schema = df.schema
    writer = df.coalesce(tasks or step_tasks(df)).write
    (writer.option("compression", compression) if compression else writer).parquet(path)
    collect_garbage(df.sparkSession)
    return df.sparkSession.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a path with all below it; one that isn't there is fine."""
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def files_mark(spark: SparkSession, folder: str) -> str:
    """What the files of a folder are now: their number, bytes and latest change. A table published from them is made anew once this changes."""
    fs, at = _fs(spark, folder)
    found = [(s.getPath().getName(), s.getLen() if s.isFile() else fs.getContentSummary(s.getPath()).getLength(), s.getModificationTime()) for s in fs.listStatus(at)]
    return f"{folder} {len(found)} {sum(n for _, n, _ in found)} {max((t for *_, t in found), default=0)}"


def published(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame], order: list[str | Column]) -> DataFrame:
    """make()'s rows, written once for an application and a source, in files and row groups that follow an order, so that a lookup by its first column reads few of them."""
    key = (shared_folder(spark), source, name)
    if key not in _tables:
        df, path = make(), scratch(spark, f"published-{name}")
        if order:
            parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-source_bytes(df) // PUBLISHED_BYTES), 1 << 14))
            df = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
        _tables[key] = path, df.schema
    path, schema = _tables[key]
    return spark.read.schema(schema).parquet(path)


def unique_ids(df: DataFrame, keys: list[str]) -> None:
    """Raise where two rows share a key."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate {', '.join(keys)}: {tuple(twice[0][:-1])}")


def content(df: DataFrame) -> list[Column]:
    """Aggregates that tell what a table holds, whatever the order of its rows: their number and the sum of their hashes (maps by their JSON)."""
    cells = [F.to_json(f.name) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in df.schema]
    row = F.xxhash64(*cells) if cells else F.lit(0).cast("bigint")
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")]


class SnapshotStore:
    """Immutable snapshots of named tables below a folder, and the one that is active of each project.

    A snapshot's tables are Parquet folders, written before the pointer moves. The pointer is the newest entry of the project's commit log:
    of two writers one fails, readers see the old or the new snapshot, and a writer that dies leaves what was active. The entry holds each
    table's rows and digest, taken while it was written; a table is held against them when it is first loaded."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._checked: set[tuple[str, str, str]] = set()

    def log(self, project: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.root}/pointers/{project}")

    def _pointer(self, project: str) -> tuple[int, dict] | None:
        return self.log(project).last()

    def publish(self, project: str, snapshot: str, tables: dict[str, DataFrame], expected: str | None = None) -> None:
        """Write every table sorted by id, refuse duplicate ids and an existing snapshot, then promote. A table's rows are counted and hashed as they are written."""
        held = {}
        for name, df in tables.items():
            ordered = df.repartitionByRange("id").sortWithinPartitions("id") if "id" in df.columns else df
            seen, path = Observation(), f"{self.root}/{project}/{snapshot}/{name}"
            ordered.observe(seen, *content(df)).write.mode("error").parquet(path)
            if "id" in df.columns:
                try:
                    unique_ids(self.spark.read.parquet(path), ["id"])
                except ValueError:
                    fs, at = _fs(self.spark, f"{self.root}/{project}/{snapshot}")
                    fs.delete(at, True)
                    raise
            held[name] = seen.get
        self.promote(project, snapshot, {name: x["rows"] for name, x in held.items()}, expected, {name: x["digest"] for name, x in held.items()})

    def promote(self, project: str, snapshot: str, counts: dict[str, int] | None = None, expected: str | None = None, digests: dict[str, str] | None = None) -> None:
        """Make a snapshot active. With expected, only while that one is; an error if it isn't, or if another writer moved the pointer meanwhile.

        A snapshot that was active before keeps the counts and digests of then, as far as the log still has them."""
        last, row = self._pointer(project) or (0, {})
        if expected is not None and row.get("snapshot_id") != expected:
            raise RuntimeError(f"the active snapshot of {project} is {row.get('snapshot_id')}, not {expected}")
        known = row.get("known", {})
        if counts is not None:
            known = known | {snapshot: {"counts": counts, "digests": digests or {}}}
        kept = dict(list(known.items())[-KNOWN:])
        try:
            self.log(project).append({"snapshot_id": snapshot, "known": kept | ({snapshot: known[snapshot]} if snapshot in known else {})}, last)
        except Conflict as e:
            raise RuntimeError(f"another writer moved the pointer of {project}") from e

    def active(self, project: str) -> str | None:
        found = self._pointer(project)
        return found[1]["snapshot_id"] if found else None

    def counts(self, project: str) -> dict[str, int]:
        """Rows of each table of the active snapshot, as they were written."""
        found = self._pointer(project)
        return found[1]["known"].get(found[1]["snapshot_id"], {}).get("counts", {}) if found else {}

    def load(self, project: str, table: str, verify: bool = True) -> DataFrame:
        """A table of the active snapshot; the pointer is read again after and the load repeated if it moved.

        verify: at its first load by this store the table must have the rows and the digest that the pointer holds, else an error."""
        while True:
            found = self._pointer(project)
            if found is None:
                raise LookupError(f"project {project} has no active snapshot")
            snapshot = found[1]["snapshot_id"]
            df = self.spark.read.parquet(f"{self.root}/{project}/{snapshot}/{table}")
            held = found[1]["known"].get(snapshot, {})
            if verify and table in held.get("digests", {}) and (project, snapshot, table) not in self._checked:
                rows, digest = df.agg(*content(df)).first()
                if (rows, digest) != (held["counts"][table], held["digests"][table]):
                    raise ValueError(f"{table} of snapshot {snapshot} isn't what was published: {rows} rows of {held['counts'][table]}, digest {digest} of {held['digests'][table]}")
                self._checked.add((project, snapshot, table))
            if self.active(project) == snapshot:
                return df

    def append_session(self, session: DataFrame, folder: str = "sessions") -> bool:
        """Add a runtime session (one project_id, session_id and source_sha256; else an error). False if it is there already; an error if it is there with other content.

        It is written aside and renamed, so of two writers one finds the other's."""
        keys = session.select("project_id", "session_id", "source_sha256").distinct().limit(2).collect()
        if len(keys) != 1:
            raise ValueError("a session has rows of exactly one project, session and source")
        key = keys[0]
        path = f"{self.root}/{folder}/project_id={key[0]}/session_id={key[1]}"
        fs, at = _fs(self.spark, path)

        def there() -> bool:
            if not fs.exists(at):
                return False
            if self.spark.read.parquet(path).filter(F.col("source_sha256") != key[2]).limit(1).count():
                raise ValueError(f"session {key[1]} is stored with other content")
            return True

        if there():
            return False
        _, aside = _fs(self.spark, f"{self.root}/aside/{uuid.uuid4().hex}")
        session.drop("project_id", "session_id").write.parquet(aside.toString())
        fs.mkdirs(at.getParent())
        moved = not fs.exists(at) and fs.rename(aside, at)
        _, inside = _fs(self.spark, f"{path}/{aside.getName()}")
        if moved and not fs.exists(inside):
            return True
        fs.delete(inside if moved else aside, True)
        there()
        return False


class SessionLog:
    """Runtime sessions appended in batches, each session once, within a project's bounds.

    A batch is a Parquet folder that counts once the commit log names it: a batch of a writer that died is never read. All checks of a
    batch are one aggregation of its rows and one join with the sessions that are stored, whatever the number of sessions."""

    def __init__(self, spark: SparkSession, root: str, most_sessions: int = MOST_SESSIONS, most_bytes: int = MOST_PROJECT_BYTES, most_session_bytes: int = MOST_SESSION_BYTES):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/commits")
        self.bounds = most_sessions, most_bytes, most_session_bytes

    def _at(self, kind: str, last: tuple[int, dict] | None, schema) -> DataFrame:
        paths = [f"{self.root}/{kind}/{b}" for b in (last[1]["batches"] if last else [])]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def append(self, sessions: DataFrame) -> DataFrame:
        """project_id, session_id, rows and already_present of each session of a batch, whose new ones are added.

        A session has one source_sha256. One that is stored with another, or with which a project would go beyond its bounds, is an error
        that adds nothing. Of two writers one repeats its checks against what the other added."""
        schema, listed = sessions.schema, "project_id string, session_id string, source_sha256 string, rows long, bytes long"
        keys = ["project_id", "session_id"]
        size = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sessions.columns])))
        here = stored(sessions.groupBy(*keys).agg(F.min("source_sha256").alias("source_sha256"), F.max("source_sha256").alias("_other"), F.count("*").alias("rows"), F.sum(size).alias("bytes")), "session-batch")
        if odd := here.filter("source_sha256 <> _other OR source_sha256 IS NULL OR project_id IS NULL OR session_id IS NULL").select(*keys).limit(1).collect():
            raise ValueError(f"session {odd[0][1]} of {odd[0][0]} has no single project, session and source")
        while True:
            last, batch = self.log.last(), uuid.uuid4().hex
            known = self._at("sessions", last, listed)
            both = here.drop("_other").join(known.select(*keys, F.col("source_sha256").alias("_stored")), keys, "left")
            if clash := both.filter("_stored <> source_sha256").select("session_id").limit(1).collect():
                raise ValueError(f"session {clash[0][0]} is stored with other content")
            new = both.filter("_stored IS NULL").drop("_stored")
            total = known.select("project_id", "bytes").union(new.select("project_id", "bytes")).groupBy("project_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("most"))
            over = total.join(new.select("project_id").distinct(), "project_id").filter((F.col("n") > self.bounds[0]) | (F.col("bytes") > self.bounds[1]) | (F.col("most") > self.bounds[2])).orderBy("project_id").limit(1).collect()
            if over:
                raise ValueError(f"project {over[0][0]} would have {over[0][1]} sessions of {over[0][2]} bytes, the largest of {over[0][3]}")
            new.select("project_id", "session_id", "source_sha256", "rows", "bytes").write.parquet(f"{self.root}/sessions/{batch}")
            sessions.join(self.spark.read.parquet(f"{self.root}/sessions/{batch}").select(*keys), keys, "left_semi").select(*sessions.columns).write.parquet(f"{self.root}/rows/{batch}")
            try:
                self.log.append({"batches": [*(last[1]["batches"] if last else []), batch], "schema": schema.json()}, last[0] if last else 0)
            except Conflict:
                for kind in ("sessions", "rows"):
                    fs, at = _fs(self.spark, f"{self.root}/{kind}/{batch}")
                    fs.delete(at, True)
                continue
            added = self.spark.read.schema(listed).parquet(f"{self.root}/sessions/{batch}").select(*keys, F.lit(True).alias("_new"))
            return here.join(added, keys, "left").select(*keys, "rows", F.col("_new").isNull().alias("already_present"))

    def load(self) -> DataFrame:
        """The rows of all committed sessions."""
        last = self.log.last()
        if last is None:
            raise LookupError("no session is stored")
        return self._at("rows", last, T.StructType.fromJson(json.loads(last[1]["schema"])))
