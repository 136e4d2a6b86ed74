"""Snapshots and vectors in a database over JDBC: the tables, statements in the dialects of PostgreSQL and Derby, and readers and writers that put every change into one transaction."""

from __future__ import annotations

import hashlib
import json
import os
import sqlite3
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..store import content, remove, scratch, source_bytes

SCHEMA_VERSION, BATCH = 1, 500
#: Parts into which a table's rows fall by a hash of their id, so that tasks read them side by side.
PARTS = 64
#: Bytes of the sources of each part's own database, and rows that are read or written at once.
PART_BYTES, ROWS = 4 << 20, 10_000


@dataclass(frozen=True)
class Dialect:
    """What differs between databases. types: of Spark's types, for columns and for those of a key; there: SQL states that say that something exists already."""

    types: dict[str, str]
    keys: dict[str, str]
    preamble: tuple[str, ...]
    guard: str
    there: tuple[str, ...] = ()
    options: tuple[tuple[str, str], ...] = ()
    staged_text: str = "text"
    vector_in: str = "{}"
    vector_out: str = "{}"


POSTGRESQL = Dialect(
    {"string": "text", "int": "integer", "bigint": "bigint", "double": "double precision", "boolean": "boolean", "timestamp": "timestamptz", "array<float>": "vector({dims})"}, {},
    ("CREATE EXTENSION IF NOT EXISTS vector", "CREATE SCHEMA IF NOT EXISTS {schema}"), "IF NOT EXISTS ", options=(("stringtype", "unspecified"),), vector_in="CAST({} AS vector)", vector_out="CAST({} AS text)",
)
DERBY = Dialect(
    {"string": "VARCHAR(32672)", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "array<float>": "CLOB"}, {"string": "VARCHAR(1024)"},
    ("CREATE SCHEMA {schema}",), "", there=("X0Y32", "X0Y68", "23505"), staged_text="CLOB",
)

#: The stored tables: columns in Spark's types, and the primary key.
TABLES: dict[str, tuple[str, list[str]]] = {
    "schema_version": ("version int", ["version"]),
    "snapshots": ("project_id string, snapshot_id string, sha256 string, created_at timestamp, contents string", ["project_id", "snapshot_id"]),
    "active_snapshots": ("project_id string, snapshot_id string", ["project_id"]),
    "symbols": ("project_id string, snapshot_id string, part int, id string, symbol_key string, module_id string, file_id string, kind string, name string, qualified_name string, signature string, language string, start_line int, start_column int, end_line int, external boolean, generated boolean", ["project_id", "snapshot_id", "id"]),
    "occurrences": ("project_id string, snapshot_id string, part int, id string, symbol_id string, file_id string, start_line int, start_column int, role string, resolution_status string", ["project_id", "snapshot_id", "id"]),
    "relationships": ("project_id string, snapshot_id string, part int, id string, source_type string, source_id string, target_type string, target_id string, unresolved_target string, kind string, resolution_status string, nature string, confidence double, file_id string, start_line int", ["project_id", "snapshot_id", "id"]),
    "semantic_indexes": ("project_id string, snapshot_id string, provider string, model string, dims int", ["project_id"]),
    "semantic_vectors": ("project_id string, stable_key string, kind string, checksum string, vector array<float>", ["project_id", "stable_key"]),
    "runtime_sessions": ("project_id string, session_id string, snapshot_id string, source_sha256 string", ["project_id", "session_id"]),
    "runs": ("id string, project_id string, status string, created_at timestamp, completed_at timestamp", ["id"]),
    "projects": ("project_id string, name string, root string, created_at timestamp", ["project_id"]),
    "workspaces": ("workspace_id string, tenant_id string, name string, status string, archived_at timestamp", ["workspace_id"]),
    "workspace_projects": ("workspace_id string, project_id string", ["workspace_id", "project_id"]),
    "fingerprints": ("project_id string, snapshot_id string, path string, sha string, size bigint", ["project_id", "snapshot_id", "path"]),
    "audit": ("tenant_id string, sequence bigint, occurred_at timestamp, action string, previous_hash string, hash string", ["tenant_id", "sequence"]),
}
INDEXES = {"symbols": ["file_id", "qualified_name"], "occurrences": ["symbol_id"], "relationships": ["source_id", "target_id"], "runs": ["project_id"]}


def columns(table: str) -> list[tuple[str, str]]:
    """Names and Spark types."""
    return [tuple(x.split(" ", 1)) for x in TABLES[table][0].split(", ")]


def _names(names: list[str], of: str = "") -> str:
    """Quoted, since databases reserve different words."""
    return ", ".join(f'{of}"{c}"' for c in names)


def _type(table: str, column: str, kind: str, dialect: Dialect, dims: int = 0) -> str:
    short = column in TABLES[table][1] or column in INDEXES.get(table, [])
    return (dialect.keys.get(kind) if short else None) or dialect.types[kind].format(dims=dims)


def _cells(table: str, dialect: Dialect, dims: int, staging: bool) -> str:
    """The columns of a table, or of one that tasks write into: there vectors are text, and texts what the database takes nulls as."""
    if staging:
        return ", ".join(f"{_names([c])} {dialect.staged_text if k in ('string', 'array<float>') else dialect.types[k]}" for c, k in columns(table))
    return ", ".join(f"{_names([c])} {_type(table, c, k, dialect, dims)}{' NOT NULL' if c in TABLES[table][1] else ''}" for c, k in columns(table))


def ddl(schema: str, dims: int = 384, dialect: Dialect = POSTGRESQL) -> list[str]:
    """The statements that make every table and index where there is none; a later version is never downgraded."""
    out = [s.format(schema=schema) for s in dialect.preamble]
    for table, (_, key) in TABLES.items():
        out.append(f"CREATE TABLE {dialect.guard}{schema}.{table} ({_cells(table, dialect, dims, False)}, PRIMARY KEY ({_names(key)}))")
    for table, names in INDEXES.items():
        out += [f"CREATE INDEX {dialect.guard}{table}_{c} ON {schema}.{table} ({_names([*TABLES[table][1][:-1], c])})" for c in names]
    if dialect is DERBY:
        return [*out, f"INSERT INTO {schema}.schema_version VALUES ({SCHEMA_VERSION})"]
    return [*out, f'INSERT INTO {schema}.schema_version SELECT {SCHEMA_VERSION} WHERE NOT EXISTS (SELECT 1 FROM {schema}.schema_version WHERE "version" >= {SCHEMA_VERSION})']


def merge_sql(schema: str, table: str, staging: str, dialect: Dialect = POSTGRESQL) -> str:
    """From a staging table into a table: rows whose key is new are added; one that is there already stays as it is."""

    def value(column: str, kind: str) -> str:
        cell = _names([column], "s.")
        if kind == "array<float>":
            return dialect.vector_in.format(cell)
        return f"CAST({cell} AS {_type(table, column, kind, dialect)})" if kind == "string" and dialect is DERBY else cell

    key, kinds = TABLES[table][1], dict(columns(table))
    into = f"INSERT INTO {schema}.{table} ({_names(list(kinds))}) SELECT {', '.join(value(c, k) for c, k in kinds.items())} FROM {schema}.{staging} s"
    if dialect is POSTGRESQL:
        return f"{into} ON CONFLICT ({_names(key)}) DO NOTHING"
    return f"{into} WHERE NOT EXISTS (SELECT 1 FROM {schema}.{table} t WHERE {' AND '.join(f'{_names([c], "t.")} = {value(c, kinds[c])}' for c in key)})"


def promote_sql(schema: str, dialect: Dialect = POSTGRESQL) -> list[str]:
    """Statements of (project, snapshot) that make a snapshot active."""
    insert = f'INSERT INTO {schema}.active_snapshots ("project_id", "snapshot_id") VALUES (?, ?)'
    if dialect is POSTGRESQL:
        return [f'{insert} ON CONFLICT ("project_id") DO UPDATE SET "snapshot_id" = EXCLUDED."snapshot_id"']
    return [f'DELETE FROM {schema}.active_snapshots WHERE "project_id" = ? AND "snapshot_id" <> ?', f'{insert[: insert.index("VALUES")]}SELECT p, s FROM (VALUES (CAST(? AS VARCHAR(1024)), CAST(? AS VARCHAR(1024)))) v (p, s) WHERE NOT EXISTS (SELECT 1 FROM {schema}.active_snapshots a WHERE a."project_id" = v.p)']


def vector_text(vector: str) -> F.Column:
    """A vector as the text that the vector type reads."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))


def staged(df: DataFrame, table: str) -> DataFrame:
    """df's rows with exactly a table's columns and types, vectors as text; a column that is missing is an error."""
    cells = [vector_text(c).alias(c) if kind == "array<float>" else F.col(c).cast(kind).alias(c) for c, kind in columns(table)]
    return df.select(*cells)


def _cells_in(table: str) -> str:
    """The columns of a part's own database; the key holds there as in the whole table, since rows fall into parts by it."""
    kinds = {"int": "INTEGER", "bigint": "INTEGER", "boolean": "INTEGER", "double": "REAL"}
    return ", ".join(f"{_names([c])} {kinds.get(k, 'TEXT')}{' NOT NULL' if c in TABLES[table][1] else ''}" for c, k in columns(table)) + f", PRIMARY KEY ({_names(TABLES[table][1])})"


def write_parts(rows: DataFrame, table: str, folder: str) -> None:
    """rows (see staged) as SQLite databases below folder, a URI that tasks reach: one for each part by a hash of the key, written by the task that has its rows. A key that repeats is an error.

    A database repeats project, snapshot and kinds in every row, so it is compressed as it goes to the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        own = tempfile.mkdtemp(prefix="codelode-part-")
        at = f"{own}/part.db"
        link = sqlite3.connect(at, isolation_level=None)
        try:
            for said in ("PRAGMA journal_mode = OFF", "PRAGMA synchronous = OFF", "PRAGMA cache_size = -32768", f"CREATE TABLE part ({_cells_in(table)}) WITHOUT ROWID", "BEGIN"):
                link.execute(said)
            n = 0
            for batch in batches:
                n += batch.num_rows
                link.executemany(f"INSERT INTO part VALUES ({', '.join('?' * batch.num_columns)})", zip(*[c.to_pylist() for c in batch.columns], strict=True))
            link.execute("COMMIT")
            link.close()
            if n:
                store, path = fs.FileSystem.from_uri(folder)
                store.create_dir(path, recursive=True)
                name = uuid.uuid4().hex
                with open(at, "rb") as source, store.open_output_stream(f"{path}/.{name}", compression="zstd") as out:
                    while piece := source.read(4 << 20):
                        out.write(piece)
                store.move(f"{path}/.{name}", f"{path}/{name}.db.zst")
                yield pa.RecordBatch.from_pydict({"name": [name], "rows": [n]}, pa.schema([("name", pa.string()), ("rows", pa.int64())]))
        finally:
            link.close()
            for left in os.listdir(own):
                os.remove(f"{own}/{left}")
            os.rmdir(own)

    spark, keys = rows.sparkSession, [F.col(c) for c in TABLES[table][1]]
    parts = max(spark.sparkContext.defaultParallelism, -(-source_bytes(rows) // PART_BYTES))
    done = rows.repartition(min(parts, 1 << 14), *keys).sortWithinPartitions(*keys).mapInArrow(run, "name string, rows long")
    # the parts of tasks that were tried twice aren't in the list
    done.write.parquet(f"{folder}/_parts")


def read_parts(spark: SparkSession, table: str, folder: str) -> DataFrame:
    """The rows that write_parts wrote, a part after another in each task, some thousand rows at once."""
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp": pa.string(), "array<float>": pa.string()}
    schema = pa.schema([(c, pa.int8() if k == "boolean" else kinds[k]) for c, k in columns(table)])
    wanted = pa.schema([(c, kinds[k]) for c, k in columns(table)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                own = tempfile.mkdtemp(prefix="codelode-part-")
                with store.open_input_stream(f"{path}/{name}.db.zst", compression="zstd") as source, open(f"{own}/part.db", "wb") as out:
                    while piece := source.read(4 << 20):
                        out.write(piece)
                link = sqlite3.connect(f"{own}/part.db")
                try:
                    found = link.execute(f"SELECT {_names([c for c, _ in columns(table)])} FROM part")
                    while rows := found.fetchmany(ROWS):
                        cells = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cells, wanted, strict=True)], schema=wanted)
                finally:
                    link.close()
                    os.remove(f"{own}/part.db")
                    os.rmdir(own)

    said = ", ".join(f"{c} {'string' if k in ('timestamp', 'array<float>') else k}" for c, k in columns(table))
    names = spark.read.schema("name string, rows long").parquet(f"{folder}/_parts").select("name")
    return names.repartition(max(1, min(names.count(), 1 << 14)), "name").mapInArrow(run, said)


class Database:
    """Tables of a schema in a database. Rows are written and read by tasks; what must hold together is one transaction of the driver.

    Derby needs no server and lives in the JVM that opens it, where the tasks of a cluster can't reach it. There it holds what a transaction
    decides (headers, pointers and the folders of tables), and the rows of a table are parts, SQLite databases of their own in the shared
    folder, which tasks write before the transaction and read after it. PostgreSQL's driver must be on the class path."""

    def __init__(self, spark: SparkSession, url: str, schema: str = "codelode", dims: int = 384, parted: bool | None = None):
        self.spark, self.url, self.schema, self.dims = spark, url, schema, dims
        self.dialect = DERBY if url.startswith("jdbc:derby:") else POSTGRESQL
        master = spark.sparkContext.master
        self.parted = self.dialect is DERBY and not (master == "local" or master.startswith("local[")) if parted is None else parted
        if self.dialect is DERBY:
            spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")

    def _options(self, **more) -> dict[str, str]:
        return {"url": self.url, "batchsize": str(BATCH)} | dict(self.dialect.options) | {k: str(v) for k, v in more.items()}

    def transaction(self, body: Callable[[Callable], None]) -> None:
        """body(run) with run(statement, *texts), which gives the rows of a query, in one transaction: all of it or nothing."""
        link = self.spark._jvm.java.sql.DriverManager.getConnection(self.url)

        def run(sql: str, *values: str) -> list[tuple]:
            call = link.prepareStatement(sql)
            try:
                for i, v in enumerate(values, 1):
                    call.setString(i, v)
                rows = []
                if call.execute():
                    found = call.getResultSet()
                    width = found.getMetaData().getColumnCount()
                    while found.next():
                        rows.append(tuple(found.getString(i + 1) for i in range(width)))
                return rows
            finally:
                call.close()

        try:
            link.setAutoCommit(False)
            link.setTransactionIsolation(8)  # serializable
            body(run)
            link.commit()
        except BaseException:
            link.rollback()
            raise
        finally:
            link.close()

    def migrate(self) -> None:
        """Make what is missing of the schema."""
        parted = [f'CREATE TABLE {self.schema}.parted ("name" VARCHAR(1024) NOT NULL PRIMARY KEY, "folder" VARCHAR(32672))'] if self.parted else []
        for statement in [*ddl(self.schema, self.dims, self.dialect), *parted]:
            try:
                self.transaction(lambda run, s=statement: run(s))
            except Exception as e:
                cause = getattr(e, "java_exception", None)
                if cause is None or not hasattr(cause, "getSQLState") or cause.getSQLState() not in self.dialect.there:
                    raise

    def _stage(self, df: DataFrame, table: str) -> tuple[str, dict]:
        """A staging table of its own with df's rows, and what they hold, seen as they were written. A writer that dies leaves this table alone behind."""
        name, seen, rows = f"staging_{table}_{uuid.uuid4().hex[:12]}", Observation(), staged(df, table)
        if self.parted:
            folder = scratch(self.spark, name)
            try:
                write_parts(rows.observe(seen, *content(rows.drop("part"))), table, folder)
            except BaseException:
                remove(self.spark, folder)
                raise
            return folder, seen.get
        self.transaction(lambda run: run(f"CREATE TABLE {self.schema}.{name} ({_cells(table, self.dialect, self.dims, True)})"))
        try:
            rows.observe(seen, *content(rows.drop("part"))).write.format("jdbc").options(**self._options(dbtable=f"{self.schema}.{name}")).mode("append").save()
        except BaseException:
            self._drop([name])
            raise
        return name, seen.get

    def _drop(self, names: list[str]) -> None:
        for name in names:
            if self.parted:
                remove(self.spark, name)
                continue
            self.transaction(lambda run, n=name: run(f"DROP TABLE {self.schema}.{n}"))

    def publish_snapshot(self, project: str, snapshot: str, tables: dict[str, DataFrame]) -> bool:
        """Store a snapshot's tables and make it active; False if it is stored already with the same content, which is then made active again.

        Tasks write into staging tables; one transaction then looks for a snapshot of that name, whose other content is an error that
        leaves everything as it was, merges the rows and moves the pointer."""
        names, contents, stored_already = {}, {}, []
        try:
            header: list[tuple] = []
            self.transaction(lambda run: header.extend(run(f'SELECT "sha256" FROM {self.schema}.snapshots WHERE "project_id" = ? AND "snapshot_id" = ?', project, snapshot)))
            for table, df in tables.items():
                part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")
                rows = df.withColumns({"project_id": F.lit(project), "snapshot_id": F.lit(snapshot), "part": part})
                if header and self.parted:  # nothing of it will be stored, so it is only looked at
                    own = staged(rows, table).drop("part")
                    contents[table] = own.agg(*content(own)).first().asDict()
                else:
                    names[table], contents[table] = self._stage(rows, table)
            said = json.dumps(contents, sort_keys=True)
            sha = hashlib.sha256(said.encode()).hexdigest()

            def merge(run: Callable) -> None:
                known = run(f'SELECT "sha256" FROM {self.schema}.snapshots WHERE "project_id" = ? AND "snapshot_id" = ?', project, snapshot)
                if known and known[0][0] != sha:
                    raise ValueError(f"snapshot {snapshot} of {project} is stored with other content")
                if not known:
                    if len(names) < len(tables):
                        raise RuntimeError(f"snapshot {snapshot} of {project} was removed meanwhile")
                    run(f"INSERT INTO {self.schema}.snapshots ({_names([c for c, _ in columns('snapshots')])}) VALUES (?, ?, ?, CURRENT_TIMESTAMP, ?)", project, snapshot, sha, said)
                    for table, staging in names.items():
                        if self.parted:
                            self._point(run, f"{table} {project} {snapshot}", staging)
                        else:
                            run(merge_sql(self.schema, table, staging, self.dialect))
                for statement in promote_sql(self.schema, self.dialect):
                    run(statement, project, snapshot)
                stored_already.append(bool(known))

            self.transaction(merge)
        finally:
            if not self.parted or not stored_already or stored_already[0]:
                self._drop(list(names.values()))
        return not stored_already[0]

    def _point(self, run: Callable, table: str, folder: str) -> str | None:
        """Make a folder of parts the rows of a table, and give the one that was."""
        (before,) = run(f'SELECT "folder" FROM {self.schema}.parted WHERE "name" = ?', table) or [(None,)]
        run(f'DELETE FROM {self.schema}.parted WHERE "name" = ?', table)
        run(f'INSERT INTO {self.schema}.parted ("name", "folder") VALUES (?, ?)', table, folder)
        return before[0]

    def _folder(self, table: str) -> str | None:
        rows: list[tuple] = []
        self.transaction(lambda run: rows.extend(run(f'SELECT "folder" FROM {self.schema}.parted WHERE "name" = ?', table)))
        return rows[0][0] if rows else None

    def active(self, project: str) -> tuple[str, dict] | None:
        """The project's active snapshot and what its tables hold."""
        rows: list[tuple] = []
        self.transaction(lambda run: rows.extend(run(f'SELECT {_names(["snapshot_id", "contents", "sha256"], "s.")} FROM {self.schema}.active_snapshots a JOIN {self.schema}.snapshots s ON s."project_id" = a."project_id" AND s."snapshot_id" = a."snapshot_id" WHERE a."project_id" = ?', project)))
        if not rows:
            return None
        snapshot, said, sha = rows[0]
        if hashlib.sha256(said.encode()).hexdigest() != sha:
            raise ValueError(f"the header of snapshot {snapshot} of {project} isn't what was published")
        return snapshot, json.loads(said)

    def load_snapshot(self, project: str, table: str, verify: bool = True) -> DataFrame:
        """A table of the project's active snapshot, read in parts; the database filters. verify: it must hold what was published, else an error."""
        found = self.active(project)
        if found is None:
            raise LookupError(f"project {project} has no active snapshot")
        if self.parted:
            df = read_parts(self.spark, table, self._folder(f"{table} {project} {found[0]}"))
        else:
            df = self._read_snapshot(project, table, found[0])
        df = df.select(*[F.col(c).cast(kind).alias(c) for c, kind in columns(table)]).drop("part")
        if verify:
            rows, digest = df.agg(*content(df)).first()
            if {"rows": rows, "digest": digest} != found[1][table]:
                raise ValueError(f"{table} of snapshot {found[0]} isn't what was published")
        return df

    def _read_snapshot(self, project: str, table: str, snapshot: str) -> DataFrame:
        quoted = lambda v: "'" + v.replace("'", "''") + "'"
        mine = f'SELECT {_names([c for c, _ in columns(table)])} FROM {self.schema}.{table} WHERE "project_id" = {quoted(project)} AND "snapshot_id" = {quoted(snapshot)}'
        split = {"partitionColumn": "part", "lowerBound": 0, "upperBound": PARTS, "numPartitions": min(PARTS, self.spark.sparkContext.defaultParallelism)}
        return self.spark.read.format("jdbc").options(**self._options(dbtable=f"({mine}) q", **split)).load()

    def replace_vectors(self, project: str, index: DataFrame) -> None:
        """The project's vectors deleted and those of index (stable_key, kind, checksum, vector) inserted, in one transaction behind a staging table."""
        name, _ = self._stage(index.withColumn("project_id", F.lit(project)), "semantic_vectors")

        stale = [name]

        def swap(run: Callable) -> None:
            if self.parted:
                before = self._point(run, f"semantic_vectors {project}", name)
                stale[:] = [before] if before else []
                return
            run(f'DELETE FROM {self.schema}.semantic_vectors WHERE "project_id" = ?', project)
            run(merge_sql(self.schema, "semantic_vectors", name, self.dialect))

        try:
            self.transaction(swap)
        except BaseException:
            self._drop([name])
            raise
        self._drop(stale)

    def load_vectors(self, project: str) -> DataFrame:
        """stable_key, kind, checksum and vector of the project's index."""
        if self.parted:
            folder = self._folder(f"semantic_vectors {project}")
            df = read_parts(self.spark, "semantic_vectors", folder) if folder else self.spark.createDataFrame([], "stable_key string, kind string, checksum string, vector string")
            return df.select("stable_key", "kind", "checksum", F.from_json("vector", "array<float>").alias("vector"))
        quoted = project.replace("'", "''")
        mine = f"""SELECT "stable_key", "kind", "checksum", {self.dialect.vector_out.format('"vector"')} AS "vector" FROM {self.schema}.semantic_vectors WHERE "project_id" = '{quoted}'"""
        df = self.spark.read.format("jdbc").options(**self._options(dbtable=f"({mine}) q")).load().toDF("stable_key", "kind", "checksum", "vector")
        return df.withColumn("vector", F.from_json("vector", "array<float>"))
