"""SCIP indexes: a reader of the public protobuf format, and facts from what it holds."""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import stable_id
from ..store import small_batches, source_bytes

# --- the wire format -------------------------------------------------------------------------------------------------


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    if (b := data[at]) < 0x80:
        return b, at + 1
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """Field numbers and raw values of a message: numbers for varints and fixed widths, slices for what has a length."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("a field reaches beyond its message")
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = int.from_bytes(data[at : at + size], "little"), at + size
        else:
            raise ValueError(f"wire type {kind} is not supported")
        yield tag >> 3, value


def _text(value) -> str:
    return bytes(value).decode("utf-8")


def _ints(values: list) -> list[int]:
    """A repeated int32, packed or not."""
    out = []
    for v in values:
        if isinstance(v, int):
            out.append(v)
        else:
            at = 0
            while at < len(v):
                n, at = _varint(v, at)
                out.append(n)
    return [n - (1 << 64) if n >> 63 else n for n in out]


def _grouped(data: memoryview) -> dict[int, list]:
    out: dict[int, list] = {}
    for number, value in fields(data):
        out.setdefault(number, []).append(value)
    return out


def _relationship(data: memoryview) -> dict:
    f = _grouped(data)
    flag = lambda n: bool(f.get(n, [0])[-1])
    return {"symbol": _text(f.get(1, [b""])[-1]), "is_reference": flag(2), "is_implementation": flag(3), "is_type_definition": flag(4), "is_definition": flag(5)}


def _symbol(data: memoryview) -> dict:
    f = _grouped(data)
    signature = _grouped(f[7][-1]) if 7 in f else {}
    return {
        "symbol": _text(f.get(1, [b""])[-1]), "kind": f.get(5, [0])[-1], "display_name": _text(f.get(6, [b""])[-1]), "signature": _text(signature.get(5, [b""])[-1]), "signature_language": _text(signature.get(4, [b""])[-1]),
        "enclosing_symbol": _text(f.get(8, [b""])[-1]), "relationships": [_relationship(r) for r in f.get(4, [])],
    }


def _occurrence(data: memoryview) -> dict:
    f = _grouped(data)
    return {"range": _ints(f.get(1, [])), "symbol": _text(f.get(2, [b""])[-1]), "roles": f.get(3, [0])[-1]}


def _document(data: memoryview, position: int) -> dict:
    f = _grouped(data)
    return {"position": position, "relative_path": _text(f.get(1, [b""])[-1]), "language": _text(f.get(4, [b""])[-1]), "encoding": f.get(6, [0])[-1], "occurrences": [_occurrence(o) for o in f.get(2, [])], "symbols": [_symbol(s) for s in f.get(3, [])], "external": False}


def _outside(symbols: list[dict], position: int) -> dict:
    return {"position": position, "relative_path": "", "language": "", "encoding": 0, "occurrences": [], "symbols": symbols, "external": True}


def decode(data: bytes) -> list[dict]:
    """The index's documents in order; symbols from outside as a last document without a path."""
    out, external = [], []
    for number, value in fields(memoryview(data)):
        if number == 2:
            out.append(_document(value, len(out)))
        elif number == 3:
            external.append(_symbol(value))
    return [*out, _outside(external, len(out))]


_REL = "array<struct<symbol: string, is_reference: boolean, is_implementation: boolean, is_type_definition: boolean, is_definition: boolean>>"
_SYMBOLS = f"array<struct<symbol: string, kind: int, display_name: string, signature: string, signature_language: string, enclosing_symbol: string, relationships: {_REL}>>"
DOCUMENTS = f"index string, position int, relative_path string, language string, encoding int, external boolean, occurrences array<struct<range: array<int>, symbol: string, roles: int>>, symbols {_SYMBOLS}"


#: Bytes of an index file that a task reads at once (one document, if larger), and of what it gives on at once.
SPAN, GIVEN = 8 << 20, 1 << 20
#: Positions of an index that a file of it holds at most.
PART = 8192
_PART = re.compile(r"\.from-(\d{10})(?=\.scip$)")


def _entries(source, size: int) -> Iterator[tuple[int, int, int]]:
    """Numbers, starts and ends of a file's outermost fields; only their heads are read."""
    at = 0
    while at < size:
        source.seek(at)
        head = memoryview(source.read(20))
        try:
            tag, k = _varint(head, 0)
            value, k = _varint(head, k) if tag & 7 in (0, 2) else (0, k)
        except IndexError:
            raise ValueError("an index ends inside a field") from None
        if tag & 7 not in (0, 1, 2, 5):
            raise ValueError(f"wire type {tag & 7} is not supported")
        end = at + k + {0: 0, 1: 8, 2: value, 5: 4}[tag & 7]
        if end > size:
            raise ValueError("a field reaches beyond its message")
        yield tag >> 3, at, end
        at = end


def _spans(source, size: int, whole: bool) -> Iterator[tuple[int, int, int, int]]:
    """Consecutive fields of a file as spans: start, bytes, documents before it, and the position of its symbols from outside (-1: it has none). A whole index has such a position always."""
    spans, n = [], 0
    for number, start, end in _entries(source, size):
        if not spans or end - spans[-1][0] > SPAN:
            spans.append([start, 0, n, False])
        spans[-1][1], spans[-1][3] = end - spans[-1][0], spans[-1][3] or number == 3
        n += number == 2
    if whole and spans and not any(x[3] for x in spans):
        spans[-1][3] = True
    k = 0
    for start, length, before, outside in spans:
        yield start, length, before, n + k if outside else -1
        k += outside


def _opened(path: str):
    from pyarrow import fs

    store, at = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row a document of every index file below path, a URI that tasks reach; a file that is cut short or isn't an index is an error.

    Files that write_index gave one index are one index, with the positions that were written. Whatever a file's size, its documents are
    read by many tasks, a span of them at a time; symbols from outside are a last document of each span that has some."""
    rel = pa.list_(pa.struct([("symbol", pa.string()), *((n, pa.bool_()) for n in ("is_reference", "is_implementation", "is_type_definition", "is_definition"))]))
    symbol = pa.struct([("symbol", pa.string()), ("kind", pa.int32()), ("display_name", pa.string()), ("signature", pa.string()), ("signature_language", pa.string()), ("enclosing_symbol", pa.string()), ("relationships", rel)])
    occurrence = pa.struct([("range", pa.list_(pa.int32())), ("symbol", pa.string()), ("roles", pa.int32())])
    schema = pa.schema([("index", pa.string()), ("position", pa.int32()), ("relative_path", pa.string()), ("language", pa.string()), ("encoding", pa.int32()), ("external", pa.bool_()), ("occurrences", pa.list_(occurrence)), ("symbols", pa.list_(symbol))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _opened(name) as source:
                    spans = [(name, *x) for x in _spans(source, size, not _PART.search(name))]
                yield pa.RecordBatch.from_pydict(dict(zip(("path", "start", "bytes", "before", "outside"), map(list, zip(*spans)), strict=True)))

    def rows(span: dict) -> Iterator[tuple[int, dict]]:
        part = _PART.search(span["path"])
        base, index = int(part[1]) if part else 0, _PART.sub("", span["path"])
        with _opened(span["path"]) as source:
            source.seek(span["start"])
            data = memoryview(source.read(span["bytes"]))
        position, external = base + span["before"], []
        for number, value in fields(data):
            if number == 2:
                yield len(value), {"index": index, **_document(value, position)}
                position += 1
            elif number == 3:
                external.append(_symbol(value))
        if span["outside"] >= 0:
            yield len(data), {"index": index, **_outside(external, base + span["outside"])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for n, row in (x for span in batch.to_pylist() for x in rows(span)):
                held.append(row)
                size += n
                if size >= GIVEN:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    found = spark.read.format("binaryFile").load(path).select("path", "length")
    tasks = max(spark.sparkContext.defaultParallelism, -(-source_bytes(found) // (4 * SPAN)))
    return found.mapInArrow(split, "path string, start long, bytes long, before long, outside long").repartition(tasks).mapInArrow(run, DOCUMENTS)


def _varint_bytes(n: int) -> bytes:
    if 0 <= n <= 0x7F:
        return bytes((n,))
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | str | bytes) -> bytes:
    """A field as it is written; nothing for zero and empty values."""
    if not value:
        return b""
    if isinstance(value, int):
        return _varint_bytes(number << 3) + _varint_bytes(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint_bytes(number << 3 | 2) + _varint_bytes(len(raw)) + raw


def _symbol_bytes(s: dict) -> bytes:
    flags = ("is_reference", "is_implementation", "is_type_definition", "is_definition")
    related = b"".join(_field(4, _field(1, r["symbol"]) + b"".join(_field(k, int(bool(r[f]))) for k, f in enumerate(flags, 2))) for r in s["relationships"] or [])
    signature = _field(4, s["signature_language"] or "") + _field(5, s["signature"] or "")
    return _field(1, s["symbol"]) + related + _field(5, s["kind"] or 0) + _field(6, s["display_name"] or "") + _field(7, signature) + _field(8, s["enclosing_symbol"] or "")


def encode(documents: list[dict]) -> bytes:
    """An index of documents as decode gives them, in their order."""
    out = []
    for d in sorted(documents, key=lambda d: d["position"]):
        if d["external"]:
            out += [_field(3, _symbol_bytes(s)) for s in d["symbols"]]
            continue
        uses = b"".join(_field(2, _field(1, b"".join(map(_varint_bytes, o["range"]))) + _field(2, o["symbol"] or "") + _field(3, o["roles"] or 0)) for o in d["occurrences"])
        cells = _field(1, d["relative_path"]) + uses + b"".join(_field(3, _symbol_bytes(s)) for s in d["symbols"]) + _field(4, d["language"] or "") + _field(6, d["encoding"] or 0)
        out.append(_varint_bytes(2 << 3 | 2) + _varint_bytes(len(cells)) + cells)
    return b"".join(out)


def _python(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's documents as decode gives them. Their occurrences, which are nearly all of them, are converted a column at a time."""
    uses = batch.column("occurrences")
    flat = uses.flatten()
    places, names, roles = flat.flatten()
    cells = lambda x: x.to_numpy(zero_copy_only=False).tolist()
    sizes = lambda x: cells(pc.fill_null(pc.list_value_length(x), 0))
    numbers = iter(cells(places.flatten()))
    each = ({"range": list(itertools.islice(numbers, n)), "symbol": name, "roles": bits} for n, name, bits in zip(sizes(places), cells(names), cells(pc.fill_null(roles, 0)), strict=True))
    for d, n in zip(batch.drop_columns(["occurrences"]).to_pylist(), sizes(uses), strict=True):
        yield d | {"occurrences": list(itertools.islice(each, n))}


def write_index(documents: DataFrame, folder: str) -> None:
    """Index files below folder, a URI that tasks reach, for each index of documents, under its hashed name and the first of the PART positions whose documents a file holds.

    Each file is an index, and an index's files one after another are its only file, as fields that repeat may be set apart. Documents are
    encoded one by one where they are, and a task writes a file as its documents come: none holds an index or a file."""
    from pyarrow import fs

    names, given = ("index", "part", "position", "content"), pa.schema([("index", pa.string()), ("part", pa.int64()), ("position", pa.int64()), ("content", pa.binary())])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for d in _python(batch):
                held.append(dict(zip(names, (d["index"], d["position"] // PART, d["position"], encode([d])), strict=True)))
                size += len(held[-1]["content"])
                if size >= GIVEN:
                    yield pa.RecordBatch.from_pylist(held, given)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, given)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        rows = ((x["index"], x["part"], x["content"]) for batch in batches for x in batch.to_pylist())
        for (index, part), own in itertools.groupby(rows, lambda x: x[:2]):
            name = f"{hashlib.sha256(index.encode()).hexdigest()}.from-{part * PART:010d}.scip"
            with store.open_output_stream(aside := f"{path}/.{name}.{uuid.uuid4().hex}") as out:
                for *_, content in own:
                    out.write(content)
            store.move(aside, f"{path}/{name}")
            yield pa.RecordBatch.from_pydict({"written": [name]})

    small_batches(documents.sparkSession)
    parts = documents.mapInArrow(encoded, "index string, part long, position long, content binary").repartition("index", "part").sortWithinPartitions("index", "part", "position")
    parts.mapInArrow(write, "written string").count()


# --- names -----------------------------------------------------------------------------------------------------------

_NAME = r"(?:`(?:[^`]|``)+`|[A-Za-z0-9_+\-$]+)"
_DESCRIPTOR = re.compile(rf"\[(?P<tparam>{_NAME})\]|\((?P<param>{_NAME})\)|(?P<name>{_NAME})(?P<end>[/#.:!]|\((?:`(?:[^`]|``)*`|[^)`])*\)\.|$)")
#: A fixed value: the endings of ECMAScript module files.
_MODULE = re.compile(r"\.([mc]?[jt]s|[jt]sx)$", re.I)


def descriptors(raw: str) -> list[tuple[str, str]]:
    """Names and endings of a symbol's descriptors, behind the four fields of its header (doubled spaces belong to a field); none where it can't be read to its end."""
    head = re.match(r"(?:(?:[^ ]|  )* ){4}", raw)
    if not head or raw.startswith("local "):
        return []
    out, at = [], head.end()
    while at < len(raw):
        m = _DESCRIPTOR.match(raw, at)
        if not m or m.end() == at:
            return []
        name = m["tparam"] or m["param"] or m["name"]
        out.append((name[1:-1].replace("``", "`") if name[0] == "`" else name, "[]" if m["tparam"] else "()" if m["param"] else m["end"][-2:] if m["end"].startswith("(") else m["end"]))
        at = m.end()
    return out


def qualified_name(raw: str | None, language: str | None) -> str | None:
    """Descriptors joined by dots; for ECMAScript without what leads up to the module's file, and with constructors named so."""
    parts = descriptors(raw or "")
    ecma = (language or "").lower() in ("typescript", "javascript") or (raw or "").startswith("scip-typescript ")
    if ecma:
        cut = next((i + 1 for i, (name, end) in enumerate(parts) if end == "/" and _MODULE.search(name)), 0)
        parts = [("constructor" if n == "<constructor>" else n, e) for n, e in parts[cut:]]
    return ".".join(n for n, _ in parts) or None


def descriptor_kind(raw: str | None) -> str:
    """The kind that a symbol's ending tells: a type, or a constructor, method or function by what it stands in."""
    if not raw or raw.startswith("local "):
        return "OTHER"
    if raw.endswith("#"):
        return "TYPE"
    parts = descriptors(raw)
    if not raw.endswith("().") or not parts:
        return "OTHER"
    if parts[-1][0] == "<constructor>":
        return "CONSTRUCTOR"
    return {"#": "METHOD", "/": "FUNCTION"}.get(parts[-2][1], "OTHER") if len(parts) > 1 else "OTHER"


#: Kind numbers of the format and the model's kinds.
KINDS = {
    7: "CLASS", 75: "CLASS", 21: "INTERFACE", 49: "STRUCT", 11: "ENUM", 53: "TRAIT", 42: "TRAIT", 56: "TRAIT", 85: "TRAIT", 26: "METHOD", 66: "METHOD", 80: "METHOD", 76: "METHOD", 68: "METHOD", 69: "METHOD", 70: "METHOD", 71: "METHOD", 67: "METHOD",
    9: "CONSTRUCTOR", 17: "FUNCTION", 15: "FIELD", 79: "FIELD", 77: "FIELD", 41: "PROPERTY", 81: "PROPERTY", 18: "PROPERTY", 45: "PROPERTY", 72: "PROPERTY", 61: "VARIABLE", 82: "VARIABLE", 60: "VARIABLE", 55: "TYPE_ALIAS", 30: "NAMESPACE", 35: "PACKAGE", 36: "PACKAGE",
}
#: Role bits of the format.
ROLES = {1: "DEFINITION", 64: "FORWARD_DEFINITION", 2: "IMPORT", 4: "WRITE", 8: "READ", 16: "GENERATED", 32: "TEST"}


@F.pandas_udf(T.StructType().add("qualified_name", "string").add("descriptor_kind", "string"))
def _names(raw: pd.Series, language: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"qualified_name": pd.Series([qualified_name(r, x) for r, x in zip(raw, language, strict=True)], dtype=object), "descriptor_kind": [descriptor_kind(r) for r in raw]})


def roles(bits: Column, named: Column) -> Column:
    """The roles of a bit set; a named occurrence that defines nothing is a reference, one without any role is other."""
    flags = [F.when(bits.bitwiseAND(F.lit(b)) != 0, r) for b, r in ROLES.items()]
    defines = bits.bitwiseAND(F.lit(65)) != 0
    found = F.array_compact(F.array(*flags, F.when(~defines & named, "REFERENCE")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("OTHER")))


def location(r: Column) -> Column:
    """Ranges of three or four numbers, lines from 0, as start and end with lines from 1; null for others."""
    e = lambda i: F.element_at(r, i)
    place = lambda a, b, c, d: F.struct((e(a) + 1).alias("start_line"), e(b).alias("start_column"), (e(c) + 1).alias("end_line"), e(d).alias("end_column"))
    return F.when(F.size(r) == 3, place(1, 2, 1, 3)).when(F.size(r) == 4, place(1, 2, 3, 4))


# --- facts -----------------------------------------------------------------------------------------------------------


def symbols(documents: DataFrame, project: str, provider: str = "scip") -> DataFrame:
    """Normalised symbols. A document's fact overwrites earlier ones of its key, external facts only fill gaps; facts without a name or language are left out. Local symbols are keyed by their document."""
    local = F.col("s.symbol").startswith("local ")
    flat = documents.select("index", "position", "relative_path", "language", "external", F.posexplode("symbols").alias("at", "s"))
    extension = F.element_at(F.create_map(*[F.lit(x) for x in ("java", "java", "kt", "kotlin", "ts", "typescript", "tsx", "typescript", "js", "javascript", "py", "python", "go", "go", "rs", "rust", "cs", "csharp", "c", "c", "cpp", "cpp")]), F.regexp_extract("relative_path", r"\.([^./]+)$", 1))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    facts = flat.withColumns({"key": F.concat(F.when(local, F.col("relative_path")).otherwise(""), F.lit("\u001f"), F.col("s.symbol")), "lang": F.coalesce(blank(F.col("language")), blank(F.col("s.signature_language")), extension, F.lit(""))})
    order = Window.partitionBy("index", "key").orderBy("external", F.desc("position"), F.desc("at"))
    facts = facts.withColumn("k", F.row_number().over(order)).filter("k = 1")
    facts = facts.filter((F.trim("s.display_name") != "") & (F.col("lang") != "")).withColumn("n", _names("s.symbol", "lang"))
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("s.kind"))
    kind = F.when(F.col("s.kind") == 0, F.col("n.descriptor_kind")).otherwise(F.coalesce(kind, F.lit("OTHER")))
    first = definitions(documents)
    facts = facts.withColumn("kind", kind).join(first, ["index", "key"], "left")
    structural = ~F.col("external") & (F.col("relative_path") != "")
    sig, loc = F.trim("s.signature"), F.coalesce(F.format_string("%d:%d-%d:%d", "loc.start_line", "loc.start_column", "loc.end_line", "loc.end_column"), F.lit(""))
    loc = F.when(F.col("loc").isNotNull(), loc).otherwise("")
    named = stable_id("structural", F.lit(project), F.col("lang"), F.col("kind"), F.col("n.qualified_name"), F.col("s.signature"), F.when(sig == "", loc).otherwise(""))
    unnamed = stable_id("structural", F.lit(project), F.col("lang"), F.col("kind"), F.col("relative_path"), F.col("s.display_name"), F.col("s.signature"), loc)
    key = F.when(structural & F.col("n.qualified_name").isNotNull(), named).when(structural, unnamed).otherwise(stable_id("provider", F.lit(project), F.lit(provider), F.col("s.symbol")))
    out = facts.withColumn("symbol_key", key)
    return out.select(
        "index", "key", stable_id("sym", F.lit(project), F.col("symbol_key")).alias("id"), "symbol_key", F.when(structural, "STRUCTURAL_FALLBACK").otherwise("PROVIDER_SCOPED_FALLBACK").alias("identity_quality"), F.lit(project).alias("project_id"),
        blank(F.col("relative_path")).alias("file_id"), "kind", F.col("s.display_name").alias("name"), F.col("n.qualified_name").alias("qualified_name"), blank(F.col("s.signature")).alias("signature"), F.col("lang").alias("language"), "loc.start_line", "loc.start_column", "loc.end_line", "loc.end_column",
        "external", F.coalesce("generated", F.lit(False)).alias("generated"), F.col("s.symbol").alias("raw_symbol"), F.col("s.relationships").alias("relationships"),
    )


def _occurrence_rows(documents: DataFrame) -> DataFrame:
    flat = documents.filter("NOT external").select("index", "position", "relative_path", F.posexplode("occurrences").alias("at", "o"))
    local = F.col("o.symbol").startswith("local ")
    key = F.concat(F.when(local, F.col("relative_path")).otherwise(""), F.lit("\u001f"), F.col("o.symbol"))
    return flat.withColumns({"key": key, "loc": location(F.col("o.range")), "roles": roles(F.col("o.roles"), F.trim("o.symbol") != "")})


def definitions(documents: DataFrame) -> DataFrame:
    """Per symbol the place of its first definition, and whether one is generated."""
    rows = _occurrence_rows(documents).filter("o.roles & 65 <> 0 AND loc IS NOT NULL")
    return rows.groupBy("index", "key").agg(F.min_by("loc", F.struct("position", "at")).alias("loc"), F.bool_or(F.array_contains("roles", "GENERATED")).alias("generated"))


def occurrences(documents: DataFrame, known: DataFrame, project: str) -> DataFrame:
    """Normalised occurrences; those without a symbol or a readable range are left out. An unknown symbol leaves the reference unresolved, under the last of its descriptors."""
    rows = _occurrence_rows(documents).filter((F.trim("o.symbol") != "") & F.col("loc").isNotNull()).join(known.select("index", "key", F.col("id").alias("symbol_id")), ["index", "key"], "left")
    name = F.when(F.col("symbol_id").isNull(), F.regexp_extract("o.symbol", r"([A-Za-z0-9_$+\-]+)`?[^A-Za-z0-9_$+\-]*$", 1))
    made = stable_id("occ", F.lit(project), F.col("relative_path"), F.col("o.symbol"), F.col("loc.start_line"), F.col("loc.start_column"), F.col("loc.end_line"), F.col("loc.end_column"), F.array_join("roles", ","))
    return rows.select(made.alias("id"), F.lit(project).alias("project_id"), "symbol_id", name.alias("unresolved_name"), F.col("relative_path").alias("file_id"), "loc.start_line", "loc.start_column", "loc.end_line", "loc.end_column", "roles", F.when(F.col("symbol_id").isNotNull(), "RESOLVED").otherwise("UNRESOLVED").alias("resolution_status"))


def relationships(known: DataFrame, project: str) -> DataFrame:
    """One factual relation for each flag of a symbol's relationships; an unknown target is named by its qualified name, else by its last descriptor."""
    flags = {"is_reference": "REFERENCES", "is_implementation": "IMPLEMENTS", "is_type_definition": "TYPE_DEFINITION", "is_definition": "DEFINITION"}
    flat = known.select("index", F.col("id").alias("source_id"), F.col("language"), F.explode("relationships").alias("r")).select("*", F.explode(F.array_compact(F.array(*[F.when(F.col(f"r.{c}"), k) for c, k in flags.items()]))).alias("kind"))
    target = known.select("index", F.col("raw_symbol").alias("raw"), F.col("id").alias("target_id")).dropDuplicates(["index", "raw"])
    rows = flat.withColumn("raw", F.col("r.symbol")).join(target, ["index", "raw"], "left")
    unresolved = F.when(F.col("target_id").isNull(), F.coalesce(_names("raw", "language")["qualified_name"], F.nullif(F.regexp_extract("raw", r"([A-Za-z0-9_$+\-]+)`?[^A-Za-z0-9_$+\-]*$", 1), F.lit(""))))
    rows = rows.withColumn("unresolved_target", unresolved).filter("target_id IS NOT NULL OR unresolved_target IS NOT NULL")
    made = stable_id("rel", F.lit(project), F.col("source_id"), F.col("kind"), F.col("target_id"), F.col("unresolved_target"))
    return rows.select(made.alias("id"), F.lit(project).alias("project_id"), F.lit("SYMBOL").alias("source_type"), "source_id", F.when(F.col("target_id").isNotNull(), "SYMBOL").alias("target_type"), "target_id", "unresolved_target", "kind", F.when(F.col("target_id").isNotNull(), "RESOLVED").otherwise("UNRESOLVED").alias("resolution_status"), F.lit("FACTUAL").alias("nature"), F.lit(None).cast("double").alias("confidence")).dropDuplicates(["id"])
