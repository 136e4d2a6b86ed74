"""Exact repeats of many words: non-overlapping blocks as anchors, probed by every rolling window, hits extended to the maximal repeats."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_BATCH_BYTES, lean, renamed, small_batches, source_bytes, stored, table, with_names

#: Words of a window that may not start twice.
WIDTH = 35
#: Bytes of text whose windows are gathered before they are sent: a share of the input, within these bounds.
LEAST_BATCH, MOST_BATCH, SHARE = 1 << 20, 64 << 20, 64
#: Buckets of hashes at least; bytes of text for each bucket of anchors and of windows.
BUCKETS, ANCHOR_BYTES, WINDOW_BYTES = 1024, 1 << 30, 128 << 20
#: Bytes and words that are hashed at a time; words of more bytes are hashed one by one.
SEGMENT, LONG_WORD = 1 << 17, 64
_BYTE_BASE, _ANCHOR_BASE, _FIRST_BASE, _SECOND_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_WORD = 1 << 64


@cache
def _powers(base: int, inverse: bool) -> np.ndarray:
    """The powers of an odd number, or of its inverse, modulo 2 ** 64."""
    out = np.full(SEGMENT + 4096, pow(base, -1, _WORD) if inverse else base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of x spread over all bits."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _polynomials(values: np.ndarray, base: int) -> np.ndarray:
    """Sums of the first i values (at most SEGMENT and some), each times a power of base: differences of these, brought back to power 0, are hashes of runs."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, False)[: len(values)], out=out[1:])
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of texts, one text after another, and where each text's words begin and the last one's end. Nulls have none."""
    flat = texts.cast(pa.binary()).cast(pa.large_binary()).fill_null(b"")
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    at = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    letter = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    begins = np.zeros(len(data) + 1, bool)  # a text, or the character after white space
    begins[at] = True
    begins[1:-1] |= ~letter[:-1]
    starts = np.flatnonzero(letter & begins[:-1])
    ends = begins[1:].copy()
    ends[:-1] |= ~letter[1:]
    ends = np.flatnonzero(letter & ends) + 1
    out, size = np.empty(len(starts), np.uint64), ends - starts
    for k in range(0, len(data), SEGMENT):
        lo, hi = np.searchsorted(starts, (k, k + SEGMENT))
        sums = _polynomials(data[k : k + SEGMENT + LONG_WORD].astype(np.uint64) + np.uint64(1), _BYTE_BASE)
        s = starts[lo:hi] - k
        out[lo:hi] = (sums[s + np.minimum(size[lo:hi], LONG_WORD)] - sums[s]) * _powers(_BYTE_BASE, True)[s] + size[lo:hi].astype(np.uint64)
    out = _mixed(out)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out, np.searchsorted(starts, at)


def rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash for each width consecutive words."""
    out = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(0, len(out), SEGMENT):
        sums = _polynomials(words[k : k + SEGMENT + width - 1], base)
        out[k : k + SEGMENT] = (sums[width:] - sums[:-width]) * _powers(base, True)[: len(sums) - width]
    return _mixed(out)


class Windows:
    """The words of some texts as hashes. A window is named by its first word; place is a word's place in its text, left how many words of it stand there and after."""

    def __init__(self, texts: pa.Array, width: int):
        self.width, self.block = width, (width + 1) // 2
        self.words, self.first = word_hashes(texts)
        counts = np.diff(self.first)
        every = np.arange(len(self.words))
        self.place, self.left = every - np.repeat(self.first[:-1], counts), np.repeat(self.first[1:], counts) - every
        self.long = np.repeat(counts >= width, counts)

    def anchors(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each run of a block's words inside a text long enough: its first word, its key (a bucket of so many bits, then 32 bits) and whether it is one of the text's own blocks, which do not overlap. Any window holds a whole block."""
        keys = rolling(self.words, self.block, _ANCHOR_BASE) >> np.uint64(32 - bits)
        at = np.flatnonzero((self.left >= self.block)[: len(keys)] & self.long[: len(keys)])
        return at, keys[at], self.place[at] % self.block == 0

    def whole(self) -> np.ndarray:
        """Whether a window starts at a word."""
        return self.left >= self.width

    def named(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """What tells windows apart: buckets of so many bits and 64 further bits, for each width words in a row."""
        return (rolling(self.words, self.width, _SECOND_BASE) >> np.uint64(64 - bits)).astype(np.int64), rolling(self.words, self.width, _FIRST_BASE)


def _slices(texts: pa.ChunkedArray) -> Iterator[pa.Array]:
    """Runs of texts of a bounded size, or of one longer text."""
    for chunk in texts.chunks:
        start = size = 0
        for i, n in enumerate(_lengths(chunk)):
            if i > start and size + n > ARROW_BATCH_BYTES:
                yield chunk.slice(start, i - start)
                start, size = i, 0
            size += n
        if len(chunk) > start:
            yield chunk.slice(start)


def _lengths(texts: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def _among(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each x is among known, which is sorted."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _twice_at_most(ordered: np.ndarray) -> np.ndarray:
    """Which of ordered values to keep so that each is kept once or, where it is repeated, twice."""
    keep = np.ones(len(ordered), bool)
    keep[2:] = ordered[2:] != ordered[:-2]
    return keep


def _pieces(buckets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The buckets that occur, and the values of each as bytes; both are in the order of buckets."""
    cuts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else np.zeros(0, np.int64)
    offsets = (np.append(cuts, len(values)) * values.itemsize).astype(np.int32)
    return buckets[cuts], pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(cells: pa.ChunkedArray | pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", kind) for x in cells.to_pylist()]


def _in_batches(docs: DataFrame, text: str, batch_bytes: int) -> DataFrame:
    """docs with batch, rows that a task read one after another with about so many bytes of text, and bytes of the text; written."""
    schema = docs.withColumns({"batch": F.lit(0).cast("bigint"), "bytes": F.lit(0).cast("bigint")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes, numbers = _lengths(batch.column(text)), []
            for n in sizes:
                if size and size + n > batch_bytes:
                    number, size = number + 1, 0
                size += n
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array(sizes, pa.int64())], names=[*batch.schema.names, "batch", "bytes"])

    return stored(docs.mapInArrow(lean(run), schema), "repeat-batches", compression="zstd")


_ANCHORS = "bucket long, kind int, batch long, blocks binary, probes binary"


def _probing(text: str, width: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each batch the keys of its blocks (kind 0, at most two of a key) and those it looks for: its blocks' and all others' (kind 1, each once)."""

    def rows(batch: int, blocks: list[np.ndarray], probes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        own, others = np.sort(np.concatenate(blocks)), np.unique(np.concatenate(probes))
        own = own[_twice_at_most(own)]
        once, low = np.unique(own), np.uint64(0xFFFFFFFF)
        for kind, column, keys in ((0, 3, own), (1, 3, once), (1, 4, others)):
            buckets, cells = _pieces((keys >> np.uint64(32)).astype(np.int64), (keys & low).astype(np.uint32))
            if len(cells):
                columns = [pa.array(buckets), pa.array(np.full(len(cells), kind, np.int32)), pa.array(np.full(len(cells), batch)), pa.nulls(len(cells), pa.binary()), pa.nulls(len(cells), pa.binary())]
                columns[column] = cells
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _ANCHORS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, probes = None, [], []
        for part in batches:
            numbers = part.column("batch").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1], [True]])) if len(numbers) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if now != numbers[a]:
                    if blocks:
                        yield from rows(now, blocks, probes)
                    now, blocks, probes = int(numbers[a]), [], []
                _, keys, own = Windows(part.column(text).slice(a, b - a), width).anchors(bits)
                if len(keys):
                    blocks.append(keys[own])
                    probes.append(keys[~own])
        if blocks:
            yield from rows(now, blocks, probes)

    return lean(run)


_HITS = "batch long, bucket long, blocks binary, probes binary"


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of bucket and kind, what each batch finds in the bucket's index of blocks: of its blocks' keys those of two blocks or more, of its other keys those of any block."""
    bucket, index, several = None, [], None
    for part in batches:
        out: list[tuple] = []
        for b, kind, batch, blocks, probes in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if b != bucket:
                bucket, index, several = b, [], None
            if kind == 0:
                index.append(np.frombuffer(blocks, np.uint32))
                continue
            if several is None:
                index, counts = np.unique(np.concatenate(index) if len(index) else np.zeros(0, np.uint32), return_counts=True)
                several = index[counts > 1]
            if blocks:
                found = (x := np.frombuffer(blocks, np.uint32))[_among(several, x)]
                if len(found):
                    out.append((batch, b, found.tobytes(), None))
            if probes:
                found = (x := np.frombuffer(probes, np.uint32))[_among(index, x)]
                if len(found):
                    out.append((batch, b, None, found.tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=[x.split()[0] for x in _HITS.split(", ")])


_SEEN = "bucket long, batch long, windows binary"


def _extending(text: str, width: int, bits: int, window_bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The windows of a batch around its hits, at most two of a kind: no other can start anywhere else."""

    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        buckets = hits.column("bucket").to_numpy().astype(np.uint64)
        known = []
        for name in ("blocks", "probes"):
            cells = _numbers(hits.column(name), np.uint32)
            known.append(np.sort(np.repeat(buckets << np.uint64(32), [len(x) for x in cells]) | np.concatenate([np.zeros(0, np.uint32), *cells]).astype(np.uint64)))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for texts in _slices(docs.column(text)) if hits.num_rows else ():
            windows = Windows(texts, width)
            at, keys, own = windows.anchors(bits)
            hit = at[np.where(own, _among(known[0], keys), _among(known[1], keys))]
            if not len(hit):
                continue
            n = len(windows.words)
            ahead = np.concatenate([[0], np.bincount(hit, minlength=n).cumsum()])  # hits before a word
            last = np.minimum(np.arange(n) + width - windows.block + 1, n)
            start = np.flatnonzero((ahead[last] > ahead[:n]) & windows.whole())
            part, name = windows.named(window_bits)
            found.append((part[start], name[start]))
        part, name = (np.concatenate([np.zeros(0, k), *x]) for k, x in zip((np.int64, np.uint64), zip(*found, strict=True) if found else ((), ()), strict=True))
        order = np.lexsort((name, part))
        part, name = part[order], name[order]
        keep = np.ones(len(name), bool)
        keep[2:] = (name[2:] != name[:-2]) | (part[2:] != part[:-2])
        buckets, cells = _pieces(part[keep], name[keep])
        number = docs.column("batch")[0].as_py() if docs.num_rows else 0
        return pa.table({"bucket": pa.array(buckets, pa.int64()), "batch": pa.array(np.full(len(cells), number), pa.int64()), "windows": cells})

    return run


def _repeated(rows: pa.Table) -> pa.Table:
    """Of the windows of a bucket those that start twice, for each batch that has them."""
    cells = _numbers(rows.column("windows"), np.uint64)
    names, counts = np.unique(np.concatenate(cells), return_counts=True)
    several = names[counts > 1]
    found = [np.unique(x[_among(several, x)]) for x in cells]
    keep = pa.array([i for i, x in enumerate(found) if len(x)], pa.int64())
    return pa.table({"bucket": rows.column("bucket").take(keep), "batch": rows.column("batch").take(keep), "windows": pa.array([x.tobytes() for x in found if len(x)], pa.binary())})


_FOUND = "n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"


def _removing(columns: list[str], text: str, width: int, window_bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The documents of a batch with their covered runs of words, and without them."""

    def run(docs: pa.Table, repeated: pa.Table) -> pa.Table:
        cells = _numbers(repeated.column("windows"), np.uint64)
        names = np.concatenate([np.zeros(0, np.uint64), *cells])
        parts = np.repeat(repeated.column("bucket").to_numpy(), [len(x) for x in cells])
        order = np.lexsort((parts, names))
        names, parts = np.append(names[order], np.zeros(2, np.uint64)), np.append(parts[order], np.full(2, -1))
        n_words, n_removed, spans, kept = [], [], [], []
        for texts in _slices(docs.column(text)):
            windows = Windows(texts, width)
            covered = np.zeros(len(windows.words) + 1, np.int32)
            if len(order) and len(windows.words) >= width:
                part, name = windows.named(window_bits)
                at = np.searchsorted(names[: len(order)], name)
                same = ((names[at] == name) & (parts[at] == part)) | ((names[at + 1] == name) & (parts[at + 1] == part))
                start = np.flatnonzero(same & windows.whole()[: len(same)])
                covered[: len(covered)] = np.bincount(start, minlength=len(covered)) - np.bincount(start + width, minlength=len(covered))
            covered = covered.cumsum()[:-1] > 0
            for k, raw in enumerate(texts.cast(pa.binary()).to_pylist()):
                a, b = int(windows.first[k]), int(windows.first[k + 1])
                words, gone = (raw or b"").split(), covered[a:b]
                n_words.append(b - a)
                n_removed.append(removed := int(gone.sum()))
                if removed:
                    line = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                    spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(line > 0), np.flatnonzero(line < 0), strict=True)])
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    spans.append([])
                kept.append(b" ".join(words))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        added = {name: pa.array(x, kind) for name, x, kind in zip(("n_words", "n_removed", "spans"), (n_words, n_removed, spans), kinds, strict=True)}
        return pa.table({c: docs.column(c) for c in columns} | added | {"kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return run


def _bits(size: int, each: int) -> int:
    """Bits that number buckets of about so many bytes of text each, BUCKETS of them at least."""
    return (max(BUCKETS, -(-size // each)) - 1).bit_length()


def without_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH, batch_bytes: int | None = None) -> DataFrame:
    """docs with n_words, n_removed, spans (maximal runs of removed words, from start up to end) and kept, the other words joined by single spaces.

    Removed is each word covered by a window of width words whose sequence also starts anywhere else, in the same text or another; windows
    are judged on the input. Any window holds one whole block of a grid of blocks half as long, so of two equal windows either holds a block
    of the other's text. Blocks' keys are an index in buckets; every run of a block's words is looked for there, and only windows around a
    hit (a key of 42 bits or more, which may be another's by chance) go on. These are told apart by 64 bits beside their bucket's number
    (74 bits or more) and counted: what starts twice is repeated, and where such windows follow on each other they are a maximal repeat.

    A batch sends a key or window twice at most, so copies make no task large, and no pairs are made. A task holds the keys of a bucket's
    blocks, or the windows around hits of about WINDOW_BYTES of text, or a batch's texts. A null, empty or blank text has no words, keeps
    an empty text and repeats nothing; rows that repeat a text or an id are rows of their own; very long texts are hashed in segments; an
    empty table gives no rows. Columns of docs called n_words, n_removed, spans or kept are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    df, at = renamed(docs)
    held = _in_batches(df, at[text], batch_bytes or min(MOST_BATCH, max(LEAST_BATCH, source_bytes(docs) // SHARE)))
    size = held.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bits, window_bits = _bits(size, ANCHOR_BYTES), _bits(size, WINDOW_BYTES)
    anchors = held.filter("bytes > 0").select(at[text], "batch").mapInArrow(_probing(at[text], width, bits), _ANCHORS)
    hits = anchors.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(lean(_hits), _HITS)
    docs_of = held.groupBy("batch")
    seen = docs_of.cogroup(hits.groupBy("batch")).applyInArrow(_extending(at[text], width, bits, window_bits), _SEEN)
    repeated = seen.groupBy("bucket").applyInArrow(_repeated, _SEEN)
    schema = ", ".join(f"{c} {kind}" for c, kind in df.dtypes)
    cleaned = docs_of.cogroup(repeated.groupBy("batch")).applyInArrow(_removing(df.columns, at[text], width, window_bits), f"{schema}, {_FOUND}")
    return with_names(cleaned, at, {c: F.col(c) for c in ("n_words", "n_removed", "spans", "kept")})


def op11(spark, sf_dir: str) -> DataFrame:
    """All documents without words that stand in repeated windows. A null text has no words; rows of a repeated or null doc_id are judged each on its own; a text that occurs twice goes whole if it has a window; very long texts are judged whole; an empty table gives no rows."""
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH split AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS k, len(w) AS n FROM split
), windows AS (
  SELECT id, k, n, word, md5_number(string_agg(word, ' ') OVER (PARTITION BY id ORDER BY k ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS h FROM words
), counted AS (
  SELECT *, k + 34 <= n AND count(*) FILTER (k + 34 <= n) OVER (PARTITION BY h) > 1 AS again FROM windows
), judged AS (
  SELECT id, k, word, count(*) FILTER (again) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone FROM counted
), kept AS (
  SELECT id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (NOT gone) AS t FROM judged GROUP BY id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (id)"""
