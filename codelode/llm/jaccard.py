"""Exact Jaccard join of documents on word n-grams through a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import files
from .common import lean, own_exchange, scratch, small_batches, stored, table
from .components import components

#: Different texts and shingles of one group at most; texts that may share a smallest hash before it is split, as a part of all rows at least.
GROUP_SETS, GROUP_SHINGLES, HOT_ROWS, HOT_SHARE = 128, 1 << 21, 256, 20_000
#: Counters of the frequency sketch (4 bytes each), in pieces of SKETCH_PIECE.
SKETCH, SKETCH_PIECE = 1 << 20, 1 << 14
#: Bits of the filter that keeps rows out of a join: at most 2 ** FILTER_BITS, in words of 64 that are broadcast.
FILTER_BITS = 25
#: Bits of a group's union for each of its tokens, and groups that a lead group is opened with in one task.
UNION_BITS, OPEN_BLOCK = 8, 64
#: Rows that a task gathers before it passes them on.
FLUSH_ROWS = 50_000
#: Kinds of texts that a task remembers to send only one copy of each.
SEEN = 200_000
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = h + np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes hashed together, and the longest word of the polynomial hash (longer ones get xxHash).
PIECE, LONG_WORD = 1 << 18, 512
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BYTE = np.where(_WHITE, np.uint64(0), _mix(np.arange(1, 257, dtype=np.uint64) * _P))
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_POWER = np.concatenate([[np.uint64(1)], np.full(PIECE, _P)]).cumprod(dtype=np.uint64)
_UNPOWER = np.concatenate([[np.uint64(1)], np.full(PIECE, np.uint64(pow(int(_P), -1, 1 << 64)))]).cumprod(dtype=np.uint64)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending; sorts x in place."""
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in UTF-8 bytes: runs of anything but ASCII white space, A-Z lower-cased. No word goes beyond one of ends (of texts, ascending).

    A word's hash is the sum of its bytes' values times powers of an odd number, taken from sums over a whole piece."""
    hashes, starts, at, whole = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, len(data)
    while at < whole:
        stop = min(at + PIECE, whole)
        white = _WHITE[data[at:stop]]
        cuts = ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, stop, "left")] - at
        if stop < whole:  # end behind the last white space or text
            last = max(int(len(white) - white[::-1].argmax()) if white.any() else 0, int(cuts[-1]) if len(cuts) else 0)
            if not last:  # a word longer than a piece
                rest = np.flatnonzero(_WHITE[data[at:]])
                end = min([whole, *(rest[:1] + at).tolist(), *ends[ends > at][:1].tolist()])
                hashes.append(np.array([xxhash.xxh64_intdigest(data[at:end].tobytes().lower())], np.uint64))
                starts.append(np.array([at], np.int64))
                at = end
                continue
            stop, white = at + last, white[:last]
            cuts = cuts[cuts < last]
        inner = ~white
        first, final = inner.copy(), inner.copy()
        first[1:] &= white[:-1]
        final[:-1] &= white[1:]
        first[cuts] = inner[cuts]
        final[cuts - 1] = inner[cuts - 1]
        begin = np.flatnonzero(first)
        if len(begin):
            values = _BYTE[data[at:stop]] * _POWER[: stop - at]
            found = np.add.reduceat(values, begin) * _UNPOWER[begin]
            end = np.flatnonzero(final) + 1
            for k in np.flatnonzero(end - begin > LONG_WORD).tolist():
                found[k] = xxhash.xxh64_intdigest(data[at + begin[k] : at + end[k]].tobytes().lower())
            hashes.append(found)
            starts.append(begin + at)
        at = stop
    return _mix(np.concatenate(hashes)), np.concatenate(starts)


class Shingler:
    """Sets of 64-bit shingle hashes."""

    #: Bytes of texts that are shingled together.
    RUN = 1 << 20

    def __init__(self, n: int):
        self.n = n

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The distinct n-word shingles of each text, ascending; with fewer words the whole sequence as one; without words or text none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + self.RUN, "right")) - 1)
            ends = offsets[at + 1 : to + 1] - offsets[at]
            hashes, starts = word_hashes(data[offsets[at] : offsets[to]], ends)
            line = hashes[: max(0, len(hashes) - self.n + 1)].copy()
            for j in range(1, self.n):
                line = line * _P + hashes[j : len(line) + j]
            line = _mix(line, self.n)
            below = np.searchsorted(starts, np.concatenate([[0], ends])).tolist()
            for a, b in zip(below[:-1], below[1:], strict=True):
                if b - a >= self.n:
                    yield distinct(line[a : b - self.n + 1].copy())
                elif b == a:
                    yield np.zeros(0, np.uint64)
                else:
                    one = hashes[a : a + 1].copy()
                    for j in range(a + 1, b):
                        one = one * _P + hashes[j]
                    yield _mix(one, b - a)
            at = to


def _signed(x: np.uint64) -> int:
    return int(np.uint64(x).astype(np.int64))


def signature(s: np.ndarray) -> tuple[int, int, int, int]:
    """Size, two sums that equal sets share, and the smallest hash of the set under another mixing."""
    if not len(s):
        return 0, 0, 0, 0
    m = _mix(s, 11)
    return len(s), _signed(m.sum()), _signed((m * m).sum()), _signed(m.min())


def prefix(s: np.ndarray, sketch: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of a set that every link of it must share one of: its rarest, by the sketch's count, then by hash, the order that all documents share.

    With each token how many of the set are left from it on, and whether it is of the short prefix (that of a link's smaller side). Tokens
    that the sketch has once are nobody else's and left out."""
    size = len(s)
    long_, short = size + (-num * size) // den + 1, size + (-2 * num * size) // (num + den) + 1
    counts = sketch[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
    key = (counts.astype(np.uint64) << np.uint64(32)) | np.arange(size, dtype=np.uint64)
    if long_ < size:
        key = np.partition(key, long_)[:long_]
    key.sort()
    order = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    place = np.flatnonzero(counts[order] > 1)
    return s[order[place]], size - place, place < short


def union_bits(tokens: np.ndarray) -> np.ndarray:
    """A set of tokens as a bitmap of a power of two bits, UNION_BITS or more for each token; halves laid over each other give the bitmap of half the size."""
    width = 1 << max(6, (UNION_BITS * len(tokens) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[((tokens >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits)


def most_shared(size: int, bits: np.ndarray, other_size: int, other: np.ndarray) -> int:
    """No fewer than the tokens that two sets share, from their bitmaps: each bit that only one has stands for a token of its own."""
    while len(bits) > len(other):
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    while len(other) > len(bits):
        other = other[: len(other) // 2] | other[len(other) // 2 :]
    alone = lambda a, b: int(np.bitwise_count(a & ~b).sum())
    return min(size - alone(bits, other), other_size - alone(other, bits))


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if den * len(small) < num * len(large) or not len(small):
        return False
    at = np.searchsorted(large, small)
    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return den * shared >= num * (len(a) + len(b) - shared)


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(i)] = self.find(j)


def _sketch(signed: DataFrame) -> np.ndarray:
    """Counts of all documents' shingles by hash, from the tasks' parts; each piece is summed as it streams by."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = np.frombuffer(counts.as_buffer(), np.uint32)
                sums[piece] = sums[piece] + got if piece in sums else got.astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in sums.values()], pa.binary())], ["piece", "counts"])

    out = np.zeros(SKETCH, np.uint32)
    for piece, counts in signed.filter("piece IS NOT NULL").select("piece", "counts").repartition("piece").mapInArrow(lean(total), "piece int, counts binary").collect():
        out[piece * SKETCH_PIECE : (piece + 1) * SKETCH_PIECE] = np.frombuffer(bytes(counts), np.uint32)
    return out


_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in text.split(", "))])


def _rows(schema: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    """A batch of the columns given, the others null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


SIGNED = "doc_id long, n int, h1 long, h2 long, low long, piece int, counts binary"


def _sign(docs: DataFrame, n: int) -> DataFrame:
    """The signature of every document, and the tasks' parts of the sketch (piece, counts)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts, schema = Shingler(n), np.zeros(SKETCH, np.uint32), _schema(SIGNED)
        for batch in batches:
            rows = []
            for s in shingler.sets(batch.column(1)):
                rows.append(signature(s))
                np.add.at(counts, (s & np.uint64(SKETCH - 1)).astype(np.int64), np.uint32(1))
            size, h1, h2, low = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield _rows(schema, len(rows), doc_id=batch.column(0), n=size, h1=h1, h2=h2, low=low)
        for k in range(SKETCH // SKETCH_PIECE):
            part = counts[k * SKETCH_PIECE : (k + 1) * SKETCH_PIECE]
            if part.any():
                yield _rows(schema, 1, piece=[k], counts=[part.tobytes()])

    return stored(docs.select("doc_id", "text").mapInArrow(lean(sign), SIGNED), "signed")


MATRIX = "doc_id long, n int, h1 long, h2 long, bits binary, size int, grp long, token long, lo int, hi int, rest int, short boolean"


def _groups(docs: DataFrame, signed: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The token-group matrix as one table: rows with a token are entries; the others are the texts in groups, one of each kind of equal texts, and with one of each group the union of its tokens (size, bits).

    A group is a set of documents linked with each other (its name the smallest id), found among those that share their smallest hash.
    Its entries are the union of its members' prefixes: token, the sizes of its smallest and largest member, how many shingles a member
    has from that token on at most, and whether a member has it in its short prefix."""
    spark = docs.sparkSession
    files.publish(counts := f"{scratch(spark, 'sketch')}/counts", _sketch(signed).tobytes())
    rows = signed.filter("n > 0 AND doc_id IS NOT NULL")
    least = max(HOT_ROWS, rows.count() // HOT_SHARE)
    lows = rows.select("low", "h1", "h2").distinct().groupBy("low").agg(F.count("*").alias("k")).filter(F.col("k") > least)
    hot = {r[0]: -(-r[1] * 2 // least) for r in lows.collect()}  # at most HOT_SHARE rows
    held = spark.sparkContext.broadcast(hot)

    @F.arrow_udf("n int, h1 long, h2 long, low long, bucket long, again boolean")
    def sign(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lean(signed_rows)(texts)

    def signed_rows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingler, splits, seen = Shingler(n), held.value, set()
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        for texts in batches:
            out = []
            for size, h1, h2, low in map(signature, shingler.sets(texts)):
                part = h1 % splits.get(low, 1)
                out.append((size, h1, h2, low, (low + part * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63, (h1, h2) in seen))
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add((h1, h2))
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["n", "h1", "h2", "low", "bucket", "again"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketch, schema = Shingler(n), files.mapped(counts).view(np.uint32), _schema(MATRIX)
        held_rows: list[list] = []
        entries: list[tuple] = []
        waiting = 0

        def close(ids: list[int], sets: list[np.ndarray], marks: list[tuple]) -> None:
            """Texts of equal smallest hash, split into what is linked."""
            nonlocal waiting
            one = Union(len(sets))
            for j in range(len(sets)):
                for i in range(j - 1, -1, -1):  # neighbours in size first
                    if den * len(sets[i]) < num * len(sets[j]):
                        break
                    if one.find(i) != one.find(j) and linked(sets[i], sets[j], num, den):
                        one.join(i, j)
            parts: dict[int, list[int]] = {}
            for i in range(len(sets)):
                parts.setdefault(one.find(i), []).append(i)
            for own in parts.values():
                name = min(ids[i] for i in own)
                sizes = [len(sets[i]) for i in own]
                token, rest, short = (np.concatenate(x) for x in zip(*(prefix(sets[i], sketch, num, den) for i in own), strict=True))
                union = sets[own[0]]
                if len(own) > 1:
                    order = np.argsort(token)
                    token, rest, short = token[order], rest[order], short[order]
                    if len(token):
                        new = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
                        token, rest, short = token[new], np.maximum.reduceat(rest, new), np.logical_or.reduceat(short, new)
                    union = distinct(np.concatenate([sets[i] for i in own]))
                for k, i in enumerate(own):
                    held_rows.append([ids[i], len(sets[i]), *marks[i], name, min(sizes), max(sizes), None if k else len(union), None if k else union_bits(union).tobytes()])
                entries.append((token.astype(np.int64), rest.astype(np.int32), short, np.full(len(token), name), np.full(len(token), min(sizes), np.int32), np.full(len(token), max(sizes), np.int32)))
                waiting += len(own) * 8 + len(token)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            if held_rows:
                names = ["doc_id", "n", "h1", "h2", "grp", "lo", "hi", "size", "bits"]
                yield _rows(schema, len(held_rows), **dict(zip(names, zip(*held_rows, strict=True), strict=True)))
            if entries:
                token, rest, short, grp, lo, hi = (np.concatenate(x) for x in zip(*entries, strict=True))
                for k in range(0, len(token), FLUSH_ROWS):
                    cut = slice(k, k + FLUSH_ROWS)
                    yield _rows(schema, len(token[cut]), token=token[cut], rest=rest[cut], short=short[cut], grp=grp[cut], lo=lo[cut], hi=hi[cut])
            held_rows.clear()
            entries.clear()
            waiting = 0

        ids, sets, marks, low, weight = [], [], [], None, 0
        for batch in batches:
            signs = zip(*(batch.column(2).field(k).to_pylist() for k in ("low", "h1", "h2")), strict=True)
            for i, s, (own, *mark) in zip(batch.column(0).to_pylist(), shingler.sets(batch.column(1)), signs, strict=True):
                if sets and low == own and marks[-1] == mark:
                    continue  # a copy from another task
                if sets and (low != own or len(sets) >= GROUP_SETS or weight > GROUP_SHINGLES):
                    close(ids, sets, marks)
                    ids, sets, marks, weight = [], [], [], 0
                    if waiting > FLUSH_ROWS:
                        yield from flush()
                low = own
                ids.append(i)
                sets.append(s)
                marks.append(mark)
                weight += len(s)
        if sets:
            close(ids, sets, marks)
        yield from flush()

    marked = docs.filter("doc_id IS NOT NULL").withColumn("s", sign.asNondeterministic()("text")).filter("s.n > 0 AND NOT s.again")
    dealt = marked.withColumn("_b", F.col("s.bucket")).repartition("_b").sortWithinPartitions("s.low", "_b", "s.n", "s.h1", "s.h2", "doc_id")
    return stored(dealt.select("doc_id", "text", "s").mapInArrow(lean(group), MATRIX), "token-groups")


def maybe_among(docs: DataFrame, ids: DataFrame, key: str = "doc_id", hit: str = "_hit") -> DataFrame:
    """docs with hit, true for every row whose key is among ids (of the same name) and few others: by a filter of hashed bits, of bounded size. docs isn't shuffled. A column called hit is replaced; others must not begin with _cl_."""
    bits = min(FILTER_BITS, max(10, int(ids.count() * 16).bit_length()))
    at = F.shiftrightunsigned(F.xxhash64(F.lit(3), key), 64 - bits)
    one = F.expr("shiftleft(1L, cast(_cl_at & 63 AS int))")
    words = ids.withColumn("_cl_at", at).groupBy(F.shiftright("_cl_at", 6).alias("_cl_word")).agg(F.bit_or(one).alias("_cl_bits"))  # at most 2 ** (FILTER_BITS - 6) rows
    held = docs.withColumn("_cl_at", at).withColumn("_cl_word", F.shiftright("_cl_at", 6)).join(F.broadcast(words), "_cl_word", "left")
    return held.withColumn(hit, F.coalesce(F.col("_cl_bits").bitwiseAND(one) != 0, F.lit(False))).drop("_cl_at", "_cl_word", "_cl_bits")


def _qualifying(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b, block) of groups whose unions share enough tokens for a link of their smallest members: neither group is opened for the others. A block of a has about OPEN_BLOCK partners.

    Only unions of groups in pairs are read. They are shuffled to the pairs once for b, whose groups are in few pairs; those of a, which
    may be in very many, are joined where the pairs then are."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("grp"))
    unions = maybe_among(texts.filter("bits IS NOT NULL").select("grp", "lo", "size", "bits"), ids, "grp").filter("_hit").drop("_hit")
    side = lambda s: unions.select(F.col("grp").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("lo", "size", "bits")])
    partners = pairs.groupBy("a").agg(F.ceil(F.count("*") / OPEN_BLOCK).alias("blocks"))
    dealt = pairs.join(own_exchange(partners, "a"), "a").withColumn("block", F.pmod(F.xxhash64("b"), "blocks").cast("int")).drop("blocks")
    both = own_exchange(dealt, "b").join(side("b"), "b")
    both = own_exchange(both, "a").join(side("a"), "a")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            rows = zip(*(batch.column(k).to_pylist() for k in range(3, 7)), *(batch.column(k) for k in (7, 8)), strict=True)
            for a_lo, b_lo, a_size, b_size, a_bits, b_bits in rows:
                most = most_shared(a_size, np.frombuffer(a_bits.as_buffer(), np.uint8), b_size, np.frombuffer(b_bits.as_buffer(), np.uint8))
                kept.append((num + den) * most >= num * (a_lo + b_lo))
            yield batch.select([0, 1, 2]).filter(pa.array(kept, pa.bool_()))

    small_batches(pairs.sparkSession)
    return both.select("a", "b", "block", "a_lo", "b_lo", "a_size", "b_size", "a_bits", "b_bits").mapInArrow(lean(bound), "a long, b long, block int")


def _links(docs: DataFrame, texts: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) of groups, a written table, that a link joins.

    Qualifying groups are opened: one text of each kind of their members is fetched, those of a once for a block of OPEN_BLOCK partners,
    those of b once for a pair. A task holds the sets of a; each set of b is bounded by what it shares with the union of a's tokens before
    it is compared with a's members."""
    spark = docs.sparkSession
    dealt = stored(_qualifying(pairs, texts, num, den), "qualifying")
    sides = dealt.select("a", "block").distinct().select("a", "block", F.col("a").alias("grp"), F.lit(0).alias("side")).union(dealt.select("a", "block", F.col("b").alias("grp"), F.lit(1)))
    wanted = stored(texts.select("grp", "doc_id").join(sides, "grp"), "opened-texts")
    fetched = maybe_among(docs, wanted.select("doc_id")).filter("_hit").drop("_hit").join(wanted, "doc_id")
    both = fetched.repartition("a", "block").sortWithinPartitions("a", "block", "side", "grp", "doc_id").select("a", "block", "side", "grp", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, now, left, union, done = Shingler(n), None, [], None, None
        for batch in batches:
            found = []
            for a, block, side, grp, s in zip(*(batch.column(k).to_pylist() for k in range(4)), shingler.sets(batch.column(4)), strict=True):
                if (a, block) != now:
                    now, left, union, done = (a, block), [], None, None
                if side == 0:
                    left.append(s)
                    continue
                if grp == done or not left:
                    continue
                if union is None:
                    union = distinct(np.concatenate(left))
                    least = min(map(len, left))
                shared = len(np.intersect1d(s, union, assume_unique=True))
                if not shared or den * shared < num * (len(s) + max(least, shared) - shared):
                    continue  # no member shares more than the union does
                if any(linked(s, x, num, den) for x in left):
                    found.append((a, grp))
                    done = grp
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    small_batches(spark)
    return both.mapInArrow(lean(check), "a long, b long")


def _could(x: str, y: str, num: int, den: int) -> Column:
    """Whether sizes and what is left from a shared token on allow a link."""
    c = lambda side, name: F.col(f"{side}.{name}")
    fits = (den * c(x, "hi") >= num * c(y, "lo")) & (den * c(y, "hi") >= num * c(x, "lo")) & (c(x, "short") | c(y, "short"))
    return fits & ((num + den) * F.least(c(x, "rest"), c(y, "rest")) >= num * (c(x, "lo") + c(y, "lo")))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, its own included) of every row of docs (doc_id, text).

    Two documents link when their shingle sets' Jaccard similarity is at least num / den. Candidates are groups that share a token of their
    prefixes and whose sizes and remaining shingles allow a link; the unions of both groups then bound what their members can share, and
    only groups that still qualify are opened, on whole texts. Every pair of groups that isn't connected yet is taken, so no component
    misses a link. First each token's groups are held against one of them alone, that with the fewest tokens before this one, which joins
    the parts of a large group of near copies; only what is still apart is then paired, by components first, so such a group costs no
    pairs of its members.

    A row with a null doc_id is linked with nothing and has a null component. A null or empty text, or one of white space, has no shingles
    and no links. Rows that share a doc_id share its links. An empty table gives no rows; further columns are left out."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = _sign(docs, n)
    marks = signed.filter("piece IS NULL").select("doc_id", "n", "h1", "h2")
    both = _groups(docs, signed, n, num, den)
    texts = both.filter("token IS NULL").select("doc_id", "n", "h1", "h2", "grp", "lo", "size", "bits")
    members = marks.filter("n > 0 AND doc_id IS NOT NULL").join(texts.select("n", "h1", "h2", "grp"), ["n", "h1", "h2"]).select("doc_id", "grp")
    several = marks.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low <> high").select("doc_id")  # ids of different texts
    again = members.join(several, "doc_id")
    again = again.join(again.groupBy("doc_id").agg(F.min("grp").alias("b")), "doc_id").select(F.col("grp").alias("a"), "b")
    repeated = not several.isEmpty()

    entries = both.filter("token IS NOT NULL").select("token", "grp", "lo", "hi", "rest", "short")
    early = F.floor((F.col("lo") - F.col("rest")) * 20 / F.col("lo")) + 1024  # twentieths of the smallest member before the token; below 0 for a larger one
    place = F.shiftleft(early.cast("bigint"), 44) + F.shiftrightunsigned(F.xxhash64("grp"), 20)
    leads = entries.groupBy("token").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.min(place).alias("lead")).filter("low <> high").select("token", "lead")
    shared = stored(entries.join(own_exchange(leads, "token"), "token").select("token", "grp", "lo", "hi", "rest", "short", (place == F.col("lead")).alias("leads")), "shared-tokens")
    x, y = shared.filter("leads").alias("x"), shared.filter("NOT leads").alias("y")
    stars = stored(x.join(y, "token").filter(_could("x", "y", num, den)).select(F.col("x.grp").alias("a"), F.col("y.grp").alias("b")).filter("a <> b").distinct(), "stars")
    edges = _links(docs, texts, stars, n, num, den)
    edges = stored(again.union(edges) if repeated else edges, "links")

    placed = shared.join(components(edges, written=True), F.col("grp") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "grp")).drop("node", "component", "leads")
    apart = placed.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("token")
    placed = stored(placed.join(own_exchange(apart, "token"), "token"), "tokens-apart")
    parts = placed.groupBy("token", "comp").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("rest").alias("rest"), F.max("short").alias("short"))
    x, y = parts.filter("short").alias("x"), parts.alias("y")
    met = x.join(y, "token").filter((F.col("x.comp") < F.col("y.comp")) | (~F.col("y.short") & (F.col("x.comp") != F.col("y.comp")))).filter(_could("x", "y", num, den))
    met = met.select("token", F.col("x.comp").alias("comp"), F.col("y.comp").alias("other"))
    x, y = placed.alias("x"), placed.withColumnRenamed("comp", "other").alias("y")
    pairs = met.join(x, ["token", "comp"]).join(y, ["token", "other"]).filter(_could("x", "y", num, den)).select(F.least("x.grp", "y.grp").alias("a"), F.greatest("x.grp", "y.grp").alias("b")).distinct()
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = stored(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
    found = components(edges, written=True) if pairs.isEmpty() else components(edges.union(_links(docs, texts, pairs, n, num, den)))

    ends = members.join(found, F.col("grp") == F.col("node"), "left").select("doc_id", F.coalesce("component", "grp").alias("comp"))
    least = ends.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("k")).filter("k > 1").drop("k")
    moved = ends.join(own_exchange(least, "comp"), "comp").filter("component_id <> doc_id").select("doc_id", "component_id").distinct()
    shown = lambda component: ("doc_id", F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id"))
    whole = marks.filter("doc_id IS NOT NULL").join(moved, "doc_id", "left").select(*shown(F.coalesce("component_id", "doc_id")))
    return whole.union(marks.filter("doc_id IS NULL").select(*shown(F.col("doc_id"))))  # not all to the one task of the null key


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs (doc_id, text and any others) with one row of each group of near duplicates, that with the smallest doc_id.

    All columns stay, whatever their names. Rows of a null doc_id stay. Of rows with the same doc_id one stays (the first by text, null first). Only rows whose id may be dropped
    or repeated are shuffled with their texts; the others pass straight through."""
    names, docs = docs.columns, docs.toDF(*[c if c in ("doc_id", "text") else f"in{i}" for i, c in enumerate(docs.columns)])
    found = stored(jaccard_components(docs, n, num, den), "near-duplicates").filter("doc_id IS NOT NULL")
    per = found.groupBy("doc_id").agg((F.min("component_id") < F.col("doc_id")).alias("_cl_drop"), (F.count("*") > 1).alias("_cl_again")).filter("_cl_drop OR _cl_again")
    per = stored(per, "drops")
    seen = maybe_among(docs, per.select("doc_id"))
    rest = seen.filter("_hit").drop("_hit").join(per, "doc_id", "left").filter("_cl_drop IS NULL OR NOT _cl_drop").drop("_cl_drop")
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first())
    once = rest.filter("_cl_again").withColumn("_cl_k", F.row_number().over(order)).filter("_cl_k = 1").drop("_cl_k")
    return seen.filter("NOT _hit").drop("_hit").unionByName(rest.filter("_cl_again IS NULL OR NOT _cl_again").drop("_cl_again")).unionByName(once.drop("_cl_again")).select(*docs.columns).toDF(*names)


def op7(spark, sf_dir: str) -> DataFrame:
    """Links of all documents on four-word shingles. A null, empty or wordless text is linked with nothing; rows of a repeated doc_id share its links, those of a null one have none; very long texts are compared whole; an empty table gives no rows."""
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), 4, 85, 100)
