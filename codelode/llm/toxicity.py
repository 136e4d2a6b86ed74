"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import remove
from . import files
from .common import give_back, lean, own_names, scratch, small_batches, stored, table

#: Hashed features; weights are one float32 each, so what is broadcast has at most 4 * DIMS bytes.
DIM_BITS = 20
DIMS = 1 << DIM_BITS
#: The fit sees at most so many labelled documents, those whose hashed ids are smallest, with all their features; at most so many features together, so that very long texts don't fill the driver: one that would go beyond is passed over.
SAMPLE, SAMPLE_FEATURES = 6000, 40_000_000
#: Settings: the best that choose() finds in GRID by three folds of training rows (of sf0.1) alone. A high L1 asks for evidence from several documents.
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.3, 1.0, 9.0, 0.5
THRESHOLD = 0.3
#: The most that a text without evidence scores, as a share of the threshold.
WITHOUT = 0.99
_WORD = re.compile(r"[^\W_]+")
#: Word heads used beside whole words, in letters: endings vary where stems don't.
HEADS = (4, 5, 6)


def _mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Features(dict):
    """Hashed features of texts: words, their heads, word pairs, triples and pairs that skip one word. The dictionary gives lately seen words their rows of hashes."""

    #: Words whose hashes are remembered at a time.
    KEPT = 200_000

    def __init__(self) -> None:
        super().__init__()
        self.rows = np.zeros((len(HEADS) + 1, self.KEPT), np.uint64)
        self.new: list[list[int]] = []

    def __missing__(self, w: str) -> int:
        self.new.append([xxhash.xxh64_intdigest(w), *[xxhash.xxh64_intdigest(w[:n], n) for n in HEADS]])
        at = self[w] = len(self)
        return at

    def of(self, text: str) -> np.ndarray:
        """The distinct features of a whole text, ascending; none for a text without words."""
        words = _WORD.findall(text.lower())
        if not words:
            return np.zeros(0, np.int64)
        if len(self) + len(words) > self.KEPT:
            self.clear()
            if len(words) > self.KEPT:  # a text of very many words may need more rows
                self.rows = np.zeros((len(HEADS) + 1, len(words)), np.uint64)
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self.rows[:, len(self) - len(self.new) : len(self)] = np.array(self.new, np.uint64).T
            self.new.clear()
        rows = self.rows[:, at]
        one, parts = rows[0], [rows.ravel()]
        turned = (one << np.uint64(21)) | (one >> np.uint64(43))
        if len(one) > 1:
            pair = _mix(turned[:-1] + one[1:])
            parts.append(pair)
        if len(one) > 2:
            parts.append(_mix(turned[:-2] + one[2:] + np.uint64(0x9E3779B97F4A7C15)))
            parts.append(_mix((pair[:-1] << np.uint64(7)) + one[2:]))
        found = (np.concatenate(parts) >> np.uint64(64 - DIM_BITS)).astype(np.int32)
        found.sort()
        return found[np.concatenate([[True], found[1:] != found[:-1]])]


def fit(rows: list[tuple[np.ndarray, int]], seed: int = 7, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, float]:
    """Weights (mostly zero) and bias. rows: distinct features and the label, 0 or 1.

    Each coordinate has its own rate, alpha / (beta + root of its summed squared gradients); L1 holds a weight at zero until its evidence
    exceeds it. Without rows of both labels the weights are zero and the bias gives the rate of label 1, one half without rows."""
    z, n, w = np.zeros(DIMS + 1), np.zeros(DIMS + 1), np.zeros(DIMS + 1)
    rate = (sum(y for _, y in rows) + 0.5) / (len(rows) + 1)
    start = float(np.log(rate / (1 - rate)))
    if not 0 < sum(y for _, y in rows) < len(rows):
        return np.zeros(DIMS, np.float32), start
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for r in order:
            x, y = rows[r]
            at = np.append(x, DIMS)
            zi, ni = z[at], n[at]
            shrink = np.full(len(at), l1)
            shrink[-1] = 0.0
            wi = np.where(np.abs(zi) <= shrink, 0.0, -(zi - np.sign(zi) * shrink) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(start + wi.sum(), -35, 35)))
            g = p - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * wi
            n[at] = ni + g * g
    live = np.abs(z) > l1
    live[-1] = True
    limit = np.full(DIMS + 1, l1)
    limit[-1] = 0.0
    w[live] = (-(z - np.sign(z) * limit) / ((beta + np.sqrt(n)) / alpha + l2))[live]
    return w[:-1].astype(np.float32), start + float(w[-1])


#: What choose() chooses from: epochs, rates and penalties around the usual ones.
GRID = [(epochs, alpha, l1, l2) for epochs in (2, 4, 8) for alpha in (0.1, 0.3, 1.0) for l1 in (1.0, 3.0, 9.0, 15.0, 25.0) for l2 in (0.5, 2.0)]


def choose(rows: list[tuple[np.ndarray, int]], grid: list[tuple] = GRID, folds: int = 3) -> list[tuple[float, float, tuple]]:
    """Settings (epochs, alpha, l1, l2) by cross-validation inside the rows given, best first: F1 at THRESHOLD and mean log loss over all folds. Row k is of fold k % folds."""
    out = []
    for epochs, alpha, l1, l2 in grid:
        p = np.zeros(len(rows))
        for k in range(folds):
            weights, bias = fit([r for i, r in enumerate(rows) if i % folds != k], epochs=epochs, alpha=alpha, l1=l1, l2=l2)
            for i in range(k, len(rows), folds):
                p[i] = 1 / (1 + np.exp(-np.clip(bias + float(weights[rows[i][0]].sum(dtype=np.float64)), -35, 35)))
        y = np.array([y for _, y in rows])
        found = p >= THRESHOLD
        f1 = 2 * (found & (y == 1)).sum() / max(found.sum() + y.sum(), 1)
        held = np.clip(p, 1e-9, 1 - 1e-9)
        out.append((float(f1), float(-(y * np.log(held) + (1 - y) * np.log(1 - held)).mean()), (epochs, alpha, l1, l2)))
    return sorted(out, key=lambda r: (-r[0], r[1]))


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = SAMPLE_FEATURES) -> list[tuple[np.ndarray, int]]:
    """Features and labels of at most sample labelled documents outside the held-out quarter, in the order of their hashed ids.

    Rows with a null id, label or text don't count as labelled; of labels that contradict each other 1 counts; of texts that share an id
    the one with the fewest features, then the smallest hash. The sample is drawn by hashed id from all labelled rows; hashed features,
    not texts, come to the driver, by files that tasks write and it maps, at most so many as features says: a document that would go beyond is passed over whole."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")).filter("_id IS NOT NULL AND _toxic IN (0, 1)").filter(~held_out("_id")).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    chosen = known.withColumn("_hash", F.xxhash64(F.lit(11), "_id")).orderBy("_hash", "_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).filter("text IS NOT NULL").select("_hash", "_id", "text", "_toxic")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Features()
        for b in batches:
            packed = [maker.of(t).astype(np.int32).tobytes() for t in b.column(2).to_pylist()]
            marks = [xxhash.xxh64_intdigest(x) >> 1 for x in packed]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary()), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(marks, pa.int64()), b.column(3).cast(pa.int32())], ["_hash", "_id", "x", "n", "mark", "y"])

    found = stored(texts.mapInArrow(lean(made), "_hash long, _id long, x binary, n long, mark long, y int"), "toxicity-sample")
    one = found.groupBy("_hash", "_id").agg(F.min(F.struct("n", "mark")).alias("m")).select("_hash", "_id", "m.*")
    room, kept = features, []
    for r in sorted(map(tuple, one.collect())):  # at most sample rows
        if r[2] <= room:
            kept.append(r)
            room -= r[2]
    if not kept:
        return []
    taken = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in zip(*kept, strict=True)], ["_hash", "_id", "n", "mark"]))
    folder = scratch(spark, "toxicity-features")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [x.as_buffer() for x in b.column(2)]
            files.publish(name := f"{folder}/{uuid.uuid4().hex}", b"".join(packed))  # a file for each batch; a task that runs twice has others
            ends = np.cumsum([0, *(x.size // 4 for x in packed)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array([name] * len(packed), pa.string()), pa.array(ends[:-1]), pa.array(ends[1:])], ["_hash", "_id", "y", "file", "start", "stop"])

    rows = found.join(F.broadcast(taken), ["_hash", "_id", "n", "mark"]).select("_hash", "_id", "x", "y").mapInArrow(lean(written), "_hash long, _id long, y int, file string, start long, stop long").collect()
    order = {}
    for r in rows:
        order.setdefault((r["_hash"], r["_id"]), r)  # equal texts of an id
    held, base = _one_file(sorted({r["file"] for r in order.values()}))
    remove(spark, folder)
    return [(held[base[r["file"]] + r["start"] : base[r["file"]] + r["stop"]], r["y"]) for _, r in sorted(order.items())]


def _one_file(names: list[str]) -> tuple[np.ndarray, dict[str, int]]:
    """Files of features in one that the driver maps, so that they are pages of a file and not memory, and where each begins."""
    base, size = {}, 0
    with tempfile.TemporaryFile() as out:
        for name in names:
            base[name] = size // 4
            store, path = files.at(name)
            with store.open_input_stream(path, compression=None) as source:
                while block := source.read(1 << 20):
                    size += out.write(block)
        out.flush()
        return (np.memmap(out, np.int32, "r") if size else np.zeros(0, np.int32)).view(np.ndarray), base  # the mapping keeps the file


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights and bias fitted on a bounded sample of labelled documents (see sampled); no weights where it has no labels of both kinds."""
    model = fit(sampled(docs, labels, sample))
    give_back()
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from threshold on, else 0), their names after prefix.

    Where nothing in a text speaks for a label, because it has no words or the model no weights, the score is the bias's or, if that is less,
    WITHOUT of the threshold: no document is called toxic for what the sample's labels happen to be. Columns of those names are replaced;
    an empty df gives no rows. Nothing is shuffled."""
    spark = docs.sparkSession
    small_batches(spark)
    at = np.flatnonzero(model[0])
    held: Broadcast = spark.sparkContext.broadcast((at.astype(np.int32), model[0][at], model[1]))  # at most 8 * DIMS bytes

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from lean(scores)(batches)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, values, bias = held.value
        weights, maker = np.zeros(DIMS, np.float32), Features()
        weights[at] = values
        for texts in batches:
            raw, unjudged = np.zeros(len(texts)), np.zeros(len(texts), bool)
            for i, t in enumerate(texts):
                x = maker.of(t or "")
                raw[i], unjudged[i] = bias + float(weights[x].sum(dtype=np.float64)), not len(x) or not len(at)
            p = 1 / (1 + np.exp(-np.clip(raw, -35, 35)))
            yield pd.Series(np.where(unjudged, np.minimum(p, WITHOUT * threshold), p))

    kept = own_names(docs, f"{prefix}score", f"{prefix}predicted")
    return kept.withColumn(f"{prefix}score", scored(F.col(text))).withColumn(f"{prefix}predicted", (F.col(f"{prefix}score") >= threshold).cast("int"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model fitted on their labels. A null, empty or wordless text scores as the bias does, but below the threshold, and so do all texts where the labels give no weights; rows of a repeated or null doc_id each have a score (a null one isn't held out); very long texts are scored whole; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
