"""Fingerprints, BPE, token counts and toxicity against plain versions of themselves."""

import gc
import hashlib
import math
import mmap
import random
import weakref

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import oracle
from codelode import store
from codelode.llm import bpe, files, syncmers, token_counts, toxicity, transducer
from codelode.llm.common import scratch, small_batches, stored
from codelode.llm.queries import QUERIES

WORD, BYTE = bpe.vocabulary("word_bpe_49k.json"), bpe.vocabulary("byte_bpe_50k.json")
PIECES = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'ve", "'t", "'r", "1", "23", "½", "é", "É", "Σ", "σ", "ς", "İ", "ı", "ſ", "!", "?", "<|endoftext|>", "<|startoftext|>", "<|", "漢", "字", "́", "e", "\xa0", "\u2003", "\x1c", "\x85", "\u200b", "😀", "ﬁ", "ǅ", "Ⅳ", "٣", "\x00", "\x0b", "\r\n", "word", "the", "don't"]


@pytest.fixture(scope="module")
def odd():
    pick = random.Random(5)
    return ["".join(pick.choice(PIECES) for _ in range(pick.randint(0, 40))) for _ in range(1500)] + ["", "'r", "'", " 're", "   ", "a   ", "\n\n's", "x" * 3000, "  '", "\n 'll"]


def closed_syncmers(hashes: list[int], k: int, s: int, mer) -> list[int]:
    """Starts of the k-mers whose least s-mer stands first or last."""
    out = []
    for i in range(len(hashes) - k + 1):
        inner = [mer(hashes[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_anchors_are_the_closed_syncmers(spark):
    text = " ".join(random.Random(1).choice(["alpha", "beta", "gamma", "delta", "of", "the"]) + str(i % 11) for i in range(200))
    row = spark.range(1).select(F.transform(F.split(F.lit(text), " "), lambda w: F.xxhash64(w)).alias("h"), syncmers.anchors(F.lit(text)).alias("a")).first()
    hashes = row["h"]
    pairs = {(a, b): None for a, b in zip(hashes, hashes[1:])}
    got = spark.createDataFrame([(a, b) for a, b in pairs], "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()
    known = {(r["a"], r["b"]): r["h"] for r in got}
    starts = closed_syncmers(hashes, syncmers.K, syncmers.S, lambda m: known[tuple(m)])
    want = spark.createDataFrame([(i, hashes[i : i + syncmers.K]) for i in starts], "i int, k array<long>").select(F.shiftright(F.xxhash64("k"), 32).cast("int").alias("h")).collect()
    assert row["a"] == [r["h"] for r in want]
    assert max(np.diff([-1, *starts, len(hashes) - syncmers.K + 1])) <= syncmers.K - syncmers.S + 1  # no longer gap


def test_short_texts_have_anchors(spark):
    pick = random.Random(4)
    texts = [" ".join(f"t{pick.randint(0, 10**6)}" for _ in range(n)) for n in range(1, 16) for _ in range(40)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("h"), syncmers.anchors(F.col("text")).alias("a")).collect()
    pairs = spark.createDataFrame([p for r in rows for p in zip(r["h"], r["h"][1:])], "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()
    known = {(r["a"], r["b"]): r["h"] for r in pairs}
    mers = {r["text"]: [known[p] for p in zip(r["h"], r["h"][1:])] for r in rows}
    none = [r for r in rows if len(r["h"]) >= syncmers.K and not closed_syncmers(r["h"], syncmers.K, syncmers.S, lambda m: known[tuple(m)])]
    assert {len(r["h"]) for r in none} >= set(range(9, 12)) and max(len(r["h"]) for r in none) <= 14
    least = {r["text"]: max(0, mers[r["text"]].index(min(mers[r["text"]])) - (syncmers.K - syncmers.S)) for r in none}
    want = spark.createDataFrame([(r["text"], r["h"][least[r["text"]] :][: syncmers.K]) for r in none], "text string, k array<long>").select("text", F.shiftright(F.xxhash64("k"), 32).cast("int").alias("h")).collect()
    assert {r["text"]: r["a"] for r in none} == {r["text"]: [r["h"]] for r in want}
    assert all(r["a"] for r in rows) and len({tuple(r["a"]) for r in rows}) == len(rows)  # no two alike


def test_fingerprints_of_awkward_rows(spark, docs, empty):
    text = lambda t: spark.range(1).select(syncmers.anchors(F.lit(t).cast("string")).alias("a")).first()["a"]
    assert [text(t) for t in (None, "", " \n")] == [[], [], []] and len(text("one two")) == 1
    both = syncmers.with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), {}, ["text"])
    rows = both.collect()
    assert len(rows) == docs.count() and all(r["next_text"] is not None for r in rows)
    ids = sorted({r["doc_id"] for r in rows if r["doc_id"] is not None}, reverse=True)
    texts = {i: {r["text"] for r in rows if r["doc_id"] == i} for i in [*ids, None]}
    for r in rows:
        i = r["doc_id"]
        later = None if i in (None, ids[-1]) else ids[ids.index(i) + 1]
        assert r["next_text"] in texts[i] | texts[later] | (texts[ids[0]] if i is None else set())
    assert syncmers.with_next(empty.select("doc_id", "text"), {}, ["text"]).count() == 0
    (one,) = syncmers.with_next(docs.select("doc_id", "text").filter("doc_id = 4"), {}, ["text"]).collect()
    assert one["next_text"] == one["text"]


def test_op1(spark):
    docs = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").collect()), reverse=True)
    after = {a[0]: b[1] for a, b in zip(docs, [*docs[1:], docs[0]])}
    rows = QUERIES["op1_syncmer_fingerprints"](spark, oracle.SF).collect()
    assert len(rows) == len(docs)
    text, prints = dict(docs), {}
    for r in rows:
        t, half = text[r["doc_id"]], len(text[r["doc_id"]]) // 2
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256((t[: len(t) - half] + after[r["doc_id"]][:half]).encode()).hexdigest())
        cut = lambda p: {p[i : i + 8] for i in range(0, len(p), 8)}
        a, b = cut(r["fingerprint"]), cut(r["edited_fingerprint"])
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]


def test_transducers_share_endings_and_give_every_value():
    words = sorted(f"{a}{b}{c}".encode() for a in ("x", "yy", "z") for b in ("one", "two") for c in ("ing", "ings", ""))
    lexicon = transducer.Lexicon(np.frombuffer(transducer.compile_lexicon((w, k) for k, w in enumerate(words)), np.uint8))
    assert [lexicon.get(w) for w in words] == list(range(len(words)))
    assert [lexicon.get(w) for w in (b"", b"x", b"xoneingsx", b"q")] == [-1] * 4
    assert len(lexicon.arrays["final"]) <= 15  # the endings once, not three times
    assert transducer.Lexicon(np.frombuffer(transducer.compile_lexicon([]), np.uint8)).get(b"a") == -1


def test_encoding_is_the_librarys(spark, odd):
    library = Tokenizer.from_file(WORD)
    coder = bpe.Encoder(bpe.build_lexicon(spark, ["the", "word", "a", "b", "é"], WORD), WORD)
    for t in odd:
        ids = library.encode(t, add_special_tokens=False).ids
        assert coder.text(t) == (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)), repr(t)


def test_op5_and_awkward_rows(spark, docs, empty):
    library = Tokenizer.from_file(WORD)
    given = docs.select("doc_id", "text", "n_tokens")
    out = bpe.encode(given, WORD, with_ids=True)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, library.encode(r["text"] or "", add_special_tokens=False).ids) for r in given.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"]) for r in out.collect()) == want
    assert bpe.encode(empty.select("doc_id", "text"), WORD).count() == 0
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").collect()}
    for r in QUERIES["op5_bpe_transducer"](spark, oracle.SF).collect():
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


@pytest.mark.parametrize("chunk", [2, 3, 7, 64, 512])
def test_words_whatever_the_chunks(odd, chunk):
    library = Tokenizer.from_file(BYTE)
    classes = token_counts.character_classes(library)
    texts = [t for t in odd if "<|" not in t][:400]
    line = "\n".join(texts) + "\n"
    kinds = classes[np.frombuffer(line.encode("utf-32-le"), np.uint32)]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kinds[ends] = token_counts.END
    chunks = token_counts.Chunks(kinds, ends, chunk)
    want = [len([1 for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(t) if b > a]) for t in texts]
    assert chunks.totals(np.ones(len(chunks.common[0]), int), np.ones(len(chunks.own[0]), int)).tolist() == want
    # a composition from the state in which texts begin meets the library's words and no others
    spans = {(a, b): k for k, (a, b) in enumerate(sorted({(at + a, at + b) for at, t in zip([0, *(ends[:-1] + 1).tolist()], texts) for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(t) if b > a}))}
    mark = lambda begins, until: np.array([spans.get(p, -1) + 2 for p in zip(begins.tolist(), until.tolist())], np.int64)
    sums = chunks.totals(mark(*chunks.common[1:]), mark(*chunks.own[1:])).tolist()
    owner = np.searchsorted(ends, [a for a, _ in spans])
    assert sums == np.bincount(owner, np.arange(len(spans)) + 2, len(texts)).astype(int).tolist()


def test_counts_are_the_librarys(spark, odd, docs, empty):
    library = Tokenizer.from_file(BYTE)
    counter = token_counts.Counter(token_counts.compile_counter(spark, BYTE), BYTE)
    assert counter.texts(odd) == [len(library.encode(t, add_special_tokens=False).ids) for t in odd]
    given = docs.select("doc_id", "text", "n_tokens")
    out = token_counts.count_tokens(given, BYTE)
    assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out.collect()) == sorted((len((t := r["text"] or "").encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 1024) for r in given.collect())
    assert token_counts.count_tokens(empty, BYTE).count() == 0
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").collect()}
    assert all(r["n_tokens"] == len(library.encode(text[r["doc_id"]], add_special_tokens=False).ids) for r in QUERIES["op9_token_counts"](spark, oracle.SF).collect())


def test_features_are_distinct_and_whole():
    maker = toxicity.Features()
    text = "one two three two"
    assert len(maker.of("")) == 0 and len(maker.of("...")) == 0
    # 3 words, 9 heads, 3 pairs, 2 skips, 2 triples
    assert len(maker.of(text)) == 3 + 9 + 3 + 2 + 2
    assert (toxicity.Features().of(text) == maker.of(text)).all()
    maker.KEPT = 4
    many = " ".join(f"w{i}" for i in range(50))
    assert (maker.of(many) == toxicity.Features().of(many)).all()


def test_fit_finds_the_words_that_matter():
    pick, maker = random.Random(2), toxicity.Features()
    text = lambda bad: " ".join([*(f"w{pick.randint(0, 400)}" for _ in range(60)), *(["awful"] * bad)])
    rows = [(maker.of(text(i % 4 == 0)), int(i % 4 == 0)) for i in range(400)]
    weights, bias = toxicity.fit(rows)
    p = lambda t: 1 / (1 + np.exp(-(bias + weights[maker.of(t)].sum())))
    assert sum(p(text(True)) >= 0.3 for _ in range(50)) >= 48 and sum(p(text(False)) >= 0.3 for _ in range(50)) <= 2
    assert (weights != 0).mean() < 0.01  # sparse
    assert toxicity.fit([])[1] == pytest.approx(0.0) and not toxicity.fit([])[0].any()
    assert not toxicity.fit([(np.array([1]), 1)])[0].any()


def test_op6_and_awkward_rows(spark, docs, empty):
    import zlib

    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert toxicity.score(empty, toxicity.train(empty, labels.limit(0))).count() == 0
    assert "score" in toxicity.score(docs, model, prefix="_t_").columns  # the column of that name stays
    again = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" and more words"))))
    both = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    rows = toxicity.sampled(again, both)
    assert len(rows) == len({r["doc_id"] for r in docs.filter("text IS NOT NULL").collect() if r["doc_id"] is not None and r["doc_id"] < 12 and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2})  # one text an id
    few = toxicity.sampled(docs, both, features=30)
    assert sum(len(x) for x, _ in few) <= 30 and all(any(len(x) == len(z) and (x == z).all() for z, _ in toxicity.sampled(docs, both)) for x, _ in few)  # whole texts


def test_op6_finds_what_was_held_out(spark):
    import zlib

    out = QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.1").collect()
    known = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    held = [(r["predicted"], known[r["doc_id"]]) for r in out if r["held_out"] and known.get(r["doc_id"]) is not None]
    found = sum(p and y for p, y in held)
    assert found >= 0.85 * sum(y for _, y in held) and found >= 0.85 * sum(p for p, _ in held)  # recall and precision; a model that never says toxic has neither


def plain_ftrl(rows, epochs, alpha, beta, l1, l2, seed):
    """Coordinate by coordinate, as it is published."""
    rate = (sum(y for _, y in rows) + 0.5) / (len(rows) + 1)
    start, z, n = math.log(rate / (1 - rate)), {}, {}

    def weight(i):
        own = 0.0 if i == "bias" else l1
        if abs(z.get(i, 0.0)) <= own:
            return 0.0
        return -(z[i] - math.copysign(own, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for r in order:
            x, y = rows[r]
            at = [*x.tolist(), "bias"]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-(start + sum(w.values())))) - y
            for i in at:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if i != "bias"}, start + weight("bias")


def test_fit_is_plain_ftrl():
    pick = random.Random(9)
    rows = [(np.array(sorted(pick.sample(range(60), 12)) + ([70] if k % 3 == 0 else [])), int(k % 3 == 0)) for k in range(90)]
    for epochs, alpha, l1, l2 in ((1, 1.0, 0.5, 0.1), (3, 0.3, 2.0, 0.5)):
        weights, bias = toxicity.fit(rows, 7, epochs, alpha, 1.0, l1, l2)
        want, start = plain_ftrl(rows, epochs, alpha, 1.0, l1, l2, 7)
        assert bias == pytest.approx(start) and all(weights[i] == pytest.approx(w, abs=1e-6) for i, w in want.items()) and (weights != 0).sum() == sum(abs(w) > 1e-9 for w in want.values())


def test_settings_are_chosen_by_folds():
    pick, maker = random.Random(3), toxicity.Features()
    rows = [(maker.of(" ".join([*(f"w{pick.randint(0, 300)}" for _ in range(20)), *(["awful"] * (k % 5 == 0))])), int(k % 5 == 0)) for k in range(150)]
    best, *_, worst = toxicity.choose(rows, [(4, 0.3, 1.0, 0.5), (1, 0.01, 30.0, 2.0)])
    assert best[2] == (4, 0.3, 1.0, 0.5) and best[0] > worst[0] == 0


def test_files_are_published_whole(tmp_path):
    files.publish(name := f"file://{tmp_path}/a/b", b"abc")
    assert bytes(files.mapped(name)) == b"abc" and [p.name for p in (tmp_path / "a").iterdir()] == ["b"]
    files.publish(name := f"{tmp_path}/empty", b"")
    assert len(files.mapped(name)) == 0


def test_long_texts_are_read_and_written_in_small_pieces(spark):
    """A row group, a page and a scan's batch of long texts stay small, in a step and in what a caller writes of a stage's result."""
    small_batches(spark)
    texts = spark.range(6000, numPartitions=1).select("id", F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.sha2(F.concat_ws(" ", "id", k), 256))).alias("text"))
    step = stored(texts, "small-pieces")
    own = scratch(spark, "small-pieces")
    step.write.parquet(own)
    for df in (step, spark.read.parquet(own)):
        groups = [m.row_group(g) for f in df.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for g in range(m.num_row_groups)]
        assert max(g.column(1).total_compressed_size for g in groups) < 12 << 20
        assert sum(g.num_rows for g in groups) == 6000
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) * 3840 < 4 << 20
    assert step.exceptAll(texts).isEmpty()


def test_the_fits_features_are_pages_of_a_file_in_the_driver(spark):
    """Features come by files that tasks write; the driver maps one of them all, and they are those of the texts."""
    texts = {i: " ".join(f"w{i * k % 37}" for k in range(1, 5 + i)) if i % 9 else "" for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, toxic int")
    rows = toxicity.sampled(docs, labels)
    ids = [r[0] for r in labels.filter(~toxicity.held_out()).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").select("doc_id").collect()]
    assert len(rows) == len(ids)
    maker = toxicity.Features()
    for (x, y), i in zip(rows, ids, strict=True):
        assert y == i % 2 and x.tolist() == maker.of(texts[i]).tolist()
        while isinstance(x, np.ndarray):
            x = x.base
        assert isinstance(x, mmap.mmap)


def test_a_step_collects_the_drivers_garbage_once_its_heap_has_grown(spark, monkeypatch):
    kept = []
    for share in (1.0, 0.0):  # never, always
        monkeypatch.setattr(store, "HEAP_SHARE", share)
        monkeypatch.setattr(store, "_collected", float("-inf"))
        stored(spark.range(3), "garbage")
        kept.append(store._collected > float("-inf"))
    assert kept == [False, True]
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    count = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    ring: list = [np.zeros(1)]
    ring.append(ring)  # only Python's own collection finds that nothing needs it
    seen, before = weakref.ref(ring[0]), count()
    gc.disable()
    try:
        del ring
        monkeypatch.setattr(store, "_collected", float("-inf"))
        assert stored(spark.range(3), "garbage").count() == 3 and seen() is None and count() > before
    finally:
        gc.enable()
