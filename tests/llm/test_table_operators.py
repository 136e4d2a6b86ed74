"""Archives, mixing, sharding, near duplicates, URL rules, vector search and the pipeline against plain versions of themselves."""

import base64
import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import oracle
from codelode.llm import components, jaccard, mixing, mtree, sharding, url_filter, warc
from codelode.llm.common import scratch
from codelode.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    oracle.same(spark, QUERIES[name], ORACLE_SQL[name])


# --- archives --------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string, payload_bytes string"


def test_archives_hold_what_was_written(spark, tmp_path):
    big = "<p>" + "long " * 200_000
    rows = [(i, f"http://h/{i} ü", h, "x", "y") for i, h in enumerate([None, "", "a", "a", big, big, "é" * 9, *(f"<html>page {i} {'text ' * 50}</html>" for i in range(200))])]
    rows += [(2, None, "a", "x", "y"), (3, "again", "a", "x", "y"), (None, None, "a", None, None), (None, "n", "lone", None, None), (None, "n", "lone", None, None)]
    pages = spark.createDataFrame(rows, PAGES).repartition(2)
    listed = warc.write_archives(pages, f"file://{tmp_path}", archive_bytes=20_000)
    got = warc.read_archives(listed, with_payload=True).collect()
    assert listed.count() > 2 and listed.agg(F.sum("records")).first()[0] == len(rows) == len(got)
    text = {}
    for i, _, h, *_ in rows:
        text.setdefault(i, set()).add(h or "")
    last = {}
    for i, _, h, *_ in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    for r in got:
        h = next(h for h in text[r["page_id"]] if base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() == r["payload_digest"])
        first = r["page_id"] == last[h] or last[h] == -1
        assert (r["record_type"], r["refers_to"], r["payload_bytes"]) == (("response", None) if first else ("revisit", last[h])) + (len(h.encode()),)
        assert r["payload"] == (h.encode() if first else b"")
    assert warc.read_archives(listed).rdd.getNumPartitions() == listed.count()  # a task for each archive
    none = warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archives(none).count() == 0


def test_a_dictionary_leads_its_archive():
    pages = [f"<html><head><title>{i}</title></head><body>{'same words on every page ' * 4}{i * 7}</body></html>".encode() for i in range(400)]
    data, learned = warc.archive(pages, pages)
    magic, size = struct.unpack_from("<II", data)
    assert learned and magic == warc.DICTIONARY_FRAME and data[8 + size : 12 + size] == warc.ZSTD_FRAME
    assert list(warc.records_of(memoryview(data))) == pages
    plain, learned = warc.archive(pages[:3], pages[:3])
    assert not learned and list(warc.records_of(memoryview(plain))) == pages[:3]
    assert len(data) - 8 - size < sum(len(warc.archive([p], [])[0]) for p in pages)
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.records_of(memoryview(data[:-2])))


def test_small_payloads_need_no_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}", least_bytes=3)).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


# --- mixing ----------------------------------------------------------------------------------------------------------


def test_targets_stop_at_three_times_a_source():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == pytest.approx([5, 10, 15])
    assert mixing.targets([100, 1, 1], [1, 2, 3]) == pytest.approx([96, 3, 3])
    assert mixing.targets([0, 5], [1, 2]) == pytest.approx([0, 5])
    assert mixing.targets([], []) == []
    pick = random.Random(3)
    for _ in range(50):
        sizes = [pick.choice([0, 1, 10, 1000]) * pick.randint(1, 9) for _ in range(7)]
        out = mixing.targets(sizes, [1, 2, 3, 1, 2, 3, 1])
        assert sum(out) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-9 for t, s in zip(out, sizes))


def test_the_tree_deals_exact_quotas():
    quotas = np.array([1000, 0, 37, 512])
    dealt = mixing.split_quotas(quotas, 7, np.random.default_rng(1))
    assert (dealt.sum(0) == quotas).all() and (dealt >= 0).all() and dealt.sum(1).max() - dealt.sum(1).min() <= 3
    many = np.array([mixing.split_quotas(np.array([30, 10]), 4, np.random.default_rng(i)) for i in range(400)])
    assert many[:, :, 0].mean(0) == pytest.approx([7.5] * 4, abs=0.3)  # every shard alike


def test_op3(spark):
    source = {r["doc_id"]: (r["source"], len([w for w in (r["text"] or "").replace("\x0b", " ").split() if w])) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    query = QUERIES["op3_mixture"]
    rows = sorted(tuple(r) for r in query(spark, "/root/testdata/sf0.01").collect())
    assert rows == sorted(tuple(r) for r in query(spark, "/root/testdata/sf0.01").collect())
    names = sorted({s for s, _ in source.values()})
    sizes = [sum(n for s, n in source.values() if s == name) for name in names]
    goals = dict(zip(names, mixing.targets(sizes, [1 + i % 3 for i in range(len(names))])))
    taken = dict.fromkeys(names, 0)
    places: dict[int, list[int]] = {}
    for doc, size, source_size, target, words, shards, slots in rows:
        for shard, slot in zip(shards, slots, strict=True):
            places.setdefault(shard, []).append(slot)
        name = source[doc][0]
        assert source_size == sizes[names.index(name)] and target == pytest.approx(goals[name]) and words in (0, size, 2 * size, 3 * size) and len(shards) * size == words
        taken[name] += words
    assert all(abs(taken[n] - goals[n]) <= 0.02 * goals[n] + 5 for n in names)
    assert all(sorted(s) == list(range(len(s))) for s in places.values())  # a gapless order in each shard


def test_any_number_of_sources_can_be_mixed(spark, monkeypatch):
    monkeypatch.setattr(mixing, "NUMBERED", 40)
    monkeypatch.setattr(mixing, "FAMILIES", 7)
    monkeypatch.setattr(mixing, "BROADCAST", 10)
    pick = random.Random(4)
    rows = [(i, f"s{i % 150:03d}", "w " * pick.randint(0, 30)) for i in range(1500)] + [(5000 + i, None, "w " * 9) for i in range(20)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), shards=5).collect()
    names = [*sorted({s for _, s, _ in rows if s is not None}), None]
    sizes = [sum(len(t.split()) for _, s, t in rows if s == name) for name in names]
    goals = dict(zip(names, mixing.targets(sizes, [1 + i % 3 for i in range(len(names))])))
    taken = dict.fromkeys(names, 0)
    for r in out:
        assert r["target"] == pytest.approx(goals[r["source"]]) and len(r["shards"]) == len(r["slots"]) == r["takes"] and all(0 <= x < 5 for x in r["shards"])
        taken[r["source"]] += r["size"] * r["takes"]
    assert len(out) == len(rows) and all(abs(taken[n] - goals[n]) <= 15 for n in names)


def test_mixed_rows_stand_in_their_shards_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", "w " * (i % 17)) for i in range(600)], "doc_id long, source string, text string")
    mixing.in_order(mixing.mixed_rows(docs, shards=8), shards=8, slots_per_part=20).write.parquet(f"file://{tmp_path}/mixed")
    runs = []
    for part in tmp_path.glob("mixed/*.parquet"):
        rows = pq.read_table(part).to_pylist()
        order = [(r["_mix_shard"], r["_mix_slot"]) for r in rows]
        assert order == sorted(order) and len({shard for shard, _ in order}) <= 1 and len(rows) <= 20  # a run of one shard in each file
        runs.append(order)
    assert len(runs) > 16 and sorted(x for run in runs for x in run) == [x for run in sorted(runs) for x in run]
    got = spark.read.parquet(f"file://{tmp_path}/mixed")
    assert got.select("_mix_shard", "_mix_slot").distinct().count() == got.count()


def test_a_long_document_does_not_miss_the_target(spark):
    pick = random.Random(6)
    words = lambda n: "w " * n
    for longest, most in ((20_000, 40), (9_000, 500), (3_000, 3_000)):
        rows = [(i, "a" if i % 4 else "b", words(pick.randint(5, 60))) for i in range(800)] + [(1000 + i, "a", words(pick.randint(most // 2, most))) for i in range(12)] + [(2000, "a", words(longest)), (2001, "b", words(longest // 2))]
        docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
        for seed in range(3):
            taken, target, out = {}, {}, mixing.mix(docs, weights=(3, 1), seed=seed).collect()
            for r in out:
                assert 0 <= r["takes"] <= 3 and len(r["shards"]) == r["takes"] and all(0 <= s < 64 for s in r["shards"])
                taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["takes"]
                target[r["source"]] = r["target"]
            assert len(out) == len(rows) and all(abs(taken[s] - target[s]) <= 30 for s in target), (longest, seed, taken, target)


def test_rows_make_up_for_a_long_one():
    fill = lambda sizes, roles, rest: (lambda t: (t.column("size").to_numpy() * t.column("_more").to_numpy()).sum())(mixing._fill(pa.table({"size": sizes, "_hash": list(range(len(sizes))), "rest": [rest if r == 1 else 0 for r in roles], "_role": roles})))
    assert fill([1000, *[10] * 80], [1, *[3] * 80], 400) == 400  # rows of later blocks
    assert fill([1000, *[10] * 80], [1, *[2] * 80], 600) == 600  # rows of earlier blocks go
    assert fill([1000, *[10] * 80], [1, *[2] * 80], 300) == 300  # the long row is farther off, but the way
    assert fill([1000], [1], 400) == 0 and fill([1000], [1], 600) == 1000
    assert fill([5, 136, 224, 233, 233, 377, 395, 933, 2933], [1] * 9, 1775) == 1776  # no flip of one row leads there


def test_mixing_awkward_rows(spark, docs, empty):
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count() and all(0 <= r["takes"] <= 3 and len(r["shards"]) == r["takes"] for r in out)
    rows = mixing.mixed_rows(docs)
    assert {"shard", "takes", "_mix_shard", "_mix_slot"} <= set(rows.columns)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    assert mixing.mixed_in_order(empty).count() == 0 and mixing.mixed_in_order(docs).columns == docs.columns


def test_rows_without_an_id_are_mixed_each_by_its_text(spark):
    rows = [(None, "a" if i % 5 else "b", " ".join(f"w{i}x{k}" for k in range(20))) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    out = mixing.mix(docs, shards=8).collect()
    shards = [s for r in out for s in r["shards"]]
    assert max(shards.count(s) for s in range(8)) < 2 * len(shards) / 8  # not all in one block and shard
    taken = {s: sum(r["size"] * r["takes"] for r in out if r["source"] == s) for s in "ab"}
    assert all(abs(taken[r["source"]] - r["target"]) <= 20 for r in out)
    mixed = mixing.mixed_rows(docs, shards=8).groupBy("source").count().collect()
    assert {r["source"]: 20 * r["count"] for r in mixed} == taken


# --- sharding --------------------------------------------------------------------------------------------------------


def test_the_matrix_has_its_sums():
    counts, sizes = np.array([100, 0, 7, 400, 13]), np.array([174, 173, 173])
    m = sharding.communication_matrix(counts, sizes, 4)
    assert (m.sum(1) == counts).all() and (m.sum(0) == sizes).all() and (m >= 0).all()
    mean = np.mean([sharding.communication_matrix(counts, sizes, i) for i in range(300)], axis=0)
    assert mean == pytest.approx(counts[:, None] * sizes / sizes.sum(), abs=1.5)


@pytest.mark.parametrize(("good", "bad", "draws"), [(6, 5, 4), (40, 3, 20), (3, 400, 30), (1000, 900, 50), (10**10, 3 * 10**10, 5), (5, 7, 12), (0, 9, 3)])
def test_draws_follow_the_hypergeometric_law(good, bad, draws):
    rng, n = np.random.default_rng(good % 97), 4000
    got = np.bincount([sharding._hypergeometric(rng, good, bad, draws) for _ in range(n)], minlength=draws + 1)
    ways = [math.comb(good, k) * math.comb(bad, draws - k) if draws - k <= bad else 0 for k in range(draws + 1)]
    want = np.array([w / sum(ways) for w in ways]) * n
    assert not got[want == 0].any()
    assert (np.abs(got - want) <= 5 * np.sqrt(want + 1)).all()


def test_large_draws_have_their_spread():
    rng, good, bad, draws = np.random.default_rng(3), 10**11, 3 * 10**11, 10**8
    got = np.array([sharding._hypergeometric(rng, good, bad, draws) for _ in range(2000)])
    sd = (draws * 0.25 * 0.75 * (1 - draws / (good + bad))) ** 0.5
    assert abs(got.mean() - draws / 4) < 5 * sd / 2000**0.5 and got.std() == pytest.approx(sd, rel=0.08)


def test_rows_of_one_key_are_spread(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 > 0, None).otherwise(F.col("id")).alias("k"), "id").repartition(5)
    out = sharding.shard_rows(rows, ["k"], 4, part_rows=100)
    parts = sharding._spread(rows, ["k"], [0], F.when(F.col("k").isNull(), 0).otherwise(1))
    assert sorted(r["_copy"] for r in parts.filter("k IS NULL").collect()) == list(range(4000)) and {r["_copy"] for r in parts.filter("k IS NOT NULL").collect()} == {0}
    got = out.toPandas()
    assert sorted(got.id) == list(range(6000)) and sorted(got.groupby("shard").size()) == [1500] * 4
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    slim = rows.select("k")
    again = [sorted((r["k"] or -1, r["shard"], r["slot"]) for r in sharding.shard_rows(slim.repartition(n), ["k"], 4, part_rows=100).collect()) for n in (2, 7)]
    assert again[0] == again[1]


def test_shards_are_even_and_slots_gapless(spark, docs, empty):
    rows = spark.range(5003).withColumn("x", F.col("id") * 3)
    out = sharding.shard_rows(rows, ["id"], 8, part_rows=100)
    got = out.toPandas()
    assert sorted(got.groupby("shard").size()) == [625] * 5 + [626] * 3
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    again = sharding.shard_rows(rows.repartition(3), ["id"], 8, part_rows=100).toPandas()
    assert got.sort_values("id").values.tolist() == again.sort_values("id").values.tolist()
    assert abs(np.corrcoef(got.id, got.slot)[0, 1]) < 0.05 and abs(np.corrcoef(got.id, got.shard)[0, 1]) < 0.05
    odd = sharding.shard_rows(docs, ["doc_id", "text"], 3).collect()
    assert len(odd) == docs.count() and sorted(len([r for r in odd if r["shard"] == s]) for s in range(3)) == [5, 6, 6]
    assert sharding.shard_rows(empty, ["doc_id"]).count() == 0


def test_shard_files_are_in_slot_order(spark):
    path = scratch(spark, "shards")
    sharding.write_shards(sharding.shard_rows(spark.range(300), ["id"], 4), path, 4, 2)
    assert spark.read.parquet(path).groupBy("shard").count().count() == 4


def test_op4(spark):
    import zlib

    text = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").collect()}
    rows = QUERIES["op4_hypergeometric_shards"](spark, oracle.SF).collect()
    assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text[r["doc_id"]]) + 1, zlib.crc32(text[r["doc_id"]]), "rows", None) for r in rows)
    assert {r["shard"] for r in rows} == set(range(8)) and len(rows) == len(text)
    slots = {k: sorted(r["slot"] for r in rows if r["shard"] == k) for k in range(8)}
    assert all(s == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


# --- near duplicates -------------------------------------------------------------------------------------------------


def by_all_pairs(rows, n, num, den):
    sets, up = [], {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
        up.setdefault(i, i)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and den * shared >= num * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(rows[a][0]), find(rows[b][0])
                up[max(x, y)] = min(x, y)
    return sorted((-1 if i is None else i, len(s), -1 if i is None else find(i)) for (i, _), s in zip(rows, sets))


def family(pick, words, copies, edits):
    base = [f"v{pick.randint(0, words * 5)}" for _ in range(words)]
    for _ in range(copies):
        w = list(base)
        for _ in range(pick.randint(0, edits)):
            w[pick.randrange(len(w))] = f"e{pick.randint(0, 10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize(("n", "num", "rows_hot", "sets"), [(4, 85, 1000, 128), (5, 80, 3, 2), (4, 85, 3, 3)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, n, num, rows_hot, sets):
    monkeypatch.setattr(jaccard, "HOT_ROWS", rows_hot)
    monkeypatch.setattr(jaccard, "GROUP_SETS", sets)
    pick = random.Random(n * num + sets)
    passage = " ".join(f"common{i}" for i in range(30))
    texts = [t for words, copies, edits in ((120, 40, 6), (60, 30, 3), (200, 10, 12), (30, 12, 2), (8, 6, 1)) for t in family(pick, words, copies, edits)]
    texts += [f"{passage} " + " ".join(f"u{pick.randint(0, 10**6)}" for _ in range(k)) for k in (0, 1, 2, 3, 5, 8, 40, 60)] + ["one two", "One  TWO", "one", "", None, "x " * 50, "x " * 60] + texts[:5]
    ids = list(range(len(texts)))
    pick.shuffle(ids)
    rows = [*zip(ids, texts), (None, texts[0]), (None, None), (ids[0], "another text"), (ids[3], texts[3])]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), n, num, 100).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in got) == by_all_pairs(rows, n, num, 100)


def test_op7_is_that_of_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["op7_jaccard_groups"](spark, oracle.SF).collect())
    assert got == by_all_pairs(rows, 4, 85, 100)


def test_large_groups_and_common_lines(spark, monkeypatch):
    """One line in every row, a third of all rows one text, a sixth near copies of another, and rows that are little but a common passage."""
    monkeypatch.setattr(jaccard, "OPEN_BLOCK", 4)
    pick = random.Random(12)
    line = " ".join(f"line{i}" for i in range(12))
    passage = " ".join(f"p{i}" for i in range(40))
    unique = lambda n: " ".join(f"u{pick.randint(0, 10**9)}" for _ in range(n))
    texts = [f"{line} {unique(30)}" for _ in range(120)] + [f"{line} same {passage} text"] * 150 + [f"{t} {line}" for t in family(pick, 90, 75, 5)]
    texts += [f"{passage} {unique(k)} {line}" for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15) for _ in range(6)]
    rows = list(zip(pick.sample(range(10_000), len(texts)), texts))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 4, 85, 100).collect()
    assert sorted(tuple(r) for r in got) == by_all_pairs(rows, 4, 85, 100)


@pytest.mark.parametrize("texts", [["", "a", "A b", None, "a  b\tc\nd e f g", "q" * 700 + " w", "é É 漢 " * 9, "z" * 300 + " tail"], [" x" * 300, "\v a\fb\rc "]])
def test_words_are_hashed_alike_wherever_they_stand(monkeypatch, texts):
    alone = [next(jaccard.Shingler(3).sets(pa.array([t]))) for t in texts]
    for piece in (1 << 18, 1024, 600):
        monkeypatch.setattr(jaccard, "PIECE", piece)
        for one, got, t in zip(alone, jaccard.Shingler(3).sets(pa.array(texts)), texts, strict=True):
            w = (t or "").encode().lower().split()
            assert (one == got).all() and len(got) == (len({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}) if w else 0)


def test_unions_bound_what_sets_share():
    rng = np.random.default_rng(5)
    for n, m, shared in ((50, 60, 30), (500, 90, 80), (1000, 1100, 1000), (3, 900, 2), (700, 700, 0)):
        pool = rng.integers(0, 2**63, n + m, dtype=np.uint64)
        a, b = pool[:n], np.concatenate([pool[:shared], pool[n : n + m - shared]])
        most = jaccard.most_shared(len(a), jaccard.union_bits(a), len(b), jaccard.union_bits(b))
        assert shared <= most <= shared + 0.3 * min(n, m) + 3


def test_one_of_each_group_stays(spark, docs, empty):
    kept = jaccard.one_of_each(docs)
    assert set(kept.columns) == set(docs.columns)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert ids == [(False, i) for i in (0, 1, 2, 3, 4, 5, 7, 8, 11)] + [(True, 0), (True, 0)]
    assert jaccard.one_of_each(empty).count() == 0 and jaccard.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("task_edges", [500_000, 20])
def test_components_of_chains_and_stars(spark, monkeypatch, task_edges):
    monkeypatch.setattr(components, "TASK_EDGES", task_edges)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 150)] + [(200, 200), (301, 300), (300, 301)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 150)} | {300: 300, 301: 300}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- URL rules -------------------------------------------------------------------------------------------------------

URLS = {
    "http://example.com/en/1": ("example.com", "/en/1", "example.com/en/", "block"), "HTTP://WWW.Example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"), "http://a.www.example.com/en/x": ("a.www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"), "http://x.net/es": ("x.net", "/es", None, "allow"), "http://example.com?q=/en/": ("example.com", "", None, "allow"),
    "http://example.com#/en/": ("example.com", "", None, "allow"), "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"), "x://y://z/é": ("y:", "//z/é", None, "allow"), "http://É.com/": ("É.com", "/", "com/", "allow"), "http://a\nb.com/x\ny": ("a\nb.com", "/x\ny", "com/", "allow"),
}


def test_urls_are_judged_by_the_longest_rule(spark):
    df = spark.createDataFrame([(u, "v", "r") for u in URLS], "url string, verdict string, rule string")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, url_filter.RULES).collect()}
    assert got == URLS
    assert url_filter.judge_urls(df.limit(0), url_filter.RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(df, []).collect()} == {"allow"}


def test_a_host_is_judged_at_the_cost_of_the_rules(monkeypatch):
    rules = url_filter.Rules(np.frombuffer(url_filter.compile_rules([("block", "b.example", "/"), ("allow", "a.b.example", "/x")]), np.uint8))
    seen = []
    find = rules.find
    rules.find = lambda keys: (seen.extend(keys), find(keys))[1]
    hosts = ["l." * 200_000 + "a.b.example", "l" * 300_000, "xa.b.example", ".b.example", "b.example", ""]
    assert rules.judge(hosts, ["/x"] * 6) == (["a.b.example/x", None, "b.example/", "b.example/", "b.example/", None], ["allow", "allow", "block", "block", "block", "allow"])
    assert sum(map(len, seen)) < 1000


def test_strings_decide_where_digests_collide(monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda k: 7)
    rules = url_filter.Rules(np.frombuffer(url_filter.compile_rules(url_filter.RULES), np.uint8))
    assert rules.judge(["x.net", "x.org"], ["/es/", "/es/"]) == (["net/es/", None], ["block", "allow"])


# --- vector search ---------------------------------------------------------------------------------------------------


def test_search_is_exact_and_prunes():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 200
    vectors = np.floor(centres[rng.integers(40, size=6000)] + rng.normal(size=(6000, 16)) * 4)
    vectors[100:140] = vectors[100]  # ties
    ids = rng.permutation(6000)
    root = mtree.build(ids, vectors, vectors.mean(0))
    queries = np.vstack([vectors[:20], vectors[100:102], np.zeros((1, 16)), -vectors[:1]])
    own = np.concatenate([ids[:20], ids[100:102], [-1, -1]])
    found, computed = mtree.search(root, vectors.mean(0), queries, own, 20)
    for q, o, rows in zip(queries, own, found):
        scores = vectors @ q
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != o][:20]
        assert rows == [(int(scores[i]), int(ids[i])) for i in order]
    assert computed < 0.7 * len(queries) * len(vectors)


def by_all_products(rows):
    """(query, rank, other, score) in Python's whole numbers."""
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i in sorted({i for i, _ in good if i % 20 == 0}):
        pairs = [(-min(max(sum(a * b for a, b in zip(q, v)), mtree.LOW), mtree.HIGH), j) for k, q in good if k == i for j, v in good if j != i and len(v) == len(q)]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(pairs)[:20])]
    return want


def top_rows(df, **options):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.top_inner(df, **options).collect())


def test_top_inner_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 5), 1.0, -0.03]) for i in range(60)] + [(60, None), (None, [1.0, 1.0, 1.0]), (61, [1.0, None, 1.0]), (62, [nan, 1.0, 1.0]), (63, [inf, 0.0, 0.0]), (64, [1.0]), (80, [2.0]), (40, [9.0, 9.0, 9.0]), (100, []), (40, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert top_rows(df, tree_rows=16) == by_all_products(rows)
    assert mtree.top_inner(df.limit(0)).count() == 0 and top_rows(df, tree_rows=16, top=3) == [r for r in by_all_products(rows) if r[1] <= 3]


def test_large_components_are_exact(spark):
    pick = random.Random(8)
    rows = [(0, [33333333.0, 1 / 64]), (1, [33333333.0, 3 / 64]), (2, [1e200, 1.0]), (20, [1e200, -1.0]), (21, [-1e200, 0.5]), (22, [1.7e308, -1.7e308])]
    rows += [(100 + i, [pick.uniform(-1e8, 1e8), pick.uniform(-1e8, 1e8)]) for i in range(700)]
    rows = [(i, [min(max(x, -1.7e308 / 64), 1.7e308 / 64) for x in v]) for i, v in rows]
    got = top_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tree_rows=300)
    assert got == by_all_products(rows) and (0, 1, 1) not in {(q, r, v) for q, r, v, _ in got if v == 22}
    assert {s for q, _, v, s in by_all_products(rows[:2])} == {4551111020088889347}


def test_clusters_and_thresholds_lose_nothing(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 30
    vectors = centres[rng.integers(12, size=3000)] + rng.normal(size=(3000, 8))
    vectors[500:1500] = vectors[500]  # a third of all rows are one vector
    rows = [(i, v) for i, v in enumerate(vectors.tolist())]
    got = top_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tree_rows=400)
    whole = np.floor(64 * vectors)
    want = []
    for q in range(0, 3000, 20):
        scores = (whole @ whole[q]).astype(np.int64)
        order = [i for i in np.lexsort((np.arange(3000), -scores)) if i != q][:20]
        want += [(q, r + 1, int(i), int(scores[i])) for r, i in enumerate(order)]
    assert got == want


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    columns = spark.read.parquet(f"{oracle.SF}/documents.parquet").columns
    at = spark.read.parquet(f"{oracle.SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, oracle.SF)
        out.write.parquet(f"file://{tmp_path}/{name.replace(' ', '_')}")
        out = spark.read.parquet(f"file://{tmp_path}/{name.replace(' ', '_')}")
        if name != "bpe":
            assert out.columns == columns
            assert not out.distinct().join(at, "doc_id", "left_anti").count()
        if name == "near duplicates":
            assert out.count() == jaccard.jaccard_components(at).filter("component_id = doc_id").count()
        at = out
    assert at.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and at.filter("size(ids) <> n_tokens").count() == 0
    small = docs.select("doc_id", "text", "lang", "source", "n_chars", "score", "shard")
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, small, oracle.SF)
        assert rows.count() >= 0
        if "text" in rows.columns:
            assert rows.columns == small.columns
            none = stage(spark, small.limit(0), oracle.SF)
            assert none.count() == 0
    assert corpus_pipeline.run(spark, oracle.SF).count() > 0


def test_stages_are_their_plain_versions(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from codelode.llm import bpe, toxicity
    from test_text_operators import plain_ftrl

    folder = "/root/testdata/sf0.001"
    write = lambda df, name: (df.write.parquet(f"file://{tmp_path}/{name}"), spark.read.parquet(f"file://{tmp_path}/{name}"))[1]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    # toxicity: plain FTRL over plain features, in the order of hashed ids
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    order = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.lit(11), "doc_id").alias("h")).collect()}
    maker = toxicity.Features()
    known = [(maker.of(t), labels[i]) for i, t, *_ in sorted(rows, key=lambda r: order[r[0]]) if i in labels and t is not None]
    weights, bias = plain_ftrl(known, toxicity.EPOCHS, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2, 7)
    score = lambda t: 1 / (1 + math.exp(-(bias + sum(weights.get(int(x), 0.0) for x in maker.of(t or "")))))
    at = write(corpus_pipeline.drop_toxic(spark, docs, folder), "toxicity")
    learned = any(abs(w) > 1e-9 for w in weights.values())
    assert sorted(r["doc_id"] for r in at.collect()) == sorted(i for i, t, *_ in rows if not learned or not (t or "").strip() or score(t) < toxicity.THRESHOLD)
    # near duplicates: all pairs
    rows = [(r["doc_id"], r["text"]) for r in at.collect()]
    at = write(corpus_pipeline.drop_near_duplicates(spark, at, folder), "duplicates")
    assert sorted(r["doc_id"] for r in at.collect()) == [i for i, _, c in by_all_pairs(rows, 5, 80, 100) if i == c]
    # mixing: targets, whole rows, at most three times
    before = {r["doc_id"]: r for r in at.collect()}
    size = lambda r: len([w for w in (r["text"] or "").replace("\x0b", " ").split() if w])
    names = sorted({r["source"] for r in before.values()}, key=lambda n: (n is None, n))
    goals = mixing.targets([sum(size(r) for r in before.values() if r["source"] == n) for n in names], [1 + i % 3 for i in range(len(names))])
    at = write(corpus_pipeline.mix_sources(spark, at, folder), "mixed")
    mixed = at.collect()
    times = {i: sum(r["doc_id"] == i for r in mixed) for i in before}
    assert all(r == before[r["doc_id"]] for r in mixed) and max(times.values()) <= 3
    for name, goal in zip(names, goals):
        own = [r for r in before.values() if r["source"] == name]
        assert abs(sum(size(r) * times[r["doc_id"]] for r in own) - goal) <= 0.02 * goal + 5
    # encoding: the library's ids
    library = Tokenizer.from_file(bpe.vocabulary("word_bpe_49k.json"))
    want = sorted((r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids) for r in mixed)
    assert sorted((r["doc_id"], r["ids"]) for r in corpus_pipeline.encode(spark, at, folder).collect()) == want


def test_nothing_goes_without_evidence_of_toxicity(spark, tmp_path):
    import corpus_pipeline

    many = [(i, f"awful thing {i}" if i % 2 else f"kind thing {i}", i % 2) for i in range(200)]
    rows = [(i, t) for i, t, _ in many] + [(1000, None), (1001, ""), (1002, " \n"), (1003, "... _!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    every = [i for i, _ in rows]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    for labels in ([], [(i, 1) for i in held], [(5000 + i, i % 2) for i in range(50)], [(i, 1) for i in range(200)], [(i, y) for i, _, y in many]):
        spark.createDataFrame(labels, "doc_id long, toxic int").write.mode("overwrite").parquet(f"file://{tmp_path}/labels.parquet")
        kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, f"file://{tmp_path}").collect())
        predicted = {r["doc_id"]: r["predicted"] for r in QUERIES["op6_toxicity"](spark, f"file://{tmp_path}").collect()}
        assert kept == sorted(i for i, p in predicted.items() if not p)
        learned = len({y for _, y in labels}) == 2 and labels[0][0] < 5000
        assert kept == ([i for i in every if i >= 1000 or i % 2 == 0] if learned else every)
        assert all(r["predicted"] == (r["score"] >= 0.3) for r in QUERIES["op6_toxicity"](spark, f"file://{tmp_path}").collect())


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    own = ["_hit", "_cl_word", "_cl_drop", "_mix_size", "_mix_shard", "_toxicity_score", "score", "predicted", "size", "bucket", "in0", "s"]
    texts = ["one two three four five six seven"] * 3 + [None, "", "eight nine ten"]
    docs = spark.createDataFrame([(i, t, f"s{i % 2}", *range(len(own))) for i, t in enumerate(texts)], "doc_id long, text string, source string, " + ", ".join(f"{c} long" for c in own))
    spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.columns == docs.columns
        assert out.count() and all([r[c] for c in own] == list(range(len(own))) for r in out.collect())
