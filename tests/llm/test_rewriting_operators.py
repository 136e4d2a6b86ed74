"""Repeats of many words, fill-in-the-middle examples and Merkle manifests against plain versions of themselves."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import oracle
from codelode.llm import fill_middle, manifest, repeats
from codelode.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_fixed_block_repeats", "op12_fill_in_middle", "op13_merkle_manifest"])
def test_same_rows_as_sql_on_more_documents(spark, name):
    oracle.same(spark, QUERIES[name], ORACLE_SQL[name], SF)


# --- repeats ---------------------------------------------------------------------------------------------------------


def plainly(texts, width):
    """Words, removed words, their runs and what stays, of each text."""
    split = [WORD.findall(t or "") for t in texts]
    starts = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if starts[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        line = [False, *gone, False]
        runs = list(zip([i for i in range(len(w)) if gone[i] and not line[i]], [i + 1 for i in range(len(w)) if gone[i] and not line[i + 2]], strict=True))
        out.append((len(w), sum(gone), runs, " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def found(df, key, **options):
    return sorted((r[key], r["n_words"], r["n_removed"], [tuple(s) for s in r["spans"]], r["kept"]) for r in repeats.without_repeats(df, **options).collect())


@pytest.mark.parametrize("width", [35, 4, 5])
def test_repeats_are_those_of_brute_force(spark, width):
    pick = random.Random(width)
    texts = [None, "", " \n", "a b " * 60, "x" * 200_000 + " " + "y " * 20_000]
    for _ in range(60):
        texts.append(pick.choice([" ", "\n\t"]).join(pick.choice("abcdefgh") * pick.choice([1, 1, 1, 70]) for _ in range(pick.choice([3, 35, 40, 200]))))
    for _ in range(20):
        a, b = pick.choice(texts) or "", pick.choice(texts) or ""
        texts.append(" é ".join([a[: pick.randint(0, len(a))], b[pick.randint(0, len(b)) :]]))
    df = spark.createDataFrame(list(enumerate(texts)), "batch long, text string").repartition(3)  # batch: also the name of a column of the operator
    expected = sorted((i, *x) for i, x in enumerate(plainly(texts, width)))
    for batch_bytes in (100, 5000, 1 << 20):
        assert found(df, "batch", width=width, batch_bytes=batch_bytes) == expected


def test_a_third_of_all_rows_may_be_copies(spark):
    copy = " ".join(f"w{i}" for i in range(50))
    texts = [copy] * 400 + [f"{' '.join(f'u{n}x{i}' for i in range(60))} {copy if n % 2 else ''}" for n in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    assert found(df, "doc_id", batch_bytes=2000) == sorted((i, *x) for i, x in enumerate(plainly(texts, 35)))


def test_awkward_rows_and_tables_of_repeats(spark, docs, empty):
    rows = repeats.without_repeats(docs)
    assert rows.columns == [*docs.columns, "n_words", "n_removed", "spans", "kept"]
    texts = [r["text"] for r in docs.collect()]
    assert Counter((t, r[0], r[1], r[3]) for t, r in zip(texts, plainly(texts, 35))) == Counter((r["text"], r["n_words"], r["n_removed"], r["kept"]) for r in rows.collect())
    assert repeats.without_repeats(empty).collect() == []
    clash = spark.createDataFrame([("a b", 1, 2, "x")], "text string, N_words int, bytes int, kept string")
    assert repeats.without_repeats(clash).drop("spans").collect()[0].asDict() == {"text": "a b", "bytes": 2, "n_words": 2, "n_removed": 0, "kept": "a b"}


# --- fill in the middle ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "runs, grammar",
    [(fill_middle.LETTERS, r"[A-Za-z]+|[^A-Za-z]"), (fill_middle.WORDS, r"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]"), (fill_middle.LINES, r"[^\n]+|\n"), (fill_middle.CHARACTERS, r"[\s\S]"), (("A-Za-z", "0-9"), r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")],
)
def test_units_are_those_of_their_grammar(spark, docs, runs, grammar):
    odd = spark.createDataFrame([(t,) for t in ("😀", "a😀b é ñandú x", "  \n\nab1\r\nZz<", "x<S", "😀😀ab😀", "\r\n\x85 a")], "text string")
    for r in docs.select("text").union(odd).select("text", fill_middle.units(F.col("text"), runs).alias("units")).collect():
        assert r["units"] == re.findall(grammar, r["text"] or "")


def test_examples_hold_their_texts(spark, docs, empty):
    tricky = spark.createDataFrame([(i, t) for i, t in enumerate(["<P>", "a <M> b", "<S", "S><P", "<<", ">>P<S", "M>x<M"] * 30)], "doc_id long, text string").withColumns({"prefix": F.lit(1), "whole": F.lit("kept"), "h1": F.lit(2), "Form": F.lit("gone")})
    rows = fill_middle.examples(tricky).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert all(r["back"] == r["text"] and r["whole"] == "kept" and r["h1"] == 2 for r in rows) and len(rows) == 210
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"} and all(r["form"] == "plain" and r["prefix"] is None for r in rows if "<P>" in r["text"] or "<M>" in r["text"])
    for r in fill_middle.examples(docs).collect():
        text, digest = r["text"] or "", sha(f"1:{'' if r['doc_id'] is None else r['doc_id']}")
        h, n = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)], len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text))
        plain = not text or h[2] % 100 >= 90
        assert r["n"] == n and r["form"] == ("plain" if plain else "spm" if h[3] % 100 < 20 else "psm")
        if not plain:
            units, (a, b) = re.findall(r"[A-Za-z]+|[^A-Za-z]", text), sorted((h[0] % (n + 1), h[1] % (n + 1)))
            assert [r["prefix"], r["middle"], r["suffix"]] == ["".join(units[:a]), "".join(units[a:b]), "".join(units[b:])]
    assert fill_middle.examples(empty).collect() == []
    assert {r["form"] for r in fill_middle.examples(docs, rate=0).collect()} == {"plain"} and "psm" not in {r["form"] for r in fill_middle.examples(docs, rate=100, spm=100).collect()}


def test_fill_in_middle_is_one_pass_without_python(spark):
    plan = QUERIES["op12_fill_in_middle"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan and plan.count("split(") == 1


# --- manifests -------------------------------------------------------------------------------------------------------


def digest(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def merkle(rows, fanout=3):
    """doc_id, leaf, subroot, root, proof, folded root and whether it is the root, of rows (doc_id, source, lang, n_chars, text)."""

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
        return out

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            start = i - i % fanout
            out.append((nodes[start:i], nodes[i + 1 : start + fanout]))
            i //= fanout
        return out

    order, trees, out = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode())), {}, []
    for s in order:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, digest(*r)))
        trees[s] = own, tree([digest(*r) for r in own])
    top = tree([trees[s][1][-1][0] for s in order])
    for k, s in enumerate(order):
        own, levels = trees[s]
        for i, r in enumerate(own):
            steps, now = path(levels, i) + path(top, k), digest(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                now = digest(*r[:4], None if r[4] is None else r[4].replace("\n", ""))
            for a, b in steps:
                now = sha("".join(a) + now + "".join(b))
            out.append((r[0], digest(*r), levels[-1][0], top[-1][0], sha("".join(x for a, b in steps for x in a + b)), now, now == top[-1][0]))
    return Counter(out)


def proved(df, levels=manifest.LEVELS):
    row = lambda text: manifest.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaves = df.withColumns({"leaf": row(F.col("text")), "tampered": F.when(hit, row(F.replace("text", F.lit("\n"), F.lit(""))))})
    return manifest.manifest(leaves, "leaf", ["doc_id"], "source", "tampered", levels=levels)


@pytest.mark.parametrize("n, sources, levels", [(0, 1, 8), (1, 1, 1), (3, 3, 1), (9, 1, 2), (10, 1, 2), (82, 1, 2), (100, 4, 1), (90, 40, 1), (300, 2, 8)])
def test_manifests_are_those_of_a_plain_tree(spark, n, sources, levels):
    rows = [(i, None if i % sources == 0 else f"é{i % sources}", None if i % 5 else "en", i, f"text\n{i}" if i % 7 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    got = proved(df, levels).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert Counter(map(tuple, got)) == merkle(rows)


def test_awkward_rows_of_a_manifest(spark, docs, empty):
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]
    got = proved(docs, 1)
    assert got.columns == [*docs.columns, "leaf", "tampered", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())) == merkle(rows)
    assert proved(empty).collect() == []


def test_a_proof_holds_for_its_row_alone():
    import numpy as np

    nodes = np.frombuffer("".join(sha(str(i)) for i in range(11)).encode(), np.uint8).reshape(-1, 64)
    matrices = manifest.block(nodes, None)
    root = matrices[-1].tobytes().decode()
    assert [len(m) for m in matrices] == [11, 4, 2, 1]
    for i in range(11):
        path = manifest.steps(matrices, i)
        assert manifest.folded(sha(str(i)), path) == root != manifest.folded(sha(str(i + 1)), path)
        assert manifest._unpacked(manifest._packed(path)) == path
    assert [len(m) for m in manifest.block(nodes[:1], 3)] == [1, 1, 1, 1]  # the last of many blocks goes as high as the others
