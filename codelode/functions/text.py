"""Scalar kernels: token estimates, ids, names, paths, lexical scores and vectors."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import MEMBER_KINDS

UNIT = "\u001f"


def token_estimate(text: Column | str) -> Column:
    """A quarter of the UTF-8 bytes, rounded up; 0 for null and empty texts."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("int")


def estimate(text: str | None) -> int:
    return -(-len((text or "").encode()) // 4)


def truncate(text: str, most: int) -> str:
    """The longest prefix whose estimate is at most most; characters are never cut."""
    return text.encode()[: 4 * max(most, 0)].decode(errors="ignore")


def truncated(text: Column | str, most: Column) -> Column:
    """The longest prefix whose estimate is at most most; characters are never cut. A null text stays null."""
    c = F.col(text) if isinstance(text, str) else text
    limit = 4 * F.greatest(most, F.lit(0)).cast("int")
    # a character has up to four bytes: of four prefixes in bytes one ends between characters
    prefixes = [F.substring(F.encode(c, "UTF-8"), F.lit(1), limit - k).cast("string") for k in range(4)]
    cut = F.coalesce(*[F.when(F.is_valid_utf8(p), p) for p in prefixes])
    return F.when(F.octet_length(c) <= limit, c).when(limit == 0, F.when(c.isNotNull(), F.lit(""))).otherwise(cut)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix: and the SHA-256 of the parts joined by U+001F; a null part counts as empty."""
    return F.concat(F.lit(f"{prefix}:"), F.sha2(F.concat_ws(UNIT, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256))


def normalized_name(name: Column | str) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


#: Fixed patterns: endings that mark a test's name, and a test file's stem.
TEST_SUFFIX = r"(?i)(?:tests?|spec(?:ification)?s?|it)$"
TEST_FILE_SUFFIX = r"(?i)(?:[._-](?:tests?|spec(?:ification)?s?|it))$"


def strip_test_suffix(name: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(name, F.lit("")), TEST_SUFFIX, "")


def file_stem(path: Column | str) -> Column:
    """What stands after the last slash and before the last dot behind it; a leading dot begins no ending."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")


def namespace(qualified_name: Column, kind: Column) -> Column:
    """A qualified name without its last part, without two for members; parts end at a dot or a slash."""
    cut = lambda c: F.regexp_replace(c, r"[./][^./]*$", "")
    q = F.coalesce(qualified_name, F.lit(""))
    outer = F.when(q.rlike("[./]"), cut(q)).otherwise("")
    return F.when(kind.isin(MEMBER_KINDS), cut(outer)).otherwise(outer)


def zone(path: Column, depth: int) -> Column:
    """The first depth folders of a path, (root) for a file without one."""
    folders = F.split(path, "/")
    inside = F.slice(folders, 1, F.least(F.lit(depth), F.size(folders) - 1))
    return F.when(F.size(folders) > 1, F.array_join(inside, "/")).otherwise("(root)")


def sanitize_remote(url: Column | str) -> Column:
    """A remote's URL without credentials, query, fragment and .git ending."""
    plain = F.regexp_replace(F.trim(url), r"[?#].*$", "")
    plain = F.regexp_replace(plain, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")
    return F.regexp_replace(F.regexp_replace(plain, r"/+$", ""), r"\.git$", "")


def safe_relative_path(path: Column) -> Column:
    """The path with slashes only; null if it is absolute, names a drive or a scheme, or climbs out."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    unsafe = p.startswith("/") | p.rlike(r"^[A-Za-z]:") | F.lower(p).startswith("file:") | p.rlike(r"(^|/)\.\.(/|$)")
    return F.when(~unsafe, F.regexp_replace(F.regexp_replace(p, r"/(\./)+", "/"), r"/{2,}", "/"))


def normalized_text(text: Column | str) -> Column:
    """Lower case; letters, numbers and _ stay, all else becomes single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def lexical_score(content: Column, query: str, normalized: Column | None = None) -> Column:
    """The share of the query's terms (two characters or more) found as whole terms, and 0.25 if the normalised content holds the whole query; 1 at most. normalized: the content's, if it is stored."""
    import re

    norm = " ".join(re.findall(r"\w+", query.lower()))
    terms = list(dict.fromkeys(t for t in norm.split(" ") if len(t) >= 2))
    if not terms:
        return F.lit(0.0)
    text = normalized_text(content) if normalized is None else normalized
    matched = F.size(F.array_intersect(F.split(text, " "), F.array(*[F.lit(t) for t in terms])))
    return F.least(F.lit(1.0), matched / F.lit(float(len(terms))) + F.when(text.contains(norm), 0.25).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays, 0 where one has no length, held to [-1, 1]."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot, norms = total(F.zip_with(a, b, lambda x, y: x * y)), F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.when(norms == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / norms)))


#: Fixed values of the hash embedding: the weight of a word and of its pieces, their lengths in characters, and the 32-bit FNV-1a hash's start and factor.
WORD_WEIGHT, PIECE_WEIGHT, PIECE_LENGTHS, FNV_START, FNV_PRIME = 1.0, 0.35, (3, 4, 5), 0x811C9DC5, 0x01000193


def _fnv(pieces: list[bytes]) -> np.ndarray:
    """FNV-1a of every piece, all pieces advancing byte by byte together."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    data, starts = np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], lengths.cumsum()[:-1]])
    order = np.argsort(-lengths, kind="stable")  # longest first, so those still running are a prefix
    h, alive = np.full(len(pieces), FNV_START, np.uint32), len(pieces)
    lengths, starts, state = lengths[order], starts[order], h.copy()
    for k in range(int(lengths[0]) if len(lengths) else 0):
        alive = int(np.searchsorted(-lengths, -k, "left"))
        state[:alive] = (state[:alive] ^ data[starts[:alive] + k]) * np.uint32(FNV_PRIME)
    h[order] = state
    return h


def hash_vectors(texts: list[str], dims: int = 384) -> np.ndarray:
    """Hashed bags of words and of their pieces with ends marked, each of length 1; zero for a text without words. Index and sign come from FNV-1a."""
    import re

    known: dict[str, int] = {}
    pieces, weights, first = [], [], []
    owner, word_of = [], []
    for i, text in enumerate(texts):
        for word in re.findall(r"\w+", text.lower()):
            k = known.get(word)
            if k is None:
                k = known[word] = len(first)
                first.append(len(pieces))
                marked = f"^{word}$"
                own = [word] + [marked[j : j + n] for n in PIECE_LENGTHS for j in range(len(marked) - n + 1)]
                pieces += [p.encode() for p in own]
                weights += [WORD_WEIGHT] + [PIECE_WEIGHT] * (len(own) - 1)
            owner.append(i)
            word_of.append(k)
    out = np.zeros((len(texts), dims))
    if not pieces:
        return out
    h = _fnv(pieces)
    index = h.astype(np.int32).astype(np.int64) % dims
    value = np.where(h >> np.uint32(30) & np.uint32(1), -1.0, 1.0) * np.array(weights)
    starts, ends = np.array(first), np.array([*first[1:], len(pieces)])
    words = np.array(word_of)
    sizes = (ends - starts)[words]
    flat = np.repeat(starts[words] - np.concatenate([[0], sizes.cumsum()[:-1]]), sizes) + np.arange(sizes.sum())
    np.add.at(out, (np.repeat(np.array(owner), sizes), index[flat]), value[flat])
    length = np.sqrt((out**2).sum(1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def hash_vector(text: str, dims: int = 384) -> np.ndarray:
    return hash_vectors([text], dims)[0]


def _narrowing(before: int, after: int) -> list[tuple[int, int]]:
    """Lines around an excerpt as its budget narrows: the wider side first, of equal ones that before."""
    steps = [(before, after)]
    while before + after:
        before, after = (before - 1, after) if before >= after else (before, after - 1)
        steps.append((before, after))
    return steps


def excerpt_of(lines: Column, start: Column, end: Column, around: int, budget: int) -> Column:
    """Lines start to end (from 1, in an array) with at most around more on each side, as many as a token budget takes, then cut to it: an expression of the same text as sources.files.excerpt gives.

    Null lines are empty; an array that ends before start gives an empty text."""
    pair = lambda p: F.struct(F.lit(p[0]).alias("before"), F.lit(p[1]).alias("after"))
    all_ = F.array(*[F.array(*[F.array(*map(pair, _narrowing(b, a))) for a in range(around + 1)]) for b in range(around + 1)])
    before = start - F.greatest(F.lit(1), start - around)
    after = F.greatest(F.lit(0), F.least(F.size(lines), end + around) - end)
    steps = F.element_at(F.element_at(all_, (before + 1).cast("int")), (after + 1).cast("int"))
    cut = lambda p: F.slice(lines, (start - p["before"]).cast("int"), F.greatest(F.lit(0), end + p["after"] - start + p["before"] + 1).cast("int"))
    texts = F.transform(steps, lambda p: F.array_join(F.transform(cut(p), lambda x: F.coalesce(x, F.lit(""))), "\n"))
    fits = F.filter(texts, lambda x: F.octet_length(x) <= 4 * budget)
    return F.coalesce(F.get(fits, F.lit(0)), truncated(F.element_at(texts, -1), F.lit(budget)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embedding(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(list(hash_vectors([t or "" for t in texts])), dtype=object)


@F.pandas_udf(T.StringType())
def hmac_sha256(key: pd.Series, message: pd.Series) -> pd.Series:
    return pd.Series([None if m is None or k is None else hmac.new(k.encode(), m.encode(), hashlib.sha256).hexdigest() for k, m in zip(key, message, strict=True)], dtype=object)
