"""BPE encoding and decoding through a minimal acyclic transducer of frequent words."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import files
from .common import lean, scratch, small_batches, stored, table
from .transducer import Lexicon, compile_lexicon

#: Words of the lexicon, words that a task counts at a time, and words whose ids it remembers; when these are too many, those outside the lexicon are forgotten.
LEXICON_WORDS, COUNTED, KEPT = 65_536, 100_000, 100_000
#: Fixed values of the tokenizer file: its split pattern, and the strings that are tokens wherever they stand.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: In texts of these characters alone, normalising is lower-casing and a split by plain sets of them is the same; others take the library's own normaliser.
_PLAIN = [c for c in map(chr, [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x180)]) if c != "\u0130"]
_OTHER = re.compile("[^" + re.escape("".join(_PLAIN)) + "]")
_LETTERS, _NUMBERS = (re.escape("".join(c for c in _PLAIN if regex.match(kind, c))) for kind in (r"\p{L}", r"\p{N}"))
_FAST = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_LETTERS}]+|[{_NUMBERS}]|[^ \t\n\r{_LETTERS}{_NUMBERS}]+")


class Words:
    """A tokenizer file's normalising and splitting."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self._special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def parts(self, text: str) -> list[str]:
        """The text's segments, special strings standing at odd places."""
        return self._special.split(text) if self._special and "<|" in text else [text]

    def of(self, segment: str) -> list[str]:
        """The words of a segment without special strings."""
        if _OTHER.search(segment):
            return PATTERN.findall(self.tokenizer.normalizer.normalize_str(segment))
        return _FAST.findall(segment.lower())


def frequent_words(docs: DataFrame, tokenizer: str, text: str = "text", most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts, at most most of them: all that are as frequent as the rarest one taken (to an eighth of a power of two).

    Tasks count in batches of at most COUNTED different words. The driver gets a histogram of a few hundred frequencies, and then the words
    above the one at which they would be too many, whatever the number of tasks."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(tokenizer), Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for segment in words.parts(t or "")[::2]:
                    seen.update(words.of(segment))
                if len(seen) > COUNTED:
                    yield give()
                    seen.clear()
        yield give()

    level = F.floor(F.log2("n") * 8).cast("int").alias("level")
    counted = stored(docs.select(text).mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).select("word", level), "word-counts")
    total, least = 0, None
    for row in sorted(counted.groupBy("level").count().collect(), reverse=True):
        total += row["count"]
        if total > most:
            break
        least = row["level"]
    return [] if least is None else [r[0] for r in counted.filter(F.col("level") >= least).select("word").collect()]


class Encoder(dict):
    """Words to ids: by the lexicon, else by the merges of the tokenizer's own model. The dictionary remembers lately found words, and all found in the lexicon."""

    def __init__(self, lexicon: str, tokenizer: str):
        self.frequent: dict[str, tuple[int, str, str]] = {}
        self.words = Words(tokenizer)
        self.model = self.words.tokenizer.model
        self.lexicon = Lexicon(files.mapped(lexicon))
        self._at, self._ids = self.lexicon.arrays["at"], self.lexicon.arrays["ids"]
        self.spelling = [self.words.tokenizer.id_to_token(i) for i in range(self.words.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.symbols = byte_symbols()

    def __missing__(self, word: str) -> tuple[int, str, str]:
        """How many ids, the ids in decimal, and their tokens, each joined by a space."""
        if len(self) >= KEPT:
            self.clear()
            self.update(self.frequent)
        k = self.lexicon.get(word.encode())
        own = self._ids[self._at[k] : self._at[k + 1]].tolist() if k >= 0 else merge(self.model, self.symbols, word)
        out = self[word] = (len(own), " ".join(map(str, own)), " ".join(self.spelling[i] for i in own))
        if k >= 0:
            self.frequent[word] = out
        return out

    def text(self, text: str) -> tuple[int, str, str]:
        """The whole text: how many ids, the ids in decimal, and what decoding them gives (the tokenizer has no decoder, so its tokens stay as they are, joined by a space)."""
        found: list = []
        for k, segment in enumerate(self.words.parts(text)):
            if k % 2:
                i = self.words.special[segment]
                found.append((1, str(i), segment))
            else:
                found += map(self.__getitem__, self.words.of(segment))
        if not found:
            return 0, "", ""
        counts, ids, tokens = zip(*found, strict=True)
        return sum(counts), " ".join(ids), " ".join(tokens)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable and no space, else the next free one from 256 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD) and (b < 0x7F or b > 0xA0)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def merge(model, symbols: list[str], word: str) -> list[int]:
    return [t.id for t in model.tokenize("".join([symbols[b] for b in word.encode()]))]


def build_lexicon(spark: SparkSession, words: list[str], tokenizer: str) -> str:
    """Compile words with their ids; returns the file's URI in the shared folder. Values are the words' ranks in byte order, which index the ids."""
    model, symbols = Words(tokenizer).tokenizer.model, byte_symbols()
    ordered = sorted({w.encode() for w in words})
    ids = [merge(model, symbols, w.decode()) for w in ordered]
    extra = {"at": np.cumsum([0, *map(len, ids)]), "ids": np.array([i for own in ids for i in own])}
    files.publish(name := f"{scratch(spark, 'lexicon')}/words", compile_lexicon(((w, k) for k, w in enumerate(ordered)), extra))
    return name


def encode(docs: DataFrame, tokenizer: str, text: str = "text", lexicon: str | None = None, with_ids: bool = False) -> DataFrame:
    """docs without its text, with n_tokens, ids_sha256 and decoded_sha256; with_ids: also ids (array<int>).

    The frequent words of all texts are counted first, unless a lexicon's URI is given. A null text counts as empty and has no ids; special
    strings inside a text are their own tokens, as the library's default is. Columns of docs with these names are replaced; an empty df
    gives no rows. Rows are encoded where they are read: only word counts are shuffled."""
    spark = docs.sparkSession
    small_batches(spark)
    lexicon = lexicon or build_lexicon(spark, frequent_words(docs, tokenizer, text), tokenizer)
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    kept = [f for f in docs.schema.fields if f.name.lower() not in names and f.name != text]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(lexicon, tokenizer)
        for batch in batches:
            rows = [(n, sha(ids), sha(out), *([np.array(ids.split(), np.int32)] if with_ids else [])) for n, ids, out in (encoder.text(t or "") for t in batch.column(0).to_pylist())]
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)] or [pa.array([], k) for k in kinds[: 3 + with_ids]]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], [*(f.name for f in kept), *names[: len(made)]])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), added])
    return docs.select(text, *[F.col(f"`{f.name}`") for f in kept]).mapInArrow(lean(run), schema)


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, vocabulary("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
