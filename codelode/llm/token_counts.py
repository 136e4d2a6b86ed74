"""Token counts by finite-state transducers: a word splitter whose transitions emit the tokens of the words that begin there, run over chunks from every state and composed by a prefix scan, and a lexicon from words to how many tokens they are."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import files
from .bpe import Words, byte_symbols, vocabulary
from .common import lean, scratch, small_batches, table
from .transducer import Lexicon, compile_lexicon

#: Characters of a chunk: all chunks of a batch advance together. A text begins a chunk of its own.
CHUNK = 512
#: Words whose counts a task remembers at a time.
KEPT = 200_000
LIMIT = 1024

#: Classes of characters: letters are told apart where a contraction needs it.
SPACE, BLANK, LETTER, NUMBER, MARK, QUOTE, STMD, R, V, L, E, END = range(12)
#: States: what the last characters belong to. FRESH: nothing is open. PAIR_*: after a quote and a letter that may begin 're, 've or 'll.
FRESH, WORD, DIGITS, MARKS, QUOTED, PAIR_R, PAIR_V, PAIR_L, ONE_SPACE, SPACES, ONE_BLANK, BLANKS = range(12)
STATES, CLASSES = 12, 12
#: Output bits: a word begins at this character; one begins at the character before.
HERE, BEFORE = 1, 2


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """The word splitter's next states and outputs, by state and class.

    A white space run keeps its last character for the word behind it if that is a space; otherwise the last stands alone. Since that shows
    only at the next character, some transitions place a boundary one character back."""
    letters = (LETTER, STMD, R, V, L, E)
    fresh = {SPACE: ONE_SPACE, BLANK: ONE_BLANK, NUMBER: DIGITS, MARK: MARKS, QUOTE: QUOTED, END: FRESH} | dict.fromkeys(letters, WORD)
    joined = {NUMBER: DIGITS, MARK: MARKS, QUOTE: MARKS} | dict.fromkeys(letters, WORD)  # behind a space that belongs to the word
    nxt, out = np.zeros((STATES, CLASSES), np.intp), np.zeros((STATES, CLASSES), np.uint8)
    for state in range(STATES):
        for kind in range(CLASSES):
            to, bits = fresh[kind], HERE
            if (state == WORD and kind in letters) or (state == DIGITS and kind == NUMBER) or (state == MARKS and kind in (MARK, QUOTE)):
                to, bits = state, 0
            elif state == QUOTED:
                if kind in (STMD, R, V, L):
                    to, bits = {STMD: FRESH, R: PAIR_R, V: PAIR_V, L: PAIR_L}[kind], 0
                elif kind in (MARK, QUOTE):
                    to, bits = MARKS, 0
            elif state in (PAIR_R, PAIR_V, PAIR_L):
                if kind == {PAIR_R: E, PAIR_V: E, PAIR_L: L}[state]:
                    to, bits = FRESH, 0
                elif kind in letters:
                    to, bits = WORD, BEFORE
                else:
                    bits = HERE | BEFORE
            elif state in (ONE_SPACE, SPACES, ONE_BLANK, BLANKS):
                if kind in (SPACE, BLANK):
                    to, bits = SPACES if kind == SPACE else BLANKS, 0
                elif kind != END and state in (ONE_SPACE, SPACES):
                    to, bits = joined[kind], BEFORE if state == SPACES else 0
                elif kind != END and state == BLANKS:
                    bits = HERE | BEFORE
            nxt[state, kind], out[state, kind] = to, bits
    return nxt, out


def character_classes(tokenizer: Tokenizer) -> np.ndarray:
    """The class of every code point, by asking the tokenizer's own splitter where it cuts behind a letter, a digit and a mark."""
    asked = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    cut = {}
    for lead in "a1!":
        cut[lead] = np.zeros(len(asked), bool)
        for k in range(0, len(asked), 4096):
            some = asked[k : k + 4096]
            begins = {a for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str("".join(f"{lead}{c}\n" for c in some))}
            cut[lead][k : k + len(some)] = [3 * i + 1 in begins for i in range(len(some))]
    kinds = np.where(~cut["a"], LETTER, np.where(~cut["1"], NUMBER, np.where(cut["!"], BLANK, MARK)))
    out = np.full(sys.maxunicode + 1, MARK, np.uint8)
    out[[ord(c) for c in asked]] = kinds
    for text, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        for c in text:
            out[ord(c)] = kind
    return out


class Chunks:
    """Chunks of segments as maps: what each does from each state it may begin in.

    kinds: the classes of all characters, the last of each segment an END; ends: where those are. to[l, s] is the state in which chunk l
    ends if it begins in s. Paths from different states soon meet: from step head on there is one path a chunk, and its words are common
    to all states; words that begin before belong to one state each. A word reaches to the next that begins, which may lie in a later
    chunk. Words are given as (chunk, begin, end), and those of one state with their state; the word of an END is left out."""

    def __init__(self, kinds: np.ndarray, ends: np.ndarray, chunk: int = CHUNK):
        nxt, out = splitter()
        flat, emitted = nxt.ravel(), out.ravel()
        first = np.concatenate([[0], ends[:-1] + 1])
        lanes_of = -(-(ends + 1 - first) // chunk)
        self.last = lanes_of.cumsum() - 1  # the last chunk of each segment
        lanes = int(lanes_of.sum())
        within = np.arange(lanes) - np.repeat(self.last + 1 - lanes_of, lanes_of)
        start = np.repeat(first, lanes_of) + within * chunk
        length = np.minimum(chunk, np.repeat(ends + 1, lanes_of) - start)
        steps = np.full((lanes, chunk), END, np.intp)
        inside = np.arange(chunk) < length[:, None]
        steps[inside] = kinds
        steps = np.ascontiguousarray(steps.T)
        now = np.broadcast_to(np.arange(STATES, dtype=np.intp), (lanes, STATES))
        heads, tails = [], []
        for j in range(chunk):
            at = now * CLASSES + steps[j][:, None]
            (heads if now.shape[1] > 1 else tails).append(emitted[at])
            now = flat[at]
            if now.shape[1] > 1 and (j % 4 == 3 or j == chunk - 1) and (now == now[:, :1]).all():
                now = now[:, :1]  # whatever the start, the state is the same
        self.to = np.array(np.broadcast_to(now, (lanes, STATES)))
        head = len(heads)
        # where words begin: chunk, state and place of the heads, chunk and place of what is common
        lane, state, place = self._begins(np.array(heads).transpose(1, 2, 0), start, 0, length)
        if tails:
            tail_lane, _, tail_place = self._begins(np.array(tails).transpose(1, 2, 0), start, head, length)
        else:
            tail_lane = tail_place = np.zeros(0, np.int64)
        # the first word of each chunk by state, that of a later chunk where it has none
        opens = np.full((lanes, STATES), -1, np.int64)
        if len(tail_lane):
            firsts = np.flatnonzero(np.concatenate([[True], tail_lane[1:] != tail_lane[:-1]]))
            opens[tail_lane[firsts]] = tail_place[firsts][:, None]
        common = opens[:, 0].copy() if head else np.full(lanes, -1, np.int64)
        if len(lane):
            firsts = np.flatnonzero(np.concatenate([[True], (lane[1:] != lane[:-1]) | (state[1:] != state[:-1])]))
            opens[lane[firsts], state[firsts]] = place[firsts]
        for l in np.flatnonzero((opens < 0).any(1))[::-1].tolist():
            if l + 1 < lanes:
                none = opens[l] < 0
                opens[l, none] = opens[l + 1, self.to[l, none]]
        whole = len(kinds)
        after = np.full((lanes, STATES), whole, np.int64)  # where the first word behind the chunk begins
        after[:-1] = np.take_along_axis(opens[1:], self.to[:-1], 1)
        after[after < 0] = whole
        end = np.append(tail_place[1:], whole)
        if len(tail_lane):
            closing = np.append(tail_lane[1:] != tail_lane[:-1], True)
            end[closing] = after[tail_lane[closing], 0]
        self.common = self._words(tail_lane, tail_place, end, ends)[0]
        end = np.append(place[1:], whole)
        if len(lane):
            closing = np.append((lane[1:] != lane[:-1]) | (state[1:] != state[:-1]), True)
            end[closing] = np.where(common[lane[closing]] >= 0, common[lane[closing]], after[lane[closing], state[closing]])
        self.own, kept = self._words(lane, place, end, ends)
        self.own_state = state[kept]

    @staticmethod
    def _begins(bits: np.ndarray, start: np.ndarray, head: int, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunk, state and place of the words that begin in steps from head on, in that order; what lies behind a chunk's own characters is left out. bits: by chunk, state and step."""
        bits = np.where((np.arange(bits.shape[2]) + head < length[:, None])[:, None, :], bits, 0)
        cells = [np.nonzero(bits & bit) for bit in (HERE, BEFORE)]
        lane, state, step = (np.concatenate([c[k] for c in cells]) for k in range(3))
        place = start[lane] + head + step - np.repeat([0, 1], [len(c[0]) for c in cells])
        order = np.lexsort((place, state, lane))
        return lane[order], state[order], place[order]

    @staticmethod
    def _words(lane: np.ndarray, begin: np.ndarray, end: np.ndarray, ends: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        kept = ~np.isin(begin, ends)
        return (lane[kept], begin[kept], end[kept]), kept

    def totals(self, common: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The tokens of each segment. common, own: tokens of the words.

        Each chunk becomes a map from the state it begins in to its last state and the tokens it emits. A parallel prefix scan composes the
        maps, adding tokens along the way; from the state in which a text begins, a segment has what its last chunk's composition emits
        beyond that of the segment before."""
        lanes = len(self.to)
        emit = np.zeros((lanes, STATES), np.int64)
        np.add.at(emit, (self.own[0], self.own_state), own)
        emit += np.bincount(self.common[0], common, lanes).astype(np.int64)[:, None]
        to, step = self.to.copy(), 1
        while step < lanes:
            emit[step:] = emit[:-step] + np.take_along_axis(emit[step:], to[:-step], 1)
            to[step:] = np.take_along_axis(to[step:], to[:-step].copy(), 1)
            step *= 2
        return np.diff(emit[self.last, FRESH], prepend=0)


class Counter(dict):
    """Counts tokens of whole texts. The dictionary remembers those of lately found words."""

    def __init__(self, compiled: str, tokenizer: str):
        super().__init__()
        self.words = Words(tokenizer)
        self.model, self.symbols = self.words.tokenizer.model, byte_symbols()
        self.lexicon = Lexicon(files.mapped(compiled))
        self.kinds = self.lexicon.arrays["kinds"].astype(np.uint8)

    def __missing__(self, word: str) -> int:
        """Tokens of a word: by the transducer, else by the model's merges."""
        raw = word.encode()
        n = self.lexicon.get(raw)
        if n < 0:
            n = len(self.model.tokenize("".join([self.symbols[b] for b in raw])))
        if len(self) >= KEPT:
            self.clear()
        self[word] = n
        return n

    def texts(self, texts: list[str]) -> list[int]:
        """Special strings inside a text are one token each, as the library's default is."""
        segments, owner, special = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            parts = self.words.parts(t)
            special[i] = len(parts) // 2
            segments += parts[::2]
            owner += [i] * (len(parts) // 2 + 1)
        if not segments:
            return []
        line = "\n".join(segments) + "\n"
        kinds = self.kinds[np.frombuffer(line.encode("utf-32-le"), np.uint32)]
        ends = np.cumsum([len(s) + 1 for s in segments]) - 1
        kinds[ends] = END
        chunks = Chunks(kinds, ends)
        total = chunks.totals(self.emitted(line, *chunks.common[1:]), self.emitted(line, *chunks.own[1:]))
        return (np.bincount(owner, total, len(texts)).astype(np.int64) + special).tolist()

    def emitted(self, line: str, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The tokens of the words between places of a line."""
        where = None
        if len(begins) and (np.diff(begins) <= 0).any():  # paths from several states have words in common
            pairs, where = np.unique(begins << 32 | ends, return_inverse=True)
            begins, ends = pairs >> 32, pairs & 0xFFFFFFFF
        found = np.fromiter(map(self.__getitem__, map(line.__getitem__, map(slice, begins.tolist(), ends.tolist()))), np.int64, len(begins))
        return found if where is None else found[where]


def compile_counter(spark: SparkSession, tokenizer: str) -> str:
    """Compile a byte-level BPE tokenizer; returns the file's URI in the shared folder: the character classes, and the transducer from every vocabulary entry to the number of tokens it gives as a word."""
    held = Words(tokenizer)
    symbols = byte_symbols()
    byte_of = {c: b for b, c in enumerate(symbols)}
    spelt = [t for t in held.tokenizer.get_vocab(with_added_tokens=False) if all(c in byte_of for c in t)]
    entries = sorted((bytes(byte_of[c] for c in t), len(held.tokenizer.model.tokenize(t))) for t in spelt)
    files.publish(name := f"{scratch(spark, 'token-counter')}/compiled", compile_lexicon(entries, {"kinds": character_classes(held.tokenizer)}))
    return name


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs without its text, with n_bytes (UTF-8), n_tokens and over_limit. A null text counts as empty. Columns of docs with these names are replaced; an empty df gives no rows. Nothing is shuffled."""
    spark = docs.sparkSession
    small_batches(spark)
    compiled = compile_counter(spark, tokenizer)

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from lean(counts)(batches)

    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(compiled, tokenizer)
        for texts in batches:
            yield pd.Series(counter.texts([t or "" for t in texts]), dtype="int64")

    kept = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit") and c != text]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), counted(F.col(text)).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, vocabulary("byte_bpe_50k.json"))
