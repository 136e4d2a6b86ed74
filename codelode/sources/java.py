"""Program-graph facts from Java sources: statement-level control flow, reaching definitions, calls and configured taint.

A reader of Java's statements, not of its types: names are matched by spelling inside a method, calls by simple name and number of
arguments. What it doesn't follow is named in the limitations of a file."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import source_bytes

_TOKEN = re.compile(r'\s+|//[^\n]*|/\*.*?\*/|(?P<text>"""(?:\\.|.)*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\')|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<op>->|::|\+\+|--|[-+*/%&|^]=|>>>?=|<<=|==|!=|<=|>=|&&|\|\||[^\s\w])', re.S)
#: Words that are no variables, and those that begin something other than a method's header.
KEYWORDS = set("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null var record sealed permits yield".split())
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="}
CONFIDENCE = 0.90
#: Bytes of the sources' own files for each task that reads Java.
SPREAD_BYTES = 4 << 20


@dataclass
class Token:
    text: str
    kind: str
    line: int


def tokens(source: str) -> list[Token]:
    out, line, at = [], 1, 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise ValueError(f"line {line}: unreadable")
        if m.lastgroup:
            out.append(Token(m[0], m.lastgroup, line))
        line += m[0].count("\n")
        at = m.end()
    return out


@dataclass
class Statement:
    kind: str
    line: int
    words: list[Token] = field(default_factory=list)
    parts: list[list[Statement]] = field(default_factory=list)


@dataclass
class Method:
    name: str
    line: int
    parameters: list[str]
    body: list[Statement]


class Reader:
    """Statements of a method's body."""

    def __init__(self, words: list[Token]):
        self.words, self.at, self.flags = words, 0, set()

    def peek(self) -> str:
        return self.words[self.at].text if self.at < len(self.words) else ""

    def close(self, open_: int) -> int:
        """The place of the bracket that closes the one at open_."""
        pairs, depth = {"(": ")", "{": "}", "[": "]"}, 0
        end = pairs[self.words[open_].text]
        for k in range(open_, len(self.words)):
            t = self.words[k].text
            depth += (t == self.words[open_].text) - (t == end)
            if not depth:
                return k
        raise ValueError(f"line {self.words[open_].line}: a bracket is not closed")

    def group(self) -> list[Token]:
        """What stands in the brackets here; goes past them."""
        end = self.close(self.at)
        inside = self.words[self.at + 1 : end]
        self.at = end + 1
        return inside

    def block(self) -> list[Statement]:
        inner = Reader(self.group())
        out = inner.all()
        self.flags |= inner.flags
        return out

    def all(self) -> list[Statement]:
        out = []
        while self.at < len(self.words):
            out += self.one()
        return out

    def one(self) -> list[Statement]:
        word, line = self.peek(), self.words[self.at].line
        if word == "{":
            return self.block()
        if word == ";":
            self.at += 1
            return []
        if word in ("if", "while", "for", "synchronized") and self.words[self.at + 1 : self.at + 2] and self.words[self.at + 1].text == "(":
            self.at += 1
            head = self.group()
            parts = [self.one()]
            if word == "if" and self.peek() == "else":
                self.at += 1
                parts.append(self.one())
            each = word == "for" and any(t.text == ":" for t in head) and not any(t.text == ";" for t in head)
            return [Statement("foreach" if each else word, line, head, parts)]
        if word == "do":
            self.at += 1
            body = self.one()
            self.at += 1
            return [Statement("do", line, self.group(), [body])]
        if word == "try":
            self.at += 1
            head = self.group() if self.peek() == "(" else []
            parts = [self.block()]
            while self.peek() in ("catch", "finally"):
                last = self.peek() == "finally"
                self.at += 1
                if not last:
                    self.group()
                parts.append(self.block())
                if last:
                    return [Statement("try-finally", line, head, parts)]
            return [Statement("try", line, head, parts)]
        if word == "switch":
            self.flags.add("SWITCH_NOT_FOLLOWED")
        if word in ("break", "continue", "yield"):
            self.flags.add("JUMPS_NOT_FOLLOWED")
        begin, depth = self.at, 0
        while self.at < len(self.words):
            t = self.words[self.at].text
            if t in "([{":
                self.at = self.close(self.at)
                if t == "{" and word == "switch":
                    self.at += 1
                    break
            elif t == ";" and not depth:
                break
            self.at += 1
        words = self.words[begin : self.at]
        if self.peek() == ";":
            self.at += 1
        return [Statement(word if word in ("return", "throw", "break", "continue", "yield", "switch") else "plain", line, words)]


def methods(source: str) -> tuple[list[Method], set[str]]:
    """The methods and constructors with bodies of a file, in order, and the limitations met."""
    words = tokens(source)
    whole, out, k = Reader(words), [], 0
    while k < len(words):
        t = words[k]
        if t.kind == "name" and t.text not in KEYWORDS and k + 1 < len(words) and words[k + 1].text == "(" and k and words[k - 1].text not in (".", "new", "@", "(", ",", "=", "->", "return"):
            end = whole.close(k + 1)
            after = end + 1
            if after < len(words) and words[after].text == "throws":
                while after < len(words) and words[after].text not in "{;":
                    after += 1
            if after < len(words) and words[after].text == "{":
                stop = whole.close(after)
                reader = Reader(words[after + 1 : stop])
                body = reader.all()
                whole.flags |= reader.flags
                out.append(Method(t.text, t.line, [p[-1].text for p in split(words[k + 2 : end], ",") if p], body))
                k = stop
        k += 1
    return out, whole.flags


def split(words: list[Token], mark: str) -> list[list[Token]]:
    """The parts between marks outside brackets, angle brackets of types included."""
    out, depth = [[]], 0
    for t in words:
        depth += (t.text in "([{<") - (t.text in ")]}>")
        if t.text == mark and depth <= 0:
            out.append([])
        else:
            out[-1].append(t)
    return out


def names(words: list[Token]) -> list[str]:
    """Variables that an expression reads: names that aren't called, selected or keywords."""
    out = []
    for k, t in enumerate(words):
        after, before = words[k + 1].text if k + 1 < len(words) else "", words[k - 1].text if k else ""
        if t.kind == "name" and t.text not in KEYWORDS and after not in ("(", "->", "::") and before not in (".", "@", "::", "new"):
            out.append(t.text)
    return out


def calls(words: list[Token]) -> list[tuple[str, list[list[Token]]]]:
    """Names and arguments of the calls in an expression, outer ones first."""
    out, reader = [], Reader(words)
    for k, t in enumerate(words[:-1]):
        if t.kind == "name" and t.text not in KEYWORDS and words[k + 1].text == "(" and (not k or words[k - 1].text != "new"):
            inside = words[k + 2 : reader.close(k + 1)]
            out.append((t.text, split(inside, ",") if inside else []))
    return out


def assigned(words: list[Token]) -> tuple[str | None, list[Token], bool]:
    """The variable that a plain statement sets, the expression, and whether its old value counts, too."""
    depth = 0
    for k, t in enumerate(words):
        depth += (t.text in "([{") - (t.text in ")]}")
        if t.text in ASSIGN and not depth and k and words[k - 1].kind == "name" and (k < 2 or words[k - 2].text != "."):
            return words[k - 1].text, words[k + 1 :], t.text != "="
    for k, t in enumerate(words):
        if t.text in ("++", "--"):
            near = [w for w in words[max(0, k - 1) : k + 2] if w.kind == "name"]
            if near:
                return near[0].text, words, True
    return None, words, False


class Graph:
    """Nodes and edges of one file."""

    def __init__(self, path: str, rules: dict[str, list[str]]):
        self.path, self.rules = path, {k: set(v) for k, v in rules.items()}
        self.nodes: dict[str, dict] = {}
        self.edges: dict[str, dict] = {}
        self.methods: list[dict] = []
        self.calls: list[dict] = []
        self.serial = 0

    def _id(self, *parts: object) -> str:
        return hashlib.sha256("\x1f".join(map(str, (self.path, *parts))).encode()).hexdigest()[:32]

    def node(self, kind: str, label: str, line: int) -> str:
        self.serial += 1
        i = f"java:{self._id(kind, label, line, self.serial)}"
        self.nodes[i] = {"id": i, "kind": kind, "label": label, "file_id": self.path, "line": line}
        return i

    def edge(self, kind: str, source: str, target: str, nature: str = "FACTUAL", confidence: float | None = None) -> None:
        i = f"java:{self._id('edge', kind, source, target)}"
        self.edges[i] = {"id": i, "source_node_id": source, "target_node_id": target, "kind": kind, "nature": nature, "confidence": confidence}

    def method(self, m: Method) -> None:
        entry = self.node("BASIC_BLOCK", f"enter {m.name}", m.line)
        self.returns: list[str] = []
        params = [self.node("PARAMETER", p, m.line) for p in m.parameters]
        state: dict[str, set[str]] = {p: {i} for p, i in zip(m.parameters, params, strict=True)}
        self.taint: dict[str, set[str]] = {}
        self.run(m.body, [entry], state)
        self.methods.append({"method_id": entry, "name": m.name, "parameters": params, "returns": self.returns})

    def _flow(self, words: list[Token], block: str, line: int, state: dict[str, set[str]]) -> str | None:
        """Uses of the definitions that reach an expression, its calls, and what taint it yields."""
        for n in dict.fromkeys(names(words)):
            for d in sorted(state.get(n, ())):
                self.edge("DEF_USE", d, block, "DERIVED", CONFIDENCE)
        for name, arguments in calls(words):
            self.calls.append({"call_id": f"{block}:{len(self.calls)}", "name": name, "arguments": [self.node("VARIABLE", " ".join(t.text for t in a), line) for a in arguments], "result": self.node("RETURN_VALUE", name, line)})
        return self._taint(words, line)

    def _taint(self, words: list[Token], line: int) -> str | None:
        """The taint node that an expression yields: a source call, a sanitized or a plain tainted variable; a call that no rule knows stops it."""
        found = calls(words)
        if not found:
            return next((t for n in names(words) for t in sorted(self.taint.get(n, ()))), None)
        name, arguments = found[0]
        inner = [x for x in (self._taint(a, line) for a in arguments) if x]
        if name in self.rules.get("sources", ()):
            return self.node("SOURCE", name, line)
        kind = "SANITIZER" if name in self.rules.get("sanitizers", ()) else "SINK" if name in self.rules.get("sinks", ()) else None
        if kind is None or not inner:
            return None
        here = self.node(kind, name, line)
        for x in inner:
            self.edge("TAINT_FLOW", x, here, "DERIVED", CONFIDENCE)
        return here if kind == "SANITIZER" else None

    def _set(self, words: list[Token], block: str, line: int, state: dict[str, set[str]]) -> None:
        target, value, keeps = assigned(words)
        tainted = self._flow(value, block, line, state)
        if target is not None:
            if keeps:
                for d in sorted(state.get(target, ())):
                    self.edge("DEF_USE", d, block, "DERIVED", CONFIDENCE)
            made = self.node("VARIABLE", target, line)
            state[target] = {made} | (state.get(target, set()) if keeps else set())
            old = self.taint.get(target, set()) if keeps else set()
            self.taint[target] = ({tainted} if tainted else set()) | old

    def run(self, body: list[Statement], before: list[str], state: dict[str, set[str]]) -> list[str]:
        """Adds a body behind the blocks before; the blocks that flow on from it. state is changed to what reaches its end."""
        for s in body:
            block = self.node("BASIC_BLOCK", s.kind, s.line)
            for b in before:
                self.edge("CONTROL_FLOW", b, block)
            merge = lambda states, into=state: into.update({n: set().union(*(x.get(n, set()) for x in states)) for n in set().union(*states)})
            copy = lambda of=state: {n: set(d) for n, d in of.items()}
            if s.kind in ("if", "while", "synchronized", "foreach", "for", "do"):
                heads = split(s.words, ";") if s.kind == "for" else [s.words]
                if s.kind == "foreach":
                    at = next(k for k, t in enumerate(s.words) if t.text == ":")
                    heads = [[*s.words[:at], Token("=", "op", s.line), *s.words[at + 1 :]]]
                for h in heads[:2]:
                    self._set(h, block, s.line, state)
                ends, states = [], []
                for part in s.parts:
                    own = copy()
                    ends.append(self.run(part, [block], own))
                    states.append(own)
                if s.kind == "if":
                    before = [b for e in ends for b in e] + ([block] if len(s.parts) == 1 else [])
                    merge([*states, *([copy()] if len(s.parts) == 1 else [])])
                elif s.kind == "synchronized":
                    before = ends[0]
                    merge(states)
                else:
                    for h in heads[2:]:
                        self._set(h, block, s.line, states[0])
                    for b in ends[0]:
                        self.edge("CONTROL_FLOW", b, block)
                    # one pass: what the body sets may reach its own beginning, so the head sees it, too
                    merge([copy(), *states])
                    for n in dict.fromkeys(names(s.words)):
                        for d in sorted(state.get(n, ())):
                            self.edge("DEF_USE", d, block, "DERIVED", CONFIDENCE)
                    before = ends[0] if s.kind == "do" and ends[0] else [block]
            elif s.kind in ("try", "try-finally"):
                self._set(s.words, block, s.line, state)
                parts = s.parts[:-1] if s.kind == "try-finally" else s.parts
                ends, states = [], []
                for part in parts:
                    own = copy()
                    ends += self.run(part, [block], own)
                    states.append(own)
                merge([*states, *([copy()] if len(parts) > 1 else [])])
                before = self.run(s.parts[-1], ends or [block], state) if s.kind == "try-finally" else ends
            else:
                words = s.words[1:] if s.kind in ("return", "throw", "yield") else s.words
                self._set(words, block, s.line, state)
                if s.kind == "return":
                    self.returns.append(block)
                before = [] if s.kind in ("return", "throw") else [block]
        return before


NODE, EDGE = "id string, kind string, label string, file_id string, line int", "id string, source_node_id string, target_node_id string, kind string, nature string, confidence double"
ROWS = f"what string, {NODE}, source_node_id string, target_node_id string, nature string, confidence double, name string, members array<string>, others array<string>"


def analyze(path: str, source: str, rules: dict[str, list[str]]) -> list[dict]:
    """Rows of one file: nodes, edges, methods, calls and limitations. A file that can't be read gives a limitation alone."""
    graph = Graph(path, rules)
    try:
        found, flags = methods(source)
        for m in found:
            graph.method(m)
    except (ValueError, IndexError, StopIteration) as e:
        return [{"what": "limitation", "label": "UNREADABLE_SOURCE", "file_id": path, "name": str(e)}]
    rows = [{"what": "node", **n} for n in graph.nodes.values()] + [{"what": "edge", **e} for e in graph.edges.values()]
    rows += [{"what": "method", "id": m["method_id"], "name": m["name"], "members": m["parameters"], "others": m["returns"], "file_id": path} for m in graph.methods]
    rows += [{"what": "call", "id": c["call_id"], "name": c["name"], "members": c["arguments"], "label": c["result"], "file_id": path} for c in graph.calls]
    return rows + [{"what": "limitation", "label": f, "file_id": path} for f in sorted(flags)]


def spread(sources: DataFrame) -> DataFrame:
    """path and content of sources in more partitions than their bytes alone would make: reading them takes far longer than moving them, so a few MB are work for many cores."""
    tasks = max(2 * sources.sparkSession.sparkContext.defaultParallelism, -(-source_bytes(sources) // SPREAD_BYTES))
    return sources.select("path", "content").repartition(min(tasks, 1 << 14), "path")


def program_facts(sources: DataFrame, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of every file of sources (path, content), spread over the cores: see analyze."""
    known = rules or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ROWS.split(", ")]
        for batch in batches:
            rows = [r for p, c in zip(batch["path"], batch["content"], strict=True) if c is not None for r in analyze(p, c, known)]
            out = pd.DataFrame(rows, columns=columns)
            out["line"] = out["line"].astype("Int32")
            out["confidence"] = out["confidence"].astype("Float64")
            yield out.astype({c: object for c in ("members", "others")}).where(out.notna(), None)

    return spread(sources).mapInPandas(run, ROWS)


def edge_counts(sources: DataFrame, kind: str, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """path and edges: how many edges of a kind every file of sources (path, content) has. A file's edges are within it, so each is counted where it is read and no node or edge leaves its task; files without such edges are left out."""
    known = rules or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths, counts = [], []
            for p, c in zip(batch["path"], batch["content"], strict=True):
                n = 0 if c is None else sum(r["what"] == "edge" and r["kind"] == kind for r in analyze(p, c, known))
                if n:
                    paths.append(p)
                    counts.append(n)
            yield pd.DataFrame({"path": pd.Series(paths, dtype=object), "edges": pd.Series(counts, dtype="int64")})

    return spread(sources).mapInPandas(run, "path string, edges long").groupBy("path").agg(F.sum("edges").alias("edges"))


def graph_of(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all files, with flows between methods that a call fits alone."""
    from ..operators.projects import interprocedural_edges

    nodes = facts.filter("what = 'node'").selectExpr("id", "kind", "label", "file_id", "line")
    edges = facts.filter("what = 'edge'").selectExpr("id", "source_node_id", "target_node_id", "kind", "nature", "confidence")
    methods_ = facts.filter("what = 'method'").selectExpr("id AS method_id", "name", "members AS parameters", "others AS returns")
    calls_ = facts.filter("what = 'call'").selectExpr("id AS call_id", "name", "members AS arguments", "label AS result")
    return nodes, edges.unionByName(interprocedural_edges(methods_, calls_))


#: What a workspace may hold.
MOST_FILES, MOST_FILE_BYTES, MOST_BYTES = 2000, 4 << 20, 64 << 20


def workspace(symbols: DataFrame, files: DataFrame, most_files: int = MOST_FILES, most_file_bytes: int = MOST_FILE_BYTES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row for the Java files that symbols lie in (files: path, size): their number and bytes, those that are missing, and the limitation that keeps them from being analysed, null where there is none."""
    named = symbols.filter(F.endswith("file_id", F.lit(".java"))).select(F.col("file_id").alias("path")).distinct()
    sums = named.join(files.select("path", "size"), "path", "left").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.count_if(F.col("size").isNull()).alias("missing"))
    limit = F.when(F.col("files") > most_files, "TOO_MANY_SOURCE_FILES").when(F.col("largest") > most_file_bytes, "SOURCE_FILE_TOO_LARGE").when(F.col("bytes") > most_bytes, "SOURCES_TOO_LARGE").when(F.col("missing") > 0, "SOURCE_FILE_MISSING")
    return sums.select("files", "bytes", "missing", limit.alias("limitation"))
