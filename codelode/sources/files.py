"""Project trees: what is ignored, what modules there are, fingerprints, and bounded reads of sources."""

from __future__ import annotations

import os
import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import estimate, truncate
from . import trees

#: Folders never entered; marker files of build systems and modules.
HARD_IGNORED = {".git", ".idea", ".codelode", "node_modules", "target", "dist", "out"}
BUILD_MARKERS = {
    "MAVEN": ["pom.xml"], "GRADLE": ["build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts"], "PNPM": ["pnpm-lock.yaml", "pnpm-workspace.yaml"], "YARN": ["yarn.lock"], "NPM": ["package-lock.json"],
    "CMAKE": ["CMakeLists.txt"], "DOTNET": ["*.csproj", "*.sln"], "GO_MODULE": ["go.mod", "go.work"], "CARGO": ["Cargo.toml"],
}
INHERITED = {"PNPM", "YARN", "NPM"}
MODULE_MARKERS = ["pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "package.json", "pyproject.toml", "setup.py", "CMakeLists.txt", "*.csproj", "*.sln", "go.mod", "go.work", "Cargo.toml"]
MAX_SOURCE_BYTES = 16 << 20


def glob_regex(glob: str) -> str:
    """A glob as a regular expression over slash-separated paths: * and ? stay in a segment, ** doesn't, [..] and [!..] are sets, a backslash takes the next character as it is."""
    tokens = re.compile(r"\\(?P<quoted>.)|\*\*+(?P<slash>/)?|(?P<star>\*)|(?P<one>\?)|\[(?P<set>!?[^\]]+)\]|(?P<plain>.)", re.S)

    def turn(m: re.Match) -> str:
        if m["quoted"] or m["plain"]:
            return re.escape(m["quoted"] or m["plain"])
        if m["star"]:
            return "[^/]*"
        if m["one"]:
            return "[^/]"
        if m["set"]:
            body = m["set"].replace("\\", "\\\\")
            return f"[^{body[1:]}]" if body.startswith("!") else f"[{body}]"
        return "(?:.*/)?" if m["slash"] else ".*"

    return tokens.sub(turn, glob)


class IgnoreRules:
    """The rules of one ignore file; the last that fits decides."""

    def __init__(self, text: str):
        self.rules: list[tuple[re.Pattern, re.Pattern, bool, bool]] = []
        for raw in text.splitlines():
            line = raw.strip()
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[negated:]
            if line[:2] in ("\\#", "\\!"):
                line = line[1:]
            folder, line = line.endswith("/"), line.removesuffix("/")
            anchored, line = line.startswith("/"), line.removeprefix("/")
            if line:
                base = ("" if anchored or "/" in line else "(?:.*/)?") + glob_regex(line)
                self.rules.append((re.compile(base + "(?:/.*)?" * folder, re.S), re.compile(base, re.S), folder, negated))

    def ignores(self, path: str, is_folder: bool) -> bool:
        out = False
        for wide, exact, folder, negated in self.rules:
            fits = wide.fullmatch(path) if not folder or is_folder else wide.fullmatch(path) and not exact.fullmatch(path)
            if fits:
                out = not negated
        return out


def ignored(path: str, is_folder: bool, files: list[IgnoreRules]) -> bool:
    """Whether a path is left out: a folder never entered is on it, or one of the ignore files says so."""
    return any(p in HARD_IGNORED for p in PurePosixPath(path).parts) or any(f.ignores(path, is_folder) for f in files)


def list_project(root: str, ignore_files: tuple[str, ...] = (".gitignore",)) -> list[str]:
    """The files of a local tree that aren't ignored, by relative path. Symbolic links aren't followed."""
    rules = []
    for name in ignore_files:
        if os.path.isfile(p := os.path.join(root, name)):
            with open(p, encoding="utf-8") as f:
                rules.append(IgnoreRules(f.read()))
    out = []
    for folder, names, found in os.walk(root):
        at = os.path.relpath(folder, root).replace(os.sep, "/")
        inside = lambda n, at=at: n if at == "." else f"{at}/{n}"
        names[:] = sorted(n for n in names if not os.path.islink(os.path.join(folder, n)) and not ignored(inside(n), True, rules))
        out += [inside(n) for n in found if not os.path.islink(os.path.join(folder, n)) and (inside(n) in ignore_files or not ignored(inside(n), False, rules))]
    return sorted(out)


def fingerprints(spark: SparkSession, root: str, **options) -> DataFrame:
    """path, size and SHA-256 of a tree's files, hashed piece by piece where they are read."""
    return trees.read(spark, root, **options).select("path", "size", "sha")


def source_lines(spark: SparkSession, root: str, pattern: str = "*", most: int = MAX_SOURCE_BYTES) -> DataFrame:
    """path, line (from 1) and text of the source files of a tree; larger files are left out."""
    return trees.read(spark, root, lines=True, pattern=pattern).filter(F.col("size") <= most).select("path", "line", "text")


def excerpt(lines: list[str], start: int, end: int, around: int, budget: int) -> tuple[int, int, str]:
    """Lines start to end (from 1) with as many around them as a token budget takes: the wider side shrinks first, then the text is cut."""
    low, high = max(1, start - around), min(len(lines), end + around)
    text = lambda: "\n".join(lines[low - 1 : high])
    while estimate(text()) > budget and (low < start or high > end):
        if start - low >= high - end and low < start:
            low += 1
        else:
            high -= 1
    return low, high, truncate(text(), budget)
