"""Modules, build systems and source roots of any number of projects, from a table of their paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import BUILD_MARKERS, HARD_IGNORED, INHERITED, MODULE_MARKERS, IgnoreRules

#: Folders that hold sources by convention, below a module, with what stands in them, of which language, by which endings.
CONVENTIONS = [
    ("src/main/java", "SOURCE", "JAVA", ".java"), ("src/test/java", "TEST", "JAVA", ".java"), ("src/main/kotlin", "SOURCE", "KOTLIN", ".kt .kts"), ("src/test/kotlin", "TEST", "KOTLIN", ".kt .kts"),
    ("src", "SOURCE", "TYPESCRIPT", ".ts .tsx"), ("test", "TEST", "TYPESCRIPT", ".ts .tsx"), ("tests", "TEST", "TYPESCRIPT", ".ts .tsx"), ("src", "SOURCE", "PYTHON", ".py"), ("test", "TEST", "PYTHON", ".py"), ("tests", "TEST", "PYTHON", ".py"),
    ("src", "SOURCE", "C", ".c .h"), ("include", "SOURCE", "C", ".h"), ("test", "TEST", "C", ".c .h"), ("tests", "TEST", "C", ".c .h"),
    ("src", "SOURCE", "CPP", ".cc .cpp .cxx .hh .hpp .hxx"), ("include", "SOURCE", "CPP", ".hh .hpp .hxx"), ("test", "TEST", "CPP", ".cc .cpp .cxx"), ("tests", "TEST", "CPP", ".cc .cpp .cxx"),
    ("src", "SOURCE", "CSHARP", ".cs"), (".", "SOURCE", "GO", ".go"), ("src", "SOURCE", "RUST", ".rs"), ("tests", "TEST", "RUST", ".rs"),
]


def is_ignored(path: Column, rules: list[IgnoreRules]) -> Column:
    """Whether a file's path is left out: it stands in a folder that is never entered, or one of the ignore files says so, by the last of its rules that fits."""
    out = path.rlike("(?:^|/)(?:" + "|".join(sorted(x.replace(".", r"\.") for x in HARD_IGNORED)) + ")(?:/|$)")
    for file in rules:
        said = F.lit(False)
        for wide, exact, folder, negated in file.rules:  # each decides anew where it fits
            fits = path.rlike(f"(?s)^(?:{wide.pattern})$")
            if folder:
                fits = fits & ~path.rlike(f"(?s)^(?:{exact.pattern})$")
            said = F.when(fits, not negated).otherwise(said)
        out = out | said
    return out


def folder_of(path: Column) -> Column:
    """The folder of a path, empty for the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def _upwards(folder: str) -> Column:
    """A folder, those above it, and the root."""
    parts = F.split(F.col(folder), "/")
    return F.when(F.col(folder) == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))


def _markers(df: DataFrame) -> DataFrame:
    """project_id, folder and system of every marker file; MODULE is what makes a folder a module."""
    rows = [("MODULE", m) for m in MODULE_MARKERS] + [(b, m) for b, markers in BUILD_MARKERS.items() for m in markers]
    known = df.sparkSession.createDataFrame([(s, m.lower() if m.startswith("*") else m) for s, m in rows], "system string, marker string")
    name = F.regexp_extract("path", "[^/]*$", 0)
    keys = F.array(name, F.concat(F.lit("*"), F.regexp_extract(F.lower(name), r"\.[^.]*$", 0)))
    named = df.select("project_id", folder_of(F.col("path")).alias("folder"), F.explode(keys).alias("marker"))
    return named.join(F.broadcast(known), "marker").select("project_id", "folder", "system").distinct()


def modules(paths: DataFrame) -> DataFrame:
    """project_id, module_path, name and build_systems (in their fixed order) of every module of paths (project_id, path).

    A folder with a marker file is a module; a project without any is one, its root. Some build systems hold for all folders below their
    marker: a module looks for those in every folder above it, by equality with its path's prefixes."""
    marked = _markers(paths)
    own = marked.filter("system = 'MODULE'").select("project_id", F.col("folder").alias("module_path"))
    lone = paths.select("project_id").distinct().join(own.select("project_id").distinct(), "project_id", "left_anti").select("project_id", F.lit("").alias("module_path"))
    every = own.unionByName(lone)
    above = every.select("project_id", "module_path", F.explode(_upwards("module_path")).alias("folder"))
    systems = marked.filter("system <> 'MODULE'")
    met = above.join(systems, ["project_id", "folder"]).filter((F.col("folder") == F.col("module_path")) | F.col("system").isin(sorted(INHERITED)))
    order = F.array(*[F.lit(x) for x in BUILD_MARKERS])
    found = met.groupBy("project_id", "module_path").agg(F.collect_set("system").alias("systems"))
    name = F.when(F.col("module_path") == "", F.col("project_id")).otherwise(F.regexp_extract("module_path", "[^/]*$", 0))
    return every.join(found, ["project_id", "module_path"], "left").select("project_id", "module_path", name.alias("name"), F.array_intersect(order, F.coalesce("systems", F.array().cast("array<string>"))).alias("build_systems"))


def source_roots(paths: DataFrame, known: DataFrame) -> DataFrame:
    """project_id, module_path, root, root_kind and language of every conventional folder of a module (known: what modules gives) with a file of its language anywhere below.

    Paths are first reduced to folders and endings; each folder above one is then a convention's place or not, and its module is found by equality."""
    rules = [(ending, root, kind, language) for root, kind, language, endings in CONVENTIONS for ending in endings.split()]
    table = paths.sparkSession.createDataFrame(rules, "ending string, convention string, root_kind string, language string")
    ending = F.regexp_extract(F.lower(F.regexp_extract("path", "[^/]*$", 0)), r"\.[^.]*$", 0)
    slim = paths.select("project_id", folder_of(F.col("path")).alias("folder"), ending.alias("ending")).distinct().join(F.broadcast(table), "ending")
    placed = slim.select("project_id", "convention", "root_kind", "language", F.explode(_upwards("folder")).alias("root")).distinct()
    at = F.when(F.col("convention") == ".", F.col("root")).when(F.col("root") == F.col("convention"), F.lit("")).when(F.endswith(F.col("root"), F.concat(F.lit("/"), F.col("convention"))), F.expr("substring(root, 1, length(root) - length(convention) - 1)"))
    return placed.withColumn("module_path", at).join(known.select("project_id", "module_path"), ["project_id", "module_path"]).select("project_id", "module_path", "root", "root_kind", "language").distinct()
