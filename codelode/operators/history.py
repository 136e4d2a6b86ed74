"""Activity of repositories, resolution across projects, changes of files, and what retention keeps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_id, zone

#: Fixed names: files that say what is ignored, and build descriptors.
IGNORE_FILES = [".gitignore"]
BUILD_FILES = ["pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "package.json", "tsconfig.json", "pyproject.toml", "setup.py", "Cargo.toml", "go.mod"]


def newest_until(commits: DataFrame, since) -> DataFrame:
    """Commits in scan order before the first that is older than since: a cut, not a filter, so a newer commit behind an old one is left out."""
    first = commits.filter(F.col("committed_at") < F.lit(since)).agg(F.min("scan_pos").alias("stop"))
    return commits.crossJoin(F.broadcast(first)).filter(F.col("stop").isNull() | (F.col("scan_pos") < F.col("stop"))).drop("stop")  # one row


def _touched(commits: DataFrame, files: DataFrame) -> DataFrame:
    author = F.coalesce(F.lower("author_email"), "author_name")
    return commits.select("commit_id", "committed_at", "scan_pos", author.alias("author")).join(files, "commit_id")


def file_activity(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Per path: commits, distinct authors (e-mail in lower case, else name), the last change and its commit; of equal times the first scanned."""
    last = F.struct("committed_at", -F.col("scan_pos"))
    return _touched(commits, files).groupBy("path").agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors"), F.max("committed_at").alias("last_changed_at"), F.max_by("commit_id", last).alias("last_commit"))


def zone_activity(commits: DataFrame, files: DataFrame, depth: int = 1) -> DataFrame:
    """Per zone, the first folders of a path: touches, distinct files, the last change."""
    return _touched(commits, files).groupBy(zone(F.col("path"), depth).alias("zone")).agg(F.count("*").alias("touches"), F.countDistinct("path").alias("files"), F.max("committed_at").alias("last_changed_at"))


def top_files(activity: DataFrame, limit: int) -> DataFrame:
    return activity.orderBy(F.desc("commits"), F.desc("last_changed_at"), "path").limit(limit)


def cross_project(relations: DataFrame, references: DataFrame) -> DataFrame:
    """Unresolved relations (id, project_id, provider_id, unresolved_target) against provider references of symbols (project_id, symbol_id, provider_id, external_id) of other projects: EXACT, AMBIGUOUS or UNRESOLVED.

    References are reduced to counts per provider id and project before the join, so an id that very many symbols share joins as one row a project."""
    key = ["provider_id", "external_id"]
    per = references.groupBy(*key, F.col("project_id").alias("p")).agg(F.count("*").alias("n"), F.min("symbol_id").alias("s"))
    found = relations.join(per, (relations["provider_id"] == per["provider_id"]) & (F.col("unresolved_target") == F.col("external_id")) & (F.col("p") != F.col("project_id")), "left").drop(per["provider_id"])
    sums = found.groupBy("id", "project_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"), F.min("s").alias("s"), F.min("p").alias("p"))
    status = F.when(F.col("candidates") == 0, "UNRESOLVED").when(F.col("candidates") == 1, "EXACT").otherwise("AMBIGUOUS")
    one = F.col("candidates") == 1
    return sums.select("id", "project_id", status.alias("status"), F.when(one, F.col("p")).alias("target_project"), F.when(one, F.col("s")).alias("target_symbol"), F.when(one, 1.0).alias("confidence"))


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each path of either side: added, deleted, modified (size or hash differs) or unchanged."""
    b = before.select("path", F.col("size").alias("size0"), F.col("sha").alias("sha0"))
    both = b.join(after.select("path", F.col("size").alias("size1"), F.col("sha").alias("sha1_")), "path", "full_outer")
    same = (F.col("size0") == F.col("size1")) & (F.col("sha0") == F.col("sha1_"))
    status = F.when(F.col("sha0").isNull(), "added").when(F.col("sha1_").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return both.select("path", status.alias("status"))


def aggregate_hash(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """SHA-256 over the ordered lines path, NUL, size, NUL, hash, and their number; of each key if there are keys (strings).

    The hash of a sequence can't be split, so a key's lines pass through one task: sorted (on disk where they are many) and hashed as they
    stream by, never gathered. Lines are hashed files, not their content. Without rows there is none without keys, too."""
    own = keys or []
    line = F.concat("path", F.lit("\0"), F.col("size").cast("string"), F.lit("\0"), "sha", F.lit("\n")).alias("line")
    dealt = files.select(*own, "path", line)
    dealt = (dealt.repartition(*own) if own else dealt.repartition(1)).sortWithinPartitions(*own, "path").select(*own, "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, count = None, None, 0
        done: list[tuple] = []
        for batch in batches:
            marks = list(zip(*(batch.column(i).to_pylist() for i in range(len(own))), strict=True)) if own else [()] * batch.num_rows
            for mark, text in zip(marks, batch.column(len(own)).to_pylist(), strict=True):
                if digest is None or mark != now:
                    if digest is not None:
                        done.append((*now, digest.hexdigest(), count))
                    now, digest, count = mark, hashlib.sha256(), 0
                digest.update(text.encode())
                count += 1
        if digest is not None:
            done.append((*now, digest.hexdigest(), count))
        kinds = [*[pa.string()] * (len(own) + 1), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True) if done else [()] * len(kinds), kinds, strict=True)], [*own, "sha256", "files"])

    return dealt.mapInArrow(run, ", ".join([*(f"{k} string" for k in own), "sha256 string", "files long"]))


def verified_sources(stored_files: DataFrame, found: DataFrame) -> DataFrame:
    """Whether all .java files of a snapshot (path, size, sha) are found unchanged: one row with their number, those that differ, and the limitation that a graph of them then has."""
    java = stored_files.filter(F.endswith("path", F.lit(".java")))
    met = java.join(found.select("path", F.col("size").alias("size_"), F.col("sha").alias("sha_")), "path", "left")
    same = F.coalesce((F.col("size") == F.col("size_")) & (F.col("sha") == F.col("sha_")), F.lit(False))
    sums = met.agg(F.count("*").alias("files"), F.count_if(~same).alias("different"))
    return sums.select("files", "different", (F.col("different") == 0).alias("exact"), F.when(F.col("different") > 0, "SOURCE_FINGERPRINT_MISMATCH").alias("limitation"))


def file_ids(paths: DataFrame, project: str) -> DataFrame:
    """paths (path) with the ids that facts name files by."""
    return paths.withColumn("file_id", stable_id("file", F.lit(project), F.col("path")))


def resolve_paths(facts: DataFrame, paths: DataFrame, project: str) -> DataFrame:
    """facts (file_id) with the path whose hashed id that is, null where no candidate path has it. An equality join of digests."""
    return facts.join(file_ids(paths.select("path").distinct(), project), "file_id", "left")


def export_facts(symbols: DataFrame, rows: DataFrame, paths: DataFrame, most: int = 1_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What another tool is given: local symbols with a place in a known file (paths: file_id, path), relations between them, and a row for each kind of omission with its count.

    At most so many symbols and relations, the first by id; what that cuts off is an omission, too."""
    local = symbols.filter("NOT external")
    placed = local.filter("file_id IS NOT NULL AND start_line IS NOT NULL")
    known = placed.join(paths.select("file_id", "path"), "file_id")
    kept = known.orderBy("id").limit(most).select("id", "kind", "name", "qualified_name", "language", "path", "start_line", "end_line")
    between = rows.filter("source_type = 'SYMBOL' AND target_type = 'SYMBOL' AND target_id IS NOT NULL")
    ids = kept.select("id")
    inside = between.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    edges = inside.orderBy("id").limit(most).select("id", "source_id", "target_id", "kind", "nature")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    counts = n(symbols, "all").crossJoin(n(local, "local")).crossJoin(n(placed, "placed")).crossJoin(n(known, "known")).crossJoin(n(kept, "kept")).crossJoin(n(rows, "relations")).crossJoin(n(between, "between")).crossJoin(n(inside, "inside")).crossJoin(n(edges, "edges"))  # one row each
    gap = lambda name, a, b: F.struct(F.lit(name).alias("omission"), (F.col(a) - F.col(b)).alias("rows"))
    gaps = F.array(gap("EXTERNAL_SYMBOLS", "all", "local"), gap("SYMBOLS_WITHOUT_PLACE", "local", "placed"), gap("SYMBOLS_WITHOUT_PATH", "placed", "known"), gap("SYMBOLS_BEYOND_LIMIT", "known", "kept"), gap("RELATIONS_NOT_BETWEEN_SYMBOLS", "relations", "between"), gap("RELATIONS_WITHOUT_BOTH_ENDS", "between", "inside"), gap("RELATIONS_BEYOND_LIMIT", "inside", "edges"))
    return kept, edges, counts.select(F.inline(gaps)).filter("rows > 0")


def classify_paths(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """paths (path) with area: IGNORE_POLICY, BUILD, SOURCE, TEST or UNQUALIFIED: by the longest source root above it whose language has its ending. roots: root, root_kind, ending."""
    name = F.regexp_replace("path", "^.*/", "")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    candidates = paths.select("path", F.explode(above).alias("root")).join(roots, "root").filter(F.endswith("path", F.col("ending")))
    best = candidates.groupBy("path").agg(F.max_by("root_kind", F.struct(F.length("root"), "root_kind")).alias("kind"))
    ignore = F.lit(False)
    for f in IGNORE_FILES:
        ignore = ignore | F.col("path").startswith(f)
    area = F.when(ignore, "IGNORE_POLICY").when(name.isin(BUILD_FILES), "BUILD").otherwise(F.coalesce("kind", F.lit("UNQUALIFIED")))
    return paths.join(best, "path", "left").select("path", area.alias("area"))


def invalidation(changes: DataFrame, areas: DataFrame) -> DataFrame:
    """What must be indexed again: NONE, PARTIAL_CANDIDATE or FULL_REQUIRED, with a count for each area changed."""
    changed = changes.filter("status <> 'unchanged'").join(areas, "path", "left")
    n = lambda a: F.count_if(F.col("area") == a).alias(a.lower())
    sums = changed.agg(F.count("*").alias("changed"), *[n(a) for a in ("IGNORE_POLICY", "BUILD", "SOURCE", "TEST", "UNQUALIFIED")])
    scope = F.when(F.col("changed") == 0, "NONE").when(F.col("ignore_policy") + F.col("build") + F.col("unqualified") > 0, "FULL_REQUIRED").otherwise("PARTIAL_CANDIDATE")
    return sums.withColumn("scope", scope)


def incremental_plan(scope: DataFrame, indexers: DataFrame) -> DataFrame:
    """NONE, FULL or INCREMENTAL: the last only if every selected indexer can. scope: scope; indexers: id, incremental."""
    able = indexers.agg(F.coalesce(F.bool_and("incremental"), F.lit(False)).alias("able"))
    plan = F.when(F.col("scope") == "NONE", "NONE").when((F.col("scope") == "PARTIAL_CANDIDATE") & F.col("able"), "INCREMENTAL").otherwise("FULL")
    return scope.crossJoin(able).select("scope", "able", plan.alias("plan"))  # one row each


def keep_snapshots(files: DataFrame, newest: int = 2) -> DataFrame:
    """The active snapshot and the newest others of each project, by time, then name."""
    order = Window.partitionBy("project_id", "active").orderBy(F.desc("modified_at"), "file_name")
    return files.withColumn("k", F.row_number().over(order)).withColumn("keep", F.col("active") | (F.col("k") <= newest)).drop("k")


def keep_runs(runs: DataFrame, succeeded: int = 20, others: int = 10) -> DataFrame:
    """The newest runs of each project, succeeded and other apart: by completion (else creation), then id, last first."""
    ok = F.col("status") == "SUCCEEDED"
    order = Window.partitionBy("project_id", "ok").orderBy(F.desc(F.coalesce("completed_at", "created_at")), F.desc("id"))
    return runs.withColumn("ok", ok).withColumn("k", F.row_number().over(order)).withColumn("keep", F.col("k") <= F.when(F.col("ok"), succeeded).otherwise(others)).drop("k", "ok")


def audit_prefix(events: DataFrame, cutoff: Column, most: int) -> DataFrame:
    """Per tenant how many of its first events go: those before the first one that isn't older than cutoff, or the excess over most, whichever is more."""
    fresh = F.min(F.when(F.col("occurred_at") >= cutoff, F.col("sequence")))
    sums = events.groupBy("tenant_id").agg(F.count("*").alias("events"), F.min("sequence").alias("low"), fresh.alias("fresh"))
    by_age = F.coalesce(F.col("fresh") - F.col("low"), F.col("events"))
    return sums.select("tenant_id", "events", F.greatest(by_age, F.col("events") - most, F.lit(0)).cast("long").alias("remove"))


def chain_breaks(events: DataFrame) -> DataFrame:
    """Events whose sequence or previous hash doesn't follow from the one before (of their tenant). A tenant's first event must follow nothing.

    Each event meets the one with the sequence before it by equality, so a tenant with very many events is no task of its own."""
    one = events.select("tenant_id", (F.col("sequence") + 1).alias("sequence"), F.col("hash").alias("last"))
    first = events.groupBy("tenant_id").agg(F.min("sequence").alias("low"))
    met = events.join(one, ["tenant_id", "sequence"], "left").join(first, "tenant_id")
    begins = F.col("sequence") == F.col("low")
    broken = F.when(begins, ~F.col("previous_hash").eqNullSafe(F.lit(""))).otherwise(F.col("last").isNull() | ~F.col("last").eqNullSafe(F.col("previous_hash")))
    return met.filter(broken).select("tenant_id", "sequence")


def reject_duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """The keys that more than one row has."""
    return rows.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")


def negotiate(languages: DataFrame, indexers: DataFrame, build_systems: tuple[str, ...] = (), capabilities: tuple[str, ...] = ()) -> DataFrame:
    """Every indexer for every language with a status, and the one chosen: of the compatible ones the highest priority, then the first id. Two small tables.

    build_systems are those of the project: an indexer whose own list (its column build_systems, where there is one) isn't empty must have one of them. It must
    have all the capabilities (its column of that name). A null list counts as empty."""
    texts = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    own = lambda name: F.coalesce(F.col(name), texts(())) if name in indexers.columns else texts(())
    unfit = (F.size(own("build_systems")) > 0) & ~F.arrays_overlap(own("build_systems"), texts(build_systems))
    lacking = F.size(F.array_except(texts(capabilities), own("capabilities"))) > 0
    pairs = languages.crossJoin(F.broadcast(indexers))
    status = F.when(~F.array_contains("languages", F.col("language")), "UNSUPPORTED_LANGUAGE").when(~F.col("qualified"), "NOT_QUALIFIED").when(unfit, "BUILD_SYSTEM").when(lacking, "MISSING_CAPABILITIES").otherwise("COMPATIBLE")
    rated = pairs.withColumn("status", status)
    order = Window.partitionBy("language", "status").orderBy(F.desc("priority"), "indexer_id")
    return rated.withColumn("chosen", (F.col("status") == "COMPATIBLE") & (F.row_number().over(order) == 1)).select("language", "indexer_id", "status", "chosen")
