"""Relations derived from facts: dependencies, and tests related to production symbols."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TEST_FILE_SUFFIX, file_stem, namespace, normalized_name, stable_id, strip_test_suffix
from ..model import CONTAINER_KINDS, DEFINITION_ROLES, DEPENDENCY_KINDS, RELATIONSHIP_KINDS, ordinal
from ..store import stored
from .lookup import is_test_path

#: Fixed weights of evidence.
WEIGHTS = {"TEST_LOCATION": 0.10, "PACKAGE_PROXIMITY": 0.20, "NAMING_CONVENTION": 0.55, "DIRECT_REFERENCE": 0.65, "DIRECT_CALL": 0.80}


def fact_order() -> list:
    """The order of facts: their source, kind, resolved ones first, target, unresolved text, id."""
    return ["project_id", "source_type", "source_id", ordinal("kind", RELATIONSHIP_KINDS), F.col("target_id").isNull(), F.asc_nulls_last("target_id"), F.asc_nulls_last("unresolved_target"), "id"]


def dependencies(rows: DataFrame) -> DataFrame:
    """One DEPENDS_ON a source and target (or unresolved text), of all factual dependency facts but self-references.

    facts counts its evidence; first_fact, status and place are those of the first fact by kind, then id. Facts are reduced before the
    shuffle: no list of a pair's facts is built."""
    facts = rows.filter((F.col("nature") == "FACTUAL") & F.col("kind").isin(DEPENDENCY_KINDS)).filter(~(F.col("source_id") == F.coalesce("target_id", F.lit(""))))
    first = F.struct("project_id", "source_type", "source_id", ordinal("kind", RELATIONSHIP_KINDS), "id")
    keys = ["project_id", "source_id", "target_id", "unresolved_target"]
    pick = F.min_by(F.struct("id", "resolution_status", "file_id", "start_line"), first).alias("f")
    found = facts.groupBy(*keys).agg(F.count("*").alias("facts"), pick, F.countDistinct("kind").alias("kinds"))
    made = stable_id("rel", *[F.col(k) for k in keys[:2]], F.lit("DEPENDS_ON"), *[F.col(k) for k in keys[2:]])
    return found.select(made.alias("id"), *keys, F.lit("DEPENDS_ON").alias("kind"), F.lit("DERIVED").alias("nature"), F.lit(1.0).alias("confidence"), "facts", "kinds", F.col("f.id").alias("first_fact"), F.col("f.resolution_status").alias("resolution_status"), F.col("f.file_id").alias("file_id"), F.col("f.start_line").alias("start_line"))


def local_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.filter("NOT external AND NOT generated")


def test_anchors(symbols: DataFrame) -> DataFrame:
    """The symbols that stand for each test file: its containers, else its functions, else its others; anchors counts them."""
    tier = F.when(F.col("kind").isin(CONTAINER_KINDS), 0).when(F.col("kind") == "FUNCTION", 1).when(F.col("kind") == "OTHER", 2)
    found = local_symbols(symbols).filter(F.col("file_id").isNotNull() & is_test_path("file_id")).withColumn("tier", tier).filter("tier IS NOT NULL")
    counts = F.array(*[F.count_if(F.col("tier") == i) for i in range(3)])
    best = found.groupBy("project_id", "file_id").agg(F.min("tier").alias("tier"), counts.alias("counts"))
    best = best.select("project_id", "file_id", "tier", F.element_at("counts", F.col("tier") + 1).alias("anchors"))
    return met(found, best, ["project_id", "file_id", "tier"])


#: Tests and production symbols of a block: where more share a name, each block of its tests meets each block of its production symbols, so that no task has a name's pairs.
BLOCK = 4096
#: Pairs of a task, and the most tasks that make them.
TASK_PAIRS, MOST_TASKS = 4_000_000, 1 << 14


def met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys, neither side broadcast: Spark takes a table for as small as its compressed files, and a broadcast one is built in the driver's memory."""
    return left.join(right.hint("merge"), keys, how)


def _test_keys(anchors: DataFrame) -> DataFrame:
    """project_id, test_id and key: the names that an anchor may be a test of, its own and its file's, each once."""
    keys = F.array_distinct(F.array(normalized_name(strip_test_suffix("name")), normalized_name(F.regexp_replace(file_stem("file_id"), TEST_FILE_SUFFIX, ""))))
    return anchors.select("project_id", F.col("id").alias("test_id"), F.explode(keys).alias("key")).filter("key <> ''").distinct()


def _production_keys(symbols: DataFrame) -> DataFrame:
    """project_id, production_id and keys: the names of each production symbol, one unless rows share an id."""
    production = local_symbols(symbols).filter(~F.coalesce(is_test_path("file_id"), F.lit(False)))
    named = production.select("project_id", F.col("id").alias("production_id"), normalized_name("name").alias("key")).filter("key <> ''")
    return named.groupBy("project_id", "production_id").agg(F.collect_set("key").alias("keys"))


def _named_pairs(tests: DataFrame, named: DataFrame, tests_more: DataFrame | None = None, named_more: DataFrame | None = None) -> DataFrame:
    """project_id, test_id and production_id of all that share a name, each pair once, with the columns that tests_more has of a test and named_more of a production symbol.

    tests and named are written tables, as they are read more than once. There are as many pairs as products of the numbers under each name, so
    they are never shuffled: a production symbol of one name gives a pair once, and what pairs need is joined to their ends before. Only those of
    several names, which rows that share an id have, are made distinct. Names of more than BLOCK ends are cut into blocks; their list, which is
    broadcast, has a row for each BLOCK ends at most. The tasks that make pairs are as many as pairs ask for, since their sources are few rows."""
    one = lambda df, more, key: df if more is None else met(df, more, ["project_id", key])
    single = named.filter(F.size("keys") == 1).select("project_id", "production_id", F.element_at("keys", 1).alias("key"))
    several = named.filter(F.size("keys") > 1).select("project_id", "production_id", F.explode("keys").alias("key"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int").alias(f"{n}_blocks")
    names = stored(met(tests.groupBy("project_id", "key").agg(F.count("*").alias("tests")), single.groupBy("project_id", "key").agg(F.count("*").alias("named")), ["project_id", "key"]), "names")
    pairs = names.agg(F.sum(F.col("tests").cast("double") * F.col("named"))).first()[0] or 0
    tasks = min(max(int(tests.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / TASK_PAIRS)), MOST_TASKS)
    large = F.broadcast(names.filter((F.col("tests") > BLOCK) | (F.col("named") > BLOCK)).select("project_id", "key", blocks("tests"), blocks("named")))

    def blocked(rows: DataFrame, own: str, other: str, id_: str) -> DataFrame:
        """rows with the block they are in and, once for each, the blocks they meet."""
        n = lambda c: F.coalesce(c, F.lit(1))
        return rows.join(large, ["project_id", "key"], "left").withColumns({own: F.pmod(F.xxhash64(id_), n(f"{own}_blocks")).cast("int"), other: F.explode(F.sequence(F.lit(0), n(f"{other}_blocks") - 1))}).drop("tests_blocks", "named_blocks")

    meet = ["project_id", "key", "tests", "named"]
    left = blocked(one(tests, tests_more, "test_id"), "tests", "named", "test_id").repartition(tasks, *meet)
    right = blocked(one(single, named_more, "production_id"), "named", "tests", "production_id").repartition(tasks, *meet)
    rare = met(tests, several, ["project_id", "key"]).select("project_id", "test_id", "production_id").distinct()
    return met(left, right, meet).drop("key", "tests", "named").unionByName(one(one(rare, tests_more, "test_id"), named_more, "production_id"))


def naming_candidates(symbols: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchors whose own or file's name without its test ending is a production symbol's name."""
    return _named_pairs(stored(_test_keys(anchors), "test-keys"), stored(_production_keys(symbols), "production-keys")).select("project_id", "test_id", "production_id", F.lit("NAMING_CONVENTION").alias("type"))


def unique_anchors(anchors: DataFrame) -> DataFrame:
    return anchors.filter("anchors = 1").select("project_id", "file_id", F.col("id").alias("test_id"))


def occurrence_candidates(symbols: DataFrame, occurrences: DataFrame, anchors: DataFrame) -> DataFrame:
    """Uses of production symbols in test files that have a single anchor."""
    production = local_symbols(symbols).filter(~F.coalesce(is_test_path("file_id"), F.lit(False))).select("project_id", F.col("id").alias("symbol_id"))
    uses = occurrences.filter((F.col("resolution_status") == "RESOLVED") & F.col("symbol_id").isNotNull() & ~F.arrays_overlap("roles", F.array(*[F.lit(r) for r in DEFINITION_ROLES])))
    call = F.array_contains("roles", "CALL")
    found = met(met(uses, unique_anchors(anchors), ["project_id", "file_id"]), production, ["project_id", "symbol_id"])
    return found.select("project_id", "test_id", F.col("symbol_id").alias("production_id"), F.when(call, "DIRECT_CALL").otherwise("DIRECT_REFERENCE").alias("type")).distinct()


def relationship_candidates(symbols: DataFrame, rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Factual calls and references from test symbols to production symbols. A source that is no anchor kind stands for its file's single anchor."""
    known = local_symbols(symbols)
    test = F.coalesce(is_test_path("file_id"), F.lit(False))
    source = known.filter(test).select("project_id", F.col("id").alias("source_id"), F.col("kind").alias("source_kind"), F.col("file_id").alias("source_file"))
    target = known.filter(~test).select("project_id", F.col("id").alias("target_id"))
    facts = rows.filter((F.col("nature") == "FACTUAL") & F.col("kind").isin("CALLS", "REFERENCES") & F.col("target_id").isNotNull()).select("project_id", "source_id", "target_id", "kind")
    single = unique_anchors(anchors).withColumnsRenamed({"file_id": "source_file"})
    found = met(met(met(facts, source, ["project_id", "source_id"]), target, ["project_id", "target_id"]), single, ["project_id", "source_file"], "left")
    own = F.when(F.col("source_kind").isin([*CONTAINER_KINDS, "FUNCTION", "OTHER"]), F.col("source_id")).otherwise(F.col("test_id"))
    kind = F.when(F.col("kind") == "CALLS", "DIRECT_CALL").otherwise("DIRECT_REFERENCE")
    return found.select("project_id", own.alias("test_id"), F.col("target_id").alias("production_id"), kind.alias("type")).filter("test_id IS NOT NULL").distinct()


def related_tests(symbols: DataFrame, occurrences: DataFrame, rows: DataFrame) -> DataFrame:
    """RELATED_TEST from test to production symbols.

    Confidence is one minus the product of what each type of evidence leaves open, half-up to three decimals. A direct use makes the
    relation DERIVED, a name alone HEURISTIC; location always counts, a shared namespace too."""
    anchors = test_anchors(symbols)
    has = lambda t: F.max(F.when(F.col("type") == t, F.lit(1)).otherwise(0)).alias(t)
    direct = ["NAMING_CONVENTION", "DIRECT_REFERENCE", "DIRECT_CALL"]
    uses = occurrence_candidates(symbols, occurrences, anchors).union(relationship_candidates(symbols, rows, anchors))
    uses = stored(uses.groupBy("project_id", "test_id", "production_id").agg(*[has(t) for t in direct[1:]]), "uses")
    place = local_symbols(symbols).select("project_id", "id", namespace(F.col("qualified_name"), F.col("kind")).alias("ns"))
    ends = {k: place.select("project_id", F.col("id").alias(f"{k}_id"), F.col("ns").alias(f"{k}_ns")) for k in ("test", "production")}
    # a test's own uses go along with it to the names, which are far more pairs
    used = uses.groupBy("project_id", "test_id").agg(F.map_from_entries(F.collect_list(F.struct("production_id", F.struct(*direct[1:])))).alias("used"))
    tests, named = stored(_test_keys(anchors), "test-keys"), stored(_production_keys(symbols), "production-keys")
    by_name = _named_pairs(tests, named, met(ends["test"], used, ["project_id", "test_id"], "left"), ends["production"])
    use = F.element_at("used", F.col("production_id"))
    by_name = by_name.select("project_id", "test_id", "production_id", F.lit(1).alias(direct[0]), *[F.coalesce(use[t], F.lit(0)).alias(t) for t in direct[1:]], "test_ns", "production_ns")
    known = tests.groupBy("project_id", "test_id").agg(F.collect_set("key").alias("test_keys"))
    others = met(met(uses, known, ["project_id", "test_id"], "left"), named, ["project_id", "production_id"], "left").filter(~F.coalesce(F.arrays_overlap("test_keys", "keys"), F.lit(False)))
    others = met(met(others, ends["test"], ["project_id", "test_id"]), ends["production"], ["project_id", "production_id"]).select("project_id", "test_id", "production_id", F.lit(0).alias(direct[0]), *direct[1:], "test_ns", "production_ns")
    near = by_name.unionByName(others).withColumn("PACKAGE_PROXIMITY", ((F.col("test_ns") == F.col("production_ns")) & (F.col("test_ns") != "")).cast("int"))
    open_ = F.lit(1 - WEIGHTS["TEST_LOCATION"])
    for t in [*direct, "PACKAGE_PROXIMITY"]:
        open_ = open_ * F.when(F.col(t) == 1, 1 - WEIGHTS[t]).otherwise(1.0)
    made = stable_id("rel", F.col("project_id"), F.col("test_id"), F.lit("RELATED_TEST"), F.col("production_id"))
    nature = F.when(F.col("DIRECT_REFERENCE") + F.col("DIRECT_CALL") > 0, "DERIVED").otherwise("HEURISTIC")
    evidence = 1 + F.col("NAMING_CONVENTION") + F.col("DIRECT_REFERENCE") + F.col("DIRECT_CALL") + F.col("PACKAGE_PROXIMITY")
    return near.select(made.alias("id"), "project_id", "test_id", "production_id", nature.alias("nature"), F.round(1 - open_, 3).alias("confidence"), evidence.alias("evidence_types"))


def noisy_or(rows: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """1 - product(1 - weight) of each group, half-up to three decimals; first to nine, so that the order of factors can't tip a half."""
    return rows.groupBy(*keys).agg(F.round(F.round(1 - F.product(1 - F.col(weight)), 9), 3).alias("confidence"))


def distinct_evidence(rows: DataFrame) -> DataFrame:
    """One row a type, description and place."""
    return rows.dropDuplicates([c for c in ("relationship_id", "type", "description", "file_id", "start_line", "start_column") if c in rows.columns])


def top_per_group(rows: DataFrame, keys: list[str], order: list, n: int, name: str = "k") -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("int")).filter(F.col(name) <= n)


def ingestion_report(symbols: DataFrame, occurrences: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of sixteen counters: rows, repeated ids, rows without a file, resolved and other rows of each table, and external symbols."""
    out = None
    for name, df in (("symbols", symbols), ("occurrences", occurrences), ("relationships", rows)):
        state = F.col("resolution_status") if "resolution_status" in df.columns else F.lit("RESOLVED")
        more = [F.count_if("external").alias("symbols_external")] if name == "symbols" else []
        one = df.agg(F.count("*").alias(f"{name}_rows"), (F.count("*") - F.countDistinct("id")).alias(f"{name}_repeated"), F.count_if(F.col("file_id").isNull()).alias(f"{name}_without_file"), F.count_if(state == "RESOLVED").alias(f"{name}_resolved"), F.count_if(state != "RESOLVED").alias(f"{name}_other"), *more)
        out = one if out is None else out.crossJoin(one)  # one row each
    return out
