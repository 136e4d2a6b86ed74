"""Projects: resolving references to them, the state of their indexes, calls between methods, and where indexers run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stable_id

INTERPROCEDURAL_CONFIDENCE = 0.85


def resolve_projects(references: DataFrame, projects: DataFrame) -> DataFrame:
    """references (reference) with project_id and status: by id first, else by exact name: RESOLVED, AMBIGUOUS or UNKNOWN."""
    by_id = projects.select(F.col("project_id").alias("reference"), F.col("project_id").alias("by_id"))
    names = projects.groupBy(F.col("name").alias("reference")).agg(F.count("*").alias("n"), F.min("project_id").alias("by_name"))
    both = references.join(by_id, "reference", "left").join(names, "reference", "left")
    status = F.when(F.col("by_id").isNotNull() | (F.col("n") == 1), "RESOLVED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("UNKNOWN")
    return both.select("reference", status.alias("status"), F.coalesce("by_id", F.when(F.col("n") == 1, F.col("by_name"))).alias("project_id"))


def index_states(projects: DataFrame, pointers: DataFrame, runs: DataFrame) -> DataFrame:
    """Per project the active snapshot, the last successful run, and READY, STALE (the last run failed), FAILED or NOT_INDEXED."""
    last = runs.groupBy("project_id").agg(F.max_by("status", F.struct("at", "id")).alias("last_status"), F.max_by(F.when(F.col("status") == "SUCCEEDED", F.col("id")), F.when(F.col("status") == "SUCCEEDED", F.struct("at", "id"))).alias("last_success"))
    both = projects.join(pointers, "project_id", "left").join(last, "project_id", "left")
    ok = F.col("last_status") == "SUCCEEDED"
    state = F.when(F.col("snapshot_id").isNotNull() & (ok | F.col("last_status").isNull()), "READY").when(F.col("snapshot_id").isNotNull(), "STALE").when(F.col("last_status").isNotNull() & ~ok, "FAILED").otherwise("NOT_INDEXED")
    return both.select("project_id", "snapshot_id", "last_success", state.alias("state"))


def semantic_states(projects: DataFrame, indexes: DataFrame, provider: str | None, model: str, dims: int) -> DataFrame:
    """Per project (project_id, snapshot_id) whether its semantic index (project_id, index_snapshot, provider, model, dims) can be used: DISABLED, NO_ACTIVE_SNAPSHOT, MISSING, STALE or READY."""
    both = projects.join(indexes, "project_id", "left")
    aligned = (F.col("provider") == F.lit(provider)) & (F.col("model") == model) & (F.col("dims") == dims)
    current = F.col("snapshot_id") == F.col("index_snapshot")
    state = F.when(F.lit(provider is None), "DISABLED").when(F.col("snapshot_id").isNull(), "NO_ACTIVE_SNAPSHOT").when(F.col("index_snapshot").isNull(), "MISSING").when(aligned & current, "READY").otherwise("STALE")
    limits = F.array_compact(F.array(F.when((state == "STALE") & ~current, "SEMANTIC_INDEX_SNAPSHOT_STALE"), F.when((state == "STALE") & ~aligned, "SEMANTIC_INDEX_MODEL_STALE")))
    return both.select("project_id", state.alias("state"), F.array_join(limits, ",").alias("limitations"))


def interprocedural_edges(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """Flows of calls that fit one method by name and number of arguments: arguments to parameters, returns to results.

    methods: method_id, name, parameters, returns (arrays of node ids); calls: call_id, name, arguments (array), result."""
    arity = methods.withColumn("arity", F.size("parameters"))
    single = arity.groupBy("name", "arity").agg(F.count("*").alias("n"), F.first("parameters").alias("parameters"), F.first("returns").alias("returns")).filter("n = 1")
    met = calls.withColumn("arity", F.size("arguments")).join(single, ["name", "arity"])
    into = met.select("call_id", F.explode(F.arrays_zip("arguments", "parameters")).alias("p")).select("call_id", F.col("p.arguments").alias("source_node_id"), F.col("p.parameters").alias("target_node_id"), F.lit("ARGUMENT_FLOW").alias("kind"))
    back = met.select("call_id", F.explode("returns").alias("source_node_id"), F.col("result").alias("target_node_id"), F.lit("RETURN_FLOW").alias("kind"))
    both = into.unionByName(back)
    return both.select(stable_id("flow", F.col("call_id"), F.col("source_node_id"), F.col("target_node_id"), F.col("kind")).alias("id"), "source_node_id", "target_node_id", "kind", F.lit("DERIVED").alias("nature"), F.lit(INTERPROCEDURAL_CONFIDENCE).alias("confidence"))


def execution_scopes(modules: list[dict], roots: list[dict], languages: set[str], builds: set[str], multi_module: bool) -> list[str]:
    """Where an indexer runs: once at the root if it handles several modules and owns the root's build, else in each module with its languages and builds."""
    able = [m for m in modules if any(r["module_path"] == m["module_path"] and r["language"] in languages for r in roots)]
    if not able:
        raise ValueError("no module has the indexer's languages")
    root = next((m for m in modules if m["module_path"] == ""), None)
    if root and multi_module and builds & set(root["build_systems"]):
        return [""]
    out = sorted(m["module_path"] for m in able if not builds or builds & set(m["build_systems"]))
    if not out:
        raise ValueError("no module has the indexer's build system")
    return out


def refresh(spark: SparkSession, capture, assess, execute, promote) -> str:
    """One incremental run: fingerprints before, what they ask for, the work, fingerprints after. The baseline moves only if the tree stood still; returns the scope done, UNSTABLE if it didn't."""
    before = capture()
    scope = assess(before)
    if scope == "NONE":
        return scope
    execute(scope)
    if capture() != before:
        return "UNSTABLE"
    promote(before)
    return scope


def refresh_outcomes(refreshes: DataFrame) -> DataFrame:
    """What each refresh (project_id, scope, before, after: aggregate hashes of its tree) did, and the baseline that holds then: NONE leaves the old one, a tree that moved under the run is UNSTABLE and leaves it, else before becomes it."""
    stood = F.col("before").eqNullSafe(F.col("after"))
    outcome = F.when(F.col("scope") == "NONE", "NONE").when(~stood, "UNSTABLE").otherwise(F.col("scope"))
    return refreshes.select("project_id", outcome.alias("outcome"), F.when((F.col("scope") == "NONE") | ~stood, F.col("baseline")).otherwise(F.col("before")).alias("baseline"))


def scopes(modules: DataFrame, roots: DataFrame, indexers: DataFrame) -> DataFrame:
    """Where each indexer runs (indexer_id, scope: a module path, "" the root): at the root alone if it handles several modules and has one of the root's builds, else in each module that has one of its languages and, where it names builds, one of them.

    modules: module_path, build_systems; roots: module_path, language; indexers: indexer_id, languages, build_systems, multi_module. An indexer without a scope has no row."""
    spoken = roots.groupBy("module_path").agg(F.collect_set("language").alias("spoken"))
    fits = F.arrays_overlap("spoken", "languages")
    able = modules.join(spoken, "module_path").crossJoin(F.broadcast(indexers.select("indexer_id", "languages", F.col("build_systems").alias("builds"), "multi_module"))).filter(fits)
    owned = F.arrays_overlap("builds", "build_systems")
    root = modules.filter("module_path = ''").select(F.col("build_systems").alias("root_builds"))
    whole = able.select("indexer_id", "builds", "multi_module").distinct().crossJoin(F.broadcast(root.limit(1))).filter(F.col("multi_module") & F.arrays_overlap("builds", "root_builds")).select("indexer_id")
    each = able.filter((F.size("builds") == 0) | owned).join(whole, "indexer_id", "left_anti").select("indexer_id", F.col("module_path").alias("scope"))
    return whole.select("indexer_id", F.lit("").alias("scope")).unionByName(each)


#: Steps of an indexing run, and what a failure at any of them leaves: the old snapshot as STALE, or FAILED without one.
LIFECYCLE = ["PROVIDER_EXECUTION", "STAGING", "PROMOTION", "COMPLETED"]


def run_lifecycle(steps: dict, has_snapshot: bool) -> tuple[str, str]:
    """Run the steps' functions in order; the last step reached and the project's state after."""
    for name in LIFECYCLE[:-1]:
        try:
            steps[name]()
        except Exception:  # whatever a provider raises ends the run, not the service
            return name, "STALE" if has_snapshot else "FAILED"
    return "COMPLETED", "READY"


def lifecycle_states(runs: DataFrame) -> DataFrame:
    """runs (id, failed_step: null where none failed, snapshot_id: the active one before) with the last step each reached, its project's state and the snapshot that is active after: a failure keeps the old one, as STALE."""
    failed = F.col("failed_step").isNotNull()
    state = F.when(~failed, "READY").when(F.col("snapshot_id").isNotNull(), "STALE").otherwise("FAILED")
    return runs.select("id", F.coalesce("failed_step", F.lit(LIFECYCLE[-1])).alias("last_step"), state.alias("state"), F.when(failed, F.col("snapshot_id")).otherwise(F.concat(F.lit("snap:"), "id")).alias("active_snapshot"))


#: What a level of support counts, of FULL's three.
SUPPORT = {"FULL": 3, "PARTIAL": 2, "EXPERIMENTAL": 1, "UNSUPPORTED": 0}


def conformance(support: DataFrame) -> DataFrame:
    """Per provider the rounded percentage of full support over its capabilities. support: provider_id, capability, level."""
    points = F.element_at(F.create_map(*[F.lit(x) for pair in SUPPORT.items() for x in pair]), F.col("level"))
    return support.groupBy("provider_id").agg(F.count("*").alias("capabilities"), F.round(100.0 * F.sum(points) / (3 * F.count("*"))).cast("int").alias("percent"))
