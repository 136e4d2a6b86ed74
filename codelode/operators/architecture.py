"""Modules: which symbols they hold, how they depend on each other, and how concentrated that is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safe_relative_path, stable_id


def assign_modules(symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """symbols with module_key, that of the longest root that holds their file (source roots before module roots), null for external symbols and unsafe paths.

    Each path is cut into its ancestor folders, which join the roots by equality: no comparison of every path with every root. Only distinct
    paths are joined."""
    paths = symbols.filter("NOT external").select("file_id").distinct().withColumn("path", safe_relative_path(F.col("file_id"))).filter("path IS NOT NULL")
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    ancestors = paths.select("file_id", F.explode(folders).alias("root"))
    found = ancestors.join(modules.select("root", "root_kind", F.col("module_id").alias("module_key")), "root")
    order = F.struct((F.col("root_kind") == "MODULE").alias("late"), (-F.length("root")).alias("short"), F.col("module_key"))
    best = found.groupBy("file_id").agg(F.min_by("module_key", order).alias("module_key"), F.min_by("root", order).alias("module_root"))
    return symbols.join(best, "file_id", "left").withColumns({c: F.when(~F.col("external"), F.col(c)) for c in ("module_key", "module_root")})


def classify_dependencies(dependencies: DataFrame, placed: DataFrame) -> DataFrame:
    """Dependencies with source_module, target_module and scope: INTER, INTRA or UNASSIGNED (an end that isn't a symbol of the snapshot, or without a module)."""
    at = placed.select("id", "module_key")
    ends = dependencies.join(at.select(F.col("id").alias("source_id"), F.col("module_key").alias("source_module")), "source_id", "left").join(at.select(F.col("id").alias("target_id"), F.col("module_key").alias("target_module")), "target_id", "left")
    scope = F.when(F.col("source_module").isNull() | F.col("target_module").isNull(), "UNASSIGNED").when(F.col("source_module") == F.col("target_module"), "INTRA").otherwise("INTER")
    return ends.withColumn("scope", scope)


def module_edges(classified: DataFrame, sample: int = 5) -> DataFrame:
    """Edges between modules: dependencies, distinct symbols at both ends, the least confidence, the first ids."""
    keys = ["source_module", "target_module"]
    inter = classified.filter("scope = 'INTER'")
    sums = inter.groupBy(*keys).agg(F.count("*").alias("dependency_count"), F.countDistinct("source_id").alias("source_symbols"), F.countDistinct("target_id").alias("target_symbols"), F.min("confidence").alias("confidence"))
    first = inter.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).filter(F.col("k") <= sample)  # a rank filter is cut in each task before the shuffle
    samples = first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("sample_ids"))
    made = stable_id("module-dependency", F.col("source_module"), F.col("target_module"))
    return sums.join(samples, keys).withColumn("id", made)


def topology(placed: DataFrame, languages: bool = True) -> DataFrame:
    """Per module: its symbols, languages (upper case, sorted) and namespaces."""
    inside = placed.filter("module_key IS NOT NULL").withColumn("namespace", folder_namespace(F.col("file_id"), F.col("module_root")))
    return inside.groupBy("module_key").agg(F.count("*").alias("symbols"), F.array_join(F.array_sort(F.collect_set(F.upper("language"))), ",").alias("languages"), F.countDistinct("namespace").alias("namespaces"))


def folder_namespace(path, root):
    """A file's folder below its root with dots for slashes, <default> at the root itself."""
    folder = F.regexp_replace(F.substring(path, F.length(root) + 2, F.lit(1 << 20)), r"/?[^/]*$", "")
    return F.when(folder == "", "<default>").otherwise(F.replace(folder, F.lit("/"), F.lit(".")))


def namespaces(placed: DataFrame) -> DataFrame:
    inside = placed.filter("module_key IS NOT NULL").withColumn("namespace", folder_namespace(F.col("file_id"), F.col("module_root")))
    return inside.groupBy("module_key", "namespace").agg(F.count("*").alias("symbols"), F.countDistinct("file_id").alias("files"))


def topology_totals(placed: DataFrame) -> DataFrame:
    return placed.agg(F.count_if(F.expr("NOT external AND module_key IS NOT NULL")).alias("local"), F.count_if(F.expr("external")).alias("external"), F.count_if(F.expr("NOT external AND module_key IS NULL")).alias("unassigned"))


def concentration(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Per module and direction: partners, dependencies, their share of all between modules, the Herfindahl index and the largest share over partners; zeros for a module without edges."""
    ids = modules.select(F.col("module_id").alias("module_key")).distinct()
    total = edges.agg(F.coalesce(F.sum("dependency_count"), F.lit(0)).alias("all"))
    out = ids
    for way, own in (("incoming", "target_module"), ("outgoing", "source_module")):
        sums = edges.groupBy(F.col(own).alias("module_key")).agg(F.count("*").alias(f"{way}_modules"), F.sum("dependency_count").alias("n"), F.sum(F.col("dependency_count") * F.col("dependency_count")).alias("squares"), F.max("dependency_count").alias("most"))
        share = sums.select("module_key", f"{way}_modules", F.col("n").alias(f"{way}_count"), (F.col("squares") / (F.col("n") * F.col("n"))).alias(f"{way}_hhi"), (F.col("most") / F.col("n")).alias(f"{way}_max_share"))
        out = out.join(share, "module_key", "left")
    out = out.na.fill(0).crossJoin(F.broadcast(total))  # one row
    for way in ("incoming", "outgoing"):
        out = out.withColumn(f"{way}_share", F.when(F.col("all") > 0, F.col(f"{way}_count") / F.col("all")).otherwise(0.0))
    return out.drop("all")


def directional_ranks(metrics: DataFrame) -> DataFrame:
    """Dense ranks by distinct counts, most first; 0 for a module without dependencies that way."""
    out = metrics
    for way in ("incoming", "outgoing"):
        counts = metrics.filter(F.col(f"{way}_count") > 0).select(f"{way}_count").distinct()
        ranks = counts.withColumn(f"{way}_rank", F.row_number().over(Window.orderBy(F.desc(f"{way}_count"))).cast("int"))  # over distinct counts of modules
        out = out.join(ranks, f"{way}_count", "left").withColumn(f"{way}_rank", F.coalesce(f"{way}_rank", F.lit(0)))
    return out


def technologies(languages: DataFrame, builds: DataFrame) -> DataFrame:
    """Per category and name: how many modules have it, and which. languages, builds: module_key, name."""
    both = languages.select(F.lit("LANGUAGE").alias("category"), "name", "module_key").union(builds.select(F.lit("BUILD_SYSTEM"), "name", "module_key"))
    return both.groupBy("category", "name").agg(F.countDistinct("module_key").alias("modules"), F.array_join(F.array_sort(F.collect_set("module_key")), ",").alias("module_keys"))


def module_context(edges: DataFrame, metrics: DataFrame, module: str) -> DataFrame:
    """A module's edges with the metrics of the module at the other end."""
    mine = edges.filter((F.col("source_module") == module) | (F.col("target_module") == module))
    way = F.when(F.col("source_module") == module, "OUTGOING").otherwise("INCOMING")
    other = F.when(F.col("source_module") == module, F.col("target_module")).otherwise(F.col("source_module"))
    return mine.select(way.alias("way"), other.alias("module_key"), "dependency_count", "confidence").join(metrics.select("module_key", "incoming_count", "outgoing_count"), "module_key")


def render_graph(edges: DataFrame, form: str = "mermaid", module: str | None = None, most: int = 10_000) -> str:
    """A module graph as Mermaid or DOT text with numbered aliases; with a module, its edges only. At most so many edges are drawn; more is an error."""
    if module is not None:
        edges = edges.filter((F.col("source_module") == module) | (F.col("target_module") == module))
    rows = edges.select("source_module", "target_module", "dependency_count").orderBy("source_module", "target_module").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the graph has more than {most} edges")
    alias = {m: f"m{i}" for i, m in enumerate(sorted({x for r in rows for x in r[:2]} | ({module} if module else set())))}
    shown = {m: m.replace("\\", "\\\\").replace('"', "'" if form == "mermaid" else '\\"') for m in alias}
    if form == "mermaid":
        return "\n".join(["graph LR", *(f'  {a}["{shown[m]}"]' for m, a in alias.items()), *(f"  {alias[s]} -->|{n}| {alias[t]}" for s, t, n in rows)]) + "\n"
    return "\n".join(["digraph modules {", *(f'  {a} [label="{shown[m]}"];' for m, a in alias.items()), *(f'  {alias[s]} -> {alias[t]} [label="{n}"];' for s, t, n in rows), "}"]) + "\n"
