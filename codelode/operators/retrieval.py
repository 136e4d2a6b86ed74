"""Exact vector search, hybrid ranking, bounded contexts, and measures of retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, excerpt_of, lexical_score, token_estimate, truncated

MAX_RESULTS, RESPONSE_TOKENS = 1000, 32
#: Lines of a bin in which spans of a file meet its lines.
BIN = 64
#: Fixed weights: semantic, lexical, graph; and lexical, graph where there is no semantic index.
HYBRID, FALLBACK = (0.50, 0.35, 0.15), (0.70, 0.30)


def cosine_top_k(vectors: DataFrame, query: list[float], limit: int, least: float = -1.0, key: str = "stable_key", vector: str = "vector") -> DataFrame:
    """The nearest vectors by cosine, ties by key: a scan of every vector and a bounded heap a task."""
    if not 1 <= limit <= MAX_RESULTS:
        raise ValueError(f"limit is 1 to {MAX_RESULTS}")
    score = cosine(F.transform(vector, lambda x: x.cast("double")), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select(key, score.alias("score")).filter(F.col("score") >= least).orderBy(F.desc("score"), key).limit(limit)


def distance_top_k(vectors: DataFrame, query: list[float], limit: int, key: str = "stable_key", vector: str = "vector") -> DataFrame:
    """The nearest vectors by cosine distance, as a vector database ranks them: distance first, then key, the score one minus it; no index, so exact."""
    if not 1 <= limit <= MAX_RESULTS:
        raise ValueError(f"limit is 1 to {MAX_RESULTS}")
    distance = 1 - cosine(F.transform(vector, lambda x: x.cast("double")), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select(key, distance.alias("distance")).orderBy("distance", key).limit(limit).withColumn("score", 1 - F.col("distance"))


def semantic_search(index: DataFrame, state: str, query: list[float], limit: int, least: float = -1.0) -> DataFrame:
    """Hits of a READY index with their nature and what limits them; an index in any other state is not searched and gives no rows."""
    hits = cosine_top_k(index, query, limit, least)
    tagged = hits.withColumns({"nature": F.lit("HEURISTIC"), "limitation": F.lit("EXACT_LINEAR_SCAN")})
    return tagged if state == "READY" else tagged.limit(0)


def synchronize(index: DataFrame, documents: DataFrame, embed: Callable[[Column], Column], model: tuple[str, str, int] | None = None, indexed: tuple[str, str, int] | None = None) -> DataFrame:
    """The index (stable_key, checksum, vector) of documents (stable_key, content, checksum): vectors of unchanged documents are taken over, only the others are embedded, and what is gone is left out.

    reused says which. Where provider, model or dimensions differ nothing is taken over."""
    old = index.select("stable_key", F.col("checksum").alias("old"), F.col("vector").alias("known"))
    both = documents.select("stable_key", "content", "checksum").join(old if model == indexed else old.limit(0), "stable_key", "left")
    same = F.coalesce(F.col("old") == F.col("checksum"), F.lit(False))
    kept = both.filter(same).select("stable_key", "checksum", F.col("known").alias("vector"), F.lit(True).alias("reused"))
    return kept.unionByName(both.filter(~same).select("stable_key", "checksum", embed(F.col("content")).alias("vector"), F.lit(False).alias("reused")))


def lexical_baseline(documents: DataFrame, query: str, limit: int) -> DataFrame:
    scored = documents.select("stable_key", lexical_score(F.col("content"), query).alias("score"))
    return scored.filter("score > 0").orderBy(F.desc("score"), "stable_key").limit(limit)


def graph_degree(rows: DataFrame) -> DataFrame:
    """How many relations touch each symbol; one to itself counts twice."""
    return rows.select(F.explode(F.array_compact(F.array("source_id", "target_id"))).alias("source_id")).groupBy("source_id").agg(F.count("*").alias("degree"))


def hybrid_search(documents: DataFrame, rows: DataFrame | None, query: str, limit: int, semantic: DataFrame | None = None, least: float = 0.0, degrees: DataFrame | None = None) -> DataFrame:
    """Documents by a mix of semantic score (stable_key, score: the probe's hits, others 0), lexical score and the degree of their symbol; those without either text signal are left out.

    degrees: what graph_degree gives, if it is stored. documents may have their normalized text in a column of that name."""
    degrees = graph_degree(rows) if degrees is None else degrees
    most = degrees.agg(F.max("degree").alias("most"))
    normal = F.col("normalized") if "normalized" in documents.columns else None
    found = documents.withColumn("lexical", lexical_score(F.col("content"), query, normal)).filter(F.col("lexical") > 0) if semantic is None else documents.withColumn("lexical", lexical_score(F.col("content"), query, normal))
    found = found.join(degrees, "source_id", "left").crossJoin(F.broadcast(most))  # one row
    graph = F.when((F.col("kind") == "SYMBOL") & (F.col("most") > 0), F.coalesce("degree", F.lit(0)) / F.col("most")).otherwise(0.0)
    if semantic is None:
        found = found.withColumn("semantic", F.lit(0.0))
    else:
        found = found.join(semantic.select("stable_key", F.col("score").alias("semantic")), "stable_key", "left").na.fill(0.0, ["semantic"])
    found = found.withColumn("graph", graph).filter("lexical > 0 OR semantic > 0")
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    mixed = FALLBACK[0] * F.col("lexical") + FALLBACK[1] * F.col("graph") if semantic is None else HYBRID[0] * unit(F.col("semantic")) + HYBRID[1] * F.col("lexical") + HYBRID[2] * F.col("graph")
    scored = found.withColumn("score", unit(mixed)).filter(F.col("score") >= least)
    return scored.select("stable_key", "kind", "source_id", "content", "score", "lexical", "graph", "semantic").orderBy(F.desc("score"), "stable_key").limit(limit)


def probe_size(limit: int, documents: int) -> int:
    return min(MAX_RESULTS, max(limit * 10, min(documents, 200)))


def hybrid_contexts(ranked: DataFrame, by: list[str], max_documents: int = 20, max_tokens: int = 4096, per_document: int = 1024) -> DataFrame:
    """Documents that fill each query's token budget in rank order, cut where they exceed their share: by's columns, position, stable_key, content, score, tokens, truncated.

    ranked: by's columns (those that tell queries apart), stable_key, content and score; ties by key. A document takes what is left of the
    budget or of its share at most, an empty one is passed over, and of a query's documents the first 3 * max_documents are looked at. The
    fold runs in an expression over these few of each query, whose contents are cut to their share before they are gathered."""
    if not 1 <= max_documents <= 100 or not 128 <= max_tokens <= 65_536:
        raise ValueError("1 to 100 documents, 128 to 65536 tokens")
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("score"), "stable_key")
    best = ranked.withColumn("rank_", F.row_number().over(order)).filter(F.col("rank_") <= min(500, 3 * max_documents))
    item = F.struct("rank_", "stable_key", "score", token_estimate("content").alias("size"), truncated("content", F.lit(per_document)).alias("content"))
    grouped = best.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items_"))
    start = F.expr(f"CAST(named_struct('used', {RESPONSE_TOKENS}, 'stopped', false, 'out', array()) AS struct<used: int, stopped: boolean, out: array<struct<at: int, tokens: int>>>)")

    def step(acc: Column, x: Column) -> Column:
        room = F.least(F.lit(per_document), F.lit(max_tokens) - acc["used"])
        tokens = F.least(x["size"], room).cast("int")
        stop = (F.size(acc["out"]) >= max_documents) | (room <= 0) | acc["stopped"]
        taken = F.struct((acc["used"] + tokens).alias("used"), F.lit(False).alias("stopped"), F.concat(acc["out"], F.array(F.struct(x["rank_"].alias("at"), tokens.alias("tokens")))).alias("out"))
        return F.when(stop, F.struct(acc["used"].alias("used"), F.lit(True).alias("stopped"), acc["out"].alias("out"))).when(x["size"] == 0, acc).otherwise(taken)

    folded = grouped.withColumn("fold_", F.aggregate("items_", start, step))
    each = folded.select(*by, "items_", F.posexplode("fold_.out").alias("i_", "o_")).withColumn("x_", F.element_at("items_", F.col("o_.at")))
    return each.select(*by, (F.col("i_") + 1).alias("position"), "x_.stable_key", truncated("x_.content", F.col("o_.tokens")).alias("content"), "x_.score", "o_.tokens", (F.col("o_.tokens") < F.col("x_.size")).alias("truncated"))


def hybrid_context(ranked: DataFrame, max_documents: int = 20, max_tokens: int = 4096, per_document: int = 1024) -> DataFrame:
    """The context of one query, whose hits ranked holds (see hybrid_contexts)."""
    one = hybrid_contexts(ranked.withColumn("query_", F.lit(0)), ["query_"], max_documents, max_tokens, per_document)
    return one.drop("query_")


def reuse_vectors(documents: DataFrame, index: DataFrame, model: tuple[str, str, int] | None = None, indexed: tuple[str, str, int] | None = None) -> DataFrame:
    """Each document of either side: REUSED (same checksum), CHANGED, ADDED or REMOVED.

    model and indexed: provider, model and dimensions now and of the index. Where they differ nothing is reused: every document is ADDED and every indexed one REMOVED."""
    if model != indexed:
        return documents.select("stable_key", F.lit("ADDED").alias("status")).union(index.select("stable_key", F.lit("REMOVED")))
    old = index.select("stable_key", F.col("checksum").alias("old"))
    both = documents.select("stable_key", "checksum").join(old, "stable_key", "full_outer")
    status = F.when(F.col("checksum").isNull(), "REMOVED").when(F.col("old").isNull(), "ADDED").when(F.col("checksum") == F.col("old"), "REUSED").otherwise("CHANGED")
    return both.select("stable_key", status.alias("status"))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """Per query recall@k (a key counts once), reciprocal rank over the whole list, and nDCG@k (repeats count). ranked: query, rank from 1, key; relevant: query, key."""
    relevant = relevant.select(query, "key").distinct()
    hits = ranked.join(relevant, [query, "key"])
    top = F.col("rank") <= k
    gain = F.when(top, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    sums = hits.groupBy(query).agg(F.countDistinct(F.when(top, F.col("key"))).alias("found"), (1 / F.min("rank")).alias("mrr"), F.sum(gain).alias("dcg"))
    sizes = relevant.groupBy(query).agg(F.count("*").alias("relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("relevant")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    both = sizes.join(sums, query, "left").na.fill(0)
    return both.select(query, "relevant", "found", (F.col("found") / F.col("relevant")).alias("recall"), "mrr", (F.col("dcg") / ideal).alias("ndcg"))


def metric_gain(a: DataFrame, b: DataFrame, query: str = "query_id") -> DataFrame:
    """What b gains over a in mean recall, reciprocal rank and nDCG."""
    mean = lambda df, p: df.agg(*[F.avg(c).alias(f"{p}{c}") for c in ("recall", "mrr", "ndcg")])
    one = mean(a, "a_").crossJoin(mean(b, "b_"))  # one row each
    return one.select(*[(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"{c}_gain") for c in ("recall", "mrr", "ndcg")])


def signal_export(ranked: DataFrame, limit: int = 500) -> DataFrame:
    """Hybrid hits with the signals behind them, for another tool: at most 500, best first, each with the limitations of what it came from."""
    if not 1 <= limit <= 500:
        raise ValueError("limit is 1 to 500")
    limits = F.array_compact(F.array(F.when(F.col("semantic") == 0, "NO_SEMANTIC_SIGNAL"), F.when(F.col("graph") == 0, "NO_GRAPH_SIGNAL"), F.when(F.col("lexical") == 0, "NO_LEXICAL_SIGNAL")))
    best = ranked.orderBy(F.desc("score"), "stable_key").limit(limit)
    return best.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "stable_key")).cast("int")).select("position", "stable_key", "kind", "score", "lexical", "graph", "semantic", F.array_join(limits, ",").alias("limitations"))


def index_size(documents: DataFrame, dims: int) -> DataFrame:
    return documents.agg(F.sum(F.coalesce(F.octet_length("content"), F.lit(0)) + 4 * dims).alias("bytes"), F.count("*").alias("documents"))


def covered_lines(placed: DataFrame, lines: DataFrame, around: int, most: int) -> DataFrame:
    """id, first and covered of placed spans (id, file_id, start_line, end_line): the texts from around lines before a span to as many after it, from lines (file_id, line from 1, text), and the number of the first.

    Spans meet lines by bins of BIN lines, so the work grows with the lines covered, not with spans times lines of a file. Lines that a
    budget of most tokens can't reach, as each line has a byte at its end, are left out; what it gives is the same."""
    last = F.least(F.col("end_line") + around, F.col("start_line") + 4 * most + 1)
    low = F.greatest(F.lit(1), F.col("start_line") - around)
    spans = placed.select("id", "file_id", low.alias("low"), F.greatest(low, last).alias("last"))
    bins = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / BIN), F.floor(F.col("last") / BIN))))
    met = bins.join(lines.select("file_id", "line", "text", F.floor(F.col("line") / BIN).alias("bin")), ["file_id", "bin"]).filter(F.col("line").between(F.col("low"), F.col("last")))
    return met.groupBy("id").agg(F.min("line").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("covered"))


def semantic_documents(symbols: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """A SYMBOL document for every symbol that isn't external, a CHUNK document for each of them that has a place, and a FILE document listing those of each file; cut to 768, 768 and 2048 tokens.

    A chunk is the symbol's source with two lines around it, from lines (file_id, line from 1, text). Where no such line is given, or all are blank, it has the symbol's own content."""
    from ..functions.text import truncated

    own = symbols.filter("NOT external")
    line = F.concat_ws(" ", "kind", F.coalesce("qualified_name", "name"), "signature")
    single = own.select(F.concat(F.lit("symbol:"), "id").alias("stable_key"), F.lit("SYMBOL").alias("kind"), F.col("id").alias("source_id"), "file_id", line.alias("content"), F.lit(768).alias("most"))
    # a file's lines in order, up to the first beyond its budget: what stands later would be cut in any case
    own_file = Window.partitionBy("file_id").orderBy("line")
    lines_of = own.filter("file_id IS NOT NULL").select("file_id", line.alias("line")).withColumn("k", F.row_number().over(own_file)).filter(F.col("k") <= 4 * 2048)  # a line has a byte at least, and so has its end
    before = F.sum(F.octet_length("line") + 1).over(own_file.rowsBetween(Window.unboundedPreceding, -1))
    lines_of = lines_of.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") <= 4 * 2048)
    listed = lines_of.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("content"))
    whole = listed.select(F.concat(F.lit("file:"), "file_id").alias("stable_key"), F.lit("FILE").alias("kind"), F.col("file_id").alias("source_id"), "file_id", "content", F.lit(2048).alias("most"))
    placed = own.filter("file_id IS NOT NULL AND start_line IS NOT NULL").select("id", "file_id", "start_line", F.coalesce("end_line", "start_line").alias("end_line"), line.alias("content"))
    if lines is None:
        chunks = placed.withColumn("source", F.lit(None).cast("string"))
    else:
        near = covered_lines(placed, lines, 2, 768).join(placed.select("id", "start_line", "end_line"), "id")
        cut = excerpt_of(F.col("covered"), F.col("start_line") - F.col("first") + 1, F.col("end_line") - F.col("first") + 1, 2, 768)
        chunks = placed.join(near.select("id", cut.alias("source")), "id", "left")
    chunk = F.when(F.col("source").rlike(r"\S"), F.col("source")).otherwise(F.col("content"))
    chunks = chunks.select(F.concat_ws(":", F.lit("chunk"), "id", "start_line", "end_line").alias("stable_key"), F.lit("CHUNK").alias("kind"), F.col("id").alias("source_id"), "file_id", chunk.alias("content"), F.lit(768).alias("most"))
    return single.unionByName(chunks).unionByName(whole).withColumn("content", truncated("content", "most")).drop("most").withColumn("tokens", token_estimate("content")).withColumn("checksum", F.sha2("content", 256))


def rank_rows(scored: DataFrame, query: str = "query_id", key: str = "key", most: int = MAX_RESULTS) -> DataFrame:
    """The result list of each query: its first rows by score, then key, most of them at most, ranked from 1. The rank filter cuts in each task before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key))).filter(F.col("rank") <= most)
