"""Runtime observations: to which symbols they belong, and what they add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_CANDIDATES = 1000


def hits_of(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """ref_id and id of every symbol that a reference may mean: by its key, else its qualified name, else its file (and the line that a symbol spans)."""
    s = symbols.select("id", "symbol_key", "qualified_name", "file_id", "start_line", "end_line")
    by_key = references.filter("key IS NOT NULL").join(s, F.col("key") == F.col("symbol_key"))
    by_name = references.filter("key IS NULL AND name IS NOT NULL").join(s, F.col("name") == F.col("qualified_name"))
    inside = F.col("line").isNull() | ((F.col("start_line") <= F.col("line")) & (F.col("end_line") >= F.col("line")))
    by_file = references.filter("key IS NULL AND name IS NULL").join(s, (F.col("file") == F.col("file_id")) & inside)
    return by_key.select("ref_id", "id").union(by_name.select("ref_id", "id")).union(by_file.select("ref_id", "id"))


def _spans(symbols: DataFrame) -> DataFrame:
    """For each file its lines where the number of symbols that span them changes: from that line on so many (n), whose ids sum to ids and of which the least is unknown.

    Each symbol adds one at its first line and takes one behind its last; running sums over a file's change points, of which a file has at most two for each line."""
    ends = F.array(F.struct(F.col("start_line").cast("long").alias("line"), F.lit(1).alias("d")), F.struct((F.col("end_line") + 1).cast("long").alias("line"), F.lit(-1).alias("d")))
    points = symbols.filter("start_line IS NOT NULL AND end_line >= start_line").select("file_id", "id", F.inline(ends))
    # the sums of hashed ids tell which symbol is the only one
    mark = F.xxhash64("id").cast("decimal(38,0)")
    changed = points.groupBy("file_id", "line").agg(F.sum("d").alias("d"), F.sum(mark * F.col("d")).alias("m"))
    so_far = Window.partitionBy("file_id").orderBy("line")
    return changed.select("file_id", "line", F.sum("d").over(so_far).alias("n"), F.sum("m").over(so_far).alias("marks"), F.coalesce(F.lead("line").over(so_far), F.lit(2**62)).alias("until"))


def resolve(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """references (ref_id, key, name, file, line) with status, symbol_id and candidates.

    A key decides, else a qualified name, else the file (and the line that a symbol spans). One symbol is RESOLVED, none UNRESOLVED,
    several AMBIGUOUS. Symbols are reduced to a count and a least id per key, name or file before references meet them, so a name that very
    many symbols share costs one row a reference; for lines, a file's spans are reduced to the lines where their number changes."""
    kind = F.when(F.col("key").isNotNull(), "key").when(F.col("name").isNotNull(), "name").when(F.col("line").isNull(), "file").otherwise("line")
    asked = references.withColumn("kind_", kind).withColumn("value_", F.coalesce("key", "name", "file"))
    per = lambda c, k: symbols.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("value_")).agg(F.count("*").alias("n_"), F.min("id").alias("first_")).withColumn("kind_", F.lit(k))
    whole = per("symbol_key", "key").unionByName(per("qualified_name", "name")).unionByName(per("file_id", "file"))
    plain = asked.filter("kind_ <> 'line' OR kind_ IS NULL").join(whole, ["kind_", "value_"], "left").select(*references.columns, "n_", "first_")
    lines = asked.filter("kind_ = 'line'").select(*references.columns)
    # a reference at a line and the change points of its file, ordered together: the last point before it holds
    spans = _spans(symbols)
    points = spans.select("file_id", F.col("line").alias("at"), F.lit(0).alias("side"), "n", "marks").withColumn("ref_id", F.lit(None).cast(dict(references.dtypes)["ref_id"]))
    places = lines.select(F.col("file").alias("file_id"), F.col("line").cast("long").alias("at")).distinct().withColumns({"side": F.lit(1), "n": F.lit(None).cast("long"), "marks": F.lit(None).cast("decimal(38,0)")})
    both = points.drop("ref_id").unionByName(places.select("file_id", "at", "side", F.col("n"), F.col("marks")))
    before = Window.partitionBy("file_id").orderBy("at", "side")
    held = both.withColumns({"n": F.last("n", ignorenulls=True).over(before), "marks": F.last("marks", ignorenulls=True).over(before)}).filter("side = 1").select(F.col("file_id").alias("file"), F.col("at").alias("line"), "n", "marks")
    ids = symbols.select(F.col("file_id").alias("file"), F.xxhash64("id").cast("decimal(38,0)").alias("marks"), "id")
    single = held.filter("n = 1").join(ids, ["file", "marks"]).groupBy("file", "line").agg(F.min("id").alias("first_"))
    counted = held.join(single, ["file", "line"], "left").select(F.col("file"), F.col("line").cast("int").alias("line"), F.col("n").alias("n_"), "first_")
    met = lines.join(counted, ["file", "line"], "left").select(*references.columns, "n_", "first_")
    found = plain.unionByName(met).withColumn("n_", F.coalesce("n_", F.lit(0)))
    status = F.when(F.col("n_") == 0, "UNRESOLVED").when(F.col("n_") == 1, "RESOLVED").otherwise("AMBIGUOUS")
    return found.select(*references.columns, status.alias("status"), F.when(F.col("n_") == 1, F.col("first_")).alias("symbol_id"), F.col("n_").alias("candidates"))


def _first_hits(references: DataFrame, symbols: DataFrame, least: int) -> DataFrame:
    """ref_id, id and k of the first MAX_CANDIDATES hits of references with least hits or more. What references ask for is looked up and cut once, however many ask it, and joined to them then."""
    by_key, by_name = F.col("key").isNotNull(), F.col("key").isNull() & F.col("name").isNotNull()
    place = [F.when(~by_key & ~by_name, F.col(c)).alias(c) for c in ("file", "line")]
    asking = references.select("ref_id", "key", F.when(by_name, F.col("name")).alias("name"), *place).withColumn("asked", F.to_json(F.struct("key", "name", "file", "line")))
    own = Window.partitionBy("ref_id")
    asked = asking.select(F.col("asked").alias("ref_id"), "key", "name", "file", "line").distinct()
    ranked = hits_of(asked, symbols).select("ref_id", "id", F.row_number().over(own.orderBy("id")).cast("int").alias("k"), F.count("*").over(own).alias("n"))
    first = ranked.filter((F.col("n") >= least) & (F.col("k") <= MAX_CANDIDATES)).select(F.col("ref_id").alias("asked"), "id", "k")
    return asking.select("ref_id", "asked").join(first, "asked").select("ref_id", "id", "k")


def candidate_ids(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """The ids of ambiguous references (ref_id, unique) of every kind, first ids first, at most MAX_CANDIDATES each. A reference with a single hit is resolved and has none."""
    return _first_hits(references, symbols, 2)


def named_ids(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """The ids of the symbols that references (ref_id, unique) by qualified name alone may mean, one or more, first ids first, at most MAX_CANDIDATES each."""
    return _first_hits(references.filter("key IS NULL AND name IS NOT NULL"), symbols, 1)


def display(key: str, name: str, file: str, line: str):
    """How a reference is shown: its key, else its name, else file and line."""
    return F.coalesce(key, name, F.concat(F.col(file), F.coalesce(F.concat(F.lit(":"), F.col(line).cast("string")), F.lit(""))))


def sources(observations: DataFrame) -> DataFrame:
    return observations.select(F.concat(F.lit("s"), F.col("observation_id").cast("string")).alias("ref_id"), F.col("source_key").alias("key"), F.col("source_name").alias("name"), F.col("source_file").alias("file"), F.col("source_line").alias("line"))


def targets(observations: DataFrame) -> DataFrame:
    text = F.lit(None).cast("string")
    return observations.filter("target_key IS NOT NULL").select(F.concat(F.lit("t"), F.col("observation_id").cast("string")).alias("ref_id"), F.col("target_key").alias("key"), text.alias("name"), text.alias("file"), F.lit(None).cast("int").alias("line"))


def active_sessions(sessions: DataFrame, active: str, session: str | None = None) -> DataFrame:
    """Sessions of the active snapshot; one asked for by name must be among them."""
    found = sessions.filter(F.col("snapshot_id") == active)
    if session is not None:
        found = found.filter(F.col("session_id") == session)
        if found.isEmpty():
            raise LookupError(f"session {session} isn't of the active snapshot")
    return found


def correlated(observations: DataFrame, symbols: DataFrame) -> DataFrame:
    """observations with both ends resolved: source_symbol, source_status, target_symbol, target_status."""
    at = lambda refs, end: resolve(refs, symbols).select(F.substring("ref_id", 2, 30).cast("long").alias("observation_id"), F.col("symbol_id").alias(f"{end}_symbol"), F.col("status").alias(f"{end}_status"))
    return observations.join(at(sources(observations), "source"), "observation_id").join(at(targets(observations), "target"), "observation_id", "left")


def report(both: DataFrame, symbols: DataFrame) -> DataFrame:
    """Sums of hits and nanoseconds (an overflow is an error), symbols seen, lines covered, and the share of all symbols."""
    seen = both.select(F.explode(F.array_compact(F.array("source_symbol", "target_symbol"))).alias("s")).agg(F.countDistinct("s").alias("observed_symbols"))
    line = F.when(F.col("type") == "LINE_COVERAGE", F.concat(F.coalesce("source_file", F.lit("null")), F.lit(":"), F.coalesce(F.col("source_line").cast("string"), F.lit("null"))))
    sums = both.agg(F.sum("hits").alias("total_hits"), F.sum("nanos").alias("total_nanos"), F.countDistinct(line).alias("covered_lines"))
    every = symbols.agg(F.count("*").alias("symbols"))
    one = sums.crossJoin(seen).crossJoin(every)  # one row each
    return one.withColumn("ratio", F.when(F.col("symbols") > 0, F.col("observed_symbols") / F.col("symbols")).otherwise(0.0))


def hot_paths(both: DataFrame, limit: int = 100) -> DataFrame:
    """What took longest: symbols (or references as shown), most nanoseconds, then hits, then key."""
    key = F.coalesce("source_symbol", display("source_key", "source_name", "source_file", "source_line"))
    return both.groupBy(key.alias("key")).agg(F.sum("hits").alias("hits"), F.sum("nanos").alias("nanos")).orderBy(F.desc("nanos"), F.desc("hits"), "key").limit(limit)


def observed_calls(both: DataFrame, limit: int = 100) -> DataFrame:
    shown = [display("source_key", "source_name", "source_file", "source_line").alias("source"), F.col("target_key").alias("target")]
    return both.filter("type = 'CALL'").groupBy(*shown).agg(F.sum("hits").alias("hits"), F.sum("nanos").alias("nanos")).orderBy(F.desc("nanos"), F.desc("hits"), "source", "target").limit(limit)


def symbol_report(both: DataFrame) -> DataFrame:
    """Per symbol: execution hits and time, hits on its lines, calls out of it and into it."""
    on = lambda t, c: F.sum(F.when(F.col("type") == t, F.col(c)).otherwise(0))
    out = both.filter("source_symbol IS NOT NULL").groupBy(F.col("source_symbol").alias("symbol_id")).agg(on("SYMBOL_EXECUTION", "hits").alias("execution_hits"), on("SYMBOL_EXECUTION", "nanos").alias("execution_nanos"), on("LINE_COVERAGE", "hits").alias("line_hits"), on("CALL", "hits").alias("outgoing_calls"))
    into = both.filter("target_symbol IS NOT NULL").groupBy(F.col("target_symbol").alias("symbol_id")).agg(on("CALL", "hits").alias("incoming_calls"))
    return out.join(into, "symbol_id", "full_outer").na.fill(0)


def correlation_counts(both: DataFrame) -> DataFrame:
    ends = both.select(F.explode(F.array_compact(F.array("source_status", "target_status"))).alias("status"))
    return ends.groupBy("status").agg(F.count("*").alias("references"))


def list_sessions(sessions: DataFrame, both: DataFrame, active: str, limit: int = 128) -> DataFrame:
    sums = both.groupBy("session_id").agg(F.count("*").alias("observations"), F.count_if(F.expr("source_status = 'RESOLVED'")).alias("resolved"))
    return sessions.join(sums, "session_id", "left").na.fill(0).withColumn("aligned", F.col("snapshot_id") == active).orderBy("session_id").limit(limit)
