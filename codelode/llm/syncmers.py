"""Document fingerprints from closed syncmers of tokens, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, own_names, table

#: Tokens of a k-mer and of the inner substrings compared in it: a quarter of all k-mers are closed syncmers.
K, S = 9, 2
#: A token: up to 16 letters, digits or marks, or up to 16 other characters that aren't white space.
TOKEN = r"[\p{L}\p{N}\p{M}]{1,16}|[^\p{L}\p{N}\p{M}\s]{1,16}"
#: Rows of a bucket of neighbouring ids, and the most buckets: their heads (28 bytes each) are broadcast. Beyond 64 million rows buckets hold more rows, which their tasks sort on disk.
BUCKET_ROWS, MAX_BUCKETS = 64, 1 << 20
QUANTILES = 64


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The closed syncmers of a text in their order: 32-bit hashes of those k-mers of tokens whose smallest s-mer stands first or last in them.

    Whether a k-mer is chosen depends on its own tokens alone, so an edit changes only anchors within k tokens of it. Of any k - s k-mers in
    a row at least one is chosen. A text too short for that may have none: of k tokens or more, it gets as its one anchor the first k-mer
    that has the text's smallest s-mer; of fewer, the hash of all its tokens. Only a text without tokens (null, empty, white space) has no
    anchors. Equal texts have equal anchors."""
    window = k - s + 1

    def of(tokens: Column) -> Column:
        n = F.size(tokens)
        inner = F.transform(F.sequence(F.lit(1), n - (s - 1)), lambda i: F.xxhash64(*[F.element_at(tokens, (i + j).cast("int")) for j in range(s)]))

        def chosen(mers: Column) -> Column:
            edge = lambda i: let(F.array_min(F.slice(mers, i, window)), lambda least: (least == F.element_at(mers, i.cast("int"))) | (least == F.element_at(mers, (i + (window - 1)).cast("int"))))
            first = lambda: F.greatest(F.array_position(mers, F.array_min(mers)).cast("int") - (window - 1), F.lit(1))
            some = lambda starts: F.when(F.size(starts) > 0, starts).otherwise(F.array(first()))
            starts = let(F.filter(F.sequence(F.lit(1), n - (k - 1)), edge), some)
            return F.transform(starts, lambda i: F.shiftright(F.xxhash64(F.slice(tokens, i, k)), 32).cast("int"))

        return F.when(n == 0, F.array().cast("array<int>")).when(n < k, F.array(F.shiftright(F.xxhash64(tokens), 32).cast("int"))).otherwise(let(inner, chosen))

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def fingerprint(found: Column) -> Column:
    """Anchors as text: 8 hexadecimal digits each, in the document's order."""
    return F.array_join(F.transform(found, lambda a: F.lpad(F.hex(a.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two anchor sets, 0 to 1; 1 for two without anchors."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def with_next(df: DataFrame, add: dict[str, Column], lead: list[str]) -> DataFrame:
    """df, add's columns, and for each of lead a column next_<name> of the row that follows by descending doc_id (null ids last); the first follows the last.

    The texts move once: ids are cut into buckets of neighbours by quantiles (and evenly within), and the head of each bucket, a row of a
    table of at most MAX_BUCKETS, is also sent to the bucket above as the one that follows its last row. Rows of equal doc_id are ordered by
    a hash of lead's columns; those without an id, and of an id that falls on a quantile, are cut into buckets by that hash, so such rows are
    no bucket of their own unless they are equal in all of these columns. A single row follows itself. Columns of df called _bucket, _hash,
    _head, _least, _above, _to or _ghost are left out."""
    df = own_names(df, "_bucket", "_hash", "_head", "_least", "_above", "_to", "_ghost")
    order_by = F.xxhash64(*[c for c in lead if c in df.columns])
    bounds, rows = df.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / QUANTILES) for i in range(QUANTILES + 1)]), F.lit(10_000)), F.count("*")).first()  # QUANTILES + 1 ids
    cuts = sorted(set(bounds or [0]))
    steps = max(1, min(MAX_BUCKETS // (2 * len(cuts) + 1), -(-rows // (BUCKET_ROWS * len(cuts)))))
    known = F.array(*[F.lit(x).cast("bigint") for x in cuts])
    doc_id = F.col("doc_id")

    def among(share: Column) -> Column:
        return F.least(F.greatest(F.floor(share * steps), F.lit(0)), F.lit(steps - 1)).cast("int")

    def by_hash() -> Column:  # a greater hash follows later, so it is below
        return among(F.lit(0.5) - F.col("_hash").cast("double") / F.lit(2.0**64))

    def place(i: Column) -> Column:
        low, high = F.element_at(known, F.greatest(i, F.lit(1))), F.element_at(known, F.least(i + 1, F.lit(len(cuts))))
        share = (doc_id.cast("double") - low.cast("double")) / F.greatest(high.cast("double") - low.cast("double"), F.lit(1.0))
        return F.when((i > 0) & (doc_id == low), (2 * i - 1) * steps + by_hash()).otherwise(2 * i * steps + among(share))

    # ranges from below: null ids, then those at each cut and those between it and the next
    cut = F.array_contains(known, doc_id)
    hashed = df.withColumn("_hash", F.when(doc_id.isNull() | cut, order_by).otherwise(F.lit(0)))
    bucket = F.when(doc_id.isNull(), by_hash() - steps).otherwise(let(F.size(F.filter(known, lambda c: c <= doc_id)), place))
    placed = hashed.withColumn("_bucket", bucket.cast("int"))
    heads = placed.groupBy("_bucket").agg(F.max("doc_id").alias("_head"), F.min("_hash").alias("_least"))
    ordered = Window.orderBy("_bucket")  # over at most MAX_BUCKETS rows
    heads = heads.select("_bucket", "_head", "_least", F.coalesce(F.lead("_bucket").over(ordered), F.min("_bucket").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_above"))
    marked = placed.join(F.broadcast(heads), "_bucket").withColumn("_head", F.col("_head").eqNullSafe(doc_id) & (F.col("_hash") == F.col("_least")))
    here = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("ghost"))
    sent = marked.withColumn("_to", F.explode(F.when(F.col("_head"), F.array(here, F.struct(F.col("_above").alias("b"), F.lit(True).alias("ghost")))).otherwise(F.array(here))))
    near = sent.select(*df.columns, F.col("_to.b").alias("_bucket"), F.col("_to.ghost").alias("_ghost")).repartition("_bucket").withColumns(add)
    order = Window.partitionBy("_bucket").orderBy("_ghost", F.col("doc_id").desc_nulls_last(), order_by)
    return near.withColumns({f"next_{c}": F.lead(c).over(order) for c in lead}).filter(~F.col("_ghost")).drop("_bucket", "_ghost")


def op1(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of their edited texts. A null text counts as empty; rows of a repeated or null doc_id each keep their own row, ordered by a hash of their texts; very long texts are taken whole; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(docs, {"anchors": anchors(F.col("text"))}, ["text", "anchors"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = paired.withColumns({"n_chars": n.cast("bigint"), "edited": F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))})
    both = edited.withColumn("edited_anchors", anchors(F.col("edited")))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("anchors")).alias("fingerprint"), fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"), likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
