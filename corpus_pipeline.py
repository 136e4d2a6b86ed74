"""Documents to training tokens: toxic documents go, one of each group of near duplicates stays, sources are mixed to weights, what is left is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelode.llm import bpe, jaccard, mixing, toxicity
from codelode.llm.common import renamed, small_batches, stored, table, with_names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but for those scored toxic by a model fitted on the labels of these documents, from the threshold on.

    A null, empty or wordless text stays, and all rows do where the labels give the model no weights; very long texts are scored whole.
    Rows that repeat a doc_id or have none are each scored by their own text. An empty table gives no rows; all columns stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    df, at = renamed(docs)
    return with_names(toxicity.score(df, model, text=at["text"]).filter("predicted = 0"), at, {})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles, that with the smallest doc_id.

    Null, empty and wordless texts are like no other and stay, as do rows without a doc_id; of rows that repeat one the first by text stays.
    Very long texts are compared whole. An empty table gives no rows; all columns stay."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times or not at all, in the random order of its output shard.

    A null or empty text has no words: the mix takes it as often as its block. Rows equal in doc_id and text share their takes; a null
    source is a source of its own, a null doc_id a value like others. An empty table gives no rows; all columns stay. The order is that of
    the files' rows, a run of a shard in each file; no column holds it."""
    small_batches(spark)
    return mixing.mixed_in_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each row, those of a null or empty text without ids.

    Very long texts are encoded whole; rows that repeat a doc_id or have none are each encoded. An empty table gives no rows."""
    return bpe.encode(docs.select("doc_id", "text"), bpe.vocabulary("word_bpe_49k.json"), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("mixing", mix_sources), ("bpe", encode)]
#: SQL can express neither the fitted model nor the random mix; tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
