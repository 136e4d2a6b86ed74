"""Runtime sessions as a stream: an extension, each session added once whatever is delivered again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.envelopes import OBSERVATIONS
from ..store import SessionLog


def session_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Observations, as JSON lines with the columns of a session file, that arrive in a folder; delivered_in is the file that each came in."""
    return spark.readStream.schema(OBSERVATIONS + ", source_sha256 string").json(folder).withColumn("delivered_in", F.col("_metadata.file_path"))


def one_delivery(batch: DataFrame) -> DataFrame:
    """The rows of each session of a batch from the first of the files that bring it: one delivered twice is there once."""
    keys = ["project_id", "session_id", "source_sha256"]
    first = batch.groupBy(*keys).agg(F.min("delivered_in").alias("delivered_in"))
    return batch.join(first, [*keys, "delivered_in"], "left_semi").drop("delivered_in")


def ingest(spark: SparkSession, folder: str, root: str, checkpoint: str, **bounds) -> StreamingQuery:
    """Append sessions from folder to the session log at root, as long as there are new files.

    A batch that is run again after a failure, or a file that is delivered again, finds its sessions in the log; a session with other
    content than the stored one, or beyond a project's bounds, stops the stream."""
    log = SessionLog(spark, root, **bounds)
    return session_stream(spark, folder).writeStream.foreachBatch(lambda batch, _: log.append(one_delivery(batch)) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hits_by_window(observations: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Hits and nanoseconds of each session and time window, by the sessions' start, with rows later than late left out."""
    timed = observations.withColumn("at", F.to_timestamp("started_at")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "session_id").agg(F.sum("hits").alias("hits"), F.sum("nanos").alias("nanos"))
