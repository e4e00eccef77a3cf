"""Streams: rows taken into a text index as they arrive, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillon.operators import text
from quillon.runtime import stage


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, ts: str, keys: Sequence[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, keys, n, total): counts and sums of ``value`` per tumbling window; rows later than ``late`` are dropped."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    grouped = marked.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(key, session_start, session_end, n): runs of events no further apart than ``gap``."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    grouped = marked.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def ingest(documents: DataFrame, id_col: str, fields: Sequence[str], counts_path: str, checkpoint: str, analyzer: str = "simple", language: str = "spanish") -> StreamingQuery:
    """Append the term counts of arriving documents to a table; the batch number makes a repeated batch replace itself."""

    def take(batch: DataFrame, number: int) -> None:
        counts = text.term_counts(text.tokens(batch, id_col, fields, analyzer, language))
        counts.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(counts_path)

    return documents.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_of(spark: SparkSession, counts_path: str, fields: Sequence[str], analyzer: str = "simple", language: str = "spanish") -> text.TextIndex:
    """The index over all counts taken in so far, staged. Of a document that arrived more than once the latest batch counts."""
    counts = spark.read.parquet(counts_path)
    latest = counts.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return text.index_counts(stage(counts.join(latest, ["doc_id", "batch"]).drop("batch"), "counts"), fields, analyzer, language)
