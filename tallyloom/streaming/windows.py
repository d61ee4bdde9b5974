"""Windows over event time, the same for batches and streams, and incremental ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

C = F.col


def with_time(events: DataFrame, time: str = "ts", late: str | None = None) -> DataFrame:
    """`at` as a timestamp with time zone, which watermarks need; `late` sets the watermark of a stream."""
    df = events.withColumn("at", C(time).cast("timestamp"))
    return df.withWatermark("at", late) if late else df


def tumbling(events: DataFrame, every: str, *by: str, slide: str | None = None) -> DataFrame:
    w = F.window("at", every, slide) if slide else F.window("at", every)
    return events.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(C("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, *by: str) -> DataFrame:
    """Runs of events of a key with less than `gap` between neighbours."""
    return events.groupBy(F.session_window("at", gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(C("w.start").alias("session_start"), C("w.end").alias("session_end"), *by, "n")


def joined(left: DataFrame, right: DataFrame, key: str, within: str, late: str = "1 hour") -> DataFrame:
    """Events of two streams (key, at, ...) with one key whose times lie at most `within` apart: key, left_at, right_at and the other columns.

    Both watermarks and the bound on the times let Spark drop rows that can't
    meet any more, so the state stays bounded.
    """
    l = left.withWatermark("at", late).withColumnRenamed("at", "left_at").withColumnRenamed(key, "_l")
    r = right.withWatermark("at", late).withColumnRenamed("at", "right_at").withColumnRenamed(key, "_r")
    near = (C("_l") == C("_r")) & (C("right_at") >= C("left_at") - F.expr(f"INTERVAL {within}")) & (C("right_at") <= C("left_at") + F.expr(f"INTERVAL {within}"))
    return l.join(r, near).withColumnRenamed("_l", key).drop("_r")


def ingest(spark: SparkSession, source: str, schema: str, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Reads the Parquet files that are new since the last run and hands them on in batches, each once."""
    return spark.readStream.schema(schema).parquet(source).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
