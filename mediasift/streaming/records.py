"""Streams of job records: good ones and rejected ones, and counts by event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mediasift.operators.records import parse_jobs


def split_sink(wire: DataFrame, folder: str) -> StreamingQuery:
    """Parses what is there by now into `folder`/good and `folder`/rejected, partitioned by micro-batch: one that is run again replaces its own files, so each row is there once."""

    def write(df: DataFrame, batch: int) -> None:
        parsed = parse_jobs(df).withColumn("sink", F.when(F.col("reject_reason").isNull(), "good").otherwise("rejected"))
        parsed.write.mode("overwrite").partitionBy("sink").parquet(f"{folder}/batch={batch}")

    return wire.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, event_time: str, group: list[str], length: str, delay: str, measures: dict[str, Column] | None = None, slide: str | None = None) -> DataFrame:
    """Rows per window of event time and group, with further aggregates by name. Final once the watermark (`delay` behind the newest row) has passed a window's end; later rows don't count. Rows without time are left out."""
    seen = stream.where(F.col(event_time).isNotNull()).withWatermark(event_time, delay)
    w = F.window(event_time, length, slide) if slide else F.window(event_time, length)
    extra = [c.alias(n) for n, c in (measures or {}).items()]
    out = seen.groupBy(w.alias("w"), *group).agg(F.count(F.lit(1)).alias("n"), *extra)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *group, "n", *(measures or {}))


def once(stream: DataFrame, keys: list[str], event_time: str, horizon: str) -> DataFrame:
    """The first row of each key within a horizon of event time: a marker that expires. A later row of the key within the horizon is suppressed; beyond it counts anew."""
    return stream.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(keys)
