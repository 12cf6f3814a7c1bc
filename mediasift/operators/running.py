"""Running totals over a whole table in a given order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediasift.session import cut, width


def running_totals(df: DataFrame, order: Sequence[str], value: str) -> DataFrame:
    """df with `rank` (from 1), `n_rows`, `sum_before` (of earlier rows) and `sum_all`. `order` must tell all rows apart; nulls come first and count as 0 in sums.

    Rows are sorted by range; each partition sums its own, and starts from the sums of the earlier ones (one row a partition).
    """
    n = width(df.sparkSession)
    ranged = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    v = F.coalesce(F.col(value), F.lit(0))
    sums = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(v).alias("_s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    offsets = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"), F.sum("_n").over(whole).alias("n_rows"), F.sum("_s").over(whole).alias("sum_all"))
    own = Window.partitionBy("_part").orderBy(*order)
    out = ranged.withColumn("_r", F.row_number().over(own)).withColumn("_b", F.sum(v).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - v)
    # as many offsets as partitions: a bounded side
    return out.join(F.broadcast(offsets), "_part").withColumns({"rank": (F.col("_n0") + F.col("_r")).cast("long"), "sum_before": F.col("_s0") + F.col("_b")}).drop("_part", "_r", "_b", "_n0", "_s0")


def retention(df: DataFrame, order: Sequence[str], size: str, max_rows: int, max_size: float) -> DataFrame:
    """df with `drop`: whether a row must go so that at most `max_rows` rows of together at most `max_size` are left, oldest first. A limit of 0 or less leaves nothing."""
    t = running_totals(df, order, size)
    rows_left, size_left = F.col("n_rows") - F.col("rank") + 1, F.col("sum_all") - F.col("sum_before")
    return t.withColumn("drop", (rows_left > max(0, max_rows)) | (size_left > max(0, max_size))).drop("rank", "n_rows", "sum_before", "sum_all")
