"""Percentiles per group by cumulative frequencies.

State: how often each group has each value, values being rounded to a resolution. States of partitions, batches or days
add up, so they merge by summing counts, and the error of any percentile is at most half the resolution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediasift.session import cut, width


def value_counts(df: DataFrame, group: Sequence[str], value: Column, resolution: float = 1e-6) -> DataFrame:
    """The mergeable state: the group's columns, `q` (value in units of the resolution) and `n`.

    Rows with a null in the group, and values that are null, NaN or infinite, don't count.
    """
    v = value.cast("double")
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(9e18 * resolution))
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]
    names = [f"_g{i}" for i in range(len(group))]
    q = F.round(v / F.lit(resolution)).cast("long").alias("q")
    return (
        df.where(usable).select(*keys, q).dropna(subset=names).groupBy(*names, "q").agg(F.count(F.lit(1)).alias("n")).withColumnsRenamed(dict(zip(names, group)))
    )


def merge(states: Sequence[DataFrame], group: Sequence[str]) -> DataFrame:
    """One state of several, in any order."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    return both.groupBy(*group, "q").agg(F.sum("n").alias("n"))


def percentiles(state: DataFrame, group: Sequence[str], pcts: Sequence[int], resolution: float = 1e-6) -> DataFrame:
    """For each group and each of `pcts` the smallest value that at least pct percent of the group's values don't exceed:
    the group's columns, `pct`, `value`, `n_values`.

    The counts are sorted by range over group and value, so that a group of any size lies in as many partitions as it
    needs; window sums run within a partition's part of a group, and start at the sum of the group's earlier parts.
    A group without values gives no row; pct 0 gives the smallest value. An empty state gives an empty result.
    """
    if any(not 0 <= p <= 100 for p in pcts):
        raise ValueError("percentiles lie from 0 to 100")
    spark = state.sparkSession
    ranged = state.repartitionByRange(width(spark), *group, "q").withColumn("_part", F.spark_partition_id())
    # the cut fixes which partition has which range: both uses below must see the same
    ranged = cut(ranged)
    parts = ranged.groupBy(*group, "_part").agg(F.sum("n").alias("_sum"))
    of_group = Window.partitionBy(*group)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *group, "_part",
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(of_group).alias("n_values"),
    )
    running = Window.partitionBy(*group, "_part").orderBy("q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.select(*group, "_part", "q", "n", F.sum("n").over(running).alias("_run")).join(offsets, [*group, "_part"])
    reached = F.col("_offset") + F.col("_run")
    target = lambda p: F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_values") * F.lit(p) / F.lit(100)).cast("long"))
    hit = lambda p: (reached >= target(p)) & (reached - F.col("n") < target(p))
    found = F.array_compact(F.array(*(F.when(hit(p), F.lit(p)) for p in pcts)))
    return (
        summed.select(*group, F.explode(found).alias("pct"), (F.col("q") * F.lit(resolution)).alias("value"), "n_values")
        if len(pcts)
        else summed.select(*group, F.lit(0).alias("pct"), F.lit(0.0).alias("value"), "n_values").limit(0)
    )


def epoch_seconds(c: Column) -> Column:
    """Seconds since the epoch, from seconds or milliseconds: no time of either kind is near 1e11."""
    return F.when(c >= 1e11, c / 1000).otherwise(c)
