"""The N highest items of every group, by score histograms.

Per group, counts of distinct items per score bin give a bin at and above which at least N items lie. Rows below it are
dropped before any sort; only the rest is ranked exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediasift.session import cut

SALTS = 16


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int, low: float = 0.0, high: float = 1.0, bins: int = 256) -> DataFrame:
    """`group`, `item`, `score`, `pos`: for each group its n items with the highest scores, `pos` from 1.

    An item's score is its largest between `low` and `high`; values that are null, NaN or outside don't count, and an
    item without one isn't there. Of equal scores the smaller item (by bytes, if a text) comes first, so the order is
    total. Rows with a null group or item are left out; an empty text is a group or item like any other. A group with
    fewer items gives all it has, and empty input an empty result. Repeated rows are one item.

    Skew: a group's rows meet per item first, the histogram has at most `bins` + 1 rows a group, the filter joins on group
    and a salt, and ranking keeps n rows a group and task before it shuffles.
    """
    s = F.col(score).cast("double")
    # cut, as it is read twice: one row per group and item
    best = cut(
        df.select(F.col(group).alias("_g"), F.col(item).alias("_i"), s.alias("_s"))
        .where(F.col("_g").isNotNull() & F.col("_i").isNotNull() & F.col("_s").between(low, high))
        .groupBy("_g", "_i")
        .agg(F.max("_s").alias("_s"))
        .withColumn("_bin", F.floor((F.col("_s") - F.lit(low)) / F.lit((high - low) / bins)).cast("int"))
    )
    above = Window.partitionBy("_g").orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = (
        best.groupBy("_g", "_bin").agg(F.count(F.lit(1)).alias("_c"))
        .select("_g", "_bin", F.sum("_c").over(above).alias("_above"))
        .groupBy("_g")
        .agg(F.coalesce(F.max(F.when(F.col("_above") >= n, F.col("_bin"))), F.lit(-1)).alias("_least"))
        .select("_g", "_least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    )
    survivors = best.withColumn("_salt", F.pmod(F.xxhash64("_i"), F.lit(SALTS)).cast("int")).join(least, ["_g", "_salt"]).where("_bin >= _least")
    rank = Window.partitionBy("_g").orderBy(F.desc("_s"), "_i")
    ranked = survivors.withColumn("pos", F.row_number().over(rank)).where(F.col("pos") <= n)
    return ranked.select(F.col("_g").alias(group), F.col("_i").alias(item), F.col("_s").alias(score), "pos")
