"""Per-key results over a join whose keys are few and heavy.

Both inputs are reduced to one compact state per join key and output group before they meet, so the number of rows that
are shuffled is bounded by distinct keys (times map tasks), never by the rows of the heaviest key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.session import cut


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    group: Sequence[str],
    left_sums: Mapping[str, Column] | None = None,
    right_sums: Mapping[str, Column] | None = None,
    how: str = "inner",
) -> DataFrame:
    """`SELECT group, count(*) AS n_rows, count(*) of either side, sums FROM left JOIN right USING (on) GROUP BY group`.

    `group` names columns of `left`. A joined row pairs each left row with each right row of its key, so of a pair of
    states the row count is the product of their counts, and a sum of one side is scaled by the other side's count.

    Columns: the group, `n_left` (left rows, each once), `n_rows` (joined rows), and one column per named sum.

    Null join keys never match (as in SQL); with how="left" unmatched left rows stay, with `n_rows` 0 and null right
    sums. A null in a group column is a group of its own. A sum skips nulls, and is null if nothing else is there.
    Tied or repeated rows count as often as they occur. Empty inputs give an empty result.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    left_sums, right_sums = dict(left_sums or {}), dict(right_sums or {})
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(on)]
    groups = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]
    k, g = [f"_k{i}" for i in range(len(on))], [f"_g{i}" for i in range(len(group))]
    ls = [f"_l{i}" for i in range(len(left_sums))]
    rs = [f"_r{i}" for i in range(len(right_sums))]
    compact = (
        left.select(*keys, *groups, *(v.alias(n) for n, v in zip(ls, left_sums.values())))
        .groupBy(*k, *g)
        .agg(F.count(F.lit(1)).alias("_nl"), *(F.sum(n).alias(n) for n in ls))
    )
    other = (
        right.select(*keys, *(v.alias(n) for n, v in zip(rs, right_sums.values())))
        .dropna(subset=k)
        .groupBy(*k)
        .agg(F.count(F.lit(1)).alias("_nr"), *(F.sum(n).alias(n) for n in rs))
    )
    joined = compact.join(other, k, how).withColumn("_nr", F.coalesce("_nr", F.lit(0)))
    return joined.groupBy(*g).agg(
        F.sum("_nl").alias("n_left"),
        # of heavy keys the product leaves 64 bits; a sum beyond them is an error, not a wrong number
        F.sum(F.col("_nl").cast("decimal(19,0)") * F.col("_nr").cast("decimal(19,0)")).cast("long").alias("n_rows"),
        *(F.sum(F.col(n) * F.col("_nr")).alias(name) for n, name in zip(ls, left_sums)),
        *(F.sum(F.col(n) * F.col("_nl")).alias(name) for n, name in zip(rs, right_sums)),
    ).withColumnsRenamed(dict(zip(g, group)))


def key_values(df: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """One row (`key_field`, `key_value`) per field with a value; a row of df gives as many as it has values."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("key_field"), v.alias("key_value")) for n, v in fields.items())))
    return df.select(each.alias("_e")).select("_e.*").where(F.col("key_value").isNotNull())


def heavy_keys(df: DataFrame, fields: Mapping[str, Column], share: float) -> DataFrame:
    """The values that hold at least `share` of all rows of df: `key_field`, `key_value`, `n_left` (its rows), `n_all`.

    The share is of all rows, with or without a value. One pass: each row counts once per field, a missing value too, so the counts of a field add up to
    the table. These compact states, one per value, meet the total of their field (as many rows as fields); rows themselves never meet. Empty input
    gives an empty result.
    """
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("key_field"), v.alias("key_value")) for n, v in fields.items())))
    # cut, as it is read twice: one row per value
    counts = cut(df.select(each.alias("_e")).select("_e.*").groupBy("key_field", "key_value").agg(F.count(F.lit(1)).alias("n_left")))
    # as many rows as fields are named: a bounded side
    totals = counts.groupBy("key_field").agg(F.sum("n_left").alias("n_all"))
    limit = F.lit(str(share)).cast("decimal(9,6)")
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    return counts.where("key_value IS NOT NULL").join(F.broadcast(totals), "key_field").where(exact("n_left") >= limit * exact("n_all")).select("key_field", "key_value", "n_left", "n_all")


def blank_to_null(c: Column) -> Column:
    """Without surrounding white space; null if nothing is left."""
    t = F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")
    return F.when(t != "", t)


def domain(c: Column) -> Column:
    """A host without surrounding blanks and closing dots, in lower case; null if nothing is left."""
    t = F.regexp_replace(F.lower(blank_to_null(c)), r"[\s.]+$", "")
    return F.when(t != "", t)


def filled(c: Column) -> Column:
    """The value as written; null if it is blank."""
    return F.when(blank_to_null(c).isNotNull(), c)
