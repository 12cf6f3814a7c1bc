"""Upkeep of record tables: counts with zeros, ordered picks, deltas, marks, and picks by related rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_with_zeros(df: DataFrame, group: Sequence[str], status: str, statuses: Sequence[str]) -> DataFrame:
    """`group` columns and a count per status, 0 where there is none; other statuses and null aren't counted."""
    return df.groupBy(*group).agg(*(F.count_if(F.col(status) == s).alias(f"n_{s}") for s in statuses))


def earliest(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows in a total order: each task keeps n, so the last one sees n per task."""
    return df.orderBy(*order).limit(n)


def changes(df: DataFrame, group: Sequence[str], order: str, value: str) -> DataFrame:
    """df with `change` to the group's previous row (null for the first) and `share_of_first`, the value by that of the first row (null if that is 0)."""
    w = Window.partitionBy(*group).orderBy(order)
    first = F.first(value).over(w)
    return df.withColumns({"change": F.col(value) - F.lag(value).over(w), "share_of_first": F.when(first != 0, F.col(value) / first)})


def mark_deleted(df: DataFrame, which: Column, at: Column, note: Column) -> DataFrame:
    """df with `deleted_at` and `note` set on the rows for which `which` holds, unless they are marked already; a null note leaves the old one."""
    hit = F.coalesce(which, F.lit(False)) & F.col("deleted_at").isNull()
    return df.withColumns({"note": F.when(hit, F.coalesce(note, F.col("note"))).otherwise(F.col("note")), "deleted_at": F.when(hit, at).otherwise(F.col("deleted_at"))})


def related(df: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with `related`: whether a row of `others` has the same keys. Null keys are related to none."""
    there = others.select(*keys).dropna().distinct().withColumn("_there", F.lit(True))
    return df.join(there, list(keys), "left").withColumn("related", F.coalesce("_there", F.lit(False))).drop("_there")


def only_new(df: DataFrame, tables: Sequence[DataFrame], keys: Sequence[str]) -> list[DataFrame]:
    """For each table the rows of df, one per key, that it hasn't: what to append so that every key is in every table once. Rows with a null key are left out."""
    one = df.dropna(subset=list(keys)).dropDuplicates(list(keys))
    return [one.join(t.select(*keys).distinct(), list(keys), "left_anti") for t in tables]
