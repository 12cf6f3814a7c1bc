"""Token sets of titles and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Distinct runs of three or more ASCII letters and digits, in lower case; empty for null."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)"), 1), lambda t: F.length(t) >= 3))


def jaccard(a: Column, b: Column) -> Column:
    """Shared tokens among all; 0 if a side is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(target: Column, text: Column) -> Column:
    """Share of the target's tokens that the text has; 0 if the target has none."""
    return F.when(F.size(target) == 0, 0.0).otherwise(F.size(F.array_intersect(target, text)) / F.size(target))


def score_class(score: Column, low: float, high: float) -> Column:
    """matched from the high bound on, unmatched up to the low one, else uncertain; a high bound below the low one is raised to it."""
    return F.when(score >= max(high, low), "matched").when(score <= low, "no_match").otherwise("uncertain")
