import math
import random

import pytest
from pyspark.sql import functions as F

from mediasift.llm.percentiles import epoch_seconds, merge, percentiles, value_counts


def test_percentiles_of_skewed_groups_merge(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, float("nan"), float("inf"), *[round(rng.expovariate(0.1), 3) for _ in range(8)]])) for _ in range(3000)]
    rows += [("one", 5.0), ("same", 1.0)] + [("same", 1.0)] * 50
    df = spark.createDataFrame(rows, "w string, v double").withColumns({"q": F.lit("clash"), "n": F.lit(1)})
    whole = value_counts(df, ["w"], F.col("v"), 1e-3)
    parts = [value_counts(df.where(F.pmod(F.hash("v"), F.lit(3)) == i), ["w"], F.col("v"), 1e-3) for i in range(3)]
    pcts = [0, 1, 50, 90, 99, 100]
    want = {}
    for w in {r[0] for r in rows} - {None}:
        v = sorted(x for g, x in rows if g == w and x is not None and math.isfinite(x))
        for p in pcts:
            want[w, p] = v[max(1, math.ceil(len(v) * p / 100)) - 1]
    for state in (whole, merge(parts, ["w"])):
        got = {(r["w"], r["pct"]): r["value"] for r in percentiles(state, ["w"], pcts, 1e-3).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) <= 5e-4 + 1e-9 for k in want)


def test_edges(spark):
    df = spark.createDataFrame([], "w string, v double")
    state = value_counts(df, ["w"], F.col("v"))
    assert percentiles(state, ["w"], [50]).count() == 0 and percentiles(state, ["w"], []).count() == 0
    with pytest.raises(ValueError):
        percentiles(state, ["w"], [101])
    rows = spark.createDataFrame([(1.7e9,), (1.7e12,), (None,)], "t double")
    assert [r[0] for r in rows.select(epoch_seconds(F.col("t"))).collect()] == [1.7e9, 1.7e9, None]
