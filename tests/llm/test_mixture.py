import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift.llm.mixture import _fill, mix, rake, too_few


def test_filling_under_caps():
    t, cap = np.array([10.0, 20.0, 70.0]), np.array([2.0, 2.0, 1.0])
    for goal in (1.0, 50.0, 100.0, 120.0, 130.0, 500.0):
        w = _fill(np.ones(3), t, cap, goal)
        assert (w <= cap + 1e-12).all() and abs((w * t).sum() - min(goal, (cap * t).sum())) < 1e-9
    assert (_fill(np.ones(2), np.zeros(2), np.ones(2), 5.0) == 1).all()


def test_raking_meets_sources_and_keeps_margins():
    cells = [(s, lang) for s in "abc" for lang in ("en", "de")]
    tokens = np.array([500.0, 100.0, 200.0, 100.0, 60.0, 40.0])
    r = rake(cells, tokens, {"a": 0.4, "b": 0.4, "c": 0.2}, {"a": 1, "b": 3, "c": 1})
    assert np.allclose(r.reached[:2], r.target[:2]) and r.reached[2] == 100 < r.target[2]
    lang = np.array([c[1] == "en" for c in cells])
    free = (r.weights * tokens)[lang].sum() / (r.weights * tokens).sum()
    assert abs(free - 760 / 1000) < 0.05
    assert rake([], np.array([]), {"a": 1.0}, {"a": 1}).reached.tolist() == [0.0]


def test_documents_by_weight(spark):
    rows = [(i, "big", "en", 10) for i in range(4000)] + [(10_000 + i, "small", "de", 10) for i in range(100)] + [(20_000, "unlisted", "en", 10), (20_001, None, None, 10), (20_002, "big", None, 0), (20_003, "small", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, size int").withColumns({"copies": F.lit("clash"), "tokens": F.lit("clash")})
    weights = spark.createDataFrame([("big", 0.5, 1), ("small", 0.1, 4), ("none", 0.4, 2), ("none", None, None), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mix(df, weights, "doc_id", F.col("source"), F.col("size"), {"language": F.col("lang")})
    got = {r["source"]: r for r in report.collect()}
    assert set(got) == {"big", "small", "none"}
    assert got["big"]["reachable"] and abs(got["big"]["mixed_tokens"] - 20_500) < 1500
    assert got["small"]["reachable"] is False and got["small"]["mixed_tokens"] == 4000
    assert got["none"]["tokens"] == 0 and not got["none"]["reachable"] and abs(sum(r["actual_share"] for r in got.values()) - 1) < 1e-9
    copies = {r["doc_id"]: r["copies"] for r in mixed.collect()}
    assert all(copies[10_000 + i] == 4 for i in range(100)) and not {20_000, 20_001, 20_002, 20_003} & set(copies) and max(copies.values()) == 4
    assert copies == {r["doc_id"]: r["copies"] for r in mix(df, weights, "doc_id", F.col("source"), F.col("size"), {"language": F.col("lang")})[0].collect()}
    empty, report = mix(df.limit(0), weights, "doc_id", F.col("source"), F.col("size"), {"language": F.col("lang")})
    assert empty.count() == 0 and report.count() == 3


def test_raking_in_spark_equals_that_by_the_driver(spark):
    rows = [(i, "ab"[i % 2], "other" if i % 90 == 89 else f"l{i % 90:02}", 100 - i % 90) for i in range(1800)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, size int")
    weights = spark.createDataFrame([("a", 0.7, 3), ("b", 0.3, 3)], "source string, target_share double, max_repeats int")
    moved = df.withColumn("source", F.when(F.col("doc_id") >= 900, F.when(F.col("source") == "a", "b").otherwise("a")).otherwise(F.col("source")))
    mixed, report = mix(moved, weights, "doc_id", F.col("source"), F.col("size"), {"language": F.col("lang")})
    wide, wide_report = mix(moved, weights, "doc_id", F.col("source"), F.col("size"), {"language": F.col("lang")}, most_cells=20)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, wide.collect()))
    for a, b in zip(*(sorted(map(tuple, r.collect())) for r in (report, wide_report))):
        assert all(x == y or abs(x - y) < 1e-6 * abs(x) for x, y in zip(a, b) if not isinstance(x, str))


def test_rare_levels_keep_their_own_margin(spark):
    # the rarest levels differ in their sources: as one pooled level each would get the pool's mix of weights
    rows, n = [], 0
    for level in range(80):
        for s, count in (("a", 12 if level % 2 else 2), ("b", 2 if level % 2 else 12)):
            for _ in range(count):
                rows.append((n, s, f"l{level:02}", 10 if level < 64 else 1))
                n += 1
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, size int")
    weights = spark.createDataFrame([("a", 0.7, 50), ("b", 0.3, 50)], "source string, target_share double, max_repeats int")
    for most in (10_000, 100):
        mixed, _ = mix(df, weights, "doc_id", F.col("source"), F.col("size") * 100, {"language": F.col("lang")}, most_cells=most)
        language = {r[0]: r[2] for r in rows}
        got = {}
        for r in mixed.collect():
            key = int(language[r["doc_id"]][1:]) % 2 if int(language[r["doc_id"]][1:]) >= 64 else None
            got[key] = got.get(key, 0) + r["tokens"] * r["copies"]
        # 8 rare levels of either kind, all of 1400 tokens
        assert abs(got[0] / 11_200 - 1) < 0.15 and abs(got[1] / 11_200 - 1) < 0.15


def test_what_is_short_is_decided_exactly():
    r = rake([("a", "x"), ("b", "x")], np.array([100.0, 900.0]), {"a": 0.2, "b": 0.8}, {"a": 2, "b": 1})
    assert r.short == [False, False] and r.residual < 1e-6 and r.rounds < 200
    assert rake([("a", "x"), ("b", "x")], np.array([99.0, 901.0]), {"a": 0.2, "b": 0.8}, {"a": 2, "b": 1}).short == [True, False]
    assert too_few(100_000_000_000_000_000, 1, 0.1, 1_000_000_000_000_000_001) and not too_few(100_000_000_000_000_000, 1, 0.1, 1_000_000_000_000_000_000)


def test_more_sources_than_a_control_table_has(spark, monkeypatch):
    monkeypatch.setattr("mediasift.llm.mixture.SOURCES", 3)
    df = spark.createDataFrame([(1, "s0", 5)], "doc_id long, source string, size int")
    weights = spark.range(4).selectExpr("concat('s', id) AS source", "0.25D AS target_share", "1 AS max_repeats")
    with pytest.raises(ValueError, match="at most 3 sources"):
        mix(df, weights, "doc_id", F.col("source"), F.col("size"), {})
