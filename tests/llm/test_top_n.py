import random

from pyspark.sql import functions as F

from mediasift.llm.top_n import top_n_per_group


def test_top_n_equals_brute_force(spark):
    rng = random.Random(6)
    score = lambda: rng.choice([None, float("nan"), -0.1, 1.2, 1.0, 0.0, 0.5, round(rng.random(), 2)])
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", "", None]), rng.choice([None, "", *[f"i{rng.randint(0, 60)}" for _ in range(9)], "É", "z"]), score()) for _ in range(1500)]
    df = spark.createDataFrame(rows, "g string, i string, s double").withColumns({"pos": F.lit("clash"), "_g": F.lit(1)})
    got = {(r["g"], r["pos"]): (r["i"], r["s"]) for r in top_n_per_group(df, "g", "i", "s", 5).collect()}
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and 0 <= s <= 1:
            best[g, i] = max(best.get((g, i), 0), s)
    want = {}
    for g in {k[0] for k in best}:
        items = sorted(((i, s) for (h, i), s in best.items() if h == g), key=lambda x: (-x[1], x[0].encode()))
        want |= {(g, p + 1): x for p, x in enumerate(items[:5])}
    assert got == want
    assert top_n_per_group(df.limit(0), "g", "i", "s", 5).count() == 0


def test_a_group_of_ties_and_a_small_one(spark):
    df = spark.createDataFrame([("t", f"{i:04}", 1.0) for i in range(2000)] + [("s", "x", 0.0)], "g string, i string, s double")
    got = sorted((r["g"], r["pos"], r["i"]) for r in top_n_per_group(df, "g", "i", "s", 3).collect())
    assert got == [("s", 1, "x"), ("t", 1, "0000"), ("t", 2, "0001"), ("t", 3, "0002")]
