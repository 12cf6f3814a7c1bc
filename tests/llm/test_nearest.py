import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift.llm import nearest
from mediasift.llm import queries as Q
from mediasift.llm.nearest import Best, nearest_vectors, unit_rows
from tests.llm.test_similar import brute


def found(df, k):
    got = {}
    for r in nearest_vectors(df, "id", "v", 16, k).collect():
        got.setdefault(r["id"], []).append((r["pos"], r["neighbour"]))
    return {i: [n for _, n in sorted(p)] for i, p in got.items()}


def test_all_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 16)) * rng.choice([0.01, 1, 30], (700, 1))
    rows = [(int(i), v.astype("f4").tolist()) for i, v in enumerate(x)]
    rows += [(5000 + i, rows[0][1]) for i in range(30)] + [(6001, [2 * a for a in rows[20][1]]), (6002, [-a for a in rows[20][1]])]
    rows += [(7000, None), (7001, [1.0] * 3), (7002, [0.0] * 16), (7003, [float("nan")] * 16), (7004, [None] + [1.0] * 15), (7005, []), (7006, [float("inf")] * 16)]
    df = spark.createDataFrame([*rows, (None, [1.0] * 16)], "id long, v array<float>").withColumn("cosine", F.lit("clash"))
    assert found(df, 10) == brute([r[0] for r in rows], [r[1] for r in rows], 10, -2)


def test_few_and_no_vectors(spark):
    schema = "id long, v array<float>"
    assert found(spark.createDataFrame([], schema), 3) == {}
    assert found(spark.createDataFrame([(1, [1.0] * 16)], schema), 3) == {}
    assert found(spark.createDataFrame([(1, [1.0] * 16), (2, [1.0] * 16), (3, [-1.0] * 16)], schema), 3) == {1: [2, 3], 2: [1, 3], 3: [1, 2]}


@pytest.mark.parametrize("size, pairs", [(7, 100_000), (64, 50), (500, 1000)])
def test_blocks_of_any_size_and_crowds(monkeypatch, size, pairs):
    monkeypatch.setattr(nearest, "PAIRS", pairs)
    rng = np.random.default_rng(6)
    x = unit_rows(np.concatenate([rng.standard_normal((300, 16)), np.ones((200, 16))]))
    ids = rng.permutation(500)
    best = Best(ids, x, 10)
    for at in range(0, 500, size):
        best.meet(ids[at : at + size], x[at : at + size])
    got = {int(i): f.tolist() for i, f in zip(ids, best.found)}
    assert got == brute(ids.tolist(), x.tolist(), 10, -2)


def test_every_usable_frame_has_ten(spark):
    folder = "/root/testdata/sf0.001"
    rows = Q.QUERIES["p1_neighbours"](spark, folder).groupBy("vec_id").count().collect()
    v = F.col("embeddings")
    usable = spark.read.parquet(f"{folder}/index_frames.parquet").where((F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)).count()
    assert len(rows) == usable and {r["count"] for r in rows} == {10}
