import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift.functions import hashing as H
from mediasift.operators import alignment as A


def slow_warp(sim, ratio):
    n, m = sim.shape
    band = max(abs(n - m), round(max(n, m) * ratio))
    cost, steps = {(0, 0): 0.0}, {(0, 0): 0}
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(m, i + band) + 1):
            ways = [(cost.get(k, float("inf")), k) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1))]
            best, k = min(ways, key=lambda x: x[0])
            cost[i, j], steps[i, j] = best + 1 - sim[i - 1, j - 1], steps.get(k, 0) + 1
    end = cost.get((n, m), float("inf"))
    return (0.0, 0) if not np.isfinite(end) else (max(0.0, min(1.0, 1 - end / steps[n, m])), steps[n, m])


@pytest.mark.parametrize("n, m, ratio", [(1, 1, 0.0), (5, 5, 0.0), (7, 4, 0.1), (4, 9, 0.5), (12, 12, 0.25), (20, 17, 1.0)])
def test_warping_equals_the_plain_recurrence(n, m, ratio):
    sim = np.round(np.random.default_rng(n * m).random((n, m)), 1)
    got, want = A.warp(sim, ratio), slow_warp(sim, ratio)
    assert got[1] == want[1] and abs(got[0] - want[0]) < 1e-12


def test_warping_of_equal_sequences_and_of_none():
    assert A.warp(np.eye(6), 0.2) == (1.0, 6)
    assert A.warp(np.zeros((0, 3)), 0.2) == (0.0, 0)


PAIRS = "target_id string, target_version string, candidate_id string"


def sides(spark, target, candidate, key="a"):
    """One pair of clips, from rows of values by name."""
    kinds = "bits long, rms double, zcr double"
    t = spark.createDataFrame([(key, "v", i, *r) for i, r in enumerate(target)], f"target_id string, target_version string, idx int, {kinds}")
    c = spark.createDataFrame([(key, i, *r) for i, r in enumerate(candidate)], f"candidate_id string, idx int, {kinds}")
    values = {k: F.col(k) for k in ("bits", "rms", "zcr")}
    return spark.createDataFrame([(key, "v", key), ("none", "v", key)], PAIRS), A.placed(t, A.TARGET, values), A.placed(c, A.CANDIDATE, values)


def by_bits(rows):
    return A.coverage(*rows, A.digest_similarity(A.of_target("bits"), A.of_candidate("bits")))


def test_coverage_takes_the_first_best_place(spark):
    x, y = 0, -1  # 64 equal bits or none
    (r,) = by_bits(sides(spark, [(b, 0.0, 0.0) for b in (None, x, y, x, y, x)], [(x, 0.0, 0.0), (y, 0.0, 0.0)])).collect()
    assert (r["similarity"], r["target_start_index"], r["target_end_index"], r["detail"]) == (1.0, 1, 2, 1.0)
    (r,) = by_bits(sides(spark, [(x, 0.0, 0.0)], [(x, 0.0, 0.0)] * 2)).collect()
    assert (r["similarity"], r["target_start_index"], r["target_end_index"]) == (0.0, 0, 0)
    assert by_bits(sides(spark, [], [(x, 0.0, 0.0)])).count() == 0


def test_coverage_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    t, c = (rng.integers(-(2**63), 2**63 - 1, n) for n in (30, 6))
    t[11:17] = c
    sim = 1 - np.bitwise_count(t.view("u8")[:, None] ^ c.view("u8")) / 64
    places = [(np.mean([sim[s + i, i] >= 0.8 for i in range(6)]) + 0.1 * np.mean([sim[s + i, i] for i in range(6)]), -s) for s in range(25)]
    (r,) = by_bits(sides(spark, [(int(v), 0.0, 0.0) for v in t], [(int(v), 0.0, 0.0) for v in c])).collect()
    assert r["target_start_index"] == -max(places)[1] == 11 and r["similarity"] == 1.0


def test_energy_correlation_finds_the_place(spark):
    t = np.random.default_rng(1).random(50)
    curve = lambda v: [(0, float(x), 0.0) for x in v]
    (r,) = A.energy_correlation(*sides(spark, curve(t), curve(t[20:35]))).collect()
    x, y = t - t.mean(), t[20:35] - t[20:35].mean()
    assert r["target_start_index"] == 20 and abs(r["detail"] - x[20:35] @ y / np.linalg.norm(y) / np.linalg.norm(x[20:35])) < 1e-9
    (flat,) = A.energy_correlation(*sides(spark, curve(t), curve(np.ones(5)))).collect()
    assert flat["similarity"] == 0.0 and flat["target_end_index"] == 4


def test_verification_near_a_place(spark):
    rng = np.random.default_rng(2)
    target = rng.random((40, 8))
    candidate = -0.5 * target[20:30]
    rows = lambda v, *key: [(*key, i, [float(x) for x in s]) for i, s in enumerate(v)]
    t = A.envelope(spark.createDataFrame(rows(target, "a", "v"), "target_id string, target_version string, idx int, x array<double>"), A.TARGET, "x", 2)
    c = A.envelope(spark.createDataFrame(rows(candidate, "a"), "candidate_id string, idx int, x array<double>"), A.CANDIDATE, "x", 2)
    assert t.count() == 160 and abs(t.where("hop = 5").first()["rms"] - np.sqrt((target[1, 2:4] ** 2).mean())) < 1e-12
    loud = lambda v: np.sqrt((v.reshape(-1, 2) ** 2).mean(axis=1))
    for place in (19, 3, 39):
        (r,) = A.verified(spark.createDataFrame([("a", "v", "a", place)], f"{PAIRS}, place int"), t, c, 4, 2).collect()
        x, y = loud(target)[max(0, place - 2) * 4 :][: 40 + 16], loud(candidate)
        x, y = x - x.mean(), y - y.mean()
        best = max((abs(x[s : s + 40] @ y) / np.linalg.norm(y) / np.linalg.norm(x[s : s + 40]) for s in range(len(x) - 39)), default=0.0)
        assert abs(r["similarity"] - best) < 1e-9


def test_warping_of_clips(spark):
    pairs, t, c = sides(spark, [(b, 0.0, 0.0) for b in (0, 0, -1, -1)], [(0, 0.0, 0.0), (-1, 0.0, 0.0), (None, 0.0, 0.0)])
    (r,) = A.warped(pairs, t, c, ["bits"], lambda x, y: A.equal_bits(x["bits"], y["bits"]), 1.0).collect()
    want = A.warp(np.array([[1, 0, 0], [1, 0, 0], [0, 1, 0], [0, 1, 0]], float), 1.0)
    assert (r["similarity"], r["path_length"]) == want and (r["target_start_index"], r["target_end_index"]) == (0, 3)


def test_digests_of_frames_and_sound(spark):
    frame = np.zeros((16, 16))
    frame[:, :8] = 200
    digest = lambda *arrays, h=16, w=16: [r[0] for r in spark.createDataFrame([(a if a is None else [float(x) for x in a],) for a in arrays], "p array<double>").select(H.frame_digest(F.col("p"), h, w)).collect()]
    assert digest(frame.ravel(), np.full(256, 7.0), [1.0] * 5, None) == ["f0" * 8, "", "", ""]
    odd = np.pad(frame, ((0, 3), (0, 5)), constant_values=99)
    assert digest(odd.ravel(), h=19, w=21) == ["f0" * 8] and digest([1.0], h=1, w=1) == [""]
    tone = np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)
    a, b, c = H.sound_digests(np.stack([tone, tone * 0.3, np.sin(2 * np.pi * 2000 * np.arange(8000) / 8000)]), 8000)
    assert a == b != c and H.sound_digests(np.zeros((2, 8000)), 8000) == ["", ""] and H.sound_digests(tone[None, :10], 8000) == [""]


def test_digest_columns(spark):
    df = spark.createDataFrame([("ff00", "ff01"), ("ff00", "ff00ff"), ("", ""), (None, "ff"), ("xy", "xy"), ("ffffffffffffffff", "0000000000000000"), ("00ff00ff", "00FF00FF")], "a string, b string")
    assert [round(r[0], 6) for r in df.select(H.hash_similarity(F.col("a"), F.col("b"))).collect()] == [0.9375, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    votes = spark.createDataFrame([("a", "ffffffffffffffff"), ("a", "ffffffff00000000"), ("a", "00000000ffffffff"), ("a", ""), ("a", None), ("b", "zz"), ("c", "8000000000000001"), ("c", "0000000000000000")], "k string, d string")
    assert {r["k"]: (r["digest"], r["n"]) for r in H.majority_digest(votes, ["k"], "d").collect()} == {"a": ("ffffffffffffffff", 3), "b": ("", 0), "c": ("0000000000000000", 2)}
    v = spark.createDataFrame([([1.0, -1.0, 1.0, 0.0],), ([2.0],), ([],), (None,)], "v array<double>")
    assert [(r[0] and round(r[0], 6), round(r[1], 6)) for r in v.select(H.rms(F.col("v")), H.zero_crossings(F.col("v"))).collect()] == [(0.866025, 1.0), (2.0, 0.0), (None, 0.0), (None, 0.0)]
    bits = spark.createDataFrame([("00ff00ff80000001",), ("xy",), (None,), ("00ff",)], "d string").select(H.digest_bits(F.col("d")).alias("b"))
    assert [r[0] for r in bits.select(H.hex_digest(F.col("b"))).collect()] == ["00ff00ff80000001", None, None, None]
    assert [r[0] for r in spark.createDataFrame([(None,), ([0.0] * 64,), ([None] * 64,), ([],)], "p array<double>").select(H.sound_digest(F.col("p"), 8000)).collect()] == [""] * 4
