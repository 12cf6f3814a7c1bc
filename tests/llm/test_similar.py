import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift.llm.similar import CrossPolytope, hadamard, similar_vectors


def brute(ids, x, k, floor):
    good = [i for i, v in enumerate(x) if v is not None and len(v) == 16 and all(a is not None and np.isfinite(a) for a in v) and any(v)]
    ids, m = np.array(ids)[good], np.array([x[i] for i in good], "f4").astype("f8")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    c = np.round(u @ u.T, 6)
    out = {}
    for i, a in enumerate(ids):
        order = [j for j in sorted(range(len(ids)), key=lambda j: (-c[i, j], ids[j])) if j != i][:k]
        out[int(a)] = [int(ids[j]) for j in order if c[i, j] >= floor]
    return out


def found(df, **kw):
    got = {}
    for r in similar_vectors(df, "id", "v", 16, **({"k": 10, "floor": 0.9} | kw)).collect():
        got.setdefault(r["id"], []).append((r["pos"], r["neighbour"]))
    return {i: [n for _, n in sorted(p)] for i, p in got.items()}


def test_hadamard_is_its_own_inverse():
    x = np.random.default_rng(1).standard_normal((5, 32))
    assert np.allclose(hadamard(hadamard(x)), x) and np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((60, 16))
    x = np.concatenate([np.repeat(centres, 15, axis=0) + 0.25 * rng.standard_normal((900, 16)), rng.standard_normal((300, 16))])
    x *= rng.choice([0.01, 1, 30], (len(x), 1))
    rows = [(int(i), v.astype("f4").tolist()) for i, v in enumerate(x)]
    rows += [(5000 + i, rows[0][1]) for i in range(30)] + [(6000, rows[20][1]), (6001, [2 * a for a in rows[20][1]])]
    rows += [(7000, None), (7001, [1.0] * 3), (7002, [0.0] * 16), (7003, [float("nan")] * 16), (7004, [None] + [1.0] * 15), (7005, []), (7006, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "id long, v array<float>").withColumns({"cosine": F.lit("clash"), "rep": F.lit(1)})
    got, want = found(df, k=10, floor=0.9), brute([r[0] for r in rows], [r[1] for r in rows], 10, 0.9)
    pairs = {(a, b) for a, n in want.items() for b in n}
    mine = {(a, b) for a, n in got.items() for b in n}
    assert len(pairs & mine) / len(pairs) > 0.97 and len(mine - pairs) / len(mine) < 0.03
    assert all(len(n) <= 10 and a not in n for a, n in got.items())
    assert got[0] == [i for i in range(5000, 5010)] and got[5003] == [0, *range(5000, 5003), *range(5004, 5010)]
    assert 6000 in got[6001] and not {a for a in got if 7000 <= a < 8000}


def test_few_and_no_vectors(spark):
    schema = "id long, v array<float>"
    assert found(spark.createDataFrame([], schema)) == {}
    assert found(spark.createDataFrame([(1, [1.0] * 16), (None, [1.0] * 16)], schema)) == {}
    assert found(spark.createDataFrame([(1, [1.0] * 16), (2, [1.0] * 16), (3, [-1.0] * 16)], schema)) == {1: [2], 2: [1]}


@pytest.mark.parametrize("functions, dim", [(2, 64), (3, 64), (4, 64), (5, 64), (3, 768), (3, 100), (3, 7), (3, 2)])
def test_codes_hold_the_likeliest_buckets(functions, dim):
    """What the task of a region reads from the codes is what the rotations say, one by one."""
    plan = CrossPolytope(dim, 2, functions)
    x = np.random.default_rng(3).standard_normal((50, dim))
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f4")
    for t in range(2):
        region, codes = plan.entries(unit, plan.rotations(t), t)
        looks = plan.buckets(codes)
        turned = [unit @ r for r in plan.rotations(t)]
        axis = lambda y: 2 * int(np.abs(y).argmax()) + int(y[np.abs(y).argmax()] < 0)
        for i in range(50):
            own = [axis(y[i]) for y in turned]
            number = 0
            for a in own[: functions - plan.low]:
                number = number * 2 * plan.padded + a
            assert region[i] == number * 2 + t
            low = 0
            for a in own[functions - plan.low :]:
                low = (low << plan.axis_bits) + a
            assert looks[i, 0] == low and (dim == 2 or len(set(looks[i].tolist())) == looks.shape[1])


@pytest.mark.parametrize("dim, functions", [(64, 2), (64, 3), (64, 4), (64, 5), (768, 3), (768, 4)])
def test_recall_of_any_setting(dim, functions):
    """Pairs of just the cosine that is asked for, other ones than the tables were measured on."""
    n = 400 if dim < 768 else 100
    plan = CrossPolytope.for_recall(dim, 0, 0.9, functions=functions)
    rng = np.random.default_rng(99)
    a, b = rng.standard_normal((2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    both = np.concatenate([a, 0.9 * a + np.sqrt(0.19) * b]).astype("f4")
    found = np.zeros(n, bool)
    for t in range(plan.tables):
        region, codes = plan.entries(both, plan.rotations(t), t)
        looks = plan.buckets(codes)
        x, y = looks[:n], looks[n:]
        found |= (region[:n] == region[n:]) & ((x == y[:, :1]).any(axis=1) | (y == x[:, :1]).any(axis=1))
    assert found.mean() > 0.96


def test_size_changes_no_setting_in_reach():
    assert len({CrossPolytope.for_recall(64, n, 0.9) for n in (0, 10, 20_000, 1_048_576, 1_048_577, 100_000_000)}) == 1
    assert CrossPolytope.for_recall(64, 10**9, 0.9).functions == 4


def test_wide_regions_are_parted(spark):
    """Nine of ten vectors in one region: it is parted into buckets, and what is found is the same."""
    rng = np.random.default_rng(12)
    x = np.concatenate([np.ones((540, 16)) + 0.15 * rng.standard_normal((540, 16)), rng.standard_normal((60, 16))])
    df = spark.createDataFrame([(int(i), v.astype("f4").tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    want = found(df, k=10, floor=0.9)
    assert found(df, k=10, floor=0.9, held=50) == want and sum(map(len, want.values())) > 4000
    assert found(df, k=10, floor=0.9, held=50, crowd=40).keys() >= want.keys()


def test_pieces_hold_whole_keys_and_no_more_than_they_may():
    import pyarrow as pa

    from mediasift.llm.similar import _regions

    rng = np.random.default_rng(5)
    key = np.sort(np.concatenate([rng.integers(0, 40, 300), np.full(700, 17), np.full(120, 41)]))
    batches = lambda: (pa.RecordBatch.from_arrays([pa.array(key[i : i + 33]), pa.array(np.arange(i, min(i + 33, len(key))))], ["k", "v"]) for i in range(0, len(key), 33))
    narrow, wide = ([p for p in _regions(batches(), ["k", "v"], "k", 100, w)] for w in (False, True))
    assert {int(k) for p in narrow for k in p["k"]} == set(range(40)) - {17} & set(key.tolist()) and {int(k) for p in wide for k in p["k"]} == {17, 41}
    assert sorted(int(v) for p in narrow + wide for v in p["v"]) == list(range(len(key)))
    owners = [set(p["k"].tolist()) for p in narrow]
    assert sum(map(len, owners)) == len(set().union(*owners)) and max(len(p["k"]) for p in narrow) <= 133


def test_crowded_buckets_are_searched_exactly(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.ones((500, 16)) + 0.02 * rng.standard_normal((500, 16)), rng.standard_normal((200, 16))])
    rows = [(int(i), v.astype("f4").tolist()) for i, v in enumerate(x)] + [(900 + i, np.ones(16).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    want = brute([r[0] for r in rows], [r[1] for r in rows], 10, 0.9)
    got = found(df, k=10, floor=0.9, crowd=64)
    crowd = [i for i in want if i < 500 or i >= 900]
    assert sum(len(set(got[i]) & set(want[i])) for i in crowd) > 0.99 * sum(len(want[i]) for i in crowd)
