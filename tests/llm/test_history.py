import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift.llm.history import MediaHistory, replay
from mediasift.llm.media_keys import evidence_key, url_key
from mediasift.llm.ring_graph import RingGraph, Shards

SAME = [
    "https://site.example/v/a-b-XyZ1.mp4", "http://site.example/v/a-b-XyZ1.mp4", "HTTPS://Site.Example:443/v/a-b-XyZ1.mp4#t=5", " https://www.site.example./v//a-b-XyZ1.mp4\n",
    "https://cdn3.site.example/v/./a-b-XyZ1.mp4?utm_source=x&ref=home", "https://edge-7.site.example/v/a-b-%58yZ1.mp4?token=1&expires=2", "https://m.site.example/v/a-b-XyZ1_720p.mp4?PHPSESSID=3", "https://site.example/v/x/../a-b-XyZ1.mp4",
]
QUERY = ["https://s.example/stream.m3u8?id=1&k=Ab&cat=film", "https://s.example/stream.m3u8?cat=film&k=Ab&id=1&share_id=9", "https://s.example/stre%61m.m3u8/?k=%41b&&id=1&cat=film"]
OTHER = [
    "https://site.example/v/a-b-xyZ1.mp4", "https://site.example/v/a-b-XyZ1-part2.mp4", "https://other.example/v/a-b-XyZ1.mp4", "https://site.example:8080/v/a-b-XyZ1.mp4", "https://site.example/v/a-b-XyZ1.mp4?v=2",
    "https://s.example/stream.m3u8?id=2&k=Ab&cat=film", "https://s.example/stream.m3u8?id=1&k=ab&cat=film", "https://s.example/a%2Fb", "https://s.example/a/b", "https://s.example/a%3Fb", "https://s.example/a+b", "https://s.example/a%20b",
]


def keys(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]


def test_addresses_of_one_file_have_one_key(spark):
    same, query, other = (keys(spark, v, url_key) for v in (SAME, QUERY, OTHER))
    assert len(set(same)) == 1 and len(set(query)) == 1 and None not in same + query + other
    assert len({*same, *query, *other}) == 2 + len(OTHER)
    assert keys(spark, ["", "  ", "N/A", "about:blank", "ftp://a.example/x", "https://", None, "x"], url_key) == [None] * 8
    assert keys(spark, ["https://a.example/%zz", "https://a.example/100%"], url_key) == ["a.example/%25zz", "a.example/100%25"]


def test_evidence_ids_have_one_key(spark):
    same = ["ev-202609-e788f582fe", "EV-202609-E788F582FE", "ev_202609_e788f582fe", "evidence:asset:ev-202609-e788f582fe", "{EV.202609.E788F582FE}", " ev202609e788f582fe\n"]
    assert set(keys(spark, same, evidence_key)) == {"ev202609e788f582fe"}
    assert keys(spark, ["", " ", "-", "n/a", "N/A ", "unknown", "None", None, "{}"], evidence_key) == [None] * 9


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 20000])
def test_routing_equals_exhaustive_search(n):
    rng = np.random.default_rng(n)
    h = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    graph = RingGraph.build(h, np.zeros(len(h), np.int64), np.arange(len(h)))
    q = np.concatenate([rng.integers(0, 2**64, 300, dtype=np.uint64), h[:300], np.array([0, 2**64 - 1], np.uint64)])
    with np.errstate(over="ignore"):
        apart = lambda a, b: np.minimum(a - b, b - a)
        best = np.array([apart(h, x).min() for x in q])
        for beam in (1, 4):
            assert (apart(graph.h[graph.route(q, beam)], q) == best).all()


def test_shards_accept_once_compact_and_load():
    rng = np.random.default_rng(3)
    shards, truth = Shards(), {}
    for b in range(23):
        h = np.unique(rng.integers(0, 3000, 200)).astype(np.uint64) * np.uint64(2**50)
        g = (h >> np.uint64(50)).astype(np.int64)
        ids = np.arange(len(h)) + 1000 * b
        got = shards.accept(h, g, ids, b)
        for k, i, f in zip(g.tolist(), ids.tolist(), got.tolist()):
            assert f == truth.get(k, -1)
            truth.setdefault(k, i)
        for graph in shards.graphs:
            again = RingGraph.of_bytes(graph.to_bytes())
            assert again.beam == graph.beam and (again.find(h, g) == graph.find(h, g)).all()
    assert len(shards.graphs) < 10 and sum(len(x.h) for x in shards.graphs) == len(truth)


def _records(rng, n):
    word = lambda: rng.choice([None, "hot", "hot", "hot", *[f"k{rng.randint(0, n)}" for _ in range(4)]])
    return [(f"r{i}", i, rng.choice([i // 50, i // 50, i // 50]), word(), word()) for i in range(n)]


def test_replay_equals_brute_force(spark):
    rows = _records(random.Random(8), 600)
    df = spark.createDataFrame(rows, "name string, seq long, b int, url string, ev string").withColumns({"record": F.lit(1), "id": F.lit("clash"), "h": F.lit(2)})
    got = {(r["name"], r["first"]) for r in replay(df, {"url": F.col("url"), "ev": F.col("ev")}, "name", "seq", "b").collect()}
    first, want = {}, set()
    for name, seq, _, u, e in rows:
        for k in (("u", u), ("e", e)):
            if k[1] is not None:
                if k in first:
                    want.add((name, first[k]))
                first.setdefault(k, name)
    assert got == want
    assert replay(df.limit(0), {"url": F.col("url")}, "name", "seq", "b").count() == 0
    assert replay(df.withColumn("b", F.lit(None).cast("int")), {"url": F.col("url")}, "name", "seq", "b").count() > 0


def test_the_width_of_the_session_adds_no_tasks_to_a_batch(spark, monkeypatch):
    made, init = [], MediaHistory.__init__
    monkeypatch.setattr(MediaHistory, "__init__", lambda self, *a, **k: (init(self, *a, **k), made.append(self))[0])
    df = spark.createDataFrame(_records(random.Random(9), 100), "name string, seq long, b int, url string, ev string")
    cores, width = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for wide in (3, 50 * cores):
            spark.conf.set("spark.sql.shuffle.partitions", wide)
            found.append(sorted(map(tuple, replay(df, {"url": F.col("url"), "ev": F.col("ev")}, "name", "seq", "b").collect())))
            assert made[-1].parts == min(wide, cores)  # two hundred keys need no more
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    assert found[0] == found[1] and found[0]


def test_batches_against_a_saved_history(spark, tmp_path):
    rng = random.Random(1)
    history, truth = MediaHistory(spark, f"file://{tmp_path}/history", 3), {}
    for b in range(9):
        keys_ = [rng.randint(0, 200) for _ in range(60)]
        rows = [(k * 10**15, k, 1000 * b + i) for i, k in enumerate(keys_)]
        for _ in range(2 if b in (3, 8) else 1):  # a batch that is run twice
            got = {r["g"]: r["first"] for r in history.add(spark.createDataFrame(rows, "h long, g long, id long"), b).collect()}
            now = dict(truth)
            for _, k, i in rows:
                now[k] = min(now.get(k, i), i)
            assert got == {k: now[k] for k in keys_ if k in truth or keys_.count(k) > 1}
        truth = now
    live = history.manifest()
    assert live["bytes_read"] < 120 * len(truth) and live["parts"] == 3
    # what was replaced is gone, but for what a repetition of the last batch needs
    named = {x[2] for m in (live, history.manifest(8)) for v in m["shards"].values() for x in v}
    assert {f"shards/{f.name}" for f in (tmp_path / "history/shards").iterdir() if not f.name.startswith(".")} == named
    assert {r["g"] for r in history.hits().collect()} <= set(truth)
