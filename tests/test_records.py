import hashlib
import ipaddress
import json
import random

from pyspark.sql import functions as F

from mediasift.functions import gates as G
from mediasift.functions import keys as K
from mediasift.functions import text_sets as T
from mediasift.functions.vectors import cosine, l2_score, unit
from mediasift.operators import records as R
from mediasift.operators.fusion import duration_similarity, resolution_similarity, weighted_score
from mediasift.operators.retrieval import search_in_blocks, similarity_band
from mediasift.operators.running import retention, running_totals


def column(spark, values, kind, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(f(F.col("v"))).collect()]


def test_addresses(spark):
    rng = random.Random(1)
    known = ["127.0.0.1", "10.1.2.3", "100.64.0.1", "100.128.0.1", "172.32.0.1", "192.168.1.1", "8.8.8.8", "169.254.1.1", "224.0.0.1", "192.0.0.9", "192.0.0.8", "198.18.0.1"]
    v4 = known + [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(300)]
    shared = ipaddress.ip_network("100.64.0.0/10")
    want = []
    for a in map(ipaddress.ip_address, v4):
        want.append(a.is_loopback or a.is_private or a.is_link_local or a.is_unspecified or a.is_multicast or a.is_reserved or a in shared)
    assert column(spark, v4, "string", G.unsafe_ipv4) == want
    assert column(spark, ["::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "2606:4700::1111", "fe80::1", "no address", None, "1.2.3.256", "01.2.3.4"], "string", G.unsafe_address) == [True, True, False, False, True, True, True, True, True]
    assert column(spark, [["8.8.8.8"], ["8.8.8.8", "10.0.0.1"], [], None, ["x"], ["2001:4860:4860::8888", "8.8.8.8"], ["8.8.8.8", "fe80::1"], ["8.8.8.8", None]], "array<string>", G.safe_destination) == [True, False, False, False, False, True, False, False]


def test_gates(spark):
    assert column(spark, [200, 299, 404, 410, 429, 503, 418, 302, None], "int", G.status_class) == ["ok", "ok", "not_found", "gone", "rate_limited", "server_error", "client_error", "unexpected", "unexpected"]
    assert column(spark, ["Video/MP4; x=1", "", None, " image/png "], "string", G.content_type) == ["video/mp4", "application/octet-stream", "application/octet-stream", "image/png"]
    assert column(spark, ["https://A.Test:80/b.MP4?x=1#y", " http://u:p@b.test./c.jpg\n", "ftp://c/d", "", None], "string", G.host) == ["a.test", "b.test", "c", None, None]
    assert column(spark, ["https://A.Test/b.MP4?x=1.jpg", " http://b.test/c.jpg\n", "https://b.test", None], "string", G.media_kind) == ["video", "image", "other", "other"]
    assert column(spark, ["GoneError", "x", None], "string", G.error_kind) == ["permanent_acquisition_failure", "unclassified_error", "unclassified_error"]
    assert column(spark, [("InferenceError", "candidate"), ("InferenceError", None), ("ModelLoadError", "candidate"), ("ServerError", "target"), ("JobValidationError", "x"), (None, None)], "struct<n: string, s: string>", lambda c: G.retry_class(c["n"], c["s"])) == ["result", "transient", "startup", "transient", "rejected", "permanent"]
    assert len(G.ERROR_KINDS) == 25
    assert column(spark, ["https://a.test/x.MKV?y=1", "x.jpg", "a", None], "string", G.mime_type) == ["video/x-matroska", "image/jpeg", "video/mp4", "video/mp4"]
    assert column(spark, [3.0, 5.0, None, float("nan")], "double", lambda c: G.too_short(c, 5)) == [True, False, False, False] and column(spark, [3.0], "double", lambda c: G.too_short(c, -1)) == [False]
    assert column(spark, [3661.0625, 360000.5, None], "double", K.clock) == ["01:01:01.063", "100:00:00.500", None]
    assert column(spark, ["/a b/ü.mp4"], "string", K.file_url) == ["file:///a%20b/%C3%BC.mp4"]
    assert column(spark, ["HTTPS://x", "ftp://x", None], "string", G.fetchable) == [True, False, False]


def test_canonical_keys(spark):
    odd = ["plain", 'quo"te', "back\\slash", "é", "tab\t", "", None, "a/b", " ", "😀"]
    assert column(spark, odd, "string", K.json_text) == [json.dumps(x) for x in odd]
    urls = ["https://x.test/é?a=\"1\"", "https://x.test/a"]
    df = spark.createDataFrame([(u, ["phash", "dinov2", "dinov2"]) for u in urls], "u string, t array<string>")
    want = [hashlib.sha256(json.dumps({"candidate_url": u, "target_id": "t", "target_version": "v", "techniques": ["dinov2", "dinov2", "phash"]}, sort_keys=True).encode()).hexdigest()[:32] for u in urls]
    assert [r[0] for r in df.select(K.job_id(F.col("u"), F.lit("t"), F.lit("v"), F.col("t"))).collect()] == want
    assert K.spec_key({"b": 1, "a": {"x": 2.0}}) == hashlib.sha256(b'{"a": {"x": 2.0}, "b": 1}').hexdigest()[:16]


def test_text_sets(spark):
    assert column(spark, ["The the NINTH-ferry s02", "é", "", None], "string", T.tokens) == [["the", "ninth", "ferry", "s02"], [], [], []]
    a = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["b"]), (["a"], [])], "a array<string>, b array<string>")
    assert [(round(r[0], 4), r[1]) for r in a.select(T.jaccard(F.col("a"), F.col("b")), T.containment(F.col("a"), F.col("b"))).collect()] == [(0.3333, 0.5), (0.0, 0.0), (0.0, 0.0)]
    assert column(spark, [0.9, 0.5, 0.1], "double", lambda c: T.score_class(c, 0.2, 0.6)) == ["matched", "uncertain", "no_match"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    rows = df.select(cosine(F.col("a"), F.col("b")), unit(F.col("a")), l2_score(cosine(F.col("a"), F.col("b")))).collect()
    assert [round(r[0], 9) for r in rows] == [1.0, 0.0, 0.0] and rows[0][1] == [0.6, 0.8] and rows[2][1] == [0.0, 0.0] and rows[0][2] == 1.0


def test_evidence(spark):
    full = json.dumps([{"technique": "phash", "matched": False, "score": 0.2}, {"technique": "dinov2", "matched": True, "score": 0.9}])
    rows = [full, json.dumps([{"technique": "ocr", "matched": False, "score": None}]), "[]", "[{", None, ""]
    got = R.fold_evidence(spark.createDataFrame([(r,) for r in rows], "evidence string"), "evidence").collect()
    assert tuple(got[0])[1:] == ("match", "phash+dinov2", 0.9, "phash=no_match (score=0.2000); dinov2=match (score=0.9000)", None)
    assert tuple(got[1])[1:] == ("no_match", "ocr", None, "ocr=no_match", None)
    assert [r["fault"] for r in got[2:]] == ["empty", "broken", "none", "broken"] and all(r["folded_decision"] is None for r in got[2:])


def test_latest_upsert_misses_and_latency(spark):
    df = spark.createDataFrame([("a", 1, 9), ("a", 2, 8), ("a", 2, 7), (None, 1, 1)], "k string, attempt int, id int")
    assert [tuple(r) for r in R.latest(df, ["k"], [F.desc("attempt"), F.col("id")]).collect()] == [("a", 2, 7)]
    old = spark.createDataFrame([("x", "v1", 1, 5)], "k string, v string, c int, u int")
    new = spark.createDataFrame([("x", "v2", 3, 6), ("y", "w", 4, 4), (None, "z", 1, 1)], "k string, v string, c int, u int")
    assert sorted(map(tuple, R.upsert(old, new, ["k"], ["v"], "c", "u").collect())) == [("x", "v2", 1, 6), ("y", "w", 4, 4)]
    wanted = spark.createDataFrame([("a",), ("a",), ("b",)], "cache_key string")
    assert [r[0] for r in R.cache_misses(wanted, wanted.where("cache_key = 'b'"), ["cache_key"]).collect()] == ["a"]
    samples = spark.createDataFrame([("w", i, float(i)) for i in range(1, 101)] + [("w", 101, None)], "g string, i int, v double")
    (r,) = R.latency_summary(samples, ["g"], "v", "i", window=11).collect()
    assert (r["count"], r["min"], r["max"], r["avg"], r["p50"], r["p95"], r["p99"], r["sample_window"]) == (100, 1.0, 100.0, 50.5, 95.0, 100.0, 100.0, 10) or r["sample_window"] == 11
    assert column(spark, [1, 2, 3, 10, 100], "int", R.backoff_seconds) == [1.0, 2.0, 4.0, 60.0, 60.0]
    assert column(spark, ["1500-0", "x", "", None, "-1"], "string", R.entry_seconds) == [1.5, None, None, None, None]


def test_running_totals_and_retention(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1, 2, 5])) for i in range(300)]
    rng.shuffle(rows)
    got = {r["i"]: (r["rank"], r["sum_before"], r["n_rows"], r["sum_all"]) for r in running_totals(spark.createDataFrame(rows, "i int, v int"), ["i"], "v").collect()}
    total, want = 0, {}
    for k, (i, v) in enumerate(sorted(rows)):
        want[i] = (k + 1, total)
        total += v or 0
    assert {i: x[:2] for i, x in got.items()} == want and {x[2:] for x in got.values()} == {(300, total)}
    t = spark.createDataFrame([(i, 10) for i in range(6)], "i int, v int")
    keep = lambda n, size: [r["i"] for r in retention(t, ["i"], "v", n, size).where("NOT drop").orderBy("i").collect()]
    assert keep(4, 1000) == [2, 3, 4, 5] and keep(100, 25) == [4, 5] and keep(0, 1000) == [] and keep(100, 0) == [] and keep(10, 60) == [0, 1, 2, 3, 4, 5]
    assert running_totals(t.limit(0), ["i"], "v").count() == 0


def test_fusion(spark):
    df = spark.createDataFrame([(1.0, None, 10.0, 20.0), (None, None, 20.0, 10.0), (float("nan"), 0.5, None, 1.0)], "a double, b double, x double, y double")
    s = weighted_score({"a": (F.col("a"), 0.5), "b": (F.col("b"), 0.25)})
    assert [(r[0], r[1]) for r in df.select(s, duration_similarity(F.col("x"), F.col("y"))).collect()] == [(1.0, 0.75), (None, 0.5), (0.5, 0.0)]
    assert df.select(resolution_similarity(F.lit(10), F.lit(10), F.lit(20), F.lit(5))).first()[0] == 0.25


def test_search_in_blocks(spark):
    rows = [(i, [float((i * k) % 7 - 3) + 0.01 * i for k in range(1, 5)]) for i in range(40)] + [(100, [0.0] * 4), (101, None), (102, [1.0]), (103, rows_nan())]
    df = spark.createDataFrame(rows, "vec_id long, embeddings array<float>").withColumn("cosine", F.lit("clash"))
    got = {}
    for r in search_in_blocks(df.where("vec_id % 10 = 0"), df, "vec_id", "embeddings", 4, 3).collect():
        got.setdefault(r["query_id"], []).append((r["pos"], r["vec_id"]))
    import numpy as np

    ids, x = np.arange(40), np.array([v for _, v in rows[:40]], "f4").astype("f8")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 10, 20, 30):
        c = np.round(u @ u[q], 6)
        order = [i for i in sorted(ids, key=lambda i: (-c[i], i)) if i != q][:3]
        assert [v for _, v in sorted(got[q])] == order
    assert column(spark, [0.96, 0.95, 0.1], "double", similarity_band) == ["nearly identical", "very similar", "different"]


def rows_nan():
    return [float("nan"), 1.0, 1.0, 1.0]


def test_legacy_and_named_keys(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    L = F.lit
    assert one(K.legacy_cache_key(L("/a/b"), L(12), L(34), L("m"), L(2.5), "v1")) == hashlib.sha1(b"/a/b|12|34|m|fps=2.50000|algo=v1").hexdigest()
    assert one(K.legacy_cache_key(L("/a/b"), L(None), L(34), L("m"), L(2.5), "v1")) is None
    t, v = K.index_member_parts(K.index_member(L("a:b"), L("1\x1f2")))
    assert (one(t), one(v)) == ("a:b", "1\x1f2") and one(K.index_member_parts(L("ab"))[0]) is None
    assert one(K.named_key("target_embeddings", L("t"), L("v"))) == "fingerprint:target:t:v:embeddings" and one(K.named_key("marker", L("/o"))) == "/o.marker"
    urls = ["https://a.test/x/b.MP4?c=d.e", "https://a.test", "https://a.test/.hidden", "https://a.test/v.tar.gz#x.y", "https://a.test/b."]
    assert column(spark, urls, "string", lambda u: K.asset_file_name(L(7), u)) == ["asset_7.MP4", "asset_7.bin", "asset_7.bin", "asset_7.gz", "asset_7.bin"]
    assert one(K.file_task_key(L("/c"), L(None), F.array(L("b"), L("a"), L("b")))) == "file:/c|target:|techniques:a,b" and one(K.queue_task_key(L(5))) == "queue_asset:5"
    assert one(K.synthetic_asset_id(L("k"))) == 2_000_000_000 + int(hashlib.sha1(b"k").hexdigest()[:8], 16)


def test_onion_techniques_and_spread(spark):
    assert column(spark, ["http://Abc.ONION/x", "http://a.test/b.onion", None], "string", G.onion) == [True, False, False]
    lists = [["Dinov2 ", "ocr"], ["zz", " AA", "zz", None], [" ", ""], [], None]
    assert column(spark, lists, "array<string>", lambda t: G.technique_fault(t, ["dinov2", "ocr"])) == [None, "Unknown techniques: aa, zz", "At least one technique must be enabled", None, None]
    rows = [("a", float(i)) for i in range(4)] + [("b", float(i)) for i in range(29)] + [("c", float(i)) for i in range(30)] + [("d", 5.0), ("a", None)]
    got = {r["g"]: r for r in R.sample_spread(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert (got["a"]["count"], got["a"]["median"], round(got["a"]["stdev"], 6)) == (4, 1.5, 1.118034) and got["d"]["stdev"] == 0.0
    assert got["a"]["warning"].startswith("n=4 is too small") and got["b"]["warning"].startswith("n=29 is small") and got["c"]["warning"] is None


def test_the_busiest_group_is_never_ranked_whole(spark):
    """Nine of ten rows are of one group: the same figures as one sort gives, of the rows from the histogram's bin on."""
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 9 + ["a", None]), i, rng.choice([None, *range(50)])) for i in range(3000)]
    got = {r["g"]: r for r in R.latency_summary(spark.createDataFrame(rows, "g string, i long, v int"), ["g"], "v", "i", window=101, bins=64).collect()}
    for g in ("hot", "a"):
        values = [v for k, _, v in rows if k == g and v is not None]
        last = sorted(values[-101:])
        at = lambda p: last[round((len(last) - 1) * p)]
        assert (got[g]["count"], got[g]["min"], got[g]["max"], got[g]["p50"], got[g]["p95"], got[g]["p99"], got[g]["sample_window"]) == (len(values), min(values), max(values), at(0.5), at(0.95), at(0.99), len(last))
    assert set(got) == {"hot", "a"} and R.latency_summary(spark.createDataFrame([], "g string, i long, v int"), ["g"], "v", "i").count() == 0


def test_candidates_outcomes_caches_and_fences(spark):
    df = spark.createDataFrame([("http://x", "a", ["t"], 1), ("ftp://x", "", [], 0), (None, None, [], None), ("HTTPS://x", None, ["t"], 1), ("http://x", "a", [], 1), ("http://x", "a", ["t"], None)], "u string, k string, t array<string>, n int")
    assert [r[0] for r in df.select(R.candidate_fault("u", ["k"], "t", "n")).collect()] == [None, "candidate_url must start with http:// or https://", "candidate_url must start with http:// or https://", "k must not be empty", "techniques must contain at least one entry", "max_attempts must be >= 1"]
    states = [(None, "match", "pending"), ("claimed", None, "pending"), ("rejected", None, "skipped"), ("retry_scheduled", None, "retryable_error"), ("failed", "match", "permanent_error"), ("completed", None, "skipped"), ("completed", "match", "match"), ("completed", "no_match", "no_match"), ("completed", "processing_failure", "permanent_error")]
    df = spark.createDataFrame(states, "s string, d string, want string")
    assert all(r[0] == r[1] for r in df.select(R.outcome(F.col("s"), F.col("d")), "want").collect())

    kinds = ", ".join(f"{c} string" for c in R.COMPATIBLE)
    one = ["t", "v", "c", "m", "1", "1", "{}", None]
    cached = spark.createDataFrame([one, [*one[:4], "2", *one[5:]], ["u", "v", "c", "m", "2", "1", "{}", "{}"]], kinds)
    wanted = spark.createDataFrame([one, ["u", *one[1:]], ["x", *one[1:]]], kinds)
    assert {r["target_id"]: (r["differs"], r["hit"]) for r in R.cache_differences(wanted, cached).collect()} == {"t": ("", True), "u": ("model_version,sampling_config", False), "x": (None, False)}

    r = R.fenced(spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 1, 3), ("a", None, 4), ("b", 1, 5)], "k string, n int, i int"), ["k"], "n", "i").collect()
    assert {x["i"]: (x["current_attempt"], x["stale"]) for x in r} == {1: (None, False), 2: (1, False), 3: (2, True), 4: (2, False), 5: (None, False)}
