import hashlib
import json

import numpy as np
from pyspark.sql import functions as F

from mediasift.sources import media as M


def test_files_ranges_and_fingerprints(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.mp4").write_bytes(b"hello world")
    (tmp_path / "sub/b.MOV").write_bytes(b"12345")
    (tmp_path / "empty.mp4").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: r for r in M.media_files(spark, str(tmp_path), ["mp4", "mov"], 5).collect()}
    assert set(got) == {"a.mp4", "b.MOV"} and not got["a.mp4"]["fits"] and got["b.MOV"]["fits"]
    assert got["a.mp4"]["content_sha256"] == hashlib.sha256(b"hello world").hexdigest()
    assert M.media_files(spark, str(tmp_path)).count() == 3  # an empty file holds no media, and Spark lists none
    df = spark.createDataFrame([(bytearray(b"hello world"),), (None,)], "c binary")
    assert [r[0] and bytes(r[0]) for r in df.select(M.byte_range(F.col("c"), 6, 8)).collect()] == [b"wor", None]
    assert bytes(df.select(M.byte_range(F.col("c"), 6)).first()[0]) == b"world"
    assert df.select(M.content_fingerprint(F.col("c"), F.lit(11), 4)).first()[0] == hashlib.sha1(b"hell" + b"lo w" + b"orld" + b"11").hexdigest()


def test_fetching_tells_what_went_wrong(spark):
    def get(url):
        if "slow" in url:
            raise TimeoutError
        return {"ok": (200, "video/mp4", b"abc"), "gone": (410, "", b""), "page": (200, "text/html", b"x"), "big": (200, "video/mp4", b"0123456789")}[url.rsplit("/", 1)[1]]

    urls = ["https://a.test/ok", "https://a.test/gone", "http://a.test/page", "http://a.test/big", "http://a.test/slow", "ftp://a.test/ok", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    got = {r["i"]: r for r in M.fetch(df, "url", get, 5).collect()}
    assert [got[i]["fault"] for i in range(7)] == [None, "gone", "content type", "size", "error: TimeoutError", "scheme", "scheme"]
    assert got[0]["content_sha256"] == hashlib.sha256(b"abc").hexdigest() and got[0]["n_bytes"] == 3


def test_embedding_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(b"a")), (2, bytearray(b"a")), (3, None)], "i int, content binary")
    got = {r["i"]: r["vec"] for r in M.embed(df, "content", lambda: M.DigestEmbedder(8)).collect()}
    assert got[1] == got[2] and got[3] is None and abs(np.linalg.norm(got[1]) - 1) < 1e-9
    cache = M.SegmentCache(spark, f"file://{tmp_path}/cache")
    assert cache.get().count() == 0
    entry = "cache_key string, segments array<struct<idx int, start_s double, end_s double, vec array<double>>>"
    cache.put(spark.createDataFrame([("k", [(0, 0.0, 5.0, [1.0]), (1, 5.0, 10.0, [2.0])]), ("empty", []), ("no vector", [(0, 0.0, 5.0, [])])], entry))
    cache.put(spark.createDataFrame([("k", [(0, 0.0, 5.0, [1.0]), (1, 5.0, 10.0, [2.0])])], entry))
    assert cache.segments().count() == 2 and M.SegmentCache(spark, f"file://{tmp_path}/cache", 2).get().count() == 0


def test_timeline_frames_and_logs(spark, tmp_path):
    clips = spark.createDataFrame([("a", 11.0), ("b", 0.0), ("c", None), ("d", 5.0), ("e", float("nan"))], "clip string, d double")
    got = sorted((r["clip"], r["segment_index"], r["end_s"]) for r in M.timeline(clips, "d", 5.0).collect())
    assert got == [("a", 0, 5.0), ("a", 1, 10.0), ("a", 2, 15.0), ("d", 0, 5.0)]
    frames = spark.range(100).withColumnRenamed("id", "n")
    assert [r["n"] for r in M.every_kth(frames, "n", 24.0, 2.0, 3).orderBy("n").collect()] == [0, 12, 24]
    M.write_json_lines(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), f"{tmp_path}/log")
    lines = [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/log").collect()]
    assert sorted(map(str, lines)) == ["{'a': 1}", "{'a': 2, 'b': 'x'}"]
    assert spark.createDataFrame([("redis://u:secret@h:1/0",), ("https://h/x",)], "u string").select(M.redacted(F.col("u"))).collect()[0][0] == "redis://u:***@h:1/0"


def test_redirects_are_checked_and_bodies_cut_off():
    import pytest

    from mediasift.functions.gates import ERROR_KINDS

    read = []

    def body(n):
        for _ in range(n):
            read.append(1)
            yield b"12345"

    pages = {
        "http://a.test/v": (302, {"location": "/w"}, []), "http://a.test/w": (301, {"location": "https://b.test/x"}, []), "https://b.test/x": (200, {"content-type": "video/mp4"}, [b"ab", b"c"]),
        "http://a.test/in": (302, {"location": "http://inside.test/"}, []), "http://a.test/file": (302, {"location": "file:///etc/passwd"}, []), "http://a.test/loop": (307, {"location": "/loop"}, []),
        "http://a.test/long": (200, {}, body(1000)), "http://a.test/said": (200, {"content-length": "999"}, body(1)), "http://a.test/404": (404, {}, []),
    }
    hosts = {"a.test": ["8.8.8.8"], "b.test": ["2001:4860:4860::8888"], "inside.test": ["8.8.8.8", "10.0.0.1"]}
    get = M.careful(lambda u: pages[u], lambda h: hosts.get(h, []), 3, 12)
    assert get("http://a.test/v") == (200, "video/mp4", b"abc") and get("http://a.test/404")[0] == 404
    for url, error in (("in", "UnsafeDestinationError"), ("file", "UnsupportedSchemeError"), ("loop", "RedirectLimitExceededError"), ("long", "SizeLimitExceededError"), ("said", "SizeLimitExceededError")):
        with pytest.raises(getattr(M, error)):
            get(f"http://a.test/{url}")
        assert ERROR_KINDS[error] == "permanent_acquisition_failure"
    assert len(read) == 3  # no more than needed to tell
    with pytest.raises(M.UnsafeDestinationError):
        get("http://unknown.test/")


def test_a_store_has_each_content_once(spark, tmp_path):
    store = M.ContentStore(spark, f"file://{tmp_path}/store")
    df = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b""),), (None,)], "c binary")
    store.put(df, "c")
    store.put(df.union(spark.createDataFrame([(bytearray(b"b"),)], "c binary")), "c")
    sha = {b: hashlib.sha256(b).hexdigest() for b in (b"a", b"", b"b")}
    assert sorted(r["content_sha256"] for r in store.all().collect()) == sorted(sha.values())
    asked = spark.createDataFrame([(sha[b"a"].upper(),), ("0" * 64,), (None,)], "sha string")
    assert {r["sha"]: r["stored"] for r in store.there(asked, "sha").collect()} == {sha[b"a"].upper(): True, "0" * 64: False, None: False}
