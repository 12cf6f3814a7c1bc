"""Heavy keys and redelivered messages."""

import random

import numpy as np
from pyspark.sql import functions as F

from mediasift.operators.eager_aggregation import blank_to_null, domain, eager_join_aggregate, filled, heavy_keys
from mediasift.streaming.dedup import bloom, drop_redelivered, dropped, first_of_each, in_bloom, ENTRY
from mediasift.streaming.records import once, split_sink, windowed_counts


def test_eager_join_equals_the_plain_join(spark):
    rng = random.Random(5)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = spark.createDataFrame([(key(), rng.choice(["x", "y", None]), rng.choice([1, 2, None])) for _ in range(80)], "k string, g string, v int")
    right = spark.createDataFrame([(key(), rng.choice([5, 7, None]), "clash") for _ in range(60)], "k string, w int, g string")
    got = eager_join_aggregate(left, right, ["k"], ["g"], {"v": F.col("v")}, {"w": F.col("w")})
    right2 = right.select("k", "w")
    want = left.join(right2, "k").groupBy("g").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("v").alias("v"), F.sum("w").alias("w"))
    key_of = lambda r: str(r[0])
    assert sorted(got.select("g", "n_rows", "v", "w").collect(), key=key_of) == sorted(want.collect(), key=key_of)
    outer = eager_join_aggregate(left, right, ["k"], ["g"], how="left").collect()
    assert sum(r["n_left"] for r in outer) == 80
    assert eager_join_aggregate(left.limit(0), right, ["k"], ["g"]).count() == 0


def test_heavy_keys_and_their_spelling(spark):
    rows = [(" A.Example. ",)] * 3 + [("a.example",)] * 1 + [("b.test",)] * 2 + [("",), ("  ",), (None,), (".",)] + [(f"x{i}.test",) for i in range(10)]
    df = spark.createDataFrame(rows, "source_domain string")
    found = {(r["key_value"], r["n_left"], r["n_all"]) for r in heavy_keys(df, {"source_domain": domain(F.col("source_domain"))}, 0.1).collect()}
    assert found == {("a.example", 4, 20), ("b.test", 2, 20)}
    two = heavy_keys(df.withColumn("t", F.lit(None).cast("string")), {"source_domain": domain(F.col("source_domain")), "t": F.col("t")}, 0.0)
    assert {r["n_all"] for r in two.collect()} == {20} and two.where("key_field = 't'").count() == 0
    assert heavy_keys(df.limit(0), {"d": domain(F.col("source_domain"))}, 0.1).count() == 0
    t = spark.createDataFrame([(" a ",), (" \t\n",), (None,)], "v string").select(filled(F.col("v")), blank_to_null(F.col("v"))).collect()
    assert [tuple(r) for r in t] == [(" a ", "a"), (None, None), (None, None)]


def test_first_of_each_and_bloom():
    e = np.array([(1, 1, 5, 50), (1, 1, 3, 20), (2, 1, 4, 1), (1, 1, 3, 20)], ENTRY)
    kept, extra, new = first_of_each(e, old=1)
    assert kept.tolist() == [(1, 1, 3, 50), (2, 1, 4, 1)] and extra.tolist() == [5] and new.tolist() == [False, True]
    rng = np.random.default_rng(1)
    h, g = rng.integers(-(2**63), 2**63 - 1, (2, 4000))
    f = bloom(h[:2000], g[:2000])
    assert in_bloom(f, h[:2000], g[:2000]).all() and in_bloom(f, h[2000:], g[2000:]).mean() < 0.05
    assert not in_bloom(bloom(h[:0], g[:0]), h, g).any()


def _deliveries(spark, folder, batches):
    """One file per batch, in arrival order."""
    import os
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "k string, id long, at timestamp, note string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/tmp{i}")
        part = next(f for f in os.listdir(f"{folder}/tmp{i}") if f.startswith("part"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(f"{folder}/tmp{i}/{part}", f"{folder}/in/{i:03}.parquet")
        os.utime(f"{folder}/in/{i:03}.parquet", (time.time() - 1000 + i, time.time() - 1000 + i))


def test_every_copy_is_dropped_however_far_apart(spark, tmp_path):
    import datetime

    rng = random.Random(2)
    day = datetime.datetime(2026, 1, 1)
    rows, n = [], 0
    for b in range(6):
        batch = []
        for _ in range(60):
            key = rng.choice(["hot", "hot", None, "", f"k{rng.randint(0, 60)}"])
            batch.append((key, n, None if rng.random() < 0.1 else day + datetime.timedelta(days=3 * b, hours=rng.randint(0, 20)), "x"))
            n += 1
        rows.append(batch)
    # what arrives first need not have the smallest number
    rows[0], rows[3] = rows[3], rows[0]
    _deliveries(spark, str(tmp_path), rows)
    schema = "k string, id long, at timestamp, note string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    drop_redelivered(stream, [F.col("k")], "id", "at", f"file://{tmp_path}/out", "1 day", 3).awaitTermination()
    first = {}
    for k, i, *_ in (r for b in rows for r in b):
        first[k] = min(i, first.get(k, i))
    want = {i for b in rows for k, i, *_ in b if first[k] != i}
    got = [r["id"] for r in dropped(spark, f"file://{tmp_path}/out").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert spark.read.parquet(f"{tmp_path}/out/late").count() > 0  # some were only found by the lookup
    # the same folder again: nothing is new, nothing changes; then one more copy
    _deliveries(spark, str(tmp_path / "more"), [[("hot", 9999, day, "late again")]])
    (tmp_path / "more/in/000.parquet").rename(tmp_path / "in/999.parquet")
    drop_redelivered(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), [F.col("k")], "id", "at", f"file://{tmp_path}/out", "1 day", 3).awaitTermination()
    assert {r["id"] for r in dropped(spark, f"file://{tmp_path}/out").collect()} == want | {9999}


def test_smallest_id_after_an_archived_and_a_live_copy(spark, tmp_path):
    import datetime

    day = datetime.datetime(2026, 1, 1)
    later = lambda n: day + datetime.timedelta(days=n)
    # 5 goes to the archive, 7 is looked up, dropped and stays live, 3 comes last
    rows = [[("m", 5, day, "x")], [("other", 100, later(5), "x")], [("other", 101, later(5), "x")], [("m", 7, later(6), "x")], [("m", 3, later(6), "x")]]
    _deliveries(spark, str(tmp_path), rows)
    stream = spark.readStream.schema("k string, id long, at timestamp, note string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    drop_redelivered(stream, [F.col("k")], "id", "at", f"file://{tmp_path}/out", "1 day", 1).awaitTermination()
    judged = spark.read.parquet(f"{tmp_path}/out/judged")
    batch_of = {(r["kind"], r["id"]): r["batch"] for r in judged.collect()}
    assert batch_of["archive", 5] < batch_of["ask", 7] and ("archive", 7) not in batch_of
    assert {r["id"] for r in dropped(spark, f"file://{tmp_path}/out").collect()} == {5, 7, 101}


def test_a_long_stream_keeps_state_and_archive_in_bounds(spark, tmp_path):
    """Two days go by in each of 14 micro-batches: the state holds what the watermark spans, and generations are merged."""
    import datetime

    from mediasift.streaming.dedup import FAN_IN, Archive

    day, rng = datetime.datetime(2026, 1, 1), random.Random(3)
    rows, first, want, n = [], {}, set(), 0
    for b in range(14):
        batch = []
        for _ in range(40):
            key = f"k{rng.randint(0, 250)}"
            batch.append((key, n, day + datetime.timedelta(days=2 * b, minutes=n), "x"))
            if key in first:
                want.add(n)
            first.setdefault(key, n)
            n += 1
        rows.append(batch)
    _deliveries(spark, str(tmp_path), rows)
    stream = spark.readStream.schema("k string, id long, at timestamp, note string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = drop_redelivered(stream, [F.col("k")], "id", "at", f"file://{tmp_path}/out", "1 day", 2)
    query.awaitTermination()
    assert {r["id"] for r in dropped(spark, f"file://{tmp_path}/out").collect()} == want
    spans = Archive(spark, f"file://{tmp_path}/out", 4).spans(10**6)
    assert len(spans) <= 2 * FAN_IN and [b + 1 for _, b in spans[:-1]] == [a for a, _ in spans[1:]]
    judged = spark.read.parquet(f"{tmp_path}/out/judged")
    moved = {r["batch"]: r["n"] for r in judged.where("kind = 'archive'").groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(moved.values()) > 14 * 20 and max(moved.values()) <= 80  # what came is gone two days later


def test_the_width_of_the_session_adds_no_tasks_to_a_micro_batch(spark, tmp_path):
    import datetime

    day, cores, width = datetime.datetime(2026, 1, 1), spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    # 0 and 1 are archived when 7 and 8 come
    rows = [[("a", 0, day, "x"), ("b", 1, day, "x")], [("c", 2, day + datetime.timedelta(days=5), "x")], [("d", 3, day + datetime.timedelta(days=5), "x")], [("a", 7, day + datetime.timedelta(days=9), "x")]]
    _deliveries(spark, str(tmp_path), rows)
    _deliveries(spark, str(tmp_path / "more"), [[("b", 8, day + datetime.timedelta(days=9), "x"), ("c", 9, day + datetime.timedelta(days=9), "x")]])

    def run():
        stream = spark.readStream.schema("k string, id long, at timestamp, note string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        drop_redelivered(stream, [F.col("k")], "id", "at", f"file://{tmp_path}/out", "1 day").awaitTermination()
        return {r["id"] for r in dropped(spark, f"file://{tmp_path}/out").collect()}

    try:
        spark.conf.set("spark.sql.shuffle.partitions", 5 * cores)
        assert run() == {7} and spark.conf.get("spark.sql.shuffle.partitions") == str(5 * cores)
        state = [f.name for f in (tmp_path / "out/checkpoint/state/0").iterdir() if f.name.isdigit()]
        assert len(state) == cores and len(list((tmp_path / "out/archive/2_2").glob("part=*"))) <= cores
        # goes on in a narrower session: what was archived and what is live is found in its old place
        spark.conf.set("spark.sql.shuffle.partitions", 2)
        (tmp_path / "more/in/000.parquet").rename(tmp_path / "in/999.parquet")
        assert run() == {7, 8, 9}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)


def test_an_empty_stream_drops_nothing(spark, tmp_path):
    spark.createDataFrame([], "k string, id long, at timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, id long, at timestamp").parquet(f"{tmp_path}/in")
    drop_redelivered(stream, [F.col("k")], "id", "at", f"file://{tmp_path}/out").awaitTermination()
    assert dropped(spark, f"file://{tmp_path}/out").count() == 0


def test_record_streams(spark, tmp_path):
    wire = "job_id string, media_evidence_id string, media_url string, media_type string, source_domain string, target_id string, target_version string, techniques string, max_attempts string, schema_version string"
    good = ("j", "e", "https://a.test/v", "video", "a.test", "t", "v", "dinov2,,ocr", "3", None)
    spark.createDataFrame([good, (*good[:8], "0", "1"), (*good[:7], ",", "1", "1")], wire).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        split_sink(spark.readStream.schema(wire).parquet(f"{tmp_path}/in"), f"file://{tmp_path}/jobs").awaitTermination()
    assert {(r["sink"], r["reject_reason"]) for r in spark.read.parquet(f"{tmp_path}/jobs").collect()} == {("good", None), ("rejected", "max_attempts below 1"), ("rejected", "no technique")}

    spark.sql("SELECT timestamp'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) AS at, id % 2 AS k FROM range(0, 12)").withColumn("id", F.lit("same")).write.parquet(f"{tmp_path}/ev")
    schema = spark.read.parquet(f"{tmp_path}/ev").schema
    q = windowed_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/ev"), "at", ["k"], "6 hours", "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["k"], r["n"]) for r in spark.table("w").collect()) == [(0, 3), (0, 3), (1, 3), (1, 3)]
    q = once(spark.readStream.schema(schema).parquet(f"{tmp_path}/ev"), ["k"], "at", "24 hours").writeStream.format("memory").queryName("o").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("o").count() == 2
