"""The matcher on sequences of letters, whose vectors are one-hot: the same letter has cosine 1, any other 0."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mediasift.operators.segments import coarse_vectors, segment_faults, segments
from mediasift.operators.temporal_match import CANDIDATE, TARGET, MatcherConfig, segment_pairs, temporal_match

SEGMENT = "idx int, start_s double, end_s double, vec array<float>"


def letters(word, key):
    return [(*key, i, 5.0 * i, 5.0 * i + 5.0, [float(x == ch) for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]) for i, ch in enumerate(word)]


def run(spark, cases, coarse=-1.0):
    pairs = spark.createDataFrame([(f"t{i}", "v", f"c{i}") for i in range(len(cases))], "target_id string, target_version string, candidate_id string")
    t = spark.createDataFrame([r for i, (w, _) in enumerate(cases) for r in letters(w, (f"t{i}", "v"))], f"target_id string, target_version string, {SEGMENT}")
    c = spark.createDataFrame([r for i, (_, w) in enumerate(cases) for r in letters(w, (f"c{i}",))], f"candidate_id string, {SEGMENT}")
    out, rows = temporal_match(pairs, t, c, 26, MatcherConfig(coarse_similarity=coarse))
    verdicts = {r["candidate_id"]: r for r in out.collect()}
    chosen = {}
    for r in rows.collect():
        chosen.setdefault(r["candidate_id"], []).append((r["c"], r["t"]))
    return [(verdicts[f"c{i}"], sorted(chosen.get(f"c{i}", []))) for i in range(len(cases))]


def expected(target, candidate, tol=1, gap=2):
    """A plain version of the rules."""
    hits = [(c, t) for c, x in enumerate(candidate) for t, y in enumerate(target) if x == y]
    if not hits:
        return []
    count = Counter(t - c for c, t in hits)
    first = {}
    for c, t in hits:
        first.setdefault(t - c, c)
    off = min(count, key=lambda o: (-count[o], first[o], o))
    best = {}
    for c, t in hits:
        if abs(t - c - off) <= tol:
            best.setdefault(c, t)
    runs, now = [], []
    for c in sorted(best):
        if now and (c - now[-1][0] > gap or best[c] < now[-1][1]):
            runs.append(now)
            now = []
        now.append((c, best[c]))
    return max([*runs, now], key=len)


KNOWN = [
    ("ABCDEFGHIJ", "ABCDEFGHIJ", True, 10), ("ABCDEFGHIJ", "CDEF", True, 4), ("ABCDEFGHIJ", "XYCDEF", True, 4), ("ABCDEFGHIJ", "CDEFZ", True, 4),
    ("ABCDEFGHIJ", "XYCDEFZ", True, 4), ("ABCDEFGHIJ", "XCY", False, 1), ("ABCDEFGHIJ", "FAC", False, 1), ("ABCDEFGHIJ", "FEDC", False, 1),
    ("ABCDECFG", "CDE", True, 3), ("ABCDEFGHIJ", "KLMNOP", False, 0), ("ABCDE", "", False, 0), ("", "ABCDE", False, 0), ("", "", False, 0),
]


def test_known_sequences(spark):
    for (target, candidate, matched, n), (v, _) in zip(KNOWN, run(spark, [k[:2] for k in KNOWN])):
        assert (v["matched"], v["matched_segment_count"]) == (matched, n), (target, candidate)
        assert v["total_target_segments"] == len(target) and v["total_candidate_segments"] == len(candidate)
        assert v["score"] == (1.0 if n else 0.0) and (v["mean_similarity"] is None) == (n == 0)


def test_place_of_a_match(spark):
    (v, _), = run(spark, [("ABCDEFGHIJ", "XYCDEF")])
    assert (v["target_start"], v["target_end"], v["candidate_start"], v["candidate_end"], v["temporal_offset_s"], v["matched_duration_s"]) == (10, 30, 10, 30, 0, 20)


def test_random_sequences_with_many_ties(spark):
    rng = random.Random(3)
    cases = [("".join(rng.choices("ABCD", k=rng.randint(1, 12))), "".join(rng.choices("ABCDE", k=rng.randint(1, 9)))) for _ in range(120)]
    for (target, candidate), (_, rows) in zip(cases, run(spark, cases)):
        assert rows == expected(target, candidate), (target, candidate)


def test_coarse_screen_comes_first(spark):
    (a, _), (b, _) = run(spark, [("ABCDEFGHIJ", "ABCDEFG"), ("ABCDEFGHIJ", "KLMNA")], coarse=0.6)
    assert a["matched"] and a["coarse_similarity"] > 0.6
    assert not b["matched"] and b["matched_segment_count"] == 0 and b["coarse_similarity"] < 0.6


def test_segments_leave_out_faulty_frames(spark):
    nan = float("nan")
    frames = spark.createDataFrame(
        [(1, "a", 0, [1.0, 0.0]), (2, "a", 0, [0.0, 1.0]), (3, "a", 1, None), (4, "a", 1, [1.0]), (5, "a", 2, [0.0, 0.0]), (6, "a", 3, [nan, 1.0]), (7, "a", None, [1.0, 1.0]), (8, None, 4, [1.0, 1.0]), (9, "a", 5, [1.0, None])],
        "vec_id long, clip string, segment_index int, embeddings array<float>",
    ).withColumns({"frame_time_s": F.col("segment_index").cast("double"), "sample_fps": F.lit(2.0), "idx": F.lit("clashing name")})
    kept = segments(frames.drop("idx"), ["clip"], 2).collect()
    assert [(r["idx"], r["vec"], r["end_s"]) for r in kept] == [(0, [1.0, 0.0], 0.5)]
    assert len(segments(frames, ["clip"], 2).collect()) == 1
    faults = {r["vec_id"]: r["reason"] for r in segment_faults(frames, ["clip"], 2).collect()}
    assert faults == {2: "index repeated", 3: "no vector", 4: "wrong length", 5: "zero vector", 6: "not a number", 7: "no index", 9: "not a number"}
    assert coarse_vectors(segments(frames.limit(0), ["clip"], 2), ["clip"], 2).count() == 0


def test_vectors_of_different_length_cannot_be_compared(spark):
    pairs = spark.createDataFrame([("t", "v", "c")], "target_id string, target_version string, candidate_id string")
    t = spark.createDataFrame([("t", "v", 0, 0.0, 1.0, [1.0, 0.0])], f"target_id string, target_version string, {SEGMENT}")
    c = spark.createDataFrame([("c", 0, 0.0, 1.0, [1.0, 0.0, 0.0])], f"candidate_id string, {SEGMENT}")
    with pytest.raises(Exception, match="can't be compared"):
        segment_pairs(pairs, t, c, 0.9).collect()


def test_long_clips_are_compared_in_blocks(spark):
    n = 600
    vec = lambda i: [float((i >> b) & 1) * 2 - 1 for b in range(12)]
    t = spark.createDataFrame([("t", "v", i, float(i), i + 1.0, vec(i)) for i in range(n)], f"target_id string, target_version string, {SEGMENT}")
    c = spark.createDataFrame([("c", i, float(i), i + 1.0, vec(i + 50)) for i in range(500)], f"candidate_id string, {SEGMENT}")
    pairs = spark.createDataFrame([("t", "v", "c")], "target_id string, target_version string, candidate_id string")
    assert {(r["c"], r["t"]) for r in segment_pairs(pairs, t, c, 0.99).collect()} == {(i, i + 50) for i in range(500)}
    (v,) = temporal_match(pairs, t, c, 12)[0].collect()
    assert v["matched_segment_count"] == 500 and v["temporal_offset_s"] == 50


def test_names_of_key_columns():
    assert TARGET == ["target_id", "target_version"] and CANDIDATE == ["candidate_id"]


def test_blocks_hold_every_segment_once(spark):
    from mediasift.operators.segments import blocks

    rng = random.Random(9)
    rows = [(f"c{k}", i, float(i), i + 0.5, [float(k), float(i)]) for k in range(40) for i in sorted(rng.sample(range(200), rng.randint(1, 120)))]
    rng.shuffle(rows)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.createDataFrame(rows, f"candidate_id string, {SEGMENT}")
        got = [(r["candidate_id"], i, s, e, [r["flat"][2 * n], r["flat"][2 * n + 1]]) for r in blocks(df, ["candidate_id"], 7).collect() for n, (i, s, e) in enumerate(zip(r["idxs"], r["starts"], r["ends"])) if i // 7 == r["block"]]
        assert sorted(got) == sorted(rows)
        assert all(len(r["idxs"]) <= 7 and list(r["idxs"]) == sorted(r["idxs"]) for r in blocks(df, ["candidate_id"], 7).collect())
        assert blocks(df.limit(0), ["candidate_id"]).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_a_crowded_target_is_spread(spark):
    """A target that nearly all pairs name meets its candidates in several tasks, with the same result."""
    from mediasift.operators.segments import blocks
    from mediasift.operators.temporal_match import pairs_of_blocks, spread_targets

    rng = random.Random(7)
    words = {f"c{i}": "".join(rng.choices("ABCDEFG", k=6)) for i in range(60)}
    t = spark.createDataFrame([*letters("ABCDEFGABC", ("hot", "v")), *letters("GFEDCBA", ("cold", "v"))], f"target_id string, target_version string, {SEGMENT}")
    c = spark.createDataFrame([r for k, w in words.items() for r in letters(w, (k,))], f"candidate_id string, {SEGMENT}")
    pairs = spark.createDataFrame([("hot", "v", k) for k in words] + [("cold", "v", "c1"), ("missing", "v", "c2")], "target_id string, target_version string, candidate_id string")
    plain = pairs_of_blocks(pairs, blocks(t, TARGET), blocks(c, CANDIDATE), 0.9)
    salted = pairs_of_blocks(pairs, blocks(t, TARGET), blocks(c, CANDIDATE), 0.9, most=7)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect())) and plain.count() > 60
    named, copies, on = spread_targets(pairs, t.select(*TARGET).distinct(), 7)
    assert on == [*TARGET, "_salt"] and {r["target_id"]: r["n"] for r in copies.groupBy("target_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {"hot": 9, "cold": 1}
    assert max(r["n"] for r in named.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).collect()) < 20 and named.count() == 62


def test_clips_of_both_sides_in_one_pass(spark):
    from mediasift.operators.segments import blocks, clip_rows

    rows = [(1, "t", "v", None, 0, [1.0, 0.0]), (2, "t", "v", None, 0, [0.0, 1.0]), (3, "t", None, "c", 1, [1.0, 1.0]), (4, "t", "v", "c", 2, [2.0, 1.0]), (5, None, None, "c", 0, None)]
    frames = spark.createDataFrame(rows, "vec_id long, target_id string, target_version string, candidate_id string, segment_index int, embeddings array<float>").withColumns({"frame_time_s": F.lit(1.0), "sample_fps": F.lit(0.0), "side": F.lit("clash"), "k0": F.lit(1)})
    got = blocks(clip_rows(frames, {"target": TARGET, "candidate": CANDIDATE}, 2), ["side", "k0", "k1"]).collect()
    assert {(r["side"], r["k0"], r["k1"], tuple(r["idxs"]), r["n"], tuple(r["total"])) for r in got} == {("target", "t", "v", (0, 2), 2, (3.0, 1.0)), ("candidate", "c", "", (1, 2), 2, (3.0, 2.0))}


def test_a_pair_without_segments_is_an_error(spark):
    pairs = spark.createDataFrame([("t", "v", "c"), ("t", "v", "x"), ("x", "v", "c")], "target_id string, target_version string, candidate_id string")
    t = spark.createDataFrame(letters("ABC", ("t", "v")), f"target_id string, target_version string, {SEGMENT}")
    c = spark.createDataFrame(letters("ABC", ("c",)), f"candidate_id string, {SEGMENT}")
    out = temporal_match(pairs, t, c, 26)[0]
    assert {(r["target_id"], r["candidate_id"]): (r["fault"], r["matched"]) for r in out.collect()} == {("t", "c"): (None, True), ("t", "x"): ("no candidate", False), ("x", "c"): ("no target", False)}


def test_verdicts_become_evidence(spark):
    import json

    from mediasift.operators.records import combine_evidence, fold_evidence
    from mediasift.operators.temporal_match import DETAIL, verdict_evidence

    pairs = spark.createDataFrame([("t", "v", "c")], "target_id string, target_version string, candidate_id string")
    t = spark.createDataFrame(letters("ABCD", ("t", "v")), f"target_id string, target_version string, {SEGMENT}")
    c = spark.createDataFrame(letters("ABC", ("c",)), f"candidate_id string, {SEGMENT}")
    one = temporal_match(pairs, t, c, 26)[0].select(F.array(verdict_evidence(), verdict_evidence("ocr")).alias("e"))
    r = fold_evidence(combine_evidence(one, "e"), "evidence_json").first()
    assert (r["decision"], r["algorithm"], r["summary"]) == ("match", "dinov2+ocr", "dinov2=match (score=1.0000); ocr=match (score=1.0000)") == (r["folded_decision"], r["folded_algorithm"], r["folded_summary"])
    parsed = json.loads(r["evidence_json"])
    assert [list(x) for x in parsed] == [sorted(x) for x in parsed] and list(parsed[0]["detail"]) == sorted(DETAIL) and parsed[0]["detail"]["matched_segment_count"] == 3
    none = combine_evidence(one.select(F.slice("e", 1, 0).alias("e")), "e").first()
    assert none["decision"] is None and none["evidence_json"] is None
