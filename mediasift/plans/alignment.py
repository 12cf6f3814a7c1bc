"""Queries on digests and loudness of segments. The tables hold no pixels and no sound, so frame vectors stand in for them: signs as bits, and all 64 numbers, turned by their
place, as samples (vectors mostly have length 1, so plain loudness would be the same everywhere)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.functions.hashing import frame_digest, hex_digest, majority_digest, rms, sign_bits, sound_digest, zero_crossings
from mediasift.functions.vectors import usable
from mediasift.operators import alignment as A
from mediasift.operators.segments import clip_rows
from mediasift.operators.temporal_match import CANDIDATE, PAIR, TARGET
from mediasift.plans.matching import _SEGS, DIM, _round, clips, named_pairs
from mediasift.session import cut, table

#: Samples of a hop of the envelope, and hops of a segment.
HOP, HOPS = 4, 16
#: Segments before and after a place that are searched around it.
SLACK = 2


def samples_of(v: Column) -> Column:
    """A vector as samples: each number by its place, from 1."""
    return F.transform(v, lambda x, i: x.cast("double") * (i + 1) / F.lit(64.0))


def features(v: Column) -> dict[str, Column]:
    """Digest, loudness and zero crossings of a segment."""
    return {"bits": sign_bits(v), "rms": F.round(rms(samples_of(v)), 9), "zcr": zero_crossings(v)}


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Named pairs with segments on both sides, and these, in place; cut, as each is read several times."""
    rows = clip_rows(table(spark, sf_dir, "index_frames"), {"target": TARGET, "candidate": CANDIDATE}, DIM)
    both = cut(A.placed_sides(rows, ["side", "k0", "k1"], features(F.col("vec"))))
    t = both.where("side = 'target'").drop("side").withColumnsRenamed({"k0": "target_id", "k1": "target_version"})
    c = both.where("side = 'candidate'").drop("side", "k1").withColumnRenamed("k0", "candidate_id")
    known = named_pairs(spark, sf_dir).join(c.where("p = 0").select(*CANDIDATE), CANDIDATE, "left_semi").join(t.where("p = 0").select(*TARGET), TARGET, "left_semi")
    return cut(known.select(*PAIR)), t, c


def q_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment pairs of named clips whose digests agree in four of five bits."""
    met = A.meetings(*_sides(spark, sf_dir)).withColumn("similarity", A.digest_similarity(A.of_target("bits"), A.of_candidate("bits")))
    return _round(met.where(F.col("similarity") >= A.MATCH).select(*PAIR, F.col("c_p").alias("c"), F.col("t_p").alias("t"), "similarity"))


def video(pairs: DataFrame, t: DataFrame, c: DataFrame) -> DataFrame:
    return A.coverage(pairs, t, c, A.digest_similarity(A.of_target("bits"), A.of_candidate("bits")))


def audio(pairs: DataFrame, t: DataFrame, c: DataFrame) -> DataFrame:
    return A.coverage(pairs, t, c, A.sound_similarity(A.of_target, A.of_candidate))


def q_coverage_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding coverage by digests."""
    return _round(video(*_sides(spark, sf_dir)))


def q_coverage_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding coverage by sound features."""
    return _round(audio(*_sides(spark, sf_dir)))


def q_energy_xcorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-correlation of loudness."""
    return _round(A.energy_correlation(*_sides(spark, sf_dir)))


def q_envelope_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest correlation of envelopes within two segments of the place that the digests give."""
    found = video(*_sides(spark, sf_dir)).select(*PAIR, F.col("target_start_index").alias("place"))
    t, c = clips(spark, sf_dir)
    loud = lambda s, key: A.envelope(s.withColumn("_x", samples_of(F.col("vec"))), key, "_x", HOP)
    return _round(A.verified(cut(found), loud(t, TARGET), loud(c, CANDIDATE), HOPS, SLACK))


def q_dtw_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dynamic time warping by digests."""
    return _round(A.warped(*_sides(spark, sf_dir), ["bits"], lambda t, c: A.equal_bits(t["bits"], c["bits"])))


def q_dtw_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dynamic time warping by sound features."""
    return _round(A.warped(*_sides(spark, sf_dir), ["bits", "rms", "zcr"], A.equal_sound))


def q_segment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest, loudness and zero crossings of every usable frame."""
    f = features(F.col("embeddings"))
    return _round(table(spark, sf_dir, "index_frames").where(usable(F.col("embeddings"), DIM)).select("vec_id", hex_digest(f["bits"]).alias("digest"), f["rms"].alias("rms"), f["zcr"].alias("zcr")))


def q_majority_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of five segments each, by majority of bits."""
    t, c = clips(spark, sf_dir)
    both = t.select(F.concat_ws("/", *TARGET).alias("clip"), "idx", "vec").union(c.select("candidate_id", "idx", "vec"))
    return majority_digest(both.select("clip", F.floor(F.col("idx") / 5).alias("part"), hex_digest(sign_bits(F.col("vec"))).alias("d")), ["clip", "part"], "d")


def q_frame_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block digests of frames, the vector taken as 8 by 8 gray values."""
    gray = F.transform("embeddings", lambda x: 128 + 127 * x.cast("double"))
    return table(spark, sf_dir, "index_frames").where(usable(F.col("embeddings"), DIM)).select("vec_id", frame_digest(gray, 8, 8).alias("digest"))


def q_sound_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band digests, the vector taken as samples at 8 kHz."""
    return table(spark, sf_dir, "index_frames").where(usable(F.col("embeddings"), DIM)).select("vec_id", sound_digest(F.col("embeddings"), 8000).alias("digest"))


_BIT = "cast(list_sum(list_transform(range({a}, {b}), lambda i: CASE WHEN {v}[i] > 0 THEN 1 << (i - {a}) ELSE 0 END)) AS BIGINT)"


def _digest(v: str) -> str:
    return "(" + " || ".join(f"printf('%08x', {_BIT.format(a=a, b=a + 32, v=v)})" for a in (1, 33)) + ")"


_SAMPLES = "list_transform({v}, lambda x, i: cast(x AS DOUBLE) * i / 64)"
_RMS = f"round(sqrt(list_sum(list_transform({_SAMPLES}, lambda x: x * x)) / 64), 9)"
_ZCR = "(list_sum(list_transform(range(1, len({v})), lambda i: CASE WHEN sign({v}[i]) <> sign({v}[i + 1]) THEN 1.0 ELSE 0.0 END)) / (len({v}) - 1))"
_FEATURES = (
    "WITH " + _SEGS.format(coarse=0.6) + f""",
tf AS (SELECT target_id, target_version, idx, row_number() OVER (PARTITION BY target_id, target_version ORDER BY idx) - 1 AS p, {_digest('vec')} AS d, {_RMS.format(v='vec')} AS rms, {_ZCR.format(v='vec')} AS zcr FROM ts),
cf AS (SELECT candidate_id, idx, row_number() OVER (PARTITION BY candidate_id ORDER BY idx) - 1 AS p, {_digest('vec')} AS d, {_RMS.format(v='vec')} AS rms, {_ZCR.format(v='vec')} AS zcr FROM cs),
x AS (SELECT p.target_id, p.target_version, p.candidate_id, t.idx AS t, c.idx AS c, t.p AS tp, c.p AS cp, t.rms AS tr, c.rms AS cr, t.zcr AS tz, c.zcr AS cz,
  1 - (bit_count(xor(cast('0x' || t.d[1:8] AS BIGINT), cast('0x' || c.d[1:8] AS BIGINT))) + bit_count(xor(cast('0x' || t.d[9:16] AS BIGINT), cast('0x' || c.d[9:16] AS BIGINT)))) / 64.0 AS hs
  FROM pairs p JOIN tf t USING (target_id, target_version) JOIN cf c USING (candidate_id))
"""
)
_K = "target_id, target_version, candidate_id"


def _covered(sim: str) -> str:
    return _FEATURES + f""",
size AS (SELECT {_K}, max(tp) + 1 AS n, max(cp) + 1 AS m FROM x GROUP BY ALL),
w AS (SELECT {_K}, tp - cp AS s, count(*) AS k, avg(CASE WHEN {sim} >= 0.8 THEN 1.0 ELSE 0.0 END) AS share, avg({sim}) AS mean FROM x GROUP BY ALL),
full_ AS (SELECT w.*, m FROM w JOIN size z ON w.target_id = z.target_id AND w.target_version = z.target_version AND w.candidate_id = z.candidate_id WHERE k = m AND s >= 0 AND n >= m),
best AS (SELECT * FROM full_ QUALIFY row_number() OVER (PARTITION BY {_K} ORDER BY round(share + 0.1 * mean, 12) DESC, s) = 1)
SELECT z.target_id, z.target_version, z.candidate_id, round(coalesce(share, 0), 6) AS similarity, cast(coalesce(s, 0) AS INTEGER) AS target_start_index,
  cast(coalesce(s + b.m - 1, 0) AS INTEGER) AS target_end_index, round(coalesce(s, 0) * 1.0, 6) AS offset_s, round(coalesce(mean, 0), 6) AS detail
FROM size z LEFT JOIN best b ON b.target_id = z.target_id AND b.target_version = z.target_version AND b.candidate_id = z.candidate_id
"""

# Warping by antidiagonals: `a` and `b` hold the costs of the last and the last but one antidiagonal by target segment, `la` and `lb` the lengths of the paths there.
def _warped(sim: str) -> str:
    cell = "coalesce({0}[i + 1], 'inf'::DOUBLE)"
    up, left, diag = cell.format("a").replace("i + 1", "i"), cell.format("a"), cell.format("b").replace("i + 1", "i")
    on = "d + 1 - i BETWEEN 1 AND m AND abs(2 * i - d - 1) <= band"
    return _FEATURES.replace("WITH", "WITH RECURSIVE", 1) + f""",
size AS (SELECT {_K}, cast(max(tp) + 1 AS INTEGER) AS n, cast(max(cp) + 1 AS INTEGER) AS m, list({sim} ORDER BY tp, cp) AS sim FROM x GROUP BY ALL),
banded AS (SELECT *, cast(greatest(abs(n - m), round_even(greatest(n, m) * 0.25, 0)) AS INTEGER) AS band FROM size),
w AS (
  SELECT {_K}, n, m, sim, band, 1 AS d, list_transform(range(0, n + 1), lambda i: 'inf'::DOUBLE) AS a, list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 0.0 ELSE 'inf'::DOUBLE END) AS b,
    list_transform(range(0, n + 1), lambda i: 0) AS la, list_transform(range(0, n + 1), lambda i: 0) AS lb FROM banded
  UNION ALL
  SELECT {_K}, n, m, sim, band, d + 1,
    list_transform(range(0, n + 1), lambda i: CASE WHEN i > 0 AND {on} THEN least({up}, {left}, {diag}) + 1.0 - sim[(i - 1) * m + d + 1 - i] ELSE 'inf'::DOUBLE END), a,
    list_transform(range(0, n + 1), lambda i: CASE WHEN i > 0 AND {on} THEN 1 + CASE WHEN {up} <= {left} AND {up} <= {diag} THEN la[i] WHEN {left} <= {diag} THEN la[i + 1] ELSE lb[i] END ELSE 0 END), la
  FROM w WHERE d < n + m)
SELECT {_K}, CASE WHEN isinf(a[n + 1]) THEN 0.0 ELSE round(greatest(0, least(1, 1 - a[n + 1] / la[n + 1])), 6) END AS similarity, CASE WHEN isinf(a[n + 1]) THEN 0 ELSE cast(la[n + 1] AS INTEGER) END AS path_length,
  0 AS target_start_index, CASE WHEN isinf(a[n + 1]) THEN 0 ELSE n - 1 END AS target_end_index FROM w WHERE d = n + m
"""


_SOUND = "(0.8 * hs + 0.2 * greatest(0, least(1, 1 - (0.65 * abs(tr - cr) + 0.35 * abs(tz - cz)))))"
_LOUD = f"list_transform(range(0, 16), lambda k: sqrt(list_sum(list_transform(range(4 * k + 1, 4 * k + 5), lambda i: pow(({_SAMPLES.format(v='vec')})[i], 2))) / 4))"

QUERIES = {
    "hamming_join": q_hamming_join, "coverage_video": q_coverage_video, "coverage_audio": q_coverage_audio, "energy_xcorr": q_energy_xcorr, "envelope_verify": q_envelope_verify,
    "dtw_video": q_dtw_video, "dtw_audio": q_dtw_audio, "segment_features": q_segment_features, "majority_digest": q_majority_digest, "frame_digest": q_frame_digest, "sound_digest": q_sound_digest,
}
ORACLES = {
    "hamming_join": _FEATURES + f"SELECT {_K}, cast(cp AS INTEGER) AS c, cast(tp AS INTEGER) AS t, round(hs, 6) AS similarity FROM x WHERE hs >= 0.8",
    "coverage_video": _covered("hs"),
    "coverage_audio": _covered(_SOUND),
    "dtw_video": _warped("hs"),
    "dtw_audio": _warped(_SOUND),
    "envelope_verify": _covered("hs").replace("SELECT z.target_id, z.target_version, z.candidate_id, round(coalesce(share", """, place AS (SELECT z.target_id, z.target_version, z.candidate_id, z.m, cast(coalesce(s, 0) AS INTEGER) AS place, round(coalesce(share""").rstrip() + f"""),
      te AS (SELECT target_id, target_version, p * 16 + k AS hop, e[k + 1] AS r FROM (SELECT target_id, target_version, row_number() OVER (PARTITION BY target_id, target_version ORDER BY idx) - 1 AS p, {_LOUD} AS e FROM ts), range(0, 16) AS g(k)),
      ce AS (SELECT candidate_id, p * 16 + k AS hop, e[k + 1] AS r FROM (SELECT candidate_id, row_number() OVER (PARTITION BY candidate_id ORDER BY idx) - 1 AS p, {_LOUD} AS e FROM cs), range(0, 16) AS g(k)),
      cc AS (SELECT candidate_id, hop, r - avg(r) OVER w AS y FROM ce WINDOW w AS (PARTITION BY candidate_id)), cn2 AS (SELECT candidate_id, sqrt(sum(y * y)) AS len FROM cc GROUP BY ALL),
      st AS (SELECT p.target_id, p.target_version, p.candidate_id, m * 16 AS size, hop - greatest(0, place - 2) * 16 AS q, r FROM place p JOIN te USING (target_id, target_version)
        WHERE hop >= greatest(0, place - 2) * 16 AND hop < greatest(0, place - 2) * 16 + m * 16 + 64),
      sm AS (SELECT {_K}, size, q, r - avg(r) OVER w AS x, count(*) OVER w AS n FROM st WINDOW w AS (PARTITION BY {_K})),
      rr AS (SELECT sm.target_id, sm.target_version, sm.candidate_id, q - cc.hop AS lag, abs(sum(x * y) / greatest(any_value(len) * sqrt(sum(x * x)), 1e-8)) AS r FROM sm JOIN cc USING (candidate_id) JOIN cn2 USING (candidate_id)
        WHERE len >= 1e-8 AND q - cc.hop BETWEEN 0 AND n - size GROUP BY ALL)
      SELECT p.target_id, p.target_version, p.candidate_id, place, round(coalesce(max(r), 0), 6) AS similarity FROM place p LEFT JOIN rr ON p.target_id = rr.target_id AND p.target_version = rr.target_version AND p.candidate_id = rr.candidate_id GROUP BY ALL""",
    "sound_digest": """
      WITH v AS (SELECT vec_id, list_transform(embeddings, lambda x, i: x * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 63))) AS v FROM index_frames
        WHERE len(embeddings) = 64 AND len(list_filter(embeddings, lambda x: x IS NULL OR isnan(x) OR abs(x) > 3.4e38)) = 0 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0),
      p AS (SELECT vec_id, list_transform(range(0, 32), lambda f: pow(list_sum(list_transform(v, lambda x, i: x * cos(2 * pi() * f * (i - 1) / 64))), 2) + pow(list_sum(list_transform(v, lambda x, i: x * sin(2 * pi() * f * (i - 1) / 64))), 2)) AS power FROM v),
      e AS (SELECT list_sort(list_distinct(list_transform(range(0, 33), lambda k: cast(round(pow(31.0, k / 32)) AS INTEGER)))) AS edges),
      b AS (SELECT vec_id, list_transform(range(1, len(edges)), lambda k: list_sum(power[edges[k] + 1 : edges[k + 1]])) AS bands FROM p, e),
      s AS (SELECT vec_id, bands, list_sum(bands) AS whole FROM b)
      SELECT vec_id, CASE WHEN whole < 1e-10 THEN '' ELSE printf('%08x', cast(list_sum(list_transform(bands, lambda x, i: CASE WHEN x * 32 >= whole THEN 1 << (32 - i) ELSE 0 END)) AS BIGINT)) END AS digest FROM s""",
    "energy_xcorr": _FEATURES + f""",
      size AS (SELECT {_K}, max(tp) + 1 AS n, max(cp) + 1 AS m FROM x GROUP BY ALL),
      ta AS (SELECT target_id, target_version, avg(rms) AS a FROM tf GROUP BY ALL), ca AS (SELECT candidate_id, avg(rms) AS a FROM cf GROUP BY ALL),
      w AS (SELECT x.target_id, x.target_version, x.candidate_id, tp - cp AS s, count(*) AS k, sum((tr - ta.a) * (cr - ca.a)) AS num, sum((tr - ta.a) * (tr - ta.a)) AS te, sum((cr - ca.a) * (cr - ca.a)) AS ce
        FROM x JOIN ta USING (target_id, target_version) JOIN ca USING (candidate_id) GROUP BY ALL),
      full_ AS (SELECT w.*, m, num / greatest(sqrt(ce) * sqrt(te), 1e-8) AS r FROM w JOIN size z ON w.target_id = z.target_id AND w.target_version = z.target_version AND w.candidate_id = z.candidate_id
        WHERE k = m AND s >= 0 AND n >= m AND sqrt(ce) >= 1e-8),
      best AS (SELECT * FROM full_ QUALIFY row_number() OVER (PARTITION BY {_K} ORDER BY round(r, 12) DESC, s) = 1)
      SELECT z.target_id, z.target_version, z.candidate_id, round(greatest(0, least(1, coalesce(r, 0))), 6) AS similarity, cast(coalesce(s, 0) AS INTEGER) AS target_start_index,
        cast(CASE WHEN z.m <= z.n THEN coalesce(s, 0) + z.m - 1 ELSE 0 END AS INTEGER) AS target_end_index, round(coalesce(s, 0) * 1.0, 6) AS offset_s, round(coalesce(r, 0), 6) AS detail
      FROM size z LEFT JOIN best b ON b.target_id = z.target_id AND b.target_version = z.target_version AND b.candidate_id = z.candidate_id""",
    "segment_features": "WITH " + _SEGS.format(coarse=0.6) + f" SELECT vec_id, {_digest('embeddings')} AS digest, round({_RMS.format(v='embeddings')}, 6) AS rms, round({_ZCR.format(v='embeddings')}, 6) AS zcr FROM ok".replace("WITH \nok", "WITH ok"),
    "majority_digest": "WITH " + _SEGS.format(coarse=0.6) + """,
      u AS (SELECT target_id || '/' || target_version AS clip, idx // 5 AS part, vec FROM ts UNION ALL SELECT candidate_id, idx // 5, vec FROM cs),
      b AS (SELECT clip, part, unnest(range(1, 65)) AS i, unnest(vec) > 0 AS up FROM u),
      m AS (SELECT clip, part, i, count(*) AS n, sum(CASE WHEN up THEN 1 ELSE 0 END) * 2 > count(*) AS on_ FROM b GROUP BY ALL),
      h AS (SELECT clip, part, n, cast(sum(CASE WHEN on_ AND i <= 32 THEN 1 << (i - 1) ELSE 0 END) AS BIGINT) AS h1, cast(sum(CASE WHEN on_ AND i > 32 THEN 1 << (i - 33) ELSE 0 END) AS BIGINT) AS h2 FROM m GROUP BY ALL)
      SELECT clip, part, printf('%08x', h1) || printf('%08x', h2) AS digest, n FROM h""",
    "frame_digest": """
      WITH g AS (SELECT vec_id, list_transform(embeddings, lambda x: 128 + 127 * cast(x AS DOUBLE)) AS v FROM index_frames
        WHERE len(embeddings) = 64 AND len(list_filter(embeddings, lambda x: x IS NULL OR isnan(x) OR abs(x) > 3.4e38)) = 0 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0),
      a AS (SELECT vec_id, v, list_sum(v) / 64 AS mean FROM g),
      s AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: (x - mean) * (x - mean))) / 64) AS sd FROM a)
      SELECT vec_id, CASE WHEN sd >= 4 THEN """ + " || ".join(f"printf('%08x', cast(list_sum(list_transform(range({a}, {a + 32}), lambda i: CASE WHEN v[i] > mean THEN 1 << ({a + 31} - i) ELSE 0 END)) AS BIGINT))" for a in (1, 33)) + " ELSE '' END AS digest FROM s",
}
