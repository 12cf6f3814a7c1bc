"""Queries on segment vectors: temporal matching, coarse screening, nearest neighbours and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.operators.frame_runs import FrameConfig, frame_runs, nearest_in_blocks
from mediasift.operators.records import combine_evidence, fold_evidence
from mediasift.operators.retrieval import search_in_blocks, similarity_band
from mediasift.operators.segments import blocks, clip_rows, coarse_of_blocks, segment_faults, segments
from mediasift.operators.temporal_match import CANDIDATE, PAIR, TARGET, MatcherConfig, match_blocks, pairs_of_blocks, screen_blocks, verdict_evidence
from mediasift.session import cut, table

DIM = 64


def clips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Segments of all targets and of all candidates."""
    frames = table(spark, sf_dir, "index_frames")
    return segments(frames, TARGET, DIM), segments(frames, CANDIDATE, DIM)


def packed_clips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of all targets and of all candidates: the table is read once and its vectors are shuffled once, whatever they are used for then."""
    rows = clip_rows(table(spark, sf_dir, "index_frames"), {"target": TARGET, "candidate": CANDIDATE}, DIM)
    packed = cut(blocks(rows, ["side", "k0", "k1"]))
    t = packed.where("side = 'target'").drop("side").withColumnsRenamed({"k0": "target_id", "k1": "target_version"})
    return t, packed.where("side = 'candidate'").drop("side", "k1").withColumnRenamed("k0", "candidate_id")


def named_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clip pairs to compare: a job's candidate with the target that it names, and the recorded pairs, whether or not there are frames of both."""
    jobs = table(spark, sf_dir, "jobs").select(*TARGET, F.col("media_evidence_id").alias("candidate_id"))
    return jobs.union(table(spark, sf_dir, "matched_pairs").select(*PAIR)).dropna().distinct()


def pairs_with_blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Named pairs that have segments on both sides, and the blocks of all clips."""
    t, c = packed_clips(spark, sf_dir)
    both = named_pairs(spark, sf_dir).join(c.select(*CANDIDATE).distinct(), CANDIDATE, "left_semi").join(t.select(*TARGET).distinct(), TARGET, "left_semi")
    return cut(both.select(*PAIR)), t, c


def _round(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def q_temporal_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of each named pair of clips; those without frames on a side are errors."""
    return _round(match_blocks(named_pairs(spark, sf_dir), *packed_clips(spark, sf_dir))[0])


def q_temporal_match_unscreened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the coarse screen: also short clips of long targets are compared."""
    return _round(match_blocks(named_pairs(spark, sf_dir), *packed_clips(spark, sf_dir), MatcherConfig(coarse_similarity=-1.0))[0])


def q_matched_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment pairs of each pair's best run."""
    rows = match_blocks(named_pairs(spark, sf_dir), *packed_clips(spark, sf_dir))[1]
    return _round(rows.select(*PAIR, F.col("t").alias("target_segment_index"), F.col("c").alias("candidate_segment_index"), F.col("s").alias("similarity")))


def q_match_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts as evidence: each combined into a result, and folded again from its JSON."""
    verdicts = match_blocks(named_pairs(spark, sf_dir), *packed_clips(spark, sf_dir))[0].where("fault IS NULL")
    results = combine_evidence(verdicts.select(*PAIR, F.array(verdict_evidence()).alias("e")), "e")
    folded = fold_evidence(results.select(*PAIR, "decision", "algorithm", "confidence", "summary", "evidence_json"), "evidence_json")
    n = F.get_json_object("evidence_json", "$[0].detail.matched_segment_count").cast("int")
    keys = F.array_join(F.json_object_keys(F.get_json_object("evidence_json", "$[0].detail")), ",")
    same = F.col("decision").eqNullSafe(F.col("folded_decision")) & F.col("algorithm").eqNullSafe(F.col("folded_algorithm")) & F.col("summary").eqNullSafe(F.col("folded_summary"))
    return _round(folded.select(*PAIR, "decision", "algorithm", "confidence", "summary", n.alias("n"), keys.alias("detail_keys"), same.alias("folds_alike")))


def q_similar_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment pairs of named clip pairs with a cosine of 0.9 or more."""
    return _round(pairs_of_blocks(*pairs_with_blocks(spark, sf_dir), 0.9).select(*PAIR, "c", "t", "s"))


def q_coarse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors of all clips; numbers come out singly, so that they can be rounded."""
    t, c = packed_clips(spark, sf_dir)
    both = coarse_of_blocks(t, TARGET).select(F.concat_ws("/", *TARGET).alias("clip"), "n_segments", "coarse").union(coarse_of_blocks(c, CANDIDATE))
    return both.select("clip", "n_segments", F.posexplode("coarse").alias("dim", "value")).withColumn("value", F.round("value", 6))


def q_coarse_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse cosines of the named pairs, and which pass."""
    return _round(screen_blocks(named_pairs(spark, sf_dir), *packed_clips(spark, sf_dir), MatcherConfig()))


def q_segment_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that can't be segments of their clip."""
    frames = table(spark, sf_dir, "index_frames")
    t = segment_faults(frames, TARGET, DIM).select(F.concat_ws("/", *TARGET).alias("clip"), "vec_id", "reason")
    return t.union(segment_faults(frames, CANDIDATE, DIM).select("candidate_id", "vec_id", "reason"))


def q_nearest_with_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate frame's nearest target frame in its named pairs, with the margin to the second."""
    return _round(nearest_in_blocks(*pairs_with_blocks(spark, sf_dir), FrameConfig()))


def q_frame_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of accepted frames."""
    return _round(frame_runs(nearest_in_blocks(*pairs_with_blocks(spark, sf_dir), FrameConfig()), FrameConfig())[0])


def q_frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and status of the named pairs by their frames."""
    return _round(frame_runs(nearest_in_blocks(*pairs_with_blocks(spark, sf_dir), FrameConfig()), FrameConfig())[1])


def q_topk_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every frame whose id is divisible by 100, the 10 nearest of all frames, exactly, with a verdict on each."""
    frames = table(spark, sf_dir, "index_frames").select("vec_id", "embeddings")
    out = search_in_blocks(frames.where("vec_id % 100 = 0"), frames, "vec_id", "embeddings", DIM, 10)
    return out.withColumn("band", similarity_band(F.col("cosine"))).withColumn("hit", F.col("cosine") >= 0.90)


_SEGS = """
ok AS (SELECT *, frame_time_s + coalesce(1 / nullif(sample_fps, 0), 0) AS end_s, list_transform(embeddings, lambda x: cast(x AS DOUBLE)) AS vec FROM index_frames
  WHERE len(embeddings) = 64 AND len(list_filter(embeddings, lambda x: x IS NULL OR isnan(x) OR abs(x) > 3.4e38)) = 0 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0 AND segment_index IS NOT NULL),
ts AS (SELECT target_id, target_version, segment_index AS idx, frame_time_s AS start_s, end_s, vec FROM ok WHERE target_id IS NOT NULL AND target_version IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY target_id, target_version, segment_index ORDER BY vec_id) = 1),
cs AS (SELECT candidate_id, segment_index AS idx, frame_time_s AS start_s, end_s, vec FROM ok WHERE candidate_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY candidate_id, segment_index ORDER BY vec_id) = 1),
named AS (SELECT * FROM (SELECT target_id, target_version, media_evidence_id AS candidate_id FROM jobs UNION SELECT target_id, target_version, candidate_id FROM matched_pairs)
  WHERE target_id IS NOT NULL AND target_version IS NOT NULL AND candidate_id IS NOT NULL),
pairs AS (SELECT n.* FROM named n SEMI JOIN cs c ON n.candidate_id = c.candidate_id WHERE EXISTS (SELECT 1 FROM ts t WHERE t.target_id = n.target_id AND t.target_version = n.target_version)),
td AS (SELECT target_id, target_version, unnest(range(1, 65)) AS dim, unnest(vec) AS x FROM ts),
cd AS (SELECT candidate_id, unnest(range(1, 65)) AS dim, unnest(vec) AS x FROM cs),
tm AS (SELECT target_id, target_version, dim, avg(x) AS x FROM td GROUP BY ALL),
cm AS (SELECT candidate_id, dim, avg(x) AS x FROM cd GROUP BY ALL),
tn AS (SELECT target_id, target_version, count(*) AS n FROM ts GROUP BY ALL),
cn AS (SELECT candidate_id, count(*) AS n FROM cs GROUP BY ALL),
tl AS (SELECT target_id, target_version, sqrt(sum(x * x)) AS len FROM tm GROUP BY ALL),
cl AS (SELECT candidate_id, sqrt(sum(x * x)) AS len FROM cm GROUP BY ALL),
dots AS (SELECT p.target_id, p.target_version, p.candidate_id, sum(t.x * c.x) AS d FROM pairs p JOIN tm t USING (target_id, target_version) JOIN cm c ON c.candidate_id = p.candidate_id AND c.dim = t.dim GROUP BY ALL),
screen AS (SELECT p.target_id, p.target_version, p.candidate_id, coalesce(tn.n, 0) AS total_target, coalesce(cn.n, 0) AS total_candidate,
    CASE WHEN tl.len IS NOT NULL AND cl.len IS NOT NULL THEN CASE WHEN tl.len < 1e-12 OR cl.len < 1e-12 THEN 0 ELSE d / (tl.len * cl.len) END END AS coarse
  FROM named p LEFT JOIN tn USING (target_id, target_version) LEFT JOIN cn USING (candidate_id) LEFT JOIN tl USING (target_id, target_version) LEFT JOIN cl USING (candidate_id)
  LEFT JOIN dots ON dots.target_id = p.target_id AND dots.target_version = p.target_version AND dots.candidate_id = p.candidate_id),
passed AS (SELECT * FROM screen WHERE total_target > 0 AND total_candidate > 0 AND coalesce(coarse >= {coarse}, true))
"""
_SIMS = """,
sims AS (SELECT p.target_id, p.target_version, p.candidate_id, c.idx AS c, t.idx AS t, list_dot_product(t.vec, c.vec) / (sqrt(list_dot_product(t.vec, t.vec)) * sqrt(list_dot_product(c.vec, c.vec))) AS s
  FROM {source} p JOIN ts t USING (target_id, target_version) JOIN cs c USING (candidate_id)),
hits AS (SELECT * FROM sims WHERE s >= 0.9)
"""
_RUNS = """,
offs AS (SELECT target_id, target_version, candidate_id, t - c AS off, count(*) AS n, min(c) AS fc FROM hits GROUP BY ALL),
dom AS (SELECT * FROM offs QUALIFY row_number() OVER (PARTITION BY target_id, target_version, candidate_id ORDER BY n DESC, fc, off) = 1),
best AS (SELECT h.* FROM hits h JOIN dom d ON h.target_id = d.target_id AND h.target_version = d.target_version AND h.candidate_id = d.candidate_id WHERE abs(h.t - h.c - d.off) <= 1
  QUALIFY row_number() OVER (PARTITION BY h.target_id, h.target_version, h.candidate_id, h.c ORDER BY round(h.s, 12) DESC, h.t) = 1),
lagged AS (SELECT *, lag(c) OVER w AS pc, lag(t) OVER w AS pt FROM best WINDOW w AS (PARTITION BY target_id, target_version, candidate_id ORDER BY c)),
runs AS (SELECT *, sum(CASE WHEN pc IS NULL OR c - pc > 2 OR t < pt THEN 1 ELSE 0 END) OVER (PARTITION BY target_id, target_version, candidate_id ORDER BY c ROWS UNBOUNDED PRECEDING) AS run FROM lagged),
agg AS (SELECT target_id, target_version, candidate_id, run, count(*) AS n, avg(s) AS mean, min(c) AS c0, max(c) AS c1, min(t) AS t0, max(t) AS t1 FROM runs GROUP BY ALL),
pick AS (SELECT * FROM agg QUALIFY row_number() OVER (PARTITION BY target_id, target_version, candidate_id ORDER BY n DESC, run) = 1)
"""


def _with(coarse: float = 0.6, source: str | None = None, runs: bool = False) -> str:
    return "WITH " + _SEGS.format(coarse=coarse) + (_SIMS.format(source=source) if source else "") + (_RUNS if runs else "")


_VERDICT = """
SELECT s.target_id, s.target_version, s.candidate_id, coalesce(n >= 3 AND mean >= 0.9, false) AS matched, round(coalesce(mean, 0), 6) AS score,
  round(least(ce.end_s - cb.start_s, te.end_s - tb.start_s), 6) AS matched_duration_s, round(tb.start_s, 6) AS target_start, round(te.end_s, 6) AS target_end,
  round(cb.start_s, 6) AS candidate_start, round(ce.end_s, 6) AS candidate_end, coalesce(n, 0) AS matched_segment_count, total_target AS total_target_segments,
  total_candidate AS total_candidate_segments, round(tb.start_s - cb.start_s, 6) AS temporal_offset_s, round(mean, 6) AS mean_similarity, round(coarse, 6) AS coarse_similarity,
  CASE WHEN total_target = 0 THEN 'no target' WHEN total_candidate = 0 THEN 'no candidate' END AS fault
FROM screen s LEFT JOIN pick p ON s.target_id = p.target_id AND s.target_version = p.target_version AND s.candidate_id = p.candidate_id
LEFT JOIN ts tb ON tb.target_id = s.target_id AND tb.target_version = s.target_version AND tb.idx = p.t0
LEFT JOIN ts te ON te.target_id = s.target_id AND te.target_version = s.target_version AND te.idx = p.t1
LEFT JOIN cs cb ON cb.candidate_id = s.candidate_id AND cb.idx = p.c0 LEFT JOIN cs ce ON ce.candidate_id = s.candidate_id AND ce.idx = p.c1
"""
_NEAREST = _with(source="pairs") + """,
two AS (SELECT *, row_number() OVER (PARTITION BY target_id, target_version, candidate_id, c ORDER BY round(s, 12) DESC, t) AS r FROM sims),
near AS (SELECT a.target_id, a.target_version, a.candidate_id, a.c, a.t, a.s AS cosine, a.s - coalesce(b.s, 0) AS margin, 1 / (1 + sqrt(greatest(0, 2 - 2 * a.s))) AS l2_score
  FROM two a LEFT JOIN two b ON a.target_id = b.target_id AND a.target_version = b.target_version AND a.candidate_id = b.candidate_id AND a.c = b.c AND b.r = 2 WHERE a.r = 1),
acc AS (SELECT *, cosine >= 0.93 AND l2_score >= 0.70 AND margin >= 0.03 AS accepted FROM near)
"""
_FRAME_RUNS = _NEAREST + """,
fl AS (SELECT *, lag(accepted) OVER w AS pa, lag(t) OVER w AS pt FROM acc WINDOW w AS (PARTITION BY target_id, target_version, candidate_id ORDER BY c)),
fr AS (SELECT *, sum(CASE WHEN pa IS NULL OR NOT pa OR t - pt < 0 OR t - pt > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY target_id, target_version, candidate_id ORDER BY c ROWS UNBOUNDED PRECEDING) AS run FROM fl),
fg AS (SELECT target_id, target_version, candidate_id, run, min(c) AS start_candidate_index, max(c) AS end_candidate_index, min(t) AS start_target_index, max(t) AS end_target_index,
  count(*) AS length, avg(cosine) AS avg_cosine, avg(l2_score) AS avg_l2_score, avg(margin) AS avg_margin FROM fr WHERE accepted GROUP BY ALL)
"""
_K = "target_id, target_version, candidate_id"

QUERIES = {
    "temporal_match": q_temporal_match, "temporal_match_unscreened": q_temporal_match_unscreened, "matched_segments": q_matched_segments, "match_evidence": q_match_evidence, "similar_segments": q_similar_segments,
    "coarse_vectors": q_coarse_vectors, "coarse_screen": q_coarse_screen, "segment_faults": q_segment_faults, "nearest_with_margin": q_nearest_with_margin,
    "frame_runs": q_frame_runs, "frame_scores": q_frame_scores, "topk_retrieval": q_topk_retrieval,
}
ORACLES = {
    "temporal_match": _with(source="passed", runs=True) + _VERDICT,
    "temporal_match_unscreened": _with(coarse=-1, source="passed", runs=True) + _VERDICT,
    "matched_segments": _with(source="passed", runs=True) + f"""SELECT r.target_id, r.target_version, r.candidate_id, t AS target_segment_index, c AS candidate_segment_index, round(s, 6) AS similarity
      FROM runs r JOIN pick p ON r.target_id = p.target_id AND r.target_version = p.target_version AND r.candidate_id = p.candidate_id AND r.run = p.run""",
    "match_evidence": f"""SELECT {_K}, CASE WHEN matched THEN 'match' ELSE 'no_match' END AS decision, 'dinov2' AS algorithm, score AS confidence,
      'dinov2=' || CASE WHEN matched THEN 'match' ELSE 'no_match' END || printf(' (score=%.4f)', exact) AS summary, matched_segment_count AS n,
      'candidate_end,candidate_start,coarse_similarity,matched_duration_s,matched_segment_count,mean_similarity,target_end,target_start,temporal_offset_s,total_candidate_segments,total_target_segments' AS detail_keys, true AS folds_alike
      FROM ({_with(source="passed", runs=True) + _VERDICT.replace("AS score,", "AS score, coalesce(mean, 0) AS exact,")}) WHERE fault IS NULL""",
    "similar_segments": _with(source="pairs") + f"SELECT {_K}, c, t, round(s, 6) AS s FROM hits",
    "coarse_vectors": _with() + """SELECT target_id || '/' || target_version AS clip, n AS n_segments, cast(dim - 1 AS INTEGER) AS dim, round(x / CASE WHEN len > 0 THEN len ELSE 1 END, 6) AS value
      FROM tm JOIN tl USING (target_id, target_version) JOIN tn USING (target_id, target_version)
      UNION ALL SELECT candidate_id, n, cast(dim - 1 AS INTEGER), round(x / CASE WHEN len > 0 THEN len ELSE 1 END, 6) FROM cm JOIN cl USING (candidate_id) JOIN cn USING (candidate_id)""",
    "coarse_screen": _with() + f"""SELECT {_K}, total_target, total_candidate, round(coarse, 6) AS coarse,
      total_target > 0 AND total_candidate > 0 AND coalesce(coarse >= 0.6, true) AS passed FROM screen""",
    "segment_faults": """
      WITH f AS (SELECT *, coalesce(len(embeddings) = 64 AND len(list_filter(embeddings, lambda x: x IS NULL OR isnan(x) OR abs(x) > 3.4e38)) = 0 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0, false) AS ok FROM index_frames),
      u AS (SELECT target_id || '/' || target_version AS clip, * FROM f WHERE target_id IS NOT NULL AND target_version IS NOT NULL UNION ALL SELECT candidate_id, * FROM f WHERE candidate_id IS NOT NULL),
      r AS (SELECT clip, vec_id, CASE WHEN segment_index IS NULL THEN 'no index' WHEN embeddings IS NULL THEN 'no vector' WHEN len(embeddings) <> 64 THEN 'wrong length'
        WHEN len(list_filter(embeddings, lambda x: x IS NULL OR isnan(x) OR abs(x) > 3.4e38)) > 0 THEN 'not a number' WHEN NOT ok THEN 'zero vector'
        WHEN row_number() OVER (PARTITION BY clip, segment_index ORDER BY ok DESC, vec_id) > 1 THEN 'index repeated' END AS reason FROM u)
      SELECT * FROM r WHERE reason IS NOT NULL""",
    "nearest_with_margin": _NEAREST + f"SELECT {_K}, c, t, round(cosine, 6) AS cosine, round(margin, 6) AS margin, round(l2_score, 6) AS l2_score, accepted FROM acc",
    "frame_runs": _FRAME_RUNS + f"""SELECT {_K}, start_candidate_index, end_candidate_index, start_target_index, end_target_index, length,
      round(avg_cosine, 6) AS avg_cosine, round(avg_l2_score, 6) AS avg_l2_score, round(avg_margin, 6) AS avg_margin, 1.0 AS temporal_consistency FROM fg""",
    "frame_scores": _FRAME_RUNS + f""",
      whole AS (SELECT {_K}, count(*) AS n, avg(CASE WHEN accepted THEN 1.0 ELSE 0.0 END) AS ratio, avg(cosine) AS cos FROM acc GROUP BY ALL),
      top AS (SELECT * FROM fg QUALIFY row_number() OVER (PARTITION BY {_K} ORDER BY length DESC, round(avg_cosine, 9) DESC, start_candidate_index) = 1),
      sc AS (SELECT w.target_id, w.target_version, w.candidate_id, ratio, cos, coalesce(length, 0) AS length, coalesce(length, 0) / n AS coverage, coalesce(length >= 6 AND avg_cosine >= 0.94, false) AS qualifies,
        CASE WHEN length IS NULL THEN 0.6 * ratio + 0.4 * cos ELSE 0.45 * avg_cosine + 0.2 * avg_l2_score + 0.1 * avg_margin + 0.15 * length / n + 0.1 END AS score,
        CASE WHEN length IS NULL THEN 0.0 ELSE 0.55 * avg_cosine + 0.2 * avg_l2_score + 0.15 + 0.1 * length / n END AS temporal
        FROM whole w LEFT JOIN top t ON w.target_id = t.target_id AND w.target_version = t.target_version AND w.candidate_id = t.candidate_id),
      cl2 AS (SELECT *, greatest(0, least(1, score)) AS score1, greatest(0, least(1, temporal)) AS temporal1 FROM sc),
      fin AS (SELECT *, greatest(0, least(1, 0.5 * score1 + 0.3 * temporal1 + 0.2 * ratio)) AS final FROM cl2)
      SELECT {_K}, round(ratio, 6) AS accepted_ratio, round(cos, 6) AS mean_cosine, length AS best_length, round(coverage, 6) AS coverage, qualifies, round(score1, 6) AS score,
        round(temporal1, 6) AS temporal_score, round(final, 6) AS final_score,
        CASE WHEN qualifies AND final >= 0.8 THEN 'matched' WHEN final <= 0.45 THEN 'no_match_pending_review' ELSE 'uncertain_manual_review' END AS status FROM fin""",
    "topk_retrieval": """
      WITH ok AS (SELECT vec_id, list_transform(embeddings, lambda x: cast(x AS DOUBLE)) AS v FROM index_frames
        WHERE len(embeddings) = 64 AND len(list_filter(embeddings, lambda x: x IS NULL OR isnan(x) OR abs(x) > 3.4e38)) = 0 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0),
      n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS len FROM ok),
      p AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, round(list_dot_product(q.v, d.v) / (q.len * d.len), 6) AS cosine FROM n q JOIN n d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
      k AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS INTEGER) AS pos FROM p)
      SELECT query_id, vec_id, cosine, pos, CASE WHEN cosine > 0.95 THEN 'nearly identical' WHEN cosine > 0.9 THEN 'very similar' WHEN cosine > 0.8 THEN 'similar'
        WHEN cosine > 0.7 THEN 'somewhat similar' WHEN cosine > 0.5 THEN 'weakly similar' ELSE 'different' END AS band, cosine >= 0.9 AS hit FROM k WHERE pos <= 10""",
}
