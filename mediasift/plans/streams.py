"""Queries that run as streams over all files that are there, to their end, and give what the sink then holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.operators.fusion import STAGES, duration_similarity, stage_scores, weighted_score
from mediasift.operators.temporal_match import CANDIDATE, PAIR, TARGET
from mediasift.plans.alignment import ORACLES as ALIGNMENT
from mediasift.plans.alignment import _sides, audio, video
from mediasift.plans.matching import _SEGS, _round, clips
from mediasift.plans.records import ORACLES as RECORDS
from mediasift.session import scratch
from mediasift.streaming.dedup import stream_of
from mediasift.streaming.records import split_sink, windowed_counts


def q_stream_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed jobs by where they went and why."""
    folder = scratch(spark, "jobs")
    split_sink(stream_of(spark, f"{sf_dir}/jobs.parquet"), folder).awaitTermination()
    return spark.read.option("recursiveFileLookup", "false").parquet(folder).groupBy("sink", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


def q_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results per day and decision, as a stream writes them: each window once, when the watermark, a day behind the newest row, has passed its end. What arrives later than that
    doesn't count, and the windows that are still open at the end aren't written."""
    folder = scratch(spark, "counts")
    stream = stream_of(spark, f"{sf_dir}/result_records.parquet").withColumn("at", F.col("received_at").cast("timestamp"))
    counts = windowed_counts(stream, "at", ["decision"], "1 day", "1 day", {"best": F.max(F.when(F.col("confidence").between(0, 1), F.col("confidence")))})

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    counts.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(folder).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "decision", "n", F.round("best", 6).alias("best"))


def q_fused_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score of each named pair: stages of lengths, digests, sound and their agreement, by their weights. Resolutions and words aren't known here: 0."""
    pairs, t, c = _sides(spark, sf_dir)
    whole = lambda s, clip, name: s.groupBy(*clip).agg((F.max("end_s") - F.min("start_s")).alias(name))
    ts, cs = clips(spark, sf_dir)
    x = pairs.join(whole(ts, TARGET, "tl"), TARGET).join(whole(cs, CANDIDATE, "cl"), CANDIDATE)
    for name, found in (("video", video(pairs, t, c)), ("audio", audio(pairs, t, c))):
        x = x.join(found.select(*PAIR, F.round("similarity", 6).alias(name), F.col("offset_s").alias(f"{name}_s")), PAIR)
    lengths = duration_similarity(F.col("cl"), F.col("tl"))
    stages = stage_scores(F.col("video"), F.col("audio"), F.col("video_s"), F.col("audio_s"), lengths, F.lit(0.0), F.lit(0.0), 1.0)
    score = weighted_score({k: (v, STAGES[k]) for k, v in stages.items()})
    return _round(x.select(*PAIR, lengths.alias("length_similarity"), stages["temporal"].alias("temporal"), F.round(score, 9).alias("score")))  # to 9 places first: halves of the sixth are decided by the last bit else


QUERIES = {"stream_parse": q_stream_parse, "stream_counts": q_stream_counts, "fused_scores": q_fused_scores}
ORACLES = {
    "stream_parse": f"SELECT CASE WHEN reject_reason IS NULL THEN 'good' ELSE 'rejected' END AS sink, reject_reason, count(*) AS n FROM ({RECORDS['job_parse']}) GROUP BY ALL",
    "stream_counts": """SELECT strftime(received_at, '%Y-%m-%d') AS day, decision, count(*) AS n, round(max(CASE WHEN confidence >= 0 AND confidence <= 1 AND NOT isnan(confidence) THEN confidence END), 6) AS best
      FROM result_records WHERE received_at IS NOT NULL GROUP BY ALL
      -- one micro-batch reads the whole table here; closed are the days that end a day before its newest row, at the latest
      HAVING max(date_trunc('day', received_at)) + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(received_at)) - INTERVAL 1 DAY FROM result_records)""",
    "fused_scores": f"""
      WITH v AS ({ALIGNMENT["coverage_video"]}), a AS ({ALIGNMENT["coverage_audio"]}), {_SEGS.format(coarse=0.6).strip()},
      tw AS (SELECT target_id, target_version, max(end_s) - min(start_s) AS tl FROM ts GROUP BY ALL), cw AS (SELECT candidate_id, max(end_s) - min(start_s) AS cl FROM cs GROUP BY ALL),
      x AS (SELECT v.target_id, v.target_version, v.candidate_id, v.similarity AS vs, v.offset_s AS vo, a.similarity AS aus, a.offset_s AS ao,
          CASE WHEN NOT coalesce(tw.tl > 0 AND cw.cl > 0, false) THEN 0.0 WHEN cw.cl <= tw.tl THEN 0.5 + 0.5 * cw.cl / tw.tl ELSE tw.tl / cw.cl END AS d
        FROM v JOIN a ON v.target_id = a.target_id AND v.target_version = a.target_version AND v.candidate_id = a.candidate_id
        JOIN tw ON tw.target_id = v.target_id AND tw.target_version = v.target_version JOIN cw ON cw.candidate_id = v.candidate_id),
      s AS (SELECT *, greatest(0, least(1, 0.25 * d + 0.45 * vs + 0.2 * aus + 0.1 * greatest(0, 1 - abs(vo - ao) / 10))) AS temporal FROM x)
      SELECT target_id, target_version, candidate_id, round(d, 6) AS length_similarity, round(temporal, 6) AS temporal, round(0.2 * 0.7 * d + 0.3 * 0.7 * vs + 0.25 * aus + 0.25 * temporal, 6) AS score FROM s""",
}
