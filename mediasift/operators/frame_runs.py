"""Matching by frames: nearest target frame with a margin, runs of accepted frames, and scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediasift.functions.vectors import clip01, l2_score
from mediasift.operators.segments import blocks
from mediasift.operators.temporal_match import CANDIDATE, PAIR, TARGET, pairs_of_blocks


@dataclass(frozen=True)
class FrameConfig:
    cosine: float = 0.93
    l2_score: float = 0.70
    margin: float = 0.03
    min_run: int = 6
    max_step: int = 3
    min_run_cosine: float = 0.94
    low: float = 0.45
    high: float = 0.80


def nearest_in_blocks(pairs: DataFrame, target_blocks: DataFrame, candidate_blocks: DataFrame, cfg: FrameConfig) -> DataFrame:
    """Per pair and candidate frame `c`: the most similar target frame `t` (the first of equals), `cosine`, `margin` to the second (to 0 if the target has one frame), `l2_score`, `accepted`.

    A pair of blocks gives two target frames for each candidate frame; those of several blocks are ranked again."""
    two = pairs_of_blocks(pairs, target_blocks, candidate_blocks, None, best=2)
    near = two.groupBy(*PAIR, "c").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.round("s", 12)).alias("o"), "t", "s"))), 1, 2).alias("_n"))
    first, second = F.col("_n")[0], F.try_element_at("_n", F.lit(2))
    near = near.select(*PAIR, "c", first["t"].alias("t"), first["s"].alias("cosine"), (first["s"] - F.coalesce(second["s"], F.lit(0.0))).alias("margin"), l2_score(first["s"]).alias("l2_score"))
    return near.withColumn("accepted", (F.col("cosine") >= cfg.cosine) & (F.col("l2_score") >= cfg.l2_score) & (F.col("margin") >= cfg.margin))


def nearest_with_margin(pairs: DataFrame, target_segments: DataFrame, candidate_segments: DataFrame, cfg: FrameConfig) -> DataFrame:
    """`nearest_in_blocks` of rows of segments."""
    return nearest_in_blocks(pairs, blocks(target_segments, TARGET), blocks(candidate_segments, CANDIDATE), cfg)


def frame_runs(near: DataFrame, cfg: FrameConfig) -> tuple[DataFrame, DataFrame]:
    """Runs of accepted frames whose target frames advance by 0 to `max_step`, and the score of each pair by its best run (longest, then most similar, then first)."""
    w = Window.partitionBy(*PAIR).orderBy("c")
    step = F.col("t") - F.lag("t").over(w)
    new = F.lag("accepted").over(w).isNull() | ~F.lag("accepted").over(w) | (step < 0) | (step > cfg.max_step)
    numbered = near.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.where("accepted").groupBy(*PAIR, "run").agg(
        F.min("c").alias("start_candidate_index"), F.max("c").alias("end_candidate_index"), F.min("t").alias("start_target_index"), F.max("t").alias("end_target_index"),
        F.count(F.lit(1)).alias("length"), F.avg("cosine").alias("avg_cosine"), F.avg("l2_score").alias("avg_l2_score"), F.avg("margin").alias("avg_margin"),
    ).withColumn("temporal_consistency", F.lit(1.0)).drop("run")
    best = Window.partitionBy(*PAIR).orderBy(F.desc("length"), F.desc(F.round("avg_cosine", 9)), "start_candidate_index")
    top = runs.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*PAIR, "length", "avg_cosine", "avg_l2_score", "avg_margin", "temporal_consistency")
    whole = near.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("accepted").cast("double")).alias("accepted_ratio"), F.avg("cosine").alias("mean_cosine"))
    x = whole.join(top, PAIR, "left")
    coverage = F.coalesce(F.col("length"), F.lit(0)) / F.col("n")
    alone = 0.60 * F.col("accepted_ratio") + 0.40 * F.col("mean_cosine")
    by_run = 0.45 * F.col("avg_cosine") + 0.20 * F.col("avg_l2_score") + 0.10 * F.col("avg_margin") + 0.15 * coverage + 0.10 * F.col("temporal_consistency")
    in_time = 0.55 * F.col("avg_cosine") + 0.20 * F.col("avg_l2_score") + 0.15 * F.col("temporal_consistency") + 0.10 * coverage
    x = x.select(
        *PAIR, "accepted_ratio", "mean_cosine", F.coalesce("length", F.lit(0)).alias("best_length"), coverage.alias("coverage"),
        F.coalesce((F.col("length") >= cfg.min_run) & (F.col("avg_cosine") >= cfg.min_run_cosine), F.lit(False)).alias("qualifies"),
        clip01(F.coalesce(by_run, alone)).alias("score"), clip01(F.coalesce(in_time, F.lit(0.0))).alias("temporal_score"),
    )
    x = x.withColumn("final_score", clip01(0.5 * F.col("score") + 0.3 * F.col("temporal_score") + 0.2 * F.col("accepted_ratio")))
    status = F.when(F.col("qualifies") & (F.col("final_score") >= max(cfg.high, 0.80)), "matched").when(F.col("final_score") <= cfg.low, "no_match_pending_review").otherwise("uncertain_manual_review")
    return runs, x.withColumn("status", status)
