"""Where a candidate clip overlaps a target clip: similar segments, dominant offset, and the longest run in step."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediasift.functions.vectors import cosine
from mediasift.operators.segments import blocks, coarse_of_blocks
from mediasift.session import cut


@dataclass(frozen=True)
class MatcherConfig:
    segment_similarity: float = 0.90
    coarse_similarity: float = 0.60
    min_segments: int = 3
    offset_tolerance: int = 1
    max_gap: int = 2


TARGET = ["target_id", "target_version"]
CANDIDATE = ["candidate_id"]
PAIR = [*TARGET, *CANDIDATE]
TIMES = ["c_start", "c_end", "t_start", "t_end"]


#: Pairs of a target that meet its blocks in one task: a target with more is spread over several.
PAIRS_A_TASK = 1024
#: Crowded targets that are sent to all executors; more of them are joined.
SENT = 100_000


def _sides(b: pa.RecordBatch) -> Iterator[tuple]:
    """Per row of a batch both sides' numbers, starts, ends and unit vectors. Below a length of 1e-12 a vector has cosine 0 with any."""
    columns = [{c: b.column(f"{side}_{c}") for c in ("idxs", "starts", "ends", "flat")} for side in "tc"]
    for i in range(b.num_rows):
        out = []
        for side in columns:
            idx, start, end, flat = (side[k][i].values.to_numpy(zero_copy_only=False) for k in side)
            v = flat.astype("f8").reshape(len(idx), -1)
            out.append((idx, start, end, v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)))
        if out[0][3].shape[1] != out[1][3].shape[1]:
            raise ValueError(f"vectors of {out[0][3].shape[1]} and of {out[1][3].shape[1]} numbers can't be compared")
        yield i, *out


def _multiply(threshold: float | None, best: int | None = None):
    """Blocks of both sides to segment pairs with their cosine and times: one matrix product a row. With `best`, of each candidate segment only that many
    targets, the most similar ones (to 12 places, of equal ones the first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[list] = [[] for _ in range(8)]
            for i, (ti, t0, t1, t), (ci, c0, c1, c) in _sides(b):
                sim = c @ t.T
                if best is not None:
                    y = np.argsort(-np.round(sim, 12), axis=1, kind="stable")[:, :best]
                    x = np.repeat(np.arange(len(ci)), y.shape[1])
                    y = y.ravel()
                elif threshold is not None:
                    x, y = np.nonzero(sim >= threshold)
                else:
                    x, y = np.indices(sim.shape).reshape(2, -1)
                for to, new in zip(parts, (np.full(len(x), i), ci[x], ti[y], sim[x, y], c0[x], c1[x], t0[y], t1[y])):
                    to.append(new)
            if not parts[0]:
                continue
            row, c, t, s, *times = map(np.concatenate, parts)
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pick) for k in PAIR), pa.array(c.astype("i4")), pa.array(t.astype("i4")), pa.array(s), *map(pa.array, times)], [*PAIR, "c", "t", "s", *TIMES])

    return run


def spread_targets(pairs: DataFrame, targets: DataFrame, most: int = PAIRS_A_TASK) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and the columns to join them by: where some target has more than `most` pairs, these get a salt, and that target's rows are there once per
    salt. Otherwise both stay as they are. `pairs` is read twice; no pair is lost or doubled."""
    crowded = cut(pairs.groupBy(*TARGET).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).withColumn("_n", F.ceil(F.col("_n") / most).cast("int")))
    n = crowded.count()
    if not n:
        return pairs, targets, TARGET
    few = F.broadcast(crowded) if n <= SENT else crowded
    salted = pairs.join(few, TARGET, "left").withColumn("_salt", F.pmod(F.xxhash64(*CANDIDATE), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    copies = targets.join(few, TARGET, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    return salted, copies, [*TARGET, "_salt"]


def pairs_of_blocks(pairs: DataFrame, target_blocks: DataFrame, candidate_blocks: DataFrame, threshold: float | None, best: int | None = None, most: int = PAIRS_A_TASK) -> DataFrame:
    """`segment_pairs` of clips that are packed into `blocks`. `pairs` is read more than once: cut it if it is costly."""
    side = lambda b, key, name: b.select(*key, *(F.col(v).alias(f"{name}_{v}") for v in ("idxs", "starts", "ends", "flat")))
    named, t, on = spread_targets(pairs, side(target_blocks, TARGET, "t"), most)
    both = named.join(side(candidate_blocks, CANDIDATE, "c"), CANDIDATE).join(t, on)
    times = ", ".join(f"{x} double" for x in TIMES)
    return both.select(*PAIR, *(f"{s}_{v}" for s in "tc" for v in ("idxs", "starts", "ends", "flat"))).mapInArrow(_multiply(threshold, best), f"target_id string, target_version string, candidate_id string, c int, t int, s double, {times}")


def segment_pairs(pairs: DataFrame, target_segments: DataFrame, candidate_segments: DataFrame, threshold: float | None) -> DataFrame:
    """Segment pairs (`c`, `t`, cosine `s`, and when each starts and ends) of the clip pairs (`target_id`, `target_version`, `candidate_id`) with a cosine of at least the threshold; all without one."""
    return pairs_of_blocks(pairs, blocks(target_segments, TARGET), blocks(candidate_segments, CANDIDATE), threshold)


def screen_blocks(pairs: DataFrame, target_blocks: DataFrame, candidate_blocks: DataFrame, cfg: MatcherConfig) -> DataFrame:
    """The pairs with `total_target`, `total_candidate`, `coarse` (null if a side is empty) and `passed`: coarse cosines decide
    before any segments meet. A pair whose target or candidate has no segments stays, with 0 of them."""
    t = coarse_of_blocks(target_blocks, TARGET).select(*TARGET, F.col("n_segments").alias("total_target"), F.col("coarse").alias("tv"))
    c = coarse_of_blocks(candidate_blocks, CANDIDATE).select(*CANDIDATE, F.col("n_segments").alias("total_candidate"), F.col("coarse").alias("cv"))
    out = pairs.join(t, TARGET, "left").join(c, CANDIDATE, "left").fillna(0, ["total_target", "total_candidate"])
    out = out.withColumn("coarse", F.when(F.col("tv").isNotNull() & F.col("cv").isNotNull(), cosine(F.col("tv"), F.col("cv"))))
    there = (F.col("total_target") > 0) & (F.col("total_candidate") > 0)
    return out.select(*PAIR, "total_target", "total_candidate", "coarse", (there & F.coalesce(F.col("coarse") >= cfg.coarse_similarity, F.lit(True))).alias("passed"))


def coarse_screen(pairs: DataFrame, target_segments: DataFrame, candidate_segments: DataFrame, dim: int, cfg: MatcherConfig) -> DataFrame:
    """`screen_blocks` of rows of segments."""
    return screen_blocks(pairs, blocks(target_segments, TARGET), blocks(candidate_segments, CANDIDATE), cfg)


def best_runs(hits: DataFrame, cfg: MatcherConfig) -> DataFrame:
    """The rows of each pair's longest run in step: hits near the dominant offset, the best target of each candidate segment, broken where
    the candidate index jumps more than the gap allows or the target index falls.

    Ties: of offsets hit equally often that with the first candidate segment, then the smaller; of targets equally similar the first; of
    runs equally long the first.
    """
    # windows on one shuffle by pair, as a join with the counts would make all hits twice
    of_pair, of_offset = Window.partitionBy(*PAIR), Window.partitionBy(*PAIR, "off")
    counted = hits.withColumn("off", F.col("t") - F.col("c")).withColumn("rank", F.struct(F.count(F.lit(1)).over(of_offset).alias("n"), (-F.min("c").over(of_offset)).alias("c"), (-F.col("off")).alias("off")))
    near = counted.withColumn("off", -F.max("rank").over(of_pair)["off"]).where(F.abs(F.col("t") - F.col("c") - F.col("off")) <= cfg.offset_tolerance)
    best = near.withColumn("r", F.row_number().over(Window.partitionBy(*PAIR, "c").orderBy(F.desc(F.round("s", 12)), "t"))).where("r = 1")
    w = of_pair.orderBy("c")
    broken = F.lag("c").over(w).isNull() | (F.col("c") - F.lag("c").over(w) > cfg.max_gap) | (F.col("t") < F.lag("t").over(w))
    runs = best.select(*PAIR, "c", "t", "s", *TIMES, broken.cast("int").alias("b")).withColumn("run", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sized = runs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*PAIR, "run")))
    first = sized.withColumn("best", F.max(F.struct("n", (-F.col("run")).alias("run"))).over(of_pair))
    return first.where((F.col("n") == F.col("best.n")) & (F.col("run") == -F.col("best.run"))).select(*PAIR, "c", "t", "s", *TIMES)


def match_blocks(pairs: DataFrame, target_blocks: DataFrame, candidate_blocks: DataFrame, cfg: MatcherConfig = MatcherConfig()) -> tuple[DataFrame, DataFrame]:
    """The verdict of each pair, and the segment pairs of its best run.

    A pair without hits, with an empty side, or that fails the coarse screen isn't matched, has score 0 and no localisation. A run
    too short is reported but isn't a match. `fault` tells which side has no segments, the target first; a pair with a fault is no verdict but an error.
    """
    # cut, as it is read several times: one short row a pair
    screened = cut(screen_blocks(pairs.select(*PAIR).dropna().distinct(), target_blocks, candidate_blocks, cfg))
    hits = pairs_of_blocks(screened.where("passed").select(*PAIR), target_blocks, candidate_blocks, cfg.segment_similarity)
    rows = best_runs(hits, cfg)
    folded = rows.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean"), F.min_by("t_start", "t").alias("target_start"), F.max_by("t_end", "t").alias("target_end"),
        F.min_by("c_start", "c").alias("candidate_start"), F.max_by("c_end", "c").alias("candidate_end"),
    )
    out = screened.join(folded, PAIR, "left").select(
        *PAIR,
        F.coalesce((F.col("n") >= cfg.min_segments) & (F.col("mean") >= cfg.segment_similarity), F.lit(False)).alias("matched"),
        F.coalesce("mean", F.lit(0.0)).alias("score"),
        F.least(F.col("candidate_end") - F.col("candidate_start"), F.col("target_end") - F.col("target_start")).alias("matched_duration_s"),
        "target_start", "target_end", "candidate_start", "candidate_end",
        F.coalesce("n", F.lit(0)).alias("matched_segment_count"), F.col("total_target").alias("total_target_segments"), F.col("total_candidate").alias("total_candidate_segments"),
        (F.col("target_start") - F.col("candidate_start")).alias("temporal_offset_s"), F.col("mean").alias("mean_similarity"), F.col("coarse").alias("coarse_similarity"),
        F.when(F.col("total_target") == 0, "no target").when(F.col("total_candidate") == 0, "no candidate").alias("fault"),
    )
    return out, rows


def temporal_match(pairs: DataFrame, target_segments: DataFrame, candidate_segments: DataFrame, dim: int, cfg: MatcherConfig = MatcherConfig()) -> tuple[DataFrame, DataFrame]:
    """`match_blocks` of rows of segments."""
    return match_blocks(pairs, cut(blocks(target_segments, TARGET)), cut(blocks(candidate_segments, CANDIDATE)), cfg)


#: What a verdict's evidence tells beside the score, by name.
DETAIL = [
    "matched_duration_s", "target_start", "target_end", "candidate_start", "candidate_end", "matched_segment_count", "total_target_segments", "total_candidate_segments",
    "temporal_offset_s", "mean_similarity", "coarse_similarity",
]


def verdict_evidence(technique: str = "dinov2", version: str = "temporal_v1") -> Column:
    """A row of verdicts as one piece of evidence, for `combine_evidence`: technique, version, matched, score and the detail by name."""
    return F.struct(F.lit(technique).alias("technique"), F.lit(version).alias("matcher_version"), "matched", "score", F.struct(*DETAIL).alias("detail"))
