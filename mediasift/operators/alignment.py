"""Aligning two sequences of segments: sliding coverage, energy correlation, verification near a place, and dynamic time warping.

A place of the candidate within the target is a diagonal of the table of segment pairs. So clips stay rows of segments; those of a pair meet, and every diagonal is one sum,
added up before it is shuffled: however long a clip is, no task holds it whole. Only warping, where each step needs the one before, takes a pair of clips as arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediasift.operators.temporal_match import CANDIDATE, PAIR, TARGET, spread_targets

#: From this share of equal bits on two segments match.
MATCH = 0.80
#: A curve with less length than this about its mean is flat.
FLAT = 1e-8


def placed(segs: DataFrame, clip: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """`clip` columns, `p` (place in order of `idx`, from 0), `n` (length of the clip) and the values."""
    whole = Window.partitionBy(*clip)
    return segs.select(*clip, (F.row_number().over(whole.orderBy("idx")) - 1).alias("p"), F.count(F.lit(1)).over(whole).cast("int").alias("n"), *(v.alias(k) for k, v in values.items()))


def placed_sides(rows: DataFrame, key: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """`placed` of rows that hold all clips of both sides (`clip_rows`), under `key`: of a segment saved more than once the row with the smallest `_id` counts. One shuffle."""
    clip = Window.partitionBy(*key)
    rows = rows.repartition(*key).withColumn("_was", F.lag("idx").over(clip.orderBy("idx", "_id"))).where("_was IS NULL OR _was <> idx")
    return placed(rows, key, values)


def about_mean(rows: DataFrame, clip: Sequence[str], value: str) -> DataFrame:
    """rows with `value` about the clip's mean, and `length`, the length of the clip's curve then."""
    whole = Window.partitionBy(*clip)
    moved = rows.withColumn(value, F.col(value) - F.avg(value).over(whole))
    return moved.withColumn("length", F.sqrt(F.sum(F.col(value) * F.col(value)).over(whole)))


def digest_similarity(a: Column, b: Column) -> Column:
    """Share of equal bits of two 64-bit digests; 0 where one is null."""
    return F.coalesce(1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0), F.lit(0.0))


def sound_similarity(t: Callable[[str], Column], c: Callable[[str], Column]) -> Column:
    """By loudness (`rms`) and zero crossings (`zcr`), and mostly by the digest (`bits`) where both have one."""
    apart = 0.65 * F.abs(t("rms") - c("rms")) + 0.35 * F.abs(t("zcr") - c("zcr"))
    feature = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - apart))
    both = t("bits").isNotNull() & c("bits").isNotNull()
    return F.when(both, 0.80 * digest_similarity(t("bits"), c("bits")) + 0.20 * feature).otherwise(feature)


def of_target(name: str) -> Column:
    return F.col(f"t_{name}")


def of_candidate(name: str) -> Column:
    return F.col(f"c_{name}")


def meetings(pairs: DataFrame, targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each segment pair of the clip pairs: PAIR, and all other columns of either side as `t_...` and `c_...`. `pairs` is read more than once."""
    side = lambda rows, clip, name: rows.select(*clip, *(F.col(v).alias(f"{name}_{v}") for v in rows.columns if v not in clip))
    named, t, on = spread_targets(pairs, side(targets, TARGET, "t"))
    return named.join(side(candidates, CANDIDATE, "c"), CANDIDATE).join(t, on)


def diagonals(met: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
    """PAIR, `start`, `m` and the aggregates of every place where the whole candidate lies within the target."""
    start = F.col("t_p") - F.col("c_p")
    inside = met.where(start.between(0, F.col("t_n") - F.col("c_n")))
    return inside.groupBy(*PAIR, start.alias("start")).agg(F.first("c_n").alias("m"), *(v.alias(k) for k, v in sums.items()))


def best_place(pairs: DataFrame, targets: DataFrame, candidates: DataFrame, places: DataFrame, worth: Column, similarity: Column, detail: Column, segment_s: float) -> DataFrame:
    """Of each pair the place of most worth (to 12 places; the first of equals): `similarity`, `target_start_index`, `target_end_index`, `offset_s`, `detail`. A candidate longer than its
    target, and one without a place, has 0 in all; a pair of which a side has no segments gives no row."""
    top = F.max(F.struct(F.round(worth, 12).alias("w"), (-F.col("start")).alias("s"), similarity.alias("similarity"), detail.alias("detail"))).alias("b")
    best = places.groupBy(*PAIR).agg(top)
    sizes = lambda rows, clip, name: rows.groupBy(*clip).agg(F.first("n").alias(name))
    whole = pairs.join(sizes(candidates, CANDIDATE, "m"), CANDIDATE).join(sizes(targets, TARGET, "n"), TARGET).join(best, PAIR, "left")
    start = F.coalesce(-F.col("b.s"), F.lit(0)).cast("int")
    there = lambda c: F.coalesce(c, F.lit(0.0))
    end = F.when(F.col("m") <= F.col("n"), start + F.col("m") - 1).otherwise(0).cast("int")
    return whole.select(*PAIR, there(F.col("b.similarity")).alias("similarity"), start.alias("target_start_index"), end.alias("target_end_index"), (start * F.lit(segment_s)).alias("offset_s"), there(F.col("b.detail")).alias("detail"))


def coverage(pairs: DataFrame, targets: DataFrame, candidates: DataFrame, similarity: Column, segment_s: float = 1.0) -> DataFrame:
    """The place with the largest share of matching segments plus a tenth of the mean similarity: share, place, and the mean as `detail`. Sides come from `placed`, `similarity` is of `t_...` and `c_...` columns."""
    met = meetings(pairs, targets, candidates).withColumn("_s", similarity)
    places = diagonals(met, {"share": F.avg((F.col("_s") >= MATCH).cast("double")), "mean": F.avg("_s")})
    return best_place(pairs, targets, candidates, places, F.col("share") + 0.1 * F.col("mean"), F.col("share"), F.col("mean"), segment_s)


def energy_correlation(pairs: DataFrame, targets: DataFrame, candidates: DataFrame, value: str = "rms", segment_s: float = 1.0) -> DataFrame:
    """The highest normalised cross-correlation of two curves, each about its mean: clipped to 0..1, its place, and as it is as `detail`. A flat candidate correlates with nothing."""
    t, c = about_mean(targets, TARGET, value), about_mean(candidates, CANDIDATE, value)
    x, y = of_target(value), of_candidate(value)
    places = diagonals(meetings(pairs, t, c).where(of_candidate("length") >= FLAT), {"xy": F.sum(x * y), "xx": F.sum(x * x), "length": F.first("c_length")})
    r = F.col("xy") / F.greatest(F.col("length") * F.sqrt(F.col("xx")), F.lit(FLAT))
    return best_place(pairs, targets, candidates, places.withColumn("r", r), F.col("r"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r"))), F.col("r"), segment_s)


def envelope(segs: DataFrame, clip: Sequence[str], samples: str, hop: int) -> DataFrame:
    """`clip` columns, `hop` (number, through the whole clip) and `rms`: the loudness of each `hop` samples of a clip whose segments hold arrays of equally many, whole hops of them."""
    at = Window.partitionBy(*clip).orderBy("idx")
    numbered = segs.select(*clip, (F.row_number().over(at) - 1).alias("_p"), F.col(samples).alias("_v"))
    per = F.floor(F.size("_v") / hop).cast("int")
    square = lambda k: F.aggregate(F.slice("_v", k * hop + 1, F.lit(hop)), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    loud = F.transform(F.sequence(F.lit(0), per - 1), lambda k: F.sqrt(square(k) / hop))
    return numbered.where(per > 0).select(*clip, "_p", per.alias("_per"), F.posexplode(loud).alias("_k", "rms")).select(*clip, (F.col("_p") * F.col("_per") + F.col("_k")).alias("hop"), "rms")


def verified(found: DataFrame, targets: DataFrame, candidates: DataFrame, per_segment: int, slack: int) -> DataFrame:
    """`found` (PAIR, `place` in segments) with `similarity`: the strongest correlation, of either sign, of the candidate's envelope with that of the target from `slack` segments before the place to
    `slack` after the candidate's end there, each about its mean. 0 for a flat candidate, one of fewer than two hops, or where the stretch of the target is shorter.
    `targets` and `candidates` come from `envelope`, with `per_segment` hops a segment."""
    c = candidates.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(*CANDIDATE)))
    c = about_mean(c, CANDIDATE, "rms")
    known = found.select(*PAIR, "place").join(c.groupBy(*CANDIDATE).agg(F.first("size").alias("size")), CANDIDATE)
    low = F.greatest(F.lit(0), F.col("place") - slack) * per_segment
    # the stretch ends as long after its start as the candidate lasts, and twice the slack
    stretch = known.join(targets, TARGET).where((F.col("hop") >= low) & (F.col("hop") < low + F.col("size") + 2 * slack * per_segment)).withColumn("at", F.col("hop") - low)
    whole = Window.partitionBy(*PAIR)
    stretch = stretch.select(*PAIR, "at", "size", (F.col("rms") - F.avg("rms").over(whole)).alias("x"), F.count(F.lit(1)).over(whole).alias("n"))
    met = stretch.join(c.where((F.col("length") >= FLAT) & (F.col("size") > 1)).select(*CANDIDATE, F.col("hop").alias("c_hop"), F.col("rms").alias("y"), "length"), CANDIDATE)
    lag = F.col("at") - F.col("c_hop")
    sums = met.where(lag.between(0, F.col("n") - F.col("size"))).groupBy(*PAIR, lag.alias("lag")).agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.first("length").alias("length"))
    r = F.abs(F.col("xy") / F.greatest(F.col("length") * F.sqrt("xx"), F.lit(FLAT)))
    best = sums.groupBy(*PAIR).agg(F.max(r).alias("similarity"))
    return found.join(best, PAIR, "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def warp(sim: np.ndarray, band_ratio: float) -> tuple[float, int]:
    """Dynamic time warping from the first to the last segments, within a band about the diagonal: 1 - mean cost of the cheapest path (cost 1 - similarity), and its length.
    Of equal ways back the target's step goes first, then the candidate's. Without a path 0. Rows are swept along antidiagonals, each as one array."""
    n, m = sim.shape
    if not n or not m:
        return 0.0, 0
    band = max(abs(n - m), round(max(n, m) * max(0.0, band_ratio)))
    cost = np.full((n + 1, m + 1), np.inf)
    length = np.zeros((n + 1, m + 1), np.int64)
    cost[0, 0] = 0.0
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        i = i[np.abs(2 * i - d) <= band]
        if not len(i):
            continue
        j = d - i
        ways = np.stack([cost[i - 1, j], cost[i, j - 1], cost[i - 1, j - 1]])
        steps = np.stack([length[i - 1, j], length[i, j - 1], length[i - 1, j - 1]])
        pick = ways.argmin(axis=0)
        cost[i, j] = ways[pick, np.arange(len(i))] + 1.0 - sim[i - 1, j - 1]
        length[i, j] = steps[pick, np.arange(len(i))] + 1
    if not np.isfinite(cost[n, m]):
        return 0.0, 0
    return float(np.clip(1.0 - cost[n, m] / length[n, m], 0, 1)), int(length[n, m])


def equal_bits(t: pa.Array, c: pa.Array) -> np.ndarray:
    """`digest_similarity` of each target with each candidate segment."""
    (a, x), (b, y) = ((d.fill_null(0).to_numpy(zero_copy_only=False).view("u8"), d.is_valid().to_numpy(zero_copy_only=False)) for d in (t, c))
    return np.where(x[:, None] & y, 1.0 - np.bitwise_count(a[:, None] ^ b) / 64.0, 0.0)


def equal_sound(t: Mapping[str, pa.Array], c: Mapping[str, pa.Array]) -> np.ndarray:
    """`sound_similarity` of each target with each candidate segment."""
    apart = [w * np.abs(t[k].to_numpy(zero_copy_only=False)[:, None] - c[k].to_numpy(zero_copy_only=False)) for k, w in (("rms", 0.65), ("zcr", 0.35))]
    feature = np.clip(1.0 - (apart[0] + apart[1]), 0.0, 1.0)
    both = t["bits"].is_valid().to_numpy(zero_copy_only=False)[:, None] & c["bits"].is_valid().to_numpy(zero_copy_only=False)
    return np.where(both, 0.80 * equal_bits(t["bits"], c["bits"]) + 0.20 * feature, feature)


def warped(pairs: DataFrame, targets: DataFrame, candidates: DataFrame, values: Sequence[str], similar: Callable[[Mapping, Mapping], np.ndarray], band_ratio: float = 0.25) -> DataFrame:
    """Each pair's `similarity` by `warp`, `path_length`, and the target segments that its path spans, `target_start_index` and `target_end_index`: the path is global, so it
    spans all. Without a path within the band all are 0. Sides come from `placed`; each clip becomes one row of arrays, as long as its media. A pair without segments on a side gives no row."""

    def arrays(rows: DataFrame, clip: Sequence[str], name: str) -> DataFrame:
        s = rows.groupBy(*clip).agg(F.array_sort(F.collect_list(F.struct("p", *values))).alias("s"))
        return s.select(*clip, *(F.col(f"s.{v}").alias(f"{name}_{v}") for v in values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for i in range(b.num_rows):
                t, c = ({v: b.column(f"{side}_{v}")[i].values for v in values} for side in "tc")
                s, n = warp(similar(t, c), band_ratio)
                found.append((s, n, 0, len(t[values[0]]) - 1 if n else 0))
            cols = [pa.array([r[k] for r in found], kind) for k, kind in enumerate((pa.float64(), pa.int32(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in PAIR), *cols], [*PAIR, "similarity", "path_length", "target_start_index", "target_end_index"])

    named, t, on = spread_targets(pairs, arrays(targets, TARGET, "t"))
    both = named.join(arrays(candidates, CANDIDATE, "c"), CANDIDATE).join(t, on).select(*PAIR, *(f"{s}_{v}" for s in "tc" for v in values))
    return both.mapInArrow(run, "target_id string, target_version string, candidate_id string, similarity double, path_length int, target_start_index int, target_end_index int")
