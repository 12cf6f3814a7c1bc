"""Clips as sequences of segment vectors."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediasift.functions.vectors import usable


def segments(frames: DataFrame, clip: Sequence[str], dim: int, id_column: str = "vec_id", vector: str = "embeddings") -> DataFrame:
    """`clip` columns, `idx`, `start_s`, `end_s`, `vec`: one row per clip and segment_index.

    Of a segment saved more than once the row with the smallest id stays. Left out are rows with a null in the clip or index, and unusable vectors (null,
    short, zero, with NaN): these are in `segment_faults`. A segment lasts one sampling step; without a rate it has no length.
    """
    step = F.coalesce(1 / F.nullif(F.col("sample_fps"), F.lit(0.0)), F.lit(0.0))
    kept = frames.select(*clip, F.col("segment_index").alias("idx"), F.col(id_column).alias("_id"), F.col("frame_time_s").alias("start_s"), (F.col("frame_time_s") + step).alias("end_s"), F.col(vector).alias("vec"))
    kept = kept.dropna(subset=[*clip, "idx"]).where(usable(F.col("vec"), dim))
    first = Window.partitionBy(*clip, "idx").orderBy("_id")
    return kept.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_id", "_r")


def segment_faults(frames: DataFrame, clip: Sequence[str], dim: int, id_column: str = "vec_id", vector: str = "embeddings") -> DataFrame:
    """Rows that `segments` leaves out, each with the first reason: `clip` columns, the id, `reason`."""
    v = F.col(vector)
    first = Window.partitionBy(*clip, "segment_index").orderBy(F.when(usable(v, dim), 0).otherwise(1), id_column)
    reason = (
        F.when(F.col("segment_index").isNull(), "no index")
        .when(v.isNull(), "no vector")
        .when(F.size(v) != dim, "wrong length")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 3.4e38)), "not a number")
        .when(~F.exists(v, lambda x: x != 0), "zero vector")
        .when(F.row_number().over(first) > 1, "index repeated")
    )
    return frames.dropna(subset=list(clip)).select(*clip, F.col(id_column), reason.alias("reason")).where("reason IS NOT NULL")


def clip_rows(frames: DataFrame, sides: Mapping[str, Sequence[str]], dim: int, id_column: str = "vec_id", vector: str = "embeddings") -> DataFrame:
    """`side`, `k0`, `k1`, ..., `idx`, `start_s`, `end_s`, `_id`, `vec`: usable frames once for each side whose clip columns they fill, in one pass over the table. A side with fewer
    columns than others has empty texts in the rest. A segment saved more than once is still there more than once."""
    wide = max(map(len, sides.values()))
    step = F.coalesce(1 / F.nullif(F.col("sample_fps"), F.lit(0.0)), F.lit(0.0))
    role = lambda side, clip: F.when(F.concat(*clip).isNotNull(), F.struct(F.lit(side).alias("side"), *((F.col(clip[i]) if i < len(clip) else F.lit("")).cast("string").alias(f"k{i}") for i in range(wide))))
    roles = F.array_compact(F.array(*(role(s, list(c)) for s, c in sides.items())))
    good = frames.where(F.col("segment_index").isNotNull() & usable(F.col(vector), dim))
    return good.select(F.explode(roles).alias("_r"), F.col("segment_index").alias("idx"), F.col("frame_time_s").alias("start_s"), (F.col("frame_time_s") + step).alias("end_s"), F.col(id_column).alias("_id"), F.col(vector).alias("vec")).select("_r.*", "idx", "start_s", "end_s", "_id", "vec")


def coarse_of_blocks(packed: DataFrame, clip: Sequence[str]) -> DataFrame:
    """`clip` columns, `n_segments`, `coarse` (the mean vector at length 1; unchanged if it has none) of `blocks`, which hold their sums: one short row a block is shuffled."""
    sums = packed.groupBy(*clip).agg(F.sum("n").alias("n_segments"), F.collect_list("total").alias("_t"))
    summed = F.aggregate(F.slice("_t", 2, F.size("_t")), F.col("_t")[0], lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    with_mean = sums.select(*clip, "n_segments", F.transform(summed, lambda x: x / F.col("n_segments")).alias("mean"))
    length = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))
    return with_mean.withColumn("len", length).select(*clip, "n_segments", F.transform("mean", lambda x: x / F.when(F.col("len") > 0, F.col("len")).otherwise(1.0)).alias("coarse"))


def coarse_vectors(segs: DataFrame, clip: Sequence[str], dim: int) -> DataFrame:
    """`coarse_of_blocks` of rows of segments."""
    return coarse_of_blocks(blocks(segs, clip), clip)


def _pack(n_keys: int):
    """Rows sorted by their first columns (keys) and the next (a number) to one row a key: lists of the rest, of the last one's lists all values, how many, and their sum.
    Of rows with equal keys and number the first stays."""

    def new_at(t: pa.RecordBatch, columns: range) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for i in columns:
            c = t.column(i)
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        return new

    def pack(t: pa.RecordBatch) -> pa.RecordBatch:
        t = t.filter(pa.array(new_at(t, range(n_keys + 1))))
        starts = np.flatnonzero(new_at(t, range(n_keys)))
        ends = pa.array(np.r_[starts, t.num_rows], pa.int32())
        vec = t.column(t.num_columns - 1)
        if vec.offset:
            vec = pa.concat_arrays([vec])
        lists = [pa.ListArray.from_arrays(ends, pa.concat_arrays([t.column(i)])) for i in range(n_keys, t.num_columns - 1)]
        flat = pa.ListArray.from_arrays(vec.offsets.take(ends), vec.values)
        at, sizes = vec.offsets.to_numpy(), np.diff(np.r_[starts, t.num_rows])
        width = np.diff(at)
        values = vec.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype("f8")
        if (width == width[0]).all():
            sums = list(np.add.reduceat(values.reshape(t.num_rows, -1), starts, axis=0))
        else:  # lengths differ between clips
            sums = [values[at[x] - at[0] : at[x + n] - at[0]].reshape(n, -1).sum(axis=0) for x, n in zip(starts, sizes)]
        keys = [t.column(i).take(pa.array(starts)) for i in range(n_keys)]
        return pa.RecordBatch.from_arrays([*keys, *lists, flat, pa.array(sizes.astype("i8")), pa.array(sums, pa.list_(pa.float64()))], [*t.schema.names, "n", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            last = int(np.flatnonzero(new_at(t, range(n_keys)))[-1])
            if last:
                yield pack(t.slice(0, last))
            held = t.slice(last)
        if held is not None:
            yield pack(held)

    return run


def blocks(segs: DataFrame, clip: Sequence[str], size: int = 256) -> DataFrame:
    """`clip` columns, `block`, `idxs`, `starts`, `ends`, `flat`, `n`, `total`: up to `size` consecutive segment numbers a row, with their times, their vectors end to end, and
    how many and what sum these have. However long a clip is, no row holds more, and its blocks lie in different partitions. Of a number that is there more than once the row with the
    smallest `_id` stays, if there is such a column. One shuffle."""
    keys = [*clip, "block"]
    tie = ["_id"] if "_id" in segs.columns else []
    rows = segs.select(*clip, F.floor(F.col("idx") / size).alias("block"), "idx", "start_s", "end_s", *tie, "vec")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "idx", *tie).drop(*tie)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    element = rows.schema["vec"].dataType.elementType.simpleString()
    return rows.mapInArrow(_pack(len(keys)), f"{kinds}, idx array<int>, start_s array<double>, end_s array<double>, vec array<{element}>, n long, total array<double>").withColumnsRenamed({"idx": "idxs", "start_s": "starts", "end_s": "ends", "vec": "flat"})
