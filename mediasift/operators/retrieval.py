"""Exact retrieval: a stated set of queries against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediasift.functions.vectors import usable
from mediasift.session import width

#: Vectors of a block.
BLOCK = 4096


def similarity_band(c: Column) -> Column:
    """A cosine in words; each bound belongs to the lower band."""
    return (
        F.when(c > 0.95, "nearly identical").when(c > 0.90, "very similar").when(c > 0.80, "similar")
        .when(c > 0.70, "somewhat similar").when(c > 0.50, "weakly similar").otherwise("different")
    )


def top_of_each(cos: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, cosine) of each row's k highest columns, rounded to 6 places; of equals the smaller ids. Columns at -inf aren't there. Only
    what may be among them after rounding is sorted."""
    if not cos.size:
        return np.empty(0, np.int64), ids[:0], np.empty(0)
    least = np.partition(cos, -k, axis=1)[:, -k] - 1e-6 if cos.shape[1] > k else np.full(len(cos), -np.inf)
    row, col = np.nonzero(cos >= least[:, None])
    c, i = np.round(cos[row, col], 6), ids[col]
    there = np.isfinite(c)
    row, c, i = row[there], c[there], i[there]
    order = np.lexsort((i, -c, row))
    row, c, i = row[order], c[order], i[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], i[keep], c[keep]


def _best(k: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            get = {c: b.column(c) for c in ("q_ids", "q_flat", "d_ids", "d_flat")}
            for i in range(b.num_rows):
                qi, qv, di, dv = (np.asarray(get[c][i].values) for c in ("q_ids", "q_flat", "d_ids", "d_flat"))
                q, d = (v.astype("f8").reshape(-1, dim) for v in (qv, dv))
                q, d = (v / np.abs(v).max(axis=1, keepdims=True) for v in (q, d))
                cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (d / np.linalg.norm(d, axis=1, keepdims=True)).T
                cos[qi[:, None] == di] = -np.inf
                row, found, c = top_of_each(cos, di, k)
                yield pa.RecordBatch.from_arrays([pa.array(qi[row]), pa.array(found), pa.array(c)], ["query_id", "vec_id", "cosine"])

    return run


def search_in_blocks(queries: DataFrame, data: DataFrame, id_column: str, vector: str, dim: int, k: int) -> DataFrame:
    """`query_id`, `vec_id`, `cosine` (6 places), `pos`: for each query the k most similar rows other than itself, of equal ones the smaller id first.

    Ids are unique integers; null ids and unusable vectors take no part on either side. Rows are packed into blocks; every block of data meets every
    block of queries once, by a key that spreads the data and repeats only the queries, and gives k rows a query. So memory depends on the block alone.
    """
    n = width(data.sparkSession)

    def packed(df: DataFrame, prefix: str) -> DataFrame:
        rows = df.where(F.col(id_column).isNotNull() & usable(F.col(vector), dim)).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
        blocks = rows.mapInArrow(_pack(dim), "ids array<long>, flat array<float>")
        return blocks.select(F.col("ids").alias(f"{prefix}_ids"), F.col("flat").alias(f"{prefix}_flat"))

    d = packed(data, "d").withColumn("at", F.pmod(F.xxhash64(F.col("d_ids")[0]), F.lit(n)))
    q = packed(queries, "q").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    found = d.join(q.hint("shuffle_hash"), "at").select("q_ids", "q_flat", "d_ids", "d_flat").mapInArrow(_best(k, dim), "query_id long, vec_id long, cosine double")
    rank = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return found.withColumn("pos", F.row_number().over(rank)).where(F.col("pos") <= k)


def _pack(dim: int):
    """(id, vector) rows to rows of up to BLOCK ids and their vectors end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([one(part.column(0)), one(part.column(1).flatten())], ["ids", "flat"])

    return run
