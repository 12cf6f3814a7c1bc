"""For every vector its k most similar ones of a whole collection, exactly, however low their cosine.

Hashing finds what is alike; the tenth nearest of most vectors is hardly nearer than chance, and no hash tells it from the
rest. So each vector meets each other one in array operations. The collection is written once, to the shared folder; each
task holds some vectors, reads the collection block by block and keeps the k best so far. So nothing is repeated on disk,
a task gives k rows a vector, and memory depends on the blocks alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mediasift.llm.similar import valid_vectors, vectors_of
from mediasift.session import scratch, width

#: Vectors of a block, on either side.
BLOCK = 4096
#: Vectors that a task holds while it reads the collection once.
HELD = 32_768
#: Pairs whose cosine is made in double at once.
PAIRS = 100_000
#: More than single precision and rounding to 6 places can change a cosine.
SLACK = 1e-5


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows in unit length; scaled first, so that neither tiny nor huge numbers leave the range of their squares."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def blocks_of(uri: str, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of a folder of Parquet files, block by block."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    for f in sorted(i.path for i in system.get_file_info(fs.FileSelector(path)) if i.path.endswith(".parquet")):
        with system.open_input_file(f) as source:
            for b in pq.ParquetFile(source).iter_batches(batch_size=BLOCK):
                if b.num_rows:
                    yield np.asarray(b.column(0)), unit_rows(vectors_of(b.column(1), dim))


class Best:
    """The k most similar so far of some vectors: cosines to 6 places, of equal ones the smaller id first."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray, k: int):
        self.ids, self.unit, self.single, self.k = ids, unit, unit.astype("f4"), k
        self.cosine = np.full((len(ids), k), -np.inf)
        self.found = np.zeros((len(ids), k), np.int64)

    def meet(self, ids: np.ndarray, unit: np.ndarray) -> None:
        """Single precision tells what may be among the best; only that is compared in double."""
        cos = self.single @ unit.astype("f4").T
        least = self.cosine[:, -1] - SLACK
        if (new := np.isneginf(least)).any() and len(ids) > self.k + 1:
            # one more, as a vector may meet itself
            least[new] = np.partition(cos[new], -(self.k + 1), axis=1)[:, -(self.k + 1)] - 2 * SLACK
        near = cos >= least.astype("f4")[:, None]
        piece = np.cumsum(near.sum(axis=1)) // PAIRS
        for p in range(int(piece[-1]) + 1):
            lo, hi = np.searchsorted(piece, [p, p + 1])
            if lo < hi:
                self._keep(lo, hi, *np.nonzero(near[lo:hi]), ids, unit)

    def _keep(self, lo: int, hi: int, row: np.ndarray, col: np.ndarray, ids: np.ndarray, unit: np.ndarray) -> None:
        other = ids[col] != self.ids[lo + row]
        row, col = row[other], col[other]
        if not len(row):
            return
        c = np.round(np.einsum("ij,ij->i", self.unit[lo + row], unit[col]), 6)
        touched = np.unique(row)
        old = self.cosine[lo + touched]
        had = ~np.isneginf(old)
        rows = np.concatenate([np.repeat(touched, had.sum(axis=1)), row])
        found = np.concatenate([self.found[lo + touched][had], ids[col]])
        c = np.concatenate([old[had], c])
        order = np.lexsort((found, -c, rows))
        rows, found, c = rows[order], found[order], c[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = place < self.k
        self.cosine[lo + rows[top], place[top]] = c[top]
        self.found[lo + rows[top], place[top]] = found[top]

    def rows(self) -> pa.RecordBatch:
        row, place = np.nonzero(~np.isneginf(self.cosine))
        columns = [self.ids[row], self.found[row, place], self.cosine[row, place] + 0.0, (place + 1).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "neighbour", "cosine", "pos"])


def _search(uri: str, dim: int, k: int):
    def answers(ids: list[np.ndarray], vectors: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        i, v = np.concatenate(ids), np.concatenate(vectors)
        held = [Best(i[at : at + BLOCK], unit_rows(v[at : at + BLOCK]), k) for at in range(0, len(i), BLOCK)]
        for block in blocks_of(uri, dim):
            for h in held:
                h.meet(*block)
        for h in held:
            yield h.rows()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                ids.append(np.array(b.column(0)))
                vectors.append(vectors_of(b.column(1), dim))
                if sum(map(len, ids)) >= HELD:
                    yield from answers(ids, vectors)
                    ids, vectors = [], []
        if ids:
            yield from answers(ids, vectors)

    return run


def nearest_vectors(df: DataFrame, id_column: str, vector_column: str, dim: int, k: int = 10) -> DataFrame:
    """`id`, `neighbour`, `cosine`, `pos`: for each vector the k most similar others (all others if there are fewer), by cosine rounded to 6
    places, of equal ones the smaller id first.

    Ids are unique integers; which rows take part is as in `similar_vectors`. No vectors give no rows. Nothing is approximate: the work is the square
    of the collection. The shared folder must be one that pyarrow can read.
    """
    spark = df.sparkSession
    where = scratch(spark, "vectors")
    valid_vectors(df, id_column, vector_column, dim).write.parquet(where)
    uri = where if "://" in where else f"file://{where}"
    asked = spark.read.schema("id long, vec array<float>").parquet(where).repartition(width(spark))
    return asked.mapInArrow(_search(uri, dim, k), "id long, neighbour long, cosine double, pos int")
