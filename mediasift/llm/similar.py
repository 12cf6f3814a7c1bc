"""For every vector the most similar ones of a whole collection, by cross-polytope hashing.

A hash turns a unit vector by a pseudo-random rotation (three rounds of random signs and a fast Hadamard transform) and takes
the signed axis nearest to it: one of 2 d values, which similar vectors share. A table joins a few such hashes; each vector
is stored in its own bucket of every table and looks into the next likely buckets too (multiprobe). Vectors that meet are
compared by a 128-bit sketch of signs first, then exactly, in double.

A vector travels once per table, to its region: the buckets that share all axes but the last two. It brings what the task there needs to tell its probes
itself, so more probes cost no more disk. How many tables there are follows from the share of pairs that a table finds, measured on random pairs of the wanted cosine; so recall is the
same for any size, number of hash functions and dimension. Vectors are shuffled once, and once more per surviving pair.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediasift.operators.retrieval import top_of_each
from mediasift.session import cut, width

SALTS = 16
SKETCH = 128
#: Likely axes of a hash function that probes are made of, and the bits of how much less likely each further one is.
LIKELY, LOSS = 3, 4
#: Pairs that are compared in one array operation.
BLOCK = 2_000_000
#: A bucket with more entries is a crowd: its vectors are searched exactly, in blocks of so many, which keeps the best of each.
DENSE = 4096
#: Entries of a region that a task holds at once. A wider region is parted into its buckets, each of which any task may get.
HELD = 250_000
#: Crowded buckets that are sent to all tasks; more of them are joined.
SENT = 100_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row, in orthonormal form; the width is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


@dataclass(frozen=True)
class CrossPolytope:
    """Tables of hashes for vectors of `dim` numbers. More tables find more; more functions a table make buckets smaller."""

    dim: int
    tables: int
    functions: int
    probes: int = LIKELY * LIKELY
    seed: int = 11

    @classmethod
    def for_recall(cls, dim: int, rows: int, cosine: float, recall: float = 0.995, functions: int | None = None) -> CrossPolytope:
        """Three functions, or as many more as keep about 64 of evenly spread vectors a bucket (in 64 dimensions from 134 million on), and as many tables as
        find this share of the pairs that have just this cosine; of nearer ones more are found."""
        functions = functions or max(3, math.ceil(math.log(max(rows, 2) / 64) / math.log(2 * cls(dim, 1, 1).padded)))
        share = _share_found(dim, functions, cls(dim, 1, functions).probes, round(max(cosine, 0.5), 3))
        return cls(dim, max(1, math.ceil(math.log(1 - recall) / math.log(1 - share))), functions)

    @property
    def padded(self) -> int:
        return 1 << max(1, (self.dim - 1).bit_length())

    @property
    def low(self) -> int:
        """How many of the last axes are told apart within a region."""
        return min(2, self.functions - 1)

    @property
    def axis_bits(self) -> int:
        return (2 * self.padded - 1).bit_length()

    @property
    def codes(self) -> int:
        """Numbers of 64 bits that hold what an entry brings beside its region: per axis its likely values and their losses."""
        each = 63 // (LIKELY * self.axis_bits + (LIKELY - 1) * LOSS)
        return -(-self.low // each)

    def rotations(self, table: int) -> list[np.ndarray]:
        """Per function the rotation that three rounds make, as a matrix: one product is faster than the rounds one by one (README)."""
        rng = np.random.default_rng([self.seed, table])
        row = []
        for _ in range(self.functions):
            m = np.eye(self.dim, self.padded)
            for _ in range(3):
                m = hadamard(m * rng.choice([-1.0, 1.0], self.padded))
            row.append(m.astype("f4"))
        return row

    def planes(self) -> np.ndarray:
        return np.random.default_rng(self.seed + 1).standard_normal((self.dim, SKETCH)).astype("f4")

    def entries(self, unit: np.ndarray, rotations: list[np.ndarray], table: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each vector's region in one table, and its codes."""
        e = self.axis_bits
        region, parts = np.zeros(len(unit), np.int64), []
        for f, r in enumerate(rotations):
            y = unit @ r
            size = np.abs(y)
            if f < self.functions - self.low:
                top = size.argmax(axis=1)
                region = region * (2 * self.padded) + 2 * top + (np.take_along_axis(y, top[:, None], 1)[:, 0] < 0)
                continue
            code = np.zeros(len(unit), np.int64)
            best = None
            for k in range(LIKELY):
                top = size.argmax(axis=1)[:, None]
                now = np.take_along_axis(size, top, 1)
                best = now if best is None else best
                axis = 2 * top[:, 0] + (np.take_along_axis(y, top, 1)[:, 0] < 0)
                code |= axis.astype(np.int64) << (k * e)
                if k:
                    loss = np.minimum(np.round((best - np.maximum(now, 0))[:, 0] * math.sqrt(self.padded) * 8), 2**LOSS - 1).astype(np.int64)
                    code |= loss << (LIKELY * e + (k - 1) * LOSS)
                np.put_along_axis(size, top, -1.0, axis=1)
            parts.append(code)
        each, bits = -(-self.low // self.codes), LIKELY * e + (LIKELY - 1) * LOSS
        codes = [sum((p << (bits * i) for i, p in enumerate(parts[at : at + each])), np.zeros(len(unit), np.int64)) for at in range(0, self.low, each)]
        return region * self.tables + table, codes

    def buckets(self, codes: list[np.ndarray]) -> np.ndarray:
        """The buckets within its region that each entry looks into, its own first, then the likeliest."""
        e = self.axis_bits
        each, bits = -(-self.low // self.codes), LIKELY * e + (LIKELY - 1) * LOSS
        axes, losses = [], []
        for i in range(self.low):
            code = codes[i // each] >> np.int64(bits * (i % each))
            axes.append([(code >> np.int64(k * e)) & ((1 << e) - 1) for k in range(LIKELY)])
            losses.append([np.zeros(len(code), np.int64), *((code >> np.int64(LIKELY * e + k * LOSS)) & (2**LOSS - 1) for k in range(LIKELY - 1))])
        combos = sorted(itertools.product(range(LIKELY), repeat=self.low), key=sum)
        cost = np.stack([sum(losses[i][c[i]] for i in range(self.low)) for c in combos], axis=1)
        cost[:, 0] = -1
        number = np.zeros((len(codes[0]), len(combos)), np.int64)
        for i in range(self.low):
            number = (number << e) + np.stack([axes[i][c[i]] for c in combos], axis=1)
        return np.take_along_axis(number, np.argsort(cost, axis=1, kind="stable")[:, : self.probes], 1)


@lru_cache(maxsize=64)
def _share_found(dim: int, functions: int, probes: int, cosine: float, pairs: int = 2000, tables: int = 8) -> float:
    """The share of random pairs of unit vectors with this cosine that a table finds, over several tables; at least one in as many as are tried."""
    rng = np.random.default_rng(17)
    a, b = rng.standard_normal((2, pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    both = np.concatenate([a, cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * b]).astype("f4")
    plan, found = CrossPolytope(dim, tables, functions, probes), 0
    for t in range(tables):
        region, codes = plan.entries(both, plan.rotations(t), t)
        looks = plan.buckets(codes)
        x, y = looks[:pairs], looks[pairs:]
        meet = (x == y[:, :1]).any(axis=1) | (y == x[:, :1]).any(axis=1)
        found += int((meet & (region[:pairs] == region[pairs:])).sum())
    return min(max(found, 1) / (pairs * tables), 1 - 1e-9)


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    """A list column, whose lists all have `dim` numbers, as a matrix in double."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)


def _names(plan: CrossPolytope) -> list[str]:
    return ["region", "id", "s1", "s2", *(f"c{i}" for i in range(plan.codes))]


def _entries(plan: CrossPolytope):
    """(id, vec) to the entries of each vector, one per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations, planes = [plan.rotations(t) for t in range(plan.tables)], plan.planes()
        weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                x = vectors_of(b.column(1), plan.dim)
                # scaled first, so that neither tiny nor huge numbers leave the range of their squares
                x /= np.abs(x).max(axis=1, keepdims=True)
                unit = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype("f4")
                bits = (unit @ planes) > 0
                s = [(bits[:, i : i + 64] * weights).sum(axis=1, dtype=np.uint64).view(np.int64) for i in (0, 64)]
                for t in range(plan.tables):
                    region, codes = plan.entries(unit, rotations[t], t)
                    yield pa.RecordBatch.from_arrays([pa.array(region), b.column(0), *map(pa.array, s), *map(pa.array, codes)], _names(plan))

    return run


def _near(i: np.ndarray, j: np.ndarray, r: dict[str, np.ndarray], far: int) -> np.ndarray:
    """Pairs (a, b) of the entries i and j that may be near enough."""
    apart = sum(np.bitwise_count((r[s][i] ^ r[s][j]).view(np.uint64)) for s in ("s1", "s2"))  # of a signed number it counts the magnitude's bits
    ok = (apart <= far) & (r["id"][i] != r["id"][j])
    a, b = r["id"][i[ok]], r["id"][j[ok]]
    return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)


def _spread(first: np.ndarray, mains: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (own entry, any entry) of all buckets that start at `first`; own entries lie in front."""
    rows = np.repeat(np.arange(len(first)), mains)
    own = np.arange(len(rows)) - np.repeat(np.cumsum(mains) - mains, mains) + first[rows]
    size = sizes[rows]
    i = np.repeat(own, size)
    j = np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[rows], size)
    return i, j


def _pairs_of(r: dict[str, np.ndarray], far: int, crowded, crowd: int) -> Iterator[np.ndarray]:
    """Candidate pairs of whole buckets, sorted by slot and probe; crowded buckets are only counted."""
    n = len(r["slot"])
    if not n:
        return
    first = np.flatnonzero(np.r_[True, r["slot"][1:] != r["slot"][:-1]])
    sizes = np.diff(np.r_[first, n])
    mains = np.add.reduceat((r["probe"] == 0).astype(np.int64), first)
    dense = sizes > crowd
    work = np.where(dense, 0, mains * sizes)
    chunk = np.cumsum(work) // BLOCK
    for c in np.unique(chunk[work > 0]):
        pick = (chunk == c) & (work > 0)
        yield _near(*_spread(first[pick], mains[pick], sizes[pick]), r, far)
    crowded.add(int(dense.sum()))


def _entered(plan: CrossPolytope, r: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Entries to one row per bucket that they look into, sorted by `slot` and `probe` (0 for the own bucket)."""
    looks = plan.buckets([r[f"c{i}"] for i in range(plan.codes)])
    row = np.repeat(np.arange(len(looks)), looks.shape[1])
    low, probe = looks.ravel(), np.tile(np.r_[0, np.ones(looks.shape[1] - 1, np.int64)], len(looks))
    order = np.lexsort((probe, low, r["region"][row]))
    out = {c: r[c][row[order]] for c in ("region", "id", "s1", "s2")} | {"low": low[order], "probe": probe[order]}
    new = (out["region"][1:] != out["region"][:-1]) | (out["low"][1:] != out["low"][:-1])
    out["slot"] = np.cumsum(np.r_[False, new]) if len(row) else row
    return out


def _regions(batches: Iterator[pa.RecordBatch], names: list[str], key: str, held: int, wide: bool) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by `key` in pieces of whole keys, of at most about `held` rows. A key with more rows isn't there; with `wide` only such are, in pieces of any kind. However many rows a
    key has, no more are held, and none is copied twice."""
    parts: list[dict[str, np.ndarray]] = []
    count, over = 0, None  # rows held, and the key that has too many
    for b in batches:
        new = {c: np.asarray(b.column(c)) for c in names}
        if over is not None:
            past = int(np.searchsorted(new[key], over, side="right"))
            if wide and past:
                yield {c: v[:past] for c, v in new.items()}
            new = {c: v[past:] for c, v in new.items()}
        if not len(new[key]):
            continue
        over = None
        parts.append(new)
        count += len(new[key])
        if count <= held:
            continue
        whole = {c: np.concatenate([x[c] for x in parts]) for c in names}
        last = int(np.searchsorted(whole[key], whole[key][-1]))
        if last:
            yield from _narrow(whole, last, key, held, wide)
        rest = {c: v[last:] for c, v in whole.items()}
        parts, count = [rest], count - last
        if count > held:
            over = rest[key][0]
            if wide:
                yield rest
            parts, count = [], 0
    if parts:
        whole = {c: np.concatenate([x[c] for x in parts]) for c in names}
        yield from _narrow(whole, count, key, held, wide)


def _narrow(whole: dict[str, np.ndarray], end: int, key: str, held: int, wide: bool) -> Iterator[dict[str, np.ndarray]]:
    """Of whole keys, up to a row, those that have no more than `held` rows, or with `wide` the others."""
    _, size = np.unique(whole[key][:end], return_counts=True)
    pick = np.repeat((size > held) == wide, size)
    if pick.any():
        yield {c: v[:end] if pick.all() else v[:end][pick] for c, v in whole.items()}


def _once(pairs: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pairs, each once for as many as are at hand."""
    seen: list[np.ndarray] = []
    for p in [*pairs, None]:
        if p is not None:
            seen.append(p)
        if seen and (p is None or sum(map(len, seen)) > BLOCK):
            both = np.concatenate(seen)
            seen = []
            both = both[np.lexsort((both[:, 1], both[:, 0]))]
            both = both[np.r_[True, (both[1:] != both[:-1]).any(axis=1)]] if len(both) else both
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])


def _collide(plan: CrossPolytope, far: int, left_out, crowd: int, held: int):
    """Entries sorted by region to candidate pairs; crowded buckets and wide regions are only counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = read = 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal read
            for b in batches:
                read += b.num_rows
                yield b

        for r in _regions(counted(), _names(plan), "region", held, False):
            seen += len(r["region"])
            yield from _once(_pairs_of(_entered(plan, r), far, left_out, crowd))
        left_out.add(read - seen)

    return run


def _parted(plan: CrossPolytope, held: int):
    """Entries of wide regions to one row per bucket that they look into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _regions(batches, _names(plan), "region", held, True):
            e = _entered(plan, r)
            slot = (e["region"] << np.int64(plan.low * plan.axis_bits)) | e["low"]
            yield pa.RecordBatch.from_arrays([pa.array(slot), *(pa.array(e[c]) for c in ("id", "s1", "s2", "probe"))], ["slot", "id", "s1", "s2", "probe"])

    return run


SLOTS = ["slot", "id", "s1", "s2", "probe"]


def _collide_slots(far: int, left_out, crowd: int):
    """Rows sorted by slot and probe to candidate pairs; crowded buckets are only counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _regions(batches, SLOTS, "slot", crowd, False):
            yield from _once(_pairs_of(r, far, left_out, crowd))

    return run


def _crowds(plan: CrossPolytope, crowd: int, held: int):
    """Members of the buckets that `_collide` left out, as bucket and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _regions(batches, _names(plan), "region", held, False):
            e = _entered(plan, r)
            inside = np.flatnonzero(np.bincount(e["slot"])[e["slot"]] > crowd)
            bucket = (e["region"][inside] << np.int64(plan.low * plan.axis_bits)) | e["low"][inside]
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(e["id"][inside])], ["bucket", "id"])

    return run


def _crowded_slots(crowd: int):
    """Members of the slots that `_collide_slots` left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _regions(batches, SLOTS, "slot", crowd, True):
            yield pa.RecordBatch.from_arrays([pa.array(r["slot"]), pa.array(r["id"])], ["bucket", "id"])

    return run


def _best_in_block(dim: int, k: int, floor: float):
    """(ids and vectors of a block, the same of another) to each one's k most similar of the other block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                qi, di = (np.asarray(b.column(c)[i].values) for c in ("q_ids", "d_ids"))
                q, d = (np.asarray(b.column(c)[i].values).astype("f8").reshape(-1, dim) for c in ("q_flat", "d_flat"))
                q, d = (v / np.abs(v).max(axis=1, keepdims=True) for v in (q, d))
                cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (d / np.linalg.norm(d, axis=1, keepdims=True)).T
                cos[qi[:, None] == di] = -np.inf
                row, found, c = top_of_each(cos, di, k)
                near = c >= floor
                yield pa.RecordBatch.from_arrays([pa.array(qi[row[near]]), pa.array(found[near]), pa.array(c[near])], ["x", "y", "cosine"])

    return run


def _search_crowds(members: DataFrame, vectors: DataFrame, dim: int, k: int, floor: float, crowd: int) -> DataFrame:
    """Neighbours (`x`, `y`, `cosine`) within crowded buckets (`bucket`, `id`), exactly: members are spread over blocks, each block of a bucket meets each other one, and a vector keeps
    its k best of a block. So a bucket of any size is many tasks, and none of them gives all pairs; the work is the square of the bucket."""
    members = cut(members.distinct())
    sizes = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias("n"))
    sizes = F.broadcast(sizes) if sizes.count() <= SENT else sizes
    placed = members.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).join(vectors, "id")
    packed = placed.groupBy("bucket", "n", "block").agg(F.collect_list(F.struct("id", "vec")).alias("m"))
    packed = cut(packed.select("bucket", "n", "block", F.col("m.id").alias("ids"), F.flatten("m.vec").alias("flat")))
    data = packed.select("bucket", "block", F.col("ids").alias("d_ids"), F.col("flat").alias("d_flat"))
    asked = packed.select("bucket", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"))
    return data.join(asked, ["bucket", "block"]).select("q_ids", "q_flat", "d_ids", "d_flat").mapInArrow(_best_in_block(dim, k, floor), "x long, y long, cosine double").distinct()


def _exact(dim: int, floor: float):
    """(a, b, va, vb) to (a, b, cosine), in double and rounded to 6 places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                x, y = vectors_of(b.column(2), dim), vectors_of(b.column(3), dim)
                x /= np.abs(x).max(axis=1, keepdims=True)
                y /= np.abs(y).max(axis=1, keepdims=True)
                c = np.round((x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)), 6)
                ok = pa.array(c >= floor)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(c).filter(ok)], ["a", "b", "cosine"])

    return run


def valid_vectors(df: DataFrame, id_column: str, vector_column: str, dim: int) -> DataFrame:
    """`id`, `vec` of the rows that have an id and `dim` finite numbers, not all zero."""
    v = F.col(vector_column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 3.4e38))
    some = F.exists(v, lambda x: x != 0)
    return df.where(F.col(id_column).isNotNull() & (F.size(v) == dim) & ~bad & some).select(F.col(id_column).cast("long").alias("id"), v.cast("array<float>").alias("vec"))


def similar_vectors(df: DataFrame, id_column: str, vector_column: str, dim: int, k: int, floor: float, plan: CrossPolytope | None = None, crowd: int = DENSE, held: int = HELD) -> DataFrame:
    """`id`, `neighbour`, `cosine`, `pos`: for each vector the k most similar others with a cosine of `floor` or more (rounded to 6 places), of
    equal ones the smaller id first.

    Ids are unique integers; rows with a null id take no part, nor do vectors that are null, have not `dim` numbers, hold a null,
    NaN or infinity, or are zero. Vectors need no unit length. Vectors saved more than once are hashed once: each of the
    copies has the others among its neighbours. No vectors give no rows. The search is approximate: of pairs with a cosine of just `floor` 99.5 percent are found, of nearer ones more.
    Many tables are needed for a low floor; without any floor `nearest_vectors` is the way. Buckets with more than `crowd` entries are searched exactly, in blocks; regions with more than
    `held` are parted first.
    """
    valid = valid_vectors(df, id_column, vector_column, dim)
    plan = plan or CrossPolytope.for_recall(dim, df.count(), floor)
    p = 0.5 if floor <= 0 else math.acos(min(floor, 1.0)) / math.pi
    far = math.ceil(SKETCH * p + 3.5 * math.sqrt(SKETCH * p * (1 - p)))  # more bits apart are 2 of 10,000 pairs at the floor

    keyed = valid.select("id", F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(1), "vec").alias("g"))
    copied = keyed.groupBy("h", "g").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    salted = copied.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = cut(keyed.withColumn("salt", F.pmod("id", F.lit(SALTS)).cast("int")).join(salted, ["h", "g", "salt"]).select("rep", "id", "salt"))
    of_class = Window.partitionBy("rep").orderBy("id")
    heads = members.withColumn("rn", F.row_number().over(of_class)).where(F.col("rn") <= k + 1).select("rep", F.col("id").alias("member"))
    vectors = valid.join(members.where("id <> rep").select("id"), "id", "left_anti")

    sc = df.sparkSession.sparkContext
    entries = vectors.mapInArrow(_entries(plan), ", ".join(f"{c} long" for c in _names(plan)))
    n = width(df.sparkSession)
    by_region = entries.repartition(n, "region").sortWithinPartitions("region")
    left_out = sc.accumulator(0)
    # partitioned by a alone: that serves both to drop what was found twice and to meet the vectors
    pairs = by_region.mapInArrow(_collide(plan, far, left_out, crowd, held), "a long, b long").repartition(n, "a").dropDuplicates(["a", "b"])

    def compared(pairs: DataFrame) -> DataFrame:
        left = pairs.join(vectors.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a")
        both = left.join(vectors.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b").select("a", "b", "va", "vb")
        near = both.mapInArrow(_exact(dim, floor), "a long, b long, cosine double")
        way = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), "cosine")
        return near.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("w")).select("w.*")

    ways = compared(pairs)
    own = heads.select(F.col("rep").alias("x"), F.col("member").alias("y"), F.lit(1.0).alias("cosine"))
    order = [F.desc("cosine"), "y"]

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rn", F.row_number().over(Window.partitionBy("x").orderBy(*order))).where(F.col("rn") <= k + 1)

    def of_members(rows: DataFrame) -> DataFrame:
        return rows.join(heads, rows["y"] == heads["rep"], "left").select("x", F.coalesce("member", "y").alias("y"), "cosine")

    ranked = cut(best(of_members(ways).union(own)))
    if left_out.value:  # rows of crowded buckets and of wide regions
        slots = by_region.mapInArrow(_parted(plan, held), ", ".join(f"{c} long" for c in SLOTS)).repartition(n, "slot").sortWithinPartitions("slot", "probe")
        more = compared(slots.mapInArrow(_collide_slots(far, left_out, crowd), "a long, b long").repartition(n, "a").dropDuplicates(["a", "b"]))
        crowds = by_region.mapInArrow(_crowds(plan, crowd, held), "bucket long, id long").union(slots.mapInArrow(_crowded_slots(crowd), "bucket long, id long"))
        more = of_members(more.union(_search_crowds(crowds, vectors, dim, k + 1, floor, crowd)))
        ranked = cut(best(ranked.drop("rn").union(more).distinct()))
    single = ranked.join(heads.select(F.col("rep").alias("x")).distinct(), "x", "left_anti").where(F.col("rn") <= k).select(F.col("x").alias("id"), F.col("y").alias("neighbour"), "cosine", F.col("rn").alias("pos"))
    shared = ranked.join(heads.select(F.col("rep").alias("x")).distinct(), "x", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = shared.join(members.select(F.col("rep").alias("x"), "id", "salt"), ["x", "salt"]).where("id <> y")
    again = Window.partitionBy("id").orderBy("rn")
    copies = each.withColumn("pos", F.row_number().over(again)).where(F.col("pos") <= k).select("id", F.col("y").alias("neighbour"), "cosine", "pos")
    return single.union(copies)
