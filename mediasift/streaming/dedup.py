"""Exactly one delivery of each message of an at-least-once stream.

State: identifiers seen in the last `delay` of event time, in Spark's state store, one entry per hash bucket holding a
sorted block of digests; so it is as large as what the watermark spans, however long the stream runs. The store is committed with the micro-batch in the query's checkpoint, and the sink
writes folders by micro-batch, so a batch that is run again replaces what it wrote before: state and output agree after any
failure. Identifiers that expire behind the watermark move to an archive: a table by part, one generation per micro-batch, of which every FAN_IN become one, with a Bloom filter per part and
generation beside it. Identifiers new to the state are tested by these filters, and only those that pass are looked up, in their parts of the archive.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mediasift.session import cut, hadoop_path, lanes, remove, width

ENTRY = np.dtype([("h", "<i8"), ("g", "<i8"), ("id", "<i8"), ("at", "<i8")])
OUT = "kind string, id long, h long, g long"
BLOOM_BITS, BLOOM_HASHES = 12, 6
#: So many generations of the archive become one.
FAN_IN = 4
#: A task of a micro-batch and a part of the archive are to get so many bytes of the stream's files; a task besides so many of all that is expected, for the state. Fewer rows than FEW are sent to all tasks.
TASK_BYTES, PART_BYTES, ALL_BYTES, FEW = 16e6, 128e6, 512e6, 200_000
WIDTH = "spark.sql.shuffle.partitions"


def digest(keys: Sequence[Column]) -> tuple[Column, Column]:
    """128 bits over the keys; a null is a value of its own, unlike any text."""
    marked = [F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("-")) for k in keys]
    return F.xxhash64(*marked), F.xxhash64(F.lit("second"), *marked)


def _positions(h: np.ndarray, g: np.ndarray, bits: int) -> np.ndarray:
    steps = np.arange(BLOOM_HASHES, dtype=np.uint64)[:, None]
    with np.errstate(over="ignore"):
        return (h.astype(np.uint64) + steps * (g.astype(np.uint64) | np.uint64(1))) % np.uint64(bits)


def bloom(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """A filter of these digests, as packed bits."""
    bits = np.zeros(max(64, -(-len(h) * BLOOM_BITS // 8) * 8), dtype=bool)
    bits[_positions(h, g, len(bits)).ravel()] = True
    return np.packbits(bits)


def in_bloom(packed: np.ndarray, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    at = _positions(h, g, len(packed) * 8)
    return ((packed[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=0)


def first_of_each(rows: np.ndarray, old: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries in any order: the smallest id of each digest with the latest time seen, the ids of all others, and
    which of the digests aren't among the first `old` entries. A delivery that is read twice is no copy of itself."""
    if not len(rows):
        return rows, np.empty(0, "<i8"), np.empty(0, bool)
    order = np.lexsort((rows["id"], rows["g"], rows["h"]))
    new = np.ones(len(rows), bool)
    rows = rows[order]
    new[1:] = (rows["h"][1:] != rows["h"][:-1]) | (rows["g"][1:] != rows["g"][:-1])
    starts = np.flatnonzero(new)
    kept = rows[starts].copy()
    kept["at"] = np.maximum.reduceat(rows["at"], starts)
    again = np.r_[False, rows["id"][1:] == rows["id"][:-1]]
    return kept, rows["id"][~new & ~again], np.minimum.reduceat(order, starts) >= old


def _entries(pdf: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(pdf), ENTRY)
    for c in ("h", "g", "id", "at"):
        out[c] = pdf[c].to_numpy()
    return out


def _combine(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Before the shuffle: copies within an Arrow batch are marked and spread, so that a message with very many copies
    sends its bucket one row per batch."""
    for pdf in chunks:
        kept, extra, _ = first_of_each(_entries(pdf))
        marked = np.zeros(len(extra), ENTRY)
        marked["id"] = extra
        both = np.concatenate([kept, marked])
        copy = np.arange(len(both)) >= len(kept)
        yield pd.DataFrame({"spread": np.where(copy, both["id"], both["h"]), "copy": copy} | {c: both[c] for c in ENTRY.names})


def _rows(kind: str, ids: np.ndarray, h: np.ndarray | int = 0, g: np.ndarray | int = 0) -> pd.DataFrame:
    return pd.DataFrame({"kind": kind, "id": ids, "h": h, "g": g})


def _advance(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One bucket's step: the drops, what is new to it, and the expired identifiers of this micro-batch."""
    live = np.frombuffer(state.get[0], ENTRY) if state.exists else np.empty(0, ENTRY)
    fresh = np.empty(0, ENTRY)
    for pdf in chunks:
        copy = pdf["copy"].to_numpy(dtype=bool)
        if copy.any():
            yield _rows("drop", pdf["id"].to_numpy()[copy])
        fresh, extra, _ = first_of_each(np.concatenate([fresh, _entries(pdf[~copy])]))
        if len(extra):
            yield _rows("drop", extra)
    before = live
    live, extra, ask = first_of_each(np.concatenate([before, fresh]), old=len(before))
    if len(extra):
        yield _rows("drop", extra)
    # also where a smaller id takes a live one's place: that one's lookup didn't compare it; both are in order of digests
    ask[~ask] = live["id"][~ask] < before["id"]
    mark = state.getCurrentWatermarkMs()
    if ask.any() and mark > 0:  # before the first watermark nothing can have expired
        asked = live[ask]
        yield _rows("ask", asked["id"], asked["h"], asked["g"])
    old = live["at"] < mark
    if old.any():
        gone, live = live[old], live[~old]
        yield _rows("archive", gone["id"], gone["h"], gone["g"])
    state.update((live.tobytes(),))


def judge(rows: DataFrame, keys: Sequence[Column], order: str, event_time: str, delay: str, buckets: int) -> DataFrame:
    """The stateful part: a stream of deliveries to a stream of `drop`, `ask` and `archive` rows."""
    h, g = digest(keys)
    at = F.coalesce(F.unix_millis(F.col(event_time).cast("timestamp")), F.lit(0))
    entries = rows.select(h.alias("h"), g.alias("g"), F.col(order).cast("long").alias("id"), at.alias("at")).where("id IS NOT NULL")
    spread = entries.mapInPandas(_combine, "spread long, copy boolean, h long, g long, id long, at long")
    return (
        spread.withColumn("seen_at", F.timestamp_millis("at"))
        .withWatermark("seen_at", delay)
        .withColumn("bucket", F.pmod(F.xxhash64("spread"), F.lit(buckets)).cast("int"))
        .groupBy("bucket")
        .applyInPandasWithState(_advance, OUT, "block binary", "append", GroupStateTimeout.NoTimeout)
    )


class Archive:
    """Expired identifiers in a folder, in `parts` parts by digest; generations of micro-batches, each a span of them."""

    ROWS, FILTERS = "h long, g long, id long, part int", "part int, bits binary"

    def __init__(self, spark: SparkSession, folder: str, parts: int, tasks: int | None = None) -> None:
        self.spark, self.folder, self.parts, self.tasks = spark, folder, parts, tasks or parts

    def part(self) -> Column:
        return F.pmod(F.col("h"), F.lit(self.parts)).cast("int")

    def spans(self, before: int) -> list[tuple[int, int]]:
        """Complete generations of earlier micro-batches, oldest first, without those that a later one holds."""
        fs, where = hadoop_path(self.spark, f"{self.folder}/filters")
        names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
        done = [n for n in names if fs.exists(hadoop_path(self.spark, f"{self.folder}/filters/{n}/_SUCCESS")[1])]
        all_ = sorted(tuple(map(int, n.split("_"))) for n in done)
        return [(lo, hi) for lo, hi in all_ if hi < before and not any((a, b) != (lo, hi) and a <= lo and hi <= b < before for a, b in all_)]

    def _read(self, kind: str, schema: str, spans: Sequence[tuple[int, int]]) -> DataFrame:
        base = [f"{self.folder}/{kind}/{lo}_{hi}" for lo, hi in spans]
        one = lambda path: self.spark.read.schema(schema).parquet(path)
        return reduce(DataFrame.union, map(one, base))

    def add(self, rows: DataFrame, lo: int, hi: int) -> None:
        """A generation: its rows (`h`, `g`, `id`) by part, then its filters; it counts once these are complete."""
        placed = rows.withColumn("part", self.part()).repartition(self.tasks, "part").sortWithinPartitions("part", "h")
        placed.write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/archive/{lo}_{hi}")

        def packed(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": rows["part"].iloc[:1], "bits": [bloom(rows["h"].to_numpy(), rows["g"].to_numpy()).tobytes()]})

        self._read("archive", self.ROWS, [(lo, hi)]).groupBy("part").applyInPandas(packed, self.FILTERS).write.mode("overwrite").parquet(f"{self.folder}/filters/{lo}_{hi}")

    def compact(self, before: int) -> None:
        """FAN_IN generations of like age become one, again and again, as long as there are so many: of the newest first. Only generations of finished micro-batches are touched, so a batch
        that is run again finds what it found before; a message's smallest id is all that stays."""
        spans = self.spans(before)
        while len(spans) >= FAN_IN and spans[-FAN_IN][1] - spans[-FAN_IN][0] <= sum(hi - lo + 1 for lo, hi in spans[1 - FAN_IN :]):
            old = spans[-FAN_IN:]
            lo, hi = old[0][0], old[-1][1]
            self.add(self._read("archive", self.ROWS, old).groupBy("h", "g").agg(F.min("id").alias("id")), lo, hi)
            for a, b in old:
                for kind in ("filters", "archive"):
                    remove(self.spark, f"{self.folder}/{kind}/{a}_{b}")
            spans = self.spans(before)

    def find(self, asked: DataFrame, before: int) -> DataFrame | None:
        """`id` and `first`, the smallest archived id, of those rows (`h`, `g`, `id`) that earlier micro-batches archived; None if they archived nothing."""
        spans = self.spans(before)
        if not spans:
            return None

        def passing(key: tuple, rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            hit = np.zeros(len(rows), bool)
            for bits in filters["bits"]:
                hit |= in_bloom(np.frombuffer(bits, np.uint8), rows["h"].to_numpy(), rows["g"].to_numpy())
            return rows[hit]

        parted = asked.select("h", "g", "id").withColumn("part", self.part())
        tested = cut(parted.groupBy("part").cogroup(self._read("filters", self.FILTERS, spans).groupBy("part")).applyInPandas(passing, "h long, g long, id long, part int"))
        touched = dict(map(tuple, tested.groupBy("part").count().collect()))  # at most as many as there are parts
        there = self._read("archive", self.ROWS, spans).where(F.col("part").isin([*touched])).select("h", "g", F.col("id").alias("first"))
        few = sum(touched.values()) <= FEW  # so the archive isn't shuffled
        return there.join(F.broadcast(tested) if few else tested, ["h", "g"]).groupBy("id").agg(F.min("first").alias("first"))


def resolve(judged: DataFrame, batch: int, out: str, parts: int, tasks: int | None = None) -> None:
    """Sink of one micro-batch: its rows in one folder, then the answers of the archive to what is new, then what expired into the archive."""
    spark = judged.sparkSession
    where = f"{out}/judged/batch={batch}"
    judged.write.mode("overwrite").partitionBy("kind").parquet(where)
    fs, _ = hadoop_path(spark, where)
    there = {k for k in ("ask", "archive") if fs.exists(hadoop_path(spark, f"{where}/kind={k}")[1])}
    mine = lambda k: spark.read.schema("id long, h long, g long").parquet(f"{where}/kind={k}")
    archive = Archive(spark, out, parts, tasks)
    if "ask" in there:
        archive.compact(batch)
        found = archive.find(mine("ask"), batch)
        if found is not None:
            # whichever is later goes; if that is the archived one, the live one stands for the message from now on
            found.where("id <> first").select(F.greatest("id", "first").alias("id")).write.mode("overwrite").parquet(f"{out}/late/batch={batch}")
    if "archive" in there:
        archive.add(mine("archive"), batch, batch)


def drop_redelivered(
    stream: DataFrame,
    keys: Sequence[Column],
    order: str,
    event_time: str,
    folder: str,
    delay: str = "1 day",
    buckets: int | None = None,
    expected: tuple[float, float] = (0, 0),
) -> StreamingQuery:
    """Start the query; it ends when all input that is there by now is read. `dropped` reads its result.

    A message is what has the same `keys`, where null equals null. `order` is an integer that tells deliveries apart and
    grows with arrival: the delivery with the smallest stays, also if it turns up after another copy, and all others
    are reported as dropped. Rows whose `order` is null can't be named and take no part. A row without event time counts
    as the oldest: its identifier goes to the archive with the next watermark. Copies are found however far apart they
    are: within `delay` of event time in the state, beyond it by the lookup. Other columns are never read. An empty
    stream drops nothing.

    `folder` holds checkpoint and output; starting again with the same folder goes on where the last run ended, in the same number of tasks, buckets and parts.
    `expected` says how many bytes the stream and a micro-batch have (`bytes_of`). A micro-batch gets tasks by these and the cores: the session's width, which is that of a pass over the whole table, would
    make each micro-batch dearer with the size of the table.
    """
    spark = stream.sparkSession
    tasks = lanes(spark, max(expected[1], expected[0] * TASK_BYTES / ALL_BYTES), TASK_BYTES)
    tasks, n, parts = _kept(spark, f"{folder}/sizes", [tasks, buckets or 4 * tasks, lanes(spark, expected[0], PART_BYTES) if expected[0] else width(spark)])
    query = judge(stream, keys, order, event_time, delay, n).writeStream.foreachBatch(lambda df, batch: resolve(df, batch, folder, parts, tasks))
    wide = spark.conf.get(WIDTH)
    spark.conf.set(WIDTH, tasks)  # a query has a copy of the session's settings, taken as it starts
    try:
        return query.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set(WIDTH, wide)


def _kept(spark: SparkSession, where: str, numbers: list[int]) -> list[int]:
    """What the folder's first run wrote there, or these numbers, written there now."""
    fs, path = hadoop_path(spark, where)
    if fs.exists(path):
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
    out = fs.create(path, True)
    try:
        out.write(json.dumps(numbers).encode())
    finally:
        out.close()
    return numbers


def dropped(spark: SparkSession, folder: str) -> DataFrame:
    """`id` of all dropped deliveries of a query's folder, once each."""
    ids = [read_log(spark, f"{folder}/judged", OUT + ", batch int").where("kind = 'drop'").select("id"), read_log(spark, f"{folder}/late", "id long, batch int").select("id")]
    return ids[0].union(ids[1]).distinct()


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of micro-batches; no rows if none wrote to it."""
    fs, where = hadoop_path(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(where) else spark.createDataFrame([], schema)


def stream_of(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A stream over the part files of a table, some at a time; a table of one file is found in its folder by name."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    fs, where = hadoop_path(spark, path)
    if fs.getFileStatus(where).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def bytes_of(spark: SparkSession, path: str, files_per_batch: int = 4) -> tuple[float, float]:
    """Of a table that is streamed by so many files: its bytes, and those of a micro-batch."""
    fs, where = hadoop_path(spark, path)
    all_ = fs.getContentSummary(where)
    return all_.getLength(), all_.getLength() * min(1, files_per_batch / max(1, all_.getFileCount()))
