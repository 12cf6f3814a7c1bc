"""New batches against all media accepted before, by graph shards over key digests.

`MediaHistory` keeps the shards in a folder: one graph per batch and part of the keys, compacted on a schedule. A batch is one pass: each task holds some parts, reads the live shards of just
these, and writes those that it adds or compacts; records of the past are never read again. Which shards are live is said by a manifest per batch, written when the batch is done, so a task
or batch that is run again leaves no trace but files that no manifest names. `replay` runs the batches of a table through such a history, one by one, as they came.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.llm.ring_graph import RingGraph, Shards
from mediasift.session import cut, hadoop_path, lanes, remove, scratch, width

SALTS = 16
NO_BATCH = 2**31 - 1
#: A part of a history is to hold so many keys, about 80 bytes each and 350 while it is linked.
PART_KEYS = 500_000


def digests(df: DataFrame, keys: Mapping[str, Column], carry: list[str]) -> DataFrame:
    """One row per record and key that names something: `h`, `g` (128 bits over the key's kind and text) and `carry`."""
    each = F.explode(F.array(*(F.when(v.isNotNull(), F.struct(F.xxhash64(F.lit(n), v).alias("h"), F.xxhash64(v, F.lit(n)).alias("g"))) for n, v in keys.items())))
    return df.select(*carry, each.alias("_e")).where("_e IS NOT NULL").select(*carry, "_e.*")


def replay(records: DataFrame, keys: Mapping[str, Column], record: str, order: str, batch: str, parts: int | None = None) -> DataFrame:
    """Records that repeat what was accepted before: `record`, and `first` (the record accepted first), distinct.

    `record` names a record (not null), `order` is a unique integer in order of arrival, `batch` the batch it came in;
    batches come in the order of their numbers, records without one last. A record repeats another if any key of theirs is equal;
    it is paired with the first record of that key, so with two keys it may be paired twice. Null keys name nothing; no records give no rows.

    Each batch is checked against the shards that the batches before it left in a folder. Skew: of a key and batch one row is searched; a key's records meet its first one under a salt.
    """
    spark = records.sparkSession
    named = records.select(F.col(record).alias("record"), F.col(order).alias("id"), F.coalesce(F.col(batch), F.lit(NO_BATCH)).cast("int").alias("batch"), *(v.alias(f"k_{n}") for n, v in keys.items()))
    keyed = cut(digests(named, {n: F.col(f"k_{n}") for n in keys}, ["record", "id", "batch"]))
    arrived = scratch(spark, "arrived")
    searched = keyed.groupBy("h", "g", "batch").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    searched.write.partitionBy("batch").parquet(arrived)
    sizes = dict(map(tuple, keyed.groupBy("batch").count().collect()))  # as many as there are batches
    history = MediaHistory(spark, scratch(spark, "history"), parts or lanes(spark, sum(sizes.values()), PART_KEYS))
    for number in sorted(sizes):
        history.run(spark.read.schema("h long, g long, id long, n long").parquet(f"{arrived}/batch={number}"), number)
    for where in (arrived, f"{history.folder}/shards"):  # only the hits are read from here on
        remove(spark, where)
    found = history.hits().groupBy("h", "g").agg(F.min("first").alias("first"))
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = cut(keyed.withColumn("salt", F.pmod("id", F.lit(SALTS)).cast("int")).join(salted, ["h", "g", "salt"]).select("h", "g", "salt", "record", "id", "first"))
    firsts = members.where("id = first").select("h", "g", F.col("record").alias("_first"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = members.where("id <> first").join(firsts, ["h", "g", "salt"]).where("record <> _first")
    return pairs.select(F.col("record").alias(record), F.col("_first").alias("first")).distinct()


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _step(folder: str, live: dict[int, list[tuple[int, int, str]]], number: int):
    """The rows of some parts, sorted by part: what repeats earlier media, and the shards that are live now."""

    def part_of(part: int, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        system, root = _file_system(folder)
        shards, read = Shards(), 0
        for low, high, name in live.get(part, []):
            with system.open_input_file(f"{root}/{name}") as f:
                block = f.read()
            read += len(block)
            shards.graphs.append(RingGraph.of_bytes(block))
            shards.spans.append((low, high))
        h, g, ids = rows["h"].to_numpy().view("u8"), rows["g"].to_numpy(), rows["id"].to_numpy()
        first = shards.accept(h, g, ids, number)
        hit = (first >= 0) | (rows["n"].to_numpy() > 1)
        yield pd.DataFrame({"h": rows["h"][hit], "g": rows["g"][hit], "first": np.where(first < 0, ids, first)[hit]})
        kept = {(low, high): name for low, high, name in live.get(part, [])}
        names = []
        for graph, (low, high) in zip(shards.graphs, shards.spans):
            name = kept.get((low, high)) if high < number else None
            if name is None:
                name = f"shards/{part}-{low}-{high}-{uuid.uuid4().hex}"
                system.create_dir(f"{root}/shards", recursive=True)
                with system.open_output_stream(f"{root}/{name}") as f:
                    f.write(graph.to_bytes())
            names.append((low, high, name))
        yield pd.DataFrame([(part, *x, read) for x in names], columns=["part", "low", "high", "name", "read"])

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["h", "g", "first", "part", "low", "high", "name", "read"]
        kinds = {c: "Int64" for c in columns if c != "name"} | {"name": object}
        waiting: list[pd.DataFrame] = []
        for pdf in [*chunks, None]:
            for part, rows in pdf.groupby("part") if pdf is not None else [(None, None)]:
                if waiting and (rows is None or waiting[0]["part"].iloc[0] != part):
                    for out in part_of(int(waiting[0]["part"].iloc[0]), pd.concat(waiting, ignore_index=True)):
                        out = out.reindex(columns=columns).astype(kinds)
                        yield out.assign(name=out["name"].where(out["name"].notna(), None))
                    waiting = []
                if rows is not None:
                    waiting.append(rows)

    return run


class MediaHistory:
    """Accepted keys as graph shards in a folder that all executors share (and pyarrow can read), in `parts` parts by digest. A task loads the shards of a part, about 80 bytes a key, so there should be
    a part per few million keys that are ever expected; a folder keeps the number of its first batch."""

    ROW = "h long, g long, first long, part int, low int, high int, name string, read long"

    def __init__(self, spark: SparkSession, folder: str, parts: int = 64) -> None:
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts

    def add(self, batch: DataFrame, number: int) -> DataFrame:
        """A batch (`h`, `g`, `id`, distinct digests, and `n`, how many records have each; 1 without it) with a number larger than all before: `h`, `g` and `first` of its digests that were accepted before or that it
        holds more than once; `first` is the id accepted first. Adding the last batch again replaces it."""
        self.run(batch, number)
        return self.hits(number)

    def run(self, batch: DataFrame, number: int) -> None:
        """`add` without reading its result: one job, and one that reads the names of the new shards."""
        live = self.manifest(number)
        parts = live.get("parts", self.parts)
        shards = {int(p): [tuple(x) for x in v] for p, v in live.get("shards", {}).items()}
        rows = batch if "n" in batch.columns else batch.groupBy("h", "g").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
        placed = rows.select("h", "g", "id", "n", F.pmod("h", F.lit(parts)).cast("int").alias("part")).repartition(min(parts, width(self.spark)), "part").sortWithinPartitions("part")
        out = f"{self.folder}/out/batch={number}"
        found = placed.mapInPandas(_step(self.folder, shards, number), self.ROW).withColumn("kind", F.when(F.col("name").isNull(), "hit").otherwise("shard"))
        found.write.mode("overwrite").partitionBy("kind").parquet(out)
        # a few rows a part
        named = self.spark.read.schema("part int, low int, high int, name string, read long").parquet(f"{out}/kind=shard").collect()
        read: dict[int, int] = {}
        for r in named:
            read[r["part"]] = r["read"]
        now = {p: v for p, v in shards.items() if p not in read}
        for r in sorted(named):
            now.setdefault(r["part"], []).append((r["low"], r["high"], r["name"]))
        self._commit(number, {"parts": parts, "shards": now, "bytes_read": sum(read.values())})

    def hits(self, number: int | None = None) -> DataFrame:
        """What a batch repeated, or what all did."""
        where = f"{self.folder}/out" if number is None else f"{self.folder}/out/batch={number}"
        fs, path = hadoop_path(self.spark, where)
        rows = self.spark.read.schema("h long, g long, first long, kind string").parquet(where) if fs.exists(path) else self.spark.createDataFrame([], "h long, g long, first long, kind string")
        return rows.where("kind = 'hit'").select("h", "g", "first")

    def _numbers(self) -> list[int]:
        fs, where = hadoop_path(self.spark, f"{self.folder}/manifests")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(where) if x.getPath().getName().isdigit()) if fs.exists(where) else []

    def manifest(self, before: int | None = None) -> dict:
        """The last manifest, or the last one before a batch: `parts`, `shards` (by part the first and last batch and file of each live one) and `bytes_read` of history for that batch."""
        known = [n for n in self._numbers() if before is None or n < before]
        if not known:
            return {}
        fs, path = hadoop_path(self.spark, f"{self.folder}/manifests/{known[-1]}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, number: int, manifest: dict) -> None:
        """Written aside and renamed. The shards that this batch replaced are kept, as they are asked for if it is run again; those that the batch before it replaced go, and so do those of an
        earlier run of this batch."""
        before, again = self.manifest(number), self.manifest(number + 1) if number in self._numbers() else {}
        names = lambda m: {x[2] for v in m.get("shards", {}).values() for x in v}
        kept = names(manifest) | names(before)
        manifest["replaced"] = sorted(names(before) - names(manifest))
        fs, aside = hadoop_path(self.spark, f"{self.folder}/manifests/_{number}-{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        _, final = hadoop_path(self.spark, f"{self.folder}/manifests/{number}")
        fs.delete(final, False)
        fs.rename(aside, final)
        for name in (set(before.get("replaced", [])) | names(again)) - kept:
            remove(self.spark, f"{self.folder}/{name}")
