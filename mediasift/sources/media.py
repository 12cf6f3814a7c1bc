"""Media files and fetched bytes as tables, embedders, cached segments, and JSON-lines logs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol
from urllib.parse import urljoin, urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.functions.gates import content_type, ending, fetchable, media_content, status_class, unsafe_text
from mediasift.session import hadoop_path


def media_files(spark: SparkSession, folder: str, endings: Iterable[str] = (), most_bytes: int = 100 << 20) -> DataFrame:
    """Files below a folder with one of these endings (any without): `path`, `length`, `content_sha256`, `ending`, `fits` (no longer than `most_bytes`). Digests are made where the file is read; contents aren't kept. Empty files aren't listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    e = ending(F.col("path"))
    kept = files.where(e.isin(list(endings))) if endings else files
    return kept.select("path", "length", F.sha2("content", 256).alias("content_sha256"), e.alias("ending"), (F.col("length") <= most_bytes).alias("fits"))


def byte_range(content: Column, start: int, end: int | None = None) -> Column:
    """Bytes from `start` up to and with `end`, as in a Range header; what lies beyond the content is left out."""
    return F.substring(content, F.lit(start + 1), F.lit(2**31 - 1 if end is None else max(0, end - start + 1)))


def content_fingerprint(content: Column, length: Column, piece: int = 65536) -> Column:
    """SHA-1 of head, middle and tail of a content, with its length: for contents too long to digest whole."""
    middle = F.greatest(F.lit(0), F.floor((length - piece) / 2)).cast("int") + 1
    tail = F.greatest(F.lit(0), length - piece).cast("int") + 1
    parts = F.concat(F.substring(content, F.lit(1), F.lit(piece)), F.substring(content, middle, F.lit(piece)), F.substring(content, tail, F.lit(piece)))
    return F.sha1(F.concat(parts, F.encode(length.cast("string"), "utf-8")))


def fetch(requests: DataFrame, url: str, get: Callable[[str], tuple[int, str, bytes]], most_bytes: int = 100 << 20) -> DataFrame:
    """requests with `status`, `content_type`, `n_bytes`, `content_sha256` and `fault`, by a function that gets one address (status, content-type header, bytes). It runs on the executors, in batches; addresses that aren't http(s) are
    never asked for. A fault is `scheme`, a class of status, `content type`, `size`, or `error: ` and the exception's name."""
    extra = "status int, header string, n_bytes long, sha string, raised string"

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks:
            rows = []
            for u, ok in zip(pdf[url], pdf["_ok"]):
                try:
                    status, header, body = get(u) if ok else (None, None, None)
                    rows.append((status, header, None if body is None else len(body), None if body is None else hashlib.sha256(body).hexdigest(), None))
                except Exception as e:  # noqa: BLE001 - whatever the getter raises is the row's result
                    rows.append((None, None, None, None, type(e).__name__))
            new = pd.DataFrame(rows, columns=["status", "header", "n_bytes", "sha", "raised"], index=pdf.index).astype({"status": "Int32", "n_bytes": "Int64"})
            yield pd.concat([pdf.drop(columns="_ok"), new], axis=1)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema), extra])
    got = requests.withColumn("_ok", fetchable(F.col(url))).mapInPandas(run, schema)
    state = status_class(F.col("status"))
    fault = (
        F.when(~fetchable(F.col(url)), "scheme").when(F.col("raised").isNotNull(), F.concat(F.lit("error: "), "raised")).when(state != "ok", state)
        .when(~media_content(F.col("header")), "content type").when(F.col("n_bytes") > most_bytes, "size")
    )
    return got.withColumns({"content_type": content_type(F.col("header")), "fault": fault, "content_sha256": F.col("sha")}).drop("header", "raised", "sha")


class UnsafeDestinationError(Exception):
    pass


class RedirectLimitExceededError(Exception):
    pass


class SizeLimitExceededError(Exception):
    pass


class UnsupportedSchemeError(Exception):
    pass


def careful(open_: Callable[[str], tuple[int, dict[str, str], Iterable[bytes]]], resolve: Callable[[str], list[str]], most_hops: int = 5, most_bytes: int = 100 << 20) -> Callable[[str], tuple[int, str, bytes]]:
    """A getter for `fetch` from a function that opens one address (status, headers in lower case, chunks of the body) and one that resolves a host.

    Redirects are followed, `most_hops` of them; before each request, the first too, the scheme must be http or https and all addresses of the host public. The body is read chunk by chunk and
    given up as soon as it is longer than `most_bytes`, or at once if its length is announced. What goes wrong is raised under the names that `error_kind` knows."""

    def get(url: str) -> tuple[int, str, bytes]:
        for _ in range(most_hops + 1):
            parts = urlsplit(url)
            if parts.scheme.lower() not in ("http", "https"):
                raise UnsupportedSchemeError(parts.scheme)
            found = resolve(parts.hostname or "") if parts.hostname else []
            if not found or any(unsafe_text(x) for x in found):
                raise UnsafeDestinationError(parts.hostname)
            status, headers, chunks = open_(url)
            if status in (301, 302, 303, 307, 308) and headers.get("location"):
                url = urljoin(url, headers["location"])
                continue
            announced = headers.get("content-length", "")
            if announced.isdigit() and int(announced) > most_bytes:
                raise SizeLimitExceededError(announced)
            body = bytearray()
            for chunk in chunks:
                body += chunk
                if len(body) > most_bytes:
                    raise SizeLimitExceededError(len(body))
            return status, headers.get("content-type", ""), bytes(body)
        raise RedirectLimitExceededError(most_hops)

    return get


class ContentStore:
    """Contents by their SHA-256, once each, as Parquet in a folder by the first two digits: what others look for reads one part of 256."""

    SCHEMA = "content_sha256 string, content binary, shard string"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def put(self, df: DataFrame, content: str) -> None:
        """Contents that aren't there yet are written; null ones are left out, equal ones are one."""
        new = df.where(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("content_sha256"), F.col(content).alias("content")).dropDuplicates(["content_sha256"])
        missing = new.join(self.all().select("content_sha256"), "content_sha256", "left_anti")
        missing.withColumn("shard", F.substring("content_sha256", 1, 2)).write.mode("append").partitionBy("shard").parquet(self.folder)

    def all(self) -> DataFrame:
        fs, where = hadoop_path(self.spark, self.folder)
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder) if fs.exists(where) else self.spark.createDataFrame([], self.SCHEMA)

    def there(self, df: DataFrame, sha: str) -> DataFrame:
        """df with `stored`: whether the store has the content of that digest, in whatever letter case; null digests are not there."""
        known = self.all().select(F.col("content_sha256").alias("_sha"), F.lit(True).alias("_there"))
        return df.join(known, F.lower(F.col(sha)) == F.col("_sha"), "left").withColumn("stored", F.coalesce("_there", F.lit(False))).drop("_sha", "_there")


class Embedder(Protocol):
    """Makes vectors of pieces of media. Loaded once per Python worker."""

    dim: int

    def embed(self, pieces: list[bytes]) -> np.ndarray: ...


class DigestEmbedder:
    """A stand-in without a model: unit vectors from a digest of the bytes, the same for the same bytes."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, pieces: list[bytes]) -> np.ndarray:
        seeds = [int.from_bytes(hashlib.sha256(p).digest()[:8], "little") for p in pieces]
        x = np.stack([np.random.default_rng(s).standard_normal(self.dim) for s in seeds]) if pieces else np.zeros((0, self.dim))
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def embed(df: DataFrame, content: str, make: Callable[[], Embedder]) -> DataFrame:
    """df without its contents, with `vec` (null for null contents). `make` is called once per task."""
    keep = [c for c in df.columns if c != content]

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in chunks:
            there = pdf[content].notna()
            vectors = iter(model.embed([bytes(b) for b in pdf.loc[there, content]]).tolist())
            yield pdf[keep].assign(vec=[next(vectors) if t else None for t in there])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != content), "vec array<double>"])
    return df.mapInPandas(run, schema)


def timeline(clips: DataFrame, duration: str, segment_s: float) -> DataFrame:
    """clips with one row per segment of its duration: `segment_index`, `start_s`, `end_s`. The last may end past the clip; durations that are null, NaN or not above 0 have none."""
    d = F.col(duration)
    n = F.when(d.isNotNull() & ~F.isnan(d) & (d > 0), F.ceil(d / segment_s).cast("int"))
    i = clips.withColumn("segment_index", F.explode(F.sequence(F.lit(0), n - 1)))
    return i.withColumns({"start_s": F.col("segment_index") * F.lit(segment_s), "end_s": (F.col("segment_index") + 1) * F.lit(segment_s)})


def every_kth(frames: DataFrame, number: str, video_fps: float, sample_fps: float, most: int | None = None) -> DataFrame:
    """The frames that sampling at a lower rate takes, at most so many by number from 0."""
    k = max(1, round(video_fps / sample_fps)) if sample_fps > 0 else 1
    taken = frames.where(F.pmod(F.col(number), F.lit(k)) == 0)
    return taken if most is None else taken.where(F.col(number) < k * most)


class SegmentCache:
    """Segments by cache key, as Parquet in a folder any file system of Spark has; entries of another schema version, or without segments, count as missing."""

    SCHEMA = "cache_key string, schema_version int, segments array<struct<idx int, start_s double, end_s double, vec array<double>>>"

    def __init__(self, spark: SparkSession, folder: str, schema_version: int = 1) -> None:
        self.spark, self.folder, self.schema_version = spark, folder, schema_version

    def put(self, entries: DataFrame) -> None:
        """`cache_key` and `segments`. Of a key put again the later entry isn't needed: content and key agree."""
        entries.select("cache_key", F.lit(self.schema_version).alias("schema_version"), "segments").write.mode("append").parquet(self.folder)

    def get(self) -> DataFrame:
        fs, where = hadoop_path(self.spark, self.folder)
        if not fs.exists(where):
            return self.spark.createDataFrame([], self.SCHEMA)
        good = self.spark.read.schema(self.SCHEMA).parquet(self.folder).where((F.col("schema_version") == self.schema_version) & (F.size("segments") > 0) & ~F.exists("segments", lambda s: F.coalesce(F.size(s["vec"]), F.lit(0)) <= 0))
        return good.dropDuplicates(["cache_key"])

    def segments(self) -> DataFrame:
        """One row per segment."""
        return self.get().select("cache_key", F.inline("segments"))


def write_json_lines(df: DataFrame, folder: str) -> None:
    """One JSON object a row; nulls are left out."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(folder)


def redacted(url: Column) -> Column:
    """An address without the password it may hold."""
    return F.regexp_replace(url, r"^(\w+://[^/?#:@]*):[^/?#@]*@", "$1:***@")
