"""Identities by digest of canonical JSON: sorted keys, ", " and ": " between parts, everything but ASCII escaped."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(c: Column) -> Column:
    """A text as a JSON string, null as null. What needs more than quotes goes to Python in Arrow batches."""

    @F.pandas_udf("string")
    def escaped(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: None if t is None else json.dumps(t))

    plain = c.rlike(r'^[\x20-\x7e&&[^"\\]]*\z')
    return F.coalesce(F.when(plain, F.concat(F.lit('"'), c, F.lit('"'))), escaped(F.when(~plain, c)), F.lit("null"))


def json_object(fields: Mapping[str, Column]) -> Column:
    """An object of JSON values, by name."""
    parts = [x for i, n in enumerate(sorted(fields)) for x in (F.lit(f"{', ' if i else ''}{json.dumps(n)}: "), fields[n])]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def json_list(items: Column) -> Column:
    """An array of printable ASCII texts as a JSON list."""
    quoted = F.transform(items, lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def job_id(url: Column, target_id: Column, target_version: Column, techniques: Column) -> Column:
    """32 hex digits that the same request always gets; the order of techniques doesn't matter, repeats do."""
    payload = json_object({"candidate_url": json_text(url), "target_id": json_text(target_id), "target_version": json_text(target_version), "techniques": json_list(F.array_sort(techniques))})
    return F.substring(F.sha2(payload, 256), 1, 32)


def spec_key(spec: Mapping[str, object]) -> str:
    """16 hex digits of an embedding specification."""
    import hashlib

    return hashlib.sha256(json.dumps(dict(spec), sort_keys=True).encode()).hexdigest()[:16]


def cache_key(target_id: Column, target_version: Column, content_sha256: Column, spec: str) -> Column:
    """The identity of one cached representation: target, content and specification."""
    return F.sha2(json_object({"target_id": json_text(target_id), "target_version": json_text(target_version), "content_sha256": json_text(content_sha256), "spec_key": F.lit(json.dumps(spec))}), 256)


def legacy_cache_key(path: Column, size: Column, mtime_ns: Column, model: Column, fps: Column, algorithm: str) -> Column:
    """SHA-1 of a file's path, size and time, the model, frame rate (5 places) and algorithm, joined by bars; null if one of them is."""
    parts = [path, size.cast("string"), mtime_ns.cast("string"), model, F.format_string("fps=%.5f", fps.cast("double")), F.lit(f"algo={algorithm}")]
    there = path.isNotNull() & size.isNotNull() & mtime_ns.isNotNull() & model.isNotNull() & fps.isNotNull()
    return F.when(there, F.sha1(F.concat_ws("|", *parts)))


UNIT = "\x1f"


def index_member(target_id: Column, target_version: Column) -> Column:
    """A target and its version as one text."""
    return F.concat(target_id, F.lit(UNIT), target_version)


def index_member_parts(member: Column) -> tuple[Column, Column]:
    """Target and version of `index_member`, split at the first unit separator; null without one."""
    at = F.instr(member, UNIT)
    return F.when(at > 0, F.substring(member, F.lit(1), at - 1)), F.when(at > 0, F.substring(member, at + 1, F.length(member)))


#: Names of the keys that the reference keeps; `{}` stands for each part in turn.
KEYS = {
    "stream": "fingerprint:jobs:stream:{}", "state": "fingerprint:job:{}:state", "retry": "fingerprint:retry:delayed:{}", "result": "fingerprint:job:{}:result", "results_stream": "fingerprint:results:stream:{}",
    "target": "fingerprint:target:{}:{}", "target_content": "fingerprint:target:content:{}", "target_embeddings": "fingerprint:target:{}:{}:embeddings", "target_segment_embeddings": "fingerprint:target:{}:{}:segment_embeddings",
    "target_lock": "fingerprint:lock:target:{}", "submission": "fingerprint:submission:{}", "marker": "{}.marker",
}


def named_key(kind: str, *parts: Column) -> Column:
    """A key of `KEYS` from its parts; null if one is."""
    pieces = KEYS[kind].split("{}")
    if len(pieces) != len(parts) + 1:
        raise ValueError(f"{kind} has {len(pieces) - 1} parts")
    return F.concat(F.lit(pieces[0]), *(x for p, rest in zip(parts, pieces[1:]) for x in (p, F.lit(rest))))


def asset_file_name(asset_id: Column, url: Column) -> Column:
    """asset_ID with the ending of the address's path as written, .bin without one."""
    path = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)[?#].*$", ""), r"^\w+://[^/]*", "")
    name = F.regexp_extract(path, r"([^/]*)/*\z", 1)
    suffix = F.regexp_extract(name, r"^\.*[^.].*(\.[^.]+)\z", 1)
    return F.concat(F.lit("asset_"), asset_id.cast("string"), F.when(suffix == "", ".bin").otherwise(suffix))


def queue_task_key(asset_id: Column) -> Column:
    return F.concat(F.lit("queue_asset:"), asset_id.cast("string"))


def file_task_key(candidate_path: Column, target_path: Column, techniques: Column) -> Column:
    """Paths are taken as resolved; no target is empty, and techniques are a set, in order."""
    return F.concat(F.lit("file:"), candidate_path, F.lit("|target:"), F.coalesce(target_path, F.lit("")), F.lit("|techniques:"), F.array_join(F.array_sort(F.array_distinct(techniques)), ","))


def synthetic_asset_id(key: Column) -> Column:
    """2,000,000,000 and the first 32 bits of the key's SHA-1."""
    return F.lit(2_000_000_000).cast("long") + F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long")


def clock(seconds: Column) -> Column:
    """Seconds as HH:MM:SS.mmm; hours go on beyond 99, null stays null."""
    ms = F.round(seconds.cast("double") * 1000).cast("long")
    return F.when(ms.isNotNull(), F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.pmod(F.floor(ms / 60_000), F.lit(60)), F.pmod(F.floor(ms / 1000), F.lit(60)), F.pmod(ms, F.lit(1000))))


def file_url(path: Column) -> Column:
    """An absolute path as a file address, each part escaped."""
    parts = F.transform(F.split(path, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")))
    return F.concat(F.lit("file://"), F.array_join(parts, "/"))
