"""Predicates and classifications on single values. Each is total: null has a defined result."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# IPv4 networks that no public destination lies in.
UNSAFE_NETWORKS = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
]
# Addresses within those that are public all the same.
SAFE_WITHIN = ["192.0.0.9/32", "192.0.0.10/32"]
# File endings of video and image media.
VIDEO_ENDINGS = ["avi", "flv", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "ts", "webm", "wmv"]
IMAGE_ENDINGS = ["bmp", "gif", "jpeg", "jpg", "png", "svg", "tif", "tiff", "webp"]
# Kinds of errors, by the name of the error.
ERROR_KINDS = {
    "TransientAcquisitionError": "transient_acquisition_failure",
    "PermanentAcquisitionError": "permanent_acquisition_failure",
    "UnsupportedSchemeError": "permanent_acquisition_failure",
    "ConnectionTimeoutError": "transient_acquisition_failure",
    "ReadTimeoutError": "transient_acquisition_failure",
    "NetworkError": "transient_acquisition_failure",
    "RedirectLimitExceededError": "permanent_acquisition_failure",
    "UnsafeDestinationError": "permanent_acquisition_failure",
    "NotFoundError": "permanent_acquisition_failure",
    "GoneError": "permanent_acquisition_failure",
    "ClientError": "permanent_acquisition_failure",
    "RateLimitedError": "transient_acquisition_failure",
    "ServerError": "transient_acquisition_failure",
    "UnexpectedStatusError": "permanent_acquisition_failure",
    "UnsupportedContentTypeError": "permanent_acquisition_failure",
    "SizeLimitExceededError": "permanent_acquisition_failure",
    "InvalidMediaError": "media_validation_failure",
    "UnsupportedMediaError": "media_validation_failure",
    "ModelLoadError": "embedding_failure",
    "DeviceUnavailableError": "embedding_failure",
    "InferenceError": "embedding_failure",
    "KeyError": "malformed_job",
    "UnsupportedTechnique": "malformed_job",
    "JobValidationError": "malformed_job",
    "TimeoutError": "redis_coordination_failure",
}
# Errors that are worth another attempt; a lost store counts among them, though it has no kind.
TRANSIENT = ["TransientAcquisitionError", "ConnectionTimeoutError", "ReadTimeoutError", "NetworkError", "RateLimitedError", "ServerError", "TimeoutError", "SharedArtifactStoreError"]
# Errors of embedding, which count by the side they came up on: a candidate's is its result, a target's is tried again or not.
EMBEDDING_RETRY = {"UnsupportedMediaError": "permanent", "InferenceError": "transient", "ModelLoadError": "startup", "DeviceUnavailableError": "startup"}
# Types that a file's ending stands for.
MIME_TYPES = {
    "avi": "video/x-msvideo", "m4v": "video/x-m4v", "mkv": "video/x-matroska", "mov": "video/quicktime", "mp4": "video/mp4", "mpeg": "video/mpeg", "mpg": "video/mpeg", "webm": "video/webm",
    "bmp": "image/bmp", "gif": "image/gif", "jpeg": "image/jpeg", "jpg": "image/jpeg", "png": "image/png", "svg": "image/svg+xml", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp",
}


def ipv4_number(address: Column) -> Column:
    """A dotted address as a number, or null if it isn't one."""
    parts = F.split(address, r"\.")
    good = address.rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}\z") & ~F.exists(parts, lambda p: p.cast("int") > 255)
    return F.when(good, sum(parts[i].cast("long") * (1 << (24 - 8 * i)) for i in range(4)))


def unsafe_ipv4(address: Column) -> Column:
    """Whether a dotted address lies in a network that isn't public; null if it's no such address."""
    n = ipv4_number(address)

    def within(networks: list[str]) -> Column:
        nets = [ipaddress.ip_network(x) for x in networks]
        return sum((n.between(int(x[0]), int(x[-1])).cast("int") for x in nets), F.lit(0)) > 0

    return within(UNSAFE_NETWORKS) & ~within(SAFE_WITHIN)


def unsafe_text(text: str | None) -> bool:
    """Whether one address, IPv4 or IPv6, isn't public; what is no address isn't either."""
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return True
    if a.version == 6 and a.ipv4_mapped:
        a = a.ipv4_mapped
    shared = a.version == 4 and a in ipaddress.ip_network("100.64.0.0/10")
    return a.is_loopback or a.is_private or a.is_link_local or a.is_unspecified or a.is_multicast or a.is_reserved or shared


def unsafe_address(address: Column) -> Column:
    """The same for IPv4, by ranges, and IPv6, in Arrow batches; what is no address, and null, is unsafe."""

    @F.pandas_udf("boolean")
    def other(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: None if t is None else unsafe_text(t))

    v4 = unsafe_ipv4(address)
    return F.coalesce(v4, other(F.when(v4.isNull(), address)), F.lit(True))


def safe_destination(addresses: Column) -> Column:
    """Whether a host resolved to at least one address, and all of them, IPv4 or IPv6, are public. Lists of dotted addresses stay in the JVM; those with others go to Arrow batches."""

    @F.pandas_udf("boolean")
    def mixed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in parts:
            yield lists.map(lambda a: None if a is None else len(a) > 0 and not any(x is None or unsafe_text(x) for x in a))

    dotted = ~F.exists(addresses, lambda a: ipv4_number(a).isNull())
    public = (F.size(addresses) > 0) & ~F.exists(addresses, lambda a: F.coalesce(unsafe_ipv4(a), F.lit(True)))
    return F.coalesce(F.when(dotted, public).otherwise(mixed(F.when(~dotted, addresses))), F.lit(False))


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def fetchable(url: Column) -> Column:
    """Whether an address has scheme http or https; null hasn't."""
    return F.coalesce(F.lower(url).rlike(r"^https?://"), F.lit(False))


def status_class(status: Column) -> Column:
    """ok, not_found, gone, rate_limited, server_error, client_error or unexpected (null too)."""
    return (
        F.when(status.between(200, 299), "ok").when(status == 404, "not_found").when(status == 410, "gone").when(status == 429, "rate_limited")
        .when(status.between(500, 599), "server_error").when(status.between(400, 499), "client_error").otherwise("unexpected")
    )


def content_type(header: Column) -> Column:
    """The bare type of a header in lower case; without one application/octet-stream."""
    bare = F.lower(F.trim(F.split_part(F.coalesce(header, F.lit("")), F.lit(";"), F.lit(1))))
    return F.when(bare == "", "application/octet-stream").otherwise(bare)


def media_content(header: Column) -> Column:
    """Whether a content type is video, image or unspecific."""
    t = content_type(header)
    return t.startswith("video/") | t.startswith("image/") | (t == "application/octet-stream")


def ending(url: Column) -> Column:
    """The ending of the file that an address or path names, in lower case; empty without one."""
    path = F.regexp_replace(F.regexp_replace(stripped(F.coalesce(url, F.lit(""))), r"(?s)[?#].*$", ""), r"^\w+://[^/]*", "")
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})\z", 1))


def media_kind(url: Column) -> Column:
    """video, image or other, by ending."""
    e = ending(url)
    return F.when(e.isin(VIDEO_ENDINGS), "video").when(e.isin(IMAGE_ENDINGS), "image").otherwise("other")


def host(url: Column) -> Column:
    """The host of an address in lower case, without user, port and closing dot; null without one."""
    h = F.regexp_extract(F.lower(stripped(url)), r"^\w+://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    h = F.regexp_replace(h, r"\.+$", "")
    return F.when(h != "", h)


def error_kind(name: Column) -> Column:
    """The kind of an error; unclassified_error for unknown names and null."""
    table = F.create_map(*(F.lit(x) for kv in ERROR_KINDS.items() for x in kv))
    return F.coalesce(table[F.coalesce(name, F.lit(""))], F.lit("unclassified_error"))


def retry_class(name: Column, side: Column) -> Column:
    """What becomes of a job after an error on a `side` (candidate or target): `result` (a failure is the candidate's result), `transient`, `permanent`,
    `rejected` (never tried again) or `startup`. Unknown names and null are permanent; a null side counts as target."""
    embedding = F.create_map(*(F.lit(x) for kv in EMBEDDING_RETRY.items() for x in kv))[F.coalesce(name, F.lit(""))]
    on_candidate = F.coalesce(side == "candidate", F.lit(False)) & embedding.isin("permanent", "transient")
    return (
        F.when(on_candidate, "result").when(embedding.isNotNull(), embedding).when(name.isin(TRANSIENT), "transient").when(name == "JobValidationError", "rejected").otherwise("permanent")
    )


def mime_type(url: Column) -> Column:
    """The type that the ending of an address or path stands for; video/mp4 without a known one."""
    table = F.create_map(*(F.lit(x) for kv in MIME_TYPES.items() for x in kv))
    return F.coalesce(table[ending(url)], F.lit("video/mp4"))


def too_short(duration: Column, least: float) -> Column:
    """Whether a length in seconds is below `least`; never where the length is null or NaN, nor with a negative `least` (-1 turns the gate off)."""
    return F.lit(False) if least < 0 else F.coalesce((duration < least) & ~F.isnan(duration.cast("double")), F.lit(False))


def onion(url: Column) -> Column:
    """Whether an address leads to a host that only Tor reaches: such are rejected where that is off."""
    return F.coalesce(host(url).endswith(".onion"), F.lit(False))


def unknown_techniques(techniques: Column, known: Sequence[str]) -> Column:
    """The names, in order and once each, that aren't known; white space around them and letter case don't count, nor do blank ones."""
    names = F.array_sort(F.array_distinct(F.filter(F.transform(techniques, lambda t: F.lower(F.trim(t))), lambda t: t != "")))
    return F.filter(names, lambda t: ~t.isin(list(known)))


def technique_fault(techniques: Column, known: Sequence[str]) -> Column:
    """Why a list of techniques is an error: unknown names, or none but blank ones; null if it is right. No list or an empty one means all."""
    unknown = unknown_techniques(techniques, known)
    blank = (F.size(techniques) > 0) & ~F.exists(techniques, lambda t: F.coalesce(F.trim(t) != "", F.lit(False)))
    return F.when(F.size(unknown) > 0, F.concat(F.lit("Unknown techniques: "), F.array_join(unknown, ", "))).when(blank, "At least one technique must be enabled")


def probed(report: Column, log: Column, size: Column) -> Column:
    """What is known of a file, from a prober's JSON report, or else the lines that a decoder logs, or else its size alone: `source` (report, log or size; null without any), `duration_s`, `width`,
    `height` and `size_bytes`."""
    r = F.from_json(report, "duration_s double, width int, height int", {"mode": "PERMISSIVE"})
    part = lambda pattern, k: F.regexp_extract(log, pattern, k)
    clock, frame = r"Duration: (\d+):(\d\d):(\d\d(?:\.\d+)?)", r"Video: .*?[ ,](\d{2,5})x(\d{2,5})"
    length = part(clock, 1).try_cast("double") * 3600 + part(clock, 2).try_cast("double") * 60 + part(clock, 3).try_cast("double")
    known = F.coalesce(r["duration_s"].isNotNull() | r["width"].isNotNull(), F.lit(False))
    logged = ~known & F.coalesce(length.isNotNull() | (part(frame, 1) != ""), F.lit(False))
    pick = lambda a, b: F.when(known, a).when(logged, b)
    source = F.when(known, "report").when(logged, "log").when(size.isNotNull(), "size")
    return F.struct(
        source.alias("source"), pick(r["duration_s"], length).alias("duration_s"), pick(r["width"], part(frame, 1).try_cast("int")).alias("width"), pick(r["height"], part(frame, 2).try_cast("int")).alias("height"),
        size.cast("long").alias("size_bytes"),
    )
