"""Job and result records: parsing, folding evidence, latest per key, registries and caches."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediasift.session import cut

EVIDENCE = "array<struct<technique string, matcher_version string, matched boolean, score double>>"
REQUIRED = ["job_id", "media_evidence_id", "media_url", "media_type", "source_domain", "target_id", "target_version", "techniques", "max_attempts"]


def parse_jobs(wire: DataFrame, schema_version: int = 1) -> DataFrame:
    """Wire rows (all text) with `technique_list`, `attempts` and `reject_reason`, the first that holds: a required field that is null or empty (in the
    fields' order), a schema version that is no integer or another one (none counts as right), attempts that are no integer or below 1, no technique."""
    missing = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in REQUIRED)))
    version, attempts = F.trim("schema_version"), F.trim("max_attempts")
    integer = r"^[+-]?\d{1,9}\z"
    techniques = F.filter(F.split(F.coalesce("techniques", F.lit("")), ","), lambda t: t != "")
    given = F.coalesce(F.col("schema_version"), F.lit("")) != ""
    reason = (
        F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
        .when(given & ~version.rlike(integer), "schema_version is no integer")
        .when(given & (version.try_cast("int") != schema_version), "schema_version differs")
        .when(~attempts.rlike(integer), "max_attempts is no integer")
        .when(attempts.try_cast("int") < 1, "max_attempts below 1")
        .when(F.size(techniques) == 0, "no technique")
    )
    return wire.withColumns({"technique_list": techniques, "attempts": F.when(attempts.rlike(integer), attempts.try_cast("int")), "reject_reason": reason})


def fold_evidence(df: DataFrame, evidence: str) -> DataFrame:
    """df with `folded_decision`, `folded_algorithm`, `folded_confidence`, `folded_summary` and `fault` of its JSON list of evidence: any match makes a match, techniques in
    their order, the largest score there is. Fault: `none` given, `broken` JSON or `empty` list; the rest is then null. A match that is null counts as none."""
    e = F.from_json(evidence, EVIDENCE, {"mode": "PERMISSIVE"})
    good = F.filter(e, lambda x: x["technique"].isNotNull())
    matched = lambda x: F.coalesce(x["matched"], F.lit(False))
    word = lambda x: F.concat(x["technique"], F.lit("="), F.when(matched(x), "match").otherwise("no_match"), F.when(x["score"].isNotNull(), F.concat(F.lit(" (score="), F.format_string("%.4f", x["score"]), F.lit(")"))).otherwise(F.lit("")))
    out = df.withColumn("_e", good)
    there = F.size("_e") > 0
    text = F.trim(F.col(evidence))
    fault = F.when(F.col(evidence).isNull(), "none").when(text.rlike(r"^\[\s*\]$"), "empty").when(~F.coalesce(there, F.lit(False)), "broken")
    return out.withColumns({
        "folded_decision": F.when(there, F.when(F.exists("_e", matched), "match").otherwise("no_match")),
        "folded_algorithm": F.when(there, F.array_join(F.transform("_e", lambda x: x["technique"]), "+")),
        "folded_confidence": F.when(there, F.array_max(F.transform("_e", lambda x: x["score"]))),
        "folded_summary": F.when(there, F.array_join(F.transform("_e", word), "; ")),
        "fault": fault,
    }).drop("_e")


def combine_evidence(df: DataFrame, evidence: str) -> DataFrame:
    """df with `decision`, `algorithm`, `confidence`, `summary` and `evidence_json` of an array of evidence (`technique`, `matcher_version`, `matched`, `score`, `detail`), in its order: any
    match makes a match, the largest score there is. JSON has its keys in order, nulls too. A null or empty array is an error of the caller's: `decision` and the rest are null."""
    e = F.col(evidence)
    there = F.coalesce(F.size(e) > 0, F.lit(False))
    hit = lambda x: F.coalesce(x["matched"], F.lit(False))
    score = lambda x: F.when(x["score"].isNotNull(), F.format_string(" (score=%.4f)", x["score"])).otherwise(F.lit(""))
    word = lambda x: F.concat(x["technique"], F.when(hit(x), "=match").otherwise("=no_match"), score(x))
    kind = df.schema[evidence].dataType.elementType
    names = sorted(kind["detail"].dataType.fieldNames())
    ordered = lambda x: F.struct(
        F.struct(*(x["detail"][n].alias(n) for n in names)).alias("detail"), x["matched"].alias("matched"), x["matcher_version"].alias("matcher_version"), x["score"].alias("score"), x["technique"].alias("technique")
    )
    return df.withColumns({
        "decision": F.when(there, F.when(F.exists(e, hit), "match").otherwise("no_match")),
        "algorithm": F.when(there, F.array_join(F.transform(e, lambda x: x["technique"]), "+")),
        "confidence": F.when(there, F.array_max(F.transform(e, lambda x: x["score"]))),
        "summary": F.when(there, F.array_join(F.transform(e, word), "; ")),
        "evidence_json": F.when(there, F.to_json(F.transform(e, ordered), {"ignoreNullFields": "false"})),
    })


def candidate_fault(url: str, required: Sequence[str], techniques: str, attempts: str) -> Column:
    """The first thing that is wrong with a candidate, or null: an address of another scheme than http and https, a required column that is null or empty (in their order), no technique,
    fewer than one attempt (null counts as none)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    fault = F.when(~F.coalesce(F.lower(F.col(url)).rlike("^https?://"), F.lit(False)), "candidate_url must start with http:// or https://")
    for c in required:
        fault = fault.when(empty(c), f"{c} must not be empty")
    return fault.when(F.size(techniques) == 0, "techniques must contain at least one entry").when(F.coalesce(F.col(attempts), F.lit(0)) < 1, "max_attempts must be >= 1")


def outcome(state: Column, decision: Column) -> Column:
    """pending, skipped, retryable_error, permanent_error, match or no_match: of a completed job its decision tells, without one it was skipped; no state, and a claimed job, is pending."""
    return (
        F.when(state.isNull() | (state == "claimed"), "pending").when(state == "rejected", "skipped").when(state == "retry_scheduled", "retryable_error").when(state == "failed", "permanent_error")
        .when(decision.isNull(), "skipped").when(decision == "match", "match").when(decision == "no_match", "no_match").otherwise("permanent_error")
    )


#: What must agree for a cached representation to serve.
COMPATIBLE = ["target_id", "target_version", "content_sha256", "model_id", "model_version", "embedding_schema_version", "preprocessing_config", "sampling_config"]


def spec_fields(spec: Mapping[str, object]) -> dict[str, object]:
    """The columns of an embedding specification; settings as JSON with sorted keys."""
    return {k: json.dumps(v, sort_keys=True) if isinstance(v, dict) else v for k, v in spec.items()}


def cache_differences(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """wanted (with the columns COMPATIBLE) with `differs`, the names of the fields in which the cached entry of the same target and version differs (null differs from any value but null; of
    several entries the one that differs least), joined by commas, and `hit`: an entry is there and differs in none. Without an entry `differs` is null. Any doubt is a miss."""
    key, rest = COMPATIBLE[:2], COMPATIBLE[2:]
    entry = cached.select(*key, *(F.col(c).alias(f"_{c}") for c in rest), F.lit(True).alias("_there"))
    apart = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in rest)))
    x = wanted.join(entry, key, "left").withColumn("_d", F.when(F.col("_there"), apart))
    best = x.groupBy(*COMPATIBLE).agg(F.min(F.when(F.col("_there"), F.struct(F.size("_d").alias("n"), F.array_join("_d", ",").alias("names")))).alias("_b"))
    return best.select(*COMPATIBLE, F.col("_b.names").alias("differs"), F.coalesce(F.col("_b.n") == 0, F.lit(False)).alias("hit"))


def fenced(df: DataFrame, key: Sequence[str], attempt: str, order: str) -> DataFrame:
    """df with `current_attempt`, the largest attempt of the key's rows before in `order` (null for the first), and `stale`: the row is of an earlier attempt, so it comes too late to count.
    A null attempt isn't stale and fences nothing. A key has as many rows as it was tried and redelivered."""
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("current_attempt", F.max(attempt).over(before)).withColumn("stale", F.coalesce(F.col(attempt) < F.col("current_attempt"), F.lit(False)))


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by `order`, which must be total; rows with a null in the key are left out. Combines before the shuffle."""
    rank = Window.partitionBy(*key).orderBy(*order)
    return df.dropna(subset=list(key)).withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def upsert(table: DataFrame, new: DataFrame, key: Sequence[str], values: Sequence[str], created: str, updated: str) -> DataFrame:
    """The table after new rows: per key the earliest `created`, and values and `updated` of the row updated last (of equals the new one's, then the larger values)."""
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).select(*key, *values, created, updated, "_new")
    last = F.max(F.struct(F.col(updated), F.col("_new"), *values))
    out = both.dropna(subset=list(key)).groupBy(*key).agg(F.min(created).alias(created), last.alias("_l"))
    return out.select(*key, *(F.col(f"_l.{v}").alias(v) for v in values), created, F.col(f"_l.{updated}").alias(updated))


def cache_misses(wanted: DataFrame, cached: DataFrame, key: Sequence[str]) -> DataFrame:
    """Wanted rows that no cached entry has, one per key: each is built once, however often it is wanted."""
    return wanted.dropDuplicates(list(key)).join(cached.select(*key).distinct(), list(key), "left_anti")


def latency_summary(df: DataFrame, group: Sequence[str], value: str, order: str, window: int = 2000, bins: int = 4096, salts: int = 16) -> DataFrame:
    """Per group exact `count`, `min`, `max`, `avg` (3 places), and `p50`, `p95`, `p99` of its last `window` samples by `order` (a unique number): the sample at place p (n - 1), rounded
    half to even. Null samples don't count; rows with a null in the group are left out. Empty input gives an empty result.

    The range of `order` is parted into `bins`; counts, sums and extremes per group and bin, added up before they are shuffled, give the whole's figures and the bin from which on a group has
    `window` samples. Only rows from there on are shuffled (under a salt) and ranked, so the busiest group's rows are never in one task.
    """
    x = df.where(F.col(value).isNotNull()).dropna(subset=list(group)).select(*group, F.col(value).alias("_v"), F.col(order).alias("_o"))
    # one row: a bounded side
    span = F.broadcast(x.agg(F.min("_o").alias("_low"), F.max("_o").alias("_high")))
    binned = x.join(span).withColumn("_bin", F.floor((F.col("_o") - F.col("_low")).cast("double") / (F.col("_high") - F.col("_low") + 1).cast("double") * bins).cast("int"))
    states = binned.groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.sum("_v").alias("_sum"))
    above = Window.partitionBy(*group).orderBy(F.desc("_bin"))
    whole = states.withColumn("_above", F.sum("_n").over(above.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*group).agg(
        F.sum("_n").alias("count"), F.min("_min").alias("min"), F.max("_max").alias("max"), F.round(F.sum("_sum") / F.sum("_n"), 3).alias("avg"),
        F.coalesce(F.max(F.when(F.col("_above") >= window, F.col("_bin"))), F.lit(-1)).alias("_least"),
    )
    whole = cut(whole)
    least = whole.select(*group, "_least", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salted = binned.withColumn("_salt", F.pmod(F.xxhash64("_o"), F.lit(salts)).cast("int"))
    late = salted.join(least, [*group, "_salt"]).where("_bin >= _least").select(*group, "_o", "_v")
    last = late.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_o")))).where(F.col("_r") <= window)
    samples = last.groupBy(*group).agg(F.array_sort(F.collect_list("_v")).alias("_s"))
    n = F.size("_s")
    at = lambda p: F.element_at("_s", F.bround((n - 1) * F.lit(p), 0).cast("int") + 1)
    return whole.drop("_least").join(samples.select(*group, at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), n.alias("sample_window")), list(group))


def sample_spread(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Per group `count`, exact `median`, population `stdev` and a `warning` where fewer than 10 or 30 samples say little. Null samples don't count."""
    x = df.where(F.col(value).isNotNull()).dropna(subset=list(group)).groupBy(*group)
    out = x.agg(F.count(F.lit(1)).alias("count"), F.median(value).alias("median"), F.stddev_pop(value).alias("stdev"))
    few = F.concat(F.lit("n="), F.col("count").cast("string"))
    return out.withColumn("warning", F.when(F.col("count") < 10, F.concat(few, F.lit(" is too small for p95/p99 to be statistically meaningful; reported for completeness only"))).when(F.col("count") < 30, F.concat(few, F.lit(" is small; p99 in particular should be treated as indicative, not precise"))))


def backoff_seconds(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    """Seconds to wait after an attempt: doubling from the base, up to the most."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(60))))


def entry_seconds(entry_id: Column) -> Column:
    """Epoch seconds of a stream entry id (milliseconds-sequence); null if it isn't one."""
    return F.regexp_extract(entry_id, r"^(\d{1,15})-\d+\z", 1).try_cast("long") / 1000
