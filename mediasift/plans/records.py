"""Queries on jobs, results, targets and documents as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.functions import gates, keys, text_sets
from mediasift.operators import records as R
from mediasift.operators.running import retention
from mediasift.session import table

#: The day that parts the registry from what is merged into it.
REGISTRY_DAY = "2025-10-10"
SPEC = {"model_id": "synthetic", "model_version": "v1", "embedding_schema_version": 1, "preprocessing_config": {"resize": 224}, "sampling_config": {"fps": 2.0}}


def q_job_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which deliveries parse, and why the others don't."""
    return R.parse_jobs(table(spark, sf_dir, "jobs")).select("delivery_id", F.array_join("technique_list", "+").alias("techniques"), "attempts", "reject_reason")


def q_media_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheme, host and kind of each job's address; the host fills in for a missing domain."""
    j = table(spark, sf_dir, "jobs")
    h = gates.host(F.col("media_url"))
    given = F.nullif(F.lower(F.trim("source_domain")), F.lit(""))
    return j.select("delivery_id", gates.fetchable(F.col("media_url")).alias("fetchable"), h.alias("host"), F.coalesce(given, h).alias("domain"), gates.ending(F.col("media_url")).alias("ending"), gates.media_kind(F.col("media_url")).alias("kind"))


def q_address_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made from event ids, and whether each is unsafe."""
    e = F.col("event_id")
    octets = [F.pmod(e * m, F.lit(256)).cast("string") for m in (7919, 104729, 1299709, 15485863)]
    a = F.concat_ws(".", *octets)
    return table(spark, sf_dir, "events").select("event_id", a.alias("address"), gates.unsafe_ipv4(a).alias("unsafe"))


ERROR_NAMES = [*gates.ERROR_KINDS, "SharedArtifactStoreError", "SomeOtherError"]


def q_http_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made from event ids, by class of status and content type."""
    e = F.col("event_id")
    status = (F.lit(200) + F.pmod(e * 37, F.lit(400))).cast("int")
    header = F.element_at(F.array(*map(F.lit, ["Video/MP4; codecs=avc1", "image/png", "text/html; charset=utf-8", "", " application/octet-stream "])), (F.pmod(e, F.lit(5)) + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy(gates.status_class(status).alias("class"), gates.content_type(header).alias("type"), gates.media_content(header).alias("media")).agg(F.count(F.lit(1)).alias("n"))


def q_error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of every name, made from event ids, by kind and by what becomes of the job, on either side."""
    e = F.col("event_id")
    name = F.element_at(F.array(*map(F.lit, sorted(ERROR_NAMES))), (F.pmod(e, F.lit(len(ERROR_NAMES))) + 1).cast("int"))
    side = F.when(F.pmod(F.floor(e / 100), F.lit(2)) == 0, "candidate").otherwise("target")
    return table(spark, sf_dir, "events").groupBy(name.alias("error"), side.alias("side"), gates.error_kind(name).alias("kind"), gates.retry_class(name, side).alias("retry")).agg(F.count(F.lit(1)).alias("n"))


def q_job_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each delivery's request."""
    t = F.filter(F.split(F.coalesce("techniques", F.lit("")), ","), lambda x: x != "")
    return table(spark, sf_dir, "jobs").select("delivery_id", keys.job_id(gates.stripped(F.col("media_url")), F.col("target_id"), F.col("target_version"), t).alias("derived_id"))


def q_evidence_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each result's evidence, folded."""
    return R.fold_evidence(table(spark, sf_dir, "result_records").select("delivery_id", "evidence"), "evidence").select("delivery_id", "folded_decision", "folded_algorithm", F.round("folded_confidence", 6).alias("folded_confidence"), "folded_summary", "fault")


def q_latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each job the result of its last attempt, of several the first delivered."""
    r = table(spark, sf_dir, "result_records").withColumn("job", F.lower(F.regexp_replace("job_id", r"^\s+|\s+$", "")))
    return R.latest(r, ["job"], [F.desc("attempt"), F.col("delivery_id")]).select("job", "attempt", "decision", "delivery_id")


def q_job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by whether a result is there, and which."""
    j = table(spark, sf_dir, "jobs").select(F.lower(F.regexp_replace("job_id", r"^\s+|\s+$", "")).alias("job"), "target_id").dropna(subset=["job"]).groupBy("job").agg(F.min("target_id").alias("target_id"))
    x = j.join(q_latest_results(spark, sf_dir).select("job", "decision"), "job", "left")
    return x.groupBy(F.coalesce("decision", F.lit("pending")).alias("outcome")).agg(F.count(F.lit(1)).alias("n_jobs"), F.countDistinct("target_id").alias("n_targets"))


def q_unfinished_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs without any result."""
    job = F.lower(F.regexp_replace("job_id", r"^\s+|\s+$", "")).alias("job")
    return table(spark, sf_dir, "jobs").select(job).distinct().join(table(spark, sf_dir, "result_records").select(job).distinct(), "job", "left_anti")


def q_duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content registered for several targets."""
    t = table(spark, sf_dir, "targets").select(F.lower("content_sha256").alias("content"), F.concat_ws("/", "target_id", "target_version").alias("target")).where("content IS NOT NULL")
    return t.groupBy("content").agg(F.countDistinct("target").alias("n"), F.min("target").alias("first"), F.max("target").alias("last")).where("n > 1")


KNOWN_TECHNIQUES = ["dinov2", "phash", "ocr", "logo", "text_banner"]


def q_candidate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each job as a candidate, and the job fields it is mapped to; techniques that aren't known are named."""
    t = F.filter(F.split(F.coalesce("techniques", F.lit("")), ","), lambda x: x != "")
    j = table(spark, sf_dir, "jobs").withColumns({"technique_list": t, "attempts": F.trim("max_attempts").try_cast("int")})
    fault = R.candidate_fault("media_url", ["media_evidence_id", "media_type", "source_domain", "target_id", "target_version"], "technique_list", "attempts")
    return j.select("delivery_id", fault.alias("fault"), F.array_join(gates.unknown_techniques(F.col("technique_list"), KNOWN_TECHNIQUES), "+").alias("unknown"), gates.mime_type(F.col("media_url")).alias("mime"))


def q_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's outcome, one of six: by its state, which follows from what was delivered of it, and its last result."""
    wire = R.parse_jobs(table(spark, sf_dir, "jobs"))
    job = F.lower(gates.stripped(F.col("job_id")))
    state = F.when(F.col("reject_reason").isNotNull(), "rejected")
    jobs = R.latest(wire.select(job.alias("job"), "delivery_id", state.alias("state"), "attempts"), ["job"], [F.col("delivery_id")])
    last = q_latest_results(spark, sf_dir).select("job", "attempt", "decision")
    x = jobs.join(last, "job", "left")
    # a failure with attempts left is tried again; without a result the job waits
    state = F.coalesce("state", F.when(F.col("attempt").isNull() & F.col("decision").isNull(), "claimed").when((F.col("decision") == "processing_failure") & (F.col("attempt") < F.col("attempts")), "retry_scheduled").otherwise("completed"))
    return x.select("job", state.alias("state"), R.outcome(state, F.col("decision")).alias("outcome"))


def q_cache_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered targets against cached representations of other specifications: which of the eight fields that must agree differ. The cache holds every other target, some of an older make."""
    t = table(spark, sf_dir, "targets").select("target_id", "target_version", F.lower("content_sha256").alias("content_sha256"))
    fixed = {k: F.lit(v) for k, v in R.spec_fields(SPEC).items()}
    wanted = t.withColumns(fixed)
    odd = F.pmod(F.length("target_id") + F.length("target_version"), F.lit(4))
    cached = t.withColumns(fixed).where(odd < 3).withColumns({"model_version": F.when(odd > 0, "v0").otherwise(F.lit(SPEC["model_version"])), "content_sha256": F.when(odd == 2, F.lit(None)).otherwise(F.col("content_sha256"))})
    return R.cache_differences(wanted, cached).select("target_id", "target_version", "differs", "hit")


def q_fenced_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in order of delivery: which came after a later attempt of their job had been delivered, and so don't count."""
    r = table(spark, sf_dir, "result_records").select(F.lower(gates.stripped(F.col("job_id"))).alias("job"), "attempt", "delivery_id").where("job IS NOT NULL")
    return R.fenced(r, ["job"], "attempt", "delivery_id").where("stale").select("delivery_id", "job", "attempt", "current_attempt")


def q_sample_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, deviation and a warning for few samples, of processing seconds per decision and stage: waiting and processing."""
    sec = lambda c: F.when(F.col(c) >= 1e11, F.col(c) / 1000).otherwise(F.col(c))
    took, waited = sec("processing_completed_at") - sec("processing_started_at"), F.unix_micros(F.col("received_at").cast("timestamp")) / 1e6 - sec("processing_completed_at")
    stages = F.explode(F.array(F.struct(F.lit("process").alias("stage"), took.alias("s")), F.struct(F.lit("deliver").alias("stage"), waited.alias("s"))))
    rows = table(spark, sf_dir, "result_records").select("decision", stages.alias("e")).select("decision", "e.stage", F.when(F.col("e.s") >= 0, F.round("e.s", 6)).alias("s"))
    return R.sample_spread(rows, ["decision", "stage"], "s").select("decision", "stage", "count", F.round("median", 6).alias("median"), F.round("stdev", 4).alias("stdev"), "warning")


def q_registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of target ids with the versions registered before a day, after the later ones are merged in: values of the last one."""
    t = table(spark, sf_dir, "targets").select("target_id", "target_version", "content_sha256", "created_at", "updated_at")
    later = F.coalesce(F.col("updated_at") >= F.lit(REGISTRY_DAY).cast("timestamp_ntz"), F.lit(True))
    columns = (["target_id"], ["target_version", "content_sha256"], "created_at", "updated_at")
    return R.upsert(R.upsert(t.limit(0), t.where(~later), *columns), t.where(later), *columns)


def q_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets named by jobs whose representation isn't in the index yet, by cache key."""
    t = table(spark, sf_dir, "targets").select("target_id", "target_version", F.lower("content_sha256").alias("content"))
    key = keys.cache_key(F.col("target_id"), F.col("target_version"), F.col("content"), keys.spec_key(SPEC))
    known = t.where("content IS NOT NULL").withColumn("cache_key", key)
    wanted = table(spark, sf_dir, "jobs").select("target_id", "target_version").dropna().distinct().join(known, ["target_id", "target_version"])
    cached = table(spark, sf_dir, "index_frames").select("target_id", "target_version").dropna().distinct().join(known, ["target_id", "target_version"])
    return R.cache_misses(wanted, cached, ["cache_key"]).select("target_id", "target_version", "cache_key")


def q_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing times per worker, of its last 2,000 results."""
    sec = lambda c: F.when(F.col(c) >= 1e11, F.col(c) / 1000).otherwise(F.col(c))
    took = F.round(sec("processing_completed_at") - sec("processing_started_at"), 6)
    r = table(spark, sf_dir, "result_records").select("worker_id", "delivery_id", F.when(took >= 0, took).alias("took"))
    return R.latency_summary(r, ["worker_id"], "took", "delivery_id")


def q_worker_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per worker: results, each decision, retries, and waiting time by backoff."""
    r = table(spark, sf_dir, "result_records")
    return r.groupBy("worker_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "match").alias("n_match"), F.count_if(F.col("decision") == "no_match").alias("n_no_match"),
        F.count_if(F.col("decision") == "processing_failure").alias("n_failed"), F.count_if(F.col("attempt") > 1).alias("n_retries"),
        F.sum(F.when(F.col("attempt") > 1, R.backoff_seconds(F.col("attempt") - 1)).otherwise(0.0)).alias("backoff_s"),
    )


def q_entry_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds from each job's creation to its arrival."""
    s = R.entry_seconds(F.col("entry_id"))
    return table(spark, sf_dir, "jobs").select("delivery_id", F.round(s, 3).alias("created_s"), F.round(F.unix_micros(F.col("received_at").cast("timestamp")) / 1e6 - s, 3).alias("delay_s"))


def q_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which targets' files go so that 500 are left, of at most 1,000 hours; unknown lengths count as none."""
    t = table(spark, sf_dir, "targets").select("target_id", "target_version", "created_at", F.coalesce(F.get_json_object("media_metadata", "$.duration_s").try_cast("double").try_cast("long"), F.lit(0)).alias("seconds"))
    return retention(t, ["created_at", "target_id", "target_version"], "seconds", 500, 3_600_000).select("target_id", "target_version", "drop")


def q_media_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each target's file; broken metadata gives nulls."""
    m = F.from_json("media_metadata", "format_name string, duration_s double, codec_type string, codec_name string, width int, height int")
    return table(spark, sf_dir, "targets").select("target_id", "target_version", m["format_name"].alias("format_name"), F.round(m["duration_s"], 3).alias("duration_s"), m["width"].alias("width"), m["height"].alias("height"), gates.ending(F.col("media_path")).alias("ending"))


def q_title_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of its target's name each document repeats."""
    t, d = text_sets.tokens(F.col("target_id")), text_sets.tokens(F.col("text"))
    x = table(spark, sf_dir, "documents").where("target_id IS NOT NULL").select("doc_id", text_sets.jaccard(t, d).alias("j"), text_sets.containment(t, d).alias("c"))
    return x.select("doc_id", F.round("j", 6).alias("jaccard"), F.round("c", 6).alias("containment"), text_sets.score_class(F.col("c"), 0.2, 0.6).alias("class"))


_JOB = r"lower(regexp_replace(job_id, '^\s+|\s+$', '', 'g'))"
_LATEST = f"SELECT {_JOB} AS job, attempt, decision, delivery_id FROM result_records WHERE job_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_JOB} ORDER BY attempt DESC NULLS LAST, delivery_id) = 1"
_MISSING = ", ".join(f"CASE WHEN coalesce({c}, '') = '' THEN '{c}' END" for c in R.REQUIRED)
_ENDING = r"lower(regexp_extract(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g'), '[?#].*$', '', 's'), '^\w+://[^/]*', ''), '\.([A-Za-z0-9]{{1,5}})$', 1))"
_HOST = r"nullif(regexp_replace(regexp_extract(lower(regexp_replace(media_url, '^\s+|\s+$', '', 'g')), '^\w+://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.+$', ''), '')"
_KINDS = " ".join(f"WHEN {{e}} IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in (("video", gates.VIDEO_ENDINGS), ("image", gates.IMAGE_ENDINGS)))
_SEC = "CASE WHEN {c} >= 1e11 THEN {c} / 1000 ELSE {c} END"
_KEY = f"""sha256('{{"content_sha256": "' || content || '", "spec_key": "{keys.spec_key(SPEC)}", "target_id": "' || target_id || '", "target_version": "' || target_version || '"}}')"""

QUERIES = {
    "job_parse": q_job_parse, "media_gate": q_media_gate, "address_gate": q_address_gate, "http_class": q_http_class, "error_kinds": q_error_kinds, "job_identity": q_job_identity, "evidence_fold": q_evidence_fold,
    "latest_results": q_latest_results, "job_outcomes": q_job_outcomes, "unfinished_jobs": q_unfinished_jobs, "duplicate_content": q_duplicate_content, "candidate_gate": q_candidate_gate, "outcomes": q_outcomes, "cache_compatible": q_cache_compatible, "fenced_results": q_fenced_results, "sample_spread": q_sample_spread, "registry_upsert": q_registry_upsert,
    "cache_misses": q_cache_misses, "latency": q_latency, "worker_counters": q_worker_counters, "entry_delay": q_entry_delay, "retention": q_retention, "media_metadata": q_media_metadata, "title_overlap": q_title_overlap,
}
_PARSED = rf"""
      WITH p AS (SELECT *, list_filter([{_MISSING}], lambda x: x IS NOT NULL) AS missing, list_filter(string_split(coalesce(techniques, ''), ','), lambda x: x <> '') AS tl, trim(schema_version) AS v, trim(max_attempts) AS a FROM jobs)
      SELECT delivery_id, array_to_string(tl, '+') AS techniques, CASE WHEN regexp_matches(a, '^[+-]?\d{{1,9}}$') THEN try_cast(a AS INTEGER) END AS attempts,
        CASE WHEN len(missing) > 0 THEN 'missing: ' || array_to_string(missing, ', ') WHEN coalesce(schema_version, '') <> '' AND NOT regexp_matches(v, '^[+-]?\d{{1,9}}$') THEN 'schema_version is no integer'
          WHEN coalesce(schema_version, '') <> '' AND try_cast(v AS INTEGER) <> 1 THEN 'schema_version differs' WHEN NOT regexp_matches(a, '^[+-]?\d{{1,9}}$') THEN 'max_attempts is no integer'
          WHEN try_cast(a AS INTEGER) < 1 THEN 'max_attempts below 1' WHEN len(tl) = 0 THEN 'no technique' END AS reject_reason FROM p"""
ORACLES = {
    "job_parse": _PARSED,
    "outcomes": f"""
      WITH p AS ({_PARSED}), j AS (SELECT {_JOB} AS job, delivery_id, attempts, reject_reason FROM jobs JOIN p USING (delivery_id) WHERE job_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_JOB} ORDER BY delivery_id) = 1),
      x AS (SELECT j.*, l.attempt, l.decision, l.job IS NOT NULL AS there FROM j LEFT JOIN ({_LATEST}) l USING (job)),
      s AS (SELECT *, CASE WHEN reject_reason IS NOT NULL THEN 'rejected' WHEN NOT there THEN 'claimed' WHEN decision = 'processing_failure' AND attempt < attempts THEN 'retry_scheduled' ELSE 'completed' END AS state FROM x)
      SELECT job, state, CASE state WHEN 'rejected' THEN 'skipped' WHEN 'claimed' THEN 'pending' WHEN 'retry_scheduled' THEN 'retryable_error'
        ELSE CASE decision WHEN 'match' THEN 'match' WHEN 'no_match' THEN 'no_match' WHEN 'processing_failure' THEN 'permanent_error' ELSE 'skipped' END END AS outcome FROM s""",
    "cache_compatible": """
      SELECT target_id, target_version, CASE o WHEN 0 THEN '' WHEN 1 THEN 'model_version' WHEN 2 THEN CASE WHEN content_sha256 IS NULL THEN 'model_version' ELSE 'content_sha256,model_version' END END AS differs, o = 0 AS hit
      FROM (SELECT *, (length(target_id) + length(target_version)) % 4 AS o FROM targets)""",
    "media_gate": rf"""
      WITH p AS (SELECT delivery_id, coalesce(regexp_matches(lower(media_url), '^https?://'), false) AS fetchable, {_HOST} AS host, nullif(lower(trim(source_domain)), '') AS given, {_ENDING.format(c='media_url')} AS ending FROM jobs)
      SELECT delivery_id, fetchable, host, coalesce(given, host) AS domain, ending, CASE {_KINDS.format(e='ending')} ELSE 'other' END AS kind FROM p""",
    "address_gate": """
      WITH o AS (SELECT event_id, (event_id * 7919) % 256 AS a, (event_id * 104729) % 256 AS b, (event_id * 1299709) % 256 AS c, (event_id * 15485863) % 256 AS d FROM events),
      n AS (SELECT *, ((a * 256 + b) * 256 + c) * 256 + d AS n FROM o)
      SELECT event_id, a || '.' || b || '.' || c || '.' || d AS address, (""" + " OR ".join(f"n BETWEEN {int(x[0])} AND {int(x[-1])}" for x in map(gates.ipaddress.ip_network, gates.UNSAFE_NETWORKS)) + ") AND NOT (" + " OR ".join(f"n = {int(gates.ipaddress.ip_network(x)[0])}" for x in gates.SAFE_WITHIN) + ") AS unsafe FROM n",
    "http_class": """
      WITH e AS (SELECT 200 + (event_id * 37) % 400 AS s, event_id % 5 AS h FROM events)
      SELECT CASE WHEN s BETWEEN 200 AND 299 THEN 'ok' WHEN s = 404 THEN 'not_found' WHEN s = 410 THEN 'gone' WHEN s = 429 THEN 'rate_limited' WHEN s BETWEEN 500 AND 599 THEN 'server_error' WHEN s BETWEEN 400 AND 499 THEN 'client_error' ELSE 'unexpected' END AS class,
        CASE h WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'image/png' WHEN 2 THEN 'text/html' ELSE 'application/octet-stream' END AS type, h <> 2 AS media, count(*) AS n FROM e GROUP BY ALL""",
    # the table of error names once more, in words of its own: name, kind, retry on the target's side
    "error_kinds": """
      WITH k(error, kind, retry) AS (VALUES
        ('ClientError', 'permanent_acquisition_failure', 'permanent'), ('ConnectionTimeoutError', 'transient_acquisition_failure', 'transient'),
        ('DeviceUnavailableError', 'embedding_failure', 'startup'), ('GoneError', 'permanent_acquisition_failure', 'permanent'),
        ('InferenceError', 'embedding_failure', 'transient'), ('InvalidMediaError', 'media_validation_failure', 'permanent'),
        ('JobValidationError', 'malformed_job', 'rejected'), ('KeyError', 'malformed_job', 'permanent'),
        ('ModelLoadError', 'embedding_failure', 'startup'), ('NetworkError', 'transient_acquisition_failure', 'transient'),
        ('NotFoundError', 'permanent_acquisition_failure', 'permanent'), ('PermanentAcquisitionError', 'permanent_acquisition_failure', 'permanent'),
        ('RateLimitedError', 'transient_acquisition_failure', 'transient'), ('ReadTimeoutError', 'transient_acquisition_failure', 'transient'),
        ('RedirectLimitExceededError', 'permanent_acquisition_failure', 'permanent'), ('ServerError', 'transient_acquisition_failure', 'transient'),
        ('SharedArtifactStoreError', 'unclassified_error', 'transient'), ('SizeLimitExceededError', 'permanent_acquisition_failure', 'permanent'),
        ('SomeOtherError', 'unclassified_error', 'permanent'), ('TimeoutError', 'redis_coordination_failure', 'transient'),
        ('TransientAcquisitionError', 'transient_acquisition_failure', 'transient'), ('UnexpectedStatusError', 'permanent_acquisition_failure', 'permanent'),
        ('UnsafeDestinationError', 'permanent_acquisition_failure', 'permanent'), ('UnsupportedContentTypeError', 'permanent_acquisition_failure', 'permanent'),
        ('UnsupportedMediaError', 'media_validation_failure', 'permanent'), ('UnsupportedSchemeError', 'permanent_acquisition_failure', 'permanent'),
        ('UnsupportedTechnique', 'malformed_job', 'permanent')),
      n AS (SELECT *, row_number() OVER (ORDER BY error) - 1 AS i FROM k),
      e AS (SELECT event_id % 27 AS i, CASE WHEN event_id // 100 % 2 = 0 THEN 'candidate' ELSE 'target' END AS side FROM events)
      SELECT error, side, kind, CASE WHEN side = 'candidate' AND error IN ('InferenceError', 'UnsupportedMediaError') THEN 'result' ELSE retry END AS retry, count(*) AS n FROM e JOIN n USING (i) GROUP BY ALL""",
    "job_identity": r"""
      WITH q AS (SELECT delivery_id, list_sort(list_filter(string_split(coalesce(techniques, ''), ','), lambda x: x <> '')) AS t,
        CASE WHEN {0} IS NULL THEN 'null' ELSE '"' || replace(replace(replace(replace({0}, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t') || '"' END AS u,
        coalesce('"' || target_id || '"', 'null') AS ti, coalesce('"' || target_version || '"', 'null') AS tv FROM jobs)
      SELECT delivery_id, left(sha256('{{"candidate_url": ' || u || ', "target_id": ' || ti || ', "target_version": ' || tv || ', "techniques": [' || array_to_string(list_transform(t, lambda x: '"' || x || '"'), ', ') || ']}}'), 32) AS derived_id FROM q""".format(r"regexp_replace(media_url, '^\s+|\s+$', '', 'g')"),
    "evidence_fold": """
      WITH p AS (SELECT delivery_id, evidence, CASE WHEN json_valid(evidence) THEN list_filter(from_json(evidence, '[{"technique":"VARCHAR","matched":"BOOLEAN","score":"DOUBLE"}]'), lambda x: x.technique IS NOT NULL) END AS e FROM result_records),
      q AS (SELECT *, coalesce(len(e) > 0, false) AS there FROM p)
      SELECT delivery_id, CASE WHEN there THEN CASE WHEN len(list_filter(e, lambda x: x.matched)) > 0 THEN 'match' ELSE 'no_match' END END AS folded_decision,
        CASE WHEN there THEN array_to_string(list_transform(e, lambda x: x.technique), '+') END AS folded_algorithm, CASE WHEN there THEN round(list_max(list_transform(e, lambda x: x.score)), 6) END AS folded_confidence,
        CASE WHEN there THEN array_to_string(list_transform(e, lambda x: x.technique || '=' || CASE WHEN coalesce(x.matched, false) THEN 'match' ELSE 'no_match' END || CASE WHEN x.score IS NOT NULL THEN printf(' (score=%.4f)', x.score) ELSE '' END), '; ') END AS folded_summary,
        CASE WHEN evidence IS NULL THEN 'none' WHEN regexp_matches(trim(evidence), '^\\[\\s*\\]$') THEN 'empty' WHEN NOT there THEN 'broken' END AS fault FROM q""",
    "candidate_gate": rf"""
      WITH p AS (SELECT *, list_filter(string_split(coalesce(techniques, ''), ','), lambda x: x <> '') AS tl, try_cast(trim(max_attempts) AS INTEGER) AS a, {_ENDING.format(c='media_url')} AS e FROM jobs)
      SELECT delivery_id, CASE WHEN coalesce(media_url, '') = '' OR NOT regexp_matches(lower(media_url), '^https?://') THEN 'candidate_url must start with http:// or https://'
          WHEN coalesce(media_evidence_id, '') = '' THEN 'media_evidence_id must not be empty' WHEN coalesce(media_type, '') = '' THEN 'media_type must not be empty'
          WHEN coalesce(source_domain, '') = '' THEN 'source_domain must not be empty' WHEN coalesce(target_id, '') = '' THEN 'target_id must not be empty' WHEN coalesce(target_version, '') = '' THEN 'target_version must not be empty'
          WHEN len(tl) = 0 THEN 'techniques must contain at least one entry' WHEN coalesce(a, 0) < 1 THEN 'max_attempts must be >= 1' END AS fault,
        array_to_string(list_sort(list_distinct(list_filter(list_transform(tl, lambda x: lower(trim(x))), lambda x: x <> '' AND x NOT IN ('dinov2', 'phash', 'ocr', 'logo', 'text_banner')))), '+') AS unknown,
        CASE e {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in gates.MIME_TYPES.items())} ELSE 'video/mp4' END AS mime FROM p""",
    "fenced_results": f"""
      SELECT delivery_id, job, attempt, cur AS current_attempt FROM (SELECT delivery_id, {_JOB} AS job, attempt, max(attempt) OVER (PARTITION BY {_JOB} ORDER BY delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur
        FROM result_records WHERE job_id IS NOT NULL) WHERE attempt < cur""",
    "sample_spread": f"""
      WITH d AS (SELECT decision, {_SEC.format(c='processing_completed_at')} AS c, {_SEC.format(c='processing_started_at')} AS s, epoch_us(received_at) / 1e6 AS r FROM result_records WHERE decision IS NOT NULL),
      u AS (SELECT decision, 'process' AS stage, round(c - s, 6) AS v FROM d WHERE c - s >= 0 UNION ALL SELECT decision, 'deliver', round(r - c, 6) FROM d WHERE r - c >= 0)
      SELECT decision, stage, count(*) AS count, round(median(v), 6) AS median, round(stddev_pop(v), 4) AS stdev,
        CASE WHEN count(*) < 10 THEN 'n=' || count(*) || ' is too small for p95/p99 to be statistically meaningful; reported for completeness only'
          WHEN count(*) < 30 THEN 'n=' || count(*) || ' is small; p99 in particular should be treated as indicative, not precise' END AS warning FROM u GROUP BY ALL""",
    "latest_results": _LATEST,
    "job_outcomes": f"""
      WITH j AS (SELECT {_JOB} AS job, min(target_id) AS target_id FROM jobs WHERE job_id IS NOT NULL GROUP BY ALL), l AS ({_LATEST})
      SELECT coalesce(decision, 'pending') AS outcome, count(*) AS n_jobs, count(DISTINCT target_id) AS n_targets FROM j LEFT JOIN l USING (job) GROUP BY ALL""",
    "unfinished_jobs": f"SELECT DISTINCT {_JOB} AS job FROM jobs WHERE {_JOB} NOT IN (SELECT {_JOB} FROM result_records WHERE job_id IS NOT NULL)",
    "duplicate_content": """SELECT lower(content_sha256) AS content, count(DISTINCT target_id || '/' || target_version) AS n, min(target_id || '/' || target_version) AS first, max(target_id || '/' || target_version) AS last
      FROM targets WHERE content_sha256 IS NOT NULL GROUP BY ALL HAVING n > 1""",
    "registry_upsert": """SELECT target_id, target_version, content_sha256, created_at, updated_at FROM (SELECT target_id, target_version, content_sha256, min(created_at) OVER (PARTITION BY target_id) AS created_at, updated_at,
      row_number() OVER (PARTITION BY target_id ORDER BY updated_at DESC NULLS LAST, target_version DESC, content_sha256 DESC) AS r FROM targets WHERE target_id IS NOT NULL) WHERE r = 1""",
    "cache_misses": f"""
      WITH t AS (SELECT target_id, target_version, lower(content_sha256) AS content FROM targets WHERE content_sha256 IS NOT NULL), k AS (SELECT *, {_KEY} AS cache_key FROM t),
      c AS (SELECT cache_key FROM k SEMI JOIN index_frames i ON i.target_id = k.target_id AND i.target_version = k.target_version)
      SELECT target_id, target_version, cache_key FROM k WHERE EXISTS (SELECT 1 FROM jobs j WHERE j.target_id = k.target_id AND j.target_version = k.target_version) AND cache_key NOT IN (SELECT cache_key FROM c)""",
    "latency": f"""
      WITH d AS (SELECT worker_id, delivery_id, round({_SEC.format(c='processing_completed_at')} - {_SEC.format(c='processing_started_at')}, 6) AS v FROM result_records WHERE worker_id IS NOT NULL),
      g AS (SELECT worker_id, v, row_number() OVER (PARTITION BY worker_id ORDER BY delivery_id DESC) AS r FROM d WHERE v >= 0),
      w AS (SELECT worker_id, list_sort(list(v) FILTER (WHERE r <= 2000)) AS s, count(*) AS count, min(v) AS min, max(v) AS max, round(avg(v), 3) AS avg FROM g GROUP BY ALL)
      SELECT worker_id, count, min, max, avg, s[cast(round_even((len(s) - 1) * 0.5, 0) AS INTEGER) + 1] AS p50, s[cast(round_even((len(s) - 1) * 0.95, 0) AS INTEGER) + 1] AS p95,
        s[cast(round_even((len(s) - 1) * 0.99, 0) AS INTEGER) + 1] AS p99, cast(len(s) AS INTEGER) AS sample_window FROM w""",
    "worker_counters": """SELECT worker_id, count(*) AS n, count(*) FILTER (WHERE decision = 'match') AS n_match, count(*) FILTER (WHERE decision = 'no_match') AS n_no_match,
      count(*) FILTER (WHERE decision = 'processing_failure') AS n_failed, count(*) FILTER (WHERE attempt > 1) AS n_retries, sum(CASE WHEN attempt > 1 THEN least(60.0, pow(2.0, attempt - 2)) ELSE 0.0 END) AS backoff_s FROM result_records GROUP BY ALL""",
    "entry_delay": r"""SELECT delivery_id, round(s, 3) AS created_s, round(epoch_us(received_at) / 1e6 - s, 3) AS delay_s FROM (SELECT *, try_cast(nullif(regexp_extract(entry_id, '^(\d{1,15})-\d+$', 1), '') AS BIGINT) / 1000 AS s FROM jobs)""",
    "retention": """
      WITH t AS (SELECT target_id, target_version, created_at, coalesce(CASE WHEN json_valid(media_metadata) THEN trunc(try_cast(json_extract_string(media_metadata, '$.duration_s') AS DOUBLE)) END, 0) AS seconds FROM targets),
      r AS (SELECT *, row_number() OVER w AS k, count(*) OVER () AS n, sum(seconds) OVER () AS total, coalesce(sum(seconds) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t
        WINDOW w AS (ORDER BY created_at NULLS FIRST, target_id, target_version))
      SELECT target_id, target_version, n - k + 1 > 500 OR total - before > 3600000 AS drop FROM r""",
    "media_metadata": f"""
      WITH t AS (SELECT target_id, target_version, CASE WHEN json_valid(media_metadata) THEN media_metadata END AS m, {_ENDING.format(c='media_path')} AS ending FROM targets)
      SELECT target_id, target_version, json_extract_string(m, '$.format_name') AS format_name, round(try_cast(json_extract_string(m, '$.duration_s') AS DOUBLE), 3) AS duration_s,
        try_cast(json_extract_string(m, '$.width') AS INTEGER) AS width, try_cast(json_extract_string(m, '$.height') AS INTEGER) AS height, ending FROM t""",
    "title_overlap": r"""
      WITH x AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(target_id), '[a-z0-9]+'), lambda x: len(x) >= 3)) AS t, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: len(x) >= 3)) AS d
        FROM documents WHERE target_id IS NOT NULL),
      y AS (SELECT doc_id, len(t) AS nt, len(d) AS nd, len(list_intersect(t, d)) AS b FROM x),
      z AS (SELECT doc_id, CASE WHEN nt = 0 OR nd = 0 THEN 0.0 ELSE b / (nt + nd - b) END AS j, CASE WHEN nt = 0 THEN 0.0 ELSE b / nt END AS c FROM y)
      SELECT doc_id, round(j, 6) AS jaccard, round(c, 6) AS containment, CASE WHEN c >= 0.6 THEN 'matched' WHEN c <= 0.2 THEN 'no_match' ELSE 'uncertain' END AS class FROM z""",
}
