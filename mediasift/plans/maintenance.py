"""Queries on upkeep of the record tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.functions.gates import stripped
from mediasift.operators import maintenance as M
from mediasift.operators.eager_aggregation import domain
from mediasift.operators.records import backoff_seconds
from mediasift.session import table

DECISIONS = ["match", "no_match", "processing_failure"]


def q_decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions per target."""
    return M.counts_with_zeros(table(spark, sf_dir, "result_records"), ["target_id"], "decision", DECISIONS)


def q_next_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 failed results that are due first, by backoff after their arrival."""
    r = table(spark, sf_dir, "result_records").where("decision = 'processing_failure'")
    due = F.unix_micros(F.col("received_at").cast("timestamp")) / 1e6 + backoff_seconds(F.col("attempt"))
    return M.earliest(r.select("delivery_id", F.round(due, 3).alias("due_s")).where("due_s IS NOT NULL"), [F.col("due_s"), F.col("delivery_id")], 50)


def q_daily_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results per worker and day, with the change to the day before and the share of the first day."""
    r = table(spark, sf_dir, "result_records").where("worker_id IS NOT NULL AND received_at IS NOT NULL")
    daily = r.groupBy("worker_id", F.date_format("received_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return M.changes(daily, ["worker_id"], "day", "n").select("worker_id", "day", "n", "change", F.round("share_of_first", 6).alias("share_of_first"))


def q_jobs_of_matched_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs per domain, and whether any result of the domain's jobs is a match."""
    job = F.lower(stripped(F.col("job_id"))).alias("job")
    j = table(spark, sf_dir, "jobs").select(job, domain(F.col("source_domain")).alias("domain")).where("domain IS NOT NULL")
    hits = table(spark, sf_dir, "result_records").where("decision = 'match'").select(job).distinct()
    counted = j.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return M.related(counted, j.join(hits, "job", "left_semi"), ["domain"])


def q_deleted_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets' files marked as deleted if content is registered under a smaller target too."""
    t = table(spark, sf_dir, "targets").select("target_id", "target_version", F.lower("content_sha256").alias("content"))
    first = t.where("content IS NOT NULL").groupBy("content").agg(F.min(F.struct("target_id", "target_version")).alias("first"))
    x = t.join(first, "content", "left").withColumns({"deleted_at": F.lit(None).cast("string"), "note": F.lit("registered")})
    twice = (F.col("first.target_id") != F.col("target_id")) | (F.col("first.target_version") != F.col("target_version"))
    return M.mark_deleted(x, twice, F.lit("2026-01-01"), F.lit("content kept elsewhere")).select("target_id", "target_version", "deleted_at", "note")


#: A moment of the tables that counts as now, and the lease after which work is taken back.
NOW, LEASE_S = "2026-08-01 00:00:00", 86_400


def q_ordered_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be taken next at a moment: the pending job to claim, retries that are due (50), deliveries that have been idle for a lease or longer (10), and the oldest pending entry. A pending job has no result."""
    job = F.lower(stripped(F.col("job_id"))).alias("job")
    now = F.lit(NOW).cast("timestamp_ntz")
    r = table(spark, sf_dir, "result_records")
    j = table(spark, sf_dir, "jobs").select(job, "delivery_id", "entry_id", "received_at").where(F.col("received_at") <= now)
    pending = j.join(r.select(job).dropna().distinct(), "job", "left_anti").where("job IS NOT NULL")
    idle = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("received_at").cast("timestamp"))
    due = F.unix_micros(F.col("received_at").cast("timestamp")) / 1e6 + backoff_seconds(F.col("attempt"))
    late = r.where("decision = 'processing_failure'").select("delivery_id", F.round(due, 3).alias("due_s")).where(F.col("due_s") <= F.unix_micros(now.cast("timestamp")) / 1e6)
    picks = {
        "claim": M.earliest(pending, [F.col("received_at"), F.col("delivery_id")], 1),
        "due": M.earliest(late, [F.col("due_s"), F.col("delivery_id")], 50),
        "stale": M.earliest(pending.where(idle >= LEASE_S * 1_000_000), [F.col("received_at"), F.col("delivery_id")], 10),
        # by the entry's own order: its milliseconds, then its number
        "oldest": M.earliest(pending.where(F.col("entry_id").rlike(r"^\d{1,15}-\d{1,15}\z")), [F.split_part("entry_id", F.lit("-"), F.lit(1)).cast("long"), F.split_part("entry_id", F.lit("-"), F.lit(2)).cast("long"), F.col("delivery_id")], 1),
    }
    return reduce(DataFrame.union, [d.select(F.lit(k).alias("pick"), "delivery_id") for k, d in picks.items()])


def q_dropped_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media evidence marked as deleted as none of its results is a match, with the number of results by then; one with a match, or without a decision, stays."""
    r = table(spark, sf_dir, "result_records").where("media_evidence_id IS NOT NULL")
    seen = r.groupBy("media_evidence_id").agg(F.count("decision").alias("n"), F.count_if(F.col("decision") == "match").alias("hits")).withColumns({"deleted_at": F.lit(None).cast("string"), "note": F.lit("stored")})
    return M.mark_deleted(seen, (F.col("n") > 0) & (F.col("hits") == 0), F.lit(NOW), F.lit("no match")).select("media_evidence_id", "n", "deleted_at", "note")


def q_event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each result as the fields of an event: what identifies it and its decision, as JSON; null fields are left out."""
    return table(spark, sf_dir, "result_records").select("delivery_id", F.to_json(F.struct("job_id", "target_id", "target_version", "attempt", "worker_id", "decision")).alias("event"))


def q_load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and peak of each worker's daily results, and of their change."""
    daily = q_daily_throughput(spark, sf_dir)
    return daily.groupBy("worker_id").agg(F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("peak"), F.round(F.avg("change"), 6).alias("mean_change"), F.max("change").alias("peak_change"))


_DOMAIN = r"nullif(regexp_replace(lower(regexp_replace(source_domain, '^\s+|\s+$', '', 'g')), '[\s.]+$', ''), '')"
_JOB = r"lower(regexp_replace(job_id, '^\s+|\s+$', '', 'g'))"

QUERIES = {
    "decision_counts": q_decision_counts, "next_retries": q_next_retries, "daily_throughput": q_daily_throughput, "jobs_of_matched_domains": q_jobs_of_matched_domains, "deleted_assets": q_deleted_assets,
    "ordered_picks": q_ordered_picks, "dropped_evidence": q_dropped_evidence, "event_fields": q_event_fields, "load_summary": q_load_summary,
}
ORACLES = {
    "ordered_picks": f"""
      WITH j AS (SELECT {_JOB} AS job, delivery_id, entry_id, received_at FROM jobs WHERE received_at <= TIMESTAMP '{NOW}'),
      p AS (SELECT * FROM j ANTI JOIN (SELECT {_JOB} AS job FROM result_records WHERE job_id IS NOT NULL) r USING (job) WHERE job IS NOT NULL),
      d AS (SELECT delivery_id, round(epoch_us(received_at) / 1e6 + least(60.0, pow(2.0, attempt - 1)), 3) AS due FROM result_records WHERE decision = 'processing_failure')
      SELECT 'claim' AS pick, delivery_id FROM (SELECT * FROM p ORDER BY received_at, delivery_id LIMIT 1)
      UNION ALL SELECT 'due', delivery_id FROM (SELECT * FROM d WHERE due <= epoch(TIMESTAMP '{NOW}') ORDER BY due, delivery_id LIMIT 50)
      UNION ALL SELECT 'stale', delivery_id FROM (SELECT * FROM p WHERE received_at <= TIMESTAMP '{NOW}' - INTERVAL {LEASE_S} SECOND ORDER BY received_at, delivery_id LIMIT 10)
      UNION ALL SELECT 'oldest', delivery_id FROM (SELECT * FROM p WHERE regexp_matches(entry_id, '^[0-9]{{1,15}}-[0-9]{{1,15}}$') ORDER BY cast(split_part(entry_id, '-', 1) AS BIGINT), cast(split_part(entry_id, '-', 2) AS BIGINT), delivery_id LIMIT 1)""",
    "dropped_evidence": f"""SELECT media_evidence_id, n, CASE WHEN n > 0 AND hits = 0 THEN '{NOW}' END AS deleted_at, CASE WHEN n > 0 AND hits = 0 THEN 'no match' ELSE 'stored' END AS note
      FROM (SELECT media_evidence_id, count(decision) AS n, count(*) FILTER (WHERE decision = 'match') AS hits FROM result_records WHERE media_evidence_id IS NOT NULL GROUP BY ALL)""",
    "event_fields": """SELECT delivery_id, '{' || array_to_string(list_filter([CASE WHEN job_id IS NOT NULL THEN '"job_id":' || to_json(job_id) END, CASE WHEN target_id IS NOT NULL THEN '"target_id":' || to_json(target_id) END,
      CASE WHEN target_version IS NOT NULL THEN '"target_version":' || to_json(target_version) END, CASE WHEN attempt IS NOT NULL THEN '"attempt":' || attempt END,
      CASE WHEN worker_id IS NOT NULL THEN '"worker_id":' || to_json(worker_id) END, CASE WHEN decision IS NOT NULL THEN '"decision":' || to_json(decision) END], lambda x: x IS NOT NULL), ',') || '}' AS event FROM result_records""",
    "load_summary": """
      WITH d AS (SELECT worker_id, strftime(received_at, '%Y-%m-%d') AS day, count(*) AS n FROM result_records WHERE worker_id IS NOT NULL AND received_at IS NOT NULL GROUP BY ALL),
      c AS (SELECT *, n - lag(n) OVER (PARTITION BY worker_id ORDER BY day) AS change FROM d)
      SELECT worker_id, round(avg(n), 6) AS mean, max(n) AS peak, round(avg(change), 6) AS mean_change, max(change) AS peak_change FROM c GROUP BY ALL""",
    "decision_counts": "SELECT target_id, " + ", ".join(f"count(*) FILTER (WHERE decision = '{d}') AS n_{d}" for d in DECISIONS) + " FROM result_records GROUP BY ALL",
    "next_retries": """SELECT delivery_id, round(epoch_us(received_at) / 1e6 + least(60.0, pow(2.0, attempt - 1)), 3) AS due_s FROM result_records WHERE decision = 'processing_failure' AND received_at IS NOT NULL AND attempt IS NOT NULL
      ORDER BY due_s, delivery_id LIMIT 50""",
    "daily_throughput": """
      WITH d AS (SELECT worker_id, strftime(received_at, '%Y-%m-%d') AS day, count(*) AS n FROM result_records WHERE worker_id IS NOT NULL AND received_at IS NOT NULL GROUP BY ALL)
      SELECT worker_id, day, n, n - lag(n) OVER w AS change, round(n / first_value(n) OVER w, 6) AS share_of_first FROM d WINDOW w AS (PARTITION BY worker_id ORDER BY day)""",
    "jobs_of_matched_domains": f"""
      WITH j AS (SELECT {_JOB} AS job, {_DOMAIN} AS domain FROM jobs), h AS (SELECT DISTINCT {_JOB} AS job FROM result_records WHERE decision = 'match'),
      m AS (SELECT DISTINCT domain FROM j SEMI JOIN h USING (job))
      SELECT domain, count(*) AS n, domain IN (SELECT domain FROM m WHERE domain IS NOT NULL) AS related FROM j WHERE domain IS NOT NULL GROUP BY ALL""",
    "deleted_assets": """
      WITH t AS (SELECT target_id, target_version, row_number() OVER (PARTITION BY lower(content_sha256) ORDER BY target_id, target_version) AS r, content_sha256 AS c FROM targets)
      SELECT target_id, target_version, CASE WHEN c IS NOT NULL AND r > 1 THEN '2026-01-01' END AS deleted_at, CASE WHEN c IS NOT NULL AND r > 1 THEN 'content kept elsewhere' ELSE 'registered' END AS note FROM t""",
}
