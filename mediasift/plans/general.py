"""Queries on few heavy keys and on redelivered messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.operators.eager_aggregation import blank_to_null, domain, eager_join_aggregate, filled, heavy_keys
from mediasift.session import scratch, table
from mediasift.streaming.dedup import bytes_of, drop_redelivered, dropped, stream_of


def fields() -> dict[str, Column]:
    """The two keys by which results are asked for."""
    return {"target_id": filled(F.col("target_id")), "source_domain": domain(F.col("source_domain"))}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of target_id and source_domain that hold at least 2 percent of all rows of jobs."""
    return heavy_keys(table(spark, sf_dir, "jobs"), fields(), 0.02).select("key_field", "key_value")


def p5_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target_id and per source_domain of jobs: deliveries, result rows of their jobs, and sums over those results.

    Jobs and results meet on job_id, of which neither is unique, so all sums count each pair of deliveries.
    """
    jobs, results = table(spark, sf_dir, "jobs"), table(spark, sf_dir, "result_records")
    keyed = jobs.select(
        F.lower(blank_to_null(F.col("job_id"))).alias("job"),
        F.explode(F.array(*(F.struct(F.lit(n).alias("key_field"), v.alias("key_value")) for n, v in fields().items()))).alias("e"),
    ).select("job", "e.*").where("key_value IS NOT NULL")
    score = F.when(F.col("confidence").between(0, 1), F.round(F.col("confidence") * 1_000_000).cast("long"))
    outcome = results.select(
        F.lower(blank_to_null(F.col("job_id"))).alias("job"),
        (F.col("decision") == "match").cast("long").alias("hit"),
        score.alias("score"),
    )
    out = eager_join_aggregate(
        keyed, outcome, ["job"], ["key_field", "key_value"],
        right_sums={"n_match": F.col("hit"), "n_scored": F.when(F.col("score").isNotNull(), 1).otherwise(0), "score_ppm": F.col("score")}, how="left",
    )
    return out.select("key_field", "key_value", F.col("n_left").alias("n_deliveries"), F.col("n_rows").alias("n_results"), "n_match", "n_scored", "score_ppm")


P5_RESULTS_SQL = r"""
WITH j AS (SELECT lower(regexp_replace(job_id, '^\s+|\s+$', '', 'g')) AS job, target_id, source_domain FROM jobs),
k AS (
  SELECT job, 'target_id' AS key_field, target_id AS key_value FROM j WHERE regexp_replace(target_id, '\s', '', 'g') <> ''
  UNION ALL
  SELECT job, 'source_domain', nullif(regexp_replace(lower(regexp_replace(source_domain, '^\s+|\s+$', '', 'g')), '[\s.]+$', ''), '') FROM j
),
r AS (SELECT lower(regexp_replace(job_id, '^\s+|\s+$', '', 'g')) AS job, decision,
        CASE WHEN confidence >= 0 AND confidence <= 1 THEN cast(round(confidence * 1000000) AS BIGINT) END AS score FROM result_records),
n AS (SELECT key_field, key_value, count(*) AS n_deliveries FROM k WHERE key_value IS NOT NULL GROUP BY ALL),
s AS (SELECT key_field, key_value, count(r.job) AS n_results,
        cast(sum(CASE WHEN r.job IS NULL THEN NULL WHEN decision = 'match' THEN 1 WHEN decision IS NULL THEN NULL ELSE 0 END) AS BIGINT) AS n_match,
        cast(sum(CASE WHEN r.job IS NULL THEN NULL WHEN score IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS n_scored, cast(sum(score) AS BIGINT) AS score_ppm
      FROM k LEFT JOIN r ON k.job = r.job WHERE key_value IS NOT NULL GROUP BY ALL)
SELECT n.key_field, n.key_value, n_deliveries, n_results, n_match, n_scored, score_ppm
FROM n JOIN s ON n.key_field = s.key_field AND n.key_value = s.key_value
"""

P5_FOUND_SQL = r"""
WITH k AS (
  SELECT 'target_id' AS key_field, target_id AS key_value FROM jobs WHERE regexp_replace(target_id, '\s', '', 'g') <> ''
  UNION ALL
  SELECT 'source_domain', nullif(regexp_replace(lower(regexp_replace(source_domain, '^\s+|\s+$', '', 'g')), '[\s.]+$', ''), '') FROM jobs
)
SELECT key_field, key_value FROM k WHERE key_value IS NOT NULL GROUP BY ALL
HAVING count(*) * 50 >= (SELECT count(*) FROM jobs)
"""


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of jobs and of result_records to be dropped."""
    messages = {
        "jobs": [F.lower(F.regexp_replace(F.coalesce("job_id", F.lit("")), r"^\s+|\s+$", ""))],
        "result_records": [F.lower(F.regexp_replace("job_id", r"^\s+|\s+$", "")), F.col("attempt"), F.col("worker_id")],
    }
    started = []
    for name, keys in messages.items():
        folder = scratch(spark, f"dedup-{name}")
        path = f"{sf_dir}/{name}.parquet"
        started.append((name, folder, drop_redelivered(stream_of(spark, path), keys, "delivery_id", "received_at", folder, expected=bytes_of(spark, path))))
    parts = []
    for name, folder, query in started:
        query.awaitTermination()
        parts.append(dropped(spark, folder).select(F.lit(name).alias("table_name"), F.col("id").alias("delivery_id")))
    return parts[0].union(parts[1])


P6_FOUND_SQL = r"""
SELECT table_name, delivery_id FROM (
  SELECT 'jobs' AS table_name, delivery_id, min(delivery_id) OVER (PARTITION BY lower(regexp_replace(coalesce(job_id, ''), '^\s+|\s+$', '', 'g'))) AS first FROM jobs
  UNION ALL
  SELECT 'result_records', delivery_id, min(delivery_id) OVER (PARTITION BY lower(regexp_replace(job_id, '^\s+|\s+$', '', 'g')), attempt, worker_id) FROM result_records
) WHERE delivery_id <> first
"""

QUERIES = {"p5_found": p5_found, "p5_results": p5_results, "p6_found": p6_found}
ORACLES = {"p5_found": P5_FOUND_SQL, "p5_results": P5_RESULTS_SQL, "p6_found": P6_FOUND_SQL}
