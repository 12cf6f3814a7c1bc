"""Queries on training data, by name, with their DuckDB oracles."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.llm.bpe import encode_corpus, share, token_count
from mediasift.llm.history import replay
from mediasift.llm.media_keys import evidence_key, trimmed, url_key
from mediasift.llm.mixture import mix
from mediasift.llm.nearest import nearest_vectors
from mediasift.llm.percentiles import epoch_seconds, merge, percentiles, value_counts
from mediasift.llm.same_look import canonical, look_alikes, look_classes
from mediasift.llm.similar import similar_vectors
from mediasift.llm.top_n import top_n_per_group
from mediasift.session import table

SECONDS = 1e-6
VOCABULARY = os.environ.get("MEDIASIFT_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of frames with a cosine of 0.9 or more, one among the 10 most similar of the other."""
    near = similar_vectors(table(spark, sf_dir, "index_frames").select("vec_id", "embeddings"), "vec_id", "embeddings", 64, k=10, floor=0.9)
    return near.select(F.least("id", "neighbour").alias("vec_id_a"), F.greatest("id", "neighbour").alias("vec_id_b")).distinct()


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's 10 most similar frames of the whole index, however similar, with their cosine and place."""
    near = nearest_vectors(table(spark, sf_dir, "index_frames").select("vec_id", "embeddings"), "vec_id", "embeddings", 64, k=10)
    return near.select(F.col("id").alias("vec_id"), F.col("neighbour").alias("neighbour_id"), "cosine", "pos")


def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    took = epoch_seconds(F.col("processing_completed_at")) - epoch_seconds(F.col("processing_started_at"))
    return table(spark, sf_dir, "result_records").select("worker_id", F.when(took >= 0, took).alias("took"))


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per worker the 50th, 90th and 99th percentile of its processing seconds."""
    state = value_counts(_durations(spark, sf_dir), ["worker_id"], F.col("took"), SECONDS)
    return percentiles(state, ["worker_id"], [50, 90, 99], SECONDS).select("worker_id", "pct", F.round("value", 6).alias("seconds"), "n_values")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers of which a percentile exceeds 20 seconds."""
    state = value_counts(_durations(spark, sf_dir), ["worker_id"], F.col("took"), SECONDS)
    return percentiles(state, ["worker_id"], [50, 90, 99], SECONDS).where(F.round("value", 6) > 20).select("worker_id", "pct")


#: The resolution of states that are kept: a hundredth of a second.
KEPT = 0.01


def p2_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from states that are kept by batch, at a coarser resolution: each batch has one, and those of all batches are merged."""
    r = table(spark, sf_dir, "result_records").withColumn("took", epoch_seconds(F.col("processing_completed_at")) - epoch_seconds(F.col("processing_started_at")))
    by_batch = value_counts(r.select("batch_id", "worker_id", F.when(F.col("took") >= 0, F.col("took")).alias("took")), ["batch_id", "worker_id"], F.col("took"), KEPT)
    halves = [by_batch.where(F.pmod("batch_id", F.lit(2)) == i).drop("batch_id") for i in (0, 1)]
    state = merge(halves, ["worker_id"])
    return percentiles(state, ["worker_id"], [50, 90, 99], KEPT).select("worker_id", "pct", F.round("value", 6).alias("seconds"), "n_values")


_P2 = """
WITH d AS (
  SELECT worker_id, round(CASE WHEN processing_completed_at >= 1e11 THEN processing_completed_at / 1000 ELSE processing_completed_at END
    - CASE WHEN processing_started_at >= 1e11 THEN processing_started_at / 1000 ELSE processing_started_at END, 6) AS v
  FROM result_records WHERE worker_id IS NOT NULL AND processing_completed_at IS NOT NULL AND processing_started_at IS NOT NULL),
r AS (SELECT worker_id, v, row_number() OVER (PARTITION BY worker_id ORDER BY v) AS k, count(*) OVER (PARTITION BY worker_id) AS n FROM d WHERE v >= 0 AND NOT isnan(v)),
p AS (SELECT unnest([50, 90, 99]) AS pct)
SELECT worker_id, pct, v AS seconds, n AS n_values FROM r, p WHERE k = greatest(1, (n * pct + 99) // 100)
"""


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target the 5 media evidence ids with the highest confidence."""
    return top_n_per_group(table(spark, sf_dir, "result_records"), "target_id", "media_evidence_id", "confidence", 5).drop("confidence")


P4_FOUND_SQL = """
SELECT target_id, media_evidence_id, cast(pos AS INTEGER) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY c DESC, encode(media_evidence_id)) AS pos FROM (
    SELECT target_id, media_evidence_id, max(confidence) AS c FROM result_records
    WHERE target_id IS NOT NULL AND media_evidence_id IS NOT NULL AND NOT isnan(confidence) AND confidence >= 0 AND confidence <= 1 GROUP BY ALL))
WHERE pos <= 5
"""

def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that repeat media, with the first delivered job of that media."""
    job = F.lower(trimmed(F.col("job_id")))
    first = table(spark, sf_dir, "jobs").select(job.alias("job"), "delivery_id", "batch_id", "media_url", "media_evidence_id").where("job <> ''")
    first = first.groupBy("job").agg(F.min(F.struct("delivery_id", "batch_id", "media_url", "media_evidence_id")).alias("d")).select("job", "d.*")
    keys = {"url": url_key(F.col("media_url")), "evidence": evidence_key(F.col("media_evidence_id"))}
    pairs = replay(first, keys, "job", "delivery_id", "batch_id")
    return pairs.select(F.least("job", "first").alias("job_id_a"), F.greatest("job", "first").alias("job_id_b")).distinct()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", share(spark, VOCABULARY))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sources by target share; languages (without region) and topics (kind of target) keep their proportions."""
    vocabulary = share(spark, VOCABULARY)
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "target_id", token_count(F.col("text"), vocabulary).alias("tokens"))
    language = F.regexp_extract(F.lower(F.trim("lang")), r"^([a-z]*)", 1)
    topic = F.regexp_extract(F.lower(F.trim("target_id")), r"^([a-z]*)", 1)
    return mix(documents, table(spark, sf_dir, "source_weights"), "doc_id", F.col("source"), F.col("tokens"), {"language": language, "topic": topic})


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed sources that can't reach their share: those of which raking leaves all cells at their caps, short of the target."""
    return _mixture(spark, sf_dir)[1].where("NOT reachable").select("source")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the mixture: target and actual share of each source, with what raking left open."""
    return _mixture(spark, sf_dir)[1]


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture, with their number of copies."""
    return _mixture(spark, sf_dir)[0]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose texts differ but look the same."""
    return look_alikes(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the first one that looks the same."""
    return look_classes(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in canonical form."""
    return table(spark, sf_dir, "documents").select("doc_id", canonical(F.col("text")).alias("text"))


# The same file by the same rules: each line of the address undoes one way of writing it.
P3_FOUND_SQL = r"""
WITH j AS (
  SELECT lower(regexp_replace(job_id, '^\s+|\s+$', '', 'g')) AS job, delivery_id, media_url, media_evidence_id FROM jobs
  QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(job_id, '^\s+|\s+$', '', 'g')) ORDER BY delivery_id) = 1),
a AS (SELECT job, delivery_id, regexp_replace(media_url, '^\s+|\s+$', '', 'g') AS u, lower(regexp_replace(media_evidence_id, '^\s+|\s+$', '', 'g')) AS e FROM j),
b AS (
  SELECT *, lower(regexp_extract(u, '^(?i:https?)://([^/?#]*)', 1)) AS host, regexp_extract(u, '^(?i:https?)://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(u, '^(?i:https?)://[^/?#]*[^?#]*\?([^#]*)', 1) AS query FROM a),
c AS (
  SELECT job, delivery_id, e,
    regexp_replace(regexp_replace(regexp_replace(host, ':(80|443)?$', ''), '\.+$', ''), '^((www\d*|m|cdn\d+|edge-\d+)\.)+([^.]+\.[^.]+)', '\3') AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(url_decode(path), '/+', '/', 'g'), '(/\.)+(/|$)', '\2', 'g'), '/+$', ''), '_\d{3,4}p(\.[A-Za-z0-9]+)$', '\1') AS path,
    array_to_string(list_sort(list_transform(list_filter(string_split(query, '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(?i:utm_\w*|ref|share_id|token|expires|sid|session|phpsessid)(=|$)')), lambda x: url_decode(x))), '&') AS query FROM b),
k AS (
  SELECT job, delivery_id, 'url' AS kind, host || path || '?' || query AS key FROM c WHERE host <> ''
  UNION ALL
  SELECT job, delivery_id, 'evidence', regexp_replace(regexp_replace(e, '^.*[:/]', ''), '[^a-z0-9]', '', 'g') FROM c
  WHERE e NOT IN ('n/a', 'na', 'none', 'null', 'unknown') AND regexp_matches(e, '[a-z0-9]')),
f AS (SELECT job, first_value(job) OVER (PARTITION BY kind, key ORDER BY delivery_id) AS first FROM k)
SELECT DISTINCT least(job, first) AS job_id_a, greatest(job, first) AS job_id_b FROM f WHERE job <> first
"""

P1_FOUND_SQL = """
WITH v AS (SELECT vec_id, list_transform(embeddings, lambda x: cast(x AS DOUBLE)) AS v FROM index_frames WHERE len(embeddings) = 64),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS len FROM v WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
c AS (SELECT a.vec_id AS id, b.vec_id AS other, round(list_dot_product(a.v, b.v) / (a.len * b.len), 6) AS cosine FROM n a JOIN n b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) AS pos FROM c WHERE cosine >= 0.9)
"""

# Letters of other scripts by the Latin letter of the same look, as DuckDB's translate takes them. Written for the oracle alone, from the charts of
# Cyrillic, Greek and Armenian; the operator has a table of its own.
_CAPITALS = [
    ("A", "АΑ"), ("B", "ВΒ"), ("C", "СϹ"), ("E", "ЕΕ"), ("H", "НΗ"), ("I", "ІΙӀ"), ("J", "ЈͿ"), ("K", "КΚ"), ("M", "МΜ"), ("N", "Ν"), ("O", "ОΟՕ"),
    ("P", "РΡ"), ("Q", "Ԛ"), ("S", "ЅՏ"), ("T", "ТΤ"), ("W", "Ԝ"), ("X", "ХΧ"), ("Y", "УΥҮ"), ("Z", "Ζ"),
]
_SMALL = [
    ("a", "аɑ"), ("c", "сϲ"), ("d", "ԁ"), ("e", "е"), ("g", "ɡ"), ("h", "һհҺ"), ("i", "і"), ("j", "јϳ"), ("l", "ӏ"), ("n", "ո"), ("o", "оοօ"), ("p", "р"),
    ("q", "ԛ"), ("s", "ѕ"), ("u", "ս"), ("v", "ѵν"), ("w", "ԝ"), ("x", "х"), ("y", "уү"), ("ë", "ё"), ("Ë", "Ё"), ("ï", "ї"), ("Ï", "Ї"),
]
_FULL = ("".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))))
_PLAIN = "text"
for _a, _b in (_FULL, ("".join(x for _, x in _CAPITALS + _SMALL), "".join(c * len(x) for c, x in _CAPITALS + _SMALL)), ("‐‑", "--")):
    _PLAIN = "translate({}, '{}', '{}')".format(_PLAIN, _a.replace("'", "''"), _b.replace("'", "''"))
for _a, _b in ((r"\r\n|\r|\x{85}|\x{2028}|\x{2029}", "' || chr(10) || '"), (r"[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]", " "), (r"[\x{ad}\x{61c}\x{180b}-\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}]", ""), ("ﬁ", "fi"), ("ﬂ", "fl"), ("…", "...")):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_a}', '{_b}', 'g')"
# The kinds of writing that the documents have, one after another; not the whole of `same_look`. Accents are composed once more after letters are replaced.
_FORMS = f"WITH f AS (SELECT doc_id, text, nfc_normalize({_PLAIN}) AS form FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)"
P9_FOUND_SQL = f"""
{_FORMS}
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text
"""
P9_CLASSES_SQL = f"{_FORMS}, k AS (SELECT form, min(doc_id) AS look, count(*) AS n_rows, count(DISTINCT text) AS n_texts FROM f GROUP BY ALL) SELECT doc_id, look, n_rows, n_texts FROM f JOIN k USING (form)"
P9_CANONICAL_SQL = f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN nfc_normalize({_PLAIN}) END AS text FROM documents"

QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p2_found": p2_found, "p2_percentiles": p2_percentiles, "p2_merged": p2_merged, "p3_found": p3_found, "p4_found": p4_found, "p7_ids": p7_ids,
    "p8_found": p8_found, "p8_shares": p8_shares, "p8_mixture": p8_mixture, "p9_found": p9_found, "p9_classes": p9_classes, "p9_canonical": p9_canonical}
ORACLES = {
    "p1_found": P1_FOUND_SQL + "SELECT DISTINCT least(id, other) AS vec_id_a, greatest(id, other) AS vec_id_b FROM k WHERE pos <= 10",
    "p1_neighbours": P1_FOUND_SQL + """, w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) AS pos FROM c)
SELECT id AS vec_id, other AS neighbour_id, cosine, cast(pos AS INTEGER) AS pos FROM w WHERE pos <= 10""",
    "p3_found": P3_FOUND_SQL,
    "p9_found": P9_FOUND_SQL,
    "p9_classes": P9_CLASSES_SQL,
    "p9_canonical": P9_CANONICAL_SQL,
    "p2_percentiles": _P2,
    "p2_merged": _P2.replace("round(CASE", "round((CASE").replace("ELSE processing_started_at END, 6)", "ELSE processing_started_at END) / 0.01)").replace("WHERE worker_id IS NOT NULL", "WHERE worker_id IS NOT NULL AND batch_id IS NOT NULL").replace("SELECT worker_id, pct, v AS seconds", "SELECT worker_id, pct, round(v * 0.01, 6) AS seconds"),
    "p2_found": f"SELECT worker_id, cast(pct AS INTEGER) AS pct FROM ({_P2}) WHERE seconds > 20",
    "p4_found": P4_FOUND_SQL,
}
