"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, dedup, licenses, lm, pieces, quality, secret_scan, simhash, token_counts, toxicity
from .common import held_out, table


def vocabulary(name: str) -> str:
    """A public vocabulary file: below DOCLOOM_TOKENIZERS if that is set, else as public_tokenizers has it."""
    if folder := os.environ.get("DOCLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, vocabulary("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan_licenses(docs)
    spans = F.transform("found", lambda f: F.concat_ws(":", f["license"], f["start"], f["end"], f["missing"], f["between"]))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["license"])))
    return found.select("doc_id", "n_blocks", F.size("found").cast("long").alias("n_found"), F.array_join(names, ",").alias("licenses"), F.array_join(spans, ",").alias("spans"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("locator")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.round_trip(docs, vocabulary("piece_bpe_32k.model")).select("doc_id", "n_pieces", "pieces_sha256", "lossless")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm.backoff_scores(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", "n_bigrams_known", F.round("logprob", 4).alias("logprob"), F.round("mean_logprob", 6).alias("mean_logprob"))


def op8_lm_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm.backoff_scores(table(spark, sf_dir, "documents"), order=3)
    return scores.select("doc_id", "n_words", "n_bigrams_known", "n_trigrams_known", F.round("logprob", 4).alias("logprob"), F.round("mean_logprob", 6).alias("mean_logprob"))


def op8_lm_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm.relational_scores(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", "n_bigrams_known", F.round("logprob", 4).alias("logprob"), F.round("mean_logprob", 6).alias("mean_logprob"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = f"""
WITH d AS (SELECT doc_id, {ASCII_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

OP6_SQL = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bwin AS (
  SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM bw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bwin),
dwin AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, lens WHERE len(w) >= n)
), hits AS (SELECT doc_id, d.n AS n, s, item FROM dwin d JOIN bwin b ON d.n = b.n AND d.win = b.win),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id)
SELECT dw.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN items USING (doc_id) LEFT JOIN words USING (doc_id)
"""

OP8_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({ASCII_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), o AS (
  SELECT r, s, w[s] AS b, CASE WHEN s > 1 THEN w[s - 1] END AS a FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS s FROM d)
), one AS (SELECT b, count(*) AS c FROM o GROUP BY b),
own1 AS (SELECT r, b, count(*) AS c FROM o GROUP BY r, b),
two AS (SELECT a, b, count(*) AS c FROM o WHERE a IS NOT NULL GROUP BY a, b),
own2 AS (SELECT r, a, b, count(*) AS c FROM o WHERE a IS NOT NULL GROUP BY r, a, b),
n AS (SELECT count(*) AS n FROM o),
x AS (
  SELECT o.r AS r, o.a IS NULL AS head, one.c - own1.c AS c, coalesce(two.c - own2.c, 0) AS c2, prev.c - pown.c AS ca, n.n - len(d.w) AS rest
  FROM o JOIN d ON d.r = o.r CROSS JOIN n JOIN one ON one.b = o.b JOIN own1 ON own1.r = o.r AND own1.b = o.b
  LEFT JOIN two ON two.a = o.a AND two.b = o.b LEFT JOIN own2 ON own2.r = o.r AND own2.a = o.a AND own2.b = o.b
  LEFT JOIN one prev ON prev.b = o.a LEFT JOIN own1 pown ON pown.r = o.r AND pown.b = o.a
), y AS (
  SELECT r, c2 > 0 AS known,
         CASE WHEN c2 > 0 THEN ln(c2) - ln(ca)
              ELSE (CASE WHEN c > 0 THEN ln(c) - ln(rest) ELSE -ln(rest + 1) END) + (CASE WHEN head THEN 0 ELSE ln(0.4) END) END AS s
  FROM x
), z AS (SELECT r, sum(CAST(known AS BIGINT)) AS k, sum(s) AS s FROM y GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(k, 0) AS BIGINT) AS n_bigrams_known,
       round(coalesce(s, 0), 4) AS logprob, CASE WHEN len(w) > 0 THEN round(coalesce(s, 0) / len(w), 6) END AS mean_logprob
FROM d LEFT JOIN z USING (r)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_licenses, op3_simhash, op4_quality, op5_exact_dedup, op6_decontamination, op7_pieces, op8_lm_scores, op8_lm_trigrams, op8_lm_relational, op9_toxicity, op10_secrets)
}
ORACLES = {"op5_exact_dedup": OP5_SQL, "op6_decontamination": OP6_SQL, "op8_lm_scores": OP8_SQL, "op8_lm_relational": OP8_SQL}
