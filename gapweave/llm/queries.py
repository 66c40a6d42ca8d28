"""Queries op1_ to op10_ over the whole of their tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_layout, ngram_lm, ogg, packing, quality, simhash, substring, urlfilter, wavelet


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    held = ngram_lm.held_out("doc_id", 4, 2)
    model = quality.fit(docs, _table(spark, sf_dir, "labels", "doc_id", "quality"), ~held)
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op2_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = ogg.from_media(ogg.to_media(_table(spark, sf_dir, "documents", "doc_id", "text")))
    tail = F.expr("substring(samples, length(samples) - 31, 32)")
    return read.select(
        "doc_id", "n_bytes", F.length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


#: Rules (host/path) and verdicts of op3_url_rules.
URL_RULES = [
    urlfilter.Rule("com/", "allow"),
    urlfilter.Rule("example.com/en/", "block"),
    urlfilter.Rule("www.example.com/en/", "allow"),
    urlfilter.Rule("net/es/", "block"),
    urlfilter.Rule("net/fr/", "block"),
]


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    held = ngram_lm.held_out("doc_id", 10, 0)
    model = ngram_lm.train(docs.where(~held))
    return ngram_lm.score(docs, model, "doc_id").select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract(_table(spark, sf_dir, "pages", "page_id", "html"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(_table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_ogg": op2_ogg,
    "op3_url_rules": op3_url_rules,
    "op4_kneser_ney": op4_kneser_ney,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_simhash": op6_simhash,
    "op7_html": op7_html,
    "op8_decontamination": op8_decontamination,
    "op9_packing": op9_packing,
    "op10_wavelet": op10_wavelet,
}

SQL: dict[str, str] = {
    "op3_url_rules": """
WITH parts AS (
  SELECT page_id,
    CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(rule, rule_host, rule_path, rule_verdict) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
  ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
judged AS (
  SELECT p.page_id, p.host, p.path, r.rule, r.rule_verdict,
    row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rule) DESC NULLS LAST, r.rule) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM judged WHERE k = 1
""",
    "op5_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50),
windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 49), ' ')) AS h FROM starts),
least_doc AS (
  SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
gone AS (
  SELECT DISTINCT x.doc_id, unnest(range(x.i, x.i + 50)) AS k FROM windows x JOIN least_doc USING (h) WHERE least < x.doc_id),
lists AS (
  SELECT doc_id, list(k) AS ks, count(*) AS n FROM gone GROUP BY doc_id),
places AS (
  SELECT doc_id, words[k] AS word, k FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS k FROM w)),
kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.k) AS body FROM places p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.k = g.k GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(l.n, 0) AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM w LEFT JOIN lists l ON w.doc_id = l.doc_id LEFT JOIN kept k ON w.doc_id = k.doc_id
""",
}
