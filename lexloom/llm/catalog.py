"""One query per operator, at production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, license_scan, lm_score, quality, simhash_dedup, source_mix, suffix_dedup, topk_search, toxicity, url_filter
from lexloom.llm.runtime import read_table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model and base log probabilities of every document."""
    return lm_score.score_documents(read_table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a mix to the target weights takes."""
    return source_mix.taken(read_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page."""
    judged = url_filter.filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.RULES)
    return judged.select("page.page_id", "host", "path", "rule", "verdict")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document."""
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, with their edit distances."""
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a 200-byte passage repeats elsewhere."""
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), depth=200)


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best neighbours of every fiftieth vector."""
    return topk_search.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def queries():
    return {"op1_lm_score": op1_lm_score, "op2_simhash_dedup": op2_simhash_dedup, "op3_source_mix": op3_source_mix, "op4_url_filter": op4_url_filter, "op5_license_scan": op5_license_scan, "op6_decontaminate": op6_decontaminate, "op7_toxicity": op7_toxicity, "op8_quality": op8_quality, "op9_suffix_dedup": op9_suffix_dedup, "op10_topk_search": op10_topk_search}


_OP4 = """
WITH urls AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule_host, rule_path, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits AS (
  SELECT u.page_id, u.host, u.path, r.rule_host || r.rule_path AS rule, r.action,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rule_host || r.rule_path) DESC) AS n
  FROM urls u LEFT JOIN rules r ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE n = 1
"""


def _op5() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in license_scan.TEMPLATES)
    return f"""
WITH templates AS (
  SELECT name, string_split(trim(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM (VALUES {values}) v(name, t)),
template_sets AS (
  SELECT row_number() OVER () AS t, name, len(w) AS words, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM templates),
docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(list_transform(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM documents),
units AS (
  SELECT r, 1 AS line, unnest(lines) AS u FROM docs
  UNION ALL SELECT r, 0, array_to_string(lines, ' ') FROM docs WHERE len(lines) > 1),
words AS (SELECT row_number() OVER () AS k, r, line, string_split(u, ' ') AS w FROM units),
sets AS (SELECT k, r, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM words WHERE len(w) >= 2),
pairs AS (
  SELECT k, r, line, name, 2 * len(list_intersect(s.b, t.b)) / (len(s.b) + len(t.b)) AS dice
  FROM sets s, template_sets t
  WHERE 2 * least(len(s.b), len(t.b)) >= 0.8 * (len(s.b) + len(t.b)) - 1e-9),
hits AS (SELECT * FROM pairs WHERE dice >= 0.8 - 1e-9),
tops AS (SELECT r, name, dice, row_number() OVER (PARTITION BY r ORDER BY dice DESC, name) AS n FROM hits),
counts AS (SELECT r, count(DISTINCT k) AS n FROM hits WHERE line = 1 GROUP BY r),
texts AS (SELECT r, string_split(array_to_string(lines, ' '), ' ') AS w FROM docs),
bigrams AS (SELECT r, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS all_b FROM texts),
places AS (SELECT r, unnest(all_b) AS x, unnest(range(1, len(all_b) + 1)) AS i FROM bigrams),
firsts AS (SELECT t, unnest(b) AS x FROM template_sets),
runs AS (
  SELECT p.r, s.name, s.b AS t_b, list_distinct(g.all_b[p.i : p.i + s.words - 2]) AS b
  FROM places p JOIN firsts f ON p.x = f.x JOIN template_sets s ON s.t = f.t JOIN bigrams g ON g.r = p.r),
passages AS (SELECT r, name, 2 * len(list_intersect(b, t_b)) / (len(b) + len(t_b)) AS dice FROM runs),
best_run AS (SELECT r, name, dice, row_number() OVER (PARTITION BY r ORDER BY dice DESC, name) AS n FROM passages WHERE dice >= 0.8 - 1e-9),
choice AS (
  SELECT d.r, d.doc_id, len(d.lines) AS n_units, coalesce(c.n, 0) AS n_notices, t.name AS a, t.dice AS x, p.name AS b, p.dice AS y,
         p.dice IS NOT NULL AND (t.dice IS NULL OR p.dice > t.dice) AS passage
  FROM docs d LEFT JOIN tops t ON t.r = d.r AND t.n = 1 LEFT JOIN best_run p ON p.r = d.r AND p.n = 1 LEFT JOIN counts c ON c.r = d.r)
SELECT doc_id, n_units, n_notices, passage, round(greatest(x, y), 6) AS dice,
       CASE WHEN passage THEN b WHEN x = y THEN least(a, b) ELSE a END AS license
FROM choice
"""


def oracle_sql():
    return {"op5_license_scan": _op5(), "op4_url_filter": _OP4}
