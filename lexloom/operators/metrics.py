"""Retrieval metrics over ranked hits (qid, rank, ord) and gold (qid, ord)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as tx


def at_k(hits: DataFrame, gold: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Per query: precision (over retrieved, and over k), recall, strict, mrr, complete.

    An empty gold set recalls 1.0 and an empty result has precision 0.0.
    """
    marked = hits.filter(F.col("rank") <= k).join(gold.distinct().withColumn("hit", F.lit(1)), ["qid", "ord"], "left")
    per = marked.groupBy("qid").agg(F.count("*").alias("retrieved"), F.count("hit").alias("found"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_gold_rank"))
    size = gold.distinct().groupBy("qid").agg(F.count("*").alias("gold"))
    rows = queries.select("qid").join(per, "qid", "left").join(size, "qid", "left").fillna(0, ["retrieved", "found", "gold"])
    return rows.select(
        "qid", "retrieved", "found", "gold", "first_gold_rank",
        F.when(F.col("retrieved") > 0, F.col("found") / F.col("retrieved")).otherwise(0.0).alias("precision"), (F.col("found") / k).alias("precision_at_k"),
        F.when(F.col("gold") > 0, F.col("found") / F.col("gold")).otherwise(1.0).alias("recall"),
        F.when(F.col("found") > 0, 1.0).otherwise(0.0).alias("strict"), F.coalesce(1 / F.col("first_gold_rank"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("found") == F.col("gold"), 1.0).otherwise(0.0).alias("complete"),
    )


def doc_recall(hits: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """One row, (doc_recall, queries): mean over queries with gold documents of the percentage
    of them among the documents of the first k hits. Both sides are (qid, doc_id)."""
    found = hits.filter(F.col("rank") <= k).select("qid", "doc_id").distinct().withColumn("hit", F.lit(1))
    per = gold.select("qid", "doc_id").distinct().join(found, ["qid", "doc_id"], "left").groupBy("qid").agg((100 * F.count("hit") / F.count("*")).alias("share"))
    return per.agg(F.coalesce(F.avg("share"), F.lit(0.0)).alias("doc_recall"), F.count("*").alias("queries"))


def means(per_query: DataFrame, *by: str) -> DataFrame:
    """Means of all metrics, over groups if asked for."""
    names = [c for c in ("precision", "precision_at_k", "recall", "strict", "mrr", "complete") if c in per_query.columns]
    return per_query.groupBy(*by).agg(*(F.avg(c).alias(c) for c in names))


def compression_ratio(before: Column, after: Column) -> Column:
    """Sizes before over after; infinite for nothing after."""
    return F.when(after == 0, float("inf")).otherwise(before / after)


def coverage(generated: Column, gold: Column, least: float = 0.5) -> Column:
    """Share of gold phrases whose words overlap all generated words enough; 1.0 without gold."""
    words = F.array_distinct(F.flatten(F.transform(generated, tx.whitespace_tokens)))
    close = tx.bind(words, lambda w: F.size(F.filter(gold, lambda g: tx.jaccard(tx.whitespace_tokens(g), w) >= least)))
    return F.when(F.size(gold) > 0, close / F.size(gold)).otherwise(1.0)


def keyword_jaccard(generated: Column, gold: Column) -> Column:
    """Jaccard of all words; 1.0 if both are empty."""
    words = lambda c: F.array_distinct(F.flatten(F.transform(c, tx.whitespace_tokens)))
    a, b = words(generated), words(gold)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(tx.jaccard(a, b))


def acronym_retention(query: Column, generated: Column) -> Column:
    """Share of the query's capital words found in generated terms; 1.0 without any."""
    caps = F.filter(tx.plain_tokens(query), lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 1))
    kept = F.filter(caps, lambda w: F.exists(generated, lambda g: F.contains(F.lower(g), F.lower(w))))
    return F.when(F.size(caps) > 0, F.size(kept) / F.size(caps)).otherwise(1.0)


def stopword_terms(generated: Column) -> Column:
    """Number of generated terms that hold a stopword."""
    return F.size(F.filter(generated, lambda g: F.arrays_overlap(tx.whitespace_tokens(g), F.array(*map(F.lit, tx.STOPWORDS)))))


def kv_cache_gib(layers: Column, kv_heads: Column, head_dim: Column, context: Column, bytes_each: Column) -> Column:
    return 2 * layers * kv_heads * head_dim * context * bytes_each / (1024.0**3)
