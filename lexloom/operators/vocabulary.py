"""Ranked vocabularies of a corpus, and term vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import text as tx
from lexloom.operators.index import Index, spread
from lexloom.operators.scoring import norm

TERM = r"^[a-zA-Z0-9\-_ ]+$"


def unigrams(index: Index) -> DataFrame:
    """(term, df) of terms in 2 documents to max(5, 15 %) of them; no stopwords or numbers."""
    most = F.greatest(F.lit(5), F.floor(0.15 * F.col("n")).cast("long"))
    rows = index.terms.crossJoin(F.broadcast(index.stats.select("n")))
    kept = (F.col("df") >= 2) & (F.col("df") <= most) & ~F.col("term").isin(tx.STOPWORDS) & ~F.col("term").rlike(r"^\p{Nd}+$")
    return rows.filter(kept & (F.length("term") >= 3) & F.col("term").rlike(TERM)).select("term", "df")


def neighbours(text: Column) -> Column:
    """Pairs of neighbours among a text's words that can be terms."""
    plain = F.filter(
        F.split(F.translate(F.lower(text), tx.PUNCTUATION, ""), r"(?U)\s+"),
        lambda t: (F.length(t) >= 3) & ~t.isin(tx.STOPWORDS) & ~t.rlike(r"^\p{Nd}+$") & t.rlike(TERM),
    )
    return tx.bind(plain, pairs)


def pairs(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def bigrams(chunks: DataFrame, first: int = 1000) -> DataFrame:
    """(term, count): neighbours after filtering, all occurrences in the first documents."""
    head = chunks.select("ord", "text").orderBy("ord").limit(first)
    dealt = spread(head).select(F.explode(neighbours(F.col("text"))).alias("term"))
    return dealt.groupBy("term").agg(F.count("*").alias("count"))


def salient(index: Index, idf_of, limit: int = 1000, idf_floor: float = 1.5) -> DataFrame:
    """(rank, term, count, idf, salience): idf * ln(1 + count), best first, ties by term.

    ``idf_of`` gives (term, idf) of a table with ``term``. The 2,500 most frequent unigrams
    and the 1,000 most frequent bigrams compete.
    """
    uni = unigrams(index).orderBy(F.desc("df"), "term").limit(2500).select("term", F.col("df").alias("count"))
    bi = bigrams(index.chunks).filter("count >= 2").orderBy(F.desc("count"), "term").limit(1000)
    pool = uni.unionByName(bi)
    scored = pool.join(idf_of(pool), "term").filter(F.col("idf") >= idf_floor).withColumn("salience", F.col("idf") * F.log(1 + F.col("count")))
    top = scored.orderBy(F.desc(F.round("salience", 9)), "term").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("salience", 9)), "term")))


def frequent(chunks: DataFrame, limit: int = 2000) -> DataFrame:
    """(term, count) of the most frequent letters-only words and their bigrams, ties by term."""
    words = spread(chunks.select("text")).select(tx.alpha_tokens(F.col("text")).alias("w"))
    terms = words.select(F.explode(F.concat("w", pairs(F.col("w")))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "term").limit(limit)


def above_median(vocabulary: DataFrame, idf: DataFrame, limit: int) -> DataFrame:
    """Terms of the 3 * limit most frequent whose idf (unknown: zero) is at least the upper median."""
    pool = vocabulary.orderBy(F.desc("count"), "term").limit(3 * limit).join(idf, "term", "left").withColumn("idf", F.coalesce("idf", F.lit(0.0)))
    ranked = pool.withColumn("at", F.row_number().over(Window.orderBy("idf", "term"))).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    middle = ranked.filter(F.col("at") == F.floor(F.col("n") / 2) + 1).select(F.col("idf").alias("middle"))
    return ranked.crossJoin(F.broadcast(middle)).filter("idf >= middle").orderBy(F.desc("count"), "term").limit(limit).select("term", "count", "idf")


def hash_vector(text: Column, dims: int = 32) -> Column:
    """Unit vector of hashed character trigrams of `` text ``: lexical, not semantic.

    A stand-in for a model's embeddings that any engine can recompute; production passes a
    table of precomputed vectors instead. Similarity thresholds need calibration for it.
    """
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3)))
    buckets = F.transform(grams, lambda g: (F.conv(F.substring(F.md5(g.cast("binary")), 1, 8), 16, 10).cast("long") % dims).cast("int"))
    counts = tx.bind(buckets, lambda b: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double")))
    return tx.bind(counts, lambda v: tx.bind(norm(v), lambda n: F.transform(v, lambda x: x / n)))


def vectors(phrases: DataFrame, key: str, encode=hash_vector) -> DataFrame:
    """``phrases`` with a column ``vec`` of the phrase in ``key``."""
    return phrases.withColumn("vec", encode(F.col(key)))
