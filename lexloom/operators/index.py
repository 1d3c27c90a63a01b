"""Inverted index over chunks (ord, text): postings, document and term statistics."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as tx


#: Bytes of (compressed) text for one task that counts words.
TASK_BYTES = 2 << 20


@dataclass(frozen=True)
class Index:
    """Lazy tables: tokens (ord, tokens), postings (term, ord, tf), lengths (ord, dl),
    terms (term, df, idf), stats (n, avgdl). ``kept`` tells that postings are stored."""

    chunks: DataFrame
    tokens: DataFrame
    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    stats: DataFrame
    kept: bool = False


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt anew if it has fewer partitions than the cluster has cores (a small file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tasks(df: DataFrame) -> int:
    """Tasks among which ``df`` is dealt where each word becomes a row: more with its size.

    The planner's estimate of the size counts, TASK_BYTES a task, so that a task's tables do
    not grow with the input; where it knows none, the session's number is taken.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir`` and read back.

    Only a session on one machine may name none.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(f"{named or tempfile.gettempdir() + '/checkpoints'}/{uuid.uuid4()}")
    return df.checkpoint(eager=True)


def lucene_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def build(chunks: DataFrame, tokenizer=tx.whitespace_tokens) -> Index:
    """An index of ``chunks``; nothing is computed until it is asked for."""
    plain = chunks.select("ord", "text")
    tokens = spread(plain).select("ord", tokenizer(F.col("text")).alias("tokens"))
    # Texts are dealt by ord, which is less to move than their (document, term) rows; the
    # counts of a document then need no further exchange.
    n = tasks(plain)
    dealt = plain.repartition(n, "ord").select("ord", tokenizer(F.col("text")).alias("tokens"))
    postings = dealt.select("ord", F.explode("tokens").alias("term")).groupBy("ord", "term").agg(F.count("*").alias("tf"))
    lengths = tokens.select("ord", F.size("tokens").cast("long").alias("dl"))
    stats = lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    return Index(chunks, tokens, postings, lengths, _terms(postings, stats, n), stats)


def _terms(postings: DataFrame, stats: DataFrame, n: int) -> DataFrame:
    df = postings.select("term").repartition(n, "term").groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", lucene_idf(F.col("n"), F.col("df")).alias("idf"))


def keep_terms(index: Index) -> Index:
    """The index with its term table stored, for plans that read it more than once."""
    return replace(index, terms=stored(index.terms))


def keep(index: Index) -> Index:
    """The index with postings, lengths and terms stored, for batch after batch of queries."""
    postings, lengths = stored(index.postings), stored(index.lengths)
    stats = stored(lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")))
    return replace(index, postings=postings, lengths=lengths, terms=stored(_terms(postings, stats, tasks(index.chunks.select("ord", "text")))), stats=stats, kept=True)


def idf_summary(terms: DataFrame) -> DataFrame:
    """One row: max_idf (1.0 without terms) and the exact median_idf (0.0 without terms)."""
    return terms.agg(F.coalesce(F.max("idf"), F.lit(1.0)).alias("max_idf"), F.coalesce(F.percentile("idf", 0.5), F.lit(0.0)).alias("median_idf"))


def term_idf(phrases: DataFrame, terms: DataFrame, key: str = "phrase", keep: tuple = ()) -> DataFrame:
    """(*keep, key, idf): mean over the phrase's words; unknown words count half of max_idf; none, zero."""
    top = F.broadcast(idf_summary(terms).select("max_idf"))
    words = phrases.select(*keep, key, F.posexplode_outer(tx.whitespace_tokens(F.col(key))).alias("at", "term"))
    found = words.join(terms.select("term", "idf"), "term", "left").crossJoin(top)
    value = F.when(F.col("term").isNull(), 0.0).otherwise(F.coalesce("idf", F.col("max_idf") * 0.5))
    return found.withColumn("value", value).groupBy(*keep, key).agg(F.avg("value").alias("idf"))


def normalised_idf(idf: Column, max_idf: Column) -> Column:
    return F.when(max_idf > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), idf / max_idf))).otherwise(0.0)
