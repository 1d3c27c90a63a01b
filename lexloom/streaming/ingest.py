"""Incremental index: a stream of chunks becomes postings and document-frequency deltas.

An extra beside the batch library: the tables it appends to sum up to the batch index.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators import index as ix


def index_stream(chunks: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append postings, lengths and df deltas of each micro-batch of (ord, text) to ``folder``.

    The batch number partitions the output, so a batch that is replayed overwrites itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        built = ix.build(batch.dropDuplicates(["ord"]))
        built.postings.write.mode("overwrite").parquet(f"{folder}/postings/batch={number}")
        built.lengths.write.mode("overwrite").parquet(f"{folder}/lengths/batch={number}")
        built.terms.select("term", "df").write.mode("overwrite").parquet(f"{folder}/df/batch={number}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_index(spark: SparkSession, folder: str, chunks: DataFrame) -> ix.Index:
    """The index that all appended batches add up to."""
    lengths = spark.read.parquet(f"{folder}/lengths").select("ord", "dl")
    stats = lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    df = spark.read.parquet(f"{folder}/df").groupBy("term").agg(F.sum("df").alias("df"))
    terms = df.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", ix.lucene_idf(F.col("n"), F.col("df")).alias("idf"))
    return replace(ix.build(chunks), postings=spark.read.parquet(f"{folder}/postings").select("ord", "term", "tf"), lengths=lengths, terms=terms, stats=stats, kept=True)
