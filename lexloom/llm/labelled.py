"""Labelled rows for the classifiers: a bounded, deterministic training sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.llm.runtime import checkpointed


def remainder(modulus: int):
    """crc32(doc_id as text) modulo ``modulus``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, max_rows: int, *columns: str) -> DataFrame:
    """(y, text, *columns) of at most ``max_rows`` labelled rows outside the held-out fold.

    The ids are those with the smallest hashes, and of rows that share an id the one with the
    smallest hash of its text, so the choice depends on neither layout nor order. Only the
    list of ids, of that proven size, is broadcast; the sample is written to the shared
    folder, as it is read more than once. Rows without a label or an id do not train.
    """
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder(modulus) != held))
    chosen = chosen.select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    kept = docs.select("doc_id", "text", *columns).join(F.broadcast(chosen), "doc_id")
    alike = Window.partitionBy("doc_id", "y").orderBy(F.xxhash64("text"), "text", *columns)
    one = kept.withColumn("copy", F.row_number().over(alike)).filter("copy = 1")
    return checkpointed(one.select("y", "text", *columns))


def fold(modulus: int, held: int):
    """True for rows of the held-out fold; a null doc_id is in none."""
    return F.coalesce(remainder(modulus) == held, F.lit(False)).alias("held_out")
