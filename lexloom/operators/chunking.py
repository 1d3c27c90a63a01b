"""Sliding-window chunks, parent blocks, child chunks and bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import text as tx


def windows(rows: DataFrame, tokens: str, size: int, overlap: int = 0) -> DataFrame:
    """``rows`` with (i, window): tokens cut every size - overlap; the last reaches the end.

    A row without tokens gives none.
    """
    step, n = size - overlap, F.size(tokens)
    more = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    at = rows.filter(n > 0).withColumn("i", F.explode(F.sequence(F.lit(0), more)))
    return at.withColumn("window", F.slice(F.col(tokens), F.col("i") * step + 1, F.lit(size)))


def parents(docs: DataFrame, size: int = 3000) -> DataFrame:
    """(doc_id, i, parent_id, text, token_count) of (doc_id, text)."""
    rows = windows(docs.select("doc_id", tx.plain_tokens(F.col("text")).alias("tokens")), "tokens", size)
    return rows.select("doc_id", "i", F.concat_ws("_block", F.col("doc_id"), F.col("i")).alias("parent_id"), F.array_join("window", " ").alias("text"), F.size("window").alias("token_count"))


def children(blocks: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """(doc_id, parent_id, chunk_id, text, token_count), windows inside each parent."""
    rows = windows(blocks.select("doc_id", "parent_id", tx.plain_tokens(F.col("text")).alias("tokens")), "tokens", size, overlap)
    return rows.select("doc_id", "parent_id", F.concat_ws("_chunk", "parent_id", F.col("i")).alias("chunk_id"), F.array_join("window", " ").alias("text"), F.size("window").alias("token_count"))


def bridges(blocks: DataFrame, half: int = 500) -> DataFrame:
    """The end of each parent with the start of the next, a chunk that is its own parent."""
    rows = blocks.select("doc_id", "i", tx.plain_tokens(F.col("text")).alias("t"))
    rows = rows.withColumn("next", F.lead("t").over(Window.partitionBy("doc_id").orderBy("i"))).filter("next is not null")
    joined = F.concat(F.slice("t", F.greatest(F.size("t") - half + 1, F.lit(1)), F.lit(half)), F.slice("next", 1, half))
    name = F.concat(F.col("doc_id").cast("string"), F.lit("_bridge"), F.col("i"), F.lit("-"), F.col("i") + 1)
    return rows.select("doc_id", name.alias("parent_id"), name.alias("chunk_id"), F.array_join(joined, " ").alias("text"), F.size(joined).alias("token_count"))


def bpe_windows(docs: DataFrame, ranks_path: str, pattern: str, size: int, overlap: int) -> DataFrame:
    """(doc_id, i, text, token_count): windows of ``size`` byte-pair tokens, each decoded again.

    ``ranks_path`` is a file of base64 tokens and ranks, readable on every executor; a text
    without tokens has no window, and the last window ends with the text.
    """

    def run(batches):
        import base64

        import pandas as pd
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids, at, i = coder.encode_ordinary(text or ""), 0, 0
                while ids:
                    part = ids[at : at + size]
                    rows.append((doc_id, i, coder.decode(part), len(part)))
                    if at + size >= len(ids):
                        break
                    at, i = at + size - overlap, i + 1
            yield pd.DataFrame(rows, columns=["doc_id", "i", "text", "token_count"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, i int, text string, token_count int")
