"""Sources and sinks: text folders, chunk and query files, incremental and CSV output."""

from __future__ import annotations

import json
import os
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as tx

CHUNK_FILE = "doc_id string, parent_blocks array<struct<parent_id:string,doc_id:string,text:string,token_count:int>>, child_chunks array<struct<chunk_id:string,parent_id:string,doc_id:string,text:string,token_count:int>>"
QUERY_FILE = (
    "query_id string, query_group string, query_type string, raw_question string, paraphrased_question string, golden_answer string, evidence_quotes array<string>, "
    "doc_id string, parent_id string, lexical_overlap double, paraphrase_quality string"
)
_GOLD = "array<struct<chunk_id:string,text:string,rank:int>>"
BENCHMARK_FILE = (
    "query_id string, query_group string, query_type string, raw_question string, paraphrased_question string, golden_answer string, doc_id_source string, parent_id_source string, "
    f"ground_truth_child_chunks {_GOLD}, extended_child_chunks {_GOLD}"
)


def _stem(path):
    """File name without folders and extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def text_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text): one document per ``*.txt``, named by its file."""
    return spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(_stem(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("text"))


def lossy_text_folder(spark: SparkSession, folder: str) -> DataFrame:
    """As ``text_folder``; bytes that are no UTF-8 are dropped, and so are blank files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    text = F.regexp_replace(F.try_validate_utf8(F.make_valid_utf8(F.col("content").cast("string"))), "�", "")
    return files.select(_stem(F.col("path")).alias("doc_id"), text.alias("text")).filter(F.trim("text") != "")


def pick_by_size(spark: SparkSession, folder: str, n: int, least: int = 40_000, most: int = 150_000) -> DataFrame:
    """(path, length) of the first n files by name within the sizes, or of any size if none is.

    File contents are not read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path", "length")
    fit = files.filter(F.col("length").between(least, most))
    return (fit if fit.limit(1).count() else files).orderBy("path").limit(n)


def chunk_files(spark: SparkSession, folder: str) -> DataFrame:
    """Child chunks of all ``*_chunks.json`` files."""
    return spark.read.schema(CHUNK_FILE).option("pathGlobFilter", "*_chunks.json").json(folder, multiLine=True).select(F.inline("child_chunks"))


def query_files(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all ``*_paraphrased.json`` arrays."""
    return spark.read.schema(QUERY_FILE).option("pathGlobFilter", "*_paraphrased.json").json(folder, multiLine=True)


def benchmark_files(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all ``final_benchmark_*.json`` below a folder."""
    reader = spark.read.schema(BENCHMARK_FILE).option("recursiveFileLookup", "true").option("pathGlobFilter", "final_benchmark_*.json")
    return reader.json(folder, multiLine=True)


def corpus(spark: SparkSession, texts: list[str], ids: list[str] | None = None) -> DataFrame:
    """(ord, chunk_id, text) of texts in memory; ids default to ``c_<i>`` and must be as many."""
    if ids is not None and len(ids) != len(texts):
        raise ValueError(f"{len(texts)} texts and {len(ids)} ids")
    rows = [(i, ids[i] if ids else f"c_{i}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "ord long, chunk_id string, text string")


def write_json(df: DataFrame, path: str, *partitions: str) -> None:
    (df.write.partitionBy(*partitions) if partitions else df.write).mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def report(means: DataFrame, title: str) -> str:
    """A Markdown table of a small result, such as means by group."""
    head = means.columns
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for row in means.limit(1000).collect():
        lines.append("| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in row) + " |")
    return "\n".join(lines) + "\n"


def seeds(answers: DataFrame) -> DataFrame:
    """Seed questions parsed from model answers (doc_id, parent_id, answer)."""
    kind = "array<struct<query_group:string,query_type:string,question:string,golden_answer:string,evidence_quotes:array<string>>>"
    parsed = answers.withColumn("q", F.from_json(tx.json_part(F.col("answer")), kind))
    return parsed.select("doc_id", "parent_id", F.posexplode("q").alias("i", "q")).select("doc_id", "parent_id", F.concat_ws("_q", "parent_id", F.col("i") + 1).alias("query_id"), "q.*")


def term_vectors(spark: SparkSession, path: str):
    """A stored (term, vec) table, or None with a warning if it cannot be read."""
    try:
        return spark.read.parquet(path).select("term", "vec")
    except Exception as e:
        warnings.warn(f"no term vectors at {path}: {e}", stacklevel=2)
        return None


def settings(path: str) -> dict:
    """A configuration file (JSON, or YAML where its library is there); {} if there is none."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        return json.loads(text) or {}
    except ValueError:
        import yaml

        return yaml.safe_load(text) or {}
