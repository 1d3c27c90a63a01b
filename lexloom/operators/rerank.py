"""Snippets, reranking by an injected model, target selection and late expansion."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexloom.functions import text as tx


def snippet(text: Column, terms: Column, words: int = 250) -> Column:
    """The sentences with most query terms, best first, or else the first three; cut to words."""
    low = F.transform(terms, F.lower)
    scored = F.transform(tx.sentences(text), lambda s, i: F.struct((-F.size(F.filter(low, lambda t: F.contains(F.lower(s), t)))).alias("n"), i.alias("i"), s.alias("s")))
    pick = tx.bind(scored, lambda a: F.when(F.exists(a, lambda x: x.n < 0), F.sort_array(F.filter(a, lambda x: x.n < 0))).otherwise(F.slice(a, 1, 3)))
    return tx.first_words(F.array_join(F.transform(pick, lambda x: x.s), " "), words)


def by_score(hits: DataFrame, k: int = 5) -> DataFrame:
    """The fallback of every reranker: the k best by score, ties by ``ord``."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "ord")
    return hits.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def apply_order(hits: DataFrame, answers: DataFrame, k: int = 5) -> DataFrame:
    """Hits in a model's order: (qid, ids) lists name ``doc_<i>`` or chunk ids, first mention counts.

    Chunks it leaves out follow by score; names it invents are dropped.
    """
    alias = hits.select("qid", "ord", "chunk_id", F.concat(F.lit("doc_"), F.row_number().over(Window.partitionBy("qid").orderBy("rank")) - 1).alias("alias"))
    named = answers.select(F.col("qid").alias("asked"), F.posexplode("ids").alias("at", "name"))
    meant = (F.col("asked") == F.col("qid")) & ((F.col("name") == F.col("alias")) | (F.col("name") == F.col("chunk_id")))
    hit = named.join(alias, meant).select("qid", "ord", "at")
    placed = hits.join(hit.groupBy("qid", "ord").agg(F.min("at").alias("at")), ["qid", "ord"], "left")
    order = Window.partitionBy("qid").orderBy(F.col("at").asc_nulls_last(), F.desc(F.round("score", 9)), "ord")
    return placed.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k).drop("at")


def ask(rows: DataFrame, prompt: Column, model: Callable[[str], str], name: str = "answer") -> DataFrame:
    """``rows`` with a model's answer to each prompt; null where the call fails.

    The callable runs in the Python workers, one batch at a time.
    """
    prompted = rows.withColumn("prompt", prompt)
    schema = T.StructType([*prompted.schema.fields, T.StructField(name, T.StringType())])

    def call(p):
        try:
            return model(p)
        except Exception:  # a failed call is answered by the fallback
            return None

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{name: [call(p) for p in pdf["prompt"]]})

    return prompted.mapInPandas(run, schema).drop("prompt")


def pointwise(hits: DataFrame, prompt: Column, model) -> DataFrame:
    """Hits that the model calls relevant, with its score; unreadable answers drop out."""
    judged = ask(hits, prompt, model)
    answer = F.from_json(tx.json_part(F.col("answer")), "relevant boolean, relevance_score double")
    return judged.withColumn("a", answer).filter("a.relevant").select(*hits.columns, F.col("a.relevance_score").alias("relevance_score"))


def listwise(hits: DataFrame, prompt_of_list: Callable[[pd.DataFrame], str], model, k: int = 5) -> DataFrame:
    """Hits reordered by one answer per query; by score where the answer cannot be read."""
    qid = hits.schema["qid"].dataType.simpleString()

    def one(pdf):
        try:
            answer = model(prompt_of_list(pdf.sort_values("rank")))
        except Exception:
            answer = None
        return pd.DataFrame({"qid": pdf["qid"].iloc[:1], "answer": [answer]})

    answers = hits.groupBy("qid").applyInPandas(one, f"qid {qid}, answer string")
    lists = answers.select("qid", F.coalesce(F.from_json(tx.json_part(F.col("answer")), "array<string>"), F.array().cast("array<string>")).alias("ids"))
    return apply_order(hits, lists, k)


def in_batches(queue: DataFrame, size: int, *order: Column) -> DataFrame:
    """``queue`` with ``batch`` and ``slot``: each query's rows in this order, ``size`` a batch."""
    at = F.row_number().over(Window.partitionBy("qid").orderBy(*order, "ord")) - 1
    return queue.withColumn("batch", F.floor(at / size).cast("int")).withColumn("slot", (at % size).cast("int"))


def _asked(rows: DataFrame, evidence: Column, queries: DataFrame, head: str, model) -> DataFrame:
    """(qid, batch, answer): one prompt a batch, its documents named ``doc_<slot>``."""
    block = F.concat(F.lit("Document ID: doc_"), F.col("slot").cast("string"), F.lit("\n"), evidence, F.lit("\n" + "-" * 40))
    texts = rows.groupBy("qid", "batch").agg(F.sort_array(F.collect_list(F.struct("slot", block.alias("b")))).alias("d"))
    prompt = F.concat(F.lit(head), F.lit("\nQuery: "), "query", F.lit("\n\n"), F.array_join(F.transform("d", lambda x: x.b), "\n"))
    return ask(texts.join(queries.select("qid", "query"), "qid"), prompt, model).select("qid", "batch", "answer")


POINTWISE = 'Judge each document. Answer as JSON: {"evaluations": [{"chunk_id": "doc_0", "relevant": true, "relevance_score": 0.9}]}'
LISTWISE = 'List the relevant documents, best first. Answer as JSON: {"target_fact": "...", "relevant_chunk_ids": ["doc_0"]}'


def pointwise_batches(queue: DataFrame, queries: DataFrame, model, size: int = 5, head: str = POINTWISE) -> DataFrame:
    """(qid, ord, relevance_score, position) of the documents called relevant, best score first.

    Batches keep the queue's rank; only aliases count as names; an unreadable batch adds none.
    """
    rows = in_batches(queue, size, F.col("rank"))
    answers = _asked(rows, F.trim("text"), queries, head, model)
    schema = "struct<evaluations:array<struct<chunk_id:string,relevant:boolean,relevance_score:double>>>"
    told = answers.select("qid", "batch", F.posexplode(F.from_json(tx.json_object(F.col("answer")), schema)["evaluations"]).alias("at", "e"))
    last = told.groupBy("qid", "batch", F.col("e.chunk_id").alias("alias")).agg(F.max_by("e", "at").alias("e"))
    hit = rows.withColumn("alias", F.concat(F.lit("doc_"), F.col("slot").cast("string"))).join(last, ["qid", "batch", "alias"]).filter("e.relevant")
    scored = hit.withColumn("relevance_score", F.coalesce("e.relevance_score", F.lit(0.0)))
    order = Window.partitionBy("qid").orderBy(F.desc("relevance_score"), "batch", "slot")
    return scored.select("qid", "ord", "relevance_score", F.row_number().over(order).alias("position"))


def listwise_batches(queue: DataFrame, queries: DataFrame, model, size: int = 10, presort: str | None = "score", most_chars: int = 2000, head: str = LISTWISE) -> DataFrame:
    """(qid, ord, relevance_score, position) of the documents a model lists, batch after batch.

    The queue is sorted by ``presort`` (``score``, or the ``length`` of its samples), largest
    first, or left in rank order. Aliases and chunk ids count as names; the place in a list
    gives the score max(0, 1 - 0.1 * place), and a document's first mention its position.
    """
    rows = in_batches(queue, size, F.desc(F.round(presort, 9)) if presort else F.col("rank"))
    answers = _asked(rows, F.concat(F.lit("Passage:\n"), F.trim(tx.first_chars(F.col("text"), most_chars))), queries, head, model)
    told = answers.select("qid", "batch", F.posexplode(F.from_json(tx.json_object(F.col("answer")), "struct<relevant_chunk_ids:array<string>>")["relevant_chunk_ids"]).alias("at", "name"))
    alias = F.concat(F.lit("doc_"), F.col("slot").cast("string"))
    names = rows.select("qid", "batch", "ord", F.explode(F.array_distinct(F.array(alias, "chunk_id"))).alias("name"))
    hit = names.join(told, ["qid", "batch", "name"]).groupBy("qid", "batch", "ord").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    order = Window.partitionBy("qid").orderBy("batch", "first")
    return hit.select("qid", "ord", F.greatest(F.lit(0.0), F.round(1 - 0.1 * F.col("last"), 9)).alias("relevance_score"), F.row_number().over(order).alias("position"))


def targets(routed: DataFrame, reranked: DataFrame) -> DataFrame:
    """Bypassed hits, then reranked ones; the best hit where a query has neither."""
    through = routed.filter("decision = 'bypass'").select("qid", "ord", F.lit(0).alias("lane"), F.col("rank").alias("at"))
    both = through.unionByName(reranked.select("qid", "ord", F.lit(1).alias("lane"), F.col("position").alias("at")))
    first = routed.filter("rank = 1").join(both, "qid", "left_anti").select("qid", "ord", F.lit(2).alias("lane"), F.col("rank").alias("at"))
    order = Window.partitionBy("qid").orderBy("lane", "at")
    return both.unionByName(first).withColumn("position", F.row_number().over(order)).drop("at")


def late(chosen: DataFrame, chunks: DataFrame, n_max: int = 10) -> DataFrame:
    """(qid, position, ord, text) of the first n_max targets; unknown ids are skipped."""
    return chosen.filter(F.col("position") <= n_max).join(chunks.select("ord", "text"), "ord").select("qid", "position", "ord", "text")


def context(expanded: DataFrame) -> DataFrame:
    """(qid, context): numbered blocks in order."""
    block = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), "text")
    return expanded.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", block.alias("b")))), lambda x: x.b), "\n\n").alias("context"))


def compress(text: Column, idf: Column, rate: float = 0.3) -> Column:
    """Extractive stand-in for prompt compression: the share of words of highest idf, in order."""
    words = tx.plain_tokens(text)
    keyed = F.transform(words, lambda w, i: F.struct((-F.coalesce(F.try_element_at(idf, F.lower(w)), F.lit(0.0))).alias("k"), i.alias("i"), w.alias("w")))
    keep = F.slice(F.sort_array(keyed), 1, F.greatest(F.lit(1), (F.size(words) * rate).cast("int")))
    return F.when(F.size(words) > 0, F.array_join(F.transform(F.array_sort(F.transform(keep, lambda x: F.struct(x.i.alias("i"), x.w.alias("w")))), lambda x: x.w), " ")).otherwise("")
