"""Building and checking retrieval benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import text as tx
from lexloom.operators.expansion import fold_distinct
from lexloom.operators.rerank import ask
from lexloom.operators.scoring import dot, norm


def overlap(a: Column, b: Column) -> Column:
    """Share of the words of ``a`` that ``b`` has; zero without words."""
    w = F.array_distinct(tx.word_tokens(a))
    return F.when(F.size(w) > 0, F.size(F.array_intersect(w, tx.word_tokens(b))) / F.size(w)).otherwise(0.0)


def relevance(quotes: Column, answer: Column, question: Column, chunk: Column) -> Column:
    """10 per contained quote, 8 for a long quote's first or last 25 characters, else 5 times overlap.

    Plus 5 times the answer's and 2 times the question's share of words in the chunk.
    """
    low = tx.normalised(chunk)

    def of(quote):
        q = tx.normalised(quote)
        edge = F.contains(low, F.substring(q, 1, 25)) | F.contains(low, F.right(q, F.lit(25)))
        return F.when(q == "", 0.0).when(F.contains(low, q), 10.0).when((F.length(q) > 20) & edge, 8.0).otherwise(5 * overlap(quote, chunk))

    return F.aggregate(F.transform(quotes, of), F.lit(0.0), lambda a, x: a + x) + 5 * overlap(answer, chunk) + 2 * overlap(question, chunk)


def core_chunks(scored: DataFrame) -> DataFrame:
    """Chunks (qid, chunk_id, score) near the best: over 0.5 and at least 0.7 of it or 5, else the best."""
    w = Window.partitionBy("qid")
    best = scored.withColumn("best", F.max("score").over(w)).withColumn("at", F.row_number().over(w.orderBy(F.desc("score"), "chunk_id")))
    good = (F.col("score") > 0.5) & ((F.col("score") >= 0.7 * F.col("best")) | (F.col("score") >= 5))
    marked = best.withColumn("good", good).withColumn("any", F.max("good").over(w))
    return marked.filter(F.col("good") | (~F.col("any") & (F.col("at") == 1))).select("qid", "chunk_id", "score")


def distinct_queries(queries: DataFrame, group: str, limit: float = 0.9) -> DataFrame:
    """(group, qid) that are not over ``limit`` similar to an earlier kept query of the group.

    ``queries`` has qid and vec; the fold holds one group's queries, as a document's few.
    """
    lists = queries.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("qid", "vec"))).alias("q"))
    cos = lambda a, b: dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-10))
    kept = fold_distinct(F.col("q"), lambda k, x: cos(k.vec, x.vec) > limit)
    return lists.select(group, F.explode(F.transform(kept, lambda x: x.qid)).alias("qid"))


def stress_corpus(docs: DataFrame, gold: DataFrame, n: int, domain: str = "source") -> DataFrame:
    """n documents per domain, those of ``gold`` (doc_id) first, then by id."""
    marked = docs.join(gold.select("doc_id").distinct().withColumn("is_gold", F.lit(True)), "doc_id", "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))
    order = Window.partitionBy(domain).orderBy(F.desc("is_gold"), "doc_id")
    return marked.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= n)


def sample_blocks(blocks: DataFrame, n: int) -> DataFrame:
    """n blocks of each document in an order given by a hash of its and the block's id."""
    order = Window.partitionBy("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.col("parent_id"))), "parent_id")
    return blocks.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= n).drop("at")


def missing(rows: DataFrame, existing: DataFrame, *keys: str) -> DataFrame:
    """Rows without a partner: the integrity check, and what a resumed run still has to do."""
    return rows.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def append_new(rows: DataFrame, path: str, *keys: str) -> int:
    """Append the rows whose keys a table does not have yet; their number."""
    spark = rows.sparkSession
    try:
        rows = missing(rows, spark.read.parquet(path), *keys)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    before = rows.count()
    rows.write.mode("append").parquet(path)
    return before


def multi_block(gold: DataFrame) -> DataFrame:
    """(qid, blocks, multi): distinct parent blocks of gold chunks (qid, chunk_id)."""
    per = gold.groupBy("qid").agg(F.countDistinct(tx.parent_block(F.col("chunk_id"), F.col("chunk_id"))).alias("blocks"))
    return per.withColumn("multi", F.col("blocks") > 1)


def valid_seeds(questions: Column) -> Column:
    """Whether there are exactly four seeds with type, question, answer and quotes."""
    full = lambda q: q.question.isNotNull() & q.golden_answer.isNotNull() & q.evidence_quotes.isNotNull() & q.query_type.isNotNull()
    return (F.size(questions) == 4) & F.forall(questions, full)


def verbatim(quotes: Column, source: Column) -> Column:
    """Share of quotes that the source contains."""
    return F.when(F.size(quotes) > 0, F.size(F.filter(quotes, lambda q: F.contains(source, q))) / F.size(quotes)).otherwise(1.0)


def split_verdicts(judged: DataFrame) -> DataFrame:
    """Relevant chunks (qid, parent_source, chunk_id, verdicts) as core or extended.

    A chunk counts if both of its judgements are true; core if it is of the query's block.
    """
    sure = judged.filter(F.size("verdicts") >= 2).filter(F.forall("verdicts", lambda v: v))
    own = tx.parent_block(F.col("chunk_id"), F.col("chunk_id")) == F.col("parent_source")
    return sure.select("qid", "chunk_id", F.when(own, "core").otherwise("extended").alias("kind"))


JUDGE = "You are a judge. Answer with a JSON list of booleans, one for each chunk."


def judged(candidates: DataFrame, model, size: int = 5, head: str = JUDGE) -> DataFrame:
    """(qid, chunk_id, parent_source, verdicts) of candidates (qid, question, parent_source, chunk_id, text).

    Batches hold chunks in an order given by a hash. A list of another length than its batch
    is false for all; what is true is asked again by itself, and ``verdicts`` holds both answers.
    """
    at = F.row_number().over(Window.partitionBy("qid").orderBy(F.xxhash64("qid", "chunk_id"), "chunk_id")) - 1
    rows = candidates.withColumn("batch", F.floor(at / size).cast("int")).withColumn("slot", (at % size).cast("int"))
    block = F.concat(F.lit("--- Chunk "), F.col("slot").cast("string"), F.lit(" ---\n"), "text")
    lists = rows.groupBy("qid", "question", "batch").agg(F.sort_array(F.collect_list(F.struct("slot", block.alias("b")))).alias("d"))
    prompt = F.concat(F.lit(f"{head}\nQuery: "), "question", F.lit("\n\n"), F.array_join(F.transform("d", lambda x: x.b), "\n\n"))
    answer = F.from_json(tx.json_part(F.col("answer")), "array<boolean>")
    first = ask(lists, prompt, model).withColumn("v", answer)
    first = first.select("qid", "batch", F.when(F.size("v") == F.size("d"), F.col("v")).alias("v"))
    told = rows.join(first, ["qid", "batch"], "left").withColumn("first", F.coalesce(F.get("v", F.col("slot")), F.lit(False))).drop("v", "batch", "slot")
    alone = F.concat(F.lit(f"{head}\nQuery: "), "question", F.lit("\n\n--- Chunk 0 ---\n"), "text")
    again = ask(told.filter("first").select("qid", "chunk_id", "question", "text"), alone, model).withColumn("v", answer)
    again = again.select("qid", "chunk_id", F.when(F.size("v") == 1, F.coalesce(F.get("v", F.lit(0)), F.lit(False))).otherwise(False).alias("second"))
    both = told.join(again, ["qid", "chunk_id"], "left")
    return both.select("qid", "chunk_id", "parent_source", F.filter(F.array("first", "second"), lambda x: x.isNotNull()).alias("verdicts"))


def with_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Child chunks with the text of their parent block."""
    return children.join(parents.select("parent_id", F.col("text").alias("parent_text")), "parent_id")


def run_against_gold(runs: DataFrame, gold: DataFrame) -> DataFrame:
    """A run's rows (query, ...) with the truth of the same question; others are left out."""
    return runs.join(gold.withColumnRenamed("question", "query"), "query")
