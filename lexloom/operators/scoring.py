"""Retrieval for batches of queries: BM25 variants, weights, vectors, fusion.

A query is rows (qid, term, w); w is the number of times a token stands in the query, or
any weight. Every lexical scorer is one plan: query terms meet the postings, and the
weighted term scores are summed by (qid, ord).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import text as tx
from lexloom.operators.index import Index, lucene_idf, stored
from lexloom.operators.scan import Scorer, dense, scan

#: Rows of query terms up to which that side is broadcast; beyond, the planner shuffles.
SMALL_SIDE = 100_000

#: Documents whose ranks are counted one by one, over all queries; beyond, every hit is shuffled.
CHOSEN = 1 << 20

#: Queries up to which a text is scored where it is read.
SCANNED = 4096


def query_terms(queries: DataFrame, tokenizer=tx.whitespace_tokens) -> DataFrame:
    """(qid, term, w) of (qid, query): w counts repeats of a token."""
    tokens = queries.select("qid", F.explode(tokenizer(F.col("query"))).alias("term"))
    return tokens.groupBy("qid", "term").agg(F.count("*").cast("double").alias("w"))


def fits(df: DataFrame, bound: int = SMALL_SIDE) -> bool:
    """Whether ``df``, a table of queries or what they ask for, has at most ``bound`` rows."""
    return df.limit(bound + 1).count() <= bound


def small(df: DataFrame, bound: int = SMALL_SIDE) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``bound`` rows, else as it is."""
    return F.broadcast(df) if fits(df, bound) else df


def scannable(index: Index, terms: DataFrame) -> bool:
    """Whether the texts are read anyway and what is asked fits into every task."""
    return not index.kept and fits(terms) and fits(terms.select("qid").distinct(), SCANNED)


def matched(index: Index, terms: DataFrame, hint=lambda df: df) -> DataFrame:
    """(ord, term, tf, dl) of the terms that the queries ask for, and no others.

    Words are filtered before any exchange; a stored index is read from its postings.
    """
    wanted = hint(terms.select("term").distinct())
    if index.kept:
        return index.postings.join(wanted, "term", "left_semi").join(index.lengths, "ord")
    words = index.tokens.select("ord", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
    return words.join(wanted, "term", "left_semi").groupBy("ord", "term", "dl").agg(F.count("*").alias("tf"))


def _scored(index: Index, terms: DataFrame, share, gain, more: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """Sums of ``w * share(df, n) * gain(tf, length ratio)``; ``more`` is a row of further statistics.

    ``first`` may leave out documents that are not among a query's so many best.
    """
    if scannable(index, terms):
        return scan(index, [Scorer(terms, share, gain, more)], first)
    found = matched(index, terms)
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    hit = found.join(terms, "term").join(df, "term").crossJoin(F.broadcast(index.stats))
    if more is not None:
        hit = hit.crossJoin(F.broadcast(more))
    ratio = F.when(F.col("avgdl") > 0, F.col("dl") / F.col("avgdl")).otherwise(1.0)
    return hit.groupBy("qid", "ord").agg(F.sum(F.col("w") * share(F.col("df"), F.col("n")) * gain(F.col("tf"), ratio)).alias("score"))


def saturated(k1: float, b: float):
    """The gain of a term by its count and the document's length, for Columns and arrays."""
    return lambda tf, r: tf * (k1 + 1) / (tf + k1 * (1 - b + b * r))


def lucene(terms: DataFrame, k1: float = 1.2, b: float = 0.75) -> Scorer:
    return Scorer(terms, lambda df, n: lucene_idf(n, df), saturated(k1, b))


def bm25_lucene(index: Index, terms: DataFrame, k1: float = 1.2, b: float = 0.75, first: int | None = None) -> DataFrame:
    """(qid, ord, score); the weighted general form, as ``w`` may be any number."""
    own = lucene(terms, k1, b)
    return _scored(index, terms, own.share, own.gain, first=first)


def bm25_okapi(index: Index, terms: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, first: int | None = None) -> DataFrame:
    """Okapi; negative idf is replaced by ``epsilon`` times the mean idf of all terms."""
    raw = lambda n, df: F.log((n - df + 0.5) / (df + 0.5))
    # The mean over all terms needs how many terms have each document frequency, no more.
    mean = index.terms.select("df").crossJoin(F.broadcast(index.stats.select("n"))).agg(F.avg(raw(F.col("n"), F.col("df"))).alias("mean"))
    share = lambda df, n: F.when(raw(n, df) < 0, epsilon * F.col("mean")).otherwise(raw(n, df))
    return _scored(index, terms, share, saturated(k1, b), mean, first)


def bm25_plus(index: Index, terms: DataFrame, k1: float = 1.5, b: float = 0.75, delta: float = 1.0, first: int | None = None) -> DataFrame:
    """BM25+ (Lv and Zhai 2011), for matching documents."""
    gain = saturated(k1, b)
    return _scored(index, terms, lambda df, n: F.log((n + 1) / df), lambda tf, r: delta + gain(tf, r), first=first)


def bm25_l(index: Index, terms: DataFrame, k1: float = 1.5, b: float = 0.75, delta: float = 0.5, first: int | None = None) -> DataFrame:
    """BM25L (Lv and Zhai 2011)."""

    def gain(tf, r):
        c = tf / (1 - b + b * r)
        return (k1 + 1) * (c + delta) / (k1 + c + delta)

    return _scored(index, terms, lambda df, n: F.log((n + 1) / (df + 0.5)), gain, first=first)


def sparse_dot(query_weights: DataFrame, doc_weights: DataFrame) -> DataFrame:
    """(qid, ord, score) of (qid, term, w) and (ord, term, w): learned sparse vectors."""
    return doc_weights.withColumnRenamed("w", "dw").join(small(query_weights), "term").groupBy("qid", "ord").agg(F.sum(F.col("w") * F.col("dw")).alias("score"))


def top_k(scored: DataFrame, k: int, by: str = "score", digits: int = 9) -> DataFrame:
    """The k best per query with ``rank`` from 1; equal (rounded) scores by ``ord``."""
    place = Window.partitionBy("qid").orderBy(F.desc(F.round(by, digits)), "ord")
    return scored.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def pad(scored: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Scores of all documents for a stated set of queries, zero where nothing matches."""
    every = chunks.select("ord").crossJoin(small(queries.select("qid")))
    return every.join(scored, ["qid", "ord"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def with_text(hits: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """Ids and texts, joined last so that no text is carried through scoring.

    ``most`` bounds the rows of ``hits`` (k times the queries): up to ``SMALL_SIDE`` they are
    broadcast to the texts, beyond that the planner shuffles.
    """
    return chunks.join(F.broadcast(hits) if most <= SMALL_SIDE else hits, "ord")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_cosine(queries: DataFrame, vectors: DataFrame, first: int | None = None) -> DataFrame:
    """(qid, ord, score) of (qid, vec) and (ord, vec): every query against every row.

    Zero norms count as 1e-10. The queries are the stated set, broadcast only if small.
    ``first`` may leave out rows that are not among a query's so many best; plain vectors of
    one length are then compared in arrays, others as without it.
    """
    dims = queries.agg(F.max(F.size("vec"))).first()[0] if first and fits(queries) else None
    if dims and dims > 0:
        odd = F.col("vec").isNull() | (F.size("vec") != dims) | F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        plain = lambda df: df.filter(~F.coalesce(odd, F.lit(True)))
        rest = lambda df: df.filter(F.coalesce(odd, F.lit(True)))
        found = dense(plain(queries), plain(vectors), first, dims)
        return found.unionByName(dense_cosine(plain(queries), rest(vectors))).unionByName(dense_cosine(rest(queries), vectors))
    unit = lambda df, key: df.select(key, F.col("vec").alias(f"{key}_vec"), F.greatest(norm(F.col("vec")), F.lit(1e-10)).alias(f"{key}_norm"))
    pairs = unit(vectors, "ord").crossJoin(small(unit(queries, "qid"), 10_000))
    return pairs.select("qid", "ord", (dot(F.col("qid_vec"), F.col("ord_vec")) / (F.col("qid_norm") * F.col("ord_norm"))).alias("score"))


def places(chunks: DataFrame) -> DataFrame:
    """(ord, place): each document's number in the order of ``ord``, from 0."""
    parts = stored(chunks.select("ord").repartitionByRange("ord").sortWithinPartitions("ord").select("ord", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")))
    first = parts.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.select("part", "first", before.alias("before"))  # a row for each partition
    return parts.join(F.broadcast(first), "part").select("ord", (F.col("id") - F.col("first") + F.col("before")).alias("place"))


def rrf(first: DataFrame, second: DataFrame, chunks: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion over the documents that either list hits.

    Both lists rank every document: those without a hit follow the last one, by ``ord``.
    """

    named = lambda df, name: df.select("qid", "ord", F.round("score", 9).alias(name))
    return fuse(named(first, "score0").join(named(second, "score1"), ["qid", "ord"], "full"), chunks, k)


def fuse(both: DataFrame, chunks: DataFrame, k: int = 60) -> DataFrame:
    """``rrf`` of (qid, ord, score0, score1), at nine decimals and null without a hit."""
    both = both.join(places(chunks), "ord")
    each = Window.partitionBy("qid")
    below = each.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    ranked = both
    for i in (0, 1):  # of the documents before this one, those without a hit are ranked before it
        score = f"score{i}"
        own = F.row_number().over(each.orderBy(F.desc_nulls_last(score), "ord"))
        rest = F.count(score).over(each) + 1 + F.col("place") - F.count(score).over(below)
        ranked = ranked.withColumn(f"own{i}", own).withColumn(f"rest{i}", rest).withColumn(f"r{i + 1}", F.when(F.col(score).isNotNull(), F.col(f"own{i}")).otherwise(F.col(f"rest{i}")))
    both = ranked.select("qid", "ord", "r1", "r2")
    return both.withColumn("score", 1 / (k + F.col("r1")) + 1 / (k + F.col("r2")))


def fuse_first(index: Index, scorers: list[Scorer], chunks: DataFrame, first: int, k: int = 60) -> DataFrame:
    """``rrf`` of two scorers, without documents that cannot be among a query's ``first`` best.

    If either list has ``first`` hits, its best of these score more than 1 / (k + first) each;
    a document that both lists rank below k + 2 * first scores less. One without a hit in a list ranks
    there no better than its place among all documents. So the so many best of each list
    and the so many smallest ``ord`` suffice; their ranks are counted over all hits.
    """
    most = k + 2 * first
    if index.kept or not fits(scorers[0].terms.select("qid").unionByName(scorers[1].terms.select("qid")).distinct(), CHOSEN // (3 * most)):
        return fuse(scan(index, scorers), chunks, k)
    found = scan(index, scorers, most, ranked=True).join(places(chunks), "ord")
    for j in (0, 1):
        rank = F.when(F.col(f"score{j}").isNotNull(), F.col(f"before{j}") + 1).otherwise(F.col(f"hits{j}") + 1 + F.col("place") - F.col(f"earlier{j}"))
        found = found.withColumn(f"r{j + 1}", rank)
    return found.select("qid", "ord", "r1", "r2", (1 / (k + F.col("r1")) + 1 / (k + F.col("r2"))).alias("score"))


def max_fusion(*variants: DataFrame) -> DataFrame:
    """The larger score of a document over variants of a query."""
    out = variants[0]
    for v in variants[1:]:
        out = out.unionByName(v)
    return out.groupBy("qid", "ord").agg(F.max("score").alias("score"))


def force_in(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ranked hits, then the (qid, ord) of ``wanted`` that are missing, ranks continuing."""
    missing = wanted.select("qid", "ord").distinct().join(ranked, ["qid", "ord"], "left_anti")
    last = ranked.groupBy("qid").agg(F.max("rank").alias("last"))
    order = Window.partitionBy("qid").orderBy("ord")
    extra = missing.join(last, "qid", "left").select("qid", "ord", (F.coalesce("last", F.lit(0)) + F.row_number().over(order)).alias("rank"), F.lit(True).alias("forced"))
    return ranked.select("qid", "ord", "rank", F.lit(False).alias("forced")).unionByName(extra)
