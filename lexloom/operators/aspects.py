"""Aspect expanders of the earlier kind: keyphrases of a query, weighted and enriched.

Keyphrases come from ``keyphrases``, a plain statistical scorer that stands in for a third
party's: it is not equal to it. Encoders and language models are injected. Results are flat:
a row per aspect, or per keyword of an aspect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import text as tx
from lexloom.operators import scoring as sc
from lexloom.operators.expansion import fold_distinct, prf_terms
from lexloom.operators.index import Index, idf_summary
from lexloom.operators.rerank import ask
from lexloom.operators.scoring import dot, norm
from lexloom.operators.vocabulary import frequent, hash_vector


def keyphrases(query: Column, n: int = 3, top: int = 20, stopwords=tx.STOPWORDS) -> Column:
    """Up to ``top`` runs of one to ``n`` words, stopwords left out, best first.

    A word scores its count over the place of its first occurrence, a phrase the sum; ties
    go to the earlier, then the shorter phrase.
    """
    words = F.filter(tx.word_tokens(query), lambda w: ~w.isin(list(stopwords)))

    def scored(w):
        value = F.transform(w, lambda x: F.size(F.filter(w, lambda y: y == x)) / F.array_position(w, x))

        def runs(v):
            def of(k):
                starts = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - k + 1)).otherwise(F.array().cast("array<int>"))
                total = lambda i: F.aggregate(F.slice(v, i, F.lit(k)), F.lit(0.0), lambda a, x: a + x)
                return F.transform(starts, lambda i: F.struct((-F.round(total(i), 9)).alias("s"), i.alias("i"), F.lit(k).alias("k"), F.array_join(F.slice(w, i, F.lit(k)), " ").alias("p")))

            out = [of(k) for k in range(1, n + 1)]
            return F.array_distinct(F.transform(F.sort_array(F.concat(*out)), lambda x: x.p))

        return tx.bind(value, runs)

    return F.slice(tx.bind(words, scored), 1, top)


def by_length(phrases: Column) -> Column:
    """Longest first; the order stays among equals."""
    return F.transform(F.sort_array(F.transform(phrases, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p")))), lambda x: x.p)


def unsubsumed(phrases: Column, whole_words: bool = False) -> Column:
    """Phrases, longest first, that are no part of one kept before."""
    inside = (lambda k, x: F.contains(F.concat(F.lit(" "), k, F.lit(" ")), F.concat(F.lit(" "), x, F.lit(" ")))) if whole_words else F.contains
    return fold_distinct(by_length(phrases), inside)


def clustered(phrases: Column, encode=hash_vector, limit: float = 0.85) -> Column:
    """The first (longest) phrase of each greedy cluster: a phrase joins the first seed that it
    resembles by more than ``limit``."""
    seeds = F.transform(phrases, lambda p: F.struct(p.alias("p"), encode(p).alias("v")))
    close = lambda k, x: dot(k.v, x.v) > limit * F.greatest(norm(k.v) * norm(x.v), F.lit(1e-10))
    return F.transform(fold_distinct(seeds, close), lambda s: s.p)


def orthogonal(queries: DataFrame, encode=hash_vector) -> DataFrame:
    """(qid, query, aspect, name): keyphrases without parts and near doubles; else the query."""
    own = clustered(unsubsumed(keyphrases(F.col("query"))), encode)
    names = F.when(F.size(own) > 0, own).when(F.trim("query") != "", F.array(F.col("query"))).otherwise(F.array().cast("array<string>"))
    return queries.select("qid", "query", F.posexplode(names).alias("aspect", "name"))


def mean_idf(names: DataFrame, terms: DataFrame, unknown: float) -> DataFrame:
    """(*names, idf): mean idf of the words of ``name``, ``unknown`` for those the index lacks."""
    words = names.select("name").distinct().select("name", F.posexplode(tx.plain_tokens(F.col("name"))).alias("i", "term"))
    per = words.join(terms.select("term", "idf"), "term", "left").groupBy("name").agg(F.avg(F.coalesce("idf", F.lit(unknown))).alias("idf"))
    return names.join(per, "name", "left")


def statistical(queries: DataFrame, index: Index, encode=hash_vector, k: int = 5) -> DataFrame:
    """(qid, aspect, name, weight, place, term, keyword_weight): aspects with feedback terms.

    Feedback is taken from the three best documents of each aspect; the weight is the mean
    idf (0.1 for unknown words) over the largest, and the ``k`` heaviest aspects stay.
    """
    rows = orthogonal(queries, encode)
    top = F.broadcast(idf_summary(index.terms).select("max_idf"))
    rows = mean_idf(rows, index.terms, 0.1).crossJoin(top)
    rows = rows.withColumn("weight", F.bround(F.col("idf") / F.col("max_idf"), 2))
    order = Window.partitionBy("qid").orderBy(F.desc("weight"), "aspect")
    rows = rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k).select("qid", "aspect", "name", "weight")
    asked = rows.select(F.struct("qid", "aspect").alias("qid"), F.explode(F.split("name", " ")).alias("term"))
    asked = asked.groupBy("qid", "term").agg(F.count("*").cast("double").alias("w"))
    hits = sc.top_k(sc.bm25_okapi(index, asked, first=3).filter("score > 0"), 3)
    more = prf_terms(hits, index, asked.select("qid", "term"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("tf"), "term"))
    more = more.select("qid.qid", "qid.aspect", place.alias("place"), "term", F.col("weight").alias("keyword_weight"))
    own = rows.select("qid", "aspect", F.lit(0).alias("place"), F.col("name").alias("term"), F.lit(1.0).alias("keyword_weight"))
    return rows.join(own.unionByName(more), ["qid", "aspect"])


def vector(queries: DataFrame, vocabulary: DataFrame, encode=hash_vector, k: int = 5, near: int = 3) -> DataFrame:
    """(qid, aspect, name, weight, place, term, keyword_weight): aspects with near vocabulary.

    ``vocabulary`` (term, vec) is a table of bounded size. An aspect's weight is the cosine of
    the query and the aspect with its keywords; the ``k`` heaviest stay.
    """
    rows = orthogonal(queries, encode).withColumn("avec", encode(F.col("name")))
    cos = lambda a, b: dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-10))
    pairs = rows.crossJoin(F.broadcast(vocabulary.select("term", "vec"))).withColumn("sim", cos(F.col("avec"), F.col("vec")))
    order = Window.partitionBy("qid", "aspect").orderBy(F.desc(F.round("sim", 9)), "term")
    best = pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= near)
    best = best.filter("term <> name").select("qid", "aspect", "place", "term", F.bround("sim", 2).alias("keyword_weight"))
    own = rows.select("qid", "aspect", F.lit(0).alias("place"), F.col("name").alias("term"), F.lit(1.0).alias("keyword_weight"))
    keywords = own.unionByName(best)
    enriched = keywords.groupBy("qid", "aspect").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda x: x.term), " ").alias("all"))
    weighed = rows.join(enriched, ["qid", "aspect"]).withColumn("weight", F.bround(cos(encode(F.col("query")), encode(F.col("all"))), 2))
    heaviest = Window.partitionBy("qid").orderBy(F.desc("weight"), "aspect")
    kept = weighed.withColumn("at", F.row_number().over(heaviest)).filter(F.col("at") <= k).select("qid", "aspect", "name", "weight")
    return kept.join(keywords, ["qid", "aspect"])


def _scaled(rows: DataFrame) -> DataFrame:
    """(qid, place, name, weight): raw weights brought to 0.1..1, the largest exactly 1."""
    w = Window.partitionBy("qid")
    low, high = F.min("raw").over(w), F.max("raw").over(w)
    value = F.when((high == low) | (F.col("raw") == high), 1.0).otherwise(F.greatest(F.lit(0.1), (F.col("raw") - low) / (high - low)))
    order = Window.partitionBy("qid").orderBy(F.desc("weight"), F.desc(F.length("name")), "name")
    return rows.withColumn("weight", tx.round_binary(value)).select("qid", F.row_number().over(order).alias("place"), "name", "weight")


def _names(queries: DataFrame) -> DataFrame:
    acronyms = F.array_distinct(F.transform(F.regexp_extract_all("query", F.lit(r"(?U)\b[A-Z]{2,}\b"), F.lit(0)), F.lower))
    both = F.array_distinct(F.concat(acronyms, keyphrases(tx.without_stopwords(F.col("query")), top=10)))
    return queries.select("qid", "query", F.explode(unsubsumed(both, whole_words=True)).alias("name"))


def aspects_by_idf(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, place, name, weight): acronyms and keyphrases by mean idf, 5.0 for unknown words."""
    return _scaled(mean_idf(_names(queries), terms, 5.0).withColumnRenamed("idf", "raw"))


def aspects_by_vector(queries: DataFrame, encode=hash_vector) -> DataFrame:
    """(qid, place, name, weight): acronyms and keyphrases by their cosine to the query."""
    q, a = encode(F.col("query")), encode(F.col("name"))
    cos = tx.bind(F.struct(q.alias("q"), a.alias("a")), lambda x: dot(x.q, x.a) / F.greatest(norm(x.q) * norm(x.a), F.lit(1e-10)))
    return _scaled(_names(queries).withColumn("raw", F.round(cos, 12)))


def combined_vocabulary(chunks: DataFrame, phrases: DataFrame, limit: int = 5000) -> DataFrame:
    """(term): ``phrases`` (term, score) best first, then the most frequent words, up to ``limit``."""
    words = frequent(chunks, limit).filter(~F.contains("term", F.lit(" "))).select("term", F.lit(1).alias("kind"), (-F.col("count")).cast("double").alias("key"))
    both = phrases.select("term", F.lit(0).alias("kind"), (-F.col("score")).cast("double").alias("key")).unionByName(words)
    return both.groupBy("term").agg(F.min(F.struct("kind", "key")).alias("k")).orderBy("k", "term").limit(limit).select("term")


def dense_aspects(queries: DataFrame, vocabulary: DataFrame, encode=hash_vector, terms: DataFrame | None = None, k: int = 10, entities=tx.wide_entities) -> DataFrame:
    """(qid, place, name, weight): ``entities`` at 1.0, then the vocabulary's terms by cosine.

    ``vocabulary`` (term) is of bounded size. With ``terms`` (term, idf), a cosine is scaled by
    0.5 + 0.5 * mean idf / max idf, unknown words counting 1.0.
    """
    vocab = vocabulary.select(F.col("term").alias("name")).distinct()
    if terms is not None:
        top = F.broadcast(idf_summary(terms).select(F.when(F.col("max_idf") > 0, F.col("max_idf")).otherwise(1.0).alias("max_idf")))
        vocab = mean_idf(vocab, terms, 1.0).crossJoin(top).select("name", (0.5 + 0.5 * F.col("idf") / F.col("max_idf")).alias("factor"))
    else:
        vocab = vocab.withColumn("factor", F.lit(1.0))
    q = queries.select("qid", encode(tx.without_stopwords(F.col("query"))).alias("qvec"))
    scored = q.crossJoin(F.broadcast(vocab.withColumn("vec", encode(F.col("name"))))).withColumn("sim", dot(F.col("qvec"), F.col("vec")) * F.col("factor"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("sim", 9)), "name")
    near = scored.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k).select("qid", F.lit(1).alias("lane"), "at", "name", tx.round_half(F.col("sim"), 4).alias("weight"))
    named = queries.select("qid", F.posexplode(entities(F.col("query"))).alias("at", "name")).select("qid", F.lit(0).alias("lane"), "at", "name", F.lit(1.0).alias("weight"))
    both = named.unionByName(near.join(named.select("qid", "name"), ["qid", "name"], "left_anti").select(named.columns))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("lane", "at"))
    return both.select("qid", place.alias("place"), "name", "weight").filter(F.col("place") <= k)


def modelled(queries: DataFrame, prompt: Column, model: Callable[[str], str]) -> DataFrame:
    """(qid, aspect, name, weight, keywords) that a model answers as JSON; an unreadable answer raises."""
    schema = "struct<aspects:array<struct<name:string,aspect_weight:double,keywords:array<struct<term:string,weight:double>>>>>"
    told = ask(queries, prompt, model).withColumn("a", F.from_json(tx.json_object(F.col("answer")), schema))
    sure = F.when(F.col("a.aspects").isNotNull(), F.col("a.aspects")).otherwise(F.raise_error(F.concat(F.lit("unreadable expansion: "), F.coalesce("answer", F.lit("none")))))
    return told.select("qid", F.posexplode(sure).alias("aspect", "x")).select("qid", "aspect", "x.name", F.col("x.aspect_weight").alias("weight"), "x.keywords")


def modelled_aspects(queries: DataFrame, prompt: Column, model: Callable[[str], str]) -> DataFrame:
    """(qid, place, name, weight) that a model answers; the query itself at 1.0 where it cannot be read."""
    told = ask(queries, prompt, model).withColumn("a", F.from_json(tx.json_part(F.col("answer")), "array<struct<name:string,weight:double>>"))
    own = F.array(F.struct(F.col("query").alias("name"), F.lit(1.0).alias("weight")))
    return told.select("qid", F.posexplode(F.when(F.size("a") > 0, F.col("a")).otherwise(own)).alias("place", "x")).select("qid", "place", "x.name", "x.weight")
