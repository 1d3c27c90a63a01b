"""Query expansion: anchors, candidates by dual similarity, weights and repetitions.

Works on a batch of queries (qid, query). Keywords come out flat, one row each:
(qid, aspect, anchor, is_entity, place, term, weight, reps); place 0 is the anchor.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import text as tx
from lexloom.operators.index import idf_summary, normalised_idf, term_idf
from lexloom.operators.scoring import dot
from lexloom.operators.vocabulary import hash_vector


@dataclass(frozen=True)
class Settings:
    """Share of words, candidates, similarity gate and mix, capacity shift, repetitions.

    ``entities`` tells whether ``anchors`` takes a query's entities before its words.
    """

    p: float = 0.5
    candidates: int = 2
    tau: float = 0.55
    beta: float = 0.65
    shift: int = -1
    r_min: int = 2
    r_max: int = 4
    reps: int = 3
    entity_idf: float = 2.0
    entities: bool = True


#: Names under which the schemas are asked for.
SCHEMAS = {
    "BM25Dense_AspectInject": "1", "BM25Dense_AspectWeighted": "2", "BM25Dense_LocalCascade": "3", "BM25Dense_AspectFusion": "4",
    "BM25Dense_FixedRepDynamicCapacity": "5a", "pipeline_v2_v5a": "5a", "v5a": "5a", "BM25Dense_DynamicAspectInject": "5b", "pipeline_v2_dynamic": "5b", "v5b": "5b",
    "BM25Dense_CentralityFixedRep": "6a", "pipeline_v2_v6a": "6a", "v6a": "6a", "BM25Dense_CentralityDynamicInject": "6b", "pipeline_v2_v6b": "6b", "v6b": "6b",
}


def anchors(queries: DataFrame, terms: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(qid, aspect, anchor, is_entity, idf): entities, then the rarest other words.

    The number of words is max(2, ceil(p * all distinct query words, entities included)).
    Without ``s.entities`` all words compete and no entity is taken.
    """
    others = (tx.non_entity_words if s.entities else tx.query_words)(F.col("query"))
    q = queries.select("qid", tx.entities(F.col("query")).alias("entities"), others.alias("others"), F.size(tx.query_words(F.col("query"))).alias("n"))
    words = q.select("qid", "n", F.posexplode("others").alias("pos", "anchor"))
    words = words.join(term_idf(words.select("anchor").distinct(), terms, "anchor"), "anchor")
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("idf", 9)), "pos")
    words = words.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= F.greatest(F.lit(2), F.ceil(s.p * F.col("n"))))
    if not s.entities:
        return words.select("qid", (F.col("at") - 1).alias("aspect"), "anchor", F.lit(False).alias("is_entity"), "idf")
    named = q.select("qid", F.posexplode("entities").alias("pos", "anchor"))
    named = named.join(term_idf(named.select("anchor").distinct(), terms, "anchor"), "anchor")
    both = named.select("qid", F.lit(0).alias("kind"), "pos", "anchor", F.lit(True).alias("is_entity"), "idf")
    both = both.unionByName(words.select("qid", F.lit(1).alias("kind"), F.col("at").alias("pos"), "anchor", F.lit(False).alias("is_entity"), "idf"))
    return both.select("qid", (F.row_number().over(Window.partitionBy("qid").orderBy("kind", "pos")) - 1).alias("aspect"), "anchor", "is_entity", "idf")


def fold_distinct(items: Column, same) -> Column:
    """Items of an ordered array that are not ``same`` as any item kept before."""
    empty = F.slice(items, 1, 0)
    return F.aggregate(items, empty, lambda kept, x: F.when(F.exists(kept, lambda k: same(k, x)), kept).otherwise(F.array_append(kept, x)))


def stem_related(a: Column, b: Column) -> Column:
    """One word begins the other and the shorter has four letters or more."""
    a, b = F.lower(a), F.lower(b)
    return (F.startswith(a, b) | F.startswith(b, a)) & (F.least(F.length(a), F.length(b)) >= 4)


def central_anchors(queries: DataFrame, terms: DataFrame, encode=hash_vector, s: Settings = Settings()) -> DataFrame:
    """Anchors by idf * max(0.1, cosine to the query), without stem and semantic doubles.

    Entities need an idf of at least ``entity_idf``; the others join the pool of words.
    """
    q = queries.select("qid", "query", tx.entities(F.col("query")).alias("entities"), tx.non_entity_words(F.col("query")).alias("others"))
    named = q.select("qid", F.posexplode("entities").alias("pos", "anchor"))
    named = named.join(term_idf(named.select("anchor").distinct(), terms, "anchor"), "anchor")
    valid = named.filter(F.col("idf") >= s.entity_idf)
    weak = named.filter(F.col("idf") < s.entity_idf).select("qid", (F.col("pos") + 100_000).alias("pos"), "anchor")
    words = q.select("qid", F.posexplode("others").alias("pos", "anchor"))
    pool = words.unionByName(weak).groupBy("qid", "anchor").agg(F.min("pos").alias("pos"))
    pool = pool.join(valid.select("qid", "anchor"), ["qid", "anchor"], "left_anti")
    pool = pool.join(term_idf(pool.select("anchor").distinct(), terms, "anchor"), "anchor").withColumn("vec", encode(F.col("anchor")))
    pool = pool.join(queries.select("qid", encode(F.col("query")).alias("qvec")), "qid")
    pool = pool.withColumn("score", F.col("idf") * F.greatest(F.lit(0.1), dot(F.col("vec"), F.col("qvec"))))
    item = F.struct((-F.round("score", 9)).alias("order"), "pos", "anchor", "idf", "vec")
    lists = pool.groupBy("qid").agg(F.sort_array(F.collect_list(item)).alias("items"), F.count("*").alias("n"))
    kept = fold_distinct(F.col("items"), lambda k, x: stem_related(k.anchor, x.anchor) | (dot(k.vec, x.vec) >= 0.9))
    kept = lists.select("qid", F.posexplode(F.slice(kept, 1, F.greatest(F.lit(2), F.ceil(s.p * F.col("n"))).cast("int"))).alias("pos", "k"))
    both = valid.select("qid", F.lit(0).alias("kind"), "pos", "anchor", F.lit(True).alias("is_entity"), "idf")
    both = both.unionByName(kept.select("qid", F.lit(1).alias("kind"), "pos", "k.anchor", F.lit(False).alias("is_entity"), "k.idf"))
    return both.select("qid", (F.row_number().over(Window.partitionBy("qid").orderBy("kind", "pos")) - 1).alias("aspect"), "anchor", "is_entity", "idf")


def candidates(chosen: DataFrame, queries: DataFrame, vocabulary: DataFrame, encode=hash_vector, s: Settings = Settings()) -> DataFrame:
    """(qid, aspect, rank, term, term_idf, sim): vocabulary terms at least ``tau`` similar.

    sim = beta * cos(anchor, term) + (1 - beta) * cos(query, term). The vocabulary
    (rank, term, idf) has a stated limit and is the broadcast side; one with ``qid`` holds
    each query's own terms.
    """
    own = "qid" in vocabulary.columns
    vocab = vocabulary.select(*["qid"] * own, "rank", "term", F.col("idf").alias("term_idf"), encode(F.col("term")).alias("vvec"))
    q = queries.select("qid", encode(F.col("query")).alias("qvec"))
    a = chosen.select("qid", "aspect", "anchor", encode(F.col("anchor")).alias("avec"))
    pairs = q.join(vocab, "qid") if own else q.crossJoin(F.broadcast(vocab))
    by_query = pairs.select("qid", "rank", "term", "term_idf", "vvec", dot(F.col("qvec"), F.col("vvec")).alias("q_sim"))
    both = a.join(by_query, "qid").withColumn("sim", s.beta * dot(F.col("avec"), F.col("vvec")) + (1 - s.beta) * F.col("q_sim"))
    gate = (F.round("sim", 9) >= s.tau) & (F.lower("term") != F.lower("anchor"))
    return both.filter(gate).select("qid", "aspect", "rank", "term", "term_idf", "sim")


def _keywords(chosen: DataFrame, found: DataFrame, weight: Column, cap: Column) -> DataFrame:
    """Anchors (with ``anchor_weight``, ``anchor_reps``) and their best candidates."""
    cols = ["qid", "aspect", "anchor", "is_entity", "idf", "anchor_weight", "anchor_reps", "cap"]
    rows = found.join(chosen.withColumn("cap", cap).select(*cols, "max_idf", "max_query_idf"), ["qid", "aspect"]).withColumn("weight", weight)
    place = F.row_number().over(Window.partitionBy("qid", "aspect").orderBy(F.desc(F.round("weight", 9)), "rank"))
    best = rows.withColumn("place", place).filter(F.col("place") <= F.col("cap"))
    own = chosen.select("qid", "aspect", "anchor", "is_entity", F.lit(0).alias("place"), F.col("anchor").alias("term"), F.col("anchor_weight").alias("weight"), F.col("anchor_reps").alias("reps"))
    return own.unionByName(best.select("qid", "aspect", "anchor", "is_entity", "place", "term", "weight", F.lit(1).alias("reps")))


def reps_of_weight(weight: Column) -> Column:
    return F.when(weight >= 0.99, 3).when(weight >= 0.7, 2).otherwise(1)


def tier(idf: Column, is_entity: Column, max_query_idf: Column, s: Settings) -> Column:
    """Repetitions by rarity: r_max for entities, else r_min..r_max, halves rounded to even."""
    scaled = s.r_min + (s.r_max - s.r_min) * idf / max_query_idf
    return F.when(is_entity, s.r_max).otherwise(F.least(F.lit(s.r_max), F.greatest(F.lit(s.r_min), F.bround(F.round(scaled, 9), 0).cast("int"))))


def expand(queries: DataFrame, terms: DataFrame, vocabulary: DataFrame, schema: str = "1", encode=hash_vector, s: Settings = Settings()) -> DataFrame:
    """Keywords of every query under a schema; unknown names fall back to schema 1."""
    schema = SCHEMAS.get(schema, schema)
    if schema == "4":
        return fused(queries, terms, vocabulary, encode, s)
    chosen = central_anchors(queries, terms, encode, s) if schema in ("6a", "6b") else anchors(queries, terms, s)
    top = F.broadcast(idf_summary(terms).select(F.when(F.col("max_idf") > 0, F.col("max_idf")).otherwise(1.0).alias("max_idf")))
    chosen = chosen.crossJoin(top).withColumn("most", F.max("idf").over(Window.partitionBy("qid")))
    chosen = chosen.withColumn("max_query_idf", F.when(F.col("most") > 0, F.col("most")).otherwise(F.col("max_idf"))).drop("most")
    found = candidates(chosen, queries, vocabulary, encode, s)
    weight = F.least(F.lit(0.95), F.col("sim") * (0.5 + 0.5 * F.col("term_idf") / F.col("max_idf")))
    rank = tier(F.col("idf"), F.col("is_entity"), F.col("max_query_idf"), s)
    floor = 0 if schema in ("6a", "6b") else 1
    reps, value, cap = F.lit(s.reps), F.lit(1.0), F.least(F.lit(5), F.greatest(F.lit(floor), rank + s.shift))
    if schema == "2":
        value = F.least(F.lit(1.0), F.greatest(F.lit(0.5), F.col("idf") / F.col("max_query_idf")))
        reps, cap = reps_of_weight(value), F.lit(s.candidates)
        weight = F.least(F.lit(0.9), 0.5 * F.col("sim") * F.col("anchor_weight"))
    elif schema in ("5b", "6b"):
        reps = rank
    elif schema not in ("5a", "6a"):
        cap = F.lit(s.candidates)
    chosen = chosen.withColumn("anchor_weight", value).withColumn("anchor_reps", reps.cast("int"))
    return _keywords(chosen, found, weight, cap)


def _clusters(pdf):
    """Average-linkage clusters of one query's anchors at cosine distance below 0.35."""
    import numpy as np

    pdf = pdf.sort_values("aspect")
    v = np.array(pdf["vec"].tolist(), float)
    d = 1 - v @ v.T / np.maximum(np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None], 1e-12)
    groups = [[i] for i in range(len(v))]
    while len(groups) > 1:
        pairs = [(d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        best = min(pairs)
        if best[0] >= 0.35:
            break
        groups[best[1]] += groups.pop(best[2])
    label = {i: min(g) for g in groups for i in g}
    return pdf.assign(cluster=[int(label[i]) for i in range(len(v))])[["qid", "aspect", "anchor", "cluster"]]


def fused(queries: DataFrame, terms: DataFrame, vocabulary: DataFrame, encode=hash_vector, s: Settings = Settings()) -> DataFrame:
    """Anchors in clusters, candidates by 0.65 idf + 0.35 mean similarity.

    ``aspect`` is the first anchor's number of a cluster, ``anchor`` its first two anchors.
    """
    qid = queries.schema["qid"].dataType.simpleString()
    chosen = anchors(queries, terms, s)
    labelled = chosen.withColumn("vec", encode(F.col("anchor"))).groupBy("qid").applyInPandas(_clusters, f"qid {qid}, aspect int, anchor string, cluster int")
    members = labelled.groupBy("qid", "cluster").agg(F.sort_array(F.collect_list(F.struct("aspect", "anchor"))).alias("m"))
    members = members.select("qid", F.col("cluster").alias("aspect"), F.transform("m", lambda x: x.anchor).alias("names"))
    wide = candidates(labelled, queries, vocabulary, encode, replace(s, tau=-2.0)).join(labelled.select("qid", "aspect", "cluster"), ["qid", "aspect"])
    n = labelled.groupBy("qid", "cluster").agg(F.count("*").alias("n"))
    mean = wide.groupBy("qid", "cluster", "rank", "term", "term_idf").agg(F.avg("sim").alias("sim"), F.count("*").alias("seen")).join(n, ["qid", "cluster"])
    top = F.broadcast(idf_summary(terms).select("max_idf"))
    mean = mean.filter((F.col("seen") == F.col("n")) & (F.round("sim", 9) >= s.tau)).crossJoin(top)  # a member itself is unseen once
    mean = mean.withColumn("weight", F.least(F.lit(0.95), 0.65 * normalised_idf(F.col("term_idf"), F.col("max_idf")) + 0.35 * F.col("sim")))
    order = Window.partitionBy("qid", "cluster").orderBy(F.desc(F.round("weight", 9)), "rank")
    best = mean.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= s.candidates).select("qid", F.col("cluster").alias("aspect"), (F.col("at") + 1000).alias("place"), "term", "weight")
    own = members.select("qid", "aspect", F.posexplode("names").alias("place", "term")).withColumn("weight", F.lit(1.0))
    name = members.select("qid", "aspect", F.array_join(F.slice("names", 1, 2), "_").alias("anchor"))
    rows = own.unionByName(best).join(name, ["qid", "aspect"])
    place = F.row_number().over(Window.partitionBy("qid", "aspect").orderBy("place")) - 1
    return rows.select("qid", "aspect", "anchor", F.lit(False).alias("is_entity"), place.alias("place"), "term", "weight", reps_of_weight(F.col("weight")).alias("reps"))


def augmented_terms(keywords: DataFrame) -> DataFrame:
    """(qid, term, w) for the scorers: every token as often as its keywords repeat it."""
    tokens = keywords.select("qid", "reps", F.explode(tx.whitespace_tokens(F.col("term"))).alias("token"))
    return tokens.groupBy("qid", F.col("token").alias("term")).agg(F.sum("reps").cast("double").alias("w"))


def augmented_list(keywords: DataFrame) -> DataFrame:
    """(qid, tokens): the augmented token list in order."""
    lists = keywords.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("aspect", "place", tx.repeated_tokens(F.col("term"), F.col("reps")).alias("t")))).alias("k"))
    return lists.select("qid", F.flatten(F.transform("k", lambda x: x.t)).alias("tokens"))


def telemetry(keywords: DataFrame) -> DataFrame:
    """Per query: anchors, injected terms, aspects without any, mean repetition, tokens."""
    own, tokens = F.col("place") == 0, F.size(tx.plain_tokens(F.col("term")))
    per = keywords.groupBy("qid", "aspect").agg(F.count_if(own).alias("a"), F.count_if(~own).alias("i"), F.sum(F.when(own, F.col("reps"))).alias("r"), F.sum(tokens * F.col("reps")).alias("t"))
    return per.groupBy("qid").agg(
        F.count("*").alias("num_anchors"), F.sum("i").alias("synonyms_injected"), F.count_if(F.col("i") == 0).alias("starved_aspects"), F.avg("r").alias("avg_r_anchor"), F.sum("t").alias("qaug_length")
    )


def traces(chosen: DataFrame, queries: DataFrame, vocabulary: DataFrame, keywords: DataFrame, encode=hash_vector, s: Settings = Settings(), most: int = 10) -> DataFrame:
    """Per aspect: its anchor, how many candidates reach ``tau``, the first ``most`` of them by
    similarity, and the terms that were injected."""
    found = candidates(chosen, queries, vocabulary, encode, s)
    order = Window.partitionBy("qid", "aspect").orderBy(F.desc(F.round("sim", 9)), "rank")
    best = found.withColumn("at", F.row_number().over(order))
    item = F.when(F.col("at") <= most, F.struct("at", "term", F.col("sim").alias("similarity"), F.col("term_idf").alias("idf")))
    per = best.groupBy("qid", "aspect").agg(F.count("*").alias("total_candidates_above_tau"), F.sort_array(F.collect_list(item)).alias("candidates_above_tau"))
    own = keywords.groupBy("qid", "aspect").agg(F.sort_array(F.collect_list(F.when(F.col("place") > 0, F.struct("place", "term")))).alias("i"), F.max(F.when(F.col("place") == 0, F.col("reps"))).alias("repetition"))
    rows = chosen.select("qid", "aspect", "anchor", "is_entity", "idf").join(per, ["qid", "aspect"], "left").join(own, ["qid", "aspect"], "left")
    return rows.select(
        "qid", "aspect", "anchor", "is_entity", "idf", "repetition", F.coalesce("total_candidates_above_tau", F.lit(0)).alias("total_candidates_above_tau"),
        "candidates_above_tau", F.transform("i", lambda x: x.term).alias("injected"),
    )


def within_budget(anchored: DataFrame, budget: int = 6) -> DataFrame:
    """(qid, aspect, saliency) with ``capacity``: by saliency, while a query's sum stays in the budget."""
    order = Window.partitionBy("qid").orderBy(F.desc("saliency"), "aspect")
    before = F.coalesce(F.sum(capacity(F.col("saliency"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return anchored.withColumn("capacity", F.greatest(F.lit(0), F.least(capacity(F.col("saliency")), budget - before)).cast("int"))


def capacity(saliency: Column) -> Column:
    """Capacity 0 to 3 by saliency."""
    return F.when(saliency >= 0.85, 3).when(saliency >= 0.6, 2).when(saliency >= 0.25, 1).otherwise(0)


def local_terms(queries: DataFrame, index, hits: DataFrame, idf_of, limit: int = 300, idf_floor: float = 1.5) -> DataFrame:
    """(qid, rank, term, count, idf, salience) for the local cascade, each query by itself.

    Global unigrams compete with the bigrams of the query's own first hits.
    """
    from lexloom.operators import vocabulary as vb

    uni = vb.unigrams(index).orderBy(F.desc("df"), "term").limit(2500).select("term", F.col("df").alias("count"))
    texts = index.chunks.select("ord", vb.neighbours(F.col("text")).alias("pairs")).join(hits.select("qid", "ord"), "ord")
    bi = texts.select("qid", F.explode("pairs").alias("term")).groupBy("qid", "term").agg(F.count("*").alias("count")).filter("count >= 2")
    order = Window.partitionBy("qid").orderBy(F.desc("count"), "term")
    bi = bi.withColumn("at", F.row_number().over(order)).filter("at <= 1000").drop("at")
    pool = queries.select("qid").crossJoin(F.broadcast(uni)).unionByName(bi)
    scored = pool.join(idf_of(pool), "term").filter(F.col("idf") >= idf_floor).withColumn("salience", F.col("idf") * F.log(1 + F.col("count")))
    place = Window.partitionBy("qid").orderBy(F.desc(F.round("salience", 9)), "term")
    return scored.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= limit)


def prf_terms(hits: DataFrame, index, known: DataFrame, top_docs: int = 3, most: int = 3) -> DataFrame:
    """(qid, term, tf, weight): frequent new tokens of the first documents, weight tf / max tf."""
    first = hits.filter(F.col("rank") <= top_docs).select("qid", "ord")
    if index.kept:
        tokens = first.join(index.postings, "ord")
    else:  # only the first documents' tokens are counted
        tokens = index.tokens.join(first, "ord").select("qid", "ord", F.explode("tokens").alias("term")).groupBy("qid", "ord", "term").agg(F.count("*").alias("tf"))
    tokens = tokens.filter(F.length("term") > 3)
    tokens = tokens.join(known, ["qid", "term"], "left_anti").groupBy("qid", "term").agg(F.sum("tf").alias("tf"))
    order = Window.partitionBy("qid").orderBy(F.desc("tf"), "term")
    best = tokens.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= most)
    return best.withColumn("weight", tx.round_binary(F.col("tf") / F.max("tf").over(Window.partitionBy("qid")))).drop("at")
