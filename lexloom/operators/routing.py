"""Triage of retrieved chunks: bypass, rerank or discard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cascade(hits: DataFrame, aspects: DataFrame, bypass: float = 0.75, discard: float = 0.15) -> DataFrame:
    """(qid, rank, ord, score, score_route, alpha, decision) of hits (qid, rank, ord, score, text).

    ``aspects`` is (qid, aspect, term); alpha is the share of aspects with a term in the
    text; the score, scaled by the query's best, is halved without any.
    """
    sets = aspects.groupBy("qid", "aspect").agg(F.collect_list(F.lower("term")).alias("terms")).groupBy("qid").agg(F.collect_list("terms").alias("aspects"))
    rows = hits.join(sets, "qid", "left").withColumn("aspects", F.coalesce("aspects", F.array().cast("array<array<string>>")))
    low = rows.withColumn("low", F.lower("text"))
    matched = F.size(F.filter("aspects", lambda a: F.exists(a, lambda t: F.contains(F.col("low"), t))))
    top = F.max("score").over(Window.partitionBy("qid"))
    rows = low.withColumn("alpha", matched / F.greatest(F.size("aspects"), F.lit(1))).withColumn("norm", F.when(top > 0, F.col("score") / top).otherwise(0.0))
    rows = rows.withColumn("score_route", F.col("norm") * (0.5 + 0.5 * F.col("alpha")))
    value = F.round("score_route", 12)
    decision = F.when(value >= bypass, "bypass").when(value < discard, "discard").otherwise("rerank")
    return rows.select("qid", "rank", "ord", "score", "score_route", "alpha", decision.alias("decision"))


def _features(samples: DataFrame, query_aspects: DataFrame, least_or_last: str) -> DataFrame:
    """(chunk_id, chunk_length, total, best, alpha): weighted lengths and aspect coverage.

    ``samples`` is (chunk_id, chunk_length, weight, length, aspects map). An aspect seen
    twice counts once, at its largest or last weight.
    """
    known = F.broadcast(query_aspects.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("aspect", "weight"))).alias("q"), F.sum("weight").alias("q_sum")))
    per = samples.filter("chunk_length > 0").groupBy("chunk_id").agg(
        F.first("chunk_length").alias("chunk_length"), F.sum(F.col("weight") * F.col("length")).alias("total"), F.max(F.col("weight") * F.col("length")).alias("best")
    )
    seen = samples.select("chunk_id", "at", F.explode("aspects").alias("aspect", "w"))
    one = F.max("w") if least_or_last == "max" else F.max_by("w", "at")
    seen = seen.groupBy("chunk_id", "aspect").agg(one.alias("w")).crossJoin(known).filter(F.map_contains_key("q", F.col("aspect")))
    # Added in the aspects' order: doubles in another order differ in the last digit, and so would ranks.
    listed = F.sort_array(F.collect_list(F.struct("aspect", "w")))
    found = seen.groupBy("chunk_id").agg(F.aggregate(listed, F.lit(0.0), lambda a, x: a + x.w).alias("found"))
    rows = per.join(found, "chunk_id", "left").crossJoin(known.select("q_sum"))
    return rows.withColumn("alpha", F.when(F.col("q_sum") > 0, F.coalesce("found", F.lit(0.0)) / F.col("q_sum")).otherwise(0.0))


def additive(samples: DataFrame, query_aspects: DataFrame, bypass: float = 0.75, discard: float = 0.1, top_k: int = 20) -> DataFrame:
    """(chunk_id, score, decision): alpha * (contiguous + scattered density)."""
    rows = _features(samples, query_aspects, "last")
    rows = rows.withColumn("score", F.col("alpha") * (F.col("best") / F.col("chunk_length") + F.col("total") / F.col("chunk_length")))
    rows = rows.withColumn("decision", F.when(F.col("score") > bypass, "bypass").when(F.col("score") >= discard, "rerank").otherwise("discard"))
    order = F.row_number().over(Window.partitionBy("decision").orderBy(F.desc("score"), "chunk_id"))
    rows = rows.withColumn("at", order)
    return rows.filter((F.col("decision") != "rerank") | (F.col("at") <= top_k)).select("chunk_id", "score", "decision")


def mass_focus(samples: DataFrame, query_aspects: DataFrame, tau_alpha=0.85, tau_mu=0.1, tau_phi=0.5, alpha_low=0.15, mu_low=0.02, n_max: int = 3, top_k: int = 20) -> DataFrame:
    """(chunk_id, alpha, mu, phi, score, decision); discarding is tested first.

    Bypasses beyond ``n_max`` join the rerank queue, which ends at ``top_k``; what is cut
    is marked ``cut``.
    """
    rows = _features(samples, query_aspects, "max")
    rows = rows.withColumn("mu", F.col("total") / F.col("chunk_length")).withColumn("phi", F.when(F.col("total") > 0, F.col("best") / F.col("total")).otherwise(0.0))
    rows = rows.withColumn("score", F.col("alpha") * (F.col("mu") + F.col("phi") - F.col("mu") * F.col("phi")))
    first = F.when((F.col("alpha") < alpha_low) | (F.col("mu") < mu_low), "discard").when((F.col("alpha") >= tau_alpha) & ((F.col("mu") >= tau_mu) | (F.col("phi") >= tau_phi)), "bypass")
    rows = rows.withColumn("decision", first.otherwise("rerank"))
    at = lambda: F.row_number().over(Window.partitionBy("decision").orderBy(F.desc("score"), "chunk_id"))
    rows = rows.withColumn("at", at()).withColumn("decision", F.when((F.col("decision") == "bypass") & (F.col("at") > n_max), "rerank").otherwise(F.col("decision")))
    rows = rows.withColumn("at", at()).withColumn("decision", F.when((F.col("decision") == "rerank") & (F.col("at") > top_k), "cut").otherwise(F.col("decision")))
    return rows.select("chunk_id", "alpha", "mu", "phi", "score", "decision")


def sensitivity(samples: DataFrame, query_aspects: DataFrame, settings: dict[str, dict]) -> DataFrame:
    """(setting, bypass, rerank, discard, ratio) of several threshold sets, in one plan.

    ``ratio`` is the length of the samples kept (bypassed or reranked) over that of all chunks.
    """
    sizes = samples.filter("chunk_length > 0").groupBy("chunk_id").agg(F.first("chunk_length").alias("whole"), F.sum("length").alias("kept"))
    out = None
    for name, kw in settings.items():
        row = mass_focus(samples, query_aspects, **kw).select(F.lit(name).alias("setting"), "chunk_id", "decision")
        out = row if out is None else out.unionByName(row)
    through = F.col("decision").isin("bypass", "rerank")
    counts = (F.count_if(F.col("decision") == d).alias(d) for d in ("bypass", "rerank", "discard"))
    return out.join(sizes, "chunk_id").groupBy("setting").agg(*counts, (F.sum(F.when(through, F.col("kept")).otherwise(0)) / F.sum("whole")).alias("ratio"))
