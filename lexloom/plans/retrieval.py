"""Configuration and the whole retrieval run over a batch of queries."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import expansion as ex
from lexloom.operators import index as ix
from lexloom.operators import rerank as rr
from lexloom.operators import routing as rt
from lexloom.operators import scoring as sc
from lexloom.operators import vocabulary as vb
from lexloom.operators.vocabulary import hash_vector


@dataclass(frozen=True)
class RetrievalConfig:
    schema: str = "BM25Dense_AspectInject"
    p: float = 0.5
    C_exp: int = 2
    tau_sim: float = 0.55
    beta: float = 0.65
    c: int = -1
    r_min: int = 2
    r_max: int = 4
    n_reps: int = 3
    max_vocab_pool_size: int = 1000
    tau_bypass: float = 0.75
    tau_discard: float = 0.15
    N_max: int = 10
    top_k: int = 30

    @classmethod
    def from_dict(cls, values: dict, **override) -> "RetrievalConfig":
        """Known keys of a parsed file; keyword arguments win, other keys are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in {**(values or {}), **override}.items() if k in known})

    def settings(self) -> ex.Settings:
        return ex.Settings(self.p, self.C_exp, self.tau_sim, self.beta, self.c, self.r_min, self.r_max, self.n_reps)


def thresholds(explicit: dict, config: dict) -> dict:
    """Routing thresholds: explicit, else configured under either name, else the defaults."""
    pick = lambda *names, default: next((s[n] for s, n in names if s.get(n) is not None), default)
    return {
        "bypass": pick((explicit, "tau_bypass"), (config, "tau_bypass"), (config, "tau_alpha"), default=0.85),
        "discard": pick((explicit, "tau_discard"), (config, "tau_discard"), (config, "tau_alpha_low"), default=0.15),
        "n_max": pick((explicit, "N_max"), (config, "N_max"), default=3),
        "top_k": pick((explicit, "top_k"), (config, "top_k"), default=20),
    }


def run(chunks: DataFrame, queries: DataFrame, config: RetrievalConfig = RetrievalConfig(), encode=hash_vector, rerank=None) -> dict[str, DataFrame]:
    """Hits, triage, targets and contexts of (qid, query) over (ord, chunk_id, text).

    The term table, read several times, is stored first; ``rerank`` maps the queue to rows with ``position``, by
    default the score order.
    """
    index = ix.keep_terms(ix.build(chunks))
    phrase_idf = lambda pool: ix.term_idf(pool.select(F.col("term").alias("phrase")).distinct(), index.terms, "phrase").withColumnRenamed("phrase", "term")
    vocabulary = vb.salient(index, phrase_idf, config.max_vocab_pool_size)
    if ex.SCHEMAS.get(config.schema) == "3":
        first = sc.top_k(sc.bm25_lucene(index, sc.query_terms(queries)), config.top_k)
        vocabulary = ex.local_terms(queries, index, first, phrase_idf)
    keywords = ex.expand(queries, index.terms, vocabulary, config.schema, encode, config.settings())
    hits = sc.top_k(sc.bm25_lucene(index, ex.augmented_terms(keywords)), config.top_k)
    told = sc.with_text(hits, chunks, queries.count() * config.top_k)
    routed = rt.cascade(told, keywords.select("qid", F.col("aspect").cast("string").alias("aspect"), "term"), config.tau_bypass, config.tau_discard)
    queue = told.join(routed.filter("decision = 'rerank'").select("qid", "ord"), ["qid", "ord"])
    targets = rr.targets(routed, (rerank or rr.by_score)(queue))
    expanded = rr.late(targets, chunks, config.N_max)
    return {"keywords": keywords, "hits": hits, "routed": routed, "targets": targets, "expanded": expanded, "context": rr.context(expanded), "telemetry": ex.telemetry(keywords)}
