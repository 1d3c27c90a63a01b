"""Hand-computed values and small oracles for the retrieval library."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.operators import aspects as ap
from lexloom.operators import benchmarks as bm
from lexloom.operators import chunking as ch
from lexloom.operators import expansion as ex
from lexloom.operators import index as ix
from lexloom.operators import lexical as lx
from lexloom.operators import metrics as mt
from lexloom.operators import rerank as rr
from lexloom.operators import routing as rt
from lexloom.operators import scoring as sc
from lexloom.plans import catalog
from lexloom.plans.retrieval import RetrievalConfig, run, thresholds
from lexloom.sources import files, models
from lexloom.streaming import ingest


def one(spark, expr, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)))
    return df.select(expr.alias("x")).first().x


def test_text(spark):
    q = 'qwen2.5-3b and EHR-Complex "KV cache"'
    assert one(spark, tx.entities(F.col("q")), q=q) == ["EHR", "KV", "qwen2.5-3b", "EHR-Complex", "KV cache"]
    assert one(spark, tx.whitespace_tokens(F.col("q")), q=" A gap? b\n") == ["a", "gap?", "b"]
    assert one(spark, tx.stripped_tokens(F.col("q")), q="A gap? x-y b!") == ["gap", "x-y"]
    assert one(spark, tx.query_words(F.col("q")), q="The Gap the gap, of x1 memory") == ["gap", "of", "x1", "memory"]
    assert one(spark, tx.json_part(F.col("q")), q='<think>no</think> ok ```json\n{"a": 1}\n``` end') == '{"a": 1}'
    assert one(spark, tx.is_reference_block(F.col("q")), q="[1] A et al. 2023)\nplain\n") is True
    assert one(spark, tx.parent_block(F.col("q")), q="d_chunk_block1_chunk2") == "d_chunk_block1"
    assert one(spark, tx.sentences(F.col("q")), q="One. Two! Three?") == ["One.", "Two!", "Three?"]
    assert len(tx.STOPWORDS) == 99


def naive_bm25(docs, query, k1=1.2, b=0.75):
    toks = [d.lower().split() for d in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    out = []
    for t in toks:
        s = 0.0
        for w in query.lower().split():
            df = sum(w in x for x in toks)
            tf = t.count(w)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avg))
        out.append(s)
    return out


def test_bm25_random(spark):
    rng = random.Random(1)
    docs = [" ".join(rng.choices("abcdefg", k=rng.randint(1, 12))) for _ in range(12)] + ["", "z"]
    queries = [(0, "a b a"), (1, "zz c"), (2, "nothing")]
    chunks = files.corpus(spark, docs)
    q = spark.createDataFrame(queries, "qid long, query string")
    got = {(r.qid, r.ord): r.score for r in sc.pad(sc.bm25_lucene(ix.build(chunks), sc.query_terms(q)), q, chunks).collect()}
    for qid, text in queries:
        for i, s in enumerate(naive_bm25(docs, text)):
            assert got[qid, i] == pytest.approx(s, abs=1e-9)
    with pytest.raises(ValueError):
        files.corpus(spark, ["a"], [])


def test_chunks(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "")], "doc_id long, text string")
    rows = ch.windows(df.withColumn("t", tx.plain_tokens(F.col("text"))), "t", 5, 2).orderBy("i").collect()
    assert [" ".join(r.window) for r in rows] == ["a b c d e", "d e f g h", "g h i j k"]
    for n in range(1, 30):
        toks = [str(i) for i in range(n)]
        want, start = [], 0
        while True:
            want.append(toks[start : start + 5])
            if start + 5 >= n:
                break
            start += 3
        got = ch.windows(spark.createDataFrame([(toks,)], "t array<string>"), "t", 5, 2).orderBy("i").collect() if n in (4, 5, 6, 11, 29) else None
        assert got is None or [r.window for r in got] == want
    blocks = ch.parents(df, 4)
    assert {r.chunk_id: r.text for r in ch.bridges(blocks, 2).collect()} == {"1_bridge0-1": "c d e f", "1_bridge1-2": "g h i j"}


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0, 200), (1, 150, 350), (1, 350, 400), (1, 401, 450), (2, 10, 20)], "ord int, lo int, hi int")
    got = lx.merged(df).groupBy("ord", "island").agg(F.min("lo"), F.max("hi")).orderBy("ord", "island").collect()
    assert [tuple(r)[2:] for r in got] == [(0, 400), (401, 450), (10, 20)]
    chunks = files.corpus(spark, ["aaaa", "xAAx"])
    hits = lx.occurrences(chunks, spark.createDataFrame([("aa", "p", 1.0)], "term string, aspect string, weight double")).collect()
    assert sorted((r.ord, r.start, r.end) for r in hits) == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 1, 2)]


def test_lexical_queries_read_long_texts(spark, tmp_path):
    rng = random.Random(4)
    words = ["The", "license", "Version", "idiot", "é", "path", "x.", "\U0001f600", "plain", "words"]
    texts = ["th th", "license", " ".join(rng.choices(words, k=2000)), "a" * 5000 + "version" + "b" * 400 + "Version", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, islands = set(), set()
    for d, text in enumerate(texts):
        low, spans = (text or "").lower(), []
        for term, aspect, weight in catalog.PATTERNS:
            for at in (i for i in range(len(low)) if low.startswith(term, i)):
                want.add((d, term, aspect, at, at + len(term) - 1))
                middle = (2 * at + len(term) - 1) // 2
                spans.append((max(0, middle - 100), min(len(low), middle + 100)))
        runs = []
        for lo, hi in sorted(spans):
            if runs and lo <= runs[-1][1]:
                runs[-1][1] = max(hi, runs[-1][1])
            else:
                runs.append([lo, hi])
        islands |= {(d, i, hashlib.md5(text[lo:hi].encode()).hexdigest()) for i, (lo, hi) in enumerate(runs, 1)}
    got = catalog.queries()["lexical_hits"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert {(r.ord, r.island, r.digest) for r in catalog.queries()["interval_merge"](spark, str(tmp_path)).collect()} == islands


def test_qaug_tokens_hold_the_injected_terms(spark, tmp_path):
    rng = random.Random(6)
    words = ["connection", "connections", "connector", "upload", "uploads", "storage", "storages", "latency", "budget", "budgets", "harbour", "harbours"]
    texts = [" ".join(rng.choices(words, k=2) + ["rare%d" % (i // 2)]) for i in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "connection upload"), (1, "storage budget rare7")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {}
    for r in catalog.queries()["expand_schema1"](spark, str(tmp_path)).collect():
        for token in r.term.lower().split():
            want[r.qid, token] = want.get((r.qid, token), 0) + r.reps
    assert any(reps % 3 for reps in want.values())
    assert {(r.qid, r.term): r.w for r in catalog.queries()["qaug_tokens"](spark, str(tmp_path)).collect()} == want


def test_routing_fixture(spark):
    got = {r.setting: (r.bypass, r.rerank, r.discard) for r in rt.sensitivity(*catalog._samples(spark), catalog.SWEEP).collect()}
    assert got == {"Strict": (0, 1, 4), "Balanced": (0, 4, 1), "Permissive": (1, 3, 1)}
    assert thresholds({"tau_bypass": 0.5}, {"tau_alpha": 0.9, "tau_alpha_low": 0.3}) == {"bypass": 0.5, "discard": 0.3, "n_max": 3, "top_k": 20}


def test_greedy_folds(spark):
    words = ["upload", "uploads", "connect", "connection", "api", "apis"]
    assert one(spark, ex.fold_distinct(F.col("w"), ex.stem_related), w=words) == ["upload", "connect", "api", "apis"]
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.99, 0.05]), (1, 2, [0.0, 1.0]), (2, 3, [1.0, 0.0])], "g int, qid int, vec array<double>")
    assert sorted(r.qid for r in bm.distinct_queries(df, "g").collect()) == [0, 2, 3]


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 20)], "qid int, rank int, ord int")
    gold = spark.createDataFrame([(1, 11), (1, 12)], "qid int, ord int")
    q = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    got = {r.qid: r for r in mt.at_k(hits, gold, q, 10).collect()}
    assert (got[1].precision, got[1].recall, got[1].mrr, got[1].strict, got[1].complete) == (0.5, 0.5, 0.5, 1.0, 0.0)
    assert (got[2].precision, got[2].recall, got[3].precision, got[3].recall) == (0.0, 1.0, 0.0, 1.0)
    assert one(spark, mt.compression_ratio(F.lit(5), F.lit(0))) == float("inf")
    assert one(spark, mt.coverage(F.col("g"), F.col("w")), g=["deep nets"], w=["deep", "nets deep"]) == 1.0
    assert one(spark, mt.acronym_retention(F.lit("use KV and EHR now"), F.col("g")), g=["kv cache"]) == 0.5


def test_rerank(spark):
    rows = [(1, r, 100 + r, f"c{r}", 1.0 / r, "t") for r in range(1, 5)]
    hits = spark.createDataFrame(rows, "qid int, rank int, ord int, chunk_id string, score double, text string")
    order = lambda df: [r.ord for r in df.orderBy("position").collect()]
    assert order(rr.listwise(hits, lambda p: "x", lambda p: '["doc_2", "c1", "nope", "doc_2"]')) == [103, 101, 102, 104]
    assert order(rr.listwise(hits, lambda p: "x", lambda p: 1 / 0)) == [101, 102, 103, 104]
    kept = rr.pointwise(hits, F.col("chunk_id"), lambda p: json.dumps({"relevant": p == "c3", "relevance_score": 0.7})).collect()
    assert [(r.ord, r.relevance_score) for r in kept] == [(103, 0.7)]
    assert one(spark, rr.snippet(F.lit("No. Deep cats. Cats deep nets."), F.col("t")), t=["deep", "nets"]) == "Cats deep nets. Deep cats."


@pytest.mark.parametrize("schema", ["v6a", "BM25Dense_AspectFusion"])
def test_run(spark, schema):
    docs = [f"memory model {w} retrieval of tokens number{i}" for i, w in enumerate("deep wide sparse dense hybrid neural".split() * 3)]
    chunks = files.corpus(spark, docs)
    q = spark.createDataFrame([(1, "sparse retrieval of EHR tokens"), (2, "unknown")], "qid long, query string")
    out = run(chunks, q, RetrievalConfig.from_dict({"schema": schema, "odd": 1}, top_k=5))
    assert out["hits"].filter("qid = 1").count() == 5
    assert out["expanded"].filter("qid = 1").count() >= 1
    assert out["telemetry"].count() >= 1
    top = out["hits"].filter("qid = 1 and rank = 1").first().ord
    assert "sparse" in docs[top]


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.txt").write_text("alpha beta\nalpha")
    (tmp_path / "t" / "two.txt").write_bytes(b"gam\xffma")
    (tmp_path / "t" / "blank.txt").write_text("  ")
    got = {r.doc_id: r.text for r in files.text_folder(spark, f"{tmp_path}/t").collect()}
    assert got["one"] == "alpha beta\nalpha" and len(got) == 3
    assert {r.doc_id: r.text for r in files.lossy_text_folder(spark, f"{tmp_path}/t").collect()} == {"one": "alpha beta\nalpha", "two": "gamma"}
    assert files.pick_by_size(spark, f"{tmp_path}/t", 2, 5, 20).count() == 2
    (tmp_path / "d_chunks.json").write_text(json.dumps({"doc_id": "d", "parent_blocks": [], "child_chunks": [{"chunk_id": "c", "parent_id": "p", "doc_id": "d", "text": "x", "token_count": 1}]}, indent=1))
    assert files.chunk_files(spark, str(tmp_path)).first().chunk_id == "c"
    chunks = files.corpus(spark, ["a b a", "b c"])
    assert bm.append_new(chunks, f"{tmp_path}/out", "chunk_id") == 2 and bm.append_new(chunks, f"{tmp_path}/out", "chunk_id") == 0
    chunks.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(chunks.schema).parquet(f"{tmp_path}/in")
    ingest.index_stream(stream, f"{tmp_path}/index", f"{tmp_path}/cp").awaitTermination(120)
    built, want = ingest.load_index(spark, f"{tmp_path}/index", chunks), ix.build(chunks)
    assert sorted(map(tuple, built.terms.collect())) == sorted(map(tuple, want.terms.collect()))


def test_round_binary(spark):
    values = [a / b for b in range(1, 201) for a in range(0, b + 1)] + [0.175, 0.145, 0.125, 0.375]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert all(r.x == round(r.v, 2) for r in df.select("v", tx.round_binary(F.col("v")).alias("x")).collect())


def test_rrf_ranks_documents_of_either_list(spark):
    chunks = files.corpus(spark, ["x"] * 7)
    first = spark.createDataFrame([(1, 5, 3.0), (1, 2, 1.0)], "qid int, ord long, score double")
    second = spark.createDataFrame([(1, 6, 9.0), (1, 5, 2.0), (2, 0, 1.0)], "qid int, ord long, score double")
    got = {(r.qid, r.ord): (r.r1, r.r2) for r in sc.rrf(first, second, chunks).collect()}
    # Query 1 ranks 5, 2, 0, 1, 3, 4, 6 and 6, 5, 0, 1, 2, 3, 4; query 2 has no hit in the first list.
    assert got == {(1, 5): (1, 2), (1, 2): (2, 5), (1, 6): (7, 1), (2, 0): (1, 1)}


def test_stored_index_scores_alike(spark):
    chunks = files.corpus(spark, ["a b a c", "b c d", "a", "e e f"])
    q = sc.query_terms(spark.createDataFrame([(0, "a b a"), (1, "e z")], "qid long, query string"))
    for score in (sc.bm25_lucene, sc.bm25_okapi, sc.bm25_plus, sc.bm25_l):
        fresh, kept = ({(r.qid, r.ord): r.score for r in score(i, q).collect()} for i in (ix.build(chunks), ix.keep(ix.build(chunks))))
        assert fresh.keys() == kept.keys() and all(fresh[k] == pytest.approx(kept[k]) for k in fresh)


def test_local_terms_are_each_query_s_own(spark):
    docs = ["solar panel output solar panel output", "wind turbine blade wind turbine blade", "plain filler text"]
    chunks = files.corpus(spark, docs)
    q = spark.createDataFrame([(1, "solar"), (2, "wind")], "qid long, query string")
    i = ix.build(chunks)
    hits = sc.top_k(sc.bm25_lucene(i, sc.query_terms(q)), 1)
    idf = lambda pool: pool.select("term").distinct().withColumn("idf", F.lit(2.0))
    both = {(r.qid, r.term) for r in ex.local_terms(q, i, hits, idf).collect()}
    alone = {(r.qid, r.term) for r in ex.local_terms(q.filter("qid = 1"), i, hits.filter("qid = 1"), idf).collect()}
    assert {t for n, t in both if n == 1} == {t for _, t in alone} and (1, "solar panel") in both and (1, "wind turbine") not in both


def test_document_recall(spark):
    hits = spark.createDataFrame([(1, 1, 10), (1, 2, 10), (1, 3, 11), (2, 1, 20)], "qid int, rank int, doc_id int")
    gold = spark.createDataFrame([(1, 10), (1, 12), (2, 20), (3, 5)], "qid int, doc_id int")
    r = mt.doc_recall(hits, gold).first()
    assert (r.doc_recall, r.queries) == (50.0, 3)


def test_keyphrases_and_aspects(spark):
    q = "the deep neural network and the deep network"
    words = ["deep", "neural", "network", "deep", "network"]
    value = [words.count(w) / (words.index(w) + 1) for w in words]
    runs = [(-round(sum(value[i : i + k]), 9), i, k, " ".join(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    want = list(dict.fromkeys(p for *_, p in sorted(runs)))
    assert one(spark, ap.keyphrases(F.col("q")), q=q) == want
    assert one(spark, ap.unsubsumed(F.col("w")), w=["ai", "aim", "cloud", "creative cloud"]) == ["creative cloud", "aim"]
    assert one(spark, ap.unsubsumed(F.col("w"), True), w=["ai", "aim", "cloud", "creative cloud"]) == ["creative cloud", "aim", "ai"]
    assert one(spark, ap.clustered(F.col("w")), w=["network", "networks x", "api"])[0] == "network"
    queries = spark.createDataFrame([(1, q), (2, "EHR storage")], "qid long, query string")
    chunks = files.corpus(spark, ["deep network model training", "neural storage of records", "ehr notes"])
    i = ix.build(chunks)
    rows = ap.aspects_by_idf(queries, i.terms).collect()
    assert all(0.1 <= r.weight <= 1 for r in rows) and {r.qid for r in rows if r.weight == 1.0} == {1, 2}
    found = ap.statistical(queries, i).collect()
    assert {r.qid for r in found} == {1, 2} and all(r.term == r.name and r.keyword_weight == 1.0 for r in found if r.place == 0)
    assert any(r.place > 0 for r in found)
    vocab = spark.createDataFrame([("deep network",), ("records",)], "term string")
    near = ap.vector(queries, vocab.withColumn("vec", ap.hash_vector(F.col("term")))).collect()
    assert any(r.term == "deep network" and r.place > 0 for r in near)
    dense = ap.dense_aspects(queries, vocab, k=2).collect()
    assert [(r.name, r.weight) for r in dense if r.qid == 2][0] == ("ehr", 1.0) and len(dense) == 4
    assert {r.term for r in ap.combined_vocabulary(chunks, spark.createDataFrame([("deep network", 2.0)], "term string, score double"), 3).collect()} >= {"deep network"}


def test_modelled_expansion(spark):
    q = spark.createDataFrame([(1, "deep nets")], "qid long, query string")
    answer = json.dumps({"aspects": [{"name": "a", "aspect_weight": 0.5, "keywords": [{"term": "t", "weight": 1.0}]}]})
    assert [(r.name, r.weight) for r in ap.modelled(q, F.col("query"), lambda p: answer).collect()] == [("a", 0.5)]
    with pytest.raises(Exception, match="unreadable expansion"):
        ap.modelled(q, F.col("query"), lambda p: "no json").collect()
    assert [(r.name, r.weight) for r in ap.modelled_aspects(q, F.col("query"), lambda p: "no json").collect()] == [("deep nets", 1.0)]
    assert [(r.name, r.weight) for r in ap.modelled_aspects(q, F.col("query"), lambda p: '[{"name": "x", "weight": 0.2}]').collect()] == [("x", 0.2)]


def test_batch_rerankers(spark):
    rows = [(1, r, 100 + r, f"c{r}", 1.0 / r, "t" * r) for r in range(1, 8)]
    hits = spark.createDataFrame(rows, "qid int, rank int, ord int, chunk_id string, score double, text string")
    q = spark.createDataFrame([(1, "x")], "qid int, query string")
    answer = '<think>[no]</think>{"target_fact": "f", "relevant_chunk_ids": ["doc_2", "nope", "doc_0", "doc_2"]}'
    got = rr.listwise_batches(hits, q, lambda p: answer, size=3).orderBy("position").collect()
    assert [r.ord for r in got] == [103, 101, 106, 104, 107] and [r.relevance_score for r in got] == [0.7, 0.8, 0.7, 0.8, 0.8]
    by_length = rr.listwise_batches(hits.withColumn("length", F.length("text")), q, lambda p: '{"relevant_chunk_ids": ["doc_0"]}', size=10, presort="length").collect()
    assert [r.ord for r in by_length] == [107]
    assert rr.listwise_batches(hits, q, lambda p: 1 / 0).collect() == []
    told = '{"evaluations": [{"chunk_id": "doc_1", "relevant": true, "relevance_score": 0.4}, {"chunk_id": "c1", "relevant": true, "relevance_score": 1.0}, {"chunk_id": "doc_0", "relevant": false}]}'
    assert [(r.ord, r.relevance_score) for r in rr.pointwise_batches(hits, q, lambda p: told).orderBy("position").collect()] == [(102, 0.4), (107, 0.4)]


def test_judging_asks_again(spark):
    rows = [(1, "q", "b0", f"b0_chunk{i}", f"text {i}") for i in range(4)]
    cands = spark.createDataFrame(rows, "qid int, question string, parent_source string, chunk_id string, text string")
    yes_once = lambda p: "[true, true, true, true]" if p.count("--- Chunk") == 4 else ("[true]" if "text 2" in p else "[false]")
    got = {r.chunk_id: r.verdicts for r in bm.judged(cands, yes_once).collect()}
    assert got == {"b0_chunk0": [True, False], "b0_chunk1": [True, False], "b0_chunk2": [True, True], "b0_chunk3": [True, False]}
    short = {r.chunk_id: r.verdicts for r in bm.judged(cands, lambda p: "[true]", size=5).collect()}
    assert all(v == [False] for v in short.values())
    assert [r.kind for r in bm.split_verdicts(bm.judged(cands, yes_once)).collect()] == ["core"]


def test_traces_and_budget(spark):
    q = spark.createDataFrame([(1, "network storage latency")], "qid long, query string")
    i = ix.build(files.corpus(spark, ["network storage", "networks latency storages", "plain"]))
    vocab = spark.createDataFrame([(1, "networks", 1.0), (2, "storages", 1.0), (3, "zebra", 1.0)], "rank int, term string, idf double")
    chosen, words = ex.anchors(q, i.terms), ex.expand(q, i.terms, vocab, "1")
    rows = {r.anchor: r for r in ex.traces(chosen, q, vocab, words).collect()}
    assert set(rows) <= {"network", "storage", "latency"} and all(r.total_candidates_above_tau == len(r.candidates_above_tau or []) for r in rows.values())
    assert any(r.injected for r in rows.values())
    own = spark.createDataFrame([(1, a, s) for a, s in enumerate([0.9, 0.9, 0.3, 0.1])], "qid int, aspect int, saliency double")
    assert [r.capacity for r in ex.within_budget(own).orderBy("aspect").collect()] == [3, 3, 0, 0]


def test_sources(spark, tmp_path):
    assert files.settings(f"{tmp_path}/none.json") == {}
    (tmp_path / "c.json").write_text('{"p": 0.3}')
    assert files.settings(f"{tmp_path}/c.json") == {"p": 0.3}
    with pytest.warns(UserWarning):
        assert files.term_vectors(spark, f"{tmp_path}/none") is None
    spark.createDataFrame([("a", [1.0])], "term string, vec array<double>").write.parquet(f"{tmp_path}/v")
    assert files.term_vectors(spark, f"{tmp_path}/v").first().term == "a"
    encode = models.encoder(lambda: lambda texts: [[float(len(t))] for t in texts], "q: ")
    assert spark.createDataFrame([("ab",), (None,)], "t string").select(encode("t").alias("v")).collect() == [([5.0],), ([3.0],)]
    chunks = files.corpus(spark, ["a a b"])
    sparse = models.sparse_weights(chunks, lambda: lambda texts: [{w: t.split().count(w) for w in set(t.split())} for t in texts])
    assert {(r.term, r.w) for r in sparse.collect()} == {("a", 2.0), ("b", 1.0)}
    pooled = one(spark, models.pooled_logits(F.expr("array(array(0D, -1D), array(1D, -2D))")))
    assert pooled == pytest.approx([math.log(2), 0.0])
    assert "<think>" in models.chatml("hi") and models.chatml("<|im_start|>x") == "<|im_start|>x"
    assert models.timed(len, [1, 2])[0] == 2


def test_reranker_clients_post(monkeypatch):
    sent = []
    monkeypatch.setattr(models, "_post", lambda url, body, timeout, headers=None: sent.append((url, body, headers)) or {"response": "", "thinking": "t", "content": "c", "choices": [{"message": {"content": "m"}}]})
    assert models.ollama("u", "m")("p") == "t" and models.completion("u")("p") == "c" and models.chat("u", "m", "k")("p") == "m"
    assert sent[1][1]["stream"] is False and sent[2][2] == {"Authorization": "Bearer k"}
    pauses, calls = [], []
    monkeypatch.setattr(models.time, "sleep", pauses.append)
    with pytest.raises(ZeroDivisionError):
        models.retried(lambda p: calls.append(p) or 1 / 0)("x")
    assert pauses == [2.0, 4.0] and len(calls) == 3


def test_bpe_windows(spark, tmp_path):
    import base64

    (tmp_path / "ranks").write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" " + str(i).encode() for i in range(256)))
    docs = spark.createDataFrame([(1, "abcdefgh"), (2, ""), (3, "abc")], "doc_id long, text string")
    got = [(r.doc_id, r.i, r.text, r.token_count) for r in ch.bpe_windows(docs, f"{tmp_path}/ranks", r".+", 4, 1).orderBy("doc_id", "i").collect()]
    assert got == [(1, 0, "abcd", 4), (1, 1, "defg", 4), (1, 2, "gh", 2), (3, 0, "abc", 3)]


def test_queries_of_any_alphabet(spark, tmp_path):
    """Queries with letters outside ASCII are expanded as well."""
    texts = ["café connection upload", "connections upload budget", "budget storage über"] * 3
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "café connection"), (1, "über budget storage")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.qid, r.anchor) for r in catalog.queries()["anchor_select"](spark, str(tmp_path)).collect()}
    assert got == {(0, "connection"), (1, "budget"), (1, "storage")}
