"""Published queries against their own SQL, on small tables of awkward rows."""

import duckdb
import pytest

from lexloom.plans import catalog

DOCS = ["the storage engine keeps words", "words of the engine and words of the store", "", "engine engine SS words keep", "plain prose without much else", "ss ss keeps the store plain"]


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query and its SQL agree on (doc_id, text) and (item_id, text) rows."""

    def check(name, docs=DOCS, items=(), vectors=()):
        tables = {
            "documents": ([(i, t) if isinstance(t, str) else t for i, t in enumerate(docs)], "doc_id long, text string"),
            "benchmark": (list(enumerate(items)), "item_id long, text string"),
            "embeddings": (list(vectors), "vec_id long, embedding array<float>"),
        }
        con = duckdb.connect()
        for table, (rows, schema) in tables.items():
            at = str(tmp_path / f"{table}.parquet")
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(at)
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{at}/*.parquet')")
        found = catalog.queries()[name](spark, str(tmp_path))
        sql = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in found.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
        key = lambda row: tuple(map(repr, row))
        assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(sql, key=key)
        return sql

    return check


@pytest.mark.parametrize("name", ["anchor_select", "aspect_coverage", "dense_aspects", "dense_aspects_filtered", "dense_aspects_scaled", "expand_schema5b", "expansion_telemetry", "qaug_tokens"])
def test_acronym_by_form(same, name):
    assert same(name, items=["SS engine keeps the words of stores", "plain words of a store"])


@pytest.mark.parametrize("name", ["dense_aspects", "dense_aspects_filtered", "dense_aspects_scaled"])
def test_weight_between_two_places(same, name):
    """Cosines of 0.15625, 0.28125, 0.40625 and 0.53125, half way between two weights, are rounded as SQL does."""
    items = ["house copper paper index network summer corn tree table house copper", "network cloud music rice fish south tree moon rice road rice storage music", "silver summer engine south milk corn river lamp corn tree bird index house"]
    same(name, docs=["rain", "corn", "salt", "milk", "tree", "bird", "rice"], items=items)


def test_index_tasks_grow_with_the_text(spark, tmp_path, monkeypatch):
    from lexloom.operators import index as ix

    spark.createDataFrame([(i, f"w{i} the w{i % 7} the") for i in range(2000)], "ord long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    few = ix.build(docs)
    monkeypatch.setattr(ix, "TASK_BYTES", 1 << 10)
    many = ix.build(docs)
    for a, b in ((few.postings, many.postings), (few.terms, many.terms)):
        assert b.rdd.getNumPartitions() > 2 * a.rdd.getNumPartitions()
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert sum(r.df for r in many.terms.collect()) == many.postings.count()


SCORED = ["bm25_lucene", "bm25_okapi", "bm25_plus", "bm25_l", "weighted_retrieve", "sparse_dot", "multi_query_max", "rrf_fusion", "forced_inclusion", "late_expand"]


@pytest.mark.parametrize("name", SCORED)
def test_scored_where_read(same, spark, monkeypatch, name):
    """Many equal texts, documents across Arrow batches and blocks, and no exchange of hits."""
    from lexloom.operators import scan

    monkeypatch.setattr(scan, "CELLS", 12)
    monkeypatch.setattr(scan, "JOINED", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        docs = DOCS * 4 + ["engine " * 9 + "words"] + DOCS[::-1] * 2
        same(name, docs=docs, items=["SS engine keeps the words of stores", "plain words of a store words", "nothing there"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_scores_move_only_the_best(spark):
    from lexloom.operators import index as ix
    from lexloom.operators import scoring as sc

    docs = spark.createDataFrame([(i, f"a b w{i % 5}") for i in range(500)], "ord long, text string")
    terms = sc.query_terms(spark.createDataFrame([(0, "a b"), (1, "w3 b")], "qid long, query string"))
    index = ix.build(docs)
    some, every = sc.bm25_lucene(index, terms, first=3), sc.bm25_lucene(index, terms)
    assert every.count() == 1000 and some.count() <= 2 * 3 * index.tokens.rdd.getNumPartitions()
    assert [tuple(r) for r in sc.top_k(some, 3).orderBy("qid", "rank").select("qid", "ord").collect()] == [(0, 0), (0, 1), (0, 2), (1, 3), (1, 8), (1, 13)]


@pytest.mark.parametrize("first", [1, 3, 40])
def test_fusion_counts_the_ranks_of_few(spark, monkeypatch, first):
    """The first of the full fusion from few documents: ties, lists of few hits, ords in no order, several tasks."""
    import random

    from lexloom.operators import index as ix
    from lexloom.operators import scan
    from lexloom.operators import scoring as sc

    monkeypatch.setattr(scan, "CELLS", 50)
    draw = random.Random(5)
    texts = ["plain"] * 60 + [" ".join(draw.choices(["a", "b", "longer", "words", f"w{i}"], [9, 5, 2, 3, 1], k=draw.randint(1, 9))) for i in range(500)]
    ords = draw.sample(range(-900, 900), len(texts))
    docs = spark.createDataFrame(list(zip(ords, texts)), "ord long, text string").repartition(5).localCheckpoint()
    terms = sc.query_terms(spark.createDataFrame([(7, "a b"), (8, "longer words a"), (9, "w3 w4 longer"), (10, "none"), (11, "words")], "qid long, query string"))
    index = ix.build(docs)
    lists = [sc.lucene(terms), sc.Scorer(terms.filter("length(term) > 3"), lambda df, n: sc.F.lit(1.0), lambda tf, ratio: tf)]
    few, every = sc.fuse_first(index, lists, docs, first, k=2), sc.fuse(scan.scan(index, lists), docs, k=2)
    ranked = lambda df: sorted(tuple(r) for r in sc.top_k(df, first).select("qid", "rank", "ord", "r1", "r2").collect())
    assert ranked(few) == ranked(every)
    assert few.groupBy("qid").count().agg({"count": "max"}).first()[0] <= 3 * (2 + 2 * first)
    if first == 1:
        assert few.count() < every.count() / 5


@pytest.mark.parametrize("name", ["rrf_fusion", "forced_inclusion"])
def test_fusion_without_hits(same, name):
    same(name)
    same(name, items=["zzz"])
    same(name, docs=[], items=["words"])


def test_dense_best(spark):
    from lexloom.operators import scoring as sc

    rows = [(i, [float(i % 7), 1.0, float(i % 3) / 3]) for i in range(1200)] + [(2000, None), (2001, [1.0]), (2002, [1.0, None, 2.0]), (2003, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "ord long, vec array<float>")
    q = v.filter("ord % 50 = 0").select(v.ord.alias("qid"), "vec")
    ranked = lambda df: sorted(map(repr, sc.top_k(df, 10).select("qid", "ord", "rank", "score").collect()))
    some = sc.dense_cosine(q, v, 10)
    assert ranked(some) == ranked(sc.dense_cosine(q, v))
    assert some.count() < sc.dense_cosine(q, v).count() / 5


def test_alpha_in_one_order(spark):
    """The same aspects give the same double, in whatever order samples hold them."""
    from itertools import permutations

    from lexloom.operators import routing as rt

    own = {"legal": 1.0, "noise": 0.1, "abuse": 0.8}
    rows = [(f"c{n}", 100, i, 1.0, 10, {a: own[a]}) for n, order in enumerate(permutations(own)) for i, a in enumerate(order)]
    samples = spark.createDataFrame(rows, "chunk_id string, chunk_length int, at int, weight double, length int, aspects map<string,double>").coalesce(1)
    aspects = spark.createDataFrame(list(own.items()), "aspect string, weight double")
    assert len({r.alpha for r in rt._features(samples, aspects, "last").collect()}) == 1
