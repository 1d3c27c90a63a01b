import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexloom.llm import source_mix as sm
from tests.llm.helpers import DOC, documents


def goals(size):
    """Targets by the rule itself: share, stop, share the excess again."""
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    t, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(size.values()))
    while left > 1e-9 and open_:
        share = left / sum(w[s] for s in open_)
        left = 0.0
        for s in list(open_):
            t[s] += share * w[s]
            if t[s] > 3 * size[s]:
                left += t[s] - 3 * size[s]
                t[s] = 3.0 * size[s]
                open_.discard(s)
    return t


def corpus(n=500):
    rng = random.Random(9)
    names = ["a", "b", "é", "z", None, "tiny", "empty"]
    src = [rng.choices(names[:5], (50, 10, 20, 5, 10))[0] for _ in range(n)] + ["tiny", "empty"]
    txt = [" \t".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["one two", None]
    return txt, src


def test_taken_follows_the_targets(spark):
    txt, src = corpus()
    docs = documents(spark, [*txt, txt[0]], [*src, src[0]])
    rows = sm.taken(docs).collect()
    again = sm.taken(docs.repartition(3)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    size, got, target = defaultdict(int), defaultdict(int), {}
    source = dict(enumerate([*src, src[0]]))
    for r in rows:
        text = [*txt, txt[0]][r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) and 0 <= r.taken <= 3 * r.size
        s = source[r.doc_id]
        size[s] += r.size
        got[s] += r.taken
        target[s] = r.target
    want = goals(size)
    for s in size:
        assert target[s] == pytest.approx(want[s], abs=1e-6)
        assert got[s] == math.floor(want[s] + 1e-6)
    assert all(r.source_size == size[source[r.doc_id]] for r in rows)


def test_mix_is_what_was_taken(spark):
    txt, src = corpus(300)
    docs = documents(spark, [*txt, txt[0]], [*src, src[0]]).withColumn("rank", F.lit("x"))
    docs = docs.unionByName(docs.filter("doc_id = 5"))
    mixed = sm.mix(docs, shards=8).collect()
    assert mixed[0].__fields__[:6] == docs.columns
    words = defaultdict(int)
    for r in mixed:
        assert len(r.text.split()) == r.mix_words > 0 and 0 <= r.mix_shard < 8
        words[r.doc_id] += r.mix_words
    want = defaultdict(int)
    for r in sm.taken(docs).collect():
        want[r.doc_id] += r.taken
    assert words == {k: v for k, v in want.items() if v}
    per = [sum(r.mix_shard == s for r in mixed) for s in range(8)]
    assert min(per) > 0


def test_taken_counts_what_the_tree_deals(spark, monkeypatch):
    txt, src = corpus(300)
    docs = documents(spark, txt, src)
    want = {r.doc_id: r.taken for r in sm.taken(docs).collect()}
    whole = sm.split
    monkeypatch.setattr(sm, "split", lambda quotas, shards: whole(quotas, shards).filter("shard <> 15"))
    got = {r.doc_id: r.taken for r in sm.taken(docs).collect()}
    lost = {k for k in want if got[k] < want[k]}
    assert lost and got.keys() == want.keys() and all(got[k] == want[k] for k in want.keys() - lost)


def test_draws_follow_the_distribution(spark):
    df = spark.range(20001).select(sm.hypergeometric(F.lit(30).cast("long"), F.lit(70).cast("long"), F.lit(40).cast("long"), F.col("id") / 20001).alias("x"))
    got = {r.x: r["count"] / 20001 for r in df.groupBy("x").count().collect()}
    for x, p in got.items():
        exact = math.comb(30, x) * math.comb(70, 40 - x) / math.comb(100, 40)
        assert p == pytest.approx(exact, abs=2e-4)


def test_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 3), (2, 0), (3, 517)], "place int, quota long")
    rows = sm.split(quotas, 16).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.place].append((r.shard, r.first, r.n))
    for place, quota in ((0, 1000), (1, 3), (2, 0), (3, 517)):
        runs = sorted(by[place])
        assert [f for _, f, _ in runs] == [sum(n for _, _, n in runs[:i]) for i in range(16)] and sum(n for *_, n in runs) == quota
    per = [sum(r.n for r in rows if r.shard == s) for s in range(16)]
    assert max(per) - min(per) <= 1 and sum(per) == 1520


def test_edges(spark):
    empty = documents(spark, ["a"]).limit(0)
    assert sm.taken(empty).collect() == [] and sm.mix(empty, 4).collect() == []
    rows = [(1, None, None, None, None), (None, "", None, "s", None)]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as size", "2 as key", "3 as block", "4 as place", "5 as nth")
    got = sm.taken(df).collect()
    assert len(got) == 2 and all(r.taken == r.size == r.target == 0 for r in got)
    assert sm.mix(df, 4).collect() == []


def test_shards_stand_together_and_names_may_clash(spark):
    txt, src = corpus(200)
    docs = documents(spark, txt, src).selectExpr("*", "'a' as mix_key", "7 as mix_nth", "8 as mix_shard", "'r' as row", "1 as place")
    mixed = sm.mix(docs, shards=8)
    assert mixed.columns == [*(c for c in docs.columns if c != "mix_shard"), "mix_shard", "mix_order", "mix_words"]
    parts = [[(r.mix_shard, r.mix_order) for r in p] for p in mixed.rdd.glom().collect()]
    assert all(p == sorted(p) for p in parts) and sum(len({s for s, _ in p}) for p in parts) == 8
    assert {(r.mix_key, r.mix_nth, r.row, r.place) for r in mixed.collect()} == {("a", 7, "r", 1)}


def test_null_ids_and_long_texts(spark):
    long = "w " * 300_000
    rows = [(None, f"t{i} x y", None, "s", 1) for i in range(500)] + [(1, long, None, "s", 1)]
    docs = spark.createDataFrame(rows, DOC)
    got = sm.taken(docs).collect()
    assert sum(r.size for r in got) == 301_500 and sum(r.taken for r in got) == int(got[0].target)
    assert sm.allotted(docs).select("rank").distinct().count() > 1
