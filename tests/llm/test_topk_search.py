import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import topk_search as tk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, every=50):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in ok if j != i and len(c) == len(q))[:k]
            out[i] = [(j, -x) for x, j in s]
    return {i: r for i, r in out.items() if r}


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = {}
    for r in tk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


@pytest.mark.parametrize("kind", ["unit", "norms", "copies"])
def test_matches_brute_force(spark, kind, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "norms":
        x *= np.exp(rng.normal(size=(600, 1)))
    if kind == "copies":
        x[100:400] = x[3]
        x[400:500] = x[5] + rng.normal(size=(100, 8)) * 0.001
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(650, None), (700, [float("nan")] * 8), (750, [None] * 8), (800, [1.0, 2.0]), (801, [0.5, 1.0]), (850, []), (900, [0.0] * 8)]
    monkeypatch.setattr(tk, "BLOCK", 100)
    monkeypatch.setattr(tk, "QUERIES", 4)
    assert run(spark, rows) == brute(rows)


def test_pruning_in_a_block_is_exact():
    rng = np.random.default_rng(3)
    c = np.floor(256 * rng.normal(size=(500, 6)) * np.exp(rng.normal(size=(500, 1)))).astype(np.int64)
    c[:40] = c[0] + rng.integers(-2, 3, (40, 6))
    norm = np.sqrt((c.astype(float) ** 2).sum(1))
    by = np.argsort(-norm)
    c, norm = c[by], norm[by]
    ids = rng.permutation(500)
    q = c[::7]
    full = q @ c.T
    for k in (1, 5):
        bound = np.sort(full, axis=1)[:, -k - 1].astype(float)
        got = tk.search_block(np.full(len(q), -1), q, bound, ids, c, norm, k)
        assert len(got[0]) and (np.sort(got[2])[::-1][: len(q)] <= full.max()).all()
        single = [tk.search_block(np.array([-1]), q[i : i + 1], bound[i : i + 1], ids, c, norm, k) for i in range(len(q))]
        for i, (_, col, s) in enumerate(single):
            want = sorted(zip(-full[i], ids))[:k]
            assert [(-a, b) for a, b in zip(s, col)] == want


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tk.top_k(empty, F.col("vec_id") % 50 == 0).collect() == []
    rows = [(50, [1.0, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).selectExpr("*", "1 as query_id", "2 as norm", "3 as score")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in tk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(50, 1, 1, 65536), (50, 2, 1, 65536)]
