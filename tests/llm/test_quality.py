import random
import zlib

import numpy as np

from lexloom.llm import quality as ql
from tests.llm.helpers import DOC, documents


def test_margin_equals_the_pair_sum():
    rng = np.random.default_rng(2)
    model = 0.3, rng.normal(size=ql.N), rng.normal(size=(ql.N, ql.RANK))
    r = np.array([0, 0, 0, 1, 1, 3])
    c = rng.choice(ql.N, 6, replace=False)
    v = rng.normal(size=6)
    want = []
    for row in range(4):
        i = np.flatnonzero(r == row)
        pairs = sum(model[2][c[a]] @ model[2][c[b]] * v[a] * v[b] for a in i for b in i if a < b)
        want.append(0.3 + sum(model[1][c[a]] * v[a] for a in i) + pairs)
    assert np.allclose(ql.margin(model, r, c, v, 4), want)


def test_held_out_accuracy(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts, good = [], []
    for i in range(600):
        w = [word() for _ in range(rng.randint(5, 80))]
        good.append(i % 5 != 0)
        if not good[-1]:
            w = [[x + "$$$" for x in w], [x.upper() + "!!" for x in w], w[:1] * len(w)][i // 5 % 3]
        texts.append(" ".join(w) + ".")
    docs = documents(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, int(t), 0) for i, t in enumerate(good)] + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in ql.score_quality(docs, labels).collect()}
    assert len(got) == 602 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i in range(600))
    assert np.mean([got[i].predicted == good[i] for i in held]) >= 0.95


def test_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(1, "a b", None, None, None), (1, "a b", None, None, 3), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as score", "2 as y", "3 as held_out", "4 as kind")
    got = ql.score_quality(df, labels).collect()
    assert len(got) == 3 and {r.score for r in got} == {0.5} and not any(r.held_out for r in got)
    assert ql.score_quality(df.limit(0), labels).collect() == []


def test_very_long_text_is_described_whole():
    from lexloom.llm import bytescan as bs

    text = ("word " * 200_000 + "END.\n") .encode()
    stats, row, word = ql.describe(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert stats[0, 0] == np.log1p(200_001) and len(word) == 2 and len(bs.SPACE) == 256
