import random
import zlib

import numpy as np
import pyarrow as pa

from lexloom.llm import bytescan as bs
from lexloom.llm import toxicity as tx
from tests.llm.helpers import DOC, documents


def test_features_are_the_distinct_n_grams_of_each_row():
    texts = ["Abc\nÉa", "", "x", "aaaaaa", "日本語 text"]
    (lo, data, offs), = bs.chunks(pa.array(texts))
    x, bounds = tx.code_points(data, offs)
    got = tx.row_features(data, offs)
    for i, t in enumerate(texts):
        low = " " + t.lower().replace("\n", " ") + " "
        assert "".join(map(chr, x[bounds[i] : bounds[i + 1]])) == low
        n = len({low[k : k + m] for m in tx.ORDERS for k in range(len(low) - m + 1)})
        assert (got >> tx.BITS == i).sum() == n


def labelled(spark, n=400):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts, toxic = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(5, 80))]
        toxic.append(i % 4 == 0)
        if toxic[-1]:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "zorg" + word())
        texts.append(" ".join(w))
    return texts, toxic


def test_held_out_accuracy_and_filter(spark):
    texts, toxic = labelled(spark)
    docs = documents(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic)] + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in tx.score_toxicity(docs, labels).collect()}
    assert len(got) == len(texts) + 2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(len(texts)))
    assert np.mean([got[i].predicted == toxic[i] for i in held]) >= 0.95
    assert got[len(texts)].score == got[len(texts) + 1].score
    kept = tx.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(1, "a b", None, None, None), (1, "a b", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as score", "2 as y", "3 as held_out", "4 as row")
    got = tx.score_toxicity(df, labels).collect()
    assert len(got) == 3 and len({r.score for r in got}) == 1 and not any(r.held_out for r in got)
    assert tx.score_toxicity(df.limit(0), labels).collect() == []
    assert len(tx.keep_clean(df, labels).columns) == 9


def test_very_long_text_is_scored_whole():
    """A chunk of one long row gives the features of all of its text."""
    text = ("plain words " * 50_000 + "zorgblat").encode()
    data, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    tail = np.frombuffer(b"zorgblat", np.uint8)
    whole, own = set(tx.row_features(data, offs).tolist()), set(tx.row_features(tail, np.array([0, len(tail)])).tolist())
    assert own <= whole


def test_one_id_in_many_rows_trains_once(spark):
    from lexloom.llm.labelled import training_sample

    docs = documents(spark, ["a"]).unionByName(spark.createDataFrame([(7, f"t{i}", None, None, 1) for i in range(300)], DOC))
    labels = spark.createDataFrame([(7, 1), (0, 0)], "doc_id long, toxic int")
    assert training_sample(docs, labels, "toxic", 5, 9, 10).count() == 2
