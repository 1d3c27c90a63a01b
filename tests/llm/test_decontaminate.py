import random

import numpy as np

from lexloom.llm import decontaminate as dc
from tests.llm.helpers import DOC, documents


def slow(item, text):
    """Least edit distance of item to any run of text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


def edited(rng, words, e):
    w = list(words)
    for _ in range(e):
        i = rng.randrange(len(w))
        kind = rng.randrange(3)
        if kind == 0:
            w[i] = "changed" + str(rng.randrange(99))
        elif kind == 1:
            w.insert(i, "extra" + str(rng.randrange(99)))
        elif len(w) > 1:
            del w[i]
    return w


def test_edit_distance():
    rng = np.random.default_rng(0)
    for _ in range(50):
        item, text = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 12))
        assert dc.edits_within(item, text) == slow(list(item), list(text))


def test_finds_leaks_and_nothing_else(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 6))) for _ in range(800)]
    items = [rng.choices(vocab, k=rng.choice([14, 19, 23, 30, 41, 59])) for _ in range(40)]
    texts, want = [None, ""], set()
    for d in range(2, 160):
        w = rng.choices(vocab, k=rng.randint(10, 300))
        if d % 2:
            i, e = rng.randrange(40), d % 4 // 2
            leak = edited(rng, items[i], e * max(1, len(items[i]) // 10))
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() if d % 3 == 0 else x + "," for x in leak]
            want.add((d, i, e))
        texts.append(" \n".join(w))
    bench = spark.createDataFrame([(i, " ".join(w).capitalize() + ".") for i, w in enumerate(items)] + [(90, None), (91, "...")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in dc.leaks(documents(spark, texts), bench).collect()}
    for (d, i), r in got.items():
        assert 0 <= r.edits <= 0.2 * r.item_words and r.similarity >= 0.8
    exact = [(d, i) for d, i, e in want if not e]
    near = [(d, i) for d, i, e in want if e]
    assert set(exact) <= set(got) and all(got[k].edits == 0 for k in exact)
    assert sum(k in got for k in near) >= 0.9 * len(near)
    assert set(got) <= {(d, i) for d, i, _ in want}
    kept = dc.keep_clean(documents(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == set(range(160)) - {d for d, _ in got}


def test_meets_every_pair_at_all_allowed_edits():
    rng = random.Random(5)
    vocab = ["w" + str(i) for i in range(3000)]
    for n in (5, 10, 16, 27, 30, 55, 111, 223):
        items = [rng.choices(vocab, k=n) for _ in range(60)]
        texts = [rng.choices(vocab, k=rng.randint(1, 60)) + edited(rng, w, n // 5) + rng.choices(vocab, k=40) for w in items]
        found = dc.Items(range(60), [" ".join(w) for w in items], 0.8).find(*flat(texts))
        assert all(found.get((i, i)) == slow(items[i], t) for i, t in enumerate(texts)), n


def flat(texts):
    (_, data, offs), = dc.bs.chunks(dc.pa.array([" ".join(t) for t in texts], dc.pa.large_string()))
    return data, offs


def test_edges(spark):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    rows = [(None, "One two, three four five six!", "x", None, None)] * 2 + [(3, "seven", None, None, None)]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as item_id", "2 as leak", "3 as row")
    assert [(r.doc_id, r.item_id, r.edits) for r in dc.leaks(df, bench).collect()] == [(None, 1, 0)] * 2
    assert dc.keep_clean(df, bench).count() == 1 and dc.keep_clean(df, bench).columns == df.columns
    assert dc.leaks(df.limit(0), bench).collect() == [] and dc.leaks(df, bench.limit(0)).collect() == []


def test_very_long_text(spark):
    rng = random.Random(12)
    item = " ".join(f"i{rng.randrange(10**6)}" for _ in range(40))
    long = " ".join(f"w{i * 7919 % 100003}" for i in range(100_000))
    docs = documents(spark, [long, long + " " + item, item + " " + long])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {(r.doc_id, r.edits) for r in dc.leaks(docs, bench).collect()} == {(1, 0), (2, 0)}
    assert {r.doc_id for r in dc.keep_clean(docs, bench).collect()} == {0}
