import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import bytescan as bs
from lexloom.llm import lm_score as lm
from tests.llm.helpers import DOC, documents


def brute(texts):
    out, count = [], Counter()
    for i, t in enumerate(texts):
        words = [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]
        held = zlib.crc32(str(i).encode()) % 10 == 0
        out.append((held, words))
        if not held:
            count.update(words)
    n, v = sum(count.values()), len(count)
    return n, [(h, len(w), sum(count[x] > 0 for x in w), sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for h, w in out]


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcÉéz,") for _ in range(rng.randint(1, 5))) for _ in range(150)]
    t = [" \n".join(rng.choices(vocab, k=rng.randint(0, 60))) for _ in range(n)]
    return [*t, None, "", "\t \r\n", "A b\x0bc\x0cD", "new words only here", *t[:30]]


def brute_scores(texts):
    """The interpolated bigram score, with every count read from dictionaries as its level stands."""
    rows = [(zlib.crc32(str(i).encode()) % 10 == 0, [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]) for i, t in enumerate(texts)]
    uni, bi = Counter(), Counter()
    for held, w in rows:
        if not held:
            uni.update(w)
            bi.update(zip(["begin", *w[:-1]], w))
    stands = lambda c, base, table: float(table[1 + math.floor(math.log(c) / math.log(base) + 1e-9)]) if c else 0.0
    fine, coarse = (lambda c: stands(c, lm.FINE, lm.FINE_COUNT)), (lambda c: stands(c, lm.COARSE, lm.COARSE_COUNT))
    total, types = Counter(), Counter()
    for (a, _), c in bi.items():
        total[a] += coarse(c)
        types[a] += 1
    floor = sum(map(fine, uni.values())) + 0.1 * (len(uni) + 1)
    out = []
    for _, w in rows:
        z = 0.0
        for a, b in zip(["begin", *w[:-1]], w):
            low, seen = (fine(uni[b]) + 0.1) / floor, coarse(bi[a, b])
            t = fine(types[a]) * lm.ESCAPE
            z += math.log10((seen + t * low) / (max(fine(total[a]), seen) + t) if t else low)
        out.append(z)
    return out


@pytest.mark.parametrize("max_filter", [1 << 28, 3000])
def test_score_matches_brute_force(spark, max_filter):
    """With so many bits an event that no probe goes astray."""
    texts = corpus(6)
    got = {r.doc_id: r.score for r in lm.score_documents(documents(spark, texts), max_filter_bytes=max_filter, bits=256).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(brute_scores(texts), abs=1e-6)


def test_stray_probes_leave_scores_finite(spark):
    """At two bits an event most probes go astray; a context without types falls back."""
    texts = corpus(7)
    rows = lm.score_documents(documents(spark, texts), bits=2).collect()
    assert len(rows) == len(texts) and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    p = lm.interpolated(np.array([0.0, 0.0, 3.0]), np.array([9.0, 0.0, 3.0]), np.array([0.0, 2.0, 0.0]), np.array([0.1, 0.2, 0.3]))
    assert p == pytest.approx([0.1, 0.2, 0.3])


def test_word_hashes_tell_words_apart():
    """Words that collide under every polynomial modulo 2**64, and words of all sizes."""
    flip = bytes.maketrans(b"ab", b"ba")
    thue = b"a"
    while len(thue) < 2048:
        thue += thue.translate(flip)
    words = [thue, thue.translate(flip), *(b"x" * n for n in range(1, 80)), *(b"y" * n + b"z" for n in range(80))]
    data = np.frombuffer(b" ".join(words), np.uint8)
    h, rows = bs.word_hashes(data, np.array([0, len(data)]))
    assert rows.tolist() == [0, len(words)] and len(set(h.tolist())) == len(words)
    upper = np.frombuffer(b" ".join(words).upper(), np.uint8)
    assert (bs.word_hashes(upper, np.array([0, len(upper)]))[0] == h).all()


def test_very_long_text(spark):
    long = " ".join(f"w{i % 997}" for i in range(150_000)) + " " + "q" * 300_000
    got = {r.doc_id: r for r in lm.score_documents(documents(spark, [long, "w1 w2", long])).collect()}
    assert got[0].n_tokens == 150_002 and got[0].n_known == 150_002 and math.isfinite(got[0].score)


@pytest.mark.parametrize("max_hot,max_filter", [(1 << 20, 1 << 28), (20, 1 << 28), (0, 2000)])
def test_base_score_is_exact_and_score_is_a_probability(spark, max_hot, max_filter):
    texts = corpus(5)
    n, want = brute(texts)
    got = {r.doc_id: r for r in lm.score_documents(documents(spark, texts), max_hot, max_filter).collect()}
    assert len(got) == len(texts)
    for i, (held, tokens, known, base) in enumerate(want):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, n)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert r.score <= 1e-9
    copies = [i for i in range(125, 155) if want[i][0] and want[i][1] > 20]
    assert copies and all(got[i].score > got[i].base_score for i in copies)


def test_filter_reads_no_count_too_low():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 20000, dtype=np.uint64)
    counts = rng.zipf(1.6, 20000).clip(1, 10**6)
    lv = lm.levels_of(counts, lm.COARSE)
    data = lm.segment(keys, lv)
    f = lm.CountFilter(data, np.zeros(1, np.int64), np.array([len(data)]))
    got = f.read(keys, np.zeros(len(keys), np.int64))
    assert (got >= lv).all() and (got == lv).mean() > 0.97
    assert (f.read(rng.integers(0, 2**63, 20000, dtype=np.uint64), np.zeros(20000, np.int64)) > 0).mean() < 0.03


def test_edges(spark):
    assert lm.score_documents(documents(spark, ["x"]).limit(0)).collect() == []
    rows = [(1, "a b", None, None, None), (1, "a b", None, None, None), (None, "a", None, None, None)]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as bucket", "2 as tokens", "3 as held_out", "4 as key", "5 as rows_of")
    got = lm.score_documents(df).collect()
    assert sorted(r.n_tokens for r in got) == [2, 3, 3] and all(r.train_tokens == 8 and not r.held_out and r.n_known == r.n_tokens for r in got)
