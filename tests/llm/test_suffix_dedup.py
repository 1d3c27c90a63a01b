import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import bytescan as bs
from lexloom.llm.suffix_dedup import remove_repeats, repeated_rows
from tests.llm.helpers import DOC, documents


def brute(texts, depth=200):
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + depth] for r in raw for i in range(len(r) - depth + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - depth + 1):
            if count[r[i : i + depth]] > 1:
                gone[i : i + depth] = [True] * depth
        left = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def texts(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(rng.randint(20, 90)) for _ in range(6)]
    out = [None, "", "short", "a" * 700, "ab" * 400, "x" * 199, "x" * 200, "x" * 200, "y" * 201]
    for _ in range(n):
        parts = [prose(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            cut = rng.randint(0, 30)
            parts += [s[cut:], prose(rng.randint(0, 40))]
        out.append(" ".join(parts))
    out += out[10:14]
    near = out[-1] + prose(120)
    for _ in range(6):
        i = rng.randrange(len(near) - 1)
        near = near[:i] + "#" + near[i + 1 :]
        out.append(near)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    t = texts(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(documents(spark, t)).collect()}
    assert [got[i] for i in range(len(t))] == brute(t)


@pytest.mark.parametrize("hot,block", [(0, 1 << 21), (2, 97), (512, 131)])
def test_hot_digits_and_blocks_do_not_change_the_result(spark, hot, block):
    t = texts(3, 14)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(documents(spark, t), hot=hot, block=block).collect()}
    assert [got[i] for i in range(len(t))] == brute(t)


def test_a_passage_in_many_contexts(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{rng.randrange(900)}" for _ in range(60))
    t = [f"{rng.random()} {' '.join(f'a{rng.randrange(10**6)}' for _ in range(30))} {passage} {' '.join(f'b{rng.randrange(10**6)}' for _ in range(30))}" for _ in range(150)] + ["same text " * 30] * 60
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(documents(spark, t), hot=40).collect()}
    assert [got[i] for i in range(len(t))] == brute(t)


def colliding(n):
    """Two texts of n letters (a multiple of 4,096) that collide under every polynomial modulo 2**64."""
    flip, x = bytes.maketrans(b"ab", b"ba"), b"a"
    while len(x) < 2048:
        x += x.translate(flip)
    return x * (n // 2048), x.translate(flip) * (n // 2048)


def test_colliding_hashes_do_not_remove_text(spark):
    a, b = colliding(4096)
    assert a != b
    p = [int(bs.span_hash(bs.prefix_hash(np.frombuffer(x, np.uint8)), np.array([0]), np.array([4096]))[0]) for x in (a, b)]
    assert p[0] == p[1]  # the quick hash does not tell them apart
    docs = documents(spark, [a.decode(), b.decode()])
    got = {r.doc_id: r.n_removed for r in remove_repeats(docs, depth=4096, digit=2048).collect()}
    assert got == {0: 0, 1: 0}
    text = np.frombuffer(a + b + a, np.uint8)
    at = np.array([0, 4096, 8192])
    assert repeated_rows(text, at, np.zeros(3, np.uint64), 4096, 4096).tolist() == [True, False, True]


def test_very_long_text(spark):
    long = " ".join(f"w{i * 7919 % 1000003}" for i in range(150_000))
    t = [long, "x" * 50 + long[500_000:500_400] + "y" * 60]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(documents(spark, t)).collect()}
    assert got == {0: (len(long), 400, 1), 1: (510, 400, 1)}


def test_edges(spark):
    empty = documents(spark, ["a"]).limit(0)
    assert remove_repeats(empty).collect() == []
    rows = [(1, "z" * 250, None, None, None), (1, "z" * 250, None, None, None), (None, "q" * 10, None, None, None)]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as key", "2 as first", "3 as bucket")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in remove_repeats(df).collect())
    assert got == [(0, 10, 0), (1, 250, 250), (1, 250, 250)]
    kept = remove_repeats(documents(spark, ["k" * 30 + "v" * 210, "v" * 200]), keep_text=True)
    assert {r.doc_id: r.kept_text for r in kept.collect()} == {0: "k" * 30, 1: ""}
