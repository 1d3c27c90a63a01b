import random
import re

import numpy as np
import pytest
import xxhash

from lexloom.llm import simhash_dedup as sd
from lexloom.llm.components import connected
from tests.llm.helpers import DOC, documents


def slow_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(ids, fps, radius=3):
    group = list(range(len(ids)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                group[top(i)] = top(j)
    return [min(ids[j] for j in range(len(ids)) if top(j) == top(i)) for i in range(len(ids))]


def texts(seed, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abÉç.") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    out = [None, "", " \n", "One", "one", "one two", "a b c"]
    for _ in range(n):
        out.append(" ".join(rng.choices(vocab, k=rng.randint(1, 200))))
    for _ in range(60):
        w = rng.choice(out[10:60]).split()
        w[rng.randrange(len(w))] = "edit"
        out.append(" ".join(w))
    return out


def test_matches_brute_force(spark):
    t = texts(1)
    fps = [slow_fingerprint(x) for x in t]
    want = brute(list(range(len(t))), fps)
    got = {r.doc_id: r for r in sd.near_duplicates(documents(spark, t)).collect()}
    assert [got[i].fingerprint for i in range(len(t))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(t))] == want
    assert len(set(want)) < len(want)


def family(seed, n, centres, flips):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, centres, dtype=np.uint64)
    x = base[rng.integers(0, centres, n)]
    for _ in range(flips):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    return np.unique(x)


@pytest.mark.parametrize("centres,flips", [(3, 4), (400, 2), (3000, 0)])
def test_sharded_links_equal_all_pairs(centres, flips):
    x = family(7, 3000, centres, flips)
    near = np.bitwise_count(x[:, None] ^ x[None]) <= 3
    want = sd.Forest(len(x))
    want.add(*np.nonzero(near))
    want.merge()
    nodes, root, shards = sd.fit_tree(x[::3], 4)
    got = sd.Forest(len(x))
    for _, home, query in sd.deal(x, nodes, root, 3):
        own = np.searchsorted(x, np.concatenate([home, query]))
        a, b = sd.link(home, query, 3, block=400)
        got.add(own[a], own[b])
    got.merge()
    assert (got.parent == want.parent).all() and shards > 1


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 100), (200, 190), (190, 210)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[210] == got[200] == got[190] == 190 and 100 not in got
    assert all(got[a] == got[b] for a, b in pairs if a != b)
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []
    by_rounds = connected(spark.createDataFrame(pairs, "a long, b long").repartition(7), small=0).collect()
    assert {r.node: r.root for r in by_rounds} == got and len(by_rounds) == len(got)


def test_keep_one_and_edges(spark):
    rows = [(5, "a b c d", "x", None, 1), (3, "a b c d", None, "s", 2), (3, "a b c d", None, "s", 2), (9, None, None, None, None), (None, "solo text here now", None, None, None)]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as fp", "2 as key", "3 as component_id")
    kept = sd.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.n_chars or 0) for r in kept.collect()) == [(0, 0), (3, 2), (9, 0)]
    assert sd.near_duplicates(df.limit(0)).collect() == []
    assert sd.keep_one(df.limit(0)).collect() == []
    clash = df.withColumnsRenamed({"lang": "row", "source": "copy", "component_id": "root"}).selectExpr("*", "7 as n", "8 as __key")
    assert sd.keep_one(clash).count() == 3 and sd.keep_one(clash).columns == clash.columns


def jaccard(a, b):
    a, b = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(a & b) / len(a | b)


def edited(text, n, rng):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_keep_one_finds_similar_texts(spark):
    """Of copies with a similarity of 0.8 or more nine in ten go; other texts all stay."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(4000)]
    zipf = [1 / (i + 1) for i in range(4000)]
    base = [" ".join(rng.choices(vocab, zipf, k=rng.choice([60, 120, 300, 900]))) for _ in range(120)]
    near, far = [], []
    for t in base:
        n = len(t.split())
        near.append(edited(t, max(1, n // 60), rng))
        far.append(edited(t, n // 8, rng))
    alike = [jaccard(a, b) for a, b in zip(base, near)]
    assert min(alike) > 0.78 and max(jaccard(a, b) for a, b in zip(base, far)) < 0.6
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in base]
    kept = {r.doc_id for r in sd.keep_one(documents(spark, base + near + far + shuffled)).collect()}
    assert set(range(120)) <= kept and set(range(240, 480)) <= kept
    found = [i for i in range(120) if alike[i] >= 0.8]
    assert len(found) > 60 and sum(120 + i not in kept for i in found) >= 0.9 * len(found)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(5)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(400))
    copies = [text, *(edited(text, 2, rng) for _ in range(700))]
    other = [" ".join(f"v{rng.randrange(500)}" for _ in range(100)) for _ in range(20)]
    assert {r.doc_id for r in sd.keep_one(documents(spark, copies + other)).collect()} == {0, *range(701, 721)}


def test_very_long_text(spark):
    long = " ".join(f"w{i * 7919 % 100003}" for i in range(120_000))
    t = [long, long + " end", "short text"]
    got = {r.doc_id: r for r in sd.near_duplicates(documents(spark, t)).collect()}
    assert got[0].component_id == got[1].component_id == 0 and got[0].fingerprint == f"{slow_fingerprint(long):016x}"
    assert {r.doc_id for r in sd.keep_one(documents(spark, t)).collect()} == {0, 2}


def test_similar_groups_by_shards(spark, monkeypatch):
    """A tree fitted on a sample, with many shards, groups the same rows as a single shard."""

    def members(found):
        by = {}
        for r in found.collect():
            by.setdefault(r.root, set()).add(r.doc_id)
        return sorted(map(sorted, by.values()))

    docs = documents(spark, texts(9))
    whole = members(sd.similar_groups(docs))
    assert len(whole) < 127
    depths, fit = [], sd.fit_tree
    monkeypatch.setattr(sd, "SHARD", 4)
    monkeypatch.setattr(sd, "fit_tree", lambda sample, depth, least=8: depths.append((len(sample), depth)) or fit(sample, depth, 8))
    assert members(sd.similar_groups(docs)) == whole
    assert depths and depths[0][0] > 0 and depths[0][1] > 1


def test_near_duplicates_by_shards(spark, monkeypatch):
    """The tree's sample is bounded and changes no group."""
    t = texts(3)
    docs = documents(spark, t)
    want = brute(list(range(len(t))), [slow_fingerprint(x) for x in t])
    sizes, fit = [], sd.fit_tree
    monkeypatch.setattr(sd, "SHARD", 8)
    monkeypatch.setattr(sd, "SAMPLE", 64)
    monkeypatch.setattr(sd, "fit_tree", lambda sample, depth: sizes.append((len(sample), depth)) or fit(sample, depth, 4))
    got = {r.doc_id: r.component_id for r in sd.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(t))] == want
    assert 32 < sizes[0][0] < 96 and sizes[0][1] > 1
