"""Near-duplicate groups by SimHash fingerprints, linked exactly through vantage points.

Distinct fingerprints are partitioned by Hamming distance: a tree of vantage points and
median distances, fitted on a bounded sample, sends each fingerprint to one home shard,
and those within the link radius of a boundary also, as queries, to the shards across
it. The triangle inequality shows that no linked pair is missed: its two distances to
any point differ by at most the radius. Inside a shard the same rule prunes branches of
a local tree, down to small blocks that are compared outright.

A shard returns a spanning forest of its links and never all pairs; copies collapse
into one fingerprint before any of this. On fingerprints without structure, distances
concentrate around half the bits, so queries multiply by about 1.6 a level: the README
has figures.

``keep_one`` looks for texts whose sets of five-word shingles are alike by 0.8 or more. At
that similarity, fingerprints of shingles differ by ten bits of 64, which no vantage point
prunes; fingerprints of the set of words differ by four. So each text has ``VIEWS``
fingerprints of its words, each under a seed of its own and dealt on its own, and a pair met
in any of them is verified by ``WIDE`` bits of its five-word shingles. Texts meet
only within a band of sizes and the part of the next one that the similarity allows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.llm import bytescan as bs
from lexloom.llm.components import Forest, connected
from lexloom.llm.runtime import checkpointed, row_key, texts_in_small_batches

U64 = np.uint64
#: Fingerprints the tree is fitted on, those a shard should hold, and a block compared outright.
SAMPLE, SHARD, BLOCK = 1 << 16, 1 << 15, 1 << 16
#: Word fingerprints of a text, bits of its shingle fingerprint, and words of a shingle.
VIEWS, WIDE, SHINGLE = 6, 256, 5
SIMILARITY = 0.8
#: One text as it is dealt to shards.
ENTRY = np.dtype([("fp", "<u8"), ("node", "<i8"), ("wide", "<u8", (WIDE // 64,))])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bit i is set if it is set in more than half of the shingles' XXH64 (seed 42)."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hash64(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = len(words) - shingle + 1
    votes = np.zeros(64, np.int64)
    for lo in range(0, k, 1 << 16):
        s, e = starts[lo : min(k, lo + (1 << 16))].tolist(), ends[lo + shingle - 1 :].tolist()
        h = np.array([hash64(line[a:b], 42) for a, b in zip(s, e)], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(votes * 2 > k, bitorder="little").view("<u8")[0])


def _fingerprints(shingle):
    def run(batches):
        for batch in batches:
            fp = np.zeros(batch.num_rows, np.uint64)
            for lo, data, offs in bs.chunks(batch.column(2)):
                raw = data.tobytes()
                for i in range(len(offs) - 1):
                    fp[lo + i] = fingerprint(raw[offs[i] : offs[i + 1]], shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], names=["key", "doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(key, doc_id, fp) of every row; fp is the 64-bit fingerprint as a signed long."""
    texts_in_small_batches(docs.sparkSession)
    keyed = docs.select(row_key("doc_id", "text").alias("key"), "doc_id", "text")
    return keyed.mapInArrow(_fingerprints(shingle), "key binary, doc_id long, fp long")


def distance(a, b):
    return np.bitwise_count(a ^ b).astype(np.int16)


def fit_tree(sample: np.ndarray, depth: int, least: int = 32):
    """Rows (vantage, median, left, right); a negative child -1-s is shard s."""
    nodes, shards = [], 0

    def grow(points, level):
        nonlocal shards
        if level < depth and len(points) >= 2 * least:
            best = None
            for v in points[:: max(1, len(points) // 4)][:4]:  # the one that splits best
                d = distance(points, v)
                mid = int(np.median(d))
                edge = int(((d > mid - 3) & (d <= mid + 3)).sum())
                if 0 < (d <= mid).sum() < len(d) and (best is None or edge < best[0]):
                    best = edge, v, mid, d
            if best:
                at = len(nodes)
                nodes.append(None)
                _, v, mid, d = best
                nodes[at] = (v, mid, grow(points[d <= mid], level + 1), grow(points[d > mid], level + 1))
                return at
        shards += 1
        return -shards

    root = grow(sample, 0)
    return nodes, root, shards


def deal(points, nodes, root, radius, asking=None):
    """Yields (shard, homes, queries) for ``points`` at home and ``asking``, which only query."""
    value = (lambda p: p["fp"]) if points.dtype.names else (lambda p: p)
    stack = [(root, points, points[:0] if asking is None else asking)]
    while stack:
        at, home, query = stack.pop()
        if not len(home) and not len(query):
            continue
        if at < 0:
            yield -1 - at, home, query
            continue
        v, mid, left, right = nodes[at]
        dh, dq = distance(value(home), v), distance(value(query), v)
        across = home[(dh <= mid) & (dh > mid - radius)]
        stack.append((left, home[dh <= mid], query[dq <= mid + radius]))
        stack.append((right, home[dh > mid], np.concatenate([query[dq > mid - radius], across])))


def _near(x, a, b, radius, forest, accept=None):
    """Compares all of a with all of b, in blocks; pairs of one tree already are passed over."""
    step = max(1, BLOCK * 4 // max(1, len(b)))
    for lo in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(x[a[lo : lo + step], None] ^ x[None, b]) <= radius)
        i, j = a[lo + i], b[j]
        apart = forest.parent[i] != forest.parent[j]
        i, j = i[apart], j[apart]
        if accept is not None and len(i):
            ok = accept(i, j)
            i, j = i[ok], j[ok]
        forest.add(i, j)
        if forest.count > 4096:
            forest.merge()


def link(home: np.ndarray, query: np.ndarray, radius: int, block: int = BLOCK, accept=None):
    """(member, root), as indices into home + query, of all links inside ``home`` and between
    ``query`` and ``home``; ``accept`` tells which of the index pairs within the radius count."""
    x = np.concatenate([home, query])
    forest = Forest(len(x))
    h, q = np.arange(len(home)), np.arange(len(home), len(x))
    stack = [(h, None), (q, h)]
    turn = 0
    while stack:
        a, b = stack.pop()
        own = b is None
        if not len(a) or (not own and not len(b)):
            continue
        if len(a) * len(a if own else b) <= block:
            _near(x, a, a if own else b, radius, forest, accept)
            continue
        pool = a if own or len(a) >= len(b) else b
        best = None
        for _ in range(3):
            turn += 1
            v = x[pool[turn * 7919 % len(pool)]]
            d = distance(x[pool], v)
            mid = min(int(np.median(d)), int(d.max()) - 1)
            edge = int(((d > mid - radius) & (d <= mid + radius)).sum())
            if best is None or edge < best[0]:
                best = edge, v, mid
        _, v, mid = best
        da = distance(x[a], v)
        if own:
            if mid < da.min():
                _near(x, a, a, radius, forest, accept)
                continue
            stack += [(a[da <= mid], None), (a[da > mid], None), (a[(da <= mid) & (da > mid - radius)], a[(da > mid) & (da <= mid + radius)])]
        else:
            db = distance(x[b], v)
            parts = [(a[da <= mid + radius], b[db <= mid]), (a[da > mid - radius], b[db > mid])]
            if any(len(p) * len(r) >= 0.9 * len(a) * len(b) for p, r in parts):
                _near(x, a, b, radius, forest, accept)
            else:
                stack += parts
    forest.merge()
    at = np.flatnonzero(forest.parent != np.arange(len(x)))
    return at, forest.parent[at]


def _deal_batches(nodes, root, radius):
    def run(batches):
        for batch in batches:
            rows = list(deal(batch.column(0).to_numpy().view(np.uint64), nodes, root, radius))
            if rows:
                s, h, q = zip(*rows)
                yield pa.RecordBatch.from_pydict({"shard": pa.array(s, pa.int32()), "home": [x.tobytes() for x in h], "query": [x.tobytes() for x in q]})

    return run


def _link_shard(radius):
    def run(table: pa.Table) -> pa.Table:
        home, query = (np.concatenate([np.frombuffer(x, np.uint64) for x in table.column(c).to_pylist()]) for c in ("home", "query"))
        x = np.concatenate([home, query]).view(np.int64)
        a, b = link(home, query, radius)
        return pa.Table.from_pydict({"a": pa.array(x[a]), "b": pa.array(x[b])})

    return run


def sampled(distinct: DataFrame, key: str, value, count: int) -> np.ndarray:
    """About ``SAMPLE`` values of the ``count`` rows, those with the smallest hashes of ``key``.

    Rows are chosen where they are, so that no task sends more than its share.
    """
    edge = F.lit(min(1 << 62, SAMPLE * (1 << 62) // max(1, count)))
    chosen = distinct.filter(F.shiftrightunsigned(F.xxhash64(key), 2) < edge).select(value.alias("value"))
    found = chosen.toPandas()["value"].tolist()
    x = np.sort(np.frombuffer(b"".join(found), "<u8") if found and isinstance(found[0], (bytes, bytearray)) else np.array(found, np.int64).view(np.uint64))
    return x[np.argsort(bs.mix(x), kind="stable")]


def linked_fingerprints(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints ``fp`` within ``radius`` bits."""
    n = distinct.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / SHARD)))
    sample = sampled(distinct, "fp", F.col("fp"), n) if depth else np.zeros(0, np.uint64)
    nodes, root, _ = fit_tree(sample, depth)
    dealt = distinct.select("fp").mapInArrow(_deal_batches(nodes, root, radius), "shard int, home binary, query binary")
    return dealt.groupBy("shard").applyInArrow(_link_shard(radius), "a long, b long")


def groups(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(key, doc_id, fp, component_id) of every row; ``key`` is the row's identity.

    ``component_id`` is the smallest doc_id reachable over links of at most ``radius``
    differing bits. A null text is empty; texts without words have fingerprint zero and
    link like any other; repeated rows fall into one group; a group whose doc_ids are all
    null has a null id; an empty table gives no rows; other columns are ignored.
    """
    rows = checkpointed(fingerprints(docs, shingle))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected(linked_fingerprints(distinct, radius)).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = named.select("fp", "root", "least")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(smallest, "root").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``; see ``groups``."""
    found = groups(docs, shingle, radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def most_bits(similarity: float) -> int:
    """Bits of ``WIDE`` by which texts of this Jaccard similarity differ at most, in nineteen of
    twenty cases: the angle between shingle sets of one size, and 1.65 standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(WIDE * p + 1.65 * math.sqrt(WIDE * p * (1 - p)))


def _majority(h: np.ndarray, bits: int) -> np.ndarray:
    """Fingerprint of ``bits`` bits: each 64 of them from the hashes under a seed of their own."""
    out = np.zeros(bits // 64, np.uint64)
    for s in range(len(out)):
        votes = np.zeros(64, np.int64)
        for lo in range(0, len(h), 1 << 16):
            with np.errstate(over="ignore"):
                x = bs.mix(h[lo : lo + (1 << 16)] + U64(s + 1) * U64(0x9E3779B97F4A7C15))
            votes += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
        out[s] = np.packbits(votes * 2 > len(h), bitorder="little").view("<u8")[0]
    return out


def sketch(words: np.ndarray):
    """(number of shingles, word fingerprints and shingle fingerprint) of a text's word hashes."""
    k = max(1, len(words) - SHINGLE + 1)
    h = np.full(k, len(words[:SHINGLE]), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(SHINGLE, len(words))):
            h = bs.mix(h * U64(0xD6E8FEB86659FD93) + words[j : j + k])
    return k, np.concatenate([_majority(np.unique(words), 64 * VIEWS), _majority(np.unique(h), WIDE)])


def _sketches(batches):
    for batch in batches:
        n, bits = [], []
        for _, data, offs in bs.chunks(batch.column(2), 1 << 20):
            words, rows = bs.word_hashes(data, offs)
            for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
                k, x = sketch(words[a:b])
                n.append(k)
                bits.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(bits, pa.binary())], names=["key", "doc_id", "n", "bits"])


def _deal_sketches(nodes, root, radius, similarity):
    """Lots (view, band, shard): texts at home, and texts of the band below in reach of them."""

    def run(batches):
        for batch in batches:
            node, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bits = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(len(n), -1)
            band = np.floor(np.log2(n)).astype(np.int64)
            reach = np.floor(np.log2(n / similarity + 1e-9)).astype(np.int64)
            out = {"lot": [], "home": [], "query": []}
            for view in range(VIEWS):
                x = np.zeros(len(n), ENTRY)
                x["fp"], x["node"], x["wide"] = bits[:, view], node, bits[:, VIEWS:]
                for b in range(int(reach.max(initial=-1)) + 1):
                    asks = x[(band == b - 1) & (reach == b)]
                    for shard, home, query in deal(x[band == b], nodes, root, radius, asks):
                        out["lot"].append(((shard << 6) + b) * VIEWS + view)
                        out["home"].append(home.tobytes())
                        out["query"].append(query.tobytes())
            if out["lot"]:
                yield pa.RecordBatch.from_pydict({"lot": pa.array(out["lot"], pa.int64()), "home": pa.array(out["home"], pa.binary()), "query": pa.array(out["query"], pa.binary())})

    return run


def _link_lot(radius, limit):
    def run(table: pa.Table) -> pa.Table:
        home, query = (np.concatenate([np.frombuffer(x, ENTRY) for x in table.column(c).to_pylist()]) for c in ("home", "query"))
        both = np.concatenate([home, query])
        close = lambda i, j: np.bitwise_count(both["wide"][i] ^ both["wide"][j]).sum(1) <= limit
        a, b = link(np.ascontiguousarray(home["fp"]), np.ascontiguousarray(query["fp"]), radius, accept=close)
        return pa.Table.from_pydict({"a": pa.array(both["node"][a]), "b": pa.array(both["node"][b])})

    return run


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, radius: int = 3) -> DataFrame:
    """(key, doc_id, root) of every row: rows of one root are linked by similar texts.

    A link is a pair whose word fingerprints differ by at most ``radius`` bits in some view and
    whose shingle fingerprints differ by at most ``most_bits(similarity)`` of ``WIDE`` bits.
    Edge cases are those of ``groups``.
    """
    texts_in_small_batches(docs.sparkSession)
    keyed = docs.select(row_key("doc_id", "text").alias("key"), "doc_id", "text")
    rows = keyed.mapInArrow(_sketches, "key binary, doc_id long, n long, bits binary")
    rows = checkpointed(rows.withColumn("node", F.xxhash64("n", "bits")))
    distinct = checkpointed(rows.select("node", "n", "bits").distinct())
    count = distinct.count()
    depth = max(0, math.ceil(math.log2(max(1, count) / (4 * SHARD))))  # bands shorten the trees
    sample = sampled(distinct, "node", F.substring("bits", 1, 8), count) if depth else np.zeros(0, np.uint64)
    nodes, root, _ = fit_tree(sample, depth)
    dealt = distinct.mapInArrow(_deal_sketches(nodes, root, radius, similarity), "lot long, home binary, query binary")
    links = dealt.groupBy("lot").applyInArrow(_link_lot(radius, most_bits(similarity)), "a long, b long")
    roots = connected(links)
    return rows.select("key", "doc_id", "node").join(roots, "node", "left").select("key", "doc_id", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, radius: int = 3) -> DataFrame:
    """``docs`` with one row of each similar group: that of the smallest doc_id (null last).

    Rows alike in id and text are one row. Null and empty texts are alike and so one group;
    long texts are read whole; an empty table gives no rows; columns may have any names.
    """
    found = similar_groups(docs, similarity, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("key").alias("k")))
    best = found.groupBy("root").agg(first.alias("m")).select(F.col("m.k").alias("key"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), row_key("doc_id", "text").alias("key"))
    kept = packed.join(best.distinct(), "key")
    each = Window.partitionBy("key").orderBy("key")  # rows alike in id and text
    return kept.withColumn("copy", F.row_number().over(each)).filter("copy = 1").select("row.*")
