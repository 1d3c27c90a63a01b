"""Exact top-k by inner product with norm-bucketed retrieval.

Vectors are grouped by length (and dimension) into buckets of similar norm. A query
with a lower bound on its k-th score turns it into a local cosine threshold of each
bucket, t = bound / (|q| * longest norm of the bucket), and each bucket chooses how to
prune: by length, dropping vectors too short to reach the bound at cosine one, or, where
t is high enough to pay off, by coordinate, keeping vectors whose value on the query's
focus coordinate lies in the range that a cosine of at least t allows. What is left is
verified by exact integer products.

Queries and buckets are both cut into blocks of bounded size, and a block of queries with a
few blocks of a bucket is one task's work: a stated set of queries against all rows, in
blocks. Two rounds: the first looks at one bucket per query, the one of longest vectors,
which gives the bound; the second sorts the queries by the length that their bounds ask for
and sends a block of them only to buckets long enough. Only k rows per query and bucket
move on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.llm.runtime import checkpointed

#: Rows of a candidate block and of a query block.
BLOCK, QUERIES = 8192, 1024
#: A coordinate scan is tried for thresholds from here on.
STEEP = 0.9
#: Norm buckets of an octave, and candidate blocks that a task looks at.
OCTAVE, TOGETHER = 8, 8
#: Below every score, and its negative is still a long.
LEAST = -(2**63) + 1
HITS = "query_id long, vec_id long, score long"


def matrices(batch):
    """(dimension, rows, integer vectors) of the usable rows of an array column.

    Rows that are null or hold a null or non-finite component are left out; products of
    what remains must fit 64 bits, so components beyond 2**31 raise.
    """
    column = batch if isinstance(batch, pa.Array) else batch.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    offs = np.asarray(column.offsets)
    values = column.values
    ok = ~np.asarray(column.is_null())
    x = np.where(np.asarray(values.is_null()), np.nan, np.asarray(values.fill_null(0.0)))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    ok &= bad[offs[1:]] == bad[offs[:-1]]
    size = np.diff(offs)
    for d in np.unique(size[ok]):
        rows = np.flatnonzero(ok & (size == d))
        v = np.floor(256.0 * x[(offs[rows][:, None] + np.arange(d)).ravel()]).reshape(len(rows), d)
        if v.size and np.abs(v).max() >= 2.0**31:
            raise ValueError("a component beyond 2**31 after scaling: its products leave 64 bits")
        yield int(d), rows, v.astype(np.int64)


def _norms(batches):
    for batch in batches:
        for d, rows, v in matrices(batch.column(1)):
            n = np.sqrt((v.astype(float) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column(0).to_numpy()[rows]), pa.array(np.full(len(rows), d, np.int32)), pa.array(n), pa.array([r.tobytes() for r in v], pa.binary())], names=["vec_id", "dim", "norm", "v"]
            )


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products; through doubles while every partial sum is below 2**53."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2.0**53:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    if float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2.0**63:
        return q @ c.T
    raise ValueError("an inner product may leave 64 bits")


def best(scores, ids, own, k):
    """Places of the k best columns of each row: score falling, then id rising; not one's own."""
    scores = np.where(ids[None] == own[:, None], LEAST, scores)
    if scores.shape[1] > k:
        floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    else:
        floor = np.full((len(scores), 1), LEAST + 1)
    row, col = np.nonzero((scores >= floor) & (scores > LEAST))
    by = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[by], col[by]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], col[rank < k]


def search_block(qid, q, bound, cid, c, norm, k):
    """Hits of a query block in a candidate block whose norms fall, given lower bounds.

    ``bound`` is a score that k candidates are known to reach, or minus infinity.
    """
    qn = np.sqrt((q.astype(float) ** 2).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(bound > 0, bound / (qn * norm[0]) if norm[0] > 0 else np.inf, -1.0)
        need = np.where(bound > 0, bound / qn, -1.0)
    out = []
    # Length: vectors shorter than bound / |q| cannot reach it. Norms fall, so a prefix stays.
    alive = t <= 1 + 1e-9
    reach = np.searchsorted(-norm, -(need * (1 - 1e-9)), side="right")
    steep = alive & (t >= STEEP) & (q.shape[1] > 0)
    plain = np.flatnonzero(alive & ~steep)
    if len(plain):
        most = int(reach[plain].max())
        if most:
            for lo in range(0, len(plain), 128):
                part = plain[lo : lo + 128]
                s = product(q[part], c[:most])
                r, col = best(s, cid[:most], qid[part], k)
                out.append((qid[part][r], cid[col], s[r, col]))
    if steep.any():
        unit = c / np.maximum(norm, 1e-300)[:, None]
        for i in np.flatnonzero(steep):
            f = int(np.abs(q[i]).argmax())
            a, ti = q[i, f] / qn[i], max(-1.0, min(1.0, t[i] * (1 - 1e-9)))
            # A cosine of at least t keeps the angles to the axis within arccos(t) of each other.
            angle, away = np.arccos(np.clip(a, -1, 1)), np.arccos(ti)
            x = unit[: reach[i], f]
            keep = np.flatnonzero((x >= np.cos(min(np.pi, angle + away)) - 1e-9) & (x <= np.cos(max(0.0, angle - away)) + 1e-9))
            if len(keep):
                s = product(q[i : i + 1], c[keep])
                r, col = best(s, cid[keep], qid[i : i + 1], k)
                out.append((np.full(len(r), qid[i]), cid[keep][col], s[r, col]))
    return [np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else ((), (), ()))]


PACKED = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("norms", pa.binary()), ("bounds", pa.binary()), ("wide", pa.bool_()), ("vectors", pa.binary()), ("longest", pa.float64()), ("need", pa.float64())])
PACKED_DDL = "dim int, block long, ids binary, norms binary, bounds binary, wide boolean, vectors binary, longest double, need double"


def _pack(rows):
    """Rows (part, vec_id, dim, norm, bound, v), sorted within the partition, as blocks."""

    def run(batches):
        held, count, number = [], 0, 0

        def emit(dim, lots):
            nonlocal number
            part, ids, norm, bound, v = (sum(x, []) for x in zip(*lots))
            x = np.frombuffer(b"".join(v), np.int64)
            wide = bool(len(x)) and np.abs(x).max() >= 1 << 15
            number += 1
            norms, bounds = np.array(norm, float), np.array(bound, float)
            need = np.where(bounds > 0, bounds / np.maximum(norms, 1e-300), -1.0).min()
            return pa.RecordBatch.from_pydict(
                {"longest": [norms.max()], "need": [need], "dim": [dim], "block": [(part[0] << 20) + number], "ids": [np.array(ids, np.int64).tobytes()], "norms": [norms.tobytes()], "bounds": [bounds.tobytes()], "wide": [wide], "vectors": [x.astype(np.int64 if wide else np.int16).tobytes()]},
                schema=PACKED,
            )

        now = None
        for batch in batches:
            part, ids, dims, norm, bound, v = (c.to_pylist() for c in batch.columns)
            lo = 0
            while lo < len(ids):
                if dims[lo] != now and held:
                    yield emit(now, held)
                    held, count = [], 0
                now = dims[lo]
                hi = lo
                while hi < len(ids) and dims[hi] == now and count < rows:
                    hi, count = hi + 1, count + 1
                held.append((part[lo:hi], ids[lo:hi], norm[lo:hi], bound[lo:hi], v[lo:hi]))
                lo = hi
                if count >= rows:
                    yield emit(now, held)
                    held, count = [], 0
        if held:
            yield emit(now, held)

    return run


def packed(vectors: DataFrame, rows: int, parts: int, by=None) -> DataFrame:
    """Blocks of at most ``rows`` vectors of one dimension, longest (or largest ``by``) first."""
    order = ("dim", F.desc("norm") if by is None else by.desc(), "vec_id")
    dealt = vectors.repartitionByRange(max(1, parts), *order).sortWithinPartitions(*order)
    dealt = dealt.select(F.spark_partition_id().cast("long").alias("part"), "vec_id", "dim", "norm", "bound", "v")
    return dealt.mapInArrow(_pack(rows), PACKED_DDL)


def bucket_of(norm):
    """Number of the bucket of a norm; vectors of no length have one of their own."""
    return F.when(norm > 0, F.floor(F.log2(norm) * OCTAVE)).otherwise(-100_000).cast("int")


def _open(row):
    v = np.frombuffer(row["vectors"], np.int64 if row["wide"] else np.int16).astype(np.int64)
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, v.reshape(len(ids), row["dim"]), np.frombuffer(row["norms"], float), np.frombuffer(row["bounds"], float)


def _meet(k):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] * 3]
        asked = [_open(r) for r in queries.to_pylist()]
        for row in candidates.to_pylist():
            cid, c, norm, _ = _open(row)
            for qid, q, _, bound in asked:
                out.append(search_block(qid, q, bound, cid, c, norm, k))
        return pa.Table.from_pydict(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(x) for x in zip(*out)))))

    return run


def _hits(queries: DataFrame, blocks: DataFrame, n_queries: int, k: int) -> DataFrame:
    """Every query block with the blocks of its dimension that are long enough, a few in a task.

    The numbers of blocks by dimension and bucket are the one table that is broadcast: some
    hundred rows a dimension, as the buckets grow with the logarithm of the norms.
    """
    down = max(1, -(-n_queries // (64 * QUERIES)))
    c = blocks.withColumn("bucket", bucket_of(F.col("longest")))
    lots = c.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / TOGETHER).alias("groups"))
    c = c.join(F.broadcast(lots), ["dim", "bucket"]).withColumn("i", F.pmod(F.xxhash64("block"), F.col("groups"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    asks = queries.withColumn("least", bucket_of(F.col("need") * (1 - 1e-9))).withColumn("j", F.pmod("block", F.lit(down)).cast("int"))
    q = asks.join(F.broadcast(lots), "dim").filter("bucket >= least").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    key = ["dim", "bucket", "i", "j"]
    # Columns of their own on one side, as both come from ``lots``.
    q = q.select("block", "ids", "norms", "bounds", "wide", "vectors", *(F.col(x).cast("long").alias(x) for x in key))
    c = c.select("block", "ids", "norms", "bounds", "wide", "vectors", *(F.col(x).cast("long").alias(x) for x in key))
    return q.groupBy(*key).cogroup(c.groupBy(*key)).applyInArrow(_meet(k), HITS)


def top_k(vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest integer inner product.

    Components become floor(256 * x). ``is_query`` is a condition on ``vectors``; a row is
    no candidate of a query with its own id. Fewer than k candidates give fewer rows; ties
    go to the smaller id.

    Vectors that are null or hold a null or non-finite component, and rows with a null id,
    take no part; vectors meet only those of their own dimension (an empty vector scores
    zero with empty ones); rows repeated with their id are candidates each, and one query
    each with equal results once; an empty table gives no rows; other columns are ignored.
    """
    named = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), is_query.alias("asks"), F.col(embedding).alias("v")).filter("vec_id is not null")
    ready = named.select("vec_id", "v").mapInArrow(_norms, "vec_id long, dim int, norm double, v binary")
    asking = named.filter("asks").select("vec_id", "v").mapInArrow(_norms, "vec_id long, dim int, norm double, v binary").dropDuplicates(["vec_id", "v"])
    n = named.agg(F.count("*"), F.count_if("asks")).first()
    parts, q_parts = -(-n[0] // BLOCK), -(-n[1] // QUERIES)
    blocks = checkpointed(packed(ready.withColumn("bound", F.lit(0.0)), BLOCK, parts))
    first = blocks.groupBy("dim").agg(F.min("block").alias("block"))
    longest = blocks.join(F.broadcast(first), ["dim", "block"], "left_semi").select(blocks.columns)
    rest = blocks.join(F.broadcast(first), ["dim", "block"], "left_anti").select(blocks.columns)
    ask = checkpointed(asking)
    opening = checkpointed(_hits(packed(ask.withColumn("bound", F.lit(float("-inf"))), QUERIES, q_parts), longest, n[1], k))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = opening.withColumn("n", F.row_number().over(place)).filter(F.col("n") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bound"))
    bounded = ask.join(kth, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    need = F.when(F.col("bound") > 0, F.col("bound") / F.col("norm")).otherwise(-1.0)
    further = _hits(packed(bounded, QUERIES, q_parts, need), rest, n[1], k)
    ranked = opening.unionByName(further).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
