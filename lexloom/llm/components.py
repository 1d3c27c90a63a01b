"""Connected components of a table of links, by alternating star contractions.

Links first meet in partitions, each of which keeps a spanning forest of its own. What is
left then contracts: each round points every node of a neighbourhood at the smallest node
of it, and the number of rounds grows with the logarithm of the longest chain. All state
stays in tables, and each round is checkpointed. A forest of at most ``SMALL`` links, counted
before, is finished by one task: the same result in one step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.runtime import checkpointed

#: Links that one task may finish (16 bytes each).
SMALL = 1 << 20
#: Links that a partition gathers before it reduces them to a forest.
GATHER = 1 << 18


class Forest:
    """Union of index pairs, kept as a forest whose roots are the smallest indices."""

    def __init__(self, n):
        self.parent = np.arange(n)
        self.held, self.count = [], 0

    def add(self, a, b):
        if len(a):
            self.held.append((a, b))
            self.count += len(a)
            if self.count > 1 << 20:
                self.merge()

    def merge(self):
        if not self.held:
            return
        a, b = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.count = [], 0
        p = self.parent
        while True:
            ra, rb = p[a], p[b]
            live = ra != rb
            if not live.any():
                break
            a, b, ra, rb = a[live], b[live], ra[live], rb[live]
            np.minimum.at(p, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                q = p[p]
                if (q == p).all():
                    break
                p = q
        self.parent = p


def stars(u: np.ndarray, v: np.ndarray):
    """(node, root) of all nodes but roots: root is the smallest node of the component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    forest = Forest(len(nodes))
    forest.add(at[: len(u)], at[len(u) :])
    forest.merge()
    own = np.flatnonzero(forest.parent != np.arange(len(nodes)))
    return nodes[own], nodes[forest.parent[own]]


def _reduce(limit):
    """Forests of a partition's links, at most about ``limit`` links held at a time."""

    def run(batches):
        u, v, held = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def out(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

        for batch in batches:
            u, v = np.concatenate([u, batch.column(0).to_numpy()]), np.concatenate([v, batch.column(1).to_numpy()])
            held += batch.num_rows
            if limit and held >= limit:
                u, v = stars(u, v)
                held = 0
                if len(u) >= limit:
                    yield out(u, v)
                    u, v = u[:0], v[:0]
        if len(u):
            yield out(*stars(u, v))

    return run


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected(links: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): root is the smallest node reachable.

    Self-links and repeats are allowed; rows with a null end are dropped; nodes without a
    link to another node are absent from the result; an empty table gives no rows. ``small``
    changes where links are contracted and not what is found.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    edges = checkpointed(edges.mapInArrow(_reduce(GATHER), "u long, v long"))
    mark = _mark(edges)
    if mark[0] <= small:
        edges = edges.coalesce(1).mapInArrow(_reduce(0), "u long, v long") if mark[0] else edges
    else:
        edges = _contracted(edges.distinct(), mark)
    flat = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return flat.unionByName(flat.select("root", "root").distinct().toDF("node", "root"))


def _contracted(edges: DataFrame, mark) -> DataFrame:
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        below = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(below.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges
