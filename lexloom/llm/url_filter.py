"""URL filters with exact membership from a cascade of Bloom filters.

A rule names a host and a path prefix and fits the host and all its subdomains. Every
url therefore has a few candidate keys, each suffix of its host with no more labels than
some rule's host, with each prefix of its path as long as some rule's path; the distinct keys of the corpus are the complete
universe. A cascade holds which of them are listed: level 0 encodes the listed keys,
level 1 the keys of the universe that level 0 takes for listed though they are not,
level 2 the listed keys that level 1 takes for these, and so on until a level has no
false positive. A key is listed exactly if the first level that misses it is an odd one
(or, past the last level, by that level's parity). The answer is exact for every key of
the universe, so urls are filtered without a join.

Level 0's error rate is chosen as the share of listed keys in the universe, so level 1
holds about as many keys as are listed, and later levels halve: the cascade's size is
bounded by the list, times the logarithm of the universe over it, whatever the corpus.
The universe is never collected; only false positives reach the driver, and the build
draws a level anew (with more bits) should they exceed their bound.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.runtime import checkpointed

U64 = np.uint64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Host after the first ``://``, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Path up to ``?`` or ``#``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, lengths: list[int], labels: list[int]) -> Column:
    """Keys host-suffix + path-prefix of a url, for the given numbers of labels and path lengths.

    A suffix is read from the end of the host, so a host of many labels costs no more.
    """
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    suffixes = F.filter(F.array(*(F.when(dots + 1 >= n, F.substring_index(host, ".", -n)) for n in labels)), lambda s: s.isNotNull())
    cut = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(cut, lambda n: F.concat(s, F.substring(path, F.lit(1), n)))))


class Bloom:
    """Bits for n keys at an error rate; keys are 64-bit hashes, salted by level."""

    def __init__(self, keys: np.ndarray, rate: float, level: int):
        self.level = level
        self.k = max(1, round(-math.log2(rate)))
        self.bits = max(64, math.ceil(len(keys) * self.k / math.log(2)))
        self.data = np.zeros(-(-self.bits // 8), np.uint8)
        at = self._at(keys).ravel()
        np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def _at(self, keys):
        with np.errstate(over="ignore"):
            x = keys * U64(0x9E3779B97F4A7C15) + U64(self.level * 2 + 1) * U64(0xD6E8FEB86659FD93)
            x = (x ^ (x >> U64(32))) * U64(0xA0761D6478BD642F)
            x ^= x >> U64(29)
            y = (x >> U64(21)) * U64(0xE7037ED1A0B428DB) | U64(1)
            return np.stack([(x + U64(i) * y) % U64(self.bits) for i in range(self.k)]).astype(np.int64)

    def has(self, keys):
        at = self._at(keys)
        return ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


class Cascade:
    """Levels in turn for listed keys (even) and others (odd)."""

    def __init__(self, levels):
        self.levels = levels

    @property
    def size_bytes(self):
        return sum(len(b.data) for b in self.levels)

    def listed(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        alive = np.arange(len(keys))
        for i, level in enumerate(self.levels):
            hit = level.has(keys[alive])
            out[alive[~hit]] = i % 2 == 1  # missed by a filter of the others: listed
            alive = alive[hit]
        out[alive] = len(self.levels) % 2 == 1  # the last level has no false positive
        return out


def _passing(levels):
    """Keys that every level so far takes for its own."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            ok = np.ones(len(keys), bool)
            for level in levels:
                ok[ok] = level.has(keys[ok])
            yield pa.RecordBatch.from_arrays([pa.array(keys[ok].view(np.int64))], names=["h"])

    return run


class Dealt:
    """Cascades of parts of the keys, dealt by remainder, for lists beyond one cascade's bound."""

    def __init__(self, cascades):
        self.cascades = cascades

    @property
    def size_bytes(self):
        return sum(c.size_bytes for c in self.cascades)

    def listed(self, keys: np.ndarray) -> np.ndarray:
        out, part = np.zeros(len(keys), bool), keys % U64(len(self.cascades))
        for i, cascade in enumerate(self.cascades):
            own = part == U64(i)
            out[own] = cascade.listed(keys[own])
        return out


def build(universe: DataFrame, listed: np.ndarray, most: int = 1 << 24):
    """Exact membership in ``listed`` for all keys of ``universe``, in parts of at most about
    ``most`` listed keys, each with a cascade of its own."""
    parts = 2 ** max(0, math.ceil(math.log2(max(1, len(listed)) / most)))
    if parts == 1:
        return build_cascade(universe, listed)
    remainder = F.col("h").bitwiseAND(F.lit(parts - 1))  # that of the key as an unsigned number
    return Dealt([build_cascade(universe.filter(remainder == i), listed[listed % U64(parts) == U64(i)]) for i in range(parts)])


def build_cascade(universe: DataFrame, listed: np.ndarray) -> Cascade:
    """One cascade: exact membership in ``listed`` (64-bit hashes) for all keys ``h`` of ``universe``.

    Each level's false positives, a few times the list at most, come to the driver.
    """
    listed = np.unique(listed)
    if not len(listed):
        return Cascade([])
    others = universe.count()
    rate = min(0.5, max(1e-9, len(listed) / max(1, others)))
    levels = [Bloom(listed, rate, 0)]
    while True:
        rows = universe.mapInArrow(_passing(levels), "h long")
        wrong = rows.count()
        if wrong - len(listed) <= 4 * len(listed) + 64:
            break
        rate /= 16  # an unlucky draw
        levels = [Bloom(listed, rate, levels[0].level + 2 * 1000)]
    found = np.array([r[0] for r in rows.toLocalIterator()], np.int64).view(np.uint64)
    false = np.setdiff1d(found, listed)
    own = listed
    while len(false):
        level = Bloom(false, 0.5, len(levels) + levels[0].level)
        levels.append(level)
        false, own = own[level.has(own)], false
    return Cascade(levels)


def _match(cascade):
    """Longest listed candidate of each row, found by the cascade alone."""

    def run(batches):
        levels = cascade.value
        for batch in batches:
            hashes, keys = batch.column(1), batch.column(2)
            offs = np.asarray(hashes.offsets)
            flat = np.asarray(hashes.values).view(np.int64)[offs[0] : offs[-1]].view(np.uint64)
            hit = levels.listed(flat)
            row = np.repeat(np.arange(batch.num_rows), np.diff(offs))
            names = keys.values.slice(offs[0], offs[-1] - offs[0])
            best: list = [None] * batch.num_rows
            for i in np.flatnonzero(hit):
                name = names[int(i)].as_py()
                r = row[i]
                if best[r] is None or (len(name), name) > (len(best[r]), best[r]):
                    best[r] = name
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string())], names=["row", "rule"])

    return run


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], most: int = 1 << 24) -> DataFrame:
    """The columns of ``pages`` given as struct ``row``, with host, path, rule and verdict.

    ``rules`` are (host, path, ``allow`` or ``block``). A url's longest listed key decides;
    without one it is not listed, hence allowed.

    A null url, or one without ``://``, has an empty host and path and fits no rule; an
    empty table gives no rows; repeated rows are judged alike; of rules given twice, the
    last counts; hosts and paths of any length cost time in proportion; other columns are
    carried along, whatever their names. ``most`` bounds the keys of one cascade.
    """
    action = {h + p: a for h, p, a in rules}
    lengths = sorted({len(p) for _, p, _ in rules}) or [0]
    labels = sorted({h.count(".") + 1 for h, _, _ in rules}) or [1]
    named = pages.select(F.struct(*pages.columns).alias("page"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = named.withColumn("keys", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(candidates(F.col("host"), F.col("path"), lengths, labels)))
    hashed = named.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))
    universe = checkpointed(hashed.select(F.explode("hashes").alias("h")).distinct())
    spark = pages.sparkSession
    listed = spark.createDataFrame([(k,) for k in action], "key string").select(F.xxhash64("key").alias("h"))
    cascade = build(universe, np.array([r.h for r in listed.collect()], np.int64).view(np.uint64), most)
    packed = hashed.select(F.struct("page", "host", "path").alias("row"), "hashes", "keys")
    schema = f"row {packed.schema['row'].dataType.simpleString()}, rule string"
    found = packed.mapInArrow(_match(spark.sparkContext.broadcast(cascade)), schema)
    blocked = [k for k, a in action.items() if a == "block"]
    verdict = F.when(F.col("rule").isin(blocked), "block").otherwise("allow") if blocked else F.lit("allow")
    return found.select(F.col("row.page").alias("page"), "row.host", "row.path", "rule", verdict.alias("verdict"))


#: The rules that the published query applies, stated with it.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
