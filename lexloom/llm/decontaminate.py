"""Benchmark decontamination: approximate passages by CGK embedding and bit sampling.

Texts and benchmark items are sequences of lower-cased words (letters and digits). A
random walk maps a window to a longer sequence: at step j it writes the word under its
pointer and moves on if a random bit of (j, word) is set, so windows a few edits apart
fall back into step and agree in most places: edit distance becomes Hamming distance.
Bit sampling then keeps ``SAMPLED`` places of the walk as a key. ``ROUNDS`` independent
walks and samples are joined into one key: windows alike agree in all of them, windows
unlike seldom do.

The target is to meet every pair within the allowed edits. An item of n words with k edits
keeps a run of ceil((n - k) / (k + 1)) words or more as they were, wherever the edits fall.
An item's windows have at most that size, and texts and items are cut into windows at
every offset, so this run is a window of both and its keys agree whatever the coins. Each
meeting is verified by the exact edit distance, over words, between the whole item and the
best fitting run of the text around it.

The items' keys are broadcast in batches of at most ``MAX_ITEMS`` items; each batch is one
pass. No text is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import bytescan as bs

U64 = np.uint64
ROUNDS, SAMPLED, MAX_ITEMS = 3, 4, 50_000
SIMILARITY = 0.8
SIZES = (1, 2, 3, 4, 7, 14)
BLANK = U64(0x1234567)
_rng = np.random.Generator(np.random.PCG64(991))
COINS = _rng.integers(1, 2**63, (ROUNDS, 2 * SIZES[-1]), dtype=np.uint64) * U64(2) + U64(1)
#: Even steps only: neighbours often read one word twice.
PLACES = {L: np.stack([np.sort(_rng.choice(np.arange(0, max(1, 2 * L - 1), 2), SAMPLED, replace=L < SAMPLED)) for _ in range(ROUNDS)]) for L in SIZES}
GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words_of(data: np.ndarray, offs: np.ndarray):
    """(hashes of lower-cased words, row bounds); Latin-1 capitals are lowered as well."""
    low = data.copy()
    after = np.concatenate([[False], data[:-1] == 0xC3]) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    low[after] += 0x20
    return bs.word_hashes(low, offs, GAP)


def class_of(n: int, k: int) -> int:
    """Window size for an item of n words: at most the run that k edits leave whole."""
    return max(L for L in SIZES if L <= max(1, -(-(n - k) // (k + 1))))


def walk_keys(sym: np.ndarray, starts: np.ndarray, L: int) -> np.ndarray:
    """Keys of the windows sym[start : start + L] over all rounds; sym has 2 L words of padding."""
    end = starts + L
    key = np.full(len(starts), U64(L), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROUNDS):
            pos, places = starts.copy(), PLACES[L][r].tolist()
            for j in range(places[-1] + 1):
                cur = sym[pos]
                for _ in range(places.count(j)):
                    key = bs.mix(key * U64(0x9E3779B97F4A7C15) + np.where(pos < end, cur, BLANK))
                pos += ((cur * COINS[r, j]) >> U64(63)).astype(np.int64)
    return key


def edits_within(item: np.ndarray, text: np.ndarray) -> int:
    """Least edit distance between ``item`` and any run of ``text``."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, w in enumerate(item, 1):
        best = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (text != w)]))
        row = np.minimum.accumulate(best - steps) + steps
    return int(row.min())


class Items:
    """Keys of every window of every item, by size class, with what they stand for."""

    def __init__(self, ids, texts, similarity):
        arr = pa.array(texts, pa.large_string())
        self.ids, self.words, self.allow = list(ids), [], []
        at = {}
        for lo, data, offs in bs.chunks(arr):
            h, rows = words_of(data, offs)
            self.words += [h[a:b] for a, b in zip(rows[:-1], rows[1:])]
        for i, w in enumerate(self.words):
            self.allow.append(int(len(w) * (1 - similarity) + 1e-9))
            if len(w):
                L = class_of(len(w), self.allow[i])
                at.setdefault(L, []).append((i, w))
        self.tables, self.flat = {}, {}
        for L, members in at.items():
            sym = np.concatenate([*(w for _, w in members), np.zeros(2 * L + 1, np.uint64)])
            base = np.cumsum([0, *(len(w) for _, w in members)])
            of_item = np.zeros(len(self.ids), np.int64)
            of_item[[i for i, _ in members]] = base[:-1]
            self.flat[L] = sym, of_item
            starts = np.concatenate([base[k] + np.arange(len(w) - L + 1) for k, (_, w) in enumerate(members)])
            owner = np.concatenate([np.full(len(w) - L + 1, i) for i, w in members])
            shift = np.concatenate([np.arange(len(w) - L + 1) for _, w in members])
            key = walk_keys(sym, starts, L)
            by = np.argsort(key, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(key >> U64(44)).astype(np.int64)] = True
            self.tables[L] = seen, key[by], owner[by], shift[by]

    def find(self, data, offs):
        """(row, item, edits) of each row and item that meet within the allowed edits."""
        h, rows = words_of(data, offs)
        n = np.diff(rows)
        end = np.repeat(rows[1:], n)
        todo = set()
        allow = np.array(self.allow)
        for L, (seen, keys, owner, shift) in self.tables.items():
            starts = np.flatnonzero(np.arange(len(h)) + L <= end)
            sym = np.concatenate([h, np.zeros(2 * L + 1, np.uint64)])
            key = walk_keys(sym, starts, L)
            hit = np.flatnonzero(seen[(key >> U64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, key[hit], "left"), np.searchsorted(keys, key[hit], "right")
            many = hi - lo
            pick = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            met = np.stack([starts[np.repeat(hit, many)], owner[pick], shift[pick]], 1)
            item, base = self.flat[L]
            for lo in range(0, len(met), max(1, (1 << 20) // (L * L))):
                at, own, off = met[lo : lo + max(1, (1 << 20) // (L * L))].T
                text, part = h[at[:, None] + np.arange(L)], item[(base[own] + off)[:, None] + np.arange(L)]
                # Every word of the item's window that the text's lacks costs an edit.
                ok = (part[:, :, None] == text[:, None, :]).any(2).sum(1) >= L - allow[own]
                row = np.searchsorted(rows, at[ok], side="right") - 1
                todo.update(zip(row.tolist(), own[ok].tolist(), (at[ok] - off[ok]).tolist()))
        best = {}
        for row, item, begin in sorted(todo):
            k, w = self.allow[item], self.words[item]
            if best.get((row, item)) == 0:
                continue
            text = h[max(rows[row], begin - k) : min(rows[row + 1], begin + len(w) + k)]
            if np.isin(w, text).sum() < len(w) - k:  # each missing word costs an edit
                continue
            d = edits_within(w, text)
            if d <= k and d < best.get((row, item), d + 1):
                best[row, item] = d
        return best


_built: dict[int, Items] = {}


def _items(broadcast) -> Items:
    """The items' tables, built once in each Python worker."""
    if broadcast.id not in _built:
        _built.clear()
        _built[broadcast.id] = Items(*broadcast.value)
    return _built[broadcast.id]


class _Batch:
    """A broadcast with its number; the number tells a worker's tables apart."""

    def __init__(self, spark, value):
        self.sent = spark.sparkContext.broadcast(value)
        self.id = self.sent._jbroadcast.id()

    def __getstate__(self):
        return {"sent": self.sent, "id": self.id}

    @property
    def value(self):
        return self.sent.value


def _find_pairs(batch):
    def run(batches):
        items = _items(batch)
        for rows in batches:
            ids = rows.column(0).to_pylist()
            for lo, data, offs in bs.chunks(rows.column(1)):
                found = items.find(data, offs)
                out = [(ids[lo + r], items.ids[i], len(items.words[i]), d) for (r, i), d in found.items()]
                if out:
                    a, b, c, d = zip(*out)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(a, pa.int64()), "item_id": pa.array(b, pa.int64()), "item_words": pa.array(c, pa.int64()), "edits": pa.array(d, pa.int64())})

    return run


def _mark_rows(batch):
    def run(batches):
        items = _items(batch)
        for rows in batches:
            leak = np.zeros(rows.num_rows, bool)
            for lo, data, offs in bs.chunks(rows.column(0).field("text")):
                for r, _ in items.find(data, offs):
                    leak[lo + r] = True
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(leak)], names=["row", "leak"])
            del rows
            pa.default_memory_pool().release_unused()

    return run


def _batches(benchmark: DataFrame, similarity: float):
    """The items in batches of bounded size, each as a broadcast."""
    spark = benchmark.sparkSession
    parts = -(-benchmark.count() // MAX_ITEMS)
    for i in range(parts):
        rows = benchmark.select("item_id", "text").filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).toLocalIterator()
        pairs = [(r.item_id, r.text) for r in rows]
        yield _Batch(spark, ([p[0] for p in pairs], [p[1] for p in pairs], similarity))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, item_words, edits, similarity``: items found in each row's text.

    A pair is returned if the item's edit distance, over words, to some run of the text is
    at most (1 - similarity) of its words. Rows repeated are reported each; a null or empty
    text, and an item without words, match nothing; items of one word match exactly; null
    ids stay null; empty tables give no rows; other columns are ignored.
    """
    found = None
    for batch in _batches(benchmark, similarity):
        part = docs.select("doc_id", "text").mapInArrow(_find_pairs(batch), "doc_id long, item_id long, item_words long, edits long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, item_words long, edits long")
    return found.withColumn("similarity", 1 - F.col("edits") / F.col("item_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs`` in which no item is found, with all their columns."""
    for batch in _batches(benchmark, similarity):
        packed = docs.select(F.struct(*docs.columns).alias("row"))
        schema = f"row {packed.schema['row'].dataType.simpleString()}, leak boolean"
        docs = packed.mapInArrow(_mark_rows(batch), schema).filter("not leak").select("row.*")
    return docs
