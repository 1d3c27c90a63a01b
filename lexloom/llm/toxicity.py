"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes ratios.

Each hashed n-gram is a 0/1 feature of a document, multiplied by its log-count ratio
r = log(P(n-gram | toxic) / P(n-gram | clean)); logistic regression on the scaled
features decides (NB-SVM). Only n-grams that occur in ``MIN_DF`` training rows with a
ratio of at least ``MIN_RATIO`` in size carry weight, which keeps the score of a long
text free of the noise of thousands of neutral n-grams.

Ratios and weights come from a training sample bounded by ``max_rows``; every document
is scored over its whole text, vectorised over code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import bytescan as bs
from lexloom.llm.labelled import fold, training_sample
from lexloom.llm.runtime import texts_in_small_batches

ORDERS = (3, 4, 5, 6)
BITS = 20
RANGES = 64
MIN_DF, MIN_RATIO = 4, 1.0
#: ``LIFT`` weighs the rarer toxic rows in the loss.
EPOCHS, RATE, RIDGE, LIFT = 80, 0.05, 5e-3, 4.0
U32 = np.uint32


def code_points(data: np.ndarray, offs: np.ndarray):
    """Lower-cased code points of a chunk's rows, each between spaces, and row bounds."""
    x = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), U32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    cuts = heads[offs]
    n = len(offs) - 1
    out = np.full(len(x) + 2 * n, 32, U32)
    bounds = cuts + 2 * np.arange(n + 1)
    inside = np.ones(len(out), bool)
    inside[bounds[:-1]] = False
    inside[bounds[1:] - 1] = False
    upper = ((x >= 65) & (x <= 90)) | ((x >= 0xC0) & (x <= 0xDE) & (x != 0xD7))
    out[inside] = np.where(x < 32, U32(32), x + upper.astype(U32) * U32(32))
    return out, bounds


def grams(x: np.ndarray):
    """(order, bucket of the n-gram at each position), for each order."""
    with np.errstate(over="ignore"):
        c = (x + U32(1)) * U32(0x9E3779B1)
        c ^= c >> U32(15)
        g = c
        for n in range(2, max(ORDERS) + 1):
            if len(x) < n:
                return
            g = g[:-1] * U32(0x01000193 * 4 + 1) + c[n - 1 :]
            if n in ORDERS:
                h = (g ^ (g >> U32(16))) * U32(0x85EBCA6B)
                yield n, h >> U32(32 - BITS)


def row_features(data, offs, active=None):
    """Distinct (row, bucket) pairs of a chunk, as row * 2**BITS + bucket."""
    x, bounds = code_points(data, offs)
    out = [np.zeros(0, np.int64)]
    for n, b in grams(x):
        at = np.arange(len(b)) if active is None else np.flatnonzero(active[b])
        row = np.searchsorted(bounds, at, side="right") - 1
        ok = at + n <= bounds[row + 1]
        out.append(np.unique((row[ok] << BITS) + b[at[ok]]))
    return np.unique(np.concatenate(out))


def _frequencies(batches):
    counts = np.zeros((2, 1 << BITS), np.int32)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        y = batch.column(0).to_numpy()
        for lo, data, offs in bs.chunks(batch.column(1), 1 << 19):
            own = y[lo : lo + len(offs) - 1]
            rows += np.bincount(own, minlength=2)
            f = row_features(data, offs)
            label = own[f >> BITS]
            for k in (0, 1):
                np.add.at(counts[k], f[label == k] & ((1 << BITS) - 1), 1)
    if rows.any():
        each = counts.reshape(2, RANGES, -1)
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([-1, *range(RANGES)], pa.int32()), "clean": [rows[:1].tobytes(), *(x.tobytes() for x in each[0])], "toxic": [rows[1:].tobytes(), *(x.tobytes() for x in each[1])]}
        )


def _sum_range(table: pa.Table) -> pa.Table:
    part = table.column("part")[0].as_py()
    total = [sum(np.frombuffer(x, np.int64 if part < 0 else np.int32).astype(np.int64) for x in table.column(c).to_pylist()) for c in ("clean", "toxic")]
    return pa.Table.from_pydict({"part": pa.array([part], pa.int32()), "clean": [total[0].tobytes()], "toxic": [total[1].tobytes()]})


def _active_features(active):
    """Labels, numbers of active features and the features of a chunk's rows, packed."""

    def run(batches):
        number = np.cumsum(active.value, dtype=np.int32) - 1
        for batch in batches:
            y = batch.column(0).to_numpy()
            for lo, data, offs in bs.chunks(batch.column(1)):
                f = row_features(data, offs, active.value)
                count = np.bincount(f >> BITS, minlength=len(offs) - 1).astype(np.int32)
                own = y[lo : lo + len(offs) - 1].astype(np.int8)
                yield pa.RecordBatch.from_pydict({"y": [own.tobytes()], "n": [count.tobytes()], "f": [number[f & ((1 << BITS) - 1)].tobytes()]})

    return run


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(sample: DataFrame):
    """(weight of each bucket, intercept) from rows (y, text) of bounded number.

    With one class only, or no rows, all weights are zero and the intercept is the
    smoothed rate (one in ten without any row, so that nothing is rejected then).
    """
    spark = sample.sparkSession
    sums = sample.mapInArrow(_frequencies, "part int, clean binary, toxic binary").groupBy("part").applyInArrow(_sum_range, "part int, clean binary, toxic binary")
    counts, rows = np.zeros((2, 1 << BITS), np.int32), np.zeros(2)
    width = (1 << BITS) // RANGES
    for part, clean, toxic in sums.collect():
        for k, x in enumerate((clean, toxic)):
            if part < 0:
                rows[k] = np.frombuffer(x, np.int64)[0]
            else:
                counts[k, part * width : (part + 1) * width] = np.frombuffer(x, np.int64)
    weights, b = np.zeros(1 << BITS, np.float32), float(np.log((rows[1] + 1) / (rows[0] + 9)))
    if not rows.all():
        return weights, b
    ids = np.flatnonzero(counts[0] + counts[1] >= MIN_DF)
    ratio = np.log((counts[1, ids] + 1) / (rows[1] + 2)) - np.log((counts[0, ids] + 1) / (rows[0] + 2))
    ids, ratio = ids[np.abs(ratio) >= MIN_RATIO], ratio[np.abs(ratio) >= MIN_RATIO]
    del counts
    active = np.zeros(1 << BITS, bool)
    active[ids] = True
    sent = spark.sparkContext.broadcast(active)
    packed = sample.mapInArrow(_active_features(sent), "y binary, n binary, f binary").collect()
    blocks = [(np.frombuffer(r.y, np.int8), np.frombuffer(r.n, np.int32), np.frombuffer(r.f, np.int32)) for r in packed]
    sent.destroy()
    weights[ids], b = _train(blocks, ratio, b)
    return weights, b


def _train(blocks, r, b):
    """Full-batch Adam on the log loss with a ridge; the rows are visited block by block."""
    total = sum(len(y) for y, _, _ in blocks)
    w = np.zeros(len(r) + 1)
    w[-1] = b
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, EPOCHS + 1):
        scaled, grad = w[:-1] * r, np.zeros_like(w)
        for y, n, col in blocks:
            row = np.repeat(np.arange(len(y)), n)
            z = np.bincount(row, weights=scaled[col], minlength=len(y)) + w[-1]
            d = (sigmoid(z) - y) * np.where(y == 1, LIFT, 1.0) / total
            grad[:-1] += np.bincount(col, weights=d[row], minlength=len(r))
            grad[-1] += d.sum()
        grad[:-1] = grad[:-1] * r + RIDGE * w[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w[:-1] * r, float(w[-1])


def _score(model):
    """Scores of rows that end in their text, or of structs with a field of that name."""

    def run(batches):
        weights, b = model.value
        active = weights != 0
        for batch in batches:
            packed = batch.schema.names == ["row"]
            text = batch.column(0).field("text") if packed else batch.column(batch.num_columns - 1)
            z = np.full(batch.num_rows, b)
            for lo, data, offs in bs.chunks(text, 1 << 20):
                f = row_features(data, offs, active)
                z[lo : lo + len(offs) - 1] += np.bincount(f >> BITS, weights=weights[f & ((1 << BITS) - 1)], minlength=len(offs) - 1)
            rest = batch.columns if packed else batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sigmoid(z))], names=[*batch.schema.names[: len(rest)], "score"])
            del batch, text, rest
            pa.default_memory_pool().release_unused()

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 12000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Trains on at most ``max_rows`` labelled rows whose crc32(doc_id as text) mod 5 is not
    0. A null or empty text has no n-grams and scores by the intercept, a very long one by all
    of its n-grams; a null doc_id is
    scored, not held out, and never trains; repeated rows score alike; empty ``docs`` give
    no rows, and without labels of both classes the score is the smoothed rate of ones;
    other columns are ignored.
    """
    texts_in_small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(training_sample(docs, labels, "toxic", 5, 0, max_rows)))
    scored = docs.select("doc_id", fold(5, 0), "text").mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, max_rows: int = 12000) -> DataFrame:
    """Rows of ``docs`` that are not predicted toxic, with all their columns.

    The text is scored inside its own row, so nothing is joined back.
    """
    texts_in_small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(training_sample(docs, labels, "toxic", 5, 0, max_rows)))
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    schema = f"row {packed.schema['row'].dataType.simpleString()}, score double"
    scored = packed.mapInArrow(_score(model), schema)
    return scored.filter("score < 0.5").select("row.*")
