"""Quality: a factorisation machine over hashed words, structure and metadata.

score = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, the pair sum taken in linear
time as half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2). Features of a text:

* hashed words, each distinct one weighing 1 / sqrt(number of distinct words);
* structure statistics of the whole text, each falling into one of ``BINS`` intervals
  whose edges are quantiles of the training sample, a 0/1 feature per interval;
* metadata: the order of magnitude of ``n_chars`` (its own interval where it is null).

Edges, weights and factors come from a training sample bounded by ``max_rows``; every
document is scored over its whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import bytescan as bs
from lexloom.llm.labelled import fold, training_sample
from lexloom.llm.runtime import texts_in_small_batches
from lexloom.llm.toxicity import sigmoid

WORDS, BINS, META, RANK = 1 << 15, 12, 32, 6
STATS = 14
N = WORDS + STATS * BINS + META
EPOCHS, BATCH, RATE, RIDGE = 12, 256, 0.02, 2e-4


def _class(chars: bytes):
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER = _class(bytes(range(65, 91)))
LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
DIGIT = _class(b"0123456789")
STOP = _class(b".?!")
COMMA = _class(b",;:")
SYMBOL = _class(bytes(c for c in range(33, 127) if not LETTER[c] and not DIGIT[c] and chr(c) not in ".?!,;:'\"()-"))
NEWLINE = ~_class(b"\n")
LINE_BREAK = ~NEWLINE


def count(flag, offs):
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def distinct_share(ids, rows):
    """Distinct values over all values of each row; 1 for rows without any."""
    n = np.diff(rows)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((ids, row))
    new = np.ones(len(ids), bool)
    if len(ids):
        new[1:] = (ids[order][1:] != ids[order][:-1]) | (row[order][1:] != row[order][:-1])
    return np.bincount(row[order][new], minlength=len(n)) / np.maximum(n, 1) + (n == 0), row[order][new], ids[order][new]


def describe(data, offs):
    """(structure statistics, rows and buckets of distinct words) of a chunk's rows."""
    words, rows = bs.word_hashes(data, offs)
    starts, ends, _ = bs.word_spans(data, offs)
    n, size = np.diff(rows), np.diff(offs)
    share, row, word = distinct_share(words, rows)
    row_of = np.repeat(np.arange(len(n)), n)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (row_of[1:] == row_of[:-1])
    s, e, lines = bs.word_spans(data, offs, LINE_BREAK)
    line_share, _, _ = distinct_share(bs.span_hash(bs.prefix_hash(data), s, e), lines)
    n_lines = np.diff(lines)
    w, b = np.maximum(n, 1), np.maximum(size, 1)
    last = data[ends - 1] if len(ends) else data[:0]
    per_word = lambda flag: count(flag, rows) / w
    stats = np.stack(
        [
            np.log1p(n), size / w, share, count(again, rows) / w, line_share, np.log1p(n_lines), n / np.maximum(n_lines, 1),
            count(UPPER[data], offs) / b, count(LETTER[data], offs) / b, count(DIGIT[data], offs) / b, count(STOP[data], offs) / w,
            count(COMMA[data], offs) / w, count(SYMBOL[data], offs) / b, per_word(SYMBOL[last] | (last == 33)),
        ],
        axis=1,
    )
    return stats, row, (word % np.uint64(WORDS)).astype(np.int64)


def meta(n_chars):
    """Interval of the declared length; the last one stands for null."""
    x = n_chars.to_numpy(zero_copy_only=False).astype(float) if len(n_chars) else np.zeros(0)
    out = np.where(np.isnan(x), META - 1, np.clip(np.log2(np.maximum(np.nan_to_num(x), 1)), 0, META - 2))
    return out.astype(np.int64)


def features(stats, row, word, kind, edges):
    """Row, feature and value triples, ordered by row."""
    rows = np.arange(len(stats))
    weight = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(stats)), 1))
    r, c, v = [row, rows], [word, WORDS + STATS * BINS + kind], [weight[row], np.ones(len(rows))]
    for k in range(STATS):
        r.append(rows)
        c.append(WORDS + k * BINS + np.searchsorted(edges[k], stats[:, k], side="right"))
        v.append(np.ones(len(rows)))
    r, c, v = (np.concatenate(x) for x in (r, c, v))
    by = np.argsort(r, kind="stable")
    return r[by], c[by], v[by]


def margin(model, r, c, v, n):
    """Score before the sigmoid of n rows, in time linear in the number of features."""
    w0, w, factors = model
    z = w0 + np.bincount(r, weights=w[c] * v, minlength=n)
    for f in range(RANK):
        x = factors[c, f] * v
        z += 0.5 * (np.bincount(r, weights=x, minlength=n) ** 2 - np.bincount(r, weights=x * x, minlength=n))
    return z


def train(y, r, c, v, seed=11):
    """Weights by mini-batch Adam on the log loss; rows are visited in a seeded order."""
    rng = np.random.default_rng(seed)
    n = len(y)
    ptr = np.searchsorted(r, np.arange(n + 1))
    rate = (y.sum() + 1) / (n + 2)
    p = np.concatenate([[np.log(rate / (1 - rate))], np.zeros(N), rng.normal(0, 0.02, N * RANK)])
    m, s = np.zeros_like(p), np.zeros_like(p)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            pick = order[lo : lo + BATCH]
            k = len(pick)
            at = np.concatenate([np.arange(ptr[i], ptr[i + 1]) for i in pick])
            rr = np.repeat(np.arange(k), ptr[pick + 1] - ptr[pick])
            cols, back = np.unique(c[at], return_inverse=True)
            vv = v[at]
            w, fac = p[1 + cols], p[1 + N :].reshape(N, RANK)[cols]
            x = fac[back] * vv[:, None]
            sums = np.stack([np.bincount(rr, weights=x[:, f], minlength=k) for f in range(RANK)], 1)
            z = p[0] + np.bincount(rr, weights=w[back] * vv, minlength=k) + 0.5 * (sums**2).sum(1) - 0.5 * np.bincount(rr, weights=(x * x).sum(1), minlength=k)
            d = ((sigmoid(z) - y[pick]) / k)[rr]
            gw = np.bincount(back, weights=d * vv, minlength=len(cols)) + RIDGE * w
            gx = (sums[rr] - x) * (d * vv)[:, None]
            gf = np.stack([np.bincount(back, weights=gx[:, f], minlength=len(cols)) for f in range(RANK)], 1) + RIDGE * fac
            step += 1
            where = np.concatenate([[0], 1 + cols, (1 + N + cols[:, None] * RANK + np.arange(RANK)).ravel()])
            g = np.concatenate([[((sigmoid(z) - y[pick]) / k).sum()], gw, gf.ravel()])
            m[where] = 0.9 * m[where] + 0.1 * g
            s[where] = 0.99 * s[where] + 0.01 * g * g
            p[where] -= RATE * m[where] / (np.sqrt(s[where]) + 1e-8)
    return float(p[0]), p[1 : 1 + N], p[1 + N :].reshape(N, RANK)


def _describe_rows(batches):
    for batch in batches:
        y = batch.column(0).to_numpy()
        kinds = meta(batch.column(2))
        for lo, data, offs in bs.chunks(batch.column(1)):
            stats, row, word = describe(data, offs)
            cuts = np.searchsorted(row, np.arange(len(offs)))
            k = len(offs) - 1
            yield pa.RecordBatch.from_pydict(
                {"y": pa.array(y[lo : lo + k], pa.int32()), "kind": pa.array(kinds[lo : lo + k]), "stats": [s.tobytes() for s in stats], "words": [word[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]}
            )


def fit(sample: DataFrame):
    """(edges, model) from rows (y, text, n_chars) of bounded number."""
    rows = list(sample.mapInArrow(_describe_rows, "y int, kind long, stats binary, words binary").collect())
    rows.sort(key=lambda r: (r.stats, r.words, r.y))  # training does not depend on layout
    y = np.array([r.y for r in rows], float)
    stats = np.frombuffer(b"".join(r.stats for r in rows), float).reshape(-1, STATS)
    edges = [np.unique(np.quantile(stats[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.zeros(0) for k in range(STATS)]
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return edges, (float(np.log(rate / (1 - rate))), np.zeros(N), np.zeros((N, RANK)))
    words = [np.frombuffer(r.words, np.int32).astype(np.int64) for r in rows]
    row = np.repeat(np.arange(len(y)), [len(w) for w in words])
    return edges, train(y, *features(stats, row, np.concatenate(words), np.array([r.kind for r in rows]), edges))


def _score(model):
    def run(batches):
        edges, fm = model.value
        for batch in batches:
            kinds = meta(batch.column(3))
            z = np.zeros(batch.num_rows)
            for lo, data, offs in bs.chunks(batch.column(2)):
                k = len(offs) - 1
                z[lo : lo + k] = margin(fm, *features(*describe(data, offs), kinds[lo : lo + k], edges), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigmoid(z))], names=["doc_id", "held_out", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Trains on at most ``max_rows`` labelled rows whose crc32(doc_id as text) mod 4 is not
    2. A null or empty text has no words and the statistics of an empty text; a very long one
    is described whole; a null
    n_chars has an interval of its own; a null doc_id is scored, not held out, and never
    trains; repeated rows score alike; empty ``docs`` give no rows, and without labels of
    both classes the score is the smoothed rate of ones; other columns are ignored.
    """
    sample = training_sample(docs, labels, "quality", 4, 2, max_rows, "n_chars").select("y", "text", F.col("n_chars").cast("long").alias("n_chars"))
    texts_in_small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(sample))
    scored = docs.select("doc_id", fold(4, 2), "text", F.col("n_chars").cast("long").alias("n_chars"))
    scored = scored.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
