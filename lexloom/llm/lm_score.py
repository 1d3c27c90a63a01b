"""Language-model scoring with a log-frequency Bloom filter of n-gram counts.

A count c is quantised to level 1 + floor(log_b c), and the n-gram enters the filter
once per level up to its own. Reading a count back is a run of membership probes that
stops at the first miss, so errors are one-sided: a count is never read too low.

The filter holds unigrams, bigrams, and for each context its total and its number of
distinct successors. A token's probability interpolates the bigram with the unigram
(Witten-Bell, the escape mass times ``ESCAPE``), each quantity from repeated probes.

Counting is a packed shuffle: a task pre-aggregates its n-grams and sends each bucket
one binary row. Filter segments are built where their counts meet; a segment's size
follows its number of events, so the error rate is the same at every input size. The
filter is broadcast while it fits ``max_filter_bytes``; beyond it, contexts are dealt
over several filters of at most that size (the unigram segments go with each), one
pass over the text each, whose log probabilities add up.

``base_score`` needs exact counts. The ``max_hot`` most frequent words, a table of
fixed size, are broadcast; all other tokens meet the exact counts in a shuffle.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.serializers import pickle_protocol

from lexloom.llm import bytescan as bs
from lexloom.llm.runtime import checkpointed, keys_of, row_key, shuffle_width, texts_in_small_batches

U64 = np.uint64
END = U64(0x5851F42D4C957F2D)
BEGIN = U64(0x14057B7EF767814F)
UNI, TOTAL, TYPES = U64(0x9FB21C651E98DF25), U64(0xB492B66FBE98F273), U64(0x8BB84B93962EACC9)
#: Quantisation base for unigrams and contexts, and for bigrams.
FINE, COARSE = 1.2, 1.5
PROBES = 4
BITS_PER_EVENT = 12
#: Times the Witten-Bell escape mass; high, as most bigrams of a corpus are new.
ESCAPE = 8.0
HIST = 4096
MAX_LEVEL = 255


def levels_of(counts: np.ndarray, base: float) -> np.ndarray:
    return (1 + np.floor(np.log(counts) / math.log(base) + 1e-9)).astype(np.int64)


def count_of_level(base: float) -> np.ndarray:
    """Count that stands for each level: the middle of the whole numbers it covers."""
    edge = np.ceil(np.minimum(base ** np.arange(MAX_LEVEL + 1) - 1e-9, 1e18))
    out = np.zeros(MAX_LEVEL + 1)
    out[1:] = (edge[:-1] + np.maximum(edge[1:] - 1, edge[:-1])) / 2
    return out


FINE_COUNT, COARSE_COUNT = count_of_level(FINE), count_of_level(COARSE)


def events(keys: np.ndarray, level: int, words: np.ndarray):
    """(64-bit word, mask of its PROBES bits) of the event (key, level), in ``words`` words."""
    with np.errstate(over="ignore"):
        x = bs.mix(keys + U64(level) * U64(0x9E3779B97F4A7C15))
    mask = np.zeros(len(x), np.uint64)
    for i in range(PROBES):
        mask |= U64(1) << ((x >> U64(6 * i)) & U64(63))
    return (((x >> U64(32)) * words) >> U64(32)).astype(np.int64), mask


def segment(keys: np.ndarray, levels: np.ndarray, bits: int = BITS_PER_EVENT) -> np.ndarray:
    """A filter of all (key, 1..level) events, as 64-bit words; an event's bits share one."""
    n = max(1, -(-int(levels.sum()) * bits // 64))
    out = np.zeros(n, np.uint64)
    for lv in range(1, int(levels.max(initial=0)) + 1):
        at, mask = events(keys[levels >= lv], lv, U64(n))
        np.bitwise_or.at(out, at, mask)
    return out


def _mark(size: int) -> bytes:
    """What precedes the content of a byte array of this size in a pickle."""
    return b"\x96" + size.to_bytes(8, "little")


#: Where the content starts in a file that holds one byte array only.
_PICKLED = pickle.dumps(bytearray(1 << 17), pickle_protocol).find(_mark(1 << 17)) + len(_mark(1 << 17))


def _copied(x: np.ndarray):
    return x.dtype.str.lstrip("<|"), len(x), lambda view: np.copyto(view, x)


def ship(spark, arrays):
    """A broadcast of one byte array that holds all arrays, and where each lies in it.

    ``arrays``: name -> (dtype, length, function that fills a view of that many zeros).
    """
    layout, used = {}, -_PICKLED % 8
    for name, (dtype, n, _) in arrays.items():
        layout[name] = (dtype, used, n)
        used += -(-n * np.dtype(dtype).itemsize // 8) * 8
    whole = bytearray(max(used, 1 << 17))
    views = _views(np.frombuffer(whole, np.uint8), layout)
    for name, (_, _, fill) in arrays.items():
        fill(views[name])
    views.clear()
    return spark.sparkContext.broadcast(whole), layout, len(whole)


def _views(raw, layout):
    return {name: raw[at : at + n * np.dtype(t).itemsize].view(t) for name, (t, at, n) in layout.items()}


def shipped(broadcast, layout, size):
    """The arrays, mapped from the executor's copy of the broadcast file where there is one.

    The Python workers of an executor then share one copy in the page cache; without a
    plain file (encrypted, or in the driver) the value is read as usual.
    """
    raw = None
    path = getattr(broadcast, "_path", None)
    if path:
        try:
            with open(path, "rb") as f:
                at = f.read(64).find(_mark(size))
            if at >= 0:
                raw = np.asarray(np.memmap(path, np.uint8, "r", offset=at + len(_mark(size)), shape=(size,)))
        except OSError:
            raw = None
    if raw is None:
        raw = np.frombuffer(broadcast.value, np.uint8)
    return _views(raw, layout)


class CountFilter:
    """Segments side by side; bucket b of a kind has ``size[b]`` words from ``at[b]``."""

    def __init__(self, data: np.ndarray, at: np.ndarray, size: np.ndarray):
        self.data, self.at, self.size = data, at, size

    def read(self, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Level of each key: one event probed after the other until one misses."""
        out = np.zeros(len(keys), np.int64)
        alive = np.flatnonzero(self.size[bucket] > 0)
        at, size = self.at[bucket[alive]], self.size[bucket[alive]].astype(np.uint64)
        for lv in range(1, MAX_LEVEL + 1):
            word, mask = events(keys[alive], lv, size)
            hit = (self.data[at + word] & mask) == mask
            alive, at, size = alive[hit], at[hit], size[hit]
            if not len(alive):
                break
            out[alive] = lv
        return out


def token_stream(data, offs):
    """Hashes of all tokens (words, then one end, per row), their contexts, row bounds."""
    words, rows = bs.word_hashes(data, offs)
    n = len(offs) - 1
    tok = np.empty(len(words) + n, np.uint64)
    bounds = rows + np.arange(n + 1)
    tok[bounds[1:] - 1] = END
    at = np.ones(len(tok), bool)
    at[bounds[1:] - 1] = False
    tok[at] = words
    ctx = np.empty_like(tok)
    ctx[1:] = tok[:-1]
    ctx[bounds[:-1]] = BEGIN
    return tok, ctx, bounds


def tail40(tok):
    return tok >> U64(24)


def pair_key(ctx, tok):
    with np.errstate(over="ignore"):
        return bs.mix(bs.mix(ctx) * U64(0xD6E8FEB86659FD93) + tail40(tok))


def tally(keys, weights):
    """(index of a first row of each key, summed weights)."""
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]]) if len(keys) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return order[at], (np.add.reduceat(weights[order], at) if len(at) else weights[:0])


NGRAMS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("head", "run", "key", "n"))])
NGRAMS_DDL = "kind int, bucket int, head binary, run binary, key binary, n binary"


def _groups(bucket, n):
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    return ((b, order[cuts[b] : cuts[b + 1]]) for b in range(n) if cuts[b] < cuts[b + 1])


def count_ngrams(buckets, flush=1 << 20):
    """Map side: unigrams by word, bigrams by context, summed within the task's block."""

    def run(batches):
        uni, bi, size = [], [], 0

        def emit():
            out = {c: [] for c in NGRAMS.names}

            def add(kind, b, head, run_, key, n):
                for c, v in zip(NGRAMS.names, (kind, b, head, run_, key, n)):
                    out[c].append(v)

            tok, n = (np.concatenate(x) for x in zip(*uni))
            at, n = tally(tok, n)
            tok = tok[at]
            for b, i in _groups((tok % U64(buckets)).astype(np.int64), buckets):
                add(0, b, b"", b"", tok[i].tobytes(), n[i].astype(np.uint32).tobytes())
            ctx, tok, key, n = (np.concatenate(x) for x in zip(*bi))
            at, n = tally(key, n)
            ctx, tok = ctx[at], tok[at]
            for b, i in _groups((ctx % U64(buckets)).astype(np.int64), buckets):
                i = i[np.argsort(ctx[i], kind="stable")]
                c = ctx[i]
                first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                low = np.ascontiguousarray(tail40(tok[i])).view(np.uint8).reshape(-1, 8)[:, :5]
                add(1, b, c[first].tobytes(), np.diff(np.append(first, len(c))).astype(np.uint32).tobytes(), low.tobytes(), n[i].astype(np.uint32).tobytes())
            return pa.RecordBatch.from_pydict(out, schema=NGRAMS)

        for batch in batches:
            for _, data, offs in bs.chunks(batch.column(0), 1 << 20):
                tok, ctx, _ = token_stream(data, offs)
                ones = np.ones(len(tok), np.int64)
                at, n = tally(tok, ones)
                uni.append((tok[at], n))
                key = pair_key(ctx, tok)
                at, n = tally(key, ones)
                bi.append((ctx[at], tok[at], key[at], n))
                size += len(at)
                if size >= flush:
                    yield emit()
                    uni, bi, size = [], [], 0
        if uni:
            yield emit()

    return run


#: Per kind and bucket: events' filter segment, and for words the exact counts.
MODEL = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("words", pa.int64()), ("total", pa.int64()), ("smooth", pa.float64()), *((c, pa.binary()) for c in ("hist", "filter", "key", "n"))])
MODEL_DDL = "kind int, bucket int, words long, total long, smooth double, hist binary, filter binary, key binary, n binary"


def build_bucket(bits):
    """Reduce side: exact counts of a bucket, and the filter segment that holds them."""
    return lambda table: _build_bucket(table, bits)


def _build_bucket(table: pa.Table, bits: int) -> pa.Table:
    kind, b = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
    col = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()])
    n = col("n", np.uint32).astype(np.int64)
    if kind == 0:
        tok = col("key", np.uint64)
        at, n = tally(tok, n)
        tok = tok[at]
        lv = levels_of(n, FINE)
        hist = np.bincount(np.minimum(n, HIST - 1), minlength=HIST)
        row = [0, b, len(tok), int(n.sum()), float(FINE_COUNT[lv].sum()), hist.astype(np.int64).tobytes(), segment(bs.mix(tok ^ UNI), lv, bits).tobytes(), tok.tobytes(), n.tobytes()]
    else:
        ctx = np.repeat(col("head", np.uint64), col("run", np.uint32))
        low = np.zeros((len(n), 8), np.uint8)
        low[:, :5] = col("key", np.uint8).reshape(-1, 5)
        with np.errstate(over="ignore"):
            key = bs.mix(bs.mix(ctx) * U64(0xD6E8FEB86659FD93) + low.view(np.uint64).ravel())
        at, n = tally(key, n)
        key, ctx = key[at], ctx[at]
        lv = levels_of(n, COARSE)
        head, mass = tally(ctx, np.stack([COARSE_COUNT[lv], np.ones(len(lv))], 1))
        heads = ctx[head]
        lt, ly = levels_of(np.maximum(mass[:, 0], 1), FINE), levels_of(mass[:, 1], FINE)
        seg = segment(np.concatenate([key, bs.mix(heads ^ TOTAL), bs.mix(heads ^ TYPES)]), np.concatenate([lv, lt, ly]), bits)
        row = [1, b, len(key), int(n.sum()), 0.0, b"", seg.tobytes(), b"", b""]
    return pa.Table.from_pydict({c: [v] for c, v in zip(MODEL.names, row)}, schema=MODEL)


PARTS = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("rows", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("bucket", pa.int32()), ("tokens", pa.binary()), ("owners", pa.binary()), ("rows_of", pa.binary())])
PARTS_DDL = "key binary, doc_id long, held_out boolean, rows long, n_tokens long, n_known long, base double, score double, bucket int, tokens binary, owners binary, rows_of binary"


def interpolated(seen, total, types, low):
    """Probability of a token: the bigram's share, ``types`` of the mass going to ``low``.

    A context without a type (never seen, whatever a stray probe says of its total) leaves
    the token to ``low``, so no probability is zero.
    """
    known = types > 0
    return np.where(known, (seen + types * low) / np.where(known, total + types, 1.0), low)


def score_texts(sent, floor, denom, buckets, opening):
    """Scores of every row; with ``opening``, also exact sums of hot words and the tail's tokens."""

    def run(batches):
        m = shipped(*sent)
        uni = CountFilter(m["uni"], m["uni_at"], m["uni_words"])
        bi = CountFilter(m["bi"], m["bi_at"], m["bi_words"])
        hot, hot_n = m["hot"], m["hot_n"]
        for batch in batches:
            keys, ids, held = (batch.column(i) for i in range(3))
            whole = keys_of(keys)
            tail_tok, tail_own = [], []
            for lo, data, offs in bs.chunks(batch.column(3), 1 << 20):
                tok, ctx, bounds = token_stream(data, offs)
                n = len(offs) - 1
                words, back = np.unique(tok, return_inverse=True)
                p1 = (FINE_COUNT[uni.read(bs.mix(words ^ UNI), (words % U64(buckets)).astype(np.int64))] + 0.1) / floor
                heads = np.append(words, BEGIN)  # a context is the token before, or the beginning
                hb = (heads % U64(buckets)).astype(np.int64)
                total = FINE_COUNT[bi.read(bs.mix(heads ^ TOTAL), hb)]
                types = FINE_COUNT[bi.read(bs.mix(heads ^ TYPES), hb)] * ESCAPE
                head = np.empty_like(back)
                head[1:] = back[:-1]
                head[bounds[:-1]] = len(words)
                seen = COARSE_COUNT[bi.read(pair_key(ctx, tok), hb[head])]
                p = interpolated(seen, np.maximum(total[head], seen), types[head], p1[back])
                score = bs.sums_by_row(np.where(m["mine"][hb[head]], np.log10(p), 0.0), bounds)
                out = {"key": keys[lo : lo + n], "doc_id": ids[lo : lo + n], "held_out": held[lo : lo + n], "rows": np.full(n, int(opening)), "score": score}
                zero = np.zeros(n, np.int64)
                if opening:
                    place = np.searchsorted(hot, words)
                    place[place == len(hot)] = 0
                    is_hot = hot[place] == words if len(hot) else np.zeros(len(words), bool)
                    c = np.where(is_hot, hot_n[place] if len(hot) else 0, 0)
                    base = np.where(is_hot, np.log10((c + 0.1) / denom), 0.0)
                    out |= {"n_tokens": np.diff(bounds), "n_known": bs.sums_by_row(is_hot[back].astype(float), bounds).round().astype(np.int64), "base": bs.sums_by_row(base[back], bounds)}
                    cold = np.flatnonzero(~is_hot[back])
                    tail_tok.append(tok[cold])
                    tail_own.append(lo + np.searchsorted(bounds, cold, side="right") - 1)
                else:
                    out |= {"n_tokens": zero, "n_known": zero, "base": zero.astype(float)}
                none = pa.nulls(n)
                yield pa.RecordBatch.from_arrays([pa.array(out[c], t) if c in out else none.cast(t) for c, t in zip(PARTS.names, PARTS.types)], schema=PARTS)
            if tail_tok:
                tok, own = np.concatenate(tail_tok), np.concatenate(tail_own)
                rows = []
                for b, i in _groups((tok % U64(buckets)).astype(np.int64), buckets):
                    named, place = np.unique(own[i], return_inverse=True)
                    rows.append((b, tok[i].tobytes(), place.astype(np.uint32).tobytes(), whole[named].tobytes()))
                if rows:
                    b, t, o, r = zip(*rows)
                    have = {"bucket": pa.array(b, pa.int32()), "tokens": pa.array(t, pa.binary()), "owners": pa.array(o, pa.binary()), "rows_of": pa.array(r, pa.binary())}
                    yield pa.RecordBatch.from_arrays([have.get(c, pa.nulls(len(rows)).cast(ty)) for c, ty in zip(PARTS.names, PARTS.types)], schema=PARTS)

    return run


def settle_tail(denom):
    """Exact sums of the tail's tokens in one bucket, one row per document there."""

    def run(table: pa.Table) -> pa.Table:
        col = lambda c, t: np.concatenate([np.zeros(0, t), *(np.frombuffer(x, t) for x in table.column(c).to_pylist() if x is not None)])
        word, n = col("word", np.uint64), col("n", np.int64)
        order = np.argsort(word)
        word, n = word[order], n[order]
        keys, known, base = [], [], []
        for t, o, r in zip(*(table.column(c).to_pylist() for c in ("tokens", "owners", "rows_of"))):
            if t is None:
                continue
            tok, own = np.frombuffer(t, np.uint64), np.frombuffer(o, np.uint32)
            c = np.zeros(len(tok), np.int64)
            if len(word):
                place = np.minimum(np.searchsorted(word, tok), len(word) - 1)
                c = np.where(word[place] == tok, n[place], 0)
            rows = len(r) // 16
            keys += [r[i : i + 16] for i in range(0, len(r), 16)]
            known.append(np.bincount(own[c > 0], minlength=rows))
            base.append(np.bincount(own, weights=np.log10((c + 0.1) / denom), minlength=rows))
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        return pa.Table.from_pydict({"key": pa.array(keys, pa.binary()), "n_known": join(known, np.int64), "base": join(base, float)})

    return run


def _rounds(sizes: dict[int, int], fixed: int, bound: int) -> list[list[int]]:
    """Context buckets grouped so that each group's segments fit beside the fixed ones."""
    out, used = [[]], 0
    for b, s in sorted(sizes.items()):
        if out[-1] and used + s > max(bound - fixed, 0):
            out.append([])
            used = 0
        out[-1].append(b)
        used += s
    return out


def _streamed(df: DataFrame, size: int):
    """Rows of ``df``, about ``size`` bytes in all, a few tasks' worth at a time."""
    return df.coalesce(max(1, min(64, size >> 24))).toLocalIterator()


def score_documents(docs: DataFrame, max_hot: int = 1 << 20, max_filter_bytes: int = 1 << 28, bits: int = BITS_PER_EVENT) -> DataFrame:
    """Base and model log10 probability of every text.

    Counts come from rows whose crc32(doc_id as text) mod 10 is not 0. Returns ``doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per row.

    A null text is empty and scores its end token only; a null doc_id is not held out and
    trains; repeated rows count and score separately; an empty table gives no rows (and a
    table without training rows gives every token probability one); other columns are
    ignored; very long texts and words are read whole, a chunk of rows at a time. Words are
    known by 64-bit hashes of their lower-cased bytes, rows by 128-bit ones. ``bits`` of the
    filter go to each event: more make stray reads rarer.
    """
    spark = docs.sparkSession
    texts_in_small_batches(spark)
    buckets = 4 * shuffle_width(spark)
    base = docs.select(
        row_key("doc_id", "text").alias("key"),
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False)).alias("held_out"),
        "text",
    )
    ngrams = base.filter(~F.col("held_out")).select("text").mapInArrow(count_ngrams(buckets), NGRAMS_DDL)
    built = checkpointed(ngrams.groupBy("kind", "bucket").applyInArrow(build_bucket(bits), MODEL_DDL))
    stats = built.filter("kind = 0").agg(F.sum("words"), F.sum("total"), F.sum("smooth")).first()
    vocab, train, smooth = (x or 0 for x in stats)
    denom, floor = train + 0.1 * (vocab + 1), smooth + 0.1 * (vocab + 1)

    hist = np.zeros(HIST, np.int64)
    for (h,) in _streamed(built.filter("kind = 0").select("hist"), buckets * HIST * 8):
        hist += np.frombuffer(h, np.int64)
    above = hist[::-1].cumsum()[::-1]  # words with at least so many occurrences
    fits = np.flatnonzero(above <= max_hot)
    least = int(fits[0]) if len(fits) else None
    hot_w, hot_n = [], []
    if least is not None:

        def pick(batches):
            for batch in batches:
                for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    n = np.frombuffer(n, np.int64)
                    yield pa.RecordBatch.from_pydict({"key": [np.frombuffer(k, np.uint64)[n >= least].tobytes()], "n": [n[n >= least].tobytes()]})

        for k, n in _streamed(built.filter("kind = 0").select("key", "n").mapInArrow(pick, "key binary, n binary"), 16 * max_hot):
            hot_w.append(np.frombuffer(k, np.uint64))
            hot_n.append(np.frombuffer(n, np.int64))
    hot = np.concatenate([np.zeros(0, np.uint64), *hot_w])
    order = np.argsort(hot)
    hot, hot_n = hot[order], np.concatenate([np.zeros(0, np.int64), *hot_n])[order]

    size = {(r.kind, r.bucket): r.size for r in _streamed(built.select("kind", "bucket", F.length("filter").alias("size")), 0)}

    def filters(kind, name, wanted):
        """The segments of these buckets, copied one by one into the broadcast's bytes."""
        at, words, used = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), 0
        for b in sorted(wanted):
            at[b], words[b] = used, size.get((kind, b), 0) // 8
            used += words[b]

        def fill(view):
            segments = built.filter((F.col("kind") == kind) & F.col("bucket").isin(sorted(wanted))).select("bucket", "filter")
            for b, seg in _streamed(segments, 8 * int(used)):
                view[at[b] : at[b] + words[b]] = np.frombuffer(seg, np.uint64)

        return {name: ("u8", used, fill), f"{name}_at": _copied(at), f"{name}_words": _copied(words)}

    scored = None
    fixed = sum(s for (k, _), s in size.items() if k == 0)
    for i, wanted in enumerate(_rounds({b: s for (k, b), s in size.items() if k == 1}, fixed, max_filter_bytes)):
        mine = np.zeros(buckets, bool)
        mine[wanted] = True
        if i == 0:
            mine[[b for b in range(buckets) if (1, b) not in size]] = True  # contexts never seen
        arrays = {"hot": _copied(hot), "hot_n": _copied(hot_n), "mine": _copied(mine)}
        sent = ship(spark, arrays | filters(0, "uni", range(buckets)) | filters(1, "bi", wanted))
        part = base.mapInArrow(score_texts(sent, floor, denom, buckets, i == 0), PARTS_DDL)
        scored = part if scored is None else scored.unionByName(part)
    scored = checkpointed(scored)

    tail = scored.filter("tokens is not null").select("bucket", "tokens", "owners", "rows_of")
    exact = built.filter("kind = 0").select("bucket", F.col("key").alias("word"), "n")
    met = tail.unionByName(exact, allowMissingColumns=True)
    settled = met.groupBy("bucket").applyInArrow(settle_tail(denom), "key binary, n_known long, base double")
    main = scored.filter("tokens is null").drop("bucket", "tokens", "owners", "rows_of")
    total = (
        main.unionByName(settled, allowMissingColumns=True)
        .groupBy("key")
        .agg(
            F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("rows").alias("rows"), F.sum("n_tokens").alias("n_tokens"),
            F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score"),
        )
    )
    each = lambda c: (F.col(c) / F.col("rows"))  # noqa: E731  repeated rows share a key
    return total.select(
        "doc_id", "held_out", each("n_tokens").cast("long").alias("n_tokens"), each("n_known").cast("long").alias("n_known"),
        F.lit(int(train)).cast("long").alias("train_tokens"), each("base").alias("base_score"), each("score").alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"),
    ).drop("copy")
