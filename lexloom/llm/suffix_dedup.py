"""Removal of repeated passages by a depth-limited radix sort of suffixes.

A suffix is ordered only through its first ``depth`` bytes, most significant digit first,
and a group of one suffix is not looked at again. Equal groups at full depth are exactly
the windows of ``depth`` bytes that start more than once.

Ordering every suffix would shuffle many times the text, so suffixes are ordered in spans.
Each window elects one of its ``digit``-byte substrings: the one with the smallest hash, the
leftmost on ties. Equal windows elect the same substring at the same offset, hence no equal
pair is lost, while only about one position in ``(depth - digit) / 2`` is elected; the
windows that elected a position are consecutive, its span.

* Pass 1 deals spans by their content. Equal spans settle all of their windows at once;
  those met within a task are merged there, so a passage that fills the corpus sends one
  row a task. The first digit then groups what differs: a digit with one span is finished.
* Pass 2 looks at the spans of unfinished digits only. Their windows are ordered digit by
  digit through ``depth``, and at the end equal groups are compared byte by byte. A digit
  with more than ``hot`` spans (a passage in very many contexts) is not gathered: its
  windows are dealt one by one, by content and merged within tasks like the spans of pass 1.

Unfinished and hot digits reach the scan as bitmaps of fixed size: a false positive ships
spans that settle nothing, or deals windows one by one, and never changes a result.

Spans, and windows dealt one by one, are told apart by 128 bits of BLAKE2b of their bytes;
the quicker polynomial hashes only elect and group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import bytescan as bs
from lexloom.llm.runtime import checkpointed, keys_of, row_key, shuffle_width, texts_in_small_batches

U64 = np.uint64
ID = np.dtype([("hi", "<u8"), ("lo", "<u8")])
#: Windows elected at once, windows ordered at once, and spans of a digit that are ordered together.
BLOCK, ORDERED, HOT = 1 << 21, 1 << 17, 128


def elected(data: np.ndarray, depth: int, digit: int):
    """Elected positions of one text: (digit's hash, position, first window, last window)."""
    prefix = bs.prefix_hash(data)
    n = len(data) - digit + 1
    at = np.arange(n)
    h = bs.mix(bs.span_hash(prefix, at, at + digit))
    width = depth - digit + 1
    order = (h & ~U64((1 << 24) - 1)) | at.astype(np.uint64)  # smallest hash, then leftmost
    pad = -n % width
    blocks = np.concatenate([order, np.full(pad, ~U64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - width + 1
    best = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & U64((1 << 24) - 1)
    change = np.flatnonzero(np.diff(best)) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change, [windows]]) - 1
    pos = best[first].astype(np.int64)
    return h[pos], pos, first, last


def pieces(data: np.ndarray, depth: int, block: int):
    """(offset, bytes) of runs of at most ``block`` windows that cover all windows of a text."""
    for lo in range(0, len(data) - depth + 1, block):
        yield lo, data[lo : lo + block + depth - 1]


def digests(data: np.ndarray, starts, ends, marks) -> np.ndarray:
    """128-bit identity of each [start, end) of ``data`` together with its mark."""
    view, blake = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    salt = [int(m).to_bytes(8, "little") for m in marks]
    return np.frombuffer(b"".join([blake(view[a:b], digest_size=16, salt=m).digest() for a, b, m in zip(starts.tolist(), ends.tolist(), salt)]), ID)


def span_ids(data, pos, first, last, depth):
    """Identity of each span: its bytes and the elected position's place in it."""
    return digests(data, first, last + depth, pos - first)


def _texts(batch: pa.RecordBatch, depth: int):
    keys = keys_of(batch.column(0))
    for lo, data, offs in bs.chunks(batch.column(1), 1 << 20):
        for i in np.flatnonzero(np.diff(offs) >= depth):
            yield keys[lo + i], data[offs[i] : offs[i + 1]]


def _by_bucket(bucket: np.ndarray, n: int):
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in range(n):
        if cuts[b] < cuts[b + 1]:
            yield b, order[cuts[b] : cuts[b + 1]]


#: Rows of one bucket, packed. Buckets up to B hold spans by digit, up to 2 B spans or windows
#: by identity, and up to 3 B windows that repeat, on their way through.
PACKED = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("id", "digit", "many", "key", "start", "n", "bytes"))])
PACKED_DDL = "bucket int, id binary, digit binary, many binary, key binary, start binary, n binary, bytes binary"
#: ``kind`` 0: windows known to repeat (key, first, count); 1: digits and their numbers of spans.
FOUND = pa.schema([("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
FOUND_DDL = "kind int, a binary, b binary, c binary"


def _rows(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: [r.get(c, b"") if c != "bucket" else r[c] for r in rows] for c in PACKED.names}, schema=PACKED)


def _same_id(ids: np.ndarray):
    """(order by identity, start of each group in it)."""
    order = np.lexsort((ids["lo"], ids["hi"]))
    x = ids[order]
    return order, np.concatenate([np.ones(min(1, len(x)), bool), (x["hi"][1:] != x["hi"][:-1]) | (x["lo"][1:] != x["lo"][:-1])])


def runs_of(key: np.ndarray, start: np.ndarray, n: np.ndarray):
    """(key, start, n) with windows that follow each other in a row as one run."""
    ids = np.ascontiguousarray(key).view(ID)
    by = np.lexsort((start, ids["lo"], ids["hi"]))
    key, ids, start, n = key[by], ids[by], start[by].astype(np.int64), n[by].astype(np.int64)
    new = np.ones(len(by), bool)
    new[1:] = (ids["hi"][1:] != ids["hi"][:-1]) | (ids["lo"][1:] != ids["lo"][:-1]) | (start[1:] != start[:-1] + n[:-1])
    at = np.flatnonzero(new)
    total = np.add.reduceat(n, at) if len(at) else n
    return key[at], start[at].astype(np.uint32), total.astype(np.uint32)


def merged(held, buckets: int):
    """Rows of a task's block: one of each identity, and windows that repeat inside the block.

    ``held``: lists of (digit, id, key, start, n).
    """
    g, ids, key, start, n = (np.concatenate(x) for x in zip(*held))
    order, new = _same_id(ids)
    size = np.diff(np.append(np.flatnonzero(new), len(ids)))
    again = order[np.repeat(size, size) > 1]
    one = order[new]
    for b, i in _by_bucket((ids["lo"][one] % U64(buckets)).astype(np.int64), buckets):
        at = one[i]
        yield {"bucket": buckets + b, "id": ids[at].tobytes(), "digit": g[at].tobytes(), "many": (size[i] > 1).astype(np.uint8).tobytes(), "key": key[at].tobytes(), "start": start[at].tobytes(), "n": n[at].tobytes()}
    if len(again):
        known, first, count = runs_of(key[again], start[again], n[again])
        yield {"bucket": 2 * buckets + int(ids["hi"][again[0]] % U64(buckets)), "key": known.tobytes(), "start": first.tobytes(), "n": count.tobytes()}


def scan_digits(depth, digit, buckets, block, flush=1 << 18):
    """Pass 1, map side: the spans of all windows, merged and packed by identity."""

    def run(batches):
        held, count = [], 0
        for batch in batches:
            for key, text in _texts(batch, depth):
                for lo, data in pieces(text, depth, block):
                    h, pos, first, last = elected(data, depth, digit)
                    held.append((h, span_ids(data, pos, first, last, depth), np.full(len(h), key), (first + lo).astype(np.uint32), (last - first + 1).astype(np.uint32)))
                    count += len(h)
                if count >= flush:
                    yield _rows(list(merged(held, buckets)))
                    held, count = [], 0
                    bs.release()
        if held:
            yield _rows(list(merged(held, buckets)))
        del held
        bs.release()

    return run


def _unpack(table: pa.Table, **kinds):
    return [np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in kinds.items()]


def _found(rows) -> pa.Table:
    return pa.Table.from_pydict({c: [r[i] for r in rows] for i, c in enumerate(FOUND.names)}, schema=FOUND)


def settle_ids(table: pa.Table, buckets: int) -> pa.Table:
    """One bucket by identity: what came more than once repeats; digits count their spans."""
    key, start, n = _unpack(table, key="V16", start=np.uint32, n=np.uint32)
    if table.column("bucket")[0].as_py() >= 2 * buckets:
        return _found([(0, key.tobytes(), start.tobytes(), n.tobytes())])
    ids, g, many = _unpack(table, id=ID, digit=U64, many=np.uint8)
    order, new = _same_id(ids)
    group = np.cumsum(new) - 1
    again = (np.bincount(group)[group] > 1) & (many[order] == 0)  # a merged row's windows are known
    at = order[again]
    digits, spans = np.unique(g[order[new]], return_counts=True)
    known, first, count = runs_of(key[at], start[at], n[at])
    return _found([(0, known.tobytes(), first.tobytes(), count.tobytes()), (1, digits.tobytes(), spans.astype(np.uint32).tobytes(), b"")])


def _settled(buckets):
    def run(table: pa.Table) -> pa.Table:
        found = settle_ids(table, buckets)
        del table
        bs.release()
        return found

    return run


COUNTED = pa.schema([("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


def _deal_digits(buckets):
    def run(batches):
        for batch in batches:
            a, b = (np.concatenate([np.zeros(0, t), *(np.frombuffer(x, t) for x in batch.column(i).to_pylist())]) for i, t in ((0, U64), (1, np.uint32)))
            rows = [(k, a[i].tobytes(), b[i].tobytes()) for k, i in _by_bucket((a % U64(buckets)).astype(np.int64), buckets)]
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(COUNTED.names, zip(*rows))), schema=COUNTED)

    return run


def _unfinished(hot):
    """Digits with more than one span, and of these the ones with more than ``hot``."""

    def run(table: pa.Table) -> pa.Table:
        digit, spans = _unpack(table, a=U64, b=np.uint32)
        each, at = np.unique(digit, return_inverse=True)
        total = np.bincount(at, weights=spans)
        return pa.Table.from_pydict({"several": [each[total > 1].tobytes()], "hot": [each[total > hot].tobytes()]})

    return run


def _slots(digits, mask):
    slot = bs.mix(digits) & mask
    return (slot >> U64(3)).astype(np.int64), (slot & U64(7)).astype(np.uint8)


def _bitmaps(sizes: DataFrame, max_bytes: int) -> np.ndarray:
    """Rows 0 and 1: unfinished and hot digits, each a bitmap of at most ``max_bytes``."""
    total = sizes.agg(F.sum(F.length("several"))).first()[0] or 0
    size = 1 << 10
    while size < min(max_bytes, 2 * total):
        size *= 2
    mask = U64(size * 8 - 1)

    def local(batches):
        own = np.zeros((2, size), np.uint8)
        for batch in batches:
            for i in (0, 1):
                for x in batch.column(i).to_pylist():
                    byte, bit = _slots(np.frombuffer(x, U64), mask)
                    np.bitwise_or.at(own[i], byte, np.uint8(1) << bit)
        yield pa.RecordBatch.from_pydict({"bits": [own.tobytes()]})

    bits = np.zeros((2, size), np.uint8)
    for row in sizes.coalesce(4).mapInArrow(local, "bits binary").toLocalIterator():
        bits |= np.frombuffer(row[0], np.uint8).reshape(2, -1)
    return bits


def scan_spans(depth, digit, buckets, block, bitmaps, flush=1 << 22):
    """Pass 2, map side: the spans of unfinished digits, one of each kind from a task's block,
    and the windows of hot digits."""

    def run(batches):
        several, hot = bitmaps.value
        mask = U64(len(several) * 8 - 1)
        held, size, seen, windows, count = {}, 0, set(), [], 0

        def emit():
            rows = []
            for b, x in held.items():
                g, ids, key, start, n, raw = zip(*x)
                rows.append({"bucket": b, "id": b"".join(ids), "digit": np.array(g, U64).tobytes(), "key": b"".join(key), "start": np.array(start, np.uint32).tobytes(), "n": np.array(n, np.uint32).tobytes(), "bytes": b"".join(raw)})
            return _rows([*rows, *(merged(windows, buckets) if windows else ())])

        for batch in batches:
            for key, text in _texts(batch, depth):
                for lo, data in pieces(text, depth, block):
                    h, pos, first, last = elected(data, depth, digit)
                    byte, bit = _slots(h, mask)
                    todo = ((several[byte] >> bit) & 1).astype(bool)
                    one_by_one = ((hot[byte] >> bit) & 1).astype(bool)
                    at = np.flatnonzero(todo & ~one_by_one)
                    ids = span_ids(data, pos[at], first[at], last[at], depth)
                    for i, x in zip(at.tolist(), ids):
                        x = x.tobytes()
                        if x not in seen:
                            seen.add(x)
                            f, e = int(first[i]), int(last[i])
                            held.setdefault(int(h[i]) % buckets, []).append((h[i], x, key.tobytes(), f + lo, e - f + 1, data[f : e + depth].tobytes()))
                            size += e - f + depth + 200
                    at = np.flatnonzero(todo & one_by_one)
                    if len(at):
                        many = last[at] - first[at] + 1
                        w = np.repeat(first[at], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                        none = np.zeros(len(w), U64)
                        windows.append((none, digests(data, w, w + depth, none), np.full(len(w), key), (w + lo).astype(np.uint32), np.ones(len(w), np.uint32)))
                        count += len(w)
                if size + 48 * count >= flush:
                    yield emit()
                    held, size, windows, count = {}, 0, [], 0
                    bs.release()
                    if len(seen) > 1 << 18:
                        seen = set()
        if held or windows:
            yield emit()
        held, windows, seen = {}, [], set()
        bs.release()

    return run


def repeated_rows(text: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int, digit: int) -> np.ndarray:
    """Marks the windows text[at : at + depth] that equal another one of their group.

    Most significant digit first; a window alone in its group after a digit is dropped. What
    is left is compared with its neighbour byte by byte.
    """
    out = np.zeros(len(at), bool)
    prefix = bs.prefix_hash(text)
    left, g = np.arange(len(at)), bs.mix(group)
    for lo in range(0, depth, digit):
        x = at[left]
        w = bs.mix(g ^ bs.span_hash(prefix, x + lo, x + min(depth, lo + digit)))
        by = np.argsort(w)
        w, left = w[by], left[by]
        same = np.concatenate([[False], w[1:] == w[:-1], [False]])
        alive = same[1:] | same[:-1]
        left, g = left[alive], w[alive]
        if not len(left):
            return out
    # Neighbours of equal groups: all bytes, eight at a time.
    head = np.concatenate([[True], g[1:] != g[:-1]])
    first = left[np.flatnonzero(head)[np.cumsum(head) - 1]]
    eight = bs.lanes(text)
    equal = group[left] == group[first]
    for lo in range(0, depth, 8):
        part = bs.MASKS[min(8, depth - lo)]
        equal &= (eight[at[left] + lo] & part) == (eight[at[first] + lo] & part)
    size = np.diff(np.append(np.flatnonzero(head), len(left)))
    pure = np.repeat(np.add.reduceat(equal, np.flatnonzero(head)) == size, size)
    out[left[pure]] = True
    if not pure.all():  # groups that only hashes hold together: by their bytes
        kinds: dict = {}
        for i in left[~pure].tolist():
            kinds.setdefault((int(group[i]), text[at[i] : at[i] + depth].tobytes()), []).append(i)
        for same_bytes in kinds.values():
            out[same_bytes] = len(same_bytes) > 1
    return out


def settle_spans(depth, digit, block):
    """Pass 2, one bucket: windows of different spans of a digit, compared to full depth."""

    def run(table: pa.Table) -> pa.Table:
        ids, g, key, start, n = _unpack(table, id=ID, digit=U64, key="V16", start=np.uint32, n=np.uint32)
        n = n.astype(np.int64)
        length = n + depth - 1
        blob = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("bytes").to_pylist()])
        begin = np.cumsum(length) - length
        order, new = _same_id(ids)
        rep = order[new]  # one of each span
        rep = rep[np.argsort(g[rep], kind="stable")]
        size = np.bincount(np.unique(g[rep], return_inverse=True)[1])
        rep = rep[np.repeat(size, size) > 1]
        rows, cut = [], 0
        while cut < len(rep):  # whole digits, about ``block`` windows at a time
            end = cut + max(1, int(np.searchsorted(np.cumsum(n[rep[cut:]]), block)))
            while end < len(rep) and g[rep[end]] == g[rep[end - 1]]:
                end += 1
            part = rep[cut:end]
            cut = end
            count = n[part]
            of = np.repeat(np.arange(len(part)), count)
            step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            text = np.concatenate([blob[begin[i] : begin[i] + length[i]] for i in part])
            base = np.cumsum(length[part]) - length[part]
            hit = np.flatnonzero(repeated_rows(text, base[of] + step, g[part][of], depth, digit))
            if len(hit):  # runs of neighbouring windows of one span
                brk = np.concatenate([[True], (np.diff(hit) > 1) | (of[hit][1:] != of[hit][:-1])])
                lo, hi = hit[brk], hit[np.concatenate([brk[1:], [True]])]
                rows.append((0, key[part][of[lo]].tobytes(), (start[part][of[lo]] + step[lo]).astype(np.uint32).tobytes(), (hi - lo + 1).astype(np.uint32).tobytes()))
        return _found(rows)

    return run


WINDOWS_DDL = "key binary, first long, windows long"


def _windows(rows) -> pa.Table:
    """(key, first, windows) of packed rows (key, first, windows)."""
    a, b, c = (b"".join(x) for x in zip(*rows)) if rows else (b"", b"", b"")
    keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(a) // 16, [None, pa.py_buffer(a)]).cast(pa.binary())
    return pa.Table.from_arrays([keys, *(pa.array(np.frombuffer(x, np.uint32).astype(np.int64)) for x in (b, c))], names=["key", "first", "windows"])


def settle_refined(depth, digit, buckets, block):
    """Pass 2, one bucket of any kind: its repeated windows, unpacked."""
    spans = settle_spans(depth, digit, block)

    def run(table: pa.Table) -> pa.Table:
        found = spans(table) if table.column("bucket")[0].as_py() < buckets else settle_ids(table, buckets)
        rows = [(r["a"], r["b"], r["c"]) for r in found.to_pylist() if r["kind"] == 0]
        del table, found
        bs.release()
        return _windows(rows)

    return run


def _unpack_windows(batches):
    for batch in batches:
        yield from _windows(list(zip(*(batch.column(i).to_pylist() for i in range(3))))).to_batches()
        bs.release()


def repeated_windows(docs: DataFrame, depth: int = 200, digit: int = 40, max_bitmap: int = 1 << 24, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(key, first, windows): runs of byte positions at which a repeated window starts.

    ``docs`` has ``key`` (identity of the row, 16 bytes) and ``text``.
    """
    spark = docs.sparkSession
    texts_in_small_batches(spark)
    buckets = 4 * shuffle_width(spark)
    spans = docs.mapInArrow(scan_digits(depth, digit, buckets, block), PACKED_DDL)
    found = checkpointed(spans.groupBy("bucket").applyInArrow(_settled(buckets), FOUND_DDL))
    dealt = found.filter("kind = 1").select("a", "b").mapInArrow(_deal_digits(buckets), "bucket int, a binary, b binary")
    sizes = checkpointed(dealt.groupBy("bucket").applyInArrow(_unfinished(hot), "several binary, hot binary"))
    bitmaps = spark.sparkContext.broadcast(_bitmaps(sizes, max_bitmap))
    again = docs.mapInArrow(scan_spans(depth, digit, buckets, block, bitmaps), PACKED_DDL)
    refined = again.groupBy("bucket").applyInArrow(settle_refined(depth, digit, buckets, min(block, ORDERED)), WINDOWS_DDL)
    known = found.filter("kind = 0 and length(a) > 0").select("a", "b", "c").mapInArrow(_unpack_windows, WINDOWS_DDL)
    return known.unionByName(refined)


def _cut(depth: int, keep_text: bool):
    """Per row: what is left of the text, and the digest of it."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index("text"))
            firsts = batch.column(names.index("first")).to_pylist()
            counts = batch.column(names.index("windows")).to_pylist()
            n_bytes, removed, spans, digests, kept = [], [], [], [], []
            for text, f, c in zip(texts, firsts, counts):
                raw = (text.as_py() or "").encode()
                left, n_cut, n_span = raw, 0, 0
                if f:
                    f = np.array(f)
                    by = np.argsort(f, kind="stable")
                    lo, hi = f[by], np.maximum.accumulate((f + np.array(c) + depth - 1)[by])
                    new = np.concatenate([[True], lo[1:] > hi[:-1]])
                    lo, hi = lo[new], hi[np.concatenate([new[1:], [True]])]
                    n_cut, n_span = int((hi - lo).sum()), len(lo)
                    ends = [0, *hi.tolist()]
                    left = b"".join(raw[a:b] for a, b in zip(ends, [*lo.tolist(), len(raw)]))
                n_bytes.append(len(raw))
                removed.append(n_cut)
                spans.append(n_span)
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", errors="ignore") if keep_text and n_cut else None)
            rest = [batch.column(i) for i, c in enumerate(names) if c not in ("first", "windows", "text")]
            out = [*rest, pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            keep = [c for c in names if c not in ("first", "windows", "text")] + ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                out.append(pa.array([t.as_py() if k is None else k for t, k in zip(texts, kept)], pa.string()))
                keep.append("kept_text")
            yield pa.RecordBatch.from_arrays(out, names=keep)

    return run


def remove_repeats(docs: DataFrame, depth: int = 200, digit: int = 40, keep_text: bool = False, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """Cut each byte covered by a ``depth``-byte string that starts anywhere else in ``docs``.

    Matches stay inside one row and are judged on the input. Returns ``doc_id``,
    ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if asked for,
    ``kept_text`` (bytes of a character that was cut through are dropped from it).

    A null text is empty; texts shorter than ``depth`` keep all bytes; repeated rows are
    separate documents and so repeat each other; ties cannot arise; an empty table gives
    no rows; very long texts are read whole, ``block`` windows at a time; columns other than
    ``doc_id`` and ``text`` are ignored. ``hot`` and ``block`` change the work, not the result.
    """
    keyed = docs.select("doc_id", "text").withColumn("key", row_key("doc_id", "text"))
    runs = repeated_windows(keyed.select("key", "text"), depth, digit, hot=hot, block=block)
    runs = runs.groupBy("key").agg(F.collect_list("first").alias("first"), F.collect_list("windows").alias("windows"))
    joined = keyed.join(runs.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "first", "windows")
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text
    return joined.mapInArrow(_cut(depth, keep_text), ddl)


def cut_repeats(docs: DataFrame, depth: int = 200, digit: int = 40) -> DataFrame:
    """``docs`` with every repeated passage cut from ``text``, all of its occurrences alike.

    Rows of which only white space is left by a cut go. Where text was cut, ``n_chars`` (if
    there is such a column) is its new length. Rows without repeats are returned as they
    are. Edge cases are those of ``remove_repeats``.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("row"), row_key("doc_id", "text").alias("key"), "text")
    runs = repeated_windows(keyed.select("key", "text"), depth, digit)
    runs = runs.groupBy("key").agg(F.collect_list("first").alias("first"), F.collect_list("windows").alias("windows"))
    joined = keyed.join(runs.hint("shuffle_hash"), "key", "left").select("row", "text", "first", "windows")
    ddl = f"row {joined.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    cut = joined.mapInArrow(_cut(depth, True), ddl).filter((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"\S"))
    columns = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if c == "text":
            value = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(value)
        if c == "n_chars":
            value = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return cut.select(*columns)
