"""Multi-pattern search with windows around hits, merged into samples.

Built-in functions give no positions of overlapping hits in linear time, so texts pass once
through Arrow batches. All hits of a text are found, and merged, where the text is: nothing
is shuffled.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.operators.index import spread

#: Patterns above which one automaton reads the text in place of one search a pattern.
FEW = 256


def _payload(terms: DataFrame) -> dict:
    """Lower-cased term -> (aspect, weight) of a query's short list."""
    rows = terms.filter("term <> ''").groupBy(F.lower("term").alias("term")).agg(F.max(F.struct("aspect", "weight")).alias("p")).collect()
    return {r.term: (r.p.aspect, r.p.weight) for r in rows}


def _every(patterns):
    """A function that yields (start, pattern) of every overlapping hit in a text."""
    if len(patterns) > FEW:
        try:
            import ahocorasick
        except ImportError:
            ahocorasick = None
        if ahocorasick:
            automaton = ahocorasick.Automaton()
            for p in patterns:
                automaton.add_word(p, p)
            automaton.make_automaton()
            return lambda text: ((end + 1 - len(p), p) for end, p in automaton.iter(text))

    def each(text):
        for p in patterns:
            at = text.find(p)
            while at >= 0:
                yield at, p
                at = text.find(p, at + 1)

    return each


def occurrences(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(ord, term, aspect, weight, start, end, length): every overlapping hit, end inclusive.

    ``terms`` (term, aspect, weight) is a query's short list; of a term in two aspects the
    last aspect counts. Matching ignores case and word boundaries.
    """
    payload = _payload(terms)
    kind = chunks.schema["ord"].dataType.simpleString()

    def run(batches):
        find = _every(list(payload))
        for batch in batches:
            out = [], [], [], [], [], [], []
            ords = batch.column(0).to_pylist()
            for ord_, low in zip(ords, batch.column(1)):
                low = low.as_py() or ""
                for at, p in find(low):
                    for column, x in zip(out, (ord_, p, *payload[p], at, at + len(p) - 1, len(low))):
                        column.append(x)
                if len(out[0]) >= 1 << 16:
                    yield pa.RecordBatch.from_pydict(dict(zip(NAMES, out)))
                    out = [], [], [], [], [], [], []
            if out[0]:
                yield pa.RecordBatch.from_pydict(dict(zip(NAMES, out)))

    low = spread(chunks.select("ord", "text")).select("ord", F.lower("text").alias("low"))
    return low.mapInArrow(run, f"ord {kind}, term string, aspect string, weight double, start long, end long, length long")


NAMES = ("ord", "term", "aspect", "weight", "start", "end", "length")


def containing(chunks: DataFrame, patterns: DataFrame, key: str, pattern: str) -> DataFrame:
    """(ord, key) of the texts that contain a pattern, as they are; ``patterns`` is a short list."""
    kind, kind_of_key = chunks.schema["ord"].dataType.simpleString(), patterns.schema[key].dataType.simpleString()
    known: dict = {}
    for k, p in patterns.select(key, pattern).collect():
        if p is not None:
            known.setdefault(p, []).append(k)

    def run(batches):
        few, find = len(known) <= FEW, _every(list(known))
        for batch in batches:
            ords, keys = [], []
            for ord_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                met = [p for p in known if p in text] if few else {p for _, p in find(text)}
                for p in met:
                    keys += known[p]
                    ords += [ord_] * len(known[p])
            yield pa.RecordBatch.from_pydict({"ord": ords, key: keys})

    return spread(chunks.select("ord", "text")).mapInArrow(run, f"ord {kind}, {key} {kind_of_key}")


def around(hits: DataFrame, reach: int = 100) -> DataFrame:
    """Each hit's window: ``reach`` characters either side of its middle, inside the text."""
    middle = F.floor((F.col("start") + F.col("end")) / 2).cast("int")
    return hits.withColumn("lo", F.greatest(F.lit(0), middle - reach)).withColumn("hi", F.least(F.col("length"), middle + reach)).drop("start", "end")


def merged(spans: DataFrame, key: str = "ord", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Spans with the number ``island`` of their run; touching spans are one run."""
    order = Window.partitionBy(key).orderBy(lo, hi)
    reach = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", F.when(reach.isNull() | (F.col(lo) > reach), 1).otherwise(0))
    return fresh.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def samples(chunks: DataFrame, terms: DataFrame, reach: int = 100) -> DataFrame:
    """(ord, island, text, length, max_weight, aspects): merged windows cut from the text.

    What ``merged`` of ``around`` of ``occurrences`` gives, for a text in one row, without
    moving hits or texts.
    """
    payload = _payload(terms)
    kind = chunks.schema["ord"].dataType.simpleString()

    def run(batches):
        find = _every(list(payload))
        for batch in batches:
            out = {c: [] for c in ("ord", "island", "text", "length", "max_weight", "aspects")}
            for ord_, text, low in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text, low = text.as_py() or "", low.as_py() or ""
                windows = []
                for at, p in find(low):
                    middle = (2 * at + len(p) - 1) // 2
                    windows.append((max(0, middle - reach), min(len(low), middle + reach), p))
                windows.sort(key=lambda w: w[:2])
                runs = []
                for lo, hi, p in windows:
                    if not runs or lo > runs[-1][1]:
                        runs.append([lo, hi, set()])
                    runs[-1][1] = max(runs[-1][1], hi)
                    runs[-1][2].add(p)
                for i, (lo, hi, found) in enumerate(runs, 1):
                    row = ord_, i, text[lo:hi], hi - lo, max(payload[p][1] for p in found), sorted({payload[p][0] for p in found})
                    for column, x in zip(out.values(), row):
                        column.append(x)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("ord", batch.schema.field(0).type), ("island", pa.int64()), ("text", pa.string()), ("length", pa.int64()), ("max_weight", pa.float64()), ("aspects", pa.list_(pa.string()))]))

    rows = spread(chunks.select("ord", "text")).select("ord", "text", F.lower("text").alias("low"))
    return rows.mapInArrow(run, f"ord {kind}, island long, text string, length long, max_weight double, aspects array<string>")
