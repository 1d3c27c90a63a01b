"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sources, ordered by code point with null last, weigh 1, 2, 3, 1, 2, 3, ... and share the
words of the corpus by weight; a target stops at ``most`` times its source's size and the
excess is shared again by weight (water filling, in closed form).

Documents of a source fall into blocks by hash. A target of e whole copies and a rest
becomes a quota of blocks: every block e times, and the first blocks of a seeded
permutation once more until the rest is filled; the block that passes the rest is taken
in part, its documents in permuted order, the last one cut to the words still missing.

The exact quotas are split among output shards by a binary tree: at each node a
multivariate hypergeometric draw decides how many of each source's blocks go left, the
left child holding its share of all blocks. A shard then owns a run of each source's
permuted blocks, disjoint from all others, and is shuffled locally.

Everything is DataFrame expressions. A draw inverts the distribution function around its
mean (twelve standard deviations each way), with factorials from Stirling's series, and
a hash of (seed, node, source) as the uniform number, so that reruns agree. Blocks of a
source are bounded in number, so the tree and the prefix sums work on bounded metadata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.llm.runtime import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: Documents a block holds if the source is small, and blocks a source has at most.
PER_BLOCK, BLOCKS = 64, 4096
#: Words an output shard should hold, and shards there are at least.
PER_SHARD, SHARDS = 1 << 24, 16
SEED = 20240601


def words(text: str = "text") -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """(source, source_size, docs, target, place) from rows (source, size).

    With the sources in order of size over weight, the ones below the water level stop at
    ``most`` times their size: a source stops if what is left after all before it, shared
    by weight, still exceeds its stop.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    # The sources are configuration: one row each, gathered into one array.
    listed = per.agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "source_size", "docs"))).alias("s"))
    weight = lambda i: F.element_at(F.array(*map(F.lit, WEIGHTS)), (i % len(WEIGHTS) + 1).cast("int"))
    listed = listed.select(F.transform("s", lambda x, i: F.struct(x.source.alias("source"), x.source_size.alias("size"), x.docs.alias("docs"), i.alias("place"), weight(i).cast("double").alias("w"))).alias("s"))
    total = F.aggregate("s", F.lit(0).cast("double"), lambda a, x: a + x["size"])
    filled = F.aggregate(
        F.array_sort(F.transform("s", lambda x: F.struct((x["size"] / x.w).alias("r"), x.place.alias("place"), (most * x["size"]).cast("double").alias("stop"), x.w.alias("w")))),
        F.struct(total.alias("left"), F.aggregate("s", F.lit(0.0), lambda a, x: a + x.w).alias("w"), F.lit(None).cast("double").alias("level")),
        lambda a, x: F.when(a.level.isNotNull() | (a.left * x.w / a.w <= x.stop), F.struct(a.left.alias("left"), a.w.alias("w"), F.coalesce(a.level, a.left / a.w).alias("level"))).otherwise(
            F.struct((a.left - x.stop).alias("left"), F.greatest(a.w - x.w, F.lit(1e-9)).alias("w"), a.level.alias("level"))
        ),
        lambda a: F.coalesce(a.level, F.lit(float("inf"))),
    )
    rows = listed.withColumn("level", filled).select("level", F.inline("s"))
    stop = (most * F.col("size")).cast("double")
    return rows.select("source", F.col("size").alias("source_size"), "docs", F.least(stop, F.col("level") * F.col("w")).alias("target"), "place")


def bind(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8, taken back by the product of the eight factors."""
    x = n + F.lit(8.0)
    back = n + F.lit(1.0)
    for i in range(2, 9):
        back = back * (n + F.lit(float(i)))
    return (x + 0.5) * F.log(x) - x + F.lit(0.9189385332046727) + 1 / (12 * x) - 1 / (360 * x * x * x) - F.log(back)


def hypergeometric(good: Column, rest: Column, draws: Column, u: Column) -> Column:
    """Number of ``good`` among ``draws`` from good + rest without return; u in [0, 1).

    Inverts the distribution function over the support within twelve standard deviations
    of the mean.
    """

    def window(v):
        n = (v.good + v.rest).cast("double")
        mean = F.when(n > 0, v.draws * v.good / n).otherwise(0.0)
        return F.struct(v.good, v.rest, v.draws, v.u, mean.alias("mean"), F.when(n > 1, F.sqrt(mean * (v.rest / n) * (n - v.draws) / (n - 1))).otherwise(0.0).alias("sd"))

    def support(v):
        low = F.greatest(F.lit(0), v.draws - v.rest, F.floor(v.mean - 12 * v.sd).cast("long") - 1)
        high = F.least(v.good, v.draws, F.ceil(v.mean + 12 * v.sd).cast("long") + 1)
        return F.struct(v.good, v.rest, v.draws, v.u, low.alias("low"), high.alias("high"), F.greatest(low, F.least(high, F.floor(v.mean).cast("long"))).alias("mode"))

    def logp(v, x):
        return -log_factorial(x) - log_factorial(v.good - x) - log_factorial(v.draws - x) - log_factorial(v.rest - v.draws + x)

    def masses(v):
        mass = bind(logp(v, v.mode), lambda top: F.transform(F.sequence(v.low, v.high), lambda x: F.exp(logp(v, x) - top)))
        return F.struct(v.u, v.low, v.high, mass.alias("mass"))

    def invert(v):
        level = v.u * F.aggregate(v.mass, F.lit(0.0), lambda a, p: a + p)
        steps = lambda level: F.aggregate(
            v.mass,
            F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("steps")),
            lambda a, p: F.struct((a["sum"] + p).alias("sum"), (a.steps + F.when(a["sum"] + p <= level, 1).otherwise(0)).alias("steps")),
            lambda a: a.steps,
        )
        return F.least(v.high, v.low + bind(level, steps))

    given = F.struct(good.cast("long").alias("good"), rest.cast("long").alias("rest"), draws.cast("long").alias("draws"), u.alias("u"))
    return bind(bind(bind(bind(given, window), support), masses), invert)


def _uniform(*parts) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11) / F.lit(float(1 << 53))


def split(quotas: DataFrame, shards: int) -> DataFrame:
    """(place, shard, first, n): runs of each source's blocks, from rows (place, quota).

    ``shards`` is a power of two. Each level splits every node in two; a node's left child
    takes half of its blocks (rounded down), drawn without return.
    """
    node = quotas.agg(F.sort_array(F.collect_list(F.struct("place", F.col("quota").alias("n")))).alias("s")).withColumn("node", F.lit(1).cast("long"))
    for _ in range(shards.bit_length() - 1):
        total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x.n)
        half = (total / 2).cast("long")
        draw = F.aggregate(
            "s",
            F.struct(total.alias("pool"), half.alias("draws"), F.array().cast("array<struct<place:int,n:bigint>>").alias("left")),
            lambda a, x: bind(
                hypergeometric(x.n, a.pool - x.n, a.draws, _uniform(F.col("node"), x.place)),
                lambda k: F.struct((a.pool - x.n).alias("pool"), (a.draws - k).alias("draws"), F.array_append(a.left, F.struct(x.place.alias("place"), k.alias("n"))).alias("left")),
            ),
            lambda a: a.left,
        )
        # Written out, so that later levels do not expand this level's expression.
        node = checkpointed(node.select("node", "s", draw.alias("left")))
        right = F.zip_with("s", "left", lambda x, y: F.struct(x.place.alias("place"), (x.n - y.n).alias("n")))
        node = node.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("s")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("s")))).alias("c")).select("c.*")
    leaves = node.select((F.col("node") - shards).cast("int").alias("shard"), F.inline("s"))
    before = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.select("place", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("first"), "n")


def allotted(docs: DataFrame, most: int = 3) -> DataFrame:
    """One row per row of ``docs``: its words, its source's goal and what is taken of it.

    ``copies`` whole copies of every document are taken, and ``extra`` words of it besides;
    ``rank`` is the place of its block in the source's permutation of ``blocks`` blocks.
    """
    slim = checkpointed(docs.select(F.xxhash64("doc_id", "text", "source").alias("key"), "doc_id", "source", words().alias("size")))
    goal = targets(slim, most)
    goal = goal.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.greatest(F.lit(0), F.floor(F.col("target") - F.col("copies") * F.col("source_size") + 1e-6)).cast("long"))
    goal = goal.withColumn("dealt", F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.ceil(F.col("docs") / PER_BLOCK))).cast("int"))
    goal = checkpointed(goal.withColumnRenamed("source", "goal_source"))
    # A null source meets its own row; a hot source is split by the planner as a skewed join.
    rows = slim.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "key"), F.col("dealt")).cast("int"))
    per_block = rows.groupBy("place", "block").agg(F.sum("size").alias("block_size"), F.max("rest").alias("rest"))
    order = Window.partitionBy("place").orderBy(F.xxhash64(F.lit(SEED + 1), "place", "block"), "block")
    before = F.coalesce(F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.greatest(F.lit(0), F.least("block_size", F.col("rest") - before)).cast("long")
    ranked = per_block.select("place", "block", F.row_number().over(order).alias("rank"), F.count("*").over(Window.partitionBy("place")).alias("blocks"), room.alias("room"))
    rows = rows.join(ranked, ["place", "block"])
    inside = Window.partitionBy("place", "block").orderBy(F.xxhash64(F.lit(SEED + 2), "doc_id"), "doc_id", "key", "size")
    ahead = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("room") - ahead)).cast("long"))


def deal(docs: DataFrame, shards: int | None = None, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rows as in ``allotted``, numbered ``nth`` among rows alike, and the items dealt of them.

    An item is one copy of a row, whole or cut: (key, nth, mix_shard, mix_order, mix_words,
    mix_cut). Its shard is the one whose run of its source's blocks holds it; an item in no
    run is not dealt.
    """
    alike = Window.partitionBy("key").orderBy("extra", "rank")
    rows = checkpointed(allotted(docs, most).withColumn("nth", F.row_number().over(alike)).select("doc_id", "key", "nth", "place", "rank", "blocks", "copies", "size", "extra", "source_size", "target"))
    live = rows.filter("size > 0 and (copies > 0 or extra > 0)")
    if shards is None:  # a power of two that grows with the words taken
        all_words = rows.agg(F.sum(F.col("copies") * F.col("size") + F.col("extra"))).first()[0] or 0
        shards = max(SHARDS, 1 << max(0, -(-all_words // PER_SHARD) - 1).bit_length())
    # A source's blocks, once per whole copy, and then those that the rest reaches.
    partial = F.coalesce(F.max(F.when(F.col("extra") > 0, F.col("rank"))), F.lit(0))
    quotas = live.groupBy("place").agg((F.max("copies") * F.max("blocks") + partial).cast("long").alias("quota"))
    runs = split(quotas, shards).filter("n > 0").groupBy(F.col("place").alias("run_place")).agg(F.sort_array(F.collect_list(F.struct("first", "n", "shard"))).alias("runs"))
    last = F.col("copies") - F.when(F.col("extra") > 0, 0).otherwise(1)
    items = live.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    items = items.join(runs, F.col("place") == F.col("run_place")).withColumn("item", F.col("copy") * F.col("blocks") + F.col("rank") - 1)
    shard = F.aggregate("runs", F.lit(None).cast("int"), lambda a, r: F.when((r.first <= F.col("item")) & (F.col("item") < r.first + r.n), r.shard).otherwise(a))
    items = items.select(
        "key", "nth", shard.alias("mix_shard"), F.xxhash64(F.lit(SEED + 3), "key", "nth", "copy").alias("mix_order"),
        F.when(F.col("copy") < F.col("copies"), F.col("size")).otherwise(F.col("extra")).alias("mix_words"), (F.col("copy") >= F.col("copies")).alias("mix_cut"),
    )
    return rows, checkpointed(items.filter("mix_shard is not null"))


def taken(docs: DataFrame, most: int = 3) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row of ``docs``.

    ``taken`` counts words with repeats, summed over the items that the splitting tree deals
    to shards: each source's sum is its target rounded down, and no row gives more than
    ``most`` times its size.

    A null text has no words, is taken zero times and changes nothing; a null source is a
    source of its own, ordered last; rows fall into blocks by id, text and source, so null
    and repeated doc_ids are nothing special; rows alike in all three are taken alike up to
    their order; very long texts are counted whole; an empty table gives no rows; other
    columns are ignored.
    """
    rows, items = deal(docs, most=most)
    sums = items.groupBy("key", "nth").agg(F.sum("mix_words").alias("dealt_words"))
    return rows.join(sums, ["key", "nth"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("dealt_words", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, shards: int | None = None, most: int = 3) -> DataFrame:
    """The mix itself: the columns of ``docs``, then ``mix_shard``, ``mix_order``, ``mix_words``.

    One row per copy taken, its text cut to the words taken of it (``mix_words``), in the
    shard dealt to its block by the splitting tree. A shard's rows stand together, shuffled
    locally: sorted by ``mix_order``, a permutation by hash. Rows without words are not taken.
    Columns of ``docs`` with these three names are replaced. Edge cases are those of ``taken``.
    """
    items = deal(docs, shards, most)[1].withColumnsRenamed({"key": "mix_key", "nth": "mix_item_nth"})
    own = [c for c in docs.columns if c not in ("mix_shard", "mix_order", "mix_words")]
    named = docs.select(F.struct(*own).alias("row"), F.xxhash64("doc_id", "text", "source").alias("mix_key"))
    named = named.withColumn("mix_nth", F.row_number().over(Window.partitionBy("mix_key").orderBy("mix_key")))
    # Rows alike share a key; the difference keeps the join on the key alone.
    joined = named.join(items, "mix_key").filter("mix_nth - mix_item_nth = 0")
    whole = F.col("row.text")
    text = F.when(F.col("mix_cut"), F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(WORD), 0), F.lit(1), F.col("mix_words").cast("int")), " ")).otherwise(whole)
    rows = joined.select(F.col("row").withField("text", text).alias("row"), "mix_shard", "mix_order", "mix_words")
    return rows.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order").select("row.*", "mix_shard", "mix_order", "mix_words")
