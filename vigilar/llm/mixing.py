"""Mixing sources to target weights by packed blocks, in DataFrame operations only.

1. Targets: every source gets its weight's share of all words, at most ``MAX_EPOCHS`` times its
   own words; what is above is shared again by weight. The water level of this is found by
   running sums over the sources in the order of words per weight.
2. The words of a source, in the order of hashed documents, are packed into blocks of ``BLOCK``.
3. A source's target gives its number of slots. How many of them each output shard gets is a
   multinomial draw: as many draws of a shard as the source has slots, counted. Running sums of
   the counts give every shard its own stretch of the slots of each source.
4. Slot j of a source with n blocks is entry j mod n of its (j div n)-th epoch; a pseudorandom
   permutation of 0..n-1 for each source and epoch (swap-or-not rounds) names the block.
5. Blocks and slots are joined by index. No block is used more than ``MAX_EPOCHS`` times.

Sources are a dimension: windows over all of them run in one task, which holds a row of a few numbers
per source, so some millions of sources are the bound. Nothing else depends on their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilar.llm.store import saved

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK = 64
SHARD_SLOTS = 16_384
ROUNDS = 12
SEED = 9
ROWS_PER_BUCKET = 4096
SLOTS_PER_CHUNK = 65_536
SLOTS_PER_TASK = 1 << 19
SHARDS_PER_BUCKET = 4096
UNIT = 1 << 24
WORD = r"[^\x20\x09-\x0D]+"


def target_table(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """s (index), source, rows, source_size and target of every source; one row a source.

    Sources are a dimension: windows over all of them sort as many rows as there are sources.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    known = sizes.withColumn("s", number).withColumn("w", weight)
    by_level = Window.orderBy(F.col("source_size") / F.col("w"), "s")
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - epochs * (F.sum("source_size").over(by_level) - F.col("source_size"))) / (
        F.sum("w").over(every) - (F.sum("w").over(by_level) - F.col("w"))
    )
    known = known.withColumn("level", level)
    reached = F.when(epochs * F.col("source_size") / F.col("w") >= F.col("level"), F.struct(F.row_number().over(by_level).alias("i"), F.col("level").alias("x")))
    known = known.withColumn("reached", reached).withColumn("water", F.min("reached").over(every)["x"])
    cap = (epochs * F.col("source_size")).cast("double")
    target = F.least(cap, F.coalesce(F.col("water") * F.col("w"), cap))
    return known.select("s", "source", "rows", "source_size", target.alias("target"))


def _hash(*parts: Column | str) -> Column:
    return F.xxhash64(F.lit(SEED), *parts)


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Place of ``x`` in a keyed pseudorandom permutation of 0..n-1 (swap-or-not)."""

    def step(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(_hash(*key, r), n) - at, n)
        return F.when(_hash(*key, r, F.greatest(at, partner)) > 0, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, step)


def _laid_out(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds s and the first word's place ``a`` in the stream of the source."""
    dealt = rows.join(targets.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    parts = F.ceil(F.col("rows") / ROWS_PER_BUCKET)
    dealt = dealt.withColumn("bucket", F.pmod(_hash("doc_id", "size"), parts))
    totals = dealt.groupBy("s", "bucket").agg(F.sum("size").alias("words"))
    ahead = F.sum("words").over(Window.partitionBy("s").orderBy("bucket")) - F.col("words")
    totals = totals.select("s", "bucket", ahead.alias("ahead"))
    running = F.sum("size").over(Window.partitionBy("s", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn("own", F.coalesce(running, F.lit(0))).join(totals, ["s", "bucket"]).withColumn("a", F.col("own") + F.col("ahead"))


def draw_counts(targets: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(s, n, shard, slots, start): how many slots of each source a shard gets, and its first one; n is the blocks of the source."""
    n = F.ceil(F.col("source_size") / block)
    plan = targets.where("source_size > 0").select("s", n.alias("n"), F.round(F.col("target") * n / F.col("source_size")).cast("long").alias("slots"))
    plan = plan.where("slots > 0")
    total = plan.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-total // shard_slots))
    chunks = plan.select("s", "n", "slots", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / SLOTS_PER_CHUNK).cast("long"))).alias("chunk"))
    chunks = chunks.repartition(1 + total // SLOTS_PER_TASK, "s", "chunk")
    low = F.col("chunk") * SLOTS_PER_CHUNK
    draws = chunks.select("s", "n", F.explode(F.sequence(low, F.least(low + SLOTS_PER_CHUNK, "slots") - 1)).alias("draw"))
    counts = draws.groupBy("s", "n", F.pmod(_hash("s", "draw"), F.lit(shards)).alias("shard")).agg(F.count(F.lit(1)).alias("slots"))
    counts = saved(counts.withColumn("bucket", F.floor(F.col("shard") / SHARDS_PER_BUCKET)), "counts")
    totals = counts.groupBy("s", "bucket").agg(F.sum("slots").alias("all"))
    totals = totals.select("s", "bucket", (F.sum("all").over(Window.partitionBy("s").orderBy("bucket")) - F.col("all")).alias("ahead"))
    own = F.sum("slots").over(Window.partitionBy("s", "bucket").orderBy("shard")) - F.col("slots")
    return counts.withColumn("own", own).join(totals, ["s", "bucket"]).select("s", "n", "shard", "slots", (F.col("own") + F.col("ahead")).alias("start"))


def draw_slots(targets: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(s, slot, shard, epoch, block): the slots of every shard by its drawn counts, and which block each of them takes."""
    counts = saved(draw_counts(targets, block, shard_slots), "stretches")
    total = counts.agg(F.sum("slots")).first()[0] or 0
    counts = counts.repartition(1 + total // SLOTS_PER_TASK, "s", "shard")
    slots = counts.select("s", "n", "shard", F.explode(F.sequence("start", F.col("start") + F.col("slots") - 1)).alias("slot"))
    epoch = F.floor(F.col("slot") / F.col("n"))
    return slots.select("s", "slot", F.col("shard").cast("int").alias("shard"), epoch.alias("epoch"), permuted(F.col("slot") % F.col("n"), F.col("n"), F.col("s"), epoch).alias("block"))


def _pieces(laid: DataFrame, block: int) -> DataFrame:
    """One row for every block that a document has words in, with the number of these words."""
    end = F.col("a") + F.col("size")
    spread = laid.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((end - 1) / block))))
    words = F.least(end, (F.col("block") + 1) * block) - F.greatest(F.col("a"), F.col("block") * block)
    return spread.withColumn("words", words)


def words_of(text: str) -> Column:
    """Number of words of a text column; 0 for nulls."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source and size in words of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_of("text").alias("size"))


def _streams(docs: DataFrame, weights: tuple[int, ...], epochs: int) -> tuple[DataFrame, DataFrame]:
    rows = saved(measured(docs), "sizes")
    targets = saved(target_table(rows, weights, epochs), "targets")
    return targets, saved(_laid_out(rows, targets).select("doc_id", "source", "size", "s", "a", "source_size", "target"), "streams")


def packed_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix itself: (shard, source, slot, block, doc_id, first_word, words) for every stretch of a document that a slot of a shard takes."""
    targets, laid = _streams(docs, weights, epochs)
    pieces = _pieces(laid, block).withColumn("first_word", F.greatest(F.col("block") * block - F.col("a"), F.lit(0)))
    slots = draw_slots(targets, block, shard_slots)
    return pieces.join(slots.hint("merge"), ["s", "block"]).select("shard", "source", "slot", "block", "doc_id", "first_word", "words")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_shard and last_shard for every row of ``docs`` (doc_id, text, source).

    The shards are the first and the last that take words of the document (null if none does).
    Null and blank texts have no words and nothing is taken. A null source is a source of its
    own, the last. Repeated rows are rows of their own; which of two equal rows is taken more
    often is not told apart. An empty table gives an empty result; other columns are ignored.
    """
    targets, laid = _streams(docs, weights, epochs)
    slots = draw_slots(targets, block, shard_slots)
    uses = slots.groupBy("s", "block").agg(F.count(F.lit(1)).alias("uses"), F.min("shard").alias("low"), F.max("shard").alias("high"))
    key = ["s", "a", "doc_id", "source", "size", "source_size", "target"]
    # The uses come from few rows of targets, which the optimizer takes for their size: never broadcast them.
    pieces = _pieces(laid, block).join(uses.hint("merge"), ["s", "block"], "left")
    taken = pieces.groupBy(*key).agg(F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).alias("taken"), F.min("low").alias("first_shard"), F.max("high").alias("last_shard"))
    none = F.lit(None).cast("int")
    empty = laid.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "first_shard": none, "last_shard": none})
    return taken.unionByName(empty.select(taken.columns)).select("doc_id", "source", "size", "source_size", "target", "taken", "first_shard", "last_shard")


def whole_copies(taken: DataFrame) -> DataFrame:
    """Adds copies to rows of ``mix_sources``: how often a document goes out when only whole ones can.

    floor(taken / size), and one more where the running sum of the remaining shares of the source
    passes a half. Rows are summed by size inside hash buckets, falling and rising in turn, so
    that the words of a source are off by at most about half its longest document for every
    ``ROWS_PER_BUCKET`` rows.
    """
    counts = taken.groupBy(F.col("source").alias("source_")).agg(F.count(F.lit(1)).alias("rows"))
    dealt = taken.join(counts, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    dealt = dealt.withColumn("bucket", F.pmod(_hash("doc_id", "size", F.lit("copies")), F.ceil(F.col("rows") / ROWS_PER_BUCKET)))
    # Shares are whole numbers of 1 / UNIT: their sums do not depend on the order of the rows.
    share = F.when(F.col("size") > 0, F.floor((F.col("taken") % F.col("size")) * UNIT / F.col("size"))).otherwise(0).cast("long")
    dealt = dealt.withColumn("share", share)
    totals = dealt.groupBy(F.col("source").alias("source_"), F.col("bucket").alias("bucket_")).agg(F.sum("share").alias("all"))
    totals = totals.withColumn("ahead", F.sum("all").over(Window.partitionBy("source_").orderBy("bucket_")) - F.col("all")).drop("all")
    turned = F.when(F.col("bucket") % 2 == 0, -F.col("size")).otherwise(F.col("size"))
    before = Window.partitionBy("source", "bucket").orderBy(turned, "doc_id", "taken").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("own", F.coalesce(F.sum("share").over(before), F.lit(0)))
    dealt = dealt.join(totals, F.col("source").eqNullSafe(F.col("source_")) & (F.col("bucket") == F.col("bucket_")))
    at = F.col("own") + F.col("ahead") + UNIT // 2
    more = F.floor((at + F.col("share")) / UNIT) - F.floor(at / UNIT)
    full = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    return dealt.select(*taken.columns, (full + more).cast("int").alias("copies"))
