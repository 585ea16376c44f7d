"""Mixing sources to target weights: a low-discrepancy schedule of equal blocks, by DataFrame operations only.

Targets: the total is shared by weight; a source stops at `cap` times its size and what it leaves is shared
again by weight (water filling: target = least of cap * size and level * weight, the level found by a
running sum over sources sorted by cap * size / weight).

Schedule: each source has its own block length, the whole target over `slots` or a PARTS-th of its own target,
whichever is less, so that a small source is met as closely as a large one at any input size. A source needs its
target over its block length in slots; the slots are at most `slots` and PARTS more for each source. Slot i stands at
the fraction of i times the golden ratio's inverse; the source whose interval of cumulative needs holds this point
gets the slot, and slots of a source are ranked by their number. Each source's documents, in the order of a hash, are
one stream of tokens cut into its blocks; the k-th slot of a source takes its block k, counted round when all blocks
are taken, and `cap` times (a whole number) at most.

Places in a source's stream come from sums over hash ranges of documents first and a running sum inside a
range then, so that a source with a third of all rows is no single task. Blocks and slots meet by (source,
block), which many keys share evenly.

Cases: a null text has size 0; a null source is a source of its own, the last in order; documents of size 0
are taken 0 words; equal doc_ids are ordered by a hash of the text and repeated rows stay rows, with equal
parts; a source of size 0 has target 0; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.storage import Stage

SLOTS = 1 << 20
PARTS = 1024
RANGE_ROWS = 4096
CELLS = 4096
#: Weights of sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Fixed value: 1 / golden ratio, in units of 2^-40.
GOLDEN_40 = 679534494285


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float, cap: float, weights=WEIGHTS) -> DataFrame:
    """sizes (source, source_size, rows) with weight, target, and the whole of all targets."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    # one row a source from here
    rank = F.row_number().over(order) - 1
    got = sizes.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    got = got.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy()
    full = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    rest = total - F.coalesce(F.sum("most").over(full), F.lit(0.0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(full), F.lit(0.0))
    # the level rises while the sources before are full, and falls from the first that is not
    got = got.withColumn("level", rest / left)
    got = got.withColumn("level", F.max("level").over(every))
    got = got.withColumn("target", F.least("most", F.col("level") * F.col("weight")))
    return got.withColumn("whole", F.sum("target").over(every)).drop("level")


def block_length(slots: int) -> Column:
    """Tokens of a source's block."""
    common = F.ceil(F.col("whole") / F.lit(float(slots)))
    return F.greatest(F.lit(1), F.least(common, F.ceil(F.col("target") / PARTS))).cast("long")


def needs(sources: DataFrame, slots: int) -> DataFrame:
    """sources with their block length, the slots all need, and the interval [low, high) of cumulative needs."""
    # one row a source
    got = sources.withColumn("block", block_length(slots))
    need = F.col("target") / F.col("block")
    every = F.sum(need).over(Window.partitionBy())
    upto = F.sum(need).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    got = got.withColumn("needed", F.ceil(every)).withColumn("high", F.when(every > 0, upto / every).otherwise(0.0))
    return got.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("rank")), F.lit(0.0)))


def golden_point(slot: Column) -> Column:
    """The fraction of slot times the golden ratio's inverse; two steps, as the whole product would not fit a long."""
    whole = (slot % F.lit(1 << 20)) * F.lit(GOLDEN_40) + F.shiftright(slot, 20) * F.lit((GOLDEN_40 << 20) % (1 << 40))
    return (whole % F.lit(1 << 40)) / F.lit(float(1 << 40))


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, rank of the source, turn) of sources with their needs: the source of each slot and the slot's number within it, from 0."""
    spark = sources.sparkSession
    count = sources.agg(F.max("needed")).first()[0] or 0
    slot = spark.range(0, count, 1, 16).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point")).withColumn("cell", F.floor(F.col("point") * CELLS))
    cells = F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))
    spans = sources.filter("high > low").select("rank", "low", "high", F.explode(cells).alias("cell"))
    dealt = slot.join(spans, "cell").filter("point >= low and point < high").select("slot", "rank")
    return dealt.withColumn("turn", F.row_number().over(Window.partitionBy("rank").orderBy("slot")) - 1)


class Mixture:
    """sources, schedule, and documents with what the mix takes of each; text_key is xxhash64 of the text."""

    def __init__(self, docs: DataFrame, share: float = 1.5, cap: int = 2, slots: int = SLOTS, weights=WEIGHTS):
        if cap != int(cap) or cap < 1:
            raise ValueError("cap must be a whole number of times")
        spark = docs.sparkSession
        stage = Stage(spark, "mixture")
        key = F.xxhash64(F.col("doc_id").cast("string"), F.lit(17))
        sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("order"), F.xxhash64("text").alias("text_key"))
        self.sized = stage.put(sized, "sized")
        sizes = self.sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
        self.sources = stage.put(needs(targets(sizes, share, cap, weights), slots), "sources")
        known = self.sources.select(F.col("source").alias("_s"), "rank", "source_size", "target", "block", (F.floor(F.col("rows") / RANGE_ROWS) + 1).alias("ranges"))
        named = self.sized.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        # ranges of the hash order: the leading part of the unsigned hash
        named = named.withColumn("range", F.floor((F.shiftright("order", 33) + F.lit(1 << 30)) * F.col("ranges") / F.lit(float(1 << 31))).cast("long"))
        sums = named.groupBy("rank", "range").agg(F.sum("size").alias("own"))
        before = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("rank", "range", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
        inside = Window.partitionBy("rank", "range").orderBy("order", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = named.withColumn("upto", F.sum("size").over(inside)).join(sums, ["rank", "range"])
        placed = placed.withColumn("end", F.col("base") + F.col("upto")).withColumn("start", F.col("end") - F.col("size"))
        self.placed = stage.put(placed.withColumn("row", F.monotonically_increasing_id()).drop("base", "upto", "order", "range", "ranges"), "placed")
        self.schedule = schedule(self.sources)
        blocks = self.sources.select("rank", "block", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("block"))).cast("long").alias("n_blocks"))
        # a block is taken `cap` times at most, whatever the points give its source
        turns = self.schedule.join(blocks, "rank").filter(F.col("turn") < F.col("n_blocks") * int(cap)).select("slot", "rank", "turn", F.pmod("turn", "n_blocks").alias("at"), "block")
        self.turns = turns
        times = turns.groupBy("rank", "at").agg(F.count("*").alias("times"))
        first, last = F.floor(F.col("start") / F.col("block")), F.floor((F.col("end") - 1) / F.col("block"))
        pieces = self.placed.filter("size > 0").select("row", "rank", "start", "end", "block", F.explode(F.sequence(first, last)).alias("at"))
        part = F.least("end", (F.col("at") + 1) * F.col("block")) - F.greatest("start", F.col("at") * F.col("block"))
        # few documents of many words are many pieces, which Spark takes for few and would broadcast
        taken = pieces.join(times.hint("merge"), ["rank", "at"]).groupBy("row").agg(F.sum(part * F.col("times")).alias("taken"))
        self.documents = self.placed.join(taken, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "text_key")


def op6_query(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return Mixture(spark.read.parquet(f"{sf_dir}/documents.parquet")).documents.select("doc_id", "size", "source_size", "target", "taken")
