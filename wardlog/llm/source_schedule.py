"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources share `epochs_total` times all tokens by weight; a source stops at `most_epochs` times its size and its
excess goes to the others. With sources ordered by limit over weight this level has a closed form, found with one
running sum over the sources.

Schedule: slot k takes the golden-ratio point frac(k * phi), which falls into one source's part of the cumulative target
shares; any stretch of slots then holds each source almost exactly in proportion. The slots of a source are ranked and
divide its target, so each source has a block size of its own: rank r takes block r of the source's documents, put in an
order shuffled by a hash, repeated up to `most_epochs` times and cut into blocks of equal tokens. Blocks may run over the
end of the source into its next epoch. The tokens taken of a source are thus its target, rounded, whatever its size; a
source whose share no point falls into takes its target in one slot.

Running totals over slots and over documents are taken in chunks, whose totals are summed first, so that a source with
a third of all rows is cut into as many tasks as any other data of its size.

Edge cases: null or empty text has size 0, takes nothing and still returns its row. A null source is a source of its
own and sorts last. Repeated rows each hold their own place. A source without tokens has target 0. An empty table gives
an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardlog.llm.common import WORD, bucket_count, text_of
from wardlog.session import stage

WEIGHTS = (5, 2, 1)
SHARE, MOST_EPOCHS = 1.5, 2
#: Slots that a schedule has at least, and tokens that a block of it holds at most on average.
LEAST_SLOTS, MOST_BLOCK = 65_536, 4_096
#: Slots whose ranks one task counts in one go, and documents that one task orders.
SLOT_CHUNK, ORDER_ROWS = 4_096, 16_384
#: Fraction of the golden ratio in units of 2^-31; products of two such numbers stay exact.
GOLDEN, UNIT = 1_327_217_885, 1 << 31
#: Cells of the unit interval by which points meet the parts of the sources.
CELLS = 4_096


def document_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size in words and a hash of the text (`mark`) of every row, numbered by `row`."""
    return docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text_of(text)).alias("mark"),
        F.monotonically_increasing_id().alias("row"),
    )


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """Per source: source, n_docs, source_size, weight, target. One row for each source passes the running sums."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")).cast("double")
    ranked = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    # Those with the least limit per weight reach it first; `level` is what a unit of weight would get if this source
    # and all behind it still took their share.
    first = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, behind = first.rowsBetween(Window.unboundedPreceding, -1), first.rowsBetween(0, Window.unboundedFollowing)
    everything = F.sum("source_size").over(Window.partitionBy())
    level = (everything * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(behind)
    levels = ranked.withColumn("level", level).withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    open_level = F.max(F.when(~F.col("full"), F.struct(F.lit(0) - F.col("limit") / F.col("weight"), "level"))).over(Window.partitionBy())
    target = F.when(F.col("full") | open_level.isNull(), F.col("limit")).otherwise(open_level["level"] * F.col("weight"))
    return levels.select("source", "n_docs", "source_size", "weight", target.alias("target"))


def slots_per_rank(shares: DataFrame, slots: int) -> DataFrame:
    """(source, rank) of every slot that falls to a source, ranks from 0 in the order of the slots."""
    spark = shares.sparkSession
    order = Window.orderBy(F.col("source").asc_nulls_last())
    total = F.sum("target").over(Window.partitionBy())
    parts = shares.where("target > 0").select(
        "source",
        (F.coalesce(F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / total).alias("low"),
        (F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0)) / total).alias("high"),
        F.lead("weight").over(order).isNull().alias("last"),
    ).withColumn("high", F.when(F.col("last"), F.lit(1.0)).otherwise(F.col("high")))
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1))
    in_cells = parts.select("source", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    turned = F.col("id").bitwiseAND(F.lit(UNIT - 1)) * F.lit(GOLDEN)
    points = spark.range(slots).select(F.col("id").alias("slot"), (turned.bitwiseAND(F.lit(UNIT - 1)) / F.lit(float(UNIT))).alias("point"))
    drawn = (
        points.withColumn("cell", cell(F.col("point")))
        .join(in_cells, "cell")
        .where("point >= low AND point < high")
        .select("slot", F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk"), "source")
    )
    counts = drawn.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(F.col("source").alias("of"), F.col("chunk").alias("in_chunk"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("chunk", "source").orderBy("slot"))
    return drawn.withColumn("inside", inside).join(
        shifts, F.col("source").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("in_chunk"))
    ).select("source", (F.col("shift") + F.col("inside") - 1).alias("rank"))


def placed(sizes: DataFrame, total_rows: int, seed: int, of_source: DataFrame) -> DataFrame:
    """Adds `start`: tokens of the source before the document, in an order shuffled by a hash of id and text.

    The columns of `of_source` are added by way of the totals per bucket, so that a large source is not moved to one task.
    Where rows lie in the input breaks ties of identical rows only; rows without tokens move nothing and are spread by it.
    """
    buckets = bucket_count(total_rows, ORDER_ROWS)
    spread = sizes.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "mark", F.when(F.col("size") == 0, F.col("row")))).withColumn("bucket", F.pmod("order", F.lit(buckets)))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = spread.groupBy("source", "bucket").agg(F.sum("size").alias("n")).select(
        F.col("source").alias("of"), F.col("bucket").alias("in_bucket"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift")
    )
    shifts = shifts.join(of_source.withColumnRenamed("of", "facts_of"), F.col("of").eqNullSafe(F.col("facts_of"))).drop("facts_of")
    inside = Window.partitionBy("source", "bucket").orderBy("order", "row").rowsBetween(Window.unboundedPreceding, -1)
    return spread.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        shifts, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in_bucket"))
    ).withColumn("start", F.col("shift") + F.col("inside")).drop("order", "mark", "bucket", "inside", "of", "in_bucket", "shift")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, and first_pass (tokens of the first epoch)."""
    sizes = stage(document_sizes(docs, key, text, source), "sizes")
    shares = stage(targets(sizes, weights, share, most), "targets")
    seen = shares.agg(F.sum("target").alias("target"), F.sum("n_docs").alias("rows")).first()
    block = int(min(MOST_BLOCK, max(1, (seen.target or 0) // LEAST_SLOTS)))
    drawn = stage(slots_per_rank(shares, int(-(-(seen.target or 0) // block))), "slots")
    missed = shares.select(F.col("source").alias("of"), "target").where("target > 0").join(
        drawn.select("source").distinct(), F.col("of").eqNullSafe(F.col("source")), "left_anti"
    )
    ranks = drawn.union(missed.select("of", F.lit(0).cast("long"))).select(F.col("source").alias("slot_of"), F.col("rank").alias("slot_rank"))
    counts = ranks.groupBy(F.col("slot_of").alias("counted")).agg(F.count("*").alias("slots"))
    of_source = shares.select(F.col("source").alias("of"), "source_size", "target", F.round("target").cast("long").alias("whole")).join(
        counts, F.col("of").eqNullSafe(F.col("counted")), "left"
    ).drop("counted")
    documents = placed(sizes, seen.rows or 0, seed, of_source)
    # Places of a document among the tokens of its source, which are repeated epoch by epoch up to the target.
    epochs = documents.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    low = F.col("start") + F.col("epoch") * F.col("source_size")
    spans = epochs.withColumn("low", low).withColumn("high", F.least(low + F.col("size"), F.col("whole")))
    width = F.col("whole") / F.col("slots")
    near = F.sequence(F.greatest(F.floor(F.col("low") / width) - 1, F.lit(0)), F.least(F.floor((F.col("high") - 1) / width) + 1, F.col("slots") - 1))
    cut = spans.withColumn("block", F.explode_outer(F.when(F.col("low") < F.col("high"), near)))
    edge = lambda rank: F.when(rank >= F.col("slots"), F.col("whole")).otherwise(F.ceil(rank * width))
    tokens = F.greatest(F.least("high", edge(F.col("block") + 1)) - F.greatest("low", edge(F.col("block"))), F.lit(0))
    pieces = cut.withColumn("tokens", tokens).where("tokens > 0 OR epoch = 0").join(
        ranks, F.col("source").eqNullSafe(F.col("slot_of")) & (F.col("block") == F.col("slot_rank")), "left"
    )
    given = F.when(F.col("slot_rank").isNotNull(), F.col("tokens")).otherwise(0)
    mixed = pieces.groupBy("row", "doc_id", "source", "size", "source_size", "target").agg(
        F.sum(given).cast("long").alias("taken"), F.sum(F.when(F.col("epoch") == 0, given).otherwise(0)).cast("long").alias("first_pass")
    )
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", "first_pass", "row")
