"""Transaction sets as rows ``(uuid, lo, hi)``: normal form, containment, skipping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableproof.operators.ordered import BLOCK, as_of, carried_max, ordered_blocks
from tableproof.session import settle

STEP_BITS = 4  # aligned spans of 16, 256, 4096 .. ids
LEVELS = 16  # as many as a bigint has steps


def merge_intervals(spans: DataFrame) -> DataFrame:
    """The fewest disjoint intervals covering the same ids; touching intervals join."""
    widest = spans.filter(F.col("lo") <= F.col("hi")).groupBy("uuid", "lo").agg(F.max("hi").alias("hi"))
    blocks = ordered_blocks(widest, ["uuid"], ["lo"])
    reach = carried_max(blocks, ["uuid"], F.col("hi"), "_carry")
    before = Window.partitionBy("uuid", BLOCK).orderBy("lo")
    reached = F.greatest(
        F.col("_carry"),
        F.max("hi").over(before.rowsBetween(Window.unboundedPreceding, -1)),
    )
    opened = blocks.join(reach, ["uuid", BLOCK], "left").withColumn("_reached", reached)
    starts = opened.withColumn(
        "_start", F.when(F.col("_reached").isNull() | (F.col("lo") > F.col("_reached") + 1), F.col("lo"))
    )
    island = F.max("_start").over(before.rowsBetween(Window.unboundedPreceding, 0))
    # inside a block every island folds to one row; only the first may continue an earlier block
    folded = starts.withColumn("_island", island).groupBy("uuid", BLOCK, "_island").agg(F.max("hi").alias("hi"))
    begun = carried_max(folded, ["uuid"], F.col("_island"), "_begun")
    return (
        folded.join(begun, ["uuid", BLOCK], "left")
        .groupBy("uuid", F.coalesce("_island", "_begun").alias("lo"))
        .agg(F.max("hi").alias("hi"))
    )


def txn_missing(marked: DataFrame, applied: DataFrame) -> DataFrame:
    """``uuid, lo, hi``: intervals of the marked set that the applied set does not hold whole.

    In normal form an interval is held by one interval or by none, and that one is the last that begins at or before
    it: a predecessor search, whose rows are the intervals themselves, however long they are."""
    have = merge_intervals(applied)
    found = as_of(merge_intervals(marked), have, ["uuid"], ["lo"], F.struct("lo", "hi"), "_held")
    return found.filter(F.coalesce(F.col("_held.hi") < F.col("hi"), F.lit(True))).select("uuid", "lo", "hi")


def txn_subset(marked: DataFrame, applied: DataFrame) -> DataFrame:
    """``uuid, missing_intervals, status`` for every uuid of the marked set."""
    lacking = txn_missing(marked, applied).groupBy("uuid").agg(F.count("*").alias("missing_intervals"))
    n = F.coalesce("missing_intervals", F.lit(0))
    return (
        marked.select("uuid").distinct().join(lacking, "uuid", "left")
        .select("uuid", n.alias("missing_intervals"), F.when(n == 0, "OK").otherwise("MISSING").alias("status"))
    )


def aligned_spans(merged: DataFrame) -> DataFrame:
    """``uuid, level, block``: disjoint intervals as aligned spans of ``16 ** level`` ids, the widest that fit.

    An interval gives at most 30 spans a level, so the rows follow the number of intervals and not their length;
    a single id gives one."""
    spans = merged.select("uuid", F.col("lo").cast("bigint").alias("_from"), (F.col("hi").cast("bigint") + 1).alias("_to"))
    parts = []
    for level in range(LEVELS):
        # what is left of the interval in units of this level; its ragged ends stay here, the middle goes up
        last = level == LEVELS - 1
        up_from = F.shiftright(F.col("_from") + ((1 << STEP_BITS) - 1), STEP_BITS)
        up_to = F.shiftright(F.col("_to"), STEP_BITS)
        middle = F.lit(False) if last else up_from < up_to
        left = F.when(middle, F.shiftleft(up_from, STEP_BITS)).otherwise(F.col("_to"))
        right = F.when(middle, F.shiftleft(up_to, STEP_BITS)).otherwise(F.col("_to"))

        def run(begin, end):
            return F.when(begin < end, F.sequence(begin, end - 1)).otherwise(F.array().cast("array<bigint>"))

        blocks = F.concat(run(F.col("_from"), left), run(right, F.col("_to")))
        parts.append(spans.select("uuid", F.lit(level).alias("level"), F.explode(blocks).alias("block")))
        if not last:
            spans = spans.filter(middle).select("uuid", up_from.alias("_from"), up_to.alias("_to"))
    return reduce(DataFrame.unionByName, parts)


def skip_applied(log: DataFrame, purged: DataFrame, uuid: str = "gtid_uuid", number: str = "gtid_no") -> DataFrame:
    """The log without the transactions the base already holds.

    The purged set becomes aligned spans, and the log meets the spans of each level that occurs on an equi key, so
    nothing is compared within a server and no span holds more than one interval. The log is neither sorted nor
    multiplied; the spans are few enough to broadcast when their measured size says so, which is left to the
    optimizer."""
    spans = settle(aligned_spans(settle(merge_intervals(purged))))
    levels = sorted(r["level"] for r in spans.select("level").distinct().collect())  # LEVELS numbers at most
    for level in levels:
        held = spans.filter(F.col("level") == level).select(F.col("uuid").alias("_uuid"), F.col("block").alias("_block"))
        on = (F.col(uuid) == F.col("_uuid")) & (F.shiftright(number, level * STEP_BITS) == F.col("_block"))
        log = log.join(held, on, "left_anti")
    return log
