"""Running values over an order, without ever putting one key into one task.

A plain window over ``partitionBy(key)`` sorts a whole key in a single task. Here the rows are
range-partitioned on ``(keys, order)``, so a hot key spreads over many tasks; each task folds its own
block, the block summaries (one row per key and block) give what must be carried in, and the two are
combined. The ranged rows are settled first: block numbers come from sampled boundaries, and a lost
executor must not draw them anew.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableproof.session import settle

BLOCK = "_block"


def ordered_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` plus a block number that grows with ``(keys, order)``."""
    ranged = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]])
    return settle(ranged.withColumn(BLOCK, F.spark_partition_id()))


def carried_max(blocks: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """``keys, block, out``: the maximum of ``value`` over all earlier blocks of the key."""
    heads = blocks.groupBy(*keys, BLOCK).agg(F.max(value).alias("_head"))
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return heads.select(*keys, BLOCK, F.max("_head").over(before).alias(out))


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
                inclusive: bool = True, spread: Sequence[str] = ()) -> DataFrame:
    """``df`` plus the running maximum of ``value`` in ``order``; ``order`` must be unique per key, unless it does not
    matter which of equal rows comes first. By ``spread`` equal rows may lie in several blocks."""
    blocks = ordered_blocks(df, keys, [*order, *spread])
    carry = carried_max(blocks, keys, value, "_carry")
    frame = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    joined = blocks.withColumn("_local", F.max(value).over(frame)).join(carry, [*keys, BLOCK], "left")
    return joined.withColumn(out, F.greatest("_carry", "_local")).drop("_carry", "_local")


def places(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "place") -> DataFrame:
    """``df`` plus the place of each row in ``order`` within its keys, from one; texts order by their bytes.
    ``order`` must be unique per key. A key's rows are spread over blocks, whose sizes are carried over."""
    blocks = ordered_blocks(df, keys, order)
    sizes = blocks.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.select(*keys, BLOCK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy(*order))
    met = blocks.withColumn("_own", own).join(carried, [*keys, BLOCK])
    return met.withColumn(out, F.col("_own") + F.col("_before")).drop("_own", "_before", BLOCK)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``df`` with each of ``values`` replaced by its sum up to and including the row, in ``order``, which must be unique
    per key. Blocks are summed where they lie and their sums carried over."""
    blocks = ordered_blocks(df, keys, order)
    sums = blocks.groupBy(*keys, BLOCK).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, BLOCK, *[F.sum(f"_{v}").over(before).alias(f"_{v}") for v in values])
    inner = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = blocks.withColumns({f"_own_{v}": F.sum(v).over(inner) for v in values}).join(carried, [*keys, BLOCK])
    rest = [c for c in df.columns if c not in values]
    return met.select(*rest, *[(F.col(f"_own_{v}") + F.coalesce(f"_{v}", F.lit(0))).cast(df.schema[v].dataType).alias(v) for v in values])


def as_of(points: DataFrame, events: DataFrame, keys: Sequence[str], order: Sequence[str],
          value: Column, out: str) -> DataFrame:
    """``points`` plus, for each, the maximum of ``value`` over events of its keys at or before it; null where a key or
    position is.

    Points pass as they are, behind the events of their position: nothing is joined back, so neither pairs within a key
    nor repeated positions multiply anything, and a position of very many rows lies in several blocks."""
    on = [*keys, *order]
    placed = reduce(Column.__and__, [F.col(c).isNotNull() for c in on])
    given = events.filter(placed).select(*on, value.alias("_value"), F.lit(0).alias("_rank"))
    tagged = points.withColumn("_rank", F.lit(1)).unionByName(given, allowMissingColumns=True)
    salt = F.xxhash64("_value", *[c for c, kind in points.dtypes if "map<" not in kind])
    scanned = running_max(tagged.withColumn("_salt", salt), keys, [*order, "_rank"], F.col("_value"), "_found", spread=["_salt"])
    own = [F.col(c).cast(points.schema[c].dataType).alias(c) for c in points.columns]
    return scanned.filter(F.col("_rank") == 1).select(*own, F.when(placed, F.col("_found")).alias(out))
