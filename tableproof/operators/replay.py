"""Roll a base forward to an instant through a change log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableproof.operators.intervals import skip_applied

Position = tuple[int, int]


def position(idx: str = "idx", pos: str = "pos") -> Column:
    """Log positions order like structs."""
    return F.struct(F.col(idx), F.col(pos))


def before(point: Position) -> Column:
    """Strictly before a position, which names the *next* event. Spelled out, so that the bound on
    ``idx`` reaches the scan."""
    idx, pos = point
    return (F.col("idx") <= idx) & ((F.col("idx") < idx) | (F.col("pos") < pos))


def at_or_after(point: Position) -> Column:
    idx, pos = point
    return (F.col("idx") >= idx) & ((F.col("idx") > idx) | (F.col("pos") >= pos))


def latest_change(log: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The last change of every key as ``key, op, values``. An aggregate, not a window: each task
    keeps one change per key before the shuffle, so a hot key costs nothing extra."""
    last = F.max_by(F.struct("op", *values), position())
    return log.groupBy(*key).agg(last.alias("_last")).select(*key, "_last.*")


def latest_state(log: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows alive after the log: the last change per key, deletes dropped."""
    return latest_change(log, key, values).filter("op <> 'D'").drop("op")


def quiesced(before_df: DataFrame, after_df: DataFrame) -> DataFrame:
    """``db, quiesced``: yes where the log position did not move between the two readings."""
    b = before_df.groupBy("db").agg(F.max(position()).alias("before"))
    a = after_df.groupBy("db").agg(F.max(position()).alias("after"))
    return b.join(a, "db", "full_outer").select(
        "db",
        F.col("before.idx").alias("before_idx"),
        F.col("before.pos").alias("before_pos"),
        F.col("after.idx").alias("after_idx"),
        F.col("after.pos").alias("after_pos"),
        F.when(F.col("before").eqNullSafe(F.col("after")), "yes").otherwise("no").alias("quiesced"),
    )


def replay_to_mark(base: DataFrame, log: DataFrame, anchor: Position, mark: Position, key: Sequence[str],
                   values: Sequence[str], purged: DataFrame | None = None, target: str = "position") -> DataFrame:
    """State at the mark: base plus the changes in ``[anchor, mark)``.

    ``named``: the log must hold a row at exactly the mark, else the query fails. ``position``: an
    unreached mark is silent, so arrival has to be proven by content. One partial aggregate over the
    pruned log and one join on the key; both sides are unique per key."""
    if target not in ("position", "named"):
        raise ValueError(f"unknown target {target!r}")
    window = log.filter(at_or_after(anchor) & before(mark))
    if purged is not None:
        window = skip_applied(window, purged)
    changes = latest_change(window, key, values).withColumn("_changed", F.lit(True))
    renamed = changes.select(*key, "op", "_changed", *[F.col(v).alias(f"_new_{v}") for v in values])
    merged = base.select(*key, *values).join(renamed, list(key), "full_outer")
    alive = merged.filter(F.col("_changed").isNull() | (F.col("op") != "D"))
    state = alive.select(
        *key, *[F.when(F.col("_changed"), F.col(f"_new_{v}")).otherwise(F.col(v)).alias(v) for v in values]
    )
    if target == "named":
        arrived = log.filter((F.col("idx") == mark[0]) & (F.col("pos") == mark[1])).agg(F.count("*").alias("n"))
        reached = F.when(arrived.scalar() > 0, F.lit(True)).otherwise(
            F.raise_error(F.lit(f"recovery target {mark[0]}:{mark[1]} is not in the log")).cast("boolean")
        )
        state = state.filter(reached)
    return state
