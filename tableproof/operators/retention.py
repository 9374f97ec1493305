"""Which backups go, and the line below which a log archive is dead weight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableproof.functions import names as N
from tableproof.session import stored


def retention_flags(pairs: DataFrame, keep: int, keep_days: int, now: int) -> DataFrame:
    """Every stamped name of ``pairs`` (``db, name``, a set) with a ``victim`` flag.

    Kept: among the newest ``keep``, not older than the cutoff, or the newest of all. The newest
    ``keep`` names per database are found with a limit that is applied before the shuffle, and only
    the oldest of them, one row per database, meets the pairs."""
    stamped = (
        pairs.select("db", "name").distinct()
        .withColumn("stamp", N.name_stamp(F.col("name"), F.col("db")))
        .filter(F.col("stamp").isNotNull())
    )
    if keep <= 0 and keep_days <= 0:
        return stamped.withColumn("victim", F.lit(False))
    newest = Window.partitionBy("db").orderBy(F.col("name").desc())
    kept_from = (
        stamped.select("db", "name")
        .withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= max(keep, 1))
        .groupBy("db")
        .agg(F.min("name").alias("_kept_from"))
    )
    # one row a database, written first: its size is known, so it is broadcast while it is small, and otherwise
    # both sides are dealt anew and a database with most of the names can be split. A large ``keep`` costs a
    # sort of ``keep`` names a database in one task
    kept_from = stored(kept_from, "kept-from")
    old = F.lit(True) if keep_days <= 0 else F.col("stamp") < N.stamp_text(now - keep_days * N.DAY)
    return (
        stamped.join(kept_from, "db")
        .withColumn("victim", (F.col("name") < F.col("_kept_from")) & old)
        .drop("_kept_from")
    )


def retention_victims(pairs: DataFrame, keep: int, keep_days: int, now: int) -> DataFrame:
    """``db, name, stamp`` of what goes. Oldest first is the order of ``name``."""
    return retention_flags(pairs, keep, keep_days, now).filter("victim").select("db", "name", "stamp")


def retention_summary(flags: DataFrame, keep: int, keep_days: int) -> DataFrame:
    folded = flags.groupBy("db").agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("victim")).alias("kept"),
        F.count_if(F.col("victim")).alias("dropped"),
    )
    return folded.withColumn("rule", N.retention_rule(keep, keep_days))


def retention_line(bases: DataFrame, keep: int, keep_days: int, now: int) -> DataFrame:
    """Per database that loses a base: the start of its oldest kept base.

    ``bases``: ``db, name, series, idx, pos``. Victims are always the oldest names, so one minimum
    over the kept ones is the line. REFUSED when that base carries no start."""
    return line_of_flags(retention_flags(bases, keep, keep_days, now), bases)


def line_of_flags(flags: DataFrame, bases: DataFrame) -> DataFrame:
    """The line from flags that are known already."""
    starts = bases.select("db", "name", "series", "idx", "pos").dropDuplicates(["db", "name"])
    with_start = flags.join(starts, ["db", "name"])
    kept = F.min(F.when(~F.col("victim"), F.struct("name", "series", "idx", "pos")))
    folded = with_start.groupBy("db").agg(kept.alias("_kept"), F.count_if("victim").alias("dropped_bases"))
    return folded.filter("dropped_bases > 0").select(
        "db",
        F.col("_kept.name").alias("base"),
        F.col("_kept.series").alias("series"),
        F.col("_kept.idx").alias("idx"),
        "dropped_bases",
        F.when(F.col("_kept.series").isNull() | F.col("_kept.idx").isNull(), "REFUSED").otherwise("LINE").alias("status"),
    )


def below_line(df: DataFrame, lines: DataFrame, keys: Sequence[str] = ("db",)) -> DataFrame:
    """Rows of the line's own series strictly below it; other series always survive."""
    cut = lines.filter("status = 'LINE'").select(*keys, "series", F.col("idx").alias("_cut"))
    return df.join(cut, [*keys, "series"]).filter(F.col("idx") < F.col("_cut")).drop("_cut")


def prune_chain(bases: DataFrame, marks: DataFrame, listing: DataFrame, keep: int, keep_days: int,
                now: int) -> DataFrame:
    """A plan ``db, kind, name, decision``; nothing is deleted here.

    ``listing``: ``db, name, series, idx, kind`` of archive files. Only log files and their backup
    companions may go; history files, strays, other series and the line's own file stay. Marks are
    tested for ownership, so a sibling's mark never goes."""
    flags = retention_flags(bases, keep, keep_days, now)
    lines = line_of_flags(flags, bases)
    refused = lines.filter("status = 'REFUSED'").select(
        "db", F.lit("base").alias("kind"), F.col("base").alias("name"), F.lit("REFUSED").alias("decision")
    )
    firm = lines.filter("status = 'LINE'").select("db")
    gone_bases = (
        flags.filter("victim").join(firm, "db", "left_semi")
        .select("db", F.lit("base").alias("kind"), "name")
    )
    own_marks = marks.filter(N.name_stamp(F.col("name"), F.col("db")).isNotNull())
    gone_marks = below_line(own_marks, lines).select("db", F.lit("mark").alias("kind"), "name")
    files = listing.filter(F.col("kind").isin("segment", "log", "backup_history"))
    gone_files = below_line(files, lines).select("db", F.lit("file").alias("kind"), "name")
    drops = gone_bases.unionByName(gone_marks).unionByName(gone_files)
    return drops.withColumn("decision", F.lit("DROP")).unionByName(refused)


def prune_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("db", "kind", "decision").agg(F.count("*").alias("n"))
