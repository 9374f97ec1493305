"""Databases whose backups stop arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableproof.functions import names as N


def stream_staleness(names: DataFrame, days: int) -> DataFrame:
    """``db, stamp, now, stale`` after every batch that touches a database (``update`` output).

    ``names``: ``name, now`` rows; the clock travels with them, so a tick is a row that repeats any
    known name with a later ``now``. Both are running maxima, so a late, older name never lowers the
    newest stamp, and each task sends one row per database to the state."""
    stamped = names.select(
        N.artefact_db(F.col("name")).alias("db"), N.artefact_stamp(F.col("name")).alias("stamp"), F.col("now").cast("bigint").alias("now")
    ).filter("stamp IS NOT NULL")
    newest = stamped.groupBy("db").agg(F.max("stamp").alias("stamp"), F.max("now").alias("now"))
    # counted from a zoneless epoch, so that the session's zone does not shift the cutoff
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("now") - days * N.DAY).cast("decimal(18,6)"))
    cutoff = F.date_format(F.expr("timestamp_ntz'1970-01-01 00:00:00'") + since, "yyyyMMdd'T'HHmmss'Z'")
    return newest.select("db", "stamp", "now", (F.col("stamp") < cutoff).alias("stale"))
