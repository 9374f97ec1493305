"""Ordered change logs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableproof.operators.replay import Position, at_or_after, before

LOG_COLUMNS = ("series", "idx", "pos", "gtid_uuid", "gtid_no", "op")


def read_change_log(spark: SparkSession, path: str, source: str = "parquet", series: str | None = None,
                    anchor: Position | None = None, mark: Position | None = None, schema: str | None = None) -> DataFrame:
    """The log between anchor and mark. Bounds on ``series`` and ``idx`` reach the scan, so a log
    stored by series or sorted by index is read only where it is needed."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    log = reader.format(source).load(path)
    missing = {"idx", "pos", "op"} - set(log.columns)
    if missing:
        raise ValueError(f"not a change log: no column {sorted(missing)}")
    if series is not None:
        log = log.filter(F.col("series") == series)
    if anchor is not None:
        log = log.filter(at_or_after(anchor))
    if mark is not None:
        log = log.filter(before(mark))
    return log
