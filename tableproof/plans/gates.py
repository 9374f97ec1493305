"""Gates in cost order, and the check rows of a snapshot."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableproof.functions import names as N
from tableproof.operators import compare as C
from tableproof.session import settle

CHECK_COLUMNS = "snapshot string, gate string, subject string, status string, severity string"


@dataclass(frozen=True)
class Gate:
    """``checks`` is called only when every earlier gate let it; one Spark action per gate."""

    name: str
    checks: Callable[[], DataFrame]
    refuting: bool = True  # a failure here makes the dearer gates pointless


@dataclass(frozen=True)
class Outcome:
    checks: DataFrame
    stopped_at: str | None


def gates_in_cost_order(gates: Sequence[Gate]) -> Outcome:
    """Run the gates, cheapest first, and stop behind the first refuting one that fails. The check
    rows are kept, so each gate is computed once."""
    done, stopped = [], None
    for gate in gates:
        rows = settle(gate.checks())
        done.append(rows)
        if gate.refuting and not rows.filter(F.col("severity").isin("failure", "refusal")).isEmpty():
            stopped = gate.name
            break
    return Outcome(reduce(DataFrame.unionByName, done), stopped)


def checks(df: DataFrame, snapshot: str, gate: str, subject: str, severity: str = "failure",
           ok: Sequence[str] = ("OK",)) -> DataFrame:
    return C.problems_of(df, gate, subject, snapshot, severity, tuple(ok))


def table_checks(snapshot: str, expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Content of every table; an unusable fingerprint is a refusal, not a failure."""
    compared = C.compare_tables(expected, actual)
    rows = checks(compared, snapshot, "tables", "table")
    return rows.withColumn("severity", F.when(F.col("status").isin("UNUSABLE", "FOREIGN_METHOD"), "refusal").otherwise(F.col("severity")))


def object_checks(snapshot: str, expected: DataFrame | None, actual: DataFrame | None) -> DataFrame | None:
    """Schema objects; a manifest that lists none gives a warning, because only data was compared."""
    if expected is None or actual is None:
        return None
    return checks(C.compare_objects(expected, actual), snapshot, "objects", "class")


def counter_checks(snapshot: str, counters: DataFrame, maxima: DataFrame, inclusive: bool) -> DataFrame:
    return checks(C.counter_probe(counters, maxima, inclusive), snapshot, "counters", "tbl")


def one_check(spark, snapshot: str, gate: str, subject: str, status: str, severity: str) -> DataFrame:
    return spark.createDataFrame([(snapshot, gate, subject, status, severity)], CHECK_COLUMNS)


def age_rows(manifests: DataFrame, now: int, max_age_days: int) -> DataFrame:
    """``snapshot, taken, stale`` of manifests ``name, created_at``; a null ``taken`` is left
    for the caller to refuse."""
    taken = N.taken_at(F.col("created_at"), F.col("name"))
    return manifests.select(F.col("name").alias("snapshot"), taken.alias("taken"), F.coalesce(N.past_window(taken, now, max_age_days), F.lit(False)).alias("stale"))


def snapshot_checks(snapshot: str, expected: DataFrame, actual: DataFrame, expected_objects: DataFrame | None = None,
                    actual_objects: DataFrame | None = None, counters: DataFrame | None = None,
                    maxima: DataFrame | None = None, inclusive: bool = True) -> DataFrame:
    """Every gate behind the load as one relation of check rows."""
    parts = [table_checks(snapshot, expected, actual), object_checks(snapshot, expected_objects, actual_objects)]
    if counters is not None and maxima is not None:
        parts.append(counter_checks(snapshot, counters, maxima, inclusive))
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])
