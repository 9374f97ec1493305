"""The fingerprint of a table kept up to date by its change log."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tableproof.functions.canonical import canonical_row
from tableproof.operators.fingerprint import lane_names, render_state, row_lanes, sum_state
from tableproof.operators.ordered import running_sums
from tableproof.session import keyed_state
from tableproof.streaming.catalogue import bucket_of


#: State rows that keys are dealt to by their hash. A call of Python per key costs many times what the key's changes do.
BUCKETS = 2048


class _Rows(StatefulProcessor):
    """Per key of a bucket the lanes of its row as it is now; a change takes the old row's lanes out and puts the new row's in."""

    def __init__(self, lanes: Sequence[str]):
        self.sums = ["octets", *lanes]

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = ["key array<string>", "idx array<bigint>", "pos array<bigint>", "alive array<boolean>", *[f"{c} array<bigint>" for c in self.sums]]
        self.rows = handle.getValueState("rows", ", ".join(kinds))

    def _held(self) -> dict[str, tuple]:
        if not self.rows.exists():
            return {}
        keys, *columns = self.rows.get()
        return dict(zip(keys, zip(*columns, strict=True), strict=True))

    def _hold(self, held: dict[str, tuple]) -> None:
        self.rows.update((list(held), *[list(column) for column in zip(*held.values(), strict=True)]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        held = self._held()
        for name, *sums in zip(*[initialState[c].tolist() for c in ("key", *self.sums)], strict=True):
            held[name] = (-1, -1, True, *sums)
        self._hold(held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, nothing = self._held(), [0] * len(self.sums)
        columns = ["idx", "pos", "key", "op", *self.sums]
        changes = [change for part in rows for change in zip(*[part[c].tolist() for c in columns], strict=True)]
        changes.sort(key=lambda change: change[:2])
        last: dict[tuple, tuple] = {}
        for change in changes:
            idx, pos, name = change[:3]
            # a change at or before the last one seen was counted already
            if name not in held or (idx, pos) > held[name][:2]:
                last[idx, name] = change
        out = []
        for idx, pos, name, op, *sums in last.values():
            lives, new = op != "D", sums if op != "D" else nothing
            _, _, alive, *now = held.get(name) or (-1, -1, False, *nothing)
            out.append((idx, int(lives) - int(alive), *[a - b for a, b in zip(new, now, strict=True)]))
            held[name] = (idx, pos, lives, *new)
        if out:
            self._hold(held)
            yield pd.DataFrame(out, columns=["idx", "n", *self.sums])

    def close(self) -> None:
        pass


def _lanes(rows: DataFrame, key: Sequence[str], values: Sequence[str], algo: str, buckets: int, extra: Sequence[str] = ()) -> DataFrame:
    """``bucket, key, extra, octets, lanes`` of the rows ``key, values``; the key is its canonical text."""
    named = rows.select(canonical_row(rows.select(*key)).alias("_key"), *[F.col(c).alias(f"_{c}") for c in extra], *key, *values)
    lanes = row_lanes(named, algo=algo, keys=["_key", *[f"_{c}" for c in extra]])
    return lanes.select(bucket_of("_key", buckets).alias("bucket"), F.col("_key").alias("key"), *[F.col(f"_{c}").alias(c) for c in extra],
                        "octets", *lane_names(algo))


def stream_changes(log: DataFrame, key: Sequence[str], values: Sequence[str], base: DataFrame | None = None, algo: str = "md5",
                   buckets: int = BUCKETS) -> DataFrame:
    """``idx, n, octets, lanes`` to add: what each key's changes of a log file do to the table's sum state. ``append`` output.

    ``log``: a stream of ``idx, pos, op`` with the key and value columns, in the log's order from batch to batch. The
    state holds a few numbers per key, never a row; ``base`` is the table the log starts from, unique by key. Changes
    that come a second time count once. Keys share ``buckets`` rows of state, and a batch reads and writes those of its own
    keys; their number is fixed by the first batch."""
    keyed_state(log.sparkSession)
    names = lane_names(algo)
    changes = _lanes(log, key, values, algo, buckets, ["idx", "pos", "op"])
    begun = None if base is None else _lanes(base, key, values, algo, buckets).groupBy("bucket")
    out = ", ".join(["idx bigint", "n bigint", "octets bigint", *[f"{n} bigint" for n in names]])
    return changes.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Rows(names), outputStructType=out, outputMode="Append", timeMode="None", initialState=begun)


def fold_changes(changes: DataFrame, algo: str = "md5") -> DataFrame:
    """One row a log file from the rows of :func:`stream_changes`, for keeping."""
    return changes.groupBy("idx").agg(
        F.sum("n").alias("n"), F.sum("octets").alias("octets"), *[F.sum(F.col(n).cast("decimal(38,0)")).cast("decimal(38,0)").alias(n) for n in lane_names(algo)])


def fingerprints_at(ledger: DataFrame, base: DataFrame | None = None, algo: str = "md5") -> DataFrame:
    """``idx, algo, digest, n, fingerprint, octets`` of the table as it stood behind every log file of the ledger, equal to
    the batch fingerprint of the state replayed up to there."""
    names = lane_names(algo)
    files = fold_changes(ledger, algo)
    if base is not None:
        begun = sum_state(row_lanes(base, algo=algo), algo=algo).select(F.lit(-1).cast("bigint").alias("idx"), "n", "octets", *names)
        files = files.unionByName(begun)
    sums = running_sums(files, [], ["idx"], ["n", "octets", *names])
    return render_state(sums.filter("idx >= 0"), ["idx"], algo, witness=True)
