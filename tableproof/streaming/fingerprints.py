"""The mergeable fingerprint over a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tableproof.operators.fingerprint import fingerprint_sum


def stream_fingerprint(rows: DataFrame, algo: str = "md5", keys: Sequence[str] = ()) -> DataFrame:
    """The sum fingerprint of everything seen so far, as a streaming aggregation (``complete`` or
    ``update`` mode). The state is one row of sums per key, whatever the volume, and equals the batch
    fingerprint of the same rows in any order and any split into batches."""
    return fingerprint_sum(rows, "strict", algo, keys)
