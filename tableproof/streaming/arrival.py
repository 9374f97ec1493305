"""Files that grow until they are whole."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tableproof.session import keyed_state
from tableproof.streaming.catalogue import bucket_of

OUTPUT = "name string, status string, size bigint, observed_at bigint"
STATE = "name array<string>, size array<bigint>, observed_at array<bigint>, first_ms array<bigint>, done array<boolean>"

#: State rows that names are dealt to by their hash. A call of Python per name costs a hundred times what the name's looks do.
BUCKETS = 2048


def held_names(state: GroupState) -> dict[str, tuple]:
    """What a bucket's state holds, by name."""
    if not state.exists:
        return {}
    names, *columns = state.get
    return dict(zip(names, zip(*columns, strict=True), strict=True))


def hold(state: GroupState, held: dict[str, tuple]) -> None:
    """The bucket's state from ``held``; an empty bucket has none."""
    if held:
        state.update((list(held), *[list(column) for column in zip(*held.values(), strict=True)]))
    elif state.exists:
        state.remove()


def stream_arrival(observations: DataFrame, whole_bytes: int, encrypted: bool, timeout_ms: int | None = None,
                   buckets: int = BUCKETS) -> DataFrame:
    """``name, status, size, observed_at`` once per name from observations ``name, size, observed_at``.

    A plain file is whole at exactly ``whole_bytes``; ciphertext when it is larger than that and two
    consecutive observations agree. A name that is not whole ``timeout_ms`` after it was first seen is
    TIMED_OUT, however often it is looked at meanwhile; leave the limit out for a stream that is run to
    its end (``availableNow``), which a pending time-out would keep alive. A finished name keeps three
    numbers of state without a time-out: a later look at it says nothing. Names share ``buckets`` rows of state, and a batch
    reads and writes those of its own names; their number is fixed by the first batch. Use with ``append`` output."""

    def observe(key: tuple[int], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, told, looked = held_names(state), [], set()
        now = None if timeout_ms is None else state.getCurrentProcessingTimeMs()
        if not state.hasTimedOut:
            looks = [look for part in batches for look in zip(part["observed_at"], part["name"], part["size"], strict=True)]
            for now_seen, name, now_size in sorted(looks, key=lambda look: look[0]):
                size, seen, first, done = held.get(name) or (None, None, now, False)
                looked.add(name)
                if done or (seen is not None and now_seen <= seen):
                    continue
                done = (now_size > whole_bytes and now_size == size) if encrypted else now_size == whole_bytes
                held[name] = (int(now_size), int(now_seen), first, bool(done))
                if done:
                    told.append((name, "WHOLE", int(now_size), int(now_seen)))
        if timeout_ms is not None:
            for name, (size, seen, first, done) in held.items():
                if not done and first + timeout_ms <= now and name not in looked:
                    held[name] = (size, seen, first, True)
                    told.append((name, "TIMED_OUT", size, seen))
        hold(state, held)
        waiting = [first for _, _, first, done in held.values() if not done] if timeout_ms is not None else []
        if waiting:
            state.setTimeoutDuration(max(1, min(waiting) + timeout_ms - now))
        if told:
            yield pd.DataFrame(told, columns=["name", "status", "size", "observed_at"])

    keyed_state(observations.sparkSession)
    timeout = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    dealt = observations.select(bucket_of("name", buckets).alias("bucket"), "name", "size", "observed_at")
    return dealt.groupBy("bucket").applyInPandasWithState(observe, OUTPUT, STATE, "append", timeout)
