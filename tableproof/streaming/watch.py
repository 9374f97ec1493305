"""Files that grow until they are whole, with a limit on how long and on what is remembered."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tableproof.session import keyed_state
from tableproof.streaming.arrival import BUCKETS, held_names, hold
from tableproof.streaming.catalogue import bucket_of

OUTPUT = "name string, status string, size bigint, observed_at timestamp"
STATE = "name array<string>, size array<bigint>, seen_ms array<bigint>, due_ms array<bigint>, done array<boolean>"


class _Watch:
    """Per name of a bucket its last look and when it is due: to be given up while it grows, to be forgotten once it is judged."""

    def __init__(self, whole_bytes: int, encrypted: bool, limit_ms: int, forget_ms: int):
        self.whole_bytes, self.encrypted, self.limit_ms, self.forget_ms = whole_bytes, encrypted, limit_ms, forget_ms

    def __call__(self, key: tuple[int], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, told = held_names(state), []
        if not state.hasTimedOut:
            looks = [look for part in batches for look in zip(part["seen_ms"], part["size"], part["name"], strict=True)]
            for at, now, name in sorted(looks, key=lambda look: look[:2]):
                self._look(held, told, name, int(at), int(now))
        self._expire(held, told, state.getCurrentWatermarkMs())
        hold(state, held)
        if held:
            # called as soon as the watermark is past the time set, so due at the earliest due itself
            state.setTimeoutTimestamp(max(1, state.getCurrentWatermarkMs(), min(due for _, _, due, _ in held.values()) - 1))
        if told:
            rows = pd.DataFrame(told, columns=["name", "status", "size", "observed_at"])
            yield rows.assign(observed_at=pd.to_datetime(rows["observed_at"], unit="ms"))

    def _look(self, held: dict[str, tuple], told: list[tuple], name: str, at: int, now: int) -> None:
        size, seen, due, done = held.get(name) or (None, None, at + self.limit_ms, False)
        # a look behind the limit comes too late, whatever it shows; the timer tells
        if done or (seen is not None and (at <= seen or seen > due)):
            return
        whole = (now > self.whole_bytes and now == size) if self.encrypted else now == self.whole_bytes
        if whole and at <= due:
            held[name] = (now, at, at + self.forget_ms, True)
            told.append((name, "WHOLE", now, at))
        else:
            held[name] = (now, at, due, False)

    def _expire(self, held: dict[str, tuple], told: list[tuple], clock: int) -> None:
        for name in [name for name, (_, _, due, _) in held.items() if due <= clock]:
            size, seen, due, done = held[name]
            if not done:
                told.append((name, "TIMED_OUT", size, seen))
            if done or due + self.forget_ms <= clock:
                del held[name]  # in the second case the clock has gone on so far that it would be forgotten in the same breath
            else:
                held[name] = (size, seen, due + self.forget_ms, True)


def watch_arrival(observations: DataFrame, whole_bytes: int, encrypted: bool, limit_s: int, forget_s: int,
                  buckets: int = BUCKETS) -> DataFrame:
    """``name, status, size, observed_at`` once per name: WHOLE, or TIMED_OUT ``limit_s`` after its first look.

    ``observations``: ``name, size, observed_at`` (a timestamp). A plain file is whole at exactly ``whole_bytes``, ciphertext
    when it is larger and two consecutive looks agree. The clock is the newest look at any file, so time-outs come
    without a look at the file itself and a replay gives the same answers. A judged name is forgotten ``forget_s``
    later and holds no state from then on; a look at it that comes later still starts anew, so ``forget_s`` should
    exceed the time that names are looked at. Names share ``buckets`` rows of state, and a batch reads and writes those
    of its own names and of those that are due; their number is fixed by the first batch. ``append`` output."""
    keyed_state(observations.sparkSession)
    timed = observations.select(bucket_of("name", buckets).alias("bucket"), "name", F.col("size").cast("bigint").alias("size"),
                                F.unix_millis("observed_at").alias("seen_ms"), "observed_at")
    watch = _Watch(whole_bytes, encrypted, limit_s * 1000, forget_s * 1000)
    return timed.withWatermark("observed_at", "0 seconds").groupBy("bucket").applyInPandasWithState(
        lambda key, batches, state: watch(key, batches, state), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
