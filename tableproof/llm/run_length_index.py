"""Operator 3: long repeats marked with run-length compressed indexes.

A byte is covered when a string of ``length`` bytes over it also starts anywhere else. Strings that are
equal have the same anchor (the leftmost smallest hash among their ``GRAM``-byte grams), so texts need only meet where they share
one:

1. every distinct text gives its anchors' hashes; hashes of one place fall out by count;
2. texts with a shared anchor are cut into units, the stretch of strings that have one anchor; equal units are one
   with a flag, so copies cost nothing;
3. units meet by anchor in buckets of bounded size. A bucket's Burrows-Wheeler transform is run-length
   encoded and suffix positions are kept at run ends only. Matching statistics of the bucket against itself (own place excluded)
   start anew only there, by the common extension of the two suffixes that meet at a run border, and go on
   in text order losing one a byte; where they reach ``length``, the string repeats;
4. an anchor with more different units than a bucket holds is cut finer: its units are dealt by the bytes that all
   strings of a narrower stretch have in common, down to single strings, where what meets is equal.

Only hashes, units and marks move, and texts that have a shared anchor; a text is held by one task at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableproof.llm.common import settled

GRAM = 128
PIECE = 1 << 21
BUCKET_BYTES = 256 << 10
GROUP_UNITS = 512
#: Widths of the stretches that an overfull anchor is cut into; at one, each unit is a single string.
FINER = (24, 1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every ``gram`` bytes, by doubling; equal grams have equal hashes."""
    with np.errstate(over="ignore"):
        h, have, factor = (data.astype(np.uint64) + np.uint64(1)) * MULTIPLIER, 1, MULTIPLIER
        while have * 2 <= gram:
            h, factor, have = h[:-have] * factor + h[have:], factor * factor, have * 2
        if have < gram:
            rest = gram - have
            h = h[:-rest] * MULTIPLIER + h[rest:]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes, first and last string starts of the anchors of all strings of ``length`` bytes."""
    found = []
    for begin in range(0, max(0, len(data) - length + 1), PIECE):
        part = data[begin:begin + PIECE + length - 1]
        h, w = gram_hashes(part, gram), length - gram + 1
        ordered = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(ordered) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        padded[:len(ordered)] = ordered
        rows = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(h) - w + 1
        place = (np.minimum(behind[:n], ahead[w - 1:w - 1 + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        last = np.concatenate([first[1:] - 1, [n - 1]])
        found.append((place[first] + begin, h[place[first]], first + begin, last + begin))
    if not found:
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]


class RunLengthIndex:
    """The run-length encoded Burrows-Wheeler transform of some texts, with suffix positions at run ends.

    Texts are set off by separators of their own, so no match crosses one. Suffixes are ordered by their first
    ``depth`` symbols at least, which is all that matches of up to ``depth`` need."""

    def __init__(self, texts: list[bytes], depth: int):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.begins = np.cumsum(lengths) - lengths
        symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64)
        ends = self.begins + lengths - 1
        symbols[ends] = 256 + np.arange(len(texts))
        order, self.levels = self._suffixes(symbols, depth)
        before = symbols[order - 1]
        border = np.flatnonzero(np.diff(before) != 0) + 1
        heads = np.concatenate([[0], border])
        self.run_symbols, self.run_lengths = before[heads], np.diff(np.concatenate([heads, [len(symbols)]]))
        self.head_places, self.end_places = order[heads], order[np.concatenate([border - 1, [len(symbols) - 1]])]
        self.size = len(symbols)

    @staticmethod
    def _suffixes(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """The suffix order, and ranks by the first 1, 2, 4, ... symbols."""
        n, have = len(symbols), 1
        rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        levels = [(1, rank)]
        while True:
            key = rank * (n + 1)
            key[:-have] += rank[have:] + 1
            order = np.argsort(key, kind="stable")
            fresh = np.concatenate([[0], (np.diff(key[order]) != 0).astype(np.int64)])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh)
            have *= 2
            levels.append((have, rank))
            if have >= depth or fresh.sum() == n - 1:
                return order, levels

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at ``a`` and ``b``, which differ."""
        a, b, got = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for size, rank in reversed(self.levels):
            while True:
                same = (np.maximum(a, b) < self.size) & (a != b)
                same[same] = rank[a[same]] == rank[b[same]]
                if not same.any():
                    break
                a[same] += size
                b[same] += size
                got[same] += size
        return got

    def matching_statistics(self) -> np.ndarray:
        """For every place the longest match that starts anywhere else, from the samples at run borders."""
        above, below = self.end_places[:-1], self.head_places[1:]
        shared = self.common(above, below)
        reach = np.arange(self.size)
        np.maximum.at(reach, above, above + shared)
        np.maximum.at(reach, below, below + shared)
        return np.maximum.accumulate(reach) - np.arange(self.size)

    def repeats(self, length: int) -> list[list[tuple[int, int]]]:
        """For every text the runs (first, number) of starts of strings of ``length`` that repeat."""
        long = (self.matching_statistics() >= length).astype(np.int8)
        step = np.diff(np.concatenate([[0], long, [0]]))
        first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        text = np.searchsorted(self.begins, first, side="right") - 1
        out: list[list[tuple[int, int]]] = [[] for _ in self.begins]
        for t, f, e in zip(text.tolist(), first.tolist(), last.tolist()):
            out[t].append((f - int(self.begins[t]), e - f))
        return out


def _signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def _short(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def shared_anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``tid, hashes``: the anchors of each text that also stand at another place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint8)
                h, n = np.unique(anchors(data, length, gram)[1], return_counts=True)
                if len(h):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[i].as_py()] * len(h), pa.binary()), pa.array(_signed(h)), pa.array(n > 1)],
                        ["tid", "h", "again"])

    seen = settled(texts.mapInArrow(work, "tid binary, h bigint, again boolean"), "anchors")
    place = F.xxhash64("tid")
    # written, so that both sides of the join are dealt anew and a hot anchor can be split
    often = settled(seen.groupBy("h").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.max("again").alias("z")).filter(
        "x < y OR z").select("h"), "often")
    return seen.join(often, "h").groupBy("tid").agg(F.collect_set("h").alias("hashes"))


UNITS = "key bigint, uid binary, tid binary, at array<int>, n_starts int, anchor int, unit binary"


def cut_units(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows ``tid, data, hashes`` to the units of the shared anchors, each different unit of a text once."""
    for batch in batches:
        for i in range(batch.num_rows):
            tid, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            wanted = batch.column(2)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
            place, h, first, last = anchors(np.frombuffer(raw, np.uint8), length, gram)
            found: dict[tuple[int, bytes], list] = {}
            for j in np.flatnonzero(np.isin(h, wanted)).tolist():
                f, e = int(first[j]), int(last[j])
                unit = raw[f:e + length]
                found.setdefault((int(h[j]), unit), [int(place[j]) - f, e - f + 1]).append(f)
            rows = list(found.items())
            for start in range(0, len(rows), 2048):
                part = rows[start:start + 2048]
                yield pa.RecordBatch.from_arrays([
                    pa.array(_signed(np.array([k for (k, _), _ in part], np.uint64))),
                    pa.array([_short(u) for (_, u), _ in part], pa.binary()), pa.array([tid] * len(part), pa.binary()),
                    pa.array([v[2:] for _, v in part], pa.list_(pa.int32())), pa.array([v[1] for _, v in part], pa.int32()),
                    pa.array([v[0] for _, v in part], pa.int32()), pa.array([u for (_, u), _ in part], pa.binary()),
                ], ["key", "uid", "tid", "at", "n_starts", "anchor", "unit"])


FINE = "key bigint, uid binary, parent_key bigint, parent_uid binary, at int, n_starts int, anchor int, again boolean, unit binary"


def cut_finer(batches: Iterator[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """Units of overfull anchors to stretches of ``width`` strings, keyed by what all strings of the stretch have in common."""
    names = [x.split()[0] for x in FINE.split(", ")]
    for batch in batches:
        for r in batch.to_pylist():
            rows, unit, a = [], r["unit"], r["anchor"]
            for j in range(max(0, a - r["n_starts"] + 1) // width, a // width + 1):
                first, last = max(0, a - (j + 1) * width + 1), min(r["n_starts"] - 1, a - j * width)
                if first > last:
                    continue
                core = unit[a - j * width: a - (j + 1) * width + 1 + length]
                key = int.from_bytes(hashlib.blake2b(core + j.to_bytes(4, "little"), digest_size=8).digest(), "little", signed=True)
                part = unit[first:last + length]
                rows.append((key, _short(part), r["root_key"], r["root_uid"], r["shift"] + first, last - first + 1, a - first,
                             r["again"], part))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names)


MARKS = "key bigint, uid binary, marks array<struct<first int, number int>>"


def mark_bucket(table: pa.Table, length: int) -> pa.Table:
    """The runs of repeating string starts in every unit of a bucket."""
    units, again, n = table.column("unit").to_pylist(), table.column("again").to_pylist(), table.column("n_starts").to_pylist()
    found = RunLengthIndex(units, max(map(len, units))).repeats(length)
    marks = [[(0, k)] if twice else runs for runs, twice, k in zip(found, again, n)]
    kind = pa.list_(pa.struct([("first", pa.int32()), ("number", pa.int32())]))
    return pa.table({"key": table.column("key"), "uid": table.column("uid"),
                     "marks": pa.array([[{"first": f, "number": k} for f, k in m] for m in marks], kind)})


RUNS = "array<struct<first int, number int>>"


def join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, uid, runs`` with the runs of a unit joined where they touch or overlap."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("number", pa.int32())]))
    for batch in batches:
        out = []
        for runs in batch.column(2).to_pylist():
            joined: list[dict] = []
            for run in sorted(runs, key=lambda r: r["first"]):
                if joined and run["first"] <= joined[-1]["first"] + joined[-1]["number"]:
                    joined[-1]["number"] = max(joined[-1]["number"], run["first"] + run["number"] - joined[-1]["first"])
                else:
                    joined.append(dict(run))
            out.append(joined)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["key", "uid", "runs"])


def unit_marks(units: DataFrame, length: int, bucket_bytes: int, group_units: int) -> DataFrame:
    """``key, uid, first, number``: repeating string starts of every different unit (``key, uid, again, n_starts, anchor, unit``)."""
    found: list[DataFrame] = []
    root = units.select("*", F.col("key").alias("root_key"), F.col("uid").alias("root_uid"), F.lit(0).alias("shift"))
    links = None
    for width in (*FINER, None):
        units = settled(units, "different")
        sizes = settled(units.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("again").alias("z")).filter("c > 1 OR z"), "sizes")
        known = settled(units.join(sizes, "key"), "units")
        small = known.filter(F.col("c") <= group_units) if width else known
        total = small.agg(F.sum(F.length("unit"))).first()[0] or 0
        buckets = max(1, -(-total // bucket_bytes))
        marked = small.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInArrow(
            lambda table: mark_bucket(table, length), MARKS)
        marked = marked.select("key", "uid", F.explode("marks").alias("m")).select("key", "uid", "m.first", "m.number")
        if links is None:
            found.append(marked)
        else:
            found.append(links.join(marked, ["key", "uid"]).select(
                F.col("parent_key").alias("key"), F.col("parent_uid").alias("uid"), (F.col("at") + F.col("first")).alias("first"), "number"))
        large = known.filter(F.col("c") > group_units)
        if not width or large.isEmpty():
            break
        if links is None:
            large = large.join(root.select("key", "uid", "root_key", "root_uid", "shift"), ["key", "uid"])
        else:
            large = large.join(links.select("key", "uid", F.col("parent_key").alias("root_key"), F.col("parent_uid").alias("root_uid"),
                                            F.col("at").alias("shift")), ["key", "uid"])
        fine = settled(large.select("n_starts", "anchor", "again", "unit", "root_key", "root_uid", "shift").mapInArrow(
            lambda batches, width=width: cut_finer(batches, length, width), FINE), "finer")
        links = fine.select("key", "uid", "parent_key", "parent_uid", "at")
        owner = F.xxhash64("parent_key", "parent_uid", "at")
        units = fine.groupBy("key", "uid").agg(
            (F.max("again") | (F.min(owner) < F.max(owner))).alias("again"), F.first("n_starts").alias("n_starts"),
            F.first("anchor").alias("anchor"), F.first("unit").alias("unit"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def repeats(docs: DataFrame, length: int = 400, text: str = "text", doc_id: str = "doc_id", gram: int = GRAM,
            bucket_bytes: int = BUCKET_BYTES, group_units: int = GROUP_UNITS) -> DataFrame:
    """``doc_id, n_bytes, text_sha256, spans, kept``: the maximal covered runs (``first, number`` in bytes) of every
    document, and the bytes that are left (null where nothing is covered: all are left).

    A null text has no bytes. Rows with equal texts are occurrences of each other, repeated rows too, so such
    texts of at least ``length`` bytes are covered whole. Overlaps count: a string may repeat one byte further on.
    An empty table gives no rows; further columns are not read. A very long text is held by one task at a time.
    ``gram`` is at most ``length``."""
    gram = min(gram, length)
    whole = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8").alias("data"))
    hashed = whole.withColumn("sha", F.sha2("data", 256)).withColumn("tid", F.substring(F.unhex("sha"), 1, 16))
    ids = settled(hashed.select("doc_id", "tid", F.col("sha").alias("text_sha256"), F.length("data").cast("long").alias("n_bytes")), "ids")
    texts = ids.groupBy("tid").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep"), F.first("n_bytes").alias("n"))

    shared = shared_anchors(hashed.select("tid", "data"), length, gram)
    chosen = shared.join(texts.select("tid", "rep"), "tid").select(F.col("tid").alias("t"), "rep", "hashes")
    source = hashed.select("doc_id", "tid", "data").join(
        chosen, (F.col("tid") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    source = settled(source.select("tid", "data", "hashes"), "texts")
    rows = settled(source.mapInArrow(lambda batches: cut_units(batches, length, gram), UNITS), "cut")
    owner = F.xxhash64("tid")
    units = rows.groupBy("key", "uid").agg(
        ((F.min(owner) < F.max(owner)) | (F.max(F.size("at")) > 1)).alias("again"), F.first("n_starts").alias("n_starts"),
        F.first("anchor").alias("anchor"), F.first("unit").alias("unit"))
    marks = unit_marks(units, length, bucket_bytes, group_units)

    # one row a unit, whatever the number of stretches it was cut into; a unit has at most length - gram + 1 starts
    whole_marks = settled(marks.groupBy("key", "uid").agg(F.collect_set(F.struct("first", "number")).alias("runs")).mapInArrow(
        join_runs, f"key bigint, uid binary, runs {RUNS}"), "marks")
    found = rows.select("key", "uid", "tid", "at").join(whole_marks, ["key", "uid"])
    runs = found.groupBy("tid").agg(F.collect_list(F.struct("at", "runs")).alias("runs"))
    some = texts.filter("copies = 1").select("tid").join(runs, "tid").join(source.select("tid", "data"), "tid")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, runs = batch.column(2)[i].as_py(), batch.column(1)[i].values
                edge = np.zeros(len(data) + 1, np.int64)
                for unit in runs:
                    at = unit["at"].values.to_numpy(zero_copy_only=False)
                    for run in unit["runs"].as_py():
                        np.add.at(edge, at + run["first"], 1)
                        np.add.at(edge, at + (run["first"] + run["number"] + length - 1), -1)
                inside = (np.cumsum(edge[:-1]) > 0).astype(np.int8)
                step = np.diff(np.concatenate([[0], inside, [0]]))
                begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                kept = np.frombuffer(data, np.uint8)[inside == 0].tobytes()
                spans = [{"first": f, "number": e - f} for f, e in zip(begin.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()], pa.binary()), pa.array([spans], SPAN_TYPE), pa.array([kept], pa.binary())],
                    ["tid", "spans", "kept"])

    parts = some.select("tid", "runs", "data").mapInArrow(cover, f"tid binary, spans {SPANS}, kept binary")
    copied = texts.filter(F.col("copies") > 1).filter(F.col("n") >= length).select(
        "tid", F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n").alias("number"))).cast(SPANS).alias("spans"),
        F.lit(b"").alias("kept"))
    done = parts.union(copied)
    return ids.join(done, "tid", "left").select(
        "doc_id", "n_bytes", "text_sha256", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), "kept")


SPANS = "array<struct<first bigint, number bigint>>"
SPAN_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("number", pa.int64())]))
