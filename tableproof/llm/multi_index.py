"""Operator 12: hard negatives by an inverted multi-index over two half spaces.

A codebook of each half space gives a row two codes, a pair of codes is a cell. The score of a row is the sum of
two half scores; for a code the half score is at most the anchor's product with the centroid plus its length
times the code's radius. A heap walks pairs of codes by the sum of these bounds, the best first, and reads the
rows of a cell only when it is its turn. It stops when no cell that is left can change the answer: for
positives when the next bound lies below the last of the best found, for a window of scores when the window's best
are found above the next bound, or when that lies below the window.

Rows are dealt in chunks of neighbouring cells, written once. Every chunk is asked by every anchor, and an
anchor's own chunk first: what it finds there is a floor for all others. A task holds one chunk and streams the
anchors past it."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableproof.llm.common import settled
from tableproof.llm.topk import products

#: Rows that the codebooks are fitted on, drawn by hash; every row is indexed.
FIT_ROWS = 20_000
#: Rows of a cell, on the average, that the number of codes aims at; codes of a half space at most.
CELL_ROWS, MOST_CODES = 256, 256
#: Bytes of the vectors of a chunk, and rows below which a chunk is not cut for the sake of more tasks.
CHUNK_BYTES, LEAST_CHUNK = 64 << 20, 4096
#: Rows read from cells before they are scored together.
AT_ONCE = 512


def codebook(half: np.ndarray, codes: int, rounds: int = 6) -> np.ndarray:
    """Centroids of Lloyd's rounds over a sample; the first ones are rows spread over the sorted sample."""
    if not len(half):
        return np.zeros((1, half.shape[1]))
    order = np.argsort(half @ np.ones(half.shape[1]), kind="stable")
    centres = np.unique(half[order[np.linspace(0, len(half) - 1, min(codes, len(half))).astype(int)]], axis=0)
    for _ in range(rounds):
        near = nearest(half, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, half)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(half: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(axis=1) - 2 * (half @ centres.T), axis=1)


class Chunk:
    """The rows of a chunk by cell, with the radii that its own rows need."""

    def __init__(self, vec: np.ndarray, label: np.ndarray, rows: np.ndarray, centres: tuple[np.ndarray, np.ndarray]):
        cut = centres[0].shape[1]
        real = rows.astype(float)
        self.halves = []
        codes = []
        for part, c in ((real[:, :cut], centres[0]), (real[:, cut:], centres[1])):
            near = nearest(part, c)
            away = np.sqrt(((part - c[near]) ** 2).sum(axis=1))
            used = np.unique(near)
            radius = np.zeros(len(c))
            np.maximum.at(radius, near, away)
            self.halves.append((c[used], radius[used]))
            codes.append(np.searchsorted(used, near))
        width = len(self.halves[1][0])
        cell = codes[0] * width + codes[1]
        order = np.argsort(cell, kind="stable")
        self.vec, self.label, self.rows = vec[order], label[order], rows[order]
        self.begin = np.searchsorted(cell[order], np.arange(len(self.halves[0][0]) * width + 1))
        self.width = width

    def walk(self, anchor: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """``bound, from, to`` of the occupied cells, by descending bound: two sorted lists and a heap over their sums."""
        cut = self.halves[0][0].shape[1]
        real = anchor.astype(float)
        lists = []
        for part, (c, radius) in zip((real[:cut], real[cut:]), self.halves, strict=True):
            bound = c @ part + np.sqrt(part @ part) * radius
            # rounding never cuts a row off: the bound is lifted by more than its error
            bound = bound + 1e-9 * np.abs(bound) + 1e-6
            order = np.argsort(-bound, kind="stable")
            lists.append((bound[order], order))
        (one, at_one), (two, at_two) = lists
        heap = [(-(one[0] + two[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            cell = at_one[i] * self.width + at_two[j]
            start, end = self.begin[cell], self.begin[cell + 1]
            if end > start:
                yield -bound, int(start), int(end)
            if j + 1 < len(two):
                heapq.heappush(heap, (-(one[i] + two[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (-(one[i + 1] + two[0]), i + 1, 0))

    def scored(self, anchor: np.ndarray, certain) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``ids, labels, scores`` of whole cells, until ``certain`` says so of the next cell's bound."""
        spans: list[tuple[int, int]] = []
        held = 0

        def read():
            at = np.concatenate([np.arange(a, b) for a, b in spans])
            spans.clear()
            return self.vec[at], self.label[at], products(np.broadcast_to(anchor, (len(at), len(anchor))), self.rows[at])

        for bound, start, end in self.walk(anchor):
            if certain(bound):
                break
            spans.append((start, end))
            held += end - start
            if held >= AT_ONCE:
                yield read()
                held = 0
        if spans:
            yield read()

    def best(self, anchor_id: int, anchor: np.ndarray, label: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best rows of the anchor's label, other than the anchor, that score ``floor`` or more."""
        vec, score = np.empty(0, np.int64), np.empty(0, np.int64)
        low = [floor]
        for ids, labels, scores in self.scored(anchor, lambda bound: bound < low[0]):
            good = (labels == label) & (ids != anchor_id) & (scores >= low[0])
            vec, score = first(np.concatenate([vec, ids[good]]), np.concatenate([score, scores[good]]), k)
            if len(vec) == k:
                low[0] = max(low[0], score[-1])
        return vec, score

    def windows(self, anchor: np.ndarray, label: int, positives: list[int], floors: list[float], low: int, high: int,
                k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each positive's score the ``k`` best rows of another label inside its window."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in positives]
        need = [max(f, low * p / 100) if low * p <= high * p else np.inf for p, f in zip(positives, floors, strict=True)]
        for ids, labels, scores in self.scored(anchor, lambda bound: bound < min(need)):
            other = labels != label
            for i, p in enumerate(positives):
                good = other & (100 * scores >= low * p) & (100 * scores <= high * p) & (scores >= floors[i])
                if good.any():
                    out[i] = first(np.concatenate([out[i][0], ids[good]]), np.concatenate([out[i][1], scores[good]]), k)
                    if len(out[i][0]) == k:
                        need[i] = max(need[i], out[i][1][-1])
        return out


def first(vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.lexsort((vec, -score))[:k]
    return vec[keep], score[keep]


def index_rows(rows: DataFrame, centres: tuple[np.ndarray, np.ndarray], chunks: int) -> DataFrame:
    """``chunk`` added to ``vec_id, label, v``: ranges of cells, a crowded cell being cut by id."""
    held = rows.sparkSession.sparkContext.broadcast(centres)  # two codebooks of MOST_CODES centroids at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = held.value
        cut = one.shape[1]
        for batch in batches:
            if batch.num_rows:
                m = matrix(batch.column("v")).astype(float)
                cell = nearest(m[:, :cut], one) * len(two) + nearest(m[:, cut:], two)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], [*batch.schema.names, "cell"])

    coded = rows.mapInArrow(work, "vec_id bigint, label bigint, v array<bigint>, cell bigint")
    dealt = settled(coded, "coded").repartitionByRange(chunks, "cell", "vec_id")
    return settled(dealt.withColumn("chunk", F.spark_partition_id()).drop("cell"), "chunks")


def matrix(lists: pa.Array) -> np.ndarray:
    """Equally long lists as the rows of a matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1).astype(np.int64, copy=False)


FOUND = "anchor_id bigint, anchor_label bigint, n int, positive_id bigint, positive_score bigint, vec_id bigint, score bigint"


def visit(indexed: DataFrame, asks: DataFrame, centres, k: int, low: int, high: int) -> DataFrame:
    """What ``asks`` (anchors with the chunk they ask) find in the chunks of ``indexed``.

    An ask without ``positive`` wants the ``k`` best of its own label; one with it wants, for each positive's score, the
    ``k`` best of other labels in the window. ``floor`` holds scores below which nothing is wanted, or nulls."""
    held = indexed.sparkSession.sparkContext.broadcast(centres)
    none = F.lit(None).cast("array<bigint>")
    rows = indexed.select("vec_id", "label", "v", "chunk", none.alias("floor"), none.alias("positive"), none.alias("positive_id"),
                          F.lit(False).alias("asks"))
    met = rows.unionByName(asks.withColumn("asks", F.lit(True))).repartition("chunk").sortWithinPartitions("chunk", "asks")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chunk, parts = None, None, []
        for batch in batches:
            numbers = batch.column("chunk").to_numpy(zero_copy_only=False)
            is_ask = batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            edges = [0, *(1 + np.flatnonzero((np.diff(numbers) != 0) | (is_ask[1:] != is_ask[:-1]))), batch.num_rows]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if end == start:
                    continue
                part = batch.slice(start, end - start)
                if at != numbers[start]:
                    at, chunk, parts = numbers[start], None, []
                if not is_ask[start]:
                    parts.append(tuple(x.to_numpy(zero_copy_only=False) for x in (part.column("vec_id"), part.column("label")))
                                 + (matrix(part.column("v")),))
                    continue
                if chunk is None and parts:
                    chunk = Chunk(*(np.concatenate(x) for x in zip(*parts, strict=True)), held.value)
                    parts = []
                if chunk is not None:
                    yield answered(part, chunk)

    def answered(part: pa.RecordBatch, chunk: Chunk) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(7)]

        def add(r, n, pid, ps, found):
            for v, s in zip(*(x.tolist() for x in found), strict=True):
                for column, x in zip(out, (r["vec_id"], r["label"], n, pid, ps, v, s), strict=True):
                    column.append(x)

        for r in part.to_pylist():
            anchor = np.array(r["v"], np.int64)
            if r["positive"] is None:
                floor = r["floor"][0] if r["floor"] else None
                add(r, 0, None, None, chunk.best(r["vec_id"], anchor, r["label"], k, -np.inf if floor is None else floor))
            else:
                floors = [-np.inf if f is None else f for f in r["floor"] or [None] * len(r["positive"])]
                found = chunk.windows(anchor, r["label"], r["positive"], floors, low, high, k)
                for n, got in enumerate(found):
                    add(r, n, r["positive_id"][n], r["positive"][n], got)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)],
                                          ["anchor_id", "anchor_label", "n", "positive_id", "positive_score", "vec_id", "score"])

    return met.mapInArrow(work, FOUND)


def merged(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each anchor and positive, with their ``rank``."""
    order = Window.partitionBy("anchor_id", "n").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def both_rounds(indexed: DataFrame, anchors: DataFrame, chunks: int, centres, k: int, low: int, high: int) -> DataFrame:
    """Anchors ask their own chunk, then all others with what that has shown to be the least that counts."""
    home = settled(visit(indexed, anchors.withColumn("floor", F.lit(None).cast("array<bigint>")), centres, k, low, high), "home")
    last = merged(home, k).groupBy("anchor_id", "n").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    floors = last.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("n", "floor"))).alias("floors"))
    numbers = F.sequence(F.lit(0), F.greatest(F.size("positive"), F.lit(1)) - 1)
    asking = anchors.join(floors, anchors["vec_id"] == floors["anchor_id"], "left").select(
        "vec_id", "label", "v", "chunk", F.transform(numbers, lambda n: F.try_element_at("floors", n)).alias("floor"), "positive", "positive_id")
    others = asking.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).filter("other <> chunk")
    away = visit(indexed, others.drop("chunk").withColumnRenamed("other", "chunk"), centres, k, low, high)
    return settled(merged(home.unionByName(away), k), "found")


def hard_negatives(vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                   positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
                   fit_rows: int = FIT_ROWS, chunk_bytes: int = CHUNK_BYTES, least_chunk: int = LEAST_CHUNK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor's positives are its ``positives`` best other rows of its label by integer inner product, its negatives for a
    positive the ``negatives`` best rows of other labels that score between ``low`` and ``high`` per cent of the positive.
    Higher scores come first, ties go to the smaller id, fewer rows are returned where there are fewer.

    Rows with a null id, label, vector or component or a non-finite one take no part. Vectors must be of one length,
    others are refused by an error. A row never meets rows of its own id. Of several rows
    with an anchor's id the smallest vector (then label) asks; repeated candidates stand for themselves.
    An empty table, or one without anchors, gives no rows. Only the three columns named are read."""
    spark = vectors.sparkSession
    whole = vectors.filter(F.col(f"`{label}`").isNotNull()).select(
        F.col(f"`{vec_id}`").alias("id"), F.col(f"`{embedding}`").alias("e"), F.col(f"`{label}`").cast("bigint").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = settled(labelled(whole, scale), "scaled")
    size = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v")), F.count_if("anchor")).first()
    n, shortest, dim = size[0], size[1], size[2]
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not n or not size[3]:
        return spark.createDataFrame([], schema)
    if shortest != dim:
        raise ValueError(f"vectors of {shortest} and of {dim} components")
    share = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, fit_rows / n))
    sample = rows.filter(share).select("v").limit(2 * fit_rows).toArrow().column("v").combine_chunks()
    sample = matrix(sample).astype(float) if len(sample) else np.zeros((1, dim))
    codes = int(min(MOST_CODES, max(2, round((n / CELL_ROWS) ** 0.5))))
    cut = max(1, dim // 2)
    centres = codebook(sample[:, :cut], codes), codebook(sample[:, cut:], codes)
    tasks = spark.sparkContext.defaultParallelism
    chunks = int(max(1, -(-n * dim * 8 // chunk_bytes), min(tasks, n // least_chunk)))
    indexed = index_rows(rows.select("vec_id", "label", "v"), centres, chunks)

    one = rows.filter("anchor").groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("r")).select("vec_id", "r.v", "r.label")
    # an anchor is a row, so its own chunk is where a row of its id lies
    at = indexed.groupBy("vec_id").agg(F.min("chunk").alias("chunk"))
    none = F.lit(None).cast("array<bigint>")
    anchors = settled(one.join(at, "vec_id").select("vec_id", "label", "v", "chunk", none.alias("positive"), none.alias("positive_id")), "anchors")
    found = both_rounds(indexed, anchors, chunks, centres, positives, low, high)
    lists = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))
    asking = settled(anchors.drop("positive", "positive_id").join(lists, F.col("vec_id") == F.col("anchor_id")).select(
        "vec_id", "label", "v", "chunk", F.col("p.score").alias("positive"), F.col("p.vec_id").alias("positive_id")), "positives")
    mined = both_rounds(indexed, asking, chunks, centres, negatives, low, high)
    return mined.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def labelled(rows: DataFrame, scale: int) -> DataFrame:
    """``vec_id, label, anchor, v`` of the rows ``id, e, label, anchor`` whose vector is whole, as whole numbers."""
    e = F.col("e")
    whole = F.coalesce(~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    return rows.filter(whole & F.col("id").isNotNull() & (F.size(e) > 0)).select(
        F.col("id").cast("long").alias("vec_id"), "label", "anchor", F.transform(e, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
