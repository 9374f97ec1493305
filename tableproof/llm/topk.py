"""Operator 9: exact top-k by inner product, pruned with multi-resolution segment statistics.

Per segment of a vector its mean and deviation are kept. Over segments of length L the inner product is
at most the sum of L * (mean * mean + deviation * deviation) (Cauchy-Schwarz on what is left of the
means), which bounds the distance from below. Bounds are taken coarse to fine; a candidate that cannot
reach a query's k-th best score so far is abandoned; survivors are computed exactly.

Candidates are dealt to chunks of bounded size, once, and every chunk is asked by every query: one pass, whose
tasks hold a chunk and stream the queries past it, block by block. A chunk returns k rows a query at most; nothing is
broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableproof.llm.common import settled

#: Queries that are taken past a chunk at a time, candidates whose bounds are compared at a time, and bytes of a chunk's
#: vectors; a chunk is not cut below LEAST_CHUNK rows for the sake of more tasks.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 2048
CHUNK_BYTES, LEAST_CHUNK = 64 << 20, 4096
FOUND = "query_id bigint, vec_id bigint, score bigint"
EXACT = float(1 << 53)


def scaled(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """``vec_id, v``: components as ``floor(scale * x)``; vectors that are null or hold a null or
    non-finite component are left out. A component must fit a long."""
    e = F.col(f"`{embedding}`")
    whole = F.coalesce(~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    return vectors.filter(whole & F.col(f"`{vec_id}`").isNotNull()).select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.transform(e, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def levels_of(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine; the finest segment has 4 components or a few more."""
    out, n = [], 1
    while dim // n >= 4:
        out.append(n)
        n *= 4
    return out or [1]


def statistics(m: np.ndarray, segments: int) -> np.ndarray:
    """Rows of (sqrt(L) * mean, sqrt(L) * deviation) per segment: the bound is their plain inner product."""
    parts = np.array_split(np.arange(m.shape[1]), segments)
    got = []
    for p in parts:
        s = m[:, p]
        mean = s.mean(axis=1)
        got += [mean * np.sqrt(len(p)), np.sqrt(np.maximum(0.0, ((s - mean[:, None]) ** 2).sum(axis=1)))]
    return np.stack(got, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise exact integer inner products of equally long int64 rows."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < EXACT:
        return np.einsum("ij,ij->i", a.astype(float), b.astype(float)).astype(np.int64)
    return (a * b).sum(axis=1)


class Candidates:
    """A block of candidates of one length with their statistics, coarse to fine."""

    def __init__(self, vec: np.ndarray, rows: np.ndarray):
        self.vec, self.rows = vec, rows
        self.stats = [statistics(rows.astype(float), n) for n in levels_of(rows.shape[1])]


class Best:
    """The k best (score, smaller id first) of every query so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, rows, k
        self.stats = [statistics(rows.astype(float), n) for n in levels_of(rows.shape[1])]
        self.score = [np.empty(0, np.int64) for _ in ids]
        self.vec = [np.empty(0, np.int64) for _ in ids]
        self.floor = np.full(len(ids), -np.inf)

    def meet(self, block: Candidates) -> None:
        q, c = None, None
        for mine, theirs in zip(self.stats, block.stats, strict=True):
            bound = mine @ theirs.T if q is None else np.einsum("ij,ij->i", mine[q], theirs[c])
            floor = self.floor[:, None] if q is None else self.floor[q]
            # rounding never abandons: the bound is lifted by more than its error
            alive = bound + 1e-9 * np.abs(bound) + 1.0 >= floor
            if q is None:
                q, c = np.nonzero(alive)
            else:
                q, c = q[alive], c[alive]
        other = self.ids[q] != block.vec[c]
        q, c = q[other], c[other]
        if not len(q):
            return
        step = max(1, (4 << 20) // max(1, block.rows.shape[1]))
        score = np.concatenate([products(self.rows[q[i:i + step]], block.rows[c[i:i + step]]) for i in range(0, len(q), step)])
        good = score >= self.floor[q]
        q, c, score = q[good], c[good], score[good]
        at = np.searchsorted(q, np.arange(len(self.ids) + 1))
        for i in np.flatnonzero(np.diff(at)):
            s = np.concatenate([self.score[i], score[at[i]:at[i + 1]]])
            v = np.concatenate([self.vec[i], block.vec[c[at[i]:at[i + 1]]]])
            keep = np.lexsort((v, -s))[: self.k]
            self.score[i], self.vec[i] = s[keep], v[keep]
            if len(keep) == self.k:
                self.floor[i] = s[keep[-1]]


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``length, ids, rows`` of a batch ``vec_id, v``, one matrix for each length of vectors in it."""
    lists = batch.column("v")
    vec = batch.column("vec_id").to_numpy(zero_copy_only=False)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    for d in np.unique(lengths).tolist():
        pick = np.flatnonzero(lengths == d)
        yield d, vec[pick], flat[begins[pick][:, None] + np.arange(d)].astype(np.int64).reshape(len(pick), d)


def answers(batches: Iterator[pa.RecordBatch], k: int, query_block: int = QUERY_BLOCK) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk, candidates before the queries that ask them, to ``query_id, vec_id, score``."""
    at, chunk = None, {}
    for batch in batches:
        numbers = batch.column("chunk").to_numpy(zero_copy_only=False)
        asks = batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        edges = [0, *(1 + np.flatnonzero((np.diff(numbers) != 0) | (asks[1:] != asks[:-1]))).tolist(), batch.num_rows]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            if end == start:
                continue
            if at != numbers[start]:
                at, chunk = numbers[start], {}
            step = query_block if asks[start] else CANDIDATE_BLOCK
            for begin in range(start, end, step):
                for d, vec, rows in by_length(batch.slice(begin, min(step, end - begin))):
                    if not asks[start]:
                        chunk.setdefault(d, []).append(Candidates(vec, rows))
                        continue
                    best = Best(vec, rows, k)
                    for block in chunk.get(d, ()):
                        best.meet(block)
                    n = [len(s) for s in best.score]
                    if sum(n):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat(vec, n)), pa.array(np.concatenate(best.vec)), pa.array(np.concatenate(best.score))],
                            ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
          scale: int = 1024, query_block: int = QUERY_BLOCK, chunk_bytes: int = CHUNK_BYTES, least_chunk: int = LEAST_CHUNK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows of every row of ``is_query``.

    Ties go to the smaller id; a query has fewer rows when there are fewer candidates; vectors of other
    lengths than the query's are no candidates of it; a row never meets rows of its own id; repeated rows
    stand for themselves and may appear twice. Of several query rows with one id the one with the smallest vector asks,
    once. Null or non-finite vectors and rows without an id take no part. An empty table gives no rows. Further columns are not
    read, so names may clash. ``query_block`` queries are taken past a chunk at a time, which bounds a task's memory."""
    spark = vectors.sparkSession
    rows = settled(scaled(vectors, vec_id, embedding, scale), "scaled")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    chunks = int(max(1, -(-size * 8 // chunk_bytes), min(spark.sparkContext.defaultParallelism, n // least_chunk)))
    dealt = settled(rows.repartition(chunks).withColumn("chunk", F.spark_partition_id()), "chunks")
    asked = scaled(vectors.filter(is_query), vec_id, embedding, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    every = settled(asked, "queries").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    met = dealt.withColumn("asks", F.lit(False)).unionByName(every.withColumn("asks", F.lit(True)))
    found = settled(met.repartition("chunk").sortWithinPartitions("chunk", "asks").mapInArrow(lambda batches: answers(batches, k, query_block), FOUND), "found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
