"""Operator 13: Merkle manifest of a table, every row with its witness, built by appending.

Rows of a group are ranked, hashed to leaves and appended in order to a frontier of open subtrees. A leaf
carries a partial witness: the siblings its subtree has met so far. When two subtrees of one height stand
side by side they are joined, and every witness below them grows by the other's digest. A frontier lives for
one aligned block of ``2 ** height`` leaves inside a task; the digests of the blocks are appended to the
frontier of the level above in the same way, then the digests of the groups to the one above that, and each
level hands its witnesses down to the blocks it stands on.

A step of a witness is ``R`` or ``L`` (the side on which the sibling stands) with the sibling's digest, or ``-``
where the node stood alone and was hashed by itself."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableproof.llm.common import settled

#: Leaves of a block are two to this power.
HEIGHT = 10
ROW_BITS = (1 << 33) - 1  # of monotonically_increasing_id: the row's number in its partition


def joined(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Frontier:
    """Open subtrees, from the tallest to the last, and the witness of every leaf so far."""

    def __init__(self) -> None:
        self.open: list[tuple[int, str, int]] = []  # height, digest, first leaf
        self.witness: list[list[str]] = []

    def append(self, digest: str) -> None:
        self.open.append((0, digest, len(self.witness)))
        self.witness.append([])
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._join()

    def _join(self) -> None:
        height, right, middle = self.open.pop()
        _, left, first = self.open.pop()
        on_right, on_left = "R" + right, "L" + left
        for w in self.witness[first:middle]:
            w.append(on_right)
        for w in self.witness[middle:]:
            w.append(on_left)
        self.open.append((height + 1, joined(left, right), first))

    def close(self, height: int | None = None) -> str:
        """The one digest that remains, raised to ``height`` where the tree goes on above this block."""
        while len(self.open) > 1 or height is not None and self.open[0][0] < height:
            if len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
                self._join()
                continue
            level, digest, first = self.open.pop()
            for w in self.witness[first:]:
                w.append("-")
            self.open.append((level + 1, joined(digest), first))
        return self.open[0][1]


def leaf_digest(fields: Sequence[Column]) -> Column:
    """sha256 over the fields: ``-`` for a null, else the text's byte count, a colon and the text."""
    texts = [f.cast("string") for f in fields]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    def step(digest: Column, s: Column) -> Column:
        side, other = F.substring(s, 1, 1), s.substr(F.lit(2), F.length(s))
        return F.sha2(F.when(side == "R", F.concat(digest, other)).when(side == "L", F.concat(other, digest)).otherwise(digest), 256)

    return F.aggregate(path, leaf, step)


def proof_digest(path: Column) -> Column:
    """sha256 over the siblings of ``path``, from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s.substr(F.lit(2), F.length(s))), ""), 256)


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` plus ``pos``: the place of each in its group from 0, without a group ever meeting in one task.

    Rows are dealt by ranges of group and order; repeated rows are told apart by a number, so that they can be
    cut as well. Places follow from the written ranges and the counts of group and range."""
    keys = [group, *order, "uid"]
    dealt = rows.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranges = settled(dealt.drop("uid").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ranges")
    ranges = ranges.withColumn("at", F.col("at").bitwiseAND(F.lit(ROW_BITS)))
    counts = ranges.groupBy("part", group).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", group, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return ranges.join(starts, ["part", group]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def appended(nodes: DataFrame, height: int) -> DataFrame:
    """``nodes`` (``tree, pos, digest`` and more) plus ``block``, ``path`` inside it and the block's ``top``."""
    blocks = nodes.withColumn("block", F.shiftright("pos", height))
    out = T.StructType([*blocks.schema.fields, T.StructField("path", T.ArrayType(T.StringType())), T.StructField("top", T.StringType())])
    names = blocks.columns

    def of_block(part: pa.RecordBatch) -> pa.RecordBatch:
        frontier = Frontier()
        for digest in part.column("digest").to_pylist():
            frontier.append(digest)
        # a first block that is not full is the whole tree; all others are raised to the block's height
        top = frontier.close(height if part.column("block")[0].as_py() else None)
        return pa.RecordBatch.from_arrays(
            [*part.columns, pa.array(frontier.witness, pa.list_(pa.string())), pa.array([top] * part.num_rows, pa.string())],
            out.fieldNames())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        last = None

        def whole() -> pa.RecordBatch:
            merged = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting.clear()
            return merged

        for batch in batches:
            if not batch.num_rows:
                continue
            trees, numbers = batch.column("tree").to_pylist(), batch.column("block").to_pylist()
            keys = list(zip(trees, numbers, strict=True))
            cuts = [i for i in range(batch.num_rows) if keys[i] != (keys[i - 1] if i else last)]
            last, start = keys[-1], 0
            for cut in [*cuts, batch.num_rows]:
                if cut > start:
                    waiting.append(batch.slice(start, cut - start))
                if cut < batch.num_rows and waiting:
                    yield of_block(whole())
                start = cut
        if waiting:
            yield of_block(whole())

    dealt = blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return dealt.select(*names).mapInArrow(work, out)


def witnessed(nodes: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """Nodes ``tree, pos, digest`` (and more) with their whole ``path``, and ``tree, digest`` of the roots.

    Each round appends the digests of the blocks below; there are as many rounds as the largest tree has powers
    of the block size."""
    levels = []
    while True:
        level = settled(appended(nodes, height), "witnesses")
        levels.append(level)
        nodes = level.filter(F.col("pos") == F.shiftleft("block", height)).select("tree", F.col("block").alias("pos"), F.col("top").alias("digest"))
        if not nodes.agg(F.max("pos")).first()[0]:
            break
    above = None
    for level in reversed(levels):
        if above is not None:
            up = above.select("tree", F.col("pos").alias("block"), F.col("path").alias("above"))
            level = level.join(up, ["tree", "block"]).withColumn("path", F.concat("path", "above")).drop("above")
        above = level
    return above.drop("block", "top"), nodes.select("tree", "digest")


def merkle_manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang",
                    order: str = "doc_id", carry: Mapping[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """``order, group, <carry>, leaf, position, path, subroot, root``: one row for each row of ``docs``.

    A row's leaf hashes ``fields``. Per value of ``group`` the leaves, ascending by ``order``, are paired level by
    level to the group's root, a node without a partner being hashed alone; group roots, null first and then
    bytewise, are paired in the same way to the root. ``carry`` names further columns computed from ``docs``.

    Nulls are values of their own: a null group is a group, rows without an ``order`` come first. Rows that tie in
    ``order`` follow their leaves; repeated rows are leaves of their own and differ in their witness only. Empty
    and very long texts are hashed as they are, in the scan; no text passes a shuffle. An empty table has no rows.
    Other columns of ``docs`` are not read, so clashing names do no harm."""
    carried = dict(carry or {})
    first = docs.select(
        F.col(f"`{order}`").alias("k"), F.col(f"`{group}`").alias("g"),
        F.coalesce(F.concat(F.lit("v"), F.col(f"`{group}`").cast("string")), F.lit("n")).alias("tree"),
        leaf_digest([F.col(f"`{f}`") for f in fields]).alias("digest"),
        *[c.alias(f"x{i}") for i, c in enumerate(carried.values())])
    leaves = settled(first, "leaves")
    below, subroots = witnessed(ranked(leaves, "tree", ["k", "digest"]), height)
    # one tree over the groups: their places in it are their ranks over all of them
    groups = settled(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("member"), "digest"), "subroots")
    tops, roots = witnessed(ranked(groups, "tree", ["member"]), height)
    above = tops.join(roots.select("tree", F.col("digest").alias("root")), "tree")
    above = settled(above.select(F.col("member").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("above"), "root"), "groups")
    names = [F.col(f"x{i}").alias(n) for i, n in enumerate(carried)]
    return below.join(above, "tree").select(
        F.col("k").alias(order), F.col("g").alias(group), *names, F.col("digest").alias("leaf"), F.col("pos").alias("position"),
        F.concat("path", "above").alias("path"), "subroot", "root")
