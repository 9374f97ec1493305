"""Operator 8: SimHash near-dedup with bit-sliced comparison.

Fingerprints are 64-bit majority votes over hashed word shingles. Equal fingerprints meet by grouping;
different ones within the radius agree in at least two of five bit blocks when the radius is three, so
they meet under one of ten keys of two blocks. Under a key, fingerprints are stored as vertical bit planes: one
machine word holds one bit of 64 candidates, and carry-save counters add the differing planes of all of them at once;
a block is abandoned as soon as all its lanes are beyond the radius. Pairs that are left are checked by
population count. A task hands on a spanning forest of the links it found, which keeps every component."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableproof.llm.common import ASCII_LOWER, WORD, add_columns, settled
from tableproof.llm.components import components

BITS = 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
SEED = 42
BLOCK_ROWS = 4096
SMALL = 48
#: near_duplicates: two sets meet when one of BANDS keys of BAND smallest hashes is equal. At a similarity of 0.8 a pair
#: shares none with chance (1 - 0.8 ** 6) ** 24 = 0.0007, at 0.9 with chance 1e-8.
BANDS, BAND = 24, 6
#: Words of 64 bits in a set's signature, which has a bit of each of the BANDS * BAND smallest hashes.
SIGNATURE = -(-BANDS * BAND // BITS)
#: Chance that the signatures of a pair at the similarity itself are further apart than the radius.
MISS = 1e-4
#: Texts of a cell's side in near_duplicates.
CELL_ROWS = 512
MIXES = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * BAND), np.uint64) | np.array([[0], [1]], np.uint64)
EDGES = "a bigint, b bigint"


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every ``width``-word shingle, repeats included; fewer words make one shingle, none make none."""
    words = [w.encode("utf-8", "surrogatepass") for w in WORD.findall((text or "").translate(ASCII_LOWER))]
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, n = xxhash.xxh64_intdigest, len(words) - width + 1
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[width - 1:].tolist())), np.uint64, n)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The signed 64-bit fingerprint: a bit is set when it is set in over half of the shingles' hashes."""
    return int(votes_of(shingle_hashes(text, width)).view(np.int64))


def votes_of(h: np.ndarray) -> np.ndarray:
    """The 64-bit majority of some hashes, as a uint64."""
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i:i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0].astype(np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def smallest_hashes(shingles: np.ndarray) -> np.ndarray:
    """The smallest of a set's hashes under each of ``BANDS * BAND`` mixes; two sets of similarity s agree in each with chance s."""
    low = np.full(BANDS * BAND, FULL)
    for i in range(0, len(shingles), 1 << 10):
        x = (shingles[None, i:i + (1 << 10)] ^ MIXES[0][:, None]) * MIXES[1][:, None]
        np.minimum(low, x.min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One key a band, of the ``BAND`` smallest hashes in it; sets of similarity s share a given key with chance s ** BAND."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in low.reshape(BANDS, BAND).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def signature(low: np.ndarray) -> np.ndarray:
    """A bit of each smallest hash. Two sets of similarity s differ in each with chance (1 - s) / 2, whatever their sizes."""
    x = low * np.uint64(0xBF58476D1CE4E5B9)
    bits = np.zeros(SIGNATURE * BITS, np.uint8)
    bits[: len(low)] = (x ^ (x >> np.uint64(31))) & np.uint64(1)
    return np.packbits(bits, bitorder="little").view("<u8").astype(np.uint64)


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of uint64 values: row b holds bit b of every value, 64 values a word; unused lanes are zero."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = np.zeros((BITS, -(-len(values) // 64) * 64), np.uint8)
    lanes[:, : len(values)] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def within(differing: Iterator[np.ndarray], like: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose distance stays within the counters. ``differing`` yields the differing bits plane by plane; they are added
    with carry-save counters that hold up to 2**k - 1 >= radius; what overflows is beyond it."""
    counters = [np.zeros_like(like) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros_like(like)
    for at, carry in enumerate(differing):
        for i, c in enumerate(counters):
            counters[i], carry = c ^ carry, c & carry
        over |= carry
        if at % 8 == 7 and (over == FULL).all():
            break
    return ~over


def lanes_of(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).astype("<u8").view(np.uint8), axis=-1, bitorder="little")


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two blocks within the radius, a band of ``left`` at a time; a row may be several words."""
    left, right = left.reshape(len(left), -1), right.reshape(len(right), -1)
    words = left.shape[1]
    held = np.concatenate([planes(right[:, k]) for k in range(words)])
    width = held.shape[1]
    band = max(1, (1 << 15) // width)
    for i in range(0, len(left), band):
        part = left[i:i + band]
        masks = [np.where((part[:, k] >> np.uint64(b)) & np.uint64(1) == 1, FULL, np.uint64(0))[:, None] for k in range(words) for b in range(BITS)]
        good = within((held[b][None, :] ^ masks[b] for b in range(len(masks))), np.zeros((len(part), width), np.uint64), radius)
        a, b = np.nonzero(lanes_of(good)[:, : len(right)])
        exact = np.bitwise_count(part[a] ^ right[b]).sum(axis=1, dtype=np.int64) <= radius
        yield a[exact] + i, b[exact]


def near_in_runs(values: np.ndarray, run: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius inside short runs of equal ``run``, all runs side by side."""
    step = 1
    while step < len(values):
        a = np.flatnonzero(run[step:] == run[:-step])
        if not len(a):
            return
        differing = planes(values[a] ^ values[a + step])
        good = lanes_of(within(iter(differing), np.zeros(differing.shape[1], np.uint64), radius))[: len(a)]
        a = a[good.astype(bool)]
        a = a[np.bitwise_count(values[a] ^ values[a + step]) <= radius]
        yield a, a + step
        step += 1


class Forest:
    """Smallest labels of linked nodes; ``edges`` is a star for each tree."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.label != np.arange(len(self.label)))
        return child, self.label[child]


def block_masks(radius: int) -> list[int]:
    """Masks of the keys: of radius + 2 blocks two stay equal."""
    blocks = [sum(1 << b for b in part.tolist()) for part in np.array_split(np.arange(BITS), radius + 2)]
    return [x | y for x, y in combinations(blocks, 2)]


def link_blocks(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows of two blocks (the second is null when a block meets itself) to forests of their links."""

    def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = column.flatten()
        return (n, flat.field("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64),
                flat.field("rep").to_numpy(zero_copy_only=False).astype(np.int64))

    def batch_of(nodes: np.ndarray, forest: Forest) -> pa.RecordBatch:
        child, root = forest.edges()
        return pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root])], ["a", "b"])

    for batch in batches:
        n, fp, rep = lists(batch.column(0))
        m, fp2, rep2 = lists(batch.column(1))
        begin, begin2 = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(m)])
        run = np.repeat(np.arange(len(n)), n)
        short = (n <= SMALL) & (m == 0)
        pick = np.flatnonzero(short[run]) if len(run) else np.empty(0, np.int64)
        if len(pick):
            forest = Forest(len(pick))
            for a, b in near_in_runs(fp[pick], run[pick], radius):
                forest.link(a, b)
            yield batch_of(rep[pick], forest)
        for i in np.flatnonzero(~short):
            left, nodes = fp[begin[i]:begin[i + 1]], rep[begin[i]:begin[i + 1]]
            if m[i]:
                right, nodes = fp2[begin2[i]:begin2[i + 1]], np.concatenate([nodes, rep2[begin2[i]:begin2[i + 1]]])
                shift = len(left)
            else:
                right, shift = left, 0
            forest = Forest(len(nodes))
            for a, b in near_pairs(left, right, radius):
                forest.link(a, b + shift)
            yield batch_of(nodes, forest)


def near_links(reps: DataFrame, radius: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``a, b``: links that connect all different fingerprints ``fp, rep`` within the radius.

    Keys with one fingerprint fall out by count. A key with more than ``block_rows`` is cut into blocks
    by hash, and its blocks meet in pairs, so no row list outgrows a block and nothing is left out."""
    keyed = reps.select("fp", "rep", F.posexplode(F.array(*[
        F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in block_masks(radius)])).alias("mask", "key"))
    # written, so that both sides of the join are dealt anew and a hot key can be split
    sizes = settled(keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    cut = keyed.join(sizes, ["mask", "key"]).withColumn("cuts", F.ceil(F.col("n") / block_rows).cast("int")).withColumn(
        "cut", F.pmod(F.xxhash64("rep"), F.col("cuts")))
    blocks = settled(cut.groupBy("mask", "key", "cuts", "cut").agg(F.collect_list(F.struct("fp", "rep")).alias("block")), "blocks")
    alone = blocks.select("block", F.lit(None).cast(blocks.schema["block"].dataType).alias("other"))
    many = blocks.filter("cuts > 1")
    pairs = many.join(many.select("mask", "key", F.col("cut").alias("cut2"), F.col("block").alias("other")),
                      ["mask", "key"]).filter("cut < cut2")
    # a hot key's pairs of blocks are as many tasks' work as there are pairs
    pairs = pairs.repartition("mask", "key", "cut", "cut2").select("block", "other")
    return alone.union(pairs).mapInArrow(lambda batches: link_blocks(batches, radius), EDGES)


def simhash(docs: DataFrame, text: str = "text", width: int = 3, name: str = "fingerprint") -> DataFrame:
    """``docs`` plus the signed fingerprint of each whole text; null and empty texts have zero."""

    def per_text(lists: Iterator[list[str | None]]) -> Iterator[list]:
        for texts in lists:
            yield [[fingerprint(t, width) for t in texts]]

    return add_columns(docs, text, [(name, T.LongType())], per_text)


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id``: the smallest id reachable over links of at most ``radius`` bits.

    Texts without a word have fingerprint zero and link like any other. Repeated rows come out repeated.
    A null id is never a representative: such a document gets the smallest id of its component, null if
    there is none. An empty table gives no rows; further columns are not read. Equal fingerprints, however
    many, are one node; they are joined back by an equi join whose hot side may be split."""
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    prints = settled(simhash(base, "text", width).select("doc_id", "fingerprint"), "fingerprints")
    reps = settled(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("rep")).filter("rep IS NOT NULL"), "reps")
    found = components(near_links(reps, radius))
    classes = reps.join(found, reps["rep"] == found["node"], "left").select(
        F.col("fp").alias("fingerprint"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(classes, "fingerprint", "left").select("doc_id", "fingerprint", "component_id")


def similarity_bits(similarity: float, miss: float = MISS) -> int:
    """Bits that the signatures of sets of this Jaccard similarity stay within but for a share ``miss`` of the pairs."""
    chance, n, below = (1.0 - similarity) / 2, BANDS * BAND, 0.0
    for radius in range(n + 1):
        below += comb(n, radius) * chance**radius * (1 - chance) ** (n - radius)
        if below >= 1 - miss:
            return radius
    return n


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least so much."""
    least = similarity * (len(x) + len(y)) / (1 + similarity) - 1e-9
    return min(len(x), len(y)) >= least and len(np.intersect1d(x, y, assume_unique=True)) >= least


@dataclass
class Member:
    """A text of a cell: the cut it is in, its node, band keys, signature and text."""

    cut: int
    node: int
    keys: np.ndarray
    sig: np.ndarray
    text: str


def link_cell(members: list[Member], cell: int | None, width: int, similarity: float, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a cell's members; with two cuts only pairs across are judged.

    Pairs whose signatures are within the radius and that share a band key are candidates; in the cell of one key
    a pair is judged if that is the first key it shares, so no pair is judged in two cells. A link is a pair whose
    shingle sets were compared. Pairs that are connected already need no comparison."""
    root, links, sets = list(range(len(members))), [], {}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def set_of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_set(members[i].text, width)
        return sets[i]

    cuts = np.array([m.cut for m in members])
    first, second = np.flatnonzero(cuts == cuts.min()), np.flatnonzero(cuts == cuts.max())
    same = cuts.min() == cuts.max()
    sigs = np.stack([m.sig for m in members])
    for a, b in near_pairs(sigs[first], sigs[second], radius):
        for i, j in zip(first[a].tolist(), second[b].tolist()):
            if same and i >= j:
                continue
            x, y = find(i), find(j)
            if x == y:
                continue
            shared = np.flatnonzero(members[i].keys == members[j].keys)
            if not len(shared) or cell is not None and members[i].keys[shared[0]] != cell:
                continue
            if alike(set_of(i), set_of(j), similarity):
                root[max(x, y)] = min(x, y)
                links.append((members[i].node, members[j].node))
    return links


def link_cells(batches: Iterator[pa.RecordBatch], width: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows ``component, cell, low, high, cut, node, keys, sig, text`` sorted by cell to the links of each cell."""
    radius, at, held = similarity_bits(similarity), None, {}

    def done() -> pa.RecordBatch:
        links = link_cell(list(held.values()), at[1], width, similarity, radius)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        cells = list(zip(*(batch.column(k).to_pylist() for k in range(6))))
        keys, sigs, texts = batch.column(6), batch.column(7), batch.column(8)
        for k, (component, cell, low, high, cut, node) in enumerate(cells):
            if (component, cell, low, high) != at:
                if len(held) > 1:
                    yield done()
                at, held = (component, cell, low, high), {}
            held[node] = Member(cut, node, np.array(keys[k].as_py(), np.int64), np.array(sigs[k].as_py(), np.int64).view(np.uint64), texts[k].as_py())
    if len(held) > 1:
        yield done()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, similarity: float = 0.8,
                    cell_rows: int | None = None) -> DataFrame:
    """``doc_id, tid, component_id``: groups of texts linked by a Jaccard similarity of at least ``similarity`` between
    their sets of ``width``-word shingles.

    Sets that share one of ``BANDS`` keys of smallest hashes meet (``BANDS`` says how rarely a pair at 0.8 does not). What
    hangs together by keys in at most ``cell_rows`` texts is one cell. Larger groups are taken apart again, into the cells of
    their keys, so a long chain of texts costs what its keys cost; a key with more texts is cut into parts that meet in
    pairs. In a cell signatures are compared bit-sliced, within a radius that leaves out ``MISS`` of the pairs at the
    similarity, and every pair that is left is compared set by set before it is a link. Which pairs are judged does not
    depend on how cells were made.
    Equal sets are one node. ``tid`` hashes the text. Null and empty texts are alike, very long ones are taken whole; a
    null id is no representative; repeated rows come out repeated; an empty table gives no rows; further columns are not read."""
    cell_rows = cell_rows or CELL_ROWS
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn(
        "tid", F.xxhash64("text"))

    def per_text(lists: Iterator[list[str | None]]) -> Iterator[list]:
        for texts in lists:
            sets = [shingle_set(t, width) for t in texts]
            lows = [smallest_hashes(s) for s in sets]
            yield [[xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                   [band_keys(x).view(np.int64) if len(s) else [] for s, x in zip(sets, lows)], [signature(x).view(np.int64) for x in lows]]

    longs = T.ArrayType(T.LongType(), False)
    prints = add_columns(base, "text", [("same", T.BinaryType()), ("keys", longs), ("sig", longs)], per_text)
    prints = settled(prints.select("doc_id", "tid", "same", "keys", "sig"), "signatures")
    # equal sets have equal keys; the text of the smallest id stands for them
    reps = settled(prints.filter("doc_id IS NOT NULL").groupBy("same").agg(
        F.min(F.struct("doc_id", "tid")).alias("r"), F.first("keys").alias("keys"), F.first("sig").alias("sig")).select(
        "same", F.col("r.doc_id").alias("rep"), "r.tid", "keys", "sig"), "reps")
    keyed = reps.select("rep", F.explode("keys").alias("key"))
    # written, so that both sides of the join are dealt anew and a hot key can be split
    hubs = settled(keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "hubs")
    shared = settled(keyed.join(hubs, "key"), "shared-keys")
    met = settled(components(shared.filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()), "met")
    sizes = settled(met.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "sizes")
    sized = settled(met.join(sizes, "component"), "sized")
    none = F.lit(None).cast("bigint")
    small = sized.filter(F.col("size") <= cell_rows).select("node", "component", none.alias("cell"), F.lit(1).alias("cuts"))
    large = sized.filter(F.col("size") > cell_rows).join(shared, F.col("node") == F.col("rep")).select(
        "node", "component", F.col("key").alias("cell"), F.ceil(F.col("n") / cell_rows).cast("int").alias("cuts"))
    placed = small.unionByName(large).withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    placed = settled(reps.select("rep", "tid", "keys", "sig").join(placed, F.col("rep") == F.col("node")).drop("rep"), "placed")
    rows = base.join(placed, (base["doc_id"] == placed["node"]) & (base["tid"] == placed["tid"])).select(
        "component", "cell", "cuts", "cut", "node", "keys", "sig", "text", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    cells = rows.select("component", "cell", F.least("cut", "other").alias("low"), F.greatest("cut", "other").alias("high"), "cut", "node", "keys", "sig", "text")
    by = ["component", "cell", "low", "high"]
    links = cells.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda batches: link_cells(batches, width, similarity), EDGES)
    found = components(settled(links, "links"))
    classes = settled(reps.join(found, reps["rep"] == found["node"], "left").select(
        "same", F.coalesce("component", "rep").alias("component_id")), "classes")
    return prints.select("doc_id", "tid", "same").join(classes, "same", "left").select("doc_id", "tid", "component_id")


def one_of_each(docs: DataFrame, groups: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without all but one document of each group: the one with the smallest id. Of rows that agree in id and
    text one stays, the smallest by all its columns where these can be ordered. A document without an id stays where no
    other of its group has one. All columns are kept as they are, whatever their names."""
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "tid").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{doc_id}`").alias("id"),
                       F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("t"))
    met = rows.join(kept, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tid")), "left_semi")
    if any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in docs.schema.fields):
        return met.dropDuplicates(["id", "t"]).select("row.*")
    return met.groupBy("id", "t").agg(F.min("row").alias("row")).select("row.*")
