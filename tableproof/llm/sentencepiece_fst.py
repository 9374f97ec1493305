"""Operator 6: SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (one arc a character, and one in front for the dummy
prefix), the pieces (a trie whose final states lead back to its root and put out an id), and byte fallback (an arc
for a character without a piece, putting out the ids of its bytes). A string composed with them is a lattice whose
states are places in the string; the encoding is its shortest path in the tropical semiring (min, +).

For unigram models an arc weighs minus its piece's score. For merge-table models the pieces weigh nothing and a
fourth machine is composed in, the pair acceptor: its state is the piece before, and the arc to the next piece weighs
zero if merging the two joined pieces by rank gives just the pair back, and infinity otherwise. A merge encoding is
the only path on which every pair weighs zero, so the shortest path is the encoding, id for id.

Unigram lattices are relaxed from left to right. For merge tables the composition is made while the search goes: a
queue holds arcs by the cost of the path before them, and an arc is composed with the acceptor when its turn comes.
Weights are not negative, so a state that is reached first is reached at least cost.

Where no piece goes on across a mark of white space the lattice of a text is the chain of its words' lattices. A task
then takes a slice of texts apart by Arrow, composes every distinct word once, and puts the texts' ids together
from the words' in arrays; decoding takes the pieces' bytes in the same way."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableproof.llm.common import add_arrays

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
MAX_MODEL_BYTES = 64 << 20
WORDS, PAIRS = 3 << 16, 1 << 19
INFINITE = float("inf")


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[at:at + n]
            at += n


@dataclass
class Model:
    """What the transducers are compiled from."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model_type: int
    byte_fallback: bool
    dummy_prefix: bool
    extra_spaces: bool


def read_model(data: bytes) -> Model:
    pieces, scores, kinds, trainer, normaliser = [], [], [], {}, {}
    for tag, value in wire(data):
        if tag == 1:
            said = dict(wire(value))
            pieces.append(said.get(1, b"").decode())
            scores.append(struct.unpack("<f", said[2])[0] if 2 in said else 0.0)
            kinds.append(said.get(3, NORMAL))
        elif tag == 2:
            trainer = dict(wire(value))
        elif tag == 3:
            normaliser = dict(wire(value))
    if normaliser.get(2):
        raise ValueError("a compiled character map is not supported: the normaliser must be the identity")
    if USER in kinds:
        raise ValueError("user-defined pieces are not supported")
    if trainer.get(3, UNIGRAM) not in (UNIGRAM, MERGES):
        raise ValueError("the model must be a unigram or a merge model")
    return Model(pieces, scores, kinds, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), bool(normaliser.get(3, 1)),
                 not normaliser.get(4, 1))


@dataclass
class Transducer:
    """The compiled machines, with bounded memories of pair weights and of paths of short words."""

    model: Model
    ids: dict[str, int] = field(default_factory=dict)
    byte_ids: list[int] = field(default_factory=list)
    pairs: dict[str, dict[str, float]] = field(default_factory=dict)
    splits: dict[str, tuple[str, str] | None] = field(default_factory=dict)
    known: int = 0
    words: dict[str, bytes] = field(default_factory=dict)
    older: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self):
        m = self.model
        self.ids = {p: i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k == NORMAL}
        self.rank = {p: m.scores[i] for p, i in self.ids.items()}
        self.unknown = m.kinds.index(UNKNOWN) if UNKNOWN in m.kinds else 0
        if m.byte_fallback:
            at = {p: i for i, p in enumerate(m.pieces) if m.kinds[i] == BYTE}
            self.byte_ids = [at[f"<0x{b:02X}>"] for b in range(256)]
        self.trie: dict = {"": ()}  # a node keeps the pieces on the way to it, the shortest first
        for piece in sorted(self.ids, key=len):
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {"": node[""]})
            if piece not in node[""]:
                self._add(node, piece)
        self.longest = max(map(len, self.ids), default=1)
        self.least = min(self.rank.values(), default=0.0) - 10.0
        crossing = any(MARK in p.lstrip(MARK) for p in self.ids)
        # no piece goes on into a mark, and none holds a control: paths of the parts are independent
        controls = "" if any(c < " " for p in self.ids for c in p) else "\x00-\x1f"
        self.parts = None if crossing else re.compile(
            f"[{controls}]|{MARK}*[^{MARK}{controls}]+|{MARK}+" if controls else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN
            else p.replace(MARK, " ").encode() for p, k in zip(m.pieces, m.kinds)]
        self.forms = pa.array([*self.bytes_of, *[b.removeprefix(b" ") for b in self.bytes_of]], pa.binary())

    def _add(self, node: dict, piece: str) -> None:
        node[""] = (*node[""], piece)

    # --- normaliser

    def normalise(self, text: str) -> str:
        if not self.model.extra_spaces:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)

    # --- pair acceptor

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes the piece when it is merged by rank, leftmost first; null for a single
        character, empty parts for a piece that merging never makes."""
        if piece in self.splits:
            return self.splits[piece]
        parts, rank = list(piece), self.rank
        last = None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            last = (parts[at], parts[at + 1])
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        got = None if len(piece) == 1 else last if len(parts) == 1 else ("", "")
        self.splits[piece] = got
        return got

    def allowed(self, left: str | None, right: str) -> bool:
        """Whether the pair has weight zero: no merge over its border comes before those that make its sides.

        The sides are taken apart, the later made one first; a merge of what then meets at the border must not
        outrank what was undone. Equal ranks are the same piece, and the leftmost goes first."""
        if self.split(right) == ("", ""):
            return False
        if left is None:
            return True
        rank, limit, strict = self.rank, -INFINITE, True
        while True:
            score = rank.get(left + right)
            if score is not None and (score > limit or not strict and score == limit):
                return False
            a, b = self.split(left), self.split(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and rank[left] < rank[right]:
                limit, strict, left = rank[left], True, a[1]
            else:
                limit, strict, right = rank[right], False, b[0]

    # --- composition and shortest paths

    def weight(self, before: str, arc: str) -> float:
        """Weight of an arc of the pair acceptor; the start is the empty piece."""
        row = self.pairs.get(before)
        if row is None:
            row = self.pairs[before] = {}
        got = row.get(arc)
        if got is None:
            got = row[arc] = 0.0 if self.allowed(before or None, arc) else INFINITE
            self.known += 1
        return got

    def arcs(self, text: str, at: int) -> tuple[str, ...]:
        """The arcs that leave a place of the lattice: the pieces that begin there, and byte fallback for a character
        that is none."""
        node = self.trie
        for c in text[at:at + self.longest]:
            below = node.get(c)
            if below is None:
                break
            node = below
        pieces = node[""]
        return pieces if text[at] in self.ids else (text[at], *pieces)

    def merge_path(self, text: str) -> list[str]:
        """Shortest path through lattice and pair acceptor. A state is a place and the piece that ends there; the only
        one of finite weight at a place is the end of the encoding of what lies before, so places are settled. All
        finite paths weigh the same, so of the queue only its lightest bucket is ever used, the last arc first."""
        n, arcs, pairs, weight = len(text), self.arcs, self.pairs, self.weight
        cost, last = [INFINITE] * (n + 1), [""] * (n + 1)
        cost[0], at = 0.0, 0
        queue: list[tuple[int, str]] = []
        while at < n:
            pairs.setdefault(last[at], {})
            for arc in arcs(text, at):
                queue.append((at, arc))
            while True:
                begin, arc = queue.pop()
                end = begin + len(arc)
                if cost[end] != INFINITE:
                    continue
                step = pairs[last[begin]].get(arc)
                total = cost[begin] + (weight(last[begin], arc) if step is None else step)
                if total < INFINITE:
                    cost[end], last[end], at = total, arc, end
                    break
        path: list[str] = []
        while at:
            path.append(last[at])
            at -= len(last[at])
        if self.known > PAIRS:
            self.pairs.clear()
            self.known = 0
        return path[::-1]

    def unigram_path(self, text: str) -> list[str]:
        """Shortest path through the lattice alone: relaxed from left to right, the first of equal paths stays."""
        n = len(text)
        cost, back = [0.0] + [INFINITE] * n, [0] * (n + 1)
        for at in range(n):
            if cost[at] == INFINITE:
                continue
            for arc in self.arcs(text, at):
                weight = -self.rank[arc] if arc in self.rank else -self.least
                end = at + len(arc)
                if cost[at] + weight < cost[end]:
                    cost[end], back[end] = cost[at] + weight, at
        out, end = [], n
        while end:
            out.append(text[back[end]:end])
            end = back[end]
        return out[::-1]

    def path_ids(self, text: str) -> bytes:
        """Ids along the shortest path, as packed 32-bit numbers."""
        path = self.merge_path(text) if self.model.model_type == MERGES else self.unigram_path(text)
        out: list[int] = []
        for arc in path:
            i = self.ids.get(arc)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in arc.encode("utf-8", "surrogatepass"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return struct.pack(f"<{len(out)}i", *out)

    def word(self, part: str) -> bytes:
        """Ids of one word. Short ones are remembered in two generations of bounded size, so that the frequent ones stay."""
        got = self.words.get(part)
        if got is None:
            got = self.older.get(part)
            if got is None:
                got = self.path_ids(part)
            if len(part) <= 48:
                if len(self.words) >= WORDS:
                    self.words, self.older = {}, self.words
                self.words[part] = got
        return got

    def chain(self, normal: str) -> bytes:
        """Ids of a normalised string: those of its words' lattices, one after another."""
        got = self.words.get(normal)
        if got is not None:
            return got
        parts = self.parts.findall(normal) if self.parts else [normal]
        return self.word(normal) if len(parts) == 1 else b"".join(map(self.word, parts))

    def encode(self, text: str) -> list[int]:
        normal = self.normalise(text)
        return np.frombuffer(self.chain(normal), "<i4").tolist() if normal else []

    def encode_array(self, texts: pa.Array) -> pa.Array:
        """Lists of ids of an array of texts, composing each distinct word once.

        Texts whose spaces do not stand singly between words go to :meth:`encode`, as all do for models whose
        lattices are not chains of words."""
        texts = pc.fill_null(texts, "")
        apart = self.parts is not None and self.model.dummy_prefix and self.model.extra_spaces
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        plain = pc.invert(pc.or_(odd, pc.equal(texts, ""))) if apart else pa.array([False] * len(texts), pa.bool_())
        mask = plain.to_numpy(zero_copy_only=False)
        words = pc.split_pattern(texts.filter(plain), " ")
        coded = words.flatten().dictionary_encode()
        chains = [self.chain(MARK + w.replace(" ", MARK)) for w in coded.dictionary.to_pylist()]
        lengths = np.fromiter(map(len, chains), np.int64, len(chains)) // 4
        flat = np.frombuffer(b"".join(chains), "<i4")
        found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))
        at = coded.indices.to_numpy(zero_copy_only=False)
        ids = found.take(coded.indices).flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lengths[at])])
        bounds = ends[words.offsets.to_numpy() - words.offsets[0].as_py()]
        # the texts that went the other way are put in between
        per_text = np.zeros(len(texts), np.int64)
        per_text[mask] = np.diff(bounds)
        others = {int(i): self.encode(texts[int(i)].as_py()) for i in np.flatnonzero(~mask)}
        for i, got in others.items():
            per_text[i] = len(got)
        offsets = np.concatenate([[0], np.cumsum(per_text)])
        if others:
            whole = np.empty(offsets[-1], np.int32)
            whole[np.repeat(mask, per_text)] = ids
            for i, got in others.items():
                whole[offsets[i]:offsets[i + 1]] = got
            ids = whole
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))

    def decode_array(self, lists: pa.Array) -> pa.Array:
        """Texts of an array of id lists: the pieces' bytes are taken by id and cut at the lists' borders."""
        lists = pc.fill_null(lists, pa.scalar([], lists.type))
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        if self.model.dummy_prefix:
            # the first piece of a text loses the prefix: each piece has a second form without it
            heads = offsets[:-1][np.diff(offsets) > 0]
            ids[heads] += len(self.bytes_of)
        taken = self.forms.take(pa.array(ids))
        ends = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset:taken.offset + len(taken) + 1]
        begun = np.flatnonzero(np.diff(offsets) > 0)
        first_empty = [i for i in begun if ends[offsets[i] + 1] == ends[offsets[i]] and not self.bytes_of[int(ids[offsets[i]]) % len(self.bytes_of)]]
        joined = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends[offsets].astype(np.int32).tobytes()), taken.buffers()[2]])
        try:
            if first_empty:
                raise pa.ArrowInvalid
            return joined.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8, or a text that begins with a piece of no bytes
            return pa.array([self.decode(r) for r in lists.to_pylist()], pa.string())

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


_COMPILED: dict[int, Transducer] = {}


def compiled(key: int, model: Model) -> Transducer:
    """The transducer of a broadcast model, compiled once a worker and kept for its later tasks."""
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Transducer(model)
    return _COMPILED[key]


def load_model(spark: SparkSession, path: str) -> Model:
    """The model file, read on the driver; it is sent to executors, so its size is checked."""
    if "://" in path:
        data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    else:
        with open(path, "rb") as file:
            data = file.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"a model of over {MAX_MODEL_BYTES} bytes is not broadcast")
    return read_model(data)


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` plus ``ids``, the encoding of each whole text, row by row.

    Null and empty texts have no ids. Texts of any length are encoded whole; memory follows the longest.
    Repeated rows are encoded each; a column named like ``ids`` is replaced."""
    model = load_model(docs.sparkSession, model_path)
    held, key = docs.sparkSession.sparkContext.broadcast(model), hash((model_path, len(model.pieces), tuple(model.pieces[-99:])))

    return add_arrays(docs, text, [(ids, T.ArrayType(T.IntegerType(), False))], lambda: lambda texts: [compiled(key, held.value).encode_array(texts)])


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` plus ``text``, the decoding of each id list; null ids decode to the empty text."""
    model = load_model(encoded.sparkSession, model_path)
    held, key = encoded.sparkSession.sparkContext.broadcast(model), hash((model_path, len(model.pieces), tuple(model.pieces[-99:])))

    return add_arrays(encoded, ids, [(text, T.StringType())], lambda: lambda lists: [compiled(key, held.value).decode_array(lists)])


def round_trip(text: str = "text", decoded: str = "decoded"):
    """Whether decoding gives the text back, the white-space mark being read as a space."""
    return F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(MARK), F.lit(" ")) == F.col(decoded)
