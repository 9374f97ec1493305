"""Operator 10: quality rules by compression bands.

zstandard ratios of the whole text and of fixed chunks are held against limits that depend on length.
Prose of one length compresses within a narrow band; repeated filler falls below it, noise and encoded
blobs stay above. A few counts of the text come along as base rules."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tableproof.llm.common import WORD, add_columns

SYMBOLS = "#*$%&|<>"
WINDOW = 8
FIELDS = [
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()),
    ("ratio", T.DoubleType()), ("n_chunks", T.LongType()), ("n_low_chunks", T.LongType()),
    ("n_high_chunks", T.LongType()), ("kept", T.BooleanType()),
]


@dataclass(frozen=True)
class Bands:
    """Limits of compressed bytes over bytes. ``whole``: (texts up to so many bytes, lowest, highest); a
    frame's fixed bytes weigh on short texts, so their limits are wide and high. Chunks have one band;
    a text fails when more than ``chunk_share`` of them lie outside it, on one side or on both. What is left after the full
    chunks is one more chunk: the text's last ``chunk_bytes`` must lie within the band, and so must the rest alone,
    whose upper limit rises by ``fixed_bytes`` spread over fewer bytes. A text shorter than a chunk is judged whole only."""

    level: int = 3
    whole: tuple[tuple[float, float, float], ...] = (
        (50, 0.50, 2.50), (100, 0.45, 1.40), (200, 0.40, 1.15), (400, 0.40, 0.95), (800, 0.40, 0.86),
        (1600, 0.37, 0.78), (3200, 0.34, 0.72), (6400, 0.31, 0.68), (12800, 0.29, 0.66),
        (51200, 0.26, 0.64), (float("inf"), 0.20, 0.62),
    )
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (0.30, 0.75)
    chunk_share: float = 0.34
    fixed_bytes: int = 40
    min_words: int = 20
    repeat_percent: int = 30


def repeated_words(words: Sequence[str], width: int = WINDOW) -> int:
    """How many words lie in a window of ``width`` words that occurs twice or more in the text."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    # window ids by doubling: equal pairs of ids get one id, so equality is exact
    have, span = ids, 1
    while span < width:
        pairs = have[:-span] * (int(have.max()) + 1) + have[span:]
        have = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        span *= 2
    often = np.bincount(have)[have] > 1
    if not often.any():
        return 0
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int((np.cumsum(edges[:n]) > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def measure(text: str | None, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    n_words, repeats = len(words), repeated_words(words)
    failed = n_words < bands.min_words or 100 * repeats > bands.repeat_percent * n_words
    raw = text.encode("utf-8", "surrogatepass")
    ratio = len(packer.compress(raw)) / len(raw) if raw else 1.0
    _, low, high = bands.whole[bisect_left([b[0] for b in bands.whole], len(raw))]
    size = bands.chunk_bytes
    chunks = [len(packer.compress(raw[i:i + size])) / size for i in range(0, len(raw) - size + 1, size)]
    n_low, n_high = sum(c < bands.chunk[0] for c in chunks), sum(c > bands.chunk[1] for c in chunks)
    n_chunks, rest = len(chunks), len(raw) % size
    if chunks and rest:
        last, alone = len(packer.compress(raw[-size:])) / size, len(packer.compress(raw[-rest:])) / rest
        above = last > bands.chunk[1] or alone > bands.chunk[1] + bands.fixed_bytes * (1 / rest - 1 / size)
        n_chunks, n_high = n_chunks + 1, n_high + above
        n_low += not above and min(last, alone) < bands.chunk[0]
    kept = not failed and low <= ratio <= high and n_low + n_high <= bands.chunk_share * n_chunks
    return (n_words, sum(map(len, words)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeats, failed,
            ratio, n_chunks, n_low, n_high, kept)


def quality_bands(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """``docs`` plus counts, ratios and the verdict ``kept``, row by row.

    Null and empty texts have no words, ratio 1 and fail the base rule; repeated rows are judged each for
    itself; a text of any length is judged whole. No shuffle; memory follows the longest text. Columns
    of ``docs`` named like a new one are replaced, all others are kept."""

    def per_text(lists: Iterator[list[str | None]]) -> Iterator[list]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for texts in lists:
            yield list(zip(*(measure(t, bands, packer) for t in texts)))

    return add_columns(docs, text, FIELDS, per_text)
