"""Repeats against brute force over all strings."""

from __future__ import annotations

import hashlib
import random

import pytest

from tableproof.llm.run_length_index import RunLengthIndex, anchors, repeats

import numpy as np

LENGTH = 64


def brute(rows, length):
    seen: dict[bytes, int] = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        for i in range(len(b) - length + 1):
            seen[b[i:i + length]] = seen.get(b[i:i + length], 0) + 1
    out = []
    for d, b in data:
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                covered[i:i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, covered) if not c)
        spans = sum(1 for i in range(len(b)) if covered[i] and (i == 0 or not covered[i - 1]))
        out.append((d, len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def digest(df):
    found = df.selectExpr("doc_id", "n_bytes", "aggregate(spans, 0L, (a, x) -> a + x.number)", "size(spans)", "coalesce(sha2(kept, 256), text_sha256)")
    return sorted(map(tuple, found.collect()), key=repr)


def some_rows(seed):
    rng = random.Random(seed)

    def text(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    shared = [text(rng.randint(10, 120)) for _ in range(12)]
    rows = []
    for d in range(120):
        parts = [rng.choice([text(rng.randint(0, 80)), rng.choice(shared), rng.choice(shared), "ab" * rng.randint(0, 60), "x" * rng.randint(0, 90)])
                 for _ in range(rng.randint(0, 6))]
        rows.append((d, "".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, ""), (7, rows[7][1]), (None, rows[9][1] + "q"), (300, "y" * 1000)]
    hot = text(70)
    return rows + [(400 + i, text(30) + hot + text(30)) for i in range(80)]


@pytest.mark.parametrize("group_units", [512, 8])
def test_repeats_equal_brute_force(spark, group_units):
    rows = some_rows(1)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert digest(repeats(df, LENGTH, gram=20, bucket_bytes=4000, group_units=group_units)) == brute(rows, LENGTH)


def test_odd_rows(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect() if len(r["text"] or "") < 1000]
    small = odd.filter("text IS NULL OR length(text) < 1000")
    assert digest(repeats(small, 20, gram=8)) == brute(rows, 20)
    assert repeats(nothing).isEmpty()
    long = {r["doc_id"]: r for r in repeats(odd, 400).filter("doc_id IN (4, 5)").collect()}
    assert [bytes(long[d]["kept"]) for d in (4, 5)] == [b"", b""]


def test_anchors_cover_every_start():
    rng = np.random.default_rng(3)
    for data in (rng.integers(97, 100, 3000).astype(np.uint8), np.zeros(700, np.uint8), np.zeros(63, np.uint8)):
        place, _, first, last = anchors(data, 64, 16)
        starts = np.concatenate([np.arange(f, e + 1) for f, e in zip(first, last)]) if len(first) else []
        assert list(starts) == list(range(max(0, len(data) - 63)))
        assert all(f <= p <= f + 48 and p >= e for p, f, e in zip(place, first, last))


def test_matching_statistics_equal_brute_force():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(12)]
    index = RunLengthIndex(texts, 64)
    got = index.matching_statistics()
    for t, begin in zip(texts, index.begins):
        for i in range(len(t)):
            want = 0
            for u, other in zip(texts, index.begins):
                for j in range(len(u)):
                    if begin + i != other + j:
                        n = 0
                        while i + n < len(t) and j + n < len(u) and t[i + n] == u[j + n]:
                            n += 1
                        want = max(want, n)
            assert got[begin + i] == want
    assert index.run_lengths.sum() == index.size
