"""The tree fingerprint: its digest against one folded by hand, and how often its rows are shuffled."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest

from tableproof.operators import fingerprint as P


def by_hand(hashes, depth):
    def sha(lines):
        return hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()

    level = defaultdict(list)
    for h, c in Counter(hashes).items():
        level[h[:depth]].append(f"{h}:{c}")
    level = {p: sha(e) for p, e in level.items()}
    while depth > 0:
        depth = max(0, depth - P.FOLD_DIGITS)
        above = defaultdict(list)
        for p, d in level.items():
            above[p[:depth]].append(f"{p}:{d}")
        level = {p: sha(e) for p, e in above.items()}
    return level[""]


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 6, 7])
def test_tree_equals_the_one_by_hand(spark, depth):
    hashes = [hashlib.sha256(str(i % 700).encode()).hexdigest() for i in range(1000)]
    rows = spark.createDataFrame([("t", h) for h in hashes], "table string, h string")
    got = P.tree_digests(rows, ["table"], depth, "sha256").first()
    assert (got["n"], got["digest"]) == (1000, by_hand(hashes, depth))


def test_rows_are_shuffled_twice_as_bytes(spark, capsys):
    rows = spark.range(10).selectExpr("'t' AS table", "sha2(cast(id AS string), 256) AS h")
    P.tree_digests(rows, ["table"], P.LEAF_DIGITS, "sha256").explain()
    plan = capsys.readouterr().out
    # equal rows, the node above the leaves, the root
    assert plan.count("Exchange hashpartitioning") == 3
    assert "unhex" in plan
