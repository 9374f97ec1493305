"""Operators 11 to 13 against brute force on small tables, and on odd rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableproof.llm.merkle import Frontier, fold, leaf_digest, merkle_manifest, proof_digest
from tableproof.llm.multi_index import hard_negatives
from tableproof.llm.positional_index import decontaminate

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa the of and".split()


# --- 11 ---------------------------------------------------------------------------------------------


def plain_words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(docs, items, width):
    out = []
    for text in docs:
        w, hit, found = plain_words(text), set(), set()
        for item, body in items:
            q = plain_words(body)
            for at in range(max(1, len(q) - width + 1)) if q else ():
                window = q[at:at + width]
                for s in range(len(w) - len(window) + 1):
                    if w[s:s + len(window)] == window:
                        hit.update(range(s, s + len(window)))
                        found.add(item)
        out.append((len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


def texts_of(seed, n, longest):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_phrases_equal_brute_force(spark):
    texts = texts_of(1, 60, 60)
    items = [(i, " ".join(texts[i].split()[5:5 + n])) for i, n in enumerate([0, 1, 2, 4, 7, 12, 30])] + [(99, "the the the the the the"), (100, "the the the the the the")]
    texts += ["the " * 40, "The, THE; the-the the\nthe", items[5][1].upper() + "!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out, found = decontaminate(docs, bench, width=4)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in out.collect()}
    assert got == dict(enumerate(brute_hits(texts, items, 4)))
    assert {r["distance"] for r in found.collect()} == {0}


def test_near_phrases_are_told_apart(spark):
    phrase = "one two three four five six"
    docs = spark.createDataFrame([(1, phrase), (2, "one two x three four five six"), (3, "one two x y z three four five six")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, phrase)], "item_id bigint, text string")
    out, found = decontaminate(docs, bench, width=6, slack=1)
    assert {r["doc_id"]: (r["n_hit"], r["items"], r["n_near"]) for r in out.collect()} == {1: (6, ["7"], 0), 2: (0, [], 1), 3: (0, [], 0)}
    assert {(r["doc_id"], r["distance"]) for r in found.filter("doc_id <> 1").collect()} == {(2, 1)}


def test_decontamination_of_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([(None, "some words nothing else"), (1, None), (2, ""), (3, "日本語 ünïcödé"), (3, "lorem ipsum dolor"), (4, "lorem ipsum dolor")],
                                  "item_id bigint, text string")
    rows = decontaminate(odd, bench, width=4)[0].collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert (by[2]["n_words"], by[2]["n_hit"], by[3]["n_words"]) == (0, 0, 0)
    assert (by[1]["n_hit"], by[1]["items"]) == (4, [])  # an item without an id hits, but is not listed
    assert by[4]["n_hit"] == 12000 and by[4]["items"] == ["3", "4"] and by[7]["items"] == ["3"]
    assert decontaminate(nothing, bench)[0].count() == 0
    clean = decontaminate(odd, bench.limit(0))[0].collect()
    assert len(clean) == odd.count() and not any(r["n_hit"] for r in clean)


def test_index_and_search_use_no_python(spark, odd):
    out, _ = decontaminate(odd, spark.createDataFrame([(1, "lorem ipsum")], "item_id bigint, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


# --- 12 ---------------------------------------------------------------------------------------------


def brute_negatives(rows, k=5, n=5, low=80, high=100, scale=256):
    q = [(i, np.floor(scale * np.array(v, float)).astype(int), lab) for i, v, lab in rows]
    out = []
    for a, va, la in q:
        if a % 10:
            continue
        scored = sorted(((int(va @ v), i, lab) for i, v, lab in q if i != a), key=lambda s: (-s[0], s[1]))
        for p, pid, _ in [s for s in scored if s[2] == la][:k]:
            fits = [s for s in scored if s[2] != la and low * p <= 100 * s[0] <= high * p][:n]
            out += [(a, pid, r + 1, i, p, s) for r, (s, i, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["spread", "clusters", "one point"])
def test_mined_negatives_equal_brute_force(spark, shape):
    rng = np.random.default_rng(3)
    n, dim = 400, 9
    v = rng.normal(size=(n, dim))
    if shape == "clusters":
        v = rng.normal(size=(8, dim))[rng.integers(0, 8, n)] + 0.02 * v
    if shape == "one point":
        v[: n // 3] = v[0]
    rows = [(i, [float(x) for x in np.round(v[i], 3)], int(rng.integers(0, 4))) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(4)
    got = hard_negatives(df, F.col("vec_id") % 10 == 0, least_chunk=60, fit_rows=100)
    assert sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect()) \
        == brute_negatives(rows)


def test_mining_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1, "x"), (1, [1.0, 0.1], 1, "x"), (2, [0.9, 0.0], 2, "x"), (3, None, 1, "x"), (4, [None, 1.0], 1, "x"), (5, [float("nan"), 1.0], 1, "x"),
            (6, [1.0, 0.0], None, "x"), (None, [1.0, 0.0], 1, "x"), (2, [0.9, 0.0], 2, "x"), (7, [float("inf"), 0.0], 2, "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, cell string").withColumnsRenamed({"cell": "chunk"})
    got = [tuple(r) for r in hard_negatives(df, F.col("vec_id") == 0).collect()]
    assert sorted(got) == [(0, 1, 1, 2, 65536, 58880), (0, 1, 2, 2, 65536, 58880)]  # a repeated row stands for itself
    assert hard_negatives(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert hard_negatives(df, F.col("vec_id") == 99).count() == 0


def test_an_anchor_id_that_several_rows_bear_is_asked_alike(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [0.9, 0.0], 2), (4, [0.0, 0.9], 2)]
    answers = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id bigint, embedding array<double>, label int")
        answers.append(sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") == 0).collect()))
    assert answers[0] == answers[1] and answers[0]


# --- 13 ---------------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    path, nodes = [[] for _ in leaves], [(h, [i]) for i, h in enumerate(leaves)]
    while len(nodes) > 1:
        level = []
        for i in range(0, len(nodes), 2):
            run = nodes[i:i + 2]
            if len(run) == 2:
                for k in run[0][1]:
                    path[k].append(run[1][0])
                for k in run[1][1]:
                    path[k].append(run[0][0])
            level.append((H(*[h for h, _ in run]), [k for _, m in run for k in m]))
        nodes = level
    return nodes[0][0], path


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 64, 65])
def test_frontier_equals_the_whole_tree(n):
    leaves = [H(str(i)) for i in range(n)]
    frontier = Frontier()
    for leaf in leaves:
        frontier.append(leaf)
    root, path = brute_tree(leaves)
    assert frontier.close() == root
    assert [[s[1:] for s in w if s != "-"] for w in frontier.witness] == path


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest_equals_the_whole_tree(spark, height):
    rows = [(i, f"text {i}", ["en", "de", None, "fr"][i % 4] if i % 7 else "en") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(6)
    out = merkle_manifest(df, ["doc_id", "lang", "text"], height=height)
    out = out.select("*", fold(F.col("leaf"), F.col("path")).alias("folded"), proof_digest(F.col("path")).alias("proof"),
                     fold(F.lit("0" * 64), F.col("path")).alias("forged"))
    groups: dict = {}
    for i, t, g in rows:
        groups.setdefault(g, []).append((i, H(encoded(i), encoded(g), encoded(t))))
    names = sorted(groups, key=lambda g: (g is not None, g or ""))
    trees = {g: brute_tree([h for _, h in sorted(groups[g])]) for g in names}
    root, up = brute_tree([trees[g][0] for g in names])
    for r in out.collect():
        at = [i for i, _ in sorted(groups[r["lang"]])].index(r["doc_id"])
        sub, path = trees[r["lang"]]
        assert (r["position"], r["leaf"]) == (at, sorted(groups[r["lang"]])[at][1])
        assert (r["subroot"], r["root"], r["folded"]) == (sub, root, root) and r["forged"] != root
        assert r["proof"] == H(*path[at], *up[names.index(r["lang"])])
    assert out.count() == len(rows)


def test_manifest_of_odd_rows(spark, odd, nothing):
    fields = ["doc_id", "text", "lang", "source"]
    rows = merkle_manifest(odd, fields, height=1, carry={"key": leaf_digest([F.col("text")])}).collect()
    assert len(rows) == odd.count() and len({r["root"] for r in rows}) == 1
    twins = [r for r in rows if r["doc_id"] == 1]
    assert twins[0]["leaf"] == twins[1]["leaf"] and twins[0]["position"] != twins[1]["position"]
    assert merkle_manifest(nothing, fields).count() == 0
    one = merkle_manifest(odd.filter("doc_id = 3"), fields).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == []
