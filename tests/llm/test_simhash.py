"""Fingerprints, bit-sliced pairs and components against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from tableproof.llm import simhash as S
from tableproof.llm.components import components


def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(nodes, linked):
    label = {n: n for n in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in linked:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_fingerprint():
    for text in [None, "", "One", "one two", "A b C d e f", "é ü\tß  x\ny z " * 9, "a b c " * 30]:
        assert S.fingerprint(text) & (2**64 - 1) == plain_fingerprint(text)


def test_a_fingerprint_of_spark_hashes(spark):
    got = spark.sql("SELECT xxhash64('a b c') AS h").first()["h"]
    assert got & (2**64 - 1) == int(S.shingle_hashes("A b c", 3)[0])


def near_values(rng, n):
    out = {rng.getrandbits(64) for _ in range(n)}
    for v in list(out):
        for _ in range(rng.randint(0, 3)):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                v ^= 1 << b
            out.add(v)
    return sorted(out)


def test_bit_sliced_pairs_equal_population_counts():
    rng = random.Random(2)
    values = np.array(near_values(rng, 150), np.uint64)
    for radius in (0, 1, 3, 5):
        found = set()
        for a, b in S.near_pairs(values, values, radius):
            found |= set(zip(a.tolist(), b.tolist()))
        want = {(i, j) for i in range(len(values)) for j in range(len(values)) if int(values[i] ^ values[j]).bit_count() <= radius}
        assert found == want
        runs, run = set(), np.arange(len(values)) // 7
        for a, b in S.near_in_runs(values, run, radius):
            runs |= set(zip(a.tolist(), b.tolist()))
        assert runs == {(i, j) for i, j in want if i < j and run[i] == run[j]}


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(4)
    values = near_values(rng, 300)
    center = rng.getrandbits(64)
    values = sorted(set(values) | {center ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(1, 64, 5)})
    rows = [(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)]
    reps = spark.createDataFrame(rows, "fp bigint, rep bigint")
    want = classes(range(len(values)), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3])
    for block_rows in (4096, 16):
        got = {i: i for i in range(len(values))}
        got |= {r["node"]: r["component"] for r in components(S.near_links(reps, 3, block_rows)).collect()}
        assert got == want


def test_components_of_paths_hubs_and_noise(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5, 5), (None, 3), (2000, 1999), (1999, 2000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}, 1999: 1999, 2000: 1999}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).isEmpty()


def test_query_rows_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    want = classes([d for d, _ in rows], [(a, b) for a, x in rows for b, y in rows if a > b and (x ^ y).bit_count() <= 3])
    from tableproof.llm.queries import op8_simhash

    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op8_simhash(spark, sf_dir).collect()}
    assert got == {d: (f"{fp:016x}", want[d]) for d, fp in rows}


def test_odd_rows(odd, nothing):
    rows = S.simhash_components(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["fingerprint"] == by[3]["fingerprint"] == by[8]["fingerprint"] == 0
    assert {by[d]["component_id"] for d in (2, 3, 8)} == {2} and by[5]["component_id"] == 4
    assert S.simhash_components(nothing).isEmpty()


def test_near_duplicates_keep_one_of_each(spark, odd):
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 9999)}" for _ in range(400)]
    near = list(words)
    near[200] = "changed"
    far = [w if i % 6 else f"other{i}" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words)), (4, " ".join(far)), (5, None), (6, ""), (1, " ".join(words))],
                                 "doc_id bigint, text string")
    groups = S.near_duplicates(docs)
    assert {r["doc_id"]: r["component_id"] for r in groups.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}
    assert sorted(r["doc_id"] for r in S.one_of_each(docs, groups).collect()) == [1, 4, 5]
    kept = S.one_of_each(odd, S.near_duplicates(odd))
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 4, 6, 7]
    assert kept.filter("doc_id = 1").count() == 1


def edited(rng, words, target, scattered):
    """A copy whose five-word shingles have about the similarity ``target``: words appended, or changed here and there."""
    fresh = lambda: f"v{rng.randint(0, 10**7)}"
    if not scattered:
        return words + [fresh() for _ in range(int(len(words) * (1 / target - 1)))]
    out, share = list(words), (1 - target) / (1 + target)
    at = rng.sample(range(len(words)), max(1, int(len(words) * share / 5)))
    for i in at:
        out[i] = fresh()
    return out


def test_near_duplicates_are_those_of_brute_force(spark):
    rng, rows, pairs = random.Random(11), [], []
    shingles = lambda words: {" ".join(words[i:i + 5]) for i in range(len(words) - 4)}
    for k in range(240):
        vocabulary = [f"w{rng.randint(0, 3000)}" for _ in range(300)]
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 1200))]
        other = edited(rng, words, rng.choice([0.7, 0.82, 0.86, 0.9, 0.95]), k % 2)
        x, y = shingles(words), shingles(other)
        pairs.append(len(x & y) / len(x | y))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    linked = [got[2 * k + 1] == 2 * k for k in range(240)]
    alike = [j >= 0.8 for j in pairs]
    assert 120 < sum(alike) < 230 and not any(x and not y for x, y in zip(linked, alike))
    assert sum(x and y for x, y in zip(linked, alike)) >= 0.99 * sum(alike)


def test_large_groups_meet_in_cuts(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL_ROWS", 8)
    rng = random.Random(12)
    words = [f"w{rng.randint(0, 9999)}" for _ in range(400)]
    rows = [(i, " ".join(words[:i] + [f"x{i}"] + words[i + 1:])) for i in range(5, 45)]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 5 for i in range(5, 45)}


def test_cells_do_not_change_what_is_linked(spark):
    """A chain of texts, each like the next one only, and a crowd around one text: one group by keys, and the same links
    whether it is one cell, the cells of its keys, or keys cut in parts."""
    rng = random.Random(13)
    line = [f"w{i}" for i in range(1500)]
    rows = [(i, " ".join(line[10 * i:10 * i + 300])) for i in range(110)]
    crowd = line[:300]
    rows += [(1000 + i, " ".join(crowd[:40 + i] + [f"x{rng.randint(0, 99)}"] + crowd[41 + i:])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [sorted(tuple(r) for r in S.near_duplicates(docs, cell_rows=n).select("doc_id", "component_id").collect()) for n in (1000, 40, 5)]
    assert got[0] == got[1] == got[2]
    assert len({c for _, c in got[0]}) < 40


def test_signatures_tell_small_and_large_sets_alike():
    rng = np.random.default_rng(5)
    radius = S.similarity_bits(0.8)
    for n in (10, 40, 200, 2000):
        missed = false = 0
        for _ in range(60):
            x = rng.integers(0, 1 << 63, n).astype(np.uint64)
            same = -(-n * 8 // 9)  # a similarity of 0.8 and a little more
            y = np.concatenate([x[:same], rng.integers(0, 1 << 63, n - same).astype(np.uint64)])
            z = rng.integers(0, 1 << 63, n).astype(np.uint64)
            sx, sy, sz = (S.signature(S.smallest_hashes(np.unique(v))) for v in (x, y, z))
            missed += sum(int(a ^ b).bit_count() for a, b in zip(sx, sy)) > radius
            false += sum(int(a ^ b).bit_count() for a, b in zip(sx, sz)) <= radius
        assert missed <= 1 and false == 0
