"""Whole queries and operators against plain brute force, and the pipeline's stages on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import warnings
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from tableproof.fixtures import load
from tableproof.llm import queries as Q
from tableproof.llm.language_mixture import fit_languages, trigrams
from tableproof.llm.mixing import Domains, Unmet, fit_rates
from tableproof.llm.sentencepiece_fst import Model, Transducer
from tableproof.llm.topk import top_k
from tableproof.llm.toxicity import BUCKETS, fit_toxicity, ngram_buckets, score_toxicity

# --- 1 ----------------------------------------------------------------------------------------------

CLEAN = "garden river window letter bread morning music winter table paper forest story bridge candle market".split()
RUDE = "grukk vlorp snazz drokk blarg".split()


def labelled_texts(rng, n, rude):
    out = []
    for _ in range(n):
        words = [rng.choice(CLEAN) + rng.choice("abcdefghij") for _ in range(40)]
        for _ in range(3 * rude):
            words[rng.randrange(40)] = rng.choice(RUDE)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("copied", [0, 1])
def test_a_copied_text_is_evidence_once(spark, copied):
    rng = random.Random(2)
    rows = [(t, 0) for t in labelled_texts(rng, 200, 0)] + [(t, 1) for t in labelled_texts(rng, 100, 1)]
    rows += [(labelled_texts(rng, 1, copied)[0], copied)] * 150
    rows += [(None, 0), ("", 1), ("x", None), ("x", 2)]
    model = fit_toxicity(spark.createDataFrame(rows, "text string, toxic int").repartition(4), fit_rows=120)
    assert 60 < model.fitted_on <= 120
    held = [(t, 0) for t in labelled_texts(rng, 100, 0)] + [(t, 1) for t in labelled_texts(rng, 100, 1)]
    got = score_toxicity(spark.createDataFrame(held, "text string, toxic int"), model).groupBy("toxic").agg(F.avg("predicted")).collect()
    share = {r["toxic"]: r[1] for r in got}
    assert share[1] >= 0.9 and share[0] <= 0.05
    # the ratios are those of a count by hand over distinct texts
    pairs = {(t or "", y) for t, y in rows if y in (0, 1)}
    n = Counter(y for _, y in pairs)
    have = {y: Counter(int(b) for t, z in pairs if z == y for b in {int(x) for part in ngram_buckets(t) for x in part}) for y in (0, 1)}
    for bucket in np.flatnonzero(model.slot < len(model.ratio))[:200].tolist():
        p, q = (have[1][bucket] + 1) / (n[1] + 2), (have[0][bucket] + 1) / (n[0] + 2)
        assert model.ratio[model.slot[bucket]] == pytest.approx(np.log(p / q))
    assert len(model.slot) == BUCKETS


# --- 3 ----------------------------------------------------------------------------------------------


def test_repeats_of_400_bytes_equal_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in load(spark, sf_dir, "documents").collect()]
    counts = Counter(xxhash.xxh3_128_digest(b[i:i + 400]) for _, b in docs for i in range(len(b) - 399))
    want = {}
    for doc, b in docs:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 399):
            if counts[xxhash.xxh3_128_digest(b[i:i + 400])] > 1:
                gone[i:i + 400] = True
        gone = gone[: len(b)]
        starts = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        want[doc] = (len(b), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in Q.op3_repeats(spark, sf_dir).collect()}
    assert got == want and any(w[1] for w in want.values())


# --- 4 ----------------------------------------------------------------------------------------------


def rate_rows(spark, tokens, p):
    return spark.createDataFrame([(i, int(t), [float(x) for x in row]) for i, (t, row) in enumerate(zip(tokens, p))],
                                 "doc_id bigint, n_tokens bigint, posterior array<double>").repartition(3)


def test_rates_equal_those_of_a_plain_solver(spark):
    rng = np.random.default_rng(4)
    tokens, p = rng.integers(5, 400, 150), rng.dirichlet([0.6, 0.4, 0.3], 150)
    model = Domains(["a", "b", "c"], np.zeros(3), np.zeros((1, 3)))
    goal = np.array([0.2, 0.3, 0.5]) * tokens.sum()
    rated = fit_rates(rate_rows(spark, tokens, p), model, {"a": 2, "b": 3, "c": 5}, tolerance=1e-5, rounds=400).collect()
    rate = np.array([r["rate"] for r in sorted(rated, key=lambda r: r["doc_id"])])
    a = p.T * tokens

    def off(r):
        return float(np.abs(a @ r - goal).max() / tokens.sum())

    plain = np.ones(150)
    for _ in range(20000):
        plain = np.maximum(0, plain - (a.T @ (a @ plain - goal)) / np.linalg.norm(a, 2) ** 2)
    assert (rate >= 0).all() and off(rate) <= 1e-5 and off(plain) <= 1e-3


def test_targets_that_cannot_be_met_are_told(spark):
    model = Domains(["a", "b"], np.zeros(2), np.zeros((1, 2)))
    rows = rate_rows(spark, [10, 20, 30], [[0.5, 0.5]] * 3)
    with pytest.warns(Unmet, match="'a'"):
        fit_rates(rows, model, {"a": 0.9, "b": 0.1}, rounds=5)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        fit_rates(rows, model, {"a": 0.5, "b": 0.5})


# --- 6 ----------------------------------------------------------------------------------------------


def merged_by_hand(text, rank):
    parts = list(text)
    while True:
        best = max(((rank[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)
        if best is None:
            return parts
        i = -best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_shortest_paths_are_merges_by_rank():
    rng = random.Random(3)
    for _ in range(12):
        pieces = ["▁", "a", "b", "c"]
        while len(pieces) < 16:
            new = rng.choice(pieces) + rng.choice(pieces[1:])
            if new not in pieces and "▁" not in new[1:]:
                pieces.append(new)
        scores = [-100.0] * 4 + [-float(i) for i in range(len(pieces) - 4)]
        fst = Transducer(Model(["<unk>", *pieces], [0.0, *scores], [2] + [1] * len(pieces), 2, False, True, True))
        rank = dict(zip(pieces[4:], scores[4:]))
        for text in map("".join, itertools.product("abc", repeat=5)):
            assert [fst.model.pieces[i] for i in fst.encode(text)] == merged_by_hand("▁" + text, rank)


# --- 7 ----------------------------------------------------------------------------------------------


def test_languages_equal_a_search_over_all_sets(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    model = fit_languages(docs, ~Q.held_out(F.col("doc_id")))
    got = {r["doc_id"]: r for r in Q.op7_language(spark, sf_dir).collect()}
    same = far = n = 0
    for r in docs.select("doc_id", "text").collect():
        at, count = np.unique(trigrams(r["text"] or ""), return_counts=True)
        if not len(at):
            assert got[r["doc_id"]]["lang_pred"] == "und" and got[r["doc_id"]]["score"] == 0
            continue
        p, best = model.probability[at], None
        for k in range(1, len(model.languages) + 1):
            for chosen in itertools.combinations(range(len(model.languages)), k):
                q, theta = p[:, chosen], np.full(k, 1 / k)
                for _ in range(60):
                    theta = theta * ((count / (q @ theta)) @ q) / count.sum()
                fit = float(count @ np.log(q @ theta)) - k * 0.5 * np.log(max(2, count.sum()))
                if best is None or fit > best[0]:
                    best = fit, chosen, theta
        n += 1
        lead = model.languages[best[1][int(np.argmax(best[2]))]]
        same += got[r["doc_id"]]["lang_pred"] == lead
        far += abs(got[r["doc_id"]]["score"] - best[2].max()) > 0.05
    assert same >= 0.99 * n and far <= 0.02 * n


# --- 9 ----------------------------------------------------------------------------------------------


def test_a_query_id_that_several_rows_bear_is_asked_alike(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.5])]
    answers = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(*r, "clash", 7) for r in order], "vec_id bigint, embedding array<double>, chunk string, asks int")
        answers.append(sorted(tuple(r) for r in top_k(df, F.col("vec_id") == 0, k=2).collect()))
    assert answers[0] == answers[1] == [(0, 1, 2, 1 << 20), (0, 2, 2, 1 << 20)]


def test_chunks_and_blocks_change_nothing(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    whole, cut = (sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 7 == 0, k=4, least_chunk=n).collect()) for n in (1 << 20, 40))
    assert whole == cut and len(whole) == 43 * 4


# --- pipeline ---------------------------------------------------------------------------------------


def test_stages_take_odd_rows(spark, sf_dir):
    good = "The quick river runs by the old garden wall and then on to the market, where bread and letters wait for the morning. " * 3
    rows = [(1, good, "en", "a", 300), (1, good, "en", "a", 300), (2, None, None, None, None), (3, "", "en", "b", 0), (None, good + "more", "en", "b", 1),
            (4, "lorem ipsum dolor sit amet " * 4000, "de", None, 7), (5, "\n\n \n", "fr", "c", 4), (6, "日本語 ünïcödé \U0001f600 ▁ end\t\r\n", None, "c", 9)]
    names = ["row", "score", "kept", "n_lines", "ids", "tid", "key", "rate", "copies", "component_id", "c0", "n0"]
    schema = T.StructType([*load(spark, sf_dir, "documents").schema.fields, *[T.StructField(n, T.StringType()) for n in names]])
    docs = spark.createDataFrame([(*r, *["clash"] * len(names)) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        got = out.collect()
        if name == corpus_pipeline.STAGES[-1][0]:
            assert len(got) == len(rows) and all(r["round_trip"] for r in got)
            continue
        assert out.columns == docs.columns, name
        assert all(r["row"] == "clash" for r in got), name
        if name == "SimHash near-dedup":
            assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 2, 4, 6]
        if name == "line dedup":
            assert len(got) == len(rows)
