"""Line dedup, bands, archives, top-k, encoding, languages, toxicity and mixing on small and odd rows."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableproof.llm import line_dedup as L
from tableproof.llm import mixing as M
from tableproof.llm import quality_bands as Q
from tableproof.llm import toxicity as X
from tableproof.llm import warc as W
from tableproof.llm.language_mixture import Mixture, detect_languages, fit_languages
from tableproof.llm.sentencepiece_fst import Model, Transducer, decode, encode, read_model, round_trip
from tableproof.llm.topk import top_k

PIECES = "/opt/tokenizers/piece_bpe_32k.model"

# --- line dedup ----------------------------------------------------------------------


def plain_line_dedup(rows, min_chars, min_docs):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held: dict[str, set] = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(d)
    gone = {k: max(v) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if gone.get(key(x), d) == d]
        out.append((d, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out)


def test_line_dedup(spark):
    rng = random.Random(1)
    pool = ["A shared Line", "  a shared line\t", "UNIQUE é ÉÉÉ", "tiny", "", "another shared line\r", "ANOTHER SHARED LINE"]
    rows = [(d, "\n".join(rng.choice(pool) + rng.choice(["", "", f" {d}"]) for _ in range(rng.randint(0, 8)))) for d in range(60)] + [(90, None), (91, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in L.line_dedup(df, min_chars=8, min_docs=3).select("doc_id", "text", "n_lines", "n_dropped").collect())
    assert got == plain_line_dedup(rows, 8, 3)


def test_line_dedup_of_odd_rows(odd, nothing):
    got = L.line_dedup(odd)
    assert got.count() == odd.count() and set(odd.columns) <= set(got.columns)
    assert got.filter("doc_id = 2").first()["text"] == "" and got.filter("doc_id = 3").first()["n_lines"] == 1
    assert L.line_dedup(nothing).isEmpty()


# --- bands -----------------------------------------------------------------------------


def plain_repeats(words):
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside |= set(range(i, i + 8))
    return len(inside)


def test_repeated_words():
    rng = random.Random(3)
    for _ in range(60):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        assert Q.repeated_words(words) == plain_repeats(words)


def test_bands(spark, odd, nothing):
    rng = random.Random(4)
    prose = " ".join("".join(rng.choice(["ta", "ne", "ri", "so", "lu", "the", "and", "en"]) for _ in range(rng.randint(1, 4))) for _ in range(900))
    noise = " ".join("".join(chr(rng.randint(33, 0x2FFF)) for _ in range(9)) for _ in range(400))
    filler = " ".join(f"{prose[:60]}{i}" for i in range(300))
    df = spark.createDataFrame([("prose", prose), ("noise", noise), ("filler", filler), ("short", "too short")], "k string, text string")
    got = {r["k"]: r for r in Q.quality_bands(df).collect()}
    assert got["prose"]["kept"] and not got["noise"]["kept"] and not got["filler"]["kept"] and got["short"]["base_failed"]
    text = "a # b\n\n a # b\nx  \nx  "
    m = Q.measure(text, Q.Bands(), __import__("zstandard").ZstdCompressor())
    assert m[:5] == (8, 8, 2, 1, 0)  # only "x  " equals an earlier line
    rows = Q.quality_bands(odd).select("doc_id", "n_words", "kept").collect()
    assert len(rows) == odd.count() and not any(r["kept"] for r in rows)
    assert Q.quality_bands(nothing).isEmpty()


def test_a_bad_rest_is_judged():
    import base64

    import zstandard

    rng = random.Random(8)
    vocabulary = ["".join(rng.choice(["ta", "ne", "ri", "so", "lu", "the", "and", "en", "mo", "ku", "vi", "pel", "gra", "dos", "ch", "is"]) for _ in range(rng.randint(1, 4))) for _ in range(900)]
    prose = " ".join(rng.choice(vocabulary) for _ in range(900))
    noise = base64.b64encode(rng.randbytes(3000)).decode()
    blob = " ".join(noise[i:i + 8] for i in range(0, len(noise), 8))
    packer = zstandard.ZstdCompressor(level=3)
    kept = lambda text: Q.measure(text, Q.Bands(), packer)[-1]
    for rest in (500, 900, 1200, 1500, 1998):
        assert kept(prose[:2048 + rest]) and not kept(prose[:2047] + " " + blob[:rest])
    assert kept(prose[:2048 + 1]) and kept(prose[:2048]) and Q.measure(prose[:2048 + 7], Q.Bands(), packer)[7] == 2


# --- archives ----------------------------------------------------------------------------


def test_pages_travel_through_arc_and_warc(spark):
    pages = [(1, "http://a.example/x y", "<p>é</p>"), (2, None, None), (3, "http://b.example/", ""), (4, "http://c.example/", "<p>é</p>"),
             (5, "http://d.example/", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n\n1 0 x"), (4, "http://c.example/", "<p>é</p>"), (None, "u", "z" * 3_000_000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    rows = W.pages_to_warc(df).collect()
    assert len(rows) == len(pages) and all(r["digest_ok"] for r in rows)
    want = {p: (len((h or "").encode()), W.sha1_base32((h or "").encode())) for p, _, h in pages}
    assert all(want[r["page_id"]] == (r["payload_bytes"], r["payload_digest"]) for r in rows)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in rows if r["page_id"] != 4)
    assert kinds == [(0, "response", None), (1, "revisit", 4), (2, "revisit", 3), (3, "response", None), (5, "response", None)]
    assert sorted((r["record_type"], r["refers_to"] or 0) for r in rows if r["page_id"] == 4) == [("response", 0), ("revisit", 4)]
    by_id = {r["record_id"]: r for r in rows}
    assert len(by_id) == len(rows)
    assert all(by_id[r["refers_to_id"]]["record_type"] == "response" for r in rows if r["refers_to_id"])
    assert W.pages_to_warc(df.limit(0)).isEmpty()
    big = W.pages_to_warc(df, min_bytes=100).filter("record_type = 'revisit'")
    assert big.isEmpty()


def test_archive_versions_and_dates():
    import io

    for version in (1, 2):
        block = f"{version} 0 org\n{W.ARC_FIELDS[version]}\n".encode()
        data = W.arc_head(version, "filedesc://x.arc", "0.0.0.0", "20200101000000", "text/plain", len(block)) + block + b"\n"
        data += W.arc_head(version, "http://x/a b", "1.2.3.4", "1999123123", "text/html", 5, status="404") + b"12\n45\n"
        found = list(W.arc_records(io.BytesIO(data)))
        assert [(r[1], r[2], r[3], r[6], r[7]) for r in found] == [(version, "http://x/a b", "1.2.3.4", "404" if version == 2 else None, b"12\n45")]
        with pytest.raises(ValueError, match="declares"):
            list(W.arc_records(io.BytesIO(data[:-4])))
    assert W.iso_date("1999123123") == "1999-12-31T23:00:00Z" and W.iso_date("20200101") == "2020-01-01T00:00:00Z"


# --- top-k ---------------------------------------------------------------------------------


def plain_top(rows, k):
    v = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in e]) for i, e in rows if e and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for q, a in v:
        if q % 5 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in v if i != q and len(b) == len(a))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("dim", [1, 3, 16, 64])
def test_top_k(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, dim).astype(np.float32).round(1 if i % 3 else 4)]) for i in range(300)]
    rows += [(1000, None), (1005, [None] * dim), (1010, [float("nan")] * dim), (1015, [float("inf")] * dim), (1020, [0.5] * (dim + 1)), (1025, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    found = top_k(df, F.col("vec_id") % 5 == 0, k=7, query_block=20)
    assert sorted(tuple(r) for r in found.filter("vec_id < 1025 AND query_id < 1025").collect()) == plain_top(rows, 7)
    assert top_k(df.limit(0), F.col("vec_id") % 5 == 0).isEmpty()


# --- encoding ----------------------------------------------------------------------------------

needs_pieces = pytest.mark.skipif(not os.path.exists(PIECES), reason="the public tokenizer is not there")


@needs_pieces
def test_encoding_equals_the_library(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PIECES)
    fst = Transducer(read_model(open(PIECES, "rb").read()))
    rng = random.Random(7)
    texts = ["", " ", "Hello  world", "a▁b <s> <0x41>", "a" * 3000, "日本語\U0001f600 é", "\x00\t\n x"]
    texts += ["".join(rng.choice("ab cdeüé\n▁  日本\U0001f600.#<>0x41ſ\t") for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in texts:
        ids = fst.encode(t)
        assert ids == sp.encode(t) and fst.decode(ids) == sp.decode(ids) == t.replace("▁", " ")


def plain_unigram(text, cost):
    best = {0: (0.0, [])}
    for end in range(1, len(text) + 1):
        options = [(best[s][0] + cost[text[s:end]], best[s][1] + [text[s:end]]) for s in range(end) if text[s:end] in cost and s in best]
        if options:
            best[end] = min(options, key=lambda x: x[0])
    return best[len(text)]


def test_unigram_models_take_the_lightest_path():
    pieces = ["<unk>", "▁", "a", "b", "ab", "ba", "▁a", "▁ab", "bab"]
    scores = [0.0, -3.0, -2.0, -2.5, -2.2, -3.1, -2.6, -4.4, -4.0]
    fst = Transducer(Model(pieces, scores, [2] + [1] * 8, 1, False, True, True))
    cost = {p: -s for p, s in zip(pieces[1:], scores[1:])}
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 12)))
        path = [pieces[i] for i in fst.encode(t)]
        assert "".join(path) == fst.normalise(t)
        if t:
            assert abs(sum(cost[p] for p in path) - plain_unigram(fst.normalise(t), cost)[0]) < 1e-9
    assert fst.encode("azz") == [pieces.index("▁a"), 0]


@needs_pieces
def test_encoding_of_odd_rows(odd, nothing):
    back = decode(encode(odd, PIECES), PIECES)
    assert back.filter(~round_trip()).isEmpty() and back.count() == odd.count()
    assert back.filter("doc_id = 2").first()["ids"] == []
    assert decode(encode(nothing, PIECES), PIECES).isEmpty()


# --- languages -----------------------------------------------------------------------------------


def language_rows():
    rng = random.Random(2)
    parts = {"xx": ["tion", "the", "ing", "and"], "yy": ["schen", "ung", "der", "ich"], "zz": ["eau", "ement", "oux", "que"]}
    text = lambda k, n: " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    return [(i, text(k, rng.randint(3, 80)), k) for i, k in enumerate(["xx", "yy", "zz"] * 40)], text


def test_languages(spark, odd, nothing):
    rows, text = language_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = fit_languages(df, F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: r for r in detect_languages(df, model).collect()}
    assert sum(got[i]["lang_pred"] == k for i, _, k in rows) >= 0.99 * len(rows)
    mixed = model.infer(text("xx", 300) + " " + text("yy", 100))
    assert mixed[0] == "xx" and set(mixed[2]) == {"xx", "yy"} and abs(mixed[2]["yy"] - 0.25) < 0.1
    assert set(model.infer(text("zz", 200))[2]) == {"zz"}
    rows = {r["doc_id"]: r for r in detect_languages(odd, model).collect()}
    assert rows[2]["lang_pred"] == rows[3]["lang_pred"] == rows[8]["lang_pred"] == "und" and rows[2]["score"] == 0.0
    assert detect_languages(nothing, model).isEmpty()
    empty = fit_languages(nothing.withColumn("doc_id", F.lit(1)), F.lit(True))
    assert empty.languages == [] and empty.infer("words")[0] == "und"


def test_proportions_are_the_likeliest():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(50), 2).T
    n = rng.multinomial(4000, p @ [0.3, 0.7]).astype(float)
    theta, fit = Mixture(["a", "b"], p, rounds=200).proportions(p, n)
    grid = [float(n @ np.log(p @ [x, 1 - x])) for x in np.linspace(0.001, 0.999, 999)]
    assert abs(fit - max(grid)) < 1e-2 and abs(theta.sum() - 1) < 1e-9


# --- toxicity ---------------------------------------------------------------------------------------


def test_toxicity(spark, odd, nothing):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ta", "ne", "ri", "so", "lu"]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(400):
        words = [word() for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(["blarghed", "Snorfle!"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = X.fit_toxicity(df.filter("doc_id < 300"))
    again = X.fit_toxicity(df.filter("doc_id < 300").repartition(7))
    assert np.allclose(model.weight, again.weight) and model.bias == pytest.approx(again.bias)
    got = X.score_toxicity(df.filter("doc_id >= 300"), model).collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.97 * len(got)
    assert model.score("tane blarghed " + "riso " * 50) > 0.3 > model.score(None)
    assert X.score_toxicity(odd, model).count() == odd.count() and X.score_toxicity(nothing, model).isEmpty()
    none = X.fit_toxicity(df.limit(0))
    assert none.score("anything") == pytest.approx(0.5)
    assert X.fit_toxicity(df.filter("toxic = 0")).score("anything") < 0.05


# --- mixing -------------------------------------------------------------------------------------------


def test_rates_meet_the_targets(spark, odd):
    rows, text = language_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = M.fit_domains(df, "lang", "text")
    assert model.names == ["xx", "yy", "zz"]
    got = M.mix(df, model, {"xx": 0.6, "yy": 0.3, "zz": 0.1}).collect()
    tokens = sum(r["n_tokens"] for r in got)
    shares = [sum(r["rate"] * r["n_tokens"] * r["posterior"][k] for r in got) / tokens for k in range(3)]
    assert np.allclose(shares, [0.6, 0.3, 0.1], atol=5e-3) and min(r["rate"] for r in got) >= 0
    assert all(int(r["rate"]) <= r["copies"] <= int(r["rate"]) + 1 for r in got)
    kept = M.mixed_documents(df, M.mix(df, model, {"xx": 0.6, "yy": 0.3, "zz": 0.1}))
    assert kept.count() == sum(r["copies"] for r in got) and kept.columns == df.columns
    zero = M.mix(df, model, {"xx": 1.0}).filter("rate < 0").count()
    assert zero == 0
    rows = M.mix(odd, model, {"xx": 1.0}).collect()
    assert len(rows) == odd.count() and all(abs(sum(r["posterior"]) - 1) < 1e-9 for r in rows)
    assert M.mix(df.limit(0), model, {"xx": 1.0}).isEmpty()
    assert M.mix(df, M.fit_domains(df.limit(0), "lang"), {"xx": 1.0}).filter("copies <> 1").isEmpty()
    with pytest.raises(ValueError, match="no target"):
        M.mix(df, model, {"other": 1.0})
