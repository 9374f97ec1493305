"""The llm operators as queries over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableproof.fixtures import load
from tableproof.llm.common import held_out, settled
from tableproof.llm.language_mixture import detect_languages, fit_languages
from tableproof.llm.line_dedup import line_dedup
from tableproof.llm.merkle import fold, leaf_digest, merkle_manifest, proof_digest
from tableproof.llm.mixing import Domains, fit_domains, mix
from tableproof.llm.multi_index import hard_negatives
from tableproof.llm.positional_index import decontaminate
from tableproof.llm.quality_bands import quality_bands
from tableproof.llm.run_length_index import repeats
from tableproof.llm.sentencepiece_fst import decode, encode, round_trip
from tableproof.llm.simhash import simhash_components
from tableproof.llm.topk import top_k
from tableproof.llm.toxicity import fit_toxicity, score_toxicity
from tableproof.llm.warc import pages_to_warc

#: The public tokenizer whose pieces are encoded with; a parameter of the operator.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

#: Shares of the mixture: a language is the domain of a good document, all poor ones together have a twentieth.
MIXTURE = {"good en": 0.53, "good de": 0.14, "good fr": 0.14, "good es": 0.14,
           "poor en": 0.02, "poor de": 0.01, "poor fr": 0.01, "poor es": 0.01}

SPACE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    labels = load(spark, sf_dir, "labels").filter("toxic IS NOT NULL").select("doc_id", "toxic")
    # labels grow with the documents: a shuffled join at every size
    learn = docs.filter(~held_out(F.col("doc_id"))).join(labels.hint("merge"), "doc_id").select("text", "toxic")
    model = fit_toxicity(learn)
    return score_toxicity(docs, model, threshold=0.3).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_to_warc(load(spark, sf_dir, "pages"), min_bytes=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS n, upper(sha1(body)) AS hex FROM p),
b AS (SELECT page_id, n, list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform(range(0, 4), lambda j:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(hex, 1 + 5 * g, 5))::BIGINT >> (15 - 5 * j)) & 31 AS BIGINT), 1)),
        'string_agg', '')), 'string_agg', '') AS digest FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS last FROM b)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM m"""


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(load(spark, sf_dir, "documents"), length=400)
    return found.select(
        "doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["number"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.coalesce(F.sha2("kept", 256), F.col("text_sha256")).alias("kept_sha256"))


def quality_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Domains:
    """Domains of quality and language, learnt from the labelled documents among ``docs``."""
    labels = load(spark, sf_dir, "labels").filter("quality IN (0, 1)").select("doc_id", "quality")
    # labels grow with the documents: a shuffled join at every size
    rows = docs.filter("lang IS NOT NULL").select("doc_id", "text", "lang").join(labels.hint("merge"), "doc_id")
    name = F.concat_ws(" ", F.when(F.col("quality") == 1, "good").otherwise("poor"), "lang")
    return fit_domains(rows.select("text", name.alias("domain")), "domain")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = quality_domains(spark, docs, sf_dir)
    return mix(docs, model, MIXTURE).select(
        "doc_id", "n_tokens", F.array(*[F.lit(n) for n in model.names]).cast("array<string>").alias("domains"), "posterior",
        "rate", "copies")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, min_chars=20, min_docs=3).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line,
             translate(trim(line, {SPACE_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND c.last <> k.doc_id AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    back = decode(encode(docs, PIECES), PIECES)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", round_trip().alias("round_trip"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = fit_languages(docs, ~held_out(F.col("doc_id")))
    found = detect_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.map_entries("languages").alias("languages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(load(spark, sf_dir, "documents"), width=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 10"""


def op10_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bands(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), width=10)
    return docs.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
w AS (SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[s:s + least(10, len(words)) - 1], ' ') AS phrase
      FROM (SELECT item_id, words, unnest(generate_series(1, greatest(len(words) - 9, 1))) AS s FROM b WHERE len(words) > 0)),
g AS (SELECT doc_id, s, n, array_to_string(words[s:s + n - 1], ' ') AS phrase
      FROM (SELECT doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM w))),
m AS (SELECT g.doc_id, g.s, g.n, w.item_id FROM g JOIN w USING (n, phrase)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS pos FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, high=100)


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    fields = [F.col(c) for c in ("doc_id", "source", "lang")] + [F.try_add(F.col("n_chars"), F.lit(1)), F.col("text")]
    docs = load(spark, sf_dir, "documents")
    kept = merkle_manifest(docs, carry={"tampered": F.when(edited, leaf_digest(fields))})
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    out = kept.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


OP13_SQL = """
WITH RECURSIVE
fields AS (SELECT doc_id, lang, unnest([0, 1]) AS edit, doc_id::VARCHAR AS a, source AS b, lang AS c, n_chars AS n, text AS e,
                  list_reduce([4294967295] || list_transform(range(0, length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, 1 + i, 1))::BIGINT),
                    lambda crc, byte: list_reduce([xor(crc, byte)] || range(0, 8),
                      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc FROM documents),
hashed AS (SELECT doc_id, lang, edit, coalesce(xor(crc, 4294967295) % 7 = 0, false) AS tampered,
                  sha256(concat(coalesce(octet_length(encode(a)) || ':' || a, '-'), coalesce(octet_length(encode(b)) || ':' || b, '-'),
                                coalesce(octet_length(encode(c)) || ':' || c, '-'), coalesce(octet_length(encode((n + edit)::VARCHAR)) || ':' || (n + edit), '-'),
                                coalesce(octet_length(encode(e)) || ':' || e, '-'))) AS h FROM fields),
leaves AS (SELECT a.doc_id, a.lang, a.h AS leaf, CASE WHEN a.tampered THEN b.h ELSE a.h END AS start,
                  row_number() OVER (PARTITION BY a.lang ORDER BY a.doc_id) - 1 AS pos, count(*) OVER (PARTITION BY a.lang) AS n
           FROM hashed a JOIN hashed b ON a.doc_id = b.doc_id AND a.edit = 0 AND b.edit = 1),
t AS (SELECT lang, 0 AS level, pos, leaf AS h, n FROM leaves
      UNION ALL
      SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subroots AS (SELECT lang, level AS depth, h, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, pos, h, n FROM subroots
      UNION ALL
      SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY level, pos // 2, n),
steps AS (SELECT l.doc_id, t.level, CASE WHEN t.pos % 2 = 1 THEN t.h END AS after, CASE WHEN t.pos % 2 = 0 THEN t.h END AS before
          FROM leaves l JOIN t ON l.lang IS NOT DISTINCT FROM t.lang AND xor(l.pos >> t.level, 1) = t.pos AND t.n > 1
          UNION ALL
          SELECT l.doc_id, s.depth + u.level, CASE WHEN u.pos % 2 = 1 THEN u.h END, CASE WHEN u.pos % 2 = 0 THEN u.h END
          FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN u ON xor(s.pos >> u.level, 1) = u.pos AND u.n > 1),
proofs AS (SELECT doc_id, sha256(string_agg(coalesce(before, after), '' ORDER BY level)) AS proof FROM steps GROUP BY doc_id),
height AS (SELECT s.lang, s.depth + (SELECT max(level) FROM u) AS top, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root FROM subroots s),
f AS (SELECT l.doc_id, l.lang, 0 AS level, l.start AS h, k.top FROM leaves l JOIN height k ON l.lang IS NOT DISTINCT FROM k.lang
      UNION ALL
      SELECT f.doc_id, f.lang, f.level + 1, sha256(concat(coalesce(s.before, ''), f.h, coalesce(s.after, ''))), f.top
      FROM f LEFT JOIN steps s ON f.doc_id = s.doc_id AND f.level = s.level WHERE f.level < f.top)
SELECT l.doc_id, l.leaf, k.subroot, k.root, coalesce(p.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = k.root AS verified
FROM leaves l JOIN height k ON l.lang IS NOT DISTINCT FROM k.lang JOIN f ON f.doc_id = l.doc_id AND f.level = f.top
LEFT JOIN proofs p ON p.doc_id = l.doc_id"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_arc_to_warc": op2_arc_to_warc,
    "op3_repeats": op3_repeats,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_language": op7_language,
    "op8_simhash": op8_simhash,
    "op9_top_k": op9_top_k,
    "op10_quality_bands": op10_quality_bands,
    "op11_decontaminate": op11_decontaminate,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle": op13_merkle,
}
ORACLE: dict[str, str] = {
    "op2_arc_to_warc": OP2_SQL,
    "op5_line_dedup": OP5_SQL,
    "op9_top_k": OP9_SQL,
    "op11_decontaminate": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_merkle": OP13_SQL,
}
