"""Corpus pipeline: quality rules, line dedup, near-dedup, mixing, encoding, each a written stage.

What all stages do with odd rows: columns beside the five of documents are carried along, whatever their names; an
empty table stays empty; very long texts are judged whole; nulls, ties and repeated rows are told of stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableproof.fixtures import load
from tableproof.llm.common import settled
from tableproof.llm.line_dedup import line_dedup
from tableproof.llm.mixing import mix, mixed_documents
from tableproof.llm.quality_bands import quality_bands
from tableproof.llm.queries import MIXTURE, PIECES, quality_domains
from tableproof.llm.sentencepiece_fst import decode, encode, round_trip
from tableproof.llm.simhash import near_duplicates, one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the compression bands reject go. Null and empty texts have no words and go;
    repeated rows are judged each; ids, languages and sources may be null."""
    return quality_bands(docs).filter("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 20 characters that three or more documents share stay in one of them, the one with the largest
    id. No row goes; a null text becomes one empty line; rows that share an id count as one document."""
    left = line_dedup(docs, min_chars=20, min_docs=3)
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of copies and near copies (five-word shingles, similarity 0.8), the one with the
    smallest id, and of repeated rows one. Texts without a word are alike; a document without an id stays where no other of its group
    has one."""
    return one_of_each(docs, near_duplicates(docs, width=5, similarity=0.8)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted rates say, domains being learnt from the labelled ones that are left. Null texts
    have no tokens and stay once; repeated rows are repeated each; without labelled documents every rate is one."""
    domains = quality_domains(spark, docs, sf_dir)
    return mixed_documents(docs, mix(docs, domains, MIXTURE)).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy encoded and decoded: its ids, and whether they give the text back. Null and empty texts have no ids;
    only id, language and source are kept of the other columns."""
    back = decode(encode(docs.select("doc_id", "text", "lang", "source"), PIECES), PIECES)
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       round_trip().alias("round_trip"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", pieces),
]

#: Compression bands, fingerprints, fitted rates and encodings are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
