"""Operator 5: line dedup over documents, in DataFrame operations.

Lines are exploded, normalised and hashed; documents are counted per hash; the hash rows, never the
texts, meet again by hash; positions to drop go back to the documents, which are reassembled in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableproof.llm.common import LOWER, SPACE, UPPER, settled


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20,
               min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text`` reassembled, plus ``n_lines`` and ``n_dropped``.

    A line whose key has at least ``min_chars`` code points and stands in at least ``min_docs`` documents
    stays only in the largest of their ids (all its occurrences there). A null or empty text is one empty
    line and comes out as an empty text. Rows that repeat an id count as one document and are each
    reassembled; a null id counts as one document below all others. Ties cannot occur: ids order them.
    Columns named ``n_lines`` or ``n_dropped`` are replaced, all others kept.

    Hot lines: (hash, id) pairs are made distinct before ids are counted, both steps combine on the map
    side, and the join back is an equi join whose hot side adaptive execution splits. Text is shuffled
    once, for the reassembly; only 16-byte hashes and positions move otherwise."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    tid = F.xxhash64(body)
    lines = (
        docs.select(F.col(f"`{doc_id}`").alias("d"), tid.alias("t"), F.posexplode(F.split(body, "\n")).alias("p", "line"))
        .select("d", "t", "p", line_key(F.col("line")).alias("key"))
        .filter(F.char_length("key") >= min_chars)
        .select("d", "t", "p", F.unhex(F.md5("key")).alias("h"))
    )
    lines = settled(lines, "lines")
    # written, so that both sides of the join are dealt anew and a hot line can be split
    common = settled(
        lines.select("h", "d").distinct().groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("last"))
        .filter(F.col("n") >= min_docs).select("h", "last"), "common-lines",
    )
    drops = (
        lines.join(common, "h").filter(~F.col("d").eqNullSafe(F.col("last")))
        .groupBy("d", "t").agg(F.collect_set("p").alias("drops"))
    )
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{doc_id}`").alias("id"), body.alias("body"))
    met = rows.join(drops, F.col("id").eqNullSafe(F.col("d")) & (F.xxhash64("body") == F.col("t")), "left")
    parts = F.split("body", "\n")
    kept = F.when(F.col("drops").isNull(), F.col("body")).otherwise(F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "drops"),
        lambda i: F.element_at(parts, i + 1)), "\n"))
    made = {
        text: kept,
        "n_lines": F.size(parts).cast("long"),
        "n_dropped": F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long"),
    }
    others = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in made]
    out = met.select(*others, *[v.alias(k) for k, v in made.items()])
    return out.select(*docs.columns, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns])
