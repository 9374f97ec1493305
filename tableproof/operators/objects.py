"""Schema objects: signatures per class and their digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableproof.functions import digests as D
from tableproof.functions.names import flatten_definition
from tableproof.operators.fingerprint import LEAF_DIGITS, tree_digests


def object_digest(objects: DataFrame, classes: DataFrame, algo: str = "md5", depth: int = LEAF_DIGITS) -> DataFrame:
    """``db, class, n, digest`` with ``digest`` = ``<count>:<hex>``; a class of ``classes``
    (``db, class``) without objects has count 0 and the digest of nothing.

    Definitions are flattened to one line, hashed and folded as a tree, so one class may hold any
    share of the catalogue."""
    hashed = objects.select("db", "class", D.digest(flatten_definition(F.col("definition")), algo).alias("h"))
    found = tree_digests(hashed, ["db", "class"], depth, algo)
    joined = classes.join(found, ["db", "class"], "left")
    n = F.coalesce(F.col("n"), F.lit(0).cast("bigint"))
    hex_digest = F.coalesce(F.col("digest"), D.digest(F.lit(""), algo))
    return joined.select(
        "db", "class", n.alias("n"), F.concat_ws(":", n.cast("string"), hex_digest).alias("digest")
    )


def index_signature(index_columns: DataFrame) -> DataFrame:
    """One line per index from ``db, index, table, seq, column``: ``name on table(cols in order)``.

    The group is one index, whose column count every engine bounds."""
    cols = F.sort_array(F.collect_list(F.struct("seq", "column")))
    grouped = index_columns.groupBy("db", "index", "table").agg(cols.alias("_cols"))
    listed = F.array_join(F.transform("_cols", lambda x: x["column"]), ",")
    return grouped.select(
        "db",
        F.lit("indexes").alias("class"),
        F.concat(F.col("index"), F.lit(" on "), F.col("table"), F.lit("("), listed, F.lit(")")).alias("definition"),
    )


def view_signature(views: DataFrame, algo: str = "md5") -> DataFrame:
    """``name hash(definition)`` per view of ``db, name, definition``."""
    return views.select(
        "db",
        F.lit("views").alias("class"),
        F.concat_ws(" ", "name", D.digest(F.col("definition"), algo)).alias("definition"),
    )


def class_list(objects: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Every expected class for every database of ``objects``."""
    return objects.select("db").distinct().select(
        "db", F.explode(F.array(*[F.lit(c) for c in classes])).alias("class")
    )


def digest_count(digest: Column) -> Column:
    """The count in front of an object digest."""
    return F.nullif(F.regexp_extract(digest, r"^([0-9]+):", 1), F.lit("")).cast("bigint")
