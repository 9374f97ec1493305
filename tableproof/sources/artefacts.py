"""Catalogues of files: names, hashes, whole trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableproof.sources.files import hash_files, list_files, walk_files

UNREPRESENTABLE_RE = r'[\n\t"]'


def list_artefacts(spark: SparkSession, path: str, site: str) -> DataFrame:
    """``site, name, bytes, mtime`` of the regular files at depth one; no content is read."""
    return list_files(spark, path).select(F.lit(site).alias("site"), F.col("rel").alias("name"), "bytes", "mtime")


def hash_artefacts(spark: SparkSession, path: str, site: str, names: DataFrame | None = None) -> DataFrame:
    """``site, name, bytes, sha256``; ``names`` narrows the files that are read."""
    files = list_files(spark, path)
    if names is not None:
        files = files.join(names.select(F.col("name").alias("rel")).distinct(), "rel", "left_semi")
    return hash_files(files).select(F.lit(site).alias("site"), F.col("rel").alias("name"), "bytes", "sha256")


def scan_file_tree(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, unrepresentable`` of every file below ``path``, hidden ones too. A name a
    manifest cannot carry is flagged; callers refuse it."""
    return walk_files(spark, path).select(
        F.col("rel").alias("path"), "bytes", F.col("rel").rlike(UNREPRESENTABLE_RE).alias("unrepresentable")
    )


def fingerprint_file_tree(spark: SparkSession, path: str) -> DataFrame:
    """Files as tables: ``table`` is the relative path, ``fingerprint`` is ``<sha256>:<bytes>``."""
    files = walk_files(spark, path)
    if not files.filter(F.col("rel").rlike(UNREPRESENTABLE_RE)).isEmpty():
        raise ValueError("a file name holds a newline, a tab or a double quote")
    return hash_files(files).select(
        F.col("rel").alias("table"), F.concat_ws(":", "sha256", F.col("bytes").cast("string")).alias("fingerprint")
    )
