"""Manifests as they arrive."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tableproof.session import keyed_state, settle
from tableproof.sources.files import exists, is_folder, list_level, qualified
from tableproof.sources.manifests import IS_MANIFEST, parsed_manifests

#: Folders that names are dealt to by their hash; a batch looks into those its own names fall into.
BUCKETS = 256


def name_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New ``*.json`` files of a folder as ``root, rel``; none is opened.

    A trigger is one look: a task lists the folder, and the names that were seen before are state, on disk by key. The driver
    holds none of them; Spark's file source keeps every name of the folder there, and a plan of them all."""
    if not is_folder(spark, folder):
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {folder}")
    keyed_state(spark)
    looks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    listed = list_level(looks.select(F.lit(qualified(spark, folder)).alias("root"), F.lit("").alias("rel")))
    there = "mtime IS NOT NULL OR NOT startswith(root, 'file:')"  # on a disk, only what is gone or a link to nothing has no time
    return listed.filter("NOT is_dir").filter(IS_MANIFEST).filter(there).select("root", "rel").dropDuplicates(["rel"])


def bucket_of(name: str, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def read_buckets(spark: SparkSession, catalogue: str, buckets: Sequence[int]) -> DataFrame | None:
    """The catalogue's rows in some buckets; no other folder is listed or opened. None where none of them exists."""
    held = [p for p in (f"{catalogue}/bucket={b}" for b in buckets) if exists(spark, p)]
    return spark.read.option("basePath", catalogue).parquet(*held) if held else None


def append_batch(batch: DataFrame, run: str, batch_id: int, catalogue: str, buckets: int = BUCKETS) -> None:
    """Add the manifests of a batch whose names the catalogue does not hold; the same batch run again replaces itself."""
    spark = batch.sparkSession
    dealt = settle(batch.dropDuplicates(["name"]).withColumn("bucket", bucket_of("name", buckets)))
    touched = sorted(r["bucket"] for r in dealt.select("bucket").distinct().collect())  # BUCKETS numbers at most
    if not touched:
        return
    known = read_buckets(spark, catalogue, touched)
    label = f"{run}-{batch_id}"
    if known is not None:
        earlier = known.filter(F.col("batch") != label).select("bucket", "name").hint("merge")  # names are more than their share of the files
        dealt = dealt.join(earlier, ["bucket", "name"], "left_anti")
    rows = dealt.withColumn("batch", F.lit(label)).repartition("bucket")
    rows.write.partitionBy("bucket", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(catalogue)


def stream_manifests(spark: SparkSession, folder: str, catalogue: str, checkpoint: str, available_now: bool = True,
                     buckets: int = BUCKETS, every: str = "10 seconds") -> StreamingQuery:
    """Append new manifests to the Parquet table ``catalogue``, each name once.

    The stream is one of names; their files are read as in :func:`~tableproof.sources.manifests.read_manifests`, many to a
    task. The table lies in folders by the hash of the name, and in them by batch. A batch reads the names of the buckets it
    touches and no others, so its cost follows the batch and not the age of the catalogue. A batch that is run
    again after a failure replaces its own folders; a stream begun anew over the same folder adds nothing. The
    number of buckets of a catalogue is fixed by its first batch.

    With ``available_now`` the stream ends after one look at the folder; else it looks ``every`` so often until it is stopped,
    and is never idle, so ``processAllAvailable`` would wait for ever."""
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def append(batch: DataFrame, batch_id: int) -> None:
        append_batch(parsed_manifests(batch), run, batch_id, catalogue, buckets)

    writer = name_stream(spark, folder).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
