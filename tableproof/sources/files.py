"""Small file-system steps on the driver, and the big ones (list, hash, copy) on the executors.

Listing and hashing go through Arrow file systems inside tasks: no name is hidden from them (the file
source of Spark skips names that begin with a dot or an underscore), and a file of any size is hashed
in pieces instead of being held as one value."""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableproof.operators.fingerprint import LEAF_DIGITS, tree_digests
from tableproof.session import settle

CHUNK = 8 * 1024 * 1024
SLICE_NAMES = 4096
TASK_BYTES = 128 * 1024 * 1024


# --- driver: single small steps ----------------------------------------------------


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark resolves it by, so that tasks meet the same store. A path
    without a scheme is one of the cluster's default file system, not of the executor's own disk."""
    fs, p = _fs(spark, path)
    return fs.makeQualified(p).toString()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def remove(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def remove_last(spark: SparkSession, path: str) -> None:
    """Remove a file, and its folder if that holds nothing else."""
    fs, p = _fs(spark, path)
    fs.delete(p, False)
    if fs.exists(p.getParent()) and len(fs.listStatus(p.getParent())) == 0:
        fs.delete(p.getParent(), False)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move into place; never over something that is there."""
    fs, p = _fs(spark, source)
    if exists(spark, target):
        raise FileExistsError(target)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"could not rename {source} to {target}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file; refuses to overwrite."""
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


# --- executors -----------------------------------------------------------------------


def _arrow_fs(path: str):
    from pyarrow import fs

    if path.startswith("s3a://"):
        path = "s3://" + path[len("s3a://"):]
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[len("file:"):]
    return fs.FileSystem.from_uri(path)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    fields = [f.split(" ") for f in ddl.split(", ")]
    columns = [pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)]
    return pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])


_LISTED = "root string, rel string, is_dir boolean, bytes bigint, mtime bigint"


def _list_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for row in batch.to_pylist():
            system, base = _arrow_fs(row["root"])
            rel = row["rel"]
            if not rel:
                itself = system.get_file_info(base)
                if itself.type == fs.FileType.File:  # a root may be a file: it has no name below itself
                    yield _batch([(row["root"], "", False, int(itself.size or 0), int(itself.mtime.timestamp()) if itself.mtime else None)], _LISTED)
                    continue
            for some in _entries(system, f"{base}/{rel}" if rel else base):
                yield _batch([(row["root"], f"{rel}/{name}" if rel else name, is_dir, size, mtime) for name, is_dir, size, mtime in some], _LISTED)


def _entries(system, folder: str) -> Iterator[list[tuple]]:
    """``name, is_dir, bytes, mtime`` of what lies in a folder, ``SLICE_NAMES`` at a time; nothing where there is no folder.
    A disk's folder is read entry by entry, so a task holds one slice; other stores give their listing at once."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        try:
            with os.scandir(folder) as found:
                while some := list(itertools.islice(found, SLICE_NAMES)):
                    yield [_entry(i) for i in some]
        except FileNotFoundError:
            return
    else:
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        for at in range(0, len(found), SLICE_NAMES):
            yield [(i.base_name, i.type == fs.FileType.Directory, int(i.size or 0), int(i.mtime.timestamp()) if i.mtime else None)
                   for i in found[at:at + SLICE_NAMES]]


def _entry(entry: os.DirEntry) -> tuple:
    try:
        seen = entry.stat()
    except FileNotFoundError:  # gone meanwhile, or a link to nothing
        return entry.name, False, 0, None
    is_dir = entry.is_dir()
    return entry.name, is_dir, 0 if is_dir else seen.st_size, int(seen.st_mtime)


def list_level(directories: DataFrame) -> DataFrame:
    """One level below every directory ``root, rel``; each directory is listed where its task runs."""
    return directories.select("root", "rel").mapInArrow(_list_level, _LISTED)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Regular files directly under ``root``: ``root, rel, bytes, mtime``."""
    start = spark.createDataFrame([(qualified(spark, root), "")], "root string, rel string")
    return list_level(start).filter("NOT is_dir").drop("is_dir")


def walk_files(spark: SparkSession, *roots: str) -> DataFrame:
    """Every regular file below the roots, which are few; see :func:`walk_from`."""
    begin = [(qualified(spark, root),) for root in roots]
    return walk_from(spark.createDataFrame(begin, "root string"))


def walk_from(roots: DataFrame) -> DataFrame:
    """``root, rel, bytes, mtime`` of every regular file below the qualified ``root`` rows, level by level: the
    directories of a level are spread over tasks, and the walk ends at the first level without any. Each level is
    written to the shared folder. A root that is a file is itself, with an empty ``rel``; one that is not there
    has no files."""
    spark = roots.sparkSession
    level = roots.select("root").distinct().withColumn("rel", F.lit(""))
    files = None
    while True:
        found = settle(list_level(level))
        here = found.filter("NOT is_dir").drop("is_dir")
        files = here if files is None else files.unionByName(here)
        level = found.filter("is_dir").select("root", "rel")
        if level.isEmpty():
            return files
        level = level.repartition(spark.sparkContext.defaultParallelism, "root", "rel")


def spread(files: DataFrame) -> DataFrame:
    """``files`` dealt to tasks in a stated number, which adaptive execution leaves alone: enough tasks for all
    cores while there are files, and no more than about ``TASK_BYTES`` each where sizes are known. Names are
    ordered by hash, so every task gets as many files as another."""
    known = settle(files)
    size = F.sum("bytes") if "bytes" in known.columns else F.lit(0)
    n, total = known.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    cores = known.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(n, max(2 * cores, -(-total // TASK_BYTES))))
    return known.repartitionByRange(tasks, F.xxhash64("root", "rel"), F.col("rel"))


_HASHED = "root string, rel string, bytes bigint, sha256 string"


def _hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            system, base = _arrow_fs(row["root"])
            digest, size = hashlib.sha256(), 0
            with system.open_input_stream(f"{base}/{row['rel']}" if row["rel"] else base) as stream:
                while piece := stream.read(CHUNK):
                    digest.update(piece)
                    size += len(piece)
            rows.append((row["root"], row["rel"], size, digest.hexdigest()))
        # a batch a file costs more than to hash a small one
        yield _batch(rows, _HASHED)


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, held = [], 0
        for row in batch.to_pylist():
            system, base = _arrow_fs(row["root"])
            with system.open_input_stream(f"{base}/{row['rel']}") as stream:
                raw = stream.read()
            rows.append((row["root"], row["rel"], raw.decode(json.detect_encoding(raw), "replace")))
            held += len(raw)
            if held >= CHUNK:
                yield _batch(rows, _READ)
                rows, held = [], 0
        if rows:
            yield _batch(rows, _READ)


_READ = "root string, rel string, text string"


def read_texts(files: DataFrame) -> DataFrame:
    """``root, rel, text`` of small JSON files ``root, rel``, many to a task; the encoding is told from the first bytes."""
    return spread(files).select("root", "rel").mapInArrow(_read_files, _READ)


def hash_files(files: DataFrame) -> DataFrame:
    """``root, rel, bytes, sha256`` of ``root, rel`` rows, hashed by the task that reads them."""
    return spread(files).select("root", "rel").mapInArrow(_hash_files, _HASHED)


_COPIED = "root string, rel string, target string"


def _copy_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            source_fs, source = _arrow_fs(row["root"])
            target_fs, goal = _arrow_fs(row["target"])
            landing = f"{goal}/{row['rel']}"
            target_fs.create_dir(landing.rsplit("/", 1)[0], recursive=True)
            with source_fs.open_input_stream(f"{source}/{row['rel']}") as src, target_fs.open_output_stream(landing) as dst:
                while piece := src.read(CHUNK):
                    dst.write(piece)
        yield batch


def copy_files(files: DataFrame, target: str) -> int:
    """Copy ``root, rel`` files below ``target``, each in its own task's hands; the number copied."""
    goal = qualified(files.sparkSession, target)
    moved = spread(files).select("root", "rel").withColumn("target", F.lit(goal))
    return moved.mapInArrow(_copy_files, _COPIED).count()


def _move_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for row in batch.to_pylist():
            system, source = _arrow_fs(row["root"])
            _, goal = _arrow_fs(row["target"])
            begin, end = f"{source}/{row['rel']}", f"{goal}/{row['rel']}"
            # a task that runs again finds its file moved already
            if system.get_file_info(begin).type != fs.FileType.NotFound or system.get_file_info(end).type == fs.FileType.NotFound:
                system.move(begin, end)
        yield batch


def move_files(files: DataFrame, target: str) -> int:
    """Move ``root, rel`` files into ``target`` on the same store, each by its own task. What lies there under the
    name is replaced in one step, never removed first; the number moved."""
    goal = qualified(files.sparkSession, target)
    moved = spread(files).select("root", "rel").withColumn("target", F.lit(goal))
    return moved.mapInArrow(_move_files, _COPIED).count()


def _delete_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for row in batch.to_pylist():
            system, base = _arrow_fs(row["root"])
            path = f"{base}/{row['rel']}"
            kind = system.get_file_info(path).type
            if kind == fs.FileType.Directory:
                system.delete_dir(path)
            elif kind == fs.FileType.File:
                system.delete_file(path)
        yield batch.append_column("target", pa.nulls(batch.num_rows, pa.string()))


def delete_files(files: DataFrame) -> int:
    """Delete ``root, rel`` files or folders in tasks; one that is gone already is no error."""
    return spread(files).select("root", "rel").mapInArrow(_delete_files, _COPIED).count()


def tree_fingerprints(hashed: DataFrame) -> DataFrame:
    """``root, sha256, bytes, files`` of whole directories from their hashed files: names, sizes and
    contents, whatever the order of listing."""
    entries = settle(hashed.select(
        "root", F.sha2(F.concat_ws("\n", "rel", F.col("bytes").cast("string"), "sha256"), 256).alias("h"), "bytes"
    ))
    sizes = entries.groupBy("root").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("files"))
    return tree_digests(entries, ["root"], LEAF_DIGITS, "sha256").join(sizes, "root").select(
        "root", F.col("digest").alias("sha256"), "bytes", "files")


def artefact_hashes(spark: SparkSession, site: str, artefacts: DataFrame) -> DataFrame:
    """``artefact, sha256`` of the artefacts (column ``artefact``, files or whole folders) that a site holds.

    The artefacts are rows from first to last: their folders are walked, their files hashed and the trees folded in
    as many jobs as the deepest folder has levels, however many artefacts there are."""
    base = qualified(spark, site)
    named = settle(artefacts.filter("artefact IS NOT NULL").select("artefact", F.concat(F.lit(f"{base}/"), "artefact").alias("root")).distinct())
    hashed = settle(hash_files(walk_from(named)))
    whole = hashed.filter("rel = ''").select("root", "sha256")
    trees = tree_fingerprints(hashed.filter("rel <> ''")).select("root", "sha256")
    return named.join(whole.unionByName(trees), "root").select("artefact", "sha256")


def tree_fingerprint(hashed: DataFrame) -> tuple[str, int, int]:
    """``(sha256, bytes, files)`` of one directory; an empty one has no hash."""
    row = tree_fingerprints(hashed).first()
    return (row["sha256"], row["bytes"], row["files"]) if row else ("", 0, 0)
