"""What several operators share: word rules, work folders, columns carried through Arrow tasks."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tableproof.session import ensure_checkpoint_dir

#: The white space of every contract: space and the five ASCII controls from tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Texts that are held as Python objects at a time.
SLICE_BYTES = 4 << 20
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared checkpoint folder; a retried job takes another one."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lost executors replay nothing before it."""
    path = work_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold that is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def is_held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def add_columns(df: DataFrame, text: str, fields: Sequence[tuple[str, T.DataType]],
                per_text: Callable[[Iterator[list[str | None]]], Iterator[Sequence[Sequence]]]) -> DataFrame:
    """``df`` plus ``fields`` made from the column ``text``, in Arrow batches without a shuffle.

    ``per_text`` maps an iterator of text lists to an iterator of column lists; it runs once a task, so
    models are compiled once. Columns of ``df`` that bear a new name are replaced."""
    names = [n for n, _ in fields]
    kept = [c for c in df.columns if c not in names or c == text]
    renamed = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    at = kept.index(text)
    out = T.StructType(list(renamed.schema.fields) + [T.StructField(f"n{i}", t) for i, (_, t) in enumerate(fields)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [to_arrow_type(t) for _, t in fields]
        waiting: list[pa.RecordBatch] = []

        def texts() -> Iterator[list[str | None]]:
            for batch in batches:
                # a batch of long texts is taken in slices, so memory follows one slice
                step = max(1, min(batch.num_rows, int(batch.num_rows * SLICE_BYTES / max(1, batch.nbytes))))
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    waiting.append(part)
                    yield part.column(at).to_pylist()

        for columns in per_text(texts()):
            part = waiting.pop(0)
            arrays = list(part.columns) + [
                pa.array(c, type=kinds[i]) for i, c in enumerate(columns)
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=out.fieldNames())

    made = renamed.mapInArrow(work, out)
    old = [F.col(f"c{i}").alias(c) for i, c in enumerate(kept) if not (c in names)]
    return made.select(*old, *[F.col(f"n{i}").alias(n) for i, n in enumerate(names)])


def add_arrays(df: DataFrame, column: str, fields: Sequence[tuple[str, T.DataType]],
               per_array: Callable[[], Callable[[pa.Array], Sequence[pa.Array]]], slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """As :func:`add_columns`, for work on whole Arrow arrays: ``per_array`` is called once a task and gives the function
    that maps slices of ``column`` to the new arrays."""
    names = [n for n, _ in fields]
    kept = [c for c in df.columns if c not in names or c == column]
    renamed = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    at = kept.index(column)
    out = T.StructType(list(renamed.schema.fields) + [T.StructField(f"n{i}", t) for i, (_, t) in enumerate(fields)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = per_array()
        for batch in batches:
            step = max(1, min(batch.num_rows, int(batch.num_rows * slice_bytes / max(1, batch.nbytes))))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                yield pa.RecordBatch.from_arrays([*part.columns, *made(part.column(at))], out.fieldNames())

    done = renamed.mapInArrow(work, out)
    old = [F.col(f"c{i}").alias(c) for i, c in enumerate(kept) if c not in names]
    return done.select(*old, *[F.col(f"n{i}").alias(n) for i, n in enumerate(names)])


def store(uri: str):
    """The Arrow file system and path behind a qualified folder name, as tasks see it."""
    from pyarrow import fs

    if uri.startswith("s3a://"):
        uri = "s3://" + uri[len("s3a://"):]
    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + uri[len("file:/"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)
