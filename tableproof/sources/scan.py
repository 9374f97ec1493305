"""Parquet files that a table of names points at, read by the tasks that hold the names.

``spark.read.parquet`` wants its paths on the driver. A log chain or the inventories of a site are millions of
files whose names are themselves the answer of a query, so here the names stay rows: a task opens the files of
its rows, skips row groups whose statistics lie outside the wanted positions, and hands on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tableproof.sources.files import _arrow_fs, spread

BATCH_ROWS = 1 << 15

Position = tuple[int, int]


def schema_of(spark: SparkSession, paths: Sequence[str]) -> T.StructType:
    """The columns of a few files, by name, those of the first file first."""
    fields: dict[str, T.StructField] = {}
    for path in paths:
        for f in spark.read.parquet(path).schema.fields:
            fields.setdefault(f.name, f)
    return T.StructType(list(fields.values()))


def _outside(group, at: dict[str, int], low: Position | None, high: Position | None) -> bool:
    """Whether the statistics of a row group prove that no row lies in ``[low, high)`` of ``(idx, pos)``."""
    def ends(name: str):
        stats = group.column(at[name]).statistics if name in at else None
        return (stats.min, stats.max) if stats is not None and stats.has_min_max else (None, None)

    first, last = ends("idx")
    if first is None:
        return False
    least, most = ends("pos") if first == last else (None, None)
    if low is not None and (last < low[0] or (last == low[0] and most is not None and most < low[1])):
        return True
    return high is not None and (first > high[0] or (first == high[0] and least is not None and least >= high[1]))


def scan_parquet(files: DataFrame, schema: T.StructType, low: Position | None = None, high: Position | None = None,
                 keep: Sequence[str] = ()) -> DataFrame:
    """Rows of the Parquet files ``root, rel`` in the columns of ``schema``, with the ``keep`` columns of their file.

    A column that a file lacks is null in its rows. ``low`` and ``high`` bound ``(idx, pos)``: row groups outside
    are not read; rows of the groups that are read are not filtered, that is the caller's condition. An absent file
    fails the task that meets it. Names are dealt by the bytes behind them where ``files`` has ``bytes``."""
    kept = [files.schema[c] for c in keep]
    out = T.StructType([*schema.fields, *kept])
    wanted, target = schema.names, out

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        kinds = to_arrow_schema(target)
        for batch in batches:
            for row in batch.to_pylist():
                system, base = _arrow_fs(row["root"])
                with system.open_input_file(f"{base}/{row['rel']}" if row["rel"] else base) as source:
                    file = pq.ParquetFile(source)
                    at = {file.schema.column(i).path: i for i in range(len(file.schema))}
                    groups = [g for g in range(file.num_row_groups) if not _outside(file.metadata.row_group(g), at, low, high)]
                    held = [c for c in wanted if c in file.schema_arrow.names]
                    if not groups:
                        continue
                    for part in file.iter_batches(BATCH_ROWS, groups, held, use_threads=False):
                        columns = []
                        for field in kinds:
                            if field.name in held:
                                column = part.column(field.name)
                                # nanoseconds of older writers lose nothing Spark could show
                                columns.append(column.cast(field.type, safe=not pa.types.is_timestamp(field.type)))
                            elif field.name in wanted:
                                columns.append(pa.nulls(part.num_rows, field.type))
                            else:
                                columns.append(pa.array([row[field.name]] * part.num_rows, field.type))
                        yield pa.RecordBatch.from_arrays(columns, [f.name for f in kinds])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Small files share a batch: one each costs more than its rows."""
        held, rows = [], 0
        for part in parts(batches):
            held.append(part)
            rows += part.num_rows
            if rows >= BATCH_ROWS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return spread(files).select("root", "rel", *[F.col(c) for c in keep]).mapInArrow(read, out)
