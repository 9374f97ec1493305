"""Schema objects of the session catalogue as rows ``db, class, name, definition``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CLASSES = ("tables", "views", "routines")


def read_object_catalog(spark: SparkSession, db: str) -> DataFrame:
    """Table and view definitions (columns in order) and user functions of one database. Metadata
    only: its size is the number of objects."""
    rows = []
    for table in spark.catalog.listTables(db):
        name = f"{db}.{table.name}" if not table.isTemporary else table.name
        columns = ", ".join(
            f"{c.name} {c.dataType}{'' if c.nullable else ' NOT NULL'}" for c in spark.catalog.listColumns(name)
        )
        kind = "views" if table.tableType in ("VIEW", "TEMPORARY") else "tables"
        rows.append((db, kind, table.name, f"{table.name}({columns})"))
    for fn in spark.catalog.listFunctions(db):
        if fn.catalog is not None and fn.namespace:  # user functions live in a namespace
            rows.append((db, "routines", fn.name, f"{fn.name} {fn.className}"))
    return spark.createDataFrame(rows, "db string, class string, name string, definition string")
