"""Reading and writing manifests."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableproof import schema as S
from tableproof.functions import digests as D
from tableproof.sources import files

SCHEMA_VERSION = 3


class Refused(RuntimeError):
    """A step that must not go on; nothing was written."""


def file_name() -> Column:
    """The name of the file a row comes from. The metadata column escapes it as in a URL, where a plus stands for itself."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*.json`` under ``path`` in the fixed schema, plus its ``name``. Absent keys are null.

    The files of a folder are read by tasks that take many each; a parser made anew and a thirtieth of a task per
    file would cost more than the files. Its listing is taken once, when this is called."""
    if files.is_folder(spark, path):
        return parsed_manifests(files.list_files(spark, path).filter(IS_MANIFEST))
    return (
        spark.read.schema(S.MANIFEST_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
        .select("*", file_name().alias("name"))
    )


#: As Spark's own file source: names that begin with a dot or an underscore are hidden.
IS_MANIFEST = "rel LIKE '%.json' AND NOT startswith(rel, '.') AND NOT startswith(rel, '_')"


def parsed_manifests(listed: DataFrame) -> DataFrame:
    """The manifests in files ``root, rel``, in the fixed schema, plus ``name``, as the JSON source reads them: an array is a row
    an element, a broken file is a row of nulls, an empty one none."""
    texts = files.read_texts(listed).filter(F.rlike("text", F.lit(r"\S")))
    # a root that is an array is read as one; the other stays whole where a single key has the wrong type
    rows = F.when(F.rlike("text", F.lit(r"^\s*\[")), F.from_json("text", T.ArrayType(S.MANIFEST_SCHEMA))).otherwise(F.array(F.from_json("text", S.MANIFEST_SCHEMA)))
    empty = F.rlike("text", F.lit(r"^\s*\[\s*\]"))
    parsed = texts.filter(~empty).select(F.element_at(F.split("rel", "/"), -1).alias("name"), F.explode_outer(rows).alias("_m"))
    return parsed.select("_m.*", "name")


def with_defaults(manifests: DataFrame) -> DataFrame:
    """What absent keys mean."""
    return manifests.withColumns({k: F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit(v)) for k, v in S.DEFAULTS.items()})


def manifest_entries(manifests: DataFrame, section: str, *keep: str) -> DataFrame:
    """``keep, entry, value`` of one section, with the value's parts by the section's format.

    tables ``digest:n`` (or ``EMPTY:0``), objects ``n:digest``, wal ``sha256``, binlogs ``sha256:bytes``, witness ``octets``
    (as ``n``)."""
    if section not in S.SECTIONS:
        raise ValueError(f"unknown section {section!r}; one of {S.SECTIONS}")
    rows = manifests.select(*keep, F.explode(section).alias("entry", "value"))
    head = F.regexp_extract("value", r"^(.*):([^:]*)$", 1)
    tail = F.regexp_extract("value", r"^(.*):([^:]*)$", 2)
    if section == "objects":
        return rows.select("*", F.split_part("value", F.lit(":"), F.lit(2)).alias("digest"), F.split_part("value", F.lit(":"), F.lit(1)).try_cast("bigint").alias("n"))
    if section == "witness":
        return rows.select("*", F.lit(None).cast("string").alias("digest"), F.col("value").try_cast("bigint").alias("n"))
    if section == "wal":
        return rows.select("*", F.col("value").alias("digest"), F.lit(None).cast("bigint").alias("n"))
    return rows.select("*", head.alias("digest"), tail.try_cast("bigint").alias("n"))


def recorded_tables(manifests: DataFrame, db: str) -> DataFrame:
    """``db, table, fingerprint, octets`` that manifests record; octets are null where no witness was recorded."""
    prints = manifest_entries(manifests, "tables", "name").select("name", F.col("entry").alias("table"), F.col("value").alias("fingerprint"))
    seen = manifest_entries(manifests, "witness", "name").select("name", F.col("entry").alias("table"), F.col("n").alias("octets"))
    return prints.join(seen, ["name", "table"], "left").select(F.lit(db).alias("db"), "table", "fingerprint", "octets")


def manifest_row(fingerprints: DataFrame, objects: DataFrame | None, meta: Mapping[str, object]) -> DataFrame:
    """One manifest row. The maps hold one entry per table or class, so their size is that of the
    catalogue, never of the data."""
    spark = fingerprints.sparkSession
    fields = {f.name: f.dataType for f in S.MANIFEST_SCHEMA.fields}
    unknown = set(meta) - set(fields)
    if unknown:
        raise ValueError(f"unknown manifest fields {sorted(unknown)}")

    def as_map(df: DataFrame, key: str, value: str):
        return df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("m")).scalar()

    empty = F.lit(None)
    maps = {
        "tables": as_map(fingerprints, "table", "fingerprint"),
        "objects": as_map(objects, "class", "digest") if objects is not None else empty,
    }
    if "octets" in fingerprints.columns:
        seen = fingerprints.filter("octets IS NOT NULL").select("table", F.col("octets").cast("string").alias("octets"))
        maps["witness"] = as_map(seen, "table", "octets")
    given = {"schema": SCHEMA_VERSION, **meta}
    columns = [
        (maps[n] if n in maps else F.lit(given.get(n)) if not isinstance(given.get(n), dict) else _map_literal(given[n]))
        .cast(t).alias(n)
        for n, t in fields.items()
    ]
    return spark.range(1).select(*columns)


def _map_literal(entries: Mapping[str, str]):
    return F.from_json(F.lit(json.dumps(dict(entries))), "map<string,string>")


def refuse_unusable(fingerprints: DataFrame) -> int:
    """The number of tables; raises when there is none or a fingerprint proves nothing."""
    row = fingerprints.agg(
        F.count("*").alias("n"),
        F.count_if(~D.usable_fingerprint(F.col("fingerprint"))).alias("bad"),
        F.min(F.when(~D.usable_fingerprint(F.col("fingerprint")), F.col("table"))).alias("first_bad"),
    ).first()
    if row["n"] == 0:
        raise Refused("no tables: a manifest that lists nothing proves nothing")
    if row["bad"]:
        raise Refused(f"unusable fingerprint of {row['first_bad']} ({row['bad']} in all)")
    return row["n"]


def write_manifest(fingerprints: DataFrame, objects: DataFrame | None, meta: Mapping[str, object], path: str) -> None:
    """Write one manifest to ``path``, which must not exist. Refuses unusable fingerprints and zero
    tables before anything appears."""
    refuse_unusable(fingerprints)
    row = manifest_row(fingerprints, objects, meta)
    text = row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true", "pretty": "true"}).alias("j")).first()["j"]
    files.write_text(fingerprints.sparkSession, path, text)
