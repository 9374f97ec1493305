"""Names, stamps, ages and log positions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and sizes that must equal the formats being audited.
STAMP_RE = r"^[0-9]{8}T[0-9]{6}Z$"
NAMED_RE = r"^(.+)_([0-9]{8}T[0-9]{6}Z)"
ANY_STAMP_RE = r"_([0-9]{8}T[0-9]{6}Z)"
WAL_SEGMENT_RE = r"^[0-9A-F]{24}$"
WAL_BACKUP_RE = r"^[0-9A-F]{24}\.[0-9A-F]{8}\.backup$"
WAL_HISTORY_RE = r"^[0-9A-F]{8}\.history$"
BINLOG_RE = r"^[A-Za-z0-9_-]+\.[0-9]{6,}$"
ENC_SUFFIX = ".age"
WAL_SPAN = 4294967296
DEFAULT_SEGMENT_BYTES = 16777216
ARTEFACT_FLOOR = {"default": 512, "files": 128, "sqlite": 48}
DAY = 86400


def col_of(value: Column | str | int) -> Column:
    """A Column stays, anything else becomes a literal."""
    return value if isinstance(value, Column) else F.lit(value)


def int_div(a: Column, b: Column | int) -> Column:
    """Whole division for non-negative numbers, exact up to 2^53."""
    return ((a - a % b) / b).cast("bigint")


def _group(name: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(name, pattern, group), F.lit(""))


# --- names and stamps ---------------------------------------------------------


def name_stamp(name: Column, db: Column | str) -> Column:
    """The 16 characters after ``db_`` when they are a stamp, else null: the "belongs to db" test."""
    db = col_of(db)
    rest = F.substring(name, F.length(db) + 2, F.lit(16))
    return F.when(F.startswith(name, F.concat(db, F.lit("_"))) & rest.rlike(STAMP_RE), rest)


def artefact_db(name: Column) -> Column:
    """Database part of a stamped name (greedy), null without a stamp."""
    return _group(name, NAMED_RE, 1)


def artefact_stamp(name: Column) -> Column:
    return _group(name, NAMED_RE, 2)


def order_key(name: Column, created_at: Column) -> Column:
    """What "newest" sorts by: the name's stamp, else ``created_at``."""
    return F.coalesce(_group(name, ANY_STAMP_RE, 1), created_at)


def stamp_epoch(stamp: Column) -> Column:
    iso = F.regexp_replace(
        stamp, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})Z$", "$1-$2-$3T$4:$5:$6Z"
    )
    return F.unix_seconds(F.try_to_timestamp(iso))


def taken_at(created_at: Column, name: Column) -> Column:
    """Epoch seconds of the backup: ``created_at`` first, else the stamp, else null."""
    created = F.nullif(created_at, F.lit(""))
    return F.when(created.isNotNull(), F.unix_seconds(F.try_to_timestamp(created))).otherwise(
        stamp_epoch(_group(name, ANY_STAMP_RE, 1))
    )


def stamp_text(epoch: int) -> str:
    """The stamp of an instant known to the driver (cutoffs)."""
    from datetime import datetime, timezone

    return datetime.fromtimestamp(epoch, tz=timezone.utc).strftime("%Y%m%dT%H%M%SZ")


def age_days(epoch: Column, now: int) -> Column:
    """Whole days, cut toward zero."""
    return ((F.lit(now) - epoch) / DAY).cast("bigint")


def past_window(epoch: Column, now: int, days: int) -> Column:
    """Strictly older than the window; exactly ``days`` old is inside."""
    return (F.lit(now) - epoch) > days * DAY


def manifest_for(artefact: Column) -> Column:
    """Manifest name of an artefact: one suffix of each kind goes, in this order."""
    bare = artefact
    for suffix in [r"\.age$", r"\.dump$", r"\.sql$", r"\.tar\.gz$"]:
        bare = F.regexp_replace(bare, suffix, "")
    return F.concat(bare, F.lit(".json"))


def bare_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.age$", "")


def is_encrypted(name: Column) -> Column:
    return F.endswith(name, F.lit(ENC_SUFFIX))


def classify_file(name: Column, flavour: str, encrypted: bool | Column = False) -> Column:
    """Kind of a file in a log archive (``wal``, ``binlog``) or at a ``site``."""
    if flavour == "site":
        return (
            F.when(F.endswith(name, F.lit(".part")), "part")
            .when(F.endswith(name, F.lit(".json")), "manifest")
            .otherwise("artefact")
        )
    enc = col_of(encrypted)
    in_form = ~enc | is_encrypted(name)
    bare = F.when(enc, bare_name(name)).otherwise(name)
    if flavour == "wal":
        return (
            F.when(~in_form, "stray")
            .when(bare.rlike(WAL_SEGMENT_RE), "segment")
            .when(bare.rlike(WAL_BACKUP_RE), "backup_history")
            .when(bare.rlike(WAL_HISTORY_RE), "timeline_history")
            .otherwise("stray")
        )
    if flavour == "binlog":
        return F.when(in_form & bare.rlike(BINLOG_RE), "log").otherwise("stray")
    raise ValueError(f"unknown flavour {flavour!r}")


# --- log positions -------------------------------------------------------------


def wal_timeline(name: Column) -> Column:
    return F.substring(name, 1, 8)


def wal_index(name: Column, segment_bytes: Column | int = DEFAULT_SEGMENT_BYTES) -> Column:
    """Absolute segment number, timeline ignored."""
    per_log = int_div(F.lit(WAL_SPAN), col_of(segment_bytes))
    log = F.conv(F.substring(name, 9, 8), 16, 10).cast("bigint")
    return log * per_log + F.conv(F.substring(name, 17, 8), 16, 10).cast("bigint")


def wal_name(
    timeline: Column | str, idx: Column, segment_bytes: Column | int = DEFAULT_SEGMENT_BYTES
) -> Column:
    """Inverse of :func:`wal_index`, with the carry at 4 GiB."""
    per_log = int_div(F.lit(WAL_SPAN), col_of(segment_bytes))
    return F.concat(
        col_of(timeline),
        F.lpad(F.hex(int_div(idx, per_log)), 8, "0"),
        F.lpad(F.hex(idx % per_log), 8, "0"),
    )


def series_of(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*)\.[0-9]+$", 1)


def index_of(name: Column) -> Column:
    """The counter, base ten whatever its leading zeros."""
    return _group(name, r"\.([0-9]+)$", 1).try_cast("bigint")


def series_name(prefix: Column | str, idx: Column) -> Column:
    """At least six digits, never truncated."""
    digits = idx.cast("string")
    return F.concat(
        col_of(prefix), F.lit("."), F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), F.lit("0"))
    )


def file_series(name: Column, flavour: str) -> Column:
    return wal_timeline(name) if flavour == "wal" else series_of(bare_name(name))


def file_index(name: Column, flavour: str, segment_bytes: Column | int = DEFAULT_SEGMENT_BYTES) -> Column:
    if flavour == "wal":
        return F.when(F.substring(name, 1, 24).rlike(WAL_SEGMENT_RE), wal_index(name, segment_bytes))
    return index_of(bare_name(name))


def file_name(series: Column, idx: Column, flavour: str,
              segment_bytes: Column | int = DEFAULT_SEGMENT_BYTES) -> Column:
    return wal_name(series, idx, segment_bytes) if flavour == "wal" else series_name(series, idx)


def infer_segment_bytes(max_bytes: Column, encrypted: bool | Column) -> Column:
    """Plain archive: the largest file; ciphertext: the largest power of two not above it."""
    power = F.pow(F.lit(2.0), F.length(F.bin(max_bytes)) - 1).cast("bigint")
    return F.when(col_of(encrypted), power).otherwise(max_bytes)


# --- texts and small rules -------------------------------------------------------


def flatten_definition(definition: Column) -> Column:
    """One object, one line."""
    return F.translate(definition, "\r\n", "  ")


def range_label(first: Column, last: Column) -> Column:
    return F.when(first == last, first).otherwise(F.concat_ws(" .. ", first, last))


def retention_rule(keep: Column | int, days: Column | int) -> Column:
    """The rule as its fields: ``keep=3``, ``days=7``, or both; a rule of days alone spares one."""
    keep, days = col_of(keep), col_of(days)
    by_count, by_age = F.concat(F.lit("keep="), keep.cast("string")), F.concat(F.lit("days="), days.cast("string"))
    return (
        F.when((keep > 0) & (days > 0), F.concat_ws(" ", by_count, by_age))
        .when(days > 0, F.concat_ws(" ", F.lit("keep=1"), by_age))
        .otherwise(by_count)
    )


def min_artefact_ok(size: Column, engine: str = "default", floor: int | None = None) -> Column:
    limit = floor if floor is not None else ARTEFACT_FLOOR.get(engine, ARTEFACT_FLOOR["default"])
    return size >= limit


def parse_txn_set(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``uuid:a-b:c,uuid2:...`` to rows ``(uuid, lo, hi)``; a single number is its own interval."""
    flat = F.regexp_replace(F.col(text), r"\s", "")
    member = df.select(*keep, F.explode(F.split(flat, ",")).alias("_member")).filter(
        F.col("_member") != ""
    )
    parts = member.select(*keep, F.split("_member", ":").alias("_parts"))
    spans = parts.select(
        *keep,
        F.col("_parts")[0].alias("uuid"),
        F.explode(F.slice("_parts", F.lit(2), F.size("_parts") - 1)).alias("_span"),
    )
    lo = F.split("_span", "-")[0].cast("bigint")
    hi = F.coalesce(F.get(F.split("_span", "-"), 1).cast("bigint"), lo)
    return spans.select(*keep, "uuid", lo.alias("lo"), hi.alias("hi"))
