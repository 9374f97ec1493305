"""The manifest: a fixed schema, every field nullable, absence is an answer."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT_FIELDS_HEAD = ["kind", "database", "created_at", "artefact"]
MANIFEST_SCHEMA = T.StructType(
    [T.StructField("schema", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in TEXT_FIELDS_HEAD]
    + [T.StructField("bytes", T.LongType())]
    + [
        T.StructField(n, T.StringType())
        for n in ["sha256", "engine", "fingerprint", "server_version", "encryption", "recipient"]
    ]
    + [
        T.StructField("wal_segment_bytes", T.LongType()),
        T.StructField("wal_start_file", T.StringType()),
        T.StructField("mark_name", T.StringType()),
        T.StructField("lsn", T.StringType()),
        T.StructField("wal_file", T.StringType()),
        T.StructField("quiesced", T.StringType()),
        T.StructField("wal_files_encrypted", T.StringType()),
        T.StructField("wal_ciphertext_bytes", T.LongType()),
        T.StructField("gtid_mode", T.StringType()),
        T.StructField("gtid_executed", T.StringType()),
        T.StructField("anchor_file", T.StringType()),
        T.StructField("anchor_pos", T.LongType()),
        T.StructField("mark_file", T.StringType()),
        T.StructField("mark_pos", T.LongType()),
        T.StructField("binlogs_encrypted", T.StringType()),
    ]
    + [
        T.StructField(section, T.MapType(T.StringType(), T.StringType()))
        for section in ["tables", "objects", "wal", "binlogs", "witness"]
    ]
)

SECTIONS = ("tables", "objects", "wal", "binlogs", "witness")

# What an absent key means.
DEFAULTS = {
    "engine": "postgres",
    "fingerprint": "md5",
    "gtid_mode": "no",
    "wal_files_encrypted": "no",
    "binlogs_encrypted": "no",
}

# The manifest kinds of the two recovery flavours.
BASE_KIND = {"wal": "pitr-base", "binlog": "binlog-base"}
MARK_KIND = {"wal": "pitr-mark", "binlog": "binlog-mark"}
DUMP_KIND = "dump"
