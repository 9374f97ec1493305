"""Queries over names, stamps, ages and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableproof import fixtures as X
from tableproof.functions import digests as D
from tableproof.functions import names as N
from tableproof.registry import register

FX2 = f"WITH a AS ({X.ARTEFACTS})"
FX3 = f"WITH w AS ({X.WAL_LISTING})"
FX4 = f"WITH b AS ({X.BINLOG_INVENTORY})"

STAMP_AFTER = (
    "CASE WHEN starts_with(name, {db} || '_') AND regexp_matches(substr(name, length({db}) + 2, 16), "
    "'^[0-9]{{8}}T[0-9]{{6}}Z$') THEN substr(name, length({db}) + 2, 16) END"
)


def stamp_sql(db: str) -> str:
    """SQL of ``name_stamp``."""
    return STAMP_AFTER.format(db=db)


def artefacts(spark, sf_dir):
    return X.view(spark, sf_dir, X.ARTEFACTS)


CREATED = "CASE WHEN id % 3 = 0 THEN concat('2026-08-', lpad(CAST(1 + id % 28 AS STRING), 2, '0'), 'T00:00:0', CAST(id % 10 AS STRING), 'Z') END"
FX2_CREATED = f"WITH a AS (SELECT *, {CREATED} AS created_at FROM ({X.ARTEFACTS}) z)"
NAME_STAMP_ANY = "nullif(regexp_extract(name, '_([0-9]{8}T[0-9]{6}Z)', 1), '')"
TAKEN_SQL = (
    "CAST(epoch(CASE WHEN created_at IS NOT NULL THEN strptime(created_at, '%Y-%m-%dT%H:%M:%SZ') "
    f"ELSE strptime({NAME_STAMP_ANY}, '%Y%m%dT%H%M%SZ') END) AS BIGINT)"
)


def created(spark, sf_dir):
    return artefacts(spark, sf_dir).withColumn("created_at", F.expr(CREATED))


@register("b2_name_stamp", f"{FX2} SELECT id, {stamp_sql('db')} AS own, {stamp_sql(chr(39) + 'app' + chr(39))} AS as_app FROM a")
def b2(spark, sf_dir):
    return artefacts(spark, sf_dir).select(
        "id", N.name_stamp(F.col("name"), F.col("db")).alias("own"), N.name_stamp(F.col("name"), "app").alias("as_app")
    )


@register(
    "b3_split_artefact_name",
    FX2 + " SELECT id, nullif(regexp_extract(name, '^(.+)_([0-9]{8}T[0-9]{6}Z)', 1), '') AS db,"
    " nullif(regexp_extract(name, '^(.+)_([0-9]{8}T[0-9]{6}Z)', 2), '') AS stamp FROM a",
)
def b3(spark, sf_dir):
    return artefacts(spark, sf_dir).select(
        "id", N.artefact_db(F.col("name")).alias("db"), N.artefact_stamp(F.col("name")).alias("stamp")
    )


@register("b4_order_key", FX2_CREATED + f" SELECT id, coalesce({NAME_STAMP_ANY}, created_at) AS order_key FROM a")
def b4(spark, sf_dir):
    return created(spark, sf_dir).select("id", N.order_key(F.col("name"), F.col("created_at")).alias("order_key"))


@register("b5_taken_at", FX2_CREATED + f" SELECT id, {TAKEN_SQL} AS taken FROM a")
def b5(spark, sf_dir):
    return created(spark, sf_dir).select("id", N.taken_at(F.col("created_at"), F.col("name")).alias("taken"))


@register("b6_age_days", FX2_CREATED + f" SELECT id, CAST(trunc(({X.NOW} - {TAKEN_SQL}) / 86400) AS BIGINT) AS days FROM a")
def b6(spark, sf_dir):
    taken = N.taken_at(F.col("created_at"), F.col("name"))
    return created(spark, sf_dir).select("id", N.age_days(taken, X.NOW).alias("days"))


@register("b7_past_window", FX2_CREATED + f" SELECT id, {X.NOW} - {TAKEN_SQL} > 30 * 86400 AS past FROM a")
def b7(spark, sf_dir):
    taken = N.taken_at(F.col("created_at"), F.col("name"))
    return created(spark, sf_dir).select("id", N.past_window(taken, X.NOW, 30).alias("past"))


MANIFEST_FOR_SQL = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '\\.age$', ''), '\\.dump$', ''), "
    "'\\.sql$', ''), '\\.tar\\.gz$', '') || '.json'"
)


@register("b8_manifest_for", f"{FX2} SELECT id, {MANIFEST_FOR_SQL} AS manifest FROM a")
def b8(spark, sf_dir):
    return artefacts(spark, sf_dir).select("id", N.manifest_for(F.col("name")).alias("manifest"))


def wal_index_sql(name: str, per_log: int = 256) -> str:
    return f"(CAST('0x' || substr({name}, 9, 8) AS BIGINT) * {per_log} + CAST('0x' || substr({name}, 17, 8) AS BIGINT))"


def wal_name_sql(timeline: str, idx: str, per_log: int = 256) -> str:
    return f"({timeline} || printf('%08X%08X', ({idx}) // {per_log}, ({idx}) % {per_log}))"


@register(
    "b9_wal_index",
    f"{FX3} SELECT name, substr(name, 1, 8) AS timeline, {wal_index_sql('name')} AS idx16, {wal_index_sql('name', 64)} AS idx64 FROM w",
)
def b9(spark, sf_dir):
    name = F.col("name")
    return X.view(spark, sf_dir, X.WAL_LISTING).select(
        "name",
        N.wal_timeline(name).alias("timeline"),
        N.wal_index(name).alias("idx16"),
        N.wal_index(name, 67108864).alias("idx64"),
    )


@register(
    "b10_wal_name",
    f"{FX3}, i AS (SELECT name, substr(name, 1, 8) AS tl, {wal_index_sql('name')} AS idx FROM w) "
    f"SELECT name, {wal_name_sql('tl', 'idx')} AS again, {wal_name_sql('tl', 'idx + 1')} AS following, "
    f"{wal_name_sql('tl', 'idx', 64)} AS at64 FROM i",
)
def b10(spark, sf_dir):
    name = F.col("name")
    tl, idx = N.wal_timeline(name), N.wal_index(name)
    return X.view(spark, sf_dir, X.WAL_LISTING).select(
        "name",
        N.wal_name(tl, idx).alias("again"),
        N.wal_name(tl, idx + 1).alias("following"),
        N.wal_name(tl, idx, 67108864).alias("at64"),
    )


SERIES_NAME_SQL = "({p} || '.' || CASE WHEN length(CAST({i} AS VARCHAR)) >= 6 THEN CAST({i} AS VARCHAR) ELSE lpad(CAST({i} AS VARCHAR), 6, '0') END)"


def series_name_sql(prefix: str, idx: str) -> str:
    return SERIES_NAME_SQL.format(p=prefix, i=idx)


@register(
    "b11_series_names",
    f"{FX4} SELECT name, regexp_extract(name, '^(.*)\\.[0-9]+$', 1) AS series, "
    "CAST(regexp_extract(name, '\\.([0-9]+)$', 1) AS BIGINT) AS idx, "
    f"{series_name_sql(chr(39) + 'mysql-bin' + chr(39), '(idx * 7919)')} AS other FROM b",
)
def b11(spark, sf_dir):
    name = F.col("name")
    return X.view(spark, sf_dir, X.BINLOG_INVENTORY).select(
        "name",
        N.series_of(name).alias("series"),
        N.index_of(name).alias("idx"),
        N.series_name("mysql-bin", F.col("idx") * 7919).alias("other"),
    )


MESSY_SQL = (
    "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN printf('%08X%08X%08X', 1, 0, o_orderkey % 256) "
    "WHEN 1 THEN printf('%08X%08X%08X.%08X.backup', 1, 0, o_orderkey % 256, 40) WHEN 2 THEN printf('%08X.history', 2) "
    "WHEN 3 THEN concat('binlog.', lpad(CAST(o_orderkey AS STRING), 6, '0')) "
    "WHEN 4 THEN printf('%08X%08X%08X.age', 1, 0, o_orderkey % 256) ELSE concat('squat-', o_orderpriority) END AS name FROM {orders}"
)


@register(
    "b12_classify_file",
    f"WITH m AS ({MESSY_SQL}), s AS ({X.ARTEFACTS}) "
    "SELECT m.id, CASE WHEN regexp_matches(m.name, '^[0-9A-F]{24}$') THEN 'segment' "
    "WHEN regexp_matches(m.name, '^[0-9A-F]{24}[.][0-9A-F]{8}[.]backup$') THEN 'backup_history' "
    "WHEN regexp_matches(m.name, '^[0-9A-F]{8}[.]history$') THEN 'timeline_history' ELSE 'stray' END AS wal, "
    "CASE WHEN m.name LIKE '%.age' AND regexp_matches(m.name, '^[0-9A-F]{24}[.]age$') THEN 'segment' ELSE 'stray' END AS wal_encrypted, "
    "CASE WHEN regexp_matches(m.name, '^[A-Za-z0-9_-]+[.][0-9]{6,}$') THEN 'log' ELSE 'stray' END AS binlog, "
    "CASE WHEN s.name LIKE '%.part' THEN 'part' WHEN s.name LIKE '%.json' THEN 'manifest' ELSE 'artefact' END AS site "
    "FROM m JOIN s ON m.id = s.id",
)
def b12(spark, sf_dir):
    messy = X.view(spark, sf_dir, MESSY_SQL)
    site = artefacts(spark, sf_dir).select("id", F.col("name").alias("site_name"))
    name = F.col("name")
    return messy.join(site, "id").select(
        "id",
        N.classify_file(name, "wal").alias("wal"),
        N.classify_file(name, "wal", True).alias("wal_encrypted"),
        N.classify_file(name, "binlog").alias("binlog"),
        N.classify_file(F.col("site_name"), "site").alias("site"),
    )


FINGERPRINTS = (
    "SELECT id, CASE WHEN id % 17 = 0 THEN '' WHEN id % 19 = 0 THEN 'EMPTY:0' WHEN id % 23 = 0 THEN upper(concat(sha, ':1')) "
    f"WHEN id % 29 = 0 THEN sha ELSE concat(sha, ':', CAST(bytes AS STRING)) END AS fp FROM ({X.ARTEFACTS}) z"
)


@register(
    "b13_usable_fingerprint",
    f"WITH f AS ({FINGERPRINTS}) "
    "SELECT id, regexp_matches(fp, '^(EMPTY:0|[0-9a-f]{8}.*:[0-9].*)$') AS usable, "
    "regexp_extract(fp, '^(.*):([0-9]+)$', 1) AS digest, TRY_CAST(nullif(regexp_extract(fp, '^(.*):([0-9]+)$', 2), '') AS BIGINT) AS n FROM f",
)
def b13(spark, sf_dir):
    fp = F.col("fp")
    return X.view(spark, sf_dir, FINGERPRINTS).select(
        "id",
        D.usable_fingerprint(fp).alias("usable"),
        D.fingerprint_digest(fp).alias("digest"),
        D.fingerprint_count(fp).alias("n"),
    )


DEFINITIONS = "SELECT p_partkey AS id, concat(p_type, chr(13), chr(10), p_brand, chr(10), p_name) AS definition FROM {part}"


@register("b14_flatten_definition", f"WITH d AS ({DEFINITIONS}) SELECT id, translate(definition, chr(13) || chr(10), '  ') AS flat FROM d")
def b14(spark, sf_dir):
    return X.view(spark, sf_dir, DEFINITIONS).select("id", N.flatten_definition(F.col("definition")).alias("flat"))


TXN_TEXTS = (
    "SELECT event_id, concat(event_type, ':', CAST(event_id AS STRING), '-', CAST(event_id + 3 AS STRING), ':', "
    "CAST(event_id + 10 AS STRING), ',', chr(10), 'peer:', CAST(user_id AS STRING)) AS txns FROM {events}"
)


@register(
    "b15_parse_txn_set",
    "SELECT event_id, event_type AS uuid, event_id AS lo, event_id + 3 AS hi FROM {events} "
    "UNION ALL SELECT event_id, event_type, event_id + 10, event_id + 10 FROM {events} "
    "UNION ALL SELECT event_id, 'peer', user_id, user_id FROM {events}",
)
def b15(spark, sf_dir):
    return N.parse_txn_set(X.view(spark, sf_dir, TXN_TEXTS), "txns", "event_id")


@register(
    "b16_retention_rule",
    "SELECT o_orderkey AS id, CASE WHEN k > 0 AND d > 0 THEN 'keep=' || k || ' days=' || d "
    "WHEN d > 0 THEN 'keep=1 days=' || d ELSE 'keep=' || k END AS rule "
    "FROM (SELECT o_orderkey, o_orderkey % 3 AS k, o_custkey % 4 AS d FROM {orders}) z",
)
def b16(spark, sf_dir):
    o = X.load(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), N.retention_rule(F.col("o_orderkey") % 3, F.col("o_custkey") % 4).alias("rule"))


@register(
    "b17_range_label",
    f"{FX4} SELECT name, CASE WHEN idx % 2 = 0 THEN name ELSE name || ' .. ' || {series_name_sql('series', '(idx + 3)')} END AS label FROM b",
)
def b17(spark, sf_dir):
    last = F.when(F.col("idx") % 2 == 0, F.col("name")).otherwise(N.series_name(F.col("series"), F.col("idx") + 3))
    return X.view(spark, sf_dir, X.BINLOG_INVENTORY).select("name", N.range_label(F.col("name"), last).alias("label"))


@register(
    "b18_infer_segment_bytes",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN CAST(pow(2, length(bin(n_chars)) - 1) AS BIGINT) ELSE n_chars END AS seg, "
    "CAST(pow(2, length(bin(CAST(pow(2, doc_id % 40) AS BIGINT))) - 1) AS BIGINT) AS exact_power FROM {documents}",
)
def b18(spark, sf_dir):
    docs = X.load(spark, sf_dir, "documents")
    power = F.pow(F.lit(2.0), F.col("doc_id") % 40).cast("bigint")
    return docs.select(
        "doc_id",
        N.infer_segment_bytes(F.col("n_chars"), F.col("doc_id") % 2 == 1).alias("seg"),
        N.infer_segment_bytes(power, True).alias("exact_power"),
    )


@register(
    "b19_min_artefact_ok",
    f"{FX2} SELECT id, bytes - 700 >= 512 AS ok_default, bytes - 1000 >= 128 AS ok_files, bytes - 1000 >= 48 AS ok_sqlite FROM a",
)
def b19(spark, sf_dir):
    size = F.col("bytes")
    return artefacts(spark, sf_dir).select(
        "id",
        N.min_artefact_ok(size - 700).alias("ok_default"),
        N.min_artefact_ok(size - 1000, "files").alias("ok_files"),
        N.min_artefact_ok(size - 1000, "sqlite").alias("ok_sqlite"),
    )
