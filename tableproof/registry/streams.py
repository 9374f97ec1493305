"""Streaming operators run over the tables as streams of files, until all is read."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from tableproof import fixtures as X
from tableproof.functions import names as N
from tableproof.registry import register
from tableproof.registry.catalogs import NEWEST
from tableproof.registry.fingerprints import strict_sql, sum_sql
from tableproof.session import ensure_checkpoint_dir
from tableproof.sources.files import is_folder
from tableproof.streaming import (
    fingerprints_at, stream_arrival, stream_changes, stream_fingerprint, stream_silence, stream_staleness, watch_arrival,
)

EVENT_COLS = ["CAST(event_id AS VARCHAR)", "CAST(ts AS VARCHAR)", "CAST(user_id AS VARCHAR)", "event_type", "CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)", "props"]


def table_stream(spark, sf_dir, name):
    """The files of one table as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(X.SCHEMAS[name])
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drain(spark, stream, mode):
    """Run a stream to its end into a table of the shared folder, batch by batch, and read it back."""
    return drained(spark, stream, mode)[0]


def drained(spark, stream, mode):
    """The same, and the folder of the stream's own state."""
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid4().hex}"

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out"), f"{root}/state"


@register(
    "s4_stream_fingerprint",
    sum_sql(f"SELECT event_type AS kind, {strict_sql([c for c in EVENT_COLS if c != 'event_type'])} AS r FROM {{events}}", "kind"),
)
def s4(spark, sf_dir):
    rows = table_stream(spark, sf_dir, "events").select(
        F.col("event_type").alias("kind"), "event_id", "ts", "user_id", F.col("value").cast("decimal(18,2)").alias("value"), "props"
    )
    seen = drain(spark, stream_fingerprint(rows, keys=["kind"]), "update")
    last = seen.groupBy("kind").agg(F.max_by(F.struct("algo", "digest", "n", "fingerprint"), "batch").alias("_l"))
    return last.select("kind", "_l.*")


@register("s3_stream_staleness", f"SELECT db, stamp, CAST({X.NOW} AS BIGINT) AS now, stamp < '{N.stamp_text(X.NOW - 45 * 86400)}' AS stale FROM ({NEWEST}) n")
def s3(spark, sf_dir):
    orders = table_stream(spark, sf_dir, "orders")
    names = spark.sql(X.ARTEFACTS, orders=orders).select("name", F.lit(X.NOW).alias("now"))
    seen = drain(spark, stream_staleness(names, 45), "update")
    last = seen.groupBy("db").agg(F.max_by(F.struct("stamp", "now", "stale"), "batch").alias("_l"))
    return last.select("db", "_l.*")


# Every file is observed thrice: growing, then at its last size twice; some never reach the size.
OBSERVED = (
    "SELECT concat('seg-', CAST(o_orderkey AS STRING)) AS name, step AS observed_at, "
    "CASE WHEN step = 1 THEN 1000 WHEN o_orderkey % 7 = 0 THEN 2000 ELSE 4096 END AS size FROM {orders} {steps}"
)


@register(
    "s2_stream_arrival",
    "SELECT concat('seg-', CAST(o_orderkey AS VARCHAR)) AS name, 'WHOLE' AS status, 4096::BIGINT AS size, 2::BIGINT AS observed_at FROM {orders} WHERE o_orderkey % 7 <> 0",
)
def s2(spark, sf_dir):
    orders = table_stream(spark, sf_dir, "orders")
    text = OBSERVED.replace("{steps}", "LATERAL VIEW explode(array(1L, 2L, 3L)) s AS step")
    seen = spark.sql(text, orders=orders).select("name", F.col("size").cast("bigint").alias("size"), "observed_at")
    return drain(spark, stream_arrival(seen, 4096, False), "append").select("name", "status", "size", "observed_at")


# Ciphertext is whole when it is larger than a segment and has had one size twice.
OBSERVED_ENCRYPTED = (
    "SELECT concat('seg-', CAST(o_orderkey AS STRING), '.age') AS name, step AS observed_at, "
    "CASE WHEN step = 1 THEN 1000 WHEN o_orderkey % 7 = 0 THEN 4096 WHEN o_orderkey % 7 = 1 THEN 4100 + step ELSE 4196 END AS size FROM {orders} {steps}"
)


@register(
    "s2_stream_arrival_encrypted",
    "SELECT concat('seg-', CAST(o_orderkey AS VARCHAR), '.age') AS name, 'WHOLE' AS status, 4196::BIGINT AS size, 3::BIGINT AS observed_at FROM {orders} WHERE o_orderkey % 7 > 1",
)
def s2_encrypted(spark, sf_dir):
    orders = table_stream(spark, sf_dir, "orders")
    text = OBSERVED_ENCRYPTED.replace("{steps}", "LATERAL VIEW explode(array(1L, 2L, 3L)) s AS step")
    seen = spark.sql(text, orders=orders).select("name", F.col("size").cast("bigint").alias("size"), "observed_at")
    return drain(spark, stream_arrival(seen, 4096, True), "append").select("name", "status", "size", "observed_at")


# The clock is the newest stamp of any database; a database whose own newest lies 45 days behind it is told of once.
@register(
    "s3_stream_silence",
    f"WITH n AS ({NEWEST}) SELECT db, stamp, 'SILENT' AS status FROM n WHERE strptime(stamp, '%Y%m%dT%H%M%SZ') < (SELECT max(strptime(stamp, '%Y%m%dT%H%M%SZ')) FROM n) - INTERVAL 45 DAY",
)
def s3_silence(spark, sf_dir):
    orders = table_stream(spark, sf_dir, "orders")
    return drain(spark, stream_silence(spark.sql(X.ARTEFACTS, orders=orders).select("name"), 45), "append").select("db", "stamp", "status")


# Every file is looked at thrice, ten seconds apart, and the files one second apart; every seventh never gets whole.
WATCHED = (
    "SELECT concat('seg-', CAST(o_orderkey AS STRING)) AS name, CASE WHEN step = 1 THEN 1000 WHEN o_orderkey % 7 = 0 THEN 2000 ELSE 4096 END AS size, "
    "timestamp_seconds(1789000000 + o_orderkey + 10 * step) AS observed_at FROM {orders} LATERAL VIEW explode(array(1L, 2L, 3L)) s AS step"
)
LOOKED = (
    "WITH o AS (SELECT 'seg-' || o_orderkey AS name, o_orderkey % 7 = 0 AS stuck, 1789000000 + o_orderkey AS t, (SELECT max(o_orderkey) + 1789000030 FROM {orders}) AS clock FROM {orders}), "
    "j AS (SELECT *, CASE WHEN NOT stuck THEN 'WHOLE' WHEN t + 70 <= clock THEN 'TIMED_OUT' END AS status FROM o) "
)


@register(
    "s2_watch_arrival",
    LOOKED + "SELECT name, status, CASE WHEN stuck THEN 2000 ELSE 4096 END::BIGINT AS size, t + CASE WHEN stuck THEN 30 ELSE 20 END AS observed_s FROM j WHERE status IS NOT NULL",
)
def s2_watch(spark, sf_dir):
    orders = table_stream(spark, sf_dir, "orders")
    seen = drain(spark, watch_arrival(spark.sql(WATCHED, orders=orders), 4096, False, 60, 120), "append")
    return seen.select("name", "status", "size", F.unix_seconds("observed_at").alias("observed_s"))


@register(
    "s2_watch_state",
    LOOKED + "SELECT count(*) AS names, count(*) FILTER (CASE status WHEN 'WHOLE' THEN t + 20 + 120 > clock WHEN 'TIMED_OUT' THEN t + 70 + 120 > clock ELSE true END) AS remembered FROM j",
)
def s2_state(spark, sf_dir):
    """What the stream still remembers when all is read, out of the names it has seen."""
    orders = table_stream(spark, sf_dir, "orders")
    _, state = drained(spark, watch_arrival(spark.sql(WATCHED, orders=orders), 4096, False, 60, 120), "append")
    held = spark.read.format("statestore").option("path", state).load().select(F.explode("value.groupState.name"))
    names = X.load(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("names"))
    return names.crossJoin(held.agg(F.count(F.lit(1)).alias("remembered")))


VERSIONS = (
    f"SELECT *, lead(idx) OVER (PARTITION BY k ORDER BY idx) AS until FROM (SELECT *, row_number() OVER (PARTITION BY k, idx ORDER BY pos DESC) AS rn FROM ({X.CHANGE_LOG}) l) c WHERE rn = 1"
)
STATES = (
    f"SELECT border AS idx, {strict_sql(['CAST(k AS VARCHAR)', 'CAST(v AS VARCHAR)'])} AS r FROM (SELECT DISTINCT idx AS border FROM ({X.CHANGE_LOG}) l) b "
    f"JOIN ({VERSIONS}) s ON s.idx <= border AND (until IS NULL OR border < until) WHERE op <> 'D'"
)


@register("s4_log_fingerprint", sum_sql(STATES, "idx"))
def s4_log(spark, sf_dir):
    """The state behind every log file, from signed sums alone; no state is ever put together."""
    log = spark.sql(X.CHANGE_LOG, events=table_stream(spark, sf_dir, "events"))
    ledger = drain(spark, stream_changes(log, ["k"], ["v"]), "append").drop("batch")
    return fingerprints_at(ledger).drop("octets")
