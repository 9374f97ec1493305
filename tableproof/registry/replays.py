"""Queries over change logs: reading, latest state, replay to an instant."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from tableproof import fixtures as X
from tableproof.operators import replay as R
from tableproof.registry import register
from tableproof.session import ensure_checkpoint_dir
from tableproof.sources.changelog import read_change_log

# The anchor is a quarter into the log, the mark three quarters, both inside a file.
BOUNDS = "e AS (SELECT max(idx) AS top FROM l), p AS (SELECT top // 4 AS a_idx, 404 AS a_pos, (top * 3) // 4 AS m_idx, 2504 AS m_pos FROM e)"
LOG = f"WITH l AS ({X.CHANGE_LOG}), {BOUNDS}"
AFTER_ANCHOR = "(l.idx > a_idx OR (l.idx = a_idx AND l.pos >= a_pos))"
BEFORE_ANCHOR = "(l.idx < a_idx OR (l.idx = a_idx AND l.pos < a_pos))"
BEFORE_MARK = "(l.idx < m_idx OR (l.idx = m_idx AND l.pos < m_pos))"


def state_sql(where: str) -> str:
    return (
        "SELECT k, v FROM (SELECT l.*, row_number() OVER (PARTITION BY k ORDER BY idx DESC, pos DESC) AS rn FROM l, p "
        f"WHERE {where}) z WHERE rn = 1 AND op <> 'D'"
    )


def change_log(spark, sf_dir):
    return X.view(spark, sf_dir, X.CHANGE_LOG)


def instants(log):
    """Anchor and mark positions; the maximum comes from file statistics or one small aggregate."""
    top = log.agg(F.max("idx").alias("top")).first()["top"]
    return (top // 4, 404), ((top * 3) // 4, 2504)


@register(
    "a11_change_log",
    f"{LOG} SELECT idx, pos, k, op, CAST(v AS VARCHAR) AS v, gtid_uuid, gtid_no FROM l, p WHERE {AFTER_ANCHOR} AND {BEFORE_MARK}",
)
def a11(spark, sf_dir):
    log = change_log(spark, sf_dir)
    anchor, mark = instants(log)
    path = f"{ensure_checkpoint_dir(spark)}/change-log-{uuid4().hex}"
    log.write.parquet(path)
    return read_change_log(spark, path, anchor=anchor, mark=mark, schema=log.schema.simpleString()[len("struct<"):-1].replace(":", " ")).withColumn("v", F.col("v").cast("string"))


@register("f5_latest_state", f"{LOG} SELECT k, CAST(v AS VARCHAR) AS v FROM ({state_sql('true')}) s")
def f5(spark, sf_dir):
    return R.latest_state(change_log(spark, sf_dir), ["k"], ["v"]).select("k", F.col("v").cast("string").alias("v"))


@register("i3_replay_to_mark", f"{LOG} SELECT k, CAST(v AS VARCHAR) AS v FROM ({state_sql(BEFORE_MARK)}) s")
def i3(spark, sf_dir):
    log = change_log(spark, sf_dir)
    anchor, mark = instants(log)
    base = R.latest_state(log.filter(R.before(anchor)), ["k"], ["v"])
    state = R.replay_to_mark(base, log, anchor, mark, ["k"], ["v"], target="named")
    return state.select("k", F.col("v").cast("string").alias("v"))


SKIPPED = "l.gtid_uuid = 'purchase' AND l.gtid_no < (SELECT max(gtid_no) // 2 FROM l)"


@register(
    "i3_replay_skipping_applied",
    f"{LOG}, c AS (SELECT l.*, row_number() OVER (PARTITION BY k ORDER BY idx DESC, pos DESC) AS rn FROM l, p WHERE {AFTER_ANCHOR} AND {BEFORE_MARK} AND NOT ({SKIPPED})), "
    f"b AS ({state_sql(BEFORE_ANCHOR)}), n AS (SELECT * FROM c WHERE rn = 1) "
    "SELECT coalesce(b.k, n.k) AS k, CAST(CASE WHEN n.k IS NULL THEN b.v ELSE n.v END AS VARCHAR) AS v FROM b FULL JOIN n ON b.k = n.k WHERE n.k IS NULL OR n.op <> 'D'",
)
def i3_skipping(spark, sf_dir):
    log = change_log(spark, sf_dir)
    anchor, mark = instants(log)
    half = log.agg(F.max("gtid_no").alias("top")).first()["top"] // 2
    purged = spark.createDataFrame([("purchase", 0, half - 1)], "uuid string, lo bigint, hi bigint")
    base = R.latest_state(log.filter(R.before(anchor)), ["k"], ["v"])
    state = R.replay_to_mark(base, log, anchor, mark, ["k"], ["v"], purged)
    return state.select("k", F.col("v").cast("string").alias("v"))


@register(
    "e19_quiesced",
    "WITH b AS (SELECT CAST(user_id % 1000 AS VARCHAR) AS db, event_id // 100 AS idx, event_id % 100 AS pos, event_id FROM {events}), "
    "x AS (SELECT db, max(row(idx, pos)) AS p FROM b GROUP BY db), y AS (SELECT db, max(row(idx, pos)) AS p FROM b WHERE event_id % 1000 < 990 GROUP BY db), "
    "q AS (SELECT coalesce(x.db, y.db) AS db, y.p AS before, x.p AS after FROM y FULL JOIN x ON x.db = y.db) "
    "SELECT db, CASE WHEN before IS NOT DISTINCT FROM after THEN 'yes' ELSE 'no' END AS quiesced FROM q",
)
def e19(spark, sf_dir):
    e = X.load(spark, sf_dir, "events").select(
        (F.col("user_id") % 1000).cast("string").alias("db"), F.floor(F.col("event_id") / 100).alias("idx"), (F.col("event_id") % 100).alias("pos"), "event_id"
    )
    return R.quiesced(e.filter("event_id % 1000 < 990"), e).select("db", "quiesced")
