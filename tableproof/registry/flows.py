"""Queries over workflows: manifests made from tables, whole verifications, site audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableproof import fixtures as X
from tableproof.operators import compare as C
from tableproof.operators import fingerprint as P
from tableproof.operators import intervals as T
from tableproof.operators import replay as R
from tableproof.plans import gates as W
from tableproof.plans.instants import site_problems
from tableproof.registry import register
from tableproof.registry.chains import AUDIT_SQL, CHAIN, FX8, POINTS, chain, points, reach_sql, txns
from tableproof.registry.comparisons import COUNTER_SQL, OBJECTS_SQL, TABLES_SQL, matrix
from tableproof.registry.fingerprints import CONV_COLS, digests_of, object_catalog, object_sql, strict_sql, sum_sql
from tableproof.registry.replays import BEFORE_MARK, LOG, change_log, instants, state_sql
from tableproof.sources.manifests import manifest_entries, manifest_row

# --- A2, A6: a manifest is made from tables and read again ---------------------------------


def manifest(spark, sf_dir):
    tables = {"conversations": X.load(spark, sf_dir, "conversations"), "copy": X.view(spark, sf_dir, X.CONVERSATIONS_COPY)}
    return manifest_row(P.fingerprint_tables(tables, "app", algo="md5"), digests_of(object_catalog(spark, sf_dir)), {"database": "app"})


CONV_PRINT = "SELECT '{t}' AS entry, fingerprint AS value, digest, n FROM ({q}) f"
TABLE_ENTRIES = " UNION ALL ".join(
    CONV_PRINT.replace("{t}", t).replace("{q}", sum_sql(f"SELECT {strict_sql(CONV_COLS)} AS r FROM ({src}) c"))
    for t, src in [("conversations", "SELECT * FROM {conversations}"), ("copy", X.CONVERSATIONS_COPY)]
)


@register("a2_manifest_tables", TABLE_ENTRIES)
def a2_tables(spark, sf_dir):
    return manifest_entries(manifest(spark, sf_dir), "tables")


@register(
    "a2_manifest_objects",
    f"SELECT class AS entry, digest AS value, split_part(digest, ':', 2) AS digest, n FROM ({object_sql('definition')}) o",
)
def a2_objects(spark, sf_dir):
    return manifest_entries(manifest(spark, sf_dir), "objects")


# --- I1: every gate of a snapshot ------------------------------------------------------------

I1_CHECKS = (
    "SELECT 'copy.json' AS snapshot, 'tables' AS gate, \"table\" AS subject, status, CASE WHEN status = 'OK' THEN 'ok' ELSE 'failure' END AS severity "
    f"FROM ({TABLES_SQL}) t UNION ALL SELECT 'copy.json', 'objects', class, status, CASE WHEN status = 'OK' THEN 'ok' ELSE 'failure' END FROM ({OBJECTS_SQL}) o "
    f"UNION ALL SELECT 'copy.json', 'counters', tbl, status, CASE WHEN status = 'OK' THEN 'ok' ELSE 'failure' END FROM ({COUNTER_SQL.replace('{op}', '<=')}) k"
)


def snapshot_checks(spark, sf_dir):
    expected, actual = matrix(spark, sf_dir, algo="xxhash64")
    return W.snapshot_checks(
        "copy.json", expected, actual, digests_of(object_catalog(spark, sf_dir)), digests_of(object_catalog(spark, sf_dir, copy=True)),
        X.view(spark, sf_dir, X.COUNTERS), C.key_maxima(X.view(spark, sf_dir, X.KEYS)),
    )


@register("i1_snapshot_checks", I1_CHECKS)
def i1(spark, sf_dir):
    return snapshot_checks(spark, sf_dir)


@register(
    "i1_snapshot_verdict",
    f"WITH c AS ({I1_CHECKS}) SELECT snapshot, count(*) FILTER (gate = 'tables') AS tables_compared, count(*) FILTER (severity = 'failure') AS failures, "
    "count(*) FILTER (severity = 'failure' AND gate = 'counters') AS write_problems, 'FAILED' AS verdict FROM c GROUP BY snapshot",
)
def i1_verdict(spark, sf_dir):
    return C.verdict(snapshot_checks(spark, sf_dir)).select("snapshot", "tables_compared", "failures", "write_problems", "verdict")


# --- I4: an instant, gate by gate --------------------------------------------------------------
# The mark's table is the log replayed in one go; the pair replays base and remainder, once to the
# mark and once stopping early, which only the content can tell.


@register(
    "i4_instant_checks",
    f"{LOG}, m AS ({state_sql(BEFORE_MARK)}), early AS ({state_sql(BEFORE_MARK.replace('m_idx', '(m_idx - 1)'))}), {FX8.removeprefix('WITH ')} "
    "SELECT 'reached' AS snapshot, 'tables' AS gate, 'accounts' AS subject, 'OK' AS status, 'ok' AS severity "
    "UNION ALL SELECT 'early', 'tables', 'accounts', CASE WHEN EXISTS (SELECT * FROM m EXCEPT ALL SELECT * FROM early) OR EXISTS (SELECT * FROM early EXCEPT ALL SELECT * FROM m) THEN 'DIFFERS' ELSE 'OK' END, "
    "CASE WHEN EXISTS (SELECT * FROM m EXCEPT ALL SELECT * FROM early) OR EXISTS (SELECT * FROM early EXCEPT ALL SELECT * FROM m) THEN 'failure' ELSE 'ok' END "
    "UNION ALL SELECT 'reached', 'transactions', uuid, CASE WHEN count(*) FILTER (NOT applied) > 0 THEN 'MISSING' ELSE 'OK' END, "
    "CASE WHEN count(*) FILTER (NOT applied) > 0 THEN 'failure' ELSE 'ok' END FROM t GROUP BY uuid",
)
def i4(spark, sf_dir):
    log = change_log(spark, sf_dir)
    anchor, mark = instants(log)
    base = R.latest_state(log.filter(R.before(anchor)), ["k"], ["v"])
    whole = R.latest_state(log.filter(R.before(mark)), ["k"], ["v"])
    early = (mark[0] - 1, mark[1])

    def prints(df):
        return P.fingerprint_tables({"accounts": df}, "app")

    rows = [
        W.table_checks("reached", prints(whole), prints(R.replay_to_mark(base, log, anchor, mark, ["k"], ["v"]))),
        W.table_checks("early", prints(whole), prints(R.replay_to_mark(base, log, anchor, early, ["k"], ["v"]))),
    ]
    t = txns(spark, sf_dir)
    rows.append(W.checks(T.txn_subset(t, t.filter("applied")), "reached", "transactions", "uuid"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# --- I7: the instants of a site ------------------------------------------------------------------


def _site(dialect: str) -> str:
    from tableproof.registry.retentions import stamped_points

    return stamped_points(dialect)


I7_SQL = (
    f"WITH p AS ({_site('duckdb')}), m0 AS (SELECT * FROM p WHERE kind = 'mark'), b AS (SELECT * FROM p WHERE kind = 'base' AND db <> 'web' AND idx % 3 <> 0), "
    "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db ORDER BY name DESC) AS rn FROM m0) z WHERE rn = 1), "
    f"r AS ({reach_sql('binlog')}), pairs AS (SELECT r.db, r.name AS mark, concat('bin', CAST(r.series AS VARCHAR)) AS series, b.idx AS base_idx, r.idx AS mark_idx FROM r LEFT JOIN b ON r.base = b.name), "
    "allfiles AS (SELECT DISTINCT concat('bin', CAST(series AS VARCHAR), '.', CASE WHEN idx >= 1000000 THEN CAST(idx AS VARCHAR) ELSE lpad(CAST(idx AS VARCHAR), 6, '0') END) AS name, idx, series FROM p), "
    "inv AS (SELECT m.name AS mark, f.name, md5(f.name) AS sha FROM m JOIN allfiles f ON f.series = m.series AND f.idx <= m.idx AND f.idx % 53 <> 7), "
    "site AS (SELECT name, CASE WHEN idx % 47 = 0 THEN 'rot' ELSE md5(name) END AS sha FROM allfiles WHERE idx % 31 <> 0), "
    "req AS (SELECT mark, series, unnest(range(base_idx, mark_idx + 1)) AS idx FROM pairs WHERE base_idx IS NOT NULL), "
    "required AS (SELECT mark, series || '.' || CASE WHEN idx >= 1000000 THEN CAST(idx AS VARCHAR) ELSE lpad(CAST(idx AS VARCHAR), 6, '0') END AS name FROM req "
    "UNION SELECT i.mark, i.name FROM inv i JOIN pairs USING (mark) WHERE base_idx IS NULL) "
    "SELECT db, mark AS subject, 'NO_INTACT_BASE' AS problem FROM pairs WHERE base_idx IS NULL "
    f"UNION ALL SELECT pairs.db, a.name, a.status FROM ({AUDIT_SQL}) a JOIN pairs ON a.mark = pairs.mark WHERE a.status <> 'OK' "
    "UNION ALL SELECT NULL, name, 'PUSH_DIED' FROM (SELECT concat(name, '.part') AS name FROM m0 WHERE idx % 101 = 1) d "
)


@register("i7_site_problems", I7_SQL)
def i7(spark, sf_dir):
    p = X.view(spark, sf_dir, _site("spark"))
    marks = p.filter("kind = 'mark'").drop("kind").withColumn("encrypted", F.lit("no"))
    bases = p.filter("kind = 'base' AND db <> 'web'").drop("kind").select("*", F.col("name").alias("artefact"), F.md5("name").alias("sha256"))
    named = F.expr("concat('bin', series, '.', if(idx >= 1000000, cast(idx AS string), lpad(cast(idx AS string), 6, '0')))")
    files = p.select(named.alias("name"), "idx", "series").distinct()
    vouched = marks.select(F.col("name").alias("mark"), F.col("series").alias("_s"), F.col("idx").alias("_i"), "db")
    newest = vouched.groupBy("db").agg(F.max(F.struct("mark", "_s", "_i")).alias("_m")).select("_m.*")
    inventory = (
        newest.join(files, (F.col("_s") == F.col("series")) & (F.col("idx") <= F.col("_i")))
        .filter("idx % 53 <> 7").select("mark", "name", F.md5("name").alias("sha256"))
    )
    held = files.filter("idx % 31 <> 0").select(F.col("name").alias("artefact"), F.when(F.col("idx") % 47 == 0, F.lit("rot")).otherwise(F.md5("name")).alias("sha256"))
    true_bases = bases.select("artefact", F.when(F.col("idx") % 3 == 0, F.lit("rot")).otherwise(F.col("sha256")).alias("sha256"))
    listing = marks.filter("idx % 101 = 1").select(F.concat("name", F.lit(".part")).alias("name"))
    logs = marks.withColumn("series", F.concat(F.lit("bin"), F.col("series").cast("string")))
    based = bases.withColumn("series", F.concat(F.lit("bin"), F.col("series").cast("string")))
    return site_problems(listing, logs, based, held.unionByName(true_bases), inventory, X.NOW, 0)
