"""Queries over retention rules and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableproof import fixtures as X
from tableproof.functions import names as N
from tableproof.operators import retention as R
from tableproof.registry import register
from tableproof.registry.names import stamp_sql


def flags_sql(pairs: str, keep: int, days: int) -> str:
    """Rows ``db, name`` to ``db, name, stamp, victim``, by ranking every name."""
    cutoff = N.stamp_text(X.NOW - days * 86400)
    kept = ["rn = 1"] + ([f"rn <= {keep}"] if keep else []) + ([f"stamp >= '{cutoff}'"] if days else [])
    return (
        f"SELECT db, name, stamp, NOT ({' OR '.join(kept)}) AS victim FROM (SELECT *, row_number() OVER (PARTITION BY db ORDER BY name DESC) AS rn "
        f"FROM (SELECT DISTINCT db, name, {stamp_sql('db')} AS stamp FROM ({pairs}) p0) p1 WHERE stamp IS NOT NULL) p2"
    )


PAIRS = f"SELECT db, name FROM ({X.ARTEFACTS}) z WHERE has_manifest AND name NOT LIKE '%.part'"


def pairs(spark, sf_dir):
    return X.view(spark, sf_dir, PAIRS)


def _victims(keep, days):
    def build(spark, sf_dir):
        return R.retention_victims(pairs(spark, sf_dir), keep, days, X.NOW)

    return build


for _keep, _days, _name in [(14, 0, "keep"), (0, 60, "days"), (300, 30, "both")]:
    register(f"f1_retention_victims_{_name}", f"SELECT db, name, stamp FROM ({flags_sql(PAIRS, _keep, _days)}) f WHERE victim")(_victims(_keep, _days))


@register(
    "e18_retention_summary",
    f"SELECT db, count(*) AS total, count(*) FILTER (NOT victim) AS kept, count(*) FILTER (victim) AS dropped, 'keep=14 days=60' AS rule "
    f"FROM ({flags_sql(PAIRS, 14, 60)}) f GROUP BY db",
)
def e18(spark, sf_dir):
    return R.retention_summary(R.retention_flags(pairs(spark, sf_dir), 14, 60, X.NOW), 14, 60)


# --- bases, marks and files of recovery points -----------------------------------------
# Stamps grow with the log position, as those of real bases do.



def stamped_points(dialect: str) -> str:
    """Recovery points under stamped names: the stamp is ``idx`` minutes before the clock's year end."""
    if dialect == "spark":
        stamp = "date_format(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, 1767225600 + idx * 600), \"yyyyMMdd'T'HHmmss'Z'\")"
    else:
        stamp = "strftime(make_timestamp((1767225600 + idx * 600) * 1000000), '%Y%m%dT%H%M%SZ')"
    return (
        f"SELECT db, kind, series, idx, pos, concat(db, '_', {stamp}, CASE kind WHEN 'base' THEN '_base.json' ELSE '_mark.json' END) AS name "
        f"FROM ({X.RECOVERY_POINTS}) z"
    )


ARCHIVE_FILES = (
    f"SELECT db, series, idx, concat('bin', CAST(series AS STRING), '.', CASE WHEN idx >= 100000 THEN CAST(idx AS STRING) ELSE lpad(CAST(idx AS STRING), 6, '0') END) AS name, "
    f"CASE WHEN idx % 50 = 0 THEN 'timeline_history' WHEN idx % 51 = 0 THEN 'backup_history' ELSE 'segment' END AS kind FROM ({X.RECOVERY_POINTS}) z"
)

LINE_SQL = (
    f"WITH p AS ({stamped_points('duckdb')}), b AS (SELECT * FROM p WHERE kind = 'base'), f AS ({flags_sql('SELECT db, name FROM b', 200, 30)}), "
    "j AS (SELECT f.*, b.series, b.idx, b.pos FROM f JOIN b ON f.db = b.db AND f.name = b.name), "
    "k AS (SELECT db, min(name) FILTER (NOT victim) AS base, count(*) FILTER (victim) AS dropped_bases FROM j GROUP BY db), "
    "line AS (SELECT k.db, k.base, b.series, b.idx, k.dropped_bases, 'LINE' AS status FROM k JOIN b ON k.db = b.db AND k.base = b.name WHERE k.dropped_bases > 0)"
)


def points(spark, sf_dir):
    p = X.view(spark, sf_dir, stamped_points("spark"))
    return p.filter("kind = 'base'").drop("kind"), p.filter("kind = 'mark'").drop("kind")


@register("f7_retention_line", LINE_SQL + " SELECT * FROM line")
def f7(spark, sf_dir):
    bases, _ = points(spark, sf_dir)
    return R.retention_line(bases, 200, 30, X.NOW)


@register(
    "c4_below_line",
    LINE_SQL + f", a AS ({ARCHIVE_FILES}) SELECT a.db, a.series, a.idx, a.name FROM a JOIN line l ON a.db = l.db AND a.series = l.series AND a.idx < l.idx",
)
def c4(spark, sf_dir):
    bases, _ = points(spark, sf_dir)
    files = X.view(spark, sf_dir, ARCHIVE_FILES)
    return R.below_line(files, R.retention_line(bases, 200, 30, X.NOW)).select("db", "series", "idx", "name")


PRUNE_SQL = LINE_SQL + (
    f", a AS ({ARCHIVE_FILES}), plan AS (SELECT f.db, 'base' AS kind, f.name FROM f JOIN line l ON f.db = l.db WHERE victim "
    "UNION ALL SELECT p.db, 'mark', p.name FROM p JOIN line l ON p.db = l.db AND p.series = l.series AND p.idx < l.idx WHERE p.kind = 'mark' "
    "UNION ALL SELECT a.db, 'file', a.name FROM a JOIN line l ON a.db = l.db AND a.series = l.series AND a.idx < l.idx WHERE a.kind <> 'timeline_history')"
)


def prune_plan(spark, sf_dir):
    bases, marks = points(spark, sf_dir)
    return R.prune_chain(bases, marks, X.view(spark, sf_dir, ARCHIVE_FILES), 200, 30, X.NOW)


@register("i9_prune_chain", PRUNE_SQL + " SELECT db, kind, name, 'DROP' AS decision FROM plan")
def i9(spark, sf_dir):
    return prune_plan(spark, sf_dir)


@register("e18_prune_summary", PRUNE_SQL + " SELECT db, kind, 'DROP' AS decision, count(*) AS n FROM plan GROUP BY db, kind")
def e18_prune(spark, sf_dir):
    return R.prune_summary(prune_plan(spark, sf_dir))
