"""Queries over catalogues of artefacts and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableproof import fixtures as X
from tableproof.functions import names as N
from tableproof.operators import catalog as G
from tableproof.operators.ordered import places
from tableproof.registry import register
from tableproof.registry.names import MANIFEST_FOR_SQL, stamp_sql

# A site per database; one listing row per file name, manifests among the files.
SITE = (
    "SELECT 'vault' AS site, db, name, has_manifest, sha, site_sha, id FROM (SELECT z.*, row_number() OVER (PARTITION BY name ORDER BY id) AS rn "
    f"FROM ({X.ARTEFACTS}) z) y WHERE rn = 1"
)
SITE_SQL = f"WITH s AS ({SITE})"
LISTED_SQL = (
    f"{SITE_SQL}, m AS (SELECT site, {MANIFEST_FOR_SQL} AS name, name AS artefact, sha AS sha256, db FROM s WHERE has_manifest AND name NOT LIKE '%.part'), "
    "l AS (SELECT site, name, site_sha AS sha256 FROM s WHERE id % 73 <> 0 UNION ALL SELECT DISTINCT site, name, NULL FROM m)"
)


def site_files(spark, sf_dir):
    return X.view(spark, sf_dir, SITE)


def site_manifests(spark, sf_dir):
    s = site_files(spark, sf_dir).filter("has_manifest").filter(~F.endswith(F.col("name"), F.lit(".part")))
    return s.select("site", N.manifest_for(F.col("name")).alias("name"), F.col("name").alias("artefact"), F.col("sha").alias("sha256"), "db")


def site_listing(spark, sf_dir):
    held = site_files(spark, sf_dir).filter("id % 73 <> 0").select("site", "name", F.col("site_sha").alias("sha256"))
    manifests = site_manifests(spark, sf_dir).select("site", "name").distinct()
    return held.unionByName(manifests, allowMissingColumns=True)


@register("c1_own_database", f"WITH a AS ({X.ARTEFACTS}) SELECT id, name FROM a WHERE {stamp_sql(chr(39) + 'app' + chr(39))} IS NOT NULL")
def c1(spark, sf_dir):
    return G.own_database(X.view(spark, sf_dir, X.ARTEFACTS), "app").select("id", "name")


KINDS = (
    "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'pitr-base' WHEN 1 THEN 'pitr-mark' WHEN 2 THEN 'binlog-base' "
    "WHEN 3 THEN 'binlog-mark' ELSE CAST(NULL AS STRING) END AS kind FROM {orders}"
)


@register("c2_by_kind", f"WITH k AS ({KINDS}) SELECT id, kind FROM k WHERE kind IS NULL OR kind = 'pitr-mark'")
def c2(spark, sf_dir):
    return G.by_kind(X.view(spark, sf_dir, KINDS), ["dump", "pitr-mark"])


NEWEST = (
    "SELECT db, max(stamp) AS stamp, max(name) FILTER (stamp = top) AS name FROM (SELECT *, max(stamp) OVER (PARTITION BY db) AS top FROM ("
    "SELECT nullif(regexp_extract(name, '^(.+)_([0-9]{8}T[0-9]{6}Z)', 1), '') AS db, nullif(regexp_extract(name, '^(.+)_([0-9]{8}T[0-9]{6}Z)', 2), '') AS stamp, name "
    f"FROM ({X.ARTEFACTS}) z) y WHERE stamp IS NOT NULL) x GROUP BY db"
)


@register("e10_newest_per_db", NEWEST)
def e10(spark, sf_dir):
    return G.newest_per_db(X.view(spark, sf_dir, X.ARTEFACTS))


@register(
    "e11_stale_databases",
    f"SELECT db, stamp, CAST(trunc(({X.NOW} - epoch(strptime(stamp, '%Y%m%dT%H%M%SZ'))) / 86400) AS BIGINT) AS age_days "
    f"FROM ({NEWEST}) n WHERE stamp < '{N.stamp_text(X.NOW - 45 * 86400)}'",
)
def e11(spark, sf_dir):
    return G.stale_databases(X.view(spark, sf_dir, X.ARTEFACTS), X.NOW, 45)


@register(
    "e12_ambiguous_selection",
    f"WITH a AS (SELECT DISTINCT db FROM ({X.ARTEFACTS}) z) SELECT db, (SELECT count(*) FROM a) AS n_databases, (SELECT count(*) FROM a) > 1 AS refused FROM a",
)
def e12(spark, sf_dir):
    return G.ambiguous_selection(X.view(spark, sf_dir, X.ARTEFACTS))


CATALOGUE = (
    "SELECT db, name, CASE WHEN id % 3 = 0 THEN concat('2026-08-', lpad(CAST(1 + id % 28 AS STRING), 2, '0'), 'T00:00:00Z') END AS created_at "
    f"FROM ({SITE}) z"
)


@register(
    "f4_pick_latest",
    f"WITH k AS (SELECT *, coalesce(nullif(regexp_extract(name, '_([0-9]{{8}}T[0-9]{{6}}Z)', 1), ''), created_at) AS order_key FROM ({CATALOGUE}) c), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY db ORDER BY order_key DESC, name ASC) AS rn FROM k WHERE coalesce(order_key, '') <> '') "
    "SELECT db, name, created_at, order_key FROM r WHERE rn = 1",
)
def f4(spark, sf_dir):
    return G.pick_latest(X.view(spark, sf_dir, CATALOGUE))


@register(
    "g1_newest_manifest",
    f"{LISTED_SQL} SELECT site, max(name) AS name FROM l WHERE {stamp_sql(chr(39) + 'app' + chr(39))} IS NOT NULL AND name LIKE '%.json' GROUP BY site",
)
def g1(spark, sf_dir):
    return G.newest_manifest(site_listing(spark, sf_dir), "app", "site")


@register(
    "g2_bytewise_order",
    f"SELECT name, row_number() OVER (PARTITION BY id % 64 ORDER BY name, id) AS place, id FROM ({X.ARTEFACTS}) z",
)
def g2(spark, sf_dir):
    a = X.view(spark, sf_dir, X.ARTEFACTS).select("id", "name", (F.col("id") % 64).alias("part"))
    return places(a, ["part"], ["name", "id"]).select("name", F.col("place").cast("bigint").alias("place"), "id")


@register("d5_audit_site", f"{LISTED_SQL} SELECT m.site, m.name, CASE WHEN h.name IS NULL THEN 'ARTEFACT_MISSING' WHEN m.sha256 <> h.sha256 THEN 'ROT' ELSE 'OK' END AS status "
          "FROM m LEFT JOIN l h ON m.artefact = h.name "
          "UNION ALL SELECT site, name, 'PUSH_DIED' FROM l WHERE name LIKE '%.part' "
          f"UNION ALL SELECT site, name, 'NO_MANIFEST' FROM l WHERE name NOT LIKE '%.part' AND name NOT LIKE '%.json' AND {MANIFEST_FOR_SQL} NOT IN (SELECT name FROM m)")
def d5(spark, sf_dir):
    return G.audit_site(site_listing(spark, sf_dir), site_manifests(spark, sf_dir))


@register(
    "d5_audit_summary",
    f"{LISTED_SQL}, a AS (SELECT m.site, CASE WHEN h.name IS NULL OR m.sha256 <> h.sha256 THEN 0 ELSE 1 END AS ok FROM m LEFT JOIN l h ON m.artefact = h.name "
    "UNION ALL SELECT site, 0 FROM l WHERE name LIKE '%.part' "
    f"UNION ALL SELECT site, 0 FROM l WHERE name NOT LIKE '%.part' AND name NOT LIKE '%.json' AND {MANIFEST_FOR_SQL} NOT IN (SELECT name FROM m)) "
    "SELECT site, count(*) FILTER (ok = 0) AS problems, count(*) FILTER (ok = 1) AS clean_pairs, CASE WHEN count(*) FILTER (ok = 0) > 0 THEN 'FAILED' "
    "WHEN count(*) FILTER (ok = 1) = 0 THEN 'NOTHING_PROVEN' ELSE 'CONSISTENT' END AS status FROM a GROUP BY site",
)
def d5_summary(spark, sf_dir):
    return G.audit_summary(G.audit_site(site_listing(spark, sf_dir), site_manifests(spark, sf_dir)))


@register(
    "d6_complete_pairs",
    f"{LISTED_SQL} SELECT site, name FROM l WHERE name NOT LIKE '%.part' AND name NOT LIKE '%.json' AND {MANIFEST_FOR_SQL} IN (SELECT name FROM m)",
)
def d6(spark, sf_dir):
    artefacts = site_listing(spark, sf_dir).filter(N.classify_file(F.col("name"), "site") == "artefact").select("site", "name")
    return G.complete_pairs(artefacts, site_manifests(spark, sf_dir))


@register(
    "h1_uncovered_artefacts",
    f"{LISTED_SQL} SELECT DISTINCT site, name FROM l WHERE name NOT LIKE '%.part' AND name NOT LIKE '%.json' AND {MANIFEST_FOR_SQL} NOT IN (SELECT name FROM m)",
)
def h1(spark, sf_dir):
    return G.uncovered_artefacts(site_listing(spark, sf_dir), site_manifests(spark, sf_dir))
