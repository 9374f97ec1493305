"""Queries over log archives, recovery points, chains and transaction sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableproof import fixtures as X
from tableproof.functions import names as N
from tableproof.operators import chain as L
from tableproof.operators import intervals as T
from tableproof.registry import register
from tableproof.registry.names import series_name_sql, wal_index_sql, wal_name_sql
from tableproof.session import stored

# --- WAL archive of FX3: one archive, several timelines ----------------------------

WAL = f"WITH w AS (SELECT 'vault' AS archive, name, bytes, substr(name, 1, 8) AS series, {wal_index_sql('name')} AS idx FROM ({X.WAL_LISTING}) z)"


def wal(spark, sf_dir):
    w = X.view(spark, sf_dir, X.WAL_LISTING)
    return w.select(
        F.lit("vault").alias("archive"), "name", F.col("bytes").cast("bigint").alias("bytes"),
        N.wal_timeline(F.col("name")).alias("series"), N.wal_index(F.col("name")).alias("idx"),
    )


WAL_HOLES = (
    f"{WAL}, n AS (SELECT archive, series, idx, lead(idx) OVER (PARTITION BY archive, series ORDER BY idx) AS nxt FROM (SELECT DISTINCT archive, series, idx FROM w) d)"
)


@register("c3_in_chain", f"{WAL} SELECT name, idx FROM w WHERE series = '00000001' AND idx BETWEEN 100 AND 4000")
def c3(spark, sf_dir):
    return L.in_chain(wal(spark, sf_dir), "00000001", 100, 4000).select("name", "idx")


@register("f2_missing_ranges", f"{WAL_HOLES} SELECT series, idx + 1 AS first, nxt - 1 AS last, nxt - idx - 1 AS n FROM n WHERE nxt > idx + 1")
def f2(spark, sf_dir):
    return L.missing_ranges(wal(spark, sf_dir))


@register("f3_wrong_size", f"{WAL} SELECT archive, name, CAST(bytes AS BIGINT) AS bytes, CAST((SELECT max(bytes) FROM w) AS BIGINT) AS expected_bytes FROM w WHERE bytes <> (SELECT max(bytes) FROM w)")
def f3(spark, sf_dir):
    return L.wrong_size(wal(spark, sf_dir)).select("archive", "name", "bytes", "expected_bytes")


# archives by customer: plain, encrypted and mixed ones; one or several prefixes
ARCHIVES = (
    "SELECT concat('archive-', CAST(o_custkey AS STRING)) AS archive, concat(CASE WHEN o_custkey % 7 = 0 AND o_orderkey % 2 = 0 THEN 'mysql-bin' ELSE 'binlog' END, '.', "
    "lpad(CAST(o_orderkey AS STRING), 8, '0'), CASE WHEN o_custkey % 5 = 1 OR (o_custkey % 5 = 2 AND o_orderkey % 3 = 0) THEN '.age' ELSE '' END) AS name, "
    "CAST(o_orderkey AS BIGINT) AS bytes FROM {orders}"
)


def archives(spark, sf_dir):
    return X.view(spark, sf_dir, ARCHIVES)


#: Every archive also holds a file of either form that is no log; neither decides the archive's form.
ARCHIVES_WITH_STRAYS = (
    f"SELECT archive, name, bytes FROM ({ARCHIVES}) logs UNION ALL SELECT archive, 'notes.txt', CAST(5 AS BIGINT) FROM (SELECT DISTINCT archive FROM ({ARCHIVES}) p) p1 "
    f"UNION ALL SELECT archive, 'old.age', CAST(5 AS BIGINT) FROM (SELECT DISTINCT archive FROM ({ARCHIVES}) e) e1"
)


@register(
    "e13_archive_form",
    f"SELECT archive, encrypted, plain, CASE WHEN encrypted > 0 AND plain > 0 THEN 'MIXED' WHEN encrypted > 0 THEN 'encrypted' ELSE 'plain' END AS form FROM ("
    f"SELECT archive, count(*) FILTER (name LIKE '%.age') AS encrypted, count(*) FILTER (name NOT LIKE '%.age') AS plain FROM ({ARCHIVES}) a GROUP BY archive) f",
)
def e13(spark, sf_dir):
    return L.archive_form(X.view(spark, sf_dir, ARCHIVES_WITH_STRAYS), "binlog")


@register(
    "e14_single_series",
    "SELECT archive, count(DISTINCT series) AS n_series, min(series) AS first_series, CASE WHEN count(DISTINCT series) > 1 THEN 'REFUSED' ELSE 'OK' END AS status "
    f"FROM (SELECT archive, regexp_extract(regexp_replace(name, '\\.age$', ''), '^(.*)\\.[0-9]+$', 1) AS series FROM ({ARCHIVES}) a) s GROUP BY archive",
)
def e14(spark, sf_dir):
    return L.single_series(archives(spark, sf_dir).withColumn("series", N.file_series(F.col("name"), "binlog")))


@register(
    "i6_check_archive_wal",
    f"{WAL_HOLES} SELECT archive, CASE WHEN nxt - 1 = idx + 1 THEN {wal_name_sql('series', 'idx + 1')} ELSE {wal_name_sql('series', 'idx + 1')} || ' .. ' || {wal_name_sql('series', 'nxt - 1')} END AS subject, "
    "'MISSING' AS problem, (nxt - idx - 1) || ' file(s)' AS detail FROM n WHERE nxt > idx + 1 "
    "UNION ALL SELECT archive, name, 'WRONG_SIZE', bytes || ' of ' || (SELECT max(bytes) FROM w) FROM w WHERE bytes <> (SELECT max(bytes) FROM w) "
    "UNION ALL SELECT 'vault', name, 'STRAY', 'not a log file' FROM (SELECT concat('squat-', o_orderpriority, CAST(o_orderkey AS VARCHAR)) AS name FROM {orders} WHERE o_orderstatus = 'P') z",
)
def i6_wal(spark, sf_dir):
    strays = X.load(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(
        F.lit("vault").alias("archive"), F.concat(F.lit("squat-"), "o_orderpriority", F.col("o_orderkey").cast("string")).alias("name"), F.lit(1).cast("bigint").alias("bytes")
    )
    return L.check_archive(wal(spark, sf_dir).select("archive", "name", "bytes").unionByName(strays), "wal")


BINLOG_CHECK = (
    f"WITH a AS ({ARCHIVES}), f AS (SELECT archive, count(*) FILTER (name LIKE '%.age') AS enc, count(*) AS total FROM a GROUP BY archive), "
    "b AS (SELECT a.archive, regexp_extract(regexp_replace(name, '\\.age$', ''), '^(.*)\\.[0-9]+$', 1) AS series, CAST(regexp_extract(regexp_replace(name, '\\.age$', ''), '\\.([0-9]+)$', 1) AS BIGINT) AS idx, "
    "f.enc > 0 AS enc FROM a JOIN f ON a.archive = f.archive WHERE f.enc = 0 OR f.enc = f.total), "
    "n AS (SELECT *, lead(idx) OVER (PARTITION BY archive, series ORDER BY idx) AS nxt FROM b), "
    f"g AS (SELECT archive, idx + 1 AS lo, nxt - 1 AS hi, {series_name_sql('series', '(idx + 1)')} || CASE WHEN enc THEN '.age' ELSE '' END AS first, "
    f"{series_name_sql('series', '(nxt - 1)')} || CASE WHEN enc THEN '.age' ELSE '' END AS last FROM n WHERE nxt > idx + 1) "
    "SELECT archive, CASE WHEN lo = hi THEN first ELSE first || ' .. ' || last END AS subject, 'MISSING' AS problem, (hi - lo + 1) || ' file(s)' AS detail FROM g "
    "UNION ALL SELECT archive, archive, 'MIXED_FORM', 'refused' FROM f WHERE enc > 0 AND enc < total "
    "UNION ALL SELECT archive, archive, 'SEVERAL_SERIES', count(DISTINCT series) || ' series' FROM b GROUP BY archive HAVING count(DISTINCT series) > 1 "
    "UNION ALL SELECT archive, s.name, 'STRAY', 'not a log file' FROM f, (SELECT unnest(['notes.txt', 'old.age']) AS name) s"
)


@register("i6_check_archive_binlog", BINLOG_CHECK)
def i6_binlog(spark, sf_dir):
    return L.check_archive(X.view(spark, sf_dir, ARCHIVES_WITH_STRAYS), "binlog")


# --- binlog archive of FX4 -----------------------------------------------------------

FX4 = f"WITH b AS ({X.BINLOG_INVENTORY})"


def binlogs(spark, sf_dir):
    return X.view(spark, sf_dir, X.BINLOG_INVENTORY)


@register(
    "d13_archive_vs_server",
    f"{FX4} SELECT series, name, CASE WHEN site_sha IS NULL THEN 'NOT_ARCHIVED' WHEN site_sha <> inventory_sha THEN 'ROT' ELSE 'OK' END AS status "
    "FROM b WHERE idx < (SELECT max(idx) FROM b)",
)
def d13(spark, sf_dir):
    b = binlogs(spark, sf_dir)
    active = b.groupBy("series").agg(F.max_by("name", "idx").alias("name"))
    server = b.select("series", "name", F.col("inventory_sha").alias("sha256"))
    archive = b.filter("site_sha IS NOT NULL").select("series", "name", F.col("site_sha").alias("sha256"))
    return L.archive_vs_server(server, archive, active)


@register(
    "e15_purged_gap",
    "WITH a AS (SELECT concat('bin', CAST(o_custkey AS VARCHAR)) AS series, max(o_orderkey) AS newest FROM {orders} GROUP BY 1), "
    "s AS (SELECT concat('bin', CAST(c_custkey AS VARCHAR)) AS series, c_custkey * 10 AS oldest FROM {customer}) "
    "SELECT s.series, newest + 1 AS first, oldest - 1 AS last FROM s JOIN a ON s.series = a.series WHERE oldest > newest + 1",
)
def e15(spark, sf_dir):
    archive = X.load(spark, sf_dir, "orders").select(F.concat(F.lit("bin"), F.col("o_custkey").cast("string")).alias("series"), F.col("o_orderkey").alias("idx"))
    server = X.load(spark, sf_dir, "customer").select(F.concat(F.lit("bin"), F.col("c_custkey").cast("string")).alias("series"), (F.col("c_custkey") * 10).alias("oldest"))
    return L.purged_gap(archive, server)


ARCHIVER = (
    "SELECT concat('srv-', CAST(o_orderkey AS STRING)) AS server, printf('%08X%08X%08X', 1, CAST(floor(o_orderkey / 256) AS BIGINT), o_orderkey % 256) AS current, "
    "CASE WHEN o_orderkey % 13 = 0 THEN CAST(NULL AS STRING) ELSE printf('%08X%08X%08X', 1, CAST(floor((o_orderkey - CASE WHEN o_orderkey % 11 = 0 AND o_orderkey > 3 THEN 3 ELSE 1 END) / 256) AS BIGINT), "
    "(o_orderkey - CASE WHEN o_orderkey % 11 = 0 AND o_orderkey > 3 THEN 3 ELSE 1 END) % 256) END AS last_archived, "
    "o_orderkey % 3 AS failed_count, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS last_failed_time, "
    "CASE WHEN o_orderkey % 17 = 0 THEN CAST(NULL AS BIGINT) ELSE o_orderkey % 1000 END AS last_archived_time FROM {orders}"
)


@register(
    "e16_archiver_backlog",
    f"WITH a AS ({ARCHIVER}), b AS (SELECT *, {wal_index_sql('current')} - {wal_index_sql('last_archived')} - 1 AS behind, "
    "coalesce(last_failed_time IS NOT NULL AND (last_archived_time IS NULL OR last_failed_time > last_archived_time), false) AS failing FROM a), "
    "c AS (SELECT server, behind, CASE WHEN last_archived IS NULL THEN 'NEVER_ARCHIVED' WHEN behind > 0 THEN 'BEHIND' WHEN failing THEN 'FAILING_NOW' "
    "WHEN failed_count > 0 THEN 'HEALED' ELSE 'OK' END AS status FROM b) "
    "SELECT *, status IN ('NEVER_ARCHIVED', 'BEHIND', 'FAILING_NOW') AS problem FROM c",
)
def e16(spark, sf_dir):
    return L.archiver_backlog(X.view(spark, sf_dir, ARCHIVER))


# --- recovery points -------------------------------------------------------------------

PAIRS = (
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 29 = 0 THEN 'dump' ELSE '{base}' END AS base_kind, CASE WHEN o_orderkey % 31 = 0 THEN CAST(NULL AS STRING) ELSE '{mark}' END AS mark_kind, "
    "'app' AS base_db, CASE WHEN o_orderkey % 37 = 0 THEN 'app_prod' ELSE 'app' END AS mark_db, 'binlog' AS base_series, CASE WHEN o_orderkey % 41 = 0 THEN 'mysql-bin' ELSE 'binlog' END AS mark_series, "
    "o_custkey % 10 AS base_idx, CASE WHEN o_orderkey % 43 = 0 THEN CAST(NULL AS BIGINT) ELSE o_orderkey % 10 END AS mark_idx, o_custkey AS base_pos, o_orderkey % 1000 AS mark_pos, "
    "CASE WHEN o_orderkey % 3 = 0 THEN 'no' END AS base_gtid, CASE WHEN o_orderkey % 47 = 0 THEN 'yes' END AS mark_gtid, CASE WHEN o_orderkey % 53 = 0 THEN 0 ELSE 5 END AS inventory_files FROM {orders}"
)
PAIRS_BINLOG = PAIRS.replace("{base}", "binlog-base").replace("{mark}", "binlog-mark")
PAIRS_WAL = PAIRS.replace("{base}", "pitr-base").replace("{mark}", "pitr-mark")


def refusal_sql(flavour: str) -> str:
    binlog = flavour == "binlog"
    base, mark = ("binlog-base", "binlog-mark") if binlog else ("pitr-base", "pitr-mark")
    predates = "mark_idx < base_idx" + (" OR (mark_idx = base_idx AND mark_pos < base_pos)" if binlog else "")
    rules = [
        (f"base_kind IS DISTINCT FROM '{base}'", "base has the wrong kind"),
        (f"mark_kind IS DISTINCT FROM '{mark}'", "mark has the wrong kind"),
        ("base_db <> mark_db", "different databases"),
        ("mark_idx IS NULL", "position fields missing"),
    ]
    if binlog:
        rules.append(("coalesce(base_gtid, 'no') <> coalesce(mark_gtid, 'no')", "different gtid modes"))
    rules += [("base_series <> mark_series", "different series"), (f"base_series = mark_series AND ({predates})", "mark predates base"), ("inventory_files = 0", "mark records no inventory")]
    whens = " ".join(f"WHEN {test} THEN '{text}'" for test, text in rules)
    total = " + ".join(f"CASE WHEN {test} THEN 1 ELSE 0 END" for test, _ in rules)
    return f"SELECT id, CASE {whens} END AS refusal, CAST({total} AS INTEGER) AS n_refusals FROM ({PAIRS_BINLOG if binlog else PAIRS_WAL}) p"


@register("c5_pair_refusals_binlog", refusal_sql("binlog"))
def c5_binlog(spark, sf_dir):
    return L.pair_refusals(X.view(spark, sf_dir, PAIRS_BINLOG), "binlog").select("id", "refusal", F.size("refusals").alias("n_refusals"))


@register("c5_pair_refusals_wal", refusal_sql("wal"))
def c5_wal(spark, sf_dir):
    return L.pair_refusals(X.view(spark, sf_dir, PAIRS_WAL), "wal").select("id", "refusal", F.size("refusals").alias("n_refusals"))


POINTS = f"WITH p AS ({X.RECOVERY_POINTS}), m AS (SELECT * FROM p WHERE kind = 'mark'), b AS (SELECT * FROM p WHERE kind = 'base')"


def points(spark, sf_dir):
    p = X.view(spark, sf_dir, X.RECOVERY_POINTS)
    return p.filter("kind = 'mark'").drop("kind"), p.filter("kind = 'base'").drop("kind")


def reach_sql(flavour: str, bases: str = "b") -> str:
    """Newest reaching base per mark; names grow with positions, but the maximum is taken by name."""
    reach = "b.idx < m.idx OR (b.idx = m.idx AND b.pos <= m.pos)" if flavour == "binlog" else "b.idx <= m.idx"
    return (
        f"SELECT m.db, m.series, m.idx, m.pos, m.name, max(b.name) AS base FROM m LEFT JOIN {bases} b ON m.db = b.db AND m.series = b.series AND ({reach}) "
        "GROUP BY m.db, m.series, m.idx, m.pos, m.name"
    )


REACH_COLS = ["db", "series", "idx", "pos", "name", "base"]


@register("d7_reachable_base_binlog", f"{POINTS} {reach_sql('binlog')}")
def d7_binlog(spark, sf_dir):
    marks, bases = points(spark, sf_dir)
    return L.reachable_base(marks, bases, "binlog").select(*REACH_COLS)


# the same rule when names do not follow positions: the newest name wins, not the nearest position
SHUFFLED = "SELECT db, kind, series, idx, pos, concat(md5(name), name) AS name FROM p"


@register("d7_reachable_base_wal", f"WITH p0 AS ({X.RECOVERY_POINTS}), p AS ({SHUFFLED.replace('FROM p', 'FROM p0')}), m AS (SELECT * FROM p WHERE kind = 'mark'), b AS (SELECT * FROM p WHERE kind = 'base') {reach_sql('wal')}")
def d7_wal(spark, sf_dir):
    marks, bases = points(spark, sf_dir)
    mixed = F.concat(F.md5("name"), "name")
    return L.reachable_base(marks.withColumn("name", mixed), bases.withColumn("name", mixed), "wal").select(*REACH_COLS)


@register("d8_intact_base", f"{POINTS}, i AS (SELECT * FROM b WHERE idx % 3 <> 0) {reach_sql('binlog', 'i')}")
def d8(spark, sf_dir):
    marks, bases = points(spark, sf_dir)
    promised = bases.select("*", F.concat("name", F.lit(".sql")).alias("artefact"), F.md5("name").alias("sha256"))
    found = promised.select("artefact", F.when(F.col("idx") % 3 == 0, F.md5("artefact")).otherwise(F.col("sha256")).alias("sha256"))
    return L.reachable_base(marks, L.intact_base(promised, found), "binlog").select(*REACH_COLS)


NEWEST_POINTS = "SELECT *, row_number() OVER (PARTITION BY db ORDER BY idx DESC) AS rn FROM m"


def stamped(dialect: str) -> str:
    from tableproof.registry.retentions import stamped_points

    return stamped_points(dialect)


@register(
    "i5_pick_latest_pair",
    f"WITH p AS ({stamped('duckdb')}), m0 AS (SELECT * FROM p WHERE kind = 'mark'), b AS (SELECT * FROM p WHERE kind = 'base' AND db <> 'web'), "
    f"m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db ORDER BY name DESC) AS rn FROM m0) z WHERE rn = 1), r AS ({reach_sql('binlog')}) "
    "SELECT db, name AS mark, base, 'AMBIGUOUS' AS status FROM r",
)
def i5(spark, sf_dir):
    p = X.view(spark, sf_dir, stamped("spark"))
    marks, bases = p.filter("kind = 'mark'").drop("kind"), p.filter("kind = 'base' AND db <> 'web'").drop("kind")
    return L.pick_latest_pair(marks, bases, "binlog")


@register(
    "i5_pick_latest_pair_unreachable",
    f"WITH p AS ({stamped('duckdb')}), m AS (SELECT * FROM p WHERE kind = 'mark' AND db = 'web') SELECT 'web' AS db, max(name) AS mark, CAST(NULL AS VARCHAR) AS base, 'UNREACHABLE' AS status FROM m",
)
def i5_unreachable(spark, sf_dir):
    p = X.view(spark, sf_dir, stamped("spark"))
    marks, bases = p.filter("kind = 'mark'").drop("kind"), p.filter("kind = 'base' AND db <> 'web'").drop("kind")
    return L.pick_latest_pair(marks, bases, "binlog", "web")


# --- chains of every mark ----------------------------------------------------------------

CHAIN = (
    f"{POINTS}, r AS ({reach_sql('binlog')}), pairs AS (SELECT r.name AS mark, concat('bin', CAST(r.series AS VARCHAR)) AS series, b.idx AS base_idx, r.idx AS mark_idx "
    "FROM r LEFT JOIN b ON r.base = b.name), "
    "req AS (SELECT mark, series, unnest(range(base_idx, mark_idx + 1)) AS idx FROM pairs WHERE base_idx IS NOT NULL), "
    f"required AS (SELECT mark, series, idx, {series_name_sql('series', 'idx')} AS name FROM req), "
    "inv AS (SELECT mark, name, md5(name) AS sha FROM required WHERE idx % 53 <> 7), "
    "files AS (SELECT DISTINCT name, idx FROM required), "
    "site AS (SELECT name, CASE WHEN idx % 47 = 0 THEN md5(concat(name, 'rot')) ELSE md5(name) END AS sha FROM files WHERE idx % 31 <> 0)"
)


def chain(spark, sf_dir):
    """Pairs, required files, inventories and the site's listing, all from the recovery points. The pairs are written
    once, dealt evenly: each of the others begins with them and makes many rows of each."""
    marks, bases = points(spark, sf_dir)
    pairs = stored(L.reachable_base(marks, bases, "binlog").select(
        F.col("name").alias("mark"), F.concat(F.lit("bin"), F.col("series").cast("string")).alias("series"),
        "base_idx", F.col("idx").alias("mark_idx"), F.lit(False).alias("encrypted"),
    ).repartition("mark"), "chain-pairs")
    required = L.required_chain(pairs, "binlog")
    inventory = required.filter("idx % 53 <> 7").select("mark", "name", F.md5("name").alias("sha256"))
    files = L.chain_files(pairs, "binlog").select("name", "idx")
    rotten = F.when(F.col("idx") % 47 == 0, F.md5(F.concat("name", F.lit("rot")))).otherwise(F.md5("name"))
    site = files.filter("idx % 31 <> 0").select("name", rotten.alias("sha256"))
    return pairs, required, inventory, site


@register("d9_required_chain", f"{CHAIN} SELECT mark, series, idx, name FROM required")
def d9(spark, sf_dir):
    return chain(spark, sf_dir)[1]


@register(
    "h2_required_with_history",
    f"{CHAIN} SELECT mark, series, idx, name FROM required UNION ALL "
    "SELECT DISTINCT mark, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), printf('%08X.history', idx % 5) FROM required",
)
def h2(spark, sf_dir):
    pairs, required, inventory, _ = chain(spark, sf_dir)
    history = required.select("mark", F.expr("printf('%08X.history', idx % 5)").alias("name"), F.lit("").alias("sha256"))
    return L.required_chain(pairs, "binlog", inventory.unionByName(history))


AUDIT_SQL = (
    "SELECT q.mark, q.name, CASE WHEN i.sha IS NULL THEN 'NOT_IN_INVENTORY' WHEN s.name IS NULL THEN 'ABSENT' WHEN i.sha <> s.sha THEN 'DIFFERS' ELSE 'OK' END AS status "
    "FROM (SELECT DISTINCT mark, name FROM required) q LEFT JOIN inv i ON q.mark = i.mark AND q.name = i.name LEFT JOIN site s ON q.name = s.name"
)


@register("d10_audit_chain", f"{CHAIN} {AUDIT_SQL}")
def d10(spark, sf_dir):
    _, required, inventory, site = chain(spark, sf_dir)
    return L.audit_chain(required, inventory, site)


@register(
    "d11_ship_plan",
    f"{CHAIN} SELECT w.name, w.sha AS sha256, CASE WHEN s.name IS NULL THEN 'SHIP' WHEN s.sha = w.sha THEN 'SKIP' ELSE 'RESHIP' END AS action "
    "FROM (SELECT DISTINCT name, sha FROM inv) w LEFT JOIN site s ON w.name = s.name",
)
def d11(spark, sf_dir):
    _, required, inventory, site = chain(spark, sf_dir)
    return L.ship_plan(required, inventory, site)


@register(
    "d12_fetch_plan",
    f"{CHAIN} SELECT q.mark, q.name, CASE WHEN i.sha IS NULL THEN 'REFUSE_UNVOUCHED' WHEN s.name IS NULL THEN 'FETCH' WHEN i.sha = s.sha THEN 'HAVE' ELSE 'REFUSE_OVERWRITE' END AS action "
    "FROM (SELECT DISTINCT mark, name FROM required) q LEFT JOIN inv i ON q.mark = i.mark AND q.name = i.name LEFT JOIN site s ON q.name = s.name",
)
def d12(spark, sf_dir):
    _, required, inventory, site = chain(spark, sf_dir)
    return L.fetch_plan(required, inventory, site)


# --- transaction sets --------------------------------------------------------------------

FX8 = f"WITH t AS (SELECT uuid, lo, hi, applied OR uuid IN ('purchase', 'view') AS applied FROM ({X.TXN_SETS}) z)"
ISLANDS = (
    "SELECT uuid, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(CASE WHEN reached IS NULL OR lo > reached + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY uuid ORDER BY lo, hi) AS island "
    "FROM (SELECT *, max(hi) OVER (PARTITION BY uuid ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {spans}) w) v GROUP BY uuid, island"
)
WIDE = "SELECT uuid, lo, hi + lo % 9 AS hi FROM t"


def txns(spark, sf_dir):
    t = X.view(spark, sf_dir, X.TXN_SETS)
    return t.withColumn("applied", F.col("applied") | F.col("uuid").isin("purchase", "view"))


@register("f6_merge_intervals", f"{FX8} {ISLANDS.replace('{spans}', 't')}")
def f6(spark, sf_dir):
    return T.merge_intervals(txns(spark, sf_dir))


@register("f6_merge_intervals_overlapping", f"{FX8}, w AS ({WIDE}) {ISLANDS.replace('{spans}', 'w')}")
def f6_wide(spark, sf_dir):
    return T.merge_intervals(txns(spark, sf_dir).select("uuid", "lo", (F.col("hi") + F.col("lo") % 9).alias("hi")))


@register(
    "d15_txn_subset",
    f"{FX8} SELECT uuid, CASE WHEN count(*) FILTER (NOT applied) > 0 THEN 'MISSING' ELSE 'OK' END AS status FROM t GROUP BY uuid",
)
def d15(spark, sf_dir):
    t = txns(spark, sf_dir)
    return T.txn_subset(t, t.filter("applied")).select("uuid", "status")


# A wide interval of either set, whose middle only the applied set of the even users lacks: rows follow intervals, not ids.
WIDE_SETS = (
    "SELECT concat('user-', CAST(user_id AS STRING)) AS uuid, 1 AS lo, 1000000000000 + max(event_id) AS hi, "
    "count(DISTINCT event_type) AS kinds FROM {events} GROUP BY user_id"
)


@register(
    "d15_txn_subset_wide",
    f"SELECT uuid, CASE WHEN kinds % 2 = 0 THEN 1 ELSE 0 END AS missing_intervals, CASE WHEN kinds % 2 = 0 THEN 'MISSING' ELSE 'OK' END AS status FROM ({WIDE_SETS}) w",
)
def d15_wide(spark, sf_dir):
    sets = X.view(spark, sf_dir, WIDE_SETS)
    whole = sets.filter("kinds % 2 = 1").select("uuid", "lo", "hi")
    cut = sets.filter("kinds % 2 = 0").select("uuid", F.explode(F.array(
        F.struct("lo", F.lit(500_000_000_000).alias("hi")), F.struct(F.lit(500_000_000_002).alias("lo"), "hi"))).alias("s")).select("uuid", "s.lo", "s.hi")
    return T.txn_subset(sets, whole.unionByName(cut))


@register(
    "d16_skip_applied_wide",
    f"WITH l AS ({X.CHANGE_LOG}) SELECT l.idx, l.pos, l.k, l.gtid_no FROM l JOIN (SELECT user_id, max(event_id) AS top FROM {{events}} GROUP BY user_id) e ON l.k = e.user_id "
    "WHERE NOT (l.gtid_no + 700000000000 <= 700000000000 + e.top // 2 OR l.gtid_no + 700000000000 >= 700000000000 + e.top)",
)
def d16_wide(spark, sf_dir):
    """Every user is a server; the base holds its ids up to a point, a thousand billion of them, and those from its last one on."""
    log = X.view(spark, sf_dir, X.CHANGE_LOG).select("idx", "pos", "k", "gtid_no")
    top = log.groupBy("k").agg(F.max("gtid_no").alias("top"))
    far = F.lit(700_000_000_000)
    held = top.select(F.col("k").alias("uuid"), F.explode(F.array(
        F.struct(F.lit(1).cast("bigint").alias("lo"), (far + F.floor(F.col("top") / 2)).alias("hi")),
        F.struct((far + F.col("top")).alias("lo"), (far * 2).alias("hi")))).alias("s")).select("uuid", "s.lo", "s.hi")
    moved = log.withColumn("_at", F.col("gtid_no") + far)
    return T.skip_applied(moved, held, "k", "_at").drop("_at")


@register(
    "d16_skip_applied",
    f"WITH l AS ({X.CHANGE_LOG}), t AS ({X.TXN_SETS}) SELECT idx, pos, gtid_uuid, gtid_no FROM l WHERE NOT EXISTS "
    "(SELECT 1 FROM t WHERE t.applied AND t.uuid <> 'error' AND t.uuid = l.gtid_uuid AND t.lo = l.gtid_no)",
)
def d16(spark, sf_dir):
    log = X.view(spark, sf_dir, X.CHANGE_LOG).select("idx", "pos", "gtid_uuid", "gtid_no")
    purged = X.view(spark, sf_dir, X.TXN_SETS).filter("applied AND uuid <> 'error'")
    return T.skip_applied(log, purged)
