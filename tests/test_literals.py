"""Small literal cases with a pinned clock; each names the boundary it guards."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tableproof import fixtures as X
from tableproof.functions import digests as D
from tableproof.functions import names as N
from tableproof.functions.canonical import canonical_row
from tableproof.operators import catalog as G
from tableproof.operators import chain as L
from tableproof.operators import compare as C
from tableproof.operators import fingerprint as P
from tableproof.operators import intervals as T
from tableproof.operators import replay as R
from tableproof.operators import retention as K

NOW, DAY = X.NOW, 86400
APP = [f"app_202609{d}T000000Z" for d in ("01", "05", "09", "10")]


def pairs(spark, names, db="app"):
    return spark.createDataFrame([(db, n) for n in names], "db string, name string")


def victims(spark, names, keep, days, now=NOW, db="app"):
    return sorted(r["name"] for r in K.retention_victims(pairs(spark, names, db), keep, days, now).collect())


def named(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


@pytest.mark.parametrize(
    ("names", "keep", "days", "later", "gone"),
    [
        (APP, 2, 0, 0, APP[:2]),
        (APP, 0, 3, 0, APP[:2]),
        (APP, 0, 7, 30, APP[:3]),
        (APP, 3, 1, 0, APP[:1]),
        (APP, 1, 3, 0, APP[:2]),
        (APP[:2] + ["app_prod_20260920T000000Z"], 1, 0, 0, APP[:1]),
        (["app_manual-copy", APP[0], APP[3]], 0, 1, 0, APP[:1]),
        (APP[:1], 0, 1, 400, []),
        (APP, 0, 0, 0, []),
    ],
)
def test_retention(spark, names, keep, days, later, gone):
    assert victims(spark, names, keep, days, NOW + later * DAY) == gone


def test_staleness_is_per_database_and_exact(spark):
    def stale(names, days=7):
        return sorted((r["db"], r["stamp"]) for r in G.stale_databases(named(spark, names), NOW, days).collect())

    assert stale(["app_20260801T000000Z.json", "app_20260909T000000Z.json", "web_20260815T000000Z.json", "web_20260820T000000Z.json"]) == [("web", "20260820T000000Z")]
    assert stale(["app_20260909T000000Z.json", "app_prod_20260801T000000Z.json", "app_prod_20260810T000000Z_full.json"]) == [("app_prod", "20260810T000000Z")]
    assert stale(["a_20260903T120000Z.json", "b_20260903T115959Z.json"]) == [("b", "20260903T115959Z")]
    assert G.stale_databases(named(spark, ["a_20260820T000000Z"]), NOW, 7).first()["age_days"] == 21


def test_window_edge(spark):
    rows = spark.createDataFrame([(NOW - 7 * DAY,), (NOW - 7 * DAY - 1,)], "t bigint")
    got = rows.select(N.past_window(F.col("t"), NOW, 7).alias("p"), N.age_days(F.col("t"), NOW).alias("d")).collect()
    assert [(r["p"], r["d"]) for r in got] == [(False, 7), (True, 7)]


def test_taken_prefers_created_at_and_order_key_prefers_the_stamp(spark):
    rows = spark.createDataFrame([("2026-09-01T00:00:00Z", APP[3]), (None, APP[3]), (None, "x")], "c string, name string")
    got = rows.select(N.taken_at(F.col("c"), F.col("name")).alias("t"), N.order_key(F.col("name"), F.col("c")).alias("k")).collect()
    assert [r["t"] for r in got] == [1788220800, 1788998400, None]
    assert [r["k"] for r in got] == ["20260910T000000Z", "20260910T000000Z", None]


def test_latest_and_ambiguity(spark):
    m = spark.createDataFrame([("app", APP[0], None), ("app_prod", "app_prod_20260905T000000Z", None)], "db string, name string, created_at string")
    assert {r["refused"] for r in G.ambiguous_selection(m).collect()} == {True}
    assert {r["refused"] for r in G.ambiguous_selection(m, "app").collect()} == {False}
    assert {r["name"] for r in G.pick_latest(m).collect()} == {APP[0], "app_prod_20260905T000000Z"}


def test_wal_arithmetic(spark):
    mib = 1024 * 1024
    row = spark.range(1).select(
        N.wal_name("00000001", F.lit(255).cast("bigint"), 16 * mib).alias("a"),
        N.wal_name("00000001", F.lit(256).cast("bigint"), 16 * mib).alias("b"),
        N.wal_name("00000001", F.lit(64).cast("bigint"), 64 * mib).alias("c"),
        N.index_of(F.lit("binlog.000009")).alias("i"),
        N.series_name("mysql-bin", F.lit(7)).alias("s"),
    ).first()
    assert tuple(row) == ("0000000100000000000000FF", "000000010000000100000000", "000000010000000100000000", 9, "mysql-bin.000007")


def test_missing_segment_and_short_segment(spark):
    files = spark.createDataFrame(
        [("a", "0000000100000000000000FE", 16777216), ("a", "000000010000000100000000", 16777216), ("b", "000000010000000100000000", 8388608), ("b", "000000010000000100000001", 16777216)],
        "archive string, name string, bytes bigint",
    )
    got = {(r["archive"], r["subject"], r["problem"], r["detail"]) for r in L.check_archive(files, "wal").collect()}
    assert got == {("a", "0000000100000000000000FF", "MISSING", "1 file(s)"), ("b", "000000010000000100000000", "WRONG_SIZE", "8388608 of 16777216")}


def test_gap_across_block_borders(spark):
    idx = [1, L.GAP_BLOCK - 1, L.GAP_BLOCK, 3 * L.GAP_BLOCK + 5]
    df = spark.createDataFrame([("s", i) for i in idx], "series string, idx bigint")
    got = sorted((r["first"], r["last"]) for r in L.missing_ranges(df).collect())
    assert got == [(2, L.GAP_BLOCK - 2), (L.GAP_BLOCK + 1, 3 * L.GAP_BLOCK + 4)]


POINT = "db string, series string, idx bigint, pos bigint, name string"


def reach(spark, marks, bases, flavour):
    m, b = spark.createDataFrame(marks, POINT), spark.createDataFrame(bases, POINT)
    return {r["name"]: r["base"] for r in L.reachable_base(m, b, flavour).collect()}


def test_reach(spark):
    bases = [("app", "00000001", 0x10, 0, "app_20260901T000000Z_base.json"), ("app", "00000001", 0x20, 0, "app_20260903T000000Z_base.json"), ("app", "00000001", 0x40, 0, "app_20260906T000000Z_base.json")]
    marks = [("app", "00000001", 0x15, 0, "app_20260902T000000Z_mark.json"), ("app", "00000001", 0x30, 0, "app_20260905T000000Z_mark.json")]
    m, b = spark.createDataFrame(marks, POINT), spark.createDataFrame(bases, POINT)
    row = L.pick_latest_pair(m, b, "wal", "app").first()
    assert (row["mark"], row["base"], row["status"]) == (marks[1][4], bases[1][4], "OK")
    other = bases[:1] + [("app", "00000002", 0x12, 0, "app_20260904T000000Z_base.json")]
    assert reach(spark, marks[:1], other, "wal") == {marks[0][4]: bases[0][4]}
    late = [("app", "00000001", 0x50, 0, "app_20260909T000000Z_base.json")]
    assert L.pick_latest_pair(m, spark.createDataFrame(late, POINT), "wal", "app").first()["status"] == "UNREACHABLE"


def test_reach_by_position(spark):
    bases = [("app", "binlog", 2, 157, "b1"), ("app", "binlog", 3, 900, "b2")]
    assert reach(spark, [("app", "binlog", 3, 400, "m")], bases, "binlog") == {"m": "b1"}
    assert reach(spark, [("app", "binlog", 3, 400, "m")], [("app", "binlog", 3, 400, "b1"), ("app", "other", 1, 1, "b9")], "binlog") == {"m": "b1"}


@pytest.mark.parametrize(("oldest", "gap"), [(1, None), (3, None), (4, (3, 3)), (10, (3, 9))])
def test_purged_gap(spark, oldest, gap):
    archive = spark.createDataFrame([("binlog", 1), ("binlog", 2), ("other", 8)], "series string, idx bigint")
    row = L.purged_gap(archive, spark.createDataFrame([("binlog", oldest)], "series string, oldest bigint")).first()
    assert (row and (row["first"], row["last"])) == gap


def test_pair_drift_reports_size_first(spark):
    m = spark.createDataFrame([("s", "a", 99, "x"), ("s", "b", 17, "x"), ("s", "c", 17, "y")], "site string, artefact string, bytes bigint, sha256 string")
    f = spark.createDataFrame([("s", "a", 17, "z"), ("s", "b", 17, "z"), ("s", "c", 17, "y")], "site string, artefact string, bytes bigint, sha256 string")
    assert {r["artefact"]: r["status"] for r in C.pair_integrity(m, f).collect()} == {"a": "SIZE_DRIFT", "b": "CHECKSUM_DRIFT", "c": "OK"}


def test_counters_follow_their_own_rule(spark):
    counters = spark.createDataFrame([("t", 5), ("e", 0), ("n", None)], "tbl string, next_value bigint")
    top = spark.createDataFrame([("t", 5)], "tbl string, max_id bigint")
    assert {r["tbl"]: r["status"] for r in C.counter_probe(counters, top, True).collect()} == {"t": "BEHIND", "e": "BEHIND"}
    assert {r["tbl"]: r["status"] for r in C.counter_probe(counters, top, False).collect()} == {"t": "OK", "e": "OK"}


def test_unusable_fingerprints_are_never_compared(spark):
    e = spark.createDataFrame([("d", "a", ""), ("d", "b", "EMPTY:0"), ("d", "c", "0123456789:3")], "db string, table string, fingerprint string")
    got = {r["table"]: r["status"] for r in C.compare_tables(e, e).collect()}
    assert got == {"a": "UNUSABLE", "b": "OK", "c": "OK"}
    with pytest.raises(Exception, match="unusable fingerprint"):
        e.select(D.require_usable(F.col("fingerprint"), F.col("table")).alias("f")).collect()


def test_archiver(spark):
    rows = [
        ("ok", "000000010000000000000005", "000000010000000000000004", 0, None, 10, None),
        ("never", "000000010000000000000005", None, 4, "x", None, 9),
        ("behind", "000000010000000000000007", "000000010000000000000004", 0, None, 10, None),
        ("failing", "000000010000000000000005", "000000010000000000000004", 2, "x", 10, 11),
        ("healed", "000000010000000000000005", "000000010000000000000004", 2, "x", 12, 11),
    ]
    df = spark.createDataFrame(rows, "server string, current string, last_archived string, failed_count bigint, last_failed string, last_archived_time bigint, last_failed_time bigint")
    assert {r["server"]: r["status"] for r in L.archiver_backlog(df).collect()} == {"ok": "OK", "never": "NEVER_ARCHIVED", "behind": "BEHIND", "failing": "FAILING_NOW", "healed": "HEALED"}


def test_row_modes_collide_where_they_must(spark):
    df = spark.createDataFrame([("1", None, "x"), ("1", "x", None), ("1", "<NULL>", "x")], "a string, b string, c string")
    texts = {m: [r[0] for r in df.select(canonical_row(df, m)).collect()] for m in ("strict", "pg", "mysql", "sqlite")}
    assert texts["pg"][0] == texts["pg"][1] and texts["mysql"][0] == texts["mysql"][2]
    assert len(set(texts["strict"])) == 3 and len(set(texts["sqlite"])) == 3


def test_nested_rows_are_injective(spark):
    ddl = "a array<string>, m map<string,string>, s struct<x:int,y:string>, b binary"
    rows = [(["a", None], {"k": "v"}, (1, None), b"\x00"), ([None, "a"], {"k": "v"}, (1, None), b"\x00"), (["a"], {"k": "v"}, (1, None), b"\x00"),
            (["a", None], {"k": None}, (1, None), b"\x00"), (["a", None], {"k": "v"}, (None, "1"), b"\x00"), (["a", None], {"k": "v"}, None, b"\x00"), (["a", None], {"k": "v"}, (1, None), None)]
    df = spark.createDataFrame(rows, ddl)
    assert df.select(canonical_row(df).alias("r")).distinct().count() == len(rows)
    assert P.row_lanes(df, algo="xxhash64").distinct().count() == len(rows)


def test_float_digit_is_seen(spark):
    a, b = (spark.createDataFrame([(1, [x, 2.0, 3.0])], "id int, v array<float>") for x in (0.1, 0.1000001))
    assert P.fingerprint_sum(a).first()["digest"] != P.fingerprint_sum(b).first()["digest"]


def test_empty_object_and_empty_table(spark):
    import hashlib

    none = hashlib.md5(hashlib.md5(b"").hexdigest().encode()).hexdigest()
    assert spark.range(1).select(P.chunked_digest(F.lit(""), 64)).first()[0] == none
    empty = spark.createDataFrame([], "a int")
    for df in (P.fingerprint_sum(empty), P.fingerprint_tree(empty), P.fingerprint_tables({"t": empty})):
        assert df.first()["fingerprint"] == "EMPTY:0"


def test_replay_target(spark):
    log = spark.createDataFrame([(1, 4, 1, "I", 10), (1, 104, 2, "I", 20), (2, 4, 1, "U", 11), (2, 104, 2, "D", 0)], "idx bigint, pos bigint, k int, op string, v int")
    base = spark.createDataFrame([(9, 90)], "k int, v int")
    got = R.replay_to_mark(base, log, (1, 104), (2, 104), ["k"], ["v"], target="named")
    assert sorted(map(tuple, got.collect())) == [(1, 11), (2, 20), (9, 90)]
    assert R.replay_to_mark(base, log, (1, 4), (9, 9), ["k"], ["v"]).count() == 2
    with pytest.raises(Exception, match="recovery target"):
        R.replay_to_mark(base, log, (1, 4), (9, 9), ["k"], ["v"], target="named").collect()


def test_interval_containment(spark):
    t = spark.createDataFrame([("u", 1, 5), ("u", 6, 9), ("u", 4000, 5000), ("v", 3, 3)], "uuid string, lo bigint, hi bigint")
    assert sorted(map(tuple, T.merge_intervals(t).collect())) == [("u", 1, 9), ("u", 4000, 5000), ("v", 3, 3)]
    held = spark.createDataFrame([("u", 1, 9), ("u", 3999, 4500), ("u", 4501, 6000)], "uuid string, lo bigint, hi bigint")
    assert {r["uuid"]: r["status"] for r in T.txn_subset(t, held).collect()} == {"u": "OK", "v": "MISSING"}


def test_history_and_siblings_survive_pruning(spark):
    bases = spark.createDataFrame([("app", f"app_2026090{d}T000000Z_base.json", "1", 10 * d, 0) for d in (1, 2, 3)], "db string, name string, series string, idx bigint, pos bigint")
    marks = spark.createDataFrame(
        [("app", "app_20260901T120000Z_mark.json", "1", 12, 0), ("app", "app_prod_20260901T120000Z_mark.json", "1", 12, 0), ("app", "app_20260903T120000Z_mark.json", "1", 30, 0)],
        "db string, name string, series string, idx bigint, pos bigint",
    )
    listing = spark.createDataFrame(
        [("app", "f29", "1", 29, "segment"), ("app", "f30", "1", 30, "segment"), ("app", "h", "1", 5, "timeline_history"), ("app", "g", "2", 5, "segment"), ("app", "b", "1", 5, "backup_history")],
        "db string, name string, series string, idx bigint, kind string",
    )
    plan = K.prune_chain(bases, marks, listing, 1, 0, NOW)
    assert sorted(r["name"] for r in plan.collect()) == sorted(["app_20260901T000000Z_base.json", "app_20260902T000000Z_base.json", "app_20260901T120000Z_mark.json", "f29", "b"])
    headless = bases.withColumn("idx", F.when(F.col("idx") < 30, F.col("idx")))
    assert [(r["decision"], r["name"]) for r in K.prune_chain(headless, marks, listing, 1, 0, NOW).collect()] == [("REFUSED", "app_20260903T000000Z_base.json")]
