"""Snapshots, publication and instants in temporary folders; each case fails for its own reason."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tableproof import fixtures as X
from tableproof.operators import replay as R
from tableproof.plans import instants as I
from tableproof.plans.verify import latest_manifest, verify_snapshot
from tableproof.registry.fingerprints import digests_of, object_catalog
from tableproof.sources import artefacts as A
from tableproof.sources import manifests as M
from tableproof.sources import snapshots as S
from tableproof.sources.changelog import read_change_log
from tableproof.sources.objects import read_object_catalog

NOW = X.NOW
DAY = 86400


def tables_of(spark, sf_dir):
    return {n: X.load(spark, sf_dir, n) for n in ("orders", "nation", "embeddings")}


@pytest.fixture(scope="module")
def snapshot(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("snap"))
    snap = S.snapshot_tables(tables_of(spark, sf_dir), folder, "app", NOW, objects=digests_of(object_catalog(spark, sf_dir)))
    return snap


def copy_of(snapshot, tmp_path):
    import shutil

    shutil.copytree(snapshot.folder, tmp_path / "copy")
    return S.Snapshot(str(tmp_path / "copy"), snapshot.artefact, snapshot.manifest)


def verdict(proof):
    return proof.verdict.first()["verdict"]


def a_part(folder, table):
    path = os.path.join(folder, table)
    return os.path.join(path, sorted(f for f in os.listdir(path) if f.endswith(".parquet"))[0])


def test_manifest_reads_back(spark, snapshot):
    m = M.with_defaults(M.read_manifests(spark, snapshot.folder)).first()
    assert (m["database"], m["schema"], m["engine"], m["gtid_mode"]) == ("app", 3, "spark", "no")
    assert m["name"] == "app_20260910T120000Z.json" and m["kind"] is None and m["wal"] is None
    rows = {r["entry"]: r["n"] for r in M.manifest_entries(M.read_manifests(spark, snapshot.folder), "tables").collect()}
    assert rows == {"orders": 1500, "nation": 25, "embeddings": 500}
    assert M.manifest_entries(M.read_manifests(spark, snapshot.folder), "objects").count() == 6


def test_manifest_sections_and_odd_keys(spark, tmp_path):
    (tmp_path / "old.json").write_text('{\n  "database": "app",\n  "tables": {".env": "' + "a" * 64 + ':17"},\n  "binlogs": {"binlog.000001": "' + "b" * 64 + ':120"}\n}\n')
    m = M.read_manifests(spark, str(tmp_path))
    t = M.manifest_entries(m, "tables").first()
    assert (t["entry"], t["n"], t["digest"]) == (".env", 17, "a" * 64)
    assert M.manifest_entries(m, "objects").isEmpty()
    assert M.manifest_entries(m, "binlogs").first()["n"] == 120
    assert M.with_defaults(m).first()["fingerprint"] == "md5"


def test_writer_refuses(spark, tmp_path):
    none = spark.createDataFrame([], "table string, fingerprint string")
    bad = spark.createDataFrame([("t", "")], "table string, fingerprint string")
    for df in (none, bad):
        with pytest.raises(M.Refused):
            M.write_manifest(df, None, {"database": "app"}, f"{tmp_path}/m.json")
    assert not os.listdir(tmp_path)


def test_untouched_snapshot_verifies(spark, sf_dir, snapshot):
    proof = verify_snapshot(spark, snapshot.manifest_path, NOW, 7, objects=digests_of(object_catalog(spark, sf_dir)))
    assert proof.stopped_at is None and verdict(proof) == "VERIFIED"
    shown = digests_of(object_catalog(spark, sf_dir))
    assert verdict(verify_snapshot(spark, snapshot.manifest_path, NOW + 30 * DAY, 7, objects=shown)) == "VERIFIED+STALE"
    assert latest_manifest(spark, snapshot.folder) == snapshot.manifest_path


def test_promised_objects_that_are_not_shown_fail(spark, snapshot):
    proof = verify_snapshot(spark, snapshot.manifest_path, NOW)
    failed = [(r["gate"], r["status"]) for r in proof.checks.filter("severity = 'failure'").collect()]
    assert failed == [("objects", "NOT_SUPPLIED")] and verdict(proof) == "FAILED"
    assert [r["status"] for r in proof.checks.filter("gate = 'counters'").collect()] == ["NOT_SUPPLIED"]


def test_lost_objects_fail_while_tables_stand(spark, sf_dir, snapshot):
    lost = digests_of(object_catalog(spark, sf_dir).filter("class <> 'routines'"))
    proof = verify_snapshot(spark, snapshot.manifest_path, NOW, objects=lost)
    failed = [(r["gate"], r["subject"], r["status"]) for r in proof.checks.filter("severity = 'failure'").collect()]
    assert failed == [("objects", "routines", "COUNT_DIFFERS")]


def test_rot_stops_at_the_bytes(spark, snapshot, tmp_path):
    copy = copy_of(snapshot, tmp_path)
    part = a_part(copy.artefact_path, "orders")
    data = bytearray(open(part, "rb").read())
    data[len(data) // 2] ^= 1
    open(part, "wb").write(data)
    proof = verify_snapshot(spark, copy.manifest_path, NOW)
    assert proof.stopped_at == "bytes" and verdict(proof) == "FAILED"
    assert "checksum drift" in proof.checks.first()["status"]


def test_truncation_is_size_drift(spark, snapshot, tmp_path):
    copy = copy_of(snapshot, tmp_path)
    part = a_part(copy.artefact_path, "orders")
    os.truncate(part, os.path.getsize(part) // 2)
    assert "size drift" in verify_snapshot(spark, copy.manifest_path, NOW).checks.first()["status"]


def test_other_copy_is_judged_by_content(spark, sf_dir, snapshot):
    live = tables_of(spark, sf_dir)
    live["orders"] = live["orders"].withColumn("o_custkey", F.when(F.col("o_orderkey") == 5, F.lit(0).cast("bigint")).otherwise(F.col("o_custkey")))
    live["ghost"] = live.pop("nation")
    proof = verify_snapshot(spark, snapshot.manifest_path, NOW, actual=live)
    rows = {r["subject"]: r["status"] for r in proof.checks.filter("gate = 'tables'").collect()}
    assert rows == {"orders": "DIFFERS", "nation": "ABSENT", "ghost": "EXTRA", "embeddings": "OK"}


def test_small_or_existing_snapshot_is_refused(spark, sf_dir, tmp_path):
    tiny = {"nation": X.load(spark, sf_dir, "nation")}
    with pytest.raises(M.Refused, match="floor"):
        S.snapshot_tables(tiny, str(tmp_path), "app", NOW, floor=10**9)
    assert not os.listdir(tmp_path)
    S.snapshot_tables(tiny, str(tmp_path), "app", NOW)
    with pytest.raises(M.Refused, match="never overwritten"):
        S.snapshot_tables(tiny, str(tmp_path), "app", NOW)


def test_publish_then_fetch(spark, sf_dir, snapshot, tmp_path):
    site, out = tmp_path / "site", tmp_path / "out"
    site.mkdir(), out.mkdir()
    S.publish_verified(spark, snapshot.manifest_path, str(site))
    with pytest.raises(M.Refused, match="never overwritten"):
        S.publish_verified(spark, snapshot.manifest_path, str(site))
    got = S.fetch_verified(spark, "app", str(site), str(out))
    shown = digests_of(object_catalog(spark, sf_dir))
    assert verdict(verify_snapshot(spark, got.manifest_path, NOW, objects=shown)) == "VERIFIED"
    with pytest.raises(M.Refused, match="left alone"):
        S.fetch_verified(spark, "app", str(site), str(out))
    with pytest.raises(M.Refused, match="no manifest"):
        S.fetch_verified(spark, "ap", str(site), str(out))
    part = a_part(f"{site}/{got.artefact}", "nation")
    os.truncate(part, 10)
    again = tmp_path / "again"
    again.mkdir()
    with pytest.raises(M.Refused, match="hash back"):
        S.fetch_verified(spark, "app", str(site), str(again))
    assert not os.listdir(again)


def test_files_are_tables(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "config").mkdir(parents=True)
    (tree / ".env").write_text("SECRET=1")
    (tree / "config" / "nginx.conf").write_text("server {}")
    listed = {r["path"]: r["bytes"] for r in A.scan_file_tree(spark, str(tree)).collect()}
    assert listed == {".env": 8, "config/nginx.conf": 9}
    prints = {r["table"]: r["fingerprint"] for r in A.fingerprint_file_tree(spark, str(tree)).collect()}
    assert prints[".env"].endswith(":8") and len(prints[".env"]) == 66
    (tree / 'a"b').write_text("x")
    assert A.scan_file_tree(spark, str(tree)).filter("unrepresentable").count() == 1
    with pytest.raises(ValueError):
        A.fingerprint_file_tree(spark, str(tree))
    assert A.list_artefacts(spark, str(tree), "s").count() == 2


def test_object_catalog(spark):
    spark.sql("CREATE OR REPLACE TEMP VIEW v_probe AS SELECT 1 AS a, 'x' AS b")
    rows = read_object_catalog(spark, "default").filter("name = 'v_probe'").collect()
    assert [(r["class"], r["definition"]) for r in rows] == [("views", "v_probe(a int NOT NULL, b string NOT NULL)")]


# --- instants ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def drill(spark, sf_dir, tmp_path_factory):
    """A log archive of one file per index, a base at (2, 404), a mark at (7, 2504)."""
    root = tmp_path_factory.mktemp("pitr")
    archive, folder = root / "archive", root / "backups"
    archive.mkdir(), folder.mkdir()
    log = X.view(spark, sf_dir, X.CHANGE_LOG).withColumn("tbl", F.lit("accounts")).persist()
    for idx in range(1, 8):
        rows = log.filter(F.col("idx") == idx).toPandas()
        rows.to_parquet(archive / f"binlog.{idx:06d}", index=False)
    base_state = R.latest_state(log.filter(R.before((2, 404))), ["k"], ["v"])
    mark_state = R.latest_state(log.filter(R.before((7, 2504))), ["k"], ["v"])
    base = I.take_base({"accounts": base_state}, str(folder), "app", NOW - 3600, I.LogPoint("binlog.000002", 404))
    at = I.LogPoint("binlog.000007", 2504)
    mark = I.mark_instant({"accounts": mark_state}, lambda: at, str(archive), str(folder), "app", NOW, pause=0.05)
    return base, mark, str(archive), mark_state


KEY = {"accounts": ["k"]}


def test_instant_is_proven(spark, drill):
    base, mark, archive, _ = drill
    proof = I.verify_instant(spark, base, mark, archive, KEY, NOW, 7)
    assert proof.stopped_at is None and verdict(proof) == "VERIFIED"
    assert read_change_log(spark, f"{archive}/binlog.000007", mark=(7, 2504)).count() == 25
    row = M.read_manifests(spark, mark).first()
    assert row["quiesced"] == "yes" and row["binlogs"] is None
    assert I.read_inventory(spark, mark).count() == 7


def test_hole_and_rot_stop_before_the_replay(spark, drill, tmp_path):
    import shutil

    base, mark, archive, _ = drill
    hole = tmp_path / "hole"
    shutil.copytree(archive, hole, ignore=shutil.ignore_patterns("binlog.000004"))
    proof = I.verify_instant(spark, base, mark, str(hole), KEY, NOW)
    assert proof.stopped_at == "presence"
    assert [r["subject"] for r in proof.checks.filter("severity = 'failure'").collect()] == ["binlog.000004"]
    rot = tmp_path / "rot"
    shutil.copytree(archive, rot)
    data = bytearray((rot / "binlog.000005").read_bytes())
    data[len(data) // 2] ^= 1
    (rot / "binlog.000005").write_bytes(data)
    proof = I.verify_instant(spark, base, mark, str(rot), KEY, NOW)
    assert proof.stopped_at == "chain"


def test_mark_refuses(spark, drill, tmp_path):
    _, _, archive, state = drill
    at = I.LogPoint("binlog.000009", 4)
    with pytest.raises(M.Refused, match="does not hold"):
        I.mark_instant({"accounts": state}, lambda: at, archive, str(tmp_path), "app", NOW, limit=0.2, pause=0.05)
    here = I.LogPoint("binlog.000007", 4)
    with pytest.raises(M.Refused, match="purged"):
        I.mark_instant({"accounts": state}, lambda: here, archive, str(tmp_path), "app", NOW, pause=0.05, oldest=I.LogPoint("binlog.000010", 4))
    with pytest.raises(M.Refused, match="no tables"):
        I.mark_instant({}, lambda: here, archive, str(tmp_path), "app", NOW)
    assert not os.listdir(tmp_path)


def test_instant_travels(spark, drill, tmp_path):
    base, mark, archive, _ = drill
    site, out = tmp_path / "site", tmp_path / "out"
    site.mkdir(), out.mkdir()
    plan = I.publish_instant(spark, base, mark, archive, str(site))
    assert {r["action"] for r in plan.collect()} == {"SHIP"} and plan.count() == 6
    assert I.check_site(spark, str(site), NOW, 7).isEmpty()
    assert [r["problem"] for r in I.check_site(spark, str(site), NOW + 30 * DAY, 7).collect()] == ["STALE"]
    got_base, got_mark = I.fetch_instant(spark, "app", str(site), str(out))
    assert verdict(I.verify_instant(spark, got_base, got_mark, str(out), KEY, NOW)) == "VERIFIED"
    with pytest.raises(M.Refused, match="already at the site"):
        I.publish_instant(spark, base, mark, archive, str(site))
    (site / "binlog.000003").unlink()
    (site / "x.part").write_text("")
    assert sorted((r["subject"], r["problem"]) for r in I.check_site(spark, str(site), NOW).collect()) == [("binlog.000003", "ABSENT"), ("x.part", "PUSH_DIED")]


def test_a_write_during_the_fingerprints_is_seen(spark, drill, tmp_path):
    _, _, archive, state = drill
    readings = iter([I.LogPoint("binlog.000007", 4), I.LogPoint("binlog.000007", 2504)])
    mark = I.mark_instant({"accounts": state}, lambda: next(readings), archive, str(tmp_path), "app", NOW, pause=0.05)
    assert M.read_manifests(spark, mark).first()["quiesced"] == "no"


def test_recorded_objects_must_be_shown(spark, sf_dir, drill, tmp_path):
    base, _, archive, state = drill
    at = I.LogPoint("binlog.000007", 2504)
    shown = digests_of(object_catalog(spark, sf_dir))
    mark = I.mark_instant({"accounts": state}, lambda: at, archive, str(tmp_path), "app", NOW, objects=shown, pause=0.05)
    assert verdict(I.verify_instant(spark, base, mark, archive, KEY, NOW)) == "FAILED"
    assert verdict(I.verify_instant(spark, base, mark, archive, KEY, NOW, objects=shown)) == "VERIFIED"
    lost = digests_of(object_catalog(spark, sf_dir).filter("class <> 'routines'"))
    assert verdict(I.verify_instant(spark, base, mark, archive, KEY, NOW, objects=lost)) == "FAILED"


def test_many_small_files_are_many_tasks(spark, tmp_path):
    from tableproof.sources import files

    for i in range(2000):
        (tmp_path / f"f{i:05d}").write_text(str(i))
    hashed = files.hash_files(files.list_files(spark, str(tmp_path)))
    tasks = hashed.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 2000


def test_old_snapshots_go_behind_the_receipt(spark, sf_dir, tmp_path):
    one = {"nation": X.load(spark, sf_dir, "nation")}
    for day in (3, 2, 1):
        S.snapshot_tables(one, str(tmp_path), "app", NOW - day * DAY, floor=0)
    last = S.snapshot_tables(one, str(tmp_path), "app", NOW, floor=0, keep=2)
    kept = sorted(n for n in os.listdir(tmp_path) if n.endswith(".json"))
    assert len(kept) == 2 and kept[-1] == last.manifest and len([n for n in os.listdir(tmp_path) if n[0] != "."]) == 4
    with pytest.raises(M.Refused, match="landed"):
        S.prune_snapshots(spark, str(tmp_path), "app", 1, 0, NOW, f"{tmp_path}/none.json")


# --- instants of the other flavour: segments, a timeline's history, a named target -------------------


def segment(idx: int) -> str:
    return f"00000001{idx // 256:08X}{idx % 256:08X}"


@pytest.fixture(scope="module")
def wal_drill(spark, sf_dir, tmp_path_factory):
    """Segments 254 to 260, so that the number carries over; a base in 255, a name in 260."""
    root = tmp_path_factory.mktemp("wal")
    archive, folder = root / "archive", root / "backups"
    archive.mkdir(), folder.mkdir()
    log = X.view(spark, sf_dir, X.CHANGE_LOG).filter("idx <= 7").withColumn("idx", F.col("idx") + 253)
    log = log.withColumns({"tbl": F.lit("accounts"), "name": F.lit(None).cast("string")}).persist()
    mark = [(260, 2504, "M", "before-deploy")]
    named = log.limit(0).unionByName(spark.createDataFrame(mark, "idx bigint, pos bigint, op string, name string"), allowMissingColumns=True)
    for idx in range(254, 261):
        rows = log.filter(F.col("idx") == idx).unionByName(named.filter(F.col("idx") == idx)).toPandas()
        rows["name"] = rows["name"].astype("string")
        rows["k"], rows["gtid_no"] = rows["k"].astype("Int64"), rows["gtid_no"].astype("Int64")
        rows.to_parquet(archive / segment(idx), index=False)
    (archive / "00000001.history").write_text("1")
    base_state = R.latest_state(log.filter(R.before((255, 0))), ["k"], ["v"])
    mark_state = R.latest_state(log.filter(R.before((260, 2504))), ["k"], ["v"])
    base = I.take_base({"accounts": base_state}, str(folder), "app", NOW - 3600, I.LogPoint(segment(255), flavour="wal"))
    at = I.LogPoint(segment(260), flavour="wal")
    with pytest.raises(M.Refused, match="needs a name"):
        I.mark_instant({"accounts": mark_state}, lambda: at, str(archive), str(folder), "app", NOW, pause=0.05)
    made = I.mark_instant({"accounts": mark_state}, lambda: at, str(archive), str(folder), "app", NOW, pause=0.05, mark_name="before-deploy")
    return base, made, str(archive), mark_state


def test_wal_instant_is_proven_and_travels(spark, wal_drill, tmp_path):
    base, mark, archive, _ = wal_drill
    proof = I.verify_instant(spark, base, mark, archive, KEY, NOW, 7)
    assert proof.stopped_at is None and verdict(proof) == "VERIFIED"
    assert I.read_inventory(spark, mark).count() == 8
    site, out = tmp_path / "site", tmp_path / "out"
    site.mkdir(), out.mkdir()
    plan = I.publish_instant(spark, base, mark, archive, str(site))
    assert {r["name"] for r in plan.collect()} == {*map(segment, range(255, 261)), "00000001.history"}
    assert I.check_site(spark, str(site), NOW, 7).isEmpty()
    got = I.fetch_instant(spark, "app", str(site), str(out), "wal")
    assert verdict(I.verify_instant(spark, *got, str(out), KEY, NOW)) == "VERIFIED"
    os.remove(site / segment(257))
    assert [(r["subject"], r["problem"]) for r in I.check_site(spark, str(site), NOW, 7).collect()] == [(segment(257), "ABSENT")]


def test_a_name_that_is_not_in_the_log(spark, wal_drill, tmp_path):
    base, _, archive, state = wal_drill
    at = I.LogPoint(segment(260), flavour="wal")
    mark = I.mark_instant({"accounts": state}, lambda: at, archive, str(tmp_path), "app", NOW, pause=0.05, mark_name="never")
    proof = I.verify_instant(spark, base, mark, archive, KEY, NOW)
    assert proof.stopped_at == "target" and verdict(proof) == "FAILED"


def test_an_empty_site_proves_nothing(spark, tmp_path):
    (tmp_path / "readme").write_text("x")
    (tmp_path / "odd.json").write_text("{}")
    assert [r["problem"] for r in I.check_site(spark, str(tmp_path), NOW).collect()] == ["NOTHING_PROVEN"]


def test_a_site_of_dumps(spark, sf_dir, snapshot, tmp_path):
    site = tmp_path / "site"
    site.mkdir()
    S.publish_verified(spark, snapshot.manifest_path, str(site))
    assert I.check_site(spark, str(site), NOW).isEmpty()
    part = a_part(f"{site}/{snapshot.artefact}", "nation")
    os.truncate(part, 10)
    assert [(r["subject"], r["problem"]) for r in I.check_site(spark, str(site), NOW).collect()] == [(snapshot.manifest, "ROT")]


def test_old_instants_go_behind_the_receipt(spark, drill, tmp_path):
    base, mark, archive, state = drill
    site = tmp_path / "site"
    site.mkdir()
    I.publish_instant(spark, base, mark, archive, str(site))
    folder = tmp_path / "later"
    folder.mkdir()
    later = I.take_base({"accounts": state}, str(folder), "app", NOW + 10, I.LogPoint("binlog.000007", 2504))
    at = I.LogPoint("binlog.000007", 2504)
    again = I.mark_instant({"accounts": state}, lambda: at, archive, str(folder), "app", NOW + 20, pause=0.05)
    I.publish_instant(spark, later, again, archive, str(site), keep=1, now=NOW + 30)
    left = sorted(os.listdir(site))
    assert not any(n.startswith(base.rsplit("/", 1)[1][:20]) for n in left)
    assert [n for n in left if n.startswith("binlog.")] == ["binlog.000007"]
    assert any(n == again.rsplit("/", 1)[1] for n in left)
