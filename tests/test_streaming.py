"""Streams against batch, and the rules a stream must not break."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tableproof import fixtures as X
from tableproof.operators import replay as R
from tableproof.operators.fingerprint import fingerprint_sum
from tableproof.streaming import fingerprints_at, stream_changes, stream_silence, watch_arrival
from tableproof.streaming.arrival import BUCKETS
from tableproof.streaming.catalogue import append_batch, bucket_of, name_stream, read_buckets
from tableproof.sources.manifests import write_manifest
from tableproof.streaming import stream_arrival, stream_fingerprint, stream_manifests, stream_staleness


def feed(spark, folder, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").json(str(folder))


def run(stream, name, mode):
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).start()


def test_fingerprint_of_a_growing_table(spark, sf_dir, tmp_path):
    rows = X.load(spark, sf_dir, "conversations")
    folder = str(tmp_path / "rows")
    for part in (0, 1):
        rows.filter(F.col("conv_id") % 2 == part).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = run(stream_fingerprint(stream), "growing", "complete")
    query.processAllAvailable(), query.stop()
    assert spark.table("growing").first() == fingerprint_sum(rows).first()


def test_late_names_never_lower_the_newest(spark, tmp_path):
    ddl = "name string, now bigint"
    feed(spark, tmp_path, [("app_20260909T000000Z.json", X.NOW), ("app_prod_20260801T000000Z.json", X.NOW)], ddl)
    query = run(stream_staleness(spark.readStream.schema(ddl).json(str(tmp_path)), 7), "quiet", "update")
    query.processAllAvailable()
    feed(spark, tmp_path, [("app_20260801T000000Z.json", X.NOW)], ddl)
    query.processAllAvailable()
    feed(spark, tmp_path, [("app_20260801T000000Z.json", X.NOW + 30 * 86400)], ddl)
    query.processAllAvailable(), query.stop()
    seen = [(r["stamp"], r["stale"]) for r in spark.table("quiet").filter("db = 'app'").orderBy("now", "stale").collect()]
    assert seen == [("20260909T000000Z", False), ("20260909T000000Z", False), ("20260909T000000Z", True)]
    assert [r["stale"] for r in spark.table("quiet").filter("db = 'app_prod'").collect()] == [True]


def wait_for(condition, seconds=40):
    end = time.time() + seconds
    while time.time() < end and not condition():
        time.sleep(0.3)
    assert condition()


def test_ciphertext_needs_two_equal_sizes(spark, tmp_path):
    ddl = "name string, size bigint, observed_at bigint"
    feed(spark, tmp_path, [("a", 120, 1), ("b", 90, 1), ("b", 90, 2)], ddl)
    stream = stream_arrival(spark.readStream.schema(ddl).json(str(tmp_path)), 100, True)
    query = run(stream, "growing_files", "append")
    query.processAllAvailable()
    assert spark.table("growing_files").isEmpty()
    feed(spark, tmp_path, [("a", 120, 2)], ddl)
    query.processAllAvailable(), query.stop()
    assert [(r["name"], r["status"]) for r in spark.table("growing_files").collect()] == [("a", "WHOLE")]


def test_a_file_that_never_gets_whole_times_out(spark, tmp_path):
    ddl = "name string, size bigint, observed_at bigint"
    feed(spark, tmp_path, [("b", 90, 1), ("b", 90, 2)], ddl)
    query = run(stream_arrival(spark.readStream.schema(ddl).json(str(tmp_path)), 100, False, 1000), "stuck_files", "append")
    try:  # a pending time-out keeps the query busy, so its output is watched instead of its end
        wait_for(lambda: not spark.table("stuck_files").isEmpty())
    finally:
        query.stop()
    assert [(r["name"], r["status"]) for r in spark.table("stuck_files").collect()] == [("b", "TIMED_OUT")]


def test_names_share_rows_of_state(spark, tmp_path):
    # a call of Python and a row of state per name took a stream of nine million names past every limit
    names, rows = 4000, "'f' || id AS name, CASE WHEN step = 1 THEN 50 WHEN id % 7 = 0 THEN 60 ELSE 100 END AS size"
    looks = spark.range(names).select("id", F.explode(F.array(F.lit(2), F.lit(1), F.lit(3))).alias("step")).cache()
    looks.selectExpr(*rows.split(", "), "CAST(step AS BIGINT) AS observed_at").write.parquet(str(tmp_path / "a"))
    looks.selectExpr(*rows.split(", "), "timestamp_seconds(1789000000 + step) AS observed_at").write.parquet(str(tmp_path / "w"))
    looks.unpersist()
    sources = {k: spark.readStream.schema(f"name string, size int, observed_at {t}").parquet(str(tmp_path / k)) for k, t in (("a", "bigint"), ("w", "timestamp"))}
    streams = {"a": stream_arrival(sources["a"], 100, False), "w": watch_arrival(sources["w"], 100, False, limit_s=60, forget_s=60)}
    for kind, stream in streams.items():
        query = run(stream, f"shared_{kind}", "append")
        query.processAllAvailable()
        held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        query.stop()
        told = spark.table(f"shared_{kind}").filter("status = 'WHOLE' AND size = 100")
        assert told.count() == told.select("name").distinct().count() == sum(1 for i in range(names) if i % 7)
        assert 0 < held <= BUCKETS < names


def test_a_bucket_tells_of_each_name_in_its_own_time(spark, tmp_path):
    ddl = "name string, size bigint, observed_at string"
    stream = watch_arrival(spark.readStream.schema("name string, size bigint, observed_at timestamp").json(str(tmp_path)), 100, False, 20, 60, buckets=1)
    query = run(stream, "one_bucket", "append")
    for looks in ([("a", 5, "00:00:00"), ("b", 5, "00:00:10"), ("c", 100, "00:00:10")], [("d", 5, "00:00:20")], [("b", 100, "00:00:30"), ("c", 100, "00:00:31")]):
        feed(spark, tmp_path, [(n, size, f"2026-09-10 {at}") for n, size, at in looks], ddl)
        query.processAllAvailable()
    query.stop()
    # a is due at 20 s exactly, b is whole at its own limit, c is told of once, d still has time
    assert sorted((r["name"], r["status"]) for r in spark.table("one_bucket").collect()) == [("a", "TIMED_OUT"), ("b", "WHOLE"), ("c", "WHOLE")]


def test_manifests_are_catalogued_once(spark, tmp_path):
    prints = spark.createDataFrame([("t", "0123456789abcdef:3")], "table string, fingerprint string")
    folder, catalogue = tmp_path / "in", str(tmp_path / "catalogue")
    folder.mkdir()
    for stamp in ("20260901T000000Z", "20260902T000000Z"):
        write_manifest(prints, None, {"database": "app"}, f"{folder}/app_{stamp}.json")
        stream_manifests(spark, str(folder), catalogue, str(tmp_path / "state")).awaitTermination()
    stream_manifests(spark, str(folder), catalogue, str(tmp_path / "fresh-state")).awaitTermination()
    rows = spark.read.parquet(catalogue)
    assert rows.count() == 2 and rows.select("name").distinct().count() == 2
    assert rows.first()["tables"] == {"t": "0123456789abcdef:3"}


def test_a_batch_opens_only_the_buckets_of_its_names(spark, tmp_path):
    catalogue = str(tmp_path / "catalogue")
    names = spark.range(400).select(F.concat(F.lit("app_"), F.col("id").cast("string")).alias("name"), F.lit("app").alias("database"))
    append_batch(names, "run", 0, catalogue, 16)
    few = names.filter("name IN ('app_7', 'app_8')").unionByName(names.limit(1).withColumn("name", F.lit("new")))
    touched = {r["b"] for r in few.select(bucket_of("name", 16).alias("b")).collect()}
    opened = read_buckets(spark, catalogue, sorted(touched)).inputFiles()
    assert opened and {int(f.split("bucket=")[1].split("/")[0]) for f in opened} <= touched
    for _ in range(2):  # the second time it replaces itself
        append_batch(few, "run", 1, catalogue, 16)
    append_batch(names, "another-run", 0, catalogue, 16)
    rows = spark.read.parquet(catalogue)
    assert rows.count() == rows.select("name").distinct().count() == 401


def test_silence_is_told_once_and_so_is_the_return(spark, tmp_path):
    ddl = "name string"
    feed(spark, tmp_path, [("app_20260901T000000Z.json",), ("web_20260901T000000Z.json",), ("web_20260801T000000Z.json",)], ddl)
    query = run(stream_silence(spark.readStream.schema(ddl).json(str(tmp_path)), 7, late_days=60), "silent", "append")
    for names in ([("app_20260908T000000Z.json",)], [("app_20260908T000001Z.json",), ("web_20260802T000000Z.json",)], [("app_20260915T000000Z.json",)],
                  [("web_20260916T000000Z.json",)], [("app_20260917T000000Z.json",)]):
        query.processAllAvailable()
        feed(spark, tmp_path, names, ddl)
    query.processAllAvailable(), query.stop()
    # seven days are not too many, one second more is; a late name changes nothing
    assert [(r["db"], r["stamp"], r["status"]) for r in spark.table("silent").collect()] == [("web", "20260901T000000Z", "SILENT"), ("web", "20260916T000000Z", "BACK")]


def test_judged_files_leave_no_state(spark, tmp_path):
    ddl = "name string, size bigint, observed_at timestamp"
    looks = [(n, size, F"2026-09-10 00:00:{s:02d}") for n, size, s in (("a", 50, 0), ("a", 100, 5), ("b", 50, 1), ("c", 7, 30))]
    feed(spark, tmp_path, looks, "name string, size bigint, observed_at string")
    stream = watch_arrival(spark.readStream.schema(ddl).json(str(tmp_path)), 100, False, limit_s=20, forget_s=60)
    query = run(stream, "watched", "append")
    query.processAllAvailable()
    feed(spark, tmp_path, [("d", 100, "2026-09-10 01:00:00")], "name string, size bigint, observed_at string")
    query.processAllAvailable()
    kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    query.stop()
    rows = {(r["name"], r["status"], r["size"]) for r in spark.table("watched").collect()}
    assert rows == {("a", "WHOLE", 100), ("b", "TIMED_OUT", 50), ("c", "TIMED_OUT", 7), ("d", "WHOLE", 100)}
    assert kept <= 3  # the last file and its timer; the others are forgotten


def test_the_ledger_equals_the_replayed_state(spark, tmp_path):
    log = X.view(spark, "/root/testdata/sf0.001", X.CHANGE_LOG).select("idx", "pos", "k", "op", "v")
    base = R.latest_state(log.filter(R.before((3, 0))), ["k"], ["v"])
    for part in (log.filter("idx BETWEEN 3 AND 5"), log.filter("idx BETWEEN 5 AND 7")):  # file 5 comes twice
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    query = run(stream_changes(stream, ["k"], ["v"], base), "ledger", "append")
    query.processAllAvailable(), query.stop()
    got = {r["idx"]: r["fingerprint"] for r in fingerprints_at(spark.table("ledger"), base).collect()}
    want = {i: fingerprint_sum(R.latest_state(log.filter(R.before((i + 1, 0))), ["k"], ["v"]).select("k", "v")).first()["fingerprint"] for i in range(3, 8)}
    assert got == want


@pytest.mark.parametrize("buckets", [1, 7])
def test_keys_share_rows_of_state_in_the_ledger(spark, tmp_path, buckets):
    """A null key, a key of two columns, more rows a bucket than an Arrow batch holds, and a base in the same buckets."""
    log = spark.range(24_000).selectExpr(
        "1 + id div 1000 AS idx", "id % 1000 AS pos", "IF(id % 11 = 0, NULL, id % 701) AS k", "concat('a', id % 3) AS s",
        "CASE WHEN id % 5 = 0 THEN 'D' ELSE 'U' END AS op", "id * 7 AS v")
    ids, held = ["k", "s"], ["k", "s", "v"]
    base = R.latest_state(log.filter("idx < 3"), ids, ["v"])
    for part in (log.filter("idx BETWEEN 3 AND 20"), log.filter("idx BETWEEN 20 AND 24")):  # file 20 comes twice
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    told, state = f"ledger_{buckets}", str(tmp_path / "state")
    query = (stream_changes(stream, ids, ["v"], base, buckets=buckets).writeStream.outputMode("append").format("memory")
             .queryName(told).option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()
    got = {r["idx"]: r["fingerprint"] for r in fingerprints_at(spark.table(told), base).filter("idx IN (3, 20, 24)").collect()}
    want = {i: fingerprint_sum(R.latest_state(log.filter(R.before((i + 1, 0))), ids, ["v"]).select(*held)).first()["fingerprint"] for i in (3, 20, 24)}
    assert got == want
    assert spark.read.format("statestore").option("path", state).option("stateVarName", "rows").load().count() <= buckets


def test_a_batch_of_manifests_is_read_by_few_tasks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(300):
        (folder / f"app+{i}.json").write_text(f'{{"database": "app", "bytes": {i}}}')
    (folder / "broken.json").write_text("{")
    stream = name_stream(spark, str(folder))
    assert stream.columns == ["root", "rel"]
    query = stream_manifests(spark, str(folder), str(tmp_path / "catalogue"), str(tmp_path / "state"))
    query.awaitTermination()
    rows = {r["name"]: (r["database"], r["bytes"]) for r in spark.read.parquet(str(tmp_path / "catalogue")).collect()}
    assert rows == {**{f"app+{i}.json": ("app", i) for i in range(300)}, "broken.json": (None, None)}


def test_names_of_manifests_stay_out_of_the_driver(spark, tmp_path):
    """A look is one row to the driver; of what lies in the folder only new manifests reach a batch, however old their time."""
    folder, catalogue, state = tmp_path / "in", str(tmp_path / "catalogue"), tmp_path / "state"
    with pytest.raises(AnalysisException):
        stream_manifests(spark, str(folder), catalogue, str(state))
    folder.mkdir()

    def catalogued():
        query = stream_manifests(spark, str(folder), catalogue, str(state))
        query.awaitTermination()
        assert sum(p["numInputRows"] for p in query.recentProgress) <= 1
        return spark.read.parquet(catalogue) if (tmp_path / "catalogue").exists() else None

    assert catalogued() is None
    for i in range(40):
        (folder / f"app-{i}.json").write_text(f'{{"bytes": {i}}}')
    assert catalogued().count() == 40
    for name in ("late.json", "_hidden.json", ".hidden.json", "other.txt"):
        (folder / name).write_text('{"bytes": 40}')
    (folder / "app-0.json").write_text('{"bytes": 99}')
    (folder / "empty.json").write_text("")
    (folder / "nested.json").mkdir()
    (folder / "gone.json").symlink_to(folder / "nothing")
    month_ago = time.time() - 30 * 86400
    os.utime(folder / "late.json", (month_ago, month_ago))
    for _ in range(2):
        rows = {r["name"]: r["bytes"] for r in catalogued().collect()}
        assert rows == {f"app-{i}.json": i for i in range(40)} | {"late.json": 40}
    logs = [p for part in ("offsets", "commits", "sources") for p in (state / part).rglob("*") if p.is_file()]
    assert logs and not any(b".json" in p.read_bytes() for p in logs)


def test_a_stream_of_manifests_that_stays(spark, tmp_path):
    folder, catalogue = tmp_path / "in", tmp_path / "catalogue"
    folder.mkdir()
    query = stream_manifests(spark, str(folder), str(catalogue), str(tmp_path / "state"), available_now=False, every="1 second")
    try:
        for n in (1, 2):
            (folder / f"app-{n}.json").write_text("{}")
            wait_for(lambda: query.exception() is None and any(catalogue.glob("bucket=*/batch=*/*.parquet")) and spark.read.parquet(str(catalogue)).count() == n, 60)
    finally:
        query.stop()
