"""Files whose names are rows, witnesses, descent, intervals by spans, and running sums."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableproof import schema as S
from tableproof.operators import chain as L
from tableproof.operators import compare as C
from tableproof.operators import fingerprint as P
from tableproof.operators import intervals as V
from tableproof.operators.ordered import running_sums
from tableproof.sources import files
from tableproof.sources import manifests as M
from tableproof.sources.scan import scan_parquet, schema_of


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """Three files of ten row groups each; the second lacks a column."""
    root = tmp_path_factory.mktemp("chain")
    for idx in (1, 2, 3):
        table = pa.table({"idx": [idx] * 100, "pos": list(range(0, 1000, 10)), "op": ["U"] * 100, "v": [float(i) for i in range(100)]})
        pq.write_table(table.drop_columns(["v"]) if idx == 2 else table, root / f"log.{idx}", row_group_size=10)
    return str(root)


def named(spark, root, *names):
    return spark.createDataFrame([(files.qualified(spark, root), n, f"mark-{n}") for n in names], "root string, rel string, mark string")


def test_a_chain_is_read_from_its_names(spark, chain):
    schema = schema_of(spark, [f"{chain}/log.1", f"{chain}/log.3"])
    rows = scan_parquet(named(spark, chain, "log.1", "log.2"), schema, keep=["mark"])
    assert rows.count() == 200 and rows.filter("idx = 3").isEmpty()
    assert rows.filter("mark = 'mark-log.2'").agg(F.count("v"), F.count("*")).first() == (0, 100)
    assert rows.filter("mark = 'mark-log.1'").agg(F.sum("v")).first()[0] == sum(range(100))


@pytest.mark.parametrize("low, high, groups", [((1, 500), (1, 700), 2), ((2, 0), (2, 100), 1), ((2, 990), (3, 5), 2), (None, (1, 0), 0), ((4, 0), None, 0), (None, None, 30)])
def test_row_groups_outside_the_bounds_are_not_read(spark, chain, low, high, groups):
    schema = T.StructType([T.StructField("idx", T.LongType()), T.StructField("pos", T.LongType())])
    rows = scan_parquet(named(spark, chain, "log.1", "log.2", "log.3"), schema, low, high)
    assert rows.count() == 10 * groups


def test_an_absent_file_fails_the_read(spark, chain):
    with pytest.raises(Exception, match="log.9"):
        scan_parquet(named(spark, chain, "log.9"), T.StructType([T.StructField("idx", T.LongType())])).count()


def test_hashes_of_artefacts_that_are_rows(spark, tmp_path):
    import hashlib

    (tmp_path / "folder" / "deep").mkdir(parents=True)
    (tmp_path / "folder" / "deep" / "a").write_text("a")
    (tmp_path / "plain.dump").write_text("bytes")
    (tmp_path / "empty").mkdir()
    asked = spark.createDataFrame([("folder",), ("plain.dump",), ("absent",), ("empty",), (None,), ("folder",)], "artefact string")
    got = {r["artefact"]: r["sha256"] for r in files.artefact_hashes(spark, str(tmp_path), asked).collect()}
    assert set(got) == {"folder", "plain.dump"} and got["plain.dump"] == hashlib.sha256(b"bytes").hexdigest()
    assert got["folder"] == files.tree_fingerprint(files.hash_files(files.walk_files(spark, str(tmp_path / "folder"))))[0]


@pytest.mark.parametrize("expected, actual, status", [
    (("aaaaaaaa:3", 30), ("aaaaaaaa:3", 30), "OK"), (("aaaaaaaa:3", None), ("aaaaaaaa:3", 30), "OK"), (("aaaaaaaa:3", 30), ("aaaaaaaa:3", 29), "TRUNCATED"),
    (("aaaaaaaa:3", 30), ("bbbbbbbb:3", 29), "TRUNCATED"), (("aaaaaaaa:3", 30), ("bbbbbbbb:3", 30), "DIFFERS"), (("aaaaaaaa:3", 30), ("bbbbbbbb:3", 31), "DIFFERS"),
    (("aaaaaaaa:3", 30), ("bbbbbbbb:2", 20), "DIFFERS"), (("TRUNCATED", 30), ("aaaaaaaa:3", 30), "UNUSABLE")])
def test_what_a_witness_says(spark, expected, actual, status):
    ddl = "db string, table string, fingerprint string, octets bigint"
    sides = [spark.createDataFrame([("d", "t", *s)], ddl) for s in (expected, actual)]
    assert C.compare_tables(*sides).first()["status"] == status


def test_witnesses_of_all_types_and_methods(spark):
    ddl = "a string, b binary, c array<string>, d map<string,string>, e struct<x:string,y:int>, f int, g array<float>"
    rows = [("añ", b"12", ["x", None], {"k": "vv"}, ("s", 1), 7, [1.0, 2.0]), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, ddl)
    # 3 + 2 + (2 members, 1 byte) + (1 + 1) + (1 + 2) + 1 + 2 members
    assert P.fingerprint_sum(df, algo="xxhash64", witness=True).first()["octets"] == 3 + 2 + 3 + 2 + 3 + 1 + 2
    sums, tree = (P.fingerprint_tables({"t": df}, method=m, algo="md5", witness=True).first()["octets"] for m in ("sum", "tree"))
    assert sums == tree == P.completeness_witness(df).first()["row_octets"]
    assert P.fingerprint_tables({"t": df.limit(0)}, witness=True).first()["octets"] == 0


def test_descent_names_the_leaves_and_rows_that_differ(spark):
    left = spark.range(5000).select("id", (F.col("id") % 7).alias("v"))
    right = left.withColumn("v", F.when(F.col("id").isin(17, 4000), -1).otherwise(F.col("v"))).unionByName(left.filter("id = 5"))
    levels = [P.tree_levels(df, algo="md5", depth=4) for df in (left, right)]
    root = levels[0].filter("depth = 0").first()
    assert f"{root['digest']}:{root['n']}" == P.fingerprint_tree(left, algo="md5", depth=4).first()["fingerprint"]
    leaves = C.differing_leaves(*levels, depth=4)
    changed = left.filter("id IN (17, 4000, 5)").unionByName(right.filter("id IN (17, 4000)"))
    assert {r["prefix"] for r in leaves.collect()} == {r["prefix"] for r in P.leaf_of(changed, algo="md5", depth=4).collect()}
    rows = C.differing_rows(left, right, leaves, algo="md5", depth=4).collect()
    assert sorted((r["side"], r["id"], r["v"]) for r in rows) == [("actual", 5, 5), ("actual", 17, -1), ("actual", 4000, -1), ("expected", 17, 3), ("expected", 4000, 3)]
    assert C.differing_leaves(levels[0], levels[0], depth=4).isEmpty()


def test_spans_hold_what_the_intervals_hold(spark):
    rng = random.Random(5)
    sets = {u: [(lo, lo + rng.choice([0, 1, 14, 15, 16, 17, 300, 70000])) for lo in rng.sample(range(0, 200000), 6)] for u in "abc"}
    sets["wide"] = [(1, 10**12), (2 * 10**12, 2 * 10**12)]
    spans = spark.createDataFrame([(u, lo, hi) for u, s in sets.items() for lo, hi in s], "uuid string, lo bigint, hi bigint")
    points = sorted({p for s in sets.values() for lo, hi in s for p in (lo - 1, lo, (lo + hi) // 2, hi, hi + 1)})
    log = spark.createDataFrame([(u, p) for u in [*sets, "none"] for p in points], "gtid_uuid string, gtid_no bigint")
    left = {tuple(r) for r in V.skip_applied(log, spans).collect()}
    assert left == {(u, p) for u in [*sets, "none"] for p in points if not any(lo <= p <= hi for lo, hi in sets.get(u, []))}
    assert V.aligned_spans(V.merge_intervals(spans.filter("uuid = 'wide'"))).count() < 400


def test_containment_by_predecessor(spark):
    ddl = "uuid string, lo bigint, hi bigint"
    marked = spark.createDataFrame([("a", 1, 10**12), ("b", 5, 9), ("b", 20, 30), ("c", 1, 1)], ddl)
    applied = spark.createDataFrame([("a", 1, 10), ("a", 11, 10**12 + 5), ("b", 1, 8), ("b", 10, 40)], ddl)
    assert {tuple(r) for r in V.txn_missing(marked, applied).collect()} == {("b", 5, 9), ("c", 1, 1)}
    assert {r["uuid"]: (r["missing_intervals"], r["status"]) for r in V.txn_subset(marked, applied).collect()} == {"a": (0, "OK"), "b": (1, "MISSING"), "c": (1, "MISSING")}


def test_sums_run_over_blocks(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id", F.lit(2).cast("bigint").alias("x")).repartition(7)
    for keys in ([], ["k"]):
        rows = running_sums(df, keys, ["id"], ["x"]).collect()
        assert len(rows) == 1000
        assert all(r["x"] == 2 * ((r["id"] + 1) if not keys else r["id"] // 3 + 1) for r in rows)


def test_manifests_of_a_folder_are_read_many_to_a_task(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"app+{i}%20.json").write_text(f'{{"database": "app", "bytes": {i}}}')
    odd = {"two.json": '[{"database": "a"}, {"database": "b"}]', "broken.json": '{"database": ', "empty.json": " \n", "none.json": "[]",
           "typed.json": '{"database": "c", "bytes": "many"}', "_hidden.json": "{}", ".dot.json": "{}", "notes.txt": "{}", "bom.json": "﻿{\"database\": \"d\"}"}
    for name, text in odd.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "below.json").mkdir()
    (tmp_path / "below.json" / "deep.json").write_text("{}")
    as_source = (spark.read.schema(S.MANIFEST_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(str(tmp_path))
                 .select("database", "bytes", M.file_name().alias("name")))
    got = M.read_manifests(spark, str(tmp_path))
    assert sorted(map(str, got.select("database", "bytes", "name").collect())) == sorted(map(str, as_source.collect()))
    assert got.columns[-1] == "name" and got.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert M.read_manifests(spark, str(tmp_path / "two.json")).count() == 2


def test_a_folder_is_listed_slice_by_slice(spark, tmp_path, monkeypatch):
    for i in range(50):
        (tmp_path / f"f{i}").write_text("x" * i)
    (tmp_path / "sub").mkdir()
    (tmp_path / "lost").symlink_to(tmp_path / "nowhere")
    monkeypatch.setattr(files, "SLICE_NAMES", 8)
    system, base = files._arrow_fs(files.qualified(spark, str(tmp_path)))
    slices = list(files._entries(system, base))
    assert max(map(len, slices)) == 8 and sum(map(len, slices)) == 52
    assert {e[0]: e[1:3] for some in slices for e in some} == {**{f"f{i}": (False, i) for i in range(50)}, "sub": (True, 0), "lost": (False, 0)}
    assert list(files._entries(system, f"{base}/nothing")) == []


def test_an_archive_is_not_sorted_in_one_task(spark):
    listing = spark.range(1000).filter("id % 10 <> 3").select(
        F.lit("vault").alias("archive"), F.concat(F.lit("00000001"), F.lpad(F.hex(F.floor(F.col("id") / 256)), 8, "0"), F.lpad(F.hex(F.col("id") % 256), 8, "0")).alias("name"),
        F.when(F.col("id") == 7, 1 << 23).otherwise(1 << 24).cast("bigint").alias("bytes"))
    # rows without a known size, as of a table too large to be broadcast
    found = L.check_archive(spark.createDataFrame(listing.collect(), listing.schema), "wal")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"SortMergeJoin \[archive#\d+\]", plan) is None
    assert {r["problem"]: r["count"] for r in found.groupBy("problem").count().collect()} == {"MISSING": 100, "WRONG_SIZE": 1}
