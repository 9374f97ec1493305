"""Audits and plans of chains: odd rows, and what is spread, replayed or shuffled more than once."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tableproof import registry
from tableproof.operators import chain as L
from tableproof.operators.ordered import as_of

registry.load_all()


def test_files_of_all_chains_once(spark):
    pairs = spark.createDataFrame(
        [("a", "bin", 3, 9, False), ("b", "bin", 3, 5, False), ("c", "bin", 4, 11, False), ("c", "bin", 4, 11, False), ("d", "bin", 3, 4, True),
         ("e", "log", 7, 7, False), ("f", "log", 9, 8, False), ("g", "log", None, 8, False)],
        "mark string, series string, base_idx bigint, mark_idx bigint, encrypted boolean")
    want = {tuple(r) for r in L.required_chain(pairs, "binlog").select("series", "idx", "name").collect()}
    got = [tuple(r) for r in L.chain_files(pairs, "binlog").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert ("bin", 4, "bin.000004.age") in want and ("bin", 11, "bin.000011") in want


REQUIRED = [("m", "1"), ("m", "1"), ("m", "2"), ("m", "3"), ("m", "4"), ("m", "5"), ("m", "6"), ("n", "1"), ("n", "7"), ("n", None)]
INVENTORY = [("m", "1", "x"), ("m", "2", "x"), ("m", "3", "x"), ("m", "4", ""), ("m", "5", None), ("n", "1", "y"), ("n", "2", "x"), ("o", "6", "x")]
FILES = [("1", "x"), ("2", "z"), ("4", "x"), ("5", None), ("6", "x"), ("7", None)]


def odd_rows(spark):
    return (spark.createDataFrame(REQUIRED, "mark string, name string"), spark.createDataFrame(INVENTORY, "mark string, name string, sha256 string"),
            spark.createDataFrame(FILES, "name string, sha256 string"))


def test_audit_of_odd_rows(spark):
    got = sorted(((r["mark"], r["name"] or "-"), r["status"]) for r in L.audit_chain(*odd_rows(spark)).collect())
    gone = "NOT_IN_INVENTORY"
    assert got == [(("m", "1"), "OK"), (("m", "2"), "DIFFERS"), (("m", "3"), "ABSENT"), (("m", "4"), gone), (("m", "5"), gone), (("m", "6"), gone),
                   (("n", "-"), gone), (("n", "1"), "DIFFERS"), (("n", "7"), gone)]


def test_plan_of_odd_rows(spark):
    got = sorted(((r["mark"], r["name"] or "-"), r["action"]) for r in L.fetch_plan(*odd_rows(spark)).collect())
    no = "REFUSE_UNVOUCHED"
    assert got == [(("m", "1"), "HAVE"), (("m", "2"), "REFUSE_OVERWRITE"), (("m", "3"), "FETCH"), (("m", "4"), no), (("m", "5"), no), (("m", "6"), no),
                   (("n", "-"), no), (("n", "1"), "REFUSE_OVERWRITE"), (("n", "7"), no)]


def outer_join(capsys, df):
    """The last join of a plan: the first that its text names."""
    df.explain()
    return re.search(r"Join \[([^\]]*)\]", capsys.readouterr().out).group(1)


def test_hashes_of_an_audit_stay_out_of_the_last_join(spark, capsys):
    assert "mark" in outer_join(capsys, L.audit_chain(*odd_rows(spark)))


def test_hashes_of_a_plan_stay_out_of_the_last_join(spark, capsys):
    assert "mark" in outer_join(capsys, L.fetch_plan(*odd_rows(spark)))


def test_shipping_of_odd_rows(spark):
    got = sorted((r["name"], (r["sha256"], r["action"])) for r in L.ship_plan(*odd_rows(spark)).collect())
    assert got == [("1", ("y", "RESHIP")), ("2", ("x", "RESHIP")), ("3", ("x", "SHIP")), ("4", ("", "RESHIP")), ("5", (None, "SKIP"))]


def test_no_chain_of_a_shipping_passes_the_driver(spark, tmp_path, capsys):
    """A few pairs of very long chains: by their estimate the links would be broadcast."""
    spark.range(3).selectExpr("concat('m', id) AS mark", "'bin' AS series", "0L AS base_idx", "id * 20000 AS mark_idx", "false AS encrypted").write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    required = L.required_chain(pairs, "binlog")
    site = L.chain_files(pairs, "binlog").filter("idx % 2 = 0").select("name", F.md5("name").alias("sha256"))
    plan = L.ship_plan(required, required.select("mark", "name", F.md5("name").alias("sha256")), site)
    told = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
    assert told == {"SKIP": 20_001, "SHIP": 20_000}
    plan.explain()
    assert "Broadcast" not in capsys.readouterr().out


@pytest.mark.parametrize("name", ["d10_audit_chain", "d12_fetch_plan"])
def test_pairs_are_found_once(spark, sf_dir, capsys, name):
    registry.QUERIES[name](spark, sf_dir).explain()
    assert "Window" not in capsys.readouterr().out


def test_as_of_without_a_place(spark):
    """Nothing is at or before a row without a position, nor such a row before anything; equal points stay as many."""
    events = spark.createDataFrame([("a", None, 9), ("a", 5, 1), ("a", 7, 4), ("a", 7, 3), (None, 1, 8)], "k string, at bigint, v int")
    points = spark.createDataFrame([("a", 4, "p"), ("a", 5, "q"), ("a", 8, "r"), ("a", 8, "r"), ("a", None, "s"), (None, 2, "t"), ("b", 9, "u")], "k string, at int, id string")
    found = as_of(points, events, ["k"], ["at"], F.col("v"), "v")
    assert found.schema["at"].dataType.simpleString() == "int"
    assert sorted((r["id"], r["v"]) for r in found.collect()) == [("p", None), ("q", 1), ("r", 4), ("r", 4), ("s", None), ("t", None), ("u", None)]
