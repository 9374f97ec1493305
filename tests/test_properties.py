"""What every fingerprint method must and must not notice."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tableproof import fixtures as X
from tableproof.operators import fingerprint as P

METHODS = {
    "sum": lambda df: P.fingerprint_sum(df),
    "sum-values": lambda df: P.fingerprint_sum(df, algo="xxhash64"),
    "tree": lambda df: P.fingerprint_tree(df, depth=2),
    "tree-deep": lambda df: P.fingerprint_tree(df, depth=5),
}


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return X.view(spark, sf_dir, X.CONVERSATIONS_COPY).persist()


@pytest.mark.parametrize("method", METHODS)
def test_order_and_layout_do_not_matter(method, rows):
    take = METHODS[method]
    base = take(rows).first()["fingerprint"]
    assert take(rows.orderBy(F.col("text").desc()).repartition(5)).first()["fingerprint"] == base
    # halves swapped, one row lost, one doubled, one cell edited
    first = rows.first()
    same_row = F.lit(True)
    for c in rows.columns:
        same_row = same_row & F.col(c).eqNullSafe(F.lit(first[c]))
    one = rows.filter(same_row).limit(1)
    assert take(rows.filter(~same_row).unionByName(rows.filter(same_row))).first()["fingerprint"] == base
    prints = {
        base,
        take(rows.filter(~same_row)).first()["fingerprint"],
        take(rows.unionByName(one)).first()["fingerprint"],
        take(rows.unionByName(one).unionByName(one)).first()["fingerprint"],
        take(rows.withColumn("text", F.when(same_row, F.concat("text", F.lit("x"))).otherwise(F.col("text")))).first()["fingerprint"],
        take(rows.withColumn("role", F.when(~same_row, F.col("role")))).first()["fingerprint"],
    }
    assert len(prints) == 6


def test_states_add_up(rows):
    a, b = rows.filter("conv_id % 2 = 0"), rows.filter("conv_id % 2 = 1")
    parts = P.sum_state(P.row_lanes(a)).unionByName(P.sum_state(P.row_lanes(b)))
    assert P.render_state(P.merge_states(parts)).first() == P.fingerprint_sum(rows).first()


def test_the_method_does_not_follow_the_size(rows):
    assert {P.fingerprint_tree(rows.limit(n)).first()["algo"] for n in (0, 1, 1000)} == {"sha256/tree6"}
    assert P.parse_label("sha256/tree6") == ("tree", "sha256", 6)
    assert P.parse_label("md5/sum")[:2] == P.parse_label("md5")[:2] == ("sum", "md5")


def test_many_tables_equal_single_ones(spark, sf_dir):
    tables = {n: X.load(spark, sf_dir, n) for n in ("region", "labels", "embeddings")}
    for method in P.METHODS:
        together = {r["table"]: r["fingerprint"] for r in P.fingerprint_tables(tables, method=method, depth=2).collect()}
        alone = {n: P.fingerprint(df, method, depth=2).first()["fingerprint"] for n, df in tables.items()}
        assert together == alone


def test_the_session_zone_does_not_matter(spark):
    ddl = "SELECT timestamp_micros(1772937000000000 + id * 1800000000) AS t, timestamp_ntz'2026-03-08 00:30:00' + make_dt_interval(0, id) AS n FROM range(6)"
    prints = set()
    for zone in ("America/New_York", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        prints |= {(P.fingerprint_sum(spark.sql(ddl)).first()["digest"], P.fingerprint_sum(spark.sql(ddl), algo="xxhash64").first()["digest"])}
    assert len(prints) == 1
