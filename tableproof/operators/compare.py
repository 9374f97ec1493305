"""The gates: tables, objects, extras, artefact pairs, counters, and the folded verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableproof.functions import digests as D
from tableproof.operators.fingerprint import FOLD_DIGITS, LEAF_DIGITS, leaf_of
from tableproof.operators.objects import digest_count
from tableproof.session import settle


def compare_tables(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Full outer on ``(db, table)`` of two ``db, table, fingerprint`` relations, with ``algo`` and ``octets`` where
    they are known.

    UNUSABLE outranks every other answer: an unusable fingerprint is never compared, nor are two that
    were taken by different methods (FOREIGN_METHOD). Where both sides carry their witness it has a say: as many
    rows of fewer bytes are TRUNCATED, and so are equal digests whose witnesses disagree."""
    def side(df: DataFrame, name: str, mark: str) -> DataFrame:
        label = F.col("algo") if "algo" in df.columns else F.lit(None).cast("string")
        octets = F.col("octets") if "octets" in df.columns else F.lit(None).cast("bigint")
        return df.select("db", "table", F.col("fingerprint").alias(name), F.lit(True).alias(mark), label.alias(f"{mark}_algo"),
                         octets.cast("bigint").alias(f"{mark}_octets"))

    e, a = side(expected, "expected", "_in_e"), side(actual, "actual", "_in_a")
    both = e.join(a, ["db", "table"], "full_outer")
    expected_n = D.fingerprint_count(F.col("expected"))
    actual_n = D.fingerprint_count(F.col("actual"))
    octet_delta = F.col("_in_a_octets") - F.col("_in_e_octets")
    same = F.col("expected") == F.col("actual")
    status = (
        F.when(F.col("_in_e").isNotNull() & ~D.usable_fingerprint(F.col("expected")), "UNUSABLE")
        .when(F.col("_in_a").isNotNull() & ~D.usable_fingerprint(F.col("actual")), "UNUSABLE")
        .when(F.col("_in_a").isNull(), "ABSENT")
        .when(F.col("_in_e").isNull(), "EXTRA")
        .when(F.col("_in_e_algo") != F.col("_in_a_algo"), "FOREIGN_METHOD")
        .when(same & (octet_delta != 0), "TRUNCATED")
        .when(same, "OK")
        .when((expected_n == actual_n) & (octet_delta < 0), "TRUNCATED")
        .otherwise("DIFFERS")
    )
    return both.select(
        "db",
        "table",
        status.alias("status"),
        "expected",
        "actual",
        expected_n.alias("expected_n"),
        actual_n.alias("actual_n"),
        (actual_n - expected_n).alias("row_delta"),
        octet_delta.alias("octet_delta"),
    )


def differing_leaves(expected: DataFrame, actual: DataFrame, keys: Sequence[str] = (), depth: int = LEAF_DIGITS) -> DataFrame:
    """``keys, prefix, expected_n, actual_n`` of the leaves that hold different rows, from two tables of tree levels.

    One join a level, from the root down: a level is compared only below the nodes that differ in the one above, so
    whatever is equal is told by one digest. A leaf that one side lacks has a null count there."""
    depths = [depth]
    while depths[0] > 0:
        depths.insert(0, max(0, depths[0] - FOLD_DIGITS))
    suspects, above = None, 0
    for level in depths:
        def side(df: DataFrame, name: str) -> DataFrame:
            at = df.filter(F.col("depth") == level).select(*keys, "prefix", F.col("n").alias(f"{name}_n"), F.col("digest").alias(f"_{name}"))
            if suspects is None:
                return at
            parents = suspects.select(*keys, F.col("prefix").alias("_parent"))
            return at.withColumn("_parent", F.substring("prefix", 1, above)).join(parents, [*keys, "_parent"], "left_semi").drop("_parent")

        both = side(expected, "expected").join(side(actual, "actual"), [*keys, "prefix"], "full_outer")
        unequal = both.filter(~F.col("_expected").eqNullSafe(F.col("_actual")))
        suspects, above = settle(unequal.select(*keys, "prefix", "expected_n", "actual_n")), level
    return suspects


def differing_rows(expected: DataFrame, actual: DataFrame, leaves: DataFrame, mode: str = "strict", algo: str = "sha256",
                   depth: int = LEAF_DIGITS) -> DataFrame:
    """``side`` and all columns of the rows that only one side has, as often as it has them more.

    Rows of equal leaves are set aside by their own hash before anything is shuffled."""
    def suspected(df: DataFrame) -> DataFrame:
        return leaf_of(df, mode, algo, depth=depth).join(leaves.select("prefix"), "prefix", "left_semi").drop("prefix")

    e, a = suspected(expected), suspected(actual)
    return e.exceptAll(a).select(F.lit("expected").alias("side"), "*").unionByName(a.exceptAll(e).select(F.lit("actual").alias("side"), "*"))


def extra_tables(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Tables only the copy has, named, with both table counts of their database."""
    extra = actual.select("db", "table").join(expected.select("db", "table"), ["db", "table"], "left_anti")
    expected_n = expected.groupBy("db").agg(F.count("*").alias("expected_tables"))
    actual_n = actual.groupBy("db").agg(F.count("*").alias("actual_tables"))
    return (
        extra.join(expected_n, "db", "left")
        .join(actual_n, "db", "left")
        .select("db", "table", F.coalesce("expected_tables", F.lit(0)).alias("expected_tables"), "actual_tables")
    )


def compare_objects(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Only the classes the manifest lists; an absent class counts 0."""
    e = expected.select("db", "class", F.col("digest").alias("expected"))
    a = actual.select("db", "class", F.col("digest").alias("actual"))
    joined = e.join(a, ["db", "class"], "left")
    expected_n = digest_count(F.col("expected"))
    actual_n = F.coalesce(digest_count(F.col("actual")), F.lit(0).cast("bigint"))
    same = F.coalesce(F.col("expected") == F.col("actual"), F.lit(False))
    # an absent class equals an empty expected one: both hold nothing
    nothing = F.col("actual").isNull() & (expected_n == 0)
    status = (
        F.when(same | nothing, "OK")
        .when(expected_n != actual_n, "COUNT_DIFFERS")
        .otherwise("DEFINITION_DIFFERS")
    )
    return joined.select(
        "db", "class", status.alias("status"), expected_n.alias("expected_n"), actual_n.alias("actual_n")
    )


def pair_integrity(manifests: DataFrame, artefacts: DataFrame) -> DataFrame:
    """``site, artefact, bytes, sha256`` promised against found; size drift is reported first."""
    found = artefacts.select(
        "site", "artefact", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha")
    )
    joined = manifests.join(found, ["site", "artefact"], "left")
    status = (
        F.when(F.col("_bytes").isNull() & F.col("_sha").isNull(), "ABSENT")
        .when(~F.col("bytes").eqNullSafe(F.col("_bytes")), "SIZE_DRIFT")
        .when(~F.col("sha256").eqNullSafe(F.col("_sha")), "CHECKSUM_DRIFT")
        .otherwise("OK")
    )
    return joined.select(*manifests.columns, status.alias("status"), F.col("_bytes").alias("found_bytes"))


def key_maxima(rows: DataFrame) -> DataFrame:
    """``tbl, max_id`` of ``tbl, id`` rows; an empty table never appears and counts as 0."""
    return rows.groupBy("tbl").agg(F.max("id").alias("max_id"))


def counter_probe(counters: DataFrame, maxima: DataFrame, inclusive: bool) -> DataFrame:
    """Counters that would collide on the next insert.

    ``inclusive``: the counter is the *next* value and must be above the data; otherwise it is the
    *last* value and must not be below it. Null counters are skipped."""
    value, top = F.col("next_value"), F.coalesce(F.col("max_id"), F.lit(0).cast("bigint"))
    behind = value <= top if inclusive else value < top
    return (
        counters.filter(value.isNotNull())
        .join(maxima, "tbl", "left")
        .select("tbl", "next_value", top.alias("max_id"), F.when(behind, "BEHIND").otherwise("OK").alias("status"))
    )


def problems_of(df: DataFrame, gate: str, subject: str, snapshot: str, severity: str = "failure",
                ok: tuple[str, ...] = ("OK",)) -> DataFrame:
    """Gate output as check rows ``snapshot, gate, subject, status, severity``."""
    return df.select(
        F.lit(snapshot).alias("snapshot"),
        F.lit(gate).alias("gate"),
        F.col(f"`{subject}`").alias("subject"),
        "status",
        F.when(F.col("status").isin(*ok), "ok").otherwise(severity).alias("severity"),
    )


def verdict(checks: DataFrame, ages: DataFrame | None = None) -> DataFrame:
    """Fold check rows per snapshot. No compared table is a failure; a refusal outranks failures;
    staleness (``ages``: ``snapshot, stale``) is judged after the proof and kept beside it."""
    folded = checks.groupBy("snapshot").agg(
        F.count_if(F.col("gate") == "tables").alias("tables_compared"),
        F.count_if(F.col("severity") == "refusal").alias("refusals"),
        F.count_if(F.col("severity") == "failure").alias("failures"),
        F.count_if((F.col("severity") == "failure") & (F.col("gate") == "counters")).alias("write_problems"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    if ages is None:
        folded = folded.withColumn("stale", F.lit(False))
    else:
        folded = folded.join(ages.select("snapshot", "stale"), "snapshot", "left").withColumn(
            "stale", F.coalesce("stale", F.lit(False))
        )
    proved = (F.col("refusals") == 0) & (F.col("failures") == 0) & (F.col("tables_compared") > 0)
    word = (
        F.when(F.col("refusals") > 0, "REFUSED")
        .when(~proved, "FAILED")
        .when(F.col("stale"), "VERIFIED+STALE")
        .otherwise("VERIFIED")
    )
    return folded.select("*", proved.alias("proved"), word.alias("verdict"))
