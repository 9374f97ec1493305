"""Prove that a snapshot, or any copy of it, equals what its manifest was written about."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableproof.operators import catalog as G
from tableproof.operators import compare as C
from tableproof.operators import fingerprint as P
from tableproof.plans.gates import Gate, age_rows, checks, counter_checks, gates_in_cost_order, object_checks, one_check, table_checks
from tableproof.schema import BASE_KIND, MARK_KIND
from tableproof.sources import snapshots as S
from tableproof.sources.manifests import Refused, manifest_entries, read_manifests, recorded_tables


@dataclass(frozen=True)
class Proof:
    verdict: DataFrame
    checks: DataFrame
    stopped_at: str | None


def latest_manifest(spark: SparkSession, folder: str, db: str | None = None) -> str:
    """The newest dump manifest of a folder; refuses when several databases could be meant."""
    dumps = G.by_kind(read_manifests(spark, folder), ["dump"]).withColumn("db", F.col("database")).filter("db IS NOT NULL")
    if db is not None:
        dumps = dumps.filter(F.col("db") == db)
    elif not G.ambiguous_selection(dumps).filter("refused").isEmpty():
        raise Refused(f"{folder} holds manifests of several databases: name one")
    row = G.pick_latest(dumps.select("db", "name", "created_at")).first()
    if row is None:
        raise Refused(f"no manifest in {folder}")
    return f"{folder}/{row['name']}"


def fingerprint_loaded(spark: SparkSession, tables: Mapping[str, DataFrame], db: str,
                       method: tuple[str, str, int]) -> tuple[DataFrame, dict[str, str]]:
    """Fingerprints of the copy by the manifest's method, and why a table has none. All tables are one job. When
    that job dies, the tables are halved until the unreadable ones stand alone, so that they are named
    with their reason and the others are still judged."""
    taken, algo, depth = method
    kept, broken = [], {}

    def take(names: list[str]) -> None:
        try:
            found = P.fingerprint_tables({n: tables[n] for n in names}, db, taken, algo=algo, depth=depth, witness=True)
            kept.extend(tuple(r) for r in found.select("db", "table", "algo", "fingerprint", "octets").collect())
        except Exception as why:  # noqa: BLE001
            if len(names) == 1:
                broken[names[0]] = f"{type(why).__name__}: {str(why).splitlines()[0][:200] if str(why) else ''}"
                return
            take(names[: len(names) // 2])
            take(names[len(names) // 2:])

    if tables:
        take(sorted(tables))
    return spark.createDataFrame(kept, "db string, table string, algo string, fingerprint string, octets bigint"), broken


def verify_snapshot(spark: SparkSession, manifest_path: str, now: int, max_age_days: int = 0,
                    actual: Mapping[str, DataFrame] | None = None, objects: DataFrame | None = None,
                    counters: DataFrame | None = None, maxima: DataFrame | None = None, inclusive: bool = True) -> Proof:
    """Bytes, tables, objects, counters, then age. ``actual`` proves another copy (a replica, a
    restored database) against the manifest; the bytes gate is then skipped, because they are not what
    is being proven. The status of loading is recorded and never trusted."""
    snap, row = S.open_snapshot(spark, manifest_path)
    kinds = {*BASE_KIND.values(), *MARK_KIND.values()}
    if row["kind"] in kinds:
        raise Refused(f"{manifest_path} is a {row['kind']} manifest, not a snapshot")
    db, name = row["database"], snap.manifest
    method = P.parse_label(row["fingerprint"])
    manifest = read_manifests(spark, manifest_path)
    expected = recorded_tables(manifest, db)
    promised = manifest_entries(manifest, "objects").select(F.lit(db).alias("db"), F.col("entry").alias("class"), F.col("value").alias("digest"))

    def bytes_gate() -> DataFrame:
        try:
            S.check_pair(spark, snap, "before loading")
            return one_check(spark, name, "bytes", snap.artefact, "OK", "ok")
        except Refused as why:
            return one_check(spark, name, "bytes", snap.artefact, str(why), "failure")

    loaded: dict[str, DataFrame] = {}

    def load_gate() -> DataFrame:
        tables, broken = S.load_snapshot(spark, manifest_path)
        loaded.update(tables)
        rows = [(name, "load", t, "LOADED", "ok") for t in tables] + [(name, "load", t, "UNREADABLE", "failure") for t in broken]
        return spark.createDataFrame(rows, "snapshot string, gate string, subject string, status string, severity string")

    def tables_gate() -> DataFrame:
        found, broken = fingerprint_loaded(spark, dict(actual) if actual is not None else loaded, db, method)
        rows = table_checks(name, expected, found)
        why = [(name, "load", t, f"UNREADABLE ({w})", "failure") for t, w in broken.items()]
        return rows.unionByName(spark.createDataFrame(why, rows.schema)) if why else rows

    def objects_gate() -> DataFrame:
        if not row["objects"]:
            return one_check(spark, name, "objects", "-", "NOT_RECORDED", "warning")
        if objects is None:  # promised and not shown is not proven
            return one_check(spark, name, "objects", "-", "NOT_SUPPLIED", "failure")
        return object_checks(name, promised, objects)

    gates = [] if actual is not None else [Gate("bytes", bytes_gate), Gate("load", load_gate, refuting=False)]
    gates += [Gate("tables", tables_gate, refuting=False), Gate("objects", objects_gate, refuting=False)]
    if counters is not None and maxima is not None:
        gates.append(Gate("counters", lambda: counter_checks(name, counters, maxima, inclusive), refuting=False))
    else:
        gates.append(Gate("counters", lambda: one_check(spark, name, "counters", "-", "NOT_SUPPLIED", "warning"), refuting=False))
    outcome = gates_in_cost_order(gates)
    ages = None
    if max_age_days > 0:
        ages = age_rows(manifest, now, max_age_days)
        if not ages.filter("taken IS NULL").isEmpty():
            raise Refused(f"{manifest_path} does not say when it was taken")
    return Proof(C.verdict(outcome.checks, ages), outcome.checks, outcome.stopped_at)


__all__ = ["Proof", "checks", "latest_manifest", "verify_snapshot"]
