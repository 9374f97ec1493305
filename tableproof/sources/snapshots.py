"""Snapshots: written, read back, proven, and only then named by a manifest."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tableproof.functions import digests as D
from tableproof.functions import names as N
from tableproof.functions.canonical import quoted
from tableproof.operators import fingerprint as P
from tableproof.operators.catalog import by_kind, newest_manifest
from tableproof.operators.retention import retention_victims
from tableproof.session import settle
from tableproof.sources import files
from tableproof.sources.manifests import Refused, manifest_entries, read_manifests, write_manifest

SUFFIX = ".parquet.d"


@dataclass(frozen=True)
class Snapshot:
    """Where a snapshot lives."""

    folder: str
    artefact: str
    manifest: str

    @property
    def artefact_path(self) -> str:
        return f"{self.folder}/{self.artefact}"

    @property
    def manifest_path(self) -> str:
        return f"{self.folder}/{self.manifest}"


def snapshot_name(db: str, now: int, label: str | None = None) -> str:
    return f"{db}_{N.stamp_text(now)}" + (f"_{label}" if label else "")


def _write_observed(df: DataFrame, path: str, algo: str) -> dict[str, int]:
    """Write a table and take the sum state of exactly the rows that were written, in one pass."""
    names = P.lane_names(algo)
    carried = P.with_lanes(df, algo)
    seen = Observation()
    sums = [F.expr(f"coalesce({D.limb_sum_sql(n, j)}, 0L)").alias(f"{n}_{j}") for n in names for j in range(D.LIMBS)]
    observed = carried.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_octets"), F.lit(0)).cast("bigint").alias("octets"), *sums)
    observed.select(*[quoted(c) for c in df.columns]).write.mode("error").parquet(path)
    return seen.get


def snapshot_tables(tables: Mapping[str, DataFrame], folder: str, db: str, now: int, label: str | None = None,
                    objects: DataFrame | None = None, floor: int = N.ARTEFACT_FLOOR["default"], algo: str = "xxhash64",
                    keep: int = 0, keep_days: int = 0) -> Snapshot:
    """Write every table under a temporary name, read it back, compare what was written with what is
    there, move it into place, and write the manifest last. On any failure nothing plausible stays. With
    ``keep`` or ``keep_days`` older snapshots of the database go once the manifest has landed."""
    if not tables:
        raise Refused("no tables: a manifest that lists nothing proves nothing")
    spark = next(iter(tables.values())).sparkSession
    name = snapshot_name(db, now, label)
    snap = Snapshot(folder, f"{name}{SUFFIX}", f"{name}.json")
    for path in (snap.artefact_path, snap.manifest_path):
        if files.exists(spark, path):
            raise Refused(f"{path} exists: a snapshot is never overwritten")
    part = f"{snap.artefact_path}.part"
    try:
        written = {t: _write_observed(df, f"{part}/{t}", algo) for t, df in sorted(tables.items())}
        back = settle(P.fingerprint_tables({t: spark.read.parquet(f"{part}/{t}") for t in tables}, db, "sum", algo=algo, witness=True))
        promised = P.render_state(_states(spark, written, algo), ["table"], algo, witness=True).select(
            "table", F.col("fingerprint").alias("written"), F.col("octets").alias("written_octets"))
        drift = back.join(promised, "table", "full_outer").filter(
            ~F.col("fingerprint").eqNullSafe(F.col("written")) | ~F.col("octets").eqNullSafe(F.col("written_octets")))
        wrong = sorted(r["table"] for r in drift.select("table").collect())  # names of tables, one row each
        if wrong:
            raise Refused(f"read-back differs from what was written: {wrong}")
        hashed = files.hash_files(files.walk_files(spark, part))
        sha, size, _ = files.tree_fingerprint(hashed)
        if size < floor:
            raise Refused(f"{size} bytes is below the floor of {floor}: not a backup")
        files.rename(spark, part, snap.artefact_path)
        meta = {"database": db, "created_at": _iso(now), "artefact": snap.artefact, "bytes": size, "sha256": sha,
                "engine": "spark", "fingerprint": f"{algo}/sum", "server_version": spark.version}
        write_manifest(back, objects, meta, snap.manifest_path)
    except BaseException:
        files.remove(spark, part)
        if files.exists(spark, snap.artefact_path) and not files.exists(spark, snap.manifest_path):
            files.remove(spark, snap.artefact_path)
        raise
    if keep > 0 or keep_days > 0:
        prune_snapshots(spark, folder, db, keep, keep_days, now, snap.manifest_path)
    return snap


def prune_snapshots(spark: SparkSession, folder: str, db: str, keep: int, keep_days: int, now: int, receipt: str) -> int:
    """Delete the snapshots of a database that retention lets go, artefacts before manifests, and only
    when ``receipt``, the manifest of what replaces them, is there. How many went."""
    if not files.exists(spark, receipt):
        raise Refused(f"{receipt} has not landed: nothing is deleted")
    dumps = by_kind(read_manifests(spark, folder), ["dump"]).filter((F.col("database") == db) & F.col("artefact").isNotNull())
    pairs = dumps.select(F.col("database").alias("db"), "name", "artefact")
    gone = settle(retention_victims(pairs, keep, keep_days, now).join(pairs, ["db", "name"]))
    root = F.lit(files.qualified(spark, folder)).alias("root")
    files.delete_files(gone.select(root, F.col("artefact").alias("rel")))
    return files.delete_files(gone.select(root, F.col("name").alias("rel")))


def _states(spark: SparkSession, written: Mapping[str, Mapping[str, int]], algo: str) -> DataFrame:
    """Observed limb sums as sum states; one row per table."""
    names = P.lane_names(algo)
    rows = [(t, s["n"], s["octets"], *[int(s[f"{n}_{j}"]) for n in names for j in range(D.LIMBS)]) for t, s in written.items()]
    columns = ", ".join(["table string", "n bigint", "octets bigint", *[f"{n}_{j} bigint" for n in names for j in range(D.LIMBS)]])
    limbs = spark.createDataFrame(rows, columns)
    totals = [f"{D.lane_total_sql([f'{n}_{j}' for j in range(D.LIMBS)])} AS {n}" for n in names]
    return limbs.selectExpr("`table`", "n", "octets", *totals)


def _iso(now: int) -> str:
    from datetime import datetime, timezone

    return datetime.fromtimestamp(now, tz=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def open_snapshot(spark: SparkSession, manifest_path: str) -> tuple[Snapshot, DataFrame]:
    """The snapshot a manifest names, and the manifest's row."""
    folder, manifest = manifest_path.rsplit("/", 1)
    row = read_manifests(spark, manifest_path).first()
    if row is None or not row["artefact"]:
        raise Refused(f"{manifest_path} names no artefact")
    return Snapshot(folder, row["artefact"], manifest), row


def load_snapshot(spark: SparkSession, manifest_path: str) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Tables of a snapshot and, for those that cannot be opened, why. A failure is a finding for
    the verdict, not an answer: opening proves nothing about content."""
    snap, _ = open_snapshot(spark, manifest_path)
    entries = manifest_entries(read_manifests(spark, manifest_path), "tables")
    loaded, broken = {}, {}
    for row in entries.select("entry").collect():  # one row per table of the manifest
        table = row["entry"]
        try:
            loaded[table] = spark.read.parquet(f"{snap.artefact_path}/{table}")
        except Exception as error:  # noqa: BLE001  (any reader failure is a finding)
            broken[table] = str(error).splitlines()[0]
    for found in tables_on_disk(spark, snap):
        if found not in loaded and found not in broken:
            loaded[found] = spark.read.parquet(f"{snap.artefact_path}/{found}")
    return loaded, broken


def tables_on_disk(spark: SparkSession, snap: Snapshot) -> list[str]:
    if not files.exists(spark, snap.artefact_path):
        return []
    start = spark.createDataFrame([(files.qualified(spark, snap.artefact_path), "")], "root string, rel string")
    return sorted(r["rel"] for r in files.list_level(start).filter("is_dir").select("rel").collect())


def check_pair(spark: SparkSession, snap: Snapshot, context: str) -> None:
    """The bytes are the ones the manifest was written about, or :class:`Refused`; size drift first."""
    row = read_manifests(spark, snap.manifest_path).first()
    sha, size, _ = files.tree_fingerprint(files.hash_files(files.walk_files(spark, snap.artefact_path)))
    if size != row["bytes"]:
        raise Refused(f"{context}: size drift, {size} bytes lie where {row['bytes']} were recorded")
    if sha != row["sha256"]:
        raise Refused(f"{context}: checksum drift, the hash is not the recorded one")


def publish_verified(spark: SparkSession, manifest_path: str, site: str, keep: int = 0, keep_days: int = 0,
                     now: int | None = None) -> Snapshot:
    """Verify here, copy under a temporary name, hash there, move into place; the manifest comes last
    and is the receipt. A copy that does not hash back is removed. With ``keep`` or ``keep_days`` (and
    ``now``) older copies of the database at the site go behind the receipt."""
    snap, row = open_snapshot(spark, manifest_path)
    check_pair(spark, snap, "before publishing")
    there = Snapshot(site, snap.artefact, snap.manifest)
    for path in (there.artefact_path, there.manifest_path):
        if files.exists(spark, path):
            raise Refused(f"{path} exists: a published name is never overwritten")
    _transfer(spark, snap.artefact_path, there.artefact_path, row["sha256"], "the site's copy")
    _copy_manifest(spark, snap, there)
    if keep > 0 or keep_days > 0:
        if now is None:
            raise ValueError("retention needs the time it is judged at")
        prune_snapshots(spark, site, row["database"], keep, keep_days, now, there.manifest_path)
    return there


def fetch_verified(spark: SparkSession, db: str, site: str, out: str) -> Snapshot:
    """Newest manifest of exactly this database, never over an existing name, hashed after arrival."""
    listing = files.list_files(spark, site).select(F.col("rel").alias("name"))
    newest = newest_manifest(listing, db).first()
    if newest is None or newest["name"] is None:
        raise Refused(f"the site holds no manifest of {db}")
    snap, row = open_snapshot(spark, f"{site}/{newest['name']}")
    here = Snapshot(out, snap.artefact, snap.manifest)
    for path in (here.artefact_path, here.manifest_path):
        if files.exists(spark, path):
            raise Refused(f"{path} exists already and is left alone")
    _transfer(spark, snap.artefact_path, here.artefact_path, row["sha256"], "the fetched copy")
    _copy_manifest(spark, snap, here)
    return here


def _transfer(spark: SparkSession, source: str, target: str, sha: str, what: str) -> None:
    part = f"{target}.part"
    try:
        files.copy_files(files.walk_files(spark, source), part)
        landed, _, _ = files.tree_fingerprint(files.hash_files(files.walk_files(spark, part)))
        if landed != sha:
            raise Refused(f"{what}: its hash back differs from the recorded one, so it was taken away")
        files.rename(spark, part, target)
    except BaseException:
        files.remove(spark, part)
        raise


def _copy_manifest(spark: SparkSession, source: Snapshot, target: Snapshot) -> None:
    one = spark.createDataFrame([(files.qualified(spark, source.folder), source.manifest)], "root string, rel string")
    part_dir = f"{target.folder}/.{target.manifest}.part"
    try:
        files.copy_files(one, part_dir)
        files.rename(spark, f"{part_dir}/{source.manifest}", target.manifest_path)
    finally:
        files.remove(spark, part_dir)
