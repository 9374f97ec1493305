"""Instants: marked, proven, published, fetched, audited at a site.

An archive is a folder of log files named ``<series>.<counter>``, each a parquet file of log rows
``idx, pos, op, key.., values..``. A mark's inventory, one row per archive file, is a table beside the
manifest, because it grows with the archive."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableproof.functions import names as N
from tableproof.operators import catalog as G
from tableproof.operators import chain as L
from tableproof.operators import compare as C
from tableproof.operators import fingerprint as P
from tableproof.operators import intervals as V
from tableproof.operators import replay as R
from tableproof.operators import retention as X
from tableproof.plans.gates import (
    Gate, age_rows, checks, counter_checks, gates_in_cost_order, object_checks, one_check, table_checks,
)
from tableproof.plans.verify import Proof
from tableproof.schema import BASE_KIND, MARK_KIND
from tableproof.session import settle, stored
from tableproof.sources import files
from tableproof.sources import snapshots as S
from tableproof.sources.artefacts import hash_artefacts, list_artefacts
from tableproof.sources.manifests import Refused, manifest_entries, read_manifests, recorded_tables, write_manifest
from tableproof.sources.scan import scan_parquet, schema_of

FLAVOURS = ("binlog", "wal")


@dataclass(frozen=True)
class LogPoint:
    """A log file and the position of the next event in it. A WAL point is a segment; its position is
    that of a named row in the log (``op`` M), so it may be left out."""

    file: str
    pos: int | None = None
    flavour: str = "binlog"
    segment_bytes: int = N.DEFAULT_SEGMENT_BYTES

    @property
    def series(self) -> str:
        return self.file[:8] if self.flavour == "wal" else self.file.rsplit(".", 1)[0]

    @property
    def idx(self) -> int:
        if self.flavour == "wal":
            return int(self.file[8:16], 16) * (N.WAL_SPAN // self.segment_bytes) + int(self.file[16:24], 16)
        return int(self.file.rsplit(".", 1)[1])


def flavour_of(kind: str | None) -> str:
    """The flavour a manifest kind belongs to."""
    for flavour in FLAVOURS:
        if kind in (BASE_KIND[flavour], MARK_KIND[flavour]):
            return flavour
    raise Refused(f"{kind} is neither a base nor a mark")


#: Manifest fields of either flavour: base file, mark file, whether the archive is encrypted.
BASE_FILE = {"binlog": "anchor_file", "wal": "wal_start_file"}
MARK_FILE = {"binlog": "mark_file", "wal": "wal_file"}
ENCRYPTED = {"binlog": "binlogs_encrypted", "wal": "wal_files_encrypted"}


# --- inventories -------------------------------------------------------------------


def archive_files(spark: SparkSession, archive: str, flavour: str = "binlog",
                  segment_bytes: int = N.DEFAULT_SEGMENT_BYTES) -> DataFrame:
    """``series, idx, name, bytes, sha256`` of the log files of an archive; timeline history has no index."""
    hashed = hash_artefacts(spark, archive, archive)
    kind = N.classify_file(F.col("name"), flavour, N.is_encrypted(F.col("name")))
    logs = hashed.filter(kind.isin(L.LOG_KIND[flavour], "timeline_history"))
    return logs.select(N.file_series(F.col("name"), flavour).alias("series"),
                       N.file_index(F.col("name"), flavour, segment_bytes).alias("idx"), "name", "bytes", "sha256")


def inventory_path(manifest_path: str) -> str:
    return manifest_path.removesuffix(".json") + ".inventory"


def read_inventory(spark: SparkSession, manifest_path: str) -> DataFrame:
    """``mark, name, sha256``: the table beside the manifest, else the manifest's own map."""
    mark = manifest_path.rsplit("/", 1)[1]
    if files.exists(spark, inventory_path(manifest_path)):
        return spark.read.parquet(inventory_path(manifest_path)).select(F.lit(mark).alias("mark"), "name", "sha256")
    manifest = read_manifests(spark, manifest_path)
    entries = manifest_entries(manifest, "binlogs").unionByName(manifest_entries(manifest, "wal"))
    return entries.select(F.lit(mark).alias("mark"), F.col("entry").alias("name"), F.col("digest").alias("sha256"))


# --- base and mark -------------------------------------------------------------------


def take_base(tables: Mapping[str, DataFrame], folder: str, db: str, now: int, anchor: LogPoint,
              gtid_mode: str = "no") -> str:
    """A snapshot plus where its replay starts; the base manifest is written behind the snapshot's."""
    spark = next(iter(tables.values())).sparkSession
    snap = S.snapshot_tables(tables, folder, db, now, floor=0)
    row = read_manifests(spark, snap.manifest_path).first()
    path = snap.manifest_path.removesuffix(".json") + f"_{anchor.flavour}base.json"
    prints = recorded_tables(read_manifests(spark, snap.manifest_path), db)
    meta = {"kind": BASE_KIND[anchor.flavour], "database": db, "created_at": row["created_at"], "artefact": snap.artefact, "bytes": row["bytes"],
            "sha256": row["sha256"], "fingerprint": row["fingerprint"], BASE_FILE[anchor.flavour]: anchor.file}
    if anchor.flavour == "wal":
        meta |= {"wal_segment_bytes": anchor.segment_bytes}
    else:
        meta |= {"gtid_mode": gtid_mode, "anchor_pos": anchor.pos}
    write_manifest(prints, None, meta, path)
    return path


def await_whole(spark: SparkSession, archive: str, name: str, limit: float = 90.0, pause: float = 1.0, looks: int = 2,
                clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
    """Wait until the file, or its encrypted form, has had one size for ``looks`` looks in a row. The limit runs from the first
    look, however the file grows; past it the mark is refused."""
    began, size, same = clock(), None, 0
    while True:
        row = list_artefacts(spark, archive, archive).filter(N.bare_name(F.col("name")) == name).agg(F.max("bytes").alias("n")).first()
        same = same + 1 if row["n"] is not None and row["n"] == size else 1
        size = row["n"]
        if size is not None and same >= looks:
            return
        if clock() - began >= limit:
            raise Refused(f"the archive does not hold {name}" + ("" if size is None else " whole"))
        sleep(pause)


def prepare_mark(tables: Mapping[str, DataFrame], position: Callable[[], LogPoint], folder: str, db: str, now: int,
                 gtid_mode: str = "no", gtid_executed: str | None = None, objects: DataFrame | None = None,
                 algo: str = "xxhash64", mark_name: str | None = None) -> str:
    """The part of a mark that cannot wait: the log position is read, fingerprints and objects are computed and written,
    and the position is read again; only if it stood still was the source quiesced. What was found is kept under
    ``folder/pending`` until the mark's own log file is whole."""
    spark = next(iter(tables.values())).sparkSession if tables else None
    if spark is None:
        raise Refused("no tables: an instant that lists nothing proves nothing")
    before = position()
    flavour = before.flavour
    if flavour == "wal" and not mark_name:
        raise Refused("a WAL mark needs a name: without one the end of recovery is not known")
    prints = settle(P.fingerprint_tables(tables, db, "sum", algo=algo, witness=True))
    objects = None if objects is None else settle(objects)
    after = position()
    name = f"{S.snapshot_name(db, now)}_{flavour}mark.json"
    pending = f"{folder}/{PENDING}/{name}"
    for path in (f"{folder}/{name}", pending):
        if files.exists(spark, path):
            raise Refused(f"{path} exists")
    meta = {"kind": MARK_KIND[flavour], "database": db, "created_at": S._iso(now), "fingerprint": f"{algo}/sum",
            "quiesced": "yes" if before == after else "no", MARK_FILE[flavour]: after.file}
    if flavour == "wal":
        meta |= {"mark_name": mark_name, "wal_segment_bytes": after.segment_bytes}
    else:
        meta |= {"gtid_mode": gtid_mode, "gtid_executed": gtid_executed, "mark_pos": after.pos}
    write_manifest(prints, objects, meta, pending)
    return pending


#: Where marks lie that wait for their log file, below the folder of the finished ones.
PENDING = "pending"


def finish_mark(spark: SparkSession, pending: str, archive: str, oldest: LogPoint | None = None) -> str:
    """The inventory of every archive file of a pending mark's series up to it, then its manifest. Refuses a mixed
    archive, a purged gap and an archive that does not hold the mark's own file."""
    row = read_manifests(spark, pending).first()
    flavour = flavour_of(row["kind"])
    segment = row["wal_segment_bytes"] or N.DEFAULT_SEGMENT_BYTES
    after = LogPoint(row[MARK_FILE[flavour]], row["mark_pos"], flavour, segment)
    listing = list_artefacts(spark, archive, archive).withColumnRenamed("site", "archive")
    form = L.archive_form(listing, flavour).first()
    if form is None or form["encrypted"] + form["plain"] == 0:
        raise Refused(f"{archive} holds no log files")
    if form["form"] == "MIXED":
        raise Refused(f"{archive} mixes plain and encrypted files")
    found = archive_files(spark, archive, flavour, segment)
    found = found.filter(F.col("idx").isNull() | (F.col("series") == after.series) & (F.col("idx") <= after.idx))
    found = settle(found)
    if oldest is not None:
        server = spark.createDataFrame([(oldest.series, oldest.idx)], "series string, oldest bigint")
        gap = L.purged_gap(found, server).first()
        if gap is not None:
            raise Refused(f"files {gap['first']} to {gap['last']} were purged before the archive got them")
    if found.filter(F.col("idx") == after.idx).isEmpty():
        raise Refused(f"the archive does not hold {after.file}")
    folder, name = pending.rsplit(f"/{PENDING}/", 1)
    path = f"{folder}/{name}"
    if files.exists(spark, path):
        raise Refused(f"{path} exists")
    kept = {f: row[f] for f in ("kind", "database", "created_at", "fingerprint", "quiesced", "mark_name", "wal_segment_bytes", "gtid_mode",
                                "gtid_executed", "mark_pos", MARK_FILE[flavour]) if row[f] is not None}
    kept[ENCRYPTED[flavour]] = "yes" if form["form"] == "encrypted" else "no"
    manifest = read_manifests(spark, pending)
    objects = manifest_entries(manifest, "objects").select(F.col("entry").alias("class"), F.col("value").alias("digest")) if row["objects"] else None
    try:
        found.select("name", "bytes", "sha256").write.mode("error").parquet(inventory_path(path))
        write_manifest(settle(recorded_tables(manifest, row["database"])), objects, kept, path)
    except BaseException:
        if not files.exists(spark, path):
            files.remove(spark, inventory_path(path))
        raise
    files.remove_last(spark, pending)
    return path


def mark_instant(tables: Mapping[str, DataFrame], position: Callable[[], LogPoint], archive: str, folder: str, db: str,
                 now: int, oldest: LogPoint | None = None, gtid_mode: str = "no", gtid_executed: str | None = None,
                 objects: DataFrame | None = None, algo: str = "xxhash64", limit: float = 90.0, pause: float = 1.0,
                 mark_name: str | None = None) -> str:
    """Record an instant in one go: prepare it, look at the archive until the mark's own file is whole, finish it. A mark
    that is refused leaves nothing behind. Where many marks wait, or long, see :func:`stream_marks`."""
    pending = prepare_mark(tables, position, folder, db, now, gtid_mode, gtid_executed, objects, algo, mark_name)
    spark = next(iter(tables.values())).sparkSession
    try:
        row = read_manifests(spark, pending).first()
        await_whole(spark, archive, row[MARK_FILE[flavour_of(row["kind"])]], limit, pause)
        return finish_mark(spark, pending, archive, oldest)
    except BaseException:
        files.remove_last(spark, pending)
        raise


def complete_marks(arrivals: DataFrame, folder: str, archive: str) -> DataFrame:
    """``mark, file, status`` of the pending marks of a folder whose log file is told of: a WHOLE file finishes its marks
    (MARKED, or REFUSED with the reason), one that TIMED_OUT refuses them. ``arrivals``: ``name, status``. Marks are a
    handful, one a database and time; arrivals may be many and meet them in a join."""
    spark = arrivals.sparkSession
    outcome = "mark string, file string, status string"
    if not files.exists(spark, f"{folder}/{PENDING}"):
        return spark.createDataFrame([], outcome)
    waiting = read_manifests(spark, f"{folder}/{PENDING}").select(
        F.col("name").alias("mark"), F.coalesce(*[F.col(c) for c in MARK_FILE.values()]).alias("file"))
    told = arrivals.select(N.bare_name(F.col("name")).alias("file"), "status").distinct()
    rows = []
    for r in waiting.join(told, "file").collect():
        pending = f"{folder}/{PENDING}/{r['mark']}"
        status = r["status"]
        if status == "WHOLE":
            try:
                finish_mark(spark, pending, archive)
                status = "MARKED"
            except Refused as why:
                status = f"REFUSED: {why}"
        if status != "MARKED":
            files.remove_last(spark, pending)
        rows.append((r["mark"], r["file"], status))
    return spark.createDataFrame(rows, outcome)


def stream_marks(arrivals: DataFrame, folder: str, archive: str, out: str, checkpoint: str, available_now: bool = True):
    """Finish pending marks as the stream of arrivals (``name, status``, see ``watch_arrival``) tells of their files; the
    outcomes go to the Parquet table ``out``. Nobody looks at the archive meanwhile."""

    def finish(batch: DataFrame, batch_id: int) -> None:
        told = settle(batch)  # the stream's state is committed by running all of a batch, whoever is waiting
        complete_marks(told, folder, archive).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = arrivals.writeStream.outputMode("append").foreachBatch(finish).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# --- one pair ------------------------------------------------------------------------


def pair_row(spark: SparkSession, base_path: str, mark_path: str, flavour: str) -> DataFrame:
    """Base and mark side by side, as the refusals read them."""
    def side(path: str, prefix: str, file: str, pos: str | None) -> DataFrame:
        m = read_manifests(spark, path)
        segment = F.coalesce("wal_segment_bytes", F.lit(N.DEFAULT_SEGMENT_BYTES))
        return m.select(
            F.lit(1).alias("_one"), F.col("kind").alias(f"{prefix}_kind"), F.col("database").alias(f"{prefix}_db"),
            N.file_series(F.col(file), flavour).alias(f"{prefix}_series"), N.file_index(F.col(file), flavour, segment).alias(f"{prefix}_idx"),
            (F.col(pos) if pos else F.lit(None).cast("bigint")).alias(f"{prefix}_pos"), F.col("gtid_mode").alias(f"{prefix}_gtid"),
        )

    n = read_inventory(spark, mark_path).agg(F.count("*")).scalar()
    positions = ("anchor_pos", "mark_pos") if flavour == "binlog" else (None, None)
    base, mark = side(base_path, "base", BASE_FILE[flavour], positions[0]), side(mark_path, "mark", MARK_FILE[flavour], positions[1])
    return base.join(mark, "_one").drop("_one").withColumn("inventory_files", n)


def sound_pair(spark: SparkSession, base_path: str, mark_path: str):
    """The pair's positions and its flavour, or a refusal; the mark's kind names the flavour."""
    mark = read_manifests(spark, mark_path).first()
    if mark is None:
        raise Refused("a manifest is missing")
    flavour = flavour_of(mark["kind"])
    row = L.pair_refusals(pair_row(spark, base_path, mark_path, flavour), flavour).first()
    if row is None or row["refusal"]:
        raise Refused(row["refusal"] if row else "a manifest is missing")
    return row, flavour


def chain_of(spark: SparkSession, pair, mark_path: str, flavour: str) -> tuple[DataFrame, DataFrame]:
    """Required files of one pair, and the mark's inventory."""
    row = read_manifests(spark, mark_path).first()
    mark = mark_path.rsplit("/", 1)[1]
    pairs = spark.createDataFrame([(mark, pair["mark_series"], pair["base_idx"], pair["mark_idx"], row[ENCRYPTED[flavour]] == "yes")],
                                  "mark string, series string, base_idx bigint, mark_idx bigint, encrypted boolean")
    inventory = read_inventory(spark, mark_path)
    return L.required_chain(pairs, flavour, inventory, row["wal_segment_bytes"] or N.DEFAULT_SEGMENT_BYTES), inventory


def verify_instant(spark: SparkSession, base_path: str, mark_path: str, archive: str, key: Mapping[str, Sequence[str]],
                   now: int, max_age_days: int = 0, purged: DataFrame | None = None, objects: DataFrame | None = None,
                   counters: DataFrame | None = None, maxima: DataFrame | None = None, inclusive: bool = True) -> Proof:
    """Refusals, the base's bytes, the chain's presence and bytes, the replay's content, schema objects, the applied
    transactions, counters, then age. Nothing is replayed once an earlier gate has refuted the pair. ``key`` names
    the key columns per table; the log tells tables apart by its column ``tbl``. Objects that the mark
    recorded and nobody shows are a failure."""
    pair, flavour = sound_pair(spark, base_path, mark_path)
    mark_name = mark_path.rsplit("/", 1)[1]
    base_row, mark_row = read_manifests(spark, base_path).first(), read_manifests(spark, mark_path).first()
    base = S.Snapshot(base_path.rsplit("/", 1)[0], base_row["artefact"], base_path.rsplit("/", 1)[1])
    db, (method, algo, depth) = mark_row["database"], P.parse_label(mark_row["fingerprint"])
    required, inventory = chain_of(spark, pair, mark_path, flavour)
    anchor = (pair["base_idx"], pair["base_pos"] or 0)

    def bytes_gate() -> DataFrame:
        try:
            S.check_pair(spark, base, "base")
            return one_check(spark, mark_name, "bytes", base.artefact, "OK", "ok")
        except Refused as why:
            return one_check(spark, mark_name, "bytes", base.artefact, str(why), "failure")

    def presence_gate() -> DataFrame:
        here = list_artefacts(spark, archive, archive).select("name", F.lit(True).alias("_held"))
        status = F.when(F.col("_held").isNull(), "ABSENT").otherwise("OK")
        return checks(required.join(here, "name", "left").select("name", status.alias("status")), mark_name, "presence", "name")

    def chain_gate() -> DataFrame:
        return checks(L.audit_chain(required, inventory, hash_artefacts(spark, archive, archive, required)), mark_name, "chain", "name")

    def chain_log(low: R.Position | None = None, high: R.Position | None = None, first: int | None = None) -> DataFrame:
        """Rows of the chain's own files and no others, from the table of their names."""
        names = required.filter("idx IS NOT NULL").select("idx", F.col("name").alias("rel")).distinct()
        ends = names.agg(F.min_by("rel", "idx"), F.max_by("rel", "idx")).first()
        schema = schema_of(spark, [f"{archive}/{n}" for n in dict.fromkeys(ends)])
        if first is not None:
            names = names.filter(F.col("idx") >= first)
        sized = files.list_files(spark, archive).select("root", "rel", "bytes").join(names.select("rel"), "rel", "left_semi")
        return scan_parquet(sized.select("root", "rel", "bytes"), schema, low, high)

    def target() -> R.Position | None:
        """Where the replay ends: the recorded position, or that of the named row in the mark's own segment."""
        if flavour == "binlog":
            return pair["mark_idx"], pair["mark_pos"]
        named = chain_log((pair["mark_idx"], 0), first=pair["mark_idx"]).filter((F.col("op") == "M") & (F.col("name") == mark_row["mark_name"]) & (F.col("idx") == pair["mark_idx"]))
        at = named.agg(F.min("pos")).first()[0]
        return None if at is None else (pair["mark_idx"], at)

    def log() -> DataFrame:
        """The changes between base and mark. Where several tables read them, or the transactions too, they are written
        once, by table."""
        if not window:
            low, high = (anchor[0], 0), mark_at[0]
            rows = chain_log(low, high).filter(R.at_or_after(low) & R.before(high))
            window.append(stored(rows, "changes", ("tbl",)) if len(key) > 1 or told else rows)
        return window[0]

    mark_at: list[R.Position] = []
    window: list[DataFrame] = []
    told = flavour == "binlog" and mark_row["gtid_executed"]

    def target_gate() -> DataFrame:
        found = target()
        if found is None:
            return one_check(spark, mark_name, "target", mark_row["mark_name"] or "-", "NOT_IN_LOG", "failure")
        mark_at.append(found)
        return one_check(spark, mark_name, "target", mark_row["mark_name"] or "position", "OK", "ok")

    def content_gate() -> DataFrame:
        states, changed = {}, log()
        for table, keys in key.items():
            rows = spark.read.parquet(f"{base.artefact_path}/{table}")
            values = [c for c in rows.columns if c not in keys]
            changes = changed.filter(F.col("tbl") == table)
            states[table] = R.replay_to_mark(rows, changes, anchor, mark_at[0], list(keys), values, purged).select(*rows.columns)
        found = P.fingerprint_tables(states, db, method, algo=algo, depth=depth, witness=True)
        return table_checks(mark_name, recorded_tables(read_manifests(spark, mark_path), db), found)

    def objects_gate() -> DataFrame:
        if not mark_row["objects"]:
            return one_check(spark, mark_name, "objects", "-", "NOT_RECORDED", "warning")
        if objects is None:
            return one_check(spark, mark_name, "objects", "-", "NOT_SUPPLIED", "failure")
        promised = manifest_entries(read_manifests(spark, mark_path), "objects").select(
            F.lit(db).alias("db"), F.col("entry").alias("class"), F.col("value").alias("digest"))
        return object_checks(mark_name, promised, objects)

    def counters_gate() -> DataFrame:
        if counters is None or maxima is None:
            return one_check(spark, mark_name, "counters", "-", "NOT_SUPPLIED", "warning")
        return counter_checks(mark_name, counters, maxima, inclusive)

    def txn_gate() -> DataFrame:
        if not told:
            return one_check(spark, mark_name, "transactions", "-", "NOT_RECORDED", "warning")
        marked = N.parse_txn_set(read_manifests(spark, mark_path), "gtid_executed")
        replayed = log().filter(R.at_or_after(anchor)).select(F.col("gtid_uuid").alias("uuid"), F.col("gtid_no").alias("lo"), F.col("gtid_no").alias("hi"))
        applied = replayed if purged is None else replayed.unionByName(purged.select("uuid", "lo", "hi"))
        return checks(V.txn_subset(marked, applied), mark_name, "transactions", "uuid")

    outcome = gates_in_cost_order([
        Gate("bytes", bytes_gate), Gate("presence", presence_gate), Gate("chain", chain_gate), Gate("target", target_gate),
        Gate("tables", content_gate, refuting=False), Gate("objects", objects_gate, refuting=False),
        Gate("transactions", txn_gate, refuting=False), Gate("counters", counters_gate, refuting=False),
    ])
    ages = None
    if max_age_days > 0:
        ages = age_rows(read_manifests(spark, mark_path), now, max_age_days)
        if not ages.filter("taken IS NULL").isEmpty():
            raise Refused("the mark does not say when it was taken")
    return Proof(C.verdict(outcome.checks, ages), outcome.checks, outcome.stopped_at)


# --- retention ------------------------------------------------------------------------


def apply_prune(spark: SparkSession, plan: DataFrame, bases: DataFrame, folder: str, archive: str, receipt: str) -> DataFrame:
    """Carry a retention plan (``db, kind, name, decision``) out; counts per kind.

    Only behind ``receipt``, the manifest of what stays usable, and never when a line was refused. Log files
    go first, then base artefacts and inventories, manifests last, so whatever a crash leaves is still
    described. ``bases`` names the artefact of each base (``name, artefact``)."""
    if not files.exists(spark, receipt):
        raise Refused(f"{receipt} has not landed: nothing is deleted")
    known = settle(plan)
    no = known.filter("decision = 'REFUSED'").first()
    if no is not None:
        raise Refused(f"{no['db']}: the oldest kept base has no start, so there is no line")
    drops = known.filter("decision = 'DROP'")
    here, there = F.lit(files.qualified(spark, folder)).alias("root"), F.lit(files.qualified(spark, archive)).alias("root")
    files.delete_files(drops.filter("kind = 'file'").select(there, F.col("name").alias("rel")).distinct())
    gone = drops.filter("kind = 'base'").join(bases.select("name", "artefact").distinct(), "name")
    files.delete_files(gone.filter("artefact IS NOT NULL").select(here, F.col("artefact").alias("rel")).distinct())
    marks = drops.filter("kind = 'mark'")
    files.delete_files(marks.select(here, F.concat(F.regexp_replace("name", "\\.json$", ""), F.lit(".inventory")).alias("rel")))
    files.delete_files(drops.filter("kind IN ('base', 'mark')").select(here, F.col("name").alias("rel")))
    return drops.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# --- sites ---------------------------------------------------------------------------


def publish_instant(spark: SparkSession, base_path: str, mark_path: str, archive: str, site: str, keep: int = 0,
                    keep_days: int = 0, now: int | None = None) -> DataFrame:
    """Ship a proven pair: chain files the site lacks or holds wrong, the base's artefact, the base
    manifest, and the mark manifest last. Returns the shipping plan that was carried out. With ``keep`` or ``keep_days``
    (and ``now``) the site's older bases, and what only they need, go behind the mark's manifest."""
    pair, flavour = sound_pair(spark, base_path, mark_path)
    base_row = read_manifests(spark, base_path).first()
    base = S.Snapshot(base_path.rsplit("/", 1)[0], base_row["artefact"], base_path.rsplit("/", 1)[1])
    S.check_pair(spark, base, "before publishing")
    mark_name = mark_path.rsplit("/", 1)[1]
    if files.exists(spark, f"{site}/{mark_name}"):
        raise Refused(f"{mark_name} is already at the site")
    required, inventory = chain_of(spark, pair, mark_path, flavour)
    local = hash_artefacts(spark, archive, archive, required)
    bad = L.audit_chain(required, inventory, local).filter("status <> 'OK'").first()
    if bad is not None:
        raise Refused(f"{bad['name']} of the local chain is {bad['status']}")
    plan = settle(L.ship_plan(required, inventory, hash_artefacts(spark, site, site, required)))
    ship = plan.filter("action <> 'SKIP'").select(F.lit(files.qualified(spark, archive)).alias("root"), F.col("name").alias("rel"), "sha256")
    _ship(spark, ship, site)
    there = S.Snapshot(site, base.artefact, base.manifest)
    if files.exists(spark, there.artefact_path):
        held, _, _ = files.tree_fingerprint(files.hash_files(files.walk_files(spark, there.artefact_path)))
        if held != base_row["sha256"]:
            raise Refused("the site holds another artefact under the base's name")
    else:
        S._transfer(spark, base.artefact_path, there.artefact_path, base_row["sha256"], "the site's base")
    if not files.exists(spark, there.manifest_path):
        S._copy_manifest(spark, base, there)
    source, target = inventory_path(mark_path), inventory_path(f"{site}/{mark_name}")
    if files.exists(spark, source) and not files.exists(spark, target):
        files.copy_files(files.walk_files(spark, source), f"{target}.part")
        files.rename(spark, f"{target}.part", target)
    folder = mark_path.rsplit("/", 1)[0]
    S._copy_manifest(spark, S.Snapshot(folder, "", mark_name), S.Snapshot(site, "", mark_name))
    if keep > 0 or keep_days > 0:
        if now is None:
            raise ValueError("retention needs the time it is judged at")
        prune_site(spark, site, flavour, keep, keep_days, now, f"{site}/{mark_name}")
    return plan


def prune_site(spark: SparkSession, site: str, flavour: str, keep: int, keep_days: int, now: int, receipt: str) -> DataFrame:
    """Plan and carry out the retention of a folder that holds bases, marks and their archive."""
    marks, bases = points_at(spark, site, flavour)
    segment = read_manifests(spark, receipt).first()["wal_segment_bytes"] or N.DEFAULT_SEGMENT_BYTES
    names = list_artefacts(spark, site, site).select("name")
    kind = N.classify_file(F.col("name"), flavour, N.is_encrypted(F.col("name")))
    held = names.select(
        "name", kind.alias("kind"), N.file_series(F.col("name"), flavour).alias("series"),
        N.file_index(F.col("name"), flavour, segment).alias("idx")).filter(F.col("kind").isin("segment", "log", "backup_history"))
    # the log of a series serves every database whose oldest kept base lies in it: the lowest line counts
    plan = settle(X.prune_chain(bases, marks, held.join(bases.select("db", "series").distinct(), "series"), keep, keep_days, now))
    lines = settle(X.retention_line(bases, keep, keep_days, now))
    kept = bases.join(lines.select("db"), "db", "left_anti").groupBy("series").agg(F.min("idx").alias("_low"))
    cut = lines.groupBy("series").agg(F.min("idx").alias("_line")).join(kept, "series", "left").select(
        "series", F.least("_line", F.coalesce("_low", "_line")).alias("_safe"))
    free = held.join(cut, "series").filter(F.col("idx") < F.col("_safe")).select("name").distinct().withColumn("kind", F.lit("file"))
    files_go = plan.filter("kind = 'file'").join(free, ["kind", "name"], "left_semi")
    return apply_prune(spark, plan.filter("kind <> 'file'").unionByName(files_go), bases, site, site, receipt)


def _ship(spark: SparkSession, ship: DataFrame, site: str) -> None:
    """Copy into a temporary folder of the site, hash there, move each file into place."""
    if ship.isEmpty():
        return
    part = f"{site}/.chain.part"
    try:
        files.copy_files(ship, part)
        landed = files.hash_files(files.list_files(spark, part)).select("rel", F.col("sha256").alias("_landed"))
        lied = ship.join(landed, "rel", "left").filter(~F.col("sha256").eqNullSafe(F.col("_landed"))).first()
        if lied is not None:
            raise Refused(f"{lied['rel']}: the hash taken at the site is not the recorded one")
        files.move_files(ship.select(F.lit(files.qualified(spark, part)).alias("root"), "rel"), site)
    finally:
        files.remove(spark, part)


def points_at(spark: SparkSession, site: str, flavour: str = "binlog") -> tuple[DataFrame, DataFrame]:
    """Marks and bases of a site as ``db, series, idx, pos, name`` (bases with artefact and hash)."""
    m = read_manifests(spark, site)
    segment = F.coalesce("wal_segment_bytes", F.lit(N.DEFAULT_SEGMENT_BYTES))

    def place(file: str, pos: str) -> list:
        at = F.col(pos) if flavour == "binlog" else F.lit(0).cast("bigint")
        return [F.col("database").alias("db"), N.file_series(F.col(file), flavour).alias("series"),
                N.file_index(F.col(file), flavour, segment).alias("idx"), at.alias("pos"), "name"]

    marks = m.filter(F.col("kind") == MARK_KIND[flavour]).select(
        *place(MARK_FILE[flavour], "mark_pos"), F.coalesce(ENCRYPTED[flavour], F.lit("no")).alias("encrypted"), segment.alias("segment_bytes"))
    bases = m.filter(F.col("kind") == BASE_KIND[flavour]).select(*place(BASE_FILE[flavour], "anchor_pos"), "artefact", "sha256")
    return marks, bases


def fetch_instant(spark: SparkSession, db: str, site: str, out: str, flavour: str = "binlog") -> tuple[str, str]:
    """Newest mark of the database at the site, the base that reaches it, and every file between. A
    mark without inventory is refused; an older mark is never taken instead; nothing is overwritten."""
    marks, bases = points_at(spark, site, flavour)
    picked = L.pick_latest_pair(marks, bases, flavour, db).first()
    if picked is None:
        raise Refused(f"the site holds no mark of {db}")
    if picked["status"] != "OK":
        raise Refused(f"{picked['mark']}: {picked['status']}")
    base_path, mark_path = f"{site}/{picked['base']}", f"{site}/{picked['mark']}"
    pair, flavour = sound_pair(spark, base_path, mark_path)
    required, inventory = chain_of(spark, pair, mark_path, flavour)
    here = hash_artefacts(spark, out, out, required)
    plan = settle(L.fetch_plan(required, inventory, here))
    no = plan.filter("action LIKE 'REFUSE%'").first()
    if no is not None:
        raise Refused(f"{no['name']}: {no['action']}")
    promised = inventory.select("name", "sha256").distinct()
    want = plan.filter("action = 'FETCH'").join(promised, "name").select(F.lit(files.qualified(spark, site)).alias("root"), F.col("name").alias("rel"), "sha256")
    base_row = read_manifests(spark, base_path).first()
    for name in (base_row["artefact"], picked["base"], picked["mark"]):
        if files.exists(spark, f"{out}/{name}"):
            raise Refused(f"{out}/{name} exists already and is left alone")
    _ship(spark, want, out)
    S._transfer(spark, f"{site}/{base_row['artefact']}", f"{out}/{base_row['artefact']}", base_row["sha256"], "the fetched base")
    for name in (picked["base"], picked["mark"]):
        S._copy_manifest(spark, S.Snapshot(site, "", name), S.Snapshot(out, "", name))
    source, target = inventory_path(mark_path), inventory_path(f"{out}/{picked['mark']}")
    if files.exists(spark, source):
        files.copy_files(files.walk_files(spark, source), target)
    return f"{out}/{picked['base']}", f"{out}/{picked['mark']}"


def site_problems(listing: DataFrame, marks: DataFrame, bases: DataFrame, hashes: DataFrame, inventory: DataFrame,
                  now: int, max_age_days: int, flavour: str = "binlog") -> DataFrame:
    """``db, subject, problem`` of the instants a site claims: crashed uploads, newest marks without an
    inventory or an intact base, chain files unvouched, absent or rotten, databases gone quiet.

    ``listing``: ``name``; ``hashes``: ``artefact, sha256`` (files and base artefacts); ``inventory``:
    ``mark, name, sha256``."""
    parts = [
        listing.filter(N.classify_file(F.col("name"), "site") == "part")
        .select(F.lit(None).cast("string").alias("db"), F.col("name").alias("subject"), F.lit("PUSH_DIED").alias("problem"))
    ]
    newest = L.newest_marks(marks)
    vouching = inventory.select(F.col("mark").alias("name")).distinct()
    bare = newest.join(vouching, "name", "left_anti")
    parts.append(bare.select("db", F.col("name").alias("subject"), F.lit("NO_INVENTORY").alias("problem")))
    sound = newest.join(vouching, "name", "left_semi")
    own = bases.filter(N.name_stamp(F.col("name"), F.col("db")).isNotNull())
    reached = L.reachable_base(sound, L.intact_base(own, hashes), flavour)
    parts.append(reached.filter("base IS NULL").select("db", F.col("name").alias("subject"), F.lit("NO_INTACT_BASE").alias("problem")))
    pairs = reached.select("db", F.col("name").alias("mark"), "series", "base_idx", F.col("idx").alias("mark_idx"), (F.col("encrypted") == "yes").alias("encrypted"))
    segment = F.col("segment_bytes") if "segment_bytes" in reached.columns else F.lit(N.DEFAULT_SEGMENT_BYTES)
    sized = reached.select(F.col("name").alias("mark"), segment.alias("_seg"))
    chain = L.required_chain(pairs.join(sized, "mark"), flavour, inventory.join(pairs.select("mark"), "mark", "left_semi"), F.col("_seg"))
    required = L.required_or_inventory(chain, inventory, pairs)
    audit = L.audit_chain(required, inventory, hashes.select(F.col("artefact").alias("name"), "sha256"))
    parts.append(audit.filter("status <> 'OK'").join(pairs.select("mark", "db"), "mark").select("db", F.col("name").alias("subject"), F.col("status").alias("problem")))
    if max_age_days > 0:
        quiet = G.stale_databases(marks.select("name"), now, max_age_days)
        parts.append(quiet.select("db", F.col("stamp").alias("subject"), F.lit("STALE").alias("problem")))
    return reduce(DataFrame.unionByName, parts)


def intact_bases(spark: SparkSession, site: str, newest: DataFrame, bases: DataFrame, flavour: str) -> DataFrame:
    """``artefact, sha256`` of bases that hash true: for every newest mark the newest base that reaches it, and the next
    one only where that one is not intact. A round is two joins and one hashing of all its bases; there are as many
    rounds as the longest row of rotten bases of a database."""
    own = settle(bases.filter(N.name_stamp(F.col("name"), F.col("db")).isNotNull() & F.col("artefact").isNotNull()))
    seen = spark.createDataFrame([], "artefact string, sha256 string, intact boolean")
    while True:
        left = own.join(seen.filter("NOT intact"), ["artefact", "sha256"], "left_anti")
        picked = L.reachable_base(newest, left, flavour, ["artefact", "sha256"]).filter("base IS NOT NULL")
        fresh = settle(picked.select(F.col("base_artefact").alias("artefact"), F.col("base_sha256").alias("sha256")).distinct()
                       .join(seen, ["artefact", "sha256"], "left_anti"))
        if fresh.isEmpty():
            return seen.filter("intact").select("artefact", "sha256")
        found = files.artefact_hashes(spark, site, fresh).withColumnRenamed("sha256", "_found")
        judged = fresh.join(found, "artefact", "left").select(
            "artefact", "sha256", F.coalesce(F.col("sha256") == F.col("_found"), F.lit(False)).alias("intact"))
        seen = settle(seen.unionByName(judged))


INVENTORY = T.StructType([T.StructField("name", T.StringType()), T.StructField("sha256", T.StringType())])


def site_inventories(spark: SparkSession, site: str, marks: DataFrame) -> DataFrame:
    """``mark, name, sha256`` of the marks (column ``name``): the tables beside their manifests, found by one listing of
    the site and read from the table of their files, and the manifests' own maps."""
    start = spark.createDataFrame([(files.qualified(spark, site), "")], "root string, rel string")
    beside = marks.select(F.col("name").alias("mark"), F.concat(F.regexp_replace("name", "\\.json$", ""), F.lit(".inventory")).alias("rel"))
    held = files.list_level(start).filter("is_dir").select("root", "rel").join(beside, "rel")
    tables = settle(held.select("mark", F.concat_ws("/", "root", "rel").alias("root")))
    parts = files.walk_from(tables).filter(F.col("rel").endswith(".parquet") & ~F.col("rel").rlike(r"(^|/)[._]"))
    inventory = scan_parquet(parts.join(tables, "root").select("root", "rel", "bytes", "mark"), INVENTORY, keep=["mark"])
    manifests = read_manifests(spark, site).join(marks.select("name"), "name", "left_semi").withColumnRenamed("name", "mark")
    for section in ("binlogs", "wal"):
        entries = manifest_entries(manifests, section, "mark")
        inventory = inventory.unionByName(entries.select(F.col("entry").alias("name"), F.col("digest").alias("sha256"), "mark"))
    return inventory.select("mark", "name", "sha256")


def check_instants(spark: SparkSession, site: str, now: int, max_age_days: int, flavour: str) -> tuple[DataFrame, int]:
    """Problems of one flavour's instants at a site, and how many databases have a mark."""
    marks, bases = points_at(spark, site, flavour)
    listing = list_artefacts(spark, site, site).select("name")
    newest = settle(L.newest_marks(marks))
    inventory = settle(site_inventories(spark, site, newest))
    # only files some newest mark stands on are read
    hashes = hash_artefacts(spark, site, site, inventory).select(F.col("name").alias("artefact"), "sha256")
    hashes = settle(hashes.unionByName(intact_bases(spark, site, newest, bases, flavour)))
    return site_problems(listing, marks, bases, hashes, inventory, now, max_age_days, flavour), newest.count()


def check_site(spark: SparkSession, site: str, now: int, max_age_days: int = 0) -> DataFrame:
    """Audit a site from its own files: ``db, subject, problem`` over dump pairs and instants of both
    flavours. A site where nothing is wrong and nothing is proven either says so."""
    parts, proven = [], 0
    for flavour in FLAVOURS:
        found, marks = check_instants(spark, site, now, max_age_days, flavour)
        parts.append(found)
        proven += marks
    dumps = G.by_kind(read_manifests(spark, site), ["dump"]).filter("artefact IS NOT NULL")
    listing = files.artefact_hashes(spark, site, dumps).select(F.lit(site).alias("site"), F.col("artefact").alias("name"), "sha256")
    audit = settle(G.audit_site(listing, dumps.select(F.lit(site).alias("site"), "name", "artefact", "sha256")))
    owners = dumps.select("name", F.col("database").alias("db"))
    # only artefacts that a manifest names were looked at; folders of tables follow no naming rule of files
    parts.append(audit.filter("status NOT IN ('OK', 'NO_MANIFEST')").join(owners, "name", "left").select("db", F.col("name").alias("subject"), F.col("status").alias("problem")))
    problems = settle(reduce(DataFrame.unionByName, parts).distinct())
    if problems.isEmpty() and proven == 0 and audit.filter("status = 'OK'").isEmpty():
        return spark.createDataFrame([(None, site, "NOTHING_PROVEN")], problems.schema)
    return problems
