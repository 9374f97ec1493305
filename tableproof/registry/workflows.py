"""Queries over the file and workflow layers: files, manifests, snapshots and instants that are derived from the
tables into the session's shared folder, and what the operators say about them."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce
from uuid import uuid4

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableproof import fixtures as X
from tableproof.functions import names as N
from tableproof.operators import replay as R
from tableproof.plans import instants as I
from tableproof.plans.gates import Gate, gates_in_cost_order
from tableproof.plans.verify import verify_snapshot
from tableproof.registry import register
from tableproof.registry.fingerprints import digests_of, object_catalog
from tableproof.session import ensure_checkpoint_dir
from tableproof.sources import artefacts as A
from tableproof.sources import files
from tableproof.sources import manifests as M
from tableproof.sources import snapshots as S
from tableproof.streaming.catalogue import stream_manifests
from tableproof.streaming.watch import watch_arrival

DAY = 86400


def folder(spark, what: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{what}-{uuid4().hex}"


def write_files(rows, root: str) -> int:
    """Rows ``rel, body`` as files below ``root``, written where the rows are."""
    goal = files.qualified(rows.sparkSession, root)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, base = files._arrow_fs(goal)
                path = f"{base}/{row['rel']}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write((row["body"] or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["rel"])

    # a table of few and small files is otherwise written by as few tasks
    dealt = rows.select("rel", "body").repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(work, "rel string").count()


def beside(left, right):
    """One row put beside every row of another relation."""
    return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one").drop("_one")


# --- A3, A4, A5: the texts of the documents as files ------------------------------------------


def document_files(spark, sf_dir, nested: bool = False):
    docs = X.load(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    rel = F.concat_ws("/", F.concat(F.lit("."), "lang"), "source", name) if nested else name
    root = folder(spark, "files")
    write_files(docs.select(rel.alias("rel"), F.col("text").alias("body")), root)
    return root


@register("a3_list_artefacts", "SELECT 'vault' AS site, 'doc-' || doc_id || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS bytes FROM {documents}")
def a3(spark, sf_dir):
    return A.list_artefacts(spark, document_files(spark, sf_dir), "vault").select("site", "name", "bytes")


@register("a4_hash_artefacts", "SELECT 'vault' AS site, 'doc-' || doc_id || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM {documents}")
def a4(spark, sf_dir):
    return A.hash_artefacts(spark, document_files(spark, sf_dir), "vault")


@register(
    "a5_scan_file_tree",
    "SELECT '.' || lang || '/' || source || '/doc-' || doc_id || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS bytes, false AS unrepresentable FROM {documents}",
)
def a5(spark, sf_dir):
    return A.scan_file_tree(spark, document_files(spark, sf_dir, nested=True))


# --- A1, A6, S1: manifests --------------------------------------------------------------------


def customer_manifests(spark, sf_dir):
    body = F.to_json(F.struct(F.lit("dump").alias("kind"), F.col("c_mktsegment").alias("database"), F.col("c_name").alias("artefact"),
                              F.col("c_custkey").alias("bytes")))
    root = folder(spark, "manifests")
    write_files(X.load(spark, sf_dir, "customer").select(F.concat("c_name", F.lit(".json")).alias("rel"), body.alias("body")), root)
    return root


READ_MANIFESTS = "SELECT c_name || '.json' AS name, 'dump' AS kind, c_mktsegment AS database, c_name AS artefact, c_custkey AS bytes, CAST(NULL AS VARCHAR) AS engine FROM {customer}"


@register("a1_read_manifests", READ_MANIFESTS)
def a1(spark, sf_dir):
    return M.read_manifests(spark, customer_manifests(spark, sf_dir)).select("name", "kind", "database", "artefact", "bytes", "engine")


@register("s1_stream_manifests", READ_MANIFESTS)
def s1(spark, sf_dir):
    root, out = customer_manifests(spark, sf_dir), folder(spark, "catalogue")
    for _ in range(2):  # the second run finds nothing new
        stream_manifests(spark, root, out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out).select("name", "kind", "database", "artefact", "bytes", "engine")


@register(
    "a6_write_manifest",
    "SELECT 'part_' || p_partkey AS entry, md5(p_name) || ':' || p_size AS value, md5(p_name) AS digest, CAST(p_size AS BIGINT) AS n FROM {part}",
)
def a6(spark, sf_dir):
    prints = X.load(spark, sf_dir, "part").select(
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("table"),
        F.concat_ws(":", F.md5("p_name"), F.col("p_size").cast("string")).alias("fingerprint"))
    path = f"{folder(spark, 'written')}.json"
    M.write_manifest(prints, None, {"database": "app"}, path)
    return M.manifest_entries(M.read_manifests(spark, path), "tables")


# --- A7-A10, I1: a snapshot made, published, fetched, loaded and proven -----------------------------


def whole_tables(spark, sf_dir):
    return {n: X.load(spark, sf_dir, n) for n in ("customer", "orders", "embeddings")}


def taken(spark, sf_dir):
    return S.snapshot_tables(whole_tables(spark, sf_dir), folder(spark, "backups"), "app", X.NOW, floor=0,
                             objects=digests_of(object_catalog(spark, sf_dir)))


LOADED = (
    "SELECT 'customer' AS tbl, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM {customer} UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM {orders} "
    "UNION ALL SELECT 'embeddings', count(*), CAST(sum(vec_id) AS BIGINT) FROM {embeddings}"
)


def loaded_rows(spark, path):
    tables, broken = S.load_snapshot(spark, path)
    if broken:
        raise RuntimeError(str(broken))
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "embeddings": "vec_id"}
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("n"), F.sum(keys[name]).alias("keys")).select(F.lit(name).alias("tbl"), "n", "keys")
        out = one if out is None else out.unionByName(one)
    return out


@register("a8_load_snapshot", LOADED)
def a8(spark, sf_dir):
    return loaded_rows(spark, taken(spark, sf_dir).manifest_path)


@register("a10_fetch_verified", LOADED)
def a10(spark, sf_dir):
    """Made, published to a site, fetched from there by name, and loaded."""
    snap, site, out = taken(spark, sf_dir), folder(spark, "site"), folder(spark, "out")
    for path in (site, out):
        files.make_folder(spark, path)
    S.publish_verified(spark, snap.manifest_path, site)
    return loaded_rows(spark, S.fetch_verified(spark, "app", site, out).manifest_path)


I1_CASES = [("as it is", "VERIFIED"), ("a month later", "VERIFIED+STALE"), ("one order gone", "FAILED"), ("objects lost", "FAILED"),
            ("objects not shown", "FAILED"), ("counter behind", "FAILED")]


@register("i1_verify_snapshot", " UNION ALL ".join(
    f"SELECT '{c}' AS case_, '{v}' AS verdict, (SELECT count(*) FROM {{orders}}) AS orders_recorded" for c, v in I1_CASES))
def i1(spark, sf_dir):
    """The whole workflow over one snapshot: proven, stale, and failed by one gate at a time."""
    snap, tables = taken(spark, sf_dir), whole_tables(spark, sf_dir)
    shown = digests_of(object_catalog(spark, sf_dir))
    lost = digests_of(object_catalog(spark, sf_dir).filter("class <> 'routines'"))
    first = tables["orders"].agg(F.min("o_orderkey").alias("_k"))
    fewer = tables | {"orders": tables["orders"].join(first, F.col("o_orderkey") == F.col("_k"), "left_anti")}
    top = tables["orders"].agg(F.max("o_orderkey").alias("max_id")).select(F.lit("orders").alias("tbl"), "max_id")
    behind = top.select("tbl", F.col("max_id").alias("next_value"))

    def proof(**given):
        return verify_snapshot(spark, snap.manifest_path, given.pop("now", X.NOW), 7, **given)

    proofs = [proof(objects=shown), proof(objects=shown, now=X.NOW + 30 * DAY), proof(objects=shown, actual=fewer), proof(objects=lost), proof(),
              proof(objects=shown, counters=behind, maxima=top)]
    n = M.manifest_entries(M.read_manifests(spark, snap.manifest_path), "tables").filter("entry = 'orders'").select(F.col("n").alias("orders_recorded"))
    out = None
    for (case, _), p in zip(I1_CASES, proofs, strict=True):
        one = beside(p.verdict.select(F.lit(case).alias("case_"), "verdict"), n)
        out = one if out is None else out.unionByName(one)
    return out


# --- I2, I4, I7, I8, I10: instants of either flavour, over a log of one file per index -------------------


def log_name(flavour: str, idx):
    if flavour == "binlog":
        return F.concat(F.lit("binlog."), F.lpad(idx.cast("string"), 6, "0"))
    return F.concat(F.lit("00000001"), F.lpad(F.hex(F.floor(idx / 256)), 8, "0"), F.lpad(F.hex(idx % 256), 8, "0"))


def point(flavour: str, idx: int, pos: int) -> I.LogPoint:
    if flavour == "binlog":
        return I.LogPoint(f"binlog.{idx:06d}", pos)
    return I.LogPoint(f"00000001{idx // 256:08X}{idx % 256:08X}", None, "wal")


def write_log(log, root: str) -> int:
    """The log as one Parquet file per index, named by column ``file``."""
    goal = files.qualified(log.sparkSession, root)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        system, base = files._arrow_fs(goal)
        system.create_dir(base, recursive=True)
        writer, name = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for part in table.column("file").unique().to_pylist():
                rows = table.filter(pa.compute.equal(table.column("file"), part)).drop_columns(["file"])
                if part != name:
                    if writer is not None:
                        writer.close()
                    writer, name = pq.ParquetWriter(f"{base}/{part}", rows.schema, filesystem=system), part
                    yield pa.RecordBatch.from_arrays([pa.array([part])], ["file"])
                writer.write_table(rows)
        if writer is not None:
            writer.close()

    dealt = log.repartition(2 * log.sparkSession.sparkContext.defaultParallelism, "file").sortWithinPartitions("file", "pos")
    return dealt.mapInArrow(work, "file string").count()


#: The one server whose transactions the log holds; they are numbered from one.
SERVER = "3e11fa47-71ca-11e1-9e33-c80aa9429562"
KEY = {"accounts": ["k"]}


@dataclass(frozen=True)
class Drill:
    """An archive, a base a quarter into its log, the place of a mark three quarters in, and the state there."""

    log: DataFrame
    archive: str
    backups: str
    base: str
    state: DataFrame
    at: I.LogPoint
    before_base: int
    before_mark: int


def account_log(spark, sf_dir):
    log = X.view(spark, sf_dir, X.CHANGE_LOG)
    return log.withColumns({"tbl": F.lit("accounts"), "name": F.lit(None).cast("string"), "gtid_uuid": F.lit(SERVER), "gtid_no": F.col("gtid_no") + 1})


def drill(spark, sf_dir, flavour: str) -> Drill:
    log = account_log(spark, sf_dir)
    top = log.agg(F.max("idx")).first()[0]
    anchor = (top // 4, 404 if flavour == "binlog" else 0)
    mark = ((top * 3) // 4, 2504)
    named = spark.createDataFrame([(*mark, "M", "deploy")], "idx bigint, pos bigint, op string, name string")
    whole = log.unionByName(named, allowMissingColumns=True) if flavour == "wal" else log
    archive, backups = folder(spark, "archive"), folder(spark, "backups")
    write_log(whole.withColumn("file", log_name(flavour, F.col("idx"))), archive)
    base_state = R.latest_state(log.filter(R.before(anchor)), ["k"], ["v"])
    state = R.latest_state(log.filter(R.before(mark)), ["k"], ["v"])
    base = I.take_base({"accounts": base_state}, backups, "app", X.NOW - 3600, point(flavour, *anchor))
    counts = log.agg(F.count_if(R.before(anchor)), F.count_if(R.before(mark))).first()
    return Drill(whole, archive, backups, base, state, point(flavour, *mark), *counts)


def mark_of(spark, d: Drill, archive: str | None = None, now: int = X.NOW, mark_name: str = "deploy", transactions: int | None = None, **given) -> str:
    flavour = d.at.flavour
    if flavour == "wal":
        given["mark_name"] = mark_name
    else:
        given["gtid_executed"] = f"{SERVER}:1-{d.before_mark if transactions is None else transactions}"
    return I.mark_instant({"accounts": d.state}, lambda: d.at, archive or d.archive, d.backups, "app", now, pause=0.01, **given)


def verified(spark, d: Drill, mark: str, archive: str | None = None, now: int = X.NOW, base: str | None = None):
    held = spark.createDataFrame([(SERVER, 1, d.before_base)], "uuid string, lo bigint, hi bigint") if d.at.flavour == "binlog" else None
    return I.verify_instant(spark, base or d.base, mark, archive or d.archive, KEY, now, 7, held)


def marked(spark, sf_dir, flavour: str, **given):
    d = drill(spark, sf_dir, flavour)
    return d, mark_of(spark, d, **given)


STATE_N = (
    f"WITH l AS ({X.CHANGE_LOG}), e AS (SELECT max(idx) AS top FROM l), s AS (SELECT k, op, row_number() OVER (PARTITION BY k ORDER BY idx DESC, pos DESC) AS rn FROM l, e "
    "WHERE idx < (top * 3) // 4 OR (idx = (top * 3) // 4 AND pos < 2504)), n AS (SELECT count(*) AS rows_at_mark FROM s WHERE rn = 1 AND op <> 'D') "
)


def with_rows(df, state):
    return beside(df, state.agg(F.count(F.lit(1)).alias("rows_at_mark")))


@register(
    "i2_mark_instant",
    STATE_N + "SELECT c.*, rows_at_mark FROM n, (SELECT unnest(['still', 'moved']) AS case_, unnest(['yes', 'no']) AS quiesced) c",
)
def i2(spark, sf_dir):
    """The position read around the fingerprints: standing still, and moved by one event meanwhile."""
    d = drill(spark, sf_dir, "binlog")
    archive, backups, state, at = d.archive, d.backups, d.state, d.at
    readings = {"still": [at, at], "moved": [I.LogPoint(at.file, at.pos - 100), at]}
    out = None
    for i, (case, values) in enumerate(readings.items()):
        left = iter(values)
        path = I.mark_instant({"accounts": state}, lambda left=left: next(left), archive, backups, "app", X.NOW + i, pause=0.01)
        n = M.manifest_entries(M.read_manifests(spark, path), "tables").select(F.col("n").alias("rows_at_mark"))
        one = beside(M.read_manifests(spark, path).select(F.lit(case).alias("case_"), "quiesced"), n)
        out = one if out is None else out.unionByName(one)
    return out


# --- I2: marks that wait for their file ------------------------------------------------------------


@register(
    "i2_mark_by_arrival",
    STATE_N + "SELECT c.*, CASE WHEN c.status = 'MARKED' THEN rows_at_mark END AS rows_at_mark, CASE WHEN c.status = 'MARKED' THEN (top * 3) // 4 END AS inventory FROM n, e, "
    "(SELECT unnest(['grows', 'never']) AS db, unnest(['MARKED', 'TIMED_OUT']) AS status) c",
)
def i2_by_arrival(spark, sf_dir):
    """Two marks wait while the archive's files are told of look by look: the file of one grows and gets whole, that of the
    other stays at its first size. Neither is looked for by a job of its own."""
    d = drill(spark, sf_dir, "binlog")
    never = I.LogPoint("binlog.999999", 4)
    pending = {db: I.prepare_mark({"accounts": d.state}, lambda at=at: at, d.backups, db, X.NOW) for db, at in (("grows", d.at), ("never", never))}
    listed = A.list_artefacts(spark, d.archive, "a").select("name", "bytes", N.file_index(F.col("name"), "binlog").alias("idx"))
    # three looks at every file, a minute apart from file to file: half of it, all of it, and all of it again
    looks = listed.select("name", F.explode(F.array(*[F.struct((F.col("bytes") / part).cast("bigint").alias("size"), F.lit(s).alias("s")) for part, s in ((2, 0), (1, 20), (1, 40))])).alias("l"), "idx")
    stuck = listed.filter("idx = 1").select(F.lit(never.file).alias("name"), F.lit(100).cast("bigint").alias("size"), F.timestamp_seconds(F.lit(X.NOW)).alias("observed_at"))
    seen = looks.select("name", "l.size", F.timestamp_seconds(F.lit(X.NOW) + F.col("idx") * 60 + F.col("l.s")).alias("observed_at")).unionByName(stuck)
    root = folder(spark, "looks")
    # three batches in the order of time, cut between the looks at the file that grows
    first = F.unix_seconds("observed_at") - (X.NOW + 60 * d.at.idx)
    for part in (first < 10, (first >= 10) & (first < 30), first >= 30):
        seen.filter(part).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    I.stream_marks(watch_arrival(stream, 0, True, 90, 3600), d.backups, d.archive, f"{root}/out", f"{root}/state").awaitTermination()
    told = spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out").withColumn("db", F.substring_index("mark", "_", 1))
    if any(files.exists(spark, p) for p in pending.values()):
        raise RuntimeError("a mark is still pending")
    made = M.read_manifests(spark, d.backups).filter("kind = 'binlog-mark'")
    n = M.manifest_entries(made, "tables", "database").select(F.col("database").alias("db"), F.col("n").alias("rows_at_mark"))
    mark = f"{d.backups}/{S.snapshot_name('grows', X.NOW)}_binlogmark.json"
    held = I.read_inventory(spark, mark).agg(F.count(F.lit(1)).alias("inventory")).withColumn("db", F.lit("grows"))
    return told.select("db", "status").join(n, "db", "left").join(held, "db", "left")


# --- I4: what each gate is there to catch ---------------------------------------------------------


def rewritten(spark, root: str, rel: str) -> None:
    """One bit in the middle of a file changed; its size stays."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, base = files._arrow_fs(row["root"])
                with system.open_input_stream(f"{base}/{row['rel']}") as source:
                    held = bytearray(source.read())
                held[len(held) // 2] ^= 1
                with system.open_output_stream(f"{base}/{row['rel']}") as target:
                    target.write(bytes(held))
            yield pa.RecordBatch.from_arrays([batch.column(1)], ["rel"])

    one = spark.createDataFrame([(files.qualified(spark, root), rel)], "root string, rel string")
    one.mapInArrow(work, "rel string").count()


def copied(spark, archive: str, without: str = "") -> str:
    there = folder(spark, "archive")
    files.make_folder(spark, there)
    files.copy_files(files.list_files(spark, archive).filter(F.col("rel") != without), there)
    return there


def without_entry(spark, inventory: str, name: str) -> None:
    """An inventory that never stood on one file."""
    left = spark.read.parquet(inventory).filter(F.col("name") != name)
    left.write.parquet(f"{inventory}.part")
    files.remove(spark, inventory)
    files.rename(spark, f"{inventory}.part", inventory)


def side_by_side(steps: dict, at_once: int = 4) -> dict:
    """The results of independent steps, a few running at a time: their jobs are short and share the cluster."""
    with ThreadPoolExecutor(at_once) as pool:
        running = {name: pool.submit(inheritable_thread_target(step)) for name, step in steps.items()}
        return {name: step.result() for name, step in running.items()}


def verdicts(spark, sf_dir, flavour: str):
    """One proof for every gate that can refute an instant, each over files that only that gate can tell from the
    sound ones: what was concluded, where it stopped, and how many subjects failed in which way."""
    d, mark = marked(spark, sf_dir, flavour)
    inside = point(flavour, d.at.idx - 1, 0).file  # a file between base and mark

    def gone():
        nothing = folder(spark, "empty")
        files.make_folder(spark, nothing)
        return verified(spark, d, mark, nothing)

    def rot():
        rotten = copied(spark, d.archive)
        rewritten(spark, rotten, inside)
        return verified(spark, d, mark, rotten)

    def unvouched():
        told = mark_of(spark, d, now=X.NOW + 1)
        without_entry(spark, I.inventory_path(told), inside)
        return verified(spark, d, told)

    def other_content():
        # the last change before the mark says something else, and the inventory was taken of that: content alone tells
        last = (F.col("idx") == d.at.idx) & (F.col("pos") == 2404) & (F.col("op") != "M")
        changed = d.log.withColumn("op", F.when(last & (F.col("op") == "D"), "U").when(last, "D").otherwise(F.col("op")))
        other = folder(spark, "archive")
        write_log(changed.withColumn("file", log_name(flavour, F.col("idx"))), other)
        return verified(spark, d, mark_of(spark, d, other, X.NOW + 2), other)

    cases = {
        "as it is": lambda: verified(spark, d, mark), "late": lambda: verified(spark, d, mark, now=X.NOW + 30 * DAY), "archive gone": gone,
        "hole": lambda: verified(spark, d, mark, copied(spark, d.archive, without=inside)), "rot": rot, "unvouched": unvouched, "other content": other_content}
    if flavour == "wal":
        cases["no such mark"] = lambda: verified(spark, d, mark_of(spark, d, now=X.NOW + 3, mark_name="never"))
    else:
        cases["transaction lost"] = lambda: verified(spark, d, mark_of(spark, d, now=X.NOW + 3, transactions=d.before_mark + 1))
    cases = side_by_side(cases)
    rows = []
    for case, p in cases.items():
        failed = p.checks.filter("severity <> 'ok' AND severity <> 'warning'").groupBy("gate", "status").agg(F.count(F.lit(1)).alias("n"))
        told = p.verdict.select(F.lit(case).alias("case_"), "verdict", F.lit(p.stopped_at).cast("string").alias("stopped_at"), F.lit(1).alias("_one"))
        rows.append(told.join(failed.withColumn("_one", F.lit(1)), "_one", "left").drop("_one"))
    return with_rows(reduce(DataFrame.unionByName, rows), d.state)


def i4_sql(last: str) -> str:
    one = "SELECT '{}' AS case_, 'FAILED' AS verdict, {} AS stopped_at, '{}' AS gate, '{}' AS status, {} AS n"
    cases = [
        "SELECT 'as it is' AS case_, 'VERIFIED' AS verdict, NULL AS stopped_at, NULL AS gate, NULL AS status, NULL::BIGINT AS n",
        "SELECT 'late', 'VERIFIED+STALE', NULL, NULL, NULL, NULL",
        one.format("archive gone", "'presence'", "presence", "ABSENT", "(SELECT (top * 3) // 4 - top // 4 + 1 FROM e)"),
        one.format("hole", "'presence'", "presence", "ABSENT", 1), one.format("rot", "'chain'", "chain", "DIFFERS", 1),
        one.format("unvouched", "'chain'", "chain", "NOT_IN_INVENTORY", 1), one.format("other content", "NULL", "tables", "DIFFERS", 1), last]
    return STATE_N + f"SELECT c.*, rows_at_mark FROM n, ({' UNION ALL '.join(cases)}) c"


NO_MARK = "SELECT 'no such mark', 'FAILED', 'target', 'target', 'NOT_IN_LOG', 1"
LOST = "SELECT 'transaction lost', 'FAILED', NULL, 'transactions', 'MISSING', 1"


@register("i4_verify_instant_binlog", i4_sql(LOST))
def i4_binlog(spark, sf_dir):
    return verdicts(spark, sf_dir, "binlog")


@register("i4_verify_instant_wal", i4_sql(NO_MARK))
def i4_wal(spark, sf_dir):
    return verdicts(spark, sf_dir, "wal")


# --- I7: a site with every kind of problem ----------------------------------------------------------

#: Databases of the site, where their base and mark lie in quarters of the log, and how long ago they were marked.
SITE = {"app": (1, 2, 0), "bare": (2, 3, 0), "lost": (1, 3, 0), "quiet": (2, 3, 30 * DAY)}


@register(
    "i7_check_site",
    f"WITH l AS ({X.CHANGE_LOG}), t AS (SELECT max(idx) // 4 AS q FROM l), f AS (SELECT 'binlog.' || lpad((q)::VARCHAR, 6, '0') AS rot, "
    "'binlog.' || lpad((q + 1)::VARCHAR, 6, '0') AS hole, 'binlog.' || lpad((2 * q)::VARCHAR, 6, '0') AS bare FROM t) "
    "SELECT 'app' AS db, rot AS subject, 'DIFFERS' AS problem FROM f UNION ALL SELECT 'app', hole, 'ABSENT' FROM f UNION ALL SELECT 'app', bare, 'NOT_IN_INVENTORY' FROM f "
    "UNION ALL SELECT 'lost', rot, 'DIFFERS' FROM f UNION ALL SELECT 'lost', hole, 'ABSENT' FROM f "
    f"UNION ALL SELECT 'lost', 'lost_{N.stamp_text(X.NOW)}_binlogmark.json', 'NO_INTACT_BASE' UNION ALL SELECT 'bare', 'bare_{N.stamp_text(X.NOW)}_binlogmark.json', 'NO_INVENTORY' "
    f"UNION ALL SELECT 'quiet', '{N.stamp_text(X.NOW - 30 * DAY)}', 'STALE' UNION ALL SELECT NULL, 'late_{N.stamp_text(X.NOW)}.dump.part', 'PUSH_DIED' "
    f"UNION ALL SELECT 'lost', 'lost_{N.stamp_text(X.NOW - 60)}.json', 'ROT' UNION ALL SELECT 'bare', 'bare_{N.stamp_text(X.NOW - 60)}.json', 'ARTEFACT_MISSING'",
)
def i7_check_site(spark, sf_dir):
    """Four databases at one site that keeps the log files too, then damaged: a file of the log changed, one deleted, one
    that an inventory never stood on, an inventory lost, a base changed, a base deleted, an upload that died."""
    log, site = account_log(spark, sf_dir), folder(spark, "site")
    quarter = log.agg(F.max("idx")).first()[0] // 4
    write_log(log.withColumn("file", log_name("binlog", F.col("idx"))), site)
    states = {n: R.latest_state(log.filter(R.before((n * quarter, 404))), ["k"], ["v"]) for n in (1, 2)}

    def instant(db, begin, end, ago):
        I.take_base({"accounts": states[begin]}, site, db, X.NOW - ago - 60, point("binlog", begin * quarter + (begin > 1), 404))
        at = point("binlog", end * quarter, 2504)
        return I.mark_instant({"accounts": states[begin]}, lambda: at, site, site, db, X.NOW - ago, pause=0.01)

    marks = side_by_side({db: partial(instant, db, *where) for db, where in SITE.items()})
    write_files(spark.createDataFrame([(f"late_{N.stamp_text(X.NOW)}.dump.part", "half")], "rel string, body string"), site)
    rewritten(spark, site, point("binlog", quarter, 0).file)
    files.remove(spark, f"{site}/{point('binlog', quarter + 1, 0).file}")
    without_entry(spark, I.inventory_path(marks["app"]), point("binlog", 2 * quarter, 0).file)
    files.remove(spark, I.inventory_path(marks["bare"]))
    held = {db: f"{S.snapshot_name(db, X.NOW - 60)}{S.SUFFIX}" for db in ("lost", "bare")}
    part = files.walk_files(spark, f"{site}/{held['lost']}").filter(F.col("rel").endswith(".parquet")).agg(F.min("rel")).first()[0]
    rewritten(spark, f"{site}/{held['lost']}", part)
    files.remove(spark, f"{site}/{held['bare']}")
    return I.check_site(spark, site, X.NOW, 7)


# --- I8, I10: an instant shipped to a site and fetched from there --------------------------------------


def travelled(spark, sf_dir, flavour: str):
    d, mark = marked(spark, sf_dir, flavour)
    site, out = folder(spark, "site"), folder(spark, "out")
    for path in (site, out):
        files.make_folder(spark, path)
    plan = I.publish_instant(spark, d.base, mark, d.archive, site)
    problems = I.check_site(spark, site, X.NOW, 7)
    base, got = I.fetch_instant(spark, "app", site, out, flavour)
    proof = verified(spark, d, got, out, base=base)
    shipped = plan.filter("action = 'SHIP'").agg(F.count(F.lit(1)).alias("shipped"))
    counts = beside(shipped, problems.agg(F.count(F.lit(1)).alias("problems")))
    return with_rows(beside(proof.verdict.select("verdict"), counts), d.state)


I10_SQL = STATE_N + "SELECT 'VERIFIED' AS verdict, (top * 3) // 4 - top // 4 + 1 AS shipped, 0::BIGINT AS problems, rows_at_mark FROM n, e"


@register("i10_fetch_instant_binlog", I10_SQL)
def i10_binlog(spark, sf_dir):
    return travelled(spark, sf_dir, "binlog")


@register("i10_fetch_instant_wal", I10_SQL)
def i10_wal(spark, sf_dir):
    return travelled(spark, sf_dir, "wal")


# --- A7, A9, I8 with retention, and what publication refuses -----------------------------------------------


@register("a7_snapshot_keep", " UNION ALL ".join(
    f"SELECT 'app_{N.stamp_text(X.NOW - d * DAY)}.json' AS name, (SELECT count(*) FROM {{customer}} WHERE c_custkey % 4 <> {d}) AS n" for d in (0, 1)))
def a7_keep(spark, sf_dir):
    """Four snapshots, a day apart, the last with ``keep=2``: what is left proves what it was taken of."""
    root = folder(spark, "backups")
    rows = X.load(spark, sf_dir, "customer")
    for d in (3, 2, 1, 0):
        S.snapshot_tables({"customer": rows.filter(F.col("c_custkey") % 4 != d)}, root, "app", X.NOW - d * DAY, floor=0, keep=0 if d else 2)
    left = M.read_manifests(spark, root)
    names = A.list_artefacts(spark, root, root).filter("name LIKE 'app%'").select("name")
    on_disk = [S.Snapshot(root, r["artefact"], r["name"]) for r in left.select("artefact", "name").collect()]
    for snap in on_disk:
        S.check_pair(spark, snap, "kept")
    return M.manifest_entries(left, "tables", "name").join(names, "name").select("name", "n")


PUBLISHED = [("sound", "published"), ("published before", "refused: exists"), ("rotten here", "refused: drift"), ("other bytes of one size", "refused: drift")]


@register("a9_publish_refusals", " UNION ALL ".join(
    f"SELECT '{case}' AS case_, '{said}' AS outcome, {int(said == 'published')}::BIGINT AS manifests_at_site, (SELECT count(*) FROM {{customer}}) AS n" for case, said in PUBLISHED))
def a9(spark, sf_dir):
    """Publication of a sound snapshot, of the same again, and of two whose bytes are no longer the recorded ones."""
    tables = {"customer": X.load(spark, sf_dir, "customer")}
    rows, sites = [], {}
    for i, (case, _) in enumerate(PUBLISHED):
        if case == "published before":
            snap, site = sites["sound"]
        else:
            snap, site = S.snapshot_tables(tables, folder(spark, "backups"), "app", X.NOW + i, floor=0), folder(spark, "site")
            files.make_folder(spark, site)
        part = files.walk_files(spark, f"{snap.artefact_path}/customer").filter(F.col("rel").endswith(".parquet")).agg(F.min("rel")).first()[0]
        if case == "rotten here":
            files.remove(spark, f"{snap.artefact_path}/customer/{part}")
        if case == "other bytes of one size":
            rewritten(spark, f"{snap.artefact_path}/customer", part)
        before = M.read_manifests(spark, site).count() if case == "published before" else 0
        try:
            S.publish_verified(spark, snap.manifest_path, site)
            said = "published"
        except M.Refused as why:
            said = "refused: exists" if "never overwritten" in str(why) else "refused: drift" if "drift" in str(why) else str(why)
        sites[case] = (snap, site)
        n = M.manifest_entries(M.read_manifests(spark, snap.manifest_path), "tables").first()["n"]
        rows.append((case, said, A.list_artefacts(spark, site, site).filter("name LIKE '%.json'").count() - before, n))
    return spark.createDataFrame(rows, "case_ string, outcome string, manifests_at_site bigint, n bigint")


@register(
    "i8_publish_keep",
    STATE_N + "SELECT kind, files FROM (SELECT 'log' AS kind, (top * 3) // 4 - (top // 2) + 1 AS files FROM e UNION ALL SELECT 'base', 1 UNION ALL SELECT 'mark', 1 UNION ALL SELECT 'dump', 1) k",
)
def i8_keep(spark, sf_dir):
    """Two instants published one after the other, the second with ``keep=1``: the first base, its mark and the log files that
    only they need are gone, and what is left is sound."""
    d = drill(spark, sf_dir, "binlog")
    site = folder(spark, "site")
    files.make_folder(spark, site)
    middle = (d.log.agg(F.max("idx")).first()[0]) // 2
    early = R.latest_state(d.log.filter(R.before((middle - 1, 4))), ["k"], ["v"])
    first = I.mark_instant({"accounts": early}, lambda: point("binlog", middle - 1, 4), d.archive, d.backups, "app", X.NOW, pause=0.01)
    I.publish_instant(spark, d.base, first, d.archive, site)
    state = R.latest_state(d.log.filter(R.before((middle, 4))), ["k"], ["v"])
    base = I.take_base({"accounts": state}, d.backups, "app", X.NOW + 60, point("binlog", middle, 4))
    second = mark_of(spark, d, now=X.NOW + 120)
    I.publish_instant(spark, base, second, d.archive, site, keep=1, now=X.NOW + 180)
    problems = I.check_site(spark, site, X.NOW + 180, 7)
    if not problems.isEmpty():
        raise RuntimeError(str(problems.collect()))
    listed = files.list_level(spark.createDataFrame([(files.qualified(spark, site), "")], "root string, rel string"))
    kind = (F.when(F.col("rel").startswith("binlog."), "log").when(F.col("rel").endswith("_binlogbase.json"), "base")
            .when(F.col("rel").endswith("_binlogmark.json"), "mark").when(F.col("is_dir") & F.col("rel").endswith(S.SUFFIX), "dump"))
    return listed.select(kind.alias("kind")).filter("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("files"))


# --- I11 ---------------------------------------------------------------------------------------------


@register(
    "i11_gates_in_cost_order",
    "SELECT o_orderpriority AS subject, 'cheap' AS gate, CASE WHEN min(o_orderkey) % 2 = 0 THEN 'OK' ELSE 'ODD' END AS status FROM {orders} GROUP BY 1",
)
def i11(spark, sf_dir):
    """The dear gate stands behind a cheap one that refutes, so its rows never come."""
    orders = X.load(spark, sf_dir, "orders")
    cheap = orders.groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("k")).select(
        F.lit("s").alias("snapshot"), F.lit("cheap").alias("gate"), F.col("o_orderpriority").alias("subject"),
        F.when(F.col("k") % 2 == 0, "OK").otherwise("ODD").alias("status"), F.lit("failure").alias("severity"))
    dear = orders.select(F.lit("s").alias("snapshot"), F.lit("dear").alias("gate"), F.col("o_orderkey").cast("string").alias("subject"),
                         F.lit("OK").alias("status"), F.lit("ok").alias("severity"))
    outcome = gates_in_cost_order([Gate("cheap", lambda: cheap), Gate("dear", lambda: dear)])
    return outcome.checks.select("subject", "gate", "status")
