"""Log archives and recovery points: gaps, reach, required chains, audits and plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableproof import schema as S
from tableproof.functions import names as N
from tableproof.operators.ordered import as_of
from tableproof.session import stored

GAP_BITS = 16
GAP_BLOCK = 1 << GAP_BITS  # indices per block; distinct indices bound every group


# --- archives --------------------------------------------------------------------


def in_chain(df: DataFrame, series: str | int, first: int, last: int) -> DataFrame:
    """Files of one series between base and mark; a plain range filter that reaches the scan."""
    return df.filter((F.col("series") == series) & F.col("idx").between(first, last))


def missing_ranges(listing: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """``keys, first, last, n``: every hole between the first and last index present.

    Indices are cut into blocks of fixed width; a block's rows are looked at in one task, the
    block starts (one row per 65536 indices) bridge the borders."""
    present = listing.filter(F.col("idx").isNotNull()).select(*keys, "idx").distinct()
    blocks = present.withColumn("_block", F.shiftright("idx", GAP_BITS))
    heads = blocks.groupBy(*keys, "_block").agg(F.min("idx").alias("_head"))
    following = heads.select(
        *keys, "_block", F.lead("_head").over(Window.partitionBy(*keys).orderBy("_block")).alias("_next_head")
    )
    inner = Window.partitionBy(*keys, "_block").orderBy("idx")
    stepped = blocks.withColumn("_lead", F.lead("idx").over(inner)).join(following, [*keys, "_block"])
    nxt = F.coalesce("_lead", "_next_head")
    return stepped.filter(nxt > F.col("idx") + 1).select(
        *keys, (F.col("idx") + 1).alias("first"), (nxt - 1).alias("last"), (nxt - F.col("idx") - 1).alias("n")
    )


def wrong_size(listing: DataFrame, keys: Sequence[str] = ("archive",), expected: int | None = None) -> DataFrame:
    """Segments whose size is not the expected one (largest present when not given)."""
    if expected is not None:
        sized = listing.withColumn("expected_bytes", F.lit(expected).cast("bigint"))
    else:
        sized = listing.join(listing.groupBy(*keys).agg(F.max("bytes").alias("expected_bytes")), list(keys))
    return sized.filter(F.col("bytes") != F.col("expected_bytes"))


LOG_KIND = {"wal": "segment", "binlog": "log"}


def archive_form(listing: DataFrame, flavour: str, keys: Sequence[str] = ("archive",)) -> DataFrame:
    """plain, encrypted, or MIXED, which is refused. Names of log files decide; strays have no say."""
    name, kind = F.col("name"), LOG_KIND[flavour]
    enc = N.is_encrypted(name) & (N.classify_file(name, flavour, True) == kind)
    plain = N.classify_file(name, flavour) == kind
    folded = listing.groupBy(*keys).agg(F.count_if(enc).alias("encrypted"), F.count_if(plain).alias("plain"))
    form = F.when((F.col("encrypted") > 0) & (F.col("plain") > 0), "MIXED").when(F.col("encrypted") > 0, "encrypted").otherwise("plain")
    return folded.withColumn("form", form)


def single_series(listing: DataFrame, keys: Sequence[str] = ("archive",)) -> DataFrame:
    """How many series an archive holds; more than one is refused for logs with a plain counter."""
    distinct = listing.select(*keys, "series").distinct()
    folded = distinct.groupBy(*keys).agg(F.count("*").alias("n_series"), F.min("series").alias("first_series"))
    return folded.withColumn("status", F.when(F.col("n_series") > 1, "REFUSED").otherwise("OK"))


def purged_gap(archive: DataFrame, oldest: DataFrame) -> DataFrame:
    """``series, first, last``: files the server dropped before the archive got them.

    ``oldest``: ``series, oldest`` of the server. An empty archive has no gap."""
    newest = archive.groupBy("series").agg(F.max("idx").alias("_newest"))
    joined = oldest.join(newest, "series")
    return joined.filter(F.col("oldest") > F.col("_newest") + 1).select(
        "series", (F.col("_newest") + 1).alias("first"), (F.col("oldest") - 1).alias("last")
    )


def archiver_backlog(status: DataFrame, segment_bytes: Column | int = N.DEFAULT_SEGMENT_BYTES) -> DataFrame:
    """``server, behind, status`` from archiver statistics; old failures that healed are no problem."""
    last = F.col("last_archived")
    behind = N.wal_index(F.col("current"), segment_bytes) - N.wal_index(F.substring(last, 1, 24), segment_bytes) - 1
    failing = F.col("last_failed_time").isNotNull() & (
        F.col("last_archived_time").isNull() | (F.col("last_failed_time") > F.col("last_archived_time"))
    )
    word = (
        F.when(last.isNull(), "NEVER_ARCHIVED")
        .when(behind > 0, "BEHIND")
        .when(failing, "FAILING_NOW")
        .when(F.col("failed_count") > 0, "HEALED")
        .otherwise("OK")
    )
    return status.select(
        "server", behind.alias("behind"), word.alias("status"),
        word.isin("NEVER_ARCHIVED", "BEHIND", "FAILING_NOW").alias("problem"),
    )


def archive_vs_server(server: DataFrame, archive: DataFrame, active: DataFrame) -> DataFrame:
    """Closed server files against the archive: ROT, NOT_ARCHIVED (informational) or OK.

    ``active``: ``series, name`` of the files still growing; they are not looked at."""
    closed = server.join(active, ["series", "name"], "left_anti")
    held = archive.select("series", "name", F.col("sha256").alias("_sha"), F.lit(True).alias("_held"))
    status = F.when(F.col("_held").isNull(), "NOT_ARCHIVED").when(~F.col("sha256").eqNullSafe(F.col("_sha")), "ROT").otherwise("OK")
    return closed.join(held, ["series", "name"], "left").select("series", "name", status.alias("status"))


# --- recovery points ---------------------------------------------------------------


def pair_refusals(pairs: DataFrame, flavour: str) -> DataFrame:
    """``pairs`` plus ``refusals`` (ordered) and ``refusal`` (the first, null when sound).

    Columns: ``base_kind, mark_kind, base_db, mark_db, base_series, mark_series, base_idx,
    mark_idx, base_pos, mark_pos, base_gtid, mark_gtid, inventory_files``."""
    c = F.col
    needed = ["base_series", "mark_series", "base_idx", "mark_idx"]
    if flavour == "binlog":
        needed += ["base_pos", "mark_pos"]
    missing = c(needed[0]).isNull()
    for field in needed[1:]:
        missing = missing | c(field).isNull()
    base_gtid = F.coalesce("base_gtid", F.lit(S.DEFAULTS["gtid_mode"]))
    mark_gtid = F.coalesce("mark_gtid", F.lit(S.DEFAULTS["gtid_mode"]))
    predates = c("mark_idx") < c("base_idx")
    if flavour == "binlog":
        predates = predates | ((c("mark_idx") == c("base_idx")) & (c("mark_pos") < c("base_pos")))
    rules = [
        (~c("base_kind").eqNullSafe(F.lit(S.BASE_KIND[flavour])), "base has the wrong kind"),
        (~c("mark_kind").eqNullSafe(F.lit(S.MARK_KIND[flavour])), "mark has the wrong kind"),
        (~c("base_db").eqNullSafe(c("mark_db")), "different databases"),
        (missing, "position fields missing"),
    ]
    if flavour == "binlog":
        rules.append((base_gtid != mark_gtid, "different gtid modes"))
    rules += [
        (c("base_series") != c("mark_series"), "different series"),
        ((c("base_series") == c("mark_series")) & predates, "mark predates base"),
    ]
    rules.append((F.coalesce("inventory_files", F.lit(0)) == 0, "mark records no inventory"))
    told = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(text)) for test, text in rules])
    refusals = F.filter(told, lambda x: x.isNotNull())
    return pairs.withColumn("refusals", refusals).withColumn("refusal", F.get("refusals", 0))


def reachable_base(marks: DataFrame, bases: DataFrame, flavour: str, payload: Sequence[str] = ()) -> DataFrame:
    """Every mark with the newest base (by name) of its database and series at or before it.

    A mark nothing reaches keeps a null base; an older mark is never tried instead. For WAL the file
    decides, for binlogs the file and the position in it."""
    at = F.col("pos") if flavour == "binlog" else F.lit(0).cast("bigint")
    points = marks.withColumn("_at", at)
    events = bases.withColumn("_at", at)
    picked = as_of(points, events, ["db", "series"], ["idx", "_at"], F.struct("name", "idx", "pos", *payload), "_base")
    return picked.drop("_at").select(
        *marks.columns,
        F.col("_base.name").alias("base"),
        F.col("_base.idx").alias("base_idx"),
        F.col("_base.pos").alias("base_pos"),
        *[F.col(f"_base.{p}").alias(f"base_{p}") for p in payload],
    )


def intact_base(bases: DataFrame, hashes: DataFrame) -> DataFrame:
    """Bases whose artefact hashes true at the site."""
    return bases.join(hashes.select("artefact", "sha256").distinct(), ["artefact", "sha256"], "left_semi")


def newest_marks(marks: DataFrame) -> DataFrame:
    """The newest mark of every database by the stamp in its own name; foreign names are ignored."""
    stamped = marks.withColumn("_stamp", N.name_stamp(F.col("name"), F.col("db"))).filter(F.col("_stamp").isNotNull())
    w = Window.partitionBy("db").orderBy(F.col("_stamp").desc(), F.col("name").asc())
    return stamped.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_stamp")


def pick_latest_pair(marks: DataFrame, bases: DataFrame, flavour: str, db: str | None = None) -> DataFrame:
    """``db, mark, base, status`` per database; AMBIGUOUS when several could be meant."""
    wanted = marks if db is None else marks.filter(F.col("db") == db)
    newest = newest_marks(wanted)
    own = bases.filter(N.name_stamp(F.col("name"), F.col("db")).isNotNull())
    picked = reachable_base(newest, own, flavour).select("db", F.col("name").alias("mark"), "base")
    several = F.lit(False) if db is not None else newest.agg(F.count("*")).scalar() > 1
    return picked.withColumn(
        "status", F.when(several, "AMBIGUOUS").when(F.col("base").isNull(), "UNREACHABLE").otherwise("OK")
    )


def _spread(pairs: DataFrame, *keep: Column | str) -> DataFrame:
    """``keep, idx``: a row for every index from base to mark."""
    pick = pairs.filter(F.col("base_idx").isNotNull() & (F.col("base_idx") <= F.col("mark_idx")))
    return pick.select(*keep, F.explode(F.sequence("base_idx", "mark_idx")).alias("idx"))


def _named(spread: DataFrame, flavour: str, *keep: str) -> DataFrame:
    suffix = F.when(F.col("encrypted"), F.lit(N.ENC_SUFFIX)).otherwise(F.lit(""))
    return spread.select(*keep, F.concat(N.file_name(F.col("series"), F.col("idx"), flavour, F.col("_segment")), suffix).alias("name"))


def required_chain(pairs: DataFrame, flavour: str, inventory: DataFrame | None = None,
                   segment_bytes: Column | int = N.DEFAULT_SEGMENT_BYTES) -> DataFrame:
    """``mark, series, idx, name`` of every file from base to mark.

    ``pairs``: ``mark, series, base_idx, mark_idx, encrypted``. History entries of the inventory
    (``mark, name``) join as a set, without an index."""
    files = _named(_spread(pairs, "mark", "series", "encrypted", N.col_of(segment_bytes).alias("_segment")), flavour, "mark", "series", "idx")
    if inventory is None:
        return files
    history = inventory.filter(N.bare_name(F.col("name")).rlike(r"\.history$")).select("mark", "name").distinct()
    return files.unionByName(history, allowMissingColumns=True)


def chain_files(pairs: DataFrame, flavour: str, segment_bytes: Column | int = N.DEFAULT_SEGMENT_BYTES) -> DataFrame:
    """``series, idx, name`` of every file that some chain needs, once.

    The longest chain from a base holds its shorter ones, so it alone is spread, and files meet by index before they are named."""
    keys = ["series", "encrypted", "_segment"]
    longest = pairs.withColumn("_segment", N.col_of(segment_bytes)).groupBy(*keys, "base_idx").agg(F.max("mark_idx").alias("mark_idx"))
    return _named(_spread(longest, *keys).distinct(), flavour, "series", "idx")


def _judged(required: DataFrame, inventory: DataFrame, files: DataFrame, word: Column, unnamed: str, out: str) -> DataFrame:
    """``mark, name, out``: every required file once, with the ``word`` on each of its inventory rows, or ``unnamed``.

    ``word`` reads ``_inv``, the inventory's hash, and ``_there`` and ``_held`` of the file that has the name. The inventory
    meets the files first: hashes pass one shuffle, and only words meet the required files."""
    held = files.select("name", F.col("sha256").alias("_there"), F.lit(True).alias("_held"))
    judged = (
        inventory.select("mark", "name", F.col("sha256").alias("_inv")).join(held, "name", "left")
        .select("mark", "name", word.alias(out))
    )
    return (
        required.select("mark", "name").distinct()
        .join(judged, ["mark", "name"], "left")
        .select("mark", "name", F.coalesce(out, F.lit(unnamed)).alias(out))
    )


def audit_chain(required: DataFrame, inventory: DataFrame, listing: DataFrame) -> DataFrame:
    """``mark, name, status``: what the inventory never stood on, what the site lacks, what differs.

    ``inventory``: ``mark, name, sha256``; ``listing``: ``name, sha256`` of the site."""
    status = (
        F.when(F.coalesce("_inv", F.lit("")) == "", "NOT_IN_INVENTORY")
        .when(F.col("_held").isNull(), "ABSENT")
        .when(~F.col("_inv").eqNullSafe(F.col("_there")), "DIFFERS")
        .otherwise("OK")
    )
    return _judged(required, inventory, listing, status, "NOT_IN_INVENTORY", "status")


def required_or_inventory(required: DataFrame, inventory: DataFrame, pairs: DataFrame) -> DataFrame:
    """The chain of every mark with a base; for a mark without one, its whole inventory."""
    baseless = pairs.filter(F.col("base_idx").isNull()).select("mark")
    fallback = inventory.select("mark", "name").join(baseless, "mark", "left_semi")
    return required.select("mark", "name").unionByName(fallback).distinct()


def ship_plan(required: DataFrame, inventory: DataFrame, site: DataFrame) -> DataFrame:
    """``name, action``: SHIP what is absent, SKIP what is true, RESHIP what only has the name.

    Chains are estimated as small as the pairs they are spread from, so both joins are told to sort: a broadcast that goes by
    the estimate passes every link through the driver."""
    want = required.select("mark", "name").join(inventory.select("mark", "name", "sha256").hint("merge"), ["mark", "name"])
    files = want.groupBy("name").agg(F.max("sha256").alias("sha256"))
    held = site.select("name", F.col("sha256").alias("_site"), F.lit(True).alias("_held")).hint("merge")
    action = (
        F.when(F.col("_held").isNull(), "SHIP").when(F.col("sha256").eqNullSafe(F.col("_site")), "SKIP").otherwise("RESHIP")
    )
    return files.join(held, "name", "left").select("name", "sha256", action.alias("action"))


def fetch_plan(required: DataFrame, inventory: DataFrame, local: DataFrame) -> DataFrame:
    """``mark, name, action``: REFUSE_UNVOUCHED, HAVE, REFUSE_OVERWRITE or FETCH."""
    action = (
        F.when(F.coalesce("_inv", F.lit("")) == "", "REFUSE_UNVOUCHED")
        .when(F.col("_held").isNull(), "FETCH")
        .when(F.col("_inv").eqNullSafe(F.col("_there")), "HAVE")
        .otherwise("REFUSE_OVERWRITE")
    )
    return _judged(required, inventory, local, action, "REFUSE_UNVOUCHED", "action")


def check_archive(listing: DataFrame, flavour: str, segment_bytes: int | None = None) -> DataFrame:
    """Problem rows ``archive, subject, problem, detail`` over ``archive, name, bytes`` rows.

    The form (plain, encrypted) is read per archive; a mixed one is refused. Series are checked one
    by one for WAL; for binlogs a second series is a refusal. An archive without a log is a failure.

    What is folded per archive is written before it meets the files again: small, it needs no shuffle of theirs, and an
    archive of any size is never sorted in one task."""
    form = stored(archive_form(listing, flavour).select("archive", "form"), "archive-forms")
    formed = listing.join(form, "archive")
    enc = F.col("form") == "encrypted"
    log_kind = LOG_KIND[flavour]
    classed = formed.withColumn("kind", N.classify_file(F.col("name"), flavour, enc))
    mixed = form.filter("form = 'MIXED'").select(
        "archive", F.col("archive").alias("subject"), F.lit("MIXED_FORM").alias("problem"), F.lit("refused").alias("detail")
    )
    sound = classed.filter("form <> 'MIXED'")
    in_either = (N.classify_file(F.col("name"), flavour) == "stray") & (
        ~N.is_encrypted(F.col("name")) | (N.classify_file(F.col("name"), flavour, True) == "stray"))
    strays = classed.filter(F.when(F.col("form") == "MIXED", in_either).otherwise(F.col("kind") == "stray")).select(
        "archive", F.col("name").alias("subject"), F.lit("STRAY").alias("problem"), F.lit("not a log file").alias("detail")
    )
    counted = sound.groupBy("archive").agg(F.count_if(F.col("kind") == log_kind).alias("_logs"))
    empty = counted.filter("_logs = 0").select(
        "archive", F.col("archive").alias("subject"), F.lit("NO_LOGS").alias("problem"), F.lit("nothing could be recovered").alias("detail")
    )
    logs = sound.filter(F.col("kind") == log_kind)
    if flavour == "wal":
        if segment_bytes is None:
            seg = stored(logs.groupBy("archive", "form").agg(F.max("bytes").alias("_max")).select(
                "archive", N.infer_segment_bytes(F.col("_max"), enc).alias("_seg")
            ), "archive-segments")
            logs = logs.join(seg, "archive")
        else:
            logs = logs.withColumn("_seg", F.lit(segment_bytes).cast("bigint"))
    else:
        logs = logs.withColumn("_seg", F.lit(0).cast("bigint"))  # a plain counter has no segment size
    placed = logs.select(
        "archive", "name", "bytes", "_seg", enc.alias("_enc"),
        N.file_series(F.col("name"), flavour).alias("series"),
        N.file_index(F.col("name"), flavour, F.col("_seg")).alias("idx"),
    )
    label_seg = F.col("_seg") if flavour == "wal" else N.DEFAULT_SEGMENT_BYTES
    holes = missing_ranges(placed, ["archive", "series", "_seg", "_enc"])
    suffix = F.when(F.col("_enc"), F.lit(N.ENC_SUFFIX)).otherwise(F.lit(""))
    first = F.concat(N.file_name(F.col("series"), F.col("first"), flavour, label_seg), suffix)
    last = F.concat(N.file_name(F.col("series"), F.col("last"), flavour, label_seg), suffix)
    gaps = holes.select(
        "archive", N.range_label(first, last).alias("subject"), F.lit("MISSING").alias("problem"),
        F.concat(F.col("n").cast("string"), F.lit(" file(s)")).alias("detail"),
    )
    found = mixed.unionByName(strays).unionByName(empty).unionByName(gaps)
    if flavour == "wal":
        # a whole segment's ciphertext has one size too: the largest present stands for it
        largest = stored(placed.groupBy("archive").agg(F.max("bytes").alias("_largest")), "archive-sizes")
        plain = F.lit(segment_bytes).cast("bigint") if segment_bytes is not None else F.col("_largest")
        sizes = placed.join(largest, "archive").withColumn(
            "expected_bytes", F.when(F.col("_enc"), F.col("_largest")).otherwise(plain)
        ).filter("bytes <> expected_bytes")
        short = sizes.select(
            "archive", F.col("name").alias("subject"), F.lit("WRONG_SIZE").alias("problem"),
            F.concat_ws(" of ", F.col("bytes").cast("string"), F.col("expected_bytes").cast("string")).alias("detail"),
        )
        return found.unionByName(short)
    several = single_series(placed).filter("status = 'REFUSED'").select(
        "archive", F.col("archive").alias("subject"), F.lit("SEVERAL_SERIES").alias("problem"),
        F.concat(F.col("n_series").cast("string"), F.lit(" series")).alias("detail"),
    )
    return found.unionByName(several)
