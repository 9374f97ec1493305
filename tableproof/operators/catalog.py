"""Catalogues of artefacts and manifests: ownership, pairs, audits, the newest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableproof.functions import names as N


def own_database(df: DataFrame, db: Column | str, name: str = "name") -> DataFrame:
    """Only names stamped right after ``db_``; a sibling never counts."""
    return df.filter(N.name_stamp(F.col(name), db).isNotNull())


def by_kind(df: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Manifests of the given kinds; a manifest without a kind is a dump."""
    return df.filter(F.coalesce(F.nullif(F.col("kind"), F.lit("")), F.lit("dump")).isin(*kinds))


def newest_per_db(names: DataFrame, name: str = "name") -> DataFrame:
    """``db, stamp, name``: the newest stamped name of every database, siblings apart."""
    stamped = names.select(
        N.artefact_db(F.col(name)).alias("db"), N.artefact_stamp(F.col(name)).alias("stamp"), F.col(name).alias("name")
    ).filter(F.col("stamp").isNotNull())
    top = F.max(F.struct("stamp", "name"))
    return stamped.groupBy("db").agg(top.alias("_top")).select("db", "_top.stamp", "_top.name")


def stale_databases(names: DataFrame, now: int, days: int, name: str = "name") -> DataFrame:
    """Databases whose newest stamp lies before ``now - days``; exactly at it is fresh."""
    cutoff = N.stamp_text(now - days * N.DAY)
    newest = newest_per_db(names, name).filter(F.col("stamp") < cutoff)
    return newest.select("db", "stamp", N.age_days(N.stamp_epoch(F.col("stamp")), now).alias("age_days"))


def ambiguous_selection(manifests: DataFrame, want: str | None = None) -> DataFrame:
    """The databases a selection could mean; refused when it names none and there are several."""
    dbs = manifests.select("db").distinct()
    if want is not None:
        return dbs.filter(F.col("db") == want).select(
            "db", F.lit(1).cast("bigint").alias("n_databases"), F.lit(False).alias("refused")
        )
    n = dbs.agg(F.count("*").alias("n_databases")).scalar()
    return dbs.select("db", n.alias("n_databases")).withColumn("refused", F.col("n_databases") > 1)


def pick_latest(manifests: DataFrame) -> DataFrame:
    """Per database the manifest with the newest order key; a tie keeps the first name."""
    keyed = manifests.withColumn("order_key", N.order_key(F.col("name"), F.col("created_at"))).filter(
        F.coalesce("order_key", F.lit("")) != ""
    )
    w = Window.partitionBy("db").orderBy(F.col("order_key").desc(), F.col("name").asc())
    return keyed.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def newest_manifest(listing: DataFrame, db: Column | str, *keys: str) -> DataFrame:
    """The newest manifest *name* of this database per ``keys``; temporaries and mtimes are ignored."""
    own = own_database(listing, db).filter(N.classify_file(F.col("name"), "site") == "manifest")
    return own.groupBy(*keys).agg(F.max("name").alias("name"))


def complete_pairs(artefacts: DataFrame, manifests: DataFrame) -> DataFrame:
    """Artefacts whose manifest is present at the same site."""
    present = manifests.select("site", F.col("name").alias("_manifest")).distinct()
    return (
        artefacts.withColumn("_manifest", N.manifest_for(F.col("name")))
        .join(present, ["site", "_manifest"], "left_semi")
        .select(*artefacts.columns)
    )


def uncovered_artefacts(listing: DataFrame, manifests: DataFrame) -> DataFrame:
    """Names of artefacts no manifest vouches for."""
    artefacts = listing.filter(N.classify_file(F.col("name"), "site") == "artefact").select("site", "name").distinct()
    vouched = artefacts.withColumn("_manifest", N.manifest_for(F.col("name")))
    present = manifests.select("site", F.col("name").alias("_manifest")).distinct()
    return vouched.join(present, ["site", "_manifest"], "left_anti").select("site", "name")


def audit_site(listing: DataFrame, manifests: DataFrame) -> DataFrame:
    """Audit a site: ``site, name, status``.

    ``listing``: ``site, name, sha256`` with the hash taken where the bytes are (null for files
    nobody hashed). ``manifests``: ``site, name, artefact, sha256``."""
    # files and promises meet once, by the manifest name a file should have; a promise under another name
    # than its own is told to its own name's group by a row of its own
    name = F.col("name")
    kind = N.classify_file(name, "site")
    files = listing.select("site", N.manifest_for(name).alias("_key"),
                           F.struct("name", F.col("sha256").alias("sha"), kind.alias("kind")).alias("_file"))
    home = N.manifest_for(F.col("artefact"))
    promises = manifests.select(
        "site", name, F.struct("name", "artefact", F.col("sha256").alias("sha")).alias("_promise"),
        F.explode(F.array_distinct(F.array(F.coalesce(home, name), name))).alias("_key"), F.coalesce(home, name).alias("_home"))
    promises = promises.select("site", "_key", F.when(F.col("_key") == F.col("_home"), F.col("_promise")).alias("_promise"),
                               (F.col("_key") == name).alias("_named"))
    met = files.unionByName(promises, allowMissingColumns=True).groupBy("site", "_key").agg(
        F.collect_list("_file").alias("_files"), F.collect_list("_promise").alias("_promises"),
        F.coalesce(F.max("_named"), F.lit(False)).alias("_named"))

    def finding(what, status):
        return F.struct(what.alias("name"), status.alias("status"))

    def judged(promise):
        same = F.filter("_files", lambda f: f["name"] == promise["artefact"])
        sha = F.array_max(F.transform(same, lambda f: f["sha"]))
        return finding(promise["name"], F.when(F.size(same) == 0, "ARTEFACT_MISSING").when(~promise["sha"].eqNullSafe(sha), "ROT").otherwise("OK"))

    orphans = F.array_distinct(F.transform(
        F.filter("_files", lambda f: (f["kind"] == "artefact") & ~F.col("_named")), lambda f: f["name"]))
    found = F.concat(
        F.transform("_promises", judged),
        F.transform(F.filter("_files", lambda f: f["kind"] == "part"), lambda f: finding(f["name"], F.lit("PUSH_DIED"))),
        F.transform(orphans, lambda n: finding(n, F.lit("NO_MANIFEST"))))
    return met.select("site", F.explode(found).alias("_f")).select("site", "_f.name", "_f.status")


def audit_summary(audit: DataFrame) -> DataFrame:
    """Per site: problems, clean pairs, and whether anything was proven at all."""
    folded = audit.groupBy("site").agg(
        F.count_if(F.col("status") != "OK").alias("problems"), F.count_if(F.col("status") == "OK").alias("clean_pairs")
    )
    return folded.select(
        "*",
        F.when(F.col("problems") > 0, "FAILED").when(F.col("clean_pairs") == 0, "NOTHING_PROVEN").otherwise("CONSISTENT").alias("status"),
    )
