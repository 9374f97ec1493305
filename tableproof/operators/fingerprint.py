"""Order-independent fingerprints of whole tables.

Three methods with one contract (every column of every row, multiplicity counts, row order does not):

``sum``    mergeable. Each row's hash is cut into 60-bit lanes and the lanes are added up. One scan,
           map-side aggregation, one tiny row per task crosses the network. The default; it guards
           against faults, not against an adversary who crafts rows.
``tree``   collision resistant. Distinct row hashes with their counts are sorted and hashed inside
           leaves cut by hash prefix, leaf digests are folded upwards. Equal rows are counted before
           the shuffle, so a row repeated a billion times is one entry. Two shuffles of the hash's bytes
           and a few more per distinct row, which also serve the nodes above the leaves; leaves are
           uniform because they are cut from a hash.
Either method can carry a witness beside the digest: the bytes of the values it was taken of, summed up in the
same pass. A copy with as many rows and fewer bytes was cut, which a digest alone cannot say.
The method, its algorithm and the leaf prefix are in the ``algo`` label; fingerprints of unequal labels are
never compared. Nothing about a method follows the size of the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableproof.functions import digests as D
from tableproof.functions.canonical import canonical_row, hashable_columns, octets_sql, quoted
from tableproof.session import settle

METHODS = ("sum", "tree")
#: Hex digits of the leaf prefix: 16 million leaves, of which only those exist that have a hash.
LEAF_DIGITS = 6
FOLD_DIGITS = 3  # at most 4096 children per inner node


DEFAULT_ALGO = {"sum": "xxhash64", "tree": "sha256"}


def row_texts(df: DataFrame, mode: str = "strict", keys: Sequence[str] = ()) -> DataFrame:
    """``keys + row``: the canonical text of every row over the columns that are not keys."""
    body = df.drop(*keys) if keys else df
    return df.select(*keys, canonical_row(body, mode).alias("row"))


# --- witness -------------------------------------------------------------------


def completeness_witness(df: DataFrame, mode: str = "strict") -> DataFrame:
    """Row count, text bytes, and the length the joined text must have."""
    return row_texts(df, mode).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.octet_length("row").cast("bigint")), F.lit(0)).alias("row_octets"),
    ).select("n", "row_octets", F.greatest(F.lit(0), F.col("row_octets") + F.col("n") - 1).alias("joined_octets"))


# --- sum -------------------------------------------------------------------------


def lane_names(algo: str) -> list[str]:
    return [f"lane_{i}" for i in range(D.LANES[algo])]


def row_hashes(df: DataFrame, mode: str = "strict", algo: str = "sha256", keys: Sequence[str] = ()) -> DataFrame:
    """``keys, octets, h``: what every method needs of a row; the text itself goes no further."""
    return row_texts(df, mode, keys).selectExpr(
        *[quoted(k) for k in keys], "cast(octet_length(row) AS bigint) AS octets", f"{D.digest_sql('row', algo)} AS h"
    )


def row_lanes(df: DataFrame, mode: str = "strict", algo: str = "md5", keys: Sequence[str] = ()) -> DataFrame:
    """``keys, octets, lane_0 ..``: the row's hash cut into 60-bit numbers.

    ``xxhash64`` hashes the column values themselves and makes no text, which is several times
    cheaper per row; it knows the strict form only, and its octets are those of the values."""
    names = lane_names(algo)
    group = [quoted(k) for k in keys]
    if algo == "xxhash64":
        if mode != "strict":
            raise ValueError("xxhash64 lanes are taken from values, not from a text mode")
        body = df.drop(*keys).schema if keys else df.schema
        lanes = value_lanes(body, names)
        return df.selectExpr(*group, f"{octets_sql(body)} AS octets", *lanes)
    hashes = row_hashes(df, mode, algo, keys)
    return hashes.selectExpr(*group, "octets", *[f"{D.lane_sql('h', i)} AS {n}" for i, n in enumerate(names)])


def value_lanes(schema: T.StructType, names: Sequence[str]) -> list[str]:
    """Lanes of the column values. The columns' types seed the hash, so values whose bits agree under two types
    (a date and a number, 1.23 and 0.123 as decimals) do not."""
    values = hashable_columns(schema)
    nulls = [quoted(f.name) for f in schema.fields]
    kinds = ",".join(f.dataType.simpleString() for f in schema.fields)
    return [f"{D.column_lane_sql(values, nulls, D.type_seed(kinds, i))} AS {n}" for i, n in enumerate(names)]


def with_lanes(df: DataFrame, algo: str = "md5") -> DataFrame:
    """All columns of ``df`` plus the lanes and octets of its rows, for observing a table while it is written."""
    names = lane_names(algo)
    if algo == "xxhash64":
        return df.selectExpr("*", f"{octets_sql(df.schema)} AS _octets", *value_lanes(df.schema, names))
    texts = df.select("*", canonical_row(df).alias("_row_text"))
    hashed = texts.select("*", D.digest(F.col("_row_text"), algo).alias("_row_hash"))
    return hashed.selectExpr("*", "cast(octet_length(_row_text) AS bigint) AS _octets",
                             *[f"{D.lane_sql('_row_hash', i)} AS {n}" for i, n in enumerate(names)])


def sum_state(lanes: DataFrame, keys: Sequence[str] = (), algo: str = "md5") -> DataFrame:
    """Mergeable state of :func:`row_lanes` rows: count, octets and the lane sums.

    A lane is added up as five 12-bit limbs in plain bigints, which stay inside generated code and
    cannot overflow below 2e15 rows; the exact lane sum is put together once per group."""
    names = lane_names(algo)
    group = [quoted(k) for k in keys]
    limbs = [F.expr(D.limb_sum_sql(n, j)).alias(f"{n}_{j}") for n in names for j in range(D.LIMBS)]
    summed = lanes.groupBy(*keys).agg(F.expr("count(*)").alias("n"), F.expr("coalesce(sum(octets), 0L)").alias("octets"), *limbs)
    totals = [f"{D.lane_total_sql([f'{n}_{j}' for j in range(D.LIMBS)])} AS {n}" for n in names]
    return summed.selectExpr(*group, "n", "octets", *totals)


def merge_states(states: DataFrame, keys: Sequence[str] = (), algo: str = "md5") -> DataFrame:
    """State of a union from the states of its parts."""
    return states.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("octets").alias("octets"),
        *[F.sum(n).cast("decimal(38,0)").alias(n) for n in lane_names(algo)],
    )


def render_state(state: DataFrame, keys: Sequence[str] = (), algo: str = "md5", witness: bool = False) -> DataFrame:
    """``keys, algo, digest, n, fingerprint`` from a state, and with ``witness`` its ``octets``."""
    lanes = F.concat_ws(":", *[F.col(n).cast("string") for n in lane_names(algo)])
    return _rendered(state, keys, D.digest(lanes, "sha256" if algo == "sha256" else "md5"), f"{algo}/sum", witness)


def _rendered(df: DataFrame, keys: Sequence[str], hex_digest: Column, label: str, witness: bool = False) -> DataFrame:
    seen = ["octets"] if witness else []
    return df.select(*keys, F.lit(label).alias("algo"), hex_digest.alias("_d"), "n", *seen).select(
        *keys,
        "algo",
        F.when(F.col("n") == 0, F.lit("EMPTY")).otherwise(F.col("_d")).alias("digest"),
        "n",
        D.render(F.col("_d"), F.col("n")).alias("fingerprint"),
        *seen,
    )


def fingerprint_sum(df: DataFrame, mode: str = "strict", algo: str = "md5",
                    keys: Sequence[str] = (), witness: bool = False) -> DataFrame:
    return render_state(sum_state(row_lanes(df, mode, algo, keys), keys, algo), keys, algo, witness)


# --- tree ------------------------------------------------------------------------


def _prefix(h: Column, digits: int) -> Column:
    """The first hex digits of a binary hash."""
    return F.lower(F.substring(F.hex(F.substring(h, 1, (digits + 1) // 2)), 1, digits))


def _home_digits(depth: int) -> int:
    """Digits that rows are dealt by: those of the node above their leaf where there are enough such nodes."""
    return depth - FOLD_DIGITS if depth >= 2 * FOLD_DIGITS else depth


def _leaf_digests(hashes: DataFrame, keys: Sequence[str], depth: int, algo: str) -> DataFrame:
    """``keys, home, prefix, n, d`` of the leaves. Hashes travel as bytes, and leaves lie where their ``home``, the node
    above, lies, so that it is folded without another shuffle. Homes are cut from the hash, so tables of any sizes lie
    evenly; where a shallow tree has too few, leaves are dealt by their own prefix."""
    octets = ["octets"] if "octets" in hashes.columns else []
    seen = [F.sum(c).alias(c) for c in octets]
    counted = hashes.select(*keys, F.unhex("h").alias("h"), *octets).groupBy(*keys, "h").agg(F.count("*").alias("c"), *seen)
    home = _prefix(F.col("h"), _home_digits(depth))
    dealt = counted.repartition(home) if _home_digits(depth) < depth else counted
    dealt = dealt.select(*keys, home.alias("home"), "h", "c", *octets)
    entry = F.concat_ws(":", F.lower(F.hex("h")), F.col("c").cast("string"))
    return dealt.groupBy(*keys, "home", _prefix(F.col("h"), depth).alias("prefix")).agg(
        F.sum("c").alias("n"), *seen,
        D.digest(F.array_join(F.sort_array(F.collect_list(entry)), "\n"), algo).alias("d"),
    )


def _folded(level: DataFrame, keys: Sequence[str], depth: int, algo: str) -> DataFrame:
    seen = [F.sum("octets").alias("octets")] if "octets" in level.columns else []
    child = F.concat_ws(":", F.col("prefix"), F.col("d"))
    node = F.col("home") if "home" in level.columns else F.substring("prefix", 1, depth)
    return level.groupBy(*keys, node.alias("prefix")).agg(
        F.sum("n").alias("n"), *seen,
        D.digest(F.array_join(F.sort_array(F.collect_list(child)), "\n"), algo).alias("d"),
    )


def tree_digests(hashes: DataFrame, keys: Sequence[str], depth: int, algo: str) -> DataFrame:
    """``keys, n, digest`` of the multiset of hex strings in column ``h``, and the sum of ``octets`` where there is one."""
    level = _leaf_digests(hashes, keys, depth, algo)
    if _home_digits(depth) == depth:
        level = level.drop("home")
    while depth > 0:
        depth = max(0, depth - FOLD_DIGITS)
        level = _folded(level, keys, depth, algo)
    return level.select(*keys, "n", F.col("d").alias("digest"), *(["octets"] if "octets" in hashes.columns else []))


def tree_levels(df: DataFrame, mode: str = "strict", algo: str = "sha256", keys: Sequence[str] = (),
                depth: int = LEAF_DIGITS) -> DataFrame:
    """``keys, depth, prefix, n, digest`` of every node of the tree, from the leaves to the root. Kept beside a
    manifest, in folders by ``depth``, it lets two copies be compared from the root down; the root's digest is the
    one of :func:`fingerprint_tree`."""
    leaves = settle(_leaf_digests(row_hashes(df, mode, algo, keys).drop("octets"), keys, depth, algo).drop("home"))
    level, out = leaves, [leaves.select(*keys, F.lit(depth).alias("depth"), "prefix", "n", F.col("d").alias("digest"))]
    while depth > 0:
        depth = max(0, depth - FOLD_DIGITS)
        level = _folded(level, keys, depth, algo)
        out.append(level.select(*keys, F.lit(depth).alias("depth"), "prefix", "n", F.col("d").alias("digest")))
    return reduce(DataFrame.unionByName, out)


def leaf_of(df: DataFrame, mode: str = "strict", algo: str = "sha256", keys: Sequence[str] = (), depth: int = LEAF_DIGITS) -> DataFrame:
    """``df`` plus ``prefix``, the leaf each of its rows is hashed in."""
    body = df.drop(*keys) if keys else df
    return df.withColumn("prefix", F.substring(D.digest(canonical_row(body, mode), algo), 1, depth))


def fingerprint_tree(df: DataFrame, mode: str = "strict", algo: str = "sha256",
                     keys: Sequence[str] = (), depth: int = LEAF_DIGITS, witness: bool = False) -> DataFrame:
    """``depth`` hex digits give up to ``16**depth`` leaves, whatever the number of rows; it is part of
    the ``algo`` label, and sides with unequal labels are not compared."""
    level = tree_digests(row_hashes(df, mode, algo, keys), keys, depth, algo)
    if not keys:
        level = level.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("digest").alias("digest"),
                          F.coalesce(F.max("octets"), F.lit(0)).alias("octets"))
    return _rendered(level, keys, F.col("digest"), f"{algo}/tree{depth}", witness)


# --- many tables -------------------------------------------------------------------


def fingerprint(df: DataFrame, method: str = "sum", mode: str = "strict", algo: str | None = None,
                keys: Sequence[str] = (), depth: int = LEAF_DIGITS, witness: bool = False) -> DataFrame:
    algo = algo or (DEFAULT_ALGO.get(method) if mode == "strict" or method != "sum" else "md5")
    if method == "sum":
        return fingerprint_sum(df, mode, algo, keys, witness)
    if method == "tree":
        return fingerprint_tree(df, mode, algo, keys, depth, witness)
    raise ValueError(f"unknown method {method!r}; one of {METHODS}")


def parse_label(label: str | None) -> tuple[str, str, int]:
    """``(method, algo, depth)`` of a label such as ``xxhash64/sum`` or ``sha256/tree6``; a bare algorithm is a sum."""
    algo, _, method = (label or "md5").partition("/")
    if method.startswith("tree"):
        return "tree", algo, int(method[len("tree"):] or LEAF_DIGITS)
    if method not in ("", "sum") or algo not in D.LANES:
        raise ValueError(f"fingerprint label {label!r} is not known")
    return "sum", algo, LEAF_DIGITS


def fingerprint_tables(tables: Mapping[str, DataFrame], db: str = "db", method: str = "sum",
                       mode: str = "strict", algo: str | None = None, depth: int = LEAF_DIGITS, witness: bool = False) -> DataFrame:
    """``db, table, algo, digest, n, fingerprint`` of every table, in one Spark job, and with ``witness`` its ``octets``.

    Each table is scanned and hashed on its own; only ``(table, octets, hash)`` meets in a union under
    one aggregation, whose partial step runs in the scanning tasks, so a table holding most of the
    rows costs nothing extra. A table without rows still gets its row."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {METHODS}")
    algo = algo or (DEFAULT_ALGO[method] if mode == "strict" or method != "sum" else "md5")
    spark = next(iter(tables.values())).sparkSession
    keys = ["db", "table"]
    listed = spark.createDataFrame([(db, name) for name in sorted(tables)], "db string, table string")
    take = row_lanes if method == "sum" else row_hashes
    parts = [take(df, mode, algo).select(F.lit(name).alias("table"), "*") for name, df in sorted(tables.items())]
    together = reduce(DataFrame.union, parts).select(F.lit(db).alias("db"), "*")
    if method == "sum":
        found = render_state(sum_state(together, keys, algo), keys, algo, witness)
        label = f"{algo}/sum"
    else:
        level = tree_digests(together, keys, depth, algo)
        label = f"{algo}/tree{depth}"
        found = _rendered(level, keys, F.col("digest"), label, witness)
    return listed.join(found, keys, "left").select(
        *keys,
        F.lit(label).alias("algo"),
        F.coalesce("digest", F.lit("EMPTY")).alias("digest"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
        F.coalesce("fingerprint", F.lit(D.EMPTY_FINGERPRINT)).alias("fingerprint"),
        *([F.coalesce("octets", F.lit(0).cast("bigint")).alias("octets")] if witness else []),
    )


# --- contents ----------------------------------------------------------------------


def content_fingerprint(content: Column) -> Column:
    """``<sha256>:<bytes>`` of one file or text."""
    return F.concat_ws(":", F.sha2(content, 256), F.octet_length(content).cast("string"))


def chunked_digest(content: Column, chunk: int, algo: str = "md5") -> Column:
    """Digest over the ordered digests of ``chunk``-byte pieces; an empty object is one empty piece.

    The pieces are byte slices made inside the row, so the object is never copied per piece and
    nothing is shuffled."""
    data = content.cast("binary")
    size = F.octet_length(data)
    offsets = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(chunk))
    pieces = F.transform(offsets, lambda o: D.digest(F.substring(data, o + 1, F.lit(chunk)), algo))
    return D.digest(F.array_join(pieces, ""), algo)
