"""Queries over row texts, fingerprints, contents and schema object digests."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from tableproof import fixtures as X
from tableproof.functions.canonical import canonical_row
from tableproof.operators import fingerprint as P
from tableproof.operators import objects as O
from tableproof.registry import register
from tableproof.session import ensure_checkpoint_dir, settle
from tableproof.sources.objects import read_object_catalog

# --- oracle building blocks ------------------------------------------------------

ORDERS_COLS = ["CAST(o_orderkey AS VARCHAR)", "CAST(o_custkey AS VARCHAR)", "o_orderstatus", "CAST(o_totalprice AS VARCHAR)", "CAST(o_orderdate AS VARCHAR)", "o_orderpriority"]
LINEITEM_COLS = [
    f"CAST({c} AS VARCHAR)"
    for c in "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()
] + ["l_returnflag", "l_linestatus", "CAST(l_shipdate AS VARCHAR)"]
CONV_COLS = ["CAST(conv_id AS VARCHAR)", "CAST(turn AS VARCHAR)", "role", "text"]


def strict_sql(cols: list[str]) -> str:
    """Casts end with ``;``, texts carry their length."""
    plain = "CAST("
    return "(" + " || ".join(
        f"coalesce({c}, 'N') || ';'" if c.startswith(plain) else f"coalesce('V' || strlen({c}) || ':' || {c}, 'N')" for c in cols
    ) + ")"


def sum_sql(rows: str, keys: str = "") -> str:
    """Rows ``(keys..., r)`` to the rendered sum fingerprint."""
    lanes = ", ".join(
        f"CAST(sum(CAST(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT) AS DECIMAL(38,0))) AS VARCHAR) AS l{i}" for i in range(2)
    )
    k = f"{keys}, " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    return (
        f"SELECT {k}'md5/sum' AS algo, md5(concat_ws(':', l0, l1)) AS digest, n, "
        f"md5(concat_ws(':', l0, l1)) || ':' || n AS fingerprint "
        f"FROM (SELECT {k}count(*) AS n, {lanes} FROM (SELECT {k}md5(r) AS h FROM ({rows}) r0) h0{g}) s0"
    )


def folded_sql(leaves: str, algo: str, keys: str = "") -> str:
    """Leaves ``(keys.., prefix, n, d)`` of six digits to ``keys.., n, digest``: six, three, no digits."""
    g = f"{keys}, " if keys else ""
    middle = (f"SELECT {g}substr(prefix, 1, 3) AS prefix, sum(n) AS n, {algo}(string_agg(prefix || ':' || d, chr(10) ORDER BY prefix || ':' || d)) AS d "
              f"FROM ({leaves}) l0 GROUP BY {g}substr(prefix, 1, 3)")
    return (f"SELECT {g}CAST(sum(n) AS BIGINT) AS n, {algo}(string_agg(prefix || ':' || d, chr(10) ORDER BY prefix || ':' || d)) AS digest "
            f"FROM ({middle}) m0" + (f" GROUP BY {keys}" if keys else ""))


def tree_sql(hashes: str, algo: str, label: str) -> str:
    """Rows ``(h)`` to the rendered tree fingerprint."""
    leaves = (f"SELECT substr(h, 1, 6) AS prefix, sum(c) AS n, {algo}(string_agg(h || ':' || c, chr(10) ORDER BY h || ':' || c)) AS d "
              f"FROM (SELECT h, count(*) AS c FROM ({hashes}) h0 GROUP BY h) c0 GROUP BY 1")
    return (
        f"SELECT '{label}' AS algo, digest, n, digest || ':' || n AS fingerprint FROM ({folded_sql(leaves, algo)}) t0"
    )


ORDERS_ROWS = f"SELECT {strict_sql(ORDERS_COLS)} AS r FROM ({X.ORDERS_COPY}) o"
LINEITEM_ROWS = f"SELECT {strict_sql(LINEITEM_COLS)} AS r FROM ({X.LINEITEM_PLAIN}) l"
CONV_ROWS = f"SELECT {strict_sql(CONV_COLS)} AS r FROM ({X.CONVERSATIONS_COPY}) c"

SQLITE_COLS = [ORDERS_COLS[0], ORDERS_COLS[1], "CASE WHEN o_orderstatus IS NULL THEN 'NULL' ELSE '''' || replace(o_orderstatus, '''', '''''') || '''' END",
               ORDERS_COLS[3], "'''' || CAST(o_orderdate AS VARCHAR) || ''''",
               "'''' || replace(o_orderpriority, '''', '''''') || ''''"]


@register(
    "b1_canonical_row",
    f"SELECT {strict_sql(ORDERS_COLS)} AS strict, concat_ws('|', {', '.join(ORDERS_COLS)}) AS pg, "
    f"concat_ws('|', {', '.join(f'coalesce({c}, chr(60) || chr(78) || chr(85) || chr(76) || chr(76) || chr(62))' for c in ORDERS_COLS)}) AS mysql, "
    f"concat_ws(chr(31), {', '.join(SQLITE_COLS)}) AS sqlite FROM ({X.ORDERS_COPY}) o",
)
def b1(spark, sf_dir):
    o = X.view(spark, sf_dir, X.ORDERS_COPY)
    return o.select(*[canonical_row(o, mode).alias(mode) for mode in ("strict", "pg", "mysql", "sqlite")])


@register("e2_fingerprint_tree", tree_sql(f"SELECT sha256(r) AS h FROM ({LINEITEM_ROWS}) z", "sha256", "sha256/tree6"))
def e2(spark, sf_dir):
    return P.fingerprint_tree(X.view(spark, sf_dir, X.LINEITEM_PLAIN))


@register("e2_fingerprint_tree_duplicates", tree_sql(f"SELECT sha256(r) AS h FROM ({CONV_ROWS}) z", "sha256", "sha256/tree6"))
def e2_duplicates(spark, sf_dir):
    return P.fingerprint_tree(X.view(spark, sf_dir, X.CONVERSATIONS_COPY))


@register("e3_fingerprint_sum", sum_sql(LINEITEM_ROWS))
def e3(spark, sf_dir):
    return P.fingerprint_sum(X.view(spark, sf_dir, X.LINEITEM_PLAIN))


@register("e3_fingerprint_sum_values", "SELECT 'xxhash64/sum' AS algo, count(*) AS n, true AS same_after_split FROM {lineitem}")
def e3_values(spark, sf_dir):
    """The value-hash digest has no counterpart in the oracle; what is compared is that a table and the
    merged states of its two halves agree."""
    rows = X.view(spark, sf_dir, X.LINEITEM_PLAIN)
    parity = F.col("l_orderkey") % 2
    halves = P.sum_state(P.row_lanes(rows.withColumn("_half", parity), algo="xxhash64", keys=["_half"]), ["_half"], "xxhash64")
    merged = P.render_state(P.merge_states(halves, algo="xxhash64"), algo="xxhash64").select(F.col("fingerprint").alias("_merged"), "n")
    return P.fingerprint_sum(rows, algo="xxhash64").join(merged, "n").select("algo", "n", (F.col("fingerprint") == F.col("_merged")).alias("same_after_split"))


#: Values that a hash of bare bits would take for one another, and pairs that are one row whatever way they come.
MUST_DIFFER = [
    ("scale", "CAST(l_quantity AS DECIMAL(10,2))", "CAST(l_quantity / 10 AS DECIMAL(10,3))"),
    ("date_int", "date_add(DATE '1970-01-01', CAST(l_linenumber AS INT))", "CAST(l_linenumber AS INT)"),
    ("bool_int", "l_linenumber > 0", "1"),
    ("float_digit", "l_extendedprice", "l_extendedprice + 1e-9"),
    ("null_zero", "CAST(NULL AS INT)", "0"),
    ("text_number", "CAST(l_partkey AS STRING)", "l_partkey"),
]
MUST_AGREE = [("same", "l_partkey", "l_partkey"), ("cast_back", "l_quantity", "CAST(CAST(l_quantity AS DECIMAL(18,2)) AS DOUBLE)")]


@register("e3_value_pairs", " UNION ALL ".join(
    f"SELECT '{n}' AS pair, {str(same).lower()} AS equal, (SELECT count(*) FROM {{lineitem}}) AS n"
    for pairs, same in ((MUST_DIFFER, False), (MUST_AGREE, True)) for n, _, _ in pairs))
def e3_value_pairs(spark, sf_dir):
    """Whole columns, one side's values against the other's, by the value hash."""
    rows = X.load(spark, sf_dir, "lineitem")
    out = None
    for name, a, b in [*MUST_DIFFER, *MUST_AGREE]:
        left = P.fingerprint_sum(rows.selectExpr(f"{a} AS v"), algo="xxhash64").select("fingerprint", "n")
        right = P.fingerprint_sum(rows.selectExpr(f"{b} AS v"), algo="xxhash64").select(F.col("fingerprint").alias("other"), "n")
        one = left.join(right, "n").select(F.lit(name).alias("pair"), (F.col("fingerprint") == F.col("other")).alias("equal"), "n")
        out = one if out is None else out.union(one)
    return out


@register(
    "e3_fingerprint_sum_grouped",
    sum_sql(f"SELECT o_orderpriority, {strict_sql(ORDERS_COLS[:5])} AS r FROM ({X.ORDERS_COPY}) o", "o_orderpriority"),
)
def e3_grouped(spark, sf_dir):
    return P.fingerprint_sum(X.view(spark, sf_dir, X.ORDERS_COPY), keys=["o_orderpriority"])


@register("e3_merge_states", sum_sql(ORDERS_ROWS))
def e3_merge(spark, sf_dir):
    o = X.view(spark, sf_dir, X.ORDERS_COPY)
    odd = P.row_lanes(o.filter("o_orderkey % 2 = 1"))
    even = P.row_lanes(o.filter("o_orderkey % 2 = 0"))
    return P.render_state(P.merge_states(P.sum_state(odd).unionByName(P.sum_state(even))))


@register(
    "e4_chunked_digest",
    "WITH t AS (SELECT doc_id AS id, encode(text) AS b FROM {documents} UNION ALL SELECT -1 - page_id, encode(html) FROM {pages} "
    "UNION ALL SELECT 1000000000 + doc_id, encode('') FROM {labels}), "
    "c AS (SELECT id, w, o, md5(b[o + 1:o + w]) AS d FROM (SELECT id, b, w, unnest(range(0, greatest(octet_length(b), 1), w)) AS o "
    "FROM t, (SELECT unnest([64, 1048576]) AS w) k) x) "
    "SELECT id, max(CASE WHEN w = 64 THEN d END) AS by_64, max(CASE WHEN w = 1048576 THEN d END) AS by_1m "
    "FROM (SELECT id, w, md5(string_agg(d, '' ORDER BY o)) AS d FROM c GROUP BY id, w) z GROUP BY id",
)
def e4(spark, sf_dir):
    docs = X.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    pages = X.load(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("id"), F.col("html").alias("body"))
    empty = X.load(spark, sf_dir, "labels").select((F.lit(1000000000) + F.col("doc_id")).alias("id"), F.lit("").alias("body"))
    both = docs.unionByName(pages).unionByName(empty)
    return both.select(
        "id",
        P.chunked_digest(F.col("body"), 64).alias("by_64"),
        P.chunked_digest(F.col("body"), 1048576).alias("by_1m"),
    )


@register(
    "e5_content_fingerprint",
    "SELECT doc_id AS id, sha256(text) || ':' || strlen(text) AS fingerprint FROM {documents} "
    "UNION ALL SELECT -1 - page_id, sha256(html) || ':' || strlen(html) FROM {pages}",
)
def e5(spark, sf_dir):
    docs = X.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    pages = X.load(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("id"), F.col("html").alias("body"))
    return docs.unionByName(pages).select("id", P.content_fingerprint(F.col("body")).alias("fingerprint"))


# --- schema objects ----------------------------------------------------------------

CLASSES = ["indexes", "constraints", "views", "routines", "triggers", "extensions"]
CLASS_SQL = "(SELECT unnest(['indexes', 'constraints', 'views', 'routines', 'triggers', 'extensions']) AS class)"


def object_sql(definition: str, where: str = "true") -> str:
    """``class, n, digest`` of FX7 for every expected class."""
    hashes = f"SELECT class, md5(translate({definition}, chr(13) || chr(10), '  ')) AS h FROM ({X.OBJECTS}) o WHERE {where}"
    leaves = (
        "SELECT class, substr(h, 1, 6) AS prefix, sum(c) AS n, md5(string_agg(h || ':' || c, chr(10) ORDER BY h || ':' || c)) AS d "
        f"FROM (SELECT class, h, count(*) AS c FROM ({hashes}) h0 GROUP BY class, h) c0 GROUP BY 1, 2"
    )
    roots = folded_sql(leaves, "md5", "class")
    return (
        "SELECT 'app' AS db, k.class, coalesce(n, 0) AS n, coalesce(n, 0) || ':' || coalesce(digest, md5('')) AS digest "
        f"FROM {CLASS_SQL} k LEFT JOIN ({roots}) r ON k.class = r.class"
    )


def object_catalog(spark, sf_dir, copy: bool = False):
    o = X.view(spark, sf_dir, X.OBJECTS).withColumn("db", F.lit("app"))
    if not copy:
        return o.select("db", "class", "name", "definition")
    return o.filter("in_copy").select("db", "class", "name", F.col("copy_definition").alias("definition"))


def digests_of(objects):
    listed = objects.sparkSession.createDataFrame([("app", c) for c in CLASSES], "db string, class string")
    return O.object_digest(objects, listed)


@register("a12_object_catalog", f"SELECT 'app' AS db, class, count(*) AS n, min(definition) AS first_definition FROM ({X.OBJECTS}) o GROUP BY class")
def a12(spark, sf_dir):
    catalog = object_catalog(spark, sf_dir)
    return catalog.groupBy("db", "class").agg(F.count("*").alias("n"), F.min("definition").alias("first_definition"))


# One table, two views and a function, made of the tables, in a database that is gone afterwards.
CATALOGUE = {
    "tables": ["nations(n_nationkey int, n_name string, regions bigint)"],
    "views": ["brands(p_brand string, parts bigint NOT NULL)", "rich(c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string)"],
}


@register("a12_read_object_catalog", " UNION ALL ".join(
    f"SELECT '{kind}' AS class, '{text.split('(')[0]}' AS name, '{text}' AS definition, (SELECT count(*) FROM {{nation}}) AS nations"
    for kind, texts in CATALOGUE.items() for text in texts) + " UNION ALL SELECT 'routines', 'twice', 'twice', (SELECT count(*) FROM {nation})")
def a12_read(spark, sf_dir):
    """What the operator reads out of the session catalogue, and that the table it lists holds its rows."""
    db = f"proof_{uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {db} LOCATION '{ensure_checkpoint_dir(spark)}/{db}'")
    try:
        n = spark.sql("SELECT n_nationkey, n_name, count(r_regionkey) AS regions FROM {n} LEFT JOIN {r} ON n_regionkey = r_regionkey GROUP BY 1, 2",
                      n=X.load(spark, sf_dir, "nation"), r=X.load(spark, sf_dir, "region"))
        n.write.saveAsTable(f"{db}.nations")
        spark.sql(f"CREATE VIEW {db}.brands AS SELECT p_brand, count(*) AS parts FROM parquet.`{sf_dir}/part.parquet` GROUP BY p_brand")
        spark.sql(f"CREATE VIEW {db}.rich AS SELECT * FROM parquet.`{sf_dir}/customer.parquet` WHERE c_acctbal > 0")
        spark.sql(f"CREATE FUNCTION {db}.twice(x BIGINT) RETURNS BIGINT RETURN 2 * x")
        rows = settle(read_object_catalog(spark, db))
        held = spark.table(f"{db}.nations").agg(F.count(F.lit(1))).first()[0]
    finally:
        spark.sql(f"DROP DATABASE {db} CASCADE")
    # what a function is made of is the engine's own text
    told = F.when(F.col("class") == "routines", F.col("name")).otherwise(F.col("definition"))
    return rows.select("class", "name", told.alias("definition"), F.lit(held).cast("bigint").alias("nations"))


@register("e6_object_digest", object_sql("definition"))
def e6(spark, sf_dir):
    return digests_of(object_catalog(spark, sf_dir))


INDEX_COLUMNS = (
    "SELECT DISTINCT 'app' AS db, concat('ix_', CAST(l_orderkey AS STRING)) AS index, 'lineitem' AS tbl, l_linenumber AS seq, "
    "concat('c', CAST(l_partkey AS STRING)) AS column_name FROM {lineitem}"
)


@register(
    "e7_index_signature",
    f"SELECT db, 'indexes' AS class, index || ' on ' || tbl || '(' || string_agg(column_name, ',' ORDER BY seq, column_name) || ')' AS definition "
    f"FROM ({INDEX_COLUMNS}) i GROUP BY db, index, tbl",
)
def e7(spark, sf_dir):
    cols = X.view(spark, sf_dir, INDEX_COLUMNS).withColumnsRenamed({"tbl": "table", "column_name": "column"})
    return O.index_signature(cols)


@register(
    "e8_view_signature",
    f"SELECT 'app' AS db, 'views' AS class, name || ' ' || md5(definition) AS definition FROM ({X.OBJECTS}) o WHERE class = 'views'",
)
def e8(spark, sf_dir):
    return O.view_signature(object_catalog(spark, sf_dir).filter("class = 'views'"))


@register(
    "e9_completeness_witness",
    f"SELECT count(*) AS n, CAST(sum(strlen(r)) AS BIGINT) AS row_octets, strlen(string_agg(r, chr(10))) AS joined_octets FROM ({LINEITEM_ROWS}) z",
)
def e9(spark, sf_dir):
    return P.completeness_witness(X.view(spark, sf_dir, X.LINEITEM_PLAIN))
