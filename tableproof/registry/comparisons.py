"""Queries over the gates: tables, objects, extras, pairs, counters, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableproof import fixtures as X
from tableproof.operators import compare as C
from tableproof.operators import fingerprint as P
from tableproof.registry import register
from tableproof.registry.fingerprints import ORDERS_COLS, digests_of, object_catalog, object_sql, strict_sql
from tableproof.session import stored

# --- the copy matrix ---------------------------------------------------------------


def source_tables(spark, sf_dir):
    tables = {name: X.load(spark, sf_dir, name) for name in X.TABLES}
    tables["orders"] = X.view(spark, sf_dir, X.ORDERS_PLAIN)
    return tables


def copied_tables(spark, sf_dir):
    tables = source_tables(spark, sf_dir)
    tables["orders"] = X.view(spark, sf_dir, X.ORDERS_COPY)
    tables["pages"] = X.view(spark, sf_dir, X.PAGES_COPY)
    tables["conversations"] = X.view(spark, sf_dir, X.CONVERSATIONS_COPY)
    tables["ghost"] = tables["region"]
    tables["customer"] = tables["customer"].repartition(3)
    del tables["labels"]
    return tables


def matrix(spark, sf_dir, method="sum", algo=None):
    expected = P.fingerprint_tables(source_tables(spark, sf_dir), "app", method, algo=algo)
    actual = P.fingerprint_tables(copied_tables(spark, sf_dir), "app", method, algo=algo)
    return expected, actual


def table_matrix_sql() -> str:
    changed = {"orders": (X.ORDERS_PLAIN, X.ORDERS_COPY), "pages": ("SELECT * FROM {pages}", X.PAGES_COPY),
               "conversations": ("SELECT * FROM {conversations}", X.CONVERSATIONS_COPY)}
    parts = []
    for name in X.TABLES:
        if name == "labels":
            parts.append("SELECT 'labels' AS \"table\", 'ABSENT' AS status, (SELECT count(*) FROM {labels}) AS expected_n, CAST(NULL AS BIGINT) AS actual_n")
            continue
        a, b = changed.get(name, (f"SELECT * FROM {{{name}}}",) * 2)
        parts.append(
            f"SELECT '{name}' AS \"table\", CASE WHEN EXISTS (({a}) EXCEPT ALL ({b})) OR EXISTS (({b}) EXCEPT ALL ({a})) "
            f"THEN 'DIFFERS' ELSE 'OK' END AS status, (SELECT count(*) FROM ({a}) x) AS expected_n, (SELECT count(*) FROM ({b}) y) AS actual_n"
        )
    parts.append("SELECT 'ghost' AS \"table\", 'EXTRA' AS status, CAST(NULL AS BIGINT) AS expected_n, (SELECT count(*) FROM {region}) AS actual_n")
    return " UNION ALL ".join(parts)


TABLES_SQL = table_matrix_sql()
D1_SQL = f"SELECT 'app' AS db, \"table\", status, expected_n, actual_n, actual_n - expected_n AS row_delta FROM ({TABLES_SQL}) t"


@register("d1_compare_tables", D1_SQL)
def d1(spark, sf_dir):
    expected, actual = matrix(spark, sf_dir)
    return C.compare_tables(expected, actual).select("db", "table", "status", "expected_n", "actual_n", "row_delta")


@register("d1_compare_tables_tree", D1_SQL)
def d1_tree(spark, sf_dir):
    expected, actual = matrix(spark, sf_dir, "tree")
    return C.compare_tables(expected, actual).select("db", "table", "status", "expected_n", "actual_n", "row_delta")


@register("d1_compare_tables_values", D1_SQL)
def d1_values(spark, sf_dir):
    expected, actual = matrix(spark, sf_dir, algo="xxhash64")
    return C.compare_tables(expected, actual).select("db", "table", "status", "expected_n", "actual_n", "row_delta")


@register("d1_compare_tables_texts", D1_SQL)
def d1_texts(spark, sf_dir):
    expected, actual = matrix(spark, sf_dir, algo="md5")
    return C.compare_tables(expected, actual).select("db", "table", "status", "expected_n", "actual_n", "row_delta")


# --- witnesses and descent -------------------------------------------------------------

CUT = "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN substr(text, 1, 40) ELSE text END AS text, lang, source, n_chars FROM {documents}"
LESS = "SELECT * FROM {customer} WHERE c_custkey % 100 <> 1"


def octets_of(source: str, cols: str) -> str:
    return f"(SELECT CAST(sum({' + '.join(f'coalesce(strlen({c}), 0)' for c in cols.split())}) AS BIGINT) FROM ({source}) z)"


def witness_sql() -> str:
    rows = []
    for table, status, e, a, cols in (
        ("documents", "TRUNCATED", "SELECT * FROM {documents}", CUT, "text lang source"),
        ("pages", "DIFFERS", "SELECT * FROM {pages}", X.PAGES_COPY, "url html"),
        ("customer", "DIFFERS", "SELECT * FROM {customer}", LESS, "c_name c_mktsegment"),
        ("part", "OK", "SELECT * FROM {part}", "SELECT * FROM {part}", "p_name p_brand p_type"),
    ):
        rows.append(f"SELECT '{table}' AS \"table\", '{status}' AS status, (SELECT count(*) FROM ({a}) x) - (SELECT count(*) FROM ({e}) y) AS row_delta, "
                    f"{octets_of(a, cols)} - {octets_of(e, cols)} AS octet_delta")
    return " UNION ALL ".join(rows)


@register("e9_witness_compare", witness_sql())
def e9_witness(spark, sf_dir):
    """A column cut in every tenth row: as many rows, fewer bytes. Text appended, rows lost and a true copy beside it."""
    names = ("documents", "pages", "customer", "part")
    source = {n: X.load(spark, sf_dir, n) for n in names}
    copy = source | {"documents": X.view(spark, sf_dir, CUT), "pages": X.view(spark, sf_dir, X.PAGES_COPY), "customer": X.view(spark, sf_dir, LESS)}
    expected, actual = (P.fingerprint_tables(t, "app", witness=True) for t in (source, copy))
    return C.compare_tables(expected, actual).select("table", "status", "row_delta", "octet_delta")


def sides_sql() -> str:
    def hashed(source: str, e: int) -> str:
        return f"SELECT md5({strict_sql(ORDERS_COLS)}) AS h, {e} AS e, {1 - e} AS a FROM ({source}) o"

    return (f"SELECT substr(h, 1, 6) AS prefix, CAST(nullif(sum(e), 0) AS BIGINT) AS expected_n, CAST(nullif(sum(a), 0) AS BIGINT) AS actual_n FROM "
            f"(SELECT h, sum(e) AS e, sum(a) AS a FROM ({hashed(X.ORDERS_PLAIN, 1)} UNION ALL {hashed(X.ORDERS_COPY, 0)}) u GROUP BY h) c "
            "GROUP BY 1 HAVING bool_or(e <> a)")


def leaves_of_orders(spark, sf_dir):
    sides = [X.view(spark, sf_dir, q) for q in (X.ORDERS_PLAIN, X.ORDERS_COPY)]
    kept = [stored(P.tree_levels(df, algo="md5"), "levels", ("depth",)) for df in sides]
    return sides, C.differing_leaves(*kept)


@register("d1_differing_leaves", sides_sql())
def d1_leaves(spark, sf_dir):
    return leaves_of_orders(spark, sf_dir)[1]


@register(
    "d1_differing_rows",
    f"SELECT 'expected' AS side, o_orderkey, o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice FROM (({X.ORDERS_PLAIN}) EXCEPT ALL ({X.ORDERS_COPY})) e "
    f"UNION ALL SELECT 'actual', o_orderkey, o_orderstatus, CAST(o_totalprice AS VARCHAR) FROM (({X.ORDERS_COPY}) EXCEPT ALL ({X.ORDERS_PLAIN})) a",
)
def d1_rows(spark, sf_dir):
    (expected, actual), leaves = leaves_of_orders(spark, sf_dir)
    return C.differing_rows(expected, actual, leaves, algo="md5").select("side", "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("string").alias("o_totalprice"))


@register(
    "d1_compare_tables_labels",
    f"SELECT db, \"table\", CASE WHEN status IN ('OK', 'DIFFERS') THEN 'FOREIGN_METHOD' ELSE status END AS status, expected_n, actual_n FROM ({D1_SQL}) m",
)
def d1_labels(spark, sf_dir):
    """One side by values, the other by texts: whatever both have is refused, not called different."""
    expected, _ = matrix(spark, sf_dir, algo="xxhash64")
    _, actual = matrix(spark, sf_dir, algo="md5")
    return C.compare_tables(expected, actual).select("db", "table", "status", "expected_n", "actual_n")


@register(
    "d3_extra_tables",
    f"SELECT 'app' AS db, \"table\", (SELECT count(*) FROM ({TABLES_SQL}) e WHERE status <> 'EXTRA') AS expected_tables, "
    f"(SELECT count(*) FROM ({TABLES_SQL}) a WHERE status <> 'ABSENT') AS actual_tables FROM ({TABLES_SQL}) t WHERE status = 'EXTRA'",
)
def d3(spark, sf_dir):
    expected, actual = matrix(spark, sf_dir)
    return C.extra_tables(expected, actual)


OBJECTS_SQL = (
    "SELECT 'app' AS db, e.class, CASE WHEN e.digest = a.digest THEN 'OK' WHEN e.n <> a.n THEN 'COUNT_DIFFERS' ELSE 'DEFINITION_DIFFERS' END AS status, "
    f"e.n AS expected_n, a.n AS actual_n FROM ({object_sql('definition')}) e JOIN ({object_sql('copy_definition', 'in_copy')}) a ON e.class = a.class"
)


@register("d2_compare_objects", OBJECTS_SQL)
def d2(spark, sf_dir):
    return C.compare_objects(digests_of(object_catalog(spark, sf_dir)), digests_of(object_catalog(spark, sf_dir, copy=True)))


# --- pairs, counters -----------------------------------------------------------------

FX2 = f"WITH a AS ({X.ARTEFACTS})"


def catalog_manifests(spark, sf_dir):
    """What the manifests of FX2 promise; one row per artefact."""
    a = X.view(spark, sf_dir, X.ARTEFACTS).filter("has_manifest")
    return a.select(F.lit("site").alias("site"), F.concat_ws("#", "id", "name").alias("artefact"), "bytes", F.col("sha").alias("sha256"))


@register(
    "d4_pair_integrity",
    f"{FX2} SELECT 'site' AS site, concat_ws('#', CAST(id AS VARCHAR), name) AS artefact, bytes, sha AS sha256, "
    "CASE WHEN id % 11 = 0 THEN 'ABSENT' WHEN bytes <> site_bytes THEN 'SIZE_DRIFT' WHEN sha <> site_sha THEN 'CHECKSUM_DRIFT' ELSE 'OK' END AS status, "
    "CASE WHEN id % 11 <> 0 THEN site_bytes END AS found_bytes FROM a WHERE has_manifest",
)
def d4(spark, sf_dir):
    held = X.view(spark, sf_dir, X.ARTEFACTS).filter("id % 11 <> 0").select(
        F.lit("site").alias("site"), F.concat_ws("#", "id", "name").alias("artefact"), F.col("site_bytes").alias("bytes"), F.col("site_sha").alias("sha256")
    )
    return C.pair_integrity(catalog_manifests(spark, sf_dir), held)


COUNTER_SQL = (
    f"WITH c AS ({X.COUNTERS}), k AS ({X.KEYS}), m AS (SELECT tbl, max(id) AS max_id FROM k GROUP BY tbl) "
    "SELECT c.tbl, c.next_value, coalesce(m.max_id, 0) AS max_id, CASE WHEN c.next_value {op} coalesce(m.max_id, 0) THEN 'BEHIND' ELSE 'OK' END AS status "
    "FROM c LEFT JOIN m ON c.tbl = m.tbl WHERE c.next_value IS NOT NULL"
)


def counters(spark, sf_dir, inclusive):
    return C.counter_probe(X.view(spark, sf_dir, X.COUNTERS), C.key_maxima(X.view(spark, sf_dir, X.KEYS)), inclusive)


@register("d14_counter_probe_next", COUNTER_SQL.replace("{op}", "<="))
def d14_next(spark, sf_dir):
    return counters(spark, sf_dir, True)


@register("d14_counter_probe_last", COUNTER_SQL.replace("{op}", "<"))
def d14_last(spark, sf_dir):
    return counters(spark, sf_dir, False)


# --- verdicts --------------------------------------------------------------------------

CHECKS = (
    "SELECT concat('snap-', CAST(o_custkey AS STRING)) AS snapshot, "
    "CASE o_orderkey % 4 WHEN 0 THEN 'objects' WHEN 1 THEN 'counters' ELSE 'tables' END AS gate, o_orderpriority AS subject, "
    "CASE WHEN o_orderkey % 41 = 0 THEN 'DIFFERS' ELSE 'OK' END AS status, "
    "CASE WHEN o_orderkey % 401 = 0 THEN 'refusal' WHEN o_orderkey % 41 = 0 THEN 'failure' WHEN o_orderkey % 43 = 0 THEN 'warning' ELSE 'ok' END AS severity "
    "FROM {orders}"
)
AGES = "SELECT concat('snap-', CAST(c_custkey AS STRING)) AS snapshot, c_nationkey % 5 = 0 AS stale FROM {customer}"


@register(
    "e17_verdict",
    f"WITH c AS ({CHECKS}), a AS ({AGES}), f AS (SELECT snapshot, count(*) FILTER (gate = 'tables') AS tables_compared, "
    "count(*) FILTER (severity = 'refusal') AS refusals, count(*) FILTER (severity = 'failure') AS failures, "
    "count(*) FILTER (severity = 'failure' AND gate = 'counters') AS write_problems, count(*) FILTER (severity = 'warning') AS warnings "
    "FROM c GROUP BY snapshot), g AS (SELECT f.*, coalesce(a.stale, false) AS stale, refusals = 0 AND failures = 0 AND tables_compared > 0 AS proved "
    "FROM f LEFT JOIN a ON f.snapshot = a.snapshot) "
    "SELECT *, CASE WHEN refusals > 0 THEN 'REFUSED' WHEN NOT proved THEN 'FAILED' WHEN stale THEN 'VERIFIED+STALE' ELSE 'VERIFIED' END AS verdict FROM g",
)
def e17(spark, sf_dir):
    return C.verdict(X.view(spark, sf_dir, CHECKS), X.view(spark, sf_dir, AGES))
