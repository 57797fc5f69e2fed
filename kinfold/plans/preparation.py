"""Queries of sources, profiles and normalizers."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions import normalize as N
from kinfold.operators import profile
from kinfold.operators.storage import fresh_path
from kinfold.plans.common import sql_aggressive, sql_text, table
from kinfold.sources import files, jdbc


def load_csv(spark, sf_dir):
    """A CSV file with missing-value texts, written and loaded."""
    path = fresh_path(spark, "nation") + ".csv"
    df = table(spark, sf_dir, "nation")
    df.withColumn("n_name", F.when(F.col("n_nationkey") % 5 == 0, "N/A").otherwise(F.col("n_name"))).write.option("header", True).csv(path)
    return files.load_file(spark, path)


def load_json_lines(spark, sf_dir):
    path = fresh_path(spark, "region") + ".json"
    table(spark, sf_dir, "region").withColumn("r_name", F.when(F.col("r_regionkey") != 1, F.col("r_name"))).write.option("ignoreNullFields", False).json(path)
    return files.load_json(spark, path)


def load_json_columns(spark, sf_dir):
    """One object of arrays."""
    path = fresh_path(spark, "region-columns") + ".json"
    one = table(spark, sf_dir, "region").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("x"))
    one.select(F.to_json(F.struct(F.col("x.r_regionkey").alias("r_regionkey"), F.col("x.r_name").alias("r_name"))).alias("value")).write.text(path)
    return files.load_json(spark, path)


def table_source(spark, sf_dir):
    return jdbc.select(table(spark, sf_dir, "part"), ["p_partkey", "p_name", "p_retailprice"], "p_size < 10 AND p_type = 'ECONOMY'")


def table_limit(spark, sf_dir):
    return jdbc.select(table(spark, sf_dir, "part"), ["p_partkey", "p_name"], "p_size >= 10", limit=25, order=["p_partkey"])


def table_info(spark, sf_dir):
    return jdbc.describe(table(spark, sf_dir, "customer"))


def preview(spark, sf_dir):
    return files.preview(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 20, [F.col("o_orderkey")])


def column_counts(spark, sf_dir):
    return profile.counts(_sparse(spark, sf_dir))


def _sparse(spark, sf_dir):
    """Parts with columns that are empty, mostly empty and full."""
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", F.lit(None).cast("string").alias("nothing"), F.when(F.col("p_partkey") % 20 == 0, F.col("p_name")).alias("rare"), F.col("p_brand").alias("Unnamed: 3"))


def validation_findings(spark, sf_dir):
    return profile.findings(_sparse(spark, sf_dir))


def data_summary(spark, sf_dir):
    return profile.summary(table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type", F.when(F.col("p_size") > 5, F.col("p_size")).alias("p_size")))


def normalization_stats(spark, sf_dir):
    return N.normalization_stats(table(spark, sf_dir, "part"), {"p_name": "text", "p_brand": "text_aggressive", "p_type": "text"}, unicode=False)


def _each(name, column, columns):
    def query(spark, sf_dir):
        return table(spark, sf_dir, name).select(*columns, column().alias("normalized"))

    return query


_RAGGED = "concat('  ', upper(p_name), '\t ', p_brand, '. ')"
_DATE_SQL = "strftime(o_orderdate, '%Y-%m-%d')"


def normalize_date(spark, sf_dir):
    """Order dates in the listed forms, one after the other."""
    forms = ("yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd", "yyyyMMdd", "MMMM d, yyyy", "d MMM yyyy")
    d = F.col("o_orderdate")
    raw = F.lit("no date")
    for i, form in enumerate(forms):
        raw = F.when(F.col("o_orderkey") % 7 == i, F.date_format(d, form)).otherwise(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", N.date(raw).alias("normalized"))


def normalize_numeric(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("$ "), F.format_number("c_acctbal", 2))).when(F.col("c_custkey") % 3 == 1, F.concat(F.col("c_custkey").cast("string"), F.lit("%"))).otherwise(F.concat(F.lit("12.34."), F.col("c_custkey").cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", N.numeric(raw).alias("normalized"))


def normalize_phone(spark, sf_dir):
    digits = F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    raw = F.concat(F.when(F.col("c_custkey") % 2 == 0, "+1 (555) ").otherwise("555."), F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 4))
    return table(spark, sf_dir, "customer").select("c_custkey", N.phone(raw).alias("normalized"))


def normalize_email(spark, sf_dir):
    raw = F.concat(F.lit(" "), F.upper(F.regexp_replace("c_name", "#", ".")), F.when(F.col("c_custkey") % 4 == 0, "@Example").otherwise("@Example.COM "))
    return table(spark, sf_dir, "customer").select("c_custkey", N.email(raw).alias("normalized"), N.is_email(raw).alias("valid"))


def composite_key(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("p_brand", F.when(F.col("p_size") > 3, F.col("p_brand")))
    return part.select("p_partkey", N.composite_key(part, {"p_name": "text", "p_brand": "text", "absent": "text"}, unicode=False).alias("key"))


def normalize_unicode(spark, sf_dir):
    """Whole texts in four languages, with compatibility forms."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(N.text(F.col("text")), 256).alias("normalized_sha256"))


def scan_files(spark, sf_dir):
    from kinfold.operators import files as scanned

    return scanned.scan(spark, sf_dir, [".parquet"]).groupBy().agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


QUERIES = {
    "load_csv": (load_csv, "SELECT n_nationkey::VARCHAR AS n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name END AS n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation"),
    "load_json_lines": (load_json_lines, "SELECT r_regionkey::VARCHAR AS r_regionkey, CASE WHEN r_regionkey <> 1 THEN r_name END AS r_name FROM region"),
    "load_json_columns": (load_json_columns, "SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region"),
    "table_source": (table_source, "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size < 10 AND p_type = 'ECONOMY'"),
    "table_limit": (table_limit, "SELECT p_partkey, p_name FROM part WHERE p_size >= 10 ORDER BY p_partkey LIMIT 25"),
    "table_info": (
        table_info,
        "SELECT t.position::INTEGER AS position, t.column_name, t.data_type, (SELECT count(*) FROM customer) AS row_count FROM (VALUES (0, 'c_custkey', 'bigint'), (1, 'c_name', 'string'), (2, 'c_nationkey', 'int'), (3, 'c_acctbal', 'double'), (4, 'c_mktsegment', 'string')) t(position, column_name, data_type)",
    ),
    "preview": (preview, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20"),
    "column_counts": (
        column_counts,
        "WITH c AS (SELECT count(*) AS n, count(CASE WHEN p_partkey % 20 = 0 THEN p_name END) AS r, count(p_brand) AS b FROM part) SELECT 0 AS position, 'p_partkey' AS \"column\", n AS rows, n AS non_null, 0::BIGINT AS nulls FROM c UNION ALL SELECT 1, 'nothing', n, 0, n FROM c UNION ALL SELECT 2, 'rare', n, r, n - r FROM c UNION ALL SELECT 3, 'Unnamed: 3', n, b, n - b FROM c",
    ),
    "validation_findings": (
        validation_findings,
        "SELECT 'warning' AS level, 'all_null' AS code, 'nothing' AS \"column\" UNION ALL SELECT 'warning', 'mostly_null', 'rare' UNION ALL SELECT 'warning', 'unnamed', 'Unnamed: 3' UNION ALL SELECT 'warning', 'many_rows', 'p_partkey' FROM (SELECT count(*) AS n FROM part) WHERE n > 100000",
    ),
    "data_summary": (
        data_summary,
        """WITH l AS (SELECT 'p_name' AS c, 'string' AS t, p_name AS v FROM part UNION ALL SELECT 'p_brand', 'string', p_brand FROM part UNION ALL SELECT 'p_type', 'string', p_type FROM part
             UNION ALL SELECT 'p_size', 'int', CASE WHEN p_size > 5 THEN p_size::VARCHAR END FROM part),
           n AS (SELECT c, t, v, count(*) AS n FROM l GROUP BY ALL)
           SELECT c AS "column", t AS data_type, coalesce(sum(n) FILTER (v IS NOT NULL), 0)::BIGINT AS non_null, coalesce(sum(n) FILTER (v IS NULL), 0)::BIGINT AS nulls,
             count(v) AS distinct_values, (SELECT v FROM n m WHERE m.c = n.c AND v IS NOT NULL ORDER BY m.n DESC, v LIMIT 1) AS most_common FROM n GROUP BY c, t""",
    ),
    "normalization_stats": (
        normalization_stats,
        "WITH s AS ("
        + " UNION ALL ".join(
            f"SELECT '{f}' AS field, '{k}' AS type, count(DISTINCT {f}) AS original_unique, count(DISTINCT {n(f)}) AS normalized_unique, count(*) FILTER ({n(f)} = '') AS empty_values FROM part"
            for f, k, n in (("p_name", "text", sql_text), ("p_brand", "text_aggressive", sql_aggressive), ("p_type", "text", sql_text))
        )
        + ") SELECT *, 1.0::DOUBLE - normalized_unique / greatest(original_unique, 1) AS reduction_ratio FROM s",
    ),
    "normalize_text": (_each("part", lambda: N.text(F.expr(_RAGGED.replace("\t", "\\t"))), ["p_partkey"]), f"SELECT p_partkey, {sql_text('p_raw')} AS normalized FROM (SELECT p_partkey, concat('  ', upper(p_name), chr(9), ' ', p_brand, '. ') AS p_raw FROM part)"),
    "normalize_text_aggressive": (_each("customer", lambda: N.text_aggressive(F.concat_ws(", ", "c_name", "c_mktsegment")), ["c_custkey"]), f"SELECT c_custkey, {sql_aggressive('r')} AS normalized FROM (SELECT c_custkey, concat_ws(', ', c_name, c_mktsegment) AS r FROM customer)"),
    "normalize_date": (normalize_date, f"SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN '' ELSE {_DATE_SQL} END AS normalized FROM orders"),
    "normalize_numeric": (
        normalize_numeric,
        "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN printf('%.2f', c_acctbal) WHEN c_custkey % 3 = 1 THEN c_custkey::VARCHAR ELSE '1234.' || c_custkey END AS normalized FROM customer",
    ),
    "normalize_phone": (normalize_phone, "SELECT c_custkey, '555' || lpad(c_custkey::VARCHAR, 7, '0') AS normalized FROM customer"),
    "normalize_email": (
        normalize_email,
        "SELECT c_custkey, lower(replace(c_name, '#', '.')) || CASE WHEN c_custkey % 4 = 0 THEN '@example' ELSE '@example.com' END AS normalized, c_custkey % 4 <> 0 AS valid FROM customer",
    ),
    "composite_key": (composite_key, f"SELECT p_partkey, {sql_text('p_name')} || '||' || {sql_text('CASE WHEN p_size > 3 THEN p_brand END')} || '||' AS key FROM part"),
    "normalize_unicode": (normalize_unicode, None),
    "scan_files": (scan_files, None),
}
