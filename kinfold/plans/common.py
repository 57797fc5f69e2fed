"""Tables and SQL fragments that the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_text(x: str) -> str:
    """functions.normalize.text in DuckDB, for ASCII."""
    return f"lower(trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g')))"


def sql_aggressive(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({sql_text(x)}, '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


PART_KEY = ["p_name", "p_brand", "p_type"]
#: Membership of the exact groups of parts by name, brand and type: g, r.
SQL_PART_MEMBERS = "SELECT min(p_partkey) OVER w AS g, p_partkey AS r, count(*) OVER w AS n FROM part WINDOW w AS (PARTITION BY lower(p_name), lower(p_brand), lower(p_type))"
