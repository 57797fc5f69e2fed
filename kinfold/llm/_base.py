"""Table access and size checks shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.storage import dropped, fresh_path, shared_folder, stored

__all__ = ["broadcast_if_small", "dropped", "fresh_path", "numbered", "partitions", "shards", "shared_folder", "stored", "table", "text_or_empty"]
#: A side of a join is broadcast only if it was counted and has at most so many rows of bounded width.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint on df only if it has been counted and has at most `rows` rows; else Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text that one shard of an exchange answers for.
SHARD_BYTES = 64 << 20


def shards(docs: DataFrame, text: str = "text") -> int:
    """Shards of an exchange over docs: by the measured bytes of their texts, and enough to keep all tasks busy."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(2 * partitions(docs.sparkSession), -(-total // SHARD_BYTES))


def numbered(docs: DataFrame, name: str = "row", key: str = "doc_id", payload: tuple[str, ...] = ("text",)) -> tuple[DataFrame, bool]:
    """(docs with `name`, whether that is the id): a number (never null) of each row, in the order of the ids, null ids last.

    Where every row has an id of its own that is the number. Else rows of one id are told apart by digests of their
    payload: the distinct (id, digests) are sorted once by range, so that a common id spreads over tasks, and numbered
    in a stored table; rows that agree in id and payload share a number."""
    again = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(f"n > 1 or {key} is null")
    if again.isEmpty():
        return docs.withColumn(name, F.col(key).cast("long")), True
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in payload]
    marks = [F.xxhash64(F.lit(i), *parts).alias(f"kinfold_mark{i}") for i in (0, 1)]
    own = docs.select(F.col(key).alias("kinfold_id"), *marks).distinct().orderBy(F.col("kinfold_id").asc_nulls_last(), "kinfold_mark0", "kinfold_mark1")
    own = stored(own.withColumn("kinfold_number", F.monotonically_increasing_id()), "numbers")
    on = F.col(key).eqNullSafe(F.col("kinfold_id")) & (marks[0] == F.col("kinfold_mark0")) & (marks[1] == F.col("kinfold_mark1"))
    return docs.join(own, on).select(*docs.columns, F.col("kinfold_number").alias(name)), False


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: White space of the word contracts: space and the control codes from tab to carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
