"""Outputs: the cleaned data set, audit log, reports, and checks of what was written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.errors import ConfigurationError
from kinfold.types import AUDIT, ProcessingStats

# Statuses of records that stay.
KEPT = ("original", "kept", "merged_primary", "flagged")


def cleaned(resolved: DataFrame) -> DataFrame:
    """Records that stay, without internal and normalized columns."""
    columns = [c for c in resolved.columns if not c.startswith("_") and not c.endswith("_normalized")]
    if "_resolution_status" in resolved.columns:
        status = F.col("_resolution_status")
        resolved = resolved.where(status.isNull() | status.isin(*KEPT))
    return resolved.select(*[F.col(f"`{c}`") for c in columns])


def write(df: DataFrame, path: str, kind: str = "parquet") -> str:
    """A folder of part files; json is lines of objects."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.option("ignoreNullFields", False).json(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ConfigurationError(f"unknown output format: {kind!r}")
    return path


def write_json_array(df: DataFrame, path: str) -> str:
    """One indented JSON array, row by row through the driver; for results that a person reads."""
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for i, row in enumerate(df.toJSON().toLocalIterator()):
            out.write(("," if i else "") + "\n  " + json.dumps(json.loads(row), ensure_ascii=False))
        out.write("\n]\n")
    return path


def audit_entries(resolved: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """An audit row per touched record; scores(record_id, similarity_score) are joined if given."""
    touched = resolved.where(F.col("_resolution_action").isNotNull())
    rows = touched.select(F.col("_original_index").cast("string").alias("record_id"), F.col("_resolution_action").alias("action"), F.col("_resolution_status").alias("reason"), F.col("_resolution_timestamp").alias("timestamp"), F.lit(True).alias("user_decision"))
    if scores is not None:
        rows = rows.join(scores.select(F.col("record_id").cast("string").alias("record_id"), F.col("similarity_score").cast("double").alias("similarity_score")), "record_id", "left")
    else:
        rows = rows.withColumn("similarity_score", F.lit(None).cast("double"))
    return rows.select(*AUDIT.names)


def write_audit_log(entries: DataFrame, path: str) -> str:
    """CSV of the six audit columns, all quoted; the header alone if there are none."""
    entries.select(*AUDIT.names).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
    return path


def entries_from_log(spark: SparkSession, path: str) -> DataFrame:
    """Audit rows of a text log: lines that hold an object with record_id and action; other lines are skipped."""
    lines = spark.read.text(path).where(F.col("value").contains("record_id") & F.col("value").contains("action"))
    return parse_entries(lines.select(F.regexp_extract("value", r"(\{.*\})", 1).alias("value")))


def parse_entries(lines: DataFrame) -> DataFrame:
    parsed = lines.select(F.from_json("value", AUDIT).alias("e")).select("e.*")
    return parsed.where("record_id is not null and action is not null")


def analyze(groups: DataFrame) -> DataFrame:
    """Counts of groups by size, by method and by action, from one pass: dimension, value, groups."""
    rolled = groups.groupingSets([[F.col("group_size")], [F.col("detection_method")], [F.col("recommended_action")]], "group_size", "detection_method", "recommended_action").agg(F.count(F.lit(1)).alias("groups"), F.grouping_id().alias("g"))
    dimension = F.when(F.col("g") == 3, "group_size").when(F.col("g") == 5, "detection_method").otherwise("recommended_action")
    value = F.when(F.col("g") == 3, F.col("group_size").cast("string")).when(F.col("g") == 5, F.col("detection_method")).otherwise(F.col("recommended_action"))
    return rolled.select(dimension.alias("dimension"), value.alias("value"), "groups")


def quality(records: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: duplicate_rate (in percent, of pairs), rates by method, and the completeness score."""
    n = records.agg(F.count(F.lit(1)).alias("records"))
    g = groups.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("detection_method") == "exact").alias("exact_groups"), F.count_if(F.col("detection_method") == "fuzzy").alias("fuzzy_groups"))
    one = n.crossJoin(g)  # one row each
    most = F.greatest("records", F.lit(1))
    rate = lambda c: F.col(c) * 2 / most * 100.0
    return one.select("records", "groups", rate("groups").alias("duplicate_rate"), rate("exact_groups").alias("exact_rate"), rate("fuzzy_groups").alias("fuzzy_rate"), completeness_score(F.col("groups"), F.col("records")).alias("completeness_score"))


def completeness_score(groups, records):
    return F.when(records == 0, F.lit(85.0)).otherwise(F.least(F.lit(100.0), F.lit(85.0) + (F.lit(1.0) - groups / F.greatest(records, F.lit(1))) * 15.0))


def summary_report(session: str, records: DataFrame, groups: DataFrame, stats: ProcessingStats, fields: list[str]) -> dict:
    """Sections session, data, performance, duplicates and quality."""
    q = quality(records, groups).first()
    shapes: dict[str, dict] = {}
    for r in analyze(groups).collect():
        shapes.setdefault(r["dimension"], {})[r["value"]] = r["groups"]
    seconds = stats.processing_time
    return {
        "session": {"id": session},
        "data": {"records": q["records"], "fields": fields},
        "performance": {"seconds": seconds, "records_per_second": q["records"] / seconds if seconds else None, "memory_mb": stats.memory_usage},
        "duplicates": {"groups": q["groups"], "exact": stats.exact_duplicates, "fuzzy": stats.fuzzy_duplicates, **shapes},
        "quality": {k: q[k] for k in ("duplicate_rate", "exact_rate", "fuzzy_rate", "completeness_score")},
    }


def write_all(resolved: DataFrame, groups: DataFrame, folder: str, session: str = "session", stats: ProcessingStats | None = None, kind: str = "parquet") -> dict[str, str]:
    """Cleaned data, audit log and report below a folder (a URI that Spark writes to)."""
    spark = resolved.sparkSession
    out = {"cleaned": write(cleaned(resolved), f"{folder}/cleaned", kind), "audit": write_audit_log(audit_entries(resolved), f"{folder}/audit")}
    report = summary_report(session, resolved, groups, stats or ProcessingStats(), cleaned(resolved).columns)
    spark.createDataFrame([(json.dumps(report, indent=2, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/report")
    return out | {"report": f"{folder}/report"}


def check_written(spark: SparkSession, path: str, kind: str, columns: list[str], rows: int | None = None) -> list[str]:
    """What is wrong with a written frame; empty if nothing is."""
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    try:
        df = reader.format(kind).load(path)
    except Exception as error:
        return [f"{path} can't be read: {error}"]
    wrong = [f"column {c} is missing" for c in columns if c not in df.columns]
    if rows is not None and (n := df.count()) != rows:
        wrong.append(f"{n} rows, not {rows}")
    return wrong
