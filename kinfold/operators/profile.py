"""Validation and summaries of a frame, each from one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.types import ValidationResult

MANY_COLUMNS, MANY_ROWS, MOSTLY_NULL = 100, 100_000, 0.9


def counts(df: DataFrame) -> DataFrame:
    """A row per column: position, column, rows, non_null, nulls."""
    aggregates = [F.count(F.lit(1)).alias("rows")] + [F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*aggregates)
    entries = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col("rows"), F.col(f"n{i}").alias("non_null"), (F.col("rows") - F.col(f"n{i}")).alias("nulls")) for i, c in enumerate(df.columns)]
    return one.select(F.inline(F.array(*entries)))


def findings(df: DataFrame) -> DataFrame:
    """A row per error or warning about columns: level, code, column."""
    share = F.coalesce(F.try_divide(F.col("nulls"), F.col("rows")), F.lit(0.0))
    found = counts(df).select(
        F.explode(
            F.filter(
                F.array(
                    F.when((F.col("rows") > 0) & (F.col("non_null") == 0), F.struct(F.lit("warning").alias("level"), F.lit("all_null").alias("code"))),
                    F.when((F.col("non_null") > 0) & (share > MOSTLY_NULL), F.struct(F.lit("warning").alias("level"), F.lit("mostly_null").alias("code"))),
                    F.when((F.trim("column") == "") | F.col("column").startswith("Unnamed:"), F.struct(F.lit("warning").alias("level"), F.lit("unnamed").alias("code"))),
                    F.when((F.col("position") == 0) & (F.col("rows") == 0), F.struct(F.lit("error").alias("level"), F.lit("no_rows").alias("code"))),
                    F.when((F.col("position") == 0) & (F.col("rows") > MANY_ROWS), F.struct(F.lit("warning").alias("level"), F.lit("many_rows").alias("code"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("x"),
        "column",
    )
    return found.select("x.level", "x.code", "column")


def validate(df: DataFrame) -> ValidationResult:
    errors, warnings = [], []
    names = df.columns
    if not names:
        return ValidationResult(False, ("no columns",), (), 0, ())
    if twice := sorted({c for c in names if names.count(c) > 1}):
        # Columns of one name can't be told apart by name, so only the frame's size is looked at.
        return ValidationResult(False, (f"duplicate columns: {', '.join(twice)}",), (), df.count(), tuple(names))
    rows = counts(df).collect()
    n = rows[0]["rows"]
    if not n:
        errors.append("no rows")
    for r in rows:
        if n and not r["non_null"]:
            warnings.append(f"column {r['column']!r} is empty")
        elif n and r["nulls"] / n > MOSTLY_NULL:
            warnings.append(f"column {r['column']!r} is mostly null")
        if not r["column"].strip() or r["column"].startswith("Unnamed:"):
            warnings.append(f"column {r['position']} has no name")
    if len(names) > MANY_COLUMNS:
        warnings.append(f"{len(names)} columns")
    if n > MANY_ROWS:
        warnings.append(f"{n} rows")
    return ValidationResult(not errors, tuple(errors), tuple(warnings), n, tuple(names))


def summary(df: DataFrame) -> DataFrame:
    """A row per column: data_type, non_null, nulls, distinct values (nulls apart) and the most common value; of equally
    common ones the smallest as text. One shuffle of pre-aggregated (column, value) counts."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("data_type"), F.col(f"`{c}`").cast("string").alias("value")) for c, t in df.dtypes])).alias("x")).select("x.*")
    by_value = pairs.groupBy("column", "data_type", "value").agg(F.count(F.lit(1)).alias("n"))
    present = F.col("value").isNotNull()
    return by_value.groupBy("column", "data_type").agg(
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("non_null"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("nulls"),
        F.count_if(present).alias("distinct_values"),
        F.min_by("value", F.when(present, F.struct((-F.col("n")).alias("n"), "value"))).alias("most_common"),
    )
