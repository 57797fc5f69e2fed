"""Golden records: one record a group, each field by a survivorship rule.

All groups and fields come from one aggregation: every rule is a maximum over (what the rule prefers, earliest
position), so ties go to the first record. Rules that weigh values by their frequency count them first.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.normalize import stripped
from kinfold.operators.exact import public
from kinfold.types import STRATEGIES

LONG_AGO = "1900-01-01 00:00:00"


def completeness(fields: list[str]) -> Column:
    """Share of the fields that are filled."""
    return sum([(stripped(F.col(f"`{f}`")) != "").cast("int") for f in fields], F.lit(0)) / F.lit(float(max(len(fields), 1)))


def golden_records(records: DataFrame, group_col: str, order_col: str, strategies: Mapping[str, str] | None = None, fields: list[str] | None = None, timestamp_field: str | None = None, default: str = "most_complete") -> DataFrame:
    """records: a row per member with its group and its position. A row per group: the fields, and _golden_record,
    _source_count, _field_sources (field -> place of the record that it came from, from 0; -1 if none), _group_id.
    An unknown rule is most_complete. most_recent reads timestamp_field: no value counts as 1900-01-01, and a value
    that is no time turns the rule into most_complete for the whole group."""
    fields = fields or [c for c in public(records) if c not in (group_col, order_col)]
    strategies = dict(strategies or {})
    rule = {f: s if (s := strategies.get(f, default)) in STRATEGIES else "most_complete" for f in fields}
    ranked = _with_place(records, group_col, order_col)
    ranked = ranked.withColumn("_c", completeness(fields))
    if timestamp_field:
        raw = F.col(f"`{timestamp_field}`").cast("string")
        ranked = ranked.withColumn("_t", F.coalesce(F.try_to_timestamp(F.when(stripped(raw) != "", raw)), F.lit(LONG_AGO).cast("timestamp")))
        ranked = ranked.withColumn("_bad", (stripped(raw) != "") & F.try_to_timestamp(raw).isNull())
    back = -F.col("_place")
    aggregates = [F.count(F.lit(1)).alias("_source_count")]
    counted = [f for f in fields if rule[f] == "most_frequent"]
    for i, f in enumerate(fields):
        value = F.col(f"`{f}`")
        ok = stripped(value) != ""
        kept = F.when(ok, F.struct(value.alias("v"), F.col("_place").alias("p")))
        by = {
            "most_complete": F.struct(F.col("_c").alias("x"), back.alias("y")),
            "longest_value": F.struct(F.length(value.cast("string")).alias("x"), back.alias("y")),
            "first_non_null": F.struct(back.alias("x"), back.alias("y")),
        }
        if rule[f] == "most_recent" and timestamp_field:
            recent = F.max_by(kept, F.when(ok, F.struct(F.col("_t").alias("x"), back.alias("y"))))
            complete = F.max_by(kept, F.when(ok, by["most_complete"]))
            pick = F.when(F.coalesce(F.bool_or("_bad"), F.lit(False)), complete).otherwise(recent)
        elif rule[f] == "most_frequent":
            continue
        else:
            pick = F.max_by(kept, F.when(ok, by.get(rule[f], by["most_complete"])))
        aggregates.append(pick.alias(f"_v{i}"))
    out = ranked.groupBy(F.col(f"`{group_col}`").alias("_group_id")).agg(*aggregates)
    if counted:
        out = out.join(_most_frequent(ranked, group_col, counted, fields), "_group_id", "left")
    sources = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.coalesce(F.col(f"_v{i}")["p"], F.lit(-1)).cast("int") for i in range(len(fields))]))
    return out.select("_group_id", *[F.col(f"_v{i}")["v"].alias(f) for i, f in enumerate(fields)], F.lit(True).alias("_golden_record"), "_source_count", sources.alias("_field_sources"))


def _with_place(records: DataFrame, group_col: str, order_col: str) -> DataFrame:
    from pyspark.sql import Window

    return records.withColumn("_place", F.row_number().over(Window.partitionBy(f"`{group_col}`").orderBy(F.col(f"`{order_col}`"))) - 1)


def _most_frequent(ranked: DataFrame, group_col: str, counted: list[str], fields: list[str]) -> DataFrame:
    """For each group and field the value with the highest count, the first seen of equal ones."""
    out = None
    for f in counted:
        i, value = fields.index(f), F.col(f"`{f}`")
        by_value = ranked.where(stripped(value) != "").groupBy(F.col(f"`{group_col}`").alias("_group_id"), value.alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("_place").alias("p"))
        one = by_value.groupBy("_group_id").agg(F.max_by(F.struct("v", "p"), F.struct(F.col("n"), -F.col("p"))).alias(f"_v{i}"))
        out = one if out is None else out.join(one, "_group_id", "full")
    return out


def statistics(golden: DataFrame, fields: list[str]) -> DataFrame:
    """One row: golden and source records, consolidation ratio, completeness."""
    c = completeness(fields)
    return golden.agg(
        F.count(F.lit(1)).alias("golden_records"),
        F.coalesce(F.sum("_source_count"), F.lit(0)).alias("source_records"),
        F.coalesce(F.try_divide(F.sum("_source_count"), F.count(F.lit(1))), F.lit(0.0)).alias("consolidation_ratio"),
        F.coalesce(F.avg(c), F.lit(0.0)).alias("avg_completeness"),
        F.coalesce(F.min(c), F.lit(0.0)).alias("min_completeness"),
        F.coalesce(F.max(c), F.lit(0.0)).alias("max_completeness"),
    )


def field_sources(golden: DataFrame) -> DataFrame:
    """How many golden values of each field came from each place."""
    return golden.select(F.explode("_field_sources").alias("field", "source")).groupBy("field", "source").agg(F.count(F.lit(1)).alias("records"))


def merge_groups(records: DataFrame, members: DataFrame, id_col: str, **options) -> DataFrame:
    """Golden records of the groups of a membership (group_id, record_id), ordered by record id."""
    joined = members.join(records.withColumn("record_id", F.col(f"`{id_col}`")), "record_id")
    return golden_records(joined, "group_id", "record_id", **options)
