"""Exact duplicates: records with equal normalized keys.

Grouping is by the SHA-256 of the key columns, each led by its length, so that long texts are never shuffled and keys
that join to one text stay apart; the SHA-256 of the plainly joined key is an output. A group's id is the smallest record
id in it. Only ids and digests travel; payload is joined by the caller.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.errors import DataValidationError
from kinfold.functions.normalize import normalizer, stripped
from kinfold.operators.storage import stored


def _checked(df: DataFrame, fields) -> None:
    if not fields:
        raise DataValidationError("at least one key field is needed")
    if missing := [f for f in fields if f not in df.columns]:
        raise DataValidationError(f"no such column: {', '.join(missing)}", fields=missing)


def keyed(df: DataFrame, id_col: str, fields, kinds: Mapping[str, str] | None = None, **options) -> DataFrame:
    """record_id and the key columns k0, k1, ..."""
    return df.select(F.col(f"`{id_col}`").alias("record_id"), *key_columns(df, fields, kinds, **options))


def digest(columns: list[Column]) -> Column:
    """SHA-256 of the values joined by ||."""
    return F.sha2(F.concat_ws("||", *columns), 256)


def identity(columns: list[Column]) -> Column:
    """32 bytes that tell keys apart: SHA-256 of their values, each after its length."""
    parts = [p for c in columns for p in (F.coalesce(F.octet_length(c).cast("string"), F.lit("-")), F.coalesce(c, F.lit("")))]
    return F.unhex(F.sha2(F.concat_ws(":", *parts), 256))


def groups(df: DataFrame, id_col: str, fields, kinds: Mapping[str, str] | None = None, **options) -> DataFrame:
    """group_id, group_size, similarity_score (100), detection_method, key_hash and recommended_action of each group of
    two or more; one shuffle, after partial sums."""
    names = [f"k{i}" for i in range(len(fields))]
    flags = [F.col(f"f{i}") for i in range(len(public(df)))]
    names = [F.col(k) for k in names]
    wide = df.select(F.col(f"`{id_col}`").alias("record_id"), *key_columns(df, fields, kinds, **options), *[is_filled(F.col(f"`{c}`")).cast("int").alias(f"f{i}") for i, c in enumerate(public(df))])
    nn = sum(flags[1:], flags[0]) if flags else F.lit(0)
    one_sided = [F.sum(f).alias(f"s{i}") for i, f in enumerate(flags)]
    wide = wide.withColumn("key", identity(names)).withColumn("key_hash", digest(names))
    agg = wide.groupBy("key").agg(F.first("key_hash").alias("key_hash"), F.min("record_id").alias("group_id"), F.count(F.lit(1)).alias("group_size"), F.min(nn).alias("nn_low"), F.max(nn).alias("nn_high"), *one_sided).where("group_size > 1")
    sides = sum([(F.col(f"s{i}") == 1).cast("int") for i in range(len(flags))], F.lit(0))
    n = float(len(flags))
    complementary = (F.col("nn_high") - F.col("nn_low") > 0.2 * n) | (sides > 0.2 * n)
    action = recommended_action(F.col("group_size"), complementary)
    return agg.select("group_id", "group_size", F.lit(100.0).alias("similarity_score"), F.lit("exact").alias("detection_method"), "key_hash", action.alias("recommended_action"))


def public(df: DataFrame) -> list[str]:
    """Columns that count as fields: neither internal (leading _) nor *_normalized."""
    return [c for c in df.columns if not c.startswith("_") and not c.endswith("_normalized")]


def is_filled(c: Column) -> Column:
    return stripped(c) != ""


def key_columns(df: DataFrame, fields, kinds: Mapping[str, str] | None = None, use_normalized: bool = True, unicode: bool = True, default: str = "text") -> list[Column]:
    """Normalized key columns; in raw mode a null is the text "nan"."""
    _checked(df, fields)
    kinds = kinds or {}
    out = []
    for i, f in enumerate(fields):
        c = F.col(f"`{f}`")
        value = normalizer(kinds.get(f, default), default)(c, unicode) if use_normalized else F.coalesce(c.cast("string"), F.lit("nan"))
        out.append(value.alias(f"k{i}"))
    return out


def recommended_action(size: Column, complementary: Column) -> Column:
    """Two records: merge if they complete each other, else keep the first; 3 to 5: merge; more: flag."""
    return F.when(size == 2, F.when(complementary, "merge").otherwise("keep_first")).when(size <= 5, "merge").otherwise("flag")


def members(df: DataFrame, id_col: str, fields, kinds: Mapping[str, str] | None = None, **options) -> DataFrame:
    """group_id, record_id of all records in groups. A join with the groups' keys, not a window: Spark splits the large
    partitions that a very common key makes."""
    keys = keyed(df, id_col, fields, kinds, **options)
    keys = keys.select("record_id", identity([F.col(k) for k in keys.columns[1:]]).alias("key"))
    found = keys.groupBy("key").agg(F.min("record_id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keys.join(found, "key").select("group_id", "record_id")


def named(found: DataFrame, prefix: str = "exact_group_") -> DataFrame:
    """groups with display names numbered in the order of group_id. Sorted once by range; a range's numbers follow on
    those of the ranges before it, so no task holds all groups."""
    sized = found.repartitionByRange("group_id").sortWithinPartitions("group_id").withColumn("_place", F.monotonically_increasing_id())
    ordered = stored(sized, "ordered-groups")
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = ordered.withColumn("_part", part).join(F.broadcast(before), "_part")
    return numbered.withColumn("group_name", F.concat(F.lit(prefix), (F.col("_before") + place + 1).cast("string"))).select(*found.columns, "group_name")


def statistics(found: DataFrame) -> DataFrame:
    """One row about groups."""
    n = F.col("group_size")
    return found.agg(
        F.count(F.lit(1)).alias("total_groups"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total_records"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_size"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_size"),
        F.coalesce(F.min(n), F.lit(0)).alias("min_size"),
        *[F.count_if(F.col("recommended_action") == a).alias(f"action_{a}") for a in ("merge", "keep_first", "flag")],
        F.count_if(n == 2).alias("pairs"),
        F.count_if((n >= 3) & (n <= 5)).alias("groups_3_to_5"),
        F.count_if(n >= 6).alias("groups_6_plus"),
    )


def by_single_field(df: DataFrame, id_col: str, field: str, normalize: bool = True, **options) -> DataFrame:
    return groups(df, id_col, [field], {field: "text"}, use_normalized=normalize, **options)


def by_composite_key(df: DataFrame, id_col: str, fields: list[str], kinds: list[str] | None = None, **options) -> DataFrame:
    if kinds is not None and len(kinds) != len(fields):
        raise DataValidationError("as many kinds as fields are needed")
    return groups(df, id_col, fields, dict(zip(fields, kinds, strict=True)) if kinds else None, **options)


def text_summary(found: DataFrame) -> str:
    s = statistics(found).first()
    return f"{s['total_groups']} groups of {s['total_records']} records (sizes {s['min_size']} to {s['max_size']}, {s['avg_size']:.2f} on average): merge {s['action_merge']}, keep first {s['action_keep_first']}, flag {s['action_flag']}"
