"""Configuration and result types of the record operators."""

from __future__ import annotations

import dataclasses
import datetime

from pyspark.sql import types as T

ACTIONS = ("KEEP", "DELETE", "MERGE", "FLAG")
STRATEGIES = ("most_recent", "most_complete", "longest_value", "most_frequent", "first_non_null")


@dataclasses.dataclass(frozen=True)
class MatchingConfig:
    exact: bool = True
    fuzzy: bool = False
    threshold: float = 80.0
    key_fields: tuple[str, ...] = ()
    fuzzy_fields: tuple[str, ...] = ()
    algorithm: str = "WRatio"


@dataclasses.dataclass(frozen=True)
class ResolutionConfig:
    default_action: str = "FLAG"
    require_confirmation: bool = True
    merge_strategy: str = "most_complete"
    preserve_ids: bool = True


@dataclasses.dataclass(frozen=True)
class Decision:
    """What to do with one group; `selected` are record ids, the first of a MERGE receives the merged values."""

    group_id: int
    action: str
    selected: tuple[int, ...] = ()
    notes: str = ""
    timestamp: datetime.datetime | None = None


@dataclasses.dataclass(frozen=True)
class ValidationResult:
    is_valid: bool
    errors: tuple[str, ...]
    warnings: tuple[str, ...]
    record_count: int
    field_names: tuple[str, ...]


@dataclasses.dataclass
class ProcessingStats:
    total_records: int = 0
    duplicate_groups_found: int = 0
    exact_duplicates: int = 0
    fuzzy_duplicates: int = 0
    processing_time: float = 0.0
    memory_usage: float = 0.0


DECISIONS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("group_id", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("selected", T.ArrayType(T.LongType())),
        T.StructField("notes", T.StringType()),
    ]
)
AUDIT = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("similarity_score", T.DoubleType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("user_decision", T.BooleanType()),
    ]
)


def decisions_frame(spark, decisions):
    """Decisions in the order in which they apply, as a DataFrame."""
    rows = [(i, d.group_id, d.action, list(d.selected), d.notes) for i, d in enumerate(decisions)]
    return spark.createDataFrame(rows, DECISIONS)
