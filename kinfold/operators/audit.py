"""Audit events: written in batches, one per stage, never per row."""

from __future__ import annotations

import datetime
import json
import logging
import logging.handlers
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "session_id string, event_id string, timestamp timestamp, event_type string, event_data string"
# Kinds of events.
KINDS = (
    "SESSION_START", "DATA_LOADED", "DATA_NORMALIZED", "DUPLICATE_DETECTION", "DUPLICATE_GROUP_IDENTIFIED",
    "RESOLUTION_DECISION", "GOLDEN_RECORD_CREATED", "RECORD_DELETED", "DATA_EXPORTED", "PERFORMANCE_METRICS",
    "SYSTEM_ERROR", "USER_ACTION", "SESSION_END",
)


class AuditLog:
    """Events of a session, appended to a folder of JSON lines that Spark writes."""

    def __init__(self, spark: SparkSession, path: str, session_id: str | None = None):
        self.spark, self.path = spark, path
        self.session_id = session_id or uuid.uuid4().hex
        self.started = datetime.datetime.now(datetime.timezone.utc)
        self.log("SESSION_START")

    def log(self, kind: str, **data) -> None:
        if kind not in KINDS:
            raise ValueError(f"unknown event: {kind}")
        row = (self.session_id, uuid.uuid4().hex, datetime.datetime.now(datetime.timezone.utc), kind, json.dumps(data, default=str))
        self.append(self.spark.createDataFrame([row], EVENT))

    def append(self, events: DataFrame) -> None:
        events.coalesce(1).write.mode("append").json(self.path)

    def loaded(self, source: str, df: DataFrame) -> None:
        self.log("DATA_LOADED", path=source, record_count=df.count(), columns=df.columns, data_hash=content_hash(df))

    def normalized(self, fields: dict[str, str], record_count: int) -> None:
        self.log("DATA_NORMALIZED", field_configs=fields, record_count=record_count)

    def detected(self, method: str, key_fields: list[str], groups: DataFrame, config: dict | None = None) -> None:
        """The detection as one event and each of its groups as one, straight from the frame."""
        n, records = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("group_size"), F.lit(0))).first()
        self.log("DUPLICATE_DETECTION", method=method, key_fields=key_fields, groups_found=n, records_affected=records, config=config or {})
        groups.select(*group_event(self.session_id)).write.mode("append").json(self.path)

    def decided(self, resolved: DataFrame) -> None:
        data = F.to_json(F.struct(F.col("_original_index").alias("record_id"), F.col("_resolution_action").alias("action"), F.col("_resolution_status").alias("status")))
        resolved.where("_resolution_action is not null").select(*_event(self.session_id, "RESOLUTION_DECISION", data)).write.mode("append").json(self.path)

    def golden(self, golden: DataFrame, strategy: str) -> None:
        data = F.to_json(F.struct(F.col("_group_id").alias("group_id"), F.col("_source_count").alias("sources"), F.lit(strategy).alias("strategy")))
        golden.select(*_event(self.session_id, "GOLDEN_RECORD_CREATED", data)).write.mode("append").json(self.path)

    def deleted(self, ids: DataFrame, reason: str, soft: bool = True) -> None:
        data = F.to_json(F.struct("record_id", F.lit(reason).alias("reason"), F.lit(soft).alias("soft_delete")))
        ids.select(*_event(self.session_id, "RECORD_DELETED", data)).write.mode("append").json(self.path)

    def exported(self, path: str, df: DataFrame, kind: str) -> None:
        self.log("DATA_EXPORTED", path=path, record_count=df.count(), format=kind, export_hash=content_hash(df))

    def performance(self, **metrics) -> None:
        self.log("PERFORMANCE_METRICS", **metrics)

    def error(self, error: Exception, context: str = "") -> None:
        self.log("SYSTEM_ERROR", error=type(error).__name__, message=str(error), context=context)

    def user_action(self, action: str, **details) -> None:
        self.log("USER_ACTION", action=action, **details)

    def close(self) -> float:
        seconds = (datetime.datetime.now(datetime.timezone.utc) - self.started).total_seconds()
        self.log("SESSION_END", seconds=seconds)
        return seconds

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENT).json(self.path)


_session: AuditLog | None = None


def session(spark: SparkSession | None = None, path: str | None = None) -> AuditLog:
    """The process's audit log; made on the first call."""
    global _session
    if _session is None:
        if spark is None or path is None:
            raise ValueError("the first call needs a session and a path")
        _session = AuditLog(spark, path)
    return _session


def close_session() -> float:
    global _session
    seconds, _session = (_session.close() if _session else 0.0), None
    return seconds


def _event(session_id: str, kind: str, data: Column) -> list[Column]:
    return [F.lit(session_id).alias("session_id"), F.uuid().alias("event_id"), F.current_timestamp().alias("timestamp"), F.lit(kind).alias("event_type"), data.alias("event_data")]


def group_event(session_id: str) -> list[Column]:
    return _event(session_id, "DUPLICATE_GROUP_IDENTIFIED", F.to_json(F.struct("group_id", "group_size", "similarity_score", "detection_method")))


def report(events: DataFrame) -> DataFrame:
    """A row per kind of event: events, and the sums of record_count and records_affected in their data."""
    number = lambda key: F.coalesce(F.get_json_object("event_data", f"$.{key}").try_cast("bigint"), F.lit(0))
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(number("record_count")).alias("record_count"), F.sum(number("records_affected")).alias("records_affected"))


def duplicate_rate(events: DataFrame) -> DataFrame:
    """One row: records loaded, records found in duplicate groups, and their rate in percent."""
    by_kind = report(events)
    loaded = F.coalesce(F.sum(F.when(F.col("event_type") == "DATA_LOADED", F.col("record_count"))), F.lit(0))
    found = F.coalesce(F.sum(F.when(F.col("event_type") == "DUPLICATE_DETECTION", F.col("records_affected"))), F.lit(0))
    return by_kind.agg(loaded.alias("records_loaded"), found.alias("records_affected")).withColumn("duplicate_rate", F.coalesce(F.try_divide(F.col("records_affected") * 100.0, F.col("records_loaded")), F.lit(0.0)))


def content_hash(df: DataFrame) -> str:
    """Of the rows in any order; the same in every run. Sums of row hashes of 64 bits, kept whole as decimals, so repeated
    rows count."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.lit(0)
    a, b = df.agg(F.coalesce(F.sum(row.cast("decimal(20,0)")), F.lit(0)), F.count(F.lit(1))).first()
    return f"{int(a) % (1 << 64):016x}-{b:x}"


class ActivityLog:
    """File, data, user, system and performance events in Python's logging, numbered in order."""

    def __init__(self, name: str = "kinfold.activity"):
        self.logger, self.number = logging.getLogger(name), 0

    def event(self, kind: str, **data) -> int:
        self.number += 1
        self.logger.info(json.dumps({"operation": self.number, "kind": kind, **data}, default=str))
        return self.number

    def file(self, path: str, operation: str, size: int | None = None, succeeded: bool = True) -> int:
        return self.event("file", path=path, what=operation, size=size, succeeded=succeeded)

    def data(self, what: str, records: int, seconds: float) -> int:
        return self.event("data", what=what, records=records, seconds=seconds, records_per_second=records / seconds if seconds else None)

    def user(self, what: str, **details) -> int:
        return self.event("user", what=what, details=details)

    def system(self, what: str, **details) -> int:
        return self.event("system", what=what, details=details)

    def performance(self, what: str, value: float, unit: str) -> int:
        return self.event("performance", what=what, value=value, unit=unit)


class ProcessingLog:
    """Decisions about records and the start and end of a run, as objects in Python's logging, which
    output.entries_from_log() reads again."""

    def __init__(self, name: str = "kinfold.audit"):
        self.logger = logging.getLogger(name)

    def action(self, record_id, action: str, reason: str = "", score: float | None = None) -> None:
        self.logger.info(json.dumps({"record_id": str(record_id), "action": action, "reason": reason, "similarity_score": score, "user_decision": False}))

    def started(self, source: str, records: int, **settings) -> None:
        self.logger.info(json.dumps({"event": "processing_start", "source": source, "records": records, "settings": settings}, default=str))

    def ended(self, source: str, groups: int, seconds: float, succeeded: bool = True) -> None:
        self.logger.info(json.dumps({"event": "processing_end", "source": source, "groups": groups, "seconds": seconds, "succeeded": succeeded}))


def setup_logging(folder: str, level: int = logging.INFO) -> logging.Logger:
    """Console, a rotating file (10 MB, five old ones) and a file of errors."""
    os.makedirs(folder, exist_ok=True)
    logger = logging.getLogger("kinfold")
    logger.setLevel(level)
    form = logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s")
    for handler, least in ((logging.StreamHandler(), level), (logging.handlers.RotatingFileHandler(os.path.join(folder, "kinfold.log"), maxBytes=10 << 20, backupCount=5, encoding="utf-8"), level), (logging.FileHandler(os.path.join(folder, "errors.log"), encoding="utf-8", delay=True), logging.ERROR)):
        handler.setLevel(least)
        handler.setFormatter(form)
        logger.addHandler(handler)
    return logger
