"""Tabular files: CSV and JSON as all-string frames, and their preview."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.errors import FileProcessingError

# Texts of a CSV field that mean a missing value.
NA_TEXTS = (
    "", "NULL", "null", "None", "N/A", "n/a", "NA", "NaN", "nan", "-NaN", "-nan",
    "#N/A", "#N/A N/A", "#NA", "<NA>", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN",
)
#: Encodings in the order in which they are tried; UTF-16 needs its mark, and Latin-1 decodes any byte.
ENCODINGS = ("utf-8", "utf-16", "iso-8859-1", "cp1252")


def load_file(spark: SparkSession, path: str, **options) -> DataFrame:
    """By suffix: .csv or .json."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".csv":
        return load_csv(spark, path, **options)
    if suffix == ".json":
        return load_json(spark, path, **options)
    raise FileProcessingError(f"unsupported file format: {suffix!r}", path=path)


def _checked(read, path: str) -> DataFrame:
    try:
        return read()
    except Exception as error:
        if getattr(error, "getCondition", lambda: None)() == "PATH_NOT_FOUND":
            raise FileProcessingError(f"file not found: {path}", path=path) from error
        raise


def load_csv(spark: SparkSession, path: str, encoding: str | None = None, separator: str = ",", quote: str = '"') -> DataFrame:
    """Header row, all columns as strings, NA_TEXTS as null. Without an encoding, the first of ENCODINGS that decodes the
    whole file is taken, so no byte is replaced without a word; text that was read wrongly under a given encoding shows
    as U+FFFD, which replaced() counts."""
    options = {"header": True, "inferSchema": False, "encoding": encoding or detect_encoding(spark, path), "sep": separator, "quote": quote, "escape": quote, "multiLine": True}
    df = _checked(lambda: spark.read.options(**options).csv(path), path)
    return df.select(*[F.when(F.col(f"`{c}`").isin(*NA_TEXTS), None).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])


def replaced(df: DataFrame) -> int:
    """Fields in which a byte could not be decoded (U+FFFD)."""
    marks = [F.count_if(F.col(f"`{c}`").contains("\ufffd")) for c in df.columns]
    return sum(df.agg(*marks).first()) if marks else 0


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, lines of objects, or one object of arrays; all columns as strings, nulls stay null. A text
    is taken as lines if its first line is an object as a whole."""
    lines = _checked(lambda: spark.read.text(path), path)
    first = lines.where(F.trim("value") != "").select(F.trim("value").alias("v")).head(1)
    whole = bool(first) and first[0]["v"].startswith("{") and _is_object(first[0]["v"])
    df = spark.read.option("multiLine", not whole).json(path)
    if df.columns and all(isinstance(f.dataType, T.ArrayType) for f in df.schema):
        df = df.select(F.inline(F.arrays_zip(*[F.col(f"`{c}`") for c in df.columns])))
    if not df.columns or df.isEmpty():
        raise FileProcessingError("the JSON file holds no records", path=path)
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def _is_object(line: str) -> bool:
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def detect_encoding(spark: SparkSession, path: str) -> str:
    """By a byte order mark, else the first of ENCODINGS that decodes every line of the files. Bytes are read as lines in
    Latin-1, which keeps them as they are, so a large file is tested by many tasks."""
    lines = _checked(lambda: spark.read.option("encoding", "iso-8859-1").option("header", False).option("sep", "\x00").option("quote", "").csv(path, schema="value string"), path)
    first = lines.head(1)
    head = (first[0]["value"] or "") if first else ""
    if head[:2] in ("\xff\xfe", "\xfe\xff"):
        return "utf-16"
    data = F.encode("value", "iso-8859-1")
    return "utf-8" if lines.where(~F.is_valid_utf8(data.cast("string"))).isEmpty() else next(e for e in ENCODINGS if not e.startswith("utf"))


def preview(df: DataFrame, rows: int = 10, order: list | None = None) -> DataFrame:
    """The first rows in a stated order (all columns by default), 1000 at most."""
    return df.orderBy(*(order or df.columns)).limit(max(0, min(rows, 1000)))


#: Loaders under the names of their formats.
load_csv_file, load_json_file = load_csv, load_json
