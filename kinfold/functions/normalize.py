"""Normalizers: Column -> Column, any type in, string out, null becomes an empty string.

All run in the JVM but for NFKD, which Spark lacks: one vectorised function that is given only values outside ASCII,
and that a plan for known ASCII columns leaves out (unicode=False).
"""

from __future__ import annotations

import datetime
import unicodedata
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.errors import ConfigurationError

# Date patterns in the order in which they are tried, month before day.
DATE_PATTERNS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "M/d/yyyy",
    "d/M/yyyy",
    "yyyy/M/d",
    "M-d-yyyy",
    "d-M-yyyy",
    "yyyyMMdd",
    "M/d/yy",
    "d/M/yy",
    "M-d-yy",
    "MMMM d, yyyy",
    "MMM d, yyyy",
    "d MMMM yyyy",
    "d MMM yyyy",
)
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"


@F.pandas_udf(T.StringType())
def _nfkd(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKD", v), na_action="ignore")


def stripped(c: Column) -> Column:
    """Null as empty; no white space (of any script) at either end."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def text(c: Column, unicode: bool = True) -> Column:
    """Compatibility form, lower case, single spaces. Combining marks stay."""
    base = stripped(c)
    if unicode:
        base = F.coalesce(_nfkd(F.when(base.rlike(r"[^\x00-\x7F]"), base)), base)
    return stripped(F.regexp_replace(F.lower(base), r"(?U)\s+", " "))


def text_aggressive(c: Column, unicode: bool = True) -> Column:
    """As text(), with everything but letters, numbers and underscores as spaces (marks too)."""
    return stripped(F.regexp_replace(F.regexp_replace(text(c, unicode), r"[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def _fuzzy_date(values: pd.Series) -> pd.Series:
    from dateutil import parser

    def find(value: str) -> str | None:
        try:
            # A part that is missing is taken from the default: dates that depend on it are none.
            a, b = (parser.parse(value, fuzzy=True, default=datetime.datetime(y, m, d)) for y, m, d in ((1904, 1, 1), (2004, 12, 31)))
        except (ValueError, OverflowError):
            return None
        return a.strftime("%Y-%m-%d") if a.date() == b.date() else None

    return values.map(find, na_action="ignore")


def date(c: Column, unicode: bool = True, fuzzy: bool = False) -> Column:
    """ISO date by the first pattern that fits; empty if none does. A value with a part missing fits none. fuzzy: what
    fits no pattern is searched for a date among other words, outside the JVM. Columns of dates and timestamps need no
    pattern."""
    value = stripped(c)
    found = F.date_format(F.coalesce(*[F.try_to_timestamp(value, F.lit(p)) for p in DATE_PATTERNS]), "yyyy-MM-dd")
    if fuzzy:
        found = F.coalesce(found, _fuzzy_date(F.when(found.isNull() & (value != ""), value)))
    return _typed(c, ("date", "timestamp", "timestamp_ntz"), F.substring_index(c.cast("string"), " ", 1), found)


def _typed(c: Column, types: tuple[str, ...], plain: Column, parsed: Column) -> Column:
    """`plain` if the column has one of the types, else `parsed`; null as empty. A column's type is a constant of the
    plan, so one of the two is all that is left in it."""
    return F.coalesce(F.when(F.typeof(c).isin(*types), plain).otherwise(parsed), F.lit(""))


def numeric(c: Column, unicode: bool = True, strict: bool = False) -> Column:
    """Digits, minus and the last dot; empty if that is no number. A leading dot is lost unless strict. Columns of whole
    numbers are texts as they are."""
    kept = F.regexp_replace(stripped(c), r"[^\p{Nd}.-]", "")
    kept = F.regexp_replace(kept, r"\.(?=.*\.)", "")
    kept = F.regexp_replace(kept, r"\.+$" if strict else r"^\.+|\.+$", "")
    kept = F.when(kept.rlike(r"^-?(\p{Nd}+\.?\p{Nd}*|\.\p{Nd}+)$"), kept)
    return _typed(c, ("tinyint", "smallint", "int", "bigint"), c.cast("string"), kept)


def phone(c: Column, unicode: bool = True) -> Column:
    """Digits, without the leading 1 of eleven."""
    digits = F.regexp_replace(stripped(c), r"[^\p{Nd}]", "")
    return F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)


def email(c: Column, unicode: bool = True) -> Column:
    """Lower case; what is no address stays as it is (see is_email)."""
    return F.lower(stripped(c))


def is_email(c: Column) -> Column:
    return email(c).rlike(EMAIL)


NORMALIZERS: dict[str, Callable[..., Column]] = {"text": text, "text_aggressive": text_aggressive, "date": date, "numeric": numeric, "phone": phone, "email": email}


def normalizer(kind: str, default: str = "text") -> Callable[..., Column]:
    return NORMALIZERS.get(kind, NORMALIZERS[default])


def normalized(df: DataFrame, fields: Mapping[str, str], unicode: bool = True, default: str = "text") -> DataFrame:
    """df with <field>_normalized for each of its fields in `fields` (name -> kind); absent ones are skipped."""
    return df.withColumns({f"{f}_normalized": normalizer(k, default)(F.col(f"`{f}`"), unicode) for f, k in fields.items() if f in df.columns})


def normalized_record(df: DataFrame, fields: Mapping[str, str], unicode: bool = True) -> DataFrame:
    """The normalized fields alone, under their own names; an absent field is empty."""
    return df.select(*[(normalizer(k)(F.col(f"`{f}`"), unicode) if f in df.columns else F.lit("")).alias(f) for f, k in fields.items()])


def composite_key(df: DataFrame, fields: Mapping[str, str], separator: str = "||", unicode: bool = True) -> Column:
    """The normalized values joined; an absent field is empty."""
    if not fields:
        raise ConfigurationError("a composite key needs a field")
    return F.concat_ws(separator, *[normalizer(k)(F.col(f"`{f}`"), unicode) if f in df.columns else F.lit("") for f, k in fields.items()])


def composite_key_from_values(values: list[Column], kinds: list[str], separator: str = "||") -> Column:
    if len(values) != len(kinds):
        raise ConfigurationError("as many kinds as values are needed")
    return F.concat_ws(separator, *[normalizer(k)(v) for v, k in zip(values, kinds, strict=True)])


def infer_kinds(columns: list[str]) -> dict[str, str]:
    """A kind for each column by its name; id columns are left out."""
    out = {}
    for c in columns:
        low = c.lower()
        if low in ("id", "index", "key"):
            continue
        out[c] = "text_aggressive" if "name" in low else "email" if "email" in low else "phone" if "phone" in low else "text"
    return out


def normalization_stats(df: DataFrame, fields: Mapping[str, str], unicode: bool = True) -> DataFrame:
    """A row per field: original and normalized distinct values, empty ones, and how far they were reduced."""
    own = {f: k for f, k in fields.items() if f in df.columns}
    if not own:
        raise ConfigurationError("no field of the frame is configured")
    ready = normalized(df.select(*[F.col(f"`{f}`") for f in own]), own, unicode)
    # One pass over (field, value, normalized) pairs; partial sums before the shuffle.
    long = ready.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("type"), F.col(f"`{f}`").cast("string").alias("o"), F.col(f"`{f}_normalized`").alias("n")) for f, k in own.items()])).alias("x")).select("x.*")
    agg = long.groupBy("field", "type").agg(F.count_distinct("o").alias("original_unique"), F.count_distinct("n").alias("normalized_unique"), F.count_if(F.col("n") == "").alias("empty_values"))
    return agg.withColumn("reduction_ratio", F.lit(1.0) - F.col("normalized_unique") / F.greatest(F.col("original_unique"), F.lit(1)))
