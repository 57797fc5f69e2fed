"""Normalizers and scores on the fixtures, against independent versions, and their properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.functions import normalize as N
from kinfold.functions import similarity as S

VECTORS = {
    "text": {"  JANE DOE  ": "jane doe", "Bob O'Connor": "bob o'connor", "María García": "maría garcía", "李小明": "李小明", "  Multiple   Spaces   Here  ": "multiple spaces here", "": "", None: ""},
    "text_aggressive": {"John Smith Jr.": "john smith jr", "ABC Corp., Inc.": "abc corp inc", "123 Main St. #456": "123 main st 456", "Phone: (555) 123-4567": "phone 555 123 4567", "Price: $99.99": "price 99 99", "María García": "mari a garci a"},
    "date": {"2023-01-15": "2023-01-15", "01/15/2023": "2023-01-15", "15/01/2023": "2023-01-15", "January 15, 2023": "2023-01-15", "Jan 15, 2023": "2023-01-15", "15 Jan 2023": "2023-01-15", "20230115": "2023-01-15", "01-15-23": "2023-01-15", "invalid date": "", "": "", None: ""},
    "numeric": {"123.45": "123.45", "$99.99": "99.99", "1,234.56": "1234.56", "€50.00": "50.00", "25%": "25", "  42  ": "42", "-123.45": "-123.45", "abc123": "123", "12.34.56": "1234.56", ".5": "5", "1e5": "15", "555-1234": "", None: ""},
    "phone": {"555-123-4567": "5551234567", "(555) 123-4567": "5551234567", "555.123.4567": "5551234567", "15551234567": "5551234567", "1-555-123-4567": "5551234567", "+1 555 123 4567": "5551234567", "invalid phone": ""},
    "email": {"JANE.DOE@EMAIL.COM": "jane.doe@email.com", "  bob@company.org  ": "bob@company.org", "invalid-email": "invalid-email", "user@domain": "user@domain"},
}


@pytest.mark.parametrize("kind", sorted(VECTORS))
def test_normalizer(kind, spark):
    import unicodedata

    df = spark.createDataFrame([(k, v) for k, v in VECTORS[kind].items()], "raw string, want string")
    for r in df.select("raw", "want", N.NORMALIZERS[kind](F.col("raw")).alias("got")).collect():
        want = unicodedata.normalize("NFKD", r["want"]) if kind == "text" else r["want"]
        assert r["got"] == want, r["raw"]


def test_fuzzy_dates(spark):
    df = spark.createDataFrame([("due on 15 March 2023, noon",), ("May",), ("2023-01-15",), ("nothing",), (None,)], "raw string")
    got = [r[0] for r in df.select(N.date(F.col("raw"), fuzzy=True)).collect()]
    assert got == ["2023-03-15", "", "2023-01-15", "", ""]


def test_strict_numeric(spark):
    assert spark.range(1).select(N.numeric(F.lit(".5"), strict=True)).first()[0] == ".5"


def test_keys_and_kinds(spark):
    df = spark.createDataFrame([(" A ", None)], "a string, b string")
    assert df.select(N.composite_key(df, {"a": "text", "b": "text", "c": "text"})).first()[0] == "a||||"
    assert N.infer_kinds(["id", "Full Name", "Email", "phone_no", "city"]) == {"Full Name": "text_aggressive", "Email": "email", "phone_no": "phone", "city": "text"}
    with pytest.raises(Exception, match="field"):
        N.composite_key(df, {})
    with pytest.raises(Exception, match="kinds"):
        N.composite_key_from_values([F.col("a")], [])


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for ch in a:
        new = [0]
        for j, x in enumerate(b):
            new.append(row[j] + 1 if x == ch else max(new[j], row[j + 1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", max_size=12), st.text("ab c", max_size=12))
def test_scores(a, b):
    assert S.lcs(a, b) == slow_lcs(a, b)
    for score in (S.indel, S.partial, S.token_sort, S.token_set, S.weighted):
        assert 0 <= score(a, b) <= 100
        assert abs(score(a, b) - score(b, a)) < 1e-9
    assert S.indel(a, a) == 100
    exact = S.partial(a, b)
    for cutoff in (50.0, 80.0, 95.0):
        assert S.partial(a, b, cutoff) in (exact, 0.0) and (exact < cutoff or S.partial(a, b, cutoff) == exact)


def test_known_scores():
    assert round(S.indel("john smith", "jon smyth"), 2) == 84.21
    assert S.token_sort("smith john", "john smith") == 100
    assert S.token_set("john smith", "john smith jr") == 100
    assert S.partial("smith", "john smith") == 100
    assert S.weighted("", "x") == 0


def test_kernel_in_engine(spark):
    words = ["", "a", "john smith", "jon smyth", "person 12", "person 21", "abcabc", "cba"]
    df = spark.createDataFrame([(x, y) for x in words for y in words], "x string, y string")
    for r in df.select("x", "y", S.SCORERS["ratio"](F.col("x"), F.col("y")).alias("a"), S.ratio_sql(F.col("x"), F.col("y")).alias("b")).collect():
        assert abs(r["a"] - r["b"]) < 1e-9, r


def test_typed_columns(spark):
    """Dates, timestamps and whole numbers are keys without patterns or regular expressions, and as their texts are."""
    rows = [("1998-02-06 00:00:00", 5), ("0001-01-01 23:59:59", -7), ("9999-12-31 12:00:00", 0), (None, None)]
    df = spark.createDataFrame(rows, "t string, n long")
    for kind in ("date", "timestamp", "timestamp_ntz"):
        typed = df.select("t", F.col("t").cast(kind).alias("v")).select(N.date(F.col("v")).alias("got"), N.date(F.col("t")).alias("want"))
        assert all(r["got"] == r["want"] for r in typed.collect())
    for kind in ("tinyint", "smallint", "int", "bigint"):
        typed = df.select(N.numeric(F.col("n").cast(kind)).alias("got"), N.numeric(F.col("n").cast("string")).alias("want"))
        assert [r["got"] for r in typed.collect()] == [r["want"] for r in typed.collect()] == ["5", "-7", "0", ""]
    parts = df.select(F.lit("2024-03-01 10:00:00.25").cast("timestamp_ntz").alias("v")).select(N.date(F.col("v")).alias("got"))
    assert {r["got"] for r in parts.collect()} == {"2024-03-01"}  # a fraction of a second is no reason for no date
    plan = df.select(N.date(F.col("t").cast("timestamp_ntz")).alias("d"), N.numeric(F.col("n")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower() and "rlike" not in plan.lower() and "yyyy" not in plan
