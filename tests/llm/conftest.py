import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows (doc_id, text[, source[, lang]]) as documents, with columns whose names could clash with internal ones."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None, "a", 1, "b", "c", 2.0, "d", "e", 3) for r in rows]
        return spark.createDataFrame(full, DOC + ", kind string, g long, bucket string, range string, mark double, good string, key string, row int").repartition(parts)

    return make


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Tables (DataFrames by name) as a folder of Parquet files."""

    def make(**tables):
        path = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"file://{path}/{name}.parquet")
        return f"file://{path}"

    return make


