"""Every registered query with SQL against DuckDB."""

import pytest

from compare import DATA, assert_equal

from kinfold.plans import registry

ORACLE = registry.oracle_sql()
#: Queries without SQL, and where their values are checked.
ELSEWHERE = {"normalize_unicode": "test_functions", "scan_files": "test_records"} | {f"fuzzy_groups_{a}": "test_scores" for a in ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "wratio")}


def test_all_checked():
    assert set(registry.queries()) == set(ORACLE) | set(ELSEWHERE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(name, spark, oracle):
    assert_equal(registry.queries()[name](spark, f"{DATA}/sf0.001"), oracle("sf0.001"), ORACLE[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
