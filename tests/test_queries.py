"""Every registered query against its DuckDB twin; those without one must give rows."""

import __spark_entry__ as entry
import check
import pytest

QUERIES, TWINS = entry.queries(), entry.oracle_sql()
# queries whose condition may be met by no row at the smallest scale
MAY_BE_EMPTY = {"article_search", "undelivered", "near_dup_titles", "stale_tasks", "promotion_insert", "stream_promotions", "api_date_cut", "edit_search"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return check.open_duck(sf_dir)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(key, spark, sf_dir, duck):
    df = QUERIES[key](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    assert rows or key in MAY_BE_EMPTY
    if key in TWINS:
        assert check.compare(rows, df.columns, duck.execute(TWINS[key])) == ""


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
