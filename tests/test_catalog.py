"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    _, verdict, _, _, _, note = compare(spark, SF, name, QUERIES[name], SQL.get(name), con)
    assert verdict in ("ok", "rows-only"), note


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


SPLIT = {
    "history_features": 9, "asof_latest_view": 30, "nearest_category_two_pass": 60, "roi_running": 150, "running_value_total": 150,
    "roc_points": 60, "monthly_scores": 10, "time_folds": 200, "outlier_iqr": 200, "describe_columns": 900,
    "rating_time_finish": 150, "rating_offence_defence": 150, "continuity_repair": 60,
}


@pytest.mark.parametrize("name", sorted(SPLIT))
def test_query_matches_sql_when_every_group_is_oversized(spark, con, name):
    """The same queries with a group limit so low that keys are split, ranks narrowed and ratings cut into blocks."""
    from duelframe.session import MAX_GROUP_ROWS

    spark.conf.set(MAX_GROUP_ROWS, str(SPLIT[name]))
    try:
        _, verdict, _, _, _, note = compare(spark, SF, name, QUERIES[name], SQL[name], con)
    finally:
        spark.conf.unset(MAX_GROUP_ROWS)
    assert verdict == "ok", note
