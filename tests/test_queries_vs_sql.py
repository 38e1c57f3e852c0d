import pytest
from compare import DATA, same

from clickweave.plans.queries import QUERIES, SQL

SLOW = {"m2_retention", "m3_compact", "io11_archive_range", "s_stream_archive"}  # hundreds of small files


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query_equals_sql(spark, name):
    same(spark, f"{DATA}/sf0.001", QUERIES[name], SQL[name])


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", ["a1_sessions_12h", "a2_pages_1d", "v_all_rules"])
def test_query_on_no_rows(spark, tmp_path, name):
    for t in ("events",):
        spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
