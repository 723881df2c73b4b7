"""Every query outside the training-data subpackage against its SQL, and its stability at other numbers of partitions."""

import pytest

from quarrylake.plans import catalog

from .compare import SF, duck, duck_rows, spark_rows

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    found = spark_rows(df)
    if name in SQL:
        wanted, columns = duck_rows(con, SQL[name])
        assert sorted(df.columns) == columns
        assert found == wanted
    assert found


@pytest.mark.parametrize("name", ["rank_topk", "merged_groups", "story_clusters", "near_title_merge", "contradictions"])
def test_partitions_do_not_matter(spark, name):
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(spark_rows(catalog.queries()[name](spark, SF)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(isinstance(x, str) for x in entry.oracle_sql().values())
    assert "score" in entry.entry(spark).columns
