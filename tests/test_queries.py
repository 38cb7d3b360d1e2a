import pytest
from compare import expected, got

from heartwood.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert got(queries()[name](spark, sf_dir)) == expected(oracle_sql()[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 10
