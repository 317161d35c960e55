import pytest

from foliospark.plans.catalogue import ORACLE_SQL, QUERIES

from .oracle import SF, same

#: Queries whose right answer at the smallest scale may be no rows.
MAY_BE_EMPTY = {"name_collisions"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    assert same(spark, QUERIES[name], ORACLE_SQL[name]) or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count()


def test_entry_answers(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["company_id", "division_id", "member_count", "member_bytes", "bound_bytes"]
    assert found.count() > 0


def test_oracle_names_are_queries():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
