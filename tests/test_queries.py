import pytest

from docloom.plans import adaptive, corpus, learning, logs, models, notices, streams, tenders
from tests.oracle import same

ALL = tenders.QUERIES | logs.QUERIES | corpus.QUERIES | notices.QUERIES | learning.QUERIES | streams.QUERIES | adaptive.QUERIES | models.QUERIES
SQL = tenders.ORACLE_SQL | logs.ORACLE_SQL | corpus.ORACLE_SQL | notices.ORACLE_SQL | learning.ORACLE_SQL | streams.ORACLE_SQL | adaptive.ORACLE_SQL | models.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    same(ALL[name](spark, sf_dir), SQL[name], sf_dir)


@pytest.mark.parametrize("name", ["classify_quality", "field_models", "field_top_features"])
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert ALL[name](spark, sf_dir).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 25
