"""Driver contract: entry() runs; every query has an oracle or is listed as rows-only."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["thread_num", "file_name", "content"]
    assert df.count() > 0


def test_every_query_has_oracle():
    from mailspark.plans.registry import ORACLE_SQL, QUERIES

    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())
