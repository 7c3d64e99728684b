"""The driver's contract."""

import __spark_entry__


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["kmer", "cnt"] and out.count() > 0


def test_oracles_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) >= 70
