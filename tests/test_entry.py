import __spark_entry__
from lexigauge import catalogue


def test_queries_have_names_and_sql_for_queries_only():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES) <= set(__spark_entry__.queries())


def test_ranking_query(spark):
    assert catalogue.QUERIES["rank_matrix"](spark, "/root/testdata/sf0.001").count() > 0
