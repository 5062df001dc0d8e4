"""Driver contract, and plans of key operators."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SMALL = "/root/testdata/sf0.001"


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 80


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["treatment_episodes", "baseline_table", "tv_overlap_cumulative", "table_one", "smd_weighted"])
def test_against_sql(spark, name):
    assert compare(entry.queries()[name](spark, SMALL), entry.oracle_sql()[name], connect(SMALL)) is None


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned_and_filtered(spark):
    plan = _plan(entry.queries()["treatment_episodes"](spark, SMALL))
    assert "LessThanOrEqual(l_shipdate" in plan
    assert "l_extendedprice" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_second_record_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in _plan(entry.queries()["phenotype_onset"](spark, SMALL))


def test_hot_site_join_is_split(spark):
    """A site that holds a third of the facts: adaptive execution splits its partition."""
    from cohortweave.operators.persons import to_person

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        fact = spark.range(0, 60000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("site_id"), F.col("id").alias("v"))
        links = spark.range(500).select(F.col("id").alias("site_id"), (F.col("id") % 90).alias("person_id"))
        df = to_person(fact, links)
        assert df.count() == 60000
        rows = df.agg(F.sum("v"))
        rows.collect()
        assert "skew=true" in _plan(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
