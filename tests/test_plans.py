from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from coratia.operators import stats
from coratia.plans.lineage import BROADCAST_ROWS, Stored, cut_lineage, store
from coratia.plans.scan import dealt_out


@pytest.fixture(scope="module")
def reviews(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables") / "reviews")
    spark.range(1000).select(
        (F.col("id") % 7).alias("user_id"), (F.col("id") % 5).alias("useful"), F.col("id").cast("string").alias("text")
    ).write.parquet(path)
    return spark.read.parquet(path)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_predicates_and_columns_reach_the_scan(reviews):
    plan = _plan(stats.count_where(reviews, F.col("useful") > 0))
    assert "GreaterThan(useful,0)" in plan and "ReadSchema: struct<useful:bigint>" in plan


def test_top_keys_combine_before_the_shuffle_and_never_sort_everything(reviews):
    plan = _plan(stats.top_keys(reviews, "user_id"))
    assert "TakeOrderedAndProject" in plan and "partial_count" in plan
    assert "ReadSchema: struct<user_id:bigint>" in plan


def test_facts_are_summed_before_they_are_joined(spark, reviews):
    dimension = spark.range(7).select(F.col("id").alias("user_id"), (F.col("id") % 2).alias("state"))
    plan = _plan(stats.average_by_attribute(reviews, dimension, "user_id", "state", "useful"))
    assert plan.index("Join") < plan.index("partial_sum(useful")


def test_stored_rows_are_counted_once(spark):
    stored = store(spark.range(10).filter("id > 100"))
    assert stored.rows == 0 and stored.df.isEmpty()
    small, large = store(spark.range(5)), Stored(spark.range(5), BROADCAST_ROWS + 1)
    other = spark.range(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in _plan(other.join(small.sized(), "id"))
        assert "BroadcastHashJoin" not in _plan(other.join(large.sized(), "id"))
        assert "BroadcastHashJoin" not in _plan(large.fits(other).join(other, "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_checkpoints_go_to_the_named_folder(spark):
    cut_lineage(spark.range(3))
    assert spark.conf.get("spark.checkpoint.dir") in spark.sparkContext.getCheckpointDir()


def test_only_scans_smaller_than_the_cores_are_dealt_out(spark, tmp_path):
    path = str(tmp_path / "texts")
    spark.range(1_000).selectExpr("id", "cast(id as string) as text").coalesce(1).write.parquet(path)
    small = spark.read.parquet(path)
    dealt = dealt_out(small, "id")
    assert "RepartitionByExpression" in dealt._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["id"] for r in dealt.collect()) == list(range(1_000))
    whole = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1b")
    try:
        assert dealt_out(small, "id") is small
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", whole)


def test_stored_rows_leave_no_shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    count = lambda: sum(1 for folder in folders for _ in Path(folder).rglob("shuffle_*.data"))
    before = count()
    assert store(spark.range(1_000).groupBy(F.col("id") % 7).count()).rows == 7
    assert count() <= before
