from __future__ import annotations

from pyspark.sql import functions as F

from coratia.plans import skew
from coratia.plans.skew import _laid_out, aggregate_matches, aggregate_pairs, hot_keys, pairs_of_group, spread_join
from tests.conftest import rows


def _skewed(spark, n=200, name="x"):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 7).alias("k"),
        F.col("id").alias(name),
    )


def test_spread_join_equals_join(spark):
    left, right = _skewed(spark), _skewed(spark, 150, "y")
    plain = rows(left.join(right, "k"))
    for limit in (1, 50, 1000, 10**9):
        assert rows(spread_join(left, right, ["k"], "x", "y", limit)) == plain


def test_pairs_of_group_equals_self_join(spark):
    df = _skewed(spark)
    a, b = df.select("k", F.col("x").alias("x_1")), df.select("k", F.col("x").alias("x_2"))
    plain = rows(a.join(b, "k").filter("x_1 < x_2"))
    for limit in (10, 10**9):
        assert rows(pairs_of_group(df, ["k"], "x", limit=limit)) == plain


def test_cells_of_a_hot_key_stay_small(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("x"))
    sizes = df.groupBy("k").agg(F.count("*").alias("n_left"), F.count("*").alias("n_right"))
    hot = hot_keys(sizes, ["k"], 10_000)
    laid_out = _laid_out(df, hot, ["k"], "x", ("a", "__left_strips"), ("b", "__right_strips"))
    cells = laid_out.groupBy("a", "b").count().agg(F.count("*"), F.max("count")).first()
    assert cells[0] == 100
    assert cells[1] < 200


def test_composite_keys_and_no_match(spark):
    left = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, j string, x int")
    right = spark.createDataFrame([(1, "c", 5)], "k int, j string, y int")
    assert rows(spread_join(left, right, ["k", "j"], "x", "y", 1)) == []


def test_aggregated_matches(spark, monkeypatch):
    left = _skewed(spark).withColumn("l", F.col("x") % 17)
    right = _skewed(spark, 150, "y").withColumn("r", F.col("y") % 11)
    sums = [F.count("*").alias("n"), F.sum(F.col("x") * F.col("y")).alias("s")]
    where = F.col("x") != F.col("y")
    plain = rows(left.join(right, "k").filter(where).groupBy("l", "r").agg(*sums))
    monkeypatch.setattr(skew, "MATCHES_PER_TASK", 100)
    # Whole lists, lists on a grid, and busy left ids.
    for limit, list_rows in ((10**9, 10**9), (10**9, 7), (300, 7), (40, 3), (1, 1)):
        found = aggregate_matches(left, right, ["k"], "l", "r", sums, where, limit, list_rows)
        assert rows(found) == plain
    df = _skewed(spark, 90)
    pairs = rows(pairs_of_group(df, ["k"], "x").groupBy("x_1", "x_2").agg(F.count("*").alias("n")))
    for limit in (60, 10**9):
        assert rows(aggregate_pairs(df, ["k"], "x", [F.count("*").alias("n")], limit=limit)) == pairs


def test_the_join_of_lists_is_dealt_out_by_matches(spark, monkeypatch):
    monkeypatch.setattr(skew, "MATCHES_PER_TASK", 100)
    monkeypatch.setattr(skew, "MATCHES_PER_WRITER", 50)
    df = _skewed(spark, 90)
    for list_rows in (10**9, 7):
        found = aggregate_pairs(df, ["k"], "x", [F.count("*").alias("n")], list_rows=list_rows)
        plan = found._jdf.queryExecution().toString()
        # 30 ** 2 matches of one key and 60 rows in seven others: 1,416 in all.
        assert plan.count(", 29), REPARTITION_BY_NUM") >= 2
        assert "lambdafunction" in plan


def test_very_many_matches_are_made_in_batches(spark, monkeypatch):
    monkeypatch.setattr(skew, "MATCHES_PER_TASK", 100)
    df = _skewed(spark, 90)
    plain = rows(aggregate_pairs(df, ["k"], "x", [F.count("*").alias("n")]))
    stored, real = [], skew.cut_lineage
    monkeypatch.setattr(skew, "cut_lineage", lambda made: stored.append(1) or real(made))
    monkeypatch.setattr(skew, "BATCH_MATCHES", 500)
    then = lambda found: found.filter("x_1 % 2 = 0")
    assert rows(aggregate_pairs(df, ["k"], "x", [F.count("*").alias("n")], then=then)) == [row for row in plain if row[0] % 2 == 0]
    # 1,416 matches: three batches, and the sizes of the keys of all and of each.
    assert len(stored) >= 6
