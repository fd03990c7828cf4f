from __future__ import annotations

from pyspark.sql import functions as F

from coratia.operators import ids, stats
from tests.conftest import rows

REVIEWS = [
    ("u1", "b1", 5.0, 1, "good"),
    ("u1", "b2", 4.0, 0, "a\U0001f600b"),
    ("u2", "b1", 5.0, 3, "longest text here"),
    ("u2", "b1", 1.0, 2, ""),
    ("u3", "b2", 5.0, 1, "x"),
    ("u1", "b1", 2.0, 5, "yy"),
]
SCHEMA = "user_id string, business_id string, stars double, useful long, text string"


def test_counts_and_distinct(spark):
    df = spark.createDataFrame(REVIEWS, SCHEMA)
    assert stats.count_where(df, F.col("useful") > 0).first()[0] == 5
    assert stats.count_where(df, F.col("stars") == 5.0).first()[0] == 3
    assert stats.longest(df, "text").first()[0] == 17
    assert stats.longest(df.filter("user_id = 'u1' and business_id = 'b2'"), "text").first()[0] == 3
    assert stats.distinct_count(df, "user_id").first()[0] == 3
    assert stats.distinct_count(df, "business_id", approximate=True).first()[0] == 2


def test_summary(spark):
    row = stats.review_summary(spark.createDataFrame(REVIEWS, SCHEMA)).first()
    assert (row.n_review_useful, row.n_review_5_star, row.n_characters) == (5, 3, 17)
    assert (row.n_user, row.n_business) == (3, 2)
    assert [tuple(e) for e in row.top20_user] == [("u1", 3), ("u2", 2), ("u3", 1)]
    assert [tuple(e) for e in row.top20_business] == [("b1", 4), ("b2", 2)]


def test_summary_orders_numeric_ids_as_numbers(spark):
    df = spark.createDataFrame(
        [(u, 1, 1.0, 0, "") for u in (10, 9, 100)],
        "user_id long, business_id long, stars double, useful long, text string",
    )
    assert [e["id"] for e in stats.review_summary(df).first().top20_user] == [9, 10, 100]


def test_top_ties_by_key(spark):
    counts = {f"k{i:02d}": 1 + (i % 3) for i in range(25)}
    df = spark.createDataFrame([(k,) for k, n in counts.items() for _ in range(n)], "k string")
    expected = sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:20]
    assert [tuple(r) for r in stats.top_keys(df, "k").collect()] == expected


def test_average_by_attribute(spark):
    facts = spark.createDataFrame(
        [("b1", 4.0), ("b1", 2.0), ("b2", 3.0), ("b4", 5.0), ("b5", 1.0)], "business_id string, stars double"
    )
    dimension = spark.createDataFrame(
        [("b1", "NV"), ("b2", "AZ"), ("b3", "OH"), ("b5", "NV")], "business_id string, state string"
    )
    found = stats.average_by_attribute(facts, dimension, "business_id", "state", "stars")
    assert [tuple(r) for r in found.collect()] == [("AZ", 3.0), ("NV", 7 / 3)]
    twice = dimension.unionByName(dimension.filter("business_id = 'b1'"))
    doubled = dict(stats.average_by_attribute(facts, twice, "business_id", "state", "stars").collect())
    assert doubled["NV"] == 13 / 5
    tied = stats.average_by_attribute(
        facts.filter("business_id in ('b1', 'b2')"), dimension, "business_id", "state", "stars"
    )
    assert [r.state for r in stats.top_averages(tied, "state", 5).collect()] == ["AZ", "NV"]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    row = stats.review_summary(df).first()
    assert (row.n_review_useful, row.n_characters, row.n_user, row.top20_user) == (0, None, 0, [])
    assert stats.top_keys(df, "user_id").collect() == []
    assert stats.distinct_count(df, "user_id").first()[0] == 0


def test_dense_codes(spark):
    df = spark.createDataFrame([(f"i{n % 50:02d}", f"j{n % 7}") for n in range(300)], "a string, b string")
    coded, dictionary = ids.encode_ids(df, ["a", "b"])
    names = sorted({f"i{n:02d}" for n in range(50)} | {f"j{n}" for n in range(7)})
    assert rows(dictionary) == [(name, i) for i, name in enumerate(names)]
    assert coded.count() == 300
    back = ids.decode_ids(coded.select("a", "a_code"), dictionary, "a_code", "again")
    assert back.filter("a = again").count() == 300


def test_dense_codes_over_many_partitions(spark):
    codes = ids.dense_codes(spark.range(10_000, numPartitions=16).repartition(13), [F.desc("id")])
    assert codes.filter(F.col("code") != 9_999 - F.col("id")).isEmpty()
    assert codes.count() == 10_000


def test_sketches_of_days_count_like_one_of_all(spark):
    n = 30_000
    df = spark.range(n).select((F.col("id") % 7).alias("day"), (F.col("id") % 20_000).alias("key"))
    df = df.unionByName(df.limit(5_000)).unionByName(df.select("day", F.lit(None).cast("long").alias("key")).limit(10))
    daily = stats.distinct_sketches(df, ["day"], "key")
    whole = stats.sketched_counts(stats.united_sketches(daily)).first()["n"]
    assert abs(whole - 20_000) <= 5 * stats.sketch_error() * 20_000
    exact = {r["day"]: r["n"] for r in df.groupBy("day").agg(F.count_distinct("key").alias("n")).collect()}
    for r in stats.sketched_counts(daily).collect():
        assert abs(r["n"] - exact[r["day"]]) <= 5 * stats.sketch_error() * exact[r["day"]]
    twice = stats.united_sketches(daily.unionByName(daily), ["day"])
    assert twice.count() == 7 and {len(r["sketch"]) < 20_000 for r in twice.collect()} == {True}


def test_sketches_without_keys(spark):
    nulls = spark.createDataFrame([("a", None), ("a", None)], "day string, key string")
    assert rows(stats.sketched_counts(stats.distinct_sketches(nulls, ["day"], "key"))) == [("a", 0)]
    empty = stats.united_sketches(stats.distinct_sketches(nulls.limit(0), ["day"], "key"))
    assert rows(stats.sketched_counts(empty)) == [(0,)]
