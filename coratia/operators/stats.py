"""Counts, distinct counts, top-k reports and averages over a joined attribute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sketches of distinct keys have two to the power of this many registers.
SKETCH_BITS = 12


def count_where(df: DataFrame, predicate: Column, name: str = "n") -> DataFrame:
    """Number of rows that satisfy `predicate` (one row)."""
    return df.filter(predicate).agg(F.count(F.lit(1)).alias(name))


def longest(df: DataFrame, text: str, name: str = "n_characters") -> DataFrame:
    """Length in code points of the longest text (one row; NULL without rows)."""
    return df.agg(F.max(F.length(text)).cast("long").alias(name))


def distinct_count(df: DataFrame, key: str, name: str = "n", approximate: bool = False) -> DataFrame:
    """Number of distinct non-NULL keys (one row)."""
    if approximate:
        return df.agg(F.approx_count_distinct(key).alias(name))
    return df.agg(F.count_distinct(key).alias(name))


def distinct_sketches(df: DataFrame, by: list[str], key: str, bits: int = SKETCH_BITS) -> DataFrame:
    """(by..., sketch): one HyperLogLog sketch of 2 ** `bits` registers per group, to be stored and united later.

    A sketch has a bounded size however many keys it has seen, and repeated or late rows do no harm. NULL keys are not
    counted; groups without any other key have an empty sketch. `key` is an integer, a text or binary.
    """
    return df.groupBy(*by).agg(F.hll_sketch_agg(key, F.lit(bits)).alias("sketch"))


def united_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., sketch): the sketches of a group as one, as if drawn from all of its rows; without `by` one row."""
    return sketches.groupBy(*(by or [])).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketched_counts(sketches: DataFrame, name: str = "n") -> DataFrame:
    """The sketches as estimated numbers of distinct keys."""
    return sketches.withColumn(name, F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0).cast("long"))).drop("sketch")


def sketch_error(bits: int = SKETCH_BITS) -> float:
    """The relative standard error of an estimate from united sketches."""
    return 1.04 / 2 ** (bits / 2)


def count_per_key(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def top_keys(df: DataFrame, key: str, k: int = 20, name: str = "n") -> DataFrame:
    """The `k` keys with the most rows, ties by key."""
    return count_per_key(df, key, name).orderBy(F.desc(name), F.asc(key)).limit(k)


def review_summary(
    reviews: DataFrame,
    user: str = "user_id",
    item: str = "business_id",
    stars: str = "stars",
    useful: str = "useful",
    text: str = "text",
    k: int = 20,
) -> DataFrame:
    """All statistics of the review report in one row.

    The two top lists are arrays of at most `k` (key, count) structs; the distinct
    counts are the numbers of their keys. The text is reduced to its length before anything is shuffled, and the tops come
    from map-side combined counts.
    """
    scalars = reviews.select(
        (F.col(useful) > 0).alias("is_useful"),
        (F.col(stars) == 5.0).alias("is_five"),
        F.length(text).cast("long").alias("chars"),
    ).agg(
        F.count_if("is_useful").alias("n_review_useful"),
        F.count_if("is_five").alias("n_review_5_star"),
        F.max("chars").alias("n_characters"),
    )
    one = F.lit(1).alias("one")
    return (
        scalars.select("*", one)
        .join(_top_list(reviews, user, k, "top20_user", "n_user"), "one")
        .join(_top_list(reviews, item, k, "top20_business", "n_business"), "one")
        .select(
            "n_review_useful",
            "n_review_5_star",
            "n_characters",
            "n_user",
            "top20_user",
            "n_business",
            "top20_business",
        )
    )


def _top_list(reviews: DataFrame, key: str, k: int, name: str, distinct: str) -> DataFrame:
    """The top list as one array in one row, of `k` rows at most, and how many distinct keys there are.

    Both are read off the same counts per key, which Spark makes once.
    """
    counts = count_per_key(reviews, key)
    entry = F.struct((-F.col("n")).alias("order"), F.col(key).alias("id"), "n")
    ranked = counts.orderBy(F.desc("n"), F.asc(key)).limit(k).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    top = ranked.select(
        F.lit(1).alias("one"),
        F.transform("entries", lambda e: F.struct(e["id"].alias("id"), e["n"].alias("n"))).alias(name),
    )
    return top.join(counts.agg(F.count(key).alias(distinct)).withColumn("one", F.lit(1)), "one")


def average_by_attribute(
    facts: DataFrame,
    dimension: DataFrame,
    on: str,
    attribute: str,
    value: str,
    name: str = "stars",
) -> DataFrame:
    """Average of `value` per `attribute` of the joined dimension row, highest first.

    Facts are summed per join key before the join, so that a hot key costs
    one row per map task, not a third of the fact table. Rows without a
    partner drop out on both sides; a key that the dimension repeats counts
    once per repetition.
    """
    per_key = (
        facts.filter(F.col(on).isNotNull())
        .groupBy(on)
        .agg(F.sum(value).alias("__sum"), F.count(value).alias("__n"))
    )
    return (
        dimension.select(on, attribute)
        .join(per_key, on)
        .groupBy(attribute)
        .agg(F.try_divide(F.sum("__sum"), F.sum("__n")).alias(name))
        .orderBy(F.desc(name), F.asc(attribute))
    )


def top_averages(averages: DataFrame, attribute: str, k: int = 5, name: str = "stars") -> DataFrame:
    """The first `k` rows of an average table."""
    return averages.orderBy(F.desc(name), F.asc(attribute)).limit(k)
