from __future__ import annotations

from itertools import combinations
from random import Random

import pytest
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from coratia.operators import baskets
from tests.conftest import rows

SMALL = ["abc"] * 3 + ["ab"] * 2 + ["c"]


def _lines(spark, groups):
    data = [(i, item) for i, group in enumerate(groups) for item in group]
    return spark.createDataFrame(data, "basket long, item string")


def _random_groups(seed, n=60, size=9):
    draw = Random(seed)
    return ["".join(c for c in "abcdefghij"[:size] if draw.random() < 0.45) or "a" for _ in range(n)]


def _brute(groups, support):
    found = {}
    for group in groups:
        for k in range(1, len(group) + 1):
            for items in combinations(sorted(set(group)), k):
                found[items] = found.get(items, 0) + 1
    return sorted((len(items), items, n) for items, n in found.items() if n >= support)


def _frequent(spark, groups, support, **options):
    items = baskets.basket_items(_lines(spark, groups), "basket", "item")
    return rows(baskets.frequent_itemsets(items, support, **options))


def test_small_example(spark):
    assert _frequent(spark, SMALL, 3) == [
        (1, ("a",), 5),
        (1, ("b",), 5),
        (1, ("c",), 4),
        (2, ("a", "b"), 5),
        (2, ("a", "c"), 3),
        (2, ("b", "c"), 3),
        (3, ("a", "b", "c"), 3),
    ]


def test_max_size_and_repeated_items(spark):
    assert _frequent(spark, ["aab", "abb"], 2, max_size=1) == [(1, ("a",), 2), (1, ("b",), 2)]
    assert _frequent(spark, ["aab", "abb"], 2)[-1] == (2, ("a", "b"), 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_baskets_with_and_without_big_ones(spark, seed):
    groups = _random_groups(seed)
    expected = _brute(groups, 12)
    assert _frequent(spark, groups, 12) == expected
    # Baskets above four items are big: they make no pairs. Any grid limit gives the same sets.
    assert _frequent(spark, groups, 12, big=4, limit=20) == expected


def test_support_one_has_no_room_for_big_baskets(spark):
    groups = ["abc", "bd"]
    assert _frequent(spark, groups, 1, big=1) == _brute(groups, 1)


def test_agrees_with_fp_growth(spark):
    groups = _random_groups(5)
    items = baskets.basket_items(_lines(spark, groups), "basket", "item")
    arrays = items.groupBy("basket").agg(F.collect_set("item").alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=(12 - 0.5) / len(groups)).fit(arrays)
    grown = model.freqItemsets.select(F.array_sort("items").alias("items"), "freq")
    found = baskets.frequent_itemsets(items, 12).select("items", "freq")
    assert rows(found) == rows(grown)


def test_size_filter_is_strict(spark):
    items = baskets.basket_items(_lines(spark, ["a", "ab", "abc", "abca"]), "basket", "item", 2)
    assert {r.basket for r in items.collect()} == {2, 3}


def test_orientation(spark):
    lines = _lines(spark, ["ab", "b"])
    assert rows(baskets.basket_sizes(baskets.orient(lines, 1, "basket", "item"))) == [(0, 2), (1, 1)]
    assert rows(baskets.basket_sizes(baskets.orient(lines, 2, "basket", "item"))) == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        baskets.orient(lines, 3, "basket", "item")


def _brute_candidates(groups, chunk_of, support, frequent):
    """Candidates per size, from the definition."""
    chunks = {}
    for i, group in enumerate(groups):
        chunks.setdefault(chunk_of(i), []).append(set(group))
    sizes, result = {}, {}
    for size, items, _ in frequent:
        sizes.setdefault(size, []).append(items)
    for k in range(1, max(sizes) + 1):
        if k == 1:
            pool = {(i,) for group in groups for i in group}
        else:
            pool = {
                a + b[-1:] for a in sizes[k - 1] for b in sizes[k - 1] if a[:-1] == b[:-1] and a < b
            }
        for items in pool:
            for members in chunks.values():
                n = sum(set(items) <= m for m in members)
                if n and n * len(groups) >= support * len(members):
                    result.setdefault(k, set()).add(items)
    return sorted((k, items) for k, found in result.items() for items in found)


def test_report_candidates_and_frequent(spark):
    groups, support = _random_groups(3, 40, 7), 9
    lines = _lines(spark, groups).withColumn("chunk", F.col("basket") % 3)
    items = baskets.basket_items(lines, "basket", "item", chunk="chunk")
    report = baskets.itemset_report(items, support, limit=20)
    frequent = _brute(groups, support)
    assert rows(report.filter("kind = 'frequent'").drop("kind")) == frequent
    with_big = baskets.itemset_report(items, support, big=3, limit=20)
    assert {tuple(map(str, r)) for r in with_big.collect()} == {tuple(map(str, r)) for r in report.collect()}
    candidates = rows(report.filter("kind = 'candidate'").select("size", "items"))
    assert candidates == _brute_candidates(groups, lambda i: i % 3, support, frequent)
    assert {(size, items) for size, items, _ in frequent} <= set(candidates)


def test_frequent_sets_do_not_depend_on_chunks(spark):
    groups, support = _random_groups(4, 30, 6), 8
    found = []
    for n_chunks in (1, 4):
        lines = _lines(spark, groups).withColumn("chunk", F.col("basket") % n_chunks)
        items = baskets.basket_items(lines, "basket", "item", chunk="chunk")
        found.append(rows(baskets.itemset_report(items, support).filter("kind = 'frequent'")))
    assert found[0] == found[1]


def test_single_level_operators(spark):
    groups, support = _random_groups(6, 30, 6), 8
    lines = _lines(spark, groups).withColumn("chunk", F.col("basket") % 3)
    items = baskets.basket_items(lines, "basket", "item", chunk="chunk")
    frequent = _brute(groups, support)
    expected = _brute_candidates(groups, lambda i: i % 3, support, frequent)
    prior = None
    for size in (1, 2, 3):
        candidates = baskets.son_candidates(items, support, prior)
        assert rows(candidates) == [(items,) for k, items in expected if k == size]
        prior = baskets.count_candidates(items, candidates, support)
        assert rows(prior.select("items", "freq")) == [(i, n) for k, i, n in frequent if k == size]


def test_counts_of_given_sets_of_different_sizes(spark):
    groups = ["abc", "ab", "bc", "abcd", "d"]
    items = baskets.basket_items(_lines(spark, groups), "basket", "item")
    given = spark.createDataFrame([(list(s),) for s in ("a", "ab", "abc", "cd", "ax", "x")], "items array<string>")
    found = rows(baskets.count_candidates(items, given, 1))
    assert found == [(("a",), 3), (("a", "b"), 3), (("a", "b", "c"), 2), (("c", "d"), 1)]


def test_empty(spark):
    items = baskets.basket_items(_lines(spark, []), "basket", "item")
    assert baskets.frequent_itemsets(items, 2).collect() == []
    chunked = items.withColumn("chunk", F.lit(0))
    assert baskets.itemset_report(chunked, 2).collect() == []
    assert baskets.frequent_itemsets(_lines(spark, ["a", "b"]), 2).collect() == []
    with pytest.raises(ValueError):
        baskets.frequent_itemsets(items, 0)


@pytest.mark.parametrize("support", [1, 7, 12, 61])
def test_trees_find_what_the_levels_find(spark, support):
    groups = _random_groups(5)
    items = baskets.basket_items(_lines(spark, groups), "basket", "item")
    found = [(size, tuple(names), n) for size, names, n in rows(baskets.frequent_itemsets_fp(items, support))]
    assert sorted(found) == _brute(groups, support)


def test_trees_stop_at_the_size_asked_for(spark):
    items = baskets.basket_items(_lines(spark, SMALL), "basket", "item")
    assert rows(baskets.frequent_itemsets_fp(items, 3, max_size=2)) == rows(baskets.frequent_itemsets(items, 3, max_size=2))


def test_a_basket_too_big_for_a_row_goes_to_the_levels(spark, monkeypatch):
    groups = _random_groups(6)
    items = baskets.basket_items(_lines(spark, groups), "basket", "item")
    asked = []
    monkeypatch.setattr(baskets, "FPGrowth", lambda **_: asked.append(1))
    found = [(size, tuple(names), n) for size, names, n in rows(baskets.frequent_itemsets_fp(items, 9, big=3))]
    assert sorted(found) == _brute(groups, 9) and not asked


def test_trees_of_nothing(spark):
    items = baskets.basket_items(_lines(spark, []), "basket", "item")
    found = baskets.frequent_itemsets_fp(items, 2)
    assert found.columns == ["size", "items", "freq"] and found.collect() == []


@pytest.mark.parametrize("row_items", [0, 3, 64])
def test_baskets_in_rows_hold_what_the_joins_find(spark, monkeypatch, row_items):
    """Whether baskets are rows, in part or at all; sets with an item twice, baskets and chunks without a name."""
    plain = baskets._matches
    monkeypatch.setattr(baskets, "_matches", lambda items, sets: plain(items, sets, row_items=row_items))
    groups, support = _random_groups(9, 40, 7), 8
    lines = _lines(spark, groups).withColumn("chunk", F.col("basket") % 3)
    items = baskets.basket_items(lines, "basket", "item", chunk="chunk")
    expected, prior = _brute_candidates(groups, lambda i: i % 3, support, _brute(groups, support)), None
    for size in (1, 2, 3):
        candidates = baskets.son_candidates(items, support, prior)
        assert rows(candidates) == [(items,) for k, items in expected if k == size]
        prior = baskets.count_candidates(items, candidates, support)
    unnamed = spark.createDataFrame([(None, "a"), (None, "b"), (1, "a"), (1, "b"), (1, "c"), (1, "d")], "basket int, item string")
    given = spark.createDataFrame([(list(s),) for s in ("a", "aa", "ab", "abcd", "abx")], "items array<string>")
    assert rows(baskets.count_candidates(unnamed, given, 1)) == [(("a",), 2), (("a", "a"), 1), (("a", "b"), 1), (("a", "b", "c", "d"), 1)]


def test_few_sets_meet_baskets_without_a_shuffle_of_their_matches(spark):
    groups = _random_groups(9, 40, 7)
    items = baskets.basket_items(_lines(spark, groups), "basket", "item")
    given = spark.createDataFrame([(list(s),) for s in ("ab", "bc", "abc")], "items array<string>")
    found, rest = baskets._matches(items, given)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert rest is None and "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
