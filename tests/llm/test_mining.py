from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from coratia.llm import mining

KINDS = "vec_id long, embedding array<double>, label int"


def brute(rows: list[tuple], anchors: int = 5, least: int = 30, most: int = 90) -> list[tuple]:
    usable = []
    for vec_id, vector, label in rows:
        if vec_id is None or not vector or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = (vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256 * x) for x in vector))
        if row not in usable:
            usable.append(row)
    out = []
    for a in usable:
        if a[0] % anchors:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in usable if b[0] != a[0] and len(b[2]) == len(a[2])
        )
        for minus, positive, _ in [s for s in scored if s[2] == a[1]][:5]:
            inside = [s for s in scored if s[2] != a[1] and least * -minus <= 100 * -s[0] <= most * -minus][:10]
            out += [(a[0], positive, k, s[1], -minus, -s[0]) for k, s in enumerate(inside, 1)]
    return sorted(out)


def found(df, **more) -> list[tuple]:
    label = mining.flipped(F.col("vec_id"), F.col("label"))
    made = mining.hard_negatives(df, F.col("vec_id") % 5 == 0, label=label, **more)
    assert made.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, made.collect()))


def table(n: int, dims: int, seed: int, coarse: bool = False) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    labels = rng.integers(0, 4, n)
    vectors = centres[labels] * rng.uniform(0.2, 1.2, (n, 1)) + rng.normal(size=(n, dims)) * 0.8
    if coarse:  # few distinct scores: ties everywhere
        vectors = np.round(vectors) / 4
    return [(int(i), [float(x) for x in v], int(k)) for i, (v, k) in enumerate(zip(vectors, labels))]


@pytest.mark.parametrize(("coarse", "shard", "block"), [(False, 40, 7), (True, 40, 7), (False, 8192, 4096)])
def test_against_brute_force(spark, coarse, shard, block):
    rows = table(300, 6, 3, coarse)
    df = spark.createDataFrame(rows, KINDS).repartition(4)
    result = found(df, shard=shard, block=block)
    assert result == brute(rows) and len(result) > 500


def test_a_search_stops_before_the_end_and_misses_nothing():
    """Few long components: the threshold falls quickly, and what has not been met is below the windows."""
    rng = np.random.default_rng(5)
    values = rng.integers(-200, 200, (20_000, 3))
    lists = mining.Lists(np.arange(20_000), values)
    looked = []
    real = lists._settled
    lists._settled = lambda known, *rest: looked.append(len(known)) or real(known, *rest)
    for anchor in (np.array([50, -20, 3]), np.array([0, 0, -7]), np.array([0, 0, 0])):
        looked.clear()
        windows = [(-(1 << 62), 1 << 62, 5), (1_000, 4_000, 10), (9_000, 3_000, 10)]
        for (best, scores), (least, most, k) in zip(lists.search(anchor, 17, windows), windows):
            every = values @ anchor
            inside = [(-s, i) for i, s in enumerate(every.tolist()) if i != 17 and least <= s <= most]
            assert list(zip((-scores).tolist(), best.tolist())) == sorted(inside)[:k]
    looked.clear()
    lists.search(np.array([50, -20, 3]), 17, [(-(1 << 62), 1 << 62, 5)])
    assert looked and max(looked) < 10_000


def test_hot_label_and_copies(spark):
    rows = table(200, 4, 9)
    rows += [(1000 + i, [0.5, 0.25, -0.5, 1.0], 2 if i % 3 else 3) for i in range(150)]
    df = spark.createDataFrame(rows, KINDS)
    assert found(df, shard=16, block=11) == brute(rows)


def test_unusable_and_repeated_rows_and_clashing_columns(spark):
    rows = table(60, 3, 2)
    bad = [
        (None, [1.0, 2.0, 3.0], 1), (101, None, 1), (102, [], 1), (103, [1.0, None, 2.0], 1), (104, [1.0, math.nan, 2.0], 1),
        (105, [1.0, math.inf, 2.0], 1), (106, [1.0, 2.0, 3.0], None), (110, [1.0, 2.0], 1), (112, [0.0, 0.0, 0.0], 1),
        (115, [1.0, 2.0], 1), (120, [2.0, 1.0], 2), (35, [0.1, 0.7, 0.2], 3), *rows[:10],
    ]
    df = spark.createDataFrame(rows + bad, KINDS)
    expected = brute(rows + bad)
    assert found(df) == expected
    assert found(df.selectExpr("*", "1 as id", "2 as v", "3 as anchor", "4 as length", "5 as shard", "6 as score")) == expected
    assert found(df.filter("vec_id < 0")) == []


def test_query_on_the_given_table(spark):
    from coratia.llm.catalogue import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op13_negatives"](spark, folder).collect())) == brute(rows, anchors=100)
