from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from coratia.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, vector string"


def brute(rows: list[tuple], step: int, nearest: int = 5) -> dict[int, list[int]]:
    fit = [
        (i, np.array(v, np.float32).astype(float))
        for i, v, *_ in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    found = {}
    for i, query in fit:
        if i % step == 0:
            others = [(j, v) for j, v in fit if j != i and len(v) == len(query)]
            scores = neighbours.cosines(query, np.array([v for _, v in others])) if others else []
            found[i] = [j for _, j in sorted((-s, j) for s, (j, _) in zip(scores, others))[:nearest]]
    return found


def searched(spark, rows: list[tuple], step: int, **more) -> dict[int, list[int]]:
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got: dict[int, list] = {}
    for r in neighbours.search(table, neighbours.every(step), **more).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    expected = brute(rows, 50)
    got: dict[int, set] = {}
    for r in neighbours.search(table, neighbours.every(50), shard=500).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(got[q] & set(x)) for q, x in expected.items())
    assert hits >= 0.95 * sum(map(len, expected.values()))


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist(), None) for i in range(30)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0], None) for i in range(40)]
    rows += [(200, None, None), (205, [], None), (210, [0.0] * 4, None), (215, [1.0, None, 0.0, 0.0], None)]
    rows += [(220, [1.0, float("nan"), 0.0, 0.0], None), (225, [1.0, float("inf"), 0.0, 0.0], None)]
    rows += [(None, [1.0, 0.0, 0.0, 0.0], None), (30, [1.0, 2.0], None), (35, [2.0, 1.0], None), (5, rows[5][1], None)]
    assert searched(spark, rows, 5) == {k: v for k, v in brute(_once(rows), 5).items() if v}
    assert searched(spark, rows, 5, shard=10) == {k: v for k, v in brute(_once(rows), 5).items() if v}


def _once(rows: list[tuple]) -> list[tuple]:
    return list({(r[0], str(r[1])): r for r in rows}.values())


def test_scores_are_cosines_and_the_query_is_left_out(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist(), None) for i in range(60)]
    vectors = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows}
    for r in neighbours.search(spark.createDataFrame(rows, SCHEMA), neighbours.every(20)).collect():
        a, b = vectors[r["query_id"]], vectors[r["vec_id"]]
        assert r["query_id"] != r["vec_id"]
        assert abs(r["score"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_pruning_keeps_near_and_diverse_edges():
    unit = np.eye(3)[[0, 0, 0, 1, 2]] + np.array([[0, 0, 0], [0, 0.1, 0], [0, 0.11, 0], [0, 0, 0.1], [0, 0, 0]])
    graph = neighbours.Graph(unit / np.linalg.norm(unit, axis=1)[:, None], degree=3)
    assert graph._pruned(0, np.array([-1, 0, 1, 2, 3, 4, 1])).tolist()[0] == 1
    assert 2 not in graph._pruned(0, np.array([1, 2, 3, 4]))


def test_empty_and_few(spark):
    assert neighbours.search(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert searched(spark, [(0, [1.0, 2.0], None)], 1) == {}
    assert searched(spark, [(0, [1.0, 2.0], None), (1, [2.0, 1.0], None)], 1) == {0: [1], 1: [0]}


def test_crowds_of_near_copies_and_multiples(spark):
    """Crowds larger than the beam, closer together than single precision tells, and multiples of one vector."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 16))
    close = centres[rng.integers(0, 4, 500)] + 1e-4 * rng.normal(size=(500, 16))
    multiples = centres[:1] * 2.0 ** rng.integers(-3, 4, (200, 1)) * rng.integers(1, 99, (200, 1))
    rows = [(i, v.tolist(), None) for i, v in enumerate(np.concatenate([close, multiples]))]
    expected = brute(_once(rows), 20)
    assert searched(spark, rows, 20) == expected


def test_search_meets_every_vertex_once():
    """Missing edges must not reopen the first vertex, which would fill the beam with its copies."""
    unit = np.random.default_rng(6).normal(size=(200, 4))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    found, _ = neighbours.Graph(unit, degree=12).build().search(unit, 64)
    for near in found:
        assert len(set(near[near >= 0].tolist())) == (near >= 0).sum()
