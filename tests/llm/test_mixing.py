from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from coratia.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def brute_targets(sizes: dict) -> dict:
    """Shares by weight, cut at three times the size, the excess shared out again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


def documents(seed: int = 1, n: int = 600) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a"] * 12 + ["b", "c", "é", "Z", None])
        words = rng.choice([0, 1, 5, 30, 30, 60, 60, 200])
        rows.append((i, " \n".join(["w"] * words), source, None))
    return [*rows, (n, None, "only null", None), (n + 1, "tiny", "small", None)]


def test_targets_are_met(spark):
    rows = documents()
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    source = {r[0]: r[2] for r in rows}
    sizes: dict = defaultdict(int)
    for i, t in text.items():
        sizes[source[i]] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    targets, taken = brute_targets(sizes), defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == len((text[r["doc_id"]] or "").split())
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 60, (s, taken[s], target)


def test_reruns_agree_whatever_the_partitions(spark):
    rows = documents(2)
    runs = [
        sorted(map(tuple, mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(k)).collect())) for k in (1, 7)
    ]
    assert runs[0] == runs[1]


def test_pareto_inclusion_follows_the_preferences(spark):
    # Equal sizes: all documents have the same chance, so a source of weight 1 in 3 loses about half of them.
    rows = [(i, "w " * 10, "ab"[i % 2], None) for i in range(2_000)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    first = [r["copies"] for r in got if r["target"] < 10_000]
    assert abs(sum(first) - 2_000 / 3) <= 1 and set(first) == {0, 1}
    # Short documents are taken more often than long ones of the same source.
    rows = [(i, "w " * (4 if i % 2 else 300), "ab"[i % 4 > 1], None) for i in range(2_000)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    mean = {size: sum(x) / len(x) for size in (4, 300) if (x := [r["copies"] for r in got if r["size"] == size])}
    assert mean[4] > 1.3 * mean[300]


def test_rows_of_the_mix_are_those_of_the_plan(spark):
    table = spark.createDataFrame(documents(3), SCHEMA)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(table).collect()}
    mixed = mixing.mixed_rows(table)
    assert mixed.columns == table.columns
    counted = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counted == {i: c for i, c in copies.items() if c}


def test_odd_tables(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mixed_rows(spark.createDataFrame([], SCHEMA)).count() == 0
    empty_texts = spark.createDataFrame([(1, None, "a", None), (None, "", None, None)], SCHEMA)
    assert [r["taken"] for r in mixing.mix(empty_texts).collect()] == [0, 0]
    twice = spark.createDataFrame([(1, "a b c", "a", None)] * 3 + [(None, "d e", "a", None)] * 2, SCHEMA)
    got = mixing.mix(twice).collect()
    assert len(got) == 5 and sum(r["taken"] for r in got) == 13


@pytest.mark.parametrize("same_text", [True, False])
@pytest.mark.parametrize("doc_id", [7, None])
def test_rows_of_one_id_meet_the_target(spark, doc_id, same_text):
    # 300 rows of one id; their source has weight 1 of 1 + 2, so about a third of 10 words x 600 rows is wanted.
    rows = [(doc_id, "w " * 9 + ("w" if same_text else f"w{i}"), "a", str(i)) for i in range(300)]
    rows += [(1_000 + i, "w " * 10, "b", None) for i in range(300)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(table.repartition(5)).collect()
    assert len(got) == 600 and all(r["taken"] in (0, 10, 20, 30) for r in got)
    target = got[0]["target"] if got[0]["target"] < 3_000 else 6_000 - got[0]["target"]
    taken = [r for r in got if r["doc_id"] == doc_id]
    assert sum(r["taken"] for r in taken) == target == 2_000
    runs = [sorted(map(str, mixing.mixed_rows(table.repartition(k)).collect())) for k in (2, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == 600


def test_words_are_counted_without_python(spark):
    texts = [None, "", " \t\n\x0b\x0c\r", "a", " a\u00a0b  c\x1cd\n\u00e9\U0001f600 x\x00y", "x" * 50 + " " * 50]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.word_count("text").alias("n"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert [n for (n,) in df.collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
