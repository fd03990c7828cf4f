from __future__ import annotations

import random
import re

import numpy as np
import pytest

from coratia.llm import quality
from tests.conftest import rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(text: str | None) -> tuple:
    """The base counts, from their definition."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


TEXTS = [
    None,
    "",
    " \n\t ",
    "a",
    "a b c a b c a b",
    "x y\nx y\n\nx y\n \n",
    "été à là\x85nel wide café",
    "a|b # *** <x> $5 %&",
    "w " * 70,
    "\x0bone\x0ctwo\rthree",
]


def test_base_counts_are_those_of_the_definition(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab \n#é") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    judged = quality.judge(docs).select("doc_id", *quality.BASE, "base_failed").collect()
    assert len(judged) == len(texts)
    for row in judged:
        expected = brute(texts[row["doc_id"]])
        assert tuple(row[c] for c in quality.BASE) == expected, texts[row["doc_id"]]
        assert row["base_failed"] == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])


def test_a_rule_that_contradicts_the_others_loses_its_weight():
    rng = np.random.default_rng(1)
    truth = rng.random(4_000) < 0.8
    votes = np.stack(
        [
            np.where(rng.random(4_000) < 0.95, truth, ~truth),
            np.where(rng.random(4_000) < 0.9, truth, ~truth),
            np.where(rng.random(4_000) < 0.9, truth, ~truth),
            rng.random(4_000) < 0.7,  # knows nothing
        ],
        axis=1,
    )
    patterns, counts = np.unique(np.where(votes, 1, -1), axis=0, return_counts=True)
    model = quality.fit(patterns, counts, ("a", "b", "c", "noise"))
    right = [abs(o[2] - o[0]) for o in model.log_odds]
    assert right[3] < 1 < min(right[:3])
    assert model.accuracies[0] == pytest.approx(0.95, abs=0.02)
    # The order of the patterns says nothing.
    shuffled = rng.permutation(len(patterns))
    assert quality.fit(patterns[shuffled], counts[shuffled], model.rules) == model


def test_posterior_in_spark_equals_that_of_the_fit(spark):
    patterns = np.array([[1, 1], [1, -1], [-1, -1], [0, 1]])
    model = quality.fit(patterns, np.array([50, 5, 10, 3]), ("a", "b"))
    table = spark.createDataFrame([tuple(map(int, p)) for p in patterns], "a int, b int")
    from pyspark.sql import functions as F

    got = table.select("a", "b", model.posterior({"a": F.col("a"), "b": F.col("b")}).alias("p")).collect()
    for row in got:
        odds = model.bias + model.log_odds[0][row["a"] + 1] + model.log_odds[1][row["b"] + 1]
        assert row["p"] == pytest.approx(1 / (1 + np.exp(-odds)), rel=1e-12)


def test_junk_goes_and_clean_texts_stay(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    told = quality.judge(table).join(labels, "doc_id").filter("not base_failed")
    counts = {(r["quality"], r["kept"]): r["count"] for r in told.groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) <= 0.01 * counts[1, True]
    assert counts.get((0, True), 0) <= 0.05 * counts[0, False]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.judge(empty).count() == 0
    assert quality.keep_good(empty).columns == empty.columns
    text = " ".join(f"word{i}" for i in range(80)) + "."
    docs = spark.createDataFrame(
        [(1, text, None, None, True), (1, text, None, None, True), (None, text, "x", "y", None), (2, None, None, None, None)],
        "doc_id long, text string, __q string, kept string, p_good boolean",
    )
    assert quality.judge(docs).count() == 4
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 3
