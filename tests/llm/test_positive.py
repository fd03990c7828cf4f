from __future__ import annotations

import zlib

import numpy as np
import pytest

from coratia.llm import positive

SF = "/root/testdata/sf0.01"
KINDS = "doc_id long, text string"


def numpy_sums(x: np.ndarray, trusted: np.ndarray):
    return lambda cells, add: add(x, trusted)


def brute_risk(model, prior: float, x: np.ndarray, trusted: np.ndarray, weights: np.ndarray) -> float:
    g = model.seen(x) @ weights
    bad, good = np.log1p(np.exp(g)), np.log1p(np.exp(-g))
    below = bad.mean() - prior * bad[trusted].mean()
    return prior * good[trusted].mean() + max(0.0, below) + positive.RIDGE / 2 * float((weights[1:] ** 2).sum())


def test_scores_equal_those_of_one_process(spark):
    """The query against the same definition on whole arrays, and held-out accuracy."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = positive.scored(docs.repartition(7), labels).collect()
    assert found[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"} and len(found) == docs.count()
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = docs.select("doc_id", "text").collect()
    out = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows}
    seen = [r for r in rows if not out[r["doc_id"]]]
    x = np.array([positive.described((r["text"] or "").encode()) for r in seen], np.float32).astype(float)
    trusted = np.array([quality.get(r["doc_id"]) == 1 for r in seen])
    model = positive.fit(numpy_sums(x, trusted))
    every = np.array([positive.described((r["text"] or "").encode()) for r in rows], np.float32).astype(float)
    expected = dict(zip([r["doc_id"] for r in rows], model.scores(every)))
    right = wrong = 0
    for r in found:
        assert r["held_out"] == out[r["doc_id"]] and r["predicted"] == int(r["score"] >= 0.5)
        assert r["score"] == pytest.approx(expected[r["doc_id"]], abs=1e-4)
        if r["held_out"] and r["doc_id"] in quality:
            right, wrong = right + (r["predicted"] == quality[r["doc_id"]]), wrong + (r["predicted"] != quality[r["doc_id"]])
    assert right > 100 and wrong <= 0.02 * right


def test_the_risk_is_least_and_never_negative():
    rng = np.random.default_rng(4)
    good, bad = rng.normal(0.4, 0.15, (3_000, positive.FEATURES)), rng.normal(0.6, 0.15, (800, positive.FEATURES))
    x, trusted = np.concatenate([good, bad]), np.zeros(3_800, bool)
    trusted[:900] = True
    model = positive.fit(numpy_sums(x, trusted), 40)
    assert 0.7 < model.prior < 0.87
    s = positive._at(model, numpy_sums(x, trusted), len(x), 900)
    least = positive.risk(s, model.prior, model.weights)
    assert least == pytest.approx(brute_risk(model, model.prior, x, trusted, model.weights), rel=1e-6)
    for _ in range(50):
        other = model.weights + rng.normal(0, 0.05, len(model.weights))
        assert brute_risk(model, model.prior, x, trusted, other) >= least - 1e-4
    assert (model.scores(bad) < 0.5).mean() > 0.9 and (model.scores(good) >= 0.5).mean() > 0.9


def test_a_prior_too_large_does_not_run_away():
    """With a prior above the truth the plain unbiased risk has no minimum; the part for bad texts is held at zero."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0.4, 0.1, (400, positive.FEATURES)), rng.normal(0.6, 0.1, (400, positive.FEATURES))])
    trusted = np.arange(800) < 300
    start = positive.Model(x.mean(axis=0), x.std(axis=0), np.zeros(positive.FEATURES + 1), 0.95)
    model = positive.descend(start, numpy_sums(x, trusted), 800, 300, 60)
    s = positive._at(model, numpy_sums(x, trusted), 800, 300)
    assert np.isfinite(model.weights).all() and positive.risk(s, 0.95, model.weights) >= 0
    assert (model.scores(x[:400]) >= 0.5).mean() > 0.95


def test_best_bin():
    trusted, every = np.array([0, 0, 0, 1000, 9000]), np.array([9000, 1000, 0, 9000, 81000])
    assert positive.best_bin(trusted, every) == pytest.approx(0.9, abs=0.01)


def test_labels_that_may_not_be_looked_at(spark):
    """Labels of held-out rows, and labels that are not 1, change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality when quality = 0 then -5 else quality end quality")
    first, second = (sorted(map(tuple, positive.scored(docs, t).collect())) for t in (labels, turned))
    assert first == second


def test_nulls_long_and_empty_texts_repeats_and_no_labels(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "some words"), (5, "word " * 300_000), (6, "a few words here"), (6, "a few words here"), (9, "x")]
    docs = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], KINDS + ", score int, x int, trusted int")
    labels = spark.createDataFrame([(1, 1), (6, 1), (6, 0), (None, 1), (5, None), (9, 1), (2, 1)], "doc_id long, quality int")
    found = sorted(map(tuple, positive.scored(docs, labels).collect()), key=str)
    assert len(found) == len(rows) and all(0 <= r[2] <= 1 for r in found)
    by_id = {}
    for r in found:
        by_id.setdefault(r[0], set()).add(r[2])
    assert len(by_id[6]) == 1 and by_id[1] == by_id[2]
    assert [r[1] for r in found if r[0] is None] == [False]
    assert {r[2] for r in positive.scored(docs, labels.filter("false")).collect()} == {0.5}
    assert positive.scored(docs.filter("false"), labels).collect() == []
