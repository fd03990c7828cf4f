from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

from coratia.llm import language

SCHEMA = "doc_id long, text string, lang string, held_out string"


def brute_bundle(text: str, space: language.Space) -> np.ndarray:
    letters = " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text) + " "
    letters = " ".join(letters.split()) and " " + " ".join(letters.split()) + " "
    total = np.zeros(space.dimensions)
    for i in range(len(letters) - 2):
        a, b, c = (space.letter(ord(x)) for x in letters[i : i + 3])
        total += np.roll(a, 2) * np.roll(b, 1) * c
    return total


@pytest.mark.parametrize("text", ["abc", "Été à l'école, là-bas! 12 Über", "a", "x" * 500, "日本 語"])
def test_bundles_by_definition(text):
    space = language.Space(256, 3)
    assert (space.bundles([language.run_counts(text), language.run_counts("other")])[0] == brute_bundle(text, space)).all()


def test_texts_without_a_letter_have_no_runs():
    for text in ("", " \n", "12 34 !?", "😀"):
        assert not len(language.run_counts(text)[0])


def test_held_out_by_definition(spark):
    ids = spark.range(200)
    for row in ids.select("id", language.held_out("id").alias("h")).collect():
        assert row["h"] == (zlib.crc32(str(row["id"]).encode()) % 4 == 2)


def test_accuracy_on_texts_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(told) == 1_000
    right = Counter((r["held_out"], r["lang"] == r["lang_pred"]) for r in told)
    assert right[True, True] >= 0.98 * (right[True, True] + right[True, False])
    assert all(0 <= r["score"] <= 1 for r in told)


def test_labels_of_texts_held_out_are_not_looked_at(spark):
    rows = [(i, ("der und die " if i % 2 else "the and of ") * 5, "de" if i % 2 else "en", None) for i in range(80)]
    changed = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else x, h) for i, t, x, h in rows]
    runs = [
        sorted(map(tuple, language.identify(spark.createDataFrame(r, SCHEMA)).collect())) for r in (rows, changed)
    ]
    assert runs[0] == runs[1]
    assert {p[2] for p in runs[0]} == {"de", "en"}


def test_odd_tables(spark):
    assert language.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, "en", "x"), (1, "", None, None), (1, "12 !", "de", None), (3, "the text", None, None)]
    assert {tuple(r)[2:] for r in language.identify(spark.createDataFrame(rows, SCHEMA)).collect()} == {("und", 0.0)}


def test_every_language_is_learnt_from_a_bounded_sample(spark):
    rows = [(i, "the and of with " + f"w{i}", "en", None) for i in range(4_000)]
    rows += [(None, f"der und die nicht {'abc'[i % 3] * (i + 1)}", "de", None) for i in range(10)]
    model = language.learn(spark.createDataFrame(rows, SCHEMA), most=20)
    assert model.languages == ("de", "en")
    assert [p[0] for p in model.predict(["und die nicht", "the with and"])] == ["de", "en"]


def test_rates_never_end_at_zero():
    rates = language.sampling_rates({"a": 3 * 10**12, "b": 5, "c": 10**6}, 20_000)
    assert rates["b"] == 1 and 0 < rates["a"] * 3 * 10**12 <= 10_000 and abs(sum(
        rates[x] * n for x, n in (("a", 3 * 10**12), ("b", 5), ("c", 10**6))) - 20_000) < 1


def brute_predict(model: language.Prototypes, text: str) -> tuple[str, float]:
    bundle = brute_bundle(text, language.Space(model.dimensions, model.seed))
    cosines = [float(v @ bundle / np.sqrt(bundle @ bundle)) for v in model.vectors]
    best = max(range(len(cosines)), key=lambda i: (cosines[i], -i))
    return model.languages[best], min(1.0, max(0.0, cosines[best]))


def test_predictions_by_definition(spark):
    texts = {"en": "The cat and the dog, of course.", "de": "Der Hund und die Katze; nicht öfter."}
    space = language.Space(256, 3)
    vectors = [brute_bundle(texts[x], space) for x in ("de", "en", "de")]
    # Two equal prototypes: the first of them is told.
    model = language.Prototypes(("de", "en", "zz"), np.stack([v / np.sqrt(v @ v) for v in vectors]), 256, 3)
    asked = ["the dog", "Katze und", "o", "x " * 3_000, "Œuvre of the Hund"]
    for text, (lang, score) in zip(asked, model.predict(asked)):
        expected = brute_predict(model, text)
        assert lang == expected[0] and score == pytest.approx(expected[1], abs=1e-9)
    assert model.predict([texts["de"]])[0][0] == "de"
    assert model.predict([None, "", "12"]) == [(language.UNKNOWN, 0.0)] * 3
