from __future__ import annotations

from collections import Counter

import sentencepiece

import corpus_pipeline
from coratia.llm import mixing, quality
from tests.llm import test_nearcopies, test_secrets

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Each stage by its definition, on what the one before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    def stage(k: int, docs):
        from coratia.plans.lineage import store

        return store(corpus_pipeline.STAGES[k][1](spark, docs, SF)).df

    model = quality.learn(docs)
    judged = quality.judge(docs, model=model).collect()
    kept = stage(0, docs)
    assert kept.columns == columns
    good = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert good == {r["doc_id"]: texts[r["doc_id"]] for r in judged if r["p_good"] >= 0.5 and not r["base_failed"]}
    single = stage(1, kept)
    ids = sorted(good)
    # Near copies are texts of five-word similarity 0.8 or more; three words and two bits, the rule of op2, keep two pairs of them.
    assert sorted(r["doc_id"] for r in single.collect()) == [ids[k] for k in test_nearcopies.brute_kept([good[i] for i in ids])]
    clean = stage(2, single)
    for r in clean.collect():
        text, expected, at = good[r["doc_id"]], "", 0
        for start, _, kind, stop in test_secrets.brute(text):
            expected += text[at:start] + f"[{kind}]" if start >= at else ""
            at = max(at, stop)
        assert r["text"] == expected + text[at:]
    mixed = stage(3, clean)
    assert mixed.columns == columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in mixed.collect()) == copies
    known = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.MODEL)
    clean_texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in stage(4, mixed).collect():
        assert r["ids"] == known.encode(clean_texts[r["doc_id"]]) and r["n_ids"] == len(r["ids"])


def test_run_is_the_stages_in_order(spark):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "secret scan", "source mix", "pieces"]
    assert corpus_pipeline.run(spark, SF).count() > 50
