from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from coratia.llm import merkle

KINDS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows: list[tuple]) -> list[tuple]:
    """The rows of the result by the definition: every root made anew from all leaves."""

    def leaf(row: tuple, text: str | None) -> str:
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))

    def up(level: list[str]) -> list[list[str]]:
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
        return levels

    def siblings(levels: list[list[str]], at: int) -> list[str]:
        found = []
        for level in levels[:-1]:
            first = at // 3 * 3
            found += [x for k, x in enumerate(level[first : first + 3]) if first + k != at]
            at //= 3
        return found

    def first_null(value):
        return (value is not None, value if value is not None else "")

    sources: dict = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))

    def tampered(row: tuple) -> str | None:
        even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
        return row[4].replace("\n", "") if even and row[4] is not None else row[4]

    groups = {s: sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for s in order}
    trees = {s: up([leaf(r, r[4]) for r in groups[s]]) for s in order}
    top = up([trees[s][-1][0] for s in order])
    out = []
    for i, s in enumerate(order):
        for k, row in enumerate(groups[s]):
            leaves = list(trees[s][0])
            leaves[k] = leaf(row, tampered(row))
            roots = list(top[0])
            roots[i] = up(leaves)[-1][0]
            folded, root = up(roots)[-1][0], top[-1][0]
            proof = sha("".join(siblings(trees[s], k) + siblings(top, i)))
            out.append((row[0], trees[s][0][k], trees[s][-1][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def found(df) -> list[tuple]:
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, df.collect()), key=str)


def test_states_are_those_of_the_hash():
    digests = np.random.default_rng(1).integers(0, 1 << 32, (50, 8), dtype=np.uint32)
    raw = merkle._bytes(digests)
    state = np.broadcast_to(merkle.START, digests.shape).copy()
    for n in range(4):
        assert merkle._bytes(merkle.finish(state, np.full(50, n))) == [
            hashlib.sha256("".join([x.hex()] * n).encode()).digest() for x in raw
        ]
        state = merkle.absorb(state, digests, np.ones(50, bool))


def table(n: int, sources: int) -> list[tuple]:
    rng = np.random.default_rng(n)
    return [
        (
            i * 3,
            None if i % 11 == 5 else f"s{min(int(rng.integers(0, sources * 2)), sources)}é",
            None if i % 7 == 0 else "en",
            None if i % 13 == 0 else i,
            None if i % 17 == 3 else "" if i % 19 == 0 else f"line {i}\nmore ü\n" * (i % 4) + "end",
        )
        for i in range(n)
    ]


@pytest.mark.parametrize(("n", "sources"), [(1, 1), (2, 1), (30, 3), (700, 5), (300, 290)])
def test_against_brute_force(spark, n, sources):
    rows = table(n, sources)
    assert found(merkle.check(spark.createDataFrame(rows, KINDS).repartition(5))) == brute(rows)


def test_several_passes(spark, monkeypatch):
    """Blocks of a few leaves, so that trees need several passes, the tree of roots too."""
    from pyspark import cloudpickle

    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    monkeypatch.setattr(merkle, "BIN", 20)
    cloudpickle.register_pickle_by_value(merkle)
    try:
        for n, sources in ((400, 2), (200, 180)):
            rows = table(n, sources)
            assert found(merkle.check(spark.createDataFrame(rows, KINDS))) == brute(rows)
    finally:
        cloudpickle.unregister_pickle_by_value(merkle)


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    rows = table(40, 2) + [(None, "s0é", "en", 1, "a\nb"), (6, "s0é", "en", 1, "other"), *table(40, 2)[:5]]
    rows += [(1001, "s1é", "en", None, "word\n" * 400_000), (1002, "s1é", "en", None, "\n")]
    df = spark.createDataFrame(rows, KINDS)
    assert found(merkle.check(df)) == brute(rows)
    clash = df.selectExpr("*", "1 as leaf", "2 as root", "3 as id", "4 as tree", "5 as pos", "6 as `group`")
    assert found(merkle.check(clash)) == brute(rows)


def test_empty_table(spark):
    assert found(merkle.check(spark.createDataFrame([], KINDS))) == []


def test_parents_keep_states_that_resume(spark):
    rows = table(50, 1)
    from coratia.plans.lineage import store

    df = spark.createDataFrame(rows, KINDS).selectExpr("doc_id as id", "source as `group`", "*")
    made = merkle.manifest(store(df.select("id", "group", merkle.leaf().alias("leaf")).selectExpr("*", "cast(null as binary) changed")))
    parents = made.parents().collect()
    assert {p["level"] for p in parents} >= {1, 2, 3}
    for p in parents:
        children = [bytes(p["children"][k : k + 32]) for k in range(0, len(p["children"]), 32)]
        assert bytes(p["digest"]) == hashlib.sha256("".join(c.hex() for c in children).encode()).digest()
        states = merkle._words([bytes(p["states"])])
        for k in range(len(children)):
            going = states[k : k + 1]
            for c in children[k:]:
                going = merkle.absorb(going, merkle._words([c]), np.ones(1, bool))
            assert merkle._bytes(merkle.finish(going, np.array([len(children)]))) == [bytes(p["digest"])]
