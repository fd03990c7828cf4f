from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from coratia.llm import simhash
from tests.conftest import rows

SCHEMA = "doc_id long, text string, source string"


def brute_fingerprint(text: str | None) -> int:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_groups(prints: list[int]) -> list[int]:
    """The first position in each one's group."""
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


TEXTS = [None, "", " \n", "one", "One TWO", "A b C d É", "a b c d é", "x " * 500, "été\x85   b"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_by_definition(text):
    assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


def near_prints(seed: int) -> list[int]:
    """Random fingerprints, a crowd around one of them, chains, and correlated bits."""
    rng = random.Random(seed)
    prints = {rng.getrandbits(64) for _ in range(300)}
    centre = rng.getrandbits(64)
    for _ in range(900):
        x = centre
        for _ in range(rng.randint(1, 6)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    x = rng.getrandbits(64)
    for k in range(20):
        prints.add(x := x ^ (3 << (2 * k)))
    stripe = (1 << 21) - 1
    prints |= {(stripe if rng.random() < 0.5 else 0) | rng.getrandbits(8) << 30 for _ in range(150)}
    return sorted(prints)


@pytest.mark.parametrize("crowded", [4, 256])
def test_linked_pairs_are_all_pairs(spark, crowded):
    prints = near_prints(5)
    values = np.array(prints, dtype=np.uint64)
    expected = set()
    for i, x in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values ^ x) <= 2):
            if i != j:
                a, b = signed(prints[i]), signed(prints[int(j)])
                expected.add((min(a, b), max(a, b)))
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp long").repartition(3)
    assert set(rows(simhash.linked_pairs(table, crowded=crowded))) == expected


def test_thresholds_are_the_cheapest_that_sum_up():
    rng = np.random.default_rng(2)
    costs = rng.random((50, 3, 3)) * 100
    costs[:, :, 0] = 0
    thresholds, cost = simhash.allocate(costs, 0)
    assert (thresholds.sum(axis=1) == 0).all()
    for r in range(50):
        options = [
            sum(costs[r, i, t] for i, t in enumerate(ts))
            for ts in np.ndindex(3, 3, 3)
            if sum(ts) == 3
        ]
        assert cost[r] == pytest.approx(min(options))
        assert cost[r] == pytest.approx(sum(costs[r, i, thresholds[r, i] + 1] for i in range(3)))


def test_near_counts_are_those_of_all_values():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 9, 64).astype(float)
    near = simhash.near_counts(counts, 6)
    for v in range(64):
        for e in range(3):
            assert near[e, v] == sum(counts[u] for u in range(64) if (u ^ v).bit_count() == e)


def test_bits_are_dealt_once_and_correlated_ones_together():
    rng = np.random.default_rng(0)
    bits = rng.random((2_000, 64)) < 0.5
    for b in range(40, 55):
        bits[:, b] = bits[:, 40] ^ (rng.random(2_000) < 0.02)
    groups = simhash.group_bits(len(bits), bits.T.astype(float) @ bits)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert any(set(range(40, 55)) <= set(g) for g in groups)


def test_documents_against_brute_force(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(90)}" for _ in range(400)]
    texts = TEXTS + [" ".join(base)] * 5
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(400)] = "new"
        texts.append(" ".join(words))
    prints = [brute_fingerprint(t) for t in texts]
    group = brute_groups(prints)
    docs = spark.createDataFrame([(i * 3, t, None) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i * 3: (f"{p:016x}", g * 3) for i, (p, g) in enumerate(zip(prints, group))}
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == sorted({g * 3 for g in group})


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0
    text, other = "the same words in every row of it", "something else that stands alone here"
    docs = spark.createDataFrame(
        [(7, text, "a"), (7, text, "a"), (None, text, "b"), (9, text, None), (None, other, "c"), (None, other, "d"), (7, "a third text of its own, twice", "e")],
        "doc_id long, text string, fp string",
    )
    found = rows(simhash.near_duplicates(docs).select("doc_id", "component_id").fillna(-1))
    assert found == [(-1, -1), (-1, -1), (-1, 7), (7, 7), (7, 7), (7, 7), (9, 7)]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert rows(kept.fillna(-1, ["doc_id"])) == sorted(
        [(-1, other, "c"), (7, "a third text of its own, twice", "e"), (7, text, "a")]
    )
