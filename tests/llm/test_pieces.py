from __future__ import annotations

import random
import struct

import pytest
import sentencepiece

from coratia.llm import pieces
from tests.conftest import rows

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = [
    "", "a", " a", "  a  b ", "été à la forêt", "日本語のテキスト", "\n\n x", "a▁b", "😀 hi 😀😀", "   ", "x" * 300,
    "thonwhnd" * 40, "\x00\t", 'token = "abc123"', "Ärgeŕ und 　 ﬁ", "  b" * 20,
]


@pytest.fixture(scope="module")
def bpe():
    with open(MODEL, "rb") as file:
        return pieces.Machine(file.read())


def fuzz(seed: int, alphabet: str, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_bpe_ids_are_those_of_merging(bpe):
    known = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = TEXTS + fuzz(1, "abcdeéßñ ▁\n.,!日本😀theinr", 500)
    for text, ids in zip(texts, bpe.encode(texts)):
        assert ids.tolist() == known.encode(text), text
        assert bpe.decode(ids) == known.decode(known.encode(text)), text


def varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number: int, value: int | bytes | float) -> bytes:
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram_model(byte_fallback: bool) -> bytes:
    """A small hand-made model."""
    rng = random.Random(5)
    texts = {"▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "cab", "é", "aé", "▁▁", "cc", "bb▁"}
    entries = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        entries += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    entries += [(t, -rng.random() * 5 - len(t) / 10, 1) for t in sorted(texts)]
    data = b"".join(
        field(1, field(1, t.encode()) + field(2, float(s)) + field(3, kind)) for t, s, kind in entries
    )
    trainer = field(3, pieces.UNIGRAM) + (field(35, 1) if byte_fallback else b"")
    normaliser = field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1)
    return data + field(2, trainer) + field(3, normaliser)


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_paths_are_the_best_ones(byte_fallback):
    data = unigram_model(byte_fallback)
    machine = pieces.Machine(data)
    known = sentencepiece.SentencePieceProcessor(model_proto=data)
    score = known.get_score
    texts = ["", " ", "abc", "zz", "a zzé z", *fuzz(2, "abcé zx", 400)]
    for text, ids in zip(texts, machine.encode(texts)):
        # Paths may tie: then any of the best will do.
        weights = [sum(score(i) for i in path) for path in (ids.tolist(), known.encode(text))]
        assert weights[0] == pytest.approx(weights[1], abs=1e-4), text
        assert len(ids) == len(known.encode(text)) and machine.decode(ids) == known.decode(known.encode(text)), text


def charsmap(rules: dict[str, str]) -> bytes:
    """A double-array trie of the rules, built the plain way."""
    targets, places = b"", {}
    for source, target in rules.items():
        places[source.encode()] = len(targets)
        targets += target.encode() + b"\0"
    units: dict[int, int] = {}
    used = {0}

    def place(node: int, prefix: bytes) -> int:
        """Put the children of a prefix into free units; returns the offset."""
        labels = sorted({k[len(prefix)] for k in places if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in places
        base = 1
        while any((node ^ base ^ c) in used for c in labels + [0] * leaf):
            base += 1
        used.update((node ^ base ^ c) for c in labels + [0] * leaf)
        if leaf:
            units[node ^ base] = 1 << 31 | places[prefix]
        for c in labels:
            child = node ^ base ^ c
            inner = prefix + bytes([c])
            offset = place(child, inner)
            units[child] = c | offset << 10 | (256 if inner in places else 0)
        return base

    root = place(0, b"")
    units[0] = root << 10
    size = max(units) + 1
    array = struct.pack(f"<{size}I", *[units.get(i, 1 << 31) for i in range(size)])
    return struct.pack("<I", len(array)) + array + targets


def test_rewriting_rules_are_read_and_the_longest_wins():
    rules = {"ﬁ": "fi", "A": "a", "AB": "x", "é": "é", "Z": ""}
    assert pieces._rules(charsmap(rules)) == rules
    data = unigram_model(True) + field(3, field(2, charsmap(rules)) + field(3, 1) + field(4, 1) + field(5, 1))
    normalise = pieces.Machine(data).normalise
    assert normalise("  AAB ﬁéZZ  c ") == "▁ax▁fié▁c"


def test_on_a_table(spark):
    table = spark.createDataFrame(
        [(i, t, 1) for i, t in enumerate([None, *TEXTS, *TEXTS])], "doc_id long, text string, same int"
    ).repartition(3)
    known = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoded = pieces.encode_texts(table, MODEL)
    assert encoded.columns == [*table.columns, "ids"]
    for row in encoded.collect():
        assert row["ids"] == (None if row["text"] is None else known.encode(row["text"]))
    decoded = {r["doc_id"]: r["text"] for r in pieces.decode_ids(encoded.drop("text"), MODEL).collect()}
    told = {r["doc_id"]: r for r in pieces.round_trip(table, MODEL).collect()}
    for row in table.collect():
        back = None if row["text"] is None else row["text"].replace("▁", " ")
        assert decoded[row["doc_id"]] == back
        assert told[row["doc_id"]]["same"] == (back == row["text"])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rows(pieces.encode_texts(empty, MODEL)) == [] and rows(pieces.round_trip(empty, MODEL)) == []
