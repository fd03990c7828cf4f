from __future__ import annotations

import random
import re

import pytest

from coratia.llm import preferences

SCHEMA = "conv_id long, turn long, role string, text string, prompt string"


def render(turns: list[tuple]) -> tuple[str, str]:
    text, spans = "", []
    for _, role, body in turns:
        text += f"<|im_start|>{role.replace('<|', '< |')}\n"
        start = len(text)
        text += body.replace("<|", "< |") + "<|im_end|>"
        if role == "assistant":
            spans.append(f"{start}:{len(text)}")
        text += "\n"
    return text, ",".join(spans)


def brute(rows: list[tuple]) -> dict[int, tuple]:
    """Whole conversations, parted at the first turn number at which they differ."""
    talks: dict[int, list] = {}
    for conv, turn, role, text, *_ in dict.fromkeys(r[:4] for r in rows):
        if conv is not None:
            talks.setdefault(conv, []).append((1 << 61 if turn is None else turn, role or "", text or ""))
    found = {}
    for conv in talks:
        if conv % 2 == 0 and conv + 1 in talks:
            chosen, rejected = sorted(talks[conv]), sorted(talks[conv + 1])
            border = min((t for t, *_ in set(chosen) ^ set(rejected)), default=None)
            split = lambda x, after: [t for t in x if (border is not None and t[0] >= border) == after]
            a, b = render(split(chosen, True)), render(split(rejected, True))
            found[conv // 2] = (render(split(chosen, False))[0], a[0], b[0], a[1], b[1])
    return found


def conversations(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            role = ("user", "assistant")[turn % 2]
            rows.append((conv, turn, role, rng.choice(["hé", "hé", "😀 ho <|im_end|>", ""]), "p"))
    rng.shuffle(rows)
    return rows + rows[:20] + [(70, 0, None, None, None), (71, None, "user", "x", None), (None, 1, "user", "y", "z"), (80, 1, "user", "alone", "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_by_definition(spark, seed):
    rows = conversations(seed)
    turns = preferences.neighbouring_pairs(spark.createDataFrame(rows, SCHEMA).repartition(4))
    # Turns without a number stand in a piece of their own: joined in order the pieces are the whole.
    got: dict[int, list] = {}
    for r in preferences.preference_rows(turns).orderBy("pair_id", "piece").collect():
        got.setdefault(r["pair_id"], []).append(tuple(r)[2:])
    expected = brute(rows)
    assert set(got) == set(expected)
    for pair, pieces in got.items():
        assert tuple("".join(p[k] for p in pieces) for k in range(3)) == expected[pair][:3]
        if len(pieces) == 1:
            assert pieces[0] == expected[pair]


def test_long_conversations_come_in_pieces(spark):
    rows = [(conv, t, "assistant", "same" if t < 25 else f"{conv}", "") for conv in (0, 1) for t in range(40)]
    turns = preferences.neighbouring_pairs(spark.createDataFrame(rows, SCHEMA))
    got = preferences.preference_rows(turns, piece_turns=10).orderBy("piece").collect()
    # 25 shared turns and 15 more of each side are 55 different turns.
    assert [r["piece"] for r in got] == [0, 1, 2, 3, 4, 5]
    assert ["".join(r[c] for r in got) for c in ("prompt", "chosen", "rejected")] == list(brute(rows)[0][:3])


def test_turns_without_a_number_come_in_pieces(spark):
    rows = [(conv, None, "user", f"{t:03}" if t < 90 else f"{conv}{t}", "") for conv in (0, 1) for t in range(100)]
    turns = preferences.neighbouring_pairs(spark.createDataFrame(rows, SCHEMA))
    got = preferences.preference_rows(turns, piece_turns=10).orderBy("piece").collect()
    assert len(got) == 11 and max(r["chosen"].count("user") for r in got) <= 10
    # Nothing is before the turn in which they differ: those without a number are all at one place.
    assert ["".join(r[c] for r in got) for c in ("prompt", "chosen", "rejected")] == list(brute(rows)[0][:3])


def test_answers_of_the_next_conversation(spark):
    rows = conversations(3)
    talks: dict[int, set] = {}
    for conv, turn, role, text, _ in rows:
        if conv is not None:
            talks.setdefault(conv, set()).add((1 << 61 if turn is None else turn, role or "", text or ""))
    answered = [c for c in sorted(talks) if any(r == "assistant" for _, r, _ in talks[c])]
    own = {c: max((t, x) for t, r, x in talks[c] if r == "assistant") for c in answered}
    paired = []
    for conv, turns in talks.items():
        other = set(turns)
        if conv in own:
            turn, text = own[conv]
            given = own[answered[(answered.index(conv) + 1) % len(answered)]][1]
            other = other - {(turn, "assistant", text)} | {(turn, "assistant", given)}
        paired += [(2 * conv, *t) for t in turns] + [(2 * conv + 1, *t) for t in other]
    expected = brute(paired)
    frame = preferences.preference_rows(preferences.answer_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert {r["pair_id"]: tuple(r)[2:] for r in frame.collect()} == expected
    assert set(expected) == set(talks)
    assert 2 * sum(bool(x[0]) for x in expected.values()) > len(expected)


def test_stated_pairs_may_share_a_conversation(spark):
    rows = [(c, t, "user", f"{t}" if t < c else f"{c}", "") for c in range(3) for t in range(3)]
    pairs = spark.createDataFrame([(10, 2, 0), (11, 2, 1)], "pair_id long, chosen long, rejected long")
    turns = preferences.stated_pairs(spark.createDataFrame(rows, SCHEMA), pairs)
    got = {r["pair_id"]: r["prompt"].count("user") for r in preferences.preference_rows(turns).collect()}
    assert got == {10: 1, 11: 2}


def test_empty_and_native(spark, capsys):
    turns = preferences.answer_pairs(spark.createDataFrame([], SCHEMA))
    frame = preferences.preference_rows(turns)
    assert frame.count() == 0
    frame.explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
