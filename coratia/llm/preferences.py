"""Preference formatting: one prompt and two masked completions per pair of conversations.

A pair is a chosen and a rejected conversation. Their longest common prefix of
turns is rendered once, as the prompt; what follows is rendered as two
completions. A completion comes with the spans, in code points, of what a model
is to learn from it: the words of the assistant and the mark that ends them. The rest is masked.

Everything is DataFrame functions. The different turns of a pair, both sides together, are numbered in their order by a
sort of all pairs, and put together in pieces of `PIECE_TURNS` of them, so a conversation of any length is never one row,
whether its turns have numbers or not: it comes out as several rows of one pair, in the order of
column `piece`. Where the conversations part is a minimum over the turns that only one side has.

Defined results: turns are ordered by number, role and text, those without a number last; a repeated row is one turn; a
null role or text is empty; rows without a conversation belong to no pair; a conversation without its partner gives no row; two equal conversations
give a prompt and two empty completions; conversations that differ at once have an empty prompt. Marks inside a text
are broken by a space, so that no text can open or close a turn. Empty tables give empty results;
other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coratia.operators.ids import dense_codes
from coratia.plans.lineage import store

PIECE_TURNS = 1_000
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"
CHOSEN, REJECTED = 0, 1
_LAST = 1 << 61  # where turns without a number stand


def neighbouring_pairs(conversations: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Turns with pair_id and side: of each two ids 2k and 2k + 1 the first is chosen, the second rejected."""
    number = F.col(conversation).cast("long")
    return conversations.filter(F.col(conversation).isNotNull()).select(
        F.shiftright(number, 1).alias("pair_id"),
        number.bitwiseAND(F.lit(1)).cast("int").alias("side"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )


def answer_pairs(conversations: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """The same with each conversation as chosen, and as rejected the conversation with its last answer taken from the next one.

    The next one is that with the next greater id, of those that have an answer; after the last comes the first. A
    conversation without an answer, or whose answer is the same as the next one's, is a pair of two equal ones.
    """
    turns = conversations.filter(F.col(conversation).isNotNull()).select(
        F.col(conversation).alias("pair_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(_LAST)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    answers = turns.filter(F.col("role") == LEARNT).groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("own"))
    numbered = store(dense_codes(answers, [F.asc("pair_id")], "code"), "answers")
    before = F.pmod(F.col("code") - 1, F.lit(max(numbered.rows, 1)))
    given = numbered.df.select(before.alias("code"), F.col("own.text").alias("given"))
    swaps = numbered.df.join(numbered.fits(given), "code").select("pair_id", "own", "given")
    sides = turns.join(numbered.fits(swaps), "pair_id", "left").withColumn(
        "side", F.explode(F.array(F.lit(CHOSEN), F.lit(REJECTED)))
    )
    last = (F.col("role") == LEARNT) & (F.struct("turn", "text") == F.col("own")) & (F.col("side") == REJECTED)
    text = F.when(F.coalesce(last, F.lit(False)), F.col("given")).otherwise(F.col("text"))
    return sides.select("pair_id", "side", "turn", "role", text.alias("text"))


def stated_pairs(conversations: DataFrame, pairs: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """The same for `pairs` (pair_id, chosen, rejected), which name conversations; one may be in many pairs."""
    sides = pairs.select(
        "pair_id", F.posexplode(F.array(F.col("chosen"), F.col("rejected"))).alias("side", "__conversation")
    )
    turns = conversations.select(F.col(conversation).alias("__conversation"), "turn", "role", "text")
    return turns.join(sides, "__conversation").select(
        "pair_id", "side", F.col("turn").cast("long").alias("turn"), "role", "text"
    )


def _broken(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _broken(turn["role"]), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(_broken(turn["text"]), F.lit(CLOSE))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def _learnt(turns: Column) -> Column:
    """start:stop of the parts to learn from, comma-joined."""
    empty = F.array().cast("array<string>")

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(_head(turn))
        stop = start + F.length(_body(turn))
        span = F.array(F.concat_ws(":", start.cast("string"), stop.cast("string")))
        return F.struct(
            (stop + 1).cast("long").alias("at"),
            F.when(turn["role"] == LEARNT, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))
    return F.array_join(F.aggregate(turns, start, step, lambda s: s["spans"]), ",")


def preference_rows(turns: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """(pair_id, piece, prompt, chosen, rejected, chosen_learnt, rejected_learnt) of (pair_id, side, turn, role, text)."""
    merged = turns.groupBy(
        "pair_id",
        F.coalesce("turn", F.lit(_LAST)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).agg(F.max(F.col("side") == CHOSEN).alias("in_c"), F.max(F.col("side") == REJECTED).alias("in_r"))
    order = [F.asc(c) for c in ("pair_id", "turn", "role", "text")]
    coded = store(dense_codes(merged.filter("pair_id is not null"), order, "code"), "turns")
    pairs = store(
        coded.df.groupBy("pair_id")
        .agg(
            F.min(F.when(~(F.col("in_c") & F.col("in_r")), F.col("turn"))).alias("border"),
            F.min("code").alias("first"),
            F.max("in_c").alias("has_c"),
            F.max("in_r").alias("has_r"),
        )
        .filter("has_c and has_r")
        .select("pair_id", "border", "first"),
        "pairs",
    )
    # A turn at the border differs in part of its rows at most: all its rows belong to the completions.
    common = F.coalesce(F.col("turn") < F.col("border"), F.lit(True))
    row = F.struct("turn", "role", "text")

    def part(condition: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(condition, row)))

    pieces = (
        coded.df.join(pairs.sized(), "pair_id")
        .groupBy("pair_id", F.floor((F.col("code") - F.col("first")) / piece_turns).cast("long").alias("piece"))
        .agg(
            part(common).alias("p"),
            part(~common & F.col("in_c")).alias("c"),
            part(~common & F.col("in_r")).alias("r"),
        )
    )
    return pieces.select(
        "pair_id",
        "piece",
        _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"),
        _rendered(F.col("r")).alias("rejected"),
        _learnt(F.col("c")).alias("chosen_learnt"),
        _learnt(F.col("r")).alias("rejected_learnt"),
    )
