"""Quality rules under weak supervision.

Every rule looks at one property of a text and votes good (1), bad (-1) or
abstains (0). No single rule decides: expectation-maximisation fits, without labels, how often each rule gives
each vote on good and on bad texts, and a text is kept if its posterior
probability of being good, given all votes, reaches a threshold. A rule that
contradicts the others loses its weight; a sure one can outvote several weak ones.

Only the counts of distinct vote patterns go to the driver: at most 3 ** (number of rules) rows, however many documents.

Defined results: a null text counts as empty; a text without a word has zero
features, fails the base rules and is not kept; rows are judged one by one,
so repeated rows and repeated or null ids change nothing; an empty table gives an empty result.
Columns whose names are taken by the result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEWEST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
KEEP_FROM = 0.5
ROUNDS = 50
PRIOR = 0.9  # first guess of the share of good texts
SMOOTH = 1.0  # votes added to every cell of the vote tables

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [*BASE, "n_lines", "n_upper", "n_distinct", "n_ends", "n_bare", "n_marks", "n_stutters"]

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_END = re.compile(rb"[#*$%&|<>](?:[\x20\x09-\x0D]|$)")
_BARE = re.compile(rb"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0DA-Za-z\x80-\xFF]+(?![^\x20\x09-\x0D])")


def measure(data: bytes) -> tuple[int, ...]:
    """The features of one UTF-8 text; bytes.split cuts at exactly \\x20 and \\x09-\\x0D."""
    words = data.split()
    n = len(words)
    in_words = sum(map(len, words))
    points = len(data) - len(data.translate(None, bytes(range(0x80, 0xC0)))) if not data.isascii() else 0
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    upper = len(data) - len(data.translate(None, _UPPER))
    lines = [line for line in data.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    return (
        n,
        in_words - points,
        symbols,
        len(lines) - len(set(lines)),
        _covered(windows, n),
        len(lines),
        upper,
        len(set(words)),
        len(_END.findall(data)) if symbols else 0,
        len(_BARE.findall(data)),
        data.count(b"!") + data.count(b"?"),
        sum(map(eq, words, words[1:])),
    )


def _covered(windows: list[tuple], n: int) -> int:
    """Words that lie in a window found twice or more."""
    if len(set(windows)) == len(windows):
        return 0
    found: set = set()
    twice: set = set()
    for window in windows:
        (twice if window in found else found).add(window)
    marked = np.zeros(n, bool)
    at = np.flatnonzero(np.fromiter((w in twice for w in windows), bool, len(windows)))
    for shift in range(3):
        marked[at + shift] = True
    return int(marked.sum())


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in FEATURES]))
def _features(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for series in texts:
        yield pd.DataFrame([measure(x or b"") for x in series], columns=FEATURES, dtype="int64")


def features(text: str | Column) -> Column:
    """A struct of counts of a text; null counts as empty."""
    return _features(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary"))


def _vote(value: Column, bad: Column, good: Column) -> Column:
    """Abstains where the value is null, or neither bad nor good."""
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def votes(q: str) -> dict[str, Column]:
    """The rules, as columns with the votes -1, 0 or 1, over the struct `q` of features."""

    def c(name: str) -> Column:
        return F.col(f"{q}.{name}")

    def per(name: str, of: str = "n_words") -> Column:
        return F.try_divide(c(name).cast("double"), c(of))

    symbols, spread, ends = per("n_symbols"), per("n_symbols", "word_chars"), per("n_ends")
    bare, marks = per("n_bare"), per("n_marks")
    repeated, lines, stutters = per("n_repeat_words"), per("n_dup_lines", "n_lines"), per("n_stutters")
    upper, distinct, length = per("n_upper", "word_chars"), per("n_distinct"), per("word_chars")
    long = c("n_words") >= 2000  # long texts repeat their words for good reason
    return {
        "symbols": _vote(symbols, symbols > 0.2, symbols < 0.02),
        "symbol_share": _vote(spread, spread > 0.04, spread < 0.004),
        "symbol_ends": _vote(ends, ends > 0.15, ends < 0.01),
        "bare_words": _vote(bare, bare > 0.15, bare < 0.02),
        "repeated_words": _vote(repeated, repeated > 0.35, repeated < 0.1),
        "repeated_lines": _vote(lines, (lines > 0.4) & (c("n_dup_lines") > 2), lines < 0.2),
        "stutters": _vote(stutters, stutters > 0.2, stutters < 0.05),
        "variety": _vote(distinct, distinct < F.when(long, 0.05).otherwise(0.15), distinct > F.when(long, 0.1).otherwise(0.3)),
        "capitals": _vote(upper, upper > 0.3, upper < 0.1),
        "marks": _vote(marks, marks > 0.3, marks < 0.05),
        "word_length": _vote(length, (length < 2.5) | (length > 12), length.between(3, 9)),
    }


@dataclass(frozen=True)
class VoteModel:
    """log_odds[rule][vote + 1] is what a vote adds to the log odds of a good text; `bias` is where they start."""

    rules: tuple[str, ...]
    bias: float
    log_odds: tuple[tuple[float, float, float], ...]
    accuracies: tuple[float, ...]

    def posterior(self, ballots: dict[str, Column]) -> Column:
        odds = F.lit(self.bias)
        for rule, (bad, none, good) in zip(self.rules, self.log_odds, strict=True):
            vote = ballots[rule]
            odds = odds + F.when(vote < 0, F.lit(bad)).when(vote > 0, F.lit(good)).otherwise(F.lit(none))
        return 1 / (1 + F.exp(-odds))


def fit(patterns: np.ndarray, counts: np.ndarray, rules: tuple[str, ...], rounds: int = ROUNDS) -> VoteModel:
    """Expectation-maximisation over vote patterns (one row each) and how many texts have them.

    The first guess calls a text bad if two rules do, so that the classes keep
    that meaning: rules that see the same fault from different sides confirm each other. Rounds are fixed, patterns sorted: the same table gives the same model.
    """
    patterns = np.asarray(patterns, dtype=np.int64).reshape(-1, len(rules))
    counts = np.asarray(counts, dtype=np.float64)
    order = np.lexsort(patterns.T[::-1]) if len(patterns) else np.arange(0)
    patterns, counts = patterns[order], counts[order]
    one_hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, rule, vote
    good = np.where((patterns < 0).sum(axis=1) >= 2, 1 - PRIOR, PRIOR)
    for _ in range(rounds):
        table = []
        for weight in (good * counts, (1 - good) * counts):
            seen = np.einsum("p,prv->rv", weight, one_hot) + SMOOTH
            table.append(np.log(seen / seen.sum(axis=1, keepdims=True)))
        share = ((good * counts).sum() + SMOOTH) / (counts.sum() + 2 * SMOOTH)
        bias = float(np.log(share / (1 - share)))
        odds = table[0] - table[1]
        # A bad vote never speaks for a text and a good one never against it.
        odds[:, 0], odds[:, 2] = np.minimum(odds[:, 0], 0), np.maximum(odds[:, 2], 0)
        good = 1 / (1 + np.exp(-np.clip(bias + np.einsum("prv,rv->p", one_hot, odds), -500, 500)))
    right = np.einsum("p,pr->r", good * counts, one_hot[:, :, 2]) + np.einsum("p,pr->r", (1 - good) * counts, one_hot[:, :, 0])
    cast = np.einsum("p,pr->r", counts, one_hot[:, :, 0] + one_hot[:, :, 2])
    return VoteModel(
        rules,
        bias,
        tuple(tuple(float(x) for x in row) for row in odds),
        tuple(float(x) for x in (right + SMOOTH) / (cast + 2 * SMOOTH)),
    )


def _with_features(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("__quality_features", features(text))


def learn(docs: DataFrame, text: str = "text") -> VoteModel:
    """Fit the rules' vote tables on all rows; combined per task, so a few rows per task are shuffled."""
    ballots = votes("__quality_features")
    measured = docs.select(text).transform(_with_features, text)
    patterns = (
        measured.select(*[v.alias(k) for k, v in ballots.items()]).groupBy(*ballots).agg(F.count(F.lit(1)).alias("n"))
    ).collect()
    rules = tuple(ballots)
    return fit(np.array([[r[k] for k in rules] for r in patterns]), np.array([r["n"] for r in patterns]), rules)


def judge(docs: DataFrame, text: str = "text", model: VoteModel | None = None, keep_from: float = KEEP_FROM) -> DataFrame:
    """`docs` with the base counts, base_failed, p_good and kept.

    kept is false where the base rules fail, else whether p_good reaches `keep_from`.
    """
    model = model or learn(docs, text)
    added = [*BASE, "base_failed", "p_good", "kept"]
    measured = _with_features(docs.drop(*[c for c in added if c in docs.columns and c != text]), text)
    n, again = F.col("__quality_features.n_words"), F.col("__quality_features.n_repeat_words")
    judged = measured.withColumns(
        {
            "base_failed": (n < FEWEST_WORDS) | (100 * again > MOST_REPEATED * n),
            "p_good": model.posterior(votes("__quality_features")),
        }
    )
    kept = ~F.col("base_failed") & (F.col("p_good") >= keep_from)
    return judged.select(
        *[c for c in docs.columns if c not in added],
        *[F.col(f"__quality_features.{c}").alias(c) for c in BASE],
        "base_failed",
        "p_good",
        kept.alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text", model: VoteModel | None = None) -> DataFrame:
    """The kept rows of `docs`, with their own columns only, whatever these are called."""
    named = docs.select(F.struct("*").alias("__row"), F.col(text).alias("__text"))
    model = model or learn(docs, text)
    judged = judge(named, "__text", model)
    return judged.filter("kept").select("__row.*")
