"""Hard negatives by Fagin's threshold algorithm over integer inner products.

Every vector is made of whole numbers, floor(256 x) per component. An anchor's positives are the nearest rows of its label;
for each of them a window of scores, 30 to 90 per cent of the positive's own, holds the negatives asked for: the nearest rows of
other labels inside it.

Rows are dealt into shards of one label and bounded size. A shard keeps, beside its rows, one list per dimension: its rows sorted by that
component. These lists are made once and stored. An anchor goes down all of them at the same pace, each from the end that its own sign
in that dimension makes the dearer one (sorted access), and scores every row it meets in full (random access). The sum over the
dimensions of the anchor's component times the one reached last is the threshold: no row still unmet
scores more. The search of a shard ends when the threshold is strictly below the k-th score of every window, or below the
window itself: a row unmet could then neither enter nor tie. The best of all shards are merged.

Anchors come in blocks, so one task holds a shard and a block. Anchors look for positives in the shards of their own label, and for negatives
in all others, in windows that are known by then. The work is that of blocks times shards, the results of a shard are bounded by what
is asked for.

Defined results: rows without an id or label, whose vector is null or empty or holds a null or non-finite component, take no part, nor do
vectors with a component beyond 2 ** 28 after rounding, whose products need not fit a long. Only vectors of equal length are compared. Rows
that repeat id, label and vector count once; a row with the anchor's id is never its partner. Ties go to smaller ids. A window of a negative
positive score is empty. Empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coratia.plans.lineage import Stored, store

SCALE = 256
ANCHORS, FLIP, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
LEAST, MOST = 30, 90  # per cent of the positive's score
SHARD = 8_192  # rows
ANCHOR_BLOCK = 4_096
MOST_TASKS = 100_000
# Ranks gone down at first in each list before the threshold is looked at; doubled each time.
PACE = 16
_LARGEST = float(1 << 28)


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long; null where the vector takes no part."""
    def fits(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < _LARGEST)

    doubles = vector.cast("array<double>")
    usable = F.coalesce((F.size(doubles) > 0) & F.forall(doubles, fits), F.lit(False))
    return F.when(usable, F.transform(doubles, lambda x: F.floor(x * scale)))


def flipped(id_column: Column, label: Column, every: int = FLIP, labels: int = LABELS) -> Column:
    return F.when(id_column % every == 0, (label + 1) % labels).otherwise(label)


# --- one shard -----------------------------------------------------------------------


class Lists:
    """Rows of one shard, by id, and per dimension their order from the smallest component to the largest."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.values = ids, values
        self.order = np.argsort(values, axis=0, kind="stable").astype(np.int32) if order is None else order

    def search(self, anchor: np.ndarray, own: int, windows: list[tuple[int, int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per window (least, most, k): rows and scores of the k best inside it, best first, ties to smaller ids."""
        n, falls = len(self.ids), anchor > 0
        asked = np.flatnonzero(anchor)
        met = np.zeros(n, bool)
        scores = np.empty(n, np.int64)
        depth, pace = 0, PACE
        weights = anchor[asked]
        while depth < n:
            end = min(n, depth + pace) if len(asked) else n
            # Sorted access, from the end that the anchor's sign makes the dearer one.
            ranks = np.where(falls[asked][None, :], n - 1 - np.arange(depth, end)[:, None], np.arange(depth, end)[:, None])
            reached = self.order[ranks, asked[None, :]]
            seen = np.zeros(n, bool)
            seen[reached.ravel()] = True
            if not len(asked):
                seen[:] = True
            fresh = np.flatnonzero(seen & ~met)
            # Random access: the whole score of every row met for the first time.
            scores[fresh] = self.values[fresh] @ anchor
            met |= seen
            depth, pace = end, pace * 2
            if depth == n or met.all():
                break
            threshold = int((self.values[reached[-1], asked] * weights).sum())
            known = scores[met & (self.ids != own)]
            if all(self._settled(known, threshold, *w) for w in windows):
                break
        found = np.flatnonzero(met & (self.ids != own))
        out = []
        for least, most, k in windows:
            inside = found[(scores[found] >= least) & (scores[found] <= most)]
            best = inside[np.lexsort((self.ids[inside], -scores[inside]))][:k]
            out.append((best, scores[best]))
        return out

    @staticmethod
    def _settled(known: np.ndarray, threshold: int, least: int, most: int, k: int) -> bool:
        if threshold < least or least > most:
            return True
        inside = known[(known >= least) & (known <= most)]
        return len(inside) >= k and threshold < np.partition(inside, len(inside) - k)[len(inside) - k]


def _pack_lists(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("id", kind="stable")
    values = np.stack(rows["v"].to_list()).astype(np.int32)
    lists = Lists(rows["id"].to_numpy(np.int64), values)
    return pd.DataFrame(
        {
            "length": [int(rows["length"].iloc[0])],
            "label": [int(rows["label"].iloc[0])],
            "shard": [int(rows["shard"].iloc[0])],
            "ids": [lists.ids.tobytes()],
            "numbers": [lists.values.tobytes()],
            "lists": [lists.order.tobytes()],
        }
    )


def sorted_lists(rows: DataFrame, shard: int = SHARD) -> Stored:
    """(length, label, shard, ids, numbers, lists): one row per shard of (id, label, v), packed.

    A label with a third of all rows has as many shards as its rows need; copies are dealt by their ids.
    """
    sizes = rows.groupBy("length", "label").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard)).cast("long").alias("shards"))
    sizes = store(sizes, "sizes")
    dealt = rows.join(sizes.sized(), ["length", "label"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")))
    packed = dealt.select("length", "label", "shard", "id", "v").groupBy("length", "label", "shard").applyInPandas(
        _pack_lists, "length int, label long, shard long, ids binary, numbers binary, lists binary"
    )
    return store(packed, "lists")


_FOUND = "anchor long, window int, vec_id long, score long"


def _visit(_key, lists: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
    """The anchors of a block in a shard; each with its windows as an array of (window, least, most, k)."""
    out: dict[str, list] = {c: [] for c in ("anchor", "window", "vec_id", "score")}
    if len(lists) and len(anchors):
        row = lists.iloc[0]
        ids = np.frombuffer(row["ids"], np.int64)
        values = np.frombuffer(row["numbers"], np.int32).reshape(len(ids), -1).astype(np.int64)
        shard = Lists(ids, values, np.frombuffer(row["lists"], np.int32).reshape(values.shape))
        for a in anchors["anchors"].iloc[0]:
            asked = [(w["least"], w["most"], w["k"]) for w in a["windows"]]
            found = shard.search(np.asarray(a["v"], np.int64), a["id"], asked)
            for w, (best, scores) in zip(a["windows"], found):
                out["anchor"] += [a["anchor"]] * len(best)
                out["window"] += [w["window"]] * len(best)
                out["vec_id"] += ids[best].tolist()
                out["score"] += scores.tolist()
    return pd.DataFrame(out)


def _searched(anchors: Stored, lists: DataFrame, same_label: bool, block: int) -> DataFrame:
    """What the anchors (anchor, id, length, label, v, windows) find in the shards of their own label, or of all others.

    Blocks of anchors and shards meet by keys of their own: every key has one block and one shard.
    """
    blocks = max(1, -(-anchors.rows // block))
    dealt = anchors.df.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)))
    packed = dealt.groupBy("length", F.col("label").alias("of"), "block").agg(
        F.collect_list(F.struct("anchor", "id", "v", "windows")).alias("anchors")
    )
    shards = lists.select("length", "label", "shard")
    askers = dealt.select("length", F.col("label").alias("of"), "block").distinct()
    meets = F.col("label") == F.col("of") if same_label else F.col("label") != F.col("of")
    visits = store(shards.join(askers, "length").filter(meets), "visits")
    keys = ["length", "label", "shard", "of", "block"]
    tasks = min(MOST_TASKS, max(1, 4 * visits.rows))
    left = lists.join(visits.sized(), ["length", "label", "shard"]).repartition(tasks, *keys)
    right = packed.join(visits.sized(), ["length", "of", "block"]).repartition(tasks, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_visit, _FOUND)


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k rows per key with their rank; each task cuts its own part before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("vec_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _window(number: Column, least: Column, most: Column, k: int) -> Column:
    return F.struct(
        number.cast("int").alias("window"), least.cast("long").alias("least"), most.cast("long").alias("most"), F.lit(k).alias("k")
    )


def hard_negatives(
    table: DataFrame,
    is_anchor: Column,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    scale: int = SCALE,
    shard: int = SHARD,
    block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that satisfy `is_anchor`."""
    rows = table.select(
        F.col(id_column).cast("long").alias("id"),
        (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
        quantised(F.col(vector), scale).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("asked"),
    ).filter("id is not null and label is not null and v is not null")
    rows = rows.distinct().select("*", F.size("v").alias("length"), F.monotonically_increasing_id().alias("anchor"))
    kept = store(rows, "rows").df
    lists = sorted_lists(kept, shard).df
    asked = kept.filter("asked").select("anchor", "id", "length", "label", "v")
    everything = _window(F.lit(0), F.lit(-(1 << 62)), F.lit(1 << 62), positives)
    near = _searched(store(asked.withColumn("windows", F.array(everything)), "anchors"), lists, True, block)
    best = _first(near, ["anchor"], positives).select(
        "anchor", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    best = store(best, "positives")
    # Whole numbers: 30 p <= 100 x <= 90 p. Below zero no x is both.
    p = F.col("positive_score")
    windows = best.df.filter(p >= 0).groupBy("anchor").agg(
        F.collect_list(
            _window(F.col("window"), F.expr(f"({least} * positive_score + 99) div 100"), F.expr(f"({most} * positive_score) div 100"), negatives)
        ).alias("windows")
    )
    far = _searched(store(asked.join(windows, "anchor"), "anchors"), lists, False, block)
    found = _first(far, ["anchor", "window"], negatives)
    names = asked.select("anchor", F.col("id").alias("anchor_id"))
    return found.join(best.df.join(names, "anchor"), ["anchor", "window"]).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def mine(table: DataFrame) -> DataFrame:
    """The query: anchors are the ids divisible by `ANCHORS`; where `FLIP` divides the id the label is wrong by one."""
    number, label = F.col("vec_id"), flipped(F.col("vec_id"), F.col("label"))
    return hard_negatives(table, number % ANCHORS == 0, label=label)
