"""Near-duplicates by SimHash fingerprints, joined by the generalised pigeonhole principle.

A text is lower-cased (A-Z only), cut into words, and every run of three words
(all words, if fewer) is hashed with XXH64; bit b of the fingerprint is set if
it is set in more than half of the hashes. Fingerprints that differ in at most
two bits are linked; groups are the connected components of the links.

The join works on distinct fingerprints:

1. Bits are grouped into three parts so that correlated bits share a part. A
   part full of correlated bits has few, crowded values; the others stay selective.
2. Part i gets a threshold t_i >= -1 (-1: the part is not probed), and these sum to
   2 - 3 + 1 = 0. If every part differed by more than its t_i, all together would differ by more
   than 2, so probing each part within its own threshold misses nothing.
3. Each fingerprint gets its own thresholds, by dynamic programming over the
   parts on estimated candidate counts. The estimates come from value counts of half parts
   (a table of fixed size) and from exact counts of the crowded part values.
4. Where even the cheapest thresholds would meet more candidates than there are
   fingerprints within two bits (2,081), those are probed instead: the join never grows
   with the square of a group of near copies.
5. Every candidate is checked by counting its differing bits.

Defined results: a null or empty text, or one of white space only, has fingerprint zero and is
linked like any other. Rows with equal ids, or the same row repeated, are in one group if their texts are.
A row without an id is linked too; component_id is the smallest id in the group, null if none has one.
Empty tables give empty results; columns of the result replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coratia.operators.graph import components
from coratia.plans.lineage import Stored, store

WORDS = 3
SEED = 42
BITS = 64
DISTANCE = 2
PARTS = 3
# A part value shared by more fingerprints than this is counted exactly before thresholds are chosen.
CROWDED = 256
# Distances within a half part that the estimates look at.
_NEAR = 2


# --- fingerprints ---------------------------------------------------------------------


def fingerprint(data: bytes, words: int = WORDS) -> int:
    """The 64-bit fingerprint of a UTF-8 text, unsigned. bytes.split cuts at exactly \\x20 and \\x09-\\x0D."""
    found = data.lower().split()
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        block = hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield pd.Series(np.array([fingerprint(x) for x in series], dtype=np.uint64).view(np.int64))


def simhash(text: str | Column) -> Column:
    """The fingerprint as a signed long; null counts as empty."""
    return _fingerprints(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary"))


# --- the parts ------------------------------------------------------------------------


def _bit_matrix(fingerprints: np.ndarray) -> np.ndarray:
    return np.unpackbits(fingerprints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_moments(fingerprints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have bits i and j both set: 64 x 64 sums, made in the tasks."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 100_000):
                bits = _bit_matrix(np.ascontiguousarray(values[at : at + 100_000])).astype(np.float32)
                total += bits.T @ bits
                n += len(bits)
        cells = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"])

    rows = (
        fingerprints.select("fp").mapInArrow(sums, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    ).collect()
    cells = np.zeros(BITS * BITS + 1)
    for row in rows:
        cells[row["cell"]] = row["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """Deal the bits into `parts` groups of (nearly) equal width, correlated bits together.

    Greedy: the pair with the largest absolute correlation opens a group, which then takes the bit
    that correlates most with those it has, until it is full.
    """
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.clip(share * (1 - share), 1e-12, None))
    strength = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    # Bits that never vary tell nothing apart: they belong together.
    fixed = spread < 1e-5
    strength[np.ix_(fixed, fixed)] = 1
    np.fill_diagonal(strength, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        width = (BITS * (k + 1)) // parts - (BITS * k) // parts
        inside = strength[np.ix_(free, free)]
        first = free[int(np.argmax(inside.max(axis=1)))]
        group = [first]
        free.remove(first)
        while len(group) < width:
            gains = strength[np.ix_(free, group)].sum(axis=1)
            group.append(free.pop(int(np.argmax(gains))))
        groups.append(sorted(group))
    return groups


def _extract(fp: str, bits: list[int]) -> Column:
    """The given bits of a long, packed; adjacent bits move together."""
    runs: list[list[int]] = []
    for at, bit in enumerate(bits):
        if runs and runs[-1][0] + runs[-1][2] == bit:
            runs[-1][2] += 1
        else:
            runs.append([bit, at, 1])
    value = F.lit(0).cast("long")
    for bit, at, width in runs:
        piece = F.shiftrightunsigned(fp, bit).bitwiseAND(F.lit((1 << width) - 1))
        value = value.bitwiseOR(F.shiftleft(piece, at))
    return value


def _shifted(way: str, value: Column, bits: Column) -> Column:
    return F.call_function(f"shift{way}", value, bits)


@lru_cache(maxsize=8)
def _ball(width: int, radius: int) -> np.ndarray:
    """Masks with at most `radius` of `width` bits set."""
    masks = [0]
    for _ in range(radius):
        masks = sorted({m | (1 << b) for m in masks for b in range(width)} | set(masks))
    return np.array(masks, dtype=np.uint64).view(np.int64)


# --- thresholds -----------------------------------------------------------------------


def _halves(width: int) -> tuple[int, int]:
    return width // 2, width - width // 2


def near_counts(counts: np.ndarray, width: int) -> np.ndarray:
    """near[e, v]: how many rows have a value at exactly e bits from v, from the counts of all 2**width values."""
    near = np.zeros((_NEAR + 1, 1 << width))
    near[0] = counts
    for bit in range(width):
        flipped = near[:, np.arange(1 << width) ^ (1 << bit)]
        # Values that differ in this bit have one difference more.
        before = near.copy()
        near[1:] = before[1:] + flipped[:-1]
    return near


def estimate(near: list[np.ndarray], values: list[np.ndarray], n: int) -> np.ndarray:
    """Estimated rows within 0 and within 1 bits, per value, taking the two halves of a part for independent."""
    low, high = near[0][:, values[0]], near[1][:, values[1]]
    same = low[0] * high[0] / max(n, 1)
    return np.stack([same, same + (low[1] * high[0] + low[0] * high[1]) / max(n, 1)])


def allocate(costs: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest thresholds per row: costs[row, part, t] is the cost of threshold t - 1 in a part; they sum to `total`.

    Dynamic programming over the parts; the state is the sum of the thresholds so far.
    """
    rows, parts, choices = costs.shape
    states = parts * (choices - 1) + 1  # sum of t, from 0
    best = np.full((rows, states), np.inf)
    best[:, 0] = 0
    chosen = np.zeros((parts, rows, states), np.int8)
    for part in range(parts):
        after = np.full((rows, states), np.inf)
        for t in range(choices):
            trial = np.full((rows, states), np.inf)
            trial[:, t:] = best[:, : states - t] + costs[:, part, t : t + 1]
            better = trial < after
            after = np.where(better, trial, after)
            chosen[part][better] = t
        best = after
    state = np.full(rows, total + parts)
    cost = best[np.arange(rows), state]
    thresholds = np.zeros((rows, parts), np.int8)
    for part in reversed(range(parts)):
        thresholds[:, part] = chosen[part, np.arange(rows), state]
        state = state - thresholds[:, part]
    return thresholds - 1, cost


# --- the join -------------------------------------------------------------------------


def _crowded_values(indexed: DataFrame, widths: list[int], crowded: int) -> Stored:
    """(part, value, same, near): how many fingerprints share a crowded value, and how many crowded ones are a bit off."""
    hot = indexed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowded)
    hot = store(hot, "crowded").df
    flips = F.transform(
        F.sequence(F.lit(0), F.element_at(F.array(*[F.lit(w) for w in widths]), F.col("part") + 1) - 1),
        lambda bit: F.col("value").bitwiseXOR(_shifted("left", F.lit(1).cast("long"), bit)),
    )
    around = hot.select("part", F.explode(flips).alias("value"), F.lit(0).cast("long").alias("same"), F.col("n").alias("near"))
    own = hot.select("part", "value", F.col("n").alias("same"), F.lit(0).cast("long").alias("near"))
    return store(
        own.unionByName(around).groupBy("part", "value").agg(F.sum("same").alias("same"), F.sum("near").alias("near")),
        "crowded",
    )


def linked_pairs(fingerprints: DataFrame, distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """(src, dst), src < dst: all pairs of the distinct longs in column fp that differ in 1 .. `distance` bits."""
    if distance != DISTANCE:
        raise ValueError("the parts and thresholds are laid out for a distance of 2")
    n, both = bit_moments(fingerprints)
    groups = group_bits(n, both)
    widths = [len(g) for g in groups]
    parts = fingerprints.select("fp", *[_extract("fp", g).alias(f"v{i}") for i, g in enumerate(groups)])
    index = parts.select("fp", F.posexplode(F.array(*[f"v{i}" for i in range(PARTS)])).alias("part", "value"))
    # Counts of half values: 2 ** 11 cells per half at most, whatever the number of rows.
    halves = [(i, _halves(w)[0]) for i, w in enumerate(widths)]
    cut = F.element_at(F.array(*[F.lit(low) for _, low in halves]), F.col("part") + 1)
    low = F.col("value") - _shifted("left", _shifted("right", F.col("value"), cut), cut)
    high = _shifted("right", F.col("value"), cut)
    cells = (
        index.select("part", F.posexplode(F.array(low, high)).alias("half", "cell"))
        .groupBy("part", "half", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    near = []
    for i, w in enumerate(widths):
        pair = []
        for half, width in enumerate(_halves(w)):
            counts = np.zeros(1 << width)
            for row in cells:
                if row["part"] == i and row["half"] == half:
                    counts[row["cell"]] = row["n"]
            pair.append(near_counts(counts, width))
        near.append(pair)
    hot = _crowded_values(index, widths, crowded)
    known = parts
    for i in range(PARTS):
        table = hot.df.filter(F.col("part") == i).select(
            F.col("value").alias(f"v{i}"), F.col("same").alias(f"same{i}"), F.col("near").alias(f"near{i}")
        )
        known = known.join(hot.fits(table), f"v{i}", "left")
    probes = known.select(
        "fp",
        *[f"v{i}" for i in range(PARTS)],
        *[F.coalesce(c, F.lit(0)).alias(c) for i in range(PARTS) for c in (f"same{i}", f"near{i}")],
    ).mapInArrow(_prober(near, widths, n), "part int, value long, fp long")
    index = index.unionByName(fingerprints.select("fp", F.lit(PARTS).alias("part"), F.col("fp").alias("value")))
    found = probes.withColumnRenamed("fp", "src").join(index.withColumnRenamed("fp", "dst"), ["part", "value"])
    apart = F.bit_count(F.col("src").bitwiseXOR(F.col("dst")))
    return found.filter((F.col("src") < F.col("dst")) & (apart <= distance)).select("src", "dst").distinct()


def _prober(near: list[list[np.ndarray]], widths: list[int], n: int):
    """Per fingerprint: its thresholds, and the part values to look up. Part number PARTS stands for the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "value", "fp"]
        everywhere = _ball(BITS, DISTANCE)
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                block = {c: batch.column(c).to_numpy()[at : at + 20_000] for c in batch.schema.names}
                fp = block["fp"]
                costs = np.zeros((len(fp), PARTS, 3))
                for i, w in enumerate(widths):
                    low = _halves(w)[0]
                    value = block[f"v{i}"]
                    guess = estimate(near[i], [value & ((1 << low) - 1), value >> low], n)
                    costs[:, i, 1] = 1 + np.maximum(guess[0], block[f"same{i}"])
                    costs[:, i, 2] = 1 + w + np.maximum(guess[1], block[f"same{i}"] + block[f"near{i}"])
                thresholds, cost = allocate(costs, DISTANCE - PARTS + 1)
                whole = cost > len(everywhere)
                out = []
                for i, w in enumerate(widths):
                    for t in (0, 1):
                        rows = np.flatnonzero(~whole & (thresholds[:, i] == t))
                        masks = _ball(w, t)
                        values = (block[f"v{i}"][rows][:, None] ^ masks).ravel()
                        out.append((np.full(len(values), i, np.int32), values, np.repeat(fp[rows], len(masks))))
                for part in out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], names)
                rows = np.flatnonzero(whole)
                for start in range(0, len(rows), 50):
                    own = fp[rows[start : start + 50]]
                    values = (own[:, None] ^ everywhere).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(values), PARTS, np.int32)), pa.array(values), pa.array(np.repeat(own, len(everywhere)))],
                        names,
                    )

    return run


def fingerprint_groups(prints: DataFrame, id_column: str) -> DataFrame:
    """(fp, root, component_id) per distinct fingerprint of `prints` (id, fp): its group and the group's smallest id."""
    distinct = store(prints.groupBy("fp").agg(F.min(id_column).alias("least")), "prints")
    links = store(linked_pairs(distinct.df), "links")
    linked = links.df.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    rooted = store(components(linked, links.df).select(F.col("node").alias("fp"), F.col("community").alias("root")), "roots")
    grouped = distinct.df.join(rooted.sized(), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked")
    )
    # Only groups of several fingerprints need their ids compared.
    least = grouped.filter("linked").groupBy("root").agg(F.min("least").alias("component_id"))
    several = grouped.filter("linked").join(rooted.fits(least), "root").select("fp", "root", "component_id")
    return several.unionByName(
        grouped.filter("not linked").select("fp", "root", F.col("least").alias("component_id"))
    )


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, component_id), one row per row of `docs`."""
    prints = store(docs.select(F.col(id_column).alias("__id"), simhash(text).alias("fp")), "fingerprints")
    groups = store(fingerprint_groups(prints.df, "__id"), "groups")
    return prints.df.join(groups.sized(), "fp").select(
        F.col("__id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each group left: the one with the smallest id.

    Where a group's smallest id stands in several rows the smallest row stays;
    a group without any id leaves its smallest row.
    """
    prints = store(docs.select(F.col(id_column).alias("__id"), simhash(text).alias("fp")), "fingerprints")
    groups = store(fingerprint_groups(prints.df, "__id"), "groups")
    told = store(prints.df.join(groups.sized(), "fp").select("__id", "root", "component_id"), "told")
    rows = docs.select(F.struct("*").alias("__row"), F.col(id_column).alias("__id"), F.col(text).alias("__text"))
    dropped = store(told.df.filter("__id is distinct from component_id").select("__id").distinct(), "dropped")
    # An id that stands in several rows needs a look at the rows; almost no table has one.
    twice = store(told.df.filter("__id is not null").groupBy("__id").count().filter("count > 1").select("__id"), "twice")
    certain = rows.filter("__id is not null").join(dropped.sized(), "__id", "left_anti")
    if twice.rows == 0 and told.df.filter("__id is null").isEmpty():
        return certain.select("__row.*")
    certain = certain.join(twice.sized(), "__id", "left_anti")
    unsure = rows.filter("__id is null").unionByName(
        rows.filter("__id is not null").join(twice.sized(), "__id", "left_semi")
    )
    unsure = unsure.withColumn("fp", simhash("__text")).join(groups.sized(), "fp")
    one = (
        unsure.filter(F.col("__id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
    )
    return certain.select("__row.*").unionByName(one.select("__row.*"))
