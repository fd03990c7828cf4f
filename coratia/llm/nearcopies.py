"""Near copies by five-word Jaccard similarity: candidates from SimHash fingerprints and MinHash bands, each one checked exactly.

A text is lower-cased (A-Z only) and cut into words as in `simhash`; its set holds every run of five words (all words, if
fewer). Texts whose sets have a Jaccard similarity of 0.8 or more are linked; groups are the connected components of the links.

1. Equal sets are merged first, so exact copies never make pairs.
2. The SimHash join (`simhash`) groups the fingerprints of the sets' hashes within two bits; each set is checked against the first one of
   its group.
3. A set has `BANDS` values, each a hash of `ROWS` minima under independent hash functions. Sets that share a value
   are candidates; a pair at exactly 0.8 shares none with probability (1 - 0.8 ** 3) ** 20 = 6e-7, a pair above it with less.
4. A group of copies would make the square of its size in pairs, so links are looked for in stars first: of each value's sets
   one drawn by a hash is the centre, and every other set is compared with one centre. Further rounds, with other centres and values, do the same
   with what is not in a group with them yet, as long as they link a fair share. That links nearly all of every group.
5. What may be missing are links between sets of different groups so far that share a value. All those pairs are looked at, in cells of
   bounded size, by bit maps: every shingle sets a bit, and a bit that only one of two sets has stands for a shingle
   that the other lacks. So the maps bound the similarity from above. Pairs that they leave room for, hardly more than the links
   themselves, are checked. No candidate is left out, however many sets share a value.
6. Every link is checked by the Jaccard similarity of the two sets. Texts travel once per round, those of a centre with many others
   to several tasks.

Stored on the way are ids, hashes and, of sets that share a value, bit maps; texts are read again where they are needed.

SimHash alone is not enough here: fingerprints of two texts at 0.8 differ by some 10 of 64 bits, up to 18, and probing parts for
so wide a distance meets a large share of all fingerprints.

Defined results: texts that are null, empty or of white space only have the empty set and are copies of each other. Of a group
the row with the smallest id stays, the smallest row where that id stands in several, or where no row has an id. Columns keep their names,
whatever these are; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coratia.llm.simhash import BITS, SEED, fingerprint_groups
from coratia.operators.graph import star_links
from coratia.plans.lineage import Stored, store

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 3
# Rounds of stars before the remaining pairs are looked at: at least, and at most while a round still links this share of its pairs.
STARS = 2
MOST_STARS = 6
STAR_YIELD = 0.01
# Sets of one value that a cell takes from either side.
STRIP = 1_000
# Bits of a map: at least this many per shingle, up to the most.
MAP_BITS, MOST_BITS = 16, 1 << 17
# Texts that are compared with one centre in one strip.
STAR_MEMBERS = 500
# Rows of cells that one call takes, about.
CELL_ROWS = 2_000

_random = np.random.default_rng(SEED)
# Multiply and add modulo 2 ** 64; the upper halves of the results are compared.
_FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(data: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the runs of words of a UTF-8 text."""
    found = data.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64))


def band_values(found: np.ndarray) -> np.ndarray:
    """One signed long per band; none for the empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    mixed = found ^ (found >> np.uint64(29))
    for at in range(0, len(mixed), 4_096):
        values = mixed[at : at + 4_096][None, :] * _FACTORS[:, None] + _ADDED[:, None]
        least = np.minimum(least, values.min(axis=1))
    rows = (least >> np.uint64(16)).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


_SET = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("fp", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)


def set_fingerprint(found: np.ndarray) -> int:
    """The SimHash fingerprint of a set of hashes: a bit is set if it is set in more than half of them."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(found), 65_536):
        block = found[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found), bitorder="little").view(np.int64)[0])


def _key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


@F.pandas_udf(_SET)
def _sets(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for series in texts:
        keys, sizes, prints, bands = [], [], [], []
        for x in series:
            found = shingles(x)
            keys.append(_key(found))
            sizes.append(len(found))
            prints.append(set_fingerprint(found))
            bands.append(band_values(found))
        yield pd.DataFrame({"key": np.array(keys, np.uint64).view(np.int64), "n": sizes, "fp": prints, "bands": bands})


@F.pandas_udf(T.LongType())
def _keys(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield pd.Series(np.array([_key(shingles(x)) for x in series], np.uint64).view(np.int64))


# --- bit maps ------------------------------------------------------------------------


def map_bits(n: int) -> int:
    """The width of the map of n shingles: a power of two, so that a wider map can be folded to it."""
    return min(MOST_BITS, max(64, 1 << (MAP_BITS * max(n, 1) - 1).bit_length()))


def bit_map(found: np.ndarray) -> bytes:
    width = map_bits(len(found))
    bits = np.zeros(width, bool)
    bits[(found >> np.uint64(3)).astype(np.int64) & (width - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


@F.pandas_udf(T.BinaryType())
def _maps(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield pd.Series([bit_map(shingles(x)) for x in series])


def _folded(maps: list[bytes], width: int) -> np.ndarray:
    """The maps as rows of 64-bit words, folded to `width` bits."""
    out = np.empty((len(maps), width // 64), np.uint64)
    for k, x in enumerate(maps):
        out[k] = np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 64), axis=0)
    return out


def near_by_maps(one: pd.DataFrame, two: pd.DataFrame, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the pairs of different `root` whose maps leave room for the similarity. Rows have key, n, root, map."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    share = similarity / (1 + similarity)
    widths = [part["map"].map(len).to_numpy() * 8 for part in (one, two)]
    for a in np.unique(widths[0]):
        for b in np.unique(widths[1]):
            width = int(min(a, b))
            if max(a, b) > 4 * width:  # so unlike in size that no pair can be similar
                continue
            at, to = np.flatnonzero(widths[0] == a), np.flatnonzero(widths[1] == b)
            x, y = _folded(one["map"].iloc[at].to_list(), width), _folded(two["map"].iloc[to].to_list(), width)
            n, m = one["n"].to_numpy()[at], two["n"].to_numpy()[to]
            roots, others = one["root"].to_numpy()[at], two["root"].to_numpy()[to]
            ones, twos = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
            block = max(1, (1 << 21) // max(1, len(y) * x.shape[1]))
            for k in range(0, len(x), block):
                both = np.bitwise_count(x[k : k + block, None, :] & y[None, :, :]).sum(axis=2, dtype=np.int64)
                i = slice(k, k + block)
                most = np.minimum(n[i, None] - (ones[i, None] - both), m[None, :] - (twos[None, :] - both))
                near = (most >= (n[i, None] + m[None, :]) * share - 1e-9) & (roots[i, None] != others[None, :])
                p, q = np.nonzero(near)
                found.append((at[p + k], to[q]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


# --- candidates and links ------------------------------------------------------------


def _sizes() -> Column:
    return F.least("m", "n") >= F.greatest("m", "n") * SIMILARITY - 1e-9


def _ordered(one: str, two: str) -> list[Column]:
    return [F.least(one, two).alias("src"), F.greatest(one, two).alias("dst")]


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """(src, dst): each set (key, fp) with the smallest key of its group by SimHash fingerprints."""
    groups = store(fingerprint_groups(sets, "key"), "prints")
    return sets.join(groups.sized(), "fp").filter("key != component_id").select(*_ordered("key", "component_id"))


def star_pairs(shared: DataFrame, turn: int = 0) -> DataFrame:
    """(src, dst): each set with one centre it is not in a group with yet. `shared` has (value, have, key, n, root).

    Every turn draws other centres, so that sets that are not like one of them meet another.
    """
    drawn = F.xxhash64("key", F.lit(turn)).alias("at")
    centre = shared.groupBy("value").agg(F.min(F.struct(drawn, "key", "n", "root")).alias("c"))
    centre = centre.select(
        "value", F.col("c.at").alias("at"), F.col("c.key").alias("hub"), F.col("c.n").alias("m"), F.col("c.root").alias("hub_root")
    )
    met = shared.join(centre, "value").filter("root != hub_root").filter(_sizes())
    # First the centre of the value that most sets share, then of a value drawn anew in every turn: the sets of a group tend to meet the same
    # one, and a value that very many unlike sets share does not stand before all others.
    first = F.col("have") if turn == 0 else F.xxhash64("value", F.lit(turn))
    chosen = met.groupBy("key").agg(F.max(F.struct(first.alias("first"), F.bitwise_not("at").alias("order"), "hub")).alias("x"))
    return chosen.select(*_ordered("key", "x.hub"))


def _cell_pairs(cell: pd.DataFrame) -> pd.DataFrame:
    """The pairs of each (value, i, j) that the maps leave room for: strip i against strip j, or inside one."""
    src, dst = [], []
    for _, part in cell.groupby(["value", "i", "j"], sort=False):
        one = part[part["own"] == part["i"]]
        two = one if part["i"].iloc[0] == part["j"].iloc[0] else part[part["own"] == part["j"]]
        if len(one) and len(two) and (one["root"].nunique() > 1 or two["root"].nunique() > 1 or one["root"].iloc[0] != two["root"].iloc[0]):
            i, j = near_by_maps(one, two)
            src.append(one["key"].to_numpy()[i])
            dst.append(two["key"].to_numpy()[j])
    if not src:
        return pd.DataFrame({"src": np.zeros(0, np.int64), "dst": np.zeros(0, np.int64)})
    a, b = np.concatenate(src), np.concatenate(dst)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pd.DataFrame({"src": pairs[:, 0], "dst": pairs[:, 1]})


def cross_pairs(shared: DataFrame, maps: DataFrame, strip: int = STRIP) -> DataFrame:
    """(src, dst): all pairs of sets of different groups that share a value and that their maps leave room for."""
    mixed = shared.groupBy("value").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.first("have").alias("have"))
    mixed = store(mixed.filter("a != b").select("value", "have"), "mixed")
    copies = mixed.df.agg(F.sum(F.col("have") * F.ceil(F.col("have") / F.lit(strip)))).first()[0] or 0
    rows = shared.join(mixed.fits(mixed.df.select("value")), "value")
    strips = F.ceil(F.col("have") / F.lit(strip)).cast("int")
    laid = rows.select(
        "value", "key", "n", "root", F.pmod(F.xxhash64("key", "value"), strips).cast("int").alias("own"), strips.alias("strips")
    ).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
    laid = laid.select(
        "value", "key", "n", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    laid = laid.join(maps, "key")
    # Small cells travel together, a large one alone.
    cells = max(1, copies // CELL_ROWS)
    return laid.groupBy(F.pmod(F.xxhash64("value", "i", "j"), F.lit(cells))).applyInPandas(_cell_pairs, "src long, dst long").distinct()


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links among rows (src, strip, member, dst, text) in order: first a centre, then the members compared with it."""
    known, b = None, np.zeros(0, np.uint64)
    for rows in batches:
        src, dst = [], []
        for hub, member, other, text in zip(rows["src"], rows["member"], rows["dst"], rows["text"]):
            if not member:
                known, b = hub, shingles(text)
                continue
            a = shingles(text)
            both = len(np.intersect1d(a, b, assume_unique=True))
            if hub == known and both >= SIMILARITY * max(1, len(a) + len(b) - both) - 1e-9:
                src.append(hub)
                dst.append(other)
        yield pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})


class _Texts:
    """Texts by key: read again from the documents, by id where an id stands for one row.

    The id of a key is chosen once; the rounds ask for some of the keys and store nothing for it.
    """

    def __init__(self, docs: DataFrame, id_column: str, text: str, rows: DataFrame):
        self.text = F.coalesce(F.col(text), F.lit("")).cast("binary")
        self.docs, self.id_column = docs, id_column
        self.sure, self.unsure = rows.filter("once"), rows.filter("not once")
        self.any_unsure = not self.unsure.isEmpty()
        self.chosen = store(self.sure.groupBy("key").agg(F.min("id").alias("id")), "chosen").df

    def of(self, keys: Stored) -> DataFrame:
        """(key, text) of the keys, one text each: equal sets can come from different texts, and any of them will do."""
        chosen = keys.fits(self.chosen.join(keys.sized(), "key", "left_semi"))
        docs = self.docs.select(F.col(self.id_column).alias("id"), self.text.alias("text"))
        found = docs.join(chosen, "id").select("key", "text")
        if self.any_unsure:
            rest = store(keys.df.join(chosen, "key", "left_anti"), "rest")
            twice = self.unsure.select("id").distinct()
            some = docs.filter("id is null").unionByName(docs.filter("id is not null").join(twice, "id", "left_semi"))
            found = found.unionByName(
                some.select(_keys("text").alias("key"), "text").join(rest.sized(), "key").groupBy("key").agg(F.min("text").alias("text"))
            )
        return found


def _linked(pairs: Stored, texts: _Texts, members: int = STAR_MEMBERS) -> Stored:
    """Those of the pairs whose texts are similar.

    Pairs with one src come together, `members` to a task's strip, behind its text: a text travels once per pair on one side and once
    per strip on the other.
    """
    asked = pairs.df.select(F.explode(F.array("src", "dst")).alias("key")).distinct()
    known = texts.of(Stored(asked, 2 * pairs.rows, pairs.size))
    counts = pairs.df.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / F.lit(members)).cast("int").alias("strips"))
    counts = store(counts, "strips")
    others = pairs.df.join(counts.sized(), "src").select("src", "dst", F.pmod(F.xxhash64("dst"), "strips").cast("int").alias("strip"))
    others = others.join(known.withColumnRenamed("key", "dst"), "dst").withColumn("member", F.lit(True))
    centres = counts.df.select("src", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip"))
    centres = centres.join(known.withColumnRenamed("key", "src"), "src").select("src", "strip", F.lit(False).alias("member"), F.col("src").alias("dst"), "text")
    laid = centres.unionByName(others).repartition("src", "strip").sortWithinPartitions("src", "strip", "member")
    return store(laid.mapInPandas(_similar, "src long, dst long"), "links")


def _roots(links: DataFrame) -> Stored:
    """(key, root) of the linked keys that are not the smallest of their group."""
    stars = star_links(links)
    return replace(stars, df=stars.df.select(F.col("node").alias("key"), F.col("to").alias("root")))


def linked_sets(sets: DataFrame, texts: _Texts, strip: int = STRIP) -> Stored | None:
    """(key, root) of the sets (key, n, fp, bands) that have a similar one with a smaller key in their group; None where no set has."""
    named = sets.filter("n > 0").select("key", "n", F.explode("bands").alias("value"))
    counts = store(named.groupBy("value").agg(F.count(F.lit(1)).alias("have")).filter("have > 1"), "values")
    shared = store(named.join(counts.sized(), "value"), "shared")
    rooted: Stored | None = None

    def labelled() -> DataFrame:
        if rooted is None:
            return shared.df.withColumn("root", F.col("key"))
        return shared.df.join(rooted.sized(), "key", "left").withColumn("root", F.coalesce("root", "key"))

    def check(pairs: Stored) -> int:
        """How many of the pairs are links, which are added to the groups there are."""
        nonlocal rooted
        fresh = _linked(pairs, texts) if pairs.rows else None
        if fresh is None or not fresh.rows:
            return 0
        # What is known of the groups so far goes along as stars, not as all the links that were ever found.
        before = [] if rooted is None else [rooted.df.select(F.col("root").alias("src"), F.col("key").alias("dst"))]
        rooted = _roots(reduce(DataFrame.unionByName, before, fresh.df))
        return fresh.rows

    check(store(fingerprint_pairs(sets.filter("n > 0").select("key", "fp")), "pairs"))
    if not shared.rows:
        return rooted
    for turn in range(MOST_STARS):
        pairs = store(star_pairs(labelled(), turn).distinct(), "pairs")
        found = check(pairs)
        if turn + 1 >= STARS and found <= pairs.rows * STAR_YIELD:
            break
    members = store(shared.df.select("key").distinct(), "members")
    maps = texts.of(members).select("key", _maps("text").alias("map"))
    check(store(cross_pairs(labelled(), store(maps, "maps").df, strip), "pairs"))
    return rooted


# --- the stage -----------------------------------------------------------------------


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", strip: int = STRIP) -> DataFrame:
    """`docs` with one row of each group left: the one with the smallest id."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    made = docs.select(F.col(id_column).alias("id"), _sets(data).alias("set")).select("id", "set.*")
    every = store(made, "sets").df
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    sets = store(
        every.groupBy("key").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("times")), "distinct"
    )
    # An id that stands in several rows needs a look at the rows; almost no table has one.
    twice = store(every.filter("id is not null").groupBy("id").count().filter("count > 1").select("id"), "twice")
    rows = every.select("id", "key").join(
        twice.sized().withColumn("often", F.lit(True)), "id", "left"
    ).select("id", "key", (F.col("id").isNotNull() & F.col("often").isNull()).alias("once"))
    texts = _Texts(docs, id_column, text, rows)
    rooted = linked_sets(sets.df.select("key", "n", "fp", "bands"), texts, strip)
    if rooted is None:
        rows = rows.withColumn("root", F.col("key"))
    else:
        rows = rows.join(rooted.sized(), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rows = store(rows, "rooted")
    least = rows.df.groupBy("root").agg(F.min(rank).alias("least"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    several = store(least.select("root", F.col("least.id").alias("least")), "several")
    told = rows.df.join(several.sized(), "root", "left")
    gone = store(told.filter("once and least is not null and id != least").select("id"), "gone")
    named = docs.select(F.struct("*").alias("row"), F.col(id_column).alias("id"), data.alias("text"))
    sure = named.filter("id is not null")
    if texts.any_unsure:
        sure = sure.join(twice.sized(), "id", "left_anti")
    certain = sure.join(gone.sized(), "id", "left_anti").select("row.*")
    if not texts.any_unsure:
        return certain
    unsure = named.filter("id is null").unionByName(named.filter("id is not null").join(twice.sized(), "id", "left_semi"))
    unsure = unsure.withColumn("key", _keys("text"))
    roots = store(rows.df.filter("not once").select("key", "root").distinct().join(several.sized(), "root", "left"), "unsure")
    unsure = unsure.join(roots.sized(), "key")
    # A group's smallest id, or none at all, may stand in several rows: one of them stays.
    one = unsure.filter("id <=> least").groupBy("root").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return certain.unionByName(one.select("row.*"))
