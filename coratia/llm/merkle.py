"""A Merkle manifest of a dataset whose parents retain hash states, so that a changed row is folded in without its left siblings.

Each row is a leaf. The leaves of a group (a source), in the order of their ids, form a tree whose nodes have up to `ARITY`
children; the roots of the groups, in the order of the groups, form one more. A parent is the SHA-256 of its children's
digests in hexadecimal. Such a digest is 64 bytes long, one block of SHA-256, so the whole state of the hash
before a child is eight words. A parent keeps a copy of that state for each child slot. Folding a
replaced child takes the copy of its slot, goes on with the replacement and the right siblings, and so on to the root.

Leaves are cut into blocks of `ARITY ** LEVELS` neighbours. A block becomes a subtree inside one task, whatever group it belongs to; the
roots of the blocks are cut into blocks again until each group has one node left. What a block needs from the levels above is
one short path, the same for all its rows, so a row is folded up to the root where its block is.

Defined results: a null column, the text too, is a `-`; an empty one is `0:`. Rows without an id come first in their group and
are never tampered with; rows of equal ids follow each other by their leaves, repeated rows are leaves of their own. Rows without a group form
the first one. A lone leaf is its group's root, a lone group's root is the root. Without siblings the proof is the hash of nothing. An
empty table gives an empty result. Only the named columns count; columns of other names, even those of the result, do not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coratia.operators.ids import dense_codes
from coratia.plans.lineage import Stored, store

ARITY = 3
LEVELS = 6
BLOCK = ARITY**LEVELS
# Nodes that one task takes at a time, in whole blocks.
BIN = 8 * BLOCK
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# --- SHA-256 over many rows at once, with states that can be kept --------------------


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _root_bits(value: int, degree: int) -> int:
    """The first 32 bits after the point of a root, exactly."""
    wide = value << (32 * degree)
    low, high = 0, 1 << 48
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if middle**degree <= wide else (low, middle)
    return low & 0xFFFFFFFF


START = np.array([_root_bits(p, 2) for p in _primes(8)], np.uint32)
_ROUND = [np.uint32(_root_bits(p, 3)) for p in _primes(64)]
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The states (n, 8) after one more block (n, 16) each."""
    w = list(np.ascontiguousarray(blocks.T))
    for t in range(16, 64):
        low = _turned(w[t - 15], 7) ^ _turned(w[t - 15], 18) ^ (w[t - 15] >> np.uint32(3))
        high = _turned(w[t - 2], 17) ^ _turned(w[t - 2], 19) ^ (w[t - 2] >> np.uint32(10))
        w.append(w[t - 16] + low + w[t - 7] + high)
    before = np.ascontiguousarray(states.T)
    a, b, c, d, e, f, g, h = before
    for t in range(64):
        one = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + ((e & f) ^ (~e & g)) + _ROUND[t] + w[t]
        two = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return np.ascontiguousarray((before + np.stack([a, b, c, d, e, f, g, h])).T)


def hexed(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 8) as blocks (n, 16) of their hexadecimal text."""
    raw = digests.astype(">u4").view(np.uint8).reshape(-1, 32)
    text = np.empty((len(raw), 64), np.uint8)
    text[:, 0::2], text[:, 1::2] = _HEX[raw >> 4], _HEX[raw & 15]
    return text.view(">u4").astype(np.uint32)


def finish(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digests of states after `blocks` whole blocks each."""
    last = np.zeros((len(states), 16), np.uint32)
    last[:, 0] = 0x80000000
    bits = blocks.astype(np.uint64) * np.uint64(512)
    last[:, 14], last[:, 15] = (bits >> np.uint64(32)).astype(np.uint32), (bits & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return compress(states, last)


def absorb(states: np.ndarray, digests: np.ndarray, where: np.ndarray) -> np.ndarray:
    """`states` with the text of the digests added in the rows `where`."""
    rows = np.flatnonzero(where)
    if len(rows):
        states = states.copy()
        states[rows] = compress(states[rows], hexed(digests[rows]))
    return states


def _words(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), ">u4").astype(np.uint32).reshape(-1, 8)


def _bytes(words: np.ndarray) -> list[bytes]:
    raw = words.astype(">u4").tobytes()
    return [raw[at : at + 32] for at in range(0, len(raw), 32)]


# One parent on the way up: the slot taken, the number of children, the state before that slot, all children.
STEP = np.dtype([("slot", "u1"), ("n", "u1"), ("state", ">u4", 8), ("children", ">u4", (ARITY, 8))])


def resume(
    digests: np.ndarray, proofs: np.ndarray, slot: np.ndarray, n: np.ndarray, state: np.ndarray, children: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """One level up: the parents' digests with `digests` in their slots, and the proofs' states after the siblings.

    The kept state stands for the left siblings, so only the right ones are hashed again.
    """
    every = np.ones(len(digests), bool)
    going = absorb(state, digests, every)
    for k in range(ARITY):
        going = absorb(going, children[:, k], (k > slot) & (k < n))
        proofs = absorb(proofs, children[:, k], (k != slot) & (k < n))
    return finish(going, n), proofs


# --- growing the trees ---------------------------------------------------------------


def _levels(n: np.ndarray) -> np.ndarray:
    """How many levels stand above `n` nodes inside one block: all of them where the group has several blocks."""
    reach, levels = np.ones(len(n), np.int64), np.zeros(len(n), np.int64)
    for _ in range(LEVELS):
        more = reach < n
        levels[more] += 1
        reach[more] *= ARITY
    return levels


_GROWN = "tree long, block long, n long, level int, index long, digest binary, children binary, states binary"


def _grow(with_paths: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Subtrees of whole blocks of (tree, pos, n, digest).

    A row per parent (level >= 1) with its children and the states kept before each; a row per block (level 0) with its root; if asked
    for, a row per entering node (level -1) with its steps up to that root.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tree", "pos"], kind="stable")
        tree, pos, n = (rows[c].to_numpy(np.int64) for c in ("tree", "pos", "n"))
        words, left = _words(rows["digest"]), _levels(n)
        entered = {"tree": tree, "pos": pos, "n": n, "left": left}
        steps = np.zeros((len(rows), LEVELS), STEP)
        origin = np.arange(len(rows))  # where each entering node's ancestor stands
        out: list[pd.DataFrame] = []

        def told(level: int, keep: np.ndarray, digests: list[bytes], index: np.ndarray, more: dict) -> None:
            block = pos[keep] // ARITY ** (LEVELS - max(level, 0)) if level else index
            out.append(
                pd.DataFrame(
                    {"tree": tree[keep], "block": block, "n": n[keep], "level": level, "index": index, "digest": digests, **more}
                )
            )

        none = {"children": None, "states": None}
        for level in range(LEVELS + 1):
            done = left == level
            if done.any():
                at = pos[done] // ARITY ** (LEVELS - level)
                told(0, done, _bytes(words[done]), at, none)
            going = np.flatnonzero(left > level)
            if not len(going):
                break
            up = pos[going] // ARITY
            opens = np.ones(len(going), bool)
            opens[1:] = (up[1:] != up[:-1]) | (tree[going][1:] != tree[going][:-1])
            parent = np.cumsum(opens) - 1
            slot = pos[going] % ARITY
            size = np.bincount(parent)
            children = np.zeros((len(size), ARITY, 8), np.uint32)
            children[parent, slot] = words[going]
            state = np.broadcast_to(START, (len(size), 8)).copy()
            kept = np.zeros((len(size), ARITY, 8), np.uint32)
            for k in range(ARITY):
                kept[:, k] = state
                state = absorb(state, children[:, k], size > k)
            if with_paths:
                moved = np.full(len(left), -1)
                moved[going] = np.arange(len(going))
                own = np.flatnonzero((origin >= 0) & (moved[np.maximum(origin, 0)] >= 0))
                at = moved[origin[own]]
                step = steps[own, level]
                step["slot"], step["n"] = slot[at], size[parent[at]]
                step["state"], step["children"] = kept[parent[at], slot[at]], children[parent[at]]
                steps[own, level] = step
                fresh = np.full(len(origin), -1)
                fresh[own] = parent[at]
                origin = fresh
            first = going[opens]
            tree, pos, n, left = tree[first], pos[first] // ARITY, n[first], left[first]
            words = finish(state, size)
            keep = np.ones(len(tree), bool)
            raw, marks = children.astype(">u4").tobytes(), kept.astype(">u4").tobytes()
            wide = 32 * ARITY
            told(
                level + 1,
                keep,
                _bytes(words),
                pos,
                {
                    "children": [raw[k * wide : k * wide + 32 * m] for k, m in enumerate(size.tolist())],
                    "states": [marks[k * wide : k * wide + 32 * m] for k, m in enumerate(size.tolist())],
                },
            )
        if with_paths:
            tree, pos, n = entered["tree"], entered["pos"], entered["n"]
            paths = [s[:k].tobytes() for s, k in zip(steps, entered["left"].tolist())]
            out.append(
                pd.DataFrame(
                    {"tree": tree, "block": pos // BLOCK, "n": n, "level": -1, "index": pos, "digest": None, "children": paths, "states": None}
                )
            )
        return pd.concat(out, ignore_index=True)

    return run


def _in_bins(nodes: DataFrame, rows: int, block: Column) -> DataFrame:
    bins = max(1, -(-rows // BIN))
    return nodes.withColumn("bin", F.pmod(F.xxhash64("tree", block), F.lit(bins)).cast("int"))


def grow(nodes: DataFrame, rows: int, largest: int, trees: int, with_paths: bool) -> list[Stored]:
    """What `_grow` makes of (tree, pos, n, digest), pass by pass: the roots of the blocks of one pass enter the next one.

    `rows` in all, in `trees` trees of at most `largest`: both fall by the size of a block with each pass.
    """
    passes: list[Stored] = []
    while True:
        binned = _in_bins(nodes, rows, F.floor(F.col("pos") / BLOCK))
        made = binned.groupBy("bin").applyInPandas(_grow(with_paths or bool(passes)), _GROWN)
        passes.append(store(made, "nodes"))
        if largest <= BLOCK:
            return passes
        largest, rows = -(-largest // BLOCK), rows // BLOCK + trees
        nodes = (
            passes[-1].df.filter((F.col("level") == 0) & (F.col("n") > BLOCK))
            .select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), "digest")
        )


def _roots(passes: list[Stored]) -> DataFrame:
    """(tree, digest) of the trees' roots."""
    found = [p.df.filter((F.col("level") == 0) & (F.col("n") <= BLOCK)).select("tree", "digest") for p in passes]
    made = found[0]
    for more in found[1:]:
        made = made.unionByName(more)
    return made


def _above(passes: list[Stored], beyond: DataFrame) -> DataFrame:
    """(tree, block, above): the steps from the root of each block of the first pass upwards; `beyond` (tree, above) are those from the
    root of each tree. A node of one pass has at most as many blocks below it as a block has nodes, so no key is hot but a tree's."""
    lower: DataFrame | None = None
    for made in reversed(passes):
        blocks = made.df.filter("level = 0").select("tree", "block", "n")
        last = blocks.filter(F.col("n") <= BLOCK).join(beyond, "tree").select("tree", "block", "above")
        if lower is not None:
            last = last.unionByName(lower)
        entering = made.df.filter("level = -1").select("tree", F.col("index").alias("under"), "block", F.col("children").alias("path"))
        lower = entering.join(last, ["tree", "block"]).select(
            "tree", F.col("under").alias("block"), F.concat("path", "above").alias("above")
        )
        final = last
    return final


@dataclass(frozen=True)
class Manifest:
    """leaves (id, leaf, changed, tree, pos, n), the passes over each group's tree, those over the roots, and the root itself."""

    leaves: DataFrame
    rows: int
    passes: list[Stored]
    top: list[Stored]
    root: bytes

    def parents(self) -> DataFrame:
        """(tree, level, index, digest, children, states): every parent of the groups' trees; levels count from the leaves."""
        made = None
        for k, p in enumerate(self.passes):
            part = p.df.filter("level > 0").select("tree", (F.col("level") + k * LEVELS).alias("level"), "index", "digest", "children", "states")
            made = part if made is None else made.unionByName(part)
        return made


def field(name: str, value: Column | None = None) -> Column:
    """`-` if null, else the number of UTF-8 bytes, a colon and the value."""
    text = (F.col(name) if value is None else value).cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: tuple[str, ...] = FIELDS, **replaced: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c, replaced.get(c)) for c in fields]), 256))


def manifest(leaves: Stored) -> Manifest | None:
    """The manifest of (id, group, leaf, changed); None of no rows. `changed` is another leaf to try in the place of `leaf`, or null."""
    if not leaves.rows:
        return None
    order = [F.asc_nulls_first("group"), F.asc_nulls_first("id"), F.asc("leaf"), F.asc_nulls_first("changed")]
    numbered = dense_codes(leaves.df, order)
    groups = store(numbered.groupBy("group").agg(F.min("code").alias("first"), F.count(F.lit(1)).alias("n")), "groups")
    trees = store(dense_codes(groups.df, [F.asc("first")], "tree"), "trees")
    largest = trees.df.agg(F.max("n")).first()[0]
    side = trees.df.withColumnRenamed("group", "__group")
    placed = numbered.join(groups.fits(side), F.col("group").eqNullSafe(F.col("__group"))).select(
        "id", "leaf", "changed", "tree", (F.col("code") - F.col("first")).alias("pos"), "n"
    )
    placed = store(placed, "leaves")
    passes = grow(placed.df.select("tree", "pos", "n", F.col("leaf").alias("digest")), placed.rows, largest, trees.rows, False)
    roots = _roots(passes).select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees.rows).cast("long").alias("n"), "digest"
    )
    top = grow(roots, trees.rows, trees.rows, 1, True)
    return Manifest(placed.df, placed.rows, passes, top, bytes(_roots(top).first()["digest"]))


_FOLDED = "leaf binary, subroot binary, folded binary, proof binary"


def _fold(_key, docs: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    """Each leaf's proof, and the root with its changed leaf in place, from the parents of its block and the steps above."""
    if not len(docs):
        return pd.DataFrame(columns=["id", "leaf", "subroot", "folded", "proof"])
    tree, pos = docs["tree"].to_numpy(np.int64), docs["pos"].to_numpy(np.int64)
    blocks = nodes[nodes["level"] == 0].reset_index(drop=True)
    keys = pd.MultiIndex.from_arrays([blocks["tree"], blocks["block"]])
    own = keys.get_indexer(pd.MultiIndex.from_arrays([tree, pos // BLOCK]))
    changed = docs["changed"].where(docs["changed"].notna(), docs["leaf"])
    words, left = _words(changed), _levels(docs["n"].to_numpy(np.int64))
    proofs, siblings = np.broadcast_to(START, words.shape).copy(), np.zeros(len(docs), np.int64)

    def go_on(at: np.ndarray, *step: np.ndarray) -> None:
        words[at], proofs[at] = resume(words[at], proofs[at], *step)
        siblings[at] += step[1] - 1

    for level in range(1, LEVELS + 1):
        at = np.flatnonzero(left >= level)
        parents = nodes[nodes["level"] == level]
        if not len(at):
            break
        width = ARITY ** (LEVELS - level)
        row = keys.get_indexer(pd.MultiIndex.from_arrays([parents["tree"], parents["block"]]))
        place = parents["index"].to_numpy(np.int64) - parents["block"].to_numpy(np.int64) * width
        where = np.full((len(blocks), width), -1)
        where[row, place] = np.arange(len(parents))
        sizes = parents["children"].map(len).to_numpy() // 32
        filled = np.arange(ARITY)[None, :] < sizes[:, None]
        children, states = np.zeros((2, len(parents), ARITY, 8), np.uint32)
        children[filled], states[filled] = _words(parents["children"]), _words(parents["states"])
        p = where[own[at], pos[at] // ARITY**level - (pos[at] // BLOCK) * width]
        slot = pos[at] // ARITY ** (level - 1) % ARITY
        go_on(at, slot, sizes[p], states[p, slot], children[p])
    paths = [np.frombuffer(x, STEP) for x in blocks["above"]]
    for k in range(max(map(len, paths))):
        have = np.array([len(x) > k for x in paths])
        step = np.array([x[k] if len(x) > k else np.zeros((), STEP) for x in paths], STEP)
        at = np.flatnonzero(have[own])
        s = step[own[at]]
        go_on(at, s["slot"].astype(np.int64), s["n"].astype(np.int64), s["state"].astype(np.uint32), s["children"].astype(np.uint32))
    return pd.DataFrame(
        {
            "id": docs["id"],
            "leaf": docs["leaf"],
            "subroot": blocks["subroot"].to_numpy()[own],
            "folded": _bytes(words),
            "proof": _bytes(finish(proofs, siblings)),
        }
    )


def fold(made: Manifest) -> DataFrame:
    """(id, leaf, subroot, folded, proof) of each row, digests as bytes."""
    nothing = made.leaves.sparkSession.createDataFrame([(0, bytearray())], "tree long, above binary")
    over = _above(made.top, nothing)
    entering = made.top[0].df.filter("level = -1").select(F.col("index").alias("at"), F.col("block").alias("in"), F.col("children").alias("path"))
    over = entering.join(over, F.col("in") == F.col("block")).select(F.col("at").alias("tree"), F.concat("path", "above").alias("above"))
    above = _above(made.passes, over).join(_roots(made.passes).withColumnRenamed("digest", "subroot"), "tree")
    parents = made.passes[0].df.filter("level >= 0").select("tree", "block", "level", "index", "children", "states")
    summary = parents.filter("level = 0").join(above, ["tree", "block"])
    nodes = parents.filter("level > 0").unionByName(summary, allowMissingColumns=True)
    kind = made.leaves.schema["id"].dataType.simpleString()
    docs = _in_bins(made.leaves, made.rows, F.floor(F.col("pos") / BLOCK))
    nodes = _in_bins(nodes, made.rows, F.col("block"))
    return docs.groupBy("bin").cogroup(nodes.groupBy("bin")).applyInPandas(_fold, f"id {kind}, {_FOLDED}")


def check(
    docs: DataFrame,
    id_column: str = "doc_id",
    group: str = "source",
    text: str = "text",
    fields: tuple[str, ...] = FIELDS,
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of `docs`, digests in hexadecimal.

    Where 2 divides the crc32 of the id the row is tampered with: its text loses its line ends, if it has any.
    """
    odd = F.crc32(F.col(id_column).cast("string")) % 2 == 1
    changes = ~F.coalesce(odd, F.lit(True)) & F.contains(F.col(text), F.lit("\n"))
    bare = F.replace(F.col(text), F.lit("\n"), F.lit(""))
    made = docs.select(
        F.col(id_column).alias("id"),
        F.col(group).cast("string").alias("group"),
        leaf(fields).alias("leaf"),
        F.when(changes, leaf(fields, **{text: bare})).alias("changed"),
    )
    built = manifest(store(made, "leaves"))
    kind = docs.schema[id_column].dataType.simpleString()
    if built is None:
        folded = docs.sparkSession.createDataFrame([], f"id {kind}, {_FOLDED}")
        root = F.lit("")
    else:
        folded, root = fold(built), F.lit(built.root.hex())

    def text_of(name: str) -> Column:
        return F.lower(F.hex(name))

    return folded.select(
        F.col("id").alias(id_column),
        text_of("leaf").alias("leaf"),
        text_of("subroot").alias("subroot"),
        root.alias("root"),
        text_of("proof").alias("proof_sha256"),
        text_of("folded").alias("folded_root"),
        (text_of("folded") == root).alias("verified"),
    )
