"""Co-occurrence graphs, edge betweenness, components, modularity and communities.

A graph is a table of directed rows (src, dst) that holds each edge both ways.
Searches run level by level for all roots at once; the state of a level is a
table (root, node, sigma) partitioned by these keys, never a structure on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coratia.operators.ids import dense_codes
from coratia.plans.lineage import BROADCAST_ROWS, Scope, Stored, cut_lineage, fresh_path, store, written
from coratia.plans.skew import MATCHES_PER_CELL, aggregate_pairs

# Groups with more members than this are hot: see `shared_counts`.
HOT_GROUP = 10_000
# At most so many hot groups travel with each member.
MOST_HOT_GROUPS = 1_000
# Members per block of the blocked counts, at most, and marks (members x groups) of one block.
BLOCK_MEMBERS = 2_048
BLOCK_MARKS = 1 << 23
# Cells of a product that cost as much as one match that is shuffled.
CELLS_PER_MATCH = 2_000
# Fewer matches than this are made one by one sooner than blocks are built.
FEWEST_MATCHES = 100_000_000
# Nodes with more edges than this are hubs; their edges are split for searches.
HUB_EDGES = 10_000
# Rows (root, node) that the searches of one batch of roots may hold.
STATE_ROWS = 200_000_000
# Rows (root, edge) that the flows of one batch of roots may hold.
FLOW_ROWS = 1_000_000_000
# Rows of edges in a part of the graph that strips of roots are searched in; larger parts are searched by joins.
PART_EDGES = 8_000_000
# A graph with more (node, edge) combinations than this is taken apart into its components first ...
PART_WORK = 10_000_000_000
# ... of which those with no more nodes than this share parts.
SMALL_PART = 1_024
# Cells (root, node) of a strip whose sums come out, and of one whose cells come out as rows.
STRIP_CELLS = 8_000_000
LISTED_CELLS = 2_000_000
# Steps (root, edge) that a strip is meant to take, as far as that makes no more strips of a part than the most.
STRIP_STEPS = 100_000_000
MOST_STRIPS = 64
# Cells that are gathered at a time.
GATHERED = 1 << 18
# Links that a task of `star_links` holds at a time.
FOREST_LINKS = 500_000
# Betweenness values closer than this many decimals are ties.
TIE_DECIMALS = 9


# --- graph construction -----------------------------------------------------------


def _pack_marks(groups: int) -> Callable:
    """The names of a block's members by place, and its bits: members x groups."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        named = rows.drop_duplicates("place").sort_values("place")
        marks = np.zeros((len(named), groups), bool)
        marks[rows["place"].to_numpy(), rows["g"].to_numpy()] = True
        return pd.DataFrame(
            {"own": [rows["own"].iloc[0]], "names": [named["member"].to_list()], "marks": [np.packbits(marks, axis=1).tobytes()]}
        )

    return run


def _common_marks(groups: int, min_shared: int) -> Callable:
    """The pairs of members of two blocks that share enough groups, from the product of their bits."""

    def matrix(names: np.ndarray, marks: bytes) -> np.ndarray:
        bits = np.frombuffer(marks, np.uint8).reshape(len(names), -1)
        return np.unpackbits(bits, axis=1, count=groups).astype(np.float32)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"member_1": [], "member_2": [], "shared": []})
        # Counts are whole numbers below 2 ** 24, exact in single precision.
        names, others = np.asarray(left["names"].iloc[0]), np.asarray(right["names_2"].iloc[0])
        one = matrix(names, left["marks"].iloc[0])
        shared = one @ (one if key[0] == key[1] else matrix(others, right["marks_2"].iloc[0])).T
        enough = shared >= min_shared
        if key[0] == key[1]:
            enough = np.triu(enough, 1)
        at, to = np.nonzero(enough)
        return pd.DataFrame(
            {
                "member_1": names[at],
                "member_2": others[to],
                "shared": shared[at, to].astype(np.int64),
            }
        )

    return run


def blocked_counts(
    rows: DataFrame,
    min_shared: int,
    block: int | None = None,
    marks: int = BLOCK_MARKS,
    cells_per_match: float = CELLS_PER_MATCH,
    fewest_matches: int = FEWEST_MATCHES,
) -> DataFrame | None:
    """The pairs of `shared_counts` from products of blocked bit matrices; `rows` are distinct (member, group).

    Members are numbered in their order and cut into blocks; a block is a matrix of members x groups, one bit each, that
    travels once to every other block. The product of two blocks counts what all their pairs share: no match becomes a row, however many
    members a group has, only pairs that come out are rows.

    None where that does not pay: where there are fewer matches than `fewest_matches`, or memberships are so sparse that the products'
    cells outnumber the matches `cells_per_match` times, or where there are too many groups for a block.
    """
    per_group = store(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "groups")
    matches = per_group.df.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
    if matches < max(1, fewest_matches):
        return None
    members = store(rows.select("member").distinct(), "members")
    if float(members.rows) ** 2 * per_group.rows > matches * cells_per_match or per_group.rows > marks // 64:
        return None
    # Some sixteen blocks of a small table, so that all cores have work; full ones of a large table.
    size = block or int(min(BLOCK_MEMBERS, marks // per_group.rows, max(64, -(-members.rows // 16))))
    codes = store(dense_codes(members.df, [F.asc("member")]), "codes")
    groups = store(dense_codes(per_group.df.select("group"), [F.asc("group")], "g"), "group-codes")
    placed = (
        rows.join(groups.sized(), "group")
        .join(codes.sized(), "member")
        .select(
            F.floor(F.col("code") / size).cast("int").alias("own"),
            (F.col("code") % size).cast("int").alias("place"),
            "member",
            F.col("g").cast("int").alias("g"),
        )
    )
    kind = rows.schema["member"].dataType
    packed = T.StructType(
        [T.StructField("own", T.IntegerType()), T.StructField("names", T.ArrayType(kind)), T.StructField("marks", T.BinaryType())]
    )
    blocks = -(-members.rows // size)
    placed = cut_lineage(placed.groupBy("own").applyInPandas(_pack_marks(per_group.rows), packed))
    # Block i meets itself and all after it.
    low = placed.select(F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.lit(blocks - 1))).alias("j"), "names", "marks")
    high = placed.select(
        F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"),
        F.col("own").alias("j"),
        # Columns of their own: with the same ones on both sides, the optimizer may prune those of one.
        F.col("names").alias("names_2"),
        F.col("marks").alias("marks_2"),
    )
    tasks = int(min(20_000, max(1, blocks * (blocks + 1) // 2)))
    pairs = T.StructType(
        [T.StructField("member_1", kind), T.StructField("member_2", kind), T.StructField("shared", T.LongType())]
    )
    return (
        low.repartition(tasks, "i", "j").groupBy("i", "j")
        .cogroup(high.repartition(tasks, "i", "j").groupBy("i", "j"))
        .applyInPandas(_common_marks(per_group.rows, min_shared), pairs)
    )


def shared_counts(
    df: DataFrame,
    member: str,
    group: str,
    min_shared: int,
    hot_group: int = HOT_GROUP,
    limit: int = MATCHES_PER_CELL,
) -> DataFrame:
    """(member_1, member_2, shared): pairs of members with at least `min_shared` common groups.

    Members in fewer groups than that are dropped first. Two members with
    `min_shared` common groups have one in common outside any `min_shared - 1`
    groups: the hottest groups, up to that many, make no pairs. Each member
    carries the short list of hot groups it is in, and the lists of a found pair are
    intersected. Where the groups are dense enough, `blocked_counts` makes the pairs instead.
    """
    if min_shared < 1:
        raise ValueError("min_shared must be at least 1")
    rows = df.select(F.col(member).alias("member"), F.col(group).alias("group")).dropna().distinct()
    busy = (
        rows.groupBy("member")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_shared)
        .select("member")
    )
    rows = cut_lineage(rows.join(busy, "member", "left_semi"))
    blocked = blocked_counts(rows, min_shared)
    if blocked is not None:
        return blocked
    hot = cut_lineage(
        rows.groupBy("group")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > hot_group)
        .orderBy(F.desc("n"), "group")
        .limit(min(min_shared - 1, MOST_HOT_GROUPS))
        .select("group")
    )
    n_hot = hot.count()
    # At most MOST_HOT_GROUPS keys are broadcast.
    light = rows.join(F.broadcast(hot), "group", "left_anti") if n_hot else rows
    shared = [F.count(F.lit(1)).alias("shared")]
    pairs = aggregate_pairs(light, ["group"], "member", shared, limit=limit).filter(
        F.col("shared") >= max(1, min_shared - n_hot)
    )
    if n_hot:
        carried = cut_lineage(
            rows.join(F.broadcast(hot), "group", "left_semi")
            .groupBy("member")
            .agg(F.collect_set("group").alias("hot"))
        )
        for side in ("1", "2"):
            named = carried.select(F.col("member").alias(f"member_{side}"), F.col("hot").alias(f"hot_{side}"))
            pairs = pairs.join(named, f"member_{side}", "left")
        common = F.coalesce(F.size(F.array_intersect("hot_1", "hot_2")), F.lit(0))
        pairs = pairs.select(
            "member_1",
            "member_2",
            (F.col("shared") + F.when(F.col("hot_1").isNull() | F.col("hot_2").isNull(), 0).otherwise(common)).alias(
                "shared"
            ),
        ).filter(F.col("shared") >= min_shared)
    return pairs


def both_directions(pairs: DataFrame, one: str, two: str) -> DataFrame:
    """(src, dst) rows in both directions from unordered pairs."""
    return pairs.select(
        F.inline(
            F.array(
                F.struct(F.col(one).alias("src"), F.col(two).alias("dst")),
                F.struct(F.col(two).alias("src"), F.col(one).alias("dst")),
            )
        )
    )


def co_graph(
    df: DataFrame,
    user: str,
    item: str,
    threshold: int,
    hot_group: int = HOT_GROUP,
    limit: int = MATCHES_PER_CELL,
) -> DataFrame:
    """(src, dst), both ways: users with at least `threshold` items in common.

    A user without any edge is not a node.
    """
    return cut_lineage(
        both_directions(shared_counts(df, user, item, threshold, hot_group, limit), "member_1", "member_2")
    )


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


# --- searches ----------------------------------------------------------------------


@dataclass(frozen=True)
class _Steps:
    """Edges laid out for searches: the edges of a hub are split into parts.

    `edges` has (node, part, neighbour, neighbour_parts); a row of the search at a
    node with several parts is sent to each of them. `parts` is None without hubs.
    """

    edges: Stored
    parts: Stored | None

    def expand(self, state: Stored, columns: list[Column]) -> DataFrame:
        """Join selected columns of (node, parts, ...) rows with the edges of their nodes."""
        rows = state.df.select("node", "parts", *columns)
        if self.edges.rows > BROADCAST_ROWS:
            rows = state.fits(rows)
        edges = self.edges.sized()
        if self.parts is None:
            return rows.join(edges, "node")
        spread = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return spread.join(edges, ["node", "part"]).drop("part")

    def with_parts(self, nodes: DataFrame) -> DataFrame:
        if self.parts is None:
            return nodes.withColumn("parts", F.lit(1))
        return nodes.join(self.parts.sized(), "node")


def _steps(edges: DataFrame, hub: int) -> _Steps:
    plain = edges.select(
        F.col("src").alias("node"), F.col("dst").alias("neighbour"), F.lit(1).alias("neighbour_parts")
    )
    degree = degrees(edges)
    if degree.filter(F.col("degree") > hub).isEmpty():
        return _Steps(store(plain), None)
    parts = store(degree.select("node", F.ceil(F.col("degree") / F.lit(hub)).cast("int").alias("parts")))
    ends = parts.df.select(F.col("node").alias("neighbour"), F.col("parts").alias("neighbour_parts"))
    laid_out = (
        plain.drop("neighbour_parts")
        .join(parts.sized(), "node")
        .join(parts.fits(ends), "neighbour")
        .select(
            "node",
            F.pmod(F.xxhash64("neighbour"), F.col("parts")).cast("int").alias("part"),
            "neighbour",
            "neighbour_parts",
        )
    )
    return _Steps(store(laid_out), parts)


def _search_levels(steps: _Steps, roots: DataFrame) -> list[Stored]:
    """One (root, node, sigma, parts) table per level, for all roots at once.

    The neighbours of a level lie on the level before, the same level or the
    next one, so new nodes are told by the last two levels alone: these and the nodes
    reached now go through one aggregation that adds up path counts and drops what was
    there before.
    """
    start = steps.with_parts(roots.select(F.col("node").alias("root"), "node"))
    current = store(start.select("root", "node", F.lit(1.0).alias("sigma"), "parts"))
    levels, before = [], None
    while current.rows:
        levels.append(current)
        reached = steps.expand(current, [F.col("root"), F.col("sigma")]).select(
            "root",
            F.col("neighbour").alias("node"),
            "sigma",
            F.col("neighbour_parts").alias("parts"),
            F.lit(False).alias("old"),
        )
        seen = current.df if before is None else current.df.unionByName(before.df)
        known = seen.select("root", "node", F.lit(0.0).alias("sigma"), "parts", F.lit(True).alias("old"))
        merged = reached.unionByName(known).groupBy("root", "node").agg(
            F.sum("sigma").alias("sigma"), F.max("parts").alias("parts"), F.max("old").alias("old")
        )
        before = current
        current = store(merged.filter(~F.col("old")).drop("old"))
    return levels


def _no_rows(edges: DataFrame, **columns: Column) -> DataFrame:
    return edges.select(*[c.alias(name) for name, c in columns.items()]).limit(0)


# --- searches in strips of roots -----------------------------------------------------


def _summed(rows: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The targets, each once, and the sum of the source rows of each; `dst` ascends."""
    first = np.flatnonzero(np.concatenate(([True], dst[1:] != dst[:-1])))
    targets, place = dst[first], np.zeros(len(dst), np.int64)
    place[first[1:]] = 1
    place = np.cumsum(place)
    total = np.zeros((len(targets), rows.shape[1]))
    step = max(1, GATHERED // rows.shape[1])
    for low in range(0, len(src), step):
        part = place[low : low + step]
        begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        total[part[begin]] += np.add.reduceat(rows[src[low : low + step]], begin, axis=0)
    return targets, total


@dataclass
class _Strip:
    """A breadth-first search from each root of a strip at once: level (-1: not reached) and path count of nodes x roots."""

    ids: np.ndarray
    roots: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    level: np.ndarray
    sigma: np.ndarray
    reached: list[np.ndarray]

    @classmethod
    def search(cls, links: pd.DataFrame, roots: np.ndarray) -> _Strip:
        n_links = len(links)
        ids, codes = np.unique(np.concatenate([links["src"].to_numpy(), links["dst"].to_numpy(), roots]), return_inverse=True)
        src, dst, start = codes[:n_links], codes[n_links : 2 * n_links], codes[2 * n_links :]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        n, width = len(ids), len(roots)
        level, sigma = np.full((n, width), -1, np.int32), np.zeros((n, width))
        level[start, np.arange(width)], sigma[start, np.arange(width)] = 0, 1.0
        missing = np.full(n, width)
        missing[start] -= 1
        reached = [np.sort(start)]
        while len(reached[-1]):
            at, nodes = len(reached) - 1, reached[-1]
            row = np.full(n, -1)
            row[nodes] = np.arange(len(nodes))
            use = (row[src] >= 0) & (missing[dst] > 0)
            if not use.any():
                break
            front = np.where(level[nodes] == at, sigma[nodes], 0.0)
            targets, got = _summed(front, row[src[use]], dst[use])
            new = (got > 0) & (level[targets] < 0)
            any_new = new.any(axis=1)
            targets, got, new = targets[any_new], got[any_new], new[any_new]
            level[targets] = np.where(new, at + 1, level[targets])
            sigma[targets] = np.where(new, got, sigma[targets])
            missing[targets] -= new.sum(axis=1)
            reached.append(targets)
        return cls(ids, start, src, dst, level, sigma, [nodes for nodes in reached if len(nodes)])

    def credits(self) -> tuple[np.ndarray, np.ndarray]:
        """The credit of each node and root, and the flow over each edge, of all roots together, as in `_flows`."""
        credit, flow = (self.level >= 0).astype(np.float64), np.zeros(len(self.src))
        n = len(self.ids)
        for at in range(len(self.reached) - 1, 0, -1):
            nodes, above = self.reached[at], self.reached[at - 1]
            row, place = np.full(n, -1), np.full(n, -1)
            row[nodes], place[above] = np.arange(len(nodes)), np.arange(len(above))
            use = np.flatnonzero((row[self.src] >= 0) & (place[self.dst] >= 0))
            sigma = self.sigma[nodes]
            share = np.where(self.level[nodes] == at, credit[nodes] / np.where(sigma > 0, sigma, 1.0), 0.0)
            parents = np.where(self.level[above] == at - 1, self.sigma[above], 0.0)
            targets, got = _summed(share, row[self.src[use]], self.dst[use])
            credit[targets] += parents[place[targets]] * got
            step = max(1, GATHERED // share.shape[1])
            for low in range(0, len(use), step):
                part = use[low : low + step]
                flow[part] += np.einsum("er,er->e", share[row[self.src[part]]], parents[place[self.dst[part]]])
        return credit, flow

    def listed(self, name: str, values: np.ndarray, **others: np.ndarray) -> pd.DataFrame:
        """A row per root and node it reaches."""
        node, root = np.nonzero(self.level >= 0)
        named = {"root": self.ids[self.roots[root]], "node": self.ids[node]}
        return pd.DataFrame({**named, **{k: v[node, root] for k, v in others.items()}, name: values[node, root]})


def _strip_paths(roots: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    found = _Strip.search(links, roots["node"].to_numpy())
    return found.listed("sigma", found.sigma, level=found.level)


def _strip_credit(roots: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    found = _Strip.search(links, roots["node"].to_numpy())
    return found.listed("credit", found.credits()[0])


def _strip_flow(roots: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    found = _Strip.search(links, roots["node"].to_numpy())
    _, flow = found.credits()
    used = flow > 0
    src, dst, n = found.src[used], found.dst[used], len(found.ids)
    ends, place = np.unique(np.minimum(src, dst) * n + np.maximum(src, dst), return_inverse=True)
    flow = np.bincount(place, flow[used], len(ends))
    return pd.DataFrame({"src": found.ids[ends // n], "dst": found.ids[ends % n], "flow": flow})


def _with_parts(links: Stored, asked: Stored) -> tuple[DataFrame, DataFrame]:
    """The edges and the roots with the column `part`: the whole graph, or components, small ones together."""
    nodes = store(links.df.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    if links.rows <= PART_EDGES and float(nodes.rows) * links.rows <= PART_WORK:
        whole = F.lit(0).cast("long").alias("part")
        return links.df.select("*", whole), asked.df.select("*", whole)
    member = store(components(nodes.df, links.df), "member")
    sizes = member.df.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    buckets = -(-nodes.rows // SMALL_PART)
    small = F.pmod(F.xxhash64("community"), F.lit(buckets))
    part = F.when(F.col("n") <= SMALL_PART, small).otherwise(F.xxhash64("community")).alias("part")
    placed = store(member.df.join(member.fits(sizes), "community").select("node", part), "parts")
    own = placed.sized().withColumnRenamed("node", "src")
    # A root without an edge is a part of the first bucket.
    roots = asked.df.join(placed.sized(), "node", "left").withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
    return cut_lineage(links.df.join(own, "src")), cut_lineage(roots)


def _in_strips(
    edges: DataFrame, roots: DataFrame | None, run: Callable, schema: T.StructType, cells: int
) -> tuple[DataFrame | None, tuple[DataFrame, DataFrame] | None]:
    """What `run` makes of every strip of roots with the edges around it; and the edges and roots of parts that are too large for it.

    Roots are dealt into strips, so that a strip's cells (root, node) are bounded; the edges of its part, which are bounded too, travel to
    each of a part's strips. No path and no flow becomes a row that is shuffled. Null is no node, repeated roots count once.
    """
    links = store(edges.select("src", "dst").dropna(), "edges")
    asked = store((nodes_of(links.df) if roots is None else roots.select("node").dropna().distinct()), "roots")
    if not asked.rows:
        return None, None
    linked, rooted = _with_parts(links, asked)
    per_part = rooted.groupBy("part").agg(F.count(F.lit(1)).alias("roots"))
    ends = linked.select("part", F.explode(F.array("src", "dst")).alias("node")).distinct()
    nodes = ends.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    sums = linked.groupBy("part").agg(F.count(F.lit(1)).alias("e"))
    for more in (nodes, sums):
        per_part = per_part.join(more, "part", "left")
    n, e, asking = F.coalesce("n", F.lit(0)) + F.lit(1), F.coalesce("e", F.lit(0)), F.col("roots").cast("double")
    by_work = F.least(F.lit(MOST_STRIPS), F.ceil(asking * e / F.lit(STRIP_STEPS)))
    strips = F.greatest(F.lit(1), F.ceil(asking * n / F.lit(cells)), by_work).cast("int")
    fits = (e <= F.lit(PART_EDGES)) & (n <= F.lit(cells))
    per_part = store(per_part.select("part", fits.alias("fits"), strips.alias("strips")), "strips")
    all_fit, total = per_part.df.agg(F.min("fits"), F.sum(F.when(F.col("fits"), F.col("strips")))).first()
    searched = per_part.fits(per_part.df.filter("fits").select("part", "strips"))
    left = rooted.join(searched, "part").select("part", F.pmod(F.xxhash64("node"), "strips").cast("int").alias("strip"), "node")
    left = cut_lineage(left)
    # Edges travel to the strips that have roots only.
    used = left.select("part", F.col("strip").alias("own")).distinct()
    right = linked.join(used, "part").select("part", F.col("own").alias("strip"), "src", "dst")
    tasks = int(min(20_000, 2 * (total or 1)))
    by = ["part", "strip"]
    found = None
    if total:
        found = left.repartition(tasks, *by).groupBy(*by).cogroup(right.repartition(tasks, *by).groupBy(*by)).applyInPandas(run, schema)
    if all_fit:
        return found, None
    large = per_part.fits(per_part.df.filter("not fits").select("part"))
    return found, (cut_lineage(linked.join(large, "part").select("src", "dst")), cut_lineage(rooted.join(large, "part").select("node")))


def _listing(edges: DataFrame, *others: T.StructField) -> T.StructType:
    kind = edges.schema["src"].dataType
    return T.StructType([T.StructField("root", kind), T.StructField("node", kind), *others])


def _united(found: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if found is None else found.unionByName(more)


def shortest_path_counts(
    edges: DataFrame, roots: DataFrame | None = None, hub: int = HUB_EDGES
) -> DataFrame:
    """(root, node, level, sigma): distance and number of shortest paths from each root.

    `roots` (a `node` column) limits the search to some roots; path counts are
    doubles, exact up to 2^53.
    """
    schema = _listing(edges, T.StructField("level", T.IntegerType()), T.StructField("sigma", T.DoubleType()))
    found, large = _in_strips(edges, roots, _strip_paths, schema, LISTED_CELLS)
    if large is None:
        src = F.col("src")
        return _no_rows(edges, root=src, node=src, level=F.lit(0), sigma=F.lit(1.0)) if found is None else found
    levels = _search_levels(_steps(large[0], hub), large[1])
    rows = [level.df.select("root", "node", F.lit(i).alias("level"), "sigma") for i, level in enumerate(levels)]
    return _united(found, reduce(DataFrame.unionByName, rows))


def _flows(steps: _Steps, levels: list[Stored]) -> tuple[list[DataFrame], list[DataFrame]]:
    """Credits per level and flows over shortest-path edges, from the deepest level up.

    A node's credit is one plus what its children pass up; a child divides its
    credit among its parents in proportion to their path counts.
    """
    if not levels:
        return [], []
    credit = Stored(levels[-1].df.withColumn("credit", F.lit(1.0)), levels[-1].rows, levels[-1].size)
    credits, flows = [credit.df], []
    for above in reversed(levels[:-1]):
        share = (F.col("credit") / F.col("sigma")).alias("share")
        up = steps.expand(credit, [F.col("root"), F.col("node").alias("child"), share]).select(
            "root", "child", F.col("neighbour").alias("node"), "share"
        )
        flow = cut_lineage(
            up.join(above.fits(above.df.select("root", "node", "sigma")), ["root", "node"]).select(
                "root", F.col("node").alias("parent"), "child", (F.col("share") * F.col("sigma")).alias("flow")
            )
        )
        passed = flow.groupBy("root", F.col("parent").alias("node")).agg(F.sum("flow").alias("passed"))
        # Made from stored rows in one step, so it needs no cut of its own.
        credit = Stored(
            above.df.join(above.fits(passed), ["root", "node"], "left").select(
                "root", "node", "sigma", "parts", (1.0 + F.coalesce("passed", F.lit(0.0))).alias("credit")
            ),
            above.rows,
            above.size,
        )
        credits.append(credit.df)
        flows.append(flow)
    return credits, flows


def node_credit(
    edges: DataFrame, roots: DataFrame | None = None, hub: int = HUB_EDGES
) -> DataFrame:
    """(root, node, credit) of every node in the search from every root."""
    found, large = _in_strips(edges, roots, _strip_credit, _listing(edges, T.StructField("credit", T.DoubleType())), LISTED_CELLS)
    if large is None:
        src = F.col("src")
        return _no_rows(edges, root=src, node=src, credit=F.lit(1.0)) if found is None else found
    steps = _steps(large[0], hub)
    credits, _ = _flows(steps, _search_levels(steps, large[1]))
    return _united(found, reduce(DataFrame.unionByName, [c.select("root", "node", "credit") for c in credits]))


def root_batches(nodes: int, state_rows: int = STATE_ROWS) -> int:
    """In how many batches the roots are searched so that one batch holds `state_rows` rows (root, node) at most, or a root alone."""
    return max(1, -(-nodes // max(1, state_rows // max(1, nodes))))


def edge_betweenness(
    edges: DataFrame,
    batches: int | None = None,
    hub: int = HUB_EDGES,
    state_rows: int | None = None,
    folder: str | None = None,
) -> DataFrame:
    """(src, dst, betweenness) with src < dst: the shortest paths over each edge.

    Each unordered pair of nodes counts once, shared among its shortest paths.
    Roots are searched in strips (`_in_strips`); in parts that are too large for that, and where `batches`, `state_rows` or a `folder` is given, by
    joins. The state of these is up to nodes x roots rows. So the roots, in the order of their codes, are searched in `batches` of equal size, as
    many as keep a batch within `state_rows`. What a batch has stored goes when its sums per edge are written. With a `folder`
    these sums stay there, and a run that broke off goes on after the last batch it has written; the folder belongs to one graph and one
    number of batches.
    """
    if batches is None and state_rows is None and folder is None:
        return _betweenness_in_strips(edges, hub)
    spark = edges.sparkSession
    steps = _steps(edges, hub)
    stored = store(nodes_of(edges), "roots")
    batches = batches or root_batches(stored.rows, state_rows or STATE_ROWS)
    roots = stored.df if batches == 1 else cut_lineage(dense_codes(stored.df, [F.asc("node")]))
    ends = [F.least("parent", "child").alias("src"), F.greatest("parent", "child").alias("dst")]
    kind = edges.schema["src"].dataType.simpleString()
    partial = []
    for batch in range(batches):
        path = f"{folder}/batch-{batch}-of-{batches}" if folder else fresh_path(spark, "batch")
        if not (folder and written(spark, path)):
            mine = roots if batches == 1 else roots.filter(F.col("code") % batches == batch).select("node")
            with Scope(spark) as state:
                _, flows = _flows(steps, _search_levels(steps, mine))
                if flows:
                    rows = reduce(DataFrame.unionByName, [f.select(*ends, "flow") for f in flows])
                    summed = rows.groupBy("src", "dst").agg(F.sum("flow").alias("flow"))
                    if batches == 1 and not folder:
                        return summed.select("src", "dst", (F.col("flow") / 2).alias("betweenness"))
                    summed.write.mode("overwrite").parquet(path)
            state.release()
            if not flows:
                continue
        partial.append(spark.read.schema(f"src {kind}, dst {kind}, flow double").parquet(path))
    if not partial:
        return _no_rows(edges, src=F.col("src"), dst=F.col("dst"), betweenness=F.lit(0.0))
    total = reduce(DataFrame.unionByName, partial).groupBy("src", "dst").agg(F.sum("flow").alias("flow"))
    return total.select("src", "dst", (F.col("flow") / 2).alias("betweenness"))


def _betweenness_in_strips(edges: DataFrame, hub: int) -> DataFrame:
    kind = edges.schema["src"].dataType
    schema = T.StructType([T.StructField("src", kind), T.StructField("dst", kind), T.StructField("flow", T.DoubleType())])
    found, large = _in_strips(edges, None, _strip_flow, schema, STRIP_CELLS)
    if found is not None:
        halves = found.groupBy("src", "dst").agg((F.sum("flow") / 2).alias("betweenness"))
        found = cut_lineage(halves)
    if large is None:
        return _no_rows(edges, src=F.col("src"), dst=F.col("dst"), betweenness=F.lit(0.0)) if found is None else found
    # By joins, a flow is a row: so many roots at a time that neither they nor the state are too many.
    roots, rows = large[1].count(), large[0].count()
    batches = max(root_batches(roots, STATE_ROWS), min(roots, -(-roots * rows // FLOW_ROWS)))
    return _united(found, edge_betweenness(large[0], batches, hub))


# --- components and modularity ---------------------------------------------------------


def _stars_of(node: np.ndarray, to: np.ndarray) -> pd.DataFrame:
    """Each node of the links but the smallest of its component, with that one."""
    names, at = np.unique(np.concatenate([node, to]), return_inverse=True)
    one, two = at[: len(node)], at[len(node) :]
    least = np.arange(len(names))
    while True:
        a, b = least[one], least[two]
        if np.array_equal(a, b):
            break
        # The larger of two ends' smallest nodes is handed the smaller one; then each node follows its own to the end.
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(further := least[least], least):
            least = further
    moved = np.flatnonzero(least != np.arange(len(names)))
    return pd.DataFrame({"node": names[moved], "to": names[least[moved]]})


def _forest(most: int) -> Callable:
    """A task's links as stars, which link the same nodes: they are no more than the nodes. At most `most` links are held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < most:
                continue
            stars = _stars_of(*(np.concatenate([x[c].to_numpy() for x in held]) for c in ("node", "to")))
            held, rows = [stars], len(stars)
            if rows > most // 2:
                yield stars
                held, rows = [], 0
        if rows:
            yield _stars_of(*(np.concatenate([x[c].to_numpy() for x in held]) for c in ("node", "to")))

    return run


def _fewer(links: DataFrame, most: int) -> DataFrame:
    """Distinct links (node, to) that link the same nodes; few ones end as stars, as Spark gives them to one task."""
    links = links.distinct()
    if not all(isinstance(f.dataType, T.IntegralType) for f in links.schema):
        return links
    return links.mapInPandas(_forest(most), links.schema)


def star_links(edges: DataFrame, most: int = FOREST_LINKS) -> Stored:
    """(node, to): each node but the smallest of its component, with that one.

    Alternates two star operations until all edges point straight at a
    smallest node: every node hands its larger neighbours to its smallest one,
    then its smaller neighbours and itself. The number of rounds grows with the logarithm of the
    longest path, and each round is two grouped minima and two joins. Before and after each round a task makes stars of the links it has.
    """
    links = store(
        _fewer(
            edges.filter(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("node"), F.least("src", "dst").alias("to")), most
        )
    )
    while not _all_stars(links):
        around = links.df.unionByName(links.df.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = around.groupBy("node").agg(F.min("to").alias("least"))
        least = least.select("node", F.least("node", "least").alias("least"))
        large = store(
            around.join(links.fits(least), "node")
            .filter(F.col("to") > F.col("node"))
            .select(F.col("to").alias("node"), F.col("least").alias("to"))
            .distinct()
        )
        least = large.df.groupBy("node").agg(F.min("to").alias("least"))
        moved = large.df.join(large.fits(least), "node").filter(F.col("to") != F.col("least"))
        links = store(
            _fewer(moved.select(F.col("to").alias("node"), F.col("least").alias("to")).unionByName(least.withColumnRenamed("least", "to")), most)
        )
    return links


def components(nodes: DataFrame, edges: DataFrame, most: int = FOREST_LINKS) -> DataFrame:
    """(node, community): each node with the smallest node it is connected to; see `star_links`."""
    links = star_links(edges, most)
    named = links.fits(links.df.withColumnRenamed("to", "community"))
    return nodes.select("node").join(named, "node", "left").select(
        "node", F.coalesce("community", "node").alias("community")
    )


def _all_stars(links: Stored) -> bool:
    """Whether each linked node has one target, which is linked to nothing itself."""
    ends = links.df.select("node", F.lit(1).alias("links"), F.lit(0).alias("targets")).unionByName(
        links.df.select(F.col("to").alias("node"), F.lit(0).alias("links"), F.lit(1).alias("targets"))
    )
    per_node = ends.groupBy("node").agg(F.sum("links").alias("links"), F.max("targets").alias("targets"))
    return per_node.filter((F.col("links") > 1) | ((F.col("links") > 0) & (F.col("targets") > 0))).isEmpty()


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row `modularity`: how much denser the communities are than chance, in the given graph.

    With m edges, e_c directed edge rows inside a community and d_c the sum of its
    degrees: the sum of e_c/2m - (d_c/2m)^2. NULL for a graph without edges.
    """
    of_src = membership.select(F.col("node").alias("src"), F.col("community").alias("c_src"))
    of_dst = membership.select(F.col("node").alias("dst"), F.col("community").alias("c_dst"))
    per_community = (
        edges.join(of_src, "src")
        .join(of_dst, "dst")
        .groupBy("c_src")
        .agg(
            F.count(F.lit(1)).cast("double").alias("d"),
            F.count_if(F.col("c_src") == F.col("c_dst")).cast("double").alias("e"),
        )
    )
    totals = per_community.agg(
        F.sum("d").alias("m2"), F.sum("e").alias("inside"), F.sum(F.col("d") * F.col("d")).alias("d2")
    )
    return totals.select(
        (
            F.try_divide(F.col("inside"), F.col("m2"))
            - F.try_divide(F.col("d2"), F.col("m2") * F.col("m2"))
        ).alias("modularity")
    )


# --- splitting -------------------------------------------------------------------------


def _tied(column: str = "betweenness") -> Column:
    return F.round(column, TIE_DECIMALS)


def top_edges(betweenness: DataFrame) -> DataFrame:
    """All edges tied at the highest betweenness."""
    top = betweenness.agg(F.max(_tied()).alias("top")).first()["top"]
    if top is None:
        return betweenness.limit(0)
    return betweenness.filter(_tied() == F.lit(top))


def drop_edges(edges: DataFrame, dropped: DataFrame) -> DataFrame:
    """`edges` without the edges in `dropped`, in both directions."""
    return edges.join(both_directions(dropped, "src", "dst"), ["src", "dst"], "left_anti")


def drop_top_edges(edges: DataFrame, betweenness: DataFrame) -> DataFrame:
    return drop_edges(edges, top_edges(betweenness))


def first_split(edges: DataFrame, batches: int | None = None, hub: int = HUB_EDGES) -> DataFrame:
    """(node, community): the components once the edges with the highest betweenness are dropped, one round of the splitting."""
    edges = cut_lineage(edges.select("src", "dst"))
    return components(nodes_of(edges), cut_lineage(drop_top_edges(edges, store(edge_betweenness(edges, batches, hub)).df)))


def girvan_newman(edges: DataFrame, batches: int | None = None, hub: int = HUB_EDGES) -> DataFrame:
    """(node, community): the split with the highest modularity, the first one if several tie.

    Starting from the connected components, the edges with the highest
    betweenness are dropped until only cliques are left. Betweenness and
    components are computed anew only where edges were dropped. Only the highest value
    and the modularity come back to the driver.
    """
    edges = cut_lineage(edges.select("src", "dst"))
    member = store(components(nodes_of(edges), edges))
    best, best_value = member.df, modularity(edges, member.sized()).first()["modularity"]
    left = edges
    between = store(edge_betweenness(edges, batches, hub))
    while True:
        top = between.df.agg(F.max(_tied()).alias("top")).first()["top"]
        if top is None or top <= 1.0:
            return best
        # The dropped edges and the nodes of the components they tear are no
        # more than the edges and nodes there are.
        dropped = between.df.filter(_tied() == F.lit(top)).select("src", "dst")
        left = cut_lineage(drop_edges(left, between.fits(dropped)))
        torn = (
            member.df.join(between.fits(dropped.select(F.col("src").alias("node"))), "node", "left_semi")
            .select("community")
            .distinct()
        )
        torn_nodes = store(member.df.join(member.fits(torn), "community", "left_semi").select("node"))
        at_src = torn_nodes.fits(torn_nodes.df.withColumnRenamed("node", "src"))
        torn_edges = cut_lineage(left.join(at_src, "src", "left_semi"))
        between = store(
            between.df.join(at_src, "src", "left_anti").unionByName(
                edge_betweenness(torn_edges, batches, hub)
            )
        )
        member = store(
            member.df.join(torn_nodes.sized(), "node", "left_anti").unionByName(
                components(torn_nodes.df, torn_edges)
            )
        )
        value = modularity(edges, member.sized()).first()["modularity"]
        # Splits that differ only by the order of their sums tie.
        if round(value, TIE_DECIMALS) > round(best_value, TIE_DECIMALS):
            best, best_value = member.df, value
