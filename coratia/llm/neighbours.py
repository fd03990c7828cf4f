"""Approximate nearest neighbours by cosine, with a pruned directed graph per shard.

Distinct vectors are dealt into shards of bounded size. Each shard builds its own graph:

* vertices are inserted in batches of random order; a greedy (beam) search from the entry point over the graph so
  far proposes neighbours for each, and robust pruning keeps the nearest candidate, drops every
  candidate that is much nearer to a kept one than to the vertex (by the factor `alpha`), and goes on until the
  vertex has its degree: short edges survive, and so do a few long ones in other directions;
* each kept edge is offered back to its target, which is pruned again when it has too many.

Every query visits every shard by beam search, and the best of all shards are merged. An exact check follows in the shard: no vertex
left unmet by the search may be nearer than the last one found, and any that is takes its place. So crowds larger than
the beam (near copies, multiples of one vector) and rows that the graph does not lead to are answered in full.
Shards are found by a hash, so their number grows with the rows and no task holds more than a few shards. Queries are
taken in blocks, so a task meets a bounded number of them at a time.

Equal vectors are one vertex: it carries the smallest ids of the vectors it
stands for, as many as an answer may need, so copies cost nothing and ties go to smaller ids.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, as
query or candidate, nor do rows without an id; of rows with the same id and the same vector one counts.
Only vectors of equal length are compared. A query with fewer candidates than asked for gets them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coratia.plans.lineage import store

NEAREST = 5
SHARD = 4_000  # vectors
DEGREE = 32
BEAM = 64
ALPHA = 1.2
PASSES = 2
BLOCK = 512  # queries or insertions searched together
QUERY_BLOCK = 20_000  # queries that meet a shard in one task
SEED = 11
ROUNDING = 1e-9  # more than two ways to compute a cosine can differ by


class Graph:
    """A graph over the rows of `unit`, vectors of length 1; distance is 1 - cosine."""

    def __init__(self, unit: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA):
        # Doubles: in single precision a crowd of near copies is all at distance 0.
        self.unit = np.ascontiguousarray(unit, np.float64)
        self.n, self.degree, self.beam, self.alpha = len(unit), degree, beam, alpha
        self.edges = np.full((self.n, degree), -1, np.int32)
        centre = self.unit.mean(axis=0)
        self.entry = int(np.argmax(self.unit @ centre)) if self.n else 0

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the `beam` best vertices met by each query, nearest first; id -1 where there are fewer.

        All queries walk at once: in each step every query expands the nearest vertex of its beam that it
        has not expanded yet, until none is left.
        """
        m = len(queries)
        ids = np.full((m, beam), -1, np.int64)
        far = np.full((m, beam), np.inf)
        open_ = np.zeros((m, beam), bool)
        # The last column stands for edges that are not there.
        met = np.zeros((m, self.n + 1), bool)
        met[:, self.n] = True
        ids[:, 0], far[:, 0], open_[:, 0] = self.entry, 1 - queries @ self.unit[self.entry], True
        met[:, self.entry] = True
        rows = np.arange(m)
        while len(rows):
            first = np.argmax(open_[rows], axis=1)
            going = open_[rows, first]
            rows, first = rows[going], first[going]
            if not len(rows):
                break
            open_[rows, first] = False
            around = self.edges[ids[rows, first]].astype(np.int64)
            target = np.where(around >= 0, around, self.n)
            fresh = ~met[rows[:, None], target]
            met[rows[:, None], target] = True
            distance = np.where(
                fresh, 1 - np.einsum("rd,rkd->rk", queries[rows], self.unit[np.maximum(around, 0)]), np.inf
            )
            all_far = np.concatenate([far[rows], distance], axis=1)
            all_ids = np.concatenate([ids[rows], np.where(fresh, around, -1)], axis=1)
            all_open = np.concatenate([open_[rows], fresh], axis=1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            far[rows] = np.take_along_axis(all_far, order, axis=1)
            ids[rows] = np.take_along_axis(all_ids, order, axis=1)
            open_[rows] = np.take_along_axis(all_open, order, axis=1) & (far[rows] < np.inf)
        return ids, far

    def _pruned(self, vertex: int, candidates: np.ndarray) -> np.ndarray:
        """Robust pruning: at most `degree` of the candidates, near and in different directions."""
        candidates = np.unique(candidates[(candidates >= 0) & (candidates != vertex)])
        points = self.unit[candidates]
        own = 1 - points @ self.unit[vertex]
        order = np.argsort(own, kind="stable")
        candidates, points, own = candidates[order], points[order], own[order]
        between = 1 - points @ points.T
        alive, kept = np.ones(len(candidates), bool), []
        while len(kept) < self.degree:
            if not alive.any():
                break
            k = int(np.argmax(alive))
            kept.append(k)
            alive &= self.alpha * between[k] > own
            alive[k] = False
        return candidates[kept]

    def build(self, passes: int = PASSES, seed: int = SEED) -> Graph:
        rng = np.random.default_rng(seed)
        # Random edges to begin with, so that every vertex can be reached.
        if self.n > 1:
            some = min(self.degree, 8, self.n - 1)
            random = np.sort((np.arange(self.n)[:, None] + rng.integers(1, self.n, (self.n, some))) % self.n, axis=1)
            random[:, 1:][random[:, 1:] == random[:, :-1]] = -1
            self.edges[:, :some] = random
        for _ in range(passes):
            order = rng.permutation(self.n)
            for at in range(0, self.n, BLOCK):
                batch = order[at : at + BLOCK]
                found, _ = self.search(self.unit[batch], self.beam)
                offered: dict[int, list[int]] = {}
                for vertex, near in zip(batch.tolist(), found):
                    kept = self._pruned(vertex, np.concatenate([near, self.edges[vertex]]))
                    self.edges[vertex] = -1
                    self.edges[vertex, : len(kept)] = kept
                    for target in kept.tolist():
                        offered.setdefault(target, []).append(vertex)
                for target, sources in offered.items():
                    have = self.edges[target][self.edges[target] >= 0]
                    joined = np.union1d(have, sources)
                    kept = joined if len(joined) <= self.degree else self._pruned(target, joined)
                    self.edges[target] = -1
                    self.edges[target, : len(kept)] = kept
        return self


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component, and not all zero."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _ranked(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows per key; Spark cuts each task's part before the shuffle, so a hot key is cheap."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(
        F.col("__rank") <= most
    )


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """In double precision, summed the same way for every row, so equal vectors have equal scores."""
    dots = (vectors * query).sum(axis=1)
    return dots / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def _verified(query: np.ndarray, near: np.ndarray, close: np.ndarray, exact: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, scores) of the `nearest` best vertices and those equal to the last of them.

    `near` are the vertices found by the graph, `close` the cosines with all vertices up to rounding. A vertex that the graph has missed is scored
    like the others if it reaches the last score found.
    """
    scores = cosines(query, exact[near])
    if len(near) >= nearest:
        bound = np.partition(scores, len(scores) - nearest)[len(scores) - nearest]
        missed = np.flatnonzero(close >= bound - ROUNDING)
    else:
        missed = np.arange(len(exact))
    missed = np.setdiff1d(missed, near, assume_unique=True)
    if len(missed):
        near, scores = np.concatenate([near, missed]), np.concatenate([scores, cosines(query, exact[missed])])
    if len(near) > nearest:
        best = scores >= np.partition(scores, len(scores) - nearest)[len(scores) - nearest]
        near, scores = near[best], scores[best]
    return near, scores


def _search_shard(wanted: int, beam: int):
    def run(_key, vertices: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(vertices) or not len(queries):
            return pd.DataFrame(columns=columns)
        vertices = vertices.sort_values("least", kind="stable")
        exact = np.stack(vertices["vector"].to_list()).astype(np.float64)
        unit = exact / np.sqrt((exact * exact).sum(axis=1))[:, None]
        members = vertices["members"].to_list()
        graph = Graph(unit).build()
        ask_ids = queries["query_id"].to_numpy()
        ask = np.stack(queries["vector"].to_list()).astype(np.float64)
        out: list[tuple[int, int, float]] = []
        for at in range(0, len(ask), BLOCK):
            part = ask[at : at + BLOCK]
            directions = part / np.sqrt((part * part).sum(axis=1))[:, None]
            found, _ = graph.search(directions, max(beam, wanted + 1))
            close = directions @ unit.T
            for query_id, query, near, all_close in zip(ask_ids[at : at + BLOCK].tolist(), part, found, close):
                # One more than asked for: the query's own vector may be among them.
                near, scores = _verified(query, near[near >= 0], all_close, exact, wanted + 1)
                answers = [
                    (-score, vec_id)
                    for score, v in zip(scores.tolist(), near.tolist())
                    for vec_id in members[v].tolist()
                    if vec_id != query_id
                ]
                out.extend((query_id, vec_id, -minus) for minus, vec_id in sorted(answers)[:wanted])
        return pd.DataFrame(out, columns=columns)

    return run


def search(
    table: DataFrame,
    is_query: Column,
    id_column: str = "vec_id",
    vector: str = "embedding",
    nearest: int = NEAREST,
    shard: int = SHARD,
    beam: int = BEAM,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest vectors found for the rows of `table` that satisfy `is_query`."""
    rows = table.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
    ).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    # The smallest ids of each distinct vector: one more than are asked for, since one may be the query's own.
    # The hash splits the work, the vector itself decides what is equal.
    keyed = rows.select("id", "vector", F.xxhash64("vector").alias("hash"))
    single = _ranked(keyed.dropDuplicates(["id", "hash", "vector"]), ["hash", "vector"], [F.col("id")], nearest + 1)
    distinct = single.groupBy("hash", "vector").agg(
        F.array_sort(F.collect_list("id")).alias("members"), F.min("id").alias("least")
    )
    kept = store(distinct.withColumn("size", F.size("vector")), "vertices")
    shards = max(1, -(-kept.rows // shard))
    vertices = kept.df.withColumn("shard", F.pmod("hash", F.lit(shards)).cast("int")).select(
        "shard", "size", "least", "members", "vector"
    )
    # Every query visits every shard; blocks of queries keep what one task meets bounded.
    asked = store(rows.filter("asked").select(F.col("id").alias("query_id"), "vector").distinct(), "queries")
    blocks = max(1, -(-asked.rows // QUERY_BLOCK))
    visits = asked.df.select(
        "query_id",
        "vector",
        F.size("vector").alias("size"),
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    placed = vertices.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = (
        placed.groupBy("size", "shard", "block")
        .cogroup(visits.groupBy("size", "shard", "block"))
        .applyInPandas(_search_shard(nearest, beam), "query_id long, vec_id long, score double")
    )
    best = _ranked(found, ["query_id"], [F.desc("score"), F.asc("vec_id")], nearest)
    return best.select("query_id", F.col("__rank").cast("int").alias("rank"), "vec_id", "score")


def every(step: int, id_column: str = "vec_id") -> Column:
    """Queries whose id is divisible by `step`."""
    return F.col(id_column) % step == 0
