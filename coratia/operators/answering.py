"""Sums over the rated, correlated neighbours of requests, without a row for any co-rating, pair or neighbour.

Members (askers and neighbours) are dealt into pieces, and a piece's ratings are packed into arrays. A task holds some pieces
of askers with their requests and some pieces of neighbours. Only the neighbours that rated a requested context can
count, so these get a place each, and the co-ratings of an asker are added up in these places alone. What leaves a task are three sums per request.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coratia.operators.ids import dense_codes
from coratia.plans.lineage import Scope, fresh_path, freed_shuffles, store

# Ratings of a piece, at most (a member's ratings stay together), and pieces of a small table.
PIECE_CELLS = 2_000_000
FEWEST_PIECES = 24
# Bytes of packed pieces that a task gets of askers, which it opens together, and of neighbours, which it opens one by one.
BLOCK_BYTES = (12 << 20, 256 << 20)
# Spark's setting of how many rows are sent to Python at a time.
_ROWS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Co-ratings that a task is meant to add up.
TASK_MATCHES = 200_000_000
# Places (asker, neighbour) at a time, co-ratings at a time, and neighbours of requests at a time, where a single asker has no more.
PLACES = 1 << 21
ADDED = 1 << 19
CANDIDATES = 1 << 17


def _packed(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string of bytes."""
    table = pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.large_binary()) for a in arrays.values()], names=list(arrays))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(table)
    return out.getvalue().to_pybytes()


def _unpacked(blob: bytes, **kinds: str) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(blob).read_next_batch()
    return {name: np.frombuffer(batch.column(name)[0].as_buffer(), kind) for name, kind in kinds.items()}


_NEIGHBOURS = {"member": "<i4", "s": "<f8", "ratings": "<f8", "at": "<i4", "group": "<i4", "n": "<i4", "r": "<f8"}
_ASKERS = {"member": "<i4", "n": "<i4", "gap": "<i4", "r": "<f8", "n_requests": "<i4", "wanted": "<i4", "own": "<f8", "rated": "<i1"}


def _pack_neighbours(key: tuple, rows: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
    """A piece's ratings by group: of each group the members' places in the piece, ascending, and their ratings; and the members' totals."""
    if not len(rows):
        return pd.DataFrame({"piece": np.zeros(0, np.int32), "blob": np.zeros(0, object)})
    totals = totals.sort_values("member")
    members = totals["member"].to_numpy()
    at, g = np.searchsorted(members, rows["member"].to_numpy()), rows["g"].to_numpy()
    order = np.lexsort((at, g))
    groups, n = np.unique(g, return_counts=True)
    blob = _packed(
        member=members.astype("<i4"),
        s=totals["s"].to_numpy("<f8", na_value=np.nan),
        ratings=totals["ratings"].to_numpy("<f8", na_value=np.nan),
        at=at[order].astype("<i4"),
        group=groups.astype("<i4"),
        n=n.astype("<i4"),
        r=rows["r"].to_numpy("<f8", na_value=np.nan)[order],
    )
    return pd.DataFrame({"piece": np.array([key[0]], np.int32), "blob": [blob]})


def _pack_askers(key: tuple, rated: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """A piece of askers: their ratings by asker and group (as gaps), their requested groups, and their own ratings in these."""
    if not len(asked):
        return pd.DataFrame({"piece": np.zeros(0, np.int32), "blob": np.zeros(0, object)})
    members = np.unique(asked["member"].to_numpy())
    at, g = np.searchsorted(members, rated["member"].to_numpy()), rated["g"].to_numpy().astype(np.int64)
    order = np.lexsort((g, at))
    at, g, r = at[order], g[order], rated["r"].to_numpy("<f8", na_value=np.nan)[order]
    n = np.bincount(at, minlength=len(members))
    gap = np.diff(g, prepend=0)
    begin = (np.cumsum(n) - n)[n > 0]
    gap[begin] = g[begin]
    of, wanted = np.searchsorted(members, asked["member"].to_numpy()), asked["g"].to_numpy().astype(np.int64)
    order = np.lexsort((wanted, of))
    of, wanted = of[order], wanted[order]
    base = int(max(g.max(initial=0), wanted.max(initial=0))) + 1
    cells, requests = at * base + g, of * base + wanted
    place = np.minimum(np.searchsorted(cells, requests), max(0, len(cells) - 1))
    known = cells[place] == requests if len(cells) else np.zeros(len(requests), bool)
    own = np.where(known, r[place], np.nan) if len(cells) else np.full(len(requests), np.nan)
    blob = _packed(
        member=members.astype("<i4"),
        n=n.astype("<i4"),
        gap=gap.astype("<i4"),
        r=r,
        n_requests=np.bincount(of, minlength=len(members)).astype("<i4"),
        wanted=wanted.astype("<i4"),
        own=own.astype("<f8"),
        rated=known.astype("<i1"),
    )
    return pd.DataFrame({"piece": np.array([key[0]], np.int32), "blob": [blob]})


class _Neighbours:
    """A piece of neighbours, opened: where each group's ratings begin and how many there are."""

    def __init__(self, blob: bytes, groups: int):
        x = _unpacked(blob, **_NEIGHBOURS)
        self.member, self.at, self.r = x["member"], x["at"], x["r"]
        self.s, self.ratings = x["s"], x["ratings"]
        self.term = _terms(self.r)
        self.begin, self.n = np.zeros((2, groups), np.int32)
        self.begin[x["group"]] = np.cumsum(x["n"]) - x["n"]
        self.n[x["group"]] = x["n"]


    def values(self, at: np.ndarray, deviations: bool) -> np.ndarray:
        """The ratings at these places, or how far they are from the mean of the member's others; NaN where there is none."""
        r = self.r[at]
        if not deviations:
            return r
        s, others = self.s[self.at[at]], self.ratings[self.at[at]] - 1
        return r - (s - r) / np.where(others == 0, np.nan, others)


def _terms(r: np.ndarray) -> np.ndarray:
    """Null counts, but adds nothing to a sum."""
    return np.nan_to_num(r) if np.isnan(r).any() else r


def _spans(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... begin[0] + n[0] - 1, begin[1], ..."""
    upto = np.cumsum(n)
    return np.arange(upto[-1] if len(n) else 0, dtype=np.int32) + np.repeat((begin - upto + n).astype(np.int32), n)


def _runs(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges low .. high - 1 whose n add up to `most` at most, or that hold one."""
    upto, low = np.cumsum(n), 0
    while low < len(n):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + most, "right")))
        yield low, high
        low = high


def _add_answers(
    askers: dict[str, np.ndarray], near: _Neighbours, sums: list[np.ndarray], deviations: bool, exclude_self: bool, min_shared: int, slot: np.ndarray
) -> None:
    """Add to the sums (weighted, weights, neighbours, values) of each request what the neighbours of one piece contribute."""
    per_asker = len(near.member)
    begin_r = np.concatenate(([0], np.cumsum(askers["n_requests"])))
    begin_c = np.concatenate(([0], np.cumsum(askers["n"])))
    found = near.n[askers["wanted"]]
    # Askers none of whose requests this piece rated have nothing to add.
    rated_by = np.concatenate(([0], np.cumsum(found)))
    per = rated_by[begin_r[1:]] - rated_by[begin_r[:-1]]
    active = np.flatnonzero(per)
    if not len(active):
        return
    group = askers["group"]
    meets, term = near.n[group], _terms(askers["r"])
    cost = np.maximum(per[active], max(1, per_asker * CANDIDATES // PLACES))
    for low, high in _runs(cost, CANDIDATES):
        some = active[low:high]
        # The neighbours that rated a requested context, and their places.
        request = _spans(begin_r[some], askers["n_requests"][some])
        asker = np.repeat(np.arange(len(some)), askers["n_requests"][some])
        n = found[request]
        at = _spans(near.begin[askers["wanted"][request]], n)
        request, asker = np.repeat(request, n), np.repeat(asker, n)
        own_self = near.member[near.at[at]] == askers["member"][some][asker]
        if exclude_self:
            keep = ~own_self
            at, request, asker, own_self = at[keep], request[keep], asker[keep], own_self[keep]
        place = asker * per_asker + near.at[at]
        if len(slot) < len(some) * per_asker:
            slot.resize(len(some) * per_asker, refcheck=False)
        slot[place] = np.arange(1, len(place) + 1, dtype=np.int32)
        total = [np.zeros(len(place) + 1) for _ in range(6)]
        cells = _spans(begin_c[some], askers["n"][some])
        of = np.repeat(np.arange(len(some), dtype=np.int32) * per_asker, askers["n"][some])
        some_meet = meets[cells] > 0
        cells, of = cells[some_meet], of[some_meet]
        for first, last in _runs(meets[cells], ADDED):
            mine = cells[first:last]
            n = meets[mine]
            other = _spans(near.begin[group[mine]], n)
            to = slot[np.repeat(of[first:last], n) + near.at[other]]
            hit = np.flatnonzero(to)
            to, y = to[hit], near.term[other[hit]]
            x = np.repeat(term[mine], n)[hit]
            for sums_of, weights in zip(total, (None, x, y, x * x, y * y, x * y)):
                sums_of += np.bincount(to, weights, len(place) + 1)
        mine = slot[place]
        slot[place] = 0
        n, sx, sy, sxx, syy, sxy = (t[mine] for t in total)
        enough = n >= min_shared
        if exclude_self:
            # A rated request leaves its own context out of the correlation.
            left = askers["rated"][request] > 0
            x, y = askers["own"][request], near.r[at]
            n = n - left
            sx, sy = np.where(left, sx - x, sx), np.where(left, sy - y, sy)
            sxx, syy, sxy = np.where(left, sxx - x * x, sxx), np.where(left, syy - y * y, syy), np.where(left, sxy - x * y, sxy)
        above = n * sxy - sx * sy
        keep = np.flatnonzero(enough & (above > 0))
        below = np.sqrt((n * sxx - sx * sx)[keep]) * np.sqrt((n * syy - sy * sy)[keep])
        w = np.where(own_self[keep], 1.0, above[keep] / below)
        to, value = request[keep], near.values(at[keep], deviations)
        known = ~np.isnan(value)
        lowest = int(to.min()) if len(to) else 0
        width = int(to.max()) + 1 - lowest if len(to) else 0
        to = to - lowest
        for sums_of, weights in zip(sums, (w * np.nan_to_num(value), np.abs(w), None, known.astype(float))):
            sums_of[lowest : lowest + width] += np.bincount(to, weights, width)


def _opened(blob: bytes) -> dict:
    """A piece of askers with their groups, which are packed as gaps, and sums of their requests."""
    x: dict = _unpacked(blob, **_ASKERS)
    gap, n = x.pop("gap").astype(np.int64), x["n"][x["n"] > 0]
    # Each asker begins anew.
    upto, starts = np.cumsum(gap), np.cumsum(n) - n
    x["group"] = (upto - np.repeat(upto[starts] - gap[starts], n)).astype(np.int32)
    x["sums"] = [np.zeros(len(x["wanted"])) for _ in range(4)]
    return x


def _summed(x: dict) -> pd.DataFrame:
    weighted, weights, n, values = x["sums"]
    some = np.flatnonzero(n)
    return pd.DataFrame(
        {
            "e": np.repeat(x["member"], x["n_requests"])[some],
            "g": x["wanted"][some],
            # Null is the sum of nulls alone.
            "weighted": np.where(values[some] > 0, weighted[some], np.nan),
            "weights": weights[some],
            "n": n[some].astype(np.int64),
        }
    )


def _answers(groups: int, deviations: bool, exclude_self: bool, min_shared: int) -> Callable:
    """The sums of each pair of blocks: its pieces of askers come first and are held, then its pieces of neighbours one after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot = np.zeros(PLACES, np.int32)
        pair, askers = None, []
        for batch in batches:
            for i, j, near, blob in zip(batch["i"], batch["j"], batch["near"], batch["blob"]):
                if (i, j) != pair:
                    yield from map(_summed, askers)
                    pair, askers = (i, j), []
                if not near:
                    askers.append(_opened(blob))
                elif askers:
                    piece = _Neighbours(blob, groups)
                    for x in askers:
                        _add_answers(x, piece, x["sums"], deviations, exclude_self, min_shared, slot)
        yield from map(_summed, askers)

    return run


def _blocks(pieces: tuple[int, int], size: tuple[float, float], tasks: int) -> list[int]:
    """Into how many blocks askers and neighbours are cut: none has more than `BLOCK_BYTES`, and there are as many pairs of blocks as `tasks`, at the least copying."""
    blocks = [min(p, max(1, ceil(s / most))) for p, s, most in zip(pieces, size, BLOCK_BYTES)]
    while blocks[0] * blocks[1] < tasks and (blocks[0] < pieces[0] or blocks[1] < pieces[1]):
        # One more block of a side is one more copy of the other.
        more = 0 if blocks[0] * size[1] <= blocks[1] * size[0] else 1
        more = more if blocks[more] < pieces[more] else 1 - more
        blocks[more] += 1
    return blocks


def answered_in_blocks(
    known: DataFrame,
    cells: DataFrame,
    totals: DataFrame | None,
    matches: float,
    exclude_self: bool,
    min_shared: int,
    piece_cells: int | None = None,
) -> DataFrame:
    """(entity, context, weighted, weights, n_neighbours) of the requests `known` (entity, context), each once.

    `cells` has (neighbour, context, r), each pair of keys once; what is weighted are ratings or, with `totals` (neighbour, s, n) of all their
    ratings, how far they are from the mean of the neighbour's others. `matches` says how many co-ratings there are, about. Ratings are copied to as
    many tasks as there are blocks on the other side; nothing else grows with the matches but the tasks' work.
    """
    spark = known.sparkSession
    cells = cells.dropna(subset=["neighbour", "context"])
    member_ids = store(dense_codes(cells.select(F.col("neighbour").alias("id")).distinct(), [F.asc("id")], "member"), "members")
    group_ids = store(dense_codes(cells.select(F.col("context").alias("id")).distinct(), [F.asc("id")], "g"), "groups")
    # Keys of the packed pieces are 32 bits long.
    if max(member_ids.rows, group_ids.rows) >= 1 << 31:
        raise ValueError("more than 2 ** 31 members or groups")

    def members(name: str, code: str) -> DataFrame:
        return member_ids.sized().select(F.col("id").alias(name), F.col("member").cast("int").alias(code))

    groups = group_ids.sized().select(F.col("id").alias("context"), F.col("g").cast("int").alias("g"))

    def coded(df: DataFrame, member: str) -> DataFrame:
        return df.join(members(member, "member"), member).join(groups, "context").drop(member, "context")

    path = fresh_path(spark, "answers")
    with Scope(spark) as packed:
        placed = store(coded(cells.select("neighbour", "context", F.col("r").cast("double").alias("r")), "neighbour"), "placed")
        asked = store(coded(known.select("entity", "context"), "entity"), "asked")
        size = piece_cells or int(min(PIECE_CELLS, max(20_000, -(-placed.rows // FEWEST_PIECES))))
        pieces = max(1, -(-placed.rows // size))
        piece = F.pmod(F.xxhash64(F.lit(7), "member"), F.lit(pieces)).cast("int").alias("piece")

        def dealt(df: DataFrame):
            return df.repartition(pieces, "piece").groupBy("piece")

        if totals is None:
            summed = members("neighbour", "member").select(piece, "member", F.lit(None).cast("double").alias("s"), F.lit(None).cast("double").alias("ratings"))
        else:
            named = totals.select("neighbour", F.col("s").cast("double").alias("s"), F.col("n").cast("double").alias("ratings"))
            summed = named.join(members("neighbour", "member"), "neighbour").select(piece, "member", "s", "ratings")
        rows = placed.df.select(piece, "member", "g", "r")
        near = store(dealt(rows).cogroup(dealt(summed)).applyInPandas(_pack_neighbours, "piece int, blob binary"), "neighbours")
        requests = asked.df.select(piece, "member", "g")
        rated = rows.join(requests.select("piece", "member").distinct(), ["piece", "member"], "left_semi")
        askers = store(dealt(rated).cogroup(dealt(requests)).applyInPandas(_pack_askers, "piece int, blob binary"), "askers")
        tasks = max(2 * spark.sparkContext.defaultParallelism, ceil(matches / TASK_MATCHES))
        n_blocks = _blocks((max(1, askers.rows), max(1, near.rows)), (askers.size, near.size), tasks)

        def side(df: DataFrame, near: int, others: int) -> DataFrame:
            own, other = ("j", "i") if near else ("i", "j")
            to = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)
            dealt = df.select(F.pmod(F.col("piece"), F.lit(n_blocks[near])).alias(own), to, F.lit(bool(near)).alias("near"), "blob")
            return dealt.select("i", "j", "near", "blob")

        # So many partitions that hardly two pairs of blocks share one.
        run_in = int(min(20_000, 8 * n_blocks[0] * n_blocks[1]))
        pairs = side(askers.df, 0, n_blocks[1]).unionByName(side(near.df, 1, n_blocks[0]))
        found = (
            pairs.repartition(run_in, "i", "j")
            .sortWithinPartitions("i", "j", "near")
            .mapInPandas(_answers(group_ids.rows, totals is not None, exclude_self, min_shared), "e int, g int, weighted double, weights double, n long")
        )
        at_once = spark.conf.get(_ROWS_AT_ONCE)
        # A row is a piece: one at a time.
        spark.conf.set(_ROWS_AT_ONCE, 1)
        try:
            with freed_shuffles(spark):
                found.write.parquet(path)
        finally:
            spark.conf.set(_ROWS_AT_ONCE, at_once)
    packed.release()
    found = spark.read.schema(found.schema).parquet(path)
    sums = found.groupBy("e", "g").agg(F.sum("weighted").alias("weighted"), F.sum("weights").alias("weights"), F.sum("n").alias("n_neighbours"))
    return sums.join(members("entity", "e"), "e").join(groups, "g").select("entity", "context", "weighted", "weights", "n_neighbours")
