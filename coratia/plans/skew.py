"""Equi-joins whose hot keys are spread over many tasks.

A shuffle join gives all rows of a key to one task. That is fine while the
number of matches stays small, and fatal when one key holds a third of all
rows on both sides. AQE splits a partition by bytes, which says nothing about
the number of matches. Here a key whose matches exceed a limit is laid
out as a grid: its left rows fall into `a` strips, its right rows into `b`
strips, every left row is sent to the `b` cells of its strip and every right
row to the `a` cells of its own, so that each match is made in exactly one
cell and no cell makes more matches than the limit. Keys below the limit are
not copied at all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coratia.plans.lineage import cut_lineage, store

MATCHES_PER_CELL = 50_000_000
# Rows of one key that travel together as a list.
LIST_ROWS = 1_000
# Matches that one task of `aggregate_matches` is meant to see.
MATCHES_PER_TASK = 2_000_000
# Matches, still in lists, that one task of its join is meant to write.
MATCHES_PER_WRITER = 8_000_000
MOST_TASKS = 50_000
# Matches that are shuffled at a time; where there are more, the left ids are taken in batches.
BATCH_MATCHES = 500_000_000

_LEFT_STRIP, _RIGHT_STRIP = "__left_strip", "__right_strip"
_LEFT_STRIPS, _RIGHT_STRIPS = "__left_strips", "__right_strips"


def _rows_per_key(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def _strips(count: str, limit: int) -> Column:
    return F.ceil(F.col(count) / F.lit(max(1.0, sqrt(limit)))).cast("int")


def hot_keys(sizes: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Keys of `sizes` (`keys`, n_left, n_right) with more matches than `limit`."""
    matches = F.col("n_left").cast("double") * F.col("n_right").cast("double")
    return sizes.filter(matches > F.lit(float(limit))).select(
        *keys,
        _strips("n_left", limit).alias(_LEFT_STRIPS),
        _strips("n_right", limit).alias(_RIGHT_STRIPS),
    )


def _laid_out(
    df: DataFrame,
    hot: DataFrame,
    keys: list[str],
    row_id: str,
    own: tuple[str, str],
    other: tuple[str, str],
) -> DataFrame:
    own_strip, own_strips = own
    other_strip, other_strips = other
    return (
        df.join(hot, keys, "left")
        .withColumn(own_strip, F.pmod(F.xxhash64(row_id), F.coalesce(own_strips, F.lit(1))).cast("int"))
        .withColumn(other_strip, F.explode(F.sequence(F.lit(0), F.coalesce(other_strips, F.lit(1)) - 1)))
        .drop(own_strips, other_strips)
    )


def _grid_join(
    left: DataFrame, right: DataFrame, hot: DataFrame, keys: list[str], left_id: str, right_id: str
) -> DataFrame:
    stored = store(hot)
    if stored.rows == 0:
        return left.join(right, keys)
    hot = stored.sized()
    one, two = (_LEFT_STRIP, _LEFT_STRIPS), (_RIGHT_STRIP, _RIGHT_STRIPS)
    return (
        _laid_out(left, hot, keys, left_id, one, two)
        .join(_laid_out(right, hot, keys, right_id, two, one), [*keys, _LEFT_STRIP, _RIGHT_STRIP])
        .drop(_LEFT_STRIP, _RIGHT_STRIP)
    )


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_id: str,
    right_id: str,
    limit: int = MATCHES_PER_CELL,
) -> DataFrame:
    """Inner join of `left` and `right` on `keys`, hot keys spread over a grid.

    `left_id` and `right_id` name the columns that tell the rows of one key
    apart.
    """
    sizes = _rows_per_key(left, keys, "n_left").join(_rows_per_key(right, keys, "n_right"), keys)
    return _grid_join(left, right, hot_keys(sizes, keys, limit), keys, left_id, right_id)


def pairs_of_group(
    df: DataFrame,
    keys: list[str],
    member: str,
    carry: list[str] | None = None,
    limit: int = MATCHES_PER_CELL,
) -> DataFrame:
    """Unordered pairs of members that share `keys`: `<member>_1` < `<member>_2`.

    Every column in `carry` comes out twice, with the same suffixes.
    """
    columns = [member, *(carry or [])]
    left = df.select(*keys, *[F.col(c).alias(f"{c}_1") for c in columns])
    right = df.select(*keys, *[F.col(c).alias(f"{c}_2") for c in columns])
    sizes = _rows_per_key(df, keys, "n_left").withColumn("n_right", F.col("n_left"))
    joined = _grid_join(
        left, right, hot_keys(sizes, keys, limit), keys, f"{member}_1", f"{member}_2"
    )
    return joined.filter(F.col(f"{member}_1") < F.col(f"{member}_2"))


def aggregate_matches(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_id: str,
    right_id: str,
    aggregates: list[Column],
    where: Column | None = None,
    limit: int = MATCHES_PER_CELL,
    list_rows: int = LIST_ROWS,
    in_list: Callable[[Column], Column] | None = None,
    then: Callable[[DataFrame], DataFrame] | None = None,
    batch_matches: int | None = None,
) -> DataFrame:
    """Join on `keys`, filter, and aggregate per (left_id, right_id).

    Most pairs of ids meet under one or two keys, so combining before the
    shuffle saves nothing, and shuffling every match is what such a join costs. Here
    the right rows of a key travel as lists of bounded length: a left row is joined with the
    lists of its keys, shuffled by its id, and only then unfolded into matches,
    which are aggregated where they are. The number of partitions follows the number of
    matches, in the join too: its tasks write many times what they read. What `in_list` says of a right row, as a struct
    beside the left row's columns, is part of `where` and is told before the shuffle. Keys with many rows are laid out as a grid as above. A left id with more
    matches than `limit` does not go to one task: its matches are shuffled one
    by one, by both ids. `then` is applied to the result. More than `batch_matches` matches are made in batches of left ids: what a
    batch results in is stored, its shuffled matches go.
    """
    by = [left_id, right_id]

    def finish(matches: DataFrame) -> DataFrame:
        kept = matches if where is None else matches.filter(where)
        found = kept.groupBy(*by).agg(*aggregates)
        return found if then is None else then(found)

    sizes = cut_lineage(
        _rows_per_key(left, keys, "n_left").join(_rows_per_key(right, keys, "n_right"), keys)
    )
    total, largest = sizes.agg(
        F.sum(F.col("n_left").cast("double") * F.col("n_right")), F.max("n_right")
    ).first()
    if total is None or total <= min(limit, MATCHES_PER_TASK):
        return finish(left.join(right, keys))
    most = BATCH_MATCHES if batch_matches is None else batch_matches
    if total > most:
        batches = ceil(total / most)
        batch = F.pmod(F.xxhash64(F.lit(batches), left_id), F.lit(batches))
        made = [
            cut_lineage(
                aggregate_matches(
                    left.filter(batch == k), right, keys, left_id, right_id, aggregates, where, limit, list_rows, in_list, then, total
                )
            )
            for k in range(batches)
        ]
        return reduce(DataFrame.unionByName, made)
    rest = None
    if total > limit:
        busy = store(
            left.select(*keys, left_id)
            .join(sizes.select(*keys, "n_right"), keys)
            .groupBy(left_id)
            .agg(F.sum("n_right").alias("n"))
            .filter(F.col("n") > limit)
            .select(left_id)
        )
        if busy.rows:
            rest = finish(
                spread_join(left.join(busy.sized(), left_id, "left_semi"), right, keys, left_id, right_id, limit)
            )
            left = left.join(busy.sized(), left_id, "left_anti")
    carried = F.struct(*[c for c in right.columns if c not in keys])
    default = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writers = int(min(MOST_TASKS, max(default, total // MATCHES_PER_WRITER + 1)))
    if largest <= list_rows:
        lists = right.repartition(writers, *keys).groupBy(*keys).agg(F.collect_list(carried).alias("__matches"))
        joined = left.repartition(writers, *keys).join(lists, keys)
    else:
        one, two = (_LEFT_STRIP, _LEFT_STRIPS), (_RIGHT_STRIP, _RIGHT_STRIPS)
        rows_per_strip = max(1.0, limit / list_rows)
        hot = store(
            sizes.filter(F.col("n_right") > list_rows).select(
                *keys,
                F.ceil(F.col("n_left") / F.lit(rows_per_strip)).cast("int").alias(_LEFT_STRIPS),
                F.ceil(F.col("n_right") / F.lit(list_rows)).cast("int").alias(_RIGHT_STRIPS),
            )
        ).sized()
        cell = [*keys, _LEFT_STRIP, _RIGHT_STRIP]
        lists = (
            _laid_out(right, hot, keys, right_id, two, one)
            .repartition(writers, *cell)
            .groupBy(*cell)
            .agg(F.collect_list(carried).alias("__matches"))
        )
        joined = _laid_out(left, hot, keys, left_id, one, two).repartition(writers, *cell).join(lists, cell)
    if in_list is not None:
        joined = joined.withColumn("__matches", F.filter("__matches", in_list)).filter(F.size("__matches") > 0)
    tasks = int(min(MOST_TASKS, max(default, total // MATCHES_PER_TASK + 1)))
    own = [c for c in left.columns if c not in keys]
    unfolded = joined.select(*own, "__matches").repartition(tasks, left_id).select(*own, F.inline("__matches"))
    found = finish(unfolded)
    return found if rest is None else found.unionByName(rest)


def aggregate_pairs(
    df: DataFrame,
    keys: list[str],
    member: str,
    aggregates: list[Column],
    carry: list[str] | None = None,
    where: Column | None = None,
    limit: int = MATCHES_PER_CELL,
    list_rows: int = LIST_ROWS,
    in_list: Callable[[Column], Column] | None = None,
    then: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """`aggregate_matches` of a table with itself: `<member>_1` < `<member>_2`."""
    columns = [member, *(carry or [])]
    left = df.select(*keys, *[F.col(c).alias(f"{c}_1") for c in columns])
    right = df.select(*keys, *[F.col(c).alias(f"{c}_2") for c in columns])
    one, two = f"{member}_1", f"{member}_2"
    in_order = F.col(one) < F.col(two)
    return aggregate_matches(
        left,
        right,
        keys,
        one,
        two,
        aggregates,
        in_order if where is None else in_order & where,
        limit,
        list_rows,
        lambda match: (F.col(one) < match[two]) if in_list is None else (F.col(one) < match[two]) & in_list(match),
        then,
    )
