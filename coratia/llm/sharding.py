"""Resharding that moves the fewest bytes, by minimum-cost flow.

Rows lie in old shards; new shards get equal capacities. Bytes flow from old
shards to new ones, staying costs nothing and moving costs one per byte, so the cheapest flow that
fills the capacities moves as little as possible. The network has one node per
shard, whatever the number of rows, and is solved on the driver.

The flow is carried out in ranges of bytes: the rows of an old shard have a fixed order, the first bytes stay, the next go to the
first shard the flow names, and so on. The order is by blocks of rows (a hash of the row) and inside a
block by the row, so that offsets are sums over blocks plus sums inside one block, and no task sees a whole shard.
A row that a border of two ranges would cut is placed on its own: at most one per
range, largest first, into the shard with the most room.

Law: `bytes`. The sizes of the shards differ from their capacity by little more than one row.

Defined results: a null text has no bytes, so its size is 1 and its hash that of the empty text; rows without an
id are placed like any other; equal rows get different slots; an empty table gives an
empty result. Columns of the result replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coratia.plans.lineage import fresh_path, store

SHARDS = 16
OLD_SHARDS = 12
BLOCK_ROWS = 20_000


# --- the flow -------------------------------------------------------------------------


def cheapest_flow(supplies: list[int], capacities: list[int], costs: list[list[int]]) -> list[list[int]]:
    """How much goes from each supply to each capacity, all supplies placed, at the least total cost.

    Successive cheapest paths: each round finds the cheapest way for more flow, which may take back earlier flow, and sends
    as much as fits. The capacities must hold the supplies.
    """
    n, m = len(supplies), len(capacities)
    if sum(capacities) < sum(supplies):
        raise ValueError("the capacities are too small")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supplies), list(capacities)
    while any(left):
        # Bellman-Ford from all supplies that have something left.
        cost_from = [0 if x else None for x in left]
        cost_to: list[int | None] = [None] * m
        came_to: list[int] = [-1] * m
        came_back: list[int] = [-1] * n
        changed = True
        while changed:
            changed = False
            for i in range(n):
                if cost_from[i] is None:
                    continue
                for j in range(m):
                    reach = cost_from[i] + costs[i][j]
                    if cost_to[j] is None or reach < cost_to[j]:
                        cost_to[j], came_to[j], changed = reach, i, True
            for j in range(m):
                if cost_to[j] is None:
                    continue
                for i in range(n):
                    back = cost_to[j] - costs[i][j]
                    if flow[i][j] and (cost_from[i] is None or back < cost_from[i]):
                        cost_from[i], came_back[i], changed = back, j, True
        end = min((j for j in range(m) if room[j]), key=lambda j: (cost_to[j], j))
        path, j = [], end
        while True:
            i = came_to[j]
            path.append((i, j))
            if came_back[i] < 0:
                break
            j = came_back[i]
            path.append((i, j))
        first = path[-1][0]
        amount = min([left[first], room[end], *(flow[i][j] for i, j in path[1::2])])
        for k, (i, j) in enumerate(path):
            flow[i][j] += amount if k % 2 == 0 else -amount
        left[first] -= amount
        room[end] -= amount
    return flow


@dataclass(frozen=True)
class Transfer:
    """Bytes [start, stop) of an old shard, in its order, go to a new shard."""

    old: int
    start: int
    stop: int
    new: int


def plan_transfers(old_sizes: dict[int, int], shards: int) -> tuple[list[Transfer], list[int]]:
    """The transfers of the cheapest flow to `shards` equal capacities, and these capacities."""
    total = sum(old_sizes.values())
    capacities = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    olds = sorted(old_sizes)
    costs = [[0 if i == j else 1 for j in range(shards)] for i in olds]
    flow = cheapest_flow([old_sizes[i] for i in olds], capacities, costs)
    transfers = []
    for i, row in zip(olds, flow):
        at = 0
        for j in sorted(range(shards), key=lambda j: (j != i, j)):
            if row[j]:
                transfers.append(Transfer(i, at, at + row[j], j))
                at += row[j]
    return transfers, capacities


# --- the rows -------------------------------------------------------------------------


def key_shard(id_column: str, shards: int) -> Column:
    """The shard of an id under the law of keys; the layout that the query starts from."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(shards)).cast("int")


def reshard(
    docs: DataFrame,
    old_shard: Column,
    shards: int = SHARDS,
    id_column: str = "doc_id",
    text: str = "text",
    carry: list[str] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, size, text_crc32, old_shard, shard, slot), and the columns `carry` of `docs` as they are.

    slot counts the rows of a shard from 0 without gaps: rows that stayed first, in their old order.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    kept = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(0)
    rows = store(
        docs.select(
            F.col(id_column).alias("id"),
            (F.octet_length(data) + 1).cast("long").alias("size"),
            F.crc32(data).alias("crc"),
            old_shard.cast("int").alias("old"),
            kept.alias("kept"),
        ),
        "rows",
    )
    blocks = max(1, -(-rows.rows // block_rows))
    named = rows.df.withColumn("block", F.pmod(F.xxhash64("id", "crc", "size"), F.lit(blocks)).cast("int"))
    sums = store(named.groupBy("old", "block").agg(F.sum("size").alias("bytes")), "blocks")
    old_sizes = {r["old"]: r["bytes"] for r in sums.df.groupBy("old").agg(F.sum("bytes").alias("bytes")).collect()}
    transfers, capacities = plan_transfers(old_sizes, shards)
    # One row per old shard, as long as the number of new ones at most.
    ranges: dict[int, list[tuple[int, int]]] = {}
    for t in transfers:
        ranges.setdefault(t.old, []).append((t.stop, t.new))
    spark = docs.sparkSession
    table = F.broadcast(
        spark.createDataFrame(list(ranges.items()), "old int, ranges array<struct<stop: long, new: int>>")
    )
    earlier = Window.partitionBy("old").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.fits(sums.df.select("old", "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base")))
    order = [F.asc_nulls_first("id"), "crc", "size"]
    inside = Window.partitionBy("old", "block").orderBy(*order)
    before = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    placed = (
        named.withColumns({"at": F.row_number().over(inside), "before": F.coalesce(before, F.lit(0))})
        .join(starts, ["old", "block"])
        .join(table, "old")
        .withColumn("start", F.col("base") + F.col("before"))
        .withColumn("range", F.element_at(F.filter("ranges", lambda r: r["stop"] > F.col("start")), 1))
        .withColumn("cut", F.col("start") + F.col("size") > F.col("range.stop"))
        .select("id", "size", "crc", "old", "kept", "block", "at", F.col("range.new").alias("new"), "cut")
    )
    placed = store(placed, "placed").df
    # Rows that a border cuts: at most one per transfer.
    loose = placed.filter("cut").select("old", "block", "at", "size", "new").collect()
    filled = dict.fromkeys(range(shards), 0)
    filled.update({r["new"]: r["bytes"] for r in placed.filter(~F.col("cut")).groupBy("new").agg(F.sum("size").alias("bytes")).collect()})
    settled = []
    for row in sorted(loose, key=lambda r: (-r["size"], r["old"], r["block"], r["at"])):
        target = min(range(shards), key=lambda j: (filled[j] - capacities[j], j != row["old"], j))
        filled[target] += row["size"]
        settled.append((row["old"], row["block"], row["at"], target))
    moved = F.broadcast(spark.createDataFrame(settled, "old int, block int, at int, settled int"))
    final = placed.join(moved, ["old", "block", "at"], "left").withColumn("shard", F.coalesce("settled", "new"))
    counts = store(final.groupBy("shard", "old", "block").agg(F.count(F.lit(1)).alias("n")), "counts")
    stayed = F.when(F.col("old") == F.col("shard"), 0).otherwise(1)
    ahead = Window.partitionBy("shard").orderBy(stayed, "old", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.fits(
        counts.df.select("shard", "old", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first_slot"))
    )
    among = Window.partitionBy("shard", "old", "block").orderBy("at")
    slotted = final.withColumn("k", F.row_number().over(among) - 1).join(bases, ["shard", "old", "block"])
    return slotted.select(
        *([F.col(f"kept.{c}").alias(c) for c in carry if c != id_column] if carry else []),
        F.col("id").alias(id_column),
        "size",
        F.col("crc").alias("text_crc32"),
        F.col("old").alias("old_shard"),
        "shard",
        (F.col("first_slot") + F.col("k")).cast("long").alias("slot"),
    )


def write_shards(placed: DataFrame, folder: str, rows_per_file: int = 1_000_000) -> list[int]:
    """Write rows with shard, old_shard and slot to `folder`/shard=N, in the order of their slots.

    Only the shards that rows leave or enter are written; the files of the others
    are not touched. Returns the shards written. A shard is written in several files where it is long.
    """
    changed = placed.filter(F.col("shard") != F.col("old_shard"))
    # One number per shard and direction.
    touched = sorted(
        r[0] for r in changed.select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct().collect()
    )
    part = F.floor(F.col("slot") / rows_per_file)
    (
        placed.filter(F.col("shard").isin(touched))
        .withColumn("__part", part)
        .repartition("shard", "__part")
        .sortWithinPartitions("shard", "__part", "slot")
        .drop("__part")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("shard")
        .parquet(folder)
    )
    return touched


def rewrite(
    docs: DataFrame, shards: int, old_shards: int, id_column: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, list[int]]:
    """Write `docs` by key over `old_shards`, then the shards that resharding changes; all rows read back, and the shards written.

    The rows read back are (row, old_shard, shard, slot), where row holds all columns: those of a changed shard come from its
    new files, those of another from the old files, which stay as they are.
    """
    spark = docs.sparkSession
    before, after = fresh_path(spark, "old-shards"), fresh_path(spark, "new-shards")
    numbered = docs.select(
        F.struct("*").alias("row"),
        F.monotonically_increasing_id().alias("number"),
        key_shard(id_column, old_shards).alias("shard"),
    )
    numbered.write.option("compression", "zstd").partitionBy("shard").parquet(before)
    old = spark.read.schema(numbered.schema).parquet(before)
    # Where each row goes is found without its other columns, which are read again only to be written.
    narrow = old.select(F.col(f"row.{id_column}").alias("id"), F.col(f"row.{text}").alias("text"), "number", "shard")
    placed = reshard(narrow, F.col("shard"), shards, "id", "text", carry=["number"])
    placed = store(placed.select("number", "old_shard", "shard", "slot"), "placement")
    moved = old.select("row", "number").join(placed.sized(), "number").drop("number")
    touched = write_shards(moved, after, BLOCK_ROWS)
    new = spark.read.schema(moved.schema).parquet(after)
    untouched = old.filter(~F.col("shard").isin(touched)).select("row", "number").join(placed.sized(), "number").drop("number")
    return new.select(moved.columns).unionByName(untouched), touched


def layout(
    docs: DataFrame, shards: int = SHARDS, old_shards: int = OLD_SHARDS, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The columns of the query: `docs`, laid out by key over `old_shards`, resharded to `shards` of equal bytes.

    Both layouts are written; what is returned is taken from the files of the second.
    """
    data = F.coalesce(F.col(f"row.{text}"), F.lit("")).cast("binary")
    return rewrite(docs, shards, old_shards, id_column, text)[0].select(
        F.col(f"row.{id_column}").alias(id_column),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )
