"""Baskets and frequent itemsets.

Baskets stay in long form, one row per (basket, item). An itemset of size k is
named by the number of its first k-1 items (the `prefix`) and its `last` item,
and an occurrence table says which basket holds which frequent set. Two
occurrences of the same basket with the same prefix are exactly two
(k-1)-sets that agree on their first k-2 items, both inside the basket: joining
the table with itself makes the occurrences of all candidates of the next
level, and nothing but those.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coratia.plans.lineage import Stored, cut_lineage, store
from coratia.plans.skew import MATCHES_PER_CELL, pairs_of_group, spread_join

# Baskets with more distinct frequent items than this are big.
BIG_BASKET = 2_000
# At most so many baskets are treated as big (the list of them stays small).
MOST_BIG_BASKETS = 1_000

# Baskets with no more items of the given sets than this travel as one row, in which the sets they hold are looked up.
ROW_ITEMS = 64

NO_PREFIX = -1


def basket_items(
    df: DataFrame,
    basket: str,
    item: str,
    min_items: int | None = None,
    chunk: str | None = None,
) -> DataFrame:
    """Distinct (basket, item[, chunk]) rows; the key of the basket is the caller's choice.

    With `min_items`, only baskets with **more** distinct items stay. `chunk`
    names a column that is constant within a basket.
    """
    columns = [F.col(basket).alias("basket"), F.col(item).alias("item")]
    if chunk is not None:
        columns.append(F.col(chunk).alias("chunk"))
    rows = df.select(*columns).distinct()
    if min_items is None:
        return rows
    large = basket_sizes(rows).filter(F.col("n_items") > min_items).select("basket")
    return rows.join(large, "basket", "left_semi")


def orient(df: DataFrame, case: int, left: str, right: str) -> DataFrame:
    """(basket, item) rows: case 1 takes the left column as the basket, case 2 the right one."""
    if case not in (1, 2):
        raise ValueError("case must be 1 or 2")
    basket, item = (left, right) if case == 1 else (right, left)
    return basket_items(df, basket, item)


def basket_sizes(items: DataFrame) -> DataFrame:
    return items.groupBy("basket").agg(F.count(F.lit(1)).alias("n_items"))


def big_baskets(items: DataFrame, support: int, big: int = BIG_BASKET) -> DataFrame:
    """The largest baskets above `big` items, fewer than `support` of them.

    A set that is in `support` baskets is in at least one basket outside this
    list, whatever the list holds. So pairs need not be made from the big baskets:
    the candidates come from all others, and are then counted in these.
    """
    room = min(support - 1, MOST_BIG_BASKETS)
    return (
        basket_sizes(items)
        .filter(F.col("n_items") > big)
        .orderBy(F.desc("n_items"), F.asc("basket"))
        .limit(max(room, 0))
        .select("basket")
    )


def _next_occurrences(occurrences: DataFrame, limit: int) -> DataFrame:
    """Occurrences of the candidates one level up."""
    keys = ["basket", "prefix"]
    carry = ["set_id"]
    if "chunk" in occurrences.columns:
        keys.append("chunk")
    pairs = pairs_of_group(occurrences, keys, "last", carry, limit)
    kept = [F.col("basket"), F.col("set_id_1").alias("prefix"), F.col("last_2").alias("last")]
    if "chunk" in occurrences.columns:
        kept.append(F.col("chunk"))
    return pairs.select(*kept)


def _occurrences_of(occurrences: DataFrame, sets: DataFrame) -> DataFrame:
    """Occurrences of given (prefix, last) sets one level up, without making all pairs."""
    by = [c for c in ("basket", "chunk") if c in occurrences.columns]
    first = occurrences.select(*by, F.col("prefix").alias("shared"), F.col("set_id").alias("prefix"))
    second = occurrences.select("basket", F.col("prefix").alias("shared"), "last")
    return (
        first.join(sets, "prefix")
        .join(second, ["basket", "shared", "last"])
        .select(*by, *sets.columns)
    )


def _count_sets(occurrences: DataFrame, by: list[str]) -> DataFrame:
    return occurrences.groupBy(*by).agg(F.count(F.lit(1)).alias("freq"))


def _numbered(sets: DataFrame) -> Stored:
    """Give the sets of a level numbers that stay the same once stored."""
    return store(sets.withColumn("set_id", F.monotonically_increasing_id()))


def _spelled(level: DataFrame, previous: Stored | None) -> DataFrame:
    """Add the array `items`, from the spelled sets of the level before."""
    if previous is None:
        return level.withColumn("items", F.array("last"))
    before = previous.df.select(F.col("set_id").alias("prefix"), F.col("items").alias("__before"))
    return level.join(previous.fits(before), "prefix").select(
        *level.columns, F.concat("__before", F.array("last")).alias("items")
    )


def _empty_report(items: DataFrame) -> DataFrame:
    kind = items.schema["item"].dataType.simpleString()
    return items.sparkSession.createDataFrame([], f"size int, items array<{kind}>, freq bigint")


def _union(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)


def frequent_itemsets(
    items: DataFrame,
    support: int,
    max_size: int | None = None,
    big: int = BIG_BASKET,
    limit: int = MATCHES_PER_CELL,
) -> DataFrame:
    """(size, items, freq): all itemsets that at least `support` baskets hold.

    `items` comes from `basket_items`. The items of a set are sorted. Levels
    follow each other until one has no frequent set.
    """
    if support < 1:
        raise ValueError("support must be at least 1")
    items = cut_lineage(items.select("basket", "item"))
    singles = _numbered(
        items.groupBy(F.col("item").alias("last"))
        .agg(F.count(F.lit(1)).alias("freq"))
        .filter(F.col("freq") >= support)
        .withColumn("prefix", F.lit(NO_PREFIX).cast("long"))
    )
    if not singles.rows:
        return _empty_report(items)
    level, size = store(_spelled(singles.df, None)), 1
    report = [_report_rows(level.df, size)]
    occurrences = cut_lineage(
        items.withColumnRenamed("item", "last")
        .join(singles.fits(singles.df.select("last", "prefix", "set_id")), "last")
        .select("basket", "prefix", "last", "set_id")
    )
    heavy = store(big_baskets(occurrences.select("basket", F.col("last").alias("item")), support, big))
    n_heavy = heavy.rows
    in_heavy = None
    if n_heavy:
        # At most MOST_BIG_BASKETS keys are broadcast.
        in_heavy = cut_lineage(occurrences.join(heavy.sized(), "basket", "left_semi"))
        occurrences = cut_lineage(occurrences.join(heavy.sized(), "basket", "left_anti"))
    key = ["prefix", "last"]
    while max_size is None or size < max_size:
        # Counted and then joined with the frequent sets: made once.
        raw = cut_lineage(_next_occurrences(occurrences, limit))
        counted = _count_sets(raw, key)
        if n_heavy:
            candidates = store(counted.filter(F.col("freq") >= support - n_heavy))
            wanted = candidates.fits(candidates.df.select(*key))
            in_big = _count_sets(_occurrences_of(in_heavy, wanted), key)
            counted = (
                candidates.df.unionByName(in_big).groupBy(*key).agg(F.sum("freq").alias("freq"))
            )
        frequent = _numbered(counted.filter(F.col("freq") >= support))
        if not frequent.rows:
            break
        size += 1
        level = store(_spelled(frequent.df, level))
        report.append(_report_rows(level.df, size))
        if size == max_size:
            break
        named = frequent.fits(frequent.df.select(*key, "set_id"))
        occurrences = cut_lineage(raw.join(named, key).select("basket", *key, "set_id"))
        if n_heavy:
            in_heavy = cut_lineage(_occurrences_of(in_heavy, named))
    return _union(report)


def frequent_itemsets_fp(
    items: DataFrame,
    support: int,
    max_size: int | None = None,
    big: int = BIG_BASKET,
    limit: int = MATCHES_PER_CELL,
) -> DataFrame:
    """The rows of `frequent_itemsets`, from FP-trees that depend on groups of items.

    Infrequent items go before the baskets become arrays, so one basket travels as one row of at most `big` frequent items. If any basket
    has more, it would be a row and a branch of every tree without a bound, and the levels answer instead. The trees
    of the groups are built apart; the driver holds the frequent items, of which there are no more than the items of an
    average basket divided by the share of baskets that `support` is.
    """
    if support < 1:
        raise ValueError("support must be at least 1")
    items = cut_lineage(items.select("basket", "item"))
    single = items.groupBy("item").agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= support).select("item")
    singles = store(single, "frequent")
    if not singles.rows:
        return _empty_report(items)
    kept = store(items.join(singles.sized(), "item", "left_semi"), "kept").df
    per_basket = store(basket_sizes(kept), "sizes")
    if per_basket.df.agg(F.max("n_items")).first()[0] > big:
        return frequent_itemsets(items, support, max_size, big, limit)
    arrays = store(kept.groupBy("basket").agg(F.collect_list("item").alias("items")).select("items"), "arrays")
    # The support is given as a share and rounded up: half a basket less stays clear of both neighbours.
    model = FPGrowth(itemsCol="items", minSupport=(support - 0.5) / arrays.rows).fit(arrays.df)
    found = model.freqItemsets.select(
        F.size("items").alias("size"), F.array_sort("items").alias("items"), F.col("freq").cast("long").alias("freq")
    )
    return cut_lineage(found if max_size is None else found.filter(F.col("size") <= max_size))


def _report_rows(level: DataFrame, size: int) -> DataFrame:
    return level.select(F.lit(size).alias("size"), "items", "freq")


def itemset_report(
    items: DataFrame,
    support: int,
    max_size: int | None = None,
    big: int = BIG_BASKET,
    limit: int = MATCHES_PER_CELL,
) -> DataFrame:
    """(kind, size, items, freq): candidates and frequent sets, level by level.

    `items` carries a `chunk` column. A set is a candidate if some chunk holds it
    at least `support` times scaled by the chunk's share of all baskets; no
    frequent set can miss that everywhere. Both kinds come from one count per
    (chunk, set). Candidates have no `freq`. Levels without a frequent set are
    left out.
    """
    if support < 1:
        raise ValueError("support must be at least 1")
    items = cut_lineage(items.select("basket", "chunk", "item"))
    chunks = store(
        items.select("chunk", "basket").distinct().groupBy("chunk").agg(F.count(F.lit(1)).alias("n_chunk"))
    )
    n_baskets, smallest = chunks.df.agg(F.sum("n_chunk"), F.min("n_chunk")).first()
    n_baskets = n_baskets or 0
    # What the smallest chunk asks of a candidate: a set in fewer baskets is neither kind.
    least = -(-support * (smallest or 0) // n_baskets) if n_baskets else support
    n_heavy, in_heavy = 0, None
    raw = items.select(
        "basket", "chunk", F.lit(NO_PREFIX).cast("long").alias("prefix"), F.col("item").alias("last")
    )
    key = ["prefix", "last"]
    report: list[DataFrame] = []
    level, size = None, 0
    while max_size is None or size < max_size:
        per_chunk = cut_lineage(_count_sets(raw, ["chunk", *key]))
        if n_heavy:
            pool = store(
                per_chunk.groupBy(*key)
                .agg(F.sum("freq").alias("freq"))
                .filter(F.col("freq") >= least - n_heavy)
                .select(*key)
            )
            in_big = _count_sets(_occurrences_of(in_heavy, pool.sized()), ["chunk", *key])
            per_chunk = cut_lineage(
                per_chunk.join(pool.sized(), key, "left_semi")
                .unionByName(in_big)
                .groupBy("chunk", *key)
                .agg(F.sum("freq").alias("freq"))
            )
        candidates = (
            per_chunk.join(chunks.sized(), "chunk")
            .filter(F.col("freq") * F.lit(n_baskets) >= F.lit(support) * F.col("n_chunk"))
            .select(*key)
            .distinct()
        )
        frequent = _numbered(
            per_chunk.groupBy(*key)
            .agg(F.sum("freq").alias("freq"))
            .filter(F.col("freq") >= support)
        )
        if not frequent.rows:
            break
        size += 1
        spelled = _spelled(candidates, level)
        level = store(_spelled(frequent.df, level))
        report.append(
            spelled.select(
                F.lit("candidate").alias("kind"),
                F.lit(size).alias("size"),
                "items",
                F.lit(None).cast("long").alias("freq"),
            )
        )
        report.append(_report_rows(level.df, size).select(F.lit("frequent").alias("kind"), "*"))
        if size == max_size:
            break
        named = frequent.fits(frequent.df.select(*key, "set_id"))
        occurrences = cut_lineage(raw.join(named, key).select("basket", "chunk", *key, "set_id"))
        if size == 1:
            single = occurrences.select("basket", F.col("last").alias("item"))
            heavy = store(big_baskets(single, least, big))
            n_heavy = heavy.rows
            if n_heavy:
                in_heavy = cut_lineage(occurrences.join(heavy.sized(), "basket", "left_semi"))
                occurrences = cut_lineage(occurrences.join(heavy.sized(), "basket", "left_anti"))
        elif n_heavy:
            in_heavy = cut_lineage(_occurrences_of(in_heavy, named))
        # Counted and then joined with the frequent sets: made once.
        raw = cut_lineage(_next_occurrences(occurrences, limit))
    if not report:
        return _empty_report(items).select(F.lit("candidate").alias("kind"), "*")
    return _union(report)


def son_candidates(
    items: DataFrame,
    support: int,
    prior: DataFrame | None = None,
) -> DataFrame:
    """Candidates of one level: (items), given the frequent sets of the level before.

    `prior` holds the column `items` with the frequent sets of size k-1, or is left out
    for the first level. `items` carries a `chunk` column.
    """
    # Baskets are brought together once, for both counts.
    met = items.select("chunk", "basket").repartition("basket").distinct()
    first = F.row_number().over(Window.partitionBy("basket").orderBy("chunk")) == 1
    chunks = store(
        met.withColumn("first", first.cast("long")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n_chunk"), F.sum("first").alias("n_first"))
    )
    n_baskets = chunks.df.agg(F.sum("n_first")).first()[0] or 0
    if prior is None:
        found = items.select("basket", "chunk", F.array("item").alias("items"))
    else:
        # Pairs of prior sets are made inside the baskets that hold both, never of the whole list.
        by = ["basket", "chunk", "head"]
        parts = [
            part.select("basket", "chunk", F.expr("slice(items, 1, size(items) - 1)").alias("head"), F.element_at("items", -1).alias("last"))
            for part in _matches(items, prior)
            if part is not None
        ]
        # The sets of a basket that is one row are few and still together: no further shuffle.
        lists = parts[0].dropna(subset=["basket", "chunk"]).groupBy(*by).agg(F.array_sort(F.collect_list("last")).alias("held"))
        pairs = _two_of(lists, by, "last_1", "last_2")
        if len(parts) > 1:
            pairs = pairs.unionByName(pairs_of_group(cut_lineage(parts[1]), by, "last").select(*by, "last_1", "last_2"))
        found = pairs.select("basket", "chunk", F.concat("head", F.array("last_1", "last_2")).alias("items"))
    return (
        found.groupBy("chunk", "items")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(chunks.sized(), "chunk")
        .filter(F.col("n") * F.lit(n_baskets) >= F.lit(support) * F.col("n_chunk"))
        .select("items")
        .distinct()
    )


def count_candidates(items: DataFrame, candidates: DataFrame, support: int) -> DataFrame:
    """(items, freq): candidate sets that at least `support` baskets hold."""
    sets = candidates.select("items").distinct()
    return (
        _union([part for part in _matches(items, sets) if part is not None])
        .groupBy("items")
        .agg(F.count(F.lit(1)).alias("freq"))
        .filter(F.col("freq") >= support)
    )


def _two_of(rows: DataFrame, keep: list[str], one: str, two: str) -> DataFrame:
    """Each two different places of the array `held`, in its order."""
    firsts = rows.select(*keep, "held", F.posexplode("held").alias("__at", one))
    return firsts.select(*keep, one, F.explode(F.expr("slice(held, __at + 2, size(held))")).alias(two))


def _matches(
    items: DataFrame, sets: DataFrame, limit: int = MATCHES_PER_CELL, row_items: int = ROW_ITEMS
) -> tuple[DataFrame, DataFrame | None]:
    """(basket, [chunk,] items): which basket holds all items of which set; the second part is of baskets that are more than a row.

    Where the sets are few enough to go to every task, a basket of at most `row_items` of their items is a row, and its two rarest-first items
    look up the sets that begin with them. Otherwise a set meets the baskets of its rarest item first, and what is left is narrowed down
    item by item. Neither a larger basket nor a longer list of sets is collected.
    """
    sets = store(sets.select("items").distinct().withColumn("set_id", F.monotonically_increasing_id()))
    parts = sets.df.select("set_id", F.size("items").alias("n_items"), F.explode("items").alias("item"))
    asked = store(parts.select("item").distinct(), "asked")
    counts = store(items.join(asked.sized(), "item", "left_semi").groupBy("item").agg(F.count(F.lit(1)).alias("n")), "counts")
    by_rarity = (
        parts.join(counts.sized(), "item")
        .groupBy("set_id", "n_items")
        .agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("order"))
        .filter(F.size("order") == F.col("n_items"))
    )
    by_rarity = store(by_rarity.select("set_id", "n_items", F.col("order.item").alias("order")), "order")
    if not (sets.small and by_rarity.small and counts.small):
        nothing = items.filter("false").select(*[c for c in items.columns if c != "item"], F.array("item").alias("items"))
        return nothing, _matches_by_item(items, sets, by_rarity, limit)
    rest, known = None, items.join(counts.sized(), "item")
    if counts.rows > row_items:
        large = store(basket_sizes(known).filter(F.col("n_items") > row_items).select("basket"), "large")
        if large.rows:
            rest = _matches_by_item(items.join(large.sized(), items["basket"].eqNullSafe(large.df["basket"]), "left_semi"), sets, by_rarity, limit)
            known = known.join(large.sized(), known["basket"].eqNullSafe(large.df["basket"]), "left_anti")
    return _matches_in_rows(known, sets, by_rarity), rest


def _matches_in_rows(known: DataFrame, sets: Stored, by_rarity: Stored) -> DataFrame:
    """The matches of baskets that are rows: `known` has (basket, item, [chunk,] n), the number of baskets of an item."""
    by = [c for c in known.columns if c not in ("item", "n")]
    held = F.array_sort(F.collect_list(F.struct("n", "item"))).getField("item")
    rows = known.groupBy(*by).agg(held.alias("held"))
    needed = by_rarity.df.select("set_id", F.array_distinct("order").alias("needed")).withColumn("n_needed", F.size("needed"))
    named = sets.df.join(by_rarity.fits(needed), "set_id").select("items", "needed", "n_needed", F.col("needed")[0].alias("one"))
    shortest, longest = needed.agg(F.min("n_needed"), F.max("n_needed")).first()
    found = []
    if shortest is None or shortest == 1:
        one = sets.fits(named.filter("n_needed = 1").select("items", "one"))
        alone = rows.select(*by, F.explode("held").alias("one")).join(one, "one")
        found.append(alone.filter("basket is not null or size(items) = 1").select(*by, "items"))
    if longest is not None and longest > 1:
        # A basket without a name holds single items only: no two of its rows are known to be of one basket.
        keep = by if longest == 2 else [*by, "all"]
        several = named.filter("n_needed > 1").withColumn("two", F.col("needed")[1])
        pairs = _two_of(rows.filter("basket is not null").withColumn("all", F.col("held")), keep, "one", "two")
        pairs = pairs.join(sets.fits(several), ["one", "two"])
        if longest > 2:
            pairs = pairs.filter(F.size(F.array_except("needed", "all")) == 0)
        found.append(pairs.select(*by, "items"))
    return _union(found)


def _matches_by_item(items: DataFrame, sets: Stored, by_rarity: Stored, limit: int) -> DataFrame:
    """The matches, from the rarest item of each set on."""
    longest = by_rarity.df.agg(F.max("n_items")).first()[0] or 1
    first = by_rarity.df.withColumn("item", F.col("order")[0])
    held = spread_join(items, first, ["item"], "basket", "set_id", limit)
    for position in range(1, longest):
        short = held.filter(F.col("n_items") <= position)
        narrowed = (
            held.filter(F.col("n_items") > position)
            .withColumn("item", F.col("order")[position])
            .join(items.select("basket", "item"), ["basket", "item"], "left_semi")
        )
        held = short.unionByName(narrowed)
    named = [c for c in items.columns if c != "item"]
    return held.select(*named, "set_id").join(sets.sized(), "set_id").select(*named, "items")
