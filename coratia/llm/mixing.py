"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target: its share of all words by weight, at most `most`
times its own words; what is cut off goes to the other sources by weight.
Within a source each document gets an expected number of copies, in proportion to a preference that falls
slowly with its length (so that a few giants do not fill the mix), at most `most`, and
so that the expected words are the target. The whole part is certain: so many
copies are taken. The rest p is the inclusion probability of one more copy: each document draws a uniform
u from its id, is ranked by its odds u / (1 - u) divided by p / (1 - p), and the
first documents in that order are taken as long as the target is not exceeded; one more document then
closes the gap, the one beyond the cut whose size comes nearest to it. This one is chosen by its size, so it is
the only document of a source whose chance is not p.

The cut of a source is found without ordering it: words are summed per source
and slice of the order, and only the slice that holds the cut is looked at in detail.

Defined results: a null text or one without a word has size 0 and is taken or not without effect;
rows without a source form the last source; rows without an id draw from their text; rows of one id draw the same u, and those
that also share source and size are alike: they stand side by side in the order, but are taken one by one, so a cut may fall among them;
a source without words has target 0; an empty table gives an empty
result. Columns of the result replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coratia.operators.ids import dense_codes
from coratia.plans.lineage import Stored, cut_lineage, store

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"
SLICES = 4096
# Preferences go from 1 to this.
PREFERENCES = 16
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(_WORD)).cast("long")


def uniform(key: Column, text: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from 48 bits of a hash of the key, or of the text where there is no key."""
    told = F.coalesce(key.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), told)), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def preference(size: Column) -> Column:
    """16 for the shortest texts, one less for each doubling, 1 at least: whole numbers keep the sums exact."""
    return F.greatest(F.lit(1), F.lit(PREFERENCES) - F.length(F.bin(size))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> Stored:
    """(source, source_size, target) of (source, size); the sources are ordered by code point, null last.

    The excess of sources above `most` times their size is shared out again until none is above. Only
    three sums go to the driver per round.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    coded = dense_codes(total, [F.asc_nulls_last("source")])
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("code") % len(weights) + 1).cast("int"))
    sources = store(coded.select("source", "source_size", pick.cast("long").alias("weight")), "sources").df
    whole = sources.agg(F.sum("source_size")).first()[0] or 0
    capped, left, shared = F.lit(False), whole, None
    known = -1
    while True:
        state = sources.agg(
            F.sum(F.when(capped, F.col("source_size") * most)),
            F.sum(F.when(~capped, F.col("weight"))),
            F.count(F.when(capped, 1)),
        ).first()
        left, shared = whole - (state[0] or 0), state[1]
        share = F.lit(float(left)) * F.col("weight") / F.lit(float(shared or 1))
        if state[2] == known or not shared:
            break
        known, capped = state[2], capped | (share > F.col("source_size") * most)
    target = F.when(capped, (F.col("source_size") * most).cast("double")).otherwise(share)
    return store(sources.select("source", "source_size", target.alias("target")), "targets")


def source_scales(sizes: DataFrame, targets: Stored, most: int = MOST) -> DataFrame:
    """(source, source_size, target, scale): a document's expected copies are least(most, scale * preference).

    Documents of one preference are alike, so at most 16 rows per source are looked at: those with the highest
    preferences are capped until the rest stays below `most`.
    """
    classes = sizes.groupBy("source", "g").agg(F.sum("size").alias("words"))
    above = Window.partitionBy("source").orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("source").orderBy(F.desc("g")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    laid = classes.withColumns(
        {
            "capped": F.coalesce(F.sum("words").over(above), F.lit(0)),
            "spread": F.sum(F.col("words") * F.col("g")).over(below),
        }
    )
    joined = laid.join(targets.sized(), laid["source"].eqNullSafe(targets.df["source"])).select(
        laid["source"], "source_size", "target", "g", "capped", "spread"
    )
    scale = F.try_divide(F.col("target") - most * F.col("capped"), F.col("spread"))
    fitting = F.when(scale * F.col("g") <= most, F.struct((-F.col("g")).alias("order"), scale.alias("scale")))
    # Where nothing is left to spread every document is capped.
    return joined.groupBy("source").agg(
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.coalesce(F.min(fitting)["scale"], F.lit(float(most))).alias("scale"),
    )


def _with_odds(rows: DataFrame, most: int) -> DataFrame:
    """Adds `whole` (certain copies), `p` (chance of one more) and `place` in (0, 1), monotone in the odds ratio."""
    expected = F.least(F.lit(float(most)), F.col("scale") * F.col("g"))
    rows = rows.withColumn("expected", F.when(F.col("size") > 0, expected).otherwise(F.lit(0.0)))
    rows = rows.withColumn("whole", F.floor("expected").cast("long"))
    rows = rows.withColumn("p", F.col("expected") - F.col("whole"))
    u, p = F.col("u"), F.col("p")
    ratio = u * (1 - p)
    # q = (u / (1 - u)) / (p / (1 - p)); q / (1 + q) has the same order and a bounded range.
    return rows.withColumn("place", F.when(p > 0, ratio / (ratio + (1 - u) * p))).drop("expected")


def pareto_cuts(rows: DataFrame, scales: DataFrame, slices: int = SLICES) -> DataFrame:
    """(source, cut, fit, gap): documents before `cut`, a struct (place, id, size), are taken once more.

    cut: the first documents that don't all fit into what is wanted, null if all fit; fit: how many of these alike rows do;
    gap: the words still wanted then, never below 0.

    `rows` has source, id, size, whole, p, place.
    """
    certain = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("whole")).alias("certain"))
    wanted = store(
        scales.alias("s")
        .join(certain.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")))
        .select("s.source", (F.col("target") - F.col("certain")).alias("wanted")),
        "wanted",
    )
    ranked = rows.filter("place is not null").withColumn("slice", F.floor(F.col("place") * slices))
    summed = ranked.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # At most `slices` rows per source.
    upto = summed.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    crossing = (
        upto.alias("u")
        .join(wanted.sized().alias("w"), F.col("u.source").eqNullSafe(F.col("w.source")))
        .filter(F.col("before") <= F.col("wanted"))
        .groupBy("u.source")
        .agg(F.max_by(F.struct("slice", "before", "wanted"), "slice").alias("x"))
        .select("source", "x.*")
    )
    crossing = store(crossing, "crossing")
    # Alike rows are one row from here on, however many they are.
    inside = (
        ranked.alias("r")
        .join(
            crossing.sized().alias("x"),
            F.col("r.source").eqNullSafe(F.col("x.source")) & (F.col("r.slice") == F.col("x.slice")),
        )
        .groupBy("r.source", "place", "id", "size", "before", "wanted")
        .agg(F.sum("size").alias("words"))
    )
    running = Window.partitionBy("source").orderBy("place", F.asc_nulls_first("id"), "size")
    ends = inside.withColumn("reached", F.col("before") + F.sum("words").over(running))
    over = F.col("reached") > F.col("wanted")
    found = ends.groupBy("source").agg(
        F.min(F.when(over, F.struct(_key(), (F.col("reached") - F.col("words")).alias("reached")))).alias("x"),
        F.max("reached").alias("all"),
        F.first("wanted").alias("wanted"),
    )
    left = F.col("wanted") - F.coalesce("x.reached", "all")
    fit = F.coalesce(F.floor(left / F.col("x.key.size")), F.lit(0)).cast("long")
    gap = left - fit * F.coalesce("x.key.size", F.lit(0))
    return found.select("source", F.col("x.key").alias("cut"), fit.alias("fit"), gap.alias("gap"))


def closing_documents(rows: DataFrame, cuts: Stored) -> DataFrame:
    """(source, closing): of the documents beyond the cut, the place of one whose size comes nearest to the words still wanted.

    One row per source and task is shuffled. A source whose gap no document lessens has no row.
    """
    beyond = _joined(rows.filter("place is not null"), cuts).filter(~_before_cut())
    left = F.abs(F.col("gap") - F.col("size"))
    nearest = F.min(F.struct(left.alias("left"), _key())).alias("x")
    return beyond.filter(left < F.col("gap")).groupBy("source").agg(nearest).select("source", F.col("x.key").alias("closing"))


def _key() -> Column:
    """The place of a row in the order of its source; alike rows share it. Structs compare with null as the least."""
    return F.struct("place", "id", "size").alias("key")


def _before_cut() -> Column:
    return F.col("place").isNotNull() & (F.col("cut").isNull() | (_key() < F.col("cut")))


def _border_rows(rows: DataFrame, table: Stored) -> Stored:
    """(source, key, take, n): how many of the n alike rows at the cut, and at the closing document, are taken once more."""
    wanted = table.df.select(
        "source",
        F.explode(
            F.array(
                F.struct(F.col("cut").alias("key"), F.coalesce("fit", F.lit(0)).cast("long").alias("take")),
                F.struct(F.col("closing").alias("key"), F.lit(1).cast("long").alias("take")),
            )
        ).alias("x"),
    ).filter("x.key is not null")
    wanted = store(wanted.groupBy("source", "x.key").agg(F.sum("x.take").alias("take")).filter("take > 0"), "border")
    counted = _at_border(rows, wanted).filter("take is not null").groupBy("source", _key(), "take").agg(F.count(F.lit(1)).alias("n"))
    return store(counted, "border")


def _at_border(rows: DataFrame, border: Stored) -> DataFrame:
    side = border.df.withColumnsRenamed({"source": "__of", "key": "__key"})
    here = F.col("source").eqNullSafe(F.col("__of")) & _key().eqNullSafe(F.col("__key"))
    return rows.join(border.fits(side), here, "left").drop("__of", "__key")


def _joined(rows: DataFrame, table: Stored, source: str = "source") -> DataFrame:
    side = table.df.withColumnRenamed("source", "__of")
    return rows.join(table.fits(side), F.col(source).eqNullSafe(F.col("__of")), "left").drop("__of")


def plan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: str = SEED,
) -> tuple[Stored, Stored, DataFrame]:
    """The table of sources (size, target, scale, cut), the rows at its borders, and one narrow row per row of `docs`."""
    narrow = _narrow(docs, id_column, text, source, seed)
    sizes = store(narrow, "sizes").df
    sized = sizes.withColumn("g", preference(F.col("size")))
    targets = source_targets(sizes, weights, most)
    scales = store(source_scales(sized, targets, most), "scales")
    rows = _with_odds(_joined(sized, scales), most)
    cuts = store(pareto_cuts(rows, scales.df), "cuts")
    closing = store(closing_documents(rows, cuts), "closing")
    table = store(_joined(_joined(scales.df, cuts), closing), "mix")
    return table, _border_rows(rows, table), sizes


def _narrow(docs: DataFrame, id_column: str, text: str, source: str, seed: str, *more: Column) -> DataFrame:
    return docs.select(
        *more,
        F.col(id_column).alias("id"),
        F.col(source).cast("string").alias("source"),
        word_count(text).alias("size"),
        uniform(F.col(id_column), F.col(text), seed).alias("u"),
    )


def _copies(rows: DataFrame, table: Stored, border: Stored, most: int, order: list[Column]) -> DataFrame:
    """Adds `copies` to rows with id, source, size and u.

    Where only some of alike rows are taken, these rows are numbered in `order`, by a sort of just them.
    """
    kept = [*rows.columns, "source_size", "target", "copies"]
    rows = _with_odds(_joined(rows.withColumn("g", preference(F.col("size"))), table), most)
    rows = _at_border(rows, border)
    parted = F.coalesce(F.col("take") < F.col("n"), F.lit(False))
    whole = F.when(_before_cut() | F.coalesce(F.col("take") >= F.col("n"), F.lit(False)), 1).otherwise(0)
    told = rows.withColumn("copies", F.col("whole") + whole)
    if border.df.filter("take < n").isEmpty():
        return told.select(kept)
    numbered = cut_lineage(
        dense_codes(
            told.filter(parted).select(*kept, _key(), "take"), [F.asc_nulls_first("source"), F.asc("key"), *order], "__code"
        )
    )
    # At most two rows per source.
    first = numbered.groupBy("source", "key").agg(F.min("__code").alias("__first"))
    first = border.fits(first.withColumnsRenamed({"source": "__of", "key": "__key"}))
    here = F.col("source").eqNullSafe(F.col("__of")) & F.col("key").eqNullSafe(F.col("__key"))
    more = F.when(F.col("__code") - F.col("__first") < F.col("take"), 1).otherwise(0)
    some = numbered.join(first, here).withColumn("copies", F.col("copies") + more)
    return told.filter(~parted).select(kept).unionByName(some.select(kept))


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: str = SEED,
) -> DataFrame:
    """(id, size, source_size, target, taken, copies), one row per row of `docs`."""
    table, border, sizes = plan(docs, id_column, text, source, weights, most, seed)
    return _copies(sizes, table, border, most, []).select(
        F.col("id").alias(id_column),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
    )


def mixed_rows(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: str = SEED,
) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken. Only tables of sources are joined to the texts."""
    table, border, _ = plan(docs, id_column, text, source, weights, most, seed)
    rows = _narrow(docs, id_column, text, source, seed, F.struct("*").alias("__doc"))
    copied = _copies(rows, table, border, most, [F.to_json("__doc")]).filter("copies > 0")
    return copied.select("__doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__doc.*")
