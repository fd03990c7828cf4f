"""Dense integer codes for ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coratia.plans.lineage import cut_lineage

# monotonically_increasing_id keeps the row number in the lower 33 bits.
_ROW_BITS = 33


def dense_codes(values: DataFrame, order_by: list[Column], code: str = "code") -> DataFrame:
    """Number the rows 0 .. n-1 in the order of `order_by`, without a global window.

    A range-partitioned sort gives every partition a run of the order; adding
    the sizes of the runs before it makes the row numbers dense. The only
    single-task step runs over one row per partition.
    """
    placed = cut_lineage(values.orderBy(*order_by).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.select(
        *values.columns,
        F.shiftright("__at", _ROW_BITS).alias("__run"),
        F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("__row"),
    )
    before = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("__run")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__run", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    # One row per shuffle partition: the broadcast is bounded by the session's setting.
    return placed.join(F.broadcast(starts), "__run").select(
        *values.columns, (F.col("__start") + F.col("__row")).alias(code)
    )


def id_dictionary(df: DataFrame, columns: list[str], name: str = "id", code: str = "code") -> DataFrame:
    """(id, code): codes 0 .. n-1 for all distinct ids of the columns, sorted by id."""
    ids = reduce(
        DataFrame.unionByName, [df.select(F.col(c).alias(name)).distinct() for c in columns]
    )
    ids = ids.filter(F.col(name).isNotNull()).distinct()
    return dense_codes(ids, [F.asc(name)], code)


def encode_ids(df: DataFrame, columns: list[str], suffix: str = "_code") -> tuple[DataFrame, DataFrame]:
    """Add `<column>_code` for each column, all columns in one id space.

    Returns the extended rows and the (id, code) dictionary.
    """
    dictionary = id_dictionary(df, columns)
    for column in columns:
        named = dictionary.select(F.col("id").alias(column), F.col("code").alias(column + suffix))
        df = df.join(named, column)
    return df, dictionary


def decode_ids(df: DataFrame, dictionary: DataFrame, code: str, name: str) -> DataFrame:
    """Replace the column `code` by the id it stands for."""
    named = dictionary.select(F.col("code").alias(code), F.col("id").alias(name))
    return df.join(named, code).drop(code)
