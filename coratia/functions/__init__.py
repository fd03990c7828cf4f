"""Column expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Runs of letters of any script.
WORD = r"\p{L}+"


def words(text: Column, pattern: str = WORD) -> Column:
    """Lower-case words of a text, as an array."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def linear_hash(value: Column, a: int, b: int, modulus: int) -> Column:
    """(a * value + b) mod modulus, without overflow."""
    if modulus <= 1 << 31:
        small = F.pmod(value.cast("long"), F.lit(modulus).cast("long"))
        return F.pmod(F.lit(a % modulus).cast("long") * small + F.lit(b % modulus).cast("long"), F.lit(modulus).cast("long"))
    wide = F.lit(a).cast("decimal(19,0)") * value.cast("decimal(19,0)") + F.lit(b).cast("decimal(19,0)")
    return F.pmod(wide.cast("decimal(38,0)"), F.lit(modulus).cast("decimal(38,0)")).cast("long")


def jaccard(overlap: Column, size_1: Column, size_2: Column) -> Column:
    """Jaccard similarity from the overlap and the two set sizes."""
    return overlap / (size_1 + size_2 - overlap)


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def pearson_numerator(n: Column, sx: Column, sy: Column, sxy: Column) -> Column:
    """n times the co-variation; exact for ratings in whole, half or quarter stars."""
    return n * sxy - sx * sy


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson correlation from sums; NULL where either side does not vary."""
    spread = F.sqrt(n * sxx - sx * sx) * F.sqrt(n * syy - sy * sy)
    return F.try_divide(pearson_numerator(n, sx, sy, sxy), spread)
