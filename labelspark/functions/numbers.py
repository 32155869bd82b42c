"""Parsing of numbers that travel as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelspark.functions.text import let, norm, numeric_sequences

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def to_double(c: Column) -> Column:
    """Number or null. The pattern guard keeps out forms only the JVM parser knows."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def abv_float(c: Column) -> Column:
    return to_double(F.trim(F.regexp_replace(norm(c), r"%+$", "")))


def plausible_abv(c: Column) -> Column:
    return F.coalesce(abv_float(c).between(3.0, 75.0), F.lit(False))


# fixed values: millilitres per unit
UNIT_ML = [
    (r"ml", 1.0),
    (r"l", 1000.0),
    (r"(?:fl\.?\s*oz\.?|fluid\s+ounces?)", 29.5735),
    (r"(?:qt\.?|quart)", 946.353),
    (r"(?:pt\.?|pint)", 473.176),
    (r"(?:gal\.?|gallon)", 3785.41),
]


def net_ml(c: Column) -> Column:
    """Net contents in whole millilitres (half to even); a bare number is millilitres."""
    def body(s):
        amount = F.regexp_extract(s, r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
        out = F.when(s == "", F.lit(None).cast("double"))
        for unit, factor in UNIT_ML:
            out = out.when(
                s.rlike(rf"(?i)^\d+(?:\.\d+)?\s*{unit}\s*$"), amount * F.lit(factor)
            )
        return F.rint(out.otherwise(to_double(s))).cast("bigint")

    return let(numeric_sequences(norm(c)), body)


def percent(score: Column) -> Column:
    return F.concat(F.rint(score * 100).cast("int").cast("string"), F.lit("%"))
