"""Numbers, text and clocks as built-in column expressions.

Rounding is half-up on the scaled value (``floor(x * 10^d + 0.5) / 10^d``): the
one rule that gives the same digits on every engine we compare with.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int = 2) -> Column:
    scale = 10.0**digits
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def ratio(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    """``round(a / b)``; null where the divisor is zero or null."""
    return rounded(F.try_divide(numerator.cast("double"), denominator.cast("double")), digits)


def centis(seconds: Column) -> Column:
    """Two-decimal seconds as an exact integer count of hundredths."""
    return F.floor(seconds * F.lit(100.0) + F.lit(0.5)).cast("long")


def div(a: Column, b: int) -> Column:
    """Floor division by a positive constant."""
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long")


def millis_to_seconds(millis: Column) -> Column:
    """Whole milliseconds as two-decimal seconds, half-up on integers."""
    return div(millis + 5, 10) / F.lit(100.0)


def seconds_between(start: Column, end: Column) -> Column:
    """Difference of two-decimal seconds without floating-point residue."""
    return (centis(end) - centis(start)) / F.lit(100.0)


def plain_seconds(seconds: Column) -> Column:
    """Shortest decimal text of two-decimal seconds: ``3.0``, ``12.5``, ``0.07``."""
    cs = centis(F.abs(seconds))
    frac = F.pmod(cs, F.lit(100))
    text = F.concat(
        div(cs, 100).cast("string"),
        F.lit("."),
        F.when(F.pmod(frac, F.lit(10)) == 0, div(frac, 10).cast("string")).otherwise(
            F.lpad(frac.cast("string"), 2, "0")
        ),
    )
    return F.when(seconds < 0, F.concat(F.lit("-"), text)).otherwise(text)


def fixed1(seconds: Column) -> Column:
    """One decimal place, half-up, from two-decimal seconds."""
    tenths = div(centis(seconds) + 5, 10)
    return F.concat(div(tenths, 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))


def fixed0(seconds: Column) -> Column:
    """No decimals, half-up."""
    return F.floor(seconds + F.lit(0.5)).cast("long").cast("string")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))
