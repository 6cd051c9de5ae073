"""Column functions with the numeric conventions of the engine: a NaN is a missing value for quantiles, a feature that is not finite is 0, and division never raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the guard of divisors and logarithms.
EPS = 1e-12


def guarded(x: Column) -> Column:
    """At least EPS."""
    return F.greatest(x, F.lit(EPS))


def clip(x: Column, c: float) -> Column:
    return F.least(F.greatest(x, F.lit(-c)), F.lit(c))


def finite(x: Column) -> Column:
    """Missing, NaN and infinite values as 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def no_nan(x: Column) -> Column:
    """NaN as null, which quantiles and means skip; infinities stay."""
    return F.when(F.isnan(x), None).otherwise(x)


def divided(a: Column, b: Column) -> Column:
    """IEEE division: infinite or NaN where the divisor is 0."""
    inf = F.lit(float("inf"))
    return F.when(b != 0, F.try_divide(a, b)).when(b == 0, F.when(a > 0, inf).when(a < 0, -inf).otherwise(F.lit(float("nan"))))


def log_volume(v: Column) -> Column:
    return F.log(F.greatest(v, F.lit(1.0)))


def signed_root(x: Column) -> Column:
    """The fourth root with the sign kept; ``power(x, 0.25)`` is NaN for negatives."""
    return F.signum(x) * F.power(F.abs(x), F.lit(0.25))


def ratio(w: Column, g: Column, least: float = 1e-9) -> Column:
    """w / g, null where g is nearly 0."""
    return F.when(F.abs(g) >= least, F.try_divide(w, g))


def cap(x: Column, most: Column) -> Column:
    """x with its size limited to ``most``, its sign kept."""
    return F.signum(x) * F.least(F.abs(x), most)


def natural_key(name: Column) -> Column:
    """The digits of a name as a number; 0 without digits."""
    return F.coalesce(F.regexp_replace(name, "[^0-9]", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def padded(text: Column, width: int) -> Column:
    """Left-aligned to a width; longer text is kept."""
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))


def number(x: Column, digits: int = 5, sign: bool = False) -> Column:
    return F.format_string(f"%{'+' if sign else ''}.{digits}f", x)
