"""Ordered windows per key.

Functions return columns; all use one window specification per key, so a chain of them needs one exchange and one sort. A key is
a column or several; ``operators.blocks`` runs such a chain in blocks of long keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import EPS, divided, guarded, no_nan
from .blocks import running

#: Rows of a block of the exponential average, in spans.
REACH = 32


#: A column's name, or several.
Key = str | list[str]


def names(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def by_key(key: Key = "stk") -> WindowSpec:
    return Window.partitionBy(*names(key)).orderBy("i")


def rows(back: int | None, key: Key = "stk", upto: int = 0) -> WindowSpec:
    """From ``back`` rows before (None: the first) up to the current row."""
    return by_key(key).rowsBetween(Window.unboundedPreceding if back is None else -back, upto)


def returns(p: Column, key: Key = "stk") -> Column:
    """Simple return, 0 in the first row, the divisor guarded."""
    before = F.lag(p).over(by_key(key))
    # greatest() skips nulls, so the first row is told apart
    return F.when(before.isNull(), 0.0).otherwise(p / guarded(before) - 1)


def target(p: Column, key: Key = "stk") -> Column:
    """Simple return, 0 in the first row, with IEEE division."""
    return F.coalesce(divided(p, F.lag(p).over(by_key(key))) - 1, F.lit(0.0))


def mean(x: Column, w: int, key: Key = "stk") -> Column:
    """Mean of the last w rows, fewer at the start."""
    return F.avg(x).over(rows(w - 1, key))


def std(x: Column, w: int, key: Key = "stk") -> Column:
    """Population standard deviation of the last w rows."""
    return F.stddev_pop(x).over(rows(w - 1, key))


def mean_through(x: Column, h: int = 20, key: Key = "stk") -> Column:
    """Mean of h + 1 rows, those h before and the current one; NaN is skipped."""
    return F.avg(no_nan(x)).over(rows(h, key))


def growth(x: Column, key: Key = "stk") -> Column:
    """Growth since the first row."""
    return x / F.first(x).over(rows(None, key)) - 1


def acceleration(x: Column, h: int = 5, key: Key = "stk") -> Column:
    """Growth over h rows, in the first h rows since the first; IEEE division."""
    return divided(x, F.coalesce(F.lag(x, h).over(by_key(key)), F.first(x).over(rows(None, key)))) - 1


def lagged(x: Column, k: int, key: Key = "stk") -> Column:
    return F.coalesce(F.lag(x, k).over(by_key(key)), F.lit(0.0))


def difference(x: Column, key: Key = "stk") -> Column:
    return F.coalesce(x - F.lag(x).over(by_key(key)), F.lit(0.0))


def zscore(x: Column, m: Column, s: Column) -> Column:
    """(x - m) / s; 0 where the window does not vary."""
    return F.when(s <= EPS, 0.0).otherwise((x - m) / (s + EPS))


def rsi(p: Column, w: int = 14, key: Key = "stk") -> Column:
    """Relative strength from simple means of gains and losses. ``p`` must be a stored column's difference."""
    up, down = F.when(p > 0, p).otherwise(0.0), F.when(p < 0, -p).otherwise(0.0)
    return 100 - 100 / (1 + mean(up, w, key) / (mean(down, w, key) + EPS))


def obv(d: Column, v: Column, key: Key = "stk") -> Column:
    """Running sum of volume signed by the price difference d; it starts at 0."""
    return F.sum(F.when(F.col("i") > 0, F.signum(d) * v).otherwise(0.0)).over(rows(None, key))


def expanding_std(x: Column, warm: int, key: Key = "stk") -> Column:
    """Population standard deviation of all rows from ``warm`` on."""
    return F.stddev_pop(F.when(F.col("i") >= warm, x)).over(rows(None, key)) + EPS


def ema(df: DataFrame, x: str, span: int, out: str, key: Key = "stk") -> DataFrame:
    """Exponential average with weight a = 2 / (span + 1), seeded with the first value.

    Rows are dealt into blocks of REACH * (span + 1). Within a block the recurrence is a running sum of x times (1 - a)^-k, at most
    e^(2.2 REACH) there; of the rows before, the last value of the block before is carried. What lies further back has a weight
    below e^(-2 REACH), far under the rounding of doubles."""
    a = 2.0 / (span + 1)
    if span <= 1:
        return df.withColumn(out, F.col(x))
    q, size = 1.0 - a, REACH * (span + 1)
    at = F.col("i") % size
    start = F.when(F.col("i") == 0, 1.0).otherwise(a)
    block = Window.partitionBy(*names(key), "_block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_block", (F.col("i") / size).cast("int"))
    df = df.withColumn("_own", F.pow(F.lit(q), at) * F.sum(start * F.col(x) * F.pow(F.lit(q), -at)).over(block))
    end = F.last(F.when(at == size - 1, F.col("_own")), ignorenulls=True).over(rows(None, key, -1))
    return df.withColumn(out, F.col("_own") + F.coalesce(end, F.lit(0.0)) * F.pow(F.lit(q), at + 1)).drop("_block", "_own")


# The same as frames, for keys of any length: what runs from the first row is scanned over blocks.


def with_growth(df: DataFrame, key: str = "stk", **of: str) -> DataFrame:
    """df with growth since the first value, by name of the new column and of its source."""
    found = running(df, [key], "i", {f"_1_{out}": ("first", x) for out, x in of.items()})
    return found.select(*df.columns, *((F.col(x) / F.col(f"_1_{out}") - 1).alias(out) for out, x in of.items()))


def with_obv(df: DataFrame, d: str, v: str, out: str, key: str = "stk") -> DataFrame:
    signed = df.withColumn("_s", F.when(F.col("i") > 0, F.signum(d) * F.col(v)).otherwise(0.0))
    return running(signed, [key], "i", {out: ("sum", "_s")}).drop("_s")


def with_expanding_std(df: DataFrame, x: str, warm: int, out: str, key: str = "stk") -> DataFrame:
    """``expanding_std`` from sums about the first value, so that a mean far from 0 costs no digits."""
    x0 = F.when(F.col("i") >= warm, F.col(x))
    moved = running(df.withColumn("_x", x0), [key], "i", {"_0": ("first", "_x")}).withColumn("_x", F.col("_x") - F.col("_0"))
    moved = moved.withColumns({"_n": F.when(F.col("_x").isNotNull(), 1.0).otherwise(0.0), "_x": F.coalesce("_x", F.lit(0.0))}).withColumn("_xx", F.col("_x") * F.col("_x"))
    found = running(moved, [key], "i", {"_sn": ("sum", "_n"), "_s": ("sum", "_x"), "_ss": ("sum", "_xx")})
    mean = F.col("_s") / F.col("_sn")
    std = F.when(F.col("_sn") > 0, F.sqrt(F.greatest(F.col("_ss") / F.col("_sn") - mean * mean, F.lit(0.0))))
    return found.select(*df.columns, (std + EPS).alias(out))
