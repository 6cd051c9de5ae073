"""Tables behind exploratory plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import no_nan, ratio, signed_root
from ..session import kept
from . import windows as W
from .blocks import ROWS, in_blocks
from .score import quantiles


def growth_view(bars: DataFrame, h: int = 20, key: str = "stk", block: int = ROWS) -> DataFrame:
    """g (growth), ma_g (its mean), diff = g - ma_g, acc (acceleration of ma_g), w (signed root of volume growth, smoothed; 0 where that is nothing but rounding), w_g = w / g."""
    grown = W.with_growth(bars.select(key, "i", "p", "v"), key, g="p", gv="v")
    return in_blocks(grown, lambda df, keys: _smoothed(df, h, keys), [key], "i", h + 6, block=block)


def _smoothed(df: DataFrame, h: int, key: list[str]) -> DataFrame:
    c = F.col
    df = df.withColumns({"ma_g": W.mean_through(c("g"), h, key), "wm": W.mean_through(c("gv"), h, key)})
    df = df.withColumns({"diff": c("g") - c("ma_g"), "acc": W.acceleration(c("ma_g"), 5, key), "w": F.when(F.abs(c("wm")) < 1e-9, 0.0).otherwise(signed_root(c("wm")))})
    return df.select(*key, "i", "g", "ma_g", "diff", "acc", "w", ratio(c("w"), c("g")).alias("w_g"))


def usable(x: str):
    return no_nan(F.when(F.abs(F.col(x)) < float("inf"), F.col(x)))


def panel_table(bars: DataFrame, skip: int = 50, least: int = 60, key: str = "stk") -> DataFrame:
    """Per key: n, the correlation of diff and acc after the first ``skip`` rows (null for keys of at most ``least`` rows), that of g and w over all rows, final growth, deviation of diff."""
    g = growth_view(bars, key=key)
    later = lambda x: F.when(F.col("i") >= skip, usable(x))
    late = F.when(F.count(F.lit(1)) > least, F.corr(later("diff"), later("acc")))
    return g.groupBy(key).agg(F.count(F.lit(1)).alias("n"), late.alias("corr_diff_acc"), F.corr(usable("g"), usable("w")).alias("corr_g_w"), F.max_by("g", "i").alias("g_end"), F.stddev_pop("diff").alias("vol_diff"))


def medians(table: DataFrame, columns: tuple[str, ...] = ("corr_diff_acc", "corr_g_w")) -> DataFrame:
    """One row: the exact median of each column over the keys, nulls and NaN left out."""
    whole = quantiles(kept(table.select(F.lit(0).alias("_one"), *columns)), ["_one"], list(columns), [0.5])
    # without keys, or with nulls only, there is a row of nulls
    return whole.agg(*(F.max(F.col(c)[0]).alias(c) for c in columns))


def _buckets(df: DataFrame, y: str, buckets: int, key: str) -> DataFrame:
    """With ``bucket``: equal stretches of each key's rows (i from 0, without gaps); the counts come by a join, which splits hot keys."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return df.select(key, "i", y).join(n, key).withColumn("bucket", F.floor(F.col("i") * F.lit(buckets).cast("long") / F.col("_n")).cast("int"))


def extremes(df: DataFrame, y: str, points: int, key: str = "stk") -> DataFrame:
    """key, i, y of at most ``points`` rows of a key: the lowest and the highest of each of points / 2 equal stretches, of equal ones the first.

    Stretches are summed up where their rows are, so what moves is two rows for each of a task's stretches, however long a key is."""
    row = F.struct("i", y)
    found = _buckets(df, y, points // 2, key).groupBy(key, "bucket").agg(F.min_by(row, F.struct(y, "i")).alias("low"), F.max_by(row, F.struct(F.col(y), -F.col("i"))).alias("high"))
    return found.select(key, F.explode(F.array_distinct(F.array("low", "high"))).alias("r")).select(key, "r.i", f"r.{y}")


def triangles(df: DataFrame, y: str, points: int, key: str = "stk") -> DataFrame:
    """key, i, y of at most ``points`` rows of a key: of each stretch the row that spans the largest triangle with the means of the stretches beside it; at the ends with the first or the last row itself."""
    rows = _buckets(df, y, points, key)
    means = rows.groupBy(key, "bucket").agg(F.avg("i").alias("x"), F.avg(y).alias("m"), F.min("i").alias("first"), F.max("i").alias("last"), F.min_by(y, "i").alias("y0"), F.max_by(y, "i").alias("y1"))
    w = W.Window.partitionBy(key).orderBy("bucket")
    # a row for each stretch: as many as there are points
    beside = lambda f, c, own: F.coalesce(f(c).over(w), F.col(own).cast("double"))
    sides = means.select(key, "bucket", beside(F.lag, "x", "first").alias("xa"), beside(F.lag, "m", "y0").alias("ya"), beside(F.lead, "x", "last").alias("xb"), beside(F.lead, "m", "y1").alias("yb"))
    area = F.abs((F.col("xa") - F.col("xb")) * (F.col(y) - F.col("ya")) - (F.col("xa") - F.col("i")) * (F.col("yb") - F.col("ya")))
    best = rows.join(sides, [key, "bucket"]).groupBy(key, "bucket").agg(F.max_by(F.struct("i", y), F.struct(area, -F.col("i"))).alias("r"))
    return best.select(key, "r.i", f"r.{y}")
