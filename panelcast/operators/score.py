"""Scores of forecasts and their summaries over a panel."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import divided, natural_key, no_nan, number, padded
from ..session import kept
from . import windows as W
from .blocks import ROWS, in_blocks


def pairs(pred: DataFrame, key: list[str] | None = None, keep: tuple[str, ...] = (), block: int = ROWS) -> DataFrame:
    """key, i, f = the row's own return and y = the forecast of the row before, from the third row on, for forecasts (key, i, p, y_pred); ``keep``: further columns of the row before."""
    key = key or ["stk"]
    before = lambda c, keys: F.lag(c).over(W.by_key(keys))
    lagged = lambda df, keys: df.select(*keys, "i", W.target(F.col("p"), keys).alias("f"), before("y_pred", keys).alias("y"), *(before(c, keys).alias(c) for c in keep))
    return in_blocks(pred.select(*key, "i", "p", "y_pred", *keep), lagged, key, "i", 1, block=block).where("i >= 2")


def errors(pred: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Errors e = target - the forecast of the row before, and f = target, from the third row on.

    pred: stk, i, target, y_pred and further key columns (method, length)."""
    key = key or ["stk"]
    lagged = lambda df, keys: df.select(*keys, "i", (F.col("target") - F.lag("y_pred").over(W.by_key(keys))).alias("e"), F.col("target").alias("f"))
    return in_blocks(pred.select(*key, "i", "target", "y_pred"), lagged, key, "i", 1).where("i >= 2")


#: Histogram bins in an octave of values.
BINS = 256
#: Rows of a key up to which its values fit a buffer of a task, so that one aggregation sorts them.
FEW = 1 << 18


def _bin(x):
    """A whole number that does not fall as x rises; there are at most 2 * 2,200 * BINS of them."""
    high = F.floor(F.log2(F.abs(x)) * BINS) + 1_200 * BINS
    high = F.when(F.abs(x) == float("inf"), 2_300 * BINS).otherwise(high)
    return F.when(x == 0, 0).when(x > 0, high).otherwise(-high).cast("int")


def quantiles(df: DataFrame, keys: list[str], columns: list[str], qs: list[float], rows: str | None = None) -> DataFrame:
    """Per key, exact quantiles with linear interpolation of each column, as arrays by its name; nulls and NaN are skipped. ``rows``: a further column's name, for the number of rows of the key.

    ``df`` is read several times: keep it first. Keys of at most ``FEW`` rows have their values sorted in a buffer. If there is a
    larger one, the values of a key are counted in a logarithmic histogram, of bounded size whatever the key has; the bins that hold the wanted
    ranks are told from its running totals, and only these are put in order, a task having one bin. Equal values are summed up
    before they move. A column all of whose values are null has null."""
    count = F.count(F.lit(1))
    if (df.groupBy(*keys).agg(count.alias("n")).agg(F.max("n")).first()[0] or 0) <= FEW:
        at = F.array(*map(F.lit, qs))
        return df.groupBy(*keys).agg(*([count.alias(rows)] if rows else []), *(F.percentile(no_nan(F.col(c).cast("double")), at).alias(c) for c in columns)).select(*keys, *([rows] if rows else []), *columns)
    each = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias("c"), no_nan(F.col(c).cast("double")).alias("x")) for k, c in enumerate(columns)))).alias("s")).select(*keys, "s.*")
    by = [*keys, "c"]
    # 0 and -0 are one value; nulls are counted too, in a bin of their own
    counts = each.select(*by, (F.col("x") + 0.0).alias("x")).withColumn("bin", F.when(F.col("x").isNotNull(), _bin(F.col("x"))).otherwise(-(1 << 30))).groupBy(*by, "bin", "x").agg(F.count(F.lit(1)).alias("n"))
    whole = W.Window.partitionBy(*by)
    upto = whole.orderBy("bin").rowsBetween(W.Window.unboundedPreceding, 0)
    valid = F.when(F.col("bin") > -(1 << 30), F.col("n")).otherwise(0)
    bins = counts.groupBy(*by, "bin").agg(F.sum("n").alias("n")).withColumns({"upto": F.sum(valid).over(upto), "all": F.sum(valid).over(whole), "rows": F.sum("n").over(whole)}).withColumn("n", valid)
    place = [(F.col("all") - 1) * q for q in qs]
    ranks = F.array(*(f(p).cast("long") for p in place for f in (F.floor, F.ceil)))
    bins = bins.select(*by, "bin", "all", "rows", (F.col("upto") - F.col("n")).alias("first"), "upto").withColumn("ranks", ranks)
    wanted = F.exists("ranks", lambda r: (r >= F.col("first")) & (r < F.col("upto")))
    bins = bins.where(wanted | (F.col("all") == 0)).drop("upto")
    inside = W.Window.partitionBy(*by, "bin").orderBy("x").rowsBetween(W.Window.unboundedPreceding, 0)
    # a null key is a key
    bins = bins.withColumnsRenamed({b: f"_k_{b}" for b in [*by, "bin"]})
    equal = reduce(and_, (F.equal_null(F.col(b), F.col(f"_k_{b}")) for b in [*by, "bin"]))
    found = counts.join(bins, equal).withColumn("upto", F.col("first") + F.sum("n").over(inside))
    at = lambda k: F.max(F.when((F.get("ranks", F.lit(k)) < F.col("upto")) & (F.get("ranks", F.lit(k)) >= F.col("upto") - F.col("n")), F.col("x")))
    picked = found.groupBy(*by).agg(F.max("all").alias("all"), F.max("rows").alias("rows"), *(at(k).alias(f"v{k}") for k in range(2 * len(qs))))
    mixed = [F.when(F.col(f"v{2 * k}") == F.col(f"v{2 * k + 1}"), F.col(f"v{2 * k}")).otherwise(F.col(f"v{2 * k}") + (F.col(f"v{2 * k + 1}") - F.col(f"v{2 * k}")) * (p - F.floor(p))) for k, p in enumerate(place)]
    own = picked.select(*by, "rows", F.when(F.col("all") > 0, F.array(*mixed)).alias("q"))
    out = own.groupBy(*keys).agg(F.max("rows").alias("_rows"), *(F.max(F.when(F.col("c") == k, F.col("q"))).alias(c) for k, c in enumerate(columns)))
    return out.select(*keys, *([F.col("_rows").alias(rows)] if rows else []), *columns)


def evaluate(pred: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Per key: n samples, base and abs (median plus half the 90 % quantile of absolute values, exact), rel = 1 - abs / base (0 if base is 0)."""
    return scored(errors(pred, key), key or ["stk"])


def evaluate_forecasts(pred: DataFrame, key: list[str] | None = None, zero: float | None = 0.0) -> DataFrame:
    """The same for forecasts (key, i, p, y_pred), their targets being the returns of p. ``zero``: as in ``scored``."""
    return scored(pairs(pred, key).withColumn("e", F.col("f") - F.col("y")), key or ["stk"], zero)


def _size(c):
    return F.col(c)[0] + 0.5 * F.col(c)[1]


def scored(found: DataFrame, key: list[str], zero: float | None = 0.0) -> DataFrame:
    """``evaluate`` from errors e and targets f. ``zero``: rel where base is 0; None: the quotient there too, by IEEE rules."""
    out = quantiles(kept(found.select(*key, F.abs("e").alias("qe"), F.abs("f").alias("qf"))), key, ["qe", "qf"], [0.5, 0.9], "n")
    return _rated(out.select(*key, "n", _size("qf").alias("base"), _size("qe").alias("abs")), zero)


def _rated(out: DataFrame, zero: float | None = 0.0) -> DataFrame:
    quotient = 1 - F.try_divide(F.col("abs"), F.col("base")) if zero is not None else 1 - divided(F.col("abs"), F.col("base"))
    return out.withColumn("rel", quotient if zero is None else F.when(F.col("base") > 0, quotient).otherwise(zero))


def swept(pred: DataFrame, name: str, values: list[float], y: Callable, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores per (``name``, stk): forecasts (stk, i, p, y_pred) are made and shifted once; ``y(value)`` over y and ``keep`` is what each value makes of them."""
    found, f = kept(pairs(pred, None, keep)), F.col("f")
    # the targets themselves are one more set of values
    each = F.explode(F.array(F.struct(F.lit(None).cast("double").alias(name), F.abs(f).alias("q")), *(F.struct(F.lit(float(v)).alias(name), F.abs(f - y(F.lit(v))).alias("q")) for v in values))).alias("s")
    sizes = quantiles(found.select("stk", each).select("stk", "s.*"), ["stk", name], ["q"], [0.5, 0.9], "n")
    # a row per value and key from here on
    base = F.max(F.when(F.col(name).isNull(), _size("q"))).over(W.Window.partitionBy("stk"))
    return _rated(sizes.withColumn("base", base).where(F.col(name).isNotNull()).select(name, "stk", "n", "base", _size("q").alias("abs")))


def summary(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per method: median and mean of abs and rel, and the share of keys with rel > 0 in percent."""
    by, scores = by or ["method"], kept(scores)
    means = scores.groupBy(*by).agg(F.avg("abs").alias("mean_abs"), F.avg("rel").alias("mean_rel"), F.avg(F.when(F.col("rel") > 0, 100.0).otherwise(0.0)).alias("pct_rel_pos"))
    middle = quantiles(scores, by, ["abs", "rel"], [0.5]).select(*by, F.col("abs")[0].alias("median_abs"), F.col("rel")[0].alias("median_rel"))
    return means.join(middle, by, "left").select(*by, "median_abs", "mean_abs", "median_rel", "mean_rel", "pct_rel_pos")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded half to even, as result files hold them."""
    return df.select(*(F.bround(f"`{c}`", digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def against_baseline(summary_: DataFrame, baseline: str, round_first: bool = True) -> DataFrame:
    """With the differences of each method to one of them; from rounded values, or not."""
    s = rounded(summary_) if round_first else summary_
    # one row: its size is fixed
    base = F.broadcast(s.where(F.col("method") == baseline).limit(1).select(*(F.col(c).alias(f"_{c}") for c in s.columns if c != "method")))
    return s.join(base).select(*s.columns, *((F.col(c) - F.col(f"_{c}")).alias(f"d_{c}") for c in s.columns if c != "method"))


def wide(scores: DataFrame, methods: list[str]) -> DataFrame:
    """A row per key: abs_<method> and rel_<method>."""
    p = scores.groupBy("stk").pivot("method", methods).agg(F.first("abs").alias("abs"), F.first("rel").alias("rel"))
    return p.select("stk", *(F.col(f"`{m}_{v}`").alias(f"{v}_{m}") for m in methods for v in ("abs", "rel")))


def head_to_head(scores: DataFrame, a: str, b: str) -> DataFrame:
    """How many keys a beats b on, by rel, of how many."""
    w = scores.groupBy("stk").pivot("method", [a, b]).agg(F.first("rel"))
    return w.agg(F.count_if(F.col(f"`{a}`") > F.col(f"`{b}`")).alias("wins"), F.count_if(F.col(f"`{a}`") == F.col(f"`{b}`")).alias("ties"), F.count(F.lit(1)).alias("keys"))


def panel_stats(scores: DataFrame, columns: tuple[str, ...] = ("base", "abs", "rel")) -> DataFrame:
    """Per measure: mean, population deviation, minimum, maximum, median."""
    long = scores.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).alias("x")) for c in columns))).alias("s")).select("s.*")
    return long.groupBy("measure").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.median("x").alias("median"))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """bin (from 1), low, high, n of equal bins between the least and the largest value; the last one is closed. NaN is left out."""
    x = df.select(no_nan(F.col(column)).alias("x")).where("x is not null")
    ends = F.broadcast(x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.expr(f"width_bucket(x, lo, hi, {bins})"), F.lit(bins))).otherwise(F.lit(1))
    counted = x.join(ends).groupBy(at.cast("int").alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    step = (F.col("hi") - F.col("lo")) / bins
    return counted.select("bin", (F.col("lo") + step * (F.col("bin") - 1)).alias("low"), (F.col("lo") + step * F.col("bin")).alias("high"), "n")


def in_natural_order(df: DataFrame) -> DataFrame:
    """Keys by the number in their name, then by name."""
    return df.withColumn("order_key", natural_key(F.col("stk"))).orderBy("order_key", "stk")


class BatchEvaluator:
    """Scores of a batch of series given as rows (stk, i, y_true, y_pred)."""

    def __init__(self, data: DataFrame, title: str = "batch"):
        self.title = title
        self.scores = evaluate(data.withColumnRenamed("y_true", "target"))

    def to_frame(self) -> DataFrame:
        return in_natural_order(self.scores)

    def report(self) -> DataFrame:
        """Lines of text, one per key, in natural order."""
        cells = F.concat(padded(F.col("stk"), 12), padded(number(F.col("base")), 12), padded(number(F.col("abs")), 12), number(F.col("rel"), sign=True))
        return self.to_frame().select("order_key", "stk", cells.alias("line"))

    def print(self) -> None:
        """One row per key reaches the driver, as a console needs it."""
        print(self.title)
        self.report().select("line").show(1_000_000, truncate=False)


def write_results(scores: DataFrame, methods: list[str], folder: str) -> None:
    """The wide table per key, unrounded, and the summary, rounded, as CSV folders."""
    wide(scores, methods).write.mode("overwrite").csv(f"{folder}/per_key", header=True)
    rounded(summary(scores)).write.mode("overwrite").csv(f"{folder}/summary", header=True)
