"""Predictors by name.

Each maps bars (stk, i, p, v) to (stk, i, p, y_pred); y_pred of row i forecasts the return of row i + 1 from rows up to i. A
method of one's own registers with ``method``; one written for a single series goes through ``per_series``."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cap, clip, guarded
from ..operators import ridge, trees
from ..operators import windows as W
from ..operators.blocks import in_blocks
from ..operators.features import features, features5
from ..operators.score import evaluate_forecasts, swept
from ..sources import with_ends

Predictor = Callable[[DataFrame], DataFrame]
METHODS: dict[str, Predictor] = {}
BASE = ridge.Plan()


def method(name: str):
    def put(f: Predictor) -> Predictor:
        METHODS[name] = f
        return f

    return put


def per_series(fn: Callable[[np.ndarray, np.ndarray], np.ndarray], key: str = "stk") -> Predictor:
    """A predictor from a function of one series' prices and volumes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        return pd.DataFrame({key: pdf[key], "i": pdf.i, "p": pdf.p, "y_pred": np.asarray(fn(pdf.p.to_numpy(float), pdf.v.to_numpy(float)), float)})

    return lambda bars: bars.select(key, "i", "p", "v").groupBy(key).applyInPandas(run, f"{key} string, i int, p double, y_pred double")


@method("zero")
def zero(bars: DataFrame) -> DataFrame:
    return bars.select("stk", "i", "p", F.lit(0.0).alias("y_pred"))


@method("ma_reversion")
def ma_reversion(bars: DataFrame, h: int = 5, most: float = 0.07) -> DataFrame:
    """Towards the mean of h + 1 rows."""
    reverted = lambda df, keys: df.select(*keys, "i", "p", clip(F.avg("p").over(W.rows(h, keys)) / guarded(F.col("p")) - 1, most).alias("y_pred"))
    return in_blocks(bars.select("stk", "i", "p"), reverted, ["stk"], "i", h)


@method("online5")
def online5(bars: DataFrame) -> DataFrame:
    return ridge.online5(features5(bars))


#: The parameter sets of the ridge family.
PLANS = {
    "baseline_v2": BASE, "submitted": BASE.with_(clip=0.02), "tight": BASE.with_(shrink=0.05, clip=0.015),
    "roll80": BASE.with_(win=80), "roll120": BASE.with_(win=120), "roll252": BASE.with_(win=252), "roll504": BASE.with_(win=504),
    "vol_0.10": BASE.with_(ratio=0.10), "vol_0.20": BASE.with_(ratio=0.20), "clipy": BASE.with_(y_clip=0.05),
    "all_0.10": BASE.with_(win=120, y_clip=0.05, ratio=0.10), "all_0.20": BASE.with_(win=120, y_clip=0.05, ratio=0.20),
}
POOLED = BASE.with_(refit=20)


def ridge_method(name: str, plan: ridge.Plan) -> None:
    METHODS[name] = lambda bars: ridge.predict(bars, plan)


for _name, _plan in PLANS.items():
    ridge_method(_name, _plan)


@method("pooled_ridge")
def pooled_ridge(bars: DataFrame) -> DataFrame:
    return ridge.predict_pooled(features(bars), POOLED)


@method("half_blend")
def half_blend(bars: DataFrame) -> DataFrame:
    return METHODS["baseline_v2"](bars).withColumn("y_pred", 0.5 * F.col("y_pred"))


@method("sign_conservative")
def sign_conservative(bars: DataFrame, share: float = 0.3) -> DataFrame:
    """The base forecast, at most a share of volatility in size."""
    made = ridge.predict_many(bars, {"base": BASE})
    return made.select("stk", "i", "p", cap(F.col("y_pred"), share * F.col("vol20")).alias("y_pred"))


@method("gbt_pooled")
def gbt_pooled(bars: DataFrame, **changes) -> DataFrame:
    return trees.predict(features(bars), **changes)


@method("gbt")
def gbt(bars: DataFrame, **changes) -> DataFrame:
    """Trees on each key alone."""
    return trees.predict(features(bars), **{"warm": 100, "refit": 20, "rounds": 200, "rate": 0.01, "depth": 3, "leaves": 8, "least": 20, "pooled": False} | changes)


def rescaled(pred: DataFrame, old: float, new: float, most: float = 0.03) -> DataFrame:
    """Forecasts of one shrinkage as those of another, without fitting again."""
    return pred.withColumn("y_pred", clip(F.col("y_pred") * (new / old), most))


def ensemble(a: DataFrame, b: DataFrame, alpha: float) -> DataFrame:
    """alpha * a + (1 - alpha) * b."""
    other = b.select("stk", "i", F.col("y_pred").alias("_b"))
    return a.join(other, ["stk", "i"]).select("stk", "i", "p", (alpha * F.col("y_pred") + (1 - alpha) * F.col("_b")).alias("y_pred"))


def with_target(pred: DataFrame, key: list[str] | None = None) -> DataFrame:
    return in_blocks(pred, lambda df, keys: df.withColumn("target", W.target(F.col("p"), keys)), key or ["stk"], "i", 1)


def ridge_family(bars: DataFrame, names: list[str]) -> DataFrame:
    """method, stk, i, p, y_pred of those methods that a ridge model per key gives, all from one pass over the features."""
    derived = [n for n in ("half_blend", "sign_conservative") if n in names]
    base = ["baseline_v2"] if derived else []
    many = ridge.predict_many(bars, {n: PLANS[n] for n in PLANS if n in [*names, *base]})
    y = F.col("y_pred")
    made = {"half_blend": 0.5 * y, "sign_conservative": cap(y, 0.3 * F.col("vol20"))}
    one = lambda n, v: F.struct(n.alias("method"), v.alias("y_pred"))
    each = F.when(F.col("method") == "baseline_v2", F.array(one(F.col("method"), y), *(one(F.lit(n), made[n]) for n in derived))).otherwise(F.array(one(F.col("method"), y)))
    return many.select("stk", "i", "p", F.explode(each).alias("m")).select("m.method", "stk", "i", "p", "m.y_pred").where(F.col("method").isin(*names))


def compare(bars: DataFrame, names: list[str]) -> DataFrame:
    """Scores per (method, stk) of several methods over the same bars."""
    family = [n for n in names if n in PLANS or n in ("half_blend", "sign_conservative")]
    out = ridge_family(bars, family) if family else None
    for n in (n for n in names if n not in family):
        own = METHODS[n](bars).select(F.lit(n).alias("method"), "stk", "i", "p", "y_pred")
        out = own if out is None else out.unionByName(own)
    return evaluate_forecasts(out, ["method", "stk"])


def shrink_sweep(pred: DataFrame, old: float, values: list[float], most: float = 0.03) -> DataFrame:
    """Scores per (shrink, stk): the forecasts are made once and rescaled for each value."""
    return swept(pred, "shrink", values, lambda v: F.least(F.greatest(F.col("y") * v / old, F.lit(-most)), F.lit(most)))


def tail_sweep(bars: DataFrame, lengths: list[int | None], predictor: Predictor) -> DataFrame:
    """Scores per (length, stk) on the last rows of each key; length 0 stands for all rows. Features start cold in each slice."""
    length = F.explode(F.array(*(F.lit(n or 0) for n in lengths))).alias("length")
    start = F.when(F.col("length") == 0, F.col("_first")).otherwise(F.greatest(F.col("_last") + 1 - F.col("length"), F.col("_first")))
    each = with_ends(bars.select("stk", "i", "p", "v")).select("*", length).where(F.col("i") >= start)
    each = each.withColumns({"key": F.concat_ws("|", F.col("length").cast("string"), "stk"), "i": (F.col("i") - start).cast("int")})
    pred = predictor(each.select(F.col("key").alias("stk"), "i", "p", "v"))
    scores = evaluate_forecasts(pred)
    return scores.select(F.split_part("stk", F.lit("|"), F.lit(1)).cast("int").alias("length"), F.split_part("stk", F.lit("|"), F.lit(2)).alias("stk"), "n", "base", "abs", "rel")
