"""Causal feature rows of price and volume series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import EPS, finite, guarded, log_volume
from . import windows as W
from .blocks import ROWS, in_blocks

NAMES = [f"f{k:02d}" for k in range(18)]
NAMES5 = [f"x{k}" for k in range(1, 6)]
#: Rows that the features of a row reach back: 70 by their windows, and what the exponential averages still weigh (after 1,024 rows less
#: than e^-75). The volume balance enters by its distance from its own mean only, so it may start anywhere.
HALO = 1_100


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, key: W.Key = "stk") -> DataFrame:
    """With ema_fast, ema_slow, macd and macd_hist (the part above its own average, relative to the price)."""
    df = W.ema(W.ema(bars, "p", fast, "ema_fast", key), "p", slow, "ema_slow", key)
    df = W.ema(df.withColumn("macd", F.col("ema_fast") - F.col("ema_slow")), "macd", signal, "macd_sig", key)
    return df.withColumn("macd_hist", (F.col("macd") - F.col("macd_sig")) / guarded(F.col("p"))).drop("macd_sig")


def features(bars: DataFrame, key: str = "stk", block: int = ROWS) -> DataFrame:
    """key, i, p, r, vol20 and the 18 features of each row, from that row and those before it; long keys in blocks."""
    return in_blocks(bars.select(key, "i", "p", "v"), features_of, [key], "i", HALO, block=block)


def features_of(bars: DataFrame, key: W.Key) -> DataFrame:
    """The same from whole keys."""
    c = F.col
    df = macd(bars.select(*W.names(key), "i", "p", "v"), key=key)
    df = df.withColumns({"r": W.returns(c("p"), key), "d": W.difference(c("p"), key), "lv": log_volume(c("v"))})
    df = df.withColumns({f"ma{w}": W.mean(c("p"), w, key) for w in (5, 10, 20, 50)} | {"vol5": W.std(c("r"), 5, key) + EPS, "vol20": W.std(c("r"), 20, key) + EPS, "lvm": W.mean(c("lv"), 20, key), "lvs": W.std(c("lv"), 20, key), "rsi": W.rsi(c("d"), 14, key), "obv": W.obv(c("d"), c("v"), key)})
    df = df.withColumns({"obm": W.mean(c("obv"), 20, key), "obs": W.std(c("obv"), 20, key), "vz": W.zscore(c("lv"), c("lvm"), c("lvs"))})
    over = lambda a, b: a / guarded(b) - 1
    each = [
        c("r"), W.lagged(c("r"), 1, key), W.lagged(c("r"), 2, key), c("r") / c("vol20"),
        over(c("p"), c("ma5")), over(c("p"), c("ma10")), over(c("p"), c("ma20")), over(c("p"), c("ma50")), over(c("ma5"), c("ma20")), over(c("ma10"), c("ma50")),
        c("vol5") / c("vol20") - 1, F.log(c("vol20") + EPS), c("vz"), W.difference(c("lv"), key),
        c("rsi") / 100 - 0.5, c("macd_hist"), W.zscore(c("obv"), c("obm"), c("obs")), c("r") * c("vz"),
    ]
    return df.select(*W.names(key), "i", "p", "r", "vol20", *(finite(x).alias(n) for n, x in zip(NAMES, each, strict=True)))


def features5(bars: DataFrame, h: int = 5, key: str = "stk", block: int = ROWS) -> DataFrame:
    """key, i, p, r and the five features of the first model; its long frame has h + 1 rows, its short one six."""
    return in_blocks(bars.select(key, "i", "p", "v"), lambda df, keys: _five(df, h, keys), [key], "i", max(h, 5) + 1, block=block)


def _five(bars: DataFrame, h: int, key: list[str]) -> DataFrame:
    c = F.col
    df = bars.withColumns({"r": W.returns(c("p"), key), "m5": W.mean_through(c("p"), 5, key), "mh": W.mean_through(c("p"), h, key), "vm": W.mean_through(c("v"), h, key)})
    x3 = F.log(guarded(c("v")) / guarded(c("vm")))
    each = [c("r"), c("p") / guarded(c("m5")) - 1, c("p") / guarded(c("mh")) - 1, x3, c("r") * x3]
    return df.select(*key, "i", "p", "r", *(finite(x).alias(n) for n, x in zip(NAMES5, each, strict=True)))
