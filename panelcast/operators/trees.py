"""Walk-forward boosted trees on absolute loss, in numpy.

At row t = warm, warm + refit, ... a model is fitted on pairs (features of row k, return of row k + 1), k < t, and scores the rows
t .. t + refit - 1. Features are binned by quantiles of the training rows (at most ``BINS``). Trees grow by the signs of the
residuals, best split first, up to ``depth`` levels and ``leaves`` leaves; a leaf's value is the median residual of its rows. Every
tree draws a share ``PART`` of the features, and every ``FREQ`` trees a share ``PART`` of the rows.

The fits are independent, so they are dealt to tasks: per key in ``SPLIT`` groups, pooled in a group per fit and model. A pooled fit
has as many models as its training rows fill ``SHARE`` times: each training row is learnt by one of them, by a hash of key and
position, and each forecast is the mean of ``VOTES`` of them (of all, if there are fewer). So no task has more than about ``SHARE``
training rows, no row is left out, and a fit of up to ``SHARE`` rows is one model. The rows of a block are repeated for each later fit."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clip
from . import windows as W
from .blocks import in_blocks
from .features import NAMES

BINS, PART, FREQ, SPLIT = 255, 0.8, 5, 8
SHARE, VOTES = 1 << 18, 4
#: What a sign weighs where it is counted with the rows; more than twice the rows of a fit.
SIGN = 2.0**26
#: At most so many partitions of fits; further ones share these.
TASKS = 1 << 16


def binned(x: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, int]:
    """Codes (features, rows of x, then of new) and how many a feature has at most; a bin holds three rows or more."""
    bins = max(2, min(BINS, len(x) // 3))
    at = np.linspace(0, 1, bins + 1)[1:-1]
    both = np.concatenate([x, new])
    return np.stack([np.searchsorted(np.unique(np.quantile(x[:, f], at)), both[:, f]) for f in range(x.shape[1])]), bins


def _last_split(gains: list[np.ndarray]) -> tuple[int, int]:
    """The (level, node) that best-first growth would split last."""
    heap, last = [(-gains[0][0], 0, 0)], (0, 0)
    while heap:
        _, level, node = heapq.heappop(heap)
        last = level, node
        if level + 1 < len(gains):
            for child in (2 * node, 2 * node + 1):
                if gains[level + 1][child] > 0:
                    heapq.heappush(heap, (-gains[level + 1][child], level + 1, child))
    return last


def _gains(count: np.ndarray, least: int) -> np.ndarray:
    """(nodes, features, bins) of what each split gains, from totals up to each bin of SIGN times the residuals' signs plus the rows; 0 where a side has fewer than ``least`` rows."""
    left = np.rint(count * (1 / SIGN))
    size = count - left * SIGN
    n_all, s_all = size[:, :1, -1:], left[:, :1, -1:].copy()
    other, right = n_all - size, s_all - left
    few = np.minimum(size, other) < max(least, 1)
    left *= left
    right *= right
    with np.errstate(divide="ignore", invalid="ignore"):
        left /= size
        right /= other
    left += right
    left -= s_all**2 / np.maximum(n_all, 1)
    left[few] = 0
    return left


def _median(v: np.ndarray) -> float:
    """np.median of finite values, without what it costs on few."""
    half = len(v) // 2
    if len(v) % 2:
        return np.partition(v, half)[half]
    low = np.partition(v, (half - 1, half))
    return (low[half - 1] + low[half]) / 2


def boosted(x: np.ndarray, y: np.ndarray, new: np.ndarray, rounds: int, rate: float, depth: int, leaves: int, least: int, seed: list[int]) -> np.ndarray:
    """Forecasts for the rows ``new`` by trees fitted on x and y."""
    if leaves < (1 << depth) - 1:
        raise ValueError("of a full tree, one split at most can be left out")
    g = np.random.default_rng(seed)
    n, d = x.shape
    if n > SIGN / 2:
        raise ValueError("rows and signs of one fit are no longer told from each other")
    codes, bins = binned(x, new)
    every, own = np.arange(n + len(new)), np.arange(n)
    score = np.full(n + len(new), np.median(y))
    drawn = max(1, round(PART * d))
    for turn in range(rounds):
        if turn % FREQ == 0:
            own = np.sort(g.choice(n, max(1, round(PART * n)), replace=False))
            mine = codes[:, own]
        chosen = np.sort(g.choice(d, drawn, replace=False))
        keys = mine[chosen] + (np.arange(drawn) * bins)[:, None]
        rest = y[own] - score[own]
        # rows and signs are counted together; both are whole numbers, so their sum is exact
        both = np.broadcast_to(np.sign(rest) * SIGN + 1, keys.shape).ravel()
        node, gains = np.zeros(len(every), np.int64), []
        for level in range(depth):
            shape = (1 << level, drawn, bins)
            flat = (keys + node[own] * (drawn * bins)).ravel()
            gain = _gains(np.cumsum(np.bincount(flat, both, shape[0] * drawn * bins).reshape(shape), 2), least).reshape(shape[0], -1)
            best = gain.argmax(1)
            top = gain[np.arange(shape[0]), best]
            top = np.where(top > 1e-9, top, 0)
            # a node without a split passes all rows to its left child
            feature, cut = chosen[best // bins], np.where(top > 0, best % bins, bins)
            gains.append(top)
            node = 2 * node + (codes[feature[node], every] > cut[node])
        if sum(int((x > 0).sum()) for x in gains) >= leaves:
            level, at = _last_split(gains)
            low = at << (depth - level)
            node[(node >= low) & (node < low + (1 << (depth - level)))] = low
        # few bits: sorted by radix
        value, order = np.zeros(1 << depth), np.argsort(node[own].astype(np.uint16), kind="stable")
        ends = np.cumsum(np.bincount(node[own], minlength=1 << depth))
        for k, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends)):
            if b > a:
                value[k] = _median(rest[order[a:b]])
        score += rate * value[node]
    return score[n:]


def predict(feats: DataFrame, warm: int = 100, refit: int = 40, rounds: int = 300, rate: float = 0.02, depth: int = 4, least: int = 50, shrink: float = 0.10, most: float = 0.03, last_fit: int | None = None, seed: int = 7, key: str = "stk", leaves: int = 15, pooled: bool = True, share: int = SHARE) -> DataFrame:
    """key, i, p, raw, y_pred by the models of each refit over all keys of ``feats``, or with ``pooled`` off by one per key and refit.

    ``last_fit``: no refits after this row."""
    df = in_blocks(feats.select(key, "i", "p", "r", *NAMES), lambda df, keys: df.withColumn("label", F.lead("r").over(W.by_key(keys))), [key], "i", 0, 1).drop("r")
    out = df.where(F.col("i") < warm).select(key, "i", "p", F.lit(0.0).alias("raw"))
    longest = feats.agg(F.max("i")).first()[0]
    fits = [] if longest is None else [t for t in range(warm, longest + 1, refit) if last_fit is None or t <= last_fit]
    if fits:
        # the fit that scores a row, -1 before the first
        stage = F.when(F.col("i") < warm, -1).otherwise(F.least(F.floor((F.col("i") - warm) / refit), F.lit(len(fits) - 1))).cast("int")
        grown = {"rounds": rounds, "rate": rate, "depth": depth, "leaves": leaves, "least": least}
        fitted = _pooled if pooled else _per_key
        out = out.unionByName(fitted(df.withColumn("stage", stage), fits, grown, seed, key, share))
    return out.select(key, "i", "p", "raw", F.when(F.col("i") < warm, 0.0).otherwise(clip(F.col("raw") * shrink, most)).alias("y_pred"))


def _dealt(df: DataFrame, groups: int, by: list[str]) -> DataFrame:
    # a number of partitions of its own: each group is much work on few bytes, which adaptive execution would put together; four for a group, so that few share one
    return df.repartition(min(max(4 * groups, df.sparkSession.sparkContext.defaultParallelism * 4), TASKS), *by)


def _per_key(df: DataFrame, fits: list[int], grown: dict, seed: int, key: str, share: int) -> DataFrame:
    end, parts = len(fits) - 1, min(SPLIT, len(fits))
    # a part has the rows that its last fit learns from or scores
    each = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).where(end - (end - F.col("part")) % parts >= F.col("stage"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        i, stage, x, y, raw = pdf.i.to_numpy(), pdf.stage.to_numpy(), pdf[NAMES].to_numpy(), pdf.label.to_numpy(float), np.full(len(pdf), np.nan)
        for k in range(int(pdf.part.iloc[0]), end + 1, parts):
            new, old = stage == k, (i < fits[k]) & np.isfinite(y)
            if new.any():
                raw[new] = boosted(x[old], y[old], x[new], **grown, seed=[seed, k]) if old.any() else 0.0
        return pd.DataFrame({key: pdf[key], "i": pdf.i, "p": pdf.p, "raw": raw})[~np.isnan(raw)]

    return _dealt(each, parts * df.agg(F.approx_count_distinct(key)).first()[0], [key, "part"]).groupBy(key, "part").applyInPandas(run, f"{key} string, i int, p double, raw double")


def models_of(df: DataFrame, fits: list[int], share: int) -> list[int]:
    """How many models each fit has, by the rows before it that have a label; ``df`` has ``stage``."""
    known = {r.stage: r.n for r in df.where("label is not null").groupBy("stage").agg(F.count(F.lit(1)).alias("n")).collect()}
    out, rows = [], 0
    for k in range(len(fits)):
        rows += known.get(k - 1, 0)
        out.append(max(1, math.ceil(rows / share)))
    return out


def _pooled(df: DataFrame, fits: list[int], grown: dict, seed: int, key: str, share: int) -> DataFrame:
    many = models_of(df, fits, share)
    each = df.withColumn("fit", F.explode(F.sequence(F.greatest("stage", F.lit(0)), F.lit(len(fits) - 1)))).where("fit = stage or label is not null")
    split = max(many) > 1
    if split:
        each = each.join(df.sparkSession.createDataFrame(list(enumerate(many)), "fit int, models int"), "fit")
    else:
        each = each.withColumn("models", F.lit(1))
    at = F.xxhash64(key, "i")
    votes = F.when(F.col("fit") == F.col("stage"), F.least("models", F.lit(VOTES))).otherwise(1)
    each = each.withColumn("model", F.explode(F.transform(F.sequence(F.lit(0), votes - 1), lambda j: F.pmod(F.pmod(at, F.col("models")) + j, F.col("models")).cast("int"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "i"])
        k, y, new = int(pdf.fit.iloc[0]), pdf.label.to_numpy(float), (pdf.stage == pdf.fit).to_numpy()
        old, scored = ~new & np.isfinite(y), pdf[new]
        own = [seed, k, int(pdf.model.iloc[0])] if pdf.models.iloc[0] > 1 else [seed, k]
        x = pdf[NAMES].to_numpy()
        raw = 0.0
        if new.any() and old.any():
            raw = boosted(x[old], y[old], x[new], **grown, seed=own)
        return pd.DataFrame({key: scored[key], "i": scored.i, "p": scored.p, "raw": raw})

    found = _dealt(each, sum(many), ["fit", "model"]).groupBy("fit", "model").applyInPandas(run, f"{key} string, i int, p double, raw double")
    return found.groupBy(key, "i").agg(F.first("p").alias("p"), F.avg("raw").alias("raw")) if split else found
