"""Keys in blocks of a few rows against whole keys, and exact quantiles against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.operators import explore, ridge, score
from panelcast.operators import features as feats
from panelcast.operators import windows as W
from panelcast.operators.blocks import in_blocks, running
from panelcast.plans import registry as R


@pytest.fixture(scope="module")
def panel(spark):
    g = np.random.default_rng(4)
    rows = []
    for k, n in {"a": 420, "b": 61, "c": 1, "d": 60, "e": 200}.items():
        p = 50 * np.exp(np.cumsum(g.normal(0, 0.02, n)))
        rows += [(k, i, float(x), float(v)) for i, (x, v) in enumerate(zip(p, g.integers(1, 1000, n)))]
    g.shuffle(rows)
    return spark.createDataFrame([(k, int(i), float(p), float(v)) for k, i, p, v in rows], "stk string, i int, p double, v double").cache()


def by_row(df, key=("stk", "i")):
    pdf = df.toPandas().sort_values(list(key)).reset_index(drop=True)
    return pdf[sorted(pdf.columns)]


def same(a, b, key=("stk", "i"), rtol=1e-8, atol=1e-11):
    pd.testing.assert_frame_equal(by_row(a, key), by_row(b, key), check_dtype=False, rtol=rtol, atol=atol)


@pytest.mark.parametrize("block", [7, 100])
def test_features_in_blocks(panel, block):
    same(feats.features(panel, block=block), feats.features_of(panel, "stk"))
    same(feats.features5(panel, block=block), feats.features5(panel))
    same(explore.growth_view(panel, block=block), explore.growth_view(panel), rtol=1e-7)


@pytest.mark.parametrize("block", [20, 100])
def test_forecasts_in_blocks(panel, block):
    """Expanding, rolling, clipped and scaled models: the scan of moments and spreads equals the pass over the whole key."""
    got, want = ridge.predict_many(panel, R.PLANS, block=block), ridge.predict_many(panel, R.PLANS)
    assert got.count() == panel.count() * len(R.PLANS)
    same(got, want, ("method", "stk", "i"), rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("block", [1, 20, 70])
def test_online_forecasts_in_blocks(panel, block):
    """The scan of products equals a loop over whole keys that refits at every row."""
    rows = feats.features5(panel).toPandas().sort_values(["stk", "i"])
    want = []
    for k, own in rows.groupby("stk"):
        a = np.hstack([np.ones((len(own), 1)), own[feats.NAMES5].to_numpy()])
        g, b = np.diag([0.0] + [0.01] * 5), np.zeros(6)
        for t in range(len(a)):
            if t:
                g, b = g + np.outer(a[t - 1], a[t - 1]), b + a[t - 1] * own.r.iloc[t]
            want.append((k, t, a[t] @ np.linalg.solve(g, b) if t >= 30 else 0.5 * a[t, 1] - 0.5 * a[t, 2]))
    for size in (block, 65_520):
        got = by_row(ridge.online5(feats.features5(panel), block=size).select("stk", "i", "raw"))
        same_rows = pd.DataFrame(want, columns=["stk", "i", "raw"]).sort_values(["stk", "i"]).reset_index(drop=True)[["i", "raw", "stk"]]
        pd.testing.assert_frame_equal(got, same_rows, check_dtype=False, rtol=1e-6, atol=1e-9)


def test_forecasts_of_uneven_blocks_are_refused(panel):
    with pytest.raises(ValueError):
        ridge.predict(panel, ridge.Plan(refit=20), block=50)


def test_a_block_takes_no_other_blocks_rows(panel):
    """Each group that reaches Python has a block and its halo at most."""
    rows = in_blocks(panel, lambda df, keys: df.withColumn("n", F.count(F.lit(1)).over(W.Window.partitionBy(*keys))), ["stk"], "i", 10, 3, block=50)
    assert rows.count() == panel.count() and rows.agg(F.max("n")).first()[0] <= 50 + 10 + 3


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_running(panel, block):
    got = by_row(running(panel, ["stk"], "i", {"s": ("sum", "v"), "m": ("max", "v"), "f": ("first", "p")}, block))
    for _, own in got.groupby("stk"):
        assert np.allclose(own.s, own.v.cumsum()) and (own.m == own.v.cummax()).all() and (own.f == own.p.iloc[0]).all()


def test_running_after_nulls(spark):
    df = spark.createDataFrame([("a", i, None if i < 5 or i == 7 else float(i)) for i in range(12)], "stk string, i int, x double")
    got = by_row(running(df, ["stk"], "i", {"s": ("sum", "x"), "m": ("max", "x"), "f": ("first", "x")}, 2))
    assert got.s.isna().tolist() == got.f.isna().tolist() == [True] * 5 + [False] * 7
    assert got.s.dropna().tolist() == [5, 11, 11, 19, 28, 38, 49] and set(got.f.dropna()) == {5} and got.m.iloc[-1] == 11


def test_expanding_std_far_from_zero(spark):
    x = 1e6 + np.random.default_rng(1).normal(0, 1e-2, 300)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "stk string, i int, x double")
    got = by_row(W.with_expanding_std(df, "x", 60, "s"))
    assert got.s.isna().sum() == 60
    assert np.allclose(got.s[60:], [x[60 : k + 1].std() + 1e-12 for k in range(60, 300)], rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(score, "FEW", few)
    g = np.random.default_rng(2)
    sets = {"normal": g.normal(size=501), "ties": g.integers(0, 3, 200).astype(float), "one": np.array([3.5]), "two": np.array([-1.0, 4.0]), "wide": np.concatenate([g.normal(size=50) * 10.0 ** g.integers(-300, 300, 50), [0.0, -0.0, 5e-324, 1.7e308]]), "infinite": np.array([-np.inf, 1.0, np.inf, np.inf]), "near": 1 + g.normal(size=100) * 1e-15}
    rows = [(k, float(v), float(-v)) for k, x in sets.items() for v in x] + [("normal", float("nan"), None), ("none", None, None), ("half", 2.0, None), (None, 1.0, 3.0), (None, 2.0, 5.0)]
    qs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.stk: r for r in score.quantiles(spark.createDataFrame(rows, "stk string, x double, y double"), ["stk"], ["x", "y"], qs).collect()}
    assert set(got) == {*sets, "half", "none", None} and got[None].x[2] == 1.5 and got[None].y[4] == 5 and got["half"].y is None and got["half"].x == [2.0] * 5 and got["none"].x is None
    for k, x in sets.items():
        for name, sign in (("x", 1), ("y", -1)):
            with np.errstate(invalid="ignore"):
                want = np.quantile(sign * x, qs)
            ok = np.isfinite(want)
            assert np.allclose(np.array(got[k][name])[ok], want[ok], rtol=1e-12, atol=0), k


def test_zero_base(spark):
    df = spark.createDataFrame([("flat", i, 5.0, 0.1) for i in range(5)] + [("short", 0, 1.0, 0.0)], "stk string, i int, p double, y_pred double")
    assert [tuple(r) for r in score.evaluate_forecasts(df).collect()] == [("flat", 3, 0.0, pytest.approx(0.15), 0.0)]
    assert score.scored(score.pairs(df).withColumn("e", F.col("f") - F.col("y")), ["stk"], zero=None).first().rel == float("-inf")


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_sweeps_shift_once(panel, monkeypatch, few):
    """A sweep equals the scores of each value's own forecasts, and no window runs over its rows."""
    monkeypatch.setattr(score, "FEW", few)
    pred = R.METHODS["ma_reversion"](panel)
    got = R.shrink_sweep(pred, 1.0, [0.1, 0.5], 0.02)
    for v in (0.1, 0.5):
        own = pred.withColumn("y_pred", F.least(F.greatest(F.col("y_pred") * v / 1.0, F.lit(-0.02)), F.lit(0.02)))
        same(got.where(F.col("shrink") == v).drop("shrink"), score.evaluate_forecasts(own), ("stk",))
