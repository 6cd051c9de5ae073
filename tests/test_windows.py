"""Edge cases of windows and features, by hand-made series and plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast import functions as fn
from panelcast import sources
from panelcast.operators import features as feats
from panelcast.operators import windows as W

EPS = 1e-12


def bars(spark, series):
    rows = [(k, i, float(p), float(v)) for k, (ps, vs) in series.items() for i, (p, v) in enumerate(zip(ps, vs))]
    return spark.createDataFrame(rows, "stk string, i int, p double, v double")


def collected(df, col, key="a"):
    return [r[col] for r in sorted((r for r in df.collect() if r.stk == key), key=lambda r: r.i)]


def walk(n, seed=0):
    g = np.random.default_rng(seed)
    return 100 * np.exp(np.cumsum(g.normal(0, 0.02, n))), g.integers(1, 1000, n).astype(float)


@pytest.mark.parametrize("span,n", [(2, 400), (9, 1300), (12, 1100), (26, 3000), (200, 14_000), (1, 5)])
def test_ema_is_the_recurrence(spark, span, n):
    p, v = walk(n)
    got = collected(W.ema(bars(spark, {"a": (p, v), "b": (p[:3], v[:3])}), "p", span, "e"), "e")
    a, want = 2 / (span + 1), [p[0]]
    for x in p[1:]:
        want.append(a * x + (1 - a) * want[-1])
    assert np.allclose(got, want, rtol=1e-12, atol=0)


def plain_features(p, v):
    """The 18 features by loops."""
    n = len(p)
    r = [0.0] + [p[i] / max(p[i - 1], EPS) - 1 for i in range(1, n)]
    d = [0.0] + [p[i] - p[i - 1] for i in range(1, n)]
    lv = [math.log(max(x, 1)) for x in v]

    def mean(a, w, i):
        return float(np.mean(a[max(0, i - w + 1) : i + 1]))

    def std(a, w, i):
        return float(np.std(a[max(0, i - w + 1) : i + 1]))

    def ema(a, s):
        k, out = 2 / (s + 1), [a[0]]
        for x in a[1:]:
            out.append(k * x + (1 - k) * out[-1])
        return np.array(out)

    macd = ema(p, 12) - ema(p, 26)
    hist = (macd - ema(macd, 9)) / np.maximum(p, EPS)
    obv = np.cumsum([np.sign(x) * y if i else 0 for i, (x, y) in enumerate(zip(d, v))])
    out = []
    for i in range(n):
        ma = {w: mean(p, w, i) for w in (5, 10, 20, 50)}
        v5, v20 = std(r, 5, i) + EPS, std(r, 20, i) + EPS
        z = 0 if std(lv, 20, i) <= EPS else (lv[i] - mean(lv, 20, i)) / (std(lv, 20, i) + EPS)
        oz = 0 if std(obv, 20, i) <= EPS else (obv[i] - mean(obv, 20, i)) / (std(obv, 20, i) + EPS)
        up, dn = mean([max(x, 0) for x in d], 14, i), mean([max(-x, 0) for x in d], 14, i)
        out.append([r[i], r[i - 1] if i else 0, r[i - 2] if i > 1 else 0, r[i] / v20, *(p[i] / ma[w] - 1 for w in (5, 10, 20, 50)), ma[5] / ma[20] - 1, ma[10] / ma[50] - 1, v5 / v20 - 1, math.log(v20 + EPS), z, lv[i] - lv[i - 1] if i else 0, (100 - 100 / (1 + up / (dn + EPS))) / 100 - 0.5, hist[i], oz, r[i] * z])
    return np.array(out)


def test_features_by_loops(spark):
    p, v = walk(150, 3)
    rows = sorted(feats.features(bars(spark, {"a": (p, v)})).collect(), key=lambda r: r.i)
    got = np.array([[r[n] for n in feats.NAMES] for r in rows])
    assert np.allclose(got, plain_features(p, v), rtol=1e-7, atol=1e-9)


def test_short_and_degenerate_series(spark):
    df = feats.features(bars(spark, {"one": ([5.0], [2.0]), "flat": ([7.0] * 30, [3.0] * 30), "zero": ([0.0] * 5, [0.0] * 5), "nan": ([1.0, float("nan"), 2.0], [1.0, float("nan"), 2.0])}))
    for r in df.collect():
        for n in feats.NAMES:
            assert math.isfinite(r[n])
    one = df.where("stk = 'one'").first()
    assert one.f14 == -0.5 and one.f11 == pytest.approx(math.log(2e-12)) and one.f00 == 0
    assert all(r.f12 == 0 and r.f16 == 0 for r in df.where("stk = 'flat'").collect())
    empty = spark.createDataFrame([], "stk string, i int, p double, v double")
    assert feats.features(empty).count() == 0 and feats.features5(empty).count() == 0


def test_monotone_rise_has_full_strength(spark):
    p = np.arange(1.0, 40.0)
    assert collected(feats.features(bars(spark, {"a": (p, p)})), "f14")[-1] == pytest.approx(0.5)


def test_price_scale_and_key_order_do_not_matter(spark):
    p, v = walk(80, 5)
    a = feats.features(bars(spark, {"a": (p, v), "b": (p * 1000, v)}))
    one, two = (np.array([[r[n] for n in feats.NAMES] for r in sorted(a.where(F.col("stk") == k).collect(), key=lambda r: r.i)]) for k in "ab")
    assert np.allclose(one, two, rtol=1e-6, atol=1e-8)


def test_frames(spark):
    p = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0]
    df = bars(spark, {"a": (p, p)}).select("stk", "i", W.mean(F.col("p"), 2).alias("w"), W.mean_through(F.col("p"), 2).alias("h"), W.acceleration(F.col("p"), 5).alias("acc"), W.target(F.col("p")).alias("t"))
    assert collected(df, "w")[-1] == 48 and collected(df, "h")[-1] == pytest.approx((16 + 32 + 64) / 3)
    assert collected(df, "acc") == [0, 1, 3, 7, 15, 31, 31] and collected(df, "t") == [0] + [1.0] * 6


def test_ieee_division_and_missing_values(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 2.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double").select(fn.divided(F.col("a"), F.col("b")).alias("q"), fn.finite(fn.divided(F.col("a"), F.col("b"))).alias("f"))
    q = [r.q for r in df.collect()]
    assert q[0] == math.inf and q[1] == -math.inf and math.isnan(q[2]) and q[3] == 0.5 and q[4] is None
    assert [r.f for r in df.collect()] == [0, 0, 0, 0.5, 0]
    df = spark.createDataFrame([("s10",), ("s2",), ("s1",), ("x",), ("s" + "9" * 30,)], "stk string").select(fn.natural_key(F.col("stk")).alias("k"))
    assert [r.k for r in df.collect()] == [10, 2, 1, 0, 0]
    df = spark.createDataFrame([(-16.0,), (16.0,), (0.0,)], "x double").select(fn.signed_root(F.col("x")).alias("y"), fn.cap(F.col("x"), F.lit(3.0)).alias("c"))
    assert [(r.y, r.c) for r in df.collect()] == [(-2, -3), (2, 3), (0, 0)]


def test_numbering_of_long_keys(spark):
    """One key of two thirds of all rows and rows without a key: numbered in several ranges, and tails cut, as by loops."""
    g = np.random.default_rng(6)
    rows = [(k, int(t), float(t)) for k, n in {"hot": 4000, "a": 1000, None: 900, "b": 1}.items() for t in g.permutation(n)]
    df = spark.createDataFrame(rows, "stk string, ts long, x double").repartition(5)
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        made = sources.numbered(df, "ts").collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert len(made) == len(rows) and all(r.i == r.ts == r.x for r in made)
    bars = spark.createDataFrame([(r.stk, r.i + 5, r.x) for r in made], "stk string, i long, x double")
    got = sorted((str(r.stk), r.i, r.x) for r in sources.tail(bars, 950).collect())
    assert got == sorted((str(k), i, float(max(n - 950, 0) + i)) for k, n in {"hot": 4000, "a": 1000, None: 900, "b": 1}.items() for i in range(min(n, 950)))
    assert {r.stk for r in sources.long_enough(bars, 901).select("stk").distinct().collect()} == {"hot", "a"}
    assert {r.stk for r in sources.long_enough(bars, 900).select("stk").distinct().collect()} == {"hot", "a", None}
    assert sources.numbered(df.limit(0), "ts").count() == sources.tail(bars.limit(0), 3).count() == 0


def test_sources(spark, tmp_path):
    a = np.arange(24.0).reshape(3, 8)
    (tmp_path / "one").mkdir(), (tmp_path / "two").mkdir()
    np.save(tmp_path / "one" / "s1.npy", a)
    np.save(tmp_path / "two" / "s1.npy", a + 1)
    np.save(tmp_path / "two" / "s2.npy", a[:2])
    df = sources.read_npy(spark, str(tmp_path / "one"), str(tmp_path / "two"))
    assert sorted((r.stk, r.i, r.date, r.adj) for r in df.collect()) == [("s1", 0, 0, 7), ("s1", 1, 8, 15), ("s1", 2, 16, 23), ("s2", 0, 0, 7), ("s2", 1, 8, 15)]
    assert sorted((r.p, r.v) for r in sources.prices(df.where("stk = 's2'")).collect()) == [(7, 6), (15, 14)]
    assert sorted((r.i, r.date) for r in sources.tail(df.where("stk = 's1'"), 2).collect()) == [(0, 8), (1, 16)]
    assert sources.long_enough(df, 3).select("stk").distinct().count() == 1
    (tmp_path / "few.csv").write_text("time,close\n" + "".join(f"2020-01-0{i},1.5\n" for i in range(1, 4)))
    (tmp_path / "many.csv").write_text("time,close\n" + "".join(f"2020-01-01,{i}\n" for i in range(150)))
    got = sources.read_csv(spark, [str(tmp_path / x) for x in ("none.csv", "few.csv", "many.csv")], "time date, close double")
    assert got.count() == 150 and sources.read_csv(spark, [str(tmp_path / "few.csv")], "time date, close double") is None
    (tmp_path / "list.txt").write_text("\nHà Nội\nHuế\n")
    assert [r.name for r in sources.read_list(spark, str(tmp_path / "list.txt"), "province").collect()] == ["Hà Nội", "Huế"]
    (tmp_path / "cases.json").write_text('[{"address": "1 a, b, c", "result": {"province": "c", "ward": "b", "street": "a"}},\n {"address": "x", "result": {"province": "p", "ward": "w", "street": "s"}}]')
    assert [(r.id, r.text, r.street) for r in sources.read_cases(spark, str(tmp_path / "cases.json")).collect()] == [(0, "1 a, b, c", "a"), (1, "x", "s")]
