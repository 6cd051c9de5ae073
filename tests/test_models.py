"""Forecasts by independent implementations, causality, and algebraic identities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import address, ridge, score
from panelcast.operators import features as feats
from panelcast.plans import registry as R

from .test_windows import bars, plain_features, walk


def ridge_by_rows(p, v, warm=60, refit=5, win=None, lam=5.0, shrink=0.1, clip=0.03, y_clip=None):
    """A walk-forward ridge with an explicit intercept column and a solve of the full system."""
    x = plain_features(p, v)
    r = np.concatenate([[0], p[1:] / p[:-1] - 1])
    out = np.zeros(len(p))
    for t in range(warm, len(p), refit):
        lo = max(0, t - win) if win else 0
        a, y = x[lo:t], r[lo + 1 : t + 1]
        if y_clip:
            y = np.clip(y, -y_clip, y_clip)
        mu, sd = a.mean(0), a.std(0) + 1e-12
        z = np.hstack([np.ones((len(a), 1)), (a - mu) / sd])
        pen = lam * np.eye(19)
        pen[0, 0] = 0
        beta = np.linalg.solve(z.T @ z + pen, z.T @ y)
        for i in range(t, min(t + refit, len(p))):
            out[i] = np.clip(shrink * (beta[0] + (x[i] - mu) / sd @ beta[1:]), -clip, clip)
    return out


def predicted(df, key="a"):
    return np.array([r.y_pred for r in sorted((r for r in df.collect() if r.stk == key), key=lambda r: r.i)])


@pytest.mark.parametrize("name,kw", [("baseline_v2", {}), ("roll80", {"win": 80}), ("clipy", {"y_clip": 0.05}), ("tight", {"shrink": 0.05, "clip": 0.015})])
def test_ridge_by_rows(spark, name, kw):
    p, v = walk(190, 9)
    got = predicted(R.METHODS[name](bars(spark, {"a": (p, v)})))
    assert np.allclose(got, ridge_by_rows(p, v, **kw), rtol=1e-6, atol=1e-10)


@pytest.mark.parametrize("n", [59, 60, 61, 65])
def test_ridge_at_the_warm_up(spark, n):
    p, v = walk(n, 2)
    got = predicted(R.METHODS["baseline_v2"](bars(spark, {"a": (p, v)})))
    assert len(got) == n and not got[:60].any() and np.allclose(got, ridge_by_rows(p, v), rtol=1e-6, atol=1e-10)


@pytest.mark.parametrize("name", ["ma_reversion", "baseline_v2", "vol_0.20", "online5", "pooled_ridge", "sign_conservative"])
def test_no_look_ahead(spark, name):
    p, v = walk(130, 4)
    q = p.copy()
    q[100:] *= 1.5
    a, b = (predicted(R.METHODS[name](bars(spark, {"a": (x, v), "b": (p[:70], v[:70])}))) for x in (p, q))
    assert np.allclose(a[:100], b[:100], rtol=1e-9, atol=1e-13) and not np.allclose(a[100:], b[100:])


def test_pooled_of_one_key_is_its_own_model(spark):
    p, v = walk(200, 6)
    df = bars(spark, {"a": (p, v)})
    own = ridge.predict(df, ridge.Plan(refit=20))
    assert np.allclose(predicted(R.METHODS["pooled_ridge"](df)), predicted(own), rtol=1e-6, atol=1e-10)


def test_identities(spark):
    p, v = walk(160, 8)
    df = bars(spark, {"a": (p, v)})
    base = predicted(R.METHODS["baseline_v2"](df))
    if abs(base).max() < 0.03:
        assert np.allclose(predicted(R.METHODS["half_blend"](df)), predicted(R.METHODS["tight"](df)))
    s = score.evaluate(R.with_target(R.METHODS["zero"](df))).first()
    assert s.rel == 0 and s.abs == s.base and s.n == 158
    mixed = R.ensemble(R.METHODS["baseline_v2"](df), R.METHODS["zero"](df), 0.25)
    assert np.allclose(predicted(mixed), 0.25 * base)
    custom = R.per_series(lambda prices, volumes: np.zeros(len(prices)) + 0.01)(df)
    assert set(predicted(custom)) == {0.01}


def test_evaluate_by_numpy(spark):
    g = np.random.default_rng(1)
    t, y = g.normal(0, 1, 31), g.normal(0, 1, 31)
    t[7] = np.nan
    df = spark.createDataFrame([("a", i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, y))], "stk string, i int, target double, y_pred double")
    s = score.evaluate(df).first()
    e, f = np.abs(t[2:] - y[1:-1]), np.abs(t[2:])
    want = [np.nanquantile(x, 0.5) + 0.5 * np.nanquantile(x, 0.9) for x in (f, e)]
    assert s.n == 29 and np.allclose([s.base, s.abs, s.rel], [*want, 1 - want[1] / want[0]])
    flat = df.withColumn("target", F.lit(0.0))
    assert score.evaluate(flat).first().rel == 0


def test_summary_reports(spark, tmp_path, capsys):
    rows = [("s10", "a", 1.0, 0.5), ("s2", "a", 2.0, -0.5), ("s10", "b", 1.5, 0.7), ("s2", "b", 1.0, 0.0)]
    df = spark.createDataFrame([(s, m, 2.0, x, y) for s, m, x, y in rows], "stk string, method string, base double, abs double, rel double")
    s = {r.method: r for r in score.summary(df).collect()}
    assert s["a"].median_abs == 1.5 and s["a"].pct_rel_pos == 50 and s["b"].mean_rel == pytest.approx(0.35)
    assert score.head_to_head(df, "b", "a").first().wins == 2
    d = {r.method: r.d_mean_rel for r in score.against_baseline(score.summary(df), "a").collect()}
    assert d == {"a": 0, "b": pytest.approx(0.35)}
    score.write_results(df, ["a", "b"], str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out/per_key"), header=True)
    assert back.columns == ["stk", "abs_a", "rel_a", "abs_b", "rel_b"] and back.count() == 2
    data = spark.createDataFrame([(k, i, float(i % 3), 0.0) for k in ("s10", "s2", "s1") for i in range(9)], "stk string, i int, y_true double, y_pred double")
    ev = score.BatchEvaluator(data, "three")
    assert [r.stk for r in ev.to_frame().collect()] == ["s1", "s2", "s10"]
    assert ev.report().first().line.startswith("s1          ")


def test_histogram_last_bin_is_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)] + [(float("nan"),)], "x double")
    assert sorted((r.bin, r.n) for r in score.histogram(df, "x").collect()) == [(b, 2 if b == 10 else 1) for b in range(1, 11)]
    assert [(r.bin, r.n) for r in score.histogram(df.where("x = 3"), "x").collect()] == [(1, 1)]


def test_trees_keep_causality_and_bounds(spark):
    p, v = walk(140, 12)
    got = predicted(R.gbt_pooled(bars(spark, {"a": (p, v)}), rounds=2, least=5, last_fit=120, refit=20))
    assert len(got) == 140 and not got[:100].any() and abs(got).max() <= 0.03


@pytest.mark.parametrize("name", ["gbt", "gbt_pooled"])
def test_trees_refit_on_every_key(spark, name):
    p, v = walk(190, 12)
    both = {"a": (p, v), "b": walk(170, 5)}
    kw = {"rounds": 6, "least": 5, "refit": 20}
    got = R.METHODS[name](bars(spark, both), **kw)
    once = R.METHODS[name](bars(spark, both), last_fit=100, **kw)
    for key, n in (("a", 190), ("b", 170)):
        a, b = predicted(got, key), predicted(once, key)
        # the first refit scores the same rows alike; later ones see more rows
        assert len(a) == n and not a[:100].any() and a[100:].any() and np.allclose(a[:120], b[:120]) and not np.allclose(a[140:], b[140:])
    changed = p.copy()
    changed[150:] *= 1.5
    assert np.allclose(predicted(R.METHODS[name](bars(spark, both | {"a": (changed, v)}), **kw))[:150], predicted(got)[:150])


def test_pooled_trees_of_many_models(spark):
    """Fits of more rows than a task takes: each row is learnt by one model of a fit, each forecast is the mean of the models that its hash names."""
    from panelcast.operators import trees

    g = np.random.default_rng(8)
    panel = bars(spark, {k: (50 * np.exp(np.cumsum(g.normal(0, 0.02, n))), g.integers(1, 99, n).astype(float)) for k, n in {"a": 150, "b": 90, "c": 61, "hot": 260}.items()})
    made, warm, refit, share, grown = feats.features(panel), 60, 50, 40, {"rounds": 3, "rate": 0.1, "depth": 2, "leaves": 4, "least": 3}
    got = {(r.stk, r.i): r.raw for r in trees.predict(made, warm=warm, refit=refit, share=share, **grown).collect()}
    rows = made.withColumn("h", F.xxhash64("stk", "i")).toPandas().sort_values(["stk", "i"])
    rows["label"] = rows.groupby("stk").r.shift(-1)
    x = rows[trees.NAMES].to_numpy()
    want = {(k, i): 0.0 for k, i in zip(rows.stk, rows.i) if i < warm}
    for k, t in enumerate(range(warm, 260, refit)):
        old = ((rows.i < t) & rows.label.notna()).to_numpy()
        models = max(1, -(-int(old.sum()) // share))
        assert models > 4
        new = ((rows.i >= t) & (rows.i < t + refit)).to_numpy()
        parts = {m: [] for m in range(models)}
        for n in np.flatnonzero(old):
            parts[int(rows.h.iloc[n]) % models].append(n)
        asked = {m: [n for n in np.flatnonzero(new) if (m - int(rows.h.iloc[n])) % models < trees.VOTES] for m in range(models)}
        votes = {}
        for m in range(models):
            if asked[m]:
                for n, v in zip(asked[m], trees.boosted(x[parts[m]], rows.label.to_numpy()[parts[m]], x[asked[m]], seed=[7, k, m], **grown)):
                    votes.setdefault(n, []).append(v)
        assert all(len(v) == trees.VOTES for v in votes.values())
        want |= {(rows.stk.iloc[n], rows.i.iloc[n]): np.mean(v) for n, v in votes.items()}
    assert set(got) == set(want) and all(abs(got[q] - want[q]) < 1e-12 for q in want)
    # a share that all rows fit is one model: the mean of one
    one = trees.predict(made, warm=warm, refit=refit, **grown)
    assert one.count() == len(rows) == one.select("stk", "i").distinct().count()


def test_registered_trees_cut_nothing(spark, monkeypatch):
    from panelcast.operators import trees
    from panelcast.plans import queries

    seen = []
    monkeypatch.setattr(trees, "predict", lambda feats, **kw: seen.append((feats.select("stk").distinct().count(), kw.get("rounds", 300), kw.get("last_fit"))) or feats.withColumn("y_pred", F.lit(0.0)))
    monkeypatch.setattr(queries, "bars_of", lambda spark, sf_dir: bars(spark, {k: walk(5, 1) for k in "abc"}))
    for q in ("pred_gbt", "pred_gbt_pooled"):
        queries.QUERIES[q](spark, "")
    assert seen == [(3, 200, None), (3, 300, None)]


def test_trees_learn_a_step():
    from panelcast.operators import trees

    g = np.random.default_rng(3)
    x = g.normal(0, 1, (600, 18))
    y = np.where(x[:, 4] > 0.3, 1.0, -1.0)
    got = trees.boosted(x[:500], y[:500], x[500:], 200, 0.05, 3, 8, 20, [1])
    assert np.mean(np.sign(got) == y[500:]) > 0.95 and np.abs(got - y[500:]).mean() < 0.15


def test_addresses(spark):
    names = spark.createDataFrame([("province", "Hà Nội"), ("province", "Huế"), ("ward", "Đống Đa"), ("ward", "Hoàn Kiếm"), ("street", "Quang Trung"), ("street", "3/2"), ("street", "Hoàn Kiếm")], "kind string, name string")
    cases = spark.createDataFrame([(0, "12 quang trung, Dong Da, Ha Noi", "Hà Nội", "Đống Đa", "Quang Trung"), (1, "3/2, hoan kiem, hue", "Huế", "Hoàn Kiếm", "3/2"), (2, "", "Huế", "Hoàn Kiếm", "3/2")], "id int, text string, province string, ward string, street string")
    details = address.judge(cases, address.nearest(cases, names))
    got = {r.id: r.total_correct for r in details.collect()}
    assert got[0] == 3 and got[1] == 3
    assert len(details.columns) == 18
    none = address.judge(cases, address.nearest(cases, names).where("id > 0"))
    assert none.where("id = 0").first().street_student == "EXCEPTION" and address.total(none).first().total == 9
    assert address.total(details.where("id > 5")).first().score == 0
    stub = address.judge(cases, address.stub(cases, names))
    assert stub.where("id = 0").first().province_student == "Huế"  # the first by code point


class Moody:
    def __init__(self, province, ward, street):
        self.lists = province, ward, street

    def process(self, text):
        if text == "bad":
            raise KeyError(text)
        return {"province": self.lists[0][0], "ward": "w", "street": "s"} if text != "short" else {"province": "p"}


def test_solutions_are_timed_and_never_stop_the_batch(spark):
    cases = spark.createDataFrame([(0, "good", "a", "w", "x"), (1, "bad", "a", "w", "s"), (2, "short", "p", "w", "s"), (3, None, "a", "w", "s")], "id long, text string, province string, ward string, street string")
    names = spark.createDataFrame([("province", "b"), ("province", "a"), ("ward", None)], "kind string, name string")
    details = address.judge(cases, address.solved(cases, names, Moody))
    assert len(details.columns) == 19 and details.columns[-2:] == ["total_correct", "time_sec"]
    got = {r.id: r for r in details.collect()}
    assert [got[i].total_correct for i in range(4)] == [2, 0, 0, 3]
    assert got[1].street_student == got[2].province_student == "EXCEPTION" and got[1].time_sec == got[2].time_sec == 0 and got[0].time_sec > 0
    total = address.total(details).first()
    assert total[:3] == (5, 12, 4.17) and total.max_time_sec >= total.avg_time_sec >= 0
    none = address.total(details.where("id > 5")).first()
    assert tuple(none) == (0, 0, 0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        most, address.MOST = address.MOST, 1
        try:
            address.solved(cases, names, Moody)
        finally:
            address.MOST = most


def test_workbook(spark, tmp_path, monkeypatch):
    import xml.etree.ElementTree as E
    import zipfile

    from panelcast.sources import workbook

    df = spark.createDataFrame([("a<&\x01 é", 1, 0.5, True), (None, None, float("nan"), None)], "s string, n long, x double, b boolean").coalesce(1)
    path = str(tmp_path / "out.xlsx")
    workbook.write_workbook({"summary": df.limit(0), 'the "details"': df}, path)
    with zipfile.ZipFile(path) as z:
        sheets = [[[("".join(c.itertext()), c.get("t")) for c in r] for r in E.fromstring(z.read(f"xl/worksheets/sheet{n}.xml"))[0]] for n in (1, 2)]
        assert [s.get("name") for s in E.fromstring(z.read("xl/workbook.xml"))[0]] == ["summary", 'the "details"']
        assert all(E.fromstring(z.read(n)) is not None for n in z.namelist())
    head = [(c, "inlineStr") for c in "snxb"]
    assert sheets == [[head], [head, [("a<&_x0001_ é", "inlineStr"), ("1", None), ("0.5", None), ("1", "b")], [("", None)] * 4]]
    monkeypatch.setattr(workbook, "ROWS", 2)
    with pytest.raises(ValueError):
        workbook.write_workbook({"details": df}, str(tmp_path / "long.xlsx"))
    assert [f.name for f in tmp_path.iterdir()] == ["out.xlsx"]


def test_cached_csv(spark, tmp_path):
    from panelcast.sources import read_csv_cached

    cache, short, full = (str(tmp_path / n) for n in ("cache", "short", "full"))
    spark.range(3).write.csv(short, header=True)
    spark.range(9).write.csv(full, header=True)
    assert read_csv_cached(spark, cache, [short], "id long", 5) is None and not (tmp_path / "cache").exists()
    assert read_csv_cached(spark, cache, [str(tmp_path / "none"), short, full], "id long", 5).count() == 9
    assert read_csv_cached(spark, cache, [], "id long", 5).count() == 9
