"""Runs whose results are kept, pushed and split scans, plotted lines, and a tree by brute force."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast import sources
from panelcast.operators import explore, score, trees
from panelcast.plans import registry as R
from panelcast.plans import runs


def panel(spark, seed=1, keys="abc", n=130):
    g = np.random.default_rng(seed)
    rows = [(k, i, float(p), float(v)) for k in keys for i, (p, v) in enumerate(zip(20 * np.exp(np.cumsum(g.normal(0, 0.02, n))), g.integers(1, 99, n)))]
    return spark.createDataFrame(rows, "stk string, i int, p double, v double")


def test_a_rerun_fits_nothing(spark, tmp_path, monkeypatch):
    store, bars, asked, compare = runs.Store(spark, f"file://{tmp_path}/store"), panel(spark), [], R.compare
    monkeypatch.setattr(R, "compare", lambda bars, names: asked.append(list(names)) or compare(bars, names))
    first = store.run(bars, ["baseline_v2", "zero"]).toPandas()
    want = compare(bars, ["baseline_v2", "zero"]).toPandas()
    order = lambda df: df.sort_values(["method", "stk"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(first), order(want)[list(first.columns)])
    # the same rows in other partitions: only what is new is computed
    again = store.run(bars.repartition(7), ["zero", "baseline_v2", "half_blend"]).toPandas()
    assert asked == [["baseline_v2", "zero"], ["half_blend"]] and len(again) == 9
    pd.testing.assert_frame_equal(order(again[again.method != "half_blend"]), order(first))
    # other bars, other entries
    store.run(panel(spark, 2), ["zero"])
    assert asked[-1] == ["zero"] and len(asked) == 3
    assert sorted(m["method"] for m in store.manifests()) == ["baseline_v2", "half_blend", "zero", "zero"]
    assert {m["parameters"]["shrink"] for m in store.manifests() if m["method"] == "baseline_v2"} == {0.1}


def test_only_whole_results_are_seen(spark, tmp_path, monkeypatch):
    store, bars = runs.Store(spark, f"file://{tmp_path}/store"), panel(spark)

    def broken(self, made, method, digest):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(runs.Store, "_publish", broken)
        with pytest.raises(RuntimeError):
            store.run(bars, ["zero"])
    assert not store.has("zero", runs.fingerprint(bars)) and store.manifests() == []
    assert store.run(bars, ["zero"]).count() == 3
    # another run was faster: its results stay
    digest = runs.fingerprint(bars)
    R.compare(bars, ["zero"]).write.parquet(f"file://{tmp_path}/late")
    store._publish(f"file://{tmp_path}/late", "zero", digest)
    assert store.run(bars, ["zero"]).count() == 3 and not (tmp_path / "late").exists()
    assert store.run(bars.limit(0), ["zero"]).count() == 0


def test_run_tables(spark, tmp_path):
    scores = runs.Store(spark, f"file://{tmp_path}").run(panel(spark), ["baseline_v2", "pooled_ridge", "half_blend", "sign_conservative", "tight"])
    got = {r.method: r for r in runs.table(scores, "improvements").collect()}
    assert set(got) == {"M0_base", "M1_poolridge", "M2_blend", "M3_signcons", "M5_tight"} and got["M0_base"].d_median_rel == 0
    assert got["M2_blend"].d_mean_abs == pytest.approx(got["M2_blend"].mean_abs - got["M0_base"].mean_abs)
    other = runs.wide(scores.where("method = 'baseline_v2'"), "experiments")
    assert {"abs_I2_vol_r0.10", "rel_ALL_r120_v0.20"} <= set(score.rounded(other).columns) and score.rounded(other).count() == 3
    assert runs.wide(scores, "improvements").count() == 3 and {"abs_M0_base", "rel_M8_poollgbm"} <= set(runs.wide(scores, "improvements").columns)


@pytest.fixture(scope="module")
def matrices(tmp_path_factory):
    folder = tmp_path_factory.mktemp("npy")
    a = np.arange(8.0 * 1000).reshape(1000, 8)
    a[:, 0] = 20240000 + np.arange(1000) // 2
    a[5, 7] = np.nan
    np.save(folder / "c.npy", a)
    np.save(folder / "f.npy", np.asfortranarray(a))
    return folder, a


def scanned(df):
    """Rows that left the reader."""
    df.collect()
    return int(df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value())


@pytest.mark.parametrize("condition, rows", [("i >= 990", 10), ("i < 3 AND stk = 'c'", 3), ("date >= 20240100 AND date < 20240110", 20), ("date = 20240499", 2), ("adj > 7990", 1), ("i > 10.5 AND i <= 12.5", 2), ("date > 20250000", 0)])
def test_bounds_reach_the_reader(spark, matrices, condition, rows):
    folder, a = matrices
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.conf.set("spark.sql.inMemoryColumnarStorage.partitionPruning", "false")  # it forgets NaN
    try:
        for ordered in ("false", "true"):
            spark.dataSource.register(sources.NpySource)
            whole = spark.read.format("npy").option("sorted", ordered).option("rows", "300").load(f"file://{folder}")
            got = whole.where(condition)
            files = 1 if "stk" in condition else 2
            n, rows_of = scanned(got), sorted(map(repr, got.collect()))
            held = whole.select("*").cache()  # Spark itself tests rows that are held
            assert n == len(rows_of) < 2000
            assert rows_of == sorted(map(repr, held.where(condition).collect()))
            held.unpersist()
            assert "adj" in condition or n == rows * files
        reader = sources.NpyReader(f"file://{folder}", 300, True)
        assert len(reader.partitions()) == 8
        from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

        assert list(reader.pushFilters([GreaterThanOrEqual(("date",), 20240100), LessThan(("date",), 20240110)])) == []
        assert [p.value[1:] for p in reader.partitions()] == [(200, 220)] * 2  # rows outside the bounds are not read
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
        spark.conf.unset("spark.sql.inMemoryColumnarStorage.partitionPruning")


def test_pickles_are_refused(spark, tmp_path):
    np.save(tmp_path / "p.npy", np.array([[{}]], object))
    with pytest.raises(Exception, match="pickled arrays are not read"):
        sources.read_npy(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("indent", [None, 1])
def test_case_files_are_split(spark, tmp_path, indent):
    odd = ['a "quoted" }{ text', "back\\slash\\\\", '\\"}', "[,]", "Đường số 7 }", "", "}}}", '"']
    cases = [{"address": f"{k} {odd[k % len(odd)]}, w, p", "result": {"province": f"p{k}", "ward": odd[(k + 3) % len(odd)], "street": "s"}, "further": {"deep": [{"x": 1}, "}"]}} for k in range(400)]
    (tmp_path / "cases.json").write_text(json.dumps(cases, indent=indent, ensure_ascii=False))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        path = str(tmp_path / "cases.json")
        got = sources.read_large_cases(spark, path)
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 5
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sources.read_cases(spark, path).collect())) and got.count() == 400
        (tmp_path / "none.json").write_text("[]")
        assert sources.read_large_cases(spark, str(tmp_path / "none.json")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_plotted_lines(spark):
    bars = panel(spark, 5, "ab", 1000)
    rows = bars.toPandas()
    for points in (10, 64):
        got, tri = explore.extremes(bars, "p", points).toPandas(), explore.triangles(bars, "p", points).toPandas()
        for k, own in rows.groupby("stk"):
            line = own.sort_values("i").p.to_numpy()
            kept = set(got[got.stk == k].i)
            parts = [np.flatnonzero(np.arange(1000) * (points // 2) // 1000 == b) for b in range(points // 2)]
            assert kept == {int(f) for x in parts for f in (x[line[x].argmin()], x[line[x].argmax()])} and len(kept) <= points
            parts = [np.flatnonzero(np.arange(1000) * points // 1000 == b) for b in range(points)]
            want = set()
            for b, x in enumerate(parts):
                mid = lambda c: (parts[c].mean(), line[parts[c]].mean())
                (xa, ya), (xb, yb) = mid(b - 1) if b else (0, line[0]), mid(b + 1) if b + 1 < points else (999, line[999])
                want.add(int(x[np.abs((xa - xb) * (line[x] - ya) - (xa - x) * (yb - ya)).argmax()]))
            assert set(tri[tri.stk == k].i) == want
    assert explore.extremes(bars.limit(0), "p", 10).count() == 0


def test_headers_of_two_lines(spark, tmp_path):
    (tmp_path / "us.csv").write_text("Price,Adj Close,Close,Volume\nTicker,AAPL,AAPL,AAPL\nDate,,,\n2020-01-02,1.5,2.5,10\n2020-01-03,1.6,2.6,20\n")
    got = sources.flattened(spark.read.csv(str(tmp_path / "us.csv")))
    assert got.columns == ["Date", "Adj Close", "Close", "Volume"] and sorted(r["Adj Close"] for r in got.collect()) == ["1.5", "1.6"]


def test_one_tree_by_loops():
    """The first tree of a fit against loops over all nodes, features and cuts; best-first up to the leaf limit, medians in the leaves."""
    for seed in range(6):
        g = np.random.default_rng(seed)
        x, y = np.round(g.normal(size=(90, 18)), 1), g.normal(size=90)
        depth, leaves, least = 3, 7, 5
        got = trees.boosted(x, y, x, 1, 1.0, depth, leaves, least, [seed])
        draw = np.random.default_rng([seed])
        own = np.sort(draw.choice(90, round(0.8 * 90), replace=False))
        chosen = np.sort(draw.choice(18, round(0.8 * 18), replace=False))
        codes, bins = trees.binned(x, x[:0])
        start = np.median(y)
        sign = np.sign(y - start)

        def best_split(rows):
            found = (1e-9, None, None)
            for f in chosen:
                for cut in range(bins):
                    a, b = [r for r in rows if codes[f, r] <= cut], [r for r in rows if codes[f, r] > cut]
                    if len(a) >= least and len(b) >= least:
                        gain = sum(sign[a]) ** 2 / len(a) + sum(sign[b]) ** 2 / len(b) - sum(sign[rows]) ** 2 / len(rows)
                        if gain > found[0] + 1e-12:
                            found = (gain, f, cut)
            return found

        grown = [(best_split(list(own)), list(own), list(range(90)), 0)]
        done = []
        while grown and len(grown) + len(done) < leaves:
            k = max(range(len(grown)), key=lambda k: grown[k][0][0])
            (gain, f, cut), rows, every, level = grown.pop(k)
            if f is None:
                done.append((rows, every))
                continue
            for side in (lambda r: codes[f, r] <= cut, lambda r: codes[f, r] > cut):
                mine, all_ = [r for r in rows if side(r)], [r for r in every if side(r)]
                split = best_split(mine) if level + 1 < depth else (0.0, None, None)
                grown.append((split, mine, all_, level + 1))
        want = np.zeros(90)
        for rows, every in [*done, *((r, e) for _, r, e, _ in grown)]:
            want[every] = start + np.median(y[rows] - start)
        assert np.allclose(got, want), seed


def test_bars_are_made_once(spark, tmp_path):
    """What the bars are made from may be any size: the digest and all methods read what was made once."""
    made, n = spark.sparkContext.accumulator(0), 150

    def counted(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    bars = spark.range(n).selectExpr("'a' AS stk", "cast(id AS int) AS i", "100 + id % 7 + 0.0 AS p", "1.0D AS v").selectExpr("stk", "i", "cast(p AS double) AS p", "v").mapInPandas(counted, "stk string, i int, p double, v double")
    assert runs.Store(spark, f"file://{tmp_path}/store").run(bars, ["zero", "baseline_v2", "ma_reversion"]).count() == 3
    assert made.value == n


def test_gains_and_medians_of_trees():
    """Signs and rows are counted in one number; both, and what splits gain, are those of separate counts."""
    g = np.random.default_rng(5)
    for least in (0, 1, 7):
        sign, rows = g.integers(-1, 2, (4, 500)), np.ones((4, 500), int)
        at = g.integers(0, 40, (4, 6, 500))
        count = lambda w: np.stack([[np.cumsum(np.bincount(f, v, 40)) for f in node] for node, v in zip(at, w, strict=True)])  # noqa: B023, E731
        size, left = count(rows), count(sign)
        n, s = size[..., -1:], left[..., -1:]
        ok = (size >= least) & (n - size >= least)
        want = np.where(ok, left**2 / np.maximum(size, 1) + (s - left) ** 2 / np.maximum(n - size, 1) - s**2 / np.maximum(n, 1), 0)
        assert np.array_equal(trees._gains(count(sign * trees.SIGN + 1), least), want)
    for k in range(1, 60):
        v = g.normal(size=k)
        assert trees._median(v) == np.median(v)


def test_fits_of_keys_are_dealt_by_their_number(spark, monkeypatch):
    """Eight groups for each key, not eight for all."""
    asked, own = [], trees._dealt
    monkeypatch.setattr(trees, "_dealt", lambda df, groups, by: asked.append(groups) or own(df, groups, by))
    bars = spark.range(6 * 300).selectExpr("concat('s', id % 6) AS stk", "cast(id DIV 6 AS int) AS i", "100 + 0.1D * (id % 11) AS p", "1.0D AS v")
    R.METHODS["gbt"](bars)
    assert asked == [6 * 8]
