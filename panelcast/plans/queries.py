"""The registered queries over driver tables, and the same in DuckDB's SQL where SQL can express them. Doubles are rounded to six digits on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sources
from ..functions import log_volume, no_nan, signed_root
from ..operators import address, explore, ridge, score
from ..operators import features as feats
from ..operators import windows as W
from ..operators.blocks import in_blocks
from ..session import shared_dir
from . import registry as R
from . import ridge_sql, runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
C = F.col


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return put


def six(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(f"`{c}`", 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def bars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.market(spark, sf_dir).select("stk", F.col("i").cast("int").alias("i"), "p", "v")


# --- SQL of the bars and features -------------------------------------------------------------------------------------

W0 = "PARTITION BY stk ORDER BY i"
BARS = f"""WITH b0 AS (SELECT p_brand AS stk, l_shipdate AS ts, sum(CAST(round(l_discount * 100) AS INT) - 5) AS dx, sum(l_quantity) AS v, count(*) AS nsh
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, l_shipdate),
bars AS (SELECT stk, ts, CAST(strftime(ts, '%Y%m%d') AS INT) AS date, CAST(row_number() OVER (PARTITION BY stk ORDER BY ts) - 1 AS INT) AS i,
  100 * exp({sources.WALK} * CAST(sum(dx) OVER (PARTITION BY stk ORDER BY ts ROWS UNBOUNDED PRECEDING) AS DOUBLE)) AS p, v, nsh FROM b0)"""
RET = f"""{BARS},
rets AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE p / greatest(lag(p) OVER ({W0}), 1e-12) - 1 END AS r, coalesce(p - lag(p) OVER ({W0}), 0) AS d, ln(greatest(v, 1.0)) AS lv FROM bars)"""


def last(w: int) -> str:
    return f"({W0} ROWS {w - 1} PRECEDING)"


def fold(x: str, span: int) -> str:
    a = 2.0 / (span + 1)
    return f"list_reduce(list({x}) OVER {last(480)}, lambda a, x: {a!r} * x + {1 - a!r} * a)"


EMA = f"""{RET},
ema1 AS (SELECT *, {fold("p", 12)} AS e12, {fold("p", 26)} AS e26 FROM rets),
ema2 AS (SELECT *, e12 - e26 AS macd FROM ema1),
emas AS (SELECT *, (macd - {fold("macd", 9)}) / greatest(p, 1e-12) AS macd_hist FROM ema2)"""
FEATS = f"""{EMA},
g1 AS (SELECT *, avg(p) OVER {last(5)} AS ma5, avg(p) OVER {last(10)} AS ma10, avg(p) OVER {last(20)} AS ma20, avg(p) OVER {last(50)} AS ma50,
  stddev_pop(r) OVER {last(5)} + 1e-12 AS vol5, stddev_pop(r) OVER {last(20)} + 1e-12 AS vol20, avg(lv) OVER {last(20)} AS lvm, stddev_pop(lv) OVER {last(20)} AS lvs,
  avg(greatest(d, 0)) OVER {last(14)} AS up, avg(greatest(-d, 0)) OVER {last(14)} AS dn, sum(CASE WHEN i > 0 THEN sign(d) * v ELSE 0 END) OVER ({W0} ROWS UNBOUNDED PRECEDING) AS obv FROM emas),
g2 AS (SELECT *, avg(obv) OVER {last(20)} AS obm, stddev_pop(obv) OVER {last(20)} AS obs, CASE WHEN lvs <= 1e-12 THEN 0 ELSE (lv - lvm) / (lvs + 1e-12) END AS vz FROM g1),
feats AS (SELECT stk, i, p, v, r, vol20, r AS f00, coalesce(lag(r, 1) OVER ({W0}), 0) AS f01, coalesce(lag(r, 2) OVER ({W0}), 0) AS f02, r / vol20 AS f03,
  p / greatest(ma5, 1e-12) - 1 AS f04, p / greatest(ma10, 1e-12) - 1 AS f05, p / greatest(ma20, 1e-12) - 1 AS f06, p / greatest(ma50, 1e-12) - 1 AS f07,
  ma5 / greatest(ma20, 1e-12) - 1 AS f08, ma10 / greatest(ma50, 1e-12) - 1 AS f09, vol5 / vol20 - 1 AS f10, ln(vol20 + 1e-12) AS f11, vz AS f12,
  coalesce(lv - lag(lv) OVER ({W0}), 0) AS f13, (100 - 100 / (1 + up / (dn + 1e-12))) / 100 - 0.5 AS f14, macd_hist AS f15,
  CASE WHEN obs <= 1e-12 THEN 0 ELSE (obv - obm) / (obs + 1e-12) END AS f16, r * vz AS f17 FROM g2)"""
SCORED = """e AS (SELECT *, target - lag(y_pred) OVER (PARTITION BY {key} ORDER BY i) AS e FROM pt),
q AS (SELECT {key}, count(*) AS n, quantile_cont(abs(e), 0.5) + 0.5 * quantile_cont(abs(e), 0.9) AS abs_, quantile_cont(abs(target), 0.5) + 0.5 * quantile_cont(abs(target), 0.9) AS base FROM e WHERE i >= 2 GROUP BY {key}),
scores AS (SELECT {key}, n, base, abs_ AS abs, CASE WHEN base > 0 THEN 1 - abs_ / base ELSE 0 END AS rel FROM q)"""
TARGET = "coalesce(p / lag(p) OVER (PARTITION BY {key} ORDER BY i) - 1, 0) AS target"
MA = "least(greatest(avg(p) OVER (PARTITION BY stk ORDER BY i ROWS 5 PRECEDING) / greatest(p, 1e-12) - 1, -0.07), 0.07)"
S6 = "round(base, 6) AS base, round(abs, 6) AS abs, round(rel, 6) AS rel"


def scored_sql(pred: str, key: str = "stk", source: str = "bars") -> str:
    return f"{BARS},\npt AS (SELECT *, {pred} AS y_pred, {TARGET.format(key=key)} FROM {source}),\n{SCORED.format(key=key)}"


def pick(sql: str, source: str, *cols: str) -> str:
    return f"{sql}\nSELECT stk, i, {', '.join(cols)} FROM {source}"


def r6(**cols: str) -> list[str]:
    return [f"round({x}, 6) AS {n}" for n, x in cols.items()]


# --- sources and filters ----------------------------------------------------------------------------------------------


@query(f"{BARS}\nSELECT stk, ts, date, i, round(p, 6) AS p, v, nsh FROM bars")
def bars(spark, sf_dir):
    return six(sources.market(spark, sf_dir)).withColumn("i", C("i").cast("int"))


@query(f"{BARS}\nSELECT stk, i, date, round(p, 6) AS p FROM bars WHERE date >= 19970101 AND date < 19980101")
def date_range(spark, sf_dir):
    return six(sources.date_range(sources.market(spark, sf_dir), 19970101, 19980101).select("stk", C("i").cast("int").alias("i"), "date", "p"))


@query(f"{BARS},\nt AS (SELECT *, row_number() OVER (PARTITION BY stk ORDER BY i DESC) AS back FROM bars)\nSELECT stk, CAST(row_number() OVER (PARTITION BY stk ORDER BY i) - 1 AS INT) AS i, round(p, 6) AS p, v FROM t WHERE back <= 250")
def tail_n(spark, sf_dir):
    return six(sources.tail(bars_of(spark, sf_dir), 250)).withColumn("i", C("i").cast("int"))


@query(f"{BARS}\nSELECT stk, count(*) AS n FROM bars GROUP BY stk HAVING count(*) >= 300")
def long_keys(spark, sf_dir):
    return sources.long_enough(bars_of(spark, sf_dir)).groupBy("stk").count().withColumnRenamed("count", "n")


@query("SELECT CAST(user_id AS VARCHAR) AS stk, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS INT) AS i, round(value, 6) AS p FROM events")
def short_series(spark, sf_dir):
    return six(sources.short_series(spark, sf_dir).select("stk", C("i").cast("int").alias("i"), "p"))


# --- windows ----------------------------------------------------------------------------------------------------------


#: Rows that the window queries reach back.
REACH = 60


def windowed(grown: bool = False, **cols) -> Callable:
    """Windows of bounded reach, in blocks of long keys; ``grown``: over the growth since the first row too."""

    def each(df, keys):
        df = df.withColumns({"r": W.returns(C("p"), keys), "d": W.difference(C("p"), keys), "lv": log_volume(C("v"))})
        return df.select(*keys, "i", *(f(keys).alias(n) for n, f in cols.items()))

    def run(spark, sf_dir):
        df = bars_of(spark, sf_dir)
        return six(in_blocks(W.with_growth(df, g="p") if grown else df, each, ["stk"], "i", REACH))

    return run


def add(name: str, sql: list[str], source: str = "rets", prelude: str = RET, grown: bool = False, **cols) -> None:
    query(pick(prelude, source, *sql), name)(windowed(grown, **cols))


add("returns", r6(r="r"), r=lambda k: C("r"))
add("lags", r6(r1=f"coalesce(lag(r, 1) OVER ({W0}), 0)", r2=f"coalesce(lag(r, 2) OVER ({W0}), 0)"), r1=lambda k: W.lagged(C("r"), 1, key=k), r2=lambda k: W.lagged(C("r"), 2, key=k))
add("difference", r6(d="d"), d=lambda k: C("d"))
add("ma_w", r6(ma5=f"avg(p) OVER {last(5)}", ma50=f"avg(p) OVER {last(50)}"), ma5=lambda k: W.mean(C("p"), 5, key=k), ma50=lambda k: W.mean(C("p"), 50, key=k))
add("ma_h1", r6(ma20=f"avg(p) OVER {last(21)}", ma5=f"avg(p) OVER {last(6)}"), ma20=lambda k: W.mean_through(C("p"), 20, key=k), ma5=lambda k: W.mean_through(C("p"), 5, key=k))
add("vol_pop", r6(vol5=f"stddev_pop(r) OVER {last(5)}", vol20=f"stddev_pop(r) OVER {last(20)}"), vol5=lambda k: W.std(C("r"), 5, key=k), vol20=lambda k: W.std(C("r"), 20, key=k))
add("dlogv", r6(x=f"coalesce(lv - lag(lv) OVER ({W0}), 0)"), x=lambda k: W.difference(C("lv"), key=k))
add("rsi14", r6(rsi=f"100 - 100 / (1 + avg(greatest(d, 0)) OVER {last(14)} / (avg(greatest(-d, 0)) OVER {last(14)} + 1e-12))"), rsi=lambda k: W.rsi(C("d"), key=k))
add("acceleration", r6(acc=f"p / coalesce(lag(p, 5) OVER ({W0}), first_value(p) OVER ({W0})) - 1"), acc=lambda k: W.acceleration(C("p"), key=k))
add("target", r6(t=f"coalesce(p / lag(p) OVER ({W0}) - 1, 0)"), t=lambda k: W.target(C("p"), key=k))
add("signed_root", r6(x=f"sign(g) * pow(abs(g), 0.25)"), "gr", f"{RET}, gr AS (SELECT *, p / first_value(p) OVER ({W0}) - 1 AS g FROM rets)", grown=True, x=lambda k: signed_root(C("g")))


@query(pick(RET, "rets", f"sum(CASE WHEN i > 0 THEN sign(d) * v ELSE 0 END) OVER ({W0} ROWS UNBOUNDED PRECEDING) AS obv"))
def obv(spark, sf_dir):
    moved = in_blocks(bars_of(spark, sf_dir), lambda df, keys: df.withColumn("d", W.difference(C("p"), keys)), ["stk"], "i", 1)
    return six(W.with_obv(moved, "d", "v", "obv").select("stk", "i", "obv"))


@query(pick(RET, "rets", *r6(g=f"p / first_value(p) OVER ({W0}) - 1")))
def growth(spark, sf_dir):
    return six(W.with_growth(bars_of(spark, sf_dir), g="p").select("stk", "i", "g"))


@query(pick(RET, "rets", *r6(s=f"stddev_pop(CASE WHEN i >= 60 THEN r END) OVER ({W0} ROWS UNBOUNDED PRECEDING) + 1e-12")))
def expanding_std(spark, sf_dir):
    moved = in_blocks(bars_of(spark, sf_dir), lambda df, keys: df.withColumn("r", W.returns(C("p"), keys)), ["stk"], "i", 1)
    return six(W.with_expanding_std(moved, "r", 60, "s").select("stk", "i", "s"))


@query(pick(EMA, "emas", *r6(e12="e12", e26="e26")))
def ema12_26(spark, sf_dir):
    both = lambda df, keys: W.ema(W.ema(df, "p", 12, "e12", keys), "p", 26, "e26", keys).select(*keys, "i", "e12", "e26")
    return six(in_blocks(bars_of(spark, sf_dir), both, ["stk"], "i", feats.HALO))


@query(pick(EMA, "emas", *r6(macd="macd", macd_hist="macd_hist")))
def macd_hist(spark, sf_dir):
    return six(in_blocks(bars_of(spark, sf_dir), lambda df, keys: feats.macd(df, key=keys), ["stk"], "i", feats.HALO).select("stk", "i", "macd", "macd_hist"))


@query(pick(FEATS, "feats", *r6(obv_z="f16", volume_z="f12")))
def z_scores(spark, sf_dir):
    return six(feats.features(bars_of(spark, sf_dir)).select("stk", "i", C("f16").alias("obv_z"), C("f12").alias("volume_z")))


@query(pick(FEATS, "feats", "round(r, 6) AS r", "round(vol20, 6) AS vol20", *r6(**{f: f for f in feats.NAMES})))
def features18(spark, sf_dir):
    return six(feats.features(bars_of(spark, sf_dir)).drop("p"))


@query(pick(RET + f""",
m AS (SELECT *, avg(p) OVER {last(6)} AS m5, avg(v) OVER {last(6)} AS vm FROM rets),
x AS (SELECT stk, i, r, p / m5 - 1 AS x2, ln(greatest(v, 1e-12) / greatest(vm, 1e-12)) AS x4 FROM m)""", "x", *r6(r="r", x1="r", x2="x2", x3="x2", x4="x4", x5="r * x4")))  # fmt: skip
def features5(spark, sf_dir):
    return six(feats.features5(bars_of(spark, sf_dir)).drop("p"))


# --- forecasts and scores ---------------------------------------------------------------------------------------------


@query(f"{BARS}\nSELECT stk, i, round({MA}, 6) AS y_pred FROM bars")
def pred_ma(spark, sf_dir):
    return six(R.METHODS["ma_reversion"](bars_of(spark, sf_dir)).select("stk", "i", "y_pred"))


@query(scored_sql(MA) + f"\nSELECT stk, n, {S6} FROM scores")
def score_ma(spark, sf_dir):
    return six(score.evaluate_forecasts(R.METHODS["ma_reversion"](bars_of(spark, sf_dir))))


@query(scored_sql(MA) + "\nSELECT stk, n, round(base, 6) AS base, round(abs, 6) AS abs, round(1 - abs / base, 6) AS rel FROM scores")
def score_ma_ieee(spark, sf_dir):
    """The first rule: no case for a base of 0."""
    return six(score.evaluate_forecasts(R.METHODS["ma_reversion"](bars_of(spark, sf_dir)), zero=None))


@query(scored_sql("0.0") + f"\nSELECT stk, n, {S6} FROM scores")
def score_zero(spark, sf_dir):
    return six(score.evaluate_forecasts(R.METHODS["zero"](bars_of(spark, sf_dir))))


BOTH = f"""{BARS},
pt AS (SELECT method, stk, i, y_pred, coalesce(p / lag(p) OVER (PARTITION BY method, stk ORDER BY i) - 1, 0) AS target FROM (
  SELECT 'zero' AS method, stk, i, p, 0.0 AS y_pred FROM bars UNION ALL SELECT 'ma_reversion', stk, i, p, {MA} FROM bars)),
{SCORED.format(key="method, stk")}"""
SUMMARY = f"""{BOTH},
s AS (SELECT method, median(abs) AS median_abs, avg(abs) AS mean_abs, median(rel) AS median_rel, avg(rel) AS mean_rel, avg(CASE WHEN rel > 0 THEN 100.0 ELSE 0 END) AS pct_rel_pos FROM scores GROUP BY method)"""
MEASURES = ("median_abs", "mean_abs", "median_rel", "mean_rel", "pct_rel_pos")


def both(spark, sf_dir) -> DataFrame:
    return R.compare(bars_of(spark, sf_dir), ["zero", "ma_reversion"])


@query(f"{SUMMARY}\nSELECT method, {', '.join(f'round({m}, 6) AS {m}' for m in MEASURES)} FROM s")
def panel_summary(spark, sf_dir):
    return six(score.summary(both(spark, sf_dir)))


@query(f"{SUMMARY}\nSELECT s.method, {', '.join(f'round(s.{m}, 6) AS {m}, round(s.{m} - b.{m}, 6) AS d_{m}' for m in MEASURES)} FROM s, s b WHERE b.method = 'zero'")
def delta_vs_base(spark, sf_dir):
    return six(score.against_baseline(score.summary(both(spark, sf_dir)), "zero", round_first=False))


@query(f"{BOTH}\nSELECT a.stk, round(a.abs, 6) AS abs_zero, round(a.rel, 6) AS rel_zero, round(b.abs, 6) AS abs_ma_reversion, round(b.rel, 6) AS rel_ma_reversion FROM scores a JOIN scores b USING (stk) WHERE a.method = 'zero' AND b.method = 'ma_reversion'")
def wide_pivot(spark, sf_dir):
    return six(score.wide(both(spark, sf_dir), ["zero", "ma_reversion"]))


@query(f"{BOTH}\nSELECT count(*) FILTER (b.rel > a.rel) AS wins, count(*) FILTER (b.rel = a.rel) AS ties, count(*) AS keys FROM scores a JOIN scores b USING (stk) WHERE a.method = 'zero' AND b.method = 'ma_reversion'")
def head_to_head(spark, sf_dir):
    return score.head_to_head(both(spark, sf_dir), "ma_reversion", "zero")


@query(scored_sql(MA) + """, l AS (SELECT 'base' AS measure, base AS x FROM scores UNION ALL SELECT 'abs', abs FROM scores UNION ALL SELECT 'rel', rel FROM scores)
SELECT measure, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, round(median(x), 6) AS median FROM l GROUP BY measure""")  # fmt: skip
def panel_stats(spark, sf_dir):
    return six(score.panel_stats(score.evaluate_forecasts(R.METHODS["ma_reversion"](bars_of(spark, sf_dir)))))


@query(scored_sql(MA) + "\nSELECT stk, coalesce(try_cast(regexp_replace(stk, '[^0-9]', '', 'g') AS BIGINT), 0) AS order_key, n FROM scores")
def natural_order(spark, sf_dir):
    return score.in_natural_order(score.evaluate_forecasts(R.METHODS["ma_reversion"](bars_of(spark, sf_dir)))).select("stk", "order_key", "n")


SWEEP = (0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 1.0)


@query(f"""{BARS}, m AS (SELECT *, {MA} AS raw FROM bars),
pt AS (SELECT shrink, stk, i, least(greatest(raw * shrink / 1.0, -0.03), 0.03) AS y_pred, coalesce(p / lag(p) OVER (PARTITION BY shrink, stk ORDER BY i) - 1, 0) AS target FROM m, (SELECT unnest([{', '.join(f'{s}::DOUBLE' for s in SWEEP)}]) AS shrink)),
{SCORED.format(key="shrink, stk")}
SELECT shrink, stk, n, {S6} FROM scores""")  # fmt: skip
def shrink_sweep_ma(spark, sf_dir):
    return six(R.shrink_sweep(R.METHODS["ma_reversion"](bars_of(spark, sf_dir)), 1.0, list(SWEEP)))


@query(f"""{BARS}, t AS (SELECT *, row_number() OVER (PARTITION BY stk ORDER BY i DESC) AS back FROM bars),
tt AS (SELECT CAST(len AS INT) AS length, stk, row_number() OVER (PARTITION BY len, stk ORDER BY i) - 1 AS i, p FROM t, (SELECT unnest([250, 500, 1000, 2000, 0]) AS len) WHERE len = 0 OR back <= len),
pt AS (SELECT length, stk, i, least(greatest(avg(p) OVER (PARTITION BY length, stk ORDER BY i ROWS 5 PRECEDING) / greatest(p, 1e-12) - 1, -0.07), 0.07) AS y_pred, coalesce(p / lag(p) OVER (PARTITION BY length, stk ORDER BY i) - 1, 0) AS target FROM tt),
{SCORED.format(key="length, stk")}
SELECT length, stk, n, {S6} FROM scores""")  # fmt: skip
def tail_sweep_ma(spark, sf_dir):
    return six(R.tail_sweep(bars_of(spark, sf_dir), [250, 500, 1000, 2000, None], R.METHODS["ma_reversion"]))


@query(f"""{RET}, ends AS (SELECT min(r) AS lo, max(r) AS hi FROM rets),
b AS (SELECT CAST(least(floor((r - lo) / (hi - lo) * 10) + 1, 10) AS INT) AS bin, lo, hi FROM rets, ends)
SELECT bin, round(lo + (hi - lo) / 10 * (bin - 1), 6) AS low, round(lo + (hi - lo) / 10 * bin, 6) AS high, count(*) AS n FROM b GROUP BY bin, lo, hi""")  # fmt: skip
def histogram(spark, sf_dir):
    return six(score.histogram(bars_of(spark, sf_dir).select(W.returns(C("p")).alias("r")), "r"))


# --- exploration ------------------------------------------------------------------------------------------------------

VIEW = f"""{BARS},
a1 AS (SELECT stk, i, p, v, p / first_value(p) OVER ({W0}) - 1 AS g, v / first_value(v) OVER ({W0}) - 1 AS gv FROM bars),
a2 AS (SELECT *, avg(g) OVER {last(21)} AS ma_g, avg(gv) OVER {last(21)} AS wm FROM a1),
a3 AS (SELECT *, g - ma_g AS diff, coalesce(lag(ma_g, 5) OVER ({W0}), first_value(ma_g) OVER ({W0})) AS before, CASE WHEN abs(wm) < 1e-9 THEN 0 ELSE sign(wm) * pow(abs(wm), 0.25) END AS w FROM a2),
view AS (SELECT *, CASE WHEN before <> 0 THEN ma_g / before - 1 END AS acc, CASE WHEN abs(g) >= 1e-9 THEN w / g END AS w_g FROM a3)"""


@query(pick(VIEW, "view", *r6(g="g", ma_g="ma_g", diff="diff", acc="acc", w="w", w_g="w_g")))
def growth_view(spark, sf_dir):
    return six(explore.growth_view(bars_of(spark, sf_dir)).withColumn("acc", explore.usable("acc")))


@query(f"{VIEW}\nSELECT stk, count(*) AS n, round(CASE WHEN count(*) > 60 THEN corr(diff, acc) FILTER (i >= 50) END, 6) AS corr_diff_acc, round(corr(g, w), 6) AS corr_g_w, round(arg_max(g, i), 6) AS g_end, round(stddev_pop(diff), 6) AS vol_diff FROM view GROUP BY stk")
def explore_panel(spark, sf_dir):
    return six(explore.panel_table(bars_of(spark, sf_dir)))


PANEL = f"{VIEW}, panel AS (SELECT stk, CASE WHEN count(*) > 60 THEN corr(diff, acc) FILTER (i >= 50) END AS corr_diff_acc, corr(g, w) AS corr_g_w FROM view GROUP BY stk)"


@query(f"{PANEL}\nSELECT round(median(corr_diff_acc), 6) AS corr_diff_acc, round(median(corr_g_w), 6) AS corr_g_w FROM panel")
def explore_medians(spark, sf_dir):
    """The row below the panel table: medians over the keys."""
    return six(explore.medians(explore.panel_table(bars_of(spark, sf_dir))))


POINTS = 200


@query(f"""{BARS}, b AS (SELECT stk, i, p, (i * {POINTS // 2}) // count(*) OVER (PARTITION BY stk) AS bucket FROM bars),
e AS (SELECT stk, bucket, arg_min(i, [p, i]) AS low, arg_max(i, [p, -i]) AS high FROM b GROUP BY stk, bucket)
SELECT DISTINCT stk, i, round(p, 6) AS p FROM b JOIN e USING (stk, bucket) WHERE i IN (low, high)""")
def plotted_line(spark, sf_dir):
    """What a line plot of each key's price shows at this many points: the extremes of equal stretches."""
    return six(explore.extremes(bars_of(spark, sf_dir), "p", POINTS))


@query(f"{VIEW}, o AS (SELECT w_g FROM view WHERE w_g IS NOT NULL AND i >= 50), ends AS (SELECT min(w_g) AS lo, max(w_g) AS hi FROM o)\nSELECT CAST(least(floor((w_g - lo) / (hi - lo) * 10) + 1, 10) AS INT) AS bin, round(lo + (hi - lo) / 10 * (CAST(least(floor((w_g - lo) / (hi - lo) * 10) + 1, 10) AS INT) - 1), 6) AS low, round(lo + (hi - lo) / 10 * CAST(least(floor((w_g - lo) / (hi - lo) * 10) + 1, 10) AS INT), 6) AS high, count(*) AS n FROM o, ends GROUP BY ALL")
def ratio_hist(spark, sf_dir):
    return six(score.histogram(explore.growth_view(bars_of(spark, sf_dir)).where("i >= 50").select(no_nan(C("w_g")).alias("w_g")), "w_g"))


# --- ridge and trees --------------------------------------------------------------------------------------------------

MOMENTS = ["n", "sy", "sx0", "sx11", "sy3", "s0_0", "s3_11", "s16_17"]


@query(f"""{FEATS}, y AS (SELECT *, lead(r) OVER ({W0}) AS y FROM feats)
SELECT stk, i, count(y) OVER w AS n, {', '.join(f'round(coalesce(sum({x}) OVER w, 0), 6) AS {n}' for n, x in (("sy", "y"), ("sx0", "f00"), ("sx11", "f11"), ("sy3", "f03 * y"), ("s0_0", "f00 * f00"), ("s3_11", "f03 * f11"), ("s16_17", "f16 * f17")))}
FROM y WINDOW w AS ({W0} ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)""")  # fmt: skip
def ridge_moments(spark, sf_dir):
    return six(ridge.running_moments(feats.features(bars_of(spark, sf_dir)), feats.NAMES, 252).select("stk", "i", *MOMENTS))


def forecast(method: str) -> Callable:
    def run(spark, sf_dir):
        return six(R.METHODS[method](bars_of(spark, sf_dir)).select("stk", "i", "y_pred"))

    return run


BLEND = f"""{ridge_sql.forecasts(FEATS, R.BASE)}"""
#: The CTEs of each method's forecasts, and its y_pred over ``pred``.
FORECASTS = {"zero": (f"{BARS}, pred AS (SELECT *, 0.0 AS y_pred FROM bars)", "y_pred"), "ma_reversion": (f"{BARS}, pred AS (SELECT *, {MA} AS y_pred FROM bars)", "y_pred"), "online5": (ridge_sql.online5(BARS), "y_pred")}
FORECASTS |= {n: (ridge_sql.forecasts(FEATS, plan), "y_pred") for n, plan in R.PLANS.items()}
FORECASTS |= {"pooled_ridge": (ridge_sql.forecasts(FEATS, R.POOLED, True), "y_pred"), "half_blend": (BLEND, "0.5 * y_pred"), "sign_conservative": (BLEND, "sign(y_pred) * least(abs(y_pred), 0.3 * vol20)")}


def made_by(method: str, as_: str = "y_pred") -> str:
    """A subquery: stk, i, p, raw forecast where there is one, and the method's y_pred."""
    ctes, y = FORECASTS[method]
    return f"({ctes}\nSELECT stk, i, p, {y} AS {as_} FROM pred)"


def swept_sql(source: str, name: str, values, y: str) -> str:
    """Summaries by a parameter whose forecasts are ``y`` over the columns of ``source``."""
    return f"""WITH pt AS (SELECT {name}, stk, i, {y} AS y_pred, {TARGET.format(key=f"{name}, stk")} FROM {source}, (SELECT unnest([{', '.join(f'{v}::DOUBLE' for v in values)}]) AS {name})),
{SCORED.format(key=f"{name}, stk")}
SELECT {name}, {SUMMED} FROM scores GROUP BY {name}"""


SUMMED = "round(median(abs), 6) AS median_abs, round(avg(abs), 6) AS mean_abs, round(median(rel), 6) AS median_rel, round(avg(rel), 6) AS mean_rel, round(avg(CASE WHEN rel > 0 THEN 100.0 ELSE 0 END), 6) AS pct_rel_pos"

for _q, _m in {
    "pred_zero": "zero", "pred_ridge_v2": "baseline_v2", "pred_ridge_submitted": "submitted", "pred_ridge_tight": "tight", "pred_ridge_roll80": "roll80", "pred_ridge_roll120": "roll120",
    "pred_ridge_roll252": "roll252", "pred_ridge_roll504": "roll504", "pred_ridge_clipy": "clipy", "pred_volscale": "vol_0.20", "pred_all": "all_0.20", "pred_online5": "online5",
    "pred_pooled_ridge": "pooled_ridge", "half_blend": "half_blend", "sign_conservative": "sign_conservative",
}.items():
    query(f"SELECT stk, i, round(y_pred, 6) AS y_pred FROM {made_by(_m)}", _q)(forecast(_m))

RIDGE_PANEL = ("zero", "ma_reversion", "online5", "baseline_v2", "submitted", "tight", "roll80", "roll120", "roll252", "roll504", "vol_0.10", "vol_0.20", "clipy", "all_0.10", "all_0.20", "pooled_ridge", "half_blend", "sign_conservative")


@query(f"""WITH pt AS (SELECT method, stk, i, y_pred, {TARGET.format(key="method, stk")} FROM ({" UNION ALL ".join(f"SELECT '{m}' AS method, * FROM {made_by(m)}" for m in RIDGE_PANEL)})),
{SCORED.format(key="method, stk")}
SELECT method, {SUMMED} FROM scores GROUP BY method""")  # fmt: skip
def score_ridge_panel(spark, sf_dir):
    return six(score.summary(R.compare(bars_of(spark, sf_dir), list(RIDGE_PANEL))))


#: The parameters of the sweeps.
SHRINKS, POOLED_SHRINKS, PARAM_SHRINKS = (0.00, 0.02, 0.04, 0.06, 0.08, 0.10, 0.12, 0.15, 0.20, 0.30, 0.50, 1.00), (0.05, 0.08, 0.10, 0.15, 0.20, 0.30), (0.20, 0.35, 0.50, 0.70)
ALPHAS, SCALES = (0.0, 0.25, 0.5, 0.75, 1.0), (0.3, 0.5, 0.7, 1.0)


@query(swept_sql(made_by("baseline_v2", "y"), "shrink", SHRINKS, "least(greatest(y * shrink / 0.1, -0.03), 0.03)"))
def shrink_sweep_ridge(spark, sf_dir):
    """The base forecasts, shrunk and clipped, rescaled and clipped again."""
    return six(score.summary(R.shrink_sweep(R.METHODS["baseline_v2"](bars_of(spark, sf_dir)), 0.10, list(SHRINKS)), ["shrink"]))


@query(swept_sql(made_by("baseline_v2", "y"), "shrink", PARAM_SHRINKS, "least(greatest(y * shrink / 0.35, -0.05), 0.05)"))
def shrink_sweep_param(spark, sf_dir):
    """The rescaled predictor, which takes the base forecasts as those of shrinkage 0.35, and clips them at 0.05."""
    return six(score.summary(R.shrink_sweep(R.METHODS["baseline_v2"](bars_of(spark, sf_dir)), 0.35, list(PARAM_SHRINKS), 0.05), ["shrink"]))


@query(swept_sql(f"({FORECASTS['pooled_ridge'][0]}\nSELECT stk, i, p, CASE WHEN i < 60 THEN 0 ELSE raw END AS y FROM pred)", "shrink", POOLED_SHRINKS, "least(greatest(y * shrink / 1.0, -0.03), 0.03)"))
def shrink_sweep_pooled(spark, sf_dir):
    pred = R.METHODS["pooled_ridge"](bars_of(spark, sf_dir)).withColumn("y_pred", C("raw"))
    return six(score.summary(R.shrink_sweep(pred, 1.0, list(POOLED_SHRINKS)), ["shrink"]))


TAILS = """t0 AS (SELECT *, row_number() OVER (PARTITION BY stk ORDER BY i DESC) AS back FROM bars0),
bars AS (SELECT CAST(len AS INT) || '|' || stk AS stk, CAST(row_number() OVER (PARTITION BY len, stk ORDER BY i) - 1 AS INT) AS i, p, v FROM t0, (SELECT unnest([250, 500, 1000, 2000, 0]) AS len) WHERE len = 0 OR back <= len)"""


@query(f"""WITH pt AS (SELECT CAST(split_part(stk, '|', 1) AS INT) AS length, split_part(stk, '|', 2) AS name, stk, i, y_pred, {TARGET.format(key="stk")} FROM ({ridge_sql.forecasts(FEATS.replace("bars AS (", "bars0 AS (", 1).replace("nsh FROM b0)", "nsh FROM b0), " + TAILS, 1), R.BASE)}
SELECT stk, i, p, y_pred FROM pred)),
{SCORED.format(key="length, stk")}
SELECT length, {SUMMED} FROM scores GROUP BY length""")  # fmt: skip
def tail_sweep_ridge(spark, sf_dir):
    return six(score.summary(R.tail_sweep(bars_of(spark, sf_dir), [250, 500, 1000, 2000, None], R.METHODS["baseline_v2"]), ["length"]))


@query(swept_sql(f"(SELECT * FROM {made_by('baseline_v2', 'a')} JOIN (SELECT stk, i, b FROM {made_by('pooled_ridge', 'b')}) USING (stk, i))", "alpha", ALPHAS, "alpha * a + (1 - alpha) * b"))
def ensemble_alpha(spark, sf_dir):
    b = bars_of(spark, sf_dir)
    a, c = R.METHODS["baseline_v2"](b), R.METHODS["pooled_ridge"](b)
    mixed = a.select("stk", "i", "p", "y_pred").join(c.select("stk", "i", C("y_pred").alias("_c")), ["stk", "i"])
    return six(score.summary(score.swept(mixed, "alpha", list(ALPHAS), lambda v: v * C("y") + (1 - v) * C("_c"), ("_c",)), ["alpha"]))


@query(swept_sql(f"({ridge_sql.forecasts(FEATS, R.POOLED.with_(shrink=0.05), True)}\nSELECT stk, i, p, y_pred AS y FROM pred)", "scale", SCALES, "y * scale"))
def scale_blend(spark, sf_dir):
    pred = ridge.predict_pooled(feats.features(bars_of(spark, sf_dir)), R.POOLED.with_(shrink=0.05))
    return six(score.summary(score.swept(pred, "scale", list(SCALES), lambda v: v * C("y")), ["scale"]))


@query()
def pred_gbt_pooled(spark, sf_dir):
    return six(R.gbt_pooled(bars_of(spark, sf_dir)).select("stk", "i", "y_pred"))


@query()
def pred_gbt(spark, sf_dir):
    return six(R.gbt(bars_of(spark, sf_dir)).select("stk", "i", "y_pred"))


# --- runs whose results are kept --------------------------------------------------------------------------------------


def kept_run(run: str, shape: Callable) -> Callable:
    """A run over the bars, its store in the shared folder: methods that an earlier run over the same bars had are not fitted again."""

    def make(spark, sf_dir):
        store = runs.Store(spark, f"{shared_dir(spark)}/panelcast-runs")
        return six(shape(store.run(bars_of(spark, sf_dir), list(runs.RUNS[run].values())), run))

    return make


for _run in runs.RUNS:
    query(name=f"run_{_run}")(kept_run(_run, runs.table))
    query(name=f"run_{_run}_wide")(kept_run(_run, runs.wide))


# --- addresses --------------------------------------------------------------------------------------------------------

CASES = """WITH c AS (SELECT c_custkey AS id, c_mktsegment, n_name, r_name, c_custkey % length(n_name) AS cut FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cases AS (SELECT id, id || ' ' || CASE WHEN id % 2 = 0 THEN lower(c_mktsegment) ELSE translate(c_mktsegment, 'AEIO', 'ÀÉÌÒ') END || ', ' ||
  CASE WHEN id % 3 = 0 THEN substr(n_name, 1, cut) || substr(n_name, cut + 2) ELSE n_name END || ', ' || r_name AS text, r_name AS province, n_name AS ward, c_mktsegment AS street FROM c)"""
_MARKED, _PLAIN = "".join(address.MARKS.values()), "".join(k * len(v) for k, v in address.MARKS.items())
NORM = lambda x: rf"trim(regexp_replace(regexp_replace(translate(lower({x}), '{_MARKED}', '{_PLAIN}'), '\p{{M}}+', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
MATCH = rf"""{CASES}, names AS (SELECT 'province' AS kind, r_name AS name FROM region UNION ALL SELECT 'ward', n_name FROM nation UNION ALL SELECT DISTINCT 'street', c_mktsegment FROM customer),
parts AS (SELECT id, 'province' AS kind, split_part(text, ',', 3) AS part FROM cases UNION ALL SELECT id, 'ward', split_part(text, ',', 2) FROM cases UNION ALL SELECT id, 'street', regexp_replace(split_part(text, ',', 1), '^\s*[0-9]+[A-Za-z]?(/[0-9]+)*\s+', '') FROM cases),
ranked AS (SELECT id, kind, name, row_number() OVER (PARTITION BY id, kind ORDER BY levenshtein({NORM("part")}, {NORM("name")}), -length({NORM("name")}), name) AS k FROM parts JOIN names USING (kind)),
answers AS (SELECT id, max(name) FILTER (kind = 'province') AS province, max(name) FILTER (kind = 'ward') AS ward, max(name) FILTER (kind = 'street') AS street FROM ranked WHERE k = 1 GROUP BY id)"""


@query(f"{MATCH}\nSELECT * FROM answers")
def address_match_lev(spark, sf_dir):
    return address.nearest(*address.cases_of(spark, sf_dir))


def judged(spark, sf_dir, matcher) -> DataFrame:
    cases, names = address.cases_of(spark, sf_dir)
    return address.judge(cases, matcher(cases, names))


@query(f"{MATCH}\nSELECT c.id, c.text, " + ", ".join(f"c.{f}, a.{f} AS {f}_student, c.{f} AS {f}_normalized, a.{f} AS {f}_student_normalized, (c.{f} = a.{f})::INT AS {f}_correct" for f in address.FIELDS) + ", " + " + ".join(f"(c.{f} = a.{f})::INT" for f in address.FIELDS) + " AS total_correct FROM cases c JOIN answers a USING (id)")
def address_details(spark, sf_dir):
    return judged(spark, sf_dir, address.nearest)


@query(f"{MATCH}\nSELECT sum(" + " + ".join(f"(c.{f} = a.{f})::INT" for f in address.FIELDS) + ")::BIGINT AS correct, 3 * count(*) AS total, round(sum(" + " + ".join(f"(c.{f} = a.{f})::INT" for f in address.FIELDS) + ") * 10 / (3 * count(*)), 2) AS score FROM cases c JOIN answers a USING (id)")
def address_judge(spark, sf_dir):
    return address.total(judged(spark, sf_dir, address.nearest))


@query(f"{CASES}, f AS (SELECT (SELECT min(r_name) FROM region) AS p, (SELECT min(n_name) FROM nation) AS w, (SELECT min(c_mktsegment) FROM customer) AS s)\nSELECT sum((province = p)::INT + (ward = w)::INT + (street = s)::INT)::BIGINT AS correct, 3 * count(*) AS total, round(sum((province = p)::INT + (ward = w)::INT + (street = s)::INT) * 10 / (3 * count(*)), 2) AS score FROM cases, f")
def address_stub(spark, sf_dir):
    return address.total(judged(spark, sf_dir, address.stub))


NAMES_SQL = "names AS (SELECT 'province' AS kind, r_name AS name FROM region UNION ALL SELECT 'ward', n_name FROM nation UNION ALL SELECT DISTINCT 'street', c_mktsegment FROM customer)"
#: The cheapest way over all combinations of runs of words, each compared with all names.
FREE = f"""{CASES}, {NAMES_SQL},
norms AS MATERIALIZED (SELECT kind, name, {NORM("name")} AS norm FROM names),
longest AS (SELECT max(len(string_split(norm, ' '))) AS longest FROM norms),
words AS (SELECT id, string_split({NORM("replace(text, ',', '')")}, ' ') AS w FROM cases),
runs AS MATERIALIZED (SELECT id, lo, hi, array_to_string(w[lo + 1:hi], ' ') AS part, coalesce(list_sum(list_transform(w[lo + 1:hi], lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN 0 ELSE length(x) END)), 0)::INT AS saved
  FROM words, longest, unnest(range(len(w))) a(lo), unnest(range(lo + 1, least(len(w), lo + longest + 1) + 1)) b(hi)),
near AS (SELECT kind, part, name, norm, levenshtein(part, norm) AS distance FROM (SELECT DISTINCT part FROM runs), norms WHERE levenshtein(part, norm) <= least(length(part) // 4, {address.EDITS})),
hits AS MATERIALIZED (SELECT kind, part, name, distance, length(norm) AS letters, row_number() OVER (PARTITION BY kind, part ORDER BY distance, -length(norm), name) AS k FROM near),
found AS MATERIALIZED (SELECT id, kind, lo, hi, name, distance - saved AS cost, letters FROM runs JOIN hits USING (part) WHERE k = 1
  UNION ALL SELECT id, kind, NULL, NULL, '', {address.MISSING}, 0 FROM cases, (SELECT unnest(['street', 'ward', 'province']) AS kind)),
ways AS (SELECT s.id, s.name AS street, w.name AS ward, p.name AS province, s.cost + w.cost + p.cost AS cost, s.letters + w.letters + p.letters AS letters
  FROM found s JOIN found w ON w.id = s.id AND w.kind = 'ward' AND (s.hi IS NULL OR w.lo IS NULL OR s.hi <= w.lo)
  JOIN found p ON p.id = s.id AND p.kind = 'province' AND (w.hi IS NULL OR p.lo IS NULL OR w.hi <= p.lo) AND (s.hi IS NULL OR p.lo IS NULL OR s.hi <= p.lo) WHERE s.kind = 'street'),
answers AS (SELECT id, nullif(province, '') AS province, nullif(ward, '') AS ward, nullif(street, '') AS street FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cost, -letters, street, ward, province) AS k FROM ways) WHERE k = 1)"""


def without_commas(spark, sf_dir):
    cases, names = address.cases_of(spark, sf_dir)
    return cases.withColumn("text", F.replace("text", F.lit(","), F.lit(""))), names


@query(f"{FREE}\nSELECT * FROM answers")
def address_segmented(spark, sf_dir):
    return address.segmented(*without_commas(spark, sf_dir))


@query(f"{FREE}\nSELECT sum(" + " + ".join(f"coalesce((c.{f} = a.{f})::INT, 0)" for f in address.FIELDS) + ")::BIGINT AS correct, 3 * count(*) AS total, round(sum(" + " + ".join(f"coalesce((c.{f} = a.{f})::INT, 0)" for f in address.FIELDS) + ") * 10 / (3 * count(*)), 2) AS score FROM cases c JOIN answers a USING (id)")
def address_segmented_judge(spark, sf_dir):
    cases, names = without_commas(spark, sf_dir)
    return address.total(address.judge(cases, address.segmented(cases, names)))


class _Strict(address.FirstNames):
    """First names, and no answer for texts in which the word AMERICA occurs."""

    def process(self, text):
        if "AMERICA" in text:
            raise ValueError(text)
        return super().process(text)


@query(f"{CASES}, f AS (SELECT (SELECT min(r_name) FROM region) AS province, (SELECT min(n_name) FROM nation) AS ward, (SELECT min(c_mktsegment) FROM customer) AS street)\nSELECT c.id, c.text, " + ", ".join(f"c.{f}, CASE WHEN c.text LIKE '%AMERICA%' THEN 'EXCEPTION' ELSE f.{f} END AS {f}_student, c.{f} AS {f}_normalized, CASE WHEN c.text LIKE '%AMERICA%' THEN 'EXCEPTION' ELSE f.{f} END AS {f}_student_normalized, (c.{f} = f.{f} AND c.text NOT LIKE '%AMERICA%')::INT AS {f}_correct" for f in address.FIELDS) + ", " + " + ".join(f"(c.{f} = f.{f} AND c.text NOT LIKE '%AMERICA%')::INT" for f in address.FIELDS) + " AS total_correct FROM cases c, f")
def address_solution(spark, sf_dir):
    # how long a case took differs from run to run
    return judged(spark, sf_dir, lambda cases, names: address.solved(cases, names, _Strict)).drop("time_sec")


@query("SELECT n_name AS a, r_name AS b, levenshtein(n_name, r_name) AS distance FROM nation, region")
def edit_distance(spark, sf_dir):
    t = lambda n, c: spark.read.parquet(f"{sf_dir}/{n}.parquet").select(C(c).alias("name"))
    return address.edit_distances(t("nation", "n_name"), t("region", "r_name"))
