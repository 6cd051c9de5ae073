"""Walk-forward ridge regression.

At row t = warm, warm + refit, ... a model is fitted on pairs (features of row k, return of row k + 1), k in [max(0, t - win), t),
and scores the rows t .. t + refit - 1. Features are standardised by the training rows' mean and population deviation, so the
intercept is the mean target and the slopes solve an 18 x 18 system. Between refits only the new rows' moments are added (and the
old ones' subtracted), about a fixed shift per key; memory does not grow with the series beyond its own columns.

Per-key models run in one Arrow pass over features that are partitioned by key and block (``operators.blocks``). A block starts
at a refit. What a window of ``win`` rows needs of the rows before is in the block's halo; an expanding model needs the moments of
all rows before, which are scanned: each block that another one follows gives its count, means and co-moments, these are merged
along the key (a row per block), and each block goes on from what lies before it. The spread of all forecasts so far, by which
some are scaled, is scanned the same way. Keys of a single block give nothing to scan.

Pooled models sum the moments of all keys per refit as an aggregation and solve in batches: one row per refit."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import EPS, clip
from ..session import kept
from . import windows as W
from .blocks import ROWS, in_blocks, spread
from .features import HALO, NAMES, NAMES5, features_of


@dataclass(frozen=True)
class Plan:
    """Parameters of a walk-forward model; win None: all rows so far. ratio: scale forecasts to this share of volatility instead of shrinking."""

    warm: int = 60
    refit: int = 5
    win: int | None = None
    lam: float = 5.0
    shrink: float = 0.10
    clip: float = 0.03
    y_clip: float | None = None
    ratio: float | None = None

    def with_(self, **changes) -> Plan:
        return replace(self, **changes)


def solve(n: np.ndarray, sx: np.ndarray, sxx: np.ndarray, sxy: np.ndarray, sy: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, deviation, slopes, intercept) of batches of moments; a constant column gets slope 0."""
    mu = sx / n[:, None]
    var = np.maximum(np.einsum("mii->mi", sxx) / n[:, None] - mu * mu, 0)
    scale = np.einsum("mii->mi", sxx) / n[:, None]
    sd = np.sqrt(np.where(var <= 1e-14 * scale, 0, var)) + EPS
    flat = sd <= 2 * EPS
    cov = (sxx - n[:, None, None] * mu[:, :, None] * mu[:, None, :]) / (sd[:, :, None] * sd[:, None, :])
    cov[flat] = 0
    cov.transpose(0, 2, 1)[flat] = 0
    right = (sxy - mu * sy[:, None]) / sd
    right[flat] = 0
    beta = np.linalg.solve(cov + lam * np.eye(sx.shape[1]), right[..., None])[..., 0]
    return mu, sd, beta, sy / n


class Moments:
    """Count, mean, co-moments of x, and for each way of clipping y its mean and co-moments with x; merged pairwise."""

    def __init__(self, x: np.ndarray, ys: list[np.ndarray]):
        self.n, self.mean = len(x), x.mean(0)
        z = x - self.mean
        self.xx, self.y, self.xy = z.T @ z, np.array([y.mean() for y in ys]), np.array([z.T @ y for y in ys])

    def add(self, new: Moments) -> None:
        n, gap, rise = self.n + new.n, new.mean - self.mean, new.y - self.y
        self.xx = self.xx + new.xx + np.outer(gap, gap) * (self.n * new.n / n)
        self.xy = self.xy + new.xy + rise[:, None] * gap * (self.n * new.n / n)
        self.mean, self.y, self.n = self.mean + gap * (new.n / n), self.y + rise * (new.n / n), n

    def packed(self) -> list[float]:
        return [float(self.n), *self.mean, *self.xx.ravel(), *self.y, *self.xy.ravel()]

    @classmethod
    def unpacked(cls, v, d: int) -> Moments:
        v, out = np.asarray(v, float), cls.__new__(cls)
        ways = (len(v) - 1 - d - d * d) // (d + 1)
        out.n, out.mean, out.xx = int(v[0]), v[1 : 1 + d], v[1 + d : 1 + d + d * d].reshape(d, d)
        rest = v[1 + d + d * d :]
        out.y, out.xy = rest[:ways], rest[ways:].reshape(ways, d)
        return out


def walk_forward(x: np.ndarray, r: np.ndarray, plan: Plan, own: int = 0, before: Moments | None = None, way: int = 0) -> np.ndarray:
    """Raw forecasts of one series, 0 before the warm-up.

    With ``own`` the rows from there on are a later block of a series, which starts at a refit, and those before it are its halo:
    ``before`` has the pairs whose target is in earlier blocks, and forecasts of the halo are 0. Its ``way``: how y is clipped."""
    n, d = x.shape
    out = np.zeros(n)
    fits = np.arange(own or plan.warm, n, plan.refit)
    if not len(fits):
        return out
    y = np.append(r[1:], 0.0)
    if plan.y_clip:
        y = np.clip(y, -plan.y_clip, plan.y_clip)
    low = high = max(own - plan.win, 0) if own and plan.win else max(own - 1, 0)
    past = before if before is not None and not plan.win else None
    shift = past.mean if past else x[low : low + plan.warm].mean(0)
    z, earlier = x - shift, past.n if past else 0
    sx, sxx, sxy, sy = np.zeros(d), np.zeros((d, d)), np.zeros(d), 0.0
    if past:
        sxx, sxy, sy = past.xx, past.xy[way], past.n * past.y[way]

    def add(a, b, sign):
        nonlocal sx, sxx, sxy, sy
        part, t = z[a:b], y[a:b]
        sx, sxx, sxy, sy = sx + sign * part.sum(0), sxx + sign * part.T @ part, sxy + sign * part.T @ t, sy + sign * t.sum()

    for at in range(0, len(fits), 512):
        moments = []
        for t in fits[at : at + 512]:
            add(high, t, 1)
            high = t
            if plan.win and t - plan.win > low:
                add(low, t - plan.win, -1)
                low = t - plan.win
            moments.append((earlier + high - low, sx, sxx, sxy, sy))
        mu, sd, beta, b0 = solve(*(np.array(m, float) for m in zip(*moments, strict=True)), plan.lam)
        for j, t in enumerate(fits[at : at + 512]):
            out[t : t + plan.refit] = b0[j] + ((z[t : t + plan.refit] - mu[j]) / sd[j]) @ beta[j]
    return out


def _scaled(df: DataFrame, plan: Plan) -> DataFrame:
    """y_pred from the raw forecast: shrunk and clipped, 0 before the warm-up."""
    return df.withColumn("y_pred", F.when(F.col("i") < plan.warm, 0.0).otherwise(clip(F.col("raw") * plan.shrink, plan.clip)))


def _clips(plans: dict[str, Plan]) -> list[float]:
    return sorted({p.y_clip or 0.0 for p in plans.values()})


def _forecasts(pdf: pd.DataFrame, known: dict, plans: dict[str, Plan], block: int) -> tuple[pd.DataFrame, int, dict[str, np.ndarray]]:
    """The sorted rows of a block, where its own rows begin, and the raw forecasts by method."""
    pdf, b = pdf.sort_values("i"), int(pdf["_b"].iloc[0])
    warm = next(iter(plans.values())).warm
    own = int(np.searchsorted(pdf.i.to_numpy(), warm + b * block)) if b else 0
    x, r, ways = pdf[NAMES].to_numpy(float), pdf.r.to_numpy(float), _clips(plans)
    before = Moments.unpacked(known["x"], len(NAMES)) if "x" in known else None
    return pdf, own, {n: walk_forward(x, r, p, own, before, ways.index(p.y_clip or 0.0)) for n, p in plans.items()} if own < len(pdf) else {}


def _scan(found: DataFrame, key: str, merge) -> DataFrame:
    """(key, _b, kind, v) of blocks to what lies before each block: ``merge`` folds the packed values of the blocks of a key, a row per block."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, part in pdf.sort_values("_b").groupby("kind"):
            total = None
            for b, v in zip(part["_b"], part.v, strict=True):
                total = v if total is None else merge(kind, total, v)
                out.append((pdf[key].iloc[0], b + 1, kind, total))
        return pd.DataFrame(out, columns=[key, "_b", "kind", "v"])

    return found.groupBy(key).applyInPandas(run, f"{key} string, _b long, kind string, v array<double>")


def _merged_moments(kind: str, a, b):
    total = Moments.unpacked(a, len(NAMES))
    total.add(Moments.unpacked(b, len(NAMES)))
    return total.packed()


def _merged_spread(kind: str, a, b):
    n, gap = a[0] + b[0], b[1] - a[1]
    return [n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n]


def _expanding(raw: np.ndarray, before) -> np.ndarray:
    """Population deviation of ``raw`` so far, after ``before`` (count, mean, sum of squares about it)."""
    n0, m0, s0 = before if before is not None else (0.0, 0.0, 0.0)
    n = np.arange(1, len(raw) + 1)
    shift = raw[0] if len(raw) else 0.0
    mean = np.cumsum(raw - shift) / n
    square = np.maximum(np.cumsum((raw - shift) ** 2) - n * mean * mean, 0)
    gap = mean + shift - m0
    return np.sqrt(np.maximum(s0 + square + gap * gap * n0 * n / (n0 + n), 0) / (n0 + n)) + EPS


def predict_many(bars: DataFrame, plans: dict[str, Plan], key: str = "stk", block: int = ROWS) -> DataFrame:
    """method, key, i, p, vol20, raw and y_pred of several models per key of ``bars`` (key, i, p, v), of equal ``warm``; features are made and moved once for all of them."""
    if len({p.warm for p in plans.values()}) != 1 or any(block % p.refit for p in plans.values()):
        raise ValueError("one warm-up for all, and blocks of whole refit intervals")
    warm, wins, ways = next(iter(plans.values())).warm, [p.win for p in plans.values() if p.win], _clips(plans)
    keys = [key, "_b"]
    bars = kept(bars.select(key, "i", "p", "v"))
    rows = spread(bars, "i", HALO + max(wins, default=0) + 1, 0, block, warm)
    feats = features_of(rows, keys)
    columns = ["method", key, "i", "p", "vol20", "raw", "y_pred"]
    ddl = f"method string, {key} string, i int, p double, vol20 double, raw double, y_pred double"

    def forecast(pdf: pd.DataFrame, known: dict) -> pd.DataFrame:
        pdf, own, raws = _forecasts(pdf, known, plans, block)
        i, vol = pdf.i.to_numpy()[own:], pdf.vol20.to_numpy(float)[own:]
        out = []
        for name, raw in raws.items():
            plan, raw = plans[name], raw[own:]
            if plan.ratio is None:
                y = raw * plan.shrink
            else:
                wide, after = np.ones(len(raw)), int(np.searchsorted(i, warm))
                wide[after:] = _expanding(raw[after:], known.get(name))
                y = raw * plan.ratio * vol / wide
            y = np.where(i < warm, 0.0, np.clip(y, -plan.clip, plan.clip))
            out.append(pd.DataFrame({"method": name, key: pdf[key].iloc[own:], "i": i, "p": pdf.p.iloc[own:], "vol20": vol, "raw": raw, "y_pred": y}))
        return pd.concat(out) if out else pd.DataFrame(columns=columns)

    if (bars.agg(F.max("i")).first()[0] or 0) < warm + block:  # no key has a second block
        return feats.groupBy(*keys).applyInPandas(lambda pdf: forecast(pdf, {}), ddl)
    # blocks that others follow, which have rows to be scanned for these; the filter comes before the features
    last = F.max("i").over(Window.partitionBy(*keys))
    full = features_of(rows.withColumn("_last", last).where(F.col("_last") >= warm + (F.col("_b") + 1) * block - 1), keys)
    scanned = f"{key} string, _b long, kind string, v array<double>"

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, b = pdf.sort_values("i"), int(pdf["_b"].iloc[0])
        first = max(int(np.searchsorted(pdf.i.to_numpy(), warm + b * block)) if b else 0, 1)
        x, y = pdf[NAMES].to_numpy(float)[first - 1 : -1], pdf.r.to_numpy(float)[first:]
        v = Moments(x, [np.clip(y, -c, c) if c else y for c in ways]).packed()
        return pd.DataFrame({key: [pdf[key].iloc[0]], "_b": [b], "kind": ["x"], "v": [v]})

    prior = _scan(full.groupBy(*keys).applyInPandas(sums, scanned), key, _merged_moments)
    scaled = {n: p for n, p in plans.items() if p.ratio is not None}

    def spreads(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=[key, "_b", "kind", "v"])
        pdf, own, raws = _forecasts(pdf, dict(zip(known.kind, known.v, strict=True)), scaled_ways, block)
        own = max(own, 0 if int(pdf["_b"].iloc[0]) else warm)
        out = [(pdf[key].iloc[0], int(pdf["_b"].iloc[0]), n, [float(len(raw) - own), raw[own:].mean(), raw[own:].var() * (len(raw) - own)]) for n, raw in raws.items() if n in scaled]
        return pd.DataFrame(out, columns=[key, "_b", "kind", "v"])

    # the moments of all ways of clipping are there, so all plans decide which way is which
    scaled_ways = scaled if _clips(scaled) == ways else plans
    if scaled:
        spread_ = full.groupBy(*keys).cogroup(prior.groupBy(*keys)).applyInPandas(spreads, scanned)
        prior = prior.unionByName(_scan(spread_, key, _merged_spread))

    def run(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return forecast(pdf, dict(zip(known.kind, known.v, strict=True))) if len(pdf) else pd.DataFrame(columns=columns)

    return feats.groupBy(*keys).cogroup(prior.groupBy(*keys)).applyInPandas(run, ddl)


def predict(bars: DataFrame, plan: Plan, key: str = "stk", block: int = ROWS) -> DataFrame:
    """key, i, p, y_pred and the raw forecast by a model per key of ``bars``."""
    return predict_many(bars, {"one": plan}, key, block).select(key, "i", "p", "raw", "y_pred")


def online5(feats: DataFrame, h: int = 5, lam: float = 0.01, most: float = 0.07, key: str = "stk", block: int = ROWS) -> DataFrame:
    """The first model: five raw features, refitted every row, all but the intercept penalised; a rule before the warm-up.

    Long keys run in blocks with a halo of one row; the products summed in a block are scanned along the key."""
    warm = max(30, h + 5)
    penalty = np.diag([0.0] + [lam] * len(NAMES5))
    d = len(penalty)

    def products(a: np.ndarray, r: np.ndarray) -> np.ndarray:
        """A row per pair (features of a row, return of the next): the products of the features with each other, then with the return."""
        return np.hstack([(a[:-1, :, None] * a[:-1, None, :]).reshape(-1, d * d), a[:-1] * r[1:, None]])

    def read(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        pdf = pdf.sort_values("i")
        return pdf, np.hstack([np.ones((len(pdf), 1)), pdf[NAMES5].to_numpy(float)]), pdf.r.to_numpy(float)

    def forecast(pdf: pd.DataFrame, before) -> pd.DataFrame:
        (pdf, a, r), total = read(pdf), np.zeros(d * d + d) if before is None else np.asarray(before, float)
        i, out = pdf.i.to_numpy(), 0.5 * a[:, 1] - 0.5 * a[:, 2]
        for at in range(1, len(a), 4096):
            sums = total + np.cumsum(products(a[at - 1 : at + 4096], r[at - 1 : at + 4096]), axis=0)
            total, rows = sums[-1], slice(at, at + len(sums))
            ready = i[rows] >= warm
            sums = sums[ready]
            beta = np.linalg.solve(sums[:, : d * d].reshape(-1, d, d) + penalty, sums[:, d * d :, None])[..., 0]
            out[rows][ready] = (a[rows][ready] * beta).sum(1)
        own = i >= int(pdf["_b"].iloc[0]) * block
        return pd.DataFrame({key: pdf[key], "i": pdf.i, "p": pdf.p, "raw": out})[own]

    ddl = f"{key} string, i int, p double, raw double"
    if (feats.agg(F.max("i")).first()[0] or 0) < block:  # no key has a second block
        raw = feats.withColumn("_b", F.lit(0)).groupBy(key).applyInPandas(lambda pdf: forecast(pdf, None), ddl)
    else:
        keys, rows = [key, "_b"], spread(kept(feats), "i", 1, block=block)
        full = rows.withColumn("_last", F.max("i").over(Window.partitionBy(*keys))).where(F.col("_last") >= (F.col("_b") + 1) * block - 1)

        def sums(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, a, r = read(pdf)
            return pd.DataFrame({key: pdf[key].iloc[:1], "_b": pdf["_b"].iloc[:1], "kind": "x", "v": [products(a, r).sum(0).tolist()]})

        def run(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            return forecast(pdf, known.v.iloc[0] if len(known) else None) if len(pdf) else pd.DataFrame(columns=[key, "i", "p", "raw"])

        prior = _scan(full.groupBy(*keys).applyInPandas(sums, f"{key} string, _b long, kind string, v array<double>"), key, lambda kind, x, y: [float(m + n) for m, n in zip(x, y, strict=True)])
        raw = rows.groupBy(*keys).cogroup(prior.groupBy(*keys)).applyInPandas(run, ddl)
    return raw.withColumn("y_pred", clip(F.col("raw"), most))


def moment_columns(names: list[str]) -> list[str]:
    d = len(names)
    return ["n", "sy", *(f"sx{a}" for a in range(d)), *(f"sy{a}" for a in range(d)), *(f"s{a}_{b}" for a in range(d) for b in range(a, d))]


def running_moments(feats: DataFrame, names: list[str], win: int, key: str = "stk", block: int = ROWS) -> DataFrame:
    """Per row t: moments of the pairs k in [max(0, t - win), t), as window sums."""
    return in_blocks(feats, lambda df, keys: _moments(df, names, win, keys), [key], "i", win, 1, block)


def _moments(feats: DataFrame, names: list[str], win: int, key: list[str]) -> DataFrame:
    w = W.by_key(key).rowsBetween(-win, -1)
    y = F.lead("r").over(W.by_key(key))
    c = F.col
    df = feats.withColumn("_y", y)
    total = lambda x: F.coalesce(F.sum(x).over(w), F.lit(0.0))
    cols = {"n": F.count("_y").over(w), "sy": total(c("_y"))}
    cols |= {f"sx{a}": total(c(x)) for a, x in enumerate(names)} | {f"sy{a}": total(c(x) * c("_y")) for a, x in enumerate(names)}
    cols |= {f"s{a}_{b}": total(c(names[a]) * c(names[b])) for a in range(len(names)) for b in range(a, len(names))}
    return df.select(*key, "i", *(v.alias(k) for k, v in cols.items()))


def pooled_models(feats: DataFrame, plan: Plan, key: str = "stk") -> DataFrame:
    """(fit_t, mu, sd, beta, b0) of one model over all keys per refit; keys are aligned by row number."""
    d = len(NAMES)
    block = F.when(F.col("i") < plan.warm, plan.warm).otherwise(plan.warm + (F.floor((F.col("i") - plan.warm) / plan.refit) + 1) * plan.refit)
    df = in_blocks(feats, lambda df, keys: df.withColumn("_y", F.lead("r").over(W.by_key(keys))), [key], "i", 0, 1).where("_y is not null").withColumn("fit_t", block.cast("int"))
    c = F.col
    y = F.least(F.greatest(c("_y"), F.lit(-plan.y_clip)), F.lit(plan.y_clip)) if plan.y_clip else c("_y")
    cols = [F.count(F.lit(1)).cast("double"), F.sum(y), *(F.sum(x) for x in NAMES), *(F.sum(c(x) * y) for x in NAMES), *(F.sum(c(NAMES[a]) * c(NAMES[b])) for a in range(d) for b in range(a, d))]
    parts = df.groupBy("fit_t").agg(F.array(*cols).alias("m")).select("fit_t", F.posexplode("m").alias("j", "v"))
    # one row per refit and moment: the running totals over refits are kept per moment
    totals = parts.withColumn("v", F.sum("v").over(Window.partitionBy("j").orderBy("fit_t")))
    packed = totals.groupBy("fit_t").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s.v).alias("m"))
    upper = np.triu_indices(d)

    @F.pandas_udf("mu array<double>, sd array<double>, beta array<double>, b0 double")
    def fit(m: pd.Series) -> pd.DataFrame:
        v = np.stack(m.to_numpy()).astype(float)
        xx = np.zeros((len(v), d, d))
        xx[:, upper[0], upper[1]] = v[:, 2 + 2 * d :]
        xx[:, upper[1], upper[0]] = v[:, 2 + 2 * d :]
        mu, sd, beta, b0 = solve(v[:, 0], v[:, 2 : 2 + d], xx, v[:, 2 + d : 2 + 2 * d], v[:, 1], plan.lam)
        return pd.DataFrame({"mu": list(mu), "sd": list(sd), "beta": list(beta), "b0": b0})

    return packed.select("fit_t", fit("m").alias("f")).select("fit_t", "f.*")


def predict_pooled(feats: DataFrame, plan: Plan | None = None, key: str = "stk") -> DataFrame:
    """key, i, p, raw, y_pred by the pooled model of the last refit before each row."""
    plan = plan or Plan(refit=20)
    fit_t = F.when(F.col("i") >= plan.warm, plan.warm + F.floor((F.col("i") - plan.warm) / plan.refit) * plan.refit).cast("int")
    x = F.array(*NAMES)
    # one row per refit; whether that is small enough to be broadcast is Spark's to see
    models = pooled_models(feats, plan, key)
    terms = F.zip_with(F.zip_with(x, F.col("mu"), lambda a, b: a - b), F.zip_with(F.col("beta"), F.col("sd"), lambda a, b: a / b), lambda a, b: a * b)
    raw = F.col("b0") + F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    out = feats.withColumn("fit_t", fit_t).join(models, "fit_t", "left").withColumn("raw", F.coalesce(raw, F.lit(0.0)))
    return _scaled(out, plan).select(key, "i", "p", "raw", "y_pred")
