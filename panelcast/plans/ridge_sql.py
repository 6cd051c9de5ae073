"""Walk-forward ridge forecasts in DuckDB's SQL: sums of products per refit, and elimination on lists of lists.

It shares no step with the operators: moments are not shifted, and systems are solved by Gauss-Jordan elimination."""

from __future__ import annotations

from ..functions import EPS
from ..operators.features import NAMES
from ..operators.ridge import Plan


def eliminated(first: str, size: int, keep: str) -> str:
    """CTEs solve1 .. solve<size>: the matrices m of ``first``, with the right side as last column, turned into identities row by row."""
    out = ""
    for c in range(1, size + 1):
        out += f""",
solve{c} AS MATERIALIZED (SELECT {keep}, list_transform(m, lambda e, r: CASE WHEN r = {c} THEN list_transform(e, lambda v: v / m[{c}][{c}]) ELSE list_transform(e, lambda v, w: v - e[{c}] * m[{c}][w] / m[{c}][{c}]) END) AS m FROM {first if c == 1 else f"solve{c - 1}"})"""
    return out


def forecasts(feats: str, plan: Plan, pooled: bool = False) -> str:
    """CTEs up to ``pred`` (stk, i, p, vol20, raw, y_pred), after those of ``feats``."""
    warm, refit, win, lam, y_clip = plan.warm, plan.refit, plan.win, plan.lam, plan.y_clip
    x = NAMES
    key = "0" if pooled else "stk"
    z = ["1.0::DOUBLE", *x, "y"]
    at = {}
    terms = []
    for a in range(20):
        for b in range(a, 20):
            at[a, b] = len(terms) + 1
            terms.append(z[b] if a == 0 else f"{z[a]} * {z[b]}")
    s = lambda a, b: f"s[{at[min(a, b), max(a, b)]}]"
    y = "lead(r) OVER (PARTITION BY stk ORDER BY i)"
    y = f"least(greatest({y}, -{y_clip}), {y_clip})" if y_clip else y
    first = f"greatest(0, CAST(ceil((i + 1 - {warm}) / {refit}.0) AS INT))"
    gone = f" UNION ALL SELECT {key}, greatest(0, CAST(ceil((i + {win} + 1 - {warm}) / {refit}.0) AS INT)), -1, m FROM products" if win else ""
    row = lambda a: ", ".join([f"({s(a, b)} - n * mu[{a}] * mu[{b}]) / (sd[{a}] * sd[{b}])" + (f" + {lam}" if a == b else "") for b in range(1, 19)] + [f"({s(a, 19)} - mu[{a}] * {s(0, 19)}) / sd[{a}]"])
    sql = f"""{feats},
labelled AS (SELECT *, {y} AS y FROM feats),
products AS MATERIALIZED (SELECT stk, i, [{', '.join(terms)}] AS m FROM labelled WHERE y IS NOT NULL),
changes AS (SELECT {key} AS k, {first} AS j, 1 AS sign, m FROM products{gone}),
parts AS (SELECT k, j, sign * unnest(m) AS v, generate_subscripts(m, 1) AS q FROM changes),
sums AS (SELECT k, j, q, sum(v) AS v FROM parts GROUP BY ALL),
running AS (SELECT k, j, q, sum(v) OVER (PARTITION BY k, q ORDER BY j) AS v FROM sums),
moments AS (SELECT k, j, list(v ORDER BY q) AS s FROM running GROUP BY k, j),
means AS (SELECT k, j, s, s[1] AS n, [{', '.join(f's[{at[0, a]}] / s[1]' for a in range(1, 19))}] AS mu FROM moments),
spreads AS (SELECT *, [{', '.join(f'sqrt(CASE WHEN {s(a, a)} / n - mu[{a}] * mu[{a}] <= 1e-14 * {s(a, a)} / n THEN 0 ELSE {s(a, a)} / n - mu[{a}] * mu[{a}] END) + {EPS}' for a in range(1, 19))}] AS sd FROM means),
solve0 AS MATERIALIZED (SELECT k, j, mu, sd, {s(0, 19)} / n AS b0, [{', '.join(f'[{row(a)}]' for a in range(1, 19))}] AS m FROM spreads)"""
    sql += eliminated("solve0", 18, "k, j, mu, sd, b0")
    raw = " + ".join(f"({n} - mu[{a}]) / sd[{a}] * m[{a}][19]" for a, n in enumerate(x, 1))
    own = f"raw * {plan.shrink}" if plan.ratio is None else f"raw * {plan.ratio} * vol20 / (stddev_pop(CASE WHEN i >= {warm} THEN raw END) OVER (PARTITION BY stk ORDER BY i) + {EPS})"
    return sql + f""",
raws AS (SELECT f.stk, f.i, f.p, f.vol20, CASE WHEN i < {warm} THEN 0 ELSE coalesce(b0 + {raw}, 0) END AS raw FROM feats f LEFT JOIN solve18 ON k = {'0' if pooled else 'stk'} AND j = (i - {warm}) // {refit} AND i >= {warm}),
pred AS (SELECT stk, i, p, vol20, raw, CASE WHEN i < {warm} THEN 0 ELSE least(greatest({own}, -{plan.clip}), {plan.clip}) END AS y_pred FROM raws)"""


def online5(bars: str, warm: int = 30, lam: float = 0.01, most: float = 0.07) -> str:
    """CTEs up to ``pred`` of the model that is refitted every row on five features, all but the intercept penalised."""
    z = ["1.0::DOUBLE", "x1", "x2", "x3", "x4", "x5"]
    total = lambda t: f"sum({t}) OVER (PARTITION BY stk ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    row = lambda a: ", ".join([total(f"{z[a]} * {z[b]}") + (f" + {lam}" if a == b and a else "") for b in range(6)] + [total(f"{z[a]} * y")])
    return f"""{bars},
rets AS (SELECT stk, i, p, v, CASE WHEN i = 0 THEN 0 ELSE p / greatest(lag(p) OVER o, 1e-12) - 1 END AS r, avg(p) OVER w AS m5, avg(v) OVER w AS vm FROM bars WINDOW o AS (PARTITION BY stk ORDER BY i), w AS (PARTITION BY stk ORDER BY i ROWS 5 PRECEDING)),
five AS (SELECT *, r AS x1, p / greatest(m5, 1e-12) - 1 AS x2, p / greatest(m5, 1e-12) - 1 AS x3, ln(greatest(v, 1e-12) / greatest(vm, 1e-12)) AS x4, r * ln(greatest(v, 1e-12) / greatest(vm, 1e-12)) AS x5, lead(r) OVER (PARTITION BY stk ORDER BY i) AS y FROM rets),
systems AS (SELECT stk, i, p, x1, x2, x3, x4, x5, [{', '.join(f'[{row(a)}]' for a in range(6))}] AS m FROM five){eliminated("(SELECT * FROM systems WHERE i >= " + str(warm) + ")", 6, "stk, i")},
raws AS (SELECT f.stk, f.i, f.p, CASE WHEN f.i < {warm} THEN 0.5 * x1 - 0.5 * x2 ELSE {' + '.join(f's.m[{a + 1}][7] * {t}' for a, t in enumerate(z))} END AS raw FROM five f LEFT JOIN solve6 s ON s.stk = f.stk AND s.i = f.i),
pred AS (SELECT stk, i, p, raw, least(greatest(raw, -{most}), {most}) AS y_pred FROM raws)"""
