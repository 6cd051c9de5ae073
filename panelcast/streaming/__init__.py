"""The recurrences of the features as streams: each key's state is a handful of numbers, so its history is not kept."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import EPS

OUT = "stk string, i long, p double, r double, ema_fast double, ema_slow double, macd_hist double, obv double"
STATE = "i long, p double, fast double, slow double, signal double, obv double"


def online(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Return, exponential averages, MACD histogram and on-balance volume of a stream (stk, i, p, v).

    Rows of a key must arrive in order of i over the batches; within a batch they are sorted. A row whose i is not beyond the
    last one seen is late and gives nothing."""
    af, as_, ag = (2.0 / (s + 1) for s in (fast, slow, signal))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = state.get if state.exists else None
        out = []
        for i, p, v in pd.concat(list(parts)).sort_values("i")[["i", "p", "v"]].itertuples(index=False):
            if s is None:
                s, r = (int(i), float(p), float(p), float(p), 0.0, 0.0), 0.0
            else:
                last, before, ef, es, sg, obv = s
                if i <= last:
                    continue
                r = p / max(before, EPS) - 1
                ef, es = af * p + (1 - af) * ef, as_ * p + (1 - as_) * es
                sg = ag * (ef - es) + (1 - ag) * sg
                obv += v if p > before else -v if p < before else 0.0
                s = (int(i), float(p), float(ef), float(es), float(sg), float(obv))
            out.append((key[0], s[0], s[1], r, s[2], s[3], (s[2] - s[3] - s[4]) / max(s[1], EPS), s[5]))
        if s is not None:
            state.update(s)
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])

    return bars.groupBy("stk").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
