"""Small series and plain-Python references written from the definitions."""

from datetime import datetime, timedelta
import random

import pandas as pd

KEY = ["symbol", "timeframe"]


def series(n, seed=1, symbol="A", start=100.0, digits=2):
    rnd = random.Random(seed)
    rows, price = [], start
    for i in range(n):
        o = price
        c = round(o + rnd.uniform(-2, 2), digits)
        h = round(max(o, c) + rnd.uniform(0, 1), digits)
        l = round(min(o, c) - rnd.uniform(0, 1), digits)
        rows.append((symbol, "H1", datetime(2024, 1, 1) + timedelta(hours=i), o, h, l, c, rnd.randint(1, 50), i, n))
        price = c
    return rows


SCHEMA = "symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, tick_volume bigint, bar_idx bigint, n_bars bigint"


def bars(spark, *sets):
    return spark.createDataFrame([r for s in sets for r in s], SCHEMA)


def frame(df, *sort):
    return df.toPandas().sort_values(list(sort) or ["symbol", "bar_idx"]).reset_index(drop=True)


def ema(xs, p, start=0, gain=None):
    gain = gain if gain is not None else 2 / (p + 1)
    out = [None] * len(xs)
    if start + p > len(xs):
        return out
    y = sum(xs[start:start + p]) / p
    out[start + p - 1] = y
    for i in range(start + p, len(xs)):
        y += gain * (xs[i] - y)
        out[i] = y
    return out


def close_to(got, want, tol=1e-9):
    got = [None if g is None or g != g else g for g in got]
    assert [g is None for g in got] == [w is None for w in want]
    for g, w in zip(got, want):
        if w is not None:
            assert abs(g - w) <= tol * max(1, abs(w)), (g, w)
