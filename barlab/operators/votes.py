"""Rule votes: strategies read indicators, every rule casts a buy or sell vote, the majority gives the signal.

Distinct (indicator, parameters) requests are computed once per series, however many strategies use them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.core.blocks import IDX, KEY, lag, rows
from barlab.core.steps import Step, with_indicators
from barlab.operators import carried, indicators as ind, structure as st
from barlab.operators.carried import MIN_SPACING, space_signals


@dataclass(frozen=True)
class Strategy:
    id: str
    timeframe: str
    family: str
    variant: str
    indicators: tuple[tuple[str, tuple[tuple[str, float], ...]], ...]
    stop_loss: int = 50
    take_profit: int = 100
    risk_reward: float = 2.0
    risk_per_trade: float = 1.0
    extra: dict = field(default_factory=dict, compare=False)


Vote = tuple[Column, Column]  # rule available, vote (+1 buy, -1 sell, 0 none)


def _known(*cols: Column) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])


def _cross(a: Column, b: Column) -> Vote:
    pa, pb = lag(a), lag(b)
    return _known(a, b, pa, pb), F.when((a > b) & (pa <= pb), 1).when((a < b) & (pa >= pb), -1).otherwise(0)


def _cross_level(a: Column, level: Column) -> Vote:
    """Close crossing the present value of a line."""
    pa = lag(a)
    return _known(level, pa), F.when((a > level) & (pa <= level), 1).when((a < level) & (pa >= level), -1).otherwise(0)


def _band(x: Column, low: Column | float, high: Column | float, touch: bool = False) -> Vote:
    lo, hi = (low if isinstance(low, Column) else F.lit(float(low))), (high if isinstance(high, Column) else F.lit(float(high)))
    buy, sell = (x <= lo, x >= hi) if touch else (x < lo, x > hi)
    return _known(x, lo, hi), F.when(buy, 1).when(sell, -1).otherwise(0)


def _event(flag: Column) -> Vote:
    """Counts only when it happens."""
    return F.coalesce(flag != 0, F.lit(False)), flag


def _recent(flag: Column, n: int, side: int) -> Vote:
    return F.coalesce(F.max(flag).over(rows(-n, -1)) == 1, F.lit(False)), F.lit(side)


def _close() -> Column:
    return F.col("close")


@dataclass(frozen=True)
class Request:
    """One distinct indicator computation and the votes it casts."""

    columns: tuple[str, ...]
    step: Callable[[dict], Step] | None
    votes: Callable[[Callable[[str], Column], dict], list[Vote]]
    frame: Callable[[DataFrame, dict], DataFrame] | None = None
    compute: tuple[str, ...] = ()  # parameters that change the computation


def _p(params: dict, name: str, default: float, floor: float = 1) -> float:
    return max(floor, params.get(name, default))


def _i(params: dict, name: str, default: int, floor: int = 1) -> int:
    return int(_p(params, name, default, floor))


def _oscillator(col: str, step, low: float, high: float, *compute: str) -> Request:
    return Request((col,), step, lambda c, p: [_band(c(col), p.get("oversold", low), p.get("overbought", high))], compute=compute)


def _macd_step(p: dict) -> Step:
    fast = _i(p, "fast", 12, 2)
    return ind.macd(fast, max(fast + 1, int(p.get("slow", 26))), _i(p, "signal", 9, 2))


def _fib_vote(c, p) -> list[Vote]:
    inside = (_close() >= c("fib_382")) & (_close() <= c("fib_618"))
    before = F.coalesce(lag("close", 5), _close())
    return [(_known(c("fib_382"), c("fib_618")), F.when(inside, F.when(_close() > before, 1).otherwise(-1)).otherwise(0))]


def _donchian_vote(c, p) -> list[Vote]:
    up, low = c("donchian_upper"), c("donchian_lower")
    rise, fall = (_close() >= up) & (lag("close") < lag(up)), (_close() <= low) & (lag("close") > lag(low))
    return [(_known(up, low, lag("close")), F.when(rise, 1).when(fall, -1).otherwise(0))]


def _flip_vote(name: str):
    def votes(c, p) -> list[Vote]:
        d, before = c(name), lag(c(name))
        return [(_known(before), F.when((d == 1) & (before == -1), 1).when((d == -1) & (before == 1), -1).otherwise(0))]

    return votes


def _cloud_vote(c, p) -> list[Vote]:
    top, bottom = F.greatest(c("span_a"), c("span_b")), F.least(c("span_a"), c("span_b"))
    side = F.when(_close() > top, 1).when(_close() < bottom, -1).otherwise(0)
    return [_cross(c("tenkan"), c("kijun")), (_known(c("span_a"), c("span_b")), side)]


_MA = {"SMA": ind.sma, "EMA": ind.ema, "WMA": ind.wma, "HMA": ind.hma, "DEMA": ind.dema, "TEMA": ind.tema}

REQUESTS: dict[str, Request] = {
    **{t: Request(("ma",), lambda p, f=f: f(_i(p, "period", 20, 2), out="ma"), lambda c, p: [], compute=("period",)) for t, f in _MA.items()},
    "RSI": _oscillator("rsi", lambda p: ind.rsi(_i(p, "period", 14, 2), out="rsi"), 30, 70, "period"),
    "MACD": Request(("macd", "macd_signal"), _macd_step, lambda c, p: [_cross(c("macd"), c("macd_signal"))], compute=("fast", "slow", "signal")),
    "BB": Request(("bb_upper", "bb_lower"), lambda p: ind.bollinger(_i(p, "period", 20, 2), _p(p, "deviation", 2.0, 0.5)),
                  lambda c, p: [_band(_close(), c("bb_lower"), c("bb_upper"), touch=True)], compute=("period", "deviation")),
    "STOCH": _oscillator("stoch_k", lambda p: ind.stochastic(_i(p, "k_period", 14, 2), _i(p, "d_period", 3), _i(p, "slowing", 3)), 20, 80, "k_period", "d_period", "slowing"),
    "ADX": Request(("adx",), lambda p: ind.adx(_i(p, "period", 14, 2)), lambda c, p: [], compute=("period",)),
    "ATR": Request(("atr",), lambda p: ind.atr(_i(p, "period", 14, 2), out="atr"), lambda c, p: [], compute=("period",)),
    "CCI": _oscillator("cci", lambda p: ind.cci(_i(p, "period", 20, 2)), -100, 100, "period"),
    "WILLIAMS_R": _oscillator("williams_r", lambda p: ind.williams_r(_i(p, "period", 14, 2)), -80, -20, "period"),
    "MFI": _oscillator("mfi", lambda p: ind.mfi(_i(p, "period", 14, 2)), 20, 80, "period"),
    "STOCH_RSI": _oscillator("stoch_rsi_k", lambda p: ind.stoch_rsi(_i(p, "rsi_period", 14, 2), _i(p, "stoch_period", 14, 2), _i(p, "k_smooth", 3)), 20, 80,
                             "rsi_period", "stoch_period", "k_smooth"),
    "ICHIMOKU": Request(("tenkan", "kijun", "span_a", "span_b"), lambda p: ind.ichimoku(_i(p, "tenkan_period", 9), _i(p, "kijun_period", 26), _i(p, "senkou_b_period", 52), _i(p, "displacement", 26)),
                        _cloud_vote, compute=("tenkan_period", "kijun_period", "senkou_b_period", "displacement")),
    "OBV": Request(("obv_trend",), lambda p: ind.obv_trend(20), lambda c, p: [_cross(c("obv_trend"), F.when(c("obv_trend").isNotNull(), 0.0))]),
    "DONCHIAN": Request(("donchian_upper", "donchian_lower"), lambda p: ind.donchian(_i(p, "period", 20, 5)), _donchian_vote, compute=("period",)),
    "KELTNER": Request(("keltner_upper", "keltner_lower"), lambda p: ind.keltner(_i(p, "ema_period", 20, 2), _i(p, "atr_period", 10, 2), _p(p, "multiplier", 2.0, 0.5)),
                       lambda c, p: [_band(_close(), c("keltner_lower"), c("keltner_upper"), touch=True)], compute=("ema_period", "atr_period", "multiplier")),
    "MOMENTUM": Request(("momentum",), lambda p: ind.momentum(_i(p, "period", 10, 2)), lambda c, p: [_cross(c("momentum"), F.when(c("momentum").isNotNull(), 0.0))], compute=("period",)),
    "VWAP": Request(("vwap",), lambda p: ind.vwap(_i(p, "period", 20, 5)), lambda c, p: [_cross_level(_close(), c("vwap"))], compute=("period",)),
    "VOLUME_PROFILE": Request(("poc",), lambda p: st.volume_profile(_i(p, "lookback", 100, 20)), lambda c, p: [_cross_level(_close(), c("poc"))], compute=("lookback",)),
    "PIVOTS": Request(("r1", "s1"), lambda p: ind.pivot_points(_i(p, "period", 20, 5)), lambda c, p: [_band(_close(), c("s1"), c("r1"), touch=True)], compute=("period",)),
    "FIBONACCI": Request(("fib_382", "fib_618"), lambda p: ind.fibonacci(_i(p, "lookback", 50, 10)), _fib_vote, compute=("lookback",)),
    "LIQUIDITY": Request(("resistance", "support"), lambda p: st.liquidity_levels(_i(p, "lookback", 20, 10), _i(p, "touch_count", 2)), lambda c, p: [], compute=("lookback", "touch_count")),
    "ORDER_BLOCKS": Request(("ob_bullish", "ob_bearish"), lambda p: st.order_blocks(_i(p, "lookback", 10, 5)),
                            lambda c, p: [_recent(c("ob_bullish"), 20, 1), _recent(c("ob_bearish"), 20, -1)], compute=("lookback",)),
    "FVG": Request(("fvg_bull", "fvg_bear"), lambda p: st.fair_value_gaps(), lambda c, p: [_recent(c("fvg_bull"), 10, 1), _recent(c("fvg_bear"), 10, -1)]),
    "ICT_STRUCTURE": Request(("bos", "choch"), None, lambda c, p: [_event(c("bos")), _event(c("choch"))],
                             lambda bars, p: st.market_structure(bars, _i(p, "lookback", 5, 3), confirm_lag=_i(p, "lookback", 5, 3)), compute=("lookback",)),
    "SUPERTREND": Request(("supertrend_dir",), None, _flip_vote("supertrend_dir"), lambda bars, p: carried.supertrend(bars, _i(p, "period", 10, 2), _p(p, "multiplier", 3.0, 0.1)), compute=("period", "multiplier")),
    "PARABOLIC_SAR": Request(("sar_dir",), None, _flip_vote("sar_dir"),
                             lambda bars, p: carried.parabolic_sar(bars, p.get("af_start", 0.02), p.get("af_step", 0.02), p.get("af_max", 0.2)), compute=("af_start", "af_step", "af_max")),
}


def _tag(kind: str, params: dict) -> str:
    used = {k: params[k] for k in REQUESTS[kind].compute if k in params}
    return "_".join([kind.lower(), *[f"{k}{v}" for k, v in sorted(used.items())]]).replace(".", "p").replace("-", "m")


def _renamed(step: Step, tag: str, keep: tuple[str, ...]) -> Step:
    names = {o: f"{o}__{tag}" for o in keep}
    drop = [o for o in step.outputs if o not in keep]
    return Step(step.name, tuple(names.values()), lambda df: step.apply(df).drop(*drop).withColumnsRenamed(names), step.back, step.ahead, step.span)


def compute_requests(bars: DataFrame, strategies: list[Strategy]) -> tuple[DataFrame, list[str]]:
    """Bars plus every distinct indicator column the strategies ask for."""
    wanted = {_tag(k, dict(p)): (k, dict(p)) for s in strategies for k, p in s.indicators}
    steps, columns = [], []
    for tag, (kind, params) in wanted.items():
        req = REQUESTS[kind]
        columns += [f"{c}__{tag}" for c in req.columns]
        if req.step:
            steps.append(_renamed(req.step(params), tag, req.columns))
    df = with_indicators(bars, *steps) if steps else bars
    for tag, (kind, params) in wanted.items():
        req = REQUESTS[kind]
        if req.frame:
            extra = req.frame(bars, params).select(*KEY, IDX, *[F.col(c).alias(f"{c}__{tag}") for c in req.columns])
            df = df.join(extra, [*KEY, IDX], "left")
    return df, columns


def _ma_votes(names: list[str]) -> list[Vote]:
    """Names ordered fast to slow."""
    cols = [F.col(n) for n in names]
    if len(cols) == 1:
        return [_cross(_close(), cols[0])]
    if len(cols) < 2:
        return []
    out = [_cross(cols[0], cols[-1])]
    if len(cols) >= 3:
        def aligned(values: list[Column], sign: int) -> Column:
            tests = [(a > b) if sign > 0 else (a < b) for a, b in zip(values, values[1:])]
            return F.coalesce(reduce(lambda x, y: x & y, tests), F.lit(False))

        for sign in (1, -1):
            fresh = aligned(cols, sign) & ~aligned([lag(c) for c in cols], sign)
            out.append((fresh, F.lit(sign)))
    return out


def signal_column(strategy: Strategy, ma_order: str = "period") -> Column:
    """Buy/sell majority of a strategy's rules on the current row (before warm-up and spacing)."""
    votes, averages, adx = [], {}, None
    for kind, raw in strategy.indicators:
        params = dict(raw)
        tag = _tag(kind, params)
        if kind in _MA:
            averages[f"ma__{tag}"] = (f"MA_{kind}_{_i(params, 'period', 20, 2)}", _i(params, "period", 20, 2))
        elif kind == "ADX":
            adx = F.coalesce(F.col(f"adx__{tag}") < params.get("threshold", 25), F.lit(False))
        else:
            votes += REQUESTS[kind].votes(lambda c, tag=tag: F.col(f"{c}__{tag}"), params)
    rank = (lambda n: averages[n][0]) if ma_order == "lexical" else (lambda n: (averages[n][1], averages[n][0]))
    votes += _ma_votes(sorted(averages, key=rank))
    if not votes:
        return F.lit(0)
    count = lambda conds: reduce(lambda a, b: a + b, [F.when(c, 1).otherwise(0) for c in conds])
    total = count([ok for ok, _ in votes])
    buys, sells = count([ok & (v == 1) for ok, v in votes]), count([ok & (v == -1) for ok, v in votes])
    if adx is not None:
        damp = F.when(adx, 1).otherwise(0)
        buys, sells = F.greatest(F.lit(0), buys - damp), F.greatest(F.lit(0), sells - damp)
    need = F.greatest(F.lit(1), F.floor(total / 3))
    return F.when(total > 0, F.when((buys >= need) & (buys > sells), 1).when((sells >= need) & (sells > buys), -1).otherwise(0)).otherwise(0)


def first_valid(df: DataFrame, columns: list[str]) -> DataFrame:
    """First bar with a value, per series and column."""
    valid = lambda c: F.col(c).isNotNull()
    return df.groupBy(*KEY).agg(*[F.min(F.when(valid(c), F.col(IDX))).alias(c) for c in columns])


def vote_signals(bars: DataFrame, strategies: list[Strategy], timeframe: str, warmup: int = 100, ma_order: str = "period") -> DataFrame:
    """(strategy_id, symbol, timeframe, bar_idx, signal) of all strategies over one timeframe's bars; zero signals are left out."""
    df, columns = compute_requests(bars, strategies)
    starts = first_valid(df, columns) if columns else None
    names = [f"_sig{n}" for n in range(len(strategies))]
    cast = Step("votes", tuple(names), lambda d: d.withColumns({n: signal_column(s, ma_order) for n, s in zip(names, strategies)}), back=21)
    df = with_indicators(df, cast).select(*KEY, IDX, *names)
    if starts is not None:
        df = df.join(starts, KEY)

    def ready(s: Strategy) -> Column:
        used = [f"{c}__{_tag(k, dict(p))}" for k, p in s.indicators for c in REQUESTS[k].columns]
        return F.greatest(F.lit(warmup), *[F.coalesce(F.col(c) + 1, F.lit(0)) for c in used]) if used else F.lit(warmup)

    cells = [F.struct(F.lit(s.id).alias("strategy_id"), F.when(F.col(IDX) >= ready(s), F.col(n)).otherwise(0).cast("int").alias("signal")) for n, s in zip(names, strategies)]
    out = df.select(*KEY, IDX, F.explode(F.array(*cells)).alias("c")).select("c.strategy_id", *KEY, IDX, "c.signal").filter("signal <> 0")
    return space_signals(out, ["strategy_id", *KEY], MIN_SPACING.get(timeframe, 1))
