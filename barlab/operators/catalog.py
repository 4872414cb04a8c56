"""Strategy families as parameter tables, and seeded generation, mutation and crossover of strategies."""

from __future__ import annotations

import hashlib

from barlab.operators.votes import Strategy

#: Stop-loss range in pips per timeframe (fixed values).
STOP_RANGE = {"M1": (5, 15), "M5": (8, 25), "M15": (10, 35), "M30": (15, 50), "H1": (20, 70), "H4": (30, 120), "D1": (50, 200)}

_RSI = ("RSI", {"period": 14, "overbought": 70, "oversold": 30})
_ADX = ("ADX", {"period": 14, "threshold": (20, 30)})
_STOCH = ("STOCH", {"k_period": 14, "d_period": 3, "slowing": 3, "overbought": 80, "oversold": 20})
_CLOUD = ("ICHIMOKU", {"tenkan_period": 9, "kijun_period": 26, "senkou_b_period": 52, "displacement": 26})

#: Families: variants, then indicators (fixed values). A list is a choice, a pair of ints an integer range, a
#: triple (low, high, digits) a decimal range; "?" before a type makes it optional with the given chance.
FAMILIES: dict[str, tuple[tuple[str, ...], tuple]] = {
    "ichimoku": (("kumo_breakout", "tk_cross", "chikou_cross", "kumo_twist", "full_ichimoku"), (
        ("ICHIMOKU", {"tenkan_period": [7, 9, 12, 15], "kijun_period": [22, 26, 30, 35], "senkou_b_period": [44, 52, 60, 65], "displacement": 26}), _ADX)),
    "ict_smc": (("order_block_bounce", "fvg_fill", "bos_entry", "choch_reversal", "liquidity_grab", "smc_full"), (
        ("ICT_STRUCTURE", {"lookback": (5, 15)}), ("ORDER_BLOCKS", {"lookback": (8, 20)}), ("FVG", {}), ("?0.7 EMA", {"period": [50, 100, 200]}))),
    "volume_profile": (("poc_bounce", "vah_val_breakout", "value_area_revert"), (("VOLUME_PROFILE", {"lookback": [50, 100, 150, 200]}), _RSI, ("?0.6 VWAP", {"period": [20, 50]}))),
    "crossover_ma": ((), (("@fast", {}), ("@slow", {}), ("@filter", {}))),
    "multi_ma_ribbon": ((), (("@ribbon", {}),)),
    "rsi_divergence": (("regular", "hidden", "double"), (("RSI", {"period": [9, 14, 21], "overbought": (65, 80), "oversold": (20, 35)}), ("EMA", {"period": [20, 50, 100]}))),
    "bollinger_squeeze": (("squeeze_breakout", "band_walk", "mean_reversion"), (
        ("BB", {"period": [15, 20, 25], "deviation": (1.5, 2.5, 1)}), ("KELTNER", {"ema_period": [15, 20, 25], "atr_period": [10, 14, 20], "multiplier": (1.0, 2.0, 1)}), _RSI)),
    "macd_histogram": (("zero_cross", "histogram_reversal", "divergence"), (("MACD", {"fast": [8, 12, 15], "slow": [21, 26, 30], "signal": [5, 9, 12]}), ("EMA", {"period": [50, 100, 200]}))),
    "supertrend": (("trend_follow", "double_supertrend", "with_rsi"), (("SUPERTREND", {"period": [7, 10, 14], "multiplier": (2.0, 4.0, 1)}), _RSI)),
    "donchian_breakout": (("turtle", "channel_breakout", "pullback"), (("DONCHIAN", {"period": [10, 20, 30, 55]}), ("ATR", {"period": 14}))),
    "keltner_breakout": (("breakout", "mean_reversion"), (("KELTNER", {"ema_period": [15, 20, 25], "atr_period": [10, 14], "multiplier": (1.5, 3.0, 1)}), _RSI)),
    "stochastic_rsi": (("overbought_oversold", "cross", "divergence"), (
        ("STOCH_RSI", {"rsi_period": [9, 14, 21], "stoch_period": [9, 14], "k_smooth": [3, 5], "overbought": (70, 85), "oversold": (15, 30)}), ("EMA", {"period": [20, 50, 100]}))),
    "pivot_bounce": (("pp_bounce", "sr_breakout", "sr_rejection"), (("PIVOTS", {"period": [10, 20, 50]}), _RSI)),
    "fibonacci_retracement": (("38.2_bounce", "61.8_bounce", "golden_zone"), (("FIBONACCI", {"lookback": [30, 50, 100]}), _RSI, ("EMA", {"period": [20, 50]}))),
    "cci_momentum": (("zero_cross", "extreme_reversal", "trend_confirm"), (("CCI", {"period": [14, 20, 30], "overbought": (100, 200), "oversold": (-200, -100)}), ("EMA", {"period": [20, 50, 100]}))),
    "williams_reversal": (("overbought_sell", "oversold_buy", "failure_swing"), (("WILLIAMS_R", {"period": [10, 14, 21], "overbought": (-20, -10), "oversold": (-90, -80)}), ("EMA", {"period": [20, 50]}))),
    "parabolic_sar_trend": (("sar_flip", "sar_with_ema", "sar_adx"), (("PARABOLIC_SAR", {"af_start": (0.01, 0.03, 3), "af_step": (0.01, 0.03, 3), "af_max": (0.15, 0.25, 2)}), _ADX)),
    "atr_volatility": (("volatility_breakout", "atr_channel"), (("ATR", {"period": [10, 14, 20]}), ("EMA", {"period": [20, 50]}), _ADX)),
    "obv_volume": (("obv_trend", "obv_divergence", "obv_breakout"), (("OBV", {}), ("EMA", {"period": [20, 50]}), _RSI)),
    "vwap_mean_reversion": (("vwap_bounce", "vwap_cross", "vwap_bands"), (("VWAP", {"period": [20, 50, 100]}), ("BB", {"period": 20, "deviation": 2.0}), _RSI)),
    "triple_screen": (("elder_triple_screen",), (("MACD", {"fast": 12, "slow": 26, "signal": 9}), ("RSI", {"period": [9, 14], "overbought": 70, "oversold": 30}),
                                                 ("STOCH", {"k_period": [9, 14], "d_period": 3, "slowing": 3, "overbought": 80, "oversold": 20}), ("EMA", {"period": [13, 21, 34]}))),
    "combined_momentum": (("multi_oscillator",), (_RSI, ("MACD", {"fast": 12, "slow": 26, "signal": 9}), _STOCH, ("CCI", {"period": 20, "overbought": 100, "oversold": -100}), ("MOMENTUM", {"period": [10, 14, 20]}))),
    "structure_breakout": (("sr_breakout", "sr_bounce", "range_breakout"), (("LIQUIDITY", {"lookback": [15, 20, 30], "touch_count": [2, 3]}), ("ATR", {"period": 14}), _RSI)),
    "hybrid_ichimoku_smc": (("kumo_ob", "tk_fvg", "full_hybrid"), (_CLOUD, ("ICT_STRUCTURE", {"lookback": 10}), ("ORDER_BLOCKS", {"lookback": 15}), ("FVG", {}))),
    "multi_indicator_fusion": ((), (("@fusion", {}),)),
}

_FUSION = (_RSI, ("MACD", {"fast": 12, "slow": 26, "signal": 9}), ("BB", {"period": 20, "deviation": 2.0}), ("SUPERTREND", {"period": 10, "multiplier": 3.0}), _CLOUD, _STOCH,
           ("ADX", {"period": 14, "threshold": 25}), ("CCI", {"period": 20, "overbought": 100, "oversold": -100}), ("EMA", {"period": [20, 50, 100, 200]}),
           ("PARABOLIC_SAR", {"af_start": 0.02, "af_step": 0.02, "af_max": 0.2}))
_AVERAGES = ["SMA", "EMA", "WMA", "HMA", "DEMA", "TEMA"]
_CROSS_SCALE = {"M5": 0.7, "M15": 0.85, "M30": 1.0, "H1": 1.2, "H4": 1.5, "D1": 2.0}
EXITS = ["opposite_signal", "trailing_stop", "time_based"]


class Draw:
    """Reproducible draws: the n-th number depends only on the seed text and n."""

    def __init__(self, *seed):
        self.seed, self.n = "-".join(map(str, seed)), 0

    def unit(self) -> float:
        self.n += 1
        return int(hashlib.md5(f"{self.seed}-{self.n}".encode()).hexdigest()[:8], 16) / (1 << 32)

    def integer(self, low: int, high: int) -> int:
        return low + int(self.unit() * (high - low + 1))

    def decimal(self, low: float, high: float, digits: int) -> float:
        return round(low + self.unit() * (high - low), digits)

    def choice(self, items):
        return items[int(self.unit() * len(items))]

    def sample(self, items, k: int) -> list:
        ranked = sorted(((self.unit(), n) for n in range(len(items))))[:k]
        return [items[n] for _, n in sorted(ranked, key=lambda x: x[1])]

    def value(self, spec):
        if isinstance(spec, list):
            return self.choice(spec)
        if isinstance(spec, tuple):
            return self.integer(*spec) if len(spec) == 2 else self.decimal(*spec)
        return spec


def stop_and_target(d: Draw, timeframe: str) -> dict:
    sl = d.integer(*STOP_RANGE.get(timeframe, STOP_RANGE["H1"]))
    rr = d.decimal(1.0, 5.0, 1)
    return {"stop_loss": sl, "take_profit": int(sl * rr), "risk_reward": rr, "risk_per_trade": d.decimal(0.5, 2.0, 1)}


def _freeze(indicators) -> tuple:
    return tuple((k, tuple(sorted(p.items()))) for k, p in indicators)


def _expand(d: Draw, timeframe: str, specs) -> list[tuple[str, dict]]:
    out: list[tuple[str, dict]] = []
    for kind, params in specs:
        if kind.startswith("?"):
            chance, kind = kind[1:].split(" ")
            if d.unit() >= float(chance):
                continue
        if kind == "@fast":
            out.append((d.choice(_AVERAGES), {"period": max(5, int(d.integer(5, 25) * _CROSS_SCALE.get(timeframe, 1.0)))}))
        elif kind == "@slow":
            out.append((d.choice(_AVERAGES), {"period": max(out[0][1]["period"] + 5, int(d.integer(30, 100) * _CROSS_SCALE.get(timeframe, 1.0)))}))
        elif kind == "@filter":
            extra = d.choice([_ADX, _RSI, ("ATR", {"period": 14}), None])
            out += _expand(d, timeframe, [extra]) if extra else []
        elif kind == "@ribbon":
            average = d.choice(["EMA", "SMA", "HMA"])
            out += [(average, {"period": p}) for p in d.sample(list(range(5, 200)), d.integer(3, 6))]
        elif kind == "@fusion":
            out += _expand(d, timeframe, d.sample(_FUSION, d.integer(3, 6)))
        else:
            out.append((kind, {k: d.value(v) for k, v in params.items()}))
    return out


def generate(family: str, timeframe: str, number: int, seed: int = 42) -> Strategy:
    """The ``number``-th strategy of a family."""
    d = Draw(seed, family, timeframe, number)
    variants, specs = FAMILIES[family]
    variant = d.choice(variants) if variants else f"{family}_{number}"
    indicators = _freeze(_expand(d, timeframe, specs))
    return Strategy(f"{family}_{timeframe}_{number}", timeframe, family, variant, indicators, **stop_and_target(d, timeframe), extra={"exit_type": d.choice(EXITS)})


def free_form(timeframe: str, number: int, seed: int = 42) -> Strategy:
    """A strategy of one to five indicators drawn from all families."""
    d = Draw(seed, "free", timeframe, number)
    pool = [s for _, specs in FAMILIES.values() for s in specs if not s[0].startswith(("@", "?"))]
    kinds: dict[str, tuple] = {}
    for spec in d.sample(pool, min(len(pool), 12)):
        kinds.setdefault(spec[0], spec)
    chosen = list(kinds.values())[: d.integer(1, 5)]
    return Strategy(f"free_{timeframe}_{number}", timeframe, "free", f"free_{number}", _freeze(_expand(d, timeframe, chosen)), **stop_and_target(d, timeframe))


def mutate(parent: Strategy, number: int, strength: float = 0.2, seed: int = 42) -> Strategy:
    """Positive parameters moved by up to ``strength``, stop by the same, reward ratio by up to 0.5."""
    d = Draw(seed, "mutate", parent.id, number)

    def moved(v):
        if isinstance(v, bool) or v <= 0:
            return v
        if isinstance(v, int):
            step = max(1, int(v * strength))
            return max(1, v + d.integer(-step, step))
        return round(max(0.01, v + (2 * d.unit() - 1) * v * strength), 3)

    indicators = tuple((k, tuple((n, moved(v)) for n, v in p)) for k, p in parent.indicators)
    step = max(1, int(parent.stop_loss * strength))
    sl = max(5, parent.stop_loss + d.integer(-step, step))
    rr = round(max(0.5, parent.risk_reward + d.unit() - 0.5), 1)
    return Strategy(f"{parent.id}_m{number}", parent.timeframe, parent.family, parent.variant, indicators, sl, int(sl * rr), rr, parent.risk_per_trade, parent.extra)


def crossover(a: Strategy, b: Strategy, number: int, seed: int = 42) -> Strategy:
    """Each indicator and the risk settings come from either parent; one indicator at least."""
    d = Draw(seed, "cross", a.id, b.id, number)
    pool = {k: (k, p) for k, p in a.indicators}
    pool.update({k: (k, p) for k, p in b.indicators if k not in pool or d.unit() < 0.5})
    picked = [x for x in pool.values() if d.unit() < 0.6] or [next(iter(pool.values()))]
    risk = a if d.unit() < 0.5 else b
    return Strategy(f"x{number}_{hashlib.sha256(f'{a.id}|{b.id}'.encode()).hexdigest()[:24]}", a.timeframe, a.family if d.unit() < 0.5 else b.family, "crossover", tuple(picked),
                    risk.stop_loss, risk.take_profit, risk.risk_reward, risk.risk_per_trade)
