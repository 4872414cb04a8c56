"""Queries for bar sources and indicators (survey groups 2.1, 2.5, 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.catalog import sql as q
from barlab.catalog.data import event_bars, fixed, order_bars, show, table
from barlab.catalog.registry import query
from barlab.catalog.sql import S, cols, frame, rnd
from barlab.core.steps import with_indicators
from barlab.operators import carried, features as ft, indicators as ind, structure as st
from barlab.sources import bars as src

ID = "symbol, bar_idx::BIGINT AS bar_idx"
TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


def _ind(spark, sf, doubles, *steps, ints="bar_idx", bars=event_bars):
    return show(with_indicators(bars(spark, sf), *steps), ints, doubles, "symbol")


# ---------------------------------------------------------------- bars

OHLC = "open high low close"


@query("bars_hourly", "S18", q.h1(select=f"SELECT {ID}, {TS}, tick_volume, {cols(OHLC)} FROM bars"))
def _(spark, sf):
    return show(event_bars(spark, sf), "bar_idx tick_volume", OHLC, "symbol ts")


@query("bars_daily", "S18", q.d1(select=f"SELECT {ID}, {TS}, tick_volume, {cols(OHLC)} FROM bars"))
def _(spark, sf):
    return show(order_bars(spark, sf), "bar_idx tick_volume", OHLC, "symbol ts")


@query("bars_resampled_h4", "S18", "WITH " + q.event_bars(14400) + f" SELECT symbol, {TS}, tick_volume, {cols(OHLC)} FROM bars")
def _(spark, sf):
    return show(src.resample(event_bars(spark, sf), "H4"), "tick_volume", OHLC, "symbol ts")


@query("latest_bars", "S1", q.h1(select=f"SELECT {ID}, {cols('close')} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 250"))
def _(spark, sf):
    return show(src.latest(event_bars(spark, sf), 250), "bar_idx", "close", "symbol")


@query("recent_update", "S4", q.h1(select=f"SELECT {ID}, {cols(OHLC)} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100"))
def _(spark, sf):
    return show(src.latest(event_bars(spark, sf), 100), "bar_idx", OHLC, "symbol")


@query("bars_in_range", "S2", q.h1(select=f"SELECT {ID}, {TS}, {cols('close')} FROM bars WHERE ts >= TIMESTAMP '2024-01-10' - INTERVAL 182 HOUR AND ts <= TIMESTAMP '2024-01-20'"))
def _(spark, sf):
    return show(src.time_range(event_bars(spark, sf), "2024-01-10", "2024-01-20", "H1", warmup=182), "bar_idx", "close", "symbol ts")


@query("history_chunk", "S3", q.d1(select=f"""SELECT {ID}, {cols('close')} FROM
  (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) WHERE rn BETWEEN 2*260+1 AND 3*260"""))
def _(spark, sf):
    return show(src.history_chunk(order_bars(spark, sf), years=4, chunk=2, per_year=260), "bar_idx", "close", "symbol")


@query("backtest_scan", "S5", q.d1(select=f"SELECT {ID}, {cols('close')} FROM bars WHERE n_bars >= 200"))
def _(spark, sf):
    return show(src.backtest_scan(order_bars(spark, sf), "D1"), "bar_idx", "close", "symbol")


@query("parse_bar_text", "S6", q.h1(select=f"SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {cols('open high low close')}, tick_volume FROM bars"))
def _(spark, sf):
    rec = F.concat_ws(",", F.unix_timestamp("ts").cast("string"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "tick_volume")])
    text = (event_bars(spark, sf).groupBy("symbol", F.to_date("ts").alias("day"))
            .agg(F.concat(F.concat_ws(";", F.collect_list(rec)), F.lit(";bad,1,2;1,x,3,4,5,6;;")).alias("data")))
    return show(src.parse_bar_text(text), "tick_volume", OHLC, "symbol ts")


# ---------------------------------------------------------------- finite frames


@query("sma", "I1", q.h1(select=f"SELECT {ID}, {rnd(f'CASE WHEN bar_idx>=19 THEN avg(close) {frame(-19, 0)} END')} AS sma_20 FROM bars"))
def _(spark, sf):
    return _ind(spark, sf, "sma_20", ind.sma(20))


def _wma(col: str, p: int) -> str:
    # weights by position inside the frame
    return "(" + "+".join(f"{p - k}*lag({col}, {k}) OVER ({S})" for k in range(p)) + f")/{p * (p + 1) // 2}.0"


@query("wma", "I2", q.h1(select=f"SELECT {ID}, {rnd(_wma('close', 10))} AS wma_10 FROM bars"))
def _(spark, sf):
    return _ind(spark, sf, "wma_10", ind.wma(10))


@query("hma", "I3", q.h1(f"a AS (SELECT *, 2*{_wma('close', 8)} - {_wma('close', 16)} AS d FROM bars)", "b AS (SELECT *, coalesce(d, 0) AS d0 FROM a)",
                         select=f"SELECT {ID}, {rnd('CASE WHEN bar_idx>=18 THEN ' + _wma('d0', 4) + ' END')} AS hma_16 FROM b"))
def _(spark, sf):
    return _ind(spark, sf, "hma_16", ind.hma(16))


BB = (f"a AS (SELECT *, CASE WHEN bar_idx>=19 THEN avg(close) {frame(-19, 0)} END AS bb_mid, CASE WHEN bar_idx>=19 THEN stddev_pop(close) {frame(-19, 0)} END AS sd FROM bars)",
      "b AS (SELECT *, bb_mid+2*sd AS bb_upper, bb_mid-2*sd AS bb_lower FROM a)")


@query("bollinger", "I4 I5", q.h1(*BB, select=f"""SELECT {ID}, {cols('bb_mid bb_upper bb_lower')},
  {rnd('CASE WHEN bb_mid>0 THEN (bb_upper-bb_lower)/bb_mid*100 ELSE 0 END')} AS bb_width,
  {rnd('CASE WHEN bb_upper-bb_lower>0 THEN (close-bb_lower)/(bb_upper-bb_lower) ELSE 0.5 END')} AS bb_pct FROM b"""))
def _(spark, sf):
    return _ind(spark, sf, "bb_mid bb_upper bb_lower bb_width bb_pct", ind.bollinger())


@query("stochastic", "I6", q.h1(
    f"a AS (SELECT *, max(high) {frame(-13, 0)} AS hi, min(low) {frame(-13, 0)} AS lo FROM bars)",
    "b AS (SELECT *, CASE WHEN bar_idx<13 THEN 50 WHEN hi<>lo THEN (close-lo)/(hi-lo)*100 ELSE 50 END AS raw FROM a)",
    f"c AS (SELECT *, CASE WHEN bar_idx>=13 THEN avg(raw) {frame(-2, 0)} END AS k FROM b)",
    f"d AS (SELECT *, CASE WHEN bar_idx>=15 THEN avg(coalesce(k,50)) {frame(-2, 0)} END AS dd FROM c)",
    select=f"SELECT {ID}, {rnd('k')} AS stoch_k, {rnd('dd')} AS stoch_d FROM d"))
def _(spark, sf):
    return _ind(spark, sf, "stoch_k stoch_d", ind.stochastic())


@query("true_range", "I7", q.h1(q.tr_cte(), select=f"SELECT {ID}, {cols('tr')} FROM trs"))
def _(spark, sf):
    return _ind(spark, sf, "tr", ind.true_range())


def _mid(p):
    return f"CASE WHEN bar_idx>={p - 1} THEN (max(high) {frame(1 - p, 0)} + min(low) {frame(1 - p, 0)})/2 END"


ICHI = (f"a AS (SELECT *, {_mid(9)} AS tenkan, {_mid(26)} AS kijun, {_mid(52)} AS sb FROM bars)",
        f"b AS (SELECT *, lag((tenkan+kijun)/2, 26) OVER ({S}) AS span_a, lag(sb, 26) OVER ({S}) AS span_b, lead(close, 26) OVER ({S}) AS chikou FROM a)",
        "c AS (SELECT *, greatest(span_a, span_b) AS cloud_top, least(span_a, span_b) AS cloud_bottom FROM b)")
ICHI_COLS = "tenkan kijun span_a span_b chikou cloud_top cloud_bottom"


@query("ichimoku", "I8", q.h1(*ICHI, select=f"SELECT {ID}, {cols(ICHI_COLS)} FROM c"))
def _(spark, sf):
    return _ind(spark, sf, ICHI_COLS, ind.ichimoku())


@query("donchian", "I9", q.h1(f"a AS (SELECT *, CASE WHEN bar_idx>=19 THEN max(high) {frame(-19, 0)} END AS donchian_upper, CASE WHEN bar_idx>=19 THEN min(low) {frame(-19, 0)} END AS donchian_lower FROM bars)",
                              select=f"SELECT {ID}, {cols('donchian_upper donchian_lower')}, {rnd('(donchian_upper+donchian_lower)/2')} AS donchian_mid FROM a"))
def _(spark, sf):
    return _ind(spark, sf, "donchian_upper donchian_lower donchian_mid", ind.donchian())


@query("williams_r", "I10", q.h1(f"a AS (SELECT *, max(high) {frame(-13, 0)} AS hi, min(low) {frame(-13, 0)} AS lo FROM bars)",
                                 select=f"SELECT {ID}, {rnd('CASE WHEN bar_idx>=13 THEN CASE WHEN hi<>lo THEN (hi-close)/(hi-lo)*-100 ELSE -50 END END')} AS williams_r FROM a"))
def _(spark, sf):
    return _ind(spark, sf, "williams_r", ind.williams_r())


@query("cci", "I11", q.h1("a AS (SELECT *, (high+low+close)/3 AS tp FROM bars)", f"b AS (SELECT *, avg(tp) {frame(-19, 0)} AS m, list(tp) {frame(-19, 0)} AS w FROM a)",
                          "c AS (SELECT *, list_avg(list_transform(w, lambda x: abs(x-m))) AS dev FROM b)",
                          select=f"SELECT {ID}, {rnd('CASE WHEN bar_idx>=19 THEN CASE WHEN dev>0 THEN (tp-m)/(0.015::DOUBLE*dev) ELSE 0 END END', 3)} AS cci FROM c"))
def _(spark, sf):
    return show(with_indicators(event_bars(spark, sf), ind.cci()), "bar_idx", "cci", "symbol", dp=3)


@query("mfi", "I12", q.h1("a AS (SELECT *, (high+low+close)/3 AS tp FROM bars)", f"b AS (SELECT *, tp - lag(tp) OVER ({S}) AS d FROM a)",
                          f"c AS (SELECT *, sum(CASE WHEN d>0 THEN tp*tick_volume ELSE 0 END) {frame(-13, 0)} AS p, sum(CASE WHEN d<0 THEN tp*tick_volume ELSE 0 END) {frame(-13, 0)} AS n FROM b)",
                          select=f"SELECT {ID}, {rnd('CASE WHEN bar_idx>=14 THEN CASE WHEN n>0 THEN 100-100/(1+p/n) WHEN p>0 THEN 100 ELSE 50 END END')} AS mfi FROM c"))
def _(spark, sf):
    return _ind(spark, sf, "mfi", ind.mfi())


OBV = (f"a AS (SELECT *, coalesce(sign(close - lag(close) OVER ({S}))*tick_volume, 0) AS v FROM bars)", f"o AS (SELECT *, sum(v) {q.ALL} AS obv FROM a)")


@query("on_balance_volume", "I13", q.h1(*OBV, select=f"SELECT {ID}, {cols('obv')} FROM o"))
def _(spark, sf):
    return show(carried.on_balance_volume(event_bars(spark, sf)), "bar_idx", "obv", "symbol")


PIV = (f"a AS (SELECT *, max(high) {frame(-20, -1)} AS h, min(low) {frame(-20, -1)} AS l, lag(close) OVER ({S}) AS c FROM bars)",
       "b AS (SELECT *, CASE WHEN bar_idx>=20 THEN (h+l+c)/3 END AS pp FROM a)")


@query("pivot_points", "I14", q.h1(*PIV, select=f"""SELECT {ID}, {cols('pp')}, {rnd('2*pp-l')} AS r1, {rnd('2*pp-h')} AS s1, {rnd('pp+(h-l)')} AS r2,
  {rnd('pp-(h-l)')} AS s2, {rnd('h+2*(pp-l)')} AS r3, {rnd('l-2*(h-pp)')} AS s3 FROM b"""))
def _(spark, sf):
    return _ind(spark, sf, "pp r1 s1 r2 s2 r3 s3", ind.pivot_points())


@query("fibonacci", "I15", q.h1(f"a AS (SELECT *, max(high) {frame(-50, -1)} AS h, min(low) {frame(-50, -1)} AS l FROM bars)",
                                select=f"SELECT {ID}, " + ", ".join(f"{rnd(f'CASE WHEN bar_idx>=50 AND h<>l THEN l+(h-l)*{r}::DOUBLE END')} AS {n}" for n, r in ind.FIB_LEVELS.items()) + " FROM a"))
def _(spark, sf):
    return _ind(spark, sf, " ".join(ind.FIB_LEVELS), ind.fibonacci())


@query("rolling_vwap", "I16", q.h1(select=f"SELECT {ID}, {rnd(f'CASE WHEN bar_idx>=20 THEN sum((high+low+close)/3*tick_volume) {frame(-20, 0)} / sum(tick_volume) {frame(-20, 0)} END')} AS vwap FROM bars"))
def _(spark, sf):
    return _ind(spark, sf, "vwap", ind.vwap())


@query("momentum_roc", "I17", q.h1(f"a AS (SELECT *, lag(close, 10) OVER ({S}) AS b FROM bars)", select=f"SELECT {ID}, {rnd('close-b')} AS momentum, {rnd('CASE WHEN b<>0 THEN (close-b)/b*100 END')} AS roc FROM a"))
def _(spark, sf):
    return _ind(spark, sf, "momentum roc", ind.momentum(), ind.roc())


SWING = (f"a AS (SELECT *, CASE WHEN bar_idx>=5 AND bar_idx<n_bars-5 AND high = max(high) {frame(-5, 5)} THEN high END AS swing_high, "
         f"CASE WHEN bar_idx>=5 AND bar_idx<n_bars-5 AND low = min(low) {frame(-5, 5)} THEN low END AS swing_low FROM bars)",)


@query("swings", "I18", q.h1(*SWING, select=f"SELECT {ID}, {cols('swing_high swing_low')} FROM a"))
def _(spark, sf):
    return _ind(spark, sf, "swing_high swing_low", st.swings())


BEFORE = f"OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
STRUCT = (*SWING,
          f"b AS (SELECT *, last_value(swing_high IGNORE NULLS) {BEFORE} AS xh, last_value(swing_low IGNORE NULLS) {BEFORE} AS xl FROM a)",
          f"c AS (SELECT *, coalesce(swing_high, xh) AS lh, coalesce(swing_low, xl) AS ll, last_value(CASE WHEN swing_high IS NOT NULL THEN xh END IGNORE NULLS) {q.ALL} AS ph, "
          f"last_value(CASE WHEN swing_low IS NOT NULL THEN xl END IGNORE NULLS) {q.ALL} AS pl FROM b)",
          "d AS (SELECT *, CASE WHEN lh>ph AND ll>pl THEN 1 WHEN lh<ph AND ll<pl THEN -1 END AS sg FROM c)",
          f"e AS (SELECT *, coalesce(last_value(sg IGNORE NULLS) {BEFORE}, 0) AS pt FROM d)",
          "f AS (SELECT *, coalesce(sg, pt) AS trend, lh IS NOT NULL AND ph IS NOT NULL AND ll IS NOT NULL AND pl IS NOT NULL AS known FROM e)",
          "ms AS (SELECT *, CASE WHEN known AND trend = pt THEN trend ELSE 0 END AS bos, CASE WHEN known AND trend <> pt AND pt <> 0 THEN trend ELSE 0 END AS choch FROM f)")


@query("market_structure", "I19", q.h1(*STRUCT, select=f"SELECT {ID}, trend::BIGINT AS trend, bos::BIGINT AS bos, choch::BIGINT AS choch FROM ms"))
def _(spark, sf):
    return show(st.market_structure(event_bars(spark, sf)), "bar_idx trend bos choch", "", "symbol")


OB = (q.atr_ctes(14),
      f"a AS (SELECT b.*, atr.y AS a, close - lag(close, 3) OVER ({S}) AS ch FROM {q.join_y('bars b', 'atr')})",
      "tu AS (SELECT symbol, bar_idx AS i FROM a WHERE bar_idx>=12 AND a IS NOT NULL AND ch > 1.5*a)",
      "td AS (SELECT symbol, bar_idx AS i FROM a WHERE bar_idx>=12 AND a IS NOT NULL AND -ch > 1.5*a)",
      "bu AS (SELECT tu.symbol, max(bar_idx) AS j FROM tu JOIN bars b ON b.symbol=tu.symbol AND b.bar_idx BETWEEN i-9 AND i-1 AND b.close<b.open GROUP BY tu.symbol, i)",
      "be AS (SELECT td.symbol, max(bar_idx) AS j FROM td JOIN bars b ON b.symbol=td.symbol AND b.bar_idx BETWEEN i-9 AND i-1 AND b.close>b.open GROUP BY td.symbol, i)",
      "ob AS (SELECT *, EXISTS (SELECT 1 FROM bu WHERE bu.symbol=bars.symbol AND j=bar_idx) AS bl, EXISTS (SELECT 1 FROM be WHERE be.symbol=bars.symbol AND j=bar_idx) AS br FROM bars)")


@query("order_blocks", "I20", q.h1(*OB, select=f"""SELECT {ID}, bl::BIGINT AS ob_bullish, br::BIGINT AS ob_bearish, {rnd('CASE WHEN bl THEN high END')} AS ob_bull_high,
  {rnd('CASE WHEN bl THEN low END')} AS ob_bull_low, {rnd('CASE WHEN br THEN high END')} AS ob_bear_high, {rnd('CASE WHEN br THEN low END')} AS ob_bear_low FROM ob"""))
def _(spark, sf):
    return _ind(spark, sf, "ob_bull_high ob_bull_low ob_bear_high ob_bear_low", st.order_blocks(), ints="bar_idx ob_bullish ob_bearish")


FVG = (f"a AS (SELECT *, lag(high) OVER ({S}) AS h0, lag(low) OVER ({S}) AS l0, lead(high) OVER ({S}) AS h1, lead(low) OVER ({S}) AS l1 FROM bars)",)


@query("fair_value_gaps", "I21", q.h1(*FVG, select=f"""SELECT {ID}, coalesce(l1>h0, false)::BIGINT AS fvg_bull, coalesce(h1<l0, false)::BIGINT AS fvg_bear,
  {rnd('CASE WHEN l1>h0 THEN l1 END')} AS fvg_bull_top, {rnd('CASE WHEN l1>h0 THEN h0 END')} AS fvg_bull_bottom,
  {rnd('CASE WHEN h1<l0 THEN l0 END')} AS fvg_bear_top, {rnd('CASE WHEN h1<l0 THEN h1 END')} AS fvg_bear_bottom FROM a"""))
def _(spark, sf):
    return _ind(spark, sf, "fvg_bull_top fvg_bull_bottom fvg_bear_top fvg_bear_bottom", st.fair_value_gaps(), ints="bar_idx fvg_bull fvg_bear")


def _level(xs):
    return f"list_filter({xs}, lambda lv: len(list_filter({xs}, lambda x: abs(x-lv) < tol)) >= 2)[1]"


@query("liquidity_levels", "I22", q.h1(
    "m AS (SELECT *, (high+low)/2 AS mid FROM bars)",
    f"mt AS (SELECT *, greatest(high-low, abs(high - lag(mid) OVER ({S})), abs(low - lag(mid) OVER ({S}))) AS tr FROM m)", q.wilder("atr", "mt", "tr", 14),
    f"a AS (SELECT b.*, atr.y*0.3::DOUBLE AS tol, list(high) {frame(-20, -1)} AS hs, list(low) {frame(-20, -1)} AS ls FROM {q.join_y('bars b', 'atr')})",
    f"c AS (SELECT *, CASE WHEN bar_idx>=40 THEN {_level('hs')} END AS resistance, CASE WHEN bar_idx>=40 THEN {_level('ls')} END AS support FROM a)",
    select=f"SELECT {ID}, {cols('resistance support')}, coalesce(resistance>high, false)::BIGINT AS liquidity_above, coalesce(support<low, false)::BIGINT AS liquidity_below FROM c"))
def _(spark, sf):
    return _ind(spark, sf, "resistance support", st.liquidity_levels(), ints="bar_idx liquidity_above liquidity_below")


VP = (f"w AS (SELECT *, list(close) {frame(-100, -1)} AS cs, list(tick_volume) {frame(-100, -1)} AS vs, min(close) {frame(-100, -1)} AS mn, max(close) {frame(-100, -1)} AS mx FROM bars)",
      "u AS (SELECT symbol, bar_idx, mn, mx, unnest(cs) AS c, unnest(vs) AS v FROM w WHERE bar_idx>=100 AND mx>mn)",
      "g AS (SELECT symbol, bar_idx, mn, mx, floor((c-mn)/(mx-mn)*49)::BIGINT AS b, sum(v) AS vol FROM u GROUP BY ALL)",
      "best AS (SELECT symbol, bar_idx, mn, mx, arg_max(b, (vol, -b)) AS b FROM g GROUP BY ALL)")


@query("volume_profile_poc", "I32 G17", q.h1(*VP, select=f"""SELECT bars.symbol, bars.bar_idx::BIGINT AS bar_idx, {rnd('mn + b*(mx-mn)/49')} AS poc,
  coalesce(close > mn + b*(mx-mn)/49, false)::BIGINT AS above_poc FROM bars LEFT JOIN best USING (symbol, bar_idx)"""))
def _(spark, sf):
    return _ind(spark, sf, "poc", st.volume_profile(), ints="bar_idx above_poc")


@query("volume_profile_value_area", "I32")
def _(spark, sf):
    return _ind(spark, sf, "poc vah val", st.volume_profile())


BP = (f"w AS (SELECT *, list(close) {frame(-239, 0)} AS cs, list(tick_volume) {frame(-239, 0)} AS vs, min(close) {frame(-239, 0)} AS mn, max(close) {frame(-239, 0)} AS mx FROM bars)",
      "u AS (SELECT symbol, bar_idx, mn, mx, unnest(cs) AS c, unnest(vs) AS v FROM w WHERE bar_idx>=239 AND mx>mn)",
      "g AS (SELECT symbol, bar_idx, mn, mx, greatest(ceil((c-mn)/((mx-mn)/20)), 1)::BIGINT AS b, sum(v) AS vol FROM u GROUP BY ALL)",
      "best AS (SELECT symbol, bar_idx, mn, mx, arg_max(b, (vol, -b)) AS b FROM g GROUP BY ALL)")


@query("binned_poc", "I33", q.h1(*BP, select=f"""SELECT w.symbol, w.bar_idx::BIGINT AS bar_idx,
  {rnd('CASE WHEN w.bar_idx>=239 THEN CASE WHEN w.mx>w.mn THEN w.mn + (b-0.5)*((w.mx-w.mn)/20) ELSE close END END')} AS poc_mid FROM w LEFT JOIN best USING (symbol, bar_idx)"""))
def _(spark, sf):
    return _ind(spark, sf, "poc_mid", st.binned_poc())


# ---------------------------------------------------------------- feature columns

RET = (f"r AS (SELECT *, ln(close / lag(close) OVER ({S})) AS log_returns FROM bars)",
       f"x AS (SELECT *, CASE WHEN bar_idx>=20 THEN stddev_samp(log_returns) {frame(-19, 0)} END * sqrt(252) AS realized_vol, "
       f"CASE WHEN bar_idx>=60 THEN skewness(log_returns) {frame(-59, 0)} END AS returns_skew, CASE WHEN bar_idx>=60 THEN kurtosis(log_returns) {frame(-59, 0)} END AS returns_kurt FROM r)")


@query("return_stats", "I34", q.h1(*RET, select=f"SELECT {ID}, {cols('log_returns realized_vol returns_skew returns_kurt')} FROM x"))
def _(spark, sf):
    return _ind(spark, sf, "log_returns realized_vol returns_skew returns_kurt", ft.return_stats())


@query("clock_features", "I35", q.h1(select=f"""SELECT {ID}, {rnd('hour(ts)/23.0')} AS hour, {rnd('(isodow(ts)-1)/6.0')} AS day_of_week, (hour(ts)>=8 AND hour(ts)<16)::BIGINT AS london_session,
  (hour(ts)>=13 AND hour(ts)<21)::BIGINT AS ny_session, (hour(ts)<8)::BIGINT AS tokyo_session FROM bars"""))
def _(spark, sf):
    return show(ft.clock(event_bars(spark, sf)), "bar_idx london_session ny_session tokyo_session", "hour day_of_week", "symbol")


MA = (q.atr_ctes(14), f"md AS (SELECT b.*, CASE WHEN atr.y=0 THEN 1e-9 ELSE atr.y END AS atr, CASE WHEN bar_idx>=19 THEN avg(close) {frame(-19, 0)} END AS ma_fast, CASE WHEN bar_idx>=49 THEN avg(close) {frame(-49, 0)} END AS ma_slow FROM {q.join_y('bars b', 'atr')})")
AGE = (f"fl AS (SELECT *, coalesce(ma_fast>ma_slow, false) AS up FROM md)", f"fk AS (SELECT *, CASE WHEN up <> lag(up) OVER ({S}) THEN bar_idx END AS flip FROM fl)",
       f"ag AS (SELECT *, bar_idx - coalesce(max(flip) {q.ALL}, 0) AS ma_cross_age FROM fk)")


@query("ma_distance_and_cross_age", "I36", q.h1(*MA, *AGE, select=f"SELECT {ID}, ma_cross_age::BIGINT AS ma_cross_age, {rnd('(close-ma_fast)/atr')} AS ma_fast_dist, {rnd('(close-ma_slow)/atr')} AS ma_slow_dist FROM ag"))
def _(spark, sf):
    return show(ft.cross_age(with_indicators(event_bars(spark, sf), ft.ma_distance())), "bar_idx ma_cross_age", "ma_fast_dist ma_slow_dist", "symbol")


KC = (q.ema("ke", "bars", "close", 20), q.atr_ctes(14, "ka"))


@query("squeeze", "I37", q.h1(*BB, *KC, f"k AS (SELECT b.*, ke.y AS km, ke.y+2*ka.y AS ku, ke.y-2*ka.y AS kl FROM {q.join_y('b', 'ke', 'ka')})",
                              "z AS (SELECT *, (bb_upper-bb_lower)/CASE WHEN bb_mid=0 THEN 1e-9 ELSE bb_mid END AS bb_rel_width, (ku-kl)/CASE WHEN km=0 THEN 1e-9 ELSE km END AS kc_width, "
                              "(close-kl)/CASE WHEN ku-kl=0 THEN 1e-9 ELSE ku-kl END AS price_kc_pos FROM k)",
                              select=f"SELECT {ID}, {cols('bb_rel_width kc_width price_kc_pos')}, coalesce(bb_rel_width<kc_width, false)::BIGINT AS bb_squeeze FROM z"))
def _(spark, sf):
    return _ind(spark, sf, "bb_rel_width kc_width price_kc_pos", ft.squeeze(), ints="bar_idx bb_squeeze")


RSI = (f"rd AS (SELECT *, coalesce(close - lag(close) OVER ({S}), 0) AS d FROM bars)", q.wilder("up", "rd", "greatest(d,0)", 14, 1), q.wilder("dn", "rd", "greatest(-d,0)", 14, 1),
       "rs AS (SELECT up.symbol, up.bar_idx, CASE WHEN dn.y<>0 THEN 100-100/(1+up.y/dn.y) WHEN up.y>0 THEN 100 ELSE 50 END AS rsi FROM up JOIN dn USING (symbol, bar_idx))")
MACD = (q.ema("ef", "bars", "close", 12), q.ema("es", "bars", "close", 26), "ml AS (SELECT symbol, bar_idx, ef.y-es.y AS m FROM ef JOIN es USING (symbol, bar_idx))", q.ema("sg", "ml", "m", 9, 25),
        "mc AS (SELECT bars.*, ml.m AS macd, sg.y AS macd_signal, ml.m-sg.y AS macd_hist FROM bars LEFT JOIN ml USING (symbol, bar_idx) LEFT JOIN sg USING (symbol, bar_idx))")


@query("divergences", "I38", q.h1(*RSI, *MACD, "dv AS (SELECT mc.*, rs.rsi FROM mc LEFT JOIN rs USING (symbol, bar_idx))",
                                  f"dw AS (SELECT *, close/nullif(lag(close,14) OVER ({S}),0) - 1 AS dc, rsi/nullif(lag(rsi,14) OVER ({S}),0) - 1 AS dr, macd/nullif(lag(macd,14) OVER ({S}),0) - 1 AS dm FROM dv)",
                                  select=f"SELECT {ID}, {rnd('dc-dr')} AS rsi_price_divergence, {rnd('dc-dm', 3)} AS macd_price_divergence FROM dw"))
def _(spark, sf):
    df = with_indicators(event_bars(spark, sf), ft.divergences())
    return df.select("symbol", "bar_idx", fixed("rsi_price_divergence").alias("rsi_price_divergence"), fixed("macd_price_divergence", 3).alias("macd_price_divergence"))


@query("volume_ratios", "I39", q.h1(select=f"SELECT {ID}, {rnd(f'CASE WHEN bar_idx>=49 THEN tick_volume/avg(tick_volume) {frame(-49, 0)} END')} AS volume_momentum, {rnd('tick_volume/CASE WHEN high-low=0 THEN 1e-9 ELSE high-low END', 2)} AS volume_price_ratio FROM bars"))
def _(spark, sf):
    df = with_indicators(event_bars(spark, sf), ft.volume_ratios())
    return df.select("symbol", "bar_idx", fixed("volume_momentum").alias("volume_momentum"), fixed("volume_price_ratio", 2).alias("volume_price_ratio"))


@query("order_flow_delta", "I40", q.h1(f"a AS (SELECT *, sign(close - lag(close) OVER ({S}))*tick_volume AS v FROM bars)", select=f"SELECT {ID}, {rnd(f'CASE WHEN bar_idx>=50 THEN sum(v) {frame(-49, 0)} END')} AS cumulative_delta FROM a"))
def _(spark, sf):
    return _ind(spark, sf, "cumulative_delta", ft.order_flow())


@query("fib_distances", "I41", q.h1(*MA, f"a AS (SELECT *, max(high) {frame(-119, 0)} AS h, min(low) {frame(-119, 0)} AS l FROM md)",
                                    select=f"SELECT {ID}, " + ", ".join(f"{rnd(f'CASE WHEN bar_idx>=119 THEN (close-(h-(h-l)*{r}::DOUBLE))/atr END')} AS dist_from_fib_{n}" for n, r in (("382", .382), ("500", .5), ("618", .618))) + " FROM a"))
def _(spark, sf):
    return _ind(spark, sf, "dist_from_fib_382 dist_from_fib_500 dist_from_fib_618", ft.ma_distance(), ft.fib_distances())


@query("channel_position", "I42", q.h1(*MA, f"a AS (SELECT *, max(high) {frame(-19, 0)} AS h, min(low) {frame(-19, 0)} AS l FROM md)",
                                       select=f"SELECT {ID}, {rnd('CASE WHEN bar_idx>=19 THEN (h-l)/atr END')} AS donchian_width, {rnd('CASE WHEN bar_idx>=19 THEN (close-l)/CASE WHEN h=l THEN 1e-9 ELSE h-l END END')} AS donchian_pos FROM a"))
def _(spark, sf):
    return _ind(spark, sf, "donchian_width donchian_pos", ft.ma_distance(), ft.channel_position())


@query("obv_slope", "I43", q.h1(*OBV, select=f"SELECT {ID}, {rnd(f'CASE WHEN bar_idx>=13 THEN regr_slope(obv, bar_idx) {frame(-13, 0)} END')} AS obv_slope FROM o"))
def _(spark, sf):
    return _ind(spark, sf, "obv_slope", ind.obv_slope())


ADX = (q.atr_ctes(14, "aa"), f"dm0 AS (SELECT *, coalesce(high - lag(high) OVER ({S}),0) AS u, coalesce(lag(low) OVER ({S}) - low,0) AS d FROM bars)",
       "dmx AS (SELECT *, CASE WHEN u>d AND u>0 THEN u ELSE 0 END AS pdm, CASE WHEN d>u AND d>0 THEN d ELSE 0 END AS mdm FROM dm0)", q.ema("ps", "dmx", "pdm", 14), q.ema("mns", "dmx", "mdm", 14),
       f"di AS (SELECT bars.*, CASE WHEN aa.y>0 THEN ps.y/aa.y*100 ELSE 0 END AS plus_di, CASE WHEN aa.y>0 THEN mns.y/aa.y*100 ELSE 0 END AS minus_di FROM {q.join_y('bars', 'aa', 'ps', 'mns')})",
       "dx AS (SELECT *, CASE WHEN plus_di+minus_di>0 THEN abs(plus_di-minus_di)/(plus_di+minus_di)*100 ELSE 0 END AS dxv FROM di)", q.ema("ax", "dx", "dxv", 14))
STATE = (*ADX, q.ema("e9", "bars", "close", 9),
         f"s1 AS (SELECT dx.*, ax.y AS adx, e9.y AS e, CASE WHEN bar_idx>=19 THEN avg(close) {frame(-19, 0)} END AS f, CASE WHEN bar_idx>=49 THEN avg(close) {frame(-49, 0)} END AS s, "
         f"CASE WHEN bar_idx>=19 THEN 4*stddev_pop(close) {frame(-19, 0)}/avg(close) {frame(-19, 0)} END AS w FROM {q.join_y('dx', 'ax', 'e9')})",
         f"s2 AS (SELECT *, CASE WHEN bar_idx>=68 THEN avg(w) {frame(-49, 0)} END AS wm FROM s1)",
         "s3 AS (SELECT *, CASE WHEN adx>25 AND f>s AND close>e THEN 'Tendance_Haussiere_Impulsion' WHEN adx>25 AND f>s AND close<=e THEN 'Tendance_Haussiere_Correction' WHEN adx<=25 AND f>s THEN 'Tendance_Haussiere_Faible' "
         "WHEN adx>25 AND f<s AND close<e THEN 'Tendance_Baissiere_Impulsion' WHEN adx>25 AND f<s AND close>=e THEN 'Tendance_Baissiere_Correction' WHEN adx<=25 AND f<s THEN 'Tendance_Baissiere_Faible' "
         "WHEN adx<20 AND w<wm THEN 'Range_Calme' WHEN adx<20 AND w>=wm THEN 'Range_Volatil' ELSE 'Indetermine' END AS market_state FROM s2)")


@query("market_state", "I44", q.h1(*STATE, select=f"SELECT {ID}, market_state FROM s3"))
def _(spark, sf):
    return show(with_indicators(event_bars(spark, sf), ft.market_state()), "bar_idx", "", "symbol market_state")


@query("market_state_one_hot", "I45", q.h1(*STATE, select="SELECT symbol, " + ", ".join(f"sum((market_state='{s}')::INT)::BIGINT AS state_{s}" for s in (*ft.STATES, ft.UNKNOWN_STATE)) + " FROM s3 GROUP BY symbol"))
def _(spark, sf):
    hot = ft.one_hot_state(with_indicators(event_bars(spark, sf), ft.market_state()))
    return hot.groupBy("symbol").agg(*[F.sum(f"state_{s}").alias(f"state_{s}") for s in (*ft.STATES, ft.UNKNOWN_STATE)])


TEXTBOOK = (q.tr_cte(),
            f"t1 AS (SELECT *, max(high) {frame(-13, 0)} - min(low) {frame(-13, 0)} AS spr, sum(tr) {frame(-13, 0)} AS st, sum(abs(high - low1)) {frame(-13, 0)} AS sp, sum(abs(low - high1)) {frame(-13, 0)} AS sm, "
            f"avg((high+low)/2) {frame(-4, 0)} - avg((high+low)/2) {frame(-33, 0)} AS ao, sum(CASE WHEN high>low THEN ((close-low)-(high-close))/(high-low) ELSE 0 END*tick_volume) {frame(-19, 0)}/sum(tick_volume) {frame(-19, 0)} AS mf "
            f"FROM (SELECT *, lag(low) OVER ({S}) AS low1, lag(high) OVER ({S}) AS high1 FROM trs))")


@query("textbook_indicators", "I46", q.h1(*TEXTBOOK, select=f"""SELECT {ID}, {rnd('CASE WHEN bar_idx>=13 AND spr>0 THEN 100*log10(st/spr)/log10(14) END')} AS choppiness_index,
  {rnd('CASE WHEN bar_idx>=33 THEN ao END')} AS awesome_oscillator, {rnd('CASE WHEN bar_idx>=14 AND st>0 THEN (sp-sm)/st END')} AS vortex_diff,
  {rnd('CASE WHEN bar_idx>=19 THEN mf END')} AS cmf FROM t1"""))
def _(spark, sf):
    return _ind(spark, sf, "choppiness_index awesome_oscillator vortex_diff cmf", ft.choppiness(), ft.awesome_oscillator(), ft.vortex(), ft.money_flow())


DAY = "OVER (PARTITION BY symbol, ts::DATE ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("daily_vwap_distance", "I46", q.h1(*MA, select=f"SELECT {ID}, {rnd(f'(close - sum((high+low+close)/3*tick_volume) {DAY} / sum(tick_volume) {DAY})/atr')} AS vwap_dist FROM md"))
def _(spark, sf):
    return show(ft.daily_vwap_distance(with_indicators(event_bars(spark, sf), ft.ma_distance())), "bar_idx", "vwap_dist", "symbol")


CANDLE = (f"k0 AS (SELECT *, lag(open) OVER ({S}) AS po, lag(high) OVER ({S}) AS ph, lag(low) OVER ({S}) AS pl, lag(close) OVER ({S}) AS pc FROM bars)",
          "k1 AS (SELECT *, abs(close-open) AS bd, high-low AS sp, high-greatest(open,close) AS uw, least(open,close)-low AS lw, greatest(open,close)<greatest(po,pc) AND least(open,close)>least(po,pc) AS wi FROM k0)")


@query("candle_patterns", "I47 I46", q.h1(*CANDLE, select=f"""SELECT {ID}, {rnd('CASE WHEN sp>0 THEN bd/sp ELSE 0 END')} AS candle_body_ratio, ((CASE WHEN sp>0 AND bd<=0.1*sp THEN 1 ELSE 0 END)
 + (CASE WHEN high<ph AND low>pl THEN 1 ELSE 0 END) + (CASE WHEN pc<po AND close>open AND open<=pc AND close>=po THEN 1 WHEN pc>po AND close<open AND open>=pc AND close<=po THEN -1 ELSE 0 END)
 + (CASE WHEN bd>0 AND lw>=2*bd AND uw<=0.1*sp THEN 1 ELSE 0 END) + (CASE WHEN bd>0 AND uw>=2*bd AND lw<=0.1*sp THEN -1 ELSE 0 END)
 + (CASE WHEN wi AND pc<po AND close>open THEN 1 WHEN wi AND pc>po AND close<open THEN -1 ELSE 0 END))::DOUBLE AS candle_pattern_score FROM k1"""))
def _(spark, sf):
    return _ind(spark, sf, "candle_pattern_score candle_body_ratio", ft.candle_score())


@query("atr_scaled_lines", "I48", q.h1(*MACD, *MA, "n AS (SELECT mc.*, md.atr FROM mc JOIN md USING (symbol, bar_idx))",
                                       select=f"SELECT {ID}, {rnd('macd/atr')} AS macd_dist, {rnd('macd_signal/atr')} AS macd_signal_dist, {rnd('macd_hist/atr')} AS macd_histogram_norm, {rnd('atr/close')} AS atr_percent FROM n"))
def _(spark, sf):
    df = with_indicators(event_bars(spark, sf), ind.macd(), ft.ma_distance())
    a = F.col("atr")
    return show(df.withColumns({"macd_dist": F.col("macd") / a, "macd_signal_dist": F.col("macd_signal") / a, "macd_histogram_norm": F.col("macd_hist") / a, "atr_percent": a / F.col("close")}),
                "bar_idx", "macd_dist macd_signal_dist macd_histogram_norm atr_percent", "symbol")


@query("cloud_features", "I49", q.h1(*ICHI, *MA, f"n AS (SELECT c.*, md.atr, lag(c.close,26) OVER (PARTITION BY c.symbol ORDER BY c.bar_idx) AS c26 FROM c JOIN md USING (symbol, bar_idx))",
                                     select=f"SELECT {ID}, {rnd('(tenkan-kijun)/atr')} AS ichi_cross, {rnd('(close-(span_a+span_b)/2)/atr')} AS price_cloud_pos, {rnd('(span_a-span_b)/atr')} AS cloud_strength, {rnd('(close-c26)/atr')} AS chikou_momentum FROM n"))
def _(spark, sf):
    return _ind(spark, sf, "ichi_cross price_cloud_pos cloud_strength chikou_momentum", ft.ma_distance(), ft.cloud_features())


# ---------------------------------------------------------------- recurrences


@query("ema", "E1", q.h1(q.ema("e", "bars", "close", 20), select=f"SELECT {ID}, {rnd('y')} AS ema_20 FROM {q.join_y('bars', 'e')}"))
def _(spark, sf):
    return _ind(spark, sf, "ema_20", ind.ema(20))


@query("ema_daily", "E1", q.d1(q.ema("e", "bars", "close", 50), select=f"SELECT {ID}, {rnd('y', 2)} AS ema_50 FROM {q.join_y('bars', 'e')}"))
def _(spark, sf):
    return show(with_indicators(order_bars(spark, sf), ind.ema(50)), "bar_idx", "ema_50", "symbol", dp=2)


CHAIN = (q.ema("e1", "bars", "close", 10), "x1 AS (SELECT symbol, bar_idx, coalesce(e1.y, 0) AS v FROM bars LEFT JOIN e1 USING (symbol, bar_idx))", q.ema("e2", "x1", "v", 10),
         "x2 AS (SELECT symbol, bar_idx, coalesce(e2.y, 0) AS v FROM bars LEFT JOIN e2 USING (symbol, bar_idx))", q.ema("e3", "x2", "v", 10))


@query("dema_tema", "E2 E3", q.h1(*CHAIN, select=f"SELECT {ID}, {rnd('2*e1.y-e2.y')} AS dema_10, {rnd('3*e1.y-3*e2.y+e3.y')} AS tema_10 FROM {q.join_y('bars', 'e1', 'e2', 'e3')}"))
def _(spark, sf):
    return _ind(spark, sf, "dema_10 tema_10", ind.dema(10), ind.tema(10))


@query("rsi", "E4", q.h1(*RSI, select=f"SELECT {ID}, {cols('rsi')} FROM bars LEFT JOIN rs USING (symbol, bar_idx)"))
def _(spark, sf):
    return _ind(spark, sf, "rsi", ind.rsi(14, out="rsi"))


@query("stochastic_rsi", "E5", q.h1(*RSI, "b1 AS (SELECT bars.*, rs.rsi FROM bars LEFT JOIN rs USING (symbol, bar_idx))",
                                    f"b2 AS (SELECT *, max(rsi) {frame(-13, 0)} AS h, min(rsi) {frame(-13, 0)} AS l FROM b1)",
                                    "b3 AS (SELECT *, CASE WHEN bar_idx<27 THEN 50 WHEN h<>l THEN (rsi-l)/(h-l)*100 ELSE 50 END AS s FROM b2)",
                                    f"b4 AS (SELECT *, CASE WHEN bar_idx>=2 THEN avg(s) {frame(-2, 0)} END AS k FROM b3)", f"b5 AS (SELECT *, CASE WHEN bar_idx>=2 THEN avg(coalesce(k,50)) {frame(-2, 0)} END AS d FROM b4)",
                                    select=f"SELECT {ID}, {rnd('k')} AS stoch_rsi_k, {rnd('d')} AS stoch_rsi_d FROM b5"))
def _(spark, sf):
    return _ind(spark, sf, "stoch_rsi_k stoch_rsi_d", ind.stoch_rsi())


@query("macd", "E6", q.h1(*MACD, select=f"SELECT {ID}, {cols('macd macd_signal macd_hist')} FROM mc"))
def _(spark, sf):
    return _ind(spark, sf, "macd macd_signal macd_hist", ind.macd())


@query("atr", "E7", q.h1(q.atr_ctes(14), select=f"SELECT {ID}, {rnd('y')} AS atr_14 FROM {q.join_y('bars', 'atr')}"))
def _(spark, sf):
    return _ind(spark, sf, "atr_14", ind.atr())


@query("adx", "E8", q.h1(*ADX, select=f"SELECT {ID}, {rnd('ax.y')} AS adx, {cols('plus_di minus_di')} FROM {q.join_y('dx', 'ax')}"))
def _(spark, sf):
    return _ind(spark, sf, "adx plus_di minus_di", ind.adx())


@query("keltner", "E9", q.h1(q.ema("ke", "bars", "close", 20), q.atr_ctes(10, "ka"), select=f"SELECT {ID}, {rnd('ke.y')} AS keltner_mid, {rnd('ke.y+2*ka.y')} AS keltner_upper, {rnd('ke.y-2*ka.y')} AS keltner_lower FROM {q.join_y('bars', 'ke', 'ka')}"))
def _(spark, sf):
    return _ind(spark, sf, "keltner_mid keltner_upper keltner_lower", ind.keltner())


@query("force_index", "E10", q.h1(f"f0 AS (SELECT *, (close - lag(close) OVER ({S}))*tick_volume AS f FROM bars)", q.ema("e", "f0", "f", 13, 1), select=f"SELECT {ID}, {rnd('y')} AS force_index FROM {q.join_y('bars', 'e')}"))
def _(spark, sf):
    return _ind(spark, sf, "force_index", ind.force_index())


@query("obv_trend", "E13", q.h1(*OBV, q.ema("e", "o", "obv", 20), select=f"SELECT {ID}, {rnd('obv-y')} AS obv_trend FROM {q.join_y('o', 'e')}"))
def _(spark, sf):
    return _ind(spark, sf, "obv_trend", ind.obv_trend())


SUPERTREND = (q.atr_ctes(10), f"sb AS MATERIALIZED (SELECT symbol, bar_idx, close, lag(close) OVER ({S}) AS pc, (high+low)/2+3*atr.y AS bu, (high+low)/2-3*atr.y AS bl FROM {q.join_y('bars', 'atr')})",
              """sr AS (SELECT symbol, bar_idx, bu AS u, bl AS l, CASE WHEN close>bu THEN 1 ELSE -1 END AS dir FROM sb WHERE bar_idx=10
  UNION ALL SELECT symbol, bar_idx, u2, l2, CASE WHEN dir=1 THEN CASE WHEN close>=l2 THEN 1 ELSE -1 END ELSE CASE WHEN close<=u2 THEN -1 ELSE 1 END END FROM
   (SELECT s.symbol, s.bar_idx, s.close, p.dir, CASE WHEN s.pc<=p.u THEN least(s.bu,p.u) ELSE s.bu END AS u2, CASE WHEN s.pc>=p.l THEN greatest(s.bl,p.l) ELSE s.bl END AS l2
    FROM sr p JOIN sb s ON s.symbol=p.symbol AND s.bar_idx=p.bar_idx+1))""")


@query("supertrend", "E11 D5", q.h1(*SUPERTREND, select=f"SELECT {ID}, coalesce(dir,0)::BIGINT AS supertrend_dir, {rnd('CASE WHEN dir=1 THEN l ELSE u END')} AS supertrend FROM bars LEFT JOIN sr USING (symbol, bar_idx)"))
def _(spark, sf):
    df = carried.supertrend(event_bars(spark, sf))
    return show(df.withColumn("supertrend", F.nanvl("supertrend", F.lit(None))), "bar_idx supertrend_dir", "supertrend", "symbol")


SAR = (f"sb AS MATERIALIZED (SELECT symbol, bar_idx, high, low, lag(high) OVER ({S}) AS h1, lag(low) OVER ({S}) AS l1, lag(high,2) OVER ({S}) AS h2, lag(low,2) OVER ({S}) AS l2 FROM bars)",
       """sr AS (SELECT symbol, bar_idx, low AS sar, high AS ep, 0.02::DOUBLE AS af, 1 AS dir FROM sb WHERE bar_idx=0
  UNION ALL SELECT symbol, bar_idx, CASE WHEN flip THEN ep2 ELSE s END, CASE WHEN flip THEN CASE WHEN dir=1 THEN low ELSE high END ELSE ep2 END, CASE WHEN flip THEN 0.02::DOUBLE ELSE af2 END, CASE WHEN flip THEN -dir ELSE dir END FROM
   (SELECT *, CASE WHEN dir=1 THEN low<s ELSE high>s END AS flip, CASE WHEN dir=1 THEN greatest(ep,high) ELSE least(ep,low) END AS ep2,
      CASE WHEN (dir=1 AND high>ep) OR (dir=-1 AND low<ep) THEN least(af+0.02::DOUBLE, 0.2::DOUBLE) ELSE af END AS af2 FROM
    (SELECT b.symbol, b.bar_idx, b.high, b.low, p.ep, p.af, p.dir, CASE WHEN p.dir=1 THEN least(p.sar+p.af*(p.ep-p.sar), b.l1, coalesce(b.l2,b.l1)) ELSE greatest(p.sar+p.af*(p.ep-p.sar), b.h1, coalesce(b.h2,b.h1)) END AS s
     FROM sr p JOIN sb b ON b.symbol=p.symbol AND b.bar_idx=p.bar_idx+1)))""")


@query("parabolic_sar", "E12 D5", q.h1(*SAR, select=f"SELECT {ID}, dir::BIGINT AS sar_dir, {cols('sar')} FROM sr"))
def _(spark, sf):
    return show(carried.parabolic_sar(event_bars(spark, sf)), "bar_idx sar_dir", "sar", "symbol")


@query("garch_volatility", "E14")
def _(spark, sf):
    from barlab.operators.volatility import garch

    return show(garch(order_bars(spark, sf)), "bar_idx", "garch_volatility garch_alpha garch_beta", "symbol")


def _peaks_sql(name: str, value: str) -> str:
    """CTEs that end in ``name`` (symbol, bar_idx, v): maxima with flat tops as one, thinned by height, then by prominence."""
    n, valley = name, lambda inside: f"(SELECT min(b.v) FROM {name}_r b WHERE b.symbol=q.symbol AND {inside})"
    higher = lambda fn, side, none: f"(SELECT coalesce({fn}(b.bar_idx), {none}) FROM {n}_r b WHERE b.symbol=d.symbol AND b.bar_idx {side} d.bar_idx AND b.v > m.v)"
    return f"""{n}_c AS (SELECT symbol, bar_idx, {value} AS v, coalesce({value} <> lag({value}) OVER ({S}), true)::INT AS changed FROM bars),
{n}_r AS (SELECT symbol, bar_idx, v, sum(changed) OVER ({S}) AS run FROM {n}_c), {n}_g AS (SELECT symbol, run, min(bar_idx) AS lo, max(bar_idx) AS hi, any_value(v) AS v FROM {n}_r GROUP BY symbol, run),
{n}_a AS (SELECT *, lag(v) OVER (PARTITION BY symbol ORDER BY run) AS before, lead(v) OVER (PARTITION BY symbol ORDER BY run) AS after FROM {n}_g),
{n}_m AS (SELECT symbol, ((lo+hi)//2)::BIGINT AS bar_idx, v FROM {n}_a WHERE before < v AND after < v),
{n}_o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY v DESC, bar_idx DESC) AS rn FROM {n}_m),
{n}_k AS (SELECT DISTINCT symbol, 0::BIGINT AS rn, []::BIGINT[] AS kept FROM {n}_o UNION ALL SELECT k.symbol, o.rn, CASE WHEN len(list_filter(k.kept, lambda x: abs(x - o.bar_idx) < 5)) = 0 THEN list_append(k.kept, o.bar_idx) ELSE k.kept END
  FROM {n}_k k JOIN {n}_o o ON o.symbol = k.symbol AND o.rn = k.rn + 1),
{n}_d AS (SELECT symbol, unnest(arg_max(kept, rn)) AS bar_idx FROM {n}_k GROUP BY symbol),
{n}_q AS (SELECT d.symbol, d.bar_idx, m.v, {higher('max', '<', '-1')} AS l, {higher('min', '>', '1000000000')} AS r FROM {n}_d d JOIN {n}_m m ON m.symbol = d.symbol AND m.bar_idx = d.bar_idx),
{n} AS (SELECT symbol, bar_idx, v FROM {n}_q q WHERE v - greatest({valley('b.bar_idx > q.l AND b.bar_idx <= q.bar_idx')}, {valley('b.bar_idx < q.r AND b.bar_idx >= q.bar_idx')}) >= 0.001)"""


_LAST = "last_value({0}.v IGNORE NULLS) OVER (PARTITION BY md.symbol ORDER BY md.bar_idx ROWS UNBOUNDED PRECEDING)"
SWINGS = (_peaks_sql("hp", "high"), _peaks_sql("lp", "-low"), f"sw AS (SELECT md.symbol, md.bar_idx, md.close, md.atr, {_LAST.format('hp')} AS sh, -{_LAST.format('lp')} AS sl FROM md LEFT JOIN hp ON hp.symbol = md.symbol AND hp.bar_idx = md.bar_idx LEFT JOIN lp ON lp.symbol = md.symbol AND lp.bar_idx = md.bar_idx)")


@query("swing_distances", "I50", q.h1(*MA, *SWINGS, select=f"SELECT {ID}, {rnd('(close-sh)/atr')} AS distance_from_swing_high, {rnd('(close-sl)/atr')} AS distance_from_swing_low, {rnd('(sh-sl)/atr')} AS swing_range_width FROM sw"))
def _(spark, sf):
    from barlab.operators.volatility import swing_distances

    df = swing_distances(with_indicators(event_bars(spark, sf), ft.ma_distance()))
    return show(df, "bar_idx", "distance_from_swing_high distance_from_swing_low swing_range_width", "symbol")


@query("technical_feature_frame", "P1 P2 I33 I48")
def _(spark, sf):
    wanted = ft.active_features(["moving_averages", "rsi", "macd", "bollinger", "keltner", "ichimoku", "supertrend", "parabolic_sar", "pivots", "volume_profile", "candles"])
    return ft.align(ft.technical_frame(event_bars(spark, sf)), wanted, ["symbol", "bar_idx"])
