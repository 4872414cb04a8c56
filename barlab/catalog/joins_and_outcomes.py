"""Queries for joins, gates, signals and trade outcomes (survey groups 2.2, 2.3, 2.4, 2.10, 2.11)."""

from __future__ import annotations

from datetime import date
from uuid import uuid4

from pyspark.sql import functions as F

from barlab.catalog import sql as q
from barlab.catalog.bars_and_indicators import ID, MA, STATE, TS
from barlab.catalog.data import event_bars, fixed, order_bars, predictions, show, table, trades
from barlab.catalog.registry import query
from barlab.catalog.sql import S, cols, frame, rnd
from barlab.core.steps import with_indicators
from barlab.functions import scalars as sc
from barlab.operators import asof, audits, features as ft, gates, indicators as ind, outcomes, periods
from barlab.plans import barrier_grid as grid, signals as sig
from barlab.session import ensure_checkpoint_dir
from barlab.sources import sinks

E1_, E4, ED = q.event_bars(), q.event_bars(14400, "h4"), q.event_bars(86400, "dd")


def _select(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


# ---------------------------------------------------------------- as-of joins


def _htf(bars: str, name: str, seconds: int) -> tuple[str, ...]:
    return (q.atr_ctes(14, f"a{name}", bars),
            f"f{name} AS (SELECT b.symbol, b.ts + INTERVAL {seconds} SECOND AS at, CASE WHEN bar_idx>=19 THEN avg(close) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS 4 PRECEDING) / avg(close) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS 19 PRECEDING) - 1 END AS trend_{name}, "
            f"a{name}.y/close AS volatility_{name} FROM {q.join_y(f'{bars} b', f'a{name}')})")


def _fill(c):
    return f"last_value({c} IGNORE NULLS) {q.ALL} AS {c}"


@query("higher_timeframe_features", "J1", _select(
    E1_, E4, ED, *_htf("h4", "h4", 14400), *_htf("dd", "d1", 86400),
    "j1 AS (SELECT bars.*, f.trend_h4, f.volatility_h4 FROM bars ASOF LEFT JOIN fh4 f ON bars.symbol=f.symbol AND bars.ts>=f.at)",
    "j2 AS (SELECT j1.*, f.trend_d1, f.volatility_d1 FROM j1 ASOF LEFT JOIN fd1 f ON j1.symbol=f.symbol AND j1.ts>=f.at)",
    f"j3 AS (SELECT symbol, bar_idx, {_fill('trend_h4')}, {_fill('volatility_h4')}, {_fill('trend_d1')}, {_fill('volatility_d1')} FROM j2)",
    select=f"SELECT {ID}, {cols('trend_h4 volatility_h4 trend_d1 volatility_d1', 6)} FROM j3"))
def _(spark, sf):
    df = asof.higher_timeframe_features(event_bars(spark, sf), {"H4": event_bars(spark, sf, "H4"), "D1": event_bars(spark, sf, "D1")})
    return show(df, "bar_idx", "trend_h4 volatility_h4 trend_d1 volatility_d1", "symbol", dp=6)


TREND5 = (ED, f"tn AS (SELECT *, CASE WHEN bar_idx>=4 THEN avg(close) {frame(-4, 0)} END AS m0 FROM dd)", f"tm AS (SELECT symbol, ts, lag(m0) OVER ({S}) AS ma FROM tn)")
TREND5J = (*TREND5, "tf AS (SELECT bars.*, tm.ma AS trend_filter_ma, coalesce(bars.close>tm.ma, false)::BIGINT AS trend_filter_above FROM bars ASOF LEFT JOIN tm ON bars.symbol=tm.symbol AND bars.ts>=tm.ts)")


@query("trend_filter", "J2 G13", _select(E1_, *TREND5J, select=f"SELECT {ID}, {cols('trend_filter_ma')}, trend_filter_above FROM tf"))
def _(spark, sf):
    return show(asof.trend_filter(event_bars(spark, sf), event_bars(spark, sf, "D1"), 5, "D1"), "bar_idx trend_filter_above", "trend_filter_ma", "symbol")


@query("trend_flag_counts", "G13", _select(E1_, *TREND5J, select="SELECT symbol, trend_filter_above, count(*)::BIGINT AS n FROM tf GROUP BY ALL"))
def _(spark, sf):
    df = asof.trend_filter(event_bars(spark, sf), event_bars(spark, sf, "D1"), 5, "D1")
    return df.groupBy("symbol", F.col("trend_filter_above").cast("bigint").alias("trend_filter_above")).agg(F.count(F.lit(1)).alias("n"))


@query("trend_filter_resampled", "J3", _select(
    E1_, "rs AS (SELECT symbol, ts::DATE AS d, last(close ORDER BY ts) AS c FROM bars GROUP BY 1, 2)",
    "rm AS (SELECT symbol, d, avg(c) OVER (PARTITION BY symbol ORDER BY d RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS ma FROM rs)",
    select=f"SELECT symbol, bar_idx::BIGINT AS bar_idx, {rnd('ma')} AS trend_filter_ma, coalesce(close>ma, false)::BIGINT AS trend_filter_above FROM bars JOIN rm USING (symbol) WHERE bars.ts::DATE = rm.d"))
def _(spark, sf):
    return show(asof.trend_filter_from_base(event_bars(spark, sf), 5, "D1"), "bar_idx trend_filter_above", "trend_filter_ma", "symbol")


ATRS = (E1_, E4, ED, q.atr_ctes(14, "b1", "bars"), q.atr_ctes(14, "b4", "h4"), q.atr_ctes(14, "bd", "dd"),
        "r1 AS (SELECT b1.symbol, ts, y FROM b1 JOIN bars USING (symbol, bar_idx))", "r4 AS (SELECT b4.symbol, ts, y FROM b4 JOIN h4 USING (symbol, bar_idx))",
        "rd AS (SELECT bd.symbol, ts, y FROM bd JOIN dd USING (symbol, bar_idx))",
        "x1 AS (SELECT bars.*, r.y AS atr_h1 FROM bars ASOF LEFT JOIN r1 r ON bars.symbol=r.symbol AND bars.ts>=r.ts)",
        "x2 AS (SELECT x1.*, r.y AS atr_h4 FROM x1 ASOF LEFT JOIN r4 r ON x1.symbol=r.symbol AND x1.ts>=r.ts)",
        "x3 AS (SELECT x2.*, r.y AS atr_d1 FROM x2 ASOF LEFT JOIN rd r ON x2.symbol=r.symbol AND x2.ts>=r.ts)")


def _tfs(spark, sf):
    return {t: event_bars(spark, sf, t) for t in ("H1", "H4", "D1")}


@query("atr_by_timeframe", "J4", _select(*ATRS, select=f"SELECT {ID}, {cols('atr_h1 atr_h4 atr_d1')} FROM x3"))
def _(spark, sf):
    return show(grid.atr_by_timeframe(event_bars(spark, sf), _tfs(spark, sf)), "bar_idx", "atr_h1 atr_h4 atr_d1", "symbol")


REFS = ("click", "view", "purchase", "error", "signup")


def _corr(n, other):
    return (f"c{n}a AS (SELECT rt.*, o.ret AS ref FROM rt ASOF LEFT JOIN (SELECT ts, ret FROM rt WHERE symbol='{other}' AND ret IS NOT NULL) o ON rt.ts>=o.ts)",
            f"c{n} AS (SELECT symbol, bar_idx, CASE WHEN symbol<>'{other}' AND count(CASE WHEN ret IS NOT NULL AND ref IS NOT NULL THEN 1 END) {frame(-49, 0)}=50 THEN corr(ret, ref) {frame(-49, 0)} END AS corr_{n} FROM c{n}a)")


@query("rolling_correlation", "J5", _select(
    E1_, f"rt AS (SELECT *, close/lag(close) OVER ({S}) - 1 AS ret FROM bars)", *_corr(0, REFS[0]), *_corr(1, REFS[1]), *_corr(2, REFS[2]),
    select=f"SELECT {ID}, {cols('corr_0 corr_1 corr_2')} FROM c0 JOIN c1 USING (symbol, bar_idx) JOIN c2 USING (symbol, bar_idx)"))
def _(spark, sf):
    return show(asof.rolling_correlation(event_bars(spark, sf), REFS[:3]), "bar_idx", "corr_0 corr_1 corr_2", "symbol")


@query("daily_pivots", "J6", q.h1(*MA, "dp AS (SELECT symbol, ts::DATE + 1 AS d, max(close) AS h, min(close) AS l, last(close ORDER BY ts) AS c FROM bars GROUP BY symbol, ts::DATE)",
                                  "dj AS (SELECT md.*, (h+l+c)/3 AS p0, 2*(h+l+c)/3-l AS r0, 2*(h+l+c)/3-h AS s0 FROM md LEFT JOIN dp ON dp.symbol=md.symbol AND dp.d=md.ts::DATE)",
                                  f"dk AS (SELECT *, last_value(p0 IGNORE NULLS) {q.ALL} AS p, last_value(r0 IGNORE NULLS) {q.ALL} AS r, last_value(s0 IGNORE NULLS) {q.ALL} AS s FROM dj)",
                                  select=f"SELECT {ID}, {rnd('(close-p)/atr')} AS dist_from_pivot, {rnd('(close-r)/atr')} AS dist_from_r1, {rnd('(close-s)/atr')} AS dist_from_s1 FROM dk"))
def _(spark, sf):
    return show(ft.daily_pivots(with_indicators(event_bars(spark, sf), ft.ma_distance())), "bar_idx", "dist_from_pivot dist_from_r1 dist_from_s1", "symbol")


# ---------------------------------------------------------------- periods

TRADES = """trades AS (SELECT l_returnflag AS strategy_id, l_orderkey AS trade_no, max(l_shipdate)::DATE AS day,
  sum((round(l_extendedprice*100)*(round(l_discount*100)-round(l_tax*100)))::BIGINT)::DOUBLE/10000 AS pnl FROM lineitem GROUP BY 1, 2)"""
START, END = date(1995, 1, 1), date(2001, 12, 31)


def _period_sql(ps):
    return "p(period, kind, s, e, days) AS (VALUES " + ", ".join(f"('{p.name}', '{p.kind}', DATE '{p.start}', DATE '{p.end}', {(p.end - p.start).days})" for p in ps) + ")"


def _period_query(name, covers, ps):
    @query(name, covers, f"WITH {TRADES}, {_period_sql(ps)} SELECT strategy_id, period, kind, count(*)::BIGINT AS trades, {rnd('sum(pnl)')} AS profit, {rnd('min(pnl)')} AS worst FROM trades JOIN p ON day>=s AND day<e GROUP BY ALL")
    def _(spark, sf):
        df = periods.tag_periods(trades(spark, sf), ps)
        out = df.groupBy("strategy_id", "period", "kind").agg(F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("profit"), F.min("pnl").alias("worst"))
        return show(out, "trades", "profit worst", "strategy_id period kind")


_period_query("temporal_split_results", "V1 J10", periods.split(START, END))
_period_query("expanding_fold_results", "V2 J10", periods.expanding_folds(START, END, 5))
_period_query("walk_forward_window_results", "V9 J10", periods.walk_forward(START, END))


# ---------------------------------------------------------------- gates and direction

PRED = """pr AS (SELECT symbol, bar_idx, m, ('0x'||substr(md5(symbol||'-'||epoch(ts)::BIGINT||'-'||m),1,8))::BIGINT % 10001 / 10000.0::DOUBLE AS pb FROM bars, (VALUES (1),(2),(3)) v(m)),
en AS (SELECT symbol, bar_idx, avg(pb) AS proba_buy, avg(1-pb) AS proba_sell, avg(greatest(pb, 1-pb))*100 AS ensemble_conf, sum((pb>=1-pb)::INT)::BIGINT AS n_buy FROM pr GROUP BY ALL)"""


@query("ensemble_votes", "F8 F9 U6", q.h1(PRED, select=f"""SELECT {ID}, n_buy, {cols('proba_buy proba_sell ensemble_conf')}, {rnd('abs(proba_buy-proba_sell)*100')} AS margin, (n_buy IN (0,3))::BIGINT AS unanimous,
  CASE WHEN n_buy>3-n_buy THEN n_buy||'/3 BUY' ELSE (3-n_buy)||'/3 SELL' END AS consensus FROM en"""))
def _(spark, sf):
    df = gates.ensemble(predictions(event_bars(spark, sf)), ["symbol", "timeframe", "bar_idx"])
    return show(df, "bar_idx n_buy unanimous", "proba_buy proba_sell ensemble_conf margin", "symbol consensus")


DEC = (*STATE, *MA, *TREND5J, PRED,
       f"vm AS (SELECT symbol, bar_idx, CASE WHEN bar_idx>=49 THEN tick_volume/avg(tick_volume) {frame(-49, 0)} END AS volume_momentum FROM bars)",
       """dec AS (SELECT tf.*, s3.adx, md.atr, md.ma_fast, md.ma_slow, vm.volume_momentum, en.proba_buy, en.proba_sell, CASE WHEN trend_filter_above=1 THEN 'BUY' ELSE 'SELL' END AS direction,
  CASE WHEN trend_filter_above=1 THEN proba_buy*100 ELSE proba_sell*100 END AS confidence
  FROM tf JOIN s3 USING (symbol, bar_idx) JOIN md USING (symbol, bar_idx) JOIN vm USING (symbol, bar_idx) JOIN en USING (symbol, bar_idx) WHERE tf.bar_idx>=180)""",
       """gat AS (SELECT * FROM dec WHERE confidence>=40 AND NOT coalesce(adx<15, false) AND NOT coalesce(volume_momentum<0, false)
  AND NOT coalesce(direction='BUY' AND ma_fast<ma_slow, false) AND NOT coalesce(direction='SELL' AND ma_fast>ma_slow, false))""")


def _decisions(spark, sf):
    bars = event_bars(spark, sf)
    return sig.decision_frame(bars, event_bars(spark, sf, "D1"), "D1", 5, predictions(bars))


@query("decision_frame", "F7 F8 J16", q.h1(*DEC, select=f"SELECT {ID}, direction, {rnd('confidence')} AS confidence FROM dec"))
def _(spark, sf):
    return show(_decisions(spark, sf), "bar_idx", "confidence", "symbol direction")


@query("gated_signals", "P4 P5", q.h1(*DEC, select=f"SELECT {ID}, direction FROM gat"))
def _(spark, sf):
    return show(sig.gated(_decisions(spark, sf), 40.0, 15.0), "bar_idx", "", "symbol direction")


def _touch(entries: str, up: str, down: str, horizon: int | None) -> str:
    bound = f" AND b.bar_idx<=e.bar_idx+{horizon}" if horizon else ""
    return (f"lv AS (SELECT *, {up} AS up, {down} AS dn FROM {entries}), "
            f"ht AS (SELECT e.symbol, e.bar_idx, min(b.bar_idx) AS k FROM lv e JOIN bars b ON b.symbol=e.symbol AND b.bar_idx>e.bar_idx{bound} AND (b.high>=e.up OR b.low<=e.dn) GROUP BY ALL), "
            "oc AS (SELECT e.*, h.k, CASE WHEN h.k IS NULL THEN 'OPEN' WHEN (direction='BUY' AND b.low<=e.dn) OR (direction='SELL' AND b.high>=e.up) THEN 'LOSS' ELSE 'WIN' END AS outcome "
            "FROM lv e LEFT JOIN ht h ON h.symbol=e.symbol AND h.bar_idx=e.bar_idx LEFT JOIN bars b ON b.symbol=h.symbol AND b.bar_idx=h.k)")


POINTS = _touch("gat", "CASE WHEN direction='BUY' THEN close+12.0::DOUBLE ELSE close+8.0::DOUBLE END", "CASE WHEN direction='BUY' THEN close-8.0::DOUBLE ELSE close-12.0::DOUBLE END", 200)
LOCK = "lk AS (SELECT *, sum((outcome='LOSS')::INT) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nl FROM oc)"


@query("barrier_outcomes", "T1 J11", q.h1(*DEC, POINTS, select=f"SELECT {ID}, direction, outcome, coalesce(k, -1)::BIGINT AS exit_idx FROM oc"))
def _(spark, sf):
    df = outcomes.barrier_outcome(sig.gated(_decisions(spark, sf), 40.0, 15.0), event_bars(spark, sf), F.lit(8.0), F.lit(12.0))
    return show(df.fillna(-1, ["exit_idx"]), "bar_idx exit_idx", "", "symbol direction outcome")


@query("locked_signals", "R-V6 T4", q.h1(*DEC, POINTS, LOCK, select=f"SELECT {ID}, direction, outcome FROM lk WHERE nl=0"))
def _(spark, sf):
    return show(sig.generate_signals(_decisions(spark, sf), event_bars(spark, sf), 800, 1200, 0.01, 40.0, 15.0), "bar_idx", "", "symbol direction outcome")


@query("news_gate", "P7", q.h1(*DEC, "sn AS (SELECT event_type AS symbol, avg(CASE WHEN value > 10 THEN 1 ELSE -1 END) AS sentiment FROM events GROUP BY 1)",
                               select=f"SELECT {ID}, direction FROM gat JOIN sn USING (symbol) WHERE NOT (direction='BUY' AND sentiment<0) AND NOT (direction='SELL' AND sentiment>0)"))
def _(spark, sf):
    mood = table(spark, sf, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.avg(F.when(F.col("value") > 10, 1).otherwise(-1)).alias("sentiment"))
    df = sig.gated(_decisions(spark, sf), 40.0, 15.0).join(mood, "symbol")
    return show(df.filter(gates.news_gate(F.col("direction"), F.col("sentiment"))), "bar_idx", "", "symbol direction")


# ---------------------------------------------------------------- report

ROUND = "least(abs(close/0.01::DOUBLE - round_even(close/0.01::DOUBLE/50, 0)*50), abs(close/0.01::DOUBLE - round_even(close/0.01::DOUBLE/100, 0)*100))"
RISK = (*_htf("h4", "h4", 14400), "rq0 AS (SELECT dec.*, f.trend_h4 FROM dec ASOF LEFT JOIN fh4 f ON dec.symbol=f.symbol AND dec.ts>=f.at)",
        f"rq AS (SELECT *, {ROUND} AS rnd, CASE WHEN hour(ts)>=8 AND hour(ts)<16 THEN 'London' WHEN hour(ts)>=13 AND hour(ts)<21 THEN 'NY' WHEN hour(ts)<8 THEN 'Tokyo' ELSE 'Off' END AS session, abs(proba_buy-proba_sell)*100 AS margin, "
        "abs((close-trend_filter_ma)/atr) AS tdist, (close-ma_fast)/atr AS ext FROM (SELECT * EXCLUDE trend_h4, last_value(trend_h4 IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS trend_h4 FROM rq0))",
        """rk AS (SELECT *, coalesce(tdist<0.3, false)::BIGINT AS risk_trend_near, coalesce(rnd<10, false)::BIGINT AS risk_round_near, coalesce(abs(ext)>1.8, false)::BIGINT AS risk_extended,
  coalesce(margin<6, false)::BIGINT AS risk_low_margin, (session='Off')::BIGINT AS risk_off_session, coalesce(CASE WHEN direction='BUY' THEN trend_h4<0 ELSE trend_h4>0 END AND margin<12, false)::BIGINT AS risk_diverge_h4 FROM rq)""",
        "rz AS (SELECT *, risk_trend_near+risk_round_near+risk_extended+risk_low_margin+risk_diverge_h4 AS risk_score FROM rk)")
REASONS = """concat_ws(',', CASE WHEN risk_trend_near=1 THEN 'Proche_MA_Tendance' END, CASE WHEN risk_round_near=1 THEN 'Proche_Round' END, CASE WHEN risk_extended=1 THEN 'Sur_Extension' END,
 CASE WHEN risk_low_margin=1 THEN 'Marge_Faible' END, CASE WHEN risk_off_session=1 THEN 'Session_Off' END, CASE WHEN risk_diverge_h4=1 THEN 'Divergence_H4' END)"""


def _risky(spark, sf):
    df = asof.higher_timeframe_features(_decisions(spark, sf), {"H4": event_bars(spark, sf, "H4")})
    df = df.withColumns({"round_dist_pips": sc.round_level_distance(F.col("close"), F.lit(0.01)), "session": sc.session_label(F.hour("ts"))})
    return gates.risk_flags(df)


@query("risk_flags", "F4 F5 F6", _select(E1_, E4, *DEC, *RISK, select=f"SELECT {ID}, session, risk_score, {REASONS} AS risk_reasons, {rnd('tdist')} AS trend_distance_atr, {rnd('rnd', 2)} AS round_dist_pips FROM rz"))
def _(spark, sf):
    df = _risky(spark, sf)
    return df.select("symbol", "bar_idx", "session", "risk_reasons", F.col("risk_score").cast("bigint").alias("risk_score"), fixed("trend_distance_atr").alias("trend_distance_atr"), fixed("round_dist_pips", 2).alias("round_dist_pips"))


@query("all_green_signals", "P6", _select(E1_, E4, *DEC, *RISK, select=f"SELECT {ID}, direction FROM rz WHERE risk_score=0"))
def _(spark, sf):
    return show(gates.all_green(_risky(spark, sf)), "bar_idx", "", "symbol direction")


REP = (E1_, E4, *DEC, *[c.replace("FROM dec ASOF", "FROM gat ASOF").replace("SELECT dec.*", "SELECT gat.*").replace("ON dec.symbol=f.symbol AND dec.ts", "ON gat.symbol=f.symbol AND gat.ts") for c in RISK],
       _touch("rz", "CASE WHEN direction='BUY' THEN close+atr*2.0::DOUBLE ELSE close+atr*1.5::DOUBLE END", "CASE WHEN direction='BUY' THEN close-atr*1.5::DOUBLE ELSE close-atr*2.0::DOUBLE END", None),
       "ex AS (SELECT o.symbol, o.bar_idx, max(b.high) AS mh, min(b.low) AS ml FROM oc o JOIN bars b ON b.symbol=o.symbol AND b.bar_idx>o.bar_idx AND b.bar_idx<=o.k GROUP BY ALL)",
       f"fw AS (SELECT symbol, bar_idx, max(high) {frame(1, 24)} AS fh, min(low) {frame(1, 24)} AS fl FROM bars)",
       """tr0 AS (SELECT oc.*, ex.mh, ex.ml, CASE WHEN outcome='WIN' THEN 'Gain' ELSE 'Perte' END AS result, CASE WHEN outcome='WIN' THEN atr*2.0::DOUBLE ELSE -atr*1.5::DOUBLE END AS mv,
  outcome='WIN' OR coalesce(CASE WHEN direction='BUY' THEN fh>=close+atr*2.0::DOUBLE ELSE fl<=close-atr*2.0::DOUBLE END, false) AS reach
  FROM oc JOIN ex USING (symbol, bar_idx) JOIN fw USING (symbol, bar_idx) WHERE outcome<>'OPEN')""",
       "tr1 AS (SELECT *, coalesce(sum((result='Perte')::INT) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nl FROM tr0)",
       "rp AS (SELECT *, mv/0.01 AS result_pips, CASE WHEN result='Perte' THEN CASE WHEN reach THEN 'SL_Trop_Serré' ELSE 'Prediction_Incorrecte' END END AS loss_reason FROM tr1 WHERE nl=0)")


def _report(spark, sf):
    return sig.trade_report(_decisions(spark, sf).filter("true"), event_bars(spark, sf), {"H4": event_bars(spark, sf, "H4")}, F.lit(0.01), threshold=40.0, green_only=False)


# the SQL gates with adx_min 15 elsewhere; the report uses the default of 0
REP = tuple(c.replace("coalesce(adx<15, false)", "coalesce(adx<0, false)") for c in REP)


@query("trade_records", "T3 T5 T8 F12", _select(*REP, select=f"""SELECT {ID}, direction, result, coalesce(loss_reason,'') AS loss_reason, k::BIGINT AS exit_idx, {rnd('result_pips', 2)} AS result_pips, {rnd('mv/(atr*1.5::DOUBLE)', 3)} AS r_multiple,
  CASE WHEN reach THEN 'Oui' ELSE 'Non' END AS tp_reachable, {rnd('(mh-close)/atr', 2)} AS excursion_up_atr, {rnd('(close-ml)/atr', 2)} AS excursion_down_atr,
  {rnd("sc.x")} AS net_pips FROM (SELECT *, mv/0.01 - 3*0.001::DOUBLE/0.01::DOUBLE - 0.5::DOUBLE AS x FROM rp) sc"""))
def _(spark, sf):
    df = _report(spark, sf).fillna("", ["loss_reason"])
    spread = sc.spread_pips(F.lit(3), F.lit(0.001), F.lit(0.01))
    net = sc.round_turn_cost(F.col("result_pips"), spread, F.lit(0.5))
    return df.select("symbol", "bar_idx", "direction", "result", "loss_reason", "tp_reachable", F.col("exit_idx").cast("bigint").alias("exit_idx"), fixed("result_pips", 2).alias("result_pips"),
                     fixed("r_multiple", 3).alias("r_multiple"), fixed("excursion_up_atr", 2).alias("excursion_up_atr"), fixed("excursion_down_atr", 2).alias("excursion_down_atr"), fixed(net).alias("net_pips"))


@query("report_totals", "G8", _select(*REP, select=f"SELECT symbol, {rnd('sum(result_pips)', 2)} AS sum_pips, sum((result='Gain')::INT)::BIGINT AS gains, sum((result='Perte')::INT)::BIGINT AS losses, sum(coalesce(loss_reason='Prediction_Incorrecte', false)::INT)::BIGINT AS wrong_predictions, sum(coalesce(loss_reason='SL_Trop_Serré', false)::INT)::BIGINT AS stops_too_tight FROM rp GROUP BY symbol"))
def _(spark, sf):
    return show(audits.report_totals(_report(spark, sf)), "gains losses wrong_predictions stops_too_tight", "sum_pips", "symbol", dp=2)


def _audit_sql():
    measures = {"trend_distance": "tdist", "round_distance": "rnd", "ma_extension": "abs(ext)", "margin": "margin"}
    parts, bins = [], []
    for a, expr in measures.items():
        edges = audits.AUDIT_EDGES[a]
        case = "CASE " + " ".join(f"WHEN {expr}<={e} THEN '{n}'" for n, e in enumerate(edges)) + f" ELSE '{len(edges)}' END"
        parts.append(f"SELECT '{a}' AS audit, CASE WHEN {expr} IS NOT NULL THEN {case} END AS bin, result, loss_reason FROM rp")
        bins += [f"('{a}', '{n}')" for n in range(len(edges) + 1)]
    parts.append("SELECT 'session', session, result, loss_reason FROM rp")
    parts.append("SELECT 'diverge_h4', coalesce(CASE WHEN direction='BUY' THEN trend_h4<0 ELSE trend_h4>0 END, false)::INT::VARCHAR, result, loss_reason FROM rp")
    return _select(*REP, "un AS (" + " UNION ALL ".join(parts) + ")", "bn(audit, bin) AS (VALUES " + ", ".join(bins) + ")",
                   "ag AS (SELECT audit, bin, count(*) AS n, sum((result='Gain')::INT) AS g, sum(coalesce(loss_reason='Prediction_Incorrecte', false)::INT) AS w FROM un WHERE bin IS NOT NULL GROUP BY ALL)",
                   select=f"SELECT audit, bin, coalesce(n,0)::BIGINT AS n_total, coalesce(g,0)::BIGINT AS n_gain, coalesce(w,0)::BIGINT AS n_wrong, {rnd('CASE WHEN n>0 THEN w/n*100 END')} AS err_rate FROM ag FULL JOIN bn USING (audit, bin)")


@query("risk_audit", "G9 G10", _audit_sql())
def _(spark, sf):
    df = audits.risk_audit(_report(spark, sf), {"trend_distance": "trend_distance_atr", "round_distance": "round_dist_pips", "ma_extension": "ma_extension", "margin": "margin"})
    return show(df, "n_total n_gain n_wrong", "err_rate", "audit bin")


# ---------------------------------------------------------------- stop/target grid

HORIZONS = {"H1": 1, "H4": 4, "D1": 24}


def _grid_entries(spark, sf):
    """Classifier signals per horizon from pseudo-random model output."""
    from barlab.catalog.data import hash_int

    bars = grid.atr_by_timeframe(event_bars(spark, sf), _tfs(spark, sf))
    h = bars.select("*", F.explode(F.array(*[F.lit(x) for x in HORIZONS])).alias("horizon"))
    h = h.withColumn("p_buy", hash_int(F.col("symbol"), F.unix_timestamp("ts").cast("string"), F.col("horizon")) % 10001 / 10000.0)
    return h.withColumn("signal", sc.classifier_signal(F.col("p_buy"), 1 - F.col("p_buy"))).filter("signal <> 0")


GRID = (*ATRS, "en AS (SELECT x3.*, hz, ('0x'||substr(md5(symbol||'-'||epoch(ts)::BIGINT||'-'||hz),1,8))::BIGINT % 10001 / 10000.0::DOUBLE AS pb FROM x3, (VALUES ('H1'),('H4'),('D1')) h(hz))",
        "es AS (SELECT *, CASE WHEN pb>0.55 THEN 1 WHEN 1-pb>0.55 THEN -1 ELSE 0 END AS sg FROM en)",
        "pt AS (SELECT DISTINCT symbol, bar_idx, close, sg, atr_h1, atr_h4, atr_d1 FROM es WHERE sg<>0)",
        "lt AS (SELECT symbol, bar_idx, close, sg, tf, CASE tf WHEN 'h1' THEN atr_h1 WHEN 'h4' THEN atr_h4 ELSE atr_d1 END AS a FROM pt, (VALUES ('h1'),('h4'),('d1')) t(tf))",
        "ls AS (SELECT *, 'sl' AS kind, a*m AS dist FROM lt, (VALUES (0.5::DOUBLE),(1.0),(1.5),(2.0)) g(m) UNION ALL SELECT *, 'tp', a*m FROM lt, (VALUES (1.0::DOUBLE),(2.0),(3.0),(4.0)) g(m))",
        """hs AS MATERIALIZED (SELECT l.symbol, l.bar_idx, l.sg, l.tf, l.kind, l.m, l.dist, min(b.bar_idx) AS k FROM (SELECT * FROM ls WHERE dist IS NOT NULL) l LEFT JOIN bars b ON b.symbol=l.symbol AND b.bar_idx>l.bar_idx
  AND CASE WHEN (l.sg=1)=(l.kind='tp') THEN b.high>=l.close+l.dist ELSE b.low<=l.close-l.dist END GROUP BY ALL)""",
        """cl AS (SELECT es.symbol, hz AS horizon, s.tf AS sl_tf, t.tf AS tp_tf, s.m AS sl_mult, t.m AS tp_mult,
  sum(CASE WHEN s.k IS NULL AND t.k IS NULL THEN 0 WHEN t.k IS NULL OR s.k<=t.k THEN -s.dist ELSE t.dist END) AS profit, count(*) AS n
  FROM es JOIN hs s ON s.symbol=es.symbol AND s.bar_idx=es.bar_idx AND s.sg=es.sg AND s.kind='sl' JOIN hs t ON t.symbol=es.symbol AND t.bar_idx=es.bar_idx AND t.sg=es.sg AND t.kind='tp' GROUP BY ALL)""")


@query("classifier_signals", "R-V5", _select(*GRID, select=f"SELECT {ID}, hz AS horizon, sg::BIGINT AS signal FROM es WHERE sg<>0"))
def _(spark, sf):
    return show(_grid_entries(spark, sf), "bar_idx signal", "", "symbol horizon")


def _cells(spark, sf):
    return grid.barrier_grid(_grid_entries(spark, sf), event_bars(spark, sf), ["H1", "H4", "D1"])


@query("barrier_grid", "J12 T2 G5 X9", _select(*GRID, select=f"SELECT symbol, horizon, sl_tf, tp_tf, {cols('sl_mult tp_mult')}, {rnd('profit', 3)} AS profit, n::BIGINT AS entries FROM cl"))
def _(spark, sf):
    df = _cells(spark, sf)
    return df.select("symbol", "horizon", "sl_tf", "tp_tf", fixed("sl_mult").alias("sl_mult"), fixed("tp_mult").alias("tp_mult"), fixed("profit", 3).alias("profit"), F.col("entries").cast("bigint").alias("entries"))


BEST = "row_number() OVER (PARTITION BY {by} ORDER BY round(profit, 6) DESC, list_position(['H1','H4','D1'], horizon), list_position(['h1','h4','d1'], sl_tf), list_position(['h1','h4','d1'], tp_tf), sl_mult, tp_mult)"


@query("best_barriers", "G6 X9", _select(*GRID, select=f"SELECT symbol, horizon, 'horizon' AS scope, sl_tf, tp_tf, {cols('sl_mult tp_mult')}, {rnd('profit', 3)} AS profit FROM cl QUALIFY {BEST.format(by='symbol, horizon')}=1 UNION ALL SELECT symbol, horizon, 'overall', sl_tf, tp_tf, {cols('sl_mult tp_mult')}, {rnd('profit', 3)} FROM cl QUALIFY {BEST.format(by='symbol')}=1"))
def _(spark, sf):
    cells = _cells(spark, sf)
    tfs = ["H1", "H4", "D1"]
    per = grid.best_cells(cells, ["symbol", "horizon"], tfs, tfs)
    both = per.withColumn("scope", F.lit("horizon")).unionByName(grid.best_cells(per.withColumns({"sl_n": F.col("sl_mult"), "tp_n": F.col("tp_mult")}), ["symbol"], tfs, tfs).withColumn("scope", F.lit("overall")))
    return both.select("symbol", "horizon", "scope", "sl_tf", "tp_tf", fixed("sl_mult").alias("sl_mult"), fixed("tp_mult").alias("tp_mult"), fixed("profit", 3).alias("profit"))


# ---------------------------------------------------------------- files


def _moves(spark, sf):
    """Bars that close higher than they open as buys, lower as sells, with a confidence."""
    b = event_bars(spark, sf).where("close <> open")
    return b.select("symbol", "timeframe", "ts", F.when(F.col("close") > F.col("open"), "BUY").otherwise("SELL").alias("direction"), (F.col("bar_idx") % 100).cast("double").alias("confidence"))


MOVES = f"mv AS (SELECT symbol, ts, CASE WHEN close>open THEN 'BUY' ELSE 'SELL' END AS dir, 'conf=' || (bar_idx % 100) || '.0%' AS comment FROM bars WHERE close<>open)"


def _read_back(spark, rows):
    path = f"{ensure_checkpoint_dir(spark)}/signals-{uuid4().hex}"
    sinks.write_signals(rows, path)
    return spark.read.option("sep", ";").option("header", True).csv(path)


@query("signal_files", "S9", _select(q.event_bars(), MOVES, select="SELECT symbol, 'split' AS layout, strftime(ts, '%Y.%m.%d') || ' ' || strftime(ts, '%H:%M') AS stamp, dir, 80::BIGINT AS sl, 120::BIGINT AS tp, comment FROM mv"
                                                                   " UNION ALL SELECT symbol, 'single', strftime(ts, '%Y-%m-%d %H:%M:%S'), dir, 80, 120, comment FROM mv"))
def _(spark, sf):
    """Signals written as CSV in both layouts and read back."""
    moves = _moves(spark, sf)
    two = _read_back(spark, sinks.signal_rows(moves, 80, 120)).withColumns({"layout": F.lit("split"), "stamp": F.concat_ws(" ", "date", "time")})
    one = _read_back(spark, sinks.signal_rows(moves, 80, 120, split_time=False)).withColumns({"layout": F.lit("single"), "stamp": F.col("time")})
    names = ["symbol", "layout", "stamp", "dir", "sl", "tp", "comment"]
    return show(two.select(*names).unionByName(one.select(*names)), "sl tp", "", "symbol layout stamp dir comment")


@query("json_line_files", "S11", _select(q.event_bars(), MOVES, select="SELECT symbol, dir, count(*)::BIGINT AS lines, count(DISTINCT comment)::BIGINT AS comments FROM (SELECT * FROM mv UNION ALL SELECT * FROM mv WHERE dir='BUY') GROUP BY ALL"))
def _(spark, sf):
    """JSON lines appended twice and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/lines-{uuid4().hex}"
    rows = sinks.signal_rows(_moves(spark, sf), 80, 120)
    sinks.append_json_lines(rows, path)
    sinks.append_json_lines(rows.where("dir = 'BUY'"), path)
    back = spark.read.schema(rows.schema).json(path)
    return back.groupBy("symbol", "dir").agg(F.count("*").cast("bigint").alias("lines"), F.countDistinct("comment").cast("bigint").alias("comments"))


# ---------------------------------------------------------------- flagship

@query("signal_report", "S18 J2 P4 T1 T4 G8", _select(
    q.order_bars(), *[c for c in STATE], *MA, PRED,
    f"f1 AS (SELECT *, CASE WHEN bar_idx>=199 THEN avg(close) {frame(-199, 0)} END AS m0 FROM bars)", f"f2 AS (SELECT symbol, bar_idx, lag(m0) OVER ({S}) AS tma FROM f1)",
    f"vm AS (SELECT symbol, bar_idx, CASE WHEN bar_idx>=49 THEN tick_volume/avg(tick_volume) {frame(-49, 0)} END AS volume_momentum FROM bars)",
    """gat AS (SELECT md.*, s3.adx, CASE WHEN coalesce(md.close>tma, false) THEN 'BUY' ELSE 'SELL' END AS direction, CASE WHEN coalesce(md.close>tma, false) THEN proba_buy ELSE proba_sell END*100 AS confidence
  FROM md JOIN f2 USING (symbol, bar_idx) JOIN s3 USING (symbol, bar_idx) JOIN en USING (symbol, bar_idx) WHERE md.bar_idx>=180)""",
    "ga2 AS (SELECT * FROM gat WHERE confidence>=20 AND NOT coalesce(direction='BUY' AND ma_fast<ma_slow, false) AND NOT coalesce(direction='SELL' AND ma_fast>ma_slow, false))",
    _touch("ga2", "CASE WHEN direction='BUY' THEN close+120000.0::DOUBLE ELSE close+80000.0::DOUBLE END", "CASE WHEN direction='BUY' THEN close-80000.0::DOUBLE ELSE close-120000.0::DOUBLE END", 200), LOCK,
    select="SELECT symbol, direction, count(*)::BIGINT AS signals, sum((outcome='WIN')::INT)::BIGINT AS wins, sum((outcome='OPEN')::INT)::BIGINT AS still_open, (sum((outcome='WIN')::INT)*1200000)::BIGINT AS points FROM lk WHERE nl=0 GROUP BY ALL"))
def _(spark, sf):
    bars = order_bars(spark, sf)
    out = sig.generate_signals(sig.decision_frame(bars, bars, "D1", 200, predictions(bars)), bars, 800_000, 1_200_000, 0.1)
    return out.groupBy("symbol", "direction").agg(F.count(F.lit(1)).alias("signals"), F.count_if(F.col("outcome") == "WIN").alias("wins"),
                                                  F.count_if(F.col("outcome") == "OPEN").alias("still_open"), (F.count_if(F.col("outcome") == "WIN") * 1_200_000).alias("points"))
