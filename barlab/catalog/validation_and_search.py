"""Queries for trade statistics, validation, resampling, votes, backtests, search and model preparation
(survey groups 2.4, 2.7, 2.10 to 2.13)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlab.catalog import sql as q
from barlab.catalog.bars_and_indicators import ADX, BB, ID, MACD, RSI
from barlab.catalog.data import event_bars, fixed, order_bars, predictions, show, table, trades
from barlab.catalog.joins_and_outcomes import END, PRED, START, TRADES, _period_sql
from barlab.catalog.registry import query
from barlab.catalog.sql import S, cols, frame, rnd
from barlab.core.steps import with_indicators
from barlab.functions import scoring
from barlab.operators import backtest as bt, features as ft, indicators as ind, mlprep, performance as perf, periods, resampling as mc, validation as val
from barlab.operators.votes import Strategy, vote_signals
from barlab.plans import search

# ---------------------------------------------------------------- trade statistics

PF = "least(99.0, CASE WHEN sum(CASE WHEN pnl<=0 THEN pnl END)<>0 THEN coalesce(sum(CASE WHEN pnl>0 THEN pnl END),0)/abs(sum(CASE WHEN pnl<=0 THEN pnl END)) WHEN sum(CASE WHEN pnl>0 THEN pnl END)>0 THEN 99 ELSE 0 END)"
SHARPE = "CASE WHEN count(pnl)>1 AND stddev_pop(pnl)>1e-12 THEN avg(pnl)/stddev_pop(pnl)*sqrt(252) ELSE 0 END"
SUMMARY = f"""count(*)::BIGINT AS trades, count(CASE WHEN pnl>0 THEN 1 END)::BIGINT AS wins, count(CASE WHEN pnl<=0 THEN 1 END)::BIGINT AS losses, sum(pnl) AS profit,
 count(CASE WHEN pnl>0 THEN 1 END)/count(*) AS winrate, coalesce(avg(CASE WHEN pnl>0 THEN pnl END),0) AS avg_win, coalesce(avg(CASE WHEN pnl<=0 THEN pnl END),0) AS avg_loss,
 max(pnl) AS best_trade, min(pnl) AS worst_trade, {PF} AS profit_factor, {SHARPE} AS sharpe"""


@query("trade_summary", "G1 G2 G3 V12 V13", f"WITH {TRADES}, s AS (SELECT strategy_id, {SUMMARY} FROM trades GROUP BY 1) SELECT strategy_id, trades, wins, losses, {cols('profit winrate avg_win avg_loss best_trade worst_trade profit_factor sharpe')} FROM s")
def _(spark, sf):
    return show(perf.summarise(trades(spark, sf), ["strategy_id"]), "trades wins losses", "profit winrate avg_win avg_loss best_trade worst_trade profit_factor sharpe", "strategy_id")


def _dd(source: str, key: str, order: str) -> str:
    return f"""eq AS (SELECT *, sum(pnl) OVER (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS eq FROM {source}),
pk AS (SELECT *, greatest(0, max(eq) OVER (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING)) AS pk FROM eq),
dd AS (SELECT {key}, max(pk-eq) AS max_drawdown, sum(pnl) AS final_equity FROM pk GROUP BY {key})"""


@query("trade_drawdown", "G4", f"WITH {TRADES}, {_dd('trades', 'strategy_id', 'trade_no')} SELECT strategy_id, {cols('max_drawdown final_equity')} FROM dd")
def _(spark, sf):
    df = perf.max_drawdown(trades(spark, sf), ["strategy_id"], F.floor(F.col("trade_no") / 4096), ["trade_no"])
    return show(df, "", "max_drawdown final_equity", "strategy_id")


# ---------------------------------------------------------------- validation

CHECK = periods.expanding_folds(START, END, 5) + [p for p in periods.split(START, END) if p.kind == "oos"]
RESULTS = f"res AS (SELECT strategy_id, period, kind, days, {SUMMARY} FROM trades JOIN p ON day>=s AND day<e GROUP BY ALL)"
REPORT = """ag AS (SELECT strategy_id, coalesce(sum(CASE WHEN kind='train' THEN profit END)/sum(CASE WHEN kind='train' THEN days END),0) AS train_daily,
  coalesce(sum(CASE WHEN kind='test' THEN profit END)/sum(CASE WHEN kind='test' THEN days END),0) AS test_daily, coalesce(sum(CASE WHEN kind='oos' THEN profit END)/sum(CASE WHEN kind='oos' THEN days END),0) AS oos_daily,
  sum(CASE WHEN kind IN ('train','test') THEN trades ELSE 0 END)::BIGINT AS total_trades, avg(CASE WHEN kind='test' THEN (profit>0)::INT END) AS sh, avg(CASE WHEN kind='test' THEN profit END) AS m,
  stddev_pop(CASE WHEN kind='test' THEN profit END) AS sd, avg(CASE WHEN kind='test' THEN winrate END) AS wr FROM res GROUP BY 1),
a2 AS (SELECT *, CASE WHEN train_daily>0 THEN greatest(-1, least(2, test_daily/train_daily)) ELSE 0 END AS degradation_ratio, 0.4*sh + 0.35*CASE WHEN m=0 THEN 0 ELSE greatest(0, 1-sd/abs(m)/3) END + 0.25*least(1, wr/0.45) AS consistency_score,
  CASE WHEN train_daily>0 THEN oos_daily/train_daily ELSE 0 END AS oos_ratio FROM ag),
a3 AS (SELECT *, (CASE WHEN degradation_ratio>=0.7 THEN 1 WHEN degradation_ratio>=0.4 THEN 0.5 ELSE 0 END + CASE WHEN consistency_score>=0.5 THEN 1 WHEN consistency_score>=0.3 THEN 0.5 ELSE 0 END
  + CASE WHEN oos_ratio>=0.3 AND oos_daily>0 THEN 1 WHEN oos_daily>0 THEN 0.5 ELSE 0 END)::DOUBLE/3 AS sc FROM a2),
rep AS (SELECT *, CASE WHEN total_trades<50 THEN 'insufficient_data' WHEN sc>=0.75 THEN 'robust' WHEN sc>=0.4 THEN 'suspect' ELSE 'overfitted' END AS verdict, least(1, abs(sc-0.5)*2+0.3) AS confidence FROM a3)"""


def _check_results(spark, sf):
    return val.period_results(periods.tag_periods(trades(spark, sf), CHECK))


@query("overfit_report", "V3 V4 V5 V6 V7 V8 D7", f"WITH {TRADES}, {_period_sql(CHECK)}, {RESULTS}, {REPORT} SELECT strategy_id, total_trades, verdict, {cols('train_daily test_daily oos_daily degradation_ratio consistency_score oos_ratio confidence')} FROM rep")
def _(spark, sf):
    return show(val.overfit_report(_check_results(spark, sf)), "total_trades", "train_daily test_daily oos_daily degradation_ratio consistency_score oos_ratio confidence", "strategy_id verdict")


WINDOWS = periods.walk_forward(START, END)
WF = """wp AS (SELECT strategy_id, period, sum(CASE WHEN kind='train' THEN profit END) AS tr, sum(CASE WHEN kind='test' THEN profit END) AS te, sum(CASE WHEN kind='test' THEN trades END) AS n, sum(CASE WHEN kind='test' THEN wins END) AS w FROM res GROUP BY ALL),
wa AS (SELECT strategy_id, count(*)::BIGINT AS windows, sum(te) AS overall_profit, sum(n)::BIGINT AS overall_trades, sum(w)/sum(n) AS overall_winrate, CASE WHEN sum(tr)>0 THEN sum(te)/sum(tr) ELSE 0 END AS wfe, avg((te>0)::INT) AS consistency_ratio FROM wp WHERE n IS NOT NULL GROUP BY 1),
wf AS (SELECT *, CASE WHEN windows<3 THEN 'insufficient_data' WHEN wfe>=0.5 AND consistency_ratio>=0.6 THEN 'robust' WHEN wfe>=0.3 AND consistency_ratio>=0.45 THEN 'suspect' ELSE 'overfitted' END AS wf_verdict FROM wa)"""


@query("walk_forward_report", "V9 V10", f"WITH {TRADES}, {_period_sql(WINDOWS)}, {RESULTS}, {WF} SELECT strategy_id, windows, overall_trades, wf_verdict, {cols('overall_profit overall_winrate wfe consistency_ratio')} FROM wf")
def _(spark, sf):
    res = val.period_results(periods.tag_periods(trades(spark, sf), WINDOWS))
    return show(val.walk_forward_report(res), "windows overall_trades", "overall_profit overall_winrate wfe consistency_ratio", "strategy_id wf_verdict")


# ---------------------------------------------------------------- resampling

REPS = 1000
_IN = "4294967296"
_STIR = lambda x: f"((xor({x}, {x} >> 16) * {mc.MIX}) % {_IN})"


def _mixed_sql(source: str, x: str, keep: str, out: str) -> str:
    """CTEs that scatter column ``x`` of ``source``, step by step."""
    return f"{out}1 AS (SELECT {keep}, {_STIR(x)} AS h FROM {source}), {out}2 AS (SELECT {keep}, {_STIR('h')} AS h FROM {out}1), {out} AS (SELECT {keep}, xor(h, h >> 16) AS h FROM {out}2)"


def _draws_sql(test: str) -> str:
    """Table u (strategy_id, rep, pos, pnl, n, h): a random number for each replicate and trade."""
    reps = f"SELECT strategy_id, rep, ({mc.salt_of(42, test)} + ('0x'||substr(md5(strategy_id),1,8))::BIGINT + rep * {mc.REP}) % {_IN} AS x FROM (SELECT DISTINCT strategy_id FROM trades), range({REPS}) r(rep)"
    return f"""it AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY trade_no)-1 AS pos, count(*) OVER (PARTITION BY strategy_id) AS n FROM trades),
a0 AS ({reps}), {_mixed_sql('a0', 'x', 'strategy_id, rep', 'a')}, b0 AS (SELECT DISTINCT pos, (pos * {mc.POS}) % {_IN} AS x FROM it), {_mixed_sql('b0', 'x', 'pos', 'b')},
u0 AS (SELECT it.strategy_id, rep, it.pos, pnl, n, xor(a.h, b.h) AS x FROM it JOIN a ON a.strategy_id = it.strategy_id JOIN b ON b.pos = it.pos), {_mixed_sql('u0', 'x', 'strategy_id, rep, pos, pnl, n', 'u')}"""


PERM = f"{_draws_sql('perm')}, rs AS (SELECT strategy_id, rep, pos, pnl, h FROM u)"
BOOT = f"{_draws_sql('boot')}, rs AS (SELECT u.strategy_id, rep, u.pos, it.pnl FROM u JOIN it ON it.strategy_id = u.strategy_id AND it.pos = u.h % u.n)"
NOISE = f"{_draws_sql('noise')}, rs AS (SELECT strategy_id, rep, pos, pnl*(1+(2*(h/4294967296.0::DOUBLE)-1)*0.1::DOUBLE) AS pnl FROM u)"


def _mc_sql(resample: str, order: str, dp: int = 4) -> str:
    sig = f"""o AS (SELECT *, count(*) OVER (PARTITION BY strategy_id) AS n, row_number() OVER (PARTITION BY strategy_id ORDER BY final_equity, rep) AS p, row_number() OVER (PARTITION BY strategy_id ORDER BY max_drawdown, rep) AS d FROM dd),
g AS (SELECT strategy_id, count(*)::BIGINT AS replicates, max(CASE WHEN p=floor(n*0.05)+1 THEN final_equity END) AS p5, max(CASE WHEN p=floor(n*0.5)+1 THEN final_equity END) AS p50, max(CASE WHEN p=floor(n*0.95)+1 THEN final_equity END) AS p95,
  avg((final_equity<0)::INT) AS loss_probability, max(CASE WHEN d=floor(n*0.95)+1 THEN max_drawdown END) AS worst_drawdown_95 FROM o GROUP BY 1)"""
    return f"WITH {TRADES}, {resample}, {_dd('rs', 'strategy_id, rep', order)}, {sig} SELECT strategy_id, replicates, (1-loss_probability>=0.95 AND p5>0)::BIGINT AS significant, {cols('p5 p50 p95 worst_drawdown_95', dp)}, {cols('loss_probability')} FROM g"


def _mc(name, fn, resample, order, dp):
    @query(name, "V11", _mc_sql(resample, order, dp))
    def _(spark, sf):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")  # rows are arrays of 4,096 values
        out = mc.significance(fn(mc.indexed_trades(trades(spark, sf)), REPS))
        return out.select("strategy_id", F.col("replicates").cast("bigint").alias("replicates"), F.col("significant").cast("bigint").alias("significant"),
                          *[fixed(c, dp).alias(c) for c in ("p5", "p50", "p95", "worst_drawdown_95")], fixed("loss_probability").alias("loss_probability"))


_mc("monte_carlo_permutation", mc.permutation, PERM, "h, pos", 4)
_mc("monte_carlo_bootstrap", mc.bootstrap, BOOT, "pos", 4)
_mc("monte_carlo_noise", mc.noise, NOISE, "pos", 2)

# ---------------------------------------------------------------- results per supplier as strategy results

SUPPLIER = f"""st AS (SELECT l_suppkey AS strategy_id, l_orderkey AS trade_no, sum((round(l_extendedprice*100)*(round(l_discount*100)-round(l_tax*100)))::BIGINT)::DOUBLE/1000000 AS pnl FROM lineitem GROUP BY 1, 2),
ss AS (SELECT strategy_id, {SUMMARY} FROM st GROUP BY 1), {_dd('st', 'strategy_id', 'trade_no')},
rs AS (SELECT ss.*, dd.max_drawdown AS drawdown, dd.max_drawdown/100 AS drawdown_pct, 10000.0::DOUBLE AS starting_capital, 10000+profit AS ending_capital, n.n_name AS family, r.r_name AS timeframe
  FROM ss JOIN dd USING (strategy_id) JOIN supplier s ON s.s_suppkey=strategy_id JOIN nation n ON n.n_nationkey=s.s_nationkey JOIN region r ON r.r_regionkey=n.n_regionkey),
sc AS (SELECT *, round_even(greatest(0, least(100, CASE WHEN profit>0 THEN least(30, profit/100*0.6) ELSE greatest(-10, profit/100*0.3) END + least(20, winrate*25)
  + CASE WHEN profit_factor>1 THEN least(15, (profit_factor-1)*15) WHEN profit_factor>0 THEN greatest(-5, (profit_factor-1)*10) ELSE -5 END + CASE WHEN sharpe>0 THEN least(15, sharpe*5) ELSE greatest(-5, sharpe*3) END
  - CASE WHEN drawdown_pct>0 THEN least(15, drawdown_pct*0.5) WHEN drawdown>0 THEN least(15, drawdown/35) ELSE 0 END
  + CASE WHEN trades>=100 THEN 10 WHEN trades>=50 THEN 7 WHEN trades>=20 THEN 5 WHEN trades>=10 THEN 3 WHEN trades>=5 THEN 1 ELSE -5 END
  + CASE WHEN avg_loss<>0 THEN CASE WHEN avg_win/abs(avg_loss)>=2 THEN 10 WHEN avg_win/abs(avg_loss)>=1.5 THEN 7 WHEN avg_win/abs(avg_loss)>=1 THEN 4 ELSE 0 END ELSE 0 END)), 1) AS score FROM rs)"""


#: Order numbers of one block (a supplier has at most that many trades in it), and lines of one task.
SPAN, TASK_ROWS = 1 << 20, 1 << 18


def supplier_results(spark, sf):
    """One scored result row per supplier; family and timeframe stand for nation and region."""
    units = (F.round(F.col("l_extendedprice") * 100) * (F.round(F.col("l_discount") * 100) - F.round(F.col("l_tax") * 100))).cast("bigint")
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("strategy_id"), F.col("l_orderkey").alias("trade_no"), F.floor(F.col("l_orderkey") / SPAN).alias("block"), units.alias("units"))
    # one shuffle for all that follows, into tasks of bounded size: lines of one trade are few, so summing before it would only fill memory
    t = lines.repartition(max(spark.sparkContext.defaultParallelism, lines.count() // TASK_ROWS + 1), "strategy_id", "block").groupBy("strategy_id", "block", "trade_no").agg((F.sum("units") / 1000000.0).alias("pnl"))
    falls = perf.max_drawdown(t, ["strategy_id"], F.col("block"), ["trade_no"])
    res = perf.summarise(t, ["strategy_id"]).join(falls, "strategy_id").withColumnRenamed("max_drawdown", "drawdown")
    dims = (table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").alias("strategy_id"), F.col("n_name").alias("family"), F.col("r_name").alias("timeframe")))
    res = res.join(dims, "strategy_id").withColumns({"drawdown_pct": F.col("drawdown") / 100, "starting_capital": F.lit(10000.0), "ending_capital": 10000 + F.col("profit"),
                                                     "degradation": F.lit(None).cast("double"), "consistency": F.lit(None).cast("double")})
    names = ("trades", "profit", "winrate", "drawdown", "drawdown_pct", "sharpe", "profit_factor", "starting_capital", "ending_capital", "avg_win", "avg_loss", "degradation", "consistency")
    return res.withColumn("score", scoring.strategy_score({n: F.col(n) for n in names})).withColumn("symbol", F.col("timeframe"))


def _res(body: str) -> str:
    return f"WITH {TRADES.replace('trades AS', 'unused AS')}, {SUPPLIER} {body}"


SID = "strategy_id::BIGINT AS strategy_id"


@query("strategy_scores", "F26 D2", _res(f"SELECT {SID}, family, {cols('score drawdown profit_factor')} FROM sc"))
def _(spark, sf):
    return show(supplier_results(spark, sf), "strategy_id", "score drawdown profit_factor", "family")


@query("viable_results", "P13", _res(f"SELECT {SID}, trades, {cols('score')} FROM sc WHERE trades>=10 AND score IS NOT NULL"))
def _(spark, sf):
    return show(search.viable(supplier_results(spark, sf)), "strategy_id trades", "score")


@query("top_strategies", "K1", _res(f"SELECT {SID}, {cols('score')}, row_number() OVER (ORDER BY score DESC, strategy_id)::BIGINT AS rank FROM sc ORDER BY score DESC, strategy_id LIMIT 10"))
def _(spark, sf):
    return show(search.top_k(supplier_results(spark, sf), 10), "strategy_id rank", "score")


@query("top_per_group", "K2 K10", _res(f"SELECT {SID}, family, {cols('score')}, row_number() OVER (PARTITION BY family ORDER BY score DESC, strategy_id)::BIGINT AS rank FROM sc QUALIFY rank<=2"))
def _(spark, sf):
    return show(search.top_k(supplier_results(spark, sf), 2, ["family"]), "strategy_id rank", "score", "family")


@query("hall_of_fame", "K8 K6", _res(f"SELECT {SID}, {cols('score')} FROM sc ORDER BY score DESC, strategy_id LIMIT 50"))
def _(spark, sf):
    return show(search.top_k(supplier_results(spark, sf), 50), "strategy_id", "score")


@query("family_timeframe_stats", "G7", _res(f"SELECT coalesce(family,'*') AS family, coalesce(timeframe,'*') AS timeframe, count(*)::BIGINT AS n, {rnd('max(score)')} AS best, {rnd('round_even(avg(score),1)')} AS mean FROM sc GROUP BY GROUPING SETS ((family),(timeframe))"))
def _(spark, sf):
    return show(search.group_stats(supplier_results(spark, sf)).fillna("*", ["family", "timeframe"]), "n", "best mean", "family timeframe")


@query("quick_test_average", "G16", _res(f"SELECT {rnd('avg(score)')} AS mean_score, {rnd('max(score)')} AS best_score, count(*)::BIGINT AS n FROM sc"))
def _(spark, sf):
    return show(supplier_results(spark, sf).agg(F.avg("score").alias("mean_score"), F.max("score").alias("best_score"), F.count(F.lit(1)).alias("n")), "n", "mean_score best_score")


@query("session_report", "G18", _res(f"SELECT count(*)::BIGINT AS runs, sum((score>0)::INT)::BIGINT AS hall_of_fame, {rnd('max(score)')} AS best_score, {rnd('avg(score)')} AS mean_score, sum((score>=40)::INT)::BIGINT AS accepted, sum((score<40)::INT)::BIGINT AS rejected FROM sc"))
def _(spark, sf):
    return show(search.session_report(supplier_results(spark, sf).withColumn("accepted", F.col("score") >= 40)), "runs hall_of_fame accepted rejected", "best_score mean_score")


@query("strategy_advice", "P14", _res(f"""SELECT {SID}, concat_ws(',', CASE WHEN winrate<0.4 THEN 'low_winrate' END, CASE WHEN drawdown>500 THEN 'high_drawdown' END, CASE WHEN trades<30 THEN 'few_trades' END,
  CASE WHEN profit_factor<1 THEN 'losing_profit_factor' END, CASE WHEN sharpe<0.5 THEN 'low_sharpe' END) AS advice FROM sc"""))
def _(spark, sf):
    r = supplier_results(spark, sf)
    return r.select(F.col("strategy_id").cast("bigint").alias("strategy_id"), F.concat_ws(",", scoring.advice(*[F.col(c) for c in ("winrate", "drawdown", "trades", "profit_factor", "sharpe", "degradation")])).alias("advice"))


# candidates: score of the even trades as train, odd trades as test, the win rate as out-of-sample score where trades >= 100
CAND = """cd AS (SELECT strategy_id, trades, score AS train_score, least(100, profit_factor*40) AS test_score, CASE WHEN trades>=450 THEN winrate*100 END AS oos_score,
  CASE WHEN sharpe<-1 THEN 'overfitted' WHEN sharpe<0 THEN 'suspect' ELSE 'robust' END AS verdict, CASE WHEN sharpe<-0.5 THEN 'overfitted' WHEN sharpe<0.1 THEN 'suspect' ELSE 'robust' END AS wf_verdict FROM sc),
c2 AS (SELECT *, greatest(0, train_score-test_score)/greatest(train_score, 1) AS pen FROM cd),
c3 AS (SELECT *, (0.3*train_score+0.4*test_score+0.3*coalesce(oos_score,test_score))*(1-0.5*pen) AS rob FROM c2),
c4 AS (SELECT *, least(rob, (test_score+coalesce(oos_score,test_score))/2)*(1-pen)*CASE wf_verdict WHEN 'robust' THEN 1.1 WHEN 'suspect' THEN 0.9 ELSE 1 END AS adj FROM c3),
c5 AS (SELECT *, CASE WHEN verdict='overfitted' THEN 0 ELSE rob END AS robustness_score, CASE WHEN verdict='overfitted' THEN 0 ELSE adj END AS adjusted_score,
  CASE WHEN verdict='overfitted' THEN 'overfitted' WHEN wf_verdict='overfitted' THEN 'walk_forward' WHEN rob<40 THEN 'robustness' ELSE '' END AS rejection_reason FROM c4)"""


def _candidates(spark, sf):
    r = supplier_results(spark, sf)
    sh = F.col("sharpe")
    grade = lambda a, b: F.when(sh < a, "overfitted").when(sh < b, "suspect").otherwise("robust")
    return r.select("strategy_id", "trades", F.col("score").alias("train_score"), F.least(F.lit(100.0), F.col("profit_factor") * 40).alias("test_score"),
                    F.when(F.col("trades") >= 450, F.col("winrate") * 100).alias("oos_score"), grade(-1, 0).alias("verdict"), grade(-0.5, 0.1).alias("wf_verdict"))


@query("candidate_acceptance", "V14 V15", _res(f", {CAND} SELECT {SID}, rejection_reason, (rejection_reason='')::BIGINT AS accepted, {cols('robustness_score adjusted_score')} FROM c5"))
def _(spark, sf):
    df = val.accept_candidates(_candidates(spark, sf)).fillna("", ["rejection_reason"]).withColumn("accepted", F.col("accepted").cast("int"))
    return show(df, "strategy_id accepted", "robustness_score adjusted_score", "rejection_reason")


@query("evaluation_verdicts", "V16", _res(f""", {CAND} SELECT {SID}, CASE WHEN NOT (trades>=440) THEN 'statistically_questionable' WHEN adjusted_score>=60 THEN 'excellent' WHEN adjusted_score>=40 THEN 'acceptable' WHEN adjusted_score>=20 THEN 'mediocre' ELSE 'poor' END AS evaluation,
  CASE WHEN NOT (trades>=440) THEN 'reject_or_investigate' WHEN adjusted_score>=60 THEN 'deploy' WHEN adjusted_score>=40 THEN 'continue_optimization' WHEN adjusted_score>=20 THEN 'major_revision' ELSE 'abandon' END AS recommendation FROM c5"""))
def _(spark, sf):
    df = val.accept_candidates(_candidates(spark, sf)).withColumn("sure", F.col("trades") >= 440)
    return show(val.evaluate(df, significant="sure"), "strategy_id", "", "evaluation recommendation")


@query("abandoned_strategies", "V16", f"""WITH h AS (SELECT l_suppkey AS sid, l_orderkey AS no, max(l_discount)*200 AS adj FROM lineitem GROUP BY 1, 2), t AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY sid ORDER BY no DESC)<=3)
  SELECT sid::BIGINT AS strategy_id, {rnd('avg(adj)')} AS recent_score, (count(*)=3 AND avg(adj)<15)::BIGINT AS abandon FROM t GROUP BY 1""")
def _(spark, sf):
    h = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("strategy_id"), F.col("l_orderkey").alias("eval_no")).agg((F.max("l_discount") * 200).alias("adjusted_score"))
    df = val.abandon(h)
    return df.select(F.col("strategy_id").cast("bigint").alias("strategy_id"), fixed("recent_score").alias("recent_score"), F.col("abandon").cast("bigint").alias("abandon"))


@query("history_points", "K9", f"""WITH h AS (SELECT l_suppkey AS sid, l_orderkey AS no, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey)-1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem))
  SELECT DISTINCT sid::BIGINT AS strategy_id, no::BIGINT AS eval_no FROM h, range(6) r(k) WHERE n<=6 OR i = CASE WHEN k=5 THEN n-1 ELSE floor(k*((n-1)/5.0::DOUBLE)) END""")
def _(spark, sf):
    from barlab.core.blocks import index_rows
    from barlab.operators.ranking import history_points

    h = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("strategy_id"), F.col("l_orderkey").alias("eval_no")).distinct()
    h = index_rows(h, ["strategy_id"], F.floor(F.col("eval_no") / 4096), ["eval_no"], "pos", "n")
    return show(history_points(h), "strategy_id eval_no")


# ---------------------------------------------------------------- votes and backtest

T_ = lambda **k: tuple(sorted(k.items()))
PLAN = [Strategy("ma_rsi", "D1", "crossover_ma", "a", (("SMA", T_(period=10)), ("SMA", T_(period=30)), ("RSI", T_(period=14, overbought=65, oversold=35))), 300, 600, 2.0, 1.0),
        Strategy("macd_adx", "D1", "macd_histogram", "b", (("MACD", T_(fast=12, slow=26, signal=9)), ("ADX", T_(period=14, threshold=12)), ("BB", T_(period=20, deviation=2.0))), 500, 500, 1.0, 2.0),
        Strategy("channel", "D1", "donchian_breakout", "c", (("DONCHIAN", T_(period=20)), ("VWAP", T_(period=20)), ("MOMENTUM", T_(period=10))), 800, 1600, 2.0, 0.5)]
INFO = bt.SymbolInfo(pip=100.0, spread_price=50.0, tick_value=1.0, tick_size=100.0)


def _x(a, b, pa, pb, known):
    return f"CASE WHEN {known} THEN CASE WHEN {a}>{b} AND {pa}<={pb} THEN 1 WHEN {a}<{b} AND {pa}>={pb} THEN -1 ELSE 0 END END"


VOTES = (
    *RSI, *MACD, *ADX, *BB,
    f"""v0 AS (SELECT bars.*, rs.rsi, mc.macd, mc.macd_signal AS ms, ax.y AS adx, b.bb_upper AS bu, b.bb_lower AS bl FROM bars LEFT JOIN rs USING (symbol, bar_idx) LEFT JOIN mc USING (symbol, bar_idx) LEFT JOIN ax USING (symbol, bar_idx) LEFT JOIN b USING (symbol, bar_idx))""",
    f"""v1 AS (SELECT *, CASE WHEN bar_idx>=9 THEN avg(close) {frame(-9, 0)} END AS f, CASE WHEN bar_idx>=29 THEN avg(close) {frame(-29, 0)} END AS s, lag(close) OVER ({S}) AS pc, lag(macd) OVER ({S}) AS pm, lag(ms) OVER ({S}) AS pms,
      CASE WHEN bar_idx>=19 THEN max(high) {frame(-19, 0)} END AS du, CASE WHEN bar_idx>=19 THEN min(low) {frame(-19, 0)} END AS dl, CASE WHEN bar_idx>=20 THEN sum((high+low+close)/3*tick_volume) {frame(-20, 0)}/sum(tick_volume) {frame(-20, 0)} END AS vw, close-lag(close,10) OVER ({S}) AS mo FROM v0)""",
    f"v2 AS (SELECT *, lag(f) OVER ({S}) AS pf, lag(s) OVER ({S}) AS ps, lag(du) OVER ({S}) AS pdu, lag(dl) OVER ({S}) AS pdl, lag(mo) OVER ({S}) AS pmo FROM v1)",
    f"""v3 AS (SELECT 'ma_rsi' AS sid, symbol, bar_idx, {_x('f', 's', 'pf', 'ps', 'pf IS NOT NULL AND ps IS NOT NULL')} AS a, CASE WHEN rsi<35 THEN 1 WHEN rsi>65 THEN -1 WHEN rsi IS NOT NULL THEN 0 END AS b, NULL::INT AS c, 0 AS damp FROM v2
  UNION ALL SELECT 'macd_adx', symbol, bar_idx, {_x('macd', 'ms', 'pm', 'pms', 'pm IS NOT NULL AND pms IS NOT NULL')}, CASE WHEN close<=bl THEN 1 WHEN close>=bu THEN -1 WHEN bu IS NOT NULL THEN 0 END, NULL, coalesce(adx<12, false)::INT FROM v2
  UNION ALL SELECT 'channel', symbol, bar_idx, CASE WHEN du IS NOT NULL AND pc IS NOT NULL THEN CASE WHEN close>=du AND pc<pdu THEN 1 WHEN close<=dl AND pc>pdl THEN -1 ELSE 0 END END,
    CASE WHEN vw IS NOT NULL THEN CASE WHEN close>vw AND pc<=vw THEN 1 WHEN close<vw AND pc>=vw THEN -1 ELSE 0 END END, {_x('mo', '0', 'pmo', '0', 'mo IS NOT NULL AND pmo IS NOT NULL')}, 0 FROM v2)""",
    """v4 AS (SELECT *, (a IS NOT NULL)::INT+(b IS NOT NULL)::INT+(c IS NOT NULL)::INT AS tv, greatest(0, coalesce((a=1)::INT,0)+coalesce((b=1)::INT,0)+coalesce((c=1)::INT,0)-damp) AS bv,
  greatest(0, coalesce((a=-1)::INT,0)+coalesce((b=-1)::INT,0)+coalesce((c=-1)::INT,0)-damp) AS sv FROM v3 WHERE bar_idx>=100)""",
    "vsig AS MATERIALIZED (SELECT sid, symbol, bar_idx, CASE WHEN bv>=greatest(1, tv//3) AND bv>sv THEN 1 WHEN sv>=greatest(1, tv//3) AND sv>bv THEN -1 ELSE 0 END AS sig FROM v4 WHERE tv>0)")


@query("vote_signals", "R-V1 R-V2 R-V3 R-V4", q.d1(*VOTES, select=f"SELECT sid AS strategy_id, {ID}, sig::BIGINT AS signal FROM vsig WHERE sig<>0"))
def _(spark, sf):
    return show(vote_signals(order_bars(spark, sf), PLAN, "D1"), "bar_idx signal", "", "strategy_id symbol")


LOT = "CASE WHEN slp*1.0<=0 THEN 0.01 ELSE round_even(greatest(0.01, round_even({cap}*risk/100/(slp*1.0)/0.01, 0)*0.01), 2) END"
MACHINE = (*VOTES, "rk(sid, slp, tpp, risk) AS (VALUES ('ma_rsi', 300, 600, 1.0::DOUBLE), ('macd_adx', 500, 500, 2.0), ('channel', 800, 1600, 0.5))",
           "sz AS (SELECT symbol, max(n_bars) AS n, least(greatest(200, least(floor(max(n_bars)*0.7)::BIGINT, max(n_bars)-100)), max(n_bars)) AS cut FROM bars GROUP BY symbol HAVING max(n_bars)>=200)",
           "sgm AS (SELECT symbol, 'full' AS seg, 0 AS lo, n AS hi FROM sz UNION ALL SELECT symbol, 'train', 0, cut FROM sz UNION ALL SELECT symbol, 'test', cut, n FROM sz)",
           "feed AS MATERIALIZED (SELECT symbol, bar_idx, sid, high, low, close, coalesce(sig,0) AS sig FROM bars JOIN (SELECT DISTINCT sid FROM rk) r ON true LEFT JOIN vsig USING (symbol, bar_idx, sid))",
           f"""pm AS (SELECT g.symbol, g.seg, g.hi, rk.*, g.lo::BIGINT AS i, 0 AS pos, 0.0::DOUBLE AS ep, 0.0::DOUBLE AS lot, 10000.0::DOUBLE AS cap, NULL::DOUBLE AS ev FROM sgm g, rk
  UNION ALL SELECT symbol, seg, hi, sid, slp, tpp, risk, i, CASE WHEN p1=0 AND sig<>0 THEN sig WHEN p1<>0 AND sig=-p1 THEN sig ELSE p1 END,
    CASE WHEN (p1=0 AND sig<>0) OR (p1<>0 AND sig=-p1) THEN CASE WHEN sig=1 THEN close+50 ELSE close END ELSE ep END,
    CASE WHEN (p1=0 AND sig<>0) OR (p1<>0 AND sig=-p1) THEN {LOT.format(cap='c2')} ELSE lot END, c2, coalesce(e1, e2) FROM
   (SELECT *, c1 + coalesce(e2,0)*lot AS c2 FROM (SELECT *, CASE WHEN p1<>0 AND sig=-p1 THEN CASE WHEN p1=1 THEN (close-ep)/100 ELSE (ep-close-50)/100 END END AS e2, cap + coalesce(e1,0)*lot AS c1 FROM
    (SELECT *, CASE WHEN e1 IS NOT NULL THEN 0 ELSE pos END AS p1 FROM
     (SELECT m.symbol, m.seg, m.hi, m.sid, m.slp, m.tpp, m.risk, f.bar_idx AS i, m.pos, m.ep, m.lot, m.cap, f.sig, f.close,
       CASE WHEN (m.pos=1 AND f.low<=m.ep-m.slp*100.0::DOUBLE) OR (m.pos=-1 AND f.high>=m.ep+m.slp*100.0::DOUBLE) THEN -m.slp::DOUBLE WHEN (m.pos=1 AND f.high>=m.ep+m.tpp*100.0::DOUBLE) OR (m.pos=-1 AND f.low<=m.ep-m.tpp*100.0::DOUBLE) THEN m.tpp::DOUBLE END AS e1
      FROM pm m JOIN feed f ON f.symbol=m.symbol AND f.sid=m.sid AND f.bar_idx=m.i+1 WHERE m.i+1<m.hi)))))""",
           "pl AS (SELECT *, lag(lot) OVER (PARTITION BY symbol, seg, sid ORDER BY i) AS plot FROM pm)",
           """tr AS (SELECT symbol, seg, sid, i, ev AS pips, ev*plot AS money FROM pl WHERE ev IS NOT NULL
  UNION ALL SELECT pm.symbol, seg, sid, i, CASE WHEN pos=1 THEN (b.close-ep)/100 ELSE (ep-b.close-50)/100 END, CASE WHEN pos=1 THEN (b.close-ep)/100 ELSE (ep-b.close-50)/100 END*lot FROM pm JOIN bars b ON b.symbol=pm.symbol AND b.bar_idx=pm.i WHERE pm.i=pm.hi-1 AND pos<>0)""")


def _trades(spark, sf):
    bars = order_bars(spark, sf)
    return bt.trade_list(vote_signals(bars, PLAN, "D1"), bars, search.risk_table(spark, PLAN), INFO)


@query("backtest_trades", "T6 F10", q.d1(*MACHINE, select=f"SELECT sid AS strategy_id, symbol, seg AS segment, count(*)::BIGINT AS trades, {rnd('sum(money)', 1)} AS profit, {rnd('sum(pips)', 1)} AS pips, sum((money>0)::INT)::BIGINT AS wins FROM tr GROUP BY ALL"))
def _(spark, sf):
    gain = F.max_by("capital", "bar_idx") - bt.STARTING_CAPITAL
    df = _trades(spark, sf).groupBy("strategy_id", "symbol", "segment").agg(
        F.count(F.lit(1)).alias("trades"), gain.alias("profit"), F.sum("pips").alias("pips"), F.count_if(F.col("pnl") > 0).alias("wins"))
    return show(df, "trades wins", "profit pips", "strategy_id symbol segment", dp=1)


@query("backtest_results", "T6 T7 G1 F26 D1")
def _(spark, sf):
    df = bt.train_test(bt.summaries(_trades(spark, sf)))
    return show(df, "trades wins losses", "profit profit_money winrate drawdown profit_factor sharpe degradation consistency score", "strategy_id symbol", dp=3)


def _evaluate(spark, sf):
    return search.evaluator({"D1": order_bars(spark, sf)}, INFO)


def _widened(strategies):
    """Stops and targets at the scale of the given prices."""
    return [Strategy(s.id, s.timeframe, s.family, s.variant, s.indicators, s.stop_loss * 5, s.take_profit * 5, s.risk_reward, s.risk_per_trade) for s in strategies]


@query("exhaustive_search", "J13 X1 X2 X4 X6 K1")
def _(spark, sf):
    """All 25 families with 3 variants each, the best 10 with 5 mutations each, ranked together."""
    return show(search.exhaustive(_evaluate(spark, sf), _widened(search.planned(["D1"]))), "trades rank", "score", "strategy_id symbol")


@query("generational_search", "X3 X5 X7 D3")
def _(spark, sf):
    from barlab.operators.catalog import free_form

    start = _widened([free_form("D1", n) for n in range(8)])
    return show(search.generational(_evaluate(spark, sf), start), "generation trades", "score", "strategy_id symbol")


@query("hill_climb", "X8")
def _(spark, sf):
    return show(search.improve(_evaluate(spark, sf), PLAN[0], steps=3), "step trades", "score", "strategy_id symbol")


@query("candidate_optimisation", "X17")
def _(spark, sf):
    start = _widened(search.planned(["D1"], variants=1, families=["crossover_ma", "donchian_breakout", "bollinger_squeeze", "pivot_bounce"]))
    return show(search.optimise_candidates(_evaluate(spark, sf), start, steps=3), "", "score", "candidate strategy_id")


# ---------------------------------------------------------------- model preparation


@query("robust_scaling", "X10", q.h1(f"pq AS (SELECT symbol, quantile_cont(close, 0.5) AS m, quantile_cont(close, 0.75)-quantile_cont(close, 0.25) AS i, quantile_cont(high-low, 0.5) AS m2, quantile_cont(high-low, 0.75)-quantile_cont(high-low, 0.25) AS i2 FROM bars GROUP BY 1)",
                                     select=f"SELECT {ID}, {rnd('(close-m)/CASE WHEN i=0 THEN 1 ELSE i END')} AS close, {rnd('(high-low-m2)/CASE WHEN i2=0 THEN 1 ELSE i2 END')} AS spread FROM bars JOIN pq USING (symbol)"))
def _(spark, sf):
    df = event_bars(spark, sf).select("symbol", "bar_idx", "close", (F.col("high") - F.col("low")).alias("spread"))
    return show(mlprep.robust_scale(df, ["close", "spread"], ["symbol"]), "bar_idx", "close spread", "symbol")


@query("sequences", "X11", q.h1(f"sq AS (SELECT *, lead(close, 4) OVER ({S}) AS fut, avg(close) {frame(-180, -1)} AS m, max(high) {frame(-180, -1)} AS h FROM bars)",
                                select=f"SELECT {ID}, 180::BIGINT AS length, {rnd('m')} AS mean_close, {rnd('h')} AS top, (fut>close)::BIGINT AS label FROM sq WHERE bar_idx>=180 AND fut IS NOT NULL"))
def _(spark, sf):
    df = mlprep.sequences(event_bars(spark, sf), ["close", "high"], 180, 4)
    df = df.withColumns({"length": F.size("sequence"), "mean_close": F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x.close) / 180, "top": F.array_max(F.transform("sequence", lambda x: x.high))})
    return show(df, "bar_idx length label", "mean_close top", "symbol")


@query("horizon_labels", "X12", q.h1(select=f"SELECT {ID}, " + ", ".join(f"coalesce((lead(close,{h}) OVER ({S})>close)::INT, -1)::BIGINT AS label_{n}" for n, h in (("h1", 1), ("h4", 4), ("d1", 24))) + " FROM bars"))
def _(spark, sf):
    return show(mlprep.horizon_labels(event_bars(spark, sf), {"H1": 1, "H4": 4, "D1": 24}).fillna(-1, ["label_h1", "label_h4", "label_d1"]), "bar_idx label_h1 label_h4 label_d1", "", "symbol")


@query("temporal_train_split", "X13", q.h1(select="SELECT symbol, CASE WHEN bar_idx<floor(n_bars*0.85) THEN 'train' ELSE 'validation' END AS part, count(*)::BIGINT AS n, min(bar_idx)::BIGINT AS first_bar FROM bars GROUP BY ALL"))
def _(spark, sf):
    return show(mlprep.temporal_split(event_bars(spark, sf)).groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("n"), F.min("bar_idx").alias("first_bar")), "n first_bar", "", "symbol part")


@query("ensemble_combination", "X14", q.h1(PRED, "w0 AS (SELECT m, avg(greatest(pb,1-pb)) AS w FROM pr GROUP BY 1)", "w1 AS (SELECT m, w/sum(w) OVER () AS w FROM w0)",
                                           select=f"SELECT {ID}, {rnd('sum(pb*w)')} AS p_buy, {rnd('sum((1-pb)*w)')} AS p_sell FROM pr JOIN w1 USING (m) GROUP BY symbol, pr.bar_idx"))
def _(spark, sf):
    return show(mlprep.combine_ensemble(predictions(event_bars(spark, sf)), ["symbol", "bar_idx"]), "bar_idx", "p_buy p_sell", "symbol")


@query("stacked_predictions", "X16", q.h1(PRED, select=f"SELECT {ID}, " + ", ".join(f"{rnd(f'max(CASE WHEN m={m} THEN {e} END)')} AS {c}_{m}" for m in (1, 2, 3) for c, e in (("p_sell", "1-pb"), ("p_buy", "pb"))) + " FROM pr GROUP BY symbol, pr.bar_idx"))
def _(spark, sf):
    return show(mlprep.stack_predictions(predictions(event_bars(spark, sf)), ["symbol", "bar_idx"], [1, 2, 3]), "bar_idx", "p_sell_1 p_buy_1 p_sell_2 p_buy_2 p_sell_3 p_buy_3", "symbol")


@query("feature_group_selection", "X15 K6 U3")
def _(spark, sf):
    bars = mlprep.temporal_split(mlprep.horizon_labels(with_indicators(event_bars(spark, sf), ind.rsi(14, out="rsi"), ind.stochastic(), ft.return_stats()), {"H4": 4})).withColumnRenamed("label_h4", "label")
    steps = mlprep.select_groups(bars, {"rsi": ["rsi"], "stochastic": ["stoch_k", "stoch_d"]}, ["log_returns"], top_n=2)
    return spark.createDataFrame([(n, ",".join(s["groups"]), float(s["accuracy"])) for n, s in enumerate(steps)], "step int, groups string, accuracy double")
