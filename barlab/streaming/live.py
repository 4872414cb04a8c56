"""Live bars, daily locks, and signal requests as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barlab.core.steps import with_indicators
from barlab.functions.scalars import stop_price, target_price, trend_direction
from barlab.operators import gates
from barlab.operators.asof import trend_filter_from_base
from barlab.operators.features import ma_distance, market_state, volume_ratios
from barlab.operators.outcomes import SL_ATR, TP_ATR
from barlab.sources.bars import TIMEFRAME_SECONDS, indexed, parse_bar_text, tick_order
from barlab.sources.feeds import format_responses, parse_requests

SEQUENCE_LENGTH = 180


def live_bars(ticks: DataFrame, timeframe: str, symbol: str, ts: str, price: str, tie: str, delay: str = "10 minutes") -> DataFrame:
    """Finished bars of a tick stream. Ticks later than ``delay`` are dropped; the query's progress counts them."""
    order = tick_order(F.col(ts), F.col(tie))
    width = F.window(F.col(ts), f"{TIMEFRAME_SECONDS[timeframe]} seconds")
    return (ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(F.col(symbol).alias("symbol"), width.alias("w"))
            .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
                 F.max_by(price, order).alias("close"), F.count(F.lit(1)).alias("tick_volume"))
            .select("symbol", F.lit(timeframe).alias("timeframe"), F.col("w.start").alias("ts"), "open", "high", "low", "close", "tick_volume"))


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped by the watermark over the recent progress reports."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def lock_states(lines: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Lock changes per symbol from a stream of (symbol, ts, locked): a lock holds for its UTC day, can be
    lifted again, and expires at midnight of event time. Emits (symbol, day, locked) on every change, and the lift of a
    day that ends locked, once: with the next day's first line, or when the watermark has passed midnight, at once if it
    already has. Lines older than the newest one seen of their symbol change nothing."""
    schema, state = "symbol string, day string, locked boolean", "day string, locked boolean, seen timestamp"

    def update(key: tuple, batches: Iterable[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        day, locked, seen = st.get if st.exists else (None, False, None)
        out = []
        if st.hasTimedOut:
            if locked:
                out.append((key[0], day, False))
            st.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
            rows = rows[rows["ts"] >= pd.Timestamp(seen)] if seen is not None else rows
            days, flags = rows["ts"].dt.strftime("%Y-%m-%d"), rows["locked"].astype(bool)
            before_day, before = days.shift(fill_value=day or ""), flags.shift(fill_value=locked)
            turned = (days != before_day) | (flags != before)
            for today, flag, last, was in zip(days[turned], flags[turned], before_day[turned], before[turned]):
                if last and last != today and was:
                    out.append((key[0], last, False))
                out.append((key[0], today, bool(flag)))
            if len(rows):
                day, locked, seen = days.iloc[-1], bool(flags.iloc[-1]), rows["ts"].iloc[-1].to_pydatetime()
            midnight = (pd.Timestamp(day) + pd.Timedelta(days=1)).value // 1_000_000
            if midnight <= st.getCurrentWatermarkMs():
                if locked:
                    out.append((key[0], day, False))
                st.remove()
            else:
                st.update((day, locked, seen))
                st.setTimeoutTimestamp(midnight)
        yield pd.DataFrame(out, columns=["symbol", "day", "locked"])

    return lines.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy("symbol").applyInPandasWithState(update, schema, state, "append", GroupStateTimeout.EventTimeTimeout)


def answer_requests(requests: DataFrame, locks: DataFrame, predict: Callable[[DataFrame], DataFrame], day: str, timeframe: str = "H1",
                    trend_period: int = 200, threshold: float = gates.DECISION_CONFIDENCE_PCT, lot: float = 0.01, minimum: int = SEQUENCE_LENGTH) -> DataFrame:
    """Signals for requests (request_id, symbol, data) that bring their own bars.

    ``predict`` adds p_buy and p_sell to the last feature row of each request. Locked symbols, short histories and
    failed predictions are answered with HOLD and a reason. A request's bars are a series of their own.
    """
    bars = indexed(parse_bar_text(requests.select(F.col("request_id").alias("symbol"), "data")).withColumn("timeframe", F.lit(timeframe)), timeframe)
    feats = with_indicators(bars, ma_distance(), market_state(), volume_ratios())
    feats = trend_filter_from_base(feats, trend_period, "D1").filter((F.col("bar_idx") == F.col("n_bars") - 1) & (F.col("n_bars") >= minimum))
    scored = predict(feats).select(F.col("symbol").alias("request_id"), "close", "atr", "adx", "volume_momentum", "ma_fast", "ma_slow", "trend_filter_ma", "trend_filter_above", "p_buy", "p_sell")
    locked = locks.filter((F.col("date") == day) & F.col("locked")).select(F.col("symbol"), F.lit(True).alias("_locked")).distinct()
    df = requests.select("request_id", "symbol").join(locked, "symbol", "left").join(scored, "request_id", "left")
    df = df.withColumn("direction", trend_direction(F.col("trend_filter_above"), F.col("close"), F.col("trend_filter_ma")))
    conf = gates.directional_confidence(F.col("direction"), F.col("p_buy"), F.col("p_sell"))
    ok = gates.technical_gate(F.col("direction"), F.col("adx"), F.col("volume_momentum"), F.col("ma_fast"), F.col("ma_slow"), F.col("trend_filter_above"))
    reason = (F.when(F.col("_locked"), "locked").when(F.col("close").isNull(), "short_history").when(F.col("p_buy").isNull(), "no_prediction")
              .when(~gates.confidence_gate(F.col("direction"), conf, threshold), "low_confidence").when(~ok, "gate"))
    df = df.withColumns({"reason": reason, "signal": F.when(reason.isNull(), F.col("direction")).otherwise("HOLD")})
    active = F.col("signal") != "HOLD"
    price = lambda fn, mult: F.when(active, fn(F.col("signal"), F.col("close"), F.col("atr"), mult)).otherwise(0.0)
    return df.select("request_id", "symbol", "signal", F.when(active, F.lit(lot)).otherwise(0.0).alias("lot"), price(target_price, TP_ATR).alias("take_profit"),
                     price(stop_price, SL_ATR).alias("stop_loss"), "reason")


def run_requests(lines: DataFrame, locks: Callable[[], DataFrame], predict: Callable[[DataFrame], DataFrame], day: Callable[[], str], out_path: str, checkpoint: str,
                 trigger: dict | None = None, **options) -> StreamingQuery:
    """Answer a stream of request lines (``value``, ``request_id``) with response lines."""

    def answer(batch: DataFrame, epoch: int) -> None:
        out = answer_requests(parse_requests(batch), locks(), predict, day(), **options)
        format_responses(out).write.mode("overwrite").option("sep", "|").csv(f"{out_path}/batch={epoch}")

    return lines.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
