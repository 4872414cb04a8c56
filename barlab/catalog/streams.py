"""Streaming queries: each runs its stream over all available input and returns the stored result."""

from __future__ import annotations

from datetime import date
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.catalog.data import fixed, show, table
from barlab.catalog.registry import query
from barlab.catalog import sql as q
from barlab.catalog.sql import cols
from barlab.catalog.text_and_memory import ITEMS, items
from barlab.session import ensure_checkpoint_dir, is_folder
from barlab.streaming import live, news as ns


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid4().hex}"


def source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Stream of a table that is one file or a folder of files."""
    reader = spark.readStream.schema(table(spark, sf, name).schema)
    path = f"{sf}/{name}.parquet"
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def drained(df: DataFrame, path: str) -> DataFrame:
    """Run an append stream to its end into Parquet and read it back."""
    spark = df.sparkSession
    run = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", folder(spark, "ckpt")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@query("live_bars", "ST8", "WITH " + q.event_bars() + f" SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, tick_volume, {cols('open high low close')} FROM bars WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def _(spark, sf):
    bars = live.live_bars(source(spark, sf, "events"), "H1", "event_type", "ts", "value", "event_id")
    return show(drained(bars, folder(spark, "bars")), "tick_volume", "open high low close", "symbol ts")


@query("news_stream", "ST1 ST2 ST4 D6", f"WITH {ITEMS} SELECT substr(content_hash,1,12) AS hash, source_type, host FROM ev QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY fetched_at, doc_id)=1")
def _(spark, sf):
    events, cards = folder(spark, "events"), folder(spark, "cards")
    run = ns.run_news(items(spark, sf, source(spark, sf, "documents")), events, cards, folder(spark, "ckpt"), today=lambda: date(2024, 1, 2), trigger={"availableNow": True})
    run.awaitTermination()
    stored = spark.read.parquet(events)
    seen = spark.read.parquet(cards).select(F.col("raw_event_hash").alias("content_hash"))
    return stored.join(seen, "content_hash", "left_semi").select(F.substring("content_hash", 1, 12).alias("hash"), "source_type", F.get_json_object("metadata", "$.domain").alias("host"))


@query("lock_state_stream", "ST6", """WITH l AS (SELECT 'SYM'||user_id AS symbol, ts, strftime(ts,'%Y-%m-%d') AS day, event_id%3<>0 AS f FROM events), c AS (SELECT *, lag(f) OVER w AS pf, lag(day) OVER w AS pd, lead(day) OVER w AS nd FROM l WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  e AS (SELECT symbol, day, f AS locked FROM c WHERE pd IS NULL OR pd<>day OR pf<>f UNION ALL
        SELECT symbol, day, false FROM c WHERE f AND (nd<>day OR nd IS NULL AND day::TIMESTAMP + INTERVAL 1 DAY < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR))
  SELECT symbol, day, locked::BIGINT AS locked, count(*)::BIGINT AS n FROM e GROUP BY ALL""")
def _(spark, sf):
    lines = source(spark, sf, "events").select(F.concat(F.lit("SYM"), F.col("user_id").cast("string")).alias("symbol"), F.col("ts"), (F.col("event_id") % 3 != 0).alias("locked"))
    out = drained(live.lock_states(lines), folder(spark, "locks"))
    return out.groupBy("symbol", "day", F.col("locked").cast("bigint").alias("locked")).agg(F.count(F.lit(1)).alias("n"))


@query("request_stream", "ST5 ST7 S7 F11")
def _(spark, sf):
    from barlab.catalog.data import event_bars, hash_int

    rec = F.concat_ws(",", F.unix_timestamp("ts").cast("string"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "tick_volume")])
    per_day = event_bars(spark, sf).groupBy("symbol", F.weekofyear("ts").alias("w")).agg(F.concat_ws(";", F.sort_array(F.collect_list(rec))).alias("data"))
    requests = per_day.select(F.concat_ws("-", "symbol", F.col("w").cast("string")).alias("request_id"), "symbol", "data")
    locks = spark.createDataFrame([("click", "2024-01-31", True)], "symbol string, date string, locked boolean")
    predict = lambda df: df.withColumn("p_buy", hash_int(F.col("symbol")) % 10001 / 10000.0).withColumn("p_sell", 1 - F.col("p_buy"))
    out = live.answer_requests(requests, locks, predict, "2024-01-31", trend_period=3, minimum=100)
    return out.select("request_id", "signal", F.coalesce("reason", F.lit("")).alias("reason"), fixed("take_profit").alias("take_profit"), fixed("stop_loss").alias("stop_loss"))


def _last_locks(spark, sf):
    """Lock state of each symbol on each day: that of its last line."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.date_format("ts", "yyyy-MM-dd").alias("date"), "ts", "event_id")
    return e.groupBy("symbol", "date").agg(F.max_by(F.col("event_id") % 3 != 0, F.struct("ts", "event_id")).alias("locked"))


@query("request_holds", "ST5 ST7", f"""WITH {q.event_bars()}, r AS (SELECT symbol, symbol || '-' || month(ts) AS request_id, count(*) AS n FROM bars GROUP BY ALL),
  k AS (SELECT event_type AS symbol, arg_max(event_id % 3 <> 0, (ts, event_id)) AS locked FROM events WHERE ts::DATE = (SELECT max(ts)::DATE FROM events) GROUP BY 1)
  SELECT request_id, symbol, CASE WHEN coalesce(locked, false) THEN 'locked' WHEN n < 180 THEN 'short_history' ELSE '' END AS held FROM r LEFT JOIN k USING (symbol)""")
def _(spark, sf):
    """A stream of request lines, answered batch by batch with the locks as they are stored then."""
    from barlab.catalog.data import event_bars, hash_int

    rec = F.concat_ws(",", F.unix_timestamp("ts").cast("string"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "tick_volume")])
    month = event_bars(spark, sf).groupBy("symbol", F.month("ts").alias("m")).agg(F.concat_ws(";", F.sort_array(F.collect_list(rec))).alias("data"))
    lines = month.select(F.concat_ws("-", "symbol", F.col("m").cast("string")).alias("request_id"), F.concat_ws(";", "symbol", "data").alias("value"))
    asked, locks, answers = folder(spark, "requests"), folder(spark, "locks"), folder(spark, "answers")
    lines.repartition(3).write.parquet(asked)
    _last_locks(spark, sf).write.parquet(locks)
    predict = lambda df: df.withColumn("p_buy", hash_int(F.col("symbol")) % 10001 / 10000.0).withColumn("p_sell", 1 - F.col("p_buy"))
    today = spark.read.parquet(locks).agg(F.max("date")).first()[0]
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 2).parquet(asked)
    run = live.run_requests(stream, lambda: spark.read.parquet(locks), predict, lambda: today, answers, folder(spark, "ckpt"), {"availableNow": True})
    run.awaitTermination()
    out = spark.read.option("sep", "|").schema("request_id string, symbol string, reason string, value string").csv(f"{answers}/batch=*")
    return out.select("request_id", "symbol", F.when(F.col("reason").isin("locked", "short_history"), F.col("reason")).otherwise("").alias("held"))
