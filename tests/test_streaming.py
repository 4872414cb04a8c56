import json
import os
from datetime import date, datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from barlab.sources.bars import build_bars
from barlab.streaming import live, news as ns

ITEM = "entity_id string, entity_name string, source_id bigint, source_type string, source_url string, title string, content string, published_at string, fetched_at timestamp, item_url string"


def _write(path, rows, n):
    path.mkdir(exist_ok=True)
    (path / f"{n:03d}.json").write_text("\n".join(json.dumps(r) for r in rows))


def _run(df, path, tmp_path, name):
    q = df.writeStream.format("parquet").option("path", str(path)).option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_live_bars_equal_batch_and_count_late_ticks(spark, tmp_path):
    t = lambda m: (datetime(2024, 1, 1) + timedelta(minutes=m)).isoformat()
    ticks = [{"s": "A", "ts": t(m), "p": float(m % 17), "id": m} for m in range(0, 600, 7)]
    src = tmp_path / "ticks"
    _write(src, ticks, 0)
    schema = "s string, ts timestamp, p double, id bigint"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    bars = live.live_bars(stream, "H1", "s", "ts", "p", "id")
    _run(bars, tmp_path / "out", tmp_path, "bars")
    want = build_bars(spark.read.schema(schema).json(str(src)), "H1", "s", "ts", "p", "id").orderBy("ts").drop("timeframe").toPandas()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").drop("timeframe").toPandas()
    assert got.equals(want.iloc[: len(got)]) and len(got) == len(want) - 1  # the open bar is not out yet
    _write(src, [{"s": "A", "ts": t(1), "p": 99.0, "id": 999}, {"s": "A", "ts": t(1000), "p": 1.0, "id": 1000}], 1)
    q = _run(live.live_bars(spark.readStream.schema(schema).json(str(src)), "H1", "s", "ts", "p", "id"), tmp_path / "out", tmp_path, "bars")
    assert live.late_rows(q) == 1
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.max("high")).first()[0] < 99


def test_news_stream_is_idempotent_and_purges(spark, tmp_path):
    item = lambda n, day, title: {"entity_id": "ecb", "entity_name": "European Central Bank", "source_id": 1, "source_type": "rss", "source_url": "https://www.ecb.europa.eu/rss", "title": title,
                                  "content": f"<p>body {n}</p>", "published_at": "x", "fetched_at": f"2024-01-{day:02d} 10:00:00", "item_url": f"https://www.ecb.europa.eu/{n}"}
    src, ev, cards = tmp_path / "items", str(tmp_path / "ev"), str(tmp_path / "cards")
    _write(src, [item(1, 1, "rate cut"), item(1, 1, "rate cut"), item(2, 9, "missile attack")], 0)
    seen = []
    run = lambda ck: ns.run_news(spark.readStream.schema(ITEM).json(str(src)), ev, cards, str(tmp_path / ck), on_batch=lambda df: seen.append(df.count()), today=lambda: date(2024, 1, 9),
                                 purge_every=0, trigger={"availableNow": True}).awaitTermination()
    run("ck1")
    kept = spark.read.parquet(cards)
    assert sum(seen) == 2 and [r["event_type"] for r in kept.collect()] == ["military_escalation"]  # the old day is purged
    before = spark.read.parquet(ev).count()
    run("ck2")  # a fresh checkpoint reads everything again: only the purged day could come back
    assert spark.read.parquet(ev).count() == before
    assert [r["title"] for r in ns.replay(spark, ev, F.lit("2024-01-10").cast("timestamp")).collect()] == ["missile attack"]


LOCKS = "symbol string, ts timestamp, locked boolean"


def _locks(spark, tmp_path, name, files):
    """Lock changes of a stream that reads the files one by one in the given order."""
    src = tmp_path / name
    for n, rows in enumerate(files):
        _write(src, [dict(zip(("symbol", "ts", "locked"), r)) for r in rows], n)
        os.utime(src / f"{n:03d}.json", (1_700_000_000 + 60 * n,) * 2)
    stream = spark.readStream.schema(LOCKS).option("maxFilesPerTrigger", 1).json(str(src))
    _run(live.lock_states(stream), tmp_path / f"{name}_out", tmp_path, name)
    return sorted((r["symbol"], r["day"], r["locked"]) for r in spark.read.parquet(str(tmp_path / f"{name}_out")).collect())


def test_locks_expire_at_midnight(spark, tmp_path):
    first = [("A", "2024-01-01 10:00:00", True), ("B", "2024-01-01 11:00:00", True), ("B", "2024-01-01 12:00:00", False)]
    second = [("C", "2024-01-02 09:00:00", True)]
    want = sorted([("A", "2024-01-01", True), ("A", "2024-01-01", False), ("B", "2024-01-01", True), ("B", "2024-01-01", False), ("C", "2024-01-02", True)])
    assert _locks(spark, tmp_path, "in_order", [first, second]) == want
    assert _locks(spark, tmp_path, "one", [first + second]) == want


def test_locks_of_a_day_that_is_over_are_lifted_at_once(spark, tmp_path):
    day = [("A", "2024-01-01 23:50:00", True)]
    later = [("C", "2024-01-02 00:40:00", True)]  # the watermark stands at 23:40, so A's line is not late
    last = [("D", "2024-01-02 05:00:00", False)]
    got = _locks(spark, tmp_path, "reversed", [later, day, last])
    assert {("A", "2024-01-01", True), ("A", "2024-01-01", False)} <= set(got)


def test_older_lock_lines_do_not_win(spark, tmp_path):
    got = _locks(spark, tmp_path, "old", [[("A", "2024-01-01 12:00:00", True)], [("A", "2024-01-01 11:30:00", False)], [("A", "2024-01-01 12:10:00", True)]])
    assert got == [("A", "2024-01-01", True)]


def test_requests_get_an_answer_each(spark, tmp_path):
    from helpers import series

    text = lambda n: ";".join(f"{int(r[2].timestamp())},{r[3]},{r[4]},{r[5]},{r[6]},{r[7]}" for r in series(n, 20))
    lines = [("r1", "AAA;" + text(240)), ("r2", "BBB;" + text(50)), ("r3", "CCC;" + text(240))]
    src = tmp_path / "req"
    _write(src, [{"request_id": i, "value": v} for i, v in lines], 0)
    locks = lambda: spark.createDataFrame([("CCC", "2024-01-01", True)], "symbol string, date string, locked boolean")
    predict = lambda df: df.withColumns({"p_buy": F.lit(0.9), "p_sell": F.lit(0.9)})
    q = live.run_requests(spark.readStream.schema("request_id string, value string").json(str(src)), locks, predict, lambda: "2024-01-01", str(tmp_path / "out"), str(tmp_path / "ck"),
                          trigger={"availableNow": True}, trend_period=3)
    q.awaitTermination()
    answers = {x["value"].split("|")[0]: x["value"] for x in spark.read.text(str(tmp_path / "out")).collect()}
    assert set(answers) == {"r1", "r2", "r3"}
    assert "HOLD;0.0" in answers["r2"] and "short_history" in answers["r2"] and "locked" in answers["r3"]
    assert ("BUY;" in answers["r1"] or "SELL;" in answers["r1"]) or "gate" in answers["r1"]


def test_stream_of_a_table_in_a_folder_of_files(spark, tmp_path):
    from barlab.catalog.streams import drained, source

    spark.range(6).repartition(3).write.parquet(str(tmp_path / "sf" / "parts.parquet"))
    pq.write_table(pa.table({"id": [1, 2]}), tmp_path / "sf" / "single.parquet")
    for name, want in (("parts", list(range(6))), ("single", [1, 2])):
        got = drained(source(spark, str(tmp_path / "sf"), name), str(tmp_path / f"{name}_out"))
        assert sorted(r["id"] for r in got.collect()) == want
