"""The news stream: items to events to cards, deduplicated, stored, handed on and purged."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barlab.operators.news import insert_if_new, make_events, recent_for_display, to_cards
from barlab.session import has_files

RETENTION_DAYS = 7
PURGE_EVERY_SECONDS = 3600


def unique_events(items: DataFrame, retention_days: int = RETENTION_DAYS) -> DataFrame:
    """Streaming items to raw events without repeats of a content hash inside the retention time. State is
    keyed by the hash, so a source that sends a third of all items is spread over all partitions."""
    events = make_events(items).withWatermark("fetched_at", f"{retention_days} days")
    return events.dropDuplicatesWithinWatermark(["content_hash"])


def _stored(spark: SparkSession, path: str, empty: DataFrame) -> DataFrame:
    return spark.read.parquet(path) if has_files(spark, path) else empty


def purge_days(spark: SparkSession, path: str, today: date, retention_days: int = RETENTION_DAYS) -> list[str]:
    """Delete the day folders older than the retention time; returns them. No data is read or rewritten."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    limit = (today - timedelta(days=retention_days)).isoformat()
    old = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("day=") and s.getPath().getName()[4:] < limit]
    for p in old:
        fs.delete(p, True)
    return [p.getName() for p in old]


def replay(spark: SparkSession, events_path: str, now, days: int = RETENTION_DAYS, limit: int | None = None) -> DataFrame:
    """Recent stored items, oldest first, for the start of a session."""
    return recent_for_display(spark.read.parquet(events_path), now, days, limit).orderBy("read_at", "content_hash")


def run_news(items: DataFrame, events_path: str, cards_path: str, checkpoint: str, on_batch: Callable[[DataFrame], None] | None = None,
             retention_days: int = RETENTION_DAYS, purge_every: float = PURGE_EVERY_SECONDS, today: Callable[[], date] = date.today, trigger: dict | None = None) -> StreamingQuery:
    """Start the stream. Every micro-batch appends its new events and their cards (by day) and calls
    ``on_batch`` with the new cards; old days are purged at most every ``purge_every`` seconds.

    Cards are written before events and both are checked against what is stored, so a batch that is retried after
    a failure adds only what is missing.
    """
    last_purge = [0.0]

    def store(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        day = lambda df, c: df.withColumn("day", F.to_date(c))
        fresh = insert_if_new(batch, _stored(spark, events_path, batch.limit(0)).select("content_hash")).persist()
        cards = to_cards(fresh)
        known = _stored(spark, cards_path, cards.limit(0)).select("raw_event_hash")
        cards = cards.join(known, "raw_event_hash", "left_anti").persist()
        day(cards, "first_seen_at").write.mode("append").partitionBy("day").parquet(cards_path)
        day(fresh, "fetched_at").write.mode("append").partitionBy("day").parquet(events_path)
        if on_batch:
            on_batch(cards)
        cards.unpersist()
        fresh.unpersist()
        if time.monotonic() - last_purge[0] >= purge_every or last_purge[0] == 0.0:
            last_purge[0] = time.monotonic()
            for path in (events_path, cards_path):
                purge_days(spark, path, today(), retention_days)

    writer = unique_events(items, retention_days).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "2 seconds"})).start()
