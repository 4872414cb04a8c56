"""Headline queries, timed including the build of the bars they read. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from barlab.catalog import data, load
from barlab.session import get_session

HEADLINE = ["signal_report", "bars_hourly", "macd", "adx", "market_structure", "volume_profile_poc", "trend_filter", "barrier_outcomes", "trade_summary", "trade_drawdown",
            "walk_forward_report", "monte_carlo_bootstrap", "strategy_scores", "vote_signals", "event_cards", "insert_if_new", "chunk_documents", "nearest_vectors", "fitted_history", "upserted_discoveries"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    registry, times = load(), {}
    registry["bars_daily"].run(spark, sf).write.format("noop").mode("overwrite").save()  # start the JVM's compilers
    for name in HEADLINE:
        data.forget()
        start = time.perf_counter()
        registry[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
