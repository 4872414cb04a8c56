"""barlab: market-style time-series analytics and news/text processing as Spark jobs."""
