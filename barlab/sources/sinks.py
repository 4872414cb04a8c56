"""Output layouts: signal CSV, report datasets, JSON lines, insert-if-new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlab.operators.audits import report_totals, risk_audit
from barlab.operators.news import insert_if_new
from barlab.session import has_files

#: Signal columns of the two CSV layouts.
SPLIT_LAYOUT = ("date", "time", "dir", "sl", "tp", "comment")
SINGLE_LAYOUT = ("time", "dir", "sl", "tp", "comment")


def signal_rows(signals: DataFrame, sl_points: int, tp_points: int, split_time: bool = True) -> DataFrame:
    """Signals in CSV column order; date and time in one or two columns."""
    stamp = {"date": F.date_format("ts", "yyyy.MM.dd"), "time": F.date_format("ts", "HH:mm" if split_time else "yyyy-MM-dd HH:mm:ss")}
    df = signals.withColumns({**stamp, "dir": F.col("direction"), "sl": F.lit(sl_points), "tp": F.lit(tp_points),
                              "comment": F.format_string("conf=%.1f%%", F.col("confidence"))})
    return df.select("symbol", "timeframe", *(SPLIT_LAYOUT if split_time else SINGLE_LAYOUT))


def write_signals(rows: DataFrame, path: str) -> None:
    """``;``-separated CSV per symbol and timeframe with a header, also when there are no rows."""
    rows.write.mode("overwrite").option("sep", ";").option("header", True).partitionBy("symbol", "timeframe").csv(path)
    if rows.isEmpty():
        spark = rows.sparkSession
        header = spark.createDataFrame([(";".join(c for c in rows.columns if c not in ("symbol", "timeframe")),)], "value string")
        header.coalesce(1).write.mode("overwrite").text(path)


def decimal_comma(df: DataFrame) -> DataFrame:
    """Doubles as text with a decimal comma."""
    as_text = {f.name: F.translate(F.col(f.name).cast("string"), ".", ",") for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    return df.withColumns(as_text) if as_text else df


def write_report(trades: DataFrame, path: str, measures: dict[str, str]) -> None:
    """Summary, detail and audit datasets of a trade report, as ``;``-separated CSV with decimal commas."""
    parts = {"summary": report_totals(trades), "detail": trades, "audit": risk_audit(trades, measures)}
    for name, df in parts.items():
        decimal_comma(df).write.mode("overwrite").option("sep", ";").option("header", True).csv(f"{path}/{name}")


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_new(new: DataFrame, path: str, key: str = "content_hash", order: str = "fetched_at") -> DataFrame:
    """Append the rows whose key is not stored yet; the table is Parquet, additive columns are allowed."""
    spark = new.sparkSession
    existing = spark.read.option("mergeSchema", True).parquet(path) if has_files(spark, path) else new.limit(0)
    fresh = insert_if_new(new, existing, key, order)
    fresh.write.mode("append").parquet(path)
    return fresh
