"""Building blocks of the checking SQL (DuckDB dialect)."""

from __future__ import annotations


def rnd(expr: str, dp: int = 4) -> str:
    scale = f"1e{dp}"
    return f"floor(({expr})::DOUBLE*{scale}+0.5000001)/{scale}"


def cols(names: str, dp: int = 4) -> str:
    return ", ".join(f"{rnd(n, dp)} AS {n}" for n in names.split())


def event_bars(seconds: int = 3600, name: str = "bars") -> str:
    return f"""{name}_raw AS (
  SELECT event_type AS symbol, make_timestamp((epoch_us(ts) // {seconds * 1000000}) * {seconds * 1000000}) AS tb,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, count(*)::BIGINT AS tick_volume
  FROM events GROUP BY 1, 2),
{name} AS (SELECT symbol, tb AS ts, open, high, low, close, tick_volume,
    row_number() OVER (PARTITION BY symbol ORDER BY tb) - 1 AS bar_idx, count(*) OVER (PARTITION BY symbol) AS n_bars FROM {name}_raw)"""


def order_bars(name: str = "bars") -> str:
    return f"""{name}_raw AS (
  SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS tb,
         first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
         last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close, count(*)::BIGINT AS tick_volume
  FROM orders GROUP BY 1, 2),
{name} AS (SELECT symbol, tb AS ts, open, high, low, close, tick_volume,
    row_number() OVER (PARTITION BY symbol ORDER BY tb) - 1 AS bar_idx, count(*) OVER (PARTITION BY symbol) AS n_bars FROM {name}_raw)"""


def h1(*ctes: str, select: str, windows: str = "") -> str:
    return "WITH RECURSIVE " + ",\n".join([event_bars(), *ctes]) + "\n" + select + windows


def d1(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([order_bars(), *ctes]) + "\n" + select


S = "PARTITION BY symbol ORDER BY bar_idx"


def frame(start: int, end: int) -> str:
    """Row frame of a series, as OVER clause."""
    edge = lambda n: "CURRENT ROW" if n == 0 else (f"{-n} PRECEDING" if n < 0 else f"{n} FOLLOWING")
    return f"OVER ({S} ROWS BETWEEN {edge(start)} AND {edge(end)})"


ALL = f"OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def decay(name: str, source: str, src: str, period: int, gain: str, start: int = 0) -> str:
    """Recursive mean seeded with the average of the first ``period`` values; gives (symbol, bar_idx, y)."""
    return f"""{name}_in AS MATERIALIZED (SELECT symbol, bar_idx, ({src})::DOUBLE AS x,
    avg(({src})::DOUBLE) OVER ({S} ROWS BETWEEN {period - 1} PRECEDING AND CURRENT ROW) AS seed FROM {source}),
{name} AS (SELECT symbol, bar_idx, seed AS y FROM {name}_in WHERE bar_idx = {start + period - 1}
  UNION ALL SELECT i.symbol, i.bar_idx, e.y + {gain} * (i.x - e.y) FROM {name} e JOIN {name}_in i ON i.symbol = e.symbol AND i.bar_idx = e.bar_idx + 1)"""


def ema(name: str, source: str, src: str, period: int, start: int = 0) -> str:
    return decay(name, source, src, period, f"(2.0::DOUBLE/{period + 1})", start)


def wilder(name: str, source: str, src: str, period: int, start: int = 0) -> str:
    return decay(name, source, src, period, f"(1.0::DOUBLE/{period})", start)


TR = f"greatest(high-low, abs(high - lag(close) OVER ({S})), abs(low - lag(close) OVER ({S})))"


def tr_cte(source: str = "bars", name: str = "trs") -> str:
    return f"{name} AS (SELECT *, {TR} AS tr FROM {source})"


def atr_ctes(period: int, name: str = "atr", source: str = "bars") -> str:
    return tr_cte(source, f"{name}_tr") + ",\n" + wilder(name, f"{name}_tr", "tr", period)


def join_y(source: str, *names: str) -> str:
    """LEFT JOIN recursive results as <name>.y."""
    return source + "".join(f" LEFT JOIN {n} USING (symbol, bar_idx)" for n in names)
