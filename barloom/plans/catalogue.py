"""Registration of queries with their SQL, and the SQL phrases that many of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, make: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name!r} exists")
    QUERIES[name] = make
    if sql is not None:
        ORACLE[name] = sql


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        register(f.__name__, f, sql)
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (both engines round half away from zero), times as text, ints as long."""
    out: list[Column] = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = F.round(c, digits) + F.lit(0.0)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind in ("int", "smallint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def shown(body: str, doubles: str = "", digits: int = 6, plain: str = "", times: str = "", longs: str = "") -> str:
    """SELECT of ``body``'s columns as ``rounded`` shows them."""
    items = [c.strip() for c in plain.split(",") if c.strip()]
    items += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in map(str.strip, times.split(",")) if c]
    items += [f"CAST({c} AS BIGINT) AS {c}" for c in map(str.strip, longs.split(",")) if c]
    items += [f"round({c}, {digits}) + 0.0 AS {c}" for c in map(str.strip, doubles.split(",")) if c]
    return f"SELECT {', '.join(items)} FROM {body}"


def over(n: int | None = None, after: int = 0, by: str = "symbol", order: str = "bar") -> str:
    """A ROWS frame of the last ``n`` rows (None: all so far)."""
    start = "UNBOUNDED" if n is None else n - 1
    return f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {start} PRECEDING AND {f'{after} FOLLOWING' if after else 'CURRENT ROW'})"


def lag(x: str, k: int = 1, by: str = "symbol", order: str = "bar") -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY {by} ORDER BY {order})"


def full(x: str, n: int, value: str) -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {value} END"


def sma(x: str, n: int) -> str:
    return full(x, n, f"avg({x}) {over(n)}")


def std(x: str, n: int) -> str:
    return full(x, n, f"stddev_samp({x}) {over(n)}")


def rank_of(x: str, n: int) -> str:
    """Percentile rank of x among the n values before."""
    frame = f"OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    less, upto = (f"len(list_filter(list({x}) {frame}, lambda e: e {op} {x}))" for op in ("<", "<="))
    return f"CASE WHEN count({x}) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN {n} PRECEDING AND CURRENT ROW) = {n + 1} THEN ({less} + {upto} + CASE WHEN {upto} > {less} THEN 1 ELSE 0 END) * 50.0 / {n} END"


def ewm(name: str, source: str, series: dict[str, tuple[str, float]]) -> str:
    """Recursive CTE of exponential means: output -> (column of source, alpha); seeded with the first bar."""
    first = ", ".join(f"CAST({x} AS DOUBLE) AS {y}" for y, (x, _) in series.items())
    step = ", ".join(f"{a!r} * s.{x} + (1 - {a!r}) * p.{y}" for y, (x, a) in series.items())
    return f"""{name} AS (
        SELECT symbol, bar, {first} FROM {source} WHERE bar = 0
        UNION ALL SELECT s.symbol, s.bar, {step} FROM {name} p JOIN {source} s ON s.symbol = p.symbol AND s.bar = p.bar + 1)"""


def ema_alpha(n: int) -> float:
    return 2 / (n + 1)


#: Ranges and directional moves of ``bars`` as CTEs.
RANGE_SQL = f"""rng AS MATERIALIZED (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr,
    close - {lag('close')} AS move, high - {lag('high')} AS up, {lag('low')} - low AS down FROM bars),
    moves AS MATERIALIZED (SELECT *, CASE WHEN move > 0 THEN move ELSE 0.0 END AS gain, CASE WHEN move < 0 THEN -move ELSE 0.0 END AS loss,
        CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS plus_dm, CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS minus_dm FROM rng)"""
