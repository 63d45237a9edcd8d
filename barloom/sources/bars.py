"""Bar tables: (symbol, ts, open, high, low, close, volume, bar).

``bar`` numbers a symbol's rows from 0 in order of ``ts``. Undefined values are NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OHLC = ("open", "high", "low", "close")



def numbered(df: DataFrame) -> DataFrame:
    """With ``bar``, the row's number within its symbol."""
    return df.withColumn("bar", (F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1).cast("long"))


def from_trades(df: DataFrame, symbol: Column, ts: Column, price: Column, order: Column, volume: Column) -> DataFrame:
    """Bars of any trade-like table: first and last price by ``order`` within (symbol, ts)."""
    rows = df.select(symbol.alias("symbol"), ts.alias("ts"), price.alias("p"), order.alias("o"), volume.alias("v"))
    bars = rows.groupBy("symbol", "ts").agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"),
        F.max_by("p", "o").alias("close"), F.sum("v").cast("double").alias("volume"),
    )
    return numbered(bars)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as one symbol, a bar per order date."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return from_trades(o, F.lit("ALL"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"), F.lit(1))


def by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the priority as symbol."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return from_trades(o, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"), F.lit(1))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive event values by hour and event type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value > 0")
    return from_trades(e, F.col("event_type"), F.date_trunc("hour", "ts").cast("timestamp_ntz"), F.col("value"), F.struct("ts", "event_id"), F.lit(1))


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit prices of line items by ship date; ties within a date by the line's key."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return from_trades(li, F.lit("SHIP"), F.col("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), order, F.col("l_quantity"))


def _sql(table: str, symbol: str, ts: str, price: str, order: str, volume: str, where: str = "true") -> str:
    return f"""trades AS (SELECT {symbol} AS symbol, {ts} AS ts, {price} AS p, {order} AS o, {volume} AS v FROM {table} WHERE {where}),
    bars AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar FROM (
        SELECT symbol, ts, arg_min(p, o) AS open, max(p) AS high, min(p) AS low, arg_max(p, o) AS close, CAST(sum(v) AS DOUBLE) AS volume
        FROM trades GROUP BY symbol, ts))"""


#: The same bars as common table expressions named ``bars``.
DAILY_SQL = _sql("orders", "'ALL'", "o_orderdate", "o_totalprice", "o_orderkey", "1")
PRIORITY_SQL = _sql("orders", "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey", "1")
HOURLY_SQL = _sql("events", "event_type", "date_trunc('hour', ts)", "value", "(ts, event_id)", "1", "value > 0")
SHIP_SQL = _sql("lineitem", "'SHIP'", "l_shipdate", "l_extendedprice / l_quantity", "(l_orderkey, l_linenumber, l_partkey, l_extendedprice)", "l_quantity")
