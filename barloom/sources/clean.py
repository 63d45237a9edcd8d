"""Cleaning, validation, file loading and range limits for bars."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.sources.bars import OHLC, numbered

#: How many days back each interval is offered.
MAX_DAYS = {"1m": 7, "2m": 60, "5m": 60, "15m": 60, "30m": 60, "90m": 60, "60m": 730, "1h": 730}
INTERVALS = (*MAX_DAYS, "1d", "5d", "1wk", "1mo", "3mo")
TIME_NAMES = ("datetime", "date", "time", "timestamp", "index")


def clean(rows: DataFrame, seq: str | None = None) -> DataFrame:
    """Lower-case names, OHLCV only, one row per (symbol, ts): the last by ``seq``; no null OHLC."""
    rows = rows.toDF(*[c.lower() for c in rows.columns])
    if "symbol" not in rows.columns:
        rows = rows.withColumn("symbol", F.lit("ALL"))
    if "volume" not in rows.columns:
        rows = rows.withColumn("volume", F.lit(0.0))
    last = Window.partitionBy("symbol", "ts").orderBy(F.col((seq or "ts").lower()).desc())
    prices = [F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in (*OHLC, "volume")]
    once = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *prices)
    return numbered(once.na.drop(subset=list(OHLC)))


def violations(bars: DataFrame) -> DataFrame:
    """One row of counts, in one pass: what keeps the bars from being valid."""
    before = F.lag("ts").over(Window.partitionBy("symbol").orderBy("bar"))
    low = F.least("open", "close")
    high = F.greatest("open", "close", "low")
    return bars.withColumn("_before", before).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.least(*OHLC) <= 0).alias("n_not_positive"),
        F.count_if(F.col("high") < high).alias("n_high_too_low"),
        F.count_if(F.col("low") > low).alias("n_low_too_high"),
        F.count_if(F.col("ts") <= F.col("_before")).alias("n_not_ascending"),
    )


def validate(bars: DataFrame) -> DataFrame:
    """``bars``, or ValueError naming the first violation and its count."""
    missing = [c for c in OHLC if c not in bars.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    found = violations(bars).first().asDict()
    if not found.pop("n_rows"):
        raise ValueError("no bars")
    for what, n in found.items():
        if n:
            raise ValueError(f"{what[2:].replace('_', ' ')}: {n} bars")
    return bars


def clamp_range(start: str, end: str, interval: str = "1d") -> tuple[str, bool]:
    """(start, clamped): no earlier than the interval is offered."""
    if interval not in INTERVALS:
        raise ValueError(f"unknown interval {interval!r}; one of {', '.join(INTERVALS)}")
    days = MAX_DAYS.get(interval)
    if days is None:
        return start, False
    first = dt.date.fromisoformat(end[:10]) - dt.timedelta(days=days)
    return (first.isoformat(), True) if dt.date.fromisoformat(start[:10]) < first else (start, False)


def clamped_start(start: Column, end: Column, interval: Column) -> tuple[Column, Column]:
    """``clamp_range`` for columns of dates: (start, whether it was moved)."""
    offered = F.create_map(*[F.lit(x) for pair in MAX_DAYS.items() for x in pair])
    first = F.date_sub(end, F.element_at(offered, interval))
    moved = F.coalesce(start < first, F.lit(False))
    return F.when(moved, first).otherwise(start), moved


def load_csv(spark: SparkSession, path: str, symbol: str = "ALL") -> DataFrame:
    """First column the time, then named OHLCV columns; cleaned and validated."""
    raw = spark.read.csv(path, header=True, inferSchema=True)
    raw = raw.withColumnRenamed(raw.columns[0], "ts").withColumn("symbol", F.lit(symbol))
    return validate(clean(raw.withColumn("_seq", F.monotonically_increasing_id()), "_seq"))


def load_file(spark: SparkSession, path: str, symbol: str = "ALL") -> DataFrame:
    """CSV or parquet with loosely named columns: ``close``, ``aapl_close`` and ``close_aapl`` are
    all close; the time column by name, else the first; no volume is 0. Not validated."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)
    names = {c: re.sub(r"\s+", "_", c.strip().lower()) for c in raw.columns}
    time = next((c for c in raw.columns if names[c] in TIME_NAMES), raw.columns[0])
    found = {}
    for want in (*OHLC, "volume"):
        match = [c for c in raw.columns if names[c] == want or names[c].endswith("_" + want) or names[c].startswith(want + "_")]
        if match:
            found[want] = F.col(f"`{match[0]}`").cast("double").alias(want)
        elif want != "volume":
            raise ValueError(f"no column for {want}")
    volume = found.pop("volume", F.lit(0.0).alias("volume"))
    rows = raw.select(F.lit(symbol).alias("symbol"), F.col(f"`{time}`").cast("timestamp_ntz").alias("ts"), *found.values(), volume)
    return numbered(rows.na.drop(subset=list(OHLC)))
