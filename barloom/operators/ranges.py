"""Joins of bars with the bars of a range behind them, by buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def behind(bars: DataFrame, reach: int, x: str) -> DataFrame:
    """(symbol, bar, v, other): each bar's x with that of every bar up to ``reach`` before it.

    Bars are dealt to buckets of ``reach``: what a bar looks back at is in its own bucket or the one before. So the
    join has keys (symbol, bucket), no nested loop, and a symbol of any length is as many keys as it has buckets.
    """
    bucket = F.floor(F.col("bar") / reach)
    asks = bars.select("symbol", "bar", F.col(x).alias("v"), F.explode(F.array(bucket, bucket - 1)).alias("bucket"))
    given = bars.select("symbol", F.col("bar").alias("at"), F.col(x).alias("other"), bucket.alias("bucket"))
    return asks.join(given, ["symbol", "bucket"]).where((F.col("at") < F.col("bar")) & (F.col("at") >= F.col("bar") - reach)).select("symbol", "bar", "v", "other")


def percentile_rank(bars: DataFrame, x: str, lookback: int) -> DataFrame:
    """(symbol, bar, rank): as ``Plan.percentile_rank``, counted by a range join; partial counts meet for each bar."""
    counted = behind(bars, lookback, x).groupBy("symbol", "bar", "v").agg(
        F.count("other").alias("n"), F.count_if(F.col("other") < F.col("v")).alias("less"), F.count_if(F.col("other") <= F.col("v")).alias("upto")
    )
    rank = (F.col("less") + F.col("upto") + (F.col("upto") > F.col("less")).cast("int")) * F.lit(50.0) / lookback
    ranked = counted.where((F.col("n") == lookback) & F.col("v").isNotNull()).select("symbol", "bar", rank.alias("rank"))
    return bars.select("symbol", "bar").join(ranked, ["symbol", "bar"], "left")
