"""Calendar seasonality of returns, as grouped aggregates over one daily frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import stats as S
from barloom.functions.windows import ratio


def last_per(bars: DataFrame, unit: str) -> DataFrame:
    """(symbol, ts, close): the last non-null close of each day, hour, month; empty ones don't exist."""
    at = F.date_trunc(unit, F.col("ts")).cast("timestamp_ntz")
    return bars.where("close IS NOT NULL").groupBy("symbol", at.alias("ts")).agg(F.max_by("close", "ts").alias("close"))


def returns(bars: DataFrame, unit: str = "day") -> DataFrame:
    """(symbol, ts, r): percent change of the last closes."""
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))
    return last_per(bars, unit).select("symbol", "ts", ((ratio(F.col("close"), before) - 1) * 100).alias("r")).where("r IS NOT NULL")


def with_year_days(rs: DataFrame) -> DataFrame:
    """With tpy: 365 where any return falls on a weekend, else 252."""
    weekend = F.max((F.weekday("ts") >= 5).cast("int")).over(Window.partitionBy("symbol"))
    return rs.withColumn("tpy", F.when(weekend == 1, 365).otherwise(252))


def is_intraday(bars: DataFrame) -> DataFrame:
    """(symbol, intraday): median spacing below a day, from three bars on."""
    before = F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts"))
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1e6
    g = bars.withColumn("_g", gap).groupBy("symbol").agg(F.percentile("_g", 0.5).alias("_m"), F.count("*").alias("_n"))
    return g.select("symbol", F.coalesce((F.col("_n") >= 3) & (F.col("_m") < 86400), F.lit(False)).alias("intraday"))


def _bucket_aggregates(tpy: Column) -> list[Column]:
    n, r = F.count("r"), F.col("r")
    mean, std = F.avg("r"), F.coalesce(F.stddev_samp("r"), F.lit(0.0))
    down = F.when(r < 0, r)
    low, high = S.wilson(F.count_if(r > 0), n)
    return [
        n.alias("n"), mean.alias("mean"), F.percentile("r", 0.5).alias("median"), std.alias("std"), (F.count_if(r > 0) / n * 100).alias("win_rate"),
        low.alias("ci_low"), high.alias("ci_high"), F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_pos"), F.coalesce(F.avg(F.when(r <= 0, r)), F.lit(0.0)).alias("avg_neg"),
        F.max("r").alias("best"), F.min("r").alias("worst"), F.sum("r").alias("total"),
        S.if_positive(std, mean / F.nullif(std, F.lit(0.0)) * F.sqrt(tpy)).alias("sharpe"),
        S.if_positive(F.stddev_samp(down), mean / F.nullif(F.stddev_samp(down), F.lit(0.0)) * F.sqrt(tpy)).alias("sortino"),
        F.when((n > 1) & (std > 0), mean / F.nullif(std, F.lit(0.0)) * F.sqrt(n)).otherwise(0.0).alias("t_stat"),
    ]


def bucket_stats(rs: DataFrame, bucket: Column, p_values: bool = True) -> DataFrame:
    """Every figure per (symbol, bucket); ``rs`` has tpy."""
    out = rs.withColumn("bucket", bucket).groupBy("symbol", "bucket").agg(*_bucket_aggregates(F.max("tpy")))
    if not p_values:
        return out
    p = F.when((F.col("n") > 1) & (F.col("std") > 0), S.t_p_value(F.col("t_stat"), (F.col("n") - 1).cast("double"))).otherwise(1.0)
    return out.withColumn("p_value", p).withColumn("stars", S.stars(F.col("p_value")))


def day_of_week(bars: DataFrame, **how) -> DataFrame:
    return bucket_stats(with_year_days(returns(bars)), F.weekday("ts"), **how)


def by_month(bars: DataFrame, **how) -> DataFrame:
    return bucket_stats(returns(bars, "month").withColumn("tpy", F.lit(12)), F.month("ts"), **how)


def by_quarter(bars: DataFrame, **how) -> DataFrame:
    return bucket_stats(with_year_days(returns(bars)), F.quarter("ts"), **how)


def day_of_month(bars: DataFrame, **how) -> DataFrame:
    return bucket_stats(with_year_days(returns(bars)), F.dayofmonth("ts"), **how)


def by_hour(bars: DataFrame, **how) -> DataFrame:
    """Only symbols with intraday bars."""
    rs = returns(bars, "hour").join(is_intraday(bars).where("intraday"), "symbol").drop("intraday")
    return bucket_stats(with_year_days(rs), F.hour("ts"), **how)


def by_year(bars: DataFrame) -> DataFrame:
    """Years of two returns or more: compounded return, drawdown within the year, ratios."""
    rs = with_year_days(returns(bars)).withColumn("year", F.year("ts"))
    order = Window.partitionBy("symbol", "year").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rs = rs.withColumn("_c", F.product(1 + F.col("r") / 100).over(order)).withColumn("_p", F.max("_c").over(order))
    low, high = S.wilson(F.count_if(F.col("r") > 0), F.count("r"))
    mean, std, tpy = F.avg("r"), F.stddev_samp("r"), F.max("tpy")
    dsd = F.stddev_samp(F.when(F.col("r") < 0, F.col("r")))
    return rs.groupBy("symbol", "year").agg(
        F.count("r").alias("n"), ((F.max_by("_c", "ts") - 1) * 100).alias("total_return"), mean.alias("mean"), std.alias("std"),
        (F.count_if(F.col("r") > 0) / F.count("r") * 100).alias("win_rate"), low.alias("ci_low"), high.alias("ci_high"),
        (F.min(ratio(F.col("_c") - F.col("_p"), F.col("_p"))) * 100).alias("max_drawdown"),
        S.if_positive(std, mean / F.nullif(std, F.lit(0.0)) * F.sqrt(tpy)).alias("sharpe"), S.if_positive(dsd, mean / F.nullif(dsd, F.lit(0.0)) * F.sqrt(tpy)).alias("sortino"),
    ).where("n >= 2")


def heat(rs: DataFrame, a: Column, b: Column) -> DataFrame:
    """Mean return per cell, long; ``pivot`` makes it wide."""
    return rs.groupBy("symbol", a.alias("a"), b.alias("b")).agg(F.avg("r").alias("mean"), F.count("*").alias("n"))


def pivot(cells: DataFrame, names: list) -> DataFrame:
    return cells.groupBy("symbol", "a").pivot("b", names).agg(F.first("mean"))


def month_heatmap(bars: DataFrame) -> DataFrame:
    return heat(returns(bars, "month"), F.year("ts"), F.month("ts"))


def year_by_weekday(bars: DataFrame) -> DataFrame:
    return heat(returns(bars), F.year("ts"), F.weekday("ts"))


def weekday_by_hour(bars: DataFrame) -> DataFrame:
    rs = returns(bars, "hour").join(is_intraday(bars).where("intraday"), "symbol")
    return heat(rs, F.weekday("ts"), F.hour("ts"))


def kruskal(rs: DataFrame, bucket: Column) -> DataFrame:
    """(symbol, groups, n, h, p): rank test over buckets of three or more, corrected for ties."""
    g = rs.withColumn("g", bucket)
    g = g.withColumn("_m", F.count("*").over(Window.partitionBy("symbol", "g"))).where("_m >= 3")
    ties = F.count("*").over(Window.partitionBy("symbol", "r"))
    g = g.withColumn("_t", ties).withColumn("_rank", F.rank().over(Window.partitionBy("symbol").orderBy("r")) + (F.col("_t") - 1) / 2)
    each = g.groupBy("symbol", "g").agg(F.count("*").alias("n"), F.sum("_rank").alias("rs"), F.sum(F.col("_t") * F.col("_t") - 1).alias("tie"))
    n = F.sum("n")
    all_ = each.groupBy("symbol").agg(F.count("*").alias("groups"), n.alias("n"), F.sum(F.col("rs") * F.col("rs") / F.col("n")).alias("_s"), F.sum("tie").alias("_tie")).where("groups >= 2")
    nn = F.col("n").cast("double")
    h = (12 / (nn * (nn + 1)) * F.col("_s") - 3 * (nn + 1)) / F.nullif(1 - F.col("_tie") / (nn * nn * nn - nn), F.lit(0.0))
    out = all_.select("symbol", "groups", "n", h.alias("h"))
    return out.withColumn("p", S.chi2_p_value(F.col("h"), (F.col("groups") - 1).cast("double")))


def distribution(bars: DataFrame, bins: int = 40) -> DataFrame:
    """One row a symbol: moments, tail risk, Jarque-Bera."""
    rs = returns(bars)
    cut = rs.groupBy("symbol").agg(F.percentile("r", 0.05).alias("var_95"), F.percentile("r", 0.01).alias("var_99"))
    n, g1, g2 = F.count("r"), F.skewness("r"), F.kurtosis("r")
    jb = F.when(n >= 8, n / 6.0 * (g1 * g1 + g2 * g2 / 4)).otherwise(0.0)
    return rs.join(cut, "symbol").groupBy("symbol").agg(
        n.alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), S.unbiased_skew("r").alias("skew"), S.unbiased_kurtosis("r").alias("kurtosis"),
        (F.count_if(F.col("r") > 0) / n * 100).alias("pct_positive"), F.max("var_95").alias("var_95"), F.max("var_99").alias("var_99"),
        F.avg(F.when(F.col("r") <= F.col("var_95"), F.col("r"))).alias("cvar_95"), jb.alias("jarque_bera"), F.exp(-jb / 2).alias("jarque_bera_p"),
    )


def histogram(rs: DataFrame, value: str, bins: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(…, bin, left, right, n): equal bins from least to greatest, the last one closed; empty bins aren't listed."""
    span = rs.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    width = (F.col("_b") - F.col("_a")) / bins
    at = F.least(F.floor((F.col(value) - F.col("_a")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    out = rs.where(F.col(value).isNotNull()).join(span, list(by)).withColumn("bin", F.coalesce(at, F.lit(0)).cast("long"))
    return out.groupBy(*by, "bin").agg(F.min(F.col("_a") + F.col("bin") * width).alias("left"), F.min(F.col("_a") + (F.col("bin") + 1) * width).alias("right"), F.count("*").alias("n"))


def streaks(rs: DataFrame) -> DataFrame:
    """(symbol, max and mean win and loss streaks, current: negative while losing); 0 counts as a loss."""
    order = Window.partitionBy("symbol").orderBy("ts")
    s = rs.withColumn("_w", (F.col("r") > 0).cast("int"))
    s = s.withColumn("_i", F.row_number().over(order) - F.row_number().over(Window.partitionBy("symbol", "_w").orderBy("ts")))
    runs = s.groupBy("symbol", "_w", "_i").agg(F.count("*").alias("n"), F.max("ts").alias("_end"))
    some = lambda f, w: F.coalesce(f(F.when(F.col("_w") == w, F.col("n"))), F.lit(0))
    return runs.groupBy("symbol").agg(
        some(F.max, 1).alias("max_win"), some(F.max, 0).alias("max_loss"), some(F.avg, 1).alias("avg_win"), some(F.avg, 0).alias("avg_loss"),
        F.max_by(F.when(F.col("_w") == 1, F.col("n")).otherwise(-F.col("n")), "_end").alias("current"),
    )


def autocorrelation(rs: DataFrame, lags: int = 10) -> DataFrame:
    """(symbol, lag, acf, band): demeaned products over the lag-0 sum, from ``lags`` + 10 returns on."""
    order = Window.partitionBy("symbol").orderBy("ts")
    whole = Window.partitionBy("symbol")
    d = rs.withColumn("_d", F.col("r") - F.avg("r").over(whole))
    d = d.withColumns({f"_p{k}": F.col("_d") * F.lag("_d", k).over(order) for k in range(1, lags + 1)})
    sums = d.groupBy("symbol").agg(F.count("*").alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("_v"), *[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)).alias(f"_s{k}") for k in range(1, lags + 1)])
    sums = sums.where((F.col("n") >= lags + 10) & (F.col("_v") >= 1e-12))
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"_s{k}") / F.col("_v")).alias("acf")) for k in range(1, lags + 1)]))
    return sums.select("symbol", "n", cells.alias("_c")).select("symbol", "n", "_c.*", (1.96 / F.sqrt("n")).alias("band")).withColumn("flagged", F.abs("acf") > F.col("band"))


def ljung_box(acf: DataFrame, lags: int = 10) -> DataFrame:
    q = F.max("n") * (F.max("n") + 2) * F.sum(F.col("acf") * F.col("acf") / F.greatest(F.col("n") - F.col("lag"), F.lit(1)))
    return acf.groupBy("symbol").agg(q.alias("q")).withColumn("p", S.chi2_tail_even(F.col("q"), lags))


def summary(stats_: DataFrame, per_year: Column) -> DataFrame:
    """Best and worst bucket by mean, their win rates and annual means."""
    best, worst = "mean", "mean"
    return stats_.groupBy("symbol").agg(
        F.max_by("bucket", best).alias("best"), F.max("mean").alias("best_mean"), F.max_by("win_rate", best).alias("best_win_rate"), (F.max("mean") * per_year).alias("best_year"),
        F.min_by("bucket", worst).alias("worst"), F.min("mean").alias("worst_mean"), F.min_by("win_rate", worst).alias("worst_win_rate"), (F.min("mean") * per_year).alias("worst_year"),
    )


def trade_calendar(trades: DataFrame, bucket: Column) -> DataFrame:
    """Trades by when they were entered."""
    low, high = S.wilson(F.count_if(F.col("pnl") > 0), F.count("*"))
    return trades.groupBy("symbol", bucket.alias("bucket")).agg(
        F.count("*").alias("n"), (F.count_if(F.col("pnl") > 0) / F.count("*") * 100).alias("win_rate"), low.alias("ci_low"), high.alias("ci_high"),
        F.avg("pnl").alias("avg_pnl"), F.avg("pnl_pct").alias("avg_pnl_pct"), F.sum("pnl").alias("total_pnl"),
    )


def analyze(bars: DataFrame) -> dict[str, DataFrame]:
    """The whole bundle, over one cached frame of daily closes (``daily``: its unpersist() releases it)."""
    daily = last_per(bars, "day").persist()
    rs = returns(daily)
    acf = autocorrelation(rs)
    return {
        "daily": daily, "day_of_week": day_of_week(daily), "kruskal": kruskal(rs, F.weekday("ts")), "month": by_month(daily), "month_heatmap": month_heatmap(daily),
        "quarter": by_quarter(daily), "year": by_year(daily), "year_by_weekday": year_by_weekday(daily), "day_of_month": day_of_month(daily),
        "hour": by_hour(bars), "weekday_by_hour": weekday_by_hour(bars), "distribution": distribution(daily), "histogram": histogram(rs, "r", 40),
        "streaks": streaks(rs), "autocorrelation": acf, "ljung_box": ljung_box(acf), "summary": summary(day_of_week(daily, p_values=False), F.lit(252)),
    }
