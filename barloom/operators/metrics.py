"""Performance figures as plain aggregates over trades and equity rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import ratio

GROUP = ("symbol", "param_id")
CAP = 999.99


def bars_per_year(bars: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(symbol, bars_per_year) from the median spacing of the bars."""
    # fixed values: upper bounds in seconds and the bars a year they stand for
    steps = ((120, 98280), (600, 19656), (1800, 6552), (3600, 3276), (7200, 1764), (2 * 86400, 252), (10 * 86400, 52))
    before = F.lag("ts").over(Window.partitionBy(*by).orderBy("ts"))
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1e6
    median = bars.withColumn("_gap", gap).groupBy(*by).agg(F.percentile("_gap", 0.5).alias("_gap"))
    n = F.lit(12)
    for bound, per_year in reversed(steps):
        n = F.when(F.col("_gap") <= bound, per_year).otherwise(n)
    return median.select(*by, F.when(F.col("_gap").isNull(), 252).otherwise(n).cast("long").alias("bars_per_year"))


def _or0(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def _capped(gain: Column, loss: Column) -> Column:
    """gain / loss, at most ``CAP``; ``CAP`` without loss, 0 without either."""
    return F.when(loss > 0, F.least(gain / F.nullif(loss, F.lit(0.0)), F.lit(CAP))).when(gain > 0, CAP).otherwise(0.0)


def trade_stats(trades: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Counts, rates and means of trades."""
    win, lose = F.col("pnl") > 0, F.col("pnl") <= 0
    run = trades.withColumn("_win", win.cast("int"))
    order = Window.partitionBy(*by).orderBy("trade_no")
    run = run.withColumn("_island", F.row_number().over(order) - F.row_number().over(Window.partitionBy(*by, "_win").orderBy("trade_no")))
    runs = run.groupBy(*by, "_win", "_island").agg(F.count("*").alias("_n")).groupBy(*by).agg(
        F.coalesce(F.max(F.when(F.col("_win") == 0, F.col("_n"))), F.lit(0)).alias("max_consecutive_losses"),
        F.coalesce(F.max(F.when(F.col("_win") == 1, F.col("_n"))), F.lit(0)).alias("max_consecutive_wins"),
    )
    mean = lambda c, x: _or0(F.avg(F.when(c, F.col(x))))
    agg = trades.groupBy(*by).agg(
        F.count("*").alias("num_trades"), F.count_if(win).alias("winners"), F.count_if(lose).alias("losers"),
        _or0(F.sum(F.when(win, F.col("pnl")))).alias("_gp"), F.abs(_or0(F.sum(F.when(lose, F.col("pnl"))))).alias("_gl"),
        mean(win, "pnl").alias("avg_winner"), mean(lose, "pnl").alias("avg_loser"),
        mean(win, "pnl_pct").alias("avg_winner_pct"), mean(lose, "pnl_pct").alias("avg_loser_pct"),
        F.avg("pnl").alias("avg_trade"), F.avg("bars_held").alias("avg_bars_held"), F.avg("mae").alias("avg_mae"), F.avg("mfe").alias("avg_mfe"),
    )
    rate = F.col("winners") / F.col("num_trades")
    lost = F.abs(F.col("avg_loser"))
    return agg.withColumns({
        "win_rate": rate * 100,
        "profit_factor": _capped(F.col("_gp"), F.col("_gl")),
        "payoff_ratio": F.when(lost != 0, F.least(F.col("avg_winner") / F.nullif(lost, F.lit(0.0)), F.lit(CAP))).otherwise(CAP),
        "expectancy": rate * F.col("avg_winner") - (1 - rate) * lost,
    }).drop("_gp", "_gl").join(runs, list(by))


def equity_stats(equity: DataFrame, capital: float, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Returns, drawdowns and risk ratios; ``equity`` has bars_per_year."""
    order = Window.partitionBy(*by).orderBy("bar")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    e = equity.withColumns({"_peak": F.max("mtm_equity").over(so_far), "_r": ratio(F.col("mtm_equity"), F.lag("mtm_equity").over(order)) - 1})
    e = e.withColumn("_dd", F.col("mtm_equity") - F.col("_peak"))
    e = e.withColumn("_spell", F.sum((F.col("_dd") >= 0).cast("int")).over(so_far))
    spells = e.groupBy(*by, "_spell").agg(F.count_if(F.col("_dd") < 0).alias("_n")).groupBy(*by).agg(F.max("_n").alias("longest_drawdown_bars"))
    active = F.when(F.col("in_position"), F.col("_r"))
    down = F.when(active < 0, active)
    agg = e.groupBy(*by).agg(
        F.max_by("mtm_equity", "bar").alias("final_equity"), F.count("*").alias("n_bars"), F.max("bars_per_year").alias("bars_per_year"),
        F.min("_dd").alias("max_drawdown"), (F.min(ratio(F.col("_dd"), F.col("_peak"))) * 100).alias("max_drawdown_pct"),
        F.count("_r").alias("_n"), F.count(active).alias("_na"), F.avg(active).alias("_mean"), F.stddev_samp(active).alias("_sd"),
        F.count(down).alias("_nd"), F.stddev_samp(down).alias("_dsd"), (F.avg(F.col("in_position").cast("int")) * 100).alias("pct_time_in_market"),
    )
    year = F.sqrt(F.when((F.col("_n") > 0) & (F.col("_na") > 0), F.col("_na") * F.col("bars_per_year") / F.nullif(F.col("_n"), F.lit(0))).otherwise(F.col("bars_per_year")))
    sharpe = F.when((F.col("_na") > 1) & (F.col("_sd") > 0), F.col("_mean") / F.nullif(F.col("_sd"), F.lit(0.0)) * year).otherwise(0.0)
    growth = F.pow(F.greatest(F.col("final_equity"), F.lit(1e-300)) / capital, F.col("bars_per_year") / F.col("n_bars"))
    agg = agg.withColumns({
        "total_return": F.col("final_equity") - capital,
        "total_return_pct": (F.col("final_equity") - capital) / capital * 100,
        "cagr": F.when((F.col("n_bars") > 1) & (F.col("final_equity") > 0), (growth - 1) * 100).otherwise(0.0),
        "sharpe_ratio": sharpe,
        "sortino_ratio": F.when((F.col("_nd") > 1) & (F.col("_dsd") > 0), F.col("_mean") / F.nullif(F.col("_dsd"), F.lit(0.0)) * year).otherwise(sharpe),
    })
    agg = agg.withColumn("calmar_ratio", F.coalesce(F.abs(ratio(F.col("cagr"), F.col("max_drawdown_pct"))), F.lit(0.0)))
    return agg.drop("_n", "_na", "_mean", "_sd", "_nd", "_dsd").join(spells, list(by))


def metrics(trades: DataFrame, equity: DataFrame, per_year: DataFrame, capital: float, by: tuple[str, ...] = GROUP) -> DataFrame:
    """One row per group; a group without trades has zeros but its final equity."""
    e = equity_stats(equity.join(per_year, [c for c in by if c in per_year.columns]), capital, by)
    t = trade_stats(trades, by)
    both = e.join(t, list(by), "left")
    fixed = {"final_equity", "n_bars", "bars_per_year", *by}
    none = F.col("num_trades").isNull()
    kind = dict(both.dtypes)
    return both.select(*[F.col(c) if c in fixed else F.when(none, F.lit(0).cast(kind[c])).otherwise(F.col(c)).alias(c) for c in both.columns])


def direction_split(trades: DataFrame) -> DataFrame:
    """Per group and side, also where a side never traded."""
    sides = trades.select(*GROUP).distinct().withColumn("direction", F.explode(F.array(F.lit("long"), F.lit("short"))))
    win = F.col("pnl") > 0
    found = trades.groupBy(*GROUP, "direction").agg(
        F.count("*").alias("n"), (F.avg(win.cast("int")) * 100).alias("win_rate"),
        _capped(_or0(F.sum(F.when(win, F.col("pnl")))), F.abs(_or0(F.sum(F.when(~win, F.col("pnl")))))).alias("profit_factor"), F.avg("pnl_pct").alias("avg_pnl_pct"),
    )
    both = sides.join(found, [*GROUP, "direction"], "left")
    return both.select(*GROUP, "direction", F.coalesce("n", F.lit(0)).alias("n"), *[_or0(F.col(c)).alias(c) for c in ("win_rate", "profit_factor", "avg_pnl_pct")])


def period_stats(trades: DataFrame, period: str) -> DataFrame:
    """By the month or quarter in which trades end."""
    start = F.date_trunc(period, "exit_ts")
    label = F.date_format(start, "yyyy-MM") if period == "month" else F.concat(F.year(start).cast("string"), F.lit("Q"), F.quarter(start).cast("string"))
    win = F.col("pnl") > 0
    return trades.withColumn("period", label).groupBy(*GROUP, "period").agg(
        F.count("*").alias("n"), (F.avg(win.cast("int")) * 100).alias("win_rate"),
        _capped(_or0(F.sum(F.when(win, F.col("pnl")))), F.abs(_or0(F.sum(F.when(~win, F.col("pnl")))))).alias("profit_factor"), F.sum("pnl_pct").alias("sum_pnl_pct"),
    )


def curve_stats(curve: DataFrame, value: str = "value", by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Return, growth, drawdown and Sharpe of any curve (bar, value, bars_per_year): active where the return isn't 0."""
    order = Window.partitionBy(*by).orderBy("bar")
    c = curve.withColumns({"_r": ratio(F.col(value), F.lag(value).over(order)) - 1, "_peak": F.max(value).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    active = F.when(F.col("_r") != 0, F.col("_r"))
    agg = c.groupBy(*by).agg(
        F.min_by(value, "bar").alias("_a"), F.max_by(value, "bar").alias("_b"), F.count("*").alias("_n"), F.max("bars_per_year").alias("_y"),
        (F.min(ratio(F.col(value) - F.col("_peak"), F.col("_peak"))) * 100).alias("max_drawdown_pct"),
        F.count("_r").alias("_nr"), F.count(active).alias("_na"), F.avg(active).alias("_mean"), F.stddev_samp(active).alias("_sd"),
    )
    sharpe = F.col("_mean") / F.nullif(F.col("_sd"), F.lit(0.0)) * F.sqrt(F.col("_na") * F.col("_y") / F.col("_nr"))
    return agg.select(
        *by, (ratio(F.col("_b"), F.col("_a")) * 100 - 100).alias("total_return_pct"),
        F.when((F.col("_n") > 1) & (F.col("_a") > 0) & (F.col("_b") > 0), (F.pow(F.col("_b") / F.nullif(F.col("_a"), F.lit(0.0)), F.col("_y") / F.col("_n")) - 1) * 100).otherwise(0.0).alias("cagr"),
        "max_drawdown_pct", F.when((F.col("_na") > 1) & (F.col("_sd") > 0), sharpe).otherwise(0.0).alias("sharpe"),
    )


def check_aligned(*frames: DataFrame, on: tuple[str, ...] = ("symbol", "ts")) -> None:
    """ValueError unless all frames have the same times (each as often): one job over their keys."""
    marks = [f.select(*on, *[F.lit(int(i == k)).alias(f"_n{k}") for k in range(len(frames))]) for i, f in enumerate(frames)]
    counts = reduce(DataFrame.unionByName, marks).groupBy(*on).agg(*[F.sum(f"_n{k}").alias(f"_n{k}") for k in range(len(frames))])
    differs = reduce(lambda a, b: a | b, [F.col("_n0") != F.col(f"_n{k}") for k in range(1, len(frames))], F.lit(False))
    sums = counts.agg(F.count_if(differs).alias("bad"), *[F.coalesce(F.sum(f"_n{k}"), F.lit(0)).alias(f"_n{k}") for k in range(len(frames))]).first()
    if sums["bad"]:
        raise ValueError(f"the series aren't on the same times: {[sums[f'_n{k}'] for k in range(len(frames))]} rows, {sums['bad']} times differ")


def aligned(a: DataFrame, b: DataFrame, on: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Inner join of two series on time, without nulls."""
    return a.join(b, list(on)).na.drop()


def beta_alpha(pairs: DataFrame, mine: str, market: str, by: tuple[str, ...] = ("symbol",), year: int = 252) -> DataFrame:
    """beta, annual alpha in percent and correlation of two return columns; zeros under ten pairs."""
    both = pairs.where(F.col(mine).isNotNull() & F.col(market).isNotNull())
    agg = both.groupBy(*by).agg(F.count("*").alias("n"), F.covar_samp(mine, market).alias("_c"), F.var_samp(market).alias("_v"), F.avg(mine).alias("_m"), F.avg(market).alias("_b"), F.corr(mine, market).alias("_r"))
    beta = _or0(ratio(F.col("_c"), F.col("_v")))
    enough = lambda x: F.when(F.col("n") >= 10, x).otherwise(0.0)
    return agg.select(*by, "n", enough(beta).alias("beta"), enough((F.col("_m") - beta * F.col("_b")) * year * 100).alias("alpha"), enough(_or0(F.col("_r"))).alias("correlation"))


def buy_and_hold(bars: DataFrame, equity: DataFrame, trades: DataFrame | None = None) -> DataFrame:
    """Close against equity on common times, scaled to the equity's start: from the beginning, or from the first entry."""
    e = equity.select("symbol", "ts", F.col("mtm_equity").alias("equity"))
    both = aligned(e, bars.select("symbol", "ts", "bar", "close"))
    if trades is not None:
        first = trades.groupBy("symbol").agg(F.min("entry_ts").alias("_from"))
        both = both.join(first, "symbol").where(F.col("ts") >= F.col("_from")).drop("_from")
    start = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    a, c = F.first("equity").over(start), F.first("close").over(start)
    return both.select("symbol", "ts", "bar", "equity", F.when((a > 0) & (c > 0), F.col("close") / F.nullif(c, F.lit(0.0)) * a).alias("benchmark"))
