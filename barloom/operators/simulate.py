"""Monte Carlo and permutations, relational over (sim_id or perm_id).

Draws are keyed hashes, md5(seed:id:position): every row's draw is the same on any cluster,
in any order, and in SQL. Simulations multiply rows by design: trades x simulations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.windows import ratio

BANDS = (5, 25, 50, 75, 95)


def draw_key(seed: int, *parts: str | Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def uniform(key: Column) -> Column:
    """In (0, 1), from the first 12 hex digits of a key."""
    return (F.conv(F.substring(key, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def sims(spark: SparkSession, n: int, name: str = "sim_id") -> DataFrame:
    return spark.range(n).withColumnRenamed("id", name)


def _paths(steps: DataFrame, capital: float, multiply: bool) -> DataFrame:
    """(sim_id, step, change) -> equity at every step; step 0 is the capital."""
    order = Window.partitionBy("symbol", "sim_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    if multiply:
        e = F.lit(capital) * F.product(1 + F.col("change")).over(order)
    else:
        e = F.lit(capital) + F.sum("change").over(order)
    return steps.withColumn("equity", e)


def trade_shuffle(trades: DataFrame, n: int = 1000, capital: float = 10_000.0, seed: int = 42) -> DataFrame:
    """Paths (symbol, sim_id, step, equity): the trades' profits in a random order for each simulation."""
    keyed = trades.select("symbol", "trade_no", "pnl").crossJoin(sims(trades.sparkSession, n))
    order = Window.partitionBy("symbol", "sim_id").orderBy(draw_key(seed, "sim_id", "trade_no"), "trade_no")
    steps = keyed.select("symbol", "sim_id", F.row_number().over(order).alias("step"), F.col("pnl").alias("change"))
    return _paths(steps, capital, multiply=False)


def block_bootstrap(equity: DataFrame, n: int = 1000, capital: float = 10_000.0, block: int = 5, seed: int = 42) -> DataFrame:
    """Paths of the same length from blocks of consecutive returns; blocks of one where there are too few."""
    order = Window.partitionBy("symbol").orderBy("bar")
    r = equity.select("symbol", "bar", (ratio(F.col("mtm_equity"), F.lag("mtm_equity").over(order)) - 1).alias("r")).where("r IS NOT NULL")
    r = r.select("symbol", (F.row_number().over(order) - 1).alias("i"), "r")
    size = r.groupBy("symbol").agg(F.count("*").alias("n")).withColumn("b", F.when(F.col("n") < 2 * block, 1).otherwise(block))
    picks = size.crossJoin(sims(equity.sparkSession, n)).withColumn("block", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / F.col("b")).cast("int"))))
    start = F.floor(uniform(draw_key(seed, "sim_id", "block")) * (F.col("n") - F.col("b") + 1))
    picks = picks.withColumn("start", start).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    picks = picks.select("symbol", "sim_id", (F.col("block") * F.col("b") + F.col("k") + 1).alias("step"), (F.col("start") + F.col("k")).alias("i"), "n").where("step <= n")
    return _paths(picks.join(r, ["symbol", "i"]).select("symbol", "sim_id", "step", F.col("r").alias("change")), capital, multiply=True)


def noise(trades: DataFrame, n: int = 1000, capital: float = 10_000.0, noise_pct: float = 20.0, seed: int = 42) -> DataFrame:
    """Paths of profits with normal noise in proportion to their size; a zero profit takes the median size."""
    size = F.abs("pnl")
    typical = trades.where("pnl <> 0").groupBy("symbol").agg(F.percentile(size, 0.5).alias("_m"))
    t = trades.join(typical, "symbol", "left").select("symbol", "trade_no", "pnl", F.when(F.col("pnl") != 0, size).otherwise(F.coalesce("_m", F.lit(1.0))).alias("_size"))
    key = lambda tag: uniform(draw_key(seed, F.lit(tag), "sim_id", "trade_no"))
    normal = F.sqrt(-2 * F.ln(key("a"))) * F.cos(2 * F.pi() * key("b"))
    steps = t.crossJoin(sims(trades.sparkSession, n)).select("symbol", "sim_id", (F.col("trade_no") + 1).alias("step"), (F.col("pnl") + normal * F.col("_size") * noise_pct / 100).alias("change"))
    return _paths(steps, capital, multiply=False)


def per_simulation(paths: DataFrame, capital: float, ruin_pct: float = 50.0, per_year: int | None = None) -> DataFrame:
    """(symbol, sim_id, final, max_drawdown_pct, ruined, sharpe): drawdown counts the start."""
    order = Window.partitionBy("symbol", "sim_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    p = paths.withColumn("_peak", F.greatest(F.max("equity").over(order), F.lit(capital)))
    dd = (F.col("equity") - F.col("_peak")) / F.when(F.col("_peak") > 0, F.col("_peak")).otherwise(1.0) * 100
    sd = F.stddev_pop("change")
    out = [
        F.max_by("equity", "step").alias("final"), F.least(F.min(dd), F.lit(0.0)).alias("max_drawdown_pct"),
        (F.least(F.min("equity"), F.lit(capital)) <= capital * (1 - ruin_pct / 100)).alias("ruined"),
    ]
    if per_year:
        out.append(F.when(sd > 0, F.avg("change") / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(per_year))).otherwise(0.0).alias("sharpe"))
    return p.groupBy("symbol", "sim_id").agg(*out)


def bands(paths: DataFrame) -> DataFrame:
    """Percentiles of equity at every step."""
    return paths.groupBy("symbol", "step").agg(*[F.percentile("equity", q / 100).alias(f"p{q}") for q in BANDS])


def summary(simulations: DataFrame) -> DataFrame:
    return simulations.groupBy("symbol").agg(
        F.count("*").alias("n"), F.avg(F.col("ruined").cast("double")).alias("risk_of_ruin"),
        *[F.percentile("final", q / 100).alias(f"final_p{q}") for q in BANDS], *[F.percentile("max_drawdown_pct", q / 100).alias(f"drawdown_p{q}") for q in (5, 50, 95)],
    )


def monte_carlo(method: str, trades: DataFrame, equity: DataFrame | None = None, **how) -> DataFrame | None:
    """Paths by ``method``; None under three trades, or under 20 bars of equity for the bootstrap."""
    if method not in ("trade_shuffle", "return_bootstrap", "noise_injection"):
        raise ValueError(f"unknown method {method!r}")
    if len(trades.limit(3).take(3)) < 3:
        return None
    if method == "return_bootstrap":
        if equity is None or len(equity.limit(20).take(20)) < 20:
            return None
        return block_bootstrap(equity, **how)
    return trade_shuffle(trades, **how) if method == "trade_shuffle" else noise(trades, **how)


def permute_prices(bars: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(symbol, perm_id, bar, ...): closes rebuilt from shuffled returns, the bar scaled with its close; volume stays."""
    order = Window.partitionBy("symbol").orderBy("bar")
    b = bars.withColumn("_r", ratio(F.col("close"), F.lag("close").over(order)) - 1).withColumn("_c0", F.first("close").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    many = b.crossJoin(sims(bars.sparkSession, n, "perm_id"))
    drawn = Window.partitionBy("symbol", "perm_id").orderBy(draw_key(seed, "perm_id", "bar"), "bar")
    shuffled = many.where("_r IS NOT NULL").select("symbol", "perm_id", F.row_number().over(drawn).alias("_k"), "_r")
    ranked = many.drop("_r").withColumn("_k", F.row_number().over(Window.partitionBy("symbol", "perm_id").orderBy("bar")) - 1)
    j = ranked.join(shuffled, ["symbol", "perm_id", "_k"], "left")
    so_far = Window.partitionBy("symbol", "perm_id").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    new = F.col("_c0") * F.product(1 + F.coalesce("_r", F.lit(0.0))).over(so_far)
    j = j.withColumn("_new", new).withColumn("_f", ratio(F.col("_new"), F.col("close")))
    o, h, low = (F.col(x) * F.col("_f") for x in ("open", "high", "low"))
    return j.select("symbol", "perm_id", "ts", "bar", o.alias("open"), F.greatest(h, o, F.col("_new")).alias("high"), F.least(low, o, F.col("_new")).alias("low"), F.col("_new").alias("close"), "volume")


def p_value(results: DataFrame, real: str = "real", permuted: str = "permuted") -> DataFrame:
    """(p, median, p95, z, verdict) of a permuted score against the real one; population deviation."""
    p = F.count_if(F.col(permuted) >= F.col(real)) / F.count("*")
    out = results.groupBy("symbol").agg(
        F.count("*").alias("n"), p.alias("p"), F.percentile(permuted, 0.5).alias("median"), F.percentile(permuted, 0.95).alias("p95"),
        ratio(F.max(real) - F.avg(permuted), F.stddev_pop(permuted)).alias("z"),
    )
    return out.withColumn("verdict", F.when(F.col("p") < 0.01, "highly significant").when(F.col("p") < 0.05, "significant").when(F.col("p") < 0.10, "marginal").otherwise("not significant"))
