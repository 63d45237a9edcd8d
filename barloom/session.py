"""The verbs of an analysis session: load, set, run, search, test, remember. Frames stay lazy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import windows as W
from barloom.operators import calendars, engine, metrics, restricted, search, simulate, specs
from barloom.operators import params as P
from barloom.operators.indicators import Plan
from barloom.sources import clean, store, synthetic


def summary(bars: DataFrame, per_year: float = 252) -> DataFrame:
    """Bars, range, extremes, annual volatility and total return of each symbol."""
    b = bars.withColumn("_r", W.pct_change("close"))
    return b.groupBy("symbol").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("close").alias("close_min"), F.max("close").alias("close_max"),
        (F.stddev_samp("_r") * per_year**0.5 * 100).alias("annual_vol"), ((W.ratio(F.max_by("close", "bar"), F.min_by("close", "bar")) - 1) * 100).alias("total_return"),
    )


def characterize(bars: DataFrame) -> DataFrame:
    """One row a symbol: volatility regime, trend against long means, strength, annual figures."""
    plan = Plan()
    atr, (_, _, adx) = plan.atr(14), plan.adx(14, 14)
    b = plan.apply(bars).withColumns({"_v": W.ratio(F.col(atr), F.col("close")) * 100, "_r": W.pct_change("close"), "_n": F.count("*").over(W.whole())})
    ends = b.groupBy("symbol").agg(F.max_by("_v", "bar").alias("atr_pct"), F.max_by("close", "bar").alias("close"), F.max_by(adx, "bar").alias("adx"), F.max("_n").alias("n"), (F.stddev_samp("_r") * 252**0.5 * 100).alias("annual_vol"), (F.avg("_r") / F.nullif(F.stddev_samp("_r"), F.lit(0.0)) * 252**0.5).alias("sharpe"))
    rank = b.join(ends.select("symbol", F.col("atr_pct").alias("_now")), "symbol").groupBy("symbol").agg((F.avg((F.col("_v") < F.col("_now")).cast("double")) * 100).alias("atr_rank"))
    back = F.col("_n") - F.col("bar")
    means = b.groupBy("symbol").agg(F.avg(F.when(back <= F.least(F.lit(200), F.floor(F.col("_n") / 2)), F.col("close"))).alias("sma_long"), F.avg(F.when(back <= F.least(F.lit(50), F.floor(F.col("_n") / 4)), F.col("close"))).alias("sma_short"))
    out = ends.join(rank, "symbol").join(means, "symbol").withColumn("gap_pct", (W.ratio(F.col("close"), F.col("sma_long")) - 1) * 100)
    return out.withColumns({
        "volatility": F.when(F.col("atr_rank") < 33, "low").when(F.col("atr_rank") > 66, "high").otherwise("medium"),
        "trend": F.when(F.col("gap_pct") > 0, "up").otherwise("down"),
        "trend_strength": F.when(F.abs("gap_pct") > 5, "strong").when(F.abs("gap_pct") > 2, "moderate").otherwise("weak"),
        "adx_regime": F.when(F.col("adx") < 20, "ranging").when(F.col("adx") < 40, "trending").otherwise("strong trend"),
    })


class Session:
    """One analyst's state: bars, parameters, costs, and the folder (shared, as Spark names it) of strategies and notes."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder
        self.bars: DataFrame | None = None
        self.params = P.defaults()
        self.costs = {"capital": engine.CAPITAL, "commission": engine.COMMISSION, "slippage": engine.SLIPPAGE}
        self._events: DataFrame | None = None
        self._held: DataFrame | None = None

    def _forget(self) -> None:
        if self._held is not None:
            self._held.unpersist()
        self._events = self._held = None

    def _kept(self) -> str:
        if self.folder is None:
            raise RuntimeError("name a folder for strategies and notes first")
        return self.folder

    def _have(self) -> DataFrame:
        if self.bars is None:
            raise RuntimeError("load bars first")
        return self.bars

    def load(self, bars: DataFrame) -> DataFrame:
        self._forget()
        self.bars = bars
        return summary(bars)

    def load_file(self, path: str, symbol: str = "ALL") -> DataFrame:
        return self.load(clean.load_file(self.spark, path, symbol))

    def load_sample(self, **how: Any) -> DataFrame:
        return self.load(synthetic.sample_bars(self.spark, **how))

    def set_params(self, given: Mapping[str, Any]) -> dict[str, Any]:
        costs = {k: float(given[k]) for k in self.costs if k in given}
        self.params = P.from_dict({**{k: v for k, v in self.params.items() if k not in P.FOLLOWS or k in given}, **given})
        self.costs |= costs
        self._forget()
        return self.params

    def run(self) -> DataFrame:
        """Metrics; trades and equity are then in ``trades`` and ``equity``. A symbol that fails is in ``errors`` alone."""
        self._forget()
        self._held = engine.backtest(self._have(), self.params, **self.costs).persist()
        self._events = engine.sound(self._held)
        return metrics.metrics(self.trades, self.equity, metrics.bars_per_year(self._have()), self.costs["capital"])

    @property
    def events(self) -> DataFrame:
        if self._events is None:
            self.run()
        return self._events

    @property
    def errors(self) -> DataFrame:
        """(symbol, param_id, message) of the symbols whose backtest failed."""
        if self._held is None:
            self.run()
        return engine.errors_of(self._held)

    @property
    def trades(self) -> DataFrame:
        return engine.trades_of(self.events)

    @property
    def equity(self) -> DataFrame:
        return engine.equity_of(self.events)

    def filters(self) -> dict[str, bool]:
        return {s.flag: bool(self.params.get(s.flag)) for s in specs.all_specs()}

    def optimize(self, metric: str = "sharpe_ratio", trials: int = 200, walk_forward: bool = True, **how: Any):
        """Walk-forward, or simple where no fold is long enough; the best parameters of one symbol become the session's."""
        if walk_forward:
            found = search.walk_forward(self._have(), self.params, self.filters(), metric, trials, **how)
            if found["best"]:
                if len(found["best"]) == 1:
                    self.apply_best(next(iter(found["best"].values())))
                return found
        study, parts = search.optimize(self._have(), self.params, self.filters(), metric, trials, **{k: v for k, v in how.items() if k in ("share", "min_trades", "pinned", "seed")})
        if study.best:
            self.apply_best(study.best)
        return {"study": study, "metrics": parts, "best": study.best}

    def apply_best(self, best: Mapping[str, Any]) -> None:
        """All but the trade direction."""
        self.set_params({k: v for k, v in best.items() if k != "trade_direction"})

    def permutation_test(self, **how: Any) -> DataFrame | None:
        found = search.permutation_test(self._have(), self.params, self.filters(), **how)
        return None if found is None else simulate.p_value(found.scores)

    def monte_carlo(self, method: str = "trade_shuffle", **how: Any) -> DataFrame | None:
        paths = simulate.monte_carlo(method, self.trades, self.equity, capital=self.costs["capital"], **how)
        return None if paths is None else simulate.summary(simulate.per_simulation(paths, self.costs["capital"]))

    def characterize(self) -> DataFrame:
        return characterize(self._have())

    def calendar(self) -> dict[str, DataFrame]:
        return calendars.analyze(self._have())

    def cost_sweep(self, round_trips: Sequence[float] = (0.3, 0.5, 1.0, 2.0, 3.0)) -> DataFrame:
        return search.cost_sweep(self._have(), self.params, round_trips, self.costs["capital"])

    def sensitivity(self, metric: str = "profit_factor", delta_pct: float = 25.0) -> DataFrame:
        return search.sensitivity(self._have(), self.params, metric, delta_pct, **self.costs)

    def heatmap(self, x: tuple[str, Sequence], y: tuple[str, Sequence], metric: str = "sharpe_ratio") -> DataFrame:
        return search.heatmap(self._have(), self.params, x, y, metric, **self.costs)

    def export_trades(self, path: str, which: str = "all", direction: str | None = None) -> None:
        """CSV of the trade log: all, winners or losers, of one direction or both."""
        t = self.trades
        t = t.where("pnl > 0") if which == "winners" else t.where("pnl <= 0") if which == "losers" else t
        (t.where(F.col("direction") == direction) if direction else t).write.mode("overwrite").csv(path, header=True)

    def divergence(self, length: int = 14, left: int = 5, right: int = 5, **how: Any) -> DataFrame:
        """Bars marked with hidden divergences (bull, bear); ValueError if a symbol has too few bars for any."""
        need, plan = 2 * (left + right + length), Plan()
        short = self._have().groupBy("symbol").count().where(F.col("count") < need).orderBy("symbol").collect()
        if short:
            raise ValueError(f"divergence needs {need} bars or more: " + ", ".join(f"{r['symbol']} has {r['count']}" for r in short))
        bull, bear = plan.hidden_divergence(length, left, right, **how)
        marked = plan.apply(self._have())
        return marked.select("symbol", "ts", "bar", "close", F.col(bull).alias("bull"), F.col(bear).alias("bear"))

    def active(self) -> list[str]:
        return [s.key for s in specs.enabled(self.params)]

    def save(self, name: str) -> str:
        """Parameters and costs under a name."""
        return store.save_strategy(self.spark, self._kept(), name, self.params, self.costs)

    def restore(self, name: str) -> dict[str, Any]:
        found = store.load_strategy(self.spark, self._kept(), name)
        return self.set_params({**P.defaults(), **found["params"], **found["execution"]})

    def strategies(self) -> DataFrame:
        return store.strategies(self.spark, self._kept())

    def note(self, **entry: Any) -> None:
        store.append_note(self.spark, self._kept(), entry)

    def notes(self, **how: Any) -> DataFrame:
        return store.notes(self.spark, self._kept(), **how)

    def indicators(self) -> list[dict[str, Any]]:
        return [{"key": s.key, "role": s.role, "flag": s.flag, "params": [p.name for p in s.params]} for s in specs.all_specs()]

    def register_indicator(self, source: str) -> str:
        """Source that assigns ``SPEC`` (or calls ``register`` with it), run as ``restricted`` allows; then tried on 100 bars."""
        told: list[Any] = []
        space = restricted.run(source, register=told.append)
        if not told and "SPEC" not in space:
            raise ValueError("the source must assign SPEC or call register")
        spec = specs.register(told[0] if told else space["SPEC"])
        try:
            plan = Plan()
            columns = spec.compute(plan, {p.name: p.default for p in spec.params}) if spec.compute else ()
            tried = plan.apply(synthetic.sample_bars(self.spark, days=100))
            if missing := [c for c in (*columns, *spec.outputs) if c not in tried.columns]:
                raise ValueError(f"{spec.key}: outputs are missing: {missing}")
            tried.count()
        except Exception:
            specs.unregister(spec.key)
            raise
        self.params = {**{p.name: p.default for p in spec.params}, **self.params}
        return spec.key

