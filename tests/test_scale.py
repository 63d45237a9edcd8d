"""Long symbols in blocks, engine state from batch to batch, errors of one symbol or set, deadlines: all as without them."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import order
from barloom.operators import engine, indicators, ranges, search
from barloom.operators import params as P
from barloom.operators.indicators import Plan
from barloom.plans import backtests, catalogue, research, series  # noqa: F401
from barloom.sources import bars as B
from barloom.sources import synthetic
from barloom.sources.shared import saved, scope

FILTERS = {"ma_trend_enabled": True, "ma_exit_enabled": True, "stop_loss_enabled": True}


@pytest.fixture
def blocks(monkeypatch):
    """Every symbol is long: blocks of seven bars."""
    monkeypatch.setattr(indicators, "BLOCK", 7)
    monkeypatch.setattr(indicators, "SMALL_BYTES", 0)


def planned(bars):
    plan = Plan()
    plan.macd(12, 26, 9)
    plan.adx(14, 14)
    plan.rsi(14)
    plan.supertrend(10, 3.0)
    plan.ema("holes", 5)
    plan.percentile_rank("close", 100)
    plan.range_bands(70, (1.0,))
    names = [n for n in plan._level if n not in ("log_return",)]
    return plan.apply(bars), names


def test_blocks_give_the_same(spark, sf, monkeypatch):
    """Means, what builds on them, ranks and quantiles: in blocks of 7 bars as in one group; also where values are missing."""
    bars = B.by_priority(spark, sf).where(F.col("symbol").isin("1-URGENT", "5-LOW"))
    bars = saved(bars.withColumn("holes", F.when((F.col("bar") > 3) & (F.hash("bar") % 5 != 0) & ((F.col("bar") < 40) | (F.col("bar") > 71)), F.col("close"))))
    plain, names = planned(bars)
    want = plain.orderBy("symbol", "bar").toPandas()
    monkeypatch.setattr(indicators, "BLOCK", 7)
    monkeypatch.setattr(indicators, "SMALL_BYTES", 0)
    got = planned(bars)[0].orderBy("symbol", "bar").toPandas()
    assert len(got) == len(want) > 500 and set(got.columns) == set(want.columns)
    for n in names:
        a, b = got[n].to_numpy(float), want[n].to_numpy(float)
        assert (np.isnan(a) == np.isnan(b)).all() and np.allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True), n
    assert want["ema_holes_5"].notna().sum() > 100


@pytest.mark.parametrize("name", ["ema_sym", "adx", "supertrend", "percentile_rank", "hpdr_bands"])
def test_queries_in_blocks(spark, blocks, sf, name):
    import oracle

    assert oracle.difference(spark, oracle.connect(sf), catalogue.QUERIES[name], catalogue.ORACLE[name], sf) == ""


def test_maps_of_blocks_compose():
    rng = np.random.default_rng(2)
    x = np.where(rng.random(400) < 0.3, np.nan, rng.normal(size=400))
    x[:5] = x[100:160] = np.nan
    import pandas as pd

    want = pd.Series(x).ewm(alpha=0.2, adjust=False).mean().to_numpy()
    for size in (1, 3, 50, 400):
        cuts = range(0, 400, size)
        starts = indicators.scan([indicators.summary(x[a : a + size], 0.2) for a in cuts], 0.2)
        for a, (y, _) in list(zip(cuts, starts, strict=True))[1:]:
            assert y == pytest.approx(want[a - 1], nan_ok=True)


def test_order_statistics_against_lists():
    rng = np.random.default_rng(3)
    for n, lookback in ((0, 3), (1, 1), (50, 7), (400, 40), (300, 300), (30, 40)):
        x = rng.integers(0, 9, n).astype(float) if lookback < 50 else rng.normal(size=n)
        if n > 100:
            x[[20, 21, 90]] = np.nan
        rank, bands = order.sliding_rank(x, lookback), order.sliding_quantiles(x, lookback, (0.0, 0.16, 0.5, 1.0))
        for i in range(n):
            back = x[max(0, i - lookback) : i]
            whole = i >= lookback and not np.isnan(x[i - lookback : i + 1]).any()
            assert np.isnan(rank[i]) == (not whole)
            if whole:
                less, upto = (back < x[i]).sum(), (back <= x[i]).sum()
                assert rank[i] == (less + upto + (upto > less)) * 50 / lookback
            window = x[max(0, i - lookback + 1) : i + 1]
            there = len(window) == lookback and not np.isnan(window).any()
            for share, band in zip((0.0, 0.16, 0.5, 1.0), bands, strict=True):
                assert band[i] == pytest.approx(np.quantile(window, share)) if there else np.isnan(band[i])


def test_sliding_rank_is_faster_than_lists():
    x = np.random.default_rng(4).normal(size=100_000)
    began = time.time()
    order.sliding_rank(x, 5000)
    assert time.time() - began < 5  # the lists hold 500 million values


def test_range_join(spark, sf):
    """The rank by a range join: as by the plan, without a nested loop."""
    bars = B.by_priority(spark, sf)
    joined = ranges.percentile_rank(bars, "close", 100)
    plan = Plan()
    name = plan.percentile_rank("close", 100)
    want = {(r["symbol"], r["bar"]): r[name] for r in plan.apply(bars).select("symbol", "bar", name).collect()}
    got = {(r["symbol"], r["bar"]): r["rank"] for r in joined.collect()}
    assert set(got) == set(want) and all((got[k] is None) == (want[k] is None or want[k] != want[k]) and (got[k] is None or got[k] == want[k]) for k in want)
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in joined._jdf.queryExecution().executedPlan().toString()


def test_engine_in_batches_of_16_rows(spark, monkeypatch):
    """State goes from batch to batch: the same events with tiny batches, and sent on after every few rows."""
    bars = synthetic.sample_bars(spark, [f"S{k}" for k in range(3)], days=300, volatility=0.03)
    p = P.make(**{**backtests.BASE, "stop_loss_enabled": True, "trailing_stop_enabled": True, "trailing_stop_activation": 1.0, "use_kelly": True, "entry_exit_conflict_mode": "defer"})
    show = lambda: sorted(map(tuple, engine.backtest(bars, p).collect()), key=repr)
    want = show()
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = show()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    assert got == want and len({r[0] for r in want}) == 3 and sum(r[2] == "trade" for r in want) > 20


def test_one_bad_symbol_and_one_bad_set(spark):
    """They are error rows; all others are as without them."""
    good = synthetic.sample_bars(spark, ["A", "B", "C"], days=250, volatility=0.03)
    bars = saved(good.withColumn("high", F.when((F.col("symbol") == "B") & (F.col("bar") == 200), None).otherwise(F.col("high"))))
    sets = {0: P.make(**backtests.BASE), 1: P.make(**{**backtests.BASE, "ma_exit_type": "nonsense"}), 2: P.make(**{**backtests.BASE, "stop_loss_enabled": True, "stop_loss_pct_long": 5.0})}
    runs = search.run_sets(bars, sets)
    failed = {(r["symbol"], r["param_id"]): r["message"] for r in runs.errors.collect()}
    assert set(failed) == {("B", 0), ("B", 1), ("B", 2), ("A", 1), ("C", 1)} and "price" in failed["B", 0] and "nonsense" in failed["A", 1]
    want = {(r["symbol"], r["param_id"]): r for r in search.evaluate(good.where("symbol <> 'B'"), {k: sets[k] for k in (0, 2)}).collect()}
    got = {(r["symbol"], r["param_id"]): r for r in runs.metrics(bars).collect()}
    assert got == want and set(got) == {(x, k) for x in "AC" for k in (0, 2)}
    assert {r["symbol"] for r in runs.events.select("symbol").distinct().collect()} == {"A", "C"}
    values = {(r["symbol"], r["param_id"]): r["value"] for r in search.objective(runs.metrics(bars), "profit_factor", 1).collect()}
    assert ("A", 1) not in values and np.isfinite(values["A", 0])
    cells = {(r["symbol"], r["x"]): r["value"] for r in search.heatmap(bars, sets[0], ("ma_fast_length", [5, 8]), ("ma_slow_length", [20]), "num_trades").collect()}
    assert cells["B", 5.0] == cells["B", 8.0] == 0 and cells["A", 5.0] > 0


def test_a_trial_that_fails_counts_as_failed(spark, monkeypatch):
    bars = synthetic.sample_bars(spark, days=250, volatility=0.03)
    sampler = search.Sampler.batch
    monkeypatch.setattr(search.Sampler, "batch", lambda self, n: [{**t, **({"ma_exit_type": "nonsense"} if k == 0 else {})} for k, t in enumerate(sampler(self, n))])
    found = search.study(bars, P.make(**backtests.BASE), FILTERS, trials=6, batch=6, min_trades=1, metric="profit_factor")
    assert found.trials[0][1] == search.FAILED and found.failed >= 1 / 6 and np.isfinite(found.value)


def test_a_study_stops_at_its_deadline(spark, monkeypatch):
    """What was told before counts; the job that runs is cancelled; later jobs of the session run."""
    bars = saved(synthetic.sample_bars(spark, days=250, volatility=0.03))
    rounds = []

    def slow(results, *how):
        rounds.append(1)
        return real(results, *how) if len(rounds) == 1 else real(results, *how).where(F.expr("java_method('java.lang.Thread', 'sleep', 60000L) IS NULL OR true"))

    real = search.objective
    monkeypatch.setattr(search, "objective", slow)
    began = time.time()
    found = search.study(bars, P.make(**backtests.BASE), FILTERS, trials=40, batch=4, min_trades=1, metric="profit_factor", timeout=25.0)
    assert time.time() - began < 50 and found.stopped and 4 <= len(found.trials) < 40 and np.isfinite(found.value) and found.best
    assert bars.count() == 250


def test_the_plan_of_a_grid_does_not_grow(spark):
    bars = saved(synthetic.sample_bars(spark, days=60))
    size = lambda n: len(search.with_many_signals(bars, search.grid(("stop_loss_pct_long", range(1, n)), ("take_profit_pct_long", range(1, n)), P.make(**backtests.BASE)))._jdf.queryExecution().optimizedPlan().toString())
    assert size(10) < size(3) * 1.1


def test_many_sample_symbols(spark):
    bars = synthetic.sample_bars(spark, [f"S{k:03}" for k in range(100)], days=30)
    assert bars.rdd.getNumPartitions() >= 1 and bars.groupBy("symbol").count().where("count = 30").count() == 100
    alone = synthetic.sample_bars(spark, "S007", days=30, seed=49).drop("symbol").collect()
    assert bars.where("symbol = 'S007'").drop("symbol").orderBy("bar").collect() == sorted(alone, key=lambda r: r["bar"])
    assert len(synthetic.SampleReader({"symbols": '["A", "B"]', "how": '{"seed": 1}'}).partitions()) == 2


def test_saved_tables_go_with_their_scope(spark):
    import os

    with scope(spark):
        outer = saved(spark.range(3))
        with scope(spark):
            inner = saved(spark.range(4))
            where = [f.removeprefix("file://") for f in inner.inputFiles()]
            assert inner.count() == 4 and all(map(os.path.exists, where))
        assert not any(map(os.path.exists, where)) and outer.count() == 3
