"""Verbs that no query reaches: pins, the simulation's dispatcher, the calendar bundle, best parameters, active indicators."""

import pytest
from pyspark.sql import functions as F

from barloom.operators import params as P
from barloom.operators import simulate
from barloom.session import Session

QUIET = {"pamrp_enabled": False, "bbwp_enabled": False, "pamrp_exit_enabled": False}


@pytest.fixture(scope="module")
def session(spark):
    s = Session(spark)
    s.load_sample(days=400)
    s.set_params({**QUIET, "rsi_enabled": True, "rsi_length": 5, "rsi_oversold": 45, "rsi_overbought": 55, "take_profit_enabled": True, "trade_direction": "both"})
    return s


def test_pins_are_sets_and_bring_their_followers():
    exit_, entry = next(iter(P.FOLLOWS.items()))
    assert P.pins([entry]) == {entry, exit_} and P.pins(P.pins([entry])) == P.pins([entry]) and P.pins(None) == set()
    assert P.pins([exit_]) == {exit_} and P.pins(["rsi_length"]) | P.pins([entry]) == P.pins(["rsi_length", entry])


def test_simulations_by_name(session):
    finals = {}
    for method, keys in (("trade_shuffle", {"sim_id"}), ("noise_injection", {"sim_id"}), ("return_bootstrap", {"sim_id"})):
        paths = simulate.monte_carlo(method, session.trades, session.equity, n=7)
        assert keys <= set(paths.columns) and paths.select("sim_id").distinct().count() == 7
        finals[method] = {round(r["final"], 4) for r in simulate.per_simulation(paths, 10_000.0).collect()}
    assert len(finals["trade_shuffle"]) == 1 < len(finals["noise_injection"])  # the order of trades doesn't change their sum
    with pytest.raises(ValueError, match="unknown method"):
        simulate.monte_carlo("guess", session.trades)
    assert simulate.monte_carlo("trade_shuffle", session.trades.limit(2)) is None
    assert simulate.monte_carlo("return_bootstrap", session.trades, session.equity.limit(19)) is None
    assert session.monte_carlo(n=5).first() is not None


def test_calendar_bundle(session):
    found = session.calendar()
    assert set(found) == {
        "daily", "day_of_week", "kruskal", "month", "month_heatmap", "quarter", "year", "year_by_weekday", "day_of_month", "hour", "weekday_by_hour", "distribution", "histogram", "streaks",
        "autocorrelation", "ljung_box", "summary",
    }
    days = {r["bucket"]: r["n"] for r in found["day_of_week"].collect()}
    assert set(days) == {0, 1, 2, 3, 4} and sum(days.values()) == 399 == found["histogram"].agg(F.sum("n")).first()[0]
    assert found["distribution"].first()["n"] == 399 and found["streaks"].count() == found["summary"].count() == 1
    found["daily"].unpersist()


def test_best_parameters_keep_the_direction(spark, session):
    s = Session(spark)
    s.set_params({"trade_direction": "short_only", "rsi_enabled": True})
    s.apply_best({"rsi_length": 21, "trade_direction": "both", "commission": 0.2})
    assert (s.params["rsi_length"], s.params["trade_direction"], s.costs["commission"]) == (21, "short_only", 0.2)
    assert "rsi_entry" in s.active() and not any(k.startswith("macd") for k in s.active())
    assert {"key", "role", "flag", "params"} <= set(s.indicators()[0]) and len(s.indicators()) == 24


def test_a_symbol_that_fails_is_an_error_of_the_session(spark):
    s = Session(spark)
    from barloom.sources import synthetic

    bars = synthetic.sample_bars(spark, ["GOOD", "BAD"], days=60)
    s.load(bars.withColumn("close", F.when((F.col("symbol") == "BAD") & (F.col("bar") == 30), None).otherwise(F.col("close"))))
    s.set_params({**QUIET, "rsi_enabled": True})
    assert [r["symbol"] for r in s.run().collect()] == ["GOOD"]
    assert [(r["symbol"], r["param_id"]) for r in s.errors.collect()] == [("BAD", 0)] and "price" in s.errors.first()["message"]
    assert {r["symbol"] for r in s.equity.select("symbol").distinct().collect()} == {"GOOD"}
