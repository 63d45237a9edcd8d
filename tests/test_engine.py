"""The engine on cases worked out by hand, and on a published trade log."""

import datetime as dt
import hashlib

import pandas as pd
import pytest

from barloom.operators import engine
from barloom.operators import params as P
from barloom.sources import synthetic

DAY = dt.datetime(2024, 1, 1)
QUIET = (100, 101, 99, 100)
#: What a run needs besides bars; a position takes all the capital, costs are off.
PLAIN = {"position_size_pct": 100.0, "stop_loss_enabled": False, "pamrp_enabled": False, "bbwp_enabled": False, "pamrp_exit_enabled": False}


def trades(spark, bars, p, **signals):
    """Trades of one symbol's (open, high, low, close), with signals as sets of bars."""
    keys = sorted({*engine.SIGNALS, *signals})
    rows = [("A", 0, DAY + dt.timedelta(days=i), i, *map(float, b), None, *(i in signals.get(k, ()) for k in keys)) for i, b in enumerate(bars)]
    kinds = ", ".join(f"{k} boolean" for k in keys)
    df = spark.createDataFrame(rows, f"symbol string, param_id int, ts timestamp_ntz, bar long, open double, high double, low double, close double, atr double, {kinds}")
    events = engine.run(df, {0: P.make(**{**PLAIN, **p})}, commission=0.0)
    return [(r["direction"], r["entry_idx"], r["entry_price"], r["exit_idx"], r["exit_price"], r["exit_reason"]) for r in engine.trades_of(events).orderBy("trade_no").collect()]


def test_a_gap_fills_at_the_open(spark):
    p = {"stop_loss_enabled": True, "stop_loss_pct_long": 5.0, "stop_loss_pct_short": 5.0}
    bars = [QUIET, QUIET, QUIET, (90, 91, 89, 90), QUIET, (100, 112, 100, 110)]
    assert trades(spark, bars[:4], p, entry_long={0}) == [("long", 1, 100, 3, 90, "stop_loss")]
    assert trades(spark, [*bars[:3], (97, 98, 94, 95)], p, entry_long={0}) == [("long", 1, 100, 3, 95, "stop_loss")]
    assert trades(spark, [*bars[:3], (108, 109, 107, 108)], p, entry_short={0}) == [("short", 1, 100, 3, 108, "stop_loss")]
    p = {"take_profit_enabled": True, "take_profit_pct_long": 5.0}
    assert trades(spark, [*bars[:3], (107, 108, 106, 107)], p, entry_long={0}) == [("long", 1, 100, 3, 107, "take_profit")]


def test_both_stops_in_one_bar(spark):
    """The one nearer to the open fills; at equal distance the profit."""
    p = {"stop_loss_enabled": True, "take_profit_enabled": True, "stop_loss_pct_long": 5.0, "take_profit_pct_long": 5.0}
    for opened, price, reason in ((100, 105, "take_profit"), (99, 95, "stop_loss"), (101, 105, "take_profit")):
        assert trades(spark, [QUIET, QUIET, (opened, 110, 90, 100)], p, entry_long={0}) == [("long", 1, 100, 2, price, reason)]


def test_the_entry_bar_may_stop(spark):
    p = {"stop_loss_enabled": True, "stop_loss_pct_long": 5.0}
    bars = [QUIET, (100, 101, 90, 97), QUIET]
    assert trades(spark, bars, {**p, "allow_same_bar_exit": True}, entry_long={0}) == [("long", 1, 100, 1, 95, "stop_loss")]
    assert trades(spark, bars, {**p, "allow_same_bar_exit": False}, entry_long={0}) == [("long", 1, 100, 2, 100, "end_of_data")]


def test_trailing_starts_beyond_its_activation(spark):
    p = {"trailing_stop_enabled": True, "trailing_stop_pct": 4.0, "trailing_stop_activation": 8.0}
    bars = [QUIET, QUIET, (100, 107, 100, 106), (106, 110, 106, 109), (108, 108, 100, 101)]
    assert trades(spark, bars, p, entry_long={0}) == [("long", 1, 100, 4, pytest.approx(105.6), "trailing_stop")]


def test_deferred_exits_count_once_they_have_been_off(spark):
    """x is on at the entry: it must go off first; y isn't, and counts at once."""
    p = {"entry_exit_conflict_mode": "defer", "exit_operator": "or"}
    quiet = [QUIET] * 8
    on = {"entry_long": {0}, "exit_long_x": {0, 1, 2, 5}, "exit_long_signal": {0, 1, 2, 5}}
    assert trades(spark, quiet, p, **on) == [("long", 1, 100, 6, 100, "signal")]
    early = on | {"exit_long_y": {3}, "exit_long_signal": {0, 1, 2, 3, 5}}
    assert trades(spark, quiet, p, **early) == [("long", 1, 100, 4, 100, "signal")]
    both = {**on, "exit_long_y": {1, 2, 5}, "exit_long_signal": {1, 2, 5}}
    assert trades(spark, quiet, {**p, "exit_operator": "and"}, **both) == [("long", 1, 100, 6, 100, "signal")]
    assert trades(spark, quiet, {"entry_exit_conflict_mode": "skip"}, **on) == []


def test_reversal_and_conflicting_entries(spark):
    quiet = [QUIET] * 6
    turn = {"entry_long": {0}, "exit_long_signal": {2}, "entry_short": {2}}
    assert [t[:2] for t in trades(spark, quiet, {"allow_same_bar_reversal": True}, **turn)] == [("long", 1), ("short", 3)]
    assert [t[:2] for t in trades(spark, quiet, {"allow_same_bar_reversal": False}, **turn)] == [("long", 1)]
    for mode, sides in (("skip", []), ("prefer_long", ["long"]), ("prefer_short", ["short"])):
        assert [t[0] for t in trades(spark, quiet, {"entry_conflict_mode": mode}, entry_long={0}, entry_short={0})] == sides


def test_published_trade_log(spark):
    """Sample bars and the engine to the last bit: the digest (a fixed value) of entry and exit times, sides, prices, sizes, profits and reasons."""
    bars = synthetic.sample_bars(spark, days=2000, volatility=0.025, drift=0.0002, seed=7, start="2018-01-01")
    p = P.from_dict({
        "trade_direction": "both", "entry_operator": "and", "exit_operator": "or", "entry_conflict_mode": "skip", "rsi_enabled": True, "rsi_length": 14, "rsi_oversold": 30, "rsi_overbought": 70,
        "stop_loss_enabled": True, "stop_loss_pct_long": 8.0, "stop_loss_pct_short": 8.0, "trailing_stop_enabled": True, "trailing_stop_pct": 3.0, "trailing_stop_activation": 1.0,
        "pamrp_enabled": False, "pamrp_exit_enabled": False, "bbwp_enabled": False,
    })
    t = engine.trades_of(engine.backtest(bars, p)).orderBy("trade_no").toPandas()
    log = pd.DataFrame({
        "entry_time": t["entry_ts"].astype("datetime64[ns]"), "exit_time": t["exit_ts"].astype("datetime64[ns]"), "direction": t["direction"].astype(object), "entry_price": t["entry_price"],
        "exit_price": t["exit_price"], "size": t["size_dollars"], "pnl": t["pnl"], "exit_reason": t["exit_reason"].astype(object),
    })
    digest = hashlib.sha256(pd.util.hash_pandas_object(log, index=False).values.tobytes()).hexdigest()
    assert digest == "51e935b428b681d411b2dc285badbf199494db56b206d5f02a1959c612d5ab72"
