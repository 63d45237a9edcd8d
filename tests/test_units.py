"""Small cases worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import engine
from barloom.operators import params as P
from barloom.session import Session
from barloom.sources import store


def frame(spark, rows):
    """(open, high, low, close, entry_long) by day."""
    day = dt.datetime(2024, 1, 1)
    data = [("A", day + dt.timedelta(days=i), i, *map(float, r[:4]), 1.0) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "symbol string, ts timestamp_ntz, bar long, open double, high double, low double, close double, volume double")


def test_session_runs_a_sample(spark, tmp_path):
    s = Session(spark, str(tmp_path))
    assert s.load_sample(days=120).first()["n"] == 120
    s.set_params({"rsi_enabled": True, "pamrp_enabled": False, "bbwp_enabled": False, "pamrp_exit_enabled": False, "rsi_length": 5, "rsi_oversold": 45})
    result = s.run().first()
    assert result["num_trades"] == s.trades.count()
    assert s.equity.count() == 120
    s.save("One")
    assert s.restore("One")["rsi_length"] == 5
    s.note(symbol="SPY", verdict="PASS", text="fine")
    s.note(symbol="QQQ", verdict="FAIL", text="not")
    assert [r["symbol"] for r in s.notes(verdict="pass").collect()] == ["SPY"]


def test_names_of_strategies(spark, tmp_path):
    at = spark, str(tmp_path)
    a, b = store.save_strategy(*at, "My one", {}), store.save_strategy(*at, "my ONE", {})
    assert a != b and store.save_strategy(*at, "My one", {"x": 1}) == a
    assert store.delete_strategy(*at, "my ONE") and not store.delete_strategy(*at, "my ONE")
    assert store.save_strategy(*at, "my one!", {}) == b  # the number is free again
    assert [s["name"] for s in store.list_strategies(*at)] == ["my one!", "My one"] and store.load_strategy(*at, "My one")["params"] == {"x": 1}
    with pytest.raises(KeyError):
        store.load_strategy(*at, "my ONE")


def test_a_strategy_keeps_its_costs(spark, tmp_path):
    s = Session(spark, str(tmp_path))
    s.set_params({"rsi_enabled": True, "rsi_length": 9, "capital": 5000, "commission": 0.25, "slippage": 0.05})
    s.save("Costly")
    again = Session(spark, str(tmp_path))
    assert again.restore("Costly")["rsi_length"] == 9
    assert again.costs == {"capital": 5000.0, "commission": 0.25, "slippage": 0.05}
    found = store.load_strategy(spark, str(tmp_path), "Costly")
    assert found["version"] == store.VERSION and set(found["execution"]) == set(store.EXECUTION)
    # a row of the first version, without an execution block; and one that isn't a row
    (tmp_path / "strategies" / "by_hand").mkdir()
    (tmp_path / "strategies" / "by_hand" / "old.json").write_text('{"name": "Old", "file": "old", "saved_at": "2020", "params": "{\\"rsi_length\\": 3}"}\n{broken\n')
    assert again.restore("Old")["rsi_length"] == 3 and again.costs["capital"] == 5000.0
    assert {r["name"] for r in again.strategies().collect()} == {"Costly", "Old"}
    (tmp_path / "strategies" / "by_hand" / "new.json").write_text('{"name": "New", "file": "new", "saved_at": "2030", "version": 99, "params": "{}"}\n')
    with pytest.raises(ValueError, match="later version"):
        again.restore("New")
    with pytest.raises(RuntimeError):
        Session(spark).save("nowhere")


def test_two_writers_of_notes(spark, tmp_path):
    """Notes that are written at once are all there, in files of their own."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: store.append_note(spark, str(tmp_path), {"symbol": f"S{k}", "verdict": "PASS", "text": "fine"}), range(8)))
    assert sorted(r["symbol"] for r in store.notes(spark, str(tmp_path)).collect()) == [f"S{k}" for k in range(8)]


def test_unknown_parameters_are_dropped():
    assert "nonsense" not in P.from_dict({"nonsense": 1})


def test_bars_without_signals_make_no_trades(spark):
    bars = frame(spark, [(100, 101, 99, 100)] * 30)
    p = P.make(rsi_enabled=True, pamrp_enabled=False, bbwp_enabled=False, pamrp_exit_enabled=False)
    events = engine.backtest(bars, p)
    assert engine.trades_of(events).count() == 0
    flat = engine.equity_of(events).agg(F.min("mtm_equity"), F.max("mtm_equity")).first()
    assert flat[0] == flat[1] == engine.CAPITAL


def test_registration_refuses_other_imports(spark):
    with pytest.raises(ValueError):
        Session(spark).register_indicator("import os\nSPEC = None")


@pytest.mark.parametrize("source", [
    "open('/tmp/x')", "__import__('os')", "eval('1')", "exec('1')", "from os import path", "import sys", "().__class__.__bases__", "from math import sqrt as __x", "class A: pass", "getattr(1, 'real')",
    "from pyspark.sql import functions as F\nF.sys.exit()", "from pyspark.sql import functions as F\nF.__globals__", "from . import math", "x = lambda: (yield)", "import pyspark.sql.functions", "with x: pass", "try:\n    1\nexcept Exception:\n    2", "async def f(): pass",
    "from barloom.operators import indicators\nindicators.saved", "x = 1",
])
def test_registration_is_restricted(spark, source):
    with pytest.raises((ValueError, NameError, ImportError, AttributeError)):
        Session(spark).register_indicator(source)
    from barloom.operators import specs

    assert all(s.key != "mine" for s in specs.all_specs())


def test_registration_of_an_indicator(spark):
    from barloom.operators import specs

    source = """
import math
from pyspark.sql import functions as F
from barloom.operators.specs import Param, Spec

def compute(plan, p):
    return (plan.sma("close", int(math.floor(p["mine_length"]))),)

SPEC = Spec(key="mine", role="entry", flag="mine_enabled", params=(Param("mine_enabled", "bool", False), Param("mine_length", "int", 5, 2, 50)), compute=compute,
            long=lambda p, c: F.col("close") > F.col(c[0]), short=lambda p, c: F.col("close") < F.col(c[0]))
"""
    try:
        assert Session(spark).register_indicator(source) == "mine"
    finally:
        specs.unregister("mine")
