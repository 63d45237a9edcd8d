"""Searches: the same seed gives the same study, studies are kept apart by symbol, and every fold appears once."""

import pytest
from pyspark.sql import functions as F

from barloom.operators import search
from barloom.operators import params as P
from barloom.plans import backtests, catalogue, research, series  # noqa: F401
from barloom.sources import bars as B

FILTERS = {"ma_trend_enabled": True, "ma_exit_enabled": True, "stop_loss_enabled": True}


@pytest.fixture(scope="module")
def priorities(spark, sf):
    """Two symbols of daily bars."""
    return B.by_priority(spark, sf).where(F.col("symbol").isin("1-URGENT", "5-LOW"))


def test_searches_repeat(spark, sf):
    one, two = (sorted(map(tuple, catalogue.QUERIES["optimize_simple"](spark, sf).collect()), key=repr) for _ in range(2))
    assert one and one == two


def test_studies_are_those_of_each_symbol_alone(spark, priorities):
    """Many symbols in the same jobs, in as many jobs as it takes, find what each finds alone; guided trials differ from random ones."""
    how = {"metric": "profit_factor", "trials": 24, "min_trades": 1, "batch": 8}
    both = search.studies(priorities, {"1-URGENT": 1, "5-LOW": 2}, research._RISK_ONLY, FILTERS, **how)
    for name, seed in (("1-URGENT", 1), ("5-LOW", 2)):
        alone = search.study(priorities.where(F.col("symbol") == name), research._RISK_ONLY, FILTERS, seed=seed, **how)
        assert alone.value == both[name].value > 0 and alone.best == both[name].best and len(alone.trials) == 24
    random = search.Sampler(search.dimensions(FILTERS, None, "both"), 1)
    assert both["1-URGENT"].trials[:8] != [] and [t for t, _ in both["1-URGENT"].trials[:8]] == random.batch(8)
    assert [t for t, _ in both["1-URGENT"].trials[8:16]] != random.batch(8) or len([v for _, v in both["1-URGENT"].trials[:8] if v > float("-inf")]) < random.startup
    with pytest.raises(ValueError):
        search.study(priorities, research._RISK_ONLY, FILTERS)


def test_jobs_share_equal_sets_and_stay_small(monkeypatch):
    monkeypatch.setattr(search, "TOGETHER", 3)
    p = [P.make(stop_loss_pct_long=float(x)) for x in range(1, 6)]
    wanted = {"a": p[:2], "b": p[:2], "c": p[1:3], "d": p[3:]}
    jobs = list(search._jobs(wanted))
    assert [len(sets) for sets, _, _ in jobs] == [3, 2]
    back = {(name, k): sets[i] for sets, _, place in jobs for (name, k), i in place.items()}
    assert back == {(name, k): t for name, ts in wanted.items() for k, t in enumerate(ts)}


def test_permutations_score_the_whole_history(spark, sf):
    real = B.daily(spark, sf)
    found = search.permutation_test(real, research._RISK_ONLY, FILTERS, permutations=3, trials=6, batch=6, min_trades=1)
    rows = found.scores.collect()
    assert sorted(r["perm_id"] for r in rows) == [0, 1, 2] and len({r["real"] for r in rows}) == 1
    study = search.study(search.split(real, 0.7)[0], research._RISK_ONLY, FILTERS, metric="profit_factor", trials=6, min_trades=1, batch=6)
    full = search.evaluate(real, {0: P.make(**(study.best or research._RISK_ONLY))}).first()["profit_factor"]
    assert rows[0]["real"] == pytest.approx(full)
    shown = found.shown(most=1).groupBy("perm_id").agg(F.count("*").alias("n"), F.max("best").alias("best")).collect()
    best = max(rows, key=lambda r: (r["permuted"], -r["perm_id"]))["perm_id"]
    assert {r["perm_id"] for r in shown if r["best"]} == {best} and None in {r["perm_id"] for r in shown}
    assert {r["n"] for r in shown} == {real.count()}
    short = real.where("bar < 49")
    assert search.permutation_test(short, research._RISK_ONLY, FILTERS) is None


def test_walk_forward_folds_of_every_symbol(spark, priorities):
    found = search.walk_forward(priorities, research._RISK_ONLY, FILTERS, metric="profit_factor", trials=50, folds=3, min_trades=1, batch=25)
    assert {tuple(r)[:2] for r in found["folds"].collect()} == set(found["params"]) == {(s, k) for s in ("1-URGENT", "5-LOW") for k in (1, 2)}
    assert set(found["best"]) == set(found["efficiency"]) == set(found["warnings"]) == {"1-URGENT", "5-LOW"}
    assert found["best"]["5-LOW"] == found["params"]["5-LOW", 2]
    ends = found["equity"].groupBy("symbol").agg(F.min_by("equity", "ts").alias("a"), F.count("*").alias("n"))
    assert all(r["a"] == 10_000 and r["n"] > 40 for r in ends.collect())
    none = search.walk_forward(priorities.where("bar < 60"), research._RISK_ONLY, FILTERS, folds=3)
    assert none["best"] == {} and none["folds"].count() == 0 and none["equity"] is None


def test_warnings():
    assert search.budget_warnings(20, FILTERS) and not search.budget_warnings(2000, FILTERS)
    assert len(search.budget_warnings(10**6, {s: True for s in ("rsi_enabled", "macd_enabled", "adx_enabled", "ma_trend_enabled")})) == 1
    said = search.robustness_warnings(-0.1, {"a": 0.6, "b": 0.1}, 0.3)
    assert len(said) == 3 and "a" in said[1] and "b" not in said[1].split(": ")[1]
    assert search.robustness_warnings(0.4, {}, 0.0)[0].startswith("efficiency 0.40") and not search.robustness_warnings(0.9, {}, 0.1)


def test_permutation_p_is_a_share(spark, sf):
    r = catalogue.QUERIES["permutation_p"](spark, sf).first()
    assert r["n"] == research.PERMUTATIONS and 0 <= r["p"] <= 1 and round(r["p"] * r["n"]) == pytest.approx(r["p"] * r["n"])

