"""Loading: feeds, files with loose names, CSV, alignment and what bars are too few for."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import metrics, signals
from barloom.operators import params as P
from barloom.session import Session
from barloom.sources import clean, feed, synthetic


def test_feed(spark):
    bars, clamped = feed.load_feed(spark, "fake_feed:fetch", ["AB", "CD"], "2023-01-02", "2024-02-01", days=100)
    assert not clamped and bars.select("symbol").distinct().count() == 2
    one = bars.where("symbol = 'AB'").orderBy("bar").collect()
    assert [r["bar"] for r in one] == list(range(len(one))) and one[0]["open"] == ord("A") and one[0]["ts"] == dt.datetime(2023, 1, 2)
    assert len({r["ts"] for r in one}) == len(one) and max(r["ts"] for r in one) == dt.datetime(2024, 1, 31)
    reader = feed.FeedReader({"symbols": '["AB", "CD"]', "start": "2023-01-02", "end": "2024-02-01", "days": "100", "fetcher": "x:y"})
    assert len(reader.partitions()) == 2 * 4 and reader.partitions()[3].value == ("AB", "2023-10-29", "2024-02-01")


def test_feed_refuses(spark):
    with pytest.raises(ValueError, match="NONE"):
        feed.load_feed(spark, "fake_feed:fetch", ["AB", "NONE"], "2024-01-01", "2024-02-01")
    with pytest.raises(ValueError, match="high too low"):
        feed.load_feed(spark, "fake_feed:broken", ["AB"], "2024-01-01", "2024-02-01")
    with pytest.raises(ValueError, match="unknown interval"):
        feed.load_feed(spark, "fake_feed:fetch", ["AB"], "2024-01-01", "2024-02-01", "7m")
    assert feed.load_feed(spark, "fake_feed:fetch", ["AB"], "2023-01-01", "2024-02-01", "5m")[1]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("When,Open,High,Low,Close,Volume\n2024-01-02,1,2,1,2,5\n2024-01-01,1,2,1,1.5,4\n2024-01-02,1,3,1,2.5,6\n")
    got = clean.load_csv(spark, str(tmp_path / "a.csv"), "X").orderBy("bar").collect()
    assert [(r["symbol"], r["bar"], r["close"], r["volume"]) for r in got] == [("X", 0, 1.5, 4), ("X", 1, 2.5, 6)]
    (tmp_path / "b.csv").write_text("x,Date,AAPL Open,high_aapl,aapl_low,Close AAPL\n0,2024-01-01,1,2,1,2\n1,2024-01-02,,2,1,2\n")
    loose = clean.load_file(spark, str(tmp_path / "b.csv")).collect()
    assert len(loose) == 1 and loose[0]["volume"] == 0 and loose[0]["ts"] == dt.datetime(2024, 1, 1)
    spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0, 2.0, 1.0, 2.0, 3.0)], "index timestamp_ntz, open double, high double, low double, close double, vol_volume double").write.parquet(str(tmp_path / "c.parquet"))
    assert clean.load_file(spark, str(tmp_path / "c.parquet")).first()["volume"] == 3
    (tmp_path / "d.csv").write_text("Date,Open,High,Low\n2024-01-01,1,2,1\n")
    with pytest.raises(ValueError, match="close"):
        clean.load_file(spark, str(tmp_path / "d.csv"))


def test_alignment_guard(spark):
    a = synthetic.sample_bars(spark, days=30)
    metrics.check_aligned(a, a.select("symbol", "ts"), a.where("close > 0"))
    with pytest.raises(ValueError, match="1 times differ"):
        metrics.check_aligned(a, a.where("bar <> 7"))
    with pytest.raises(ValueError):
        metrics.check_aligned(a, a.unionByName(a.where("bar = 3")))


def test_divergence_needs_bars(spark):
    s = Session(spark)
    s.load_sample(days=47)
    with pytest.raises(ValueError, match="SAMPLE has 47"):
        s.divergence()
    s.load_sample(days=200)
    assert s.divergence().count() == 200


def test_neutral_columns_and_no_trades(spark):
    bars = synthetic.sample_bars(spark, days=40)
    off = P.make(pamrp_enabled=False, bbwp_enabled=False, pamrp_exit_enabled=False)
    got = signals.with_signals(bars, off)
    assert got.select(*signals.NEUTRAL).distinct().collect() == [(50.0,) * len(signals.NEUTRAL)]
    s = Session(spark)
    s.load(bars)
    s.set_params({"pamrp_enabled": False, "bbwp_enabled": False, "pamrp_exit_enabled": False})
    r = s.run().first().asDict()
    assert r["num_trades"] == r["profit_factor"] == r["win_rate"] == r["sharpe_ratio"] == 0 and r["final_equity"] == 10_000


def test_exported_trades(spark, tmp_path):
    s = Session(spark)
    s.load_sample(days=400)
    s.set_params({"rsi_enabled": True, "pamrp_enabled": False, "bbwp_enabled": False, "pamrp_exit_enabled": False, "rsi_length": 5, "rsi_oversold": 45, "take_profit_enabled": True})
    for which, rule in (("all", "true"), ("winners", "pnl > 0"), ("losers", "pnl <= 0")):
        s.export_trades(str(tmp_path / which), which, "long")
        back = spark.read.csv(str(tmp_path / which), header=True, inferSchema=True)
        assert back.count() == s.trades.where(rule).where("direction = 'long'").count()
    assert s.trades.agg(F.count("*")).first()[0] > 0
