"""Bars from any fetching function, as a Spark data source: a partition is one symbol and one stretch of days.

The fetcher is named by import path (``module:function``), so executors import it; it takes (symbol, start, end,
interval), days as ISO text and the end exclusive, and returns rows (time, open, high, low, close, volume).
"""

from __future__ import annotations

import datetime as dt
import importlib
import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from barloom.sources.clean import clamp_range, clean, validate
from barloom.sources.shared import saved

SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, seq long"


class Stretch(InputPartition):
    def __init__(self, symbol: str, start: str, end: str):
        super().__init__((symbol, start, end))


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.symbols: list[str] = json.loads(options["symbols"])
        self.start, self.end = (dt.date.fromisoformat(options[k][:10]) for k in ("start", "end"))
        self.interval, self.days, self.fetcher = options.get("interval", "1d"), int(options.get("days", "366")), options["fetcher"]

    def partitions(self) -> Sequence[InputPartition]:
        cuts = [self.start + dt.timedelta(days=i) for i in range(0, max(0, (self.end - self.start).days), self.days)]
        ends = [*cuts[1:], self.end]
        return [Stretch(s, a.isoformat(), b.isoformat()) for s in self.symbols for a, b in zip(cuts, ends, strict=True)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.fetcher.partition(":")
        symbol, start, end = partition.value
        for seq, (ts, *prices) in enumerate(getattr(importlib.import_module(module), name)(symbol, start, end, self.interval)):
            yield (symbol, ts, *(None if x is None else float(x) for x in prices), seq)


class Feed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bar_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(dict(self.options))


def load_feed(spark: SparkSession, fetcher: str, symbols: Sequence[str], start: str, end: str, interval: str = "1d", days: int = 366) -> tuple[DataFrame, bool]:
    """(clean, valid bars, whether the start was moved to what the interval offers)."""
    first, clamped = clamp_range(start, end, interval)
    spark.dataSource.register(Feed)
    rows = spark.read.format(Feed.name()).options(fetcher=fetcher, symbols=json.dumps(list(symbols)), start=first, end=end, interval=interval, days=str(days)).load()
    bars = validate(clean(saved(rows), "seq"))  # fetched once: checks and uses read what was written
    if missing := set(symbols) - {r[0] for r in bars.select("symbol").distinct().collect()}:
        raise ValueError(f"no bars for {', '.join(sorted(missing))} ({interval}, {first} to {end})")
    return bars, clamped
