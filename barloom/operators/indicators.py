"""Indicators as a plan of columns.

A ``Plan`` collects the columns that are wanted. Each is named by its function and arguments,
so equal requests are one column. Window columns are built-in functions; series in which a
value depends on the previous *output* (exponential means, supertrend) and order statistics of
long windows are folds, and all folds of one dependency level run in one grouped pass.

A symbol of up to ``BLOCK`` bars is one group. Where a symbol has more, its bars are dealt to blocks:

* Exponential means are maps y -> a y + b. Each block composes its own (``summary``), a scan over the
  blocks' maps gives each the value it starts from, and the blocks are then worked out side by side.
* Windows of order statistics take the bars that they look back at along from the blocks before.
* Supertrend has no such composition: it goes through the sorted bars, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import order
from barloom.functions import windows as W
from barloom.sources.shared import saved

KEYS = ("symbol", "fold", "param_id", "perm_id")
#: Bars of a group; Spark's estimate of bytes under which no symbol is looked at for more; values from which windows are ordered by a tree.
BLOCK, SMALL_BYTES, LONG_WINDOW = 1 << 16, 32 << 20, 64


def _supertrend(close: np.ndarray, upper: np.ndarray, lower: np.ndarray, state: tuple[float, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(line, direction): the close against the line before picks the side; a side's line only tightens. ``state``: those of the bar before."""
    line, side = np.empty(len(close)), np.empty(len(close))
    if state is None and len(close):
        line[0], side[0] = upper[0], -1.0
    held, way = state or (upper[0], -1.0)
    for i in range(state is None, len(close)):
        now = 1.0 if close[i] > held else -1.0 if close[i] < held else way
        fresh = lower[i] if now > 0 else upper[i]
        if now == way and (fresh < held if now > 0 else fresh > held):
            fresh = held
        held, way = fresh, now
        line[i], side[i] = held, way
    return line, side


class Plan:
    def __init__(self) -> None:
        self._level: dict[str, tuple[int, int]] = {}  # column -> (fold level, projection within it)
        self._columns: dict[str, Callable[[], Column]] = {}
        self._folds: dict[str, tuple[int, str, tuple]] = {}  # output -> (level, kind, arguments)

    def _place(self, needs: tuple[str, ...]) -> tuple[int, int]:
        return max((self._level.get(n, (0, 0)) for n in needs), default=(0, 0))

    def column(self, name: str, needs: tuple[str, ...], build: Callable[[], Column]) -> str:
        if name not in self._level:
            level, step = self._place(needs)
            self._level[name], self._columns[name] = (level, step + 1), build
        return name

    def _fold(self, name: str, needs: tuple[str, ...], kind: str, args: tuple) -> str:
        if name not in self._level:
            level = self._place(needs)[0]
            self._level[name], self._folds[name] = (level + 1, 0), (level, kind, args)
        return name

    # moving averages

    def sma(self, x: str, n: int) -> str:
        return self.column(f"sma_{x}_{n}", (x,), lambda: W.sma(x, n))

    def wma(self, x: str, n: int) -> str:
        return self.column(f"wma_{x}_{n}", (x,), lambda: W.wma(x, n))

    def ema(self, x: str, n: int) -> str:
        return self._fold(f"ema_{x}_{n}", (x,), "ewm", (x, 2 / (n + 1)))

    def rma(self, x: str, n: int) -> str:
        return self._fold(f"rma_{x}_{n}", (x,), "ewm", (x, 1 / n))

    def vwma(self, x: str, n: int) -> str:
        return self.column(f"vwma_{x}_{n}", (x, "volume"), lambda: W.vwma(x, "volume", n))

    def ma(self, x: str, n: int, kind: str) -> str:
        kinds = {"sma": self.sma, "ema": self.ema, "wma": self.wma, "rma": self.rma, "vwma": self.vwma}
        if kind.lower() not in kinds:
            raise ValueError(f"unknown moving average {kind!r}; one of {', '.join(kinds)}")
        return kinds[kind.lower()](x, n)

    # oscillators

    def percentile_rank(self, x: str, lookback: int) -> str:
        if lookback > LONG_WINDOW:
            return self._fold(f"rank_{x}_{lookback}", (x,), "rank", (x, lookback))
        return self.column(f"rank_{x}_{lookback}", (x,), lambda: W.percentile_rank(x, lookback))

    def pamrp(self, length: int, lookback: int, kind: str = "sma") -> str:
        mean = self.ma("close", length, kind)
        part = self.column(f"pamr_{mean}", (mean,), lambda: W.ratio(F.col("close"), F.col(mean)))
        return self.percentile_rank(part, lookback)

    def band_width(self, length: int, mult: float = 2.0) -> str:
        return self.column(f"bbw_{length}_{mult:g}".replace(".", "p"), ("close",), lambda: W.band_width("close", length, mult))

    def bbwp(self, length: int, lookback: int) -> str:
        return self.percentile_rank(self.band_width(length), lookback)

    def true_range(self) -> str:
        return self.column("true_range", (), W.true_range)

    def atr(self, n: int) -> str:
        return self.rma(self.true_range(), n)

    def rsi(self, n: int) -> str:
        move = self.column("move", (), lambda: F.col("close") - W.previous("close"))
        gain = self.column("gain", (move,), lambda: F.when(F.col(move) > 0, F.col(move)).otherwise(0.0))
        loss = self.column("loss", (move,), lambda: F.when(F.col(move) < 0, -F.col(move)).otherwise(0.0))
        g, ls = self.rma(gain, n), self.rma(loss, n)
        return self.column(f"rsi_{n}", (g, ls), lambda: F.when(F.col(ls) == 0, None).when(F.col(g) == 0, 0.0).otherwise(100 - 100 / (1 + W.ratio(F.col(g), F.col(ls)))))

    def stoch_rsi(self, length: int, stoch: int, k: int, d: int) -> tuple[str, str]:
        r = self.rsi(length)
        low, high = lambda: F.min(r).over(W.last(stoch)), lambda: F.max(r).over(W.last(stoch))
        raw = self.column(f"stoch_{r}_{stoch}", (r,), lambda: W.full(r, stoch, W.ratio(F.col(r) - low(), high() - low()) * 100))
        fast = self.sma(raw, k)
        return fast, self.sma(fast, d)

    def macd(self, fast: int, slow: int, signal: int) -> tuple[str, str, str]:
        a, b = self.ema("close", fast), self.ema("close", slow)
        line = self.column(f"macd_{fast}_{slow}", (a, b), lambda: F.col(a) - F.col(b))
        sig = self.ema(line, signal)
        return line, sig, self.column(f"hist_{fast}_{slow}_{signal}", (line, sig), lambda: F.col(line) - F.col(sig))

    def adx(self, length: int, smoothing: int) -> tuple[str, str, str]:
        up = self.column("up_move", (), lambda: F.col("high") - W.previous("high"))
        down = self.column("down_move", (), lambda: W.previous("low") - F.col("low"))
        plus = self.column("plus_dm", (up, down), lambda: F.when((F.col(up) > F.col(down)) & (F.col(up) > 0), F.col(up)).otherwise(0.0))
        minus = self.column("minus_dm", (up, down), lambda: F.when((F.col(down) > F.col(up)) & (F.col(down) > 0), F.col(down)).otherwise(0.0))
        width, p, m = self.atr(length), self.rma(plus, length), self.rma(minus, length)
        pdi = self.column(f"plus_di_{length}", (p, width), lambda: W.ratio(F.col(p), F.col(width)) * 100)
        mdi = self.column(f"minus_di_{length}", (m, width), lambda: W.ratio(F.col(m), F.col(width)) * 100)
        dx = self.column(f"dx_{length}", (pdi, mdi), lambda: F.coalesce(W.ratio(F.abs(F.col(pdi) - F.col(mdi)), F.col(pdi) + F.col(mdi)) * 100, F.lit(0.0)))
        return pdi, mdi, self.rma(dx, smoothing)

    def supertrend(self, period: int, mult: float) -> tuple[str, str]:
        width = self.atr(period)
        tag = f"{period}_{mult:g}".replace(".", "p")
        upper = self.column(f"st_upper_{tag}", (width,), lambda: (F.col("high") + F.col("low")) / 2 + mult * F.col(width))
        lower = self.column(f"st_lower_{tag}", (width,), lambda: (F.col("high") + F.col("low")) / 2 - mult * F.col(width))
        line = self._fold(f"supertrend_{tag}", (upper, lower), "supertrend", ("close", upper, lower))
        self._level[f"{line}_dir"] = self._level[line]
        return line, f"{line}_dir"

    def vwap(self) -> str:
        return self.column("vwap", (), W.vwap)

    def hidden_divergence(self, length: int = 14, left: int = 5, right: int = 5, pivots: int = 5, confirm: bool = False) -> tuple[str, str]:
        """(bullish, bearish) marks on the pivot bar; ``confirm`` puts them ``right`` bars later, when they are known."""
        r = self.rsi(length)
        out = []
        for name, low in (("bull", True), ("bear", False)):
            tag = f"{name}_{length}_{left}_{right}"
            pp = self.column(f"pivot_close_{tag}", (), lambda low=low: W.pivot("close", left, right, low))
            pr = self.column(f"pivot_rsi_{tag}", (r,), lambda low=low: W.pivot(r, left, right, low))
            before = W.bars().rowsBetween(-(2**31), -1)

            def seen(flag: str, before=before) -> Column:
                point = F.struct("bar", F.col("close").alias("c"), F.col(r).alias("r"))
                return F.slice(F.reverse(F.collect_list(F.when(F.col(flag), point)).over(before)), 1, pivots)

            a = self.column(f"seen_close_{tag}_{pivots}", (pp, pr), lambda pp=pp, seen=seen: seen(pp))
            b = self.column(f"seen_rsi_{tag}_{pivots}", (pp, pr), lambda pr=pr, seen=seen: seen(pr))

            def diverges(pp=pp, pr=pr, a=a, b=b, low=low) -> Column:
                c, v = F.col("close"), F.col(r)
                hit = F.exists(F.array_intersect(a, b), lambda j: ((c > j["c"]) & (v < j["r"])) if low else ((c < j["c"]) & (v > j["r"])))
                return F.coalesce(F.col(pp) & F.col(pr) & (F.col("bar") >= right) & hit, F.lit(False))

            mark = self.column(f"hidden_{tag}_{pivots}", (a, b), diverges)
            if confirm:
                mark = self.column(f"{mark}_confirmed", (mark,), lambda mark=mark: F.coalesce(W.previous(mark, right), F.lit(False)))
            out.append(mark)
        return out[0], out[1]

    def range_bands(self, lookback: int, z: tuple[float, ...]) -> dict[str, str]:
        self.column("log_return", (), lambda: W.log_return("close"))
        name = lambda k: f"hpdr_{lookback}_{k}".replace(".", "p")
        built = W.range_bands("close", lookback, z)
        if lookback > LONG_WINDOW:
            shares = W.band_shares(z)
            out = {k: self._fold(name(k), (), "quantile", ("close", lookback, share)) for k, share in shares.items()}
            return out | {k: self.column(name(k), ("log_return",), lambda c=c: c) for k, c in built.items() if k not in shares}
        return {k: self.column(name(k), ("log_return",), lambda c=c: c) for k, c in built.items()}

    def apply(self, bars: DataFrame) -> DataFrame:
        """``bars`` with every column of the plan."""
        top = max((level for level, _ in self._level.values()), default=0)
        for level in range(top + 1):
            mine = {n: step for n, (at, step) in self._level.items() if at == level and n in self._columns}
            for step in sorted(set(mine.values())):
                bars = bars.withColumns({n: self._columns[n]() for n, s in mine.items() if s == step})
            folds = {n: (kind, args) for n, (at, kind, args) in self._folds.items() if at == level}
            if folds:
                bars = _run_folds(bars, folds)
        return bars


def _added(folds: dict[str, tuple[str, tuple]]) -> list[str]:
    return [c for n, (kind, _) in folds.items() for c in ([n, f"{n}_dir"] if kind == "supertrend" else [n])]


def _schema(bars: DataFrame, added: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema) + "".join(f", `{c}` double" for c in added)


def _keys(bars: DataFrame) -> list[str]:
    return [k for k in KEYS if k in bars.columns]


def _values(group: pd.DataFrame, folds: dict[str, tuple[str, tuple]]) -> dict[str, np.ndarray | pd.Series]:
    """The folds' columns over a group in order of bar."""
    new: dict[str, np.ndarray | pd.Series] = {}
    quantiles: dict[tuple, dict[float, str]] = {}
    for n, (kind, args) in folds.items():
        if kind == "ewm":
            new[n] = group[args[0]].astype(float).ewm(alpha=args[1], adjust=False).mean()
        elif kind == "rank":
            new[n] = order.sliding_rank(group[args[0]].to_numpy(float), args[1])
        elif kind == "quantile":
            quantiles.setdefault(args[:2], {})[args[2]] = n
        else:
            new[n], new[f"{n}_dir"] = _supertrend(*(group[a].to_numpy(float) for a in args))
    for (x, lookback), named in quantiles.items():
        new |= dict(zip(named.values(), order.sliding_quantiles(group[x].to_numpy(float), lookback, tuple(named)), strict=True))
    return new


def _any_long(bars: DataFrame) -> bool:
    """Whether a symbol has more than ``BLOCK`` bars. Small input isn't counted: the answer only picks the way, not the result."""
    if int(str(bars._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_BYTES:
        return False
    return (bars.agg(F.max("bar")).first()[0] or 0) >= BLOCK


def _run_folds(bars: DataFrame, folds: dict[str, tuple[str, tuple]]) -> DataFrame:
    """All ``folds`` of a level in one grouped pass, or in blocks."""
    if _any_long(bars):
        return _run_blocks(bars, folds)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bar")
        return group.assign(**_values(group, folds))

    return bars.groupBy(*_keys(bars)).applyInPandas(run, _schema(bars, _added(folds)))


# blocks of long symbols


def summary(x: np.ndarray, alpha: float) -> tuple[int, float, float, float, int]:
    """A block's map of an exponential mean, as (values before the first one that is there, that one, a, b, values
    behind the last): from the mean y at the first value on, the block ends with a y + b. Without a value: (n, NaN, 1, 0, n)."""
    there = np.flatnonzero(~np.isnan(x))
    if not len(there):
        return len(x), float("nan"), 1.0, 0.0, len(x)
    kept = (1 - alpha) ** np.diff(there)  # what is left of the mean's weight where values are missing
    rest = x[there[0] :].copy()
    rest[0] = 0.0
    return int(there[0]), float(x[there[0]]), float(np.prod(kept / (kept + alpha))), float(pd.Series(rest).ewm(alpha=alpha, adjust=False).mean().iloc[-1]), len(x) - 1 - int(there[-1])


def entered(y: float, weight: float, first: int, x: float, alpha: float) -> float:
    """The mean at a block's first value x, after ``first`` missing ones, from the mean y before it and its weight."""
    left = weight * (1 - alpha) ** (first + 1)
    return x if np.isnan(y) else y if y == x else (left * y + alpha * x) / (left + alpha)


def scan(blocks: list[tuple[int, float, float, float, int]], alpha: float) -> list[tuple[float, float]]:
    """(mean, its weight) that each block starts from."""
    out, y, weight = [], float("nan"), 1.0
    for first, x, a, b, behind in blocks:
        out.append((y, weight))
        if np.isnan(x):
            weight *= (1 - alpha) ** first
        else:
            y, weight = a * entered(y, weight, first, x, alpha) + b, (1 - alpha) ** behind
    return out


def _run_blocks(bars: DataFrame, folds: dict[str, tuple[str, tuple]]) -> DataFrame:
    means = {n: args for n, (kind, args) in folds.items() if kind == "ewm"}
    orders = {n: f for n, f in folds.items() if f[0] in ("rank", "quantile")}
    keys = _keys(bars)
    bars = saved(bars.withColumn("_block", F.floor(F.col("bar") / BLOCK)))
    if means:
        bars = _means(bars, keys, means)
    if orders:
        bars = _orders(bars, keys, orders)
    for n, (kind, args) in folds.items():
        if kind == "supertrend":
            bars = _streamed(bars, keys, n, args)
    return bars.drop("_block")


def _means(bars: DataFrame, keys: list[str], means: dict[str, tuple[str, float]]) -> DataFrame:
    """Three passes: every block's maps, the scan over a symbol's blocks, and the blocks from where they start."""
    parts = ("first", "x", "a", "b", "behind")
    kinds = {f.name: f.dataType.simpleString() for f in bars.schema}
    key = ", ".join(f"`{k}` {kinds[k]}" for k in (*keys, "_block"))

    def maps(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bar")
        row = {k: group[k].iloc[0] for k in (*keys, "_block")}
        for i, (x, alpha) in enumerate(means.values()):
            row |= {f"{p}{i}": v for p, v in zip(parts, summary(group[x].to_numpy(float), alpha), strict=True)}
        return pd.DataFrame([row])

    def starts(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_block")
        out = group[[*keys, "_block"]].copy()
        for i, (_, alpha) in enumerate(means.values()):
            rows = list(zip(*(group[f"{p}{i}"] for p in parts), strict=True))
            out[[f"_y{i}", f"_w{i}"]] = scan([(int(f), x, a, b, int(e)) for f, x, a, b, e in rows], alpha)
        return out

    def apply(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bar")
        new = {}
        for i, (n, (x, alpha)) in enumerate(means.items()):
            y, weight, values = group[f"_y{i}"].iloc[0], group[f"_w{i}"].iloc[0], group[x].to_numpy(float).copy()
            there = np.flatnonzero(~np.isnan(values))
            first = int(there[0]) if len(there) else len(values)
            if len(there):
                values[first] = entered(y, weight, first, values[first], alpha)
            mean = pd.Series(values).ewm(alpha=alpha, adjust=False).mean().to_numpy(copy=True)
            mean[:first] = y
            new[n] = mean
        return group.assign(**new).drop(columns=carried)

    carried = [f"_{c}{i}" for i in range(len(means)) for c in "yw"]
    numbers = ", ".join(f"first{i} long, x{i} double, a{i} double, b{i} double, behind{i} long" for i in range(len(means)))
    of_blocks = bars.groupBy(*keys, "_block").applyInPandas(maps, f"{key}, {numbers}")
    from_ = of_blocks.groupBy(*keys).applyInPandas(starts, f"{key}, " + ", ".join(f"{c} double" for c in carried))
    return bars.join(saved(from_), [*keys, "_block"]).select(*bars.columns, *carried).groupBy(*keys, "_block").applyInPandas(apply, _schema(bars, list(means)))


def _orders(bars: DataFrame, keys: list[str], orders: dict[str, tuple[str, tuple]]) -> DataFrame:
    """Each block with the bars before it that its windows look back at."""
    reach = max(args[1] for _, args in orders.values())
    home = F.col("_block")
    dealt = bars.withColumn("_at", F.explode(F.sequence(home, F.floor((F.col("bar") + reach) / BLOCK))))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bar")
        return group.assign(**_values(group, orders))[group["_block"].to_numpy() == group["_at"].to_numpy()].drop(columns="_at")

    return dealt.groupBy(*keys, "_at").applyInPandas(run, _schema(bars, list(orders)))


def _streamed(bars: DataFrame, keys: list[str], name: str, args: tuple) -> DataFrame:
    """Supertrend over sorted bars; what goes from batch to batch is a symbol's last line and direction."""
    names = bars.columns

    def work(batches):
        now, state = None, None
        for batch in batches:
            group = batch.to_pandas()
            line, side = np.empty(len(group)), np.empty(len(group))
            change = np.flatnonzero((group[keys] != group[keys].shift()).any(axis=1).to_numpy())
            for a, b in zip(change, [*change[1:], len(group)], strict=True):
                mine = tuple(group[keys].iloc[a])
                state = state if mine == now else None
                line[a:b], side[a:b] = _supertrend(*(group[x].to_numpy(float)[a:b] for x in args), state)
                now, state = mine, (line[b - 1], side[b - 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(line), pa.array(side)], names=[*names, name, f"{name}_dir"])

    ordered = bars.repartition(*keys).sortWithinPartitions(*keys, "bar")
    return ordered.mapInArrow(work, _schema(bars, [name, f"{name}_dir"]))
