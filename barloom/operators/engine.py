"""The event-driven backtest: one state machine per (symbol, parameter set), in one sorted pass.

Each bar in turn: an open position ages and its extremes move; stop orders (loss, profit,
trailing, range trailing), else the time limit, else the last bar's exit signal may close it;
then the last bar's entry signal may open one at this bar's open, which the same bar's range
may stop again. What is open at the end is closed at the last close.

Both sides run the same rules on prices times ``s`` (+1 long, -1 short): adverse is down,
favourable is up. Groups are independent, so a sweep is as parallel as it has parameter sets.

Rows come sorted by group and bar, a batch at a time; a group's state (cash, position, record, the
bar before) goes from batch to batch, so memory doesn't grow with the history. An exception in a
group ends that group alone: it becomes an event of kind ``error`` (exit_reason: the message), and
``sound`` leaves out whatever the group had given before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.signals import with_signals

CAPITAL, COMMISSION, SLIPPAGE = 10_000.0, 0.1, 0.0
STOPS = ("stop_loss", "take_profit", "trailing_stop", "atr_trailing")
KELLY_TRADES = 20
EVENTS = (
    "symbol string, param_id int, kind string, trade_no int, entry_idx int, entry_ts timestamp_ntz, entry_price double, direction string, size_dollars double, "
    "exit_idx int, exit_ts timestamp_ntz, exit_price double, exit_reason string, pnl double, pnl_pct double, bars_held int, mae double, mfe double, "
    "bar int, ts timestamp_ntz, mtm_equity double, realized_equity double, in_position boolean"
)
TRADE = ("symbol", "param_id", "trade_no", "entry_idx", "entry_ts", "entry_price", "direction", "size_dollars", "exit_idx", "exit_ts", "exit_price", "exit_reason", "pnl", "pnl_pct", "bars_held", "mae", "mfe")
EQUITY = ("symbol", "param_id", "bar", "ts", "mtm_equity", "realized_equity", "in_position")
SIGNALS = ("entry_long", "entry_short", "exit_long_signal", "exit_short_signal")


class Position:
    __slots__ = ("age", "at", "blocked", "entry", "hi", "lo", "s", "since", "size")

    def __init__(self, at: int, since: int | None, entry: float, s: int, size: float, hi: float, lo: float, blocked: set[str]):
        self.at, self.since, self.entry, self.s, self.size, self.hi, self.lo, self.blocked, self.age = at, since, entry, s, size, hi, lo, blocked, 0

    @property
    def side(self) -> str:
        return "long" if self.s > 0 else "short"

    def excursion(self) -> tuple[float, float]:
        """(worst, best) so far, in percent."""
        ends = [(self.s * x - self.s * self.entry) / self.entry * 100 for x in (self.lo, self.hi)]
        return min(ends), max(ends)


def stop_exit(pos: Position, opened: float, high: float, low: float, atr: float | None, p: Mapping[str, Any]) -> tuple[float, str] | None:
    """The stop order that this bar's range fills, if any: (price, reason)."""
    s, entry = pos.s, pos.entry
    adverse, favourable = (low, high) if s > 0 else (high, low)
    peak = pos.hi if s > 0 else pos.lo

    def hit(level: float) -> float | None:
        """A stop's fill: its level, or the open if that has gapped beyond."""
        return s * min(s * level, s * opened) if s * adverse <= s * level else None

    loss = hit(entry * (1 - s * p[f"stop_loss_pct_{pos.side}"] / 100)) if p["stop_loss_enabled"] else None
    profit = None
    if p["take_profit_enabled"]:
        target = entry * (1 + s * p[f"take_profit_pct_{pos.side}"] / 100)
        if s * favourable >= s * target:
            profit = s * max(s * target, s * opened)
    if profit is not None and (loss is None or abs(opened - profit) <= abs(opened - loss)):
        return profit, "take_profit"
    if loss is not None:
        return loss, "stop_loss"
    if p["trailing_stop_enabled"] and s * peak >= s * (entry * (1 + s * p["trailing_stop_activation"] / 100)):
        if (fill := hit(peak * (1 - s * p["trailing_stop_pct"] / 100))) is not None:
            return fill, "trailing_stop"
    if p["atr_trailing_enabled"] and atr is not None and atr == atr:
        if (fill := hit(peak - s * (atr * p["atr_multiplier"]))) is not None:
            return fill, "atr_trailing"
    return None


class Account:
    """Cash and the realised record that Kelly sizing reads."""

    def __init__(self, capital: float, p: Mapping[str, Any]):
        self.cash, self.p = capital, p
        self.wins: list[float] = [0, 0.0]
        self.losses: list[float] = [0, 0.0]

    def record(self, pnl: float, pct: float) -> None:
        book = self.wins if pnl > 0 else self.losses
        book[0] += 1
        book[1] += abs(pct)

    def stake(self) -> float:
        p, trades = self.p, self.wins[0] + self.losses[0]
        rate = self.wins[0] / trades if trades else 0.5
        share = p["position_size_pct"] / 100
        if p["use_kelly"] and rate > 0:
            won, lost = (x[1] / x[0] if x[0] else 0.0 for x in (self.wins, self.losses))
            if trades < KELLY_TRADES or lost <= 0:
                won = p["take_profit_pct_long"] if p["take_profit_enabled"] else 5.0
                lost = p["stop_loss_pct_long"] if p["stop_loss_enabled"] else 3.0
            odds = won / max(lost, 0.01)
            share = max(0.0, min((odds * rate - (1 - rate)) / odds if odds > 0 else 0.0, 1.0)) * p["kelly_fraction"]
        return self.cash * min(share, 1.0)


class Machine:
    """One group's account from bar to bar; what happens is added to ``trades`` and ``curve``, which may be emptied at any time."""

    def __init__(self, p: Mapping[str, Any], costs: tuple[float, float, float], exits: Mapping[str, Sequence[str]]):
        self.p, self.exits, self.defer = p, exits, p["entry_exit_conflict_mode"] == "defer"
        capital, self.commission, slippage = costs
        self.slip, self.account = slippage / 100, Account(capital, p)
        self.pos: Position | None = None
        self.i, self.n = -1, 0
        self.before: tuple[dict[str, bool], dict[str, dict[str, bool]]] | None = None
        self.last: tuple[int | None, float, tuple[float, float, bool]] = (None, 0.0, (capital, capital, False))
        self.trades: list[dict[str, Any]] = []
        self.curve: list[tuple] = []

    def _close(self, at: int | None, price: float, reason: str) -> None:
        pos = self.pos
        if reason not in STOPS:
            price *= 1 - pos.s * self.slip
        pct = (pos.s * price - pos.s * pos.entry) / pos.entry * 100 - self.commission * 2
        pnl = pos.size * (pct / 100)
        self.account.cash += pos.size + pnl
        self.account.record(pnl, pct)
        mae, mfe = pos.excursion()
        self.trades.append({
            "trade_no": self.n, "entry_idx": pos.at, "entry_ts": pos.since, "entry_price": pos.entry, "direction": pos.side, "size_dollars": pos.size, "exit_idx": self.i,
            "exit_ts": at, "exit_price": price, "exit_reason": reason, "pnl": pnl, "pnl_pct": pct, "bars_held": pos.age, "mae": mae, "mfe": mfe,
        })
        self.n += 1
        self.pos = None

    def _wants_out(self, signals: Mapping[str, bool], each: Mapping[str, Mapping[str, bool]]) -> bool:
        pos, side = self.pos, self.pos.side
        if not self.defer or not pos.blocked:
            return signals[f"exit_{side}_signal"]
        pos.blocked = {k for k in pos.blocked if each[side][k]}
        said = [each[side][k] and k not in pos.blocked for k in self.exits[side]]
        return bool(said) and (any if self.p["exit_operator"] == "or" else all)(said)

    def step(self, ts: int | None, opened: float, high: float, low: float, close: float, atr: float | None, signals: Mapping[str, bool], each: Mapping[str, Mapping[str, bool]]) -> None:
        """The next bar; ``signals`` and ``each`` (exits by side and spec) are this bar's, and act on the next."""
        if None in (opened, high, low, close):
            raise ValueError("a price is missing")
        self.i += 1
        if self.i:
            self.curve.append((self.i - 1, self.last[0], *self.last[2]))
            self._bar(ts, opened, high, low, atr, *self.before)
            pos, cash = self.pos, self.account.cash
            size = pos.size if pos else 0.0
            gain = size * ((pos.s * close - pos.s * pos.entry) / pos.entry) if pos else 0.0
            self.last = ts, close, (cash + size + gain, cash + size, self.held)
        else:
            self.last = ts, close, self.last[2]
        self.before = signals, each

    def _bar(self, ts: int | None, opened: float, high: float, low: float, atr: float | None, before: Mapping[str, bool], each: Mapping[str, Mapping[str, bool]]) -> None:
        p, pos = self.p, self.pos
        self.held, may_enter, closed = pos is not None, True, 0
        if pos is not None:
            pos.age += 1
            pos.hi, pos.lo = max(pos.hi, high), min(pos.lo, low)
            done = stop_exit(pos, opened, high, low, atr, p)
            if done is None and p["time_exit_enabled"] and pos.age >= p[f"time_exit_bars_{pos.side}"]:
                done = opened, "time_exit"
            if done is None and self._wants_out(before, each):
                done = opened, "signal"
            if done is not None:
                self._close(ts, *done)
                closed, may_enter = pos.s, done[1] not in STOPS and p["allow_same_bar_reversal"]
        if self.pos is not None or not may_enter or not (before["entry_long"] or before["entry_short"]):
            return
        go = {s: before[f"entry_{side}"] and closed != s for s, side in ((1, "long"), (-1, "short"))}
        if p["entry_exit_conflict_mode"] == "skip":
            go = {s: g and not before[f"exit_{'long' if s > 0 else 'short'}_signal"] for s, g in go.items()}
        if go[1] and go[-1]:
            go = {s: p["entry_conflict_mode"] == f"prefer_{'long' if s > 0 else 'short'}" for s in go}
        s = 1 if go[1] else -1 if go[-1] else 0
        if s:
            side = "long" if s > 0 else "short"
            blocked = {k for k in self.exits[side] if each[side][k]} if self.defer else set()
            self.pos = Position(self.i, ts, opened * (1 + s * self.slip), s, self.account.stake(), high, low, blocked)
            self.account.cash -= self.pos.size
            if p["allow_same_bar_exit"] and (done := stop_exit(self.pos, opened, high, low, atr, p)) is not None:
                self._close(ts, *done)

    def finish(self) -> None:
        ts, close, marks = self.last
        if self.pos is not None:
            self._close(ts, close, "end_of_data")
            marks = (self.account.cash, self.account.cash, marks[2])
        self.curve.append((self.i, ts, *marks))


_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us")}
_FIELDS = pa.schema([(n, _ARROW[t]) for n, t in map(str.split, EVENTS.split(", "))])
#: Event rows that are sent on at once.
ROWS = 20_000


def _table(n: int, **columns: Any) -> pa.RecordBatch:
    """``n`` event rows; columns that aren't given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _FIELDS], schema=_FIELDS)


class _Group:
    """A group's machine, or what went wrong with it."""

    def __init__(self, symbol: str | None, ident: int | None, make: Callable[[int | None], Machine]):
        self.symbol, self.ident, self.error = symbol, ident, None
        try:
            self.machine: Machine | None = make(ident)
        except Exception as e:
            self.fail(e)

    def fail(self, e: Exception) -> None:
        self.machine, self.error = None, f"{type(e).__name__}: {e}"

    def step(self, *bar: Any) -> None:
        if self.machine is not None:
            try:
                self.machine.step(*bar)
            except Exception as e:
                self.fail(e)

    def events(self, keep_equity: bool, end: bool) -> Iterator[pa.RecordBatch]:
        same = lambda n, kind: {"symbol": [self.symbol] * n, "param_id": [self.ident] * n, "kind": [kind] * n}
        m = self.machine
        if m is None:
            if end:
                yield _table(1, **same(1, "error"), exit_reason=[self.error])
            return
        if end:
            m.finish()
        if m.trades:
            yield _table(len(m.trades), **same(len(m.trades), "trade"), **{k: [t[k] for t in m.trades] for k in m.trades[0]})
        if m.curve and keep_equity:
            bar, ts, marked, realized, held = zip(*m.curve, strict=True)
            yield _table(len(bar), **same(len(bar), "equity"), bar=bar, ts=ts, mtm_equity=marked, realized_equity=realized, in_position=held)
        m.trades, m.curve = [], []


def _events(names: Sequence[str], params: Mapping[int, Mapping[str, Any]], costs: Mapping[int, tuple[float, float, float]], keep_equity: bool) -> Callable:
    """Rows in order of symbol, param_id and bar -> events."""
    exits = {side: [c.removeprefix(f"exit_{side}_") for c in names if c.startswith(f"exit_{side}_") and c != f"exit_{side}_signal"] for side in ("long", "short")}
    new = lambda ident: Machine(params[ident], costs[ident], exits)

    def values(c: pa.Array) -> list:
        """By way of NumPy where nothing is missing, which is many times faster."""
        if c.null_count or not len(c):
            return c.to_pylist()
        if pa.types.is_string(c.type):
            c = c.dictionary_encode()
            known = c.dictionary.to_pylist()
            return [known[i] for i in c.indices.to_numpy().tolist()]
        return c.to_numpy(zero_copy_only=False).tolist()

    def columns(batch: pa.RecordBatch) -> dict[str, list]:
        at = {name: batch.column(i) for i, name in enumerate(names)}
        return {n: values(c.cast(pa.timestamp("us")).cast(pa.int64()) if n == "ts" else c) for n, c in at.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: _Group | None = None
        held = 0
        for batch in batches:
            c = columns(batch)
            none = [None] * batch.num_rows
            signals = [dict(zip(SIGNALS, map(bool, row), strict=True)) for row in zip(*(c[k] for k in SIGNALS), strict=True)]
            each = [{side: {k: bool(c[f"exit_{side}_{k}"][r]) for k in ks} for side, ks in exits.items()} for r in range(batch.num_rows)] if any(p["entry_exit_conflict_mode"] == "defer" for p in params.values()) else [{}] * batch.num_rows
            for symbol, ident, *bar in zip(c["symbol"], c["param_id"], c["ts"], c["open"], c["high"], c["low"], c["close"], c.get("atr", none), signals, each, strict=True):
                if group is None or (symbol, ident) != (group.symbol, group.ident):
                    if group is not None:
                        yield from group.events(keep_equity, end=True)
                    group, held = _Group(symbol, ident, new), 0
                group.step(*bar)
                held += 1
                if held >= ROWS:
                    yield from group.events(keep_equity, end=False)
                    held = 0
        if group is not None:
            yield from group.events(keep_equity, end=True)

    return work


def run(signals: DataFrame, params: Mapping[int, Mapping[str, Any]], capital: float = CAPITAL, commission: float = COMMISSION, slippage: float = SLIPPAGE, costs: Mapping[int, tuple[float, float, float]] | None = None, keep_equity: bool = True) -> DataFrame:
    """Event rows (kind trade, equity or error) for every (symbol, param_id) of ``signals``.

    ``signals`` has bars, the signal columns and param_id; ``params`` maps param_id to its
    parameters; ``costs`` to (capital, commission, slippage) where they differ.
    """
    costs = costs or {k: (capital, commission, slippage) for k in params}
    wanted = [c for c in signals.columns if c in ("symbol", "param_id", "bar", "ts", "open", "high", "low", "close", "atr") or c.startswith(("entry_", "exit_"))]
    plain = {k: dict(v) for k, v in params.items()}
    rows = signals.select(*wanted).repartition("symbol", "param_id").sortWithinPartitions("symbol", "param_id", "bar")
    return rows.mapInArrow(_events(wanted, plain, costs, keep_equity), EVENTS)


def errors_of(events: DataFrame) -> DataFrame:
    """(symbol, param_id, message) of the groups that failed."""
    return events.where("kind = 'error'").select("symbol", "param_id", F.col("exit_reason").alias("message"))


def sound(events: DataFrame) -> DataFrame:
    """``events`` (best a saved or cached table: they are read twice) without those of groups that failed."""
    failed = errors_of(events).select(F.col("symbol").alias("_s"), F.col("param_id").alias("_p"))
    return events.join(failed, F.col("symbol").eqNullSafe(F.col("_s")) & F.col("param_id").eqNullSafe(F.col("_p")), "left_anti")


def trades_of(events: DataFrame) -> DataFrame:
    return events.where("kind = 'trade'").select(*TRADE)


def equity_of(events: DataFrame) -> DataFrame:
    return events.where("kind = 'equity'").select(*EQUITY)


def backtest(bars: DataFrame, params: Mapping[str, Any], capital: float = CAPITAL, commission: float = COMMISSION, slippage: float = SLIPPAGE) -> DataFrame:
    """Indicators, signals and the engine for one parameter set over all symbols."""
    return run(with_signals(bars, dict(params)).withColumn("param_id", F.lit(0)), {0: params}, capital, commission, slippage)
