"""Searching parameters: many backtests as rows of one job.

Trials, folds, costs and grids are parameter sets with a ``param_id``; indicators are computed
once for each distinct request, whatever the number of sets, and the engine runs a group for
each (symbol, param_id). An error of one of them is its own result: no value (-inf) for a trial,
0 in a heat map, a cost level or a symbol that is left out.
"""

from __future__ import annotations

import itertools
import math
import threading
import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.windows import ratio
from barloom.operators import engine, metrics, specs
from barloom.operators import params as P
from barloom.operators.indicators import Plan
from barloom.operators.signals import SIDES, edge, sure
from barloom.sources.shared import saved

Params = dict[str, Any]
FAILED = float("-inf")


# many parameter sets over the same bars


def _planned(plan: Plan, p: Params) -> tuple[dict[str, tuple[str, ...]], dict[tuple[str, str], Column]]:
    """A set's indicator columns, added to ``plan``, and its masks by spec and side."""
    columns = {s.key: s.compute(plan, p) for s in specs.enabled(p) if s.compute}
    masks = {(s.key, side): sure(getattr(s, side)(p, columns[s.key])) for s in specs.enabled(p) if s.long for side in SIDES}
    return columns, masks


def _kinds(sets: Mapping[int, Params]) -> dict[int, tuple]:
    """What each set's signals depend on: all but what only the engine reads. Sets of one kind have the same signals."""
    engine_only = {x.name for s in specs.all_specs() if not s.compute and not s.long for x in s.params if x.name != s.flag}
    return {ident: tuple((k, repr(v)) for k, v in sorted(p.items()) if k not in engine_only) for ident, p in sets.items()}


def unusable(sets: Mapping[int, Params]) -> dict[int, str]:
    """What is wrong with the sets that no signals can be made of."""
    wrong: dict[tuple, str | None] = {}
    kinds = _kinds(sets)
    for ident, kind in kinds.items():
        if kind not in wrong:
            try:
                _planned(Plan(), sets[ident])
                wrong[kind] = None
            except Exception as e:
                wrong[kind] = f"{type(e).__name__}: {e}"
    return {ident: wrong[kind] for ident, kind in kinds.items() if wrong[kind] is not None}


_SET = (
    "param_id int, symbols array<string>, allowed_long boolean, allowed_short boolean, triggers_long array<int>, triggers_short array<int>, filters_long array<int>, filters_short array<int>, "
    "exits_long array<int>, exits_short array<int>, all_filters boolean, all_exits boolean, atr int"
)
#: Sets that are sent to every executor; more are joined by a key. A set is a few hundred bytes.
MANY_SETS = 10_000


def with_many_signals(bars: DataFrame, sets: Mapping[int, Params], owners: Mapping[int, Sequence[str]] | None = None) -> DataFrame:
    """Bars times parameter sets, each row with its set's signals (as ``with_signals``) and param_id.

    A bar carries its distinct masks as an array; a set is a row of numbers of masks, joined to the
    bars. So the plan grows with the masks, not with the sets. ``owners`` names the symbols that a set is
    for, where it isn't for all.
    """
    plan, numbers, built, atrs, relation = Plan(), {}, [], {}, []
    exits = sorted({s.key for p in sets.values() for s in specs.enabled(p, "exit")})
    kinds, planned = _kinds(sets), {}
    for ident, p in sets.items():
        if kinds[ident] not in planned:
            planned[kinds[ident]] = _planned(plan, p)
        columns, masks = planned[kinds[ident]]
        values = {s.key: tuple(p[x.name] for x in s.params) for s in specs.enabled(p)}

        def number(key: str, side: str, columns=columns, masks=masks, values=values) -> int:
            name = (key, side, columns.get(key), values[key])
            if name not in numbers:
                numbers[name] = len(built)
                built.append(masks[key, side])
            return numbers[name]

        row = {"param_id": ident, "symbols": None if owners is None else list(owners[ident]), "all_filters": p["entry_operator"] == "and", "all_exits": p["exit_operator"] == "and"}
        row["atr"] = atrs.setdefault(columns["atr_trail"][0], len(atrs)) if "atr_trail" in columns else None
        entries = [s for s in specs.enabled(p, "entry") if s.long]
        is_filter = lambda s, p=p: bool(s.mode) and p[s.mode] == "filter"
        mine = {s.key for s in specs.enabled(p, "exit")}
        for side in SIDES:
            row[f"allowed_{side}"] = p["trade_direction"] in ("both", f"{side}_only")
            row[f"triggers_{side}"] = [number(s.key, side) for s in entries if not is_filter(s)]
            row[f"filters_{side}"] = [number(s.key, side) for s in entries if is_filter(s)]
            row[f"exits_{side}"] = [number(k, side) if k in mine else None for k in exits]
        relation.append(row)
    names = [f"_m{i}" for i in range(len(built))]
    bars = plan.apply(bars).withColumns(dict(zip(names, built, strict=True)))
    array = lambda cs, kind: F.array(*cs).cast(f"array<{kind}>")
    plain = ["symbol", "ts", "bar", "open", "high", "low", "close"]
    bars = bars.select(*plain, array(map(F.col, names), "boolean").alias("_on"), array([edge(F.col(n)) for n in names], "boolean").alias("_edge"), array(map(F.col, atrs), "double").alias("_atr"))
    bars = saved(bars)  # the sets meet a table of masks: indicators are worked out once, and the plan behind them ends here
    order = [c.split()[0] for c in _SET.split(", ")]
    known = bars.sparkSession.createDataFrame([tuple(r[c] for c in order) for r in relation], _SET)
    known = F.broadcast(known) if len(relation) <= MANY_SETS else known
    if owners is None:
        each = bars.crossJoin(known)
    else:
        each = bars.join(known.withColumn("symbol", F.explode("symbols")), "symbol")
    on, rises = lambda i: F.get("_on", i), lambda i: F.get("_edge", i)
    either = lambda which, c: F.when(F.col(which), F.forall(c, on)).otherwise(F.exists(c, on))
    signals: list[Column] = []
    for side in SIDES:
        filters, said = F.col(f"filters_{side}"), F.array_compact(f"exits_{side}")
        kept = F.when(F.size(filters) == 0, F.lit(True)).otherwise(either("all_filters", filters))
        signals.append((F.col(f"allowed_{side}") & F.exists(f"triggers_{side}", rises) & kept).alias(f"entry_{side}"))
        signals.append(((F.size(said) > 0) & either("all_exits", said)).alias(f"exit_{side}_signal"))
        signals += [F.coalesce(F.get("_on", F.get(f"exits_{side}", F.lit(i))), F.lit(False)).alias(f"exit_{side}_{k}") for i, k in enumerate(exits)]
    return each.select("param_id", *plain, *signals, F.get("_atr", F.col("atr")).alias("atr"))


@dataclass
class Runs:
    """What backtests of many sets gave: events of those that worked, errors (symbol, param_id, message) of the others."""

    events: DataFrame
    errors: DataFrame

    def metrics(self, bars: DataFrame, capital: float = engine.CAPITAL) -> DataFrame:
        return metrics.metrics(engine.trades_of(self.events), engine.equity_of(self.events), metrics.bars_per_year(bars), capital)


def run_sets(bars: DataFrame, sets: Mapping[int, Params], capital: float = engine.CAPITAL, commission: float = engine.COMMISSION, slippage: float = engine.SLIPPAGE, costs: Mapping[int, tuple[float, float, float]] | None = None, owners: Mapping[int, Sequence[str]] | None = None) -> Runs:
    """Backtests of every (symbol, param_id): the engine runs once, its events are written and read from there.

    A set that no signals can be made of, or a group in which the engine fails, is an error row; the others aren't touched.
    """
    spark, bad = bars.sparkSession, unusable(sets)
    good = {k: p for k, p in sets.items() if k not in bad}
    lost = spark.createDataFrame(list(bad.items()), "param_id int, message string")
    names = bars.select("symbol").distinct()
    if owners is not None:
        names = spark.createDataFrame([(x, k) for k in bad for x in owners[k]], "symbol string, param_id int")
        lost = names.join(lost, "param_id").select("symbol", "param_id", "message")
    else:
        lost = names.crossJoin(lost).select("symbol", "param_id", "message")
    if not good:
        nothing = spark.createDataFrame([], engine.EVENTS)
        return Runs(nothing, lost)
    mine = None if owners is None else {k: owners[k] for k in good}
    events = saved(engine.run(with_many_signals(bars, good, mine), good, capital, commission, slippage, costs))
    errors = engine.errors_of(events)
    return Runs(engine.sound(events), errors.unionByName(lost) if bad else errors)


def evaluate(bars: DataFrame, sets: Mapping[int, Params], capital: float = engine.CAPITAL, commission: float = engine.COMMISSION, slippage: float = engine.SLIPPAGE, costs: Mapping[int, tuple[float, float, float]] | None = None, owners: Mapping[int, Sequence[str]] | None = None) -> DataFrame:
    """Metrics of every (symbol, param_id) that could be run."""
    return run_sets(bars, sets, capital, commission, slippage, costs, owners).metrics(bars, capital)


def objective(results: DataFrame, metric: str, min_trades: int) -> DataFrame:
    """(symbol, param_id, value): -inf for too few trades or an undefined metric."""
    v = F.col(metric).cast("double")
    good = (F.col("num_trades") >= min_trades) & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return results.select("symbol", "param_id", F.when(good, v).otherwise(F.lit(FAILED)).alias("value"))


def best(values: DataFrame) -> DataFrame:
    """The best trial of each symbol; equal ones: the earliest."""
    return values.groupBy("symbol").agg(F.max_by("param_id", F.struct("value", -F.col("param_id"))).alias("param_id"), F.max("value").alias("value"))


# slices


def renumbered(bars: DataFrame) -> DataFrame:
    by = [c for c in ("symbol", "fold") if c in bars.columns]
    return bars.withColumn("bar", (F.row_number().over(Window.partitionBy(*by).orderBy("ts")) - 1).cast("long"))


def split(bars: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """(train, test) by position; each starts anew, so indicators warm up again."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    marked = bars.withColumn("_train", F.col("bar") < F.floor(n * share))
    return renumbered(marked.where("_train").drop("_train")), renumbered(marked.where("NOT _train").drop("_train"))


def fold_windows(n: int, folds: int, anchored: bool = False, window: int | None = None, share: float = 0.7) -> list[tuple[int, int, int, int]]:
    """(train start, train end, test start, test end) of each fold after the first; ends are exclusive."""
    size, reach = n // folds, int(n * share) if window is None else window
    return [(0 if anchored else max(0, k * size - reach), k * size, k * size, min((k + 1) * size, n)) for k in range(1, folds)]


def fold_table(bars: DataFrame, folds: int, anchored: bool = False, share: float = 0.7) -> DataFrame:
    """(symbol, fold, part, ...bars): the windows of all folds by one join on a few rows; bars numbered within each."""
    n = bars.groupBy("symbol").agg(F.count("*").alias("n"))
    k = F.explode(F.sequence(F.lit(1), F.lit(folds - 1)))
    w = n.withColumn("size", F.floor(F.col("n") / folds)).withColumn("fold", k).withColumn("edge", F.col("fold") * F.col("size"))
    start = F.lit(0) if anchored else F.greatest(F.lit(0), F.col("edge") - F.floor(F.col("n") * share))
    parts = F.array(F.struct(F.lit("train").alias("part"), start.cast("long").alias("a"), F.col("edge").alias("b")), F.struct(F.lit("test").alias("part"), F.col("edge").alias("a"), F.least(F.col("edge") + F.col("size"), F.col("n")).alias("b")))
    w = w.select("symbol", "fold", F.explode(parts).alias("_p")).select("symbol", "fold", "_p.*")
    joined = bars.join(w, "symbol").where((F.col("bar") >= F.col("a")) & (F.col("bar") < F.col("b")))
    return joined.withColumn("bar", F.col("bar") - F.col("a")).drop("a", "b")


def stitch(equity: DataFrame, capital: float) -> DataFrame:
    """Test curves (symbol, fold, ts, bar, mtm_equity) chained: each starts where the one before ended; a time that occurs twice keeps the first."""
    ends = equity.groupBy("symbol", "fold").agg(F.min_by("mtm_equity", "bar").alias("a"), F.max_by("mtm_equity", "bar").alias("b")).where("a > 0")
    before = Window.partitionBy("symbol").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.withColumn("base", F.coalesce(F.product(F.col("b") / F.col("a")).over(before), F.lit(1.0)) * capital)
    chained = equity.join(base, ["symbol", "fold"]).withColumn("equity", F.col("mtm_equity") / F.col("a") * F.col("base"))
    first = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy("fold"))
    return chained.withColumn("_n", first).where("_n = 1").select("symbol", "fold", "ts", "bar", "equity")


def stability(values: DataFrame, by: tuple[str, ...] = ("param",)) -> DataFrame:
    """(param, cv) of (param, fold, value): population deviation over the mean's size, from two folds on."""
    sd, mean = F.stddev_pop("value"), F.avg("value")
    cv = F.when(F.abs(mean) > 1e-9, sd / F.nullif(F.abs(mean), F.lit(0.0))).otherwise(0.0)
    return values.groupBy(*by).agg(F.count("*").alias("n"), F.bround(cv, 4).alias("cv")).where("n >= 2").select(*by, "cv")


def efficiency(folds: DataFrame) -> DataFrame:
    """(symbol, ratio): mean finite test value over the mean train value."""
    test = F.avg(F.when(F.abs("test_value") < float("inf"), F.col("test_value")))
    train = F.avg(F.when(F.abs("train_value") < float("inf"), F.col("train_value")).otherwise(0.0))
    return folds.groupBy("symbol").agg(F.when(F.abs(train) > 1e-9, F.coalesce(test, F.lit(0.0)) / F.nullif(train, F.lit(0.0))).otherwise(0.0).alias("efficiency"))


def degradation(train: Column, test: Column) -> Column:
    """Loss from train to test in percent, where train is positive."""
    return F.when(train > 0, ratio(train - test, train) * 100)


# choosing parameters


def dimensions(filters: Mapping[str, bool], pinned: Mapping[str, Any] | None = None, direction: str = "both", compat_flags: bool = False) -> list[specs.Param]:
    """Parameters to search: of enabled specs, not pinned, relevant to the direction. Bools keep their default."""
    out = []
    for s in specs.all_specs():
        on = s.params[0].default if compat_flags else filters.get(s.flag, False)
        for p in s.params if on else ():
            if p.search and p.kind != "bool" and p.name not in (pinned or {}) and (p.side == "both" or direction in ("both", f"{p.side}_only")):
                out.append(p)
    return out


def active_count(filters: Mapping[str, bool], pinned: Mapping[str, Any] | None = None, direction: str = "both") -> int:
    """As budgets count them: searchable bools too, less the pins, at least 1."""
    n = sum(p.search and (p.side == "both" or direction in ("both", f"{p.side}_only")) for s in specs.all_specs() if filters.get(s.flag, False) for p in s.params)
    return max(n - len(pinned or {}), 1)


def budget_warnings(trials: int, filters: Mapping[str, bool], pinned: Mapping[str, Any] | None = None) -> list[str]:
    need, out = active_count(filters, pinned) * 10, []
    if trials < need:
        out.append(f"{trials} trials are few for {need // 10} parameters: {need} or more are advised")
    used = sum(filters.get(s.flag, False) for s in specs.all_specs() if s.role == "entry")
    if used > 3:
        out.append(f"{used} entry indicators at once: three at most are advised")
    return out


def robustness_warnings(efficiency_: float, cv: Mapping[str, float], failed: float, tested: bool = True) -> list[str]:
    out = []
    if tested and efficiency_ < 0:
        out.append(f"efficiency {efficiency_:.2f}: train and test disagree in sign")
    elif tested and 0 < efficiency_ < 0.5:
        out.append(f"efficiency {efficiency_:.2f} is below 0.50: likely overfitted")
    if shaky := [k for k, v in cv.items() if v > 0.5]:
        out.append(f"unstable entry parameters (CV > 0.50): {', '.join(shaky[:8])}")
    if failed > 0.2:
        out.append(f"{failed:.0%} of the trials failed")
    return out


class Sampler:
    """Seeded tree-structured Parzen sampling in batches: random first, then what the good trials make likely."""

    def __init__(self, space: Sequence[specs.Param], seed: int = 42, startup: int = 10, good: float = 0.25, tries: int = 24):
        self.space, self.rng, self.startup, self.good, self.tries = list(space), np.random.default_rng(seed), startup, good, tries
        self.seen: list[tuple[Params, float]] = []

    def _random(self, p: specs.Param) -> Any:
        if p.kind == "categorical":
            return p.choices[self.rng.integers(len(p.choices))]
        if p.kind == "int":
            return int(self.rng.integers(int(p.low), int(p.high) + 1))
        return float(self.rng.uniform(p.low, p.high))

    def _likely(self, p: specs.Param, good: list[Any], bad: list[Any]) -> Any:
        if p.kind == "categorical":
            score = [(good.count(c) + 1) / (bad.count(c) + 1) * self.rng.random() for c in p.choices]
            return p.choices[int(np.argmax(score))]
        width = (p.high - p.low) or 1.0
        spread = max(width / (1 + len(good)), width / 50)
        around = np.array(good, float)
        c = np.clip(around[self.rng.integers(len(around), size=self.tries)] + self.rng.normal(0, spread, self.tries), p.low, p.high)
        density = lambda xs: np.exp(-((c[:, None] - np.array(xs, float)[None]) ** 2) / (2 * spread**2)).mean(1) + 1e-12 if xs else np.full(len(c), 1e-12)
        pick = float(c[int(np.argmax(density(good) / density(bad)))])
        return round(pick) if p.kind == "int" else pick

    def batch(self, n: int) -> list[Params]:
        usable = [t for t in self.seen if math.isfinite(t[1])]
        if len(usable) < self.startup:
            return [{p.name: self._random(p) for p in self.space} for _ in range(n)]
        ranked = sorted(usable, key=lambda t: -t[1])
        cut = max(1, math.ceil(self.good * len(ranked)))
        return [{p.name: self._likely(p, [t[0][p.name] for t in ranked[:cut]], [t[0][p.name] for t in ranked[cut:]]) for p in self.space} for _ in range(n)]

    def tell(self, trials: Sequence[Params], values: Sequence[float]) -> None:
        self.seen += list(zip(trials, values, strict=True))


@dataclass
class Study:
    best: Params | None
    value: float
    failed: float
    trials: list[tuple[Params, float]] = field(default_factory=list)
    stopped: bool = False  # at its deadline, before all trials were told


class Deadline:
    """Cancels the jobs that are started inside, by tag, once ``seconds`` have passed; ``over`` tells whether they have."""

    def __init__(self, spark: SparkSession, seconds: float | None):
        self.context, self.tag = spark.sparkContext, f"barloom-{uuid.uuid4().hex}"
        self.at = None if seconds is None else time.monotonic() + seconds
        self.timer: threading.Timer | None = None

    @property
    def over(self) -> bool:
        return self.at is not None and time.monotonic() >= self.at

    def _cancel(self) -> None:
        self.context.cancelJobsWithTag(self.tag)
        self.timer = threading.Timer(0.5, self._cancel)  # jobs that start between two cancellations
        self.timer.daemon = True
        self.timer.start()

    def __enter__(self) -> Deadline:
        if self.at is not None:
            self.context.addJobTag(self.tag)
            self.timer = threading.Timer(max(0.0, self.at - time.monotonic()), self._cancel)
            self.timer.daemon = True
            self.timer.start()
        return self

    def __exit__(self, *error: Any) -> None:
        if self.at is not None:
            self.context.removeJobTag(self.tag)
            while self.timer is not None and self.timer.is_alive():
                self.timer.cancel()
                self.timer.join(1.0)


#: Distinct parameter sets that one job evaluates.
TOGETHER = 100


def _jobs(wanted: Mapping[str, Sequence[Params]]) -> Iterator[tuple[dict[int, Params], dict[int, list[str]], dict[tuple[str, int], int]]]:
    """Jobs of at most about ``TOGETHER`` sets, symbols kept whole: (sets, their symbols, set of each symbol's k-th trial)."""
    sets: dict[int, Params] = {}
    known: dict[tuple, int] = {}
    owners: dict[int, list[str]] = {}
    place: dict[tuple[str, int], int] = {}
    for symbol, trials in wanted.items():
        names = [tuple(sorted((k, repr(v)) for k, v in t.items())) for t in trials]
        if sets and len(sets) + len({n for n in names if n not in known}) > TOGETHER:
            yield sets, owners, place
            sets, known, owners, place = {}, {}, {}, {}
        for k, (name, t) in enumerate(zip(names, trials, strict=True)):
            ident = known.setdefault(name, len(known))
            sets.setdefault(ident, t)
            place[symbol, k] = ident
            if symbol not in owners.setdefault(ident, []):
                owners[ident].append(symbol)
    if sets:
        yield sets, owners, place


def metrics_of(bars: DataFrame, wanted: Mapping[str, Sequence[Params]], **costs: float) -> Iterator[tuple[DataFrame, dict[tuple[str, int], int]]]:
    """Metrics (symbol, param_id, ...) of each symbol with its own parameter sets, a job at a time, and which set was whose."""
    for sets, owners, place in _jobs(wanted):
        used = sorted({x for o in owners.values() for x in o})
        yield evaluate(bars.where(F.col("symbol").isin(*used)), sets, **costs, owners=owners), place


def studies(bars: DataFrame, seeds: Mapping[str, int], base: Params, filters: Mapping[str, bool], metric: str = "sharpe_ratio", trials: int = 200, min_trades: int = 5, pinned: Mapping[str, Any] | None = None, batch: int = 25, compat_flags: bool = False, timeout: float | None = None, **costs: float) -> dict[str, Study]:
    """A study of its own for every symbol in ``seeds``, all in the same jobs: each round takes ``batch`` more trials of each.

    Trials are rows of a job; only their values come back. Symbols whose samplers ask for the same sets share them.
    After ``timeout`` seconds the running job is cancelled, and the studies are those of the trials told so far.
    """
    flags = {s.flag: (s.params[0].default if compat_flags else bool(filters.get(s.flag, False))) for s in specs.all_specs()}
    fixed = {**base, **flags, **(pinned or {})}
    space = dimensions(filters, pinned, base["trade_direction"], compat_flags)
    samplers = {name: Sampler(space, seed) for name, seed in seeds.items()}
    lost, done, stopped = dict.fromkeys(seeds, 0), 0, False
    with Deadline(bars.sparkSession, timeout) as deadline:
        try:
            while done < trials and not deadline.over:
                asked = {name: s.batch(min(batch, trials - done)) for name, s in samplers.items()}
                sets = {name: [P.make(**{k: v for k, v in {**fixed, **t}.items() if k in P.defaults()}) for t in ts] for name, ts in asked.items()}
                for results, place in metrics_of(bars, sets, **costs):
                    found = {(r["symbol"], r["param_id"]): r["value"] for r in objective(results, metric, min_trades).collect()}
                    for name in {symbol for symbol, _ in place}:
                        values = [found.get((name, place[name, k])) for k in range(len(asked[name]))]
                        lost[name] += sum(v is None for v in values)
                        samplers[name].tell(asked[name], [FAILED if v is None else v for v in values])
                done += batch
        except Exception:
            if not deadline.over:  # else it is the cancelled job's
                raise
        stopped = done < trials
    out = {}
    for name, s in samplers.items():
        top = max((t for t in s.seen if math.isfinite(t[1])), key=lambda t: t[1], default=None)  # the first of equals
        out[name] = Study({**fixed, **top[0]} if top else None, top[1] if top else FAILED, lost[name] / max(1, len(s.seen)), s.seen, stopped)
    return out


def symbols(bars: DataFrame) -> list[str]:
    return sorted(r[0] for r in bars.select("symbol").distinct().collect())


def _only(bars: DataFrame) -> str:
    found = symbols(bars)
    if len(found) != 1:
        raise ValueError(f"one symbol is asked for, not {len(found)}; use studies for several")
    return found[0]


def study(bars: DataFrame, base: Params, filters: Mapping[str, bool], metric: str = "sharpe_ratio", trials: int = 200, min_trades: int = 5, seed: int = 42, **how: Any) -> Study:
    """The best parameters over one symbol's bars."""
    name = _only(bars)
    return studies(bars, {name: seed}, base, filters, metric, trials, min_trades, **how)[name]


def optimize(bars: DataFrame, base: Params, filters: Mapping[str, bool], metric: str = "sharpe_ratio", trials: int = 200, share: float = 0.7, min_trades: int = 5, **how: Any) -> tuple[Study, DataFrame]:
    """(study on the train part, metrics of part train, test and full with the best parameters)."""
    train, test = split(bars, share)
    s = study(train, base, filters, metric, trials, min_trades, **how)
    sets = {0: P.make(**(s.best or base))}
    parts = [evaluate(b, sets).withColumn("part", F.lit(name)) for name, b in (("train", train), ("test", test), ("full", bars))]
    return s, parts[0].unionByName(parts[1]).unionByName(parts[2])


def walk_forward(bars: DataFrame, base: Params, filters: Mapping[str, bool], metric: str = "sharpe_ratio", trials: int = 200, folds: int = 5, anchored: bool = False, share: float = 0.7, min_trades: int = 5, **how: Any) -> dict[str, Any]:
    """Fit on each fold's train window, test on the next; the last fold's parameters are a symbol's candidate.

    Folds of all symbols are studied in the same jobs; ``best``, ``stability``, ``efficiency`` and ``failed`` are by symbol.
    """
    table = fold_table(bars, folds, anchored, share)
    sizes = {(r["symbol"], r["fold"], r["part"]): r["n"] for r in table.groupBy("symbol", "fold", "part").agg(F.count("*").alias("n")).collect()}
    usable = sorted((x, k) for x, k, part in sizes if part == "train" and sizes[x, k, "train"] >= 50 and sizes.get((x, k, "test"), 0) >= 20)
    name = lambda x, k: f"{x}#{k}"
    parts = {x: table.where(F.col("part") == x).withColumn("symbol", F.concat_ws("#", "symbol", "fold")).drop("fold", "part") for x in ("train", "test")}
    found = studies(parts["train"], {name(x, k): 42 + 7 * k for x, k in usable}, base, filters, metric, max(50, trials // max(folds - 1, 1)), min_trades, **how) if usable else {}
    fitted = {(x, k): P.make(**found[name(x, k)].best) for x, k in usable if found[name(x, k)].best}
    wanted = {name(x, k): [p] for (x, k), p in fitted.items()}
    value: dict[tuple[str, str], float] = {}
    curves = None
    for part, b in parts.items():
        for sets, owners, _ in _jobs(wanted):
            mine = b.where(F.col("symbol").isin(*sorted({x for o in owners.values() for x in o})))
            runs = run_sets(mine, sets, owners=owners)
            m, events = runs.metrics(mine), runs.events
            value |= {(r["symbol"], part): r["value"] for r in objective(m, metric, min_trades).collect()}
            if part == "test":
                e = engine.equity_of(events)
                curves = e if curves is None else curves.unionByName(e)
    spark = bars.sparkSession
    rows = [(x, k, value.get((name(x, k), "train"), FAILED), value.get((name(x, k), "test"), FAILED)) for x, k in fitted]
    scores = spark.createDataFrame(rows, "symbol string, fold int, train_value double, test_value double")
    entry = {p.name for s in specs.all_specs() if s.role == "entry" for p in s.params}
    numbers = [(x, n, k, float(v)) for (x, k), p in fitted.items() for n, v in p.items() if n in entry and isinstance(v, int | float) and not isinstance(v, bool)]
    names = sorted({x for x, _ in usable})
    cv: dict[str, dict[str, float]] = {x: {} for x in names}
    for r in stability(spark.createDataFrame(numbers, "symbol string, param string, fold int, value double"), ("symbol", "param")).collect():
        cv[r["symbol"]][r["param"]] = r["cv"]
    ratios = {r["symbol"]: r["efficiency"] for r in efficiency(scores).collect()}
    failed = {x: float(np.mean([found[name(y, k)].failed for y, k in usable if y == x])) for x in names}
    if curves is not None:
        at = F.split("symbol", "#")
        curves = stitch(curves.withColumn("fold", F.element_at(at, -1).cast("int")).withColumn("symbol", F.array_join(F.slice(at, 1, F.size(at) - 1), "#")), engine.CAPITAL)
    return {
        "folds": scores, "params": fitted, "best": {x: fitted[max(f for f in fitted if f[0] == x)] for x in {x for x, _ in fitted}}, "equity": curves,
        "stability": cv, "efficiency": ratios, "failed": failed,
        "warnings": {x: budget_warnings(trials, filters, how.get("pinned")) + robustness_warnings(ratios.get(x, 0.0), cv[x], failed[x], x in ratios) for x in names},
    }


# sweeps


def cost_sweep(bars: DataFrame, p: Params, round_trips: Sequence[float] = (0.3, 0.5, 1.0, 2.0, 3.0), capital: float = engine.CAPITAL) -> DataFrame:
    """Metrics at each round-trip cost; a quarter of it is the commission and a quarter the slippage of each leg."""
    costs = {i: (capital, rt / 4, rt / 4) for i, rt in enumerate(round_trips)}
    labels = bars.sparkSession.createDataFrame([(i, float(rt)) for i, rt in enumerate(round_trips)], "param_id int, round_trip_pct double")
    return evaluate(bars, dict.fromkeys(costs, p), capital, costs=costs).join(labels, "param_id")


def variations(p: Params, delta_pct: float = 25.0) -> list[tuple[str, float, float, float]]:
    """(name, base, low, high) of every number of the enabled specs; ints stay ints, at least 1."""
    out = []
    for s in specs.enabled(p):
        for x in s.params:
            v = p[x.name]
            if x.kind not in ("int", "float") or not v:
                continue
            d = abs(v) * delta_pct / 100
            if x.kind == "int":
                low = max(1, round(v - d))
                out.append((x.name, v, low, max(low + 1, round(v + d))))
            else:
                low = round(v - d, 4)
                out.append((x.name, v, low, max(low + 0.01, round(v + d, 4))))
    return out


def sensitivity(bars: DataFrame, p: Params, metric: str = "profit_factor", delta_pct: float = 25.0, **costs: float) -> DataFrame:
    """(symbol, param, base, low, high, low_value, high_value, sensitivity), the most sensitive first."""
    rows = variations(p, delta_pct)
    sets = {2 * i + j: {**p, r[0]: r[2 + j]} for i, r in enumerate(rows) for j in (0, 1)}
    labels = bars.sparkSession.createDataFrame([(2 * i + j, r[0], float(r[1]), float(r[2]), float(r[3]), j) for i, r in enumerate(rows) for j in (0, 1)], "param_id int, param string, base double, low double, high double, j int")
    m = evaluate(bars, sets, **costs).join(labels, "param_id").groupBy("symbol", "param", "base", "low", "high").agg(
        F.max(F.when(F.col("j") == 0, F.col(metric))).alias("low_value"), F.max(F.when(F.col("j") == 1, F.col(metric))).alias("high_value"))
    return m.withColumn("sensitivity", F.abs(F.col("high_value") - F.col("low_value"))).orderBy(F.desc(F.coalesce("sensitivity", F.lit(0.0))), "param")


def grid(x: tuple[str, Sequence[Any]], y: tuple[str, Sequence[Any]], p: Params) -> dict[int, Params]:
    return {i: {**p, x[0]: a, y[0]: b} for i, (a, b) in enumerate(itertools.product(x[1], y[1]))}


def heatmap(bars: DataFrame, p: Params, x: tuple[str, Sequence[Any]], y: tuple[str, Sequence[Any]], metric: str = "sharpe_ratio", **costs: float) -> DataFrame:
    """(symbol, x, y, value) over the grid, long."""
    cells = list(itertools.product(x[1], y[1]))
    labels = bars.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(cells)], "param_id int, x double, y double")
    v = F.col(metric).cast("double")
    every = bars.select("symbol").distinct().crossJoin(labels)  # a cell that couldn't be run is 0 too
    return every.join(evaluate(bars, grid(x, y, p), **costs), ["symbol", "param_id"], "left").select("symbol", "x", "y", F.coalesce(v, F.lit(0.0)).alias("value"))


@dataclass
class Permutations:
    scores: DataFrame  # symbol, perm_id, permuted, real
    curves: DataFrame  # symbol, perm_id (null: the real bars), bar, mtm_equity

    def shown(self, most: int = 200) -> DataFrame:
        """Every k-th permuted curve, at most about ``most``, with the best one marked, and the real one."""
        n = F.count("*").over(Window.partitionBy("symbol"))
        rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("permuted"), "perm_id"))
        each = self.scores.withColumn("_n", n).withColumn("best", rank == 1)
        every = F.greatest(F.lit(1), F.floor(F.col("_n") / F.least(F.col("_n"), F.lit(most))))
        picked = each.where(F.col("best") | (F.col("perm_id") % every == 0)).select("symbol", "perm_id", "best")
        drawn = self.curves.join(picked, ["symbol", "perm_id"])
        return drawn.unionByName(self.curves.where("perm_id IS NULL").withColumn("best", F.lit(False)))


def permutation_test(bars: DataFrame, base: Params, filters: Mapping[str, bool], metric: str = "profit_factor", permutations: int = 100, trials: int = 50, share: float = 0.7, min_trades: int = 5, seed: int = 42, **how: Any) -> Permutations | None:
    """The real history against permuted ones; None under 50 bars.

    Each permutes the whole history, optimizes on its train part by a study of its own (the same seed for
    each, so the random first trials are shared) and scores the full history with the parameters found.
    """
    from barloom.operators.simulate import permute_prices

    if any(r["n"] < 50 for r in bars.groupBy("symbol").agg(F.count("*").alias("n")).collect()):
        return None
    real = bars.select("symbol", "ts", "bar", "open", "high", "low", "close", "volume")
    permuted = permute_prices(real, permutations, seed).withColumn("symbol", F.concat_ws("#", "symbol", F.col("perm_id").cast("string"))).select(*real.columns)
    many = real.unionByName(permuted)
    names = [x if k is None else f"{x}#{k}" for x in symbols(real) for k in (None, *range(permutations))]
    found = studies(split(many, share)[0], dict.fromkeys(names, seed), base, filters, metric, trials, min_trades, **how)
    scores, curves = None, None
    for sets, owners, _ in _jobs({n: [P.make(**(found[n].best or base))] for n in names}):
        mine = many.where(F.col("symbol").isin(*sorted({x for o in owners.values() for x in o})))
        runs = run_sets(mine, sets, owners=owners)
        m, events = runs.metrics(mine), runs.events
        m, e = m.select("symbol", F.coalesce(F.nanvl(F.col(metric).cast("double"), F.lit(None)), F.lit(0.0)).alias("value")), engine.equity_of(events).select("symbol", "bar", "mtm_equity")
        scores, curves = (m, e) if scores is None else (scores.unionByName(m), curves.unionByName(e))
    own = lambda df: df.withColumn("perm_id", F.expr("try_element_at(split(symbol, '#'), 2)").cast("int")).withColumn("symbol", F.split_part("symbol", F.lit("#"), F.lit(1)))
    scores = own(scores)
    truth = scores.where("perm_id IS NULL").select("symbol", F.col("value").alias("real"))
    return Permutations(scores.where("perm_id IS NOT NULL").select("symbol", "perm_id", F.col("value").alias("permuted")).join(truth, "symbol"), own(curves))
