"""The indicator catalogue: 24 specs with their parameters as data, and the checks on them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions import windows as W
from barloom.operators.indicators import Plan

Params = dict[str, Any]
MA_TYPES = ("sma", "ema", "wma", "rma")


@dataclass(frozen=True)
class Param:
    name: str
    kind: str  # bool, int, float or categorical
    default: Any
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()
    side: str = "both"
    search: bool = True
    step: float | None = None


@dataclass(frozen=True)
class Spec:
    key: str
    role: str  # entry, exit, risk or overlay
    flag: str
    params: tuple[Param, ...]
    #: adds columns to the plan; returns their names
    compute: Callable[[Plan, Params], tuple[str, ...]] | None = None
    #: (params, column names) -> when the long / short side is signalled
    long: Callable[[Params, tuple[str, ...]], Column] | None = None
    short: Callable[[Params, tuple[str, ...]], Column] | None = None
    mode: str | None = None  # the parameter that says trigger or filter
    depends: tuple[str, ...] = ()
    outputs: tuple[str, ...] = field(default=())


def _flag(name: str, on: bool = False) -> Param:
    return Param(name, "bool", on, search=False)


def _int(name: str, default: int, low: int, high: int, side: str = "both") -> Param:
    return Param(name, "int", default, low, high, side=side)


def _float(name: str, default: float, low: float, high: float, side: str = "both", step: float = 0.5) -> Param:
    return Param(name, "float", default, low, high, side=side, step=step)


def _pick(name: str, default: str, choices: tuple[str, ...], search: bool = True) -> Param:
    return Param(name, "categorical", default, choices=choices, search=search)


def _mode(name: str) -> Param:
    return _pick(name, "trigger", ("trigger", "filter"), search=False)


def _c(name: str) -> Column:
    return F.col(name)


def _below(key: str) -> Callable:
    return lambda p, c: _c(c[0]) < p[key]


def _above(key: str) -> Callable:
    return lambda p, c: _c(c[0]) > p[key]


def _slope(p: Params, c: tuple[str, ...]) -> Column:
    """The band-width rank's own average against the bar before."""
    now, before = _c(c[1]), W.previous(c[1])
    return {"disabled": F.lit(True), "decreasing": now < before, "increasing": now > before}[p["bbwp_ma_filter"]]


def _macd_side(key: str, up: bool) -> Callable:
    def signal(p: Params, c: tuple[str, ...]) -> Column:
        a, b = {"histogram": (_c(c[2]), F.lit(0)), "crossover": (_c(c[0]), _c(c[1])), "zero-line": (_c(c[0]), F.lit(0))}[p[key]]
        return a > b if up else a < b

    return signal


def _adx_side(up: bool) -> Callable:
    def signal(p: Params, c: tuple[str, ...]) -> Column:
        strong = _c(c[2]) > p["adx_threshold"]
        return strong & (_c(c[0]) > _c(c[1]) if up else _c(c[0]) < _c(c[1])) if p["adx_require_di"] else strong

    return signal


def _pair(sign: int) -> Callable:
    return lambda p, c: (_c(c[0]) > _c(c[1])) if sign > 0 else (_c(c[0]) < _c(c[1]))


def _turn(sign: int) -> Callable:
    return lambda p, c: (_c(c[1]) > 0) if sign > 0 else (_c(c[1]) < 0)


def _volume(key: str, sign: int) -> Callable:
    return lambda p, c: (_c("volume") > _c(c[0]) * p[key]) if sign > 0 else (_c("volume") < _c(c[0]) * p[key])


#: Names, defaults and ranges of the catalogue, in registration order.
SPECS: list[Spec] = [
    Spec(
        "pamrp_entry", "entry", "pamrp_enabled",
        (_flag("pamrp_enabled", True), _int("pamrp_entry_ma_length", 20, 1, 200), _int("pamrp_entry_lookback", 350, 50, 1000), _pick("pamrp_entry_ma_type", "sma", MA_TYPES),
         _int("pamrp_entry_long", 20, 1, 49, "long"), _int("pamrp_entry_short", 80, 51, 99, "short"), _mode("pamrp_signal_mode")),
        lambda g, p: (g.pamrp(p["pamrp_entry_ma_length"], p["pamrp_entry_lookback"], p["pamrp_entry_ma_type"]),),
        _below("pamrp_entry_long"), _above("pamrp_entry_short"), "pamrp_signal_mode",
    ),
    Spec(
        "bbwp_entry", "entry", "bbwp_enabled",
        (_flag("bbwp_enabled", True), _int("bbwp_length", 13, 1, 50), _int("bbwp_lookback", 252, 50, 500), _int("bbwp_sma_length", 5, 1, 20),
         _int("bbwp_threshold_long", 50, 1, 99, "long"), _int("bbwp_threshold_short", 50, 1, 99, "short"),
         _pick("bbwp_ma_filter", "disabled", ("disabled", "decreasing", "increasing")), _mode("bbwp_signal_mode")),
        lambda g, p: (b := g.bbwp(p["bbwp_length"], p["bbwp_lookback"]), g.sma(b, p["bbwp_sma_length"])),
        lambda p, c: _below("bbwp_threshold_long")(p, c) & _slope(p, c), lambda p, c: _above("bbwp_threshold_short")(p, c) & _slope(p, c), "bbwp_signal_mode",
    ),
    Spec(
        "adx_entry", "entry", "adx_enabled",
        (_flag("adx_enabled"), _int("adx_length", 14, 1, 50), _int("adx_smoothing", 14, 1, 50), _int("adx_threshold", 20, 1, 99), Param("adx_require_di", "bool", False), _mode("adx_signal_mode")),
        lambda g, p: g.adx(p["adx_length"], p["adx_smoothing"]), _adx_side(True), _adx_side(False), "adx_signal_mode",
    ),
    Spec(
        "ma_trend", "entry", "ma_trend_enabled",
        (_flag("ma_trend_enabled"), _int("ma_fast_length", 50, 1, 200), _int("ma_slow_length", 200, 2, 500), _pick("ma_type", "sma", MA_TYPES), _mode("ma_trend_signal_mode")),
        lambda g, p: (g.ma("close", p["ma_fast_length"], p["ma_type"]), g.ma("close", p["ma_slow_length"], p["ma_type"])), _pair(1), _pair(-1), "ma_trend_signal_mode",
    ),
    Spec(
        "rsi_entry", "entry", "rsi_enabled",
        (_flag("rsi_enabled"), _int("rsi_length", 14, 2, 100), _int("rsi_oversold", 30, 1, 49, "long"), _int("rsi_overbought", 70, 51, 99, "short"), _mode("rsi_signal_mode")),
        lambda g, p: (g.rsi(p["rsi_length"]),), _below("rsi_oversold"), _above("rsi_overbought"), "rsi_signal_mode",
    ),
    Spec(
        "volume_entry", "entry", "volume_enabled",
        (_flag("volume_enabled"), _int("volume_ma_length", 20, 1, 200), _float("volume_multiplier", 1.0, 0.1, 5.0, step=0.1), _mode("volume_signal_mode")),
        lambda g, p: (g.sma("volume", p["volume_ma_length"]),), _volume("volume_multiplier", 1), _volume("volume_multiplier", 1), "volume_signal_mode",
    ),
    Spec(
        "supertrend_entry", "entry", "supertrend_enabled",
        (_flag("supertrend_enabled"), _int("supertrend_period", 10, 2, 50), _float("supertrend_multiplier", 3.0, 0.5, 10.0)),
        lambda g, p: g.supertrend(p["supertrend_period"], p["supertrend_multiplier"]), _turn(1), _turn(-1),
    ),
    Spec("vwap", "overlay", "vwap_enabled", (_flag("vwap_enabled"),), lambda g, p: (g.vwap(),)),
    Spec(
        "macd_entry", "entry", "macd_enabled",
        (_flag("macd_enabled"), _int("macd_fast", 12, 1, 100), _int("macd_slow", 26, 2, 200), _int("macd_signal", 9, 1, 50), _pick("macd_mode", "histogram", ("histogram", "crossover", "zero-line"))),
        lambda g, p: g.macd(p["macd_fast"], p["macd_slow"], p["macd_signal"]), _macd_side("macd_mode", True), _macd_side("macd_mode", False),
    ),
    Spec(
        "stoch_rsi_entry", "entry", "stoch_rsi_entry_enabled",
        (_flag("stoch_rsi_entry_enabled"), _int("stoch_rsi_length", 14, 2, 50), _int("stoch_rsi_k", 3, 1, 20), _int("stoch_rsi_d", 3, 1, 20),
         _int("stoch_rsi_oversold", 20, 1, 49, "long"), _int("stoch_rsi_overbought", 80, 51, 99, "short"), _mode("stoch_rsi_signal_mode")),
        lambda g, p: g.stoch_rsi(p["stoch_rsi_length"], p["stoch_rsi_length"], p["stoch_rsi_k"], p["stoch_rsi_d"]),
        _below("stoch_rsi_oversold"), _above("stoch_rsi_overbought"), "stoch_rsi_signal_mode",
    ),
    Spec(
        "pamrp_exit", "exit", "pamrp_exit_enabled",
        (_flag("pamrp_exit_enabled", True), _int("pamrp_exit_ma_length", 20, 1, 200), _int("pamrp_exit_lookback", 350, 50, 1000), _pick("pamrp_exit_ma_type", "sma", MA_TYPES),
         _int("pamrp_exit_long", 70, 51, 99, "long"), _int("pamrp_exit_short", 30, 1, 49, "short")),
        lambda g, p: (g.pamrp(p["pamrp_exit_ma_length"], p["pamrp_exit_lookback"], p["pamrp_exit_ma_type"]),), _above("pamrp_exit_long"), _below("pamrp_exit_short"),
    ),
    Spec(
        "stoch_rsi_exit", "exit", "stoch_rsi_exit_enabled",
        (_flag("stoch_rsi_exit_enabled"), _int("stoch_rsi_exit_length", 14, 2, 50), _int("stoch_rsi_exit_k", 3, 1, 20), _int("stoch_rsi_exit_d", 3, 1, 20),
         _int("stoch_rsi_exit_overbought", 80, 51, 99, "long"), _int("stoch_rsi_exit_oversold", 20, 1, 49, "short")),
        lambda g, p: g.stoch_rsi(p["stoch_rsi_exit_length"], p["stoch_rsi_exit_length"], p["stoch_rsi_exit_k"], p["stoch_rsi_exit_d"]),
        _above("stoch_rsi_exit_overbought"), _below("stoch_rsi_exit_oversold"),
    ),
    Spec(
        "ma_exit", "exit", "ma_exit_enabled",
        (_flag("ma_exit_enabled"), _int("ma_exit_fast", 10, 1, 100), _int("ma_exit_slow", 20, 2, 200), _pick("ma_exit_type", "ema", MA_TYPES)),
        lambda g, p: (g.ma("close", p["ma_exit_fast"], p["ma_exit_type"]), g.ma("close", p["ma_exit_slow"], p["ma_exit_type"])), _pair(-1), _pair(1),
    ),
    Spec(
        "bbwp_exit", "exit", "bbwp_exit_enabled",
        (_flag("bbwp_exit_enabled"), _int("bbwp_exit_length", 13, 1, 50), _int("bbwp_exit_lookback", 252, 50, 500), _int("bbwp_exit_sma_length", 5, 1, 20),
         _int("bbwp_exit_threshold_long", 80, 1, 99, "long"), _int("bbwp_exit_threshold_short", 20, 1, 99, "short")),
        lambda g, p: (g.bbwp(p["bbwp_exit_length"], p["bbwp_exit_lookback"]),), _above("bbwp_exit_threshold_long"), _below("bbwp_exit_threshold_short"),
    ),
    Spec(
        "adx_exit", "exit", "adx_exit_enabled",
        (_flag("adx_exit_enabled"), _int("adx_exit_length", 14, 1, 50), _int("adx_exit_smoothing", 14, 1, 50), _int("adx_exit_threshold", 20, 1, 99)),
        lambda g, p: g.adx(p["adx_exit_length"], p["adx_exit_smoothing"]), lambda p, c: _c(c[2]) < p["adx_exit_threshold"], lambda p, c: _c(c[2]) < p["adx_exit_threshold"],
    ),
    Spec(
        "macd_exit", "exit", "macd_exit_enabled",
        (_flag("macd_exit_enabled"), _int("macd_exit_fast", 12, 1, 100), _int("macd_exit_slow", 26, 2, 200), _int("macd_exit_signal", 9, 1, 50), _pick("macd_exit_mode", "histogram", ("histogram", "crossover", "zero-line"))),
        lambda g, p: g.macd(p["macd_exit_fast"], p["macd_exit_slow"], p["macd_exit_signal"]), _macd_side("macd_exit_mode", False), _macd_side("macd_exit_mode", True),
    ),
    Spec(
        "rsi_exit", "exit", "rsi_exit_enabled",
        (_flag("rsi_exit_enabled"), _int("rsi_exit_length", 14, 2, 100), _int("rsi_exit_long", 50, 1, 99, "long"), _int("rsi_exit_short", 50, 1, 99, "short")),
        lambda g, p: (g.rsi(p["rsi_exit_length"]),), _above("rsi_exit_long"), _below("rsi_exit_short"),
    ),
    Spec(
        "supertrend_exit", "exit", "supertrend_exit_enabled",
        (_flag("supertrend_exit_enabled"), _int("supertrend_exit_period", 10, 2, 50), _float("supertrend_exit_multiplier", 3.0, 0.5, 10.0)),
        lambda g, p: g.supertrend(p["supertrend_exit_period"], p["supertrend_exit_multiplier"]), _turn(-1), _turn(1),
    ),
    Spec(
        "volume_exit", "exit", "volume_exit_enabled",
        (_flag("volume_exit_enabled"), _int("volume_exit_ma_length", 20, 1, 200), _float("volume_exit_multiplier", 1.0, 0.1, 5.0, step=0.1)),
        lambda g, p: (g.sma("volume", p["volume_exit_ma_length"]),), _volume("volume_exit_multiplier", -1), _volume("volume_exit_multiplier", -1),
    ),
    Spec("stop_loss", "risk", "stop_loss_enabled", (_flag("stop_loss_enabled", True), _float("stop_loss_pct_long", 3.0, 0.5, 30.0, "long"), _float("stop_loss_pct_short", 3.0, 0.5, 30.0, "short"))),
    Spec("take_profit", "risk", "take_profit_enabled", (_flag("take_profit_enabled"), _float("take_profit_pct_long", 5.0, 0.5, 50.0, "long"), _float("take_profit_pct_short", 5.0, 0.5, 50.0, "short"))),
    Spec("trailing_stop", "risk", "trailing_stop_enabled", (_flag("trailing_stop_enabled"), _float("trailing_stop_pct", 2.0, 0.5, 20.0), _float("trailing_stop_activation", 1.0, 0.0, 10.0))),
    Spec("atr_trail", "risk", "atr_trailing_enabled", (_flag("atr_trailing_enabled"), _int("atr_length", 14, 1, 50), _float("atr_multiplier", 2.0, 0.5, 10.0)), lambda g, p: (g.atr(p["atr_length"]),)),
    Spec("time_exit", "risk", "time_exit_enabled", (_flag("time_exit_enabled"), _int("time_exit_bars_long", 20, 1, 200, "long"), _int("time_exit_bars_short", 20, 1, 200, "short"))),
]

_BY_KEY: dict[str, Spec] = {}


def _check(spec: Spec, known: Iterable[Spec]) -> None:
    """ValueError unless ``spec`` fits beside ``known``."""
    names = {p.name for s in known for p in s.params}
    if any(s.key == spec.key for s in known):
        raise ValueError(f"spec {spec.key!r} exists")
    if spec.role not in ("entry", "exit", "risk", "overlay"):
        raise ValueError(f"{spec.key}: unknown role {spec.role!r}")
    if not any(p.name == spec.flag and p.kind == "bool" for p in spec.params):
        raise ValueError(f"{spec.key}: its flag {spec.flag!r} must be a bool parameter")
    for p in spec.params:
        if p.name in names:
            raise ValueError(f"parameter {p.name!r} exists")
        names.add(p.name)
        if p.kind in ("int", "float") and (p.low is None or p.high is None or not p.low <= p.default <= p.high):
            raise ValueError(f"{p.name}: needs low <= default <= high")
        if p.kind == "categorical" and p.default not in p.choices:
            raise ValueError(f"{p.name}: the default isn't a choice")
        if p.kind not in ("bool", "int", "float", "categorical"):
            raise ValueError(f"{p.name}: unknown kind {p.kind!r}")
    missing = [d for d in spec.depends if not any(s.key == d for s in known)]
    if missing:
        raise ValueError(f"{spec.key}: unknown dependencies {missing}")


for _spec in SPECS:
    _check(_spec, _BY_KEY.values())
    _BY_KEY[_spec.key] = _spec


def all_specs() -> list[Spec]:
    return list(_BY_KEY.values())


def get(key: str) -> Spec:
    return _BY_KEY[key]


def register(spec: Spec) -> Spec:
    """A further spec, available at once; it is checked like the built-in ones."""
    _check(spec, _BY_KEY.values())
    _BY_KEY[spec.key] = spec
    return spec


def unregister(key: str) -> None:
    _BY_KEY.pop(key, None)


def defaults() -> Params:
    return {p.name: p.default for s in all_specs() for p in s.params}


def enabled(params: Params, role: str | None = None) -> list[Spec]:
    """Specs that are switched on, in order of registration, each after what it depends on."""
    on = [s for s in all_specs() if params.get(s.flag) and role in (None, s.role)]
    out: list[Spec] = []

    def visit(s: Spec, path: tuple[str, ...]) -> None:
        if s.key in path:
            raise ValueError(f"specs depend on each other: {' > '.join((*path, s.key))}")
        if s not in out:
            for d in s.depends:
                if any(x.key == d for x in on):
                    visit(get(d), (*path, s.key))
            out.append(s)

    for s in on:
        visit(s, ())
    return out
