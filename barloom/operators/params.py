"""Strategy parameters: the catalogue's defaults, strategy-level settings, coercions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from barloom.operators import specs

#: Strategy-level settings and their defaults.
STRATEGY: dict[str, Any] = {
    "trade_direction": "long_only",
    "entry_operator": "and",
    "exit_operator": "or",
    "allow_same_bar_exit": True,
    "allow_same_bar_reversal": False,
    "entry_conflict_mode": "skip",
    "entry_exit_conflict_mode": "skip",
    "position_size_pct": 100.0,
    "use_kelly": False,
    "kelly_fraction": 0.5,
}
CHOICES = {
    "trade_direction": ("long_only", "short_only", "both"),
    "entry_operator": ("and", "or"),
    "exit_operator": ("and", "or"),
    "entry_conflict_mode": ("skip", "prefer_long", "prefer_short"),
    "entry_exit_conflict_mode": ("skip", "defer"),
}
#: An exit parameter that isn't given follows its entry parameter.
FOLLOWS: dict[str, str] = {
    "rsi_exit_length": "rsi_length",
    "bbwp_exit_length": "bbwp_length",
    "bbwp_exit_lookback": "bbwp_lookback",
    "bbwp_exit_sma_length": "bbwp_sma_length",
    "adx_exit_length": "adx_length",
    "adx_exit_smoothing": "adx_smoothing",
    "macd_exit_fast": "macd_fast",
    "macd_exit_slow": "macd_slow",
    "macd_exit_signal": "macd_signal",
    "volume_exit_ma_length": "volume_ma_length",
    "supertrend_exit_period": "supertrend_period",
    "supertrend_exit_multiplier": "supertrend_multiplier",
    "stoch_rsi_exit_length": "stoch_rsi_length",
    "stoch_rsi_exit_k": "stoch_rsi_k",
    "stoch_rsi_exit_d": "stoch_rsi_d",
    "stoch_rsi_exit_overbought": "stoch_rsi_overbought",
    "stoch_rsi_exit_oversold": "stoch_rsi_oversold",
    "ma_exit_fast": "ma_fast_length",
    "ma_exit_slow": "ma_slow_length",
    "ma_exit_type": "ma_type",
}
#: Old names -> the present ones, in the order in which they are resolved.
RENAMED: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("pamrp_length", ("pamrp_entry_length", "pamrp_exit_length")),
    ("pamrp_entry_length", ("pamrp_entry_ma_length",)),
    ("pamrp_exit_length", ("pamrp_exit_ma_length",)),
    ("time_exit_bars", ("time_exit_bars_long", "time_exit_bars_short")),
)


def defaults() -> dict[str, Any]:
    return {**STRATEGY, **specs.defaults()}


def renamed(given: Mapping[str, Any]) -> dict[str, Any]:
    out = dict(given)
    for old, new in RENAMED:
        if (value := out.pop(old, None)) is not None:
            for name in new:
                out.setdefault(name, value)
    return out


def followed(given: Mapping[str, Any]) -> dict[str, Any]:
    return {**{x: given[e] for x, e in FOLLOWS.items() if e in given}, **given}


def pins(names: Iterable[str] | None) -> set[str]:
    """Pinned parameters, with the exit parameters that follow pinned entries."""
    held = set(names or ())
    return held | {x for x, e in FOLLOWS.items() if e in held}


def make(**given: Any) -> dict[str, Any]:
    """Defaults overlaid with ``given``; unknown names and values are errors; nothing follows."""
    unknown = set(given) - set(defaults())
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    out = {**defaults(), **given}
    for name, allowed in CHOICES.items():
        if out[name] not in allowed:
            raise ValueError(f"{name}: {out[name]!r} isn't one of {allowed}")
    return out


def from_dict(given: Mapping[str, Any]) -> dict[str, Any]:
    """As stored or entered: old names, labels such as "Long Only", followers; unknown names are dropped."""
    out = followed(renamed(given))
    for name, allowed in CHOICES.items():
        if isinstance(out.get(name), str):
            word = out[name].strip().lower().replace(" ", "_")
            if word not in allowed and name == "trade_direction":
                word = "long_only"
            out[name] = word
    return make(**{k: v for k, v in out.items() if k in defaults()})
