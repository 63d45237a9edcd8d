"""From indicator columns to entry and exit signals."""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import windows as W
from barloom.operators import specs
from barloom.operators.indicators import Plan

SIDES = ("long", "short")
#: Columns that callers may expect also where their spec is off.
NEUTRAL = ("pamrp_entry", "pamrp_exit", "pamrp", "bbwp", "bbwp_sma")


def sure(mask: Column) -> Column:
    """Null counts as False."""
    return F.coalesce(mask, F.lit(False))


def combine(masks: Iterable[Column], operator: str) -> Column:
    """AND or OR; without masks False."""
    masks = [sure(m) for m in masks]
    if not masks:
        return F.lit(False)
    return reduce(lambda a, b: (a & b) if operator == "and" else (a | b), masks)


def edge(mask: Column) -> Column:
    """Where the mask turns True; the first bar may."""
    return sure(mask) & ~F.lag(sure(mask), 1, False).over(W.bars())


def indicator_plan(params: dict[str, Any]) -> tuple[Plan, dict[str, tuple[str, ...]]]:
    plan = Plan()
    return plan, {s.key: s.compute(plan, params) for s in specs.enabled(params) if s.compute}


def with_signals(bars: DataFrame, params: dict[str, Any]) -> DataFrame:
    """``bars`` with indicators, entry_long, entry_short, exit_{side}_signal, exit_{side}_{spec} and atr.

    Triggers join by OR, on their rising edge; filters by the entry operator; an entry needs
    both. Exits are levels, joined by the exit operator.
    """
    plan, columns = indicator_plan(params)
    bars = plan.apply(bars)
    for name in NEUTRAL:
        if name not in bars.columns:
            source = {"pamrp": "pamrp_entry", "bbwp": "bbwp_entry", "bbwp_sma": "bbwp_entry"}.get(name, name)
            at = 1 if name == "bbwp_sma" else 0
            bars = bars.withColumn(name, F.col(columns[source][at]) if source in columns else F.lit(50.0))
    entries = [s for s in specs.enabled(params, "entry") if s.long]
    exits = [s for s in specs.enabled(params, "exit") if s.long]
    is_filter = lambda s: bool(s.mode) and params[s.mode] == "filter"
    if entries and all(is_filter(s) for s in entries):
        warnings.warn("every enabled entry is a filter: there will be no entries", stacklevel=2)
    new: dict[str, Column] = {}
    for side in SIDES:
        signal = lambda s, side=side: getattr(s, side)(params, columns[s.key])
        trigger = combine([edge(signal(s)) for s in entries if not is_filter(s)], "or")
        kept = [signal(s) for s in entries if is_filter(s)]
        allowed = params["trade_direction"] in ("both", f"{side}_only")
        new[f"entry_{side}"] = F.lit(allowed) & trigger & (combine(kept, params["entry_operator"]) if kept else F.lit(True))
        each = {f"exit_{side}_{s.key}": sure(signal(s)) for s in exits}
        new |= each
        new[f"exit_{side}_signal"] = combine(each.values(), params["exit_operator"])
    if "atr_trail" in columns:
        new["atr"] = F.col(columns["atr_trail"][0])
    # values of the slope filter need a window of their own, so signals come after indicators
    return bars.withColumns(new)
