"""Queries on the engine: trades, equity and metrics of parameter sets over daily bars.

The SQL is a state machine of its own: a recursive query that carries the account from bar to
bar, written from the rules and not from the engine's code.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import windows as W
from barloom.operators import calendars, engine, metrics, search
from barloom.operators import params as P
from barloom.plans.catalogue import RANGE_SQL, ewm, lag, over, query, register, rounded, shown, sma
from barloom.sources import bars as B
from barloom.sources.shared import saved

#: Entries where a 5-bar mean crosses a 20-bar mean, exits where a 3-bar mean is beyond a 10-bar mean.
BASE: dict[str, Any] = {
    "pamrp_enabled": False, "bbwp_enabled": False, "pamrp_exit_enabled": False, "trade_direction": "both", "ma_trend_enabled": True, "ma_fast_length": 5, "ma_slow_length": 20,
    "ma_exit_enabled": True, "ma_exit_fast": 3, "ma_exit_slow": 10, "ma_exit_type": "sma", "stop_loss_enabled": False, "position_size_pct": 10.0,
}


def _exits_sql(p: dict[str, Any]) -> list[tuple[str, str]]:
    """(long, short) of each enabled exit."""
    beyond = lambda op: f"coalesce({sma('close', p['ma_exit_fast'])} {op} {sma('close', p['ma_exit_slow'])}, false)"
    found = [(beyond("<"), beyond(">"))]
    if p["rsi_exit_enabled"]:
        found.append(tuple(f"coalesce(rsi {op} {p[f'rsi_exit_{side}']}, false)" for op, side in ((">", "long"), ("<", "short"))))
    return found


def _signals_sql(p: dict[str, Any]) -> str:
    """``sig``: bars with the bar before's signals (of all exits, and of each), and the range mean."""
    sides = {"long": p["trade_direction"] in ("both", "long_only"), "short": p["trade_direction"] in ("both", "short_only")}
    edge = lambda x: f"{x} AND NOT coalesce({lag(x)}, false)"
    exits, op = _exits_sql(p), f" {p['exit_operator']} "
    each = ", ".join(f"{x} AS x{i}{side}" for i, pair in enumerate(exits) for side, x in zip("ls", pair, strict=True))
    both = ", ".join(f"{op.join(f'x{i}{side}' for i in range(len(exits)))} AS x{side}" for side in "ls")
    before = ", ".join(f"{lag(f'x{i}{side}')} AS p{i}{side}" for i in range(len(exits)) for side in "ls")
    rsi, joined = "", ""
    if p["rsi_exit_enabled"]:
        n = p["rsi_exit_length"]
        rsi = ewm("rf", "moves", {"g": ("gain", 1 / n), "l": ("loss", 1 / n)}) + ", rsi AS MATERIALIZED (SELECT symbol, bar, CASE WHEN l = 0 THEN NULL WHEN g = 0 THEN 0.0 ELSE 100 - 100 / (1 + g / l) END AS rsi FROM rf), "
        joined = " JOIN rsi USING (symbol, bar)"
    return f"""{rsi}m0 AS (SELECT symbol, bar, ts, open, high, low, close, coalesce({sma('close', p['ma_fast_length'])} > {sma('close', p['ma_slow_length'])}, false) AS up, coalesce({sma('close', p['ma_fast_length'])} < {sma('close', p['ma_slow_length'])}, false) AS dn, {each} FROM bars{joined}),
        m AS (SELECT *, {both} FROM m0),
        e AS (SELECT *, {sides['long']} AND {edge('up')} AS el, {sides['short']} AND {edge('dn')} AS es FROM m),
        sig AS MATERIALIZED (SELECT e.*, atr, {lag('el')} AS pel, {lag('es')} AS pes, {lag('xl')} AS pxl, {lag('xs')} AS pxs, {before} FROM e JOIN ra USING (symbol, bar))"""


def _stops(p: dict[str, Any]) -> tuple[str, str]:
    """(price columns, reason) of the stop orders for pos, ep, hi, lo against a bar."""

    def stop(level_long: str, level_short: str, also_long: str = "true", also_short: str = "true") -> str:
        return f"CASE WHEN pos = 1 AND {also_long} AND low <= {level_long} THEN least({level_long}, open) WHEN pos = -1 AND {also_short} AND high >= {level_short} THEN greatest({level_short}, open) END"

    none = "CAST(NULL AS DOUBLE)"
    sl = stop(f"ep * (1 - {p['stop_loss_pct_long']} / 100.0)", f"ep * (1 + {p['stop_loss_pct_short']} / 100.0)") if p["stop_loss_enabled"] else none
    a, b = f"ep * (1 + {p['take_profit_pct_long']} / 100.0)", f"ep * (1 - {p['take_profit_pct_short']} / 100.0)"
    tp = f"CASE WHEN pos = 1 AND high >= {a} THEN greatest({a}, open) WHEN pos = -1 AND low <= {b} THEN least({b}, open) END" if p["take_profit_enabled"] else none
    t, act = p["trailing_stop_pct"], p["trailing_stop_activation"]
    tr = stop(f"hi * (1 - {t} / 100.0)", f"lo * (1 + {t} / 100.0)", f"hi >= ep * (1 + {act} / 100.0)", f"lo <= ep * (1 - {act} / 100.0)") if p["trailing_stop_enabled"] else none
    at = stop(f"(hi - atr * {p['atr_multiplier']})", f"(lo + atr * {p['atr_multiplier']})") if p["atr_trailing_enabled"] else none
    reason = """CASE WHEN tp_p IS NOT NULL AND (sl_p IS NULL OR abs(open - tp_p) <= abs(open - sl_p)) THEN 'take_profit' WHEN sl_p IS NOT NULL THEN 'stop_loss'
        WHEN tr_p IS NOT NULL THEN 'trailing_stop' WHEN at_p IS NOT NULL THEN 'atr_trailing' END"""
    return f"{sl} AS sl_p, {tp} AS tp_p, {tr} AS tr_p, {at} AS at_p", reason


_STOP_PRICE = "CASE {r} WHEN 'take_profit' THEN tp_p WHEN 'stop_loss' THEN sl_p WHEN 'trailing_stop' THEN tr_p WHEN 'atr_trailing' THEN at_p ELSE {other} END"


def engine_sql(p: dict[str, Any], capital: float = engine.CAPITAL, commission: float = engine.COMMISSION, slippage: float = engine.SLIPPAGE, bars: str = B.DAILY_SQL) -> str:
    """CTEs ``run`` (a row a bar), ``log`` and ``equity`` for the parameter set."""
    prices, reason = _stops(p)
    slip, fee = slippage / 100, 2 * commission
    close_price = lambda r, x: f"CASE WHEN {r} IN ('stop_loss', 'take_profit', 'trailing_stop', 'atr_trailing') THEN {x} ELSE {x} * (1 - pos * {slip!r}) END"
    timed = f"WHEN pos = 1 AND age >= {p['time_exit_bars_long']} OR pos = -1 AND age >= {p['time_exit_bars_short']} THEN 'time_exit'" if p["time_exit_enabled"] else ""
    skip = p["entry_exit_conflict_mode"] == "skip"
    # deferred: an exit that is on at the entry counts only once it has been off; b0, b1, ... are those still on since then
    exits = range(len(_exits_sql(p))) if p["entry_exit_conflict_mode"] == "defer" else ()
    of_side = lambda i, pos: f"CASE WHEN {pos} = 1 THEN p{i}l ELSE p{i}s END"
    deep = "".join(f", s.p{i}l, s.p{i}s, r.b{i} AND CASE WHEN r.pos = 1 THEN s.p{i}l ELSE s.p{i}s END AS b{i}" for i in exits)
    out = "pos <> 0 AND (" + f" {p['exit_operator']} ".join(f"({of_side(i, 'pos')} AND NOT b{i})" for i in exits) + ")" if exits else "pos = 1 AND pxl OR pos = -1 AND pxs"
    held, none = "".join(f", b{i}" for i in exits), "".join(f", false AS b{i}" for i in exits)
    entered = "".join(f", CASE WHEN go <> 0 THEN {of_side(i, 'go')} ELSE b{i} END AS b{i}" for i in exits)
    both = {"skip": "0", "prefer_long": "1", "prefer_short": "-1"}[p["entry_conflict_mode"]]
    loss_pct, win_pct = (p["stop_loss_pct_long"] if p["stop_loss_enabled"] else 3.0), (p["take_profit_pct_long"] if p["take_profit_enabled"] else 5.0)
    share = f"{p['position_size_pct']} / 100.0"
    if p["use_kelly"]:
        odds = f"(CASE WHEN nw + nl >= 20 AND sl_sum > 0 THEN CASE WHEN nw > 0 THEN sw_sum / nw ELSE 0.0 END / greatest(sl_sum / nl, 0.01) ELSE {win_pct} / {loss_pct} END)"
        rate = "(CASE WHEN nw + nl > 0 THEN nw * 1.0 / (nw + nl) ELSE 0.5 END)"
        share = f"CASE WHEN {rate} > 0 THEN CASE WHEN {odds} > 0 THEN greatest(0.0, least(({odds} * {rate} - (1 - {rate})) / {odds}, 1.0)) ELSE 0.0 END * {p['kelly_fraction']} ELSE {share} END"
    return f"""{bars}, {RANGE_SQL}, {ewm('ra', 'rng', {'atr': ('tr', 1 / p['atr_length'])})}, {_signals_sql(p)},
    run AS (
        SELECT symbol, bar, ts, close, CAST({capital} AS DOUBLE) AS cash, 0 AS pos, 0.0::DOUBLE AS ep, 0.0::DOUBLE AS size, 0.0::DOUBLE AS hi, 0.0::DOUBLE AS lo, 0 AS age, 0::BIGINT AS eidx,
            0 AS nw, 0 AS nl, 0.0::DOUBLE AS sw_sum, 0.0::DOUBLE AS sl_sum, CAST({capital} AS DOUBLE) AS mtm, CAST({capital} AS DOUBLE) AS realized, false AS held,
            NULL::STRUCT(eidx BIGINT, ep DOUBLE, pos INT, size DOUBLE, price DOUBLE, reason VARCHAR, pnl DOUBLE, pct DOUBLE, age INT, mae DOUBLE, mfe DOUBLE) AS x1,
            NULL::STRUCT(eidx BIGINT, ep DOUBLE, pos INT, size DOUBLE, price DOUBLE, reason VARCHAR, pnl DOUBLE, pct DOUBLE, age INT, mae DOUBLE, mfe DOUBLE) AS x2{none}
        FROM sig WHERE bar = 0
        UNION ALL
        SELECT symbol, bar, ts, close, f_cash, f_pos, CASE WHEN f_pos <> 0 THEN f_ep ELSE 0.0 END, CASE WHEN f_pos <> 0 THEN f_size ELSE 0.0 END, hi, lo, CASE WHEN f_pos <> 0 THEN f_age ELSE 0 END, f_eidx,
            nw, nl, sw_sum, sl_sum, f_cash + CASE WHEN f_pos <> 0 THEN f_size * (1 + f_pos * (close - f_ep) / f_ep) ELSE 0.0 END, f_cash + CASE WHEN f_pos <> 0 THEN f_size ELSE 0.0 END, was, x1, x2{held}
        FROM (
          SELECT *, CASE WHEN x2 IS NULL THEN pos ELSE 0 END AS f_pos, ep AS f_ep, size AS f_size, age AS f_age, eidx AS f_eidx,
            cash + coalesce(x2.size + x2.pnl, 0.0) AS f_cash
          FROM (
            SELECT * REPLACE (
                nw + CASE WHEN x2.pnl > 0 THEN 1 ELSE 0 END AS nw, nl + CASE WHEN x2.pnl <= 0 THEN 1 ELSE 0 END AS nl,
                sw_sum + CASE WHEN x2.pnl > 0 THEN abs(x2.pct) ELSE 0.0 END AS sw_sum, sl_sum + CASE WHEN x2.pnl <= 0 THEN abs(x2.pct) ELSE 0.0 END AS sl_sum)
            FROM (
              SELECT *, CASE WHEN r2 IS NOT NULL THEN {{'eidx': eidx, 'ep': ep, 'pos': pos, 'size': size, 'price': p2, 'reason': r2, 'pnl': size * ((pos * (p2 - ep) / ep * 100 - {fee!r}) / 100),
                  'pct': pos * (p2 - ep) / ep * 100 - {fee!r}, 'age': 0, 'mae': least(pos * (hi - ep) / ep, pos * (lo - ep) / ep) * 100, 'mfe': greatest(pos * (hi - ep) / ep, pos * (lo - ep) / ep) * 100}} END AS x2
              FROM (
                SELECT *, {_STOP_PRICE.format(r='r2', other='NULL')} AS p2
                FROM (
                  SELECT *, CASE WHEN entered AND {p['allow_same_bar_exit']} THEN {reason} END AS r2
                  FROM (
                    SELECT *, {prices}
                    FROM (
                      SELECT * EXCLUDE (go, pos, ep, size, hi, lo, age, eidx, cash, sl_p, tp_p, tr_p, at_p{held}), go <> 0 AS entered, was_in AS was,
                        CASE WHEN go <> 0 THEN go WHEN x1 IS NULL THEN pos ELSE 0 END AS pos, CASE WHEN go <> 0 THEN open * (1 + go * {slip!r}) ELSE ep END AS ep,
                        CASE WHEN go <> 0 THEN cash * least({share}, 1.0) ELSE size END AS size, CASE WHEN go <> 0 THEN high ELSE hi END AS hi, CASE WHEN go <> 0 THEN low ELSE lo END AS lo,
                        CASE WHEN go <> 0 THEN 0 ELSE age END AS age, CASE WHEN go <> 0 THEN bar ELSE eidx END AS eidx, CASE WHEN go <> 0 THEN cash - cash * least({share}, 1.0) ELSE cash END AS cash{entered}
                      FROM (
                        SELECT *, CASE WHEN NOT free THEN 0 WHEN gl AND gs THEN {both} WHEN gl THEN 1 WHEN gs THEN -1 ELSE 0 END AS go
                        FROM (
                          SELECT * REPLACE (
                              cash + coalesce(x1.size + x1.pnl, 0.0) AS cash, nw + CASE WHEN x1.pnl > 0 THEN 1 ELSE 0 END AS nw, nl + CASE WHEN x1.pnl <= 0 THEN 1 ELSE 0 END AS nl,
                              sw_sum + CASE WHEN x1.pnl > 0 THEN abs(x1.pct) ELSE 0.0 END AS sw_sum, sl_sum + CASE WHEN x1.pnl <= 0 THEN abs(x1.pct) ELSE 0.0 END AS sl_sum),
                            pos = 0 OR (x1 IS NOT NULL AND x1.reason IN ('signal', 'time_exit') AND {p['allow_same_bar_reversal']}) AS free,
                            pel AND coalesce(x1.pos, 0) <> 1 AND NOT ({skip} AND pxl) AS gl, pes AND coalesce(x1.pos, 0) <> -1 AND NOT ({skip} AND pxs) AS gs
                          FROM (
                            SELECT *, CASE WHEN r1 IS NOT NULL THEN {{'eidx': eidx, 'ep': ep, 'pos': pos, 'size': size, 'price': p1, 'reason': r1, 'pnl': size * ((pos * (p1 - ep) / ep * 100 - {fee!r}) / 100),
                                'pct': pos * (p1 - ep) / ep * 100 - {fee!r}, 'age': age, 'mae': least(pos * (hi - ep) / ep, pos * (lo - ep) / ep) * 100, 'mfe': greatest(pos * (hi - ep) / ep, pos * (lo - ep) / ep) * 100}} END AS x1
                            FROM (
                              SELECT *, {close_price('r1', f"({_STOP_PRICE.format(r='r1', other='open')})")} AS p1
                              FROM (
                                SELECT *, CASE WHEN pos <> 0 THEN CASE WHEN {reason} IS NOT NULL THEN {reason} {timed} WHEN {out} THEN 'signal' END END AS r1
                                FROM (
                                  SELECT *, {prices}
                                  FROM (
                                    SELECT s.symbol, s.bar, s.ts, s.open, s.high, s.low, s.close, s.atr, s.pel, s.pes, s.pxl, s.pxs{deep}, r.cash, r.pos, r.ep, r.size, r.eidx, r.nw, r.nl, r.sw_sum, r.sl_sum,
                                      r.pos <> 0 AS was_in, CASE WHEN r.pos <> 0 THEN r.age + 1 ELSE 0 END AS age, CASE WHEN r.pos <> 0 THEN greatest(r.hi, s.high) ELSE 0.0 END AS hi, CASE WHEN r.pos <> 0 THEN least(r.lo, s.low) ELSE 0.0 END AS lo
                                    FROM run r JOIN sig s ON s.symbol = r.symbol AND s.bar = r.bar + 1))))))))))))))
    ),
    ends AS (SELECT symbol, max(bar) AS bar FROM run GROUP BY symbol),
    fin AS (SELECT r.*, close * (1 - pos * {slip!r}) AS price FROM run r JOIN ends USING (symbol, bar) WHERE pos <> 0),
    fills AS (
        SELECT symbol, bar AS exit_idx, ts AS exit_ts, 1 AS part, unnest(x1) FROM run WHERE x1 IS NOT NULL
        UNION ALL SELECT symbol, bar, ts, 2, unnest(x2) FROM run WHERE x2 IS NOT NULL
        UNION ALL SELECT symbol, bar, ts, 3, eidx, ep, pos, size, price, 'end_of_data', size * ((pos * (price - ep) / ep * 100 - {fee!r}) / 100), pos * (price - ep) / ep * 100 - {fee!r}, age,
            least(pos * (hi - ep) / ep, pos * (lo - ep) / ep) * 100, greatest(pos * (hi - ep) / ep, pos * (lo - ep) / ep) * 100 FROM fin),
    log AS (SELECT t.*, t.eidx AS entry_idx, s.ts AS entry_ts, t.ep AS entry_price, CASE WHEN t.pos = 1 THEN 'long' ELSE 'short' END AS direction, t.price AS exit_price, t.reason AS exit_reason, t.pct AS pnl_pct, t.age AS bars_held,
            row_number() OVER (PARTITION BY t.symbol ORDER BY exit_idx, part) - 1 AS trade_no FROM fills t JOIN sig s ON s.symbol = t.symbol AND s.bar = t.eidx),
    equity AS (SELECT run.symbol, run.bar, run.ts, coalesce(run.cash + f.size + t.pnl, run.mtm) AS mtm, coalesce(run.cash + f.size + t.pnl, run.realized) AS realized, run.held
        FROM run LEFT JOIN fin f ON f.symbol = run.symbol AND f.bar = run.bar LEFT JOIN fills t ON t.symbol = run.symbol AND t.exit_idx = run.bar AND t.part = 3)"""


TRADE_SHOW = shown("log", "entry_price, exit_price, pnl_pct, mae, mfe", 8, "symbol, direction, exit_reason", "entry_ts", "trade_no, entry_idx, exit_idx, bars_held")


def _trades(p: dict[str, Any], bars: Callable[[SparkSession, str], DataFrame] = B.daily, **costs: float) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = engine.trades_of(engine.backtest(bars(spark, sf_dir), p, **costs))
        return rounded(t.select("symbol", "direction", "exit_reason", "entry_ts", "trade_no", "entry_idx", "exit_idx", "bars_held", "entry_price", "exit_price", "pnl_pct", "mae", "mfe"), 8)  # prices with costs have up to eight digits: none is a tie

    return run


#: Parameters of the trade queries; rules that only differ in size aren't repeated.
BACKTESTS: dict[str, dict[str, Any]] = {
    "bt_stop_loss": {"stop_loss_enabled": True, "stop_loss_pct_long": 20.0, "stop_loss_pct_short": 25.0},
    "bt_take_profit": {"take_profit_enabled": True, "take_profit_pct_long": 30.0, "take_profit_pct_short": 20.0},
    "bt_sl_tp_conflict": {"stop_loss_enabled": True, "take_profit_enabled": True, "stop_loss_pct_long": 10.0, "stop_loss_pct_short": 10.0},
    "bt_trailing": {"trailing_stop_enabled": True, "trailing_stop_pct": 15.0, "trailing_stop_activation": 5.0},
    "bt_atr_trail": {"atr_trailing_enabled": True, "atr_multiplier": 0.5},
    "bt_time_exit": {"time_exit_enabled": True, "time_exit_bars_long": 4, "time_exit_bars_short": 3},
    "bt_signal_exit": {},
    "bt_both_directions": {"stop_loss_enabled": True, "stop_loss_pct_long": 30.0, "stop_loss_pct_short": 30.0, "time_exit_enabled": True},
    "bt_long_only": {"trade_direction": "long_only"},
    "bt_short_only": {"trade_direction": "short_only"},
    "bt_same_bar_exit_off": {"stop_loss_enabled": True, "stop_loss_pct_long": 20.0, "allow_same_bar_exit": False},
    "bt_reversal_on": {"allow_same_bar_reversal": True, "time_exit_enabled": True, "time_exit_bars_long": 3, "time_exit_bars_short": 3},
    "bt_conflict_prefer_long": {"entry_conflict_mode": "prefer_long", "entry_exit_conflict_mode": "defer"},
    "bt_conflict_prefer_short": {"entry_conflict_mode": "prefer_short"},
    "bt_skip_mode": {"entry_exit_conflict_mode": "skip", "stop_loss_enabled": True, "stop_loss_pct_long": 20.0},
    "bt_position_size": {"position_size_pct": 2.5, "stop_loss_enabled": True},
    "bt_all_stops": {"stop_loss_enabled": True, "take_profit_enabled": True, "trailing_stop_enabled": True, "atr_trailing_enabled": True, "time_exit_enabled": True, "stop_loss_pct_long": 30.0, "stop_loss_pct_short": 30.0, "take_profit_pct_long": 40.0, "take_profit_pct_short": 40.0, "trailing_stop_pct": 10.0},
}
for _name, _more in BACKTESTS.items():
    _p = P.make(**{**BASE, **_more})
    register(_name, _trades(_p), f"WITH RECURSIVE {engine_sql(_p)} {TRADE_SHOW}")
_STOPPED = P.make(**{**BASE, **BACKTESTS["bt_all_stops"]})
register("bt_costs", _trades(_STOPPED, commission=0.25, slippage=0.25), f"WITH RECURSIVE {engine_sql(_STOPPED, commission=0.25, slippage=0.25)} {TRADE_SHOW}")
register("bt_multi_asset", _trades(_STOPPED, B.by_priority), f"WITH RECURSIVE {engine_sql(_STOPPED, bars=B.PRIORITY_SQL)} {TRADE_SHOW}")
_DEFERRED = P.make(**{**BASE, "entry_exit_conflict_mode": "defer", "rsi_exit_enabled": True})
register("bt_defer_mode", _trades(_DEFERRED), f"WITH RECURSIVE {engine_sql(_DEFERRED)} {TRADE_SHOW}")
_KELLY = P.make(**{**BASE, "use_kelly": True, "take_profit_enabled": True, "stop_loss_enabled": True, "stop_loss_pct_long": 20.0, "stop_loss_pct_short": 20.0, "take_profit_pct_long": 30.0, "take_profit_pct_short": 30.0})


def _sized(p: dict[str, Any]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = engine.trades_of(engine.backtest(B.daily(spark, sf_dir), p))
        return rounded(t.select("trade_no", "direction", "exit_reason", "size_dollars", "pnl"), 2)

    return run


register("bt_kelly", _sized(_KELLY), f"WITH RECURSIVE {engine_sql(_KELLY)} SELECT CAST(trade_no AS BIGINT) AS trade_no, direction, exit_reason, round(size, 2) + 0.0 AS size_dollars, round(pnl, 2) + 0.0 AS pnl FROM log")
register("trade_log_filter", lambda s, d: _sized(_STOPPED)(s, d).where("direction = 'long' AND pnl <= 0"), f"WITH RECURSIVE {engine_sql(_STOPPED)} SELECT CAST(trade_no AS BIGINT) AS trade_no, direction, exit_reason, round(size, 2) + 0.0 AS size_dollars, round(pnl, 2) + 0.0 AS pnl FROM log WHERE direction = 'long' AND round(pnl, 2) <= 0")


def _events(spark: SparkSession, sf_dir: str, p: dict[str, Any] = _STOPPED, bars: Callable = B.by_priority) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bars, trades, equity), the engine run once."""
    b = bars(spark, sf_dir)
    e = saved(engine.backtest(b, p))
    return b, engine.trades_of(e), engine.equity_of(e)


_RUN = f"WITH RECURSIVE {engine_sql(_STOPPED, bars=B.PRIORITY_SQL)}"


@query(f"{_RUN} SELECT symbol, CAST(bar AS BIGINT) AS bar, round(mtm, 2) + 0.0 AS mtm_equity, round(realized, 2) + 0.0 AS realized_equity, held AS in_position FROM equity")
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_events(spark, sf_dir)[2].select("symbol", "bar", "mtm_equity", "realized_equity", "in_position"), 2)


_GAP = "epoch(ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts))"
_YEAR = "CASE WHEN g IS NULL THEN 252 WHEN g <= 120 THEN 98280 WHEN g <= 600 THEN 19656 WHEN g <= 1800 THEN 6552 WHEN g <= 3600 THEN 3276 WHEN g <= 7200 THEN 1764 WHEN g <= 172800 THEN 252 WHEN g <= 864000 THEN 52 ELSE 12 END"
_PER_YEAR = f"py AS (SELECT symbol, {_YEAR} AS y FROM (SELECT symbol, median(g) AS g FROM (SELECT symbol, {_GAP} AS g FROM bars) GROUP BY symbol))"


@query(f"WITH {B.HOURLY_SQL}, {_PER_YEAR} SELECT symbol, CAST(y AS BIGINT) AS bars_per_year FROM py")
def bars_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bars_per_year(B.hourly(spark, sf_dir))


_PF = "CASE WHEN {l} > 0 THEN least({g} / {l}, 999.99) WHEN {g} > 0 THEN 999.99 ELSE 0.0 END"
_PNL = {"g": "coalesce(sum(pnl) FILTER (pnl > 0), 0.0)", "l": "abs(coalesce(sum(pnl) FILTER (pnl <= 0), 0.0))"}
_METRICS = f"""{_PER_YEAR}, tr AS (SELECT symbol, count(*) AS num_trades, count(*) FILTER (pnl > 0) AS winners, count(*) FILTER (pnl <= 0) AS losers, {_PF.format(**_PNL)} AS profit_factor,
        coalesce(avg(pnl) FILTER (pnl > 0), 0.0) AS avg_winner, coalesce(avg(pnl) FILTER (pnl <= 0), 0.0) AS avg_loser, avg(pnl) AS avg_trade, avg(bars_held) AS avg_bars_held, avg(mae) AS avg_mae, avg(mfe) AS avg_mfe FROM log GROUP BY symbol),
    rn AS (SELECT symbol, w, max(n) AS n FROM (SELECT symbol, w, i, count(*) AS n FROM (SELECT symbol, pnl > 0 AS w, row_number() OVER (PARTITION BY symbol ORDER BY trade_no) - row_number() OVER (PARTITION BY symbol, pnl > 0 ORDER BY trade_no) AS i FROM log) GROUP BY ALL) GROUP BY ALL),
    q AS (SELECT *, max(mtm) {over()} AS peak, mtm / nullif({lag('mtm')}, 0) - 1 AS r FROM equity), sp AS (SELECT *, sum(CAST(mtm >= peak AS INT)) {over()} AS spell FROM q),
    ld AS (SELECT symbol, max(n) AS longest FROM (SELECT symbol, spell, count(*) FILTER (mtm < peak) AS n FROM sp GROUP BY ALL) GROUP BY symbol),
    eq AS (SELECT symbol, arg_max(mtm, bar) AS last, count(*) AS n, min(mtm - peak) AS max_drawdown, min((mtm - peak) / nullif(peak, 0)) * 100 AS max_drawdown_pct, count(r) AS nr, count(r) FILTER (held) AS na,
        avg(r) FILTER (held) AS mean, stddev_samp(r) FILTER (held) AS sd, count(r) FILTER (held AND r < 0) AS nd, stddev_samp(r) FILTER (held AND r < 0) AS dsd, avg(CAST(held AS INT)) * 100 AS pct_time FROM q GROUP BY symbol),
    al AS (SELECT *, winners * 1.0 / num_trades AS rate, CASE WHEN na > 1 AND sd > 0 THEN mean / sd * sqrt(na * y * 1.0 / nr) ELSE 0.0 END AS sharpe, CASE WHEN last > 0 THEN (pow(last / 10000.0, y * 1.0 / n) - 1) * 100 ELSE 0.0 END AS cagr
        FROM eq JOIN tr USING (symbol) JOIN py USING (symbol) JOIN ld USING (symbol))"""


@query(f"""{_RUN}, {_METRICS} SELECT symbol, num_trades, winners, losers, round(rate * 100, 4) AS win_rate, round(profit_factor, 4) AS profit_factor, round(avg_winner, 3) AS avg_winner, round(avg_loser, 3) AS avg_loser,
    round(avg_trade, 3) AS avg_trade, round(avg_bars_held, 4) AS avg_bars_held, round(avg_mae, 4) AS avg_mae, round(avg_mfe, 4) AS avg_mfe, round(rate * avg_winner - (1 - rate) * abs(avg_loser), 3) AS expectancy,
    round(CASE WHEN avg_loser <> 0 THEN least(avg_winner / abs(avg_loser), 999.99) ELSE 999.99 END, 4) AS payoff_ratio, round(last - 10000, 2) AS total_return, round(cagr, 4) AS cagr, round(max_drawdown, 2) AS max_drawdown,
    round(max_drawdown_pct, 4) AS max_drawdown_pct, longest AS longest_drawdown_bars, round(sharpe, 4) AS sharpe_ratio, round(CASE WHEN nd > 1 AND dsd > 0 THEN mean / dsd * sqrt(na * y * 1.0 / nr) ELSE sharpe END, 4) AS sortino_ratio,
    round(coalesce(abs(cagr / nullif(max_drawdown_pct, 0)), 0.0), 4) AS calmar_ratio, round(pct_time, 4) AS pct_time_in_market, coalesce((SELECT n FROM rn WHERE rn.symbol = al.symbol AND w), 0) AS max_consecutive_wins,
    coalesce((SELECT n FROM rn WHERE rn.symbol = al.symbol AND NOT w), 0) AS max_consecutive_losses FROM al""")
def metrics_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, t, e = _events(spark, sf_dir)
    m = metrics.metrics(t, e, metrics.bars_per_year(b), engine.CAPITAL)
    digits = {"avg_winner": 3, "avg_loser": 3, "avg_trade": 3, "expectancy": 3, "total_return": 2, "max_drawdown": 2}
    counts = ("num_trades", "winners", "losers", "longest_drawdown_bars", "max_consecutive_wins", "max_consecutive_losses")
    shares = ("win_rate", "profit_factor", "avg_bars_held", "avg_mae", "avg_mfe", "payoff_ratio", "cagr", "max_drawdown_pct", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "pct_time_in_market")
    return m.select("symbol", *counts, *[(F.round(c, digits.get(c, 4)) + F.lit(0.0)).alias(c) for c in (*digits, *shares)])


@query(f"{_RUN}, sides AS (SELECT symbol, unnest(['long', 'short']) AS direction FROM (SELECT DISTINCT symbol FROM log)), f AS (SELECT symbol, direction, count(*) AS n, avg(CAST(pnl > 0 AS INT)) * 100 AS w, {_PF.format(**_PNL)} AS pf, avg(pnl_pct) AS a FROM log GROUP BY ALL) SELECT symbol, direction, coalesce(n, 0) AS n, round(coalesce(w, 0.0), 4) AS win_rate, round(coalesce(pf, 0.0), 4) AS profit_factor, round(coalesce(a, 0.0), 4) AS avg_pnl_pct FROM sides LEFT JOIN f USING (symbol, direction)")
def direction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.direction_split(_events(spark, sf_dir)[1]).drop("param_id"), 4)


for _period, _label in (("month", "strftime(exit_ts, '%Y-%m')"), ("quarter", "year(exit_ts) || 'Q' || quarter(exit_ts)")):
    register(
        f"period_{_period}", lambda s, d, period=_period: rounded(metrics.period_stats(_events(s, d)[1], period).drop("param_id"), 4),
        f"{_RUN} SELECT symbol, {_label} AS period, count(*) AS n, round(avg(CAST(pnl > 0 AS INT)) * 100, 4) AS win_rate, round({_PF.format(**_PNL)}, 4) AS profit_factor, round(sum(pnl_pct), 4) AS sum_pnl_pct FROM log GROUP BY symbol, {_label}",
    )
for _bucket, _expr, _sql in (("dow", lambda: F.weekday("entry_ts"), "isodow(entry_ts) - 1"), ("month", lambda: F.month("entry_ts"), "month(entry_ts)")):
    _k, _n = "count(*) FILTER (pnl > 0)", "count(*)"
    _wil = lambda sign, k=_k, n=_n: f"((({k} * 1.0 / {n}) + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n}) {sign} 1.96 * sqrt(({k} * 1.0 / {n}) * (1 - {k} * 1.0 / {n}) / {n} + 3.8416 / (4.0 * {n} * {n})) / (1 + 3.8416 / {n})) * 100"
    register(
        f"cal_trades_{_bucket}", lambda s, d, e=_expr: rounded(calendars.trade_calendar(_events(s, d)[1], e()), 3),
        f"{_RUN} SELECT symbol, CAST({_sql} AS BIGINT) AS bucket, count(*) AS n, round({_k} * 100.0 / {_n}, 3) AS win_rate, round(greatest(0.0, {_wil('-')}), 3) AS ci_low, round(least(100.0, {_wil('+')}), 3) AS ci_high, round(avg(pnl), 3) AS avg_pnl, round(avg(pnl_pct), 3) AS avg_pnl_pct, round(sum(pnl), 3) AS total_pnl FROM log GROUP BY symbol, {_sql}",
    )

# against the market


def _held(since: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b, t, e = _events(spark, sf_dir)
        return rounded(metrics.buy_and_hold(b, e, t if since else None).select("symbol", "bar", "equity", "benchmark"), 2)

    return run


_BH = """{run}, j AS (SELECT e.symbol, e.bar, e.ts, e.mtm, b.close FROM equity e JOIN bars b USING (symbol, ts) {where}) SELECT symbol, CAST(bar AS BIGINT) AS bar, round(mtm, 2) + 0.0 AS equity,
    round(CASE WHEN first(mtm) OVER w > 0 AND first(close) OVER w > 0 THEN close / first(close) OVER w * first(mtm) OVER w END, 2) + 0.0 AS benchmark FROM j WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
register("bh_full_window", _held(False), _BH.format(run=_RUN, where=""))
register("bh_since_first_trade", _held(True), _BH.format(run=_RUN, where="JOIN (SELECT symbol, min(entry_ts) AS f FROM log GROUP BY symbol) x ON x.symbol = e.symbol AND e.ts >= f"))


@query(f"""{_RUN}, a AS (SELECT symbol, ts, mtm / nullif({lag('mtm')}, 0) - 1 AS s FROM equity), mk AS (SELECT symbol, ts, close / nullif({lag('close')}, 0) - 1 AS b FROM bars)
    SELECT symbol, count(*) AS n, round(CASE WHEN count(*) >= 10 THEN covar_samp(s, b) / var_samp(b) ELSE 0.0 END, 6) AS beta, round((avg(s) - covar_samp(s, b) / var_samp(b) * avg(b)) * 25200, 4) AS alpha, round(corr(s, b), 6) AS correlation
    FROM a JOIN mk USING (symbol, ts) WHERE s IS NOT NULL AND b IS NOT NULL GROUP BY symbol""")
def beta_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, _, e = _events(spark, sf_dir)
    mine = e.select("symbol", "ts", (W.ratio(F.col("mtm_equity"), W.previous("mtm_equity")) - 1).alias("s"))
    market = b.select("symbol", "ts", W.pct_change("close").alias("b"))
    out = metrics.beta_alpha(metrics.aligned(mine, market), "s", "b")
    return out.select("symbol", "n", F.round("beta", 6).alias("beta"), F.round("alpha", 4).alias("alpha"), F.round("correlation", 6).alias("correlation"))


@query(f"""WITH {B.PRIORITY_SQL}, {_PER_YEAR}, q AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS r, max(close) {over()} AS peak FROM bars),
    a AS (SELECT symbol, arg_min(close, bar) AS f, arg_max(close, bar) AS l, count(*) AS n, min((close - peak) / peak) * 100 AS dd, count(r) AS nr, count(r) FILTER (r <> 0) AS na, avg(r) FILTER (r <> 0) AS m, stddev_samp(r) FILTER (r <> 0) AS sd FROM q GROUP BY symbol)
    SELECT symbol, round(l / f * 100 - 100, 4) AS total_return_pct, round((pow(l / f, y * 1.0 / n) - 1) * 100, 4) AS cagr, round(dd, 4) AS max_drawdown_pct, round(m / sd * sqrt(na * y * 1.0 / nr), 4) AS sharpe FROM a JOIN py USING (symbol)""")
def curve_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.by_priority(spark, sf_dir)
    return rounded(metrics.curve_stats(b.withColumn("value", F.col("close")).join(metrics.bars_per_year(b), "symbol")), 4)


@query(f"""WITH {B.PRIORITY_SQL}, q AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS r FROM bars) SELECT symbol, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts,
    round(min(close), 4) AS close_min, round(max(close), 4) AS close_max, round(stddev_samp(r) * sqrt(252) * 100, 4) AS annual_vol, round((arg_max(close, bar) / arg_min(close, bar) - 1) * 100, 4) AS total_return FROM q GROUP BY symbol""")
def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.session import summary

    return rounded(summary(B.by_priority(spark, sf_dir)), 4)


# sweeps: metrics of many parameter sets


def _sweep_sql(sets: list[tuple[str, str]], metric: str, digits: int = 4) -> str:
    """UNION of one run for each (labels, CTEs)."""
    one = f"SELECT symbol, {{labels}}, round({metric}, {digits}) AS value FROM al"
    return " UNION ALL ".join(f"SELECT * FROM (WITH RECURSIVE {ctes}, {_METRICS} {one.format(labels=labels)})" for labels, ctes in sets)


_GRID_X, _GRID_Y = [5.0 * k for k in range(1, 8)], [10.0 + 5 * k for k in range(9)]
_GRID_BASE = P.make(**{**BASE, "stop_loss_enabled": True, "take_profit_enabled": True})


def labelled_sql(symbol: str, more: str, base: str = B.DAILY_SQL) -> str:
    """CTE ``bars``: those of ``base`` once for each row of ``more``, with a symbol made of its columns."""
    return base.replace("bars AS MATERIALIZED", "one AS MATERIALIZED") + f", bars AS MATERIALIZED (SELECT one.* REPLACE ({symbol} AS symbol) FROM one, {more})"


#: The sets of the grid are symbols, so one recursion runs them all; a limit is read off the symbol's name.
_GRID_BARS = labelled_sql("x || '#' || y", f"(SELECT unnest({_GRID_X}) AS x), (SELECT unnest({_GRID_Y}) AS y)")
_GRID_SET = {**_GRID_BASE, "stop_loss_pct_long": "CAST(split_part(symbol, '#', 1) AS DOUBLE)", "take_profit_pct_long": "CAST(split_part(symbol, '#', 2) AS DOUBLE)"}


@query(f"WITH RECURSIVE {engine_sql(_GRID_SET, bars=_GRID_BARS)}, {_METRICS} SELECT 'ALL' AS symbol, CAST(split_part(symbol, '#', 1) AS DOUBLE) AS x, CAST(split_part(symbol, '#', 2) AS DOUBLE) AS y, round(profit_factor, 4) AS value FROM al")
def grid_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.heatmap(B.daily(spark, sf_dir), _GRID_BASE, ("stop_loss_pct_long", _GRID_X), ("take_profit_pct_long", _GRID_Y), "profit_factor"), 4)


_ROUND_TRIPS = (0.3, 0.5, 1.0, 2.0, 3.0)


@query(_sweep_sql([(f"CAST({rt} AS DOUBLE) AS round_trip_pct", engine_sql(_STOPPED, commission=rt / 4, slippage=rt / 4)) for rt in _ROUND_TRIPS], "profit_factor"))
def cost_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.cost_sweep(B.daily(spark, sf_dir), _STOPPED).select("symbol", "round_trip_pct", F.col("profit_factor").alias("value")), 4)


_RISK = P.make(**{**BASE, "ma_trend_enabled": True, "stop_loss_enabled": True, "stop_loss_pct_long": 20.0, "stop_loss_pct_short": 20.0})


def _sensitivity_sql() -> str:
    rows = search.variations(_RISK)
    runs = _sweep_sql([(f"'{name}' AS param, CAST({base} AS DOUBLE) AS base, CAST({low} AS DOUBLE) AS low, CAST({high} AS DOUBLE) AS high, {j} AS j", engine_sql({**_RISK, name: (low, high)[j]})) for name, base, low, high in rows for j in (0, 1)], "profit_factor", 12)
    value = "max(value) FILTER (j = {})".format
    return f"""SELECT symbol, param, base, low, high, round({value(0)}, 4) AS low_value, round({value(1)}, 4) AS high_value, round(abs({value(1)} - {value(0)}), 4) AS sensitivity
        FROM ({runs}) GROUP BY symbol, param, base, low, high"""


@query(_sensitivity_sql())
def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.sensitivity(B.daily(spark, sf_dir), _RISK), 4)
