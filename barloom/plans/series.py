"""Queries on bars, window indicators, folds and signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import windows as W
from barloom.operators import params as P
from barloom.operators import ranges, signals, specs
from barloom.operators.indicators import Plan
from barloom.plans.catalogue import RANGE_SQL, ema_alpha, ewm, full, lag, over, query, rank_of, register, rounded, shown, sma, std
from barloom.sources import bars as B
from barloom.sources import clean as C

BAR_DOUBLES = "open, high, low, close, volume"


def _bars(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    register(name, lambda s, d: rounded(make(s, d), 8), f"WITH {sql} {shown('bars', BAR_DOUBLES, 8, 'symbol, bar', 'ts')}")


_bars("bars_daily", B.daily, B.DAILY_SQL)
_bars("bars_sym", B.by_priority, B.PRIORITY_SQL)
_bars("bars_hourly", B.hourly, B.HOURLY_SQL)
_bars("bars_ship", B.shipped, B.SHIP_SQL)


@query(f"""WITH {B.DAILY_SQL}, many AS (
        SELECT ts, open, high, low, close, volume, 1 AS seq FROM bars UNION ALL SELECT ts, open * 2, high * 2, low * 2, close * 2, volume, 2 FROM bars WHERE bar % 7 = 0
        UNION ALL SELECT ts, open, high, low, NULL, volume, 3 FROM bars WHERE bar % 11 = 0),
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY seq DESC) AS n FROM many) WHERE n = 1 AND close IS NOT NULL)
    SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(open, 4) AS open, round(close, 4) AS close, row_number() OVER (ORDER BY ts) - 1 AS bar FROM kept""")
def clean_dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.daily(spark, sf_dir).select("symbol", F.col("ts"), "open", "high", "low", "close", "volume", "bar")
    again = b.where("bar % 7 = 0").select("symbol", "ts", *[(F.col(c) * 2).alias(c) for c in B.OHLC], "volume", F.lit(2).alias("seq"))
    holes = b.where("bar % 11 = 0").select("symbol", "ts", "open", "high", "low", F.lit(None).cast("double").alias("close"), "volume", F.lit(3).alias("seq"))
    rows = b.drop("bar").withColumn("seq", F.lit(1)).unionByName(again).unionByName(holes)
    return rounded(C.clean(rows.toDF(*[c.upper() for c in rows.columns]), "SEQ").select("ts", "open", "close", "bar"), 4)


@query(f"""WITH {B.DAILY_SQL}, x AS (SELECT *, {lag('ts')} AS before FROM (SELECT symbol, ts, bar, open, close, low, CASE WHEN bar % 5 = 0 THEN low ELSE high END AS high FROM bars))
    SELECT count(*) AS n_rows, count(*) FILTER (least(open, high, low, close) <= 0) AS n_not_positive, count(*) FILTER (high < greatest(open, close, low)) AS n_high_too_low,
        count(*) FILTER (low > least(open, close)) AS n_low_too_high, count(*) FILTER (ts <= before) AS n_not_ascending FROM x""")
def validate_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.violations(B.daily(spark, sf_dir).withColumn("high", F.when(F.col("bar") % 5 == 0, F.col("low")).otherwise(F.col("high"))))


_OFFERED = " ".join(f"WHEN '{step}' THEN {days}" for step, days in C.MAX_DAYS.items())


@query(f"""WITH {B.PRIORITY_SQL}, r AS (SELECT symbol, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM bars GROUP BY symbol), q AS (SELECT symbol, a, b, unnest({list(C.INTERVALS)}) AS step FROM r),
    d AS (SELECT *, b - CAST(CASE step {_OFFERED} END AS INT) AS first FROM q)
    SELECT symbol, step, CAST(CASE WHEN a < first THEN first ELSE a END AS VARCHAR) AS start, coalesce(a < first, false) AS clamped FROM d""")
def clamp_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From where each interval is offered, for the range of every symbol's bars."""
    r = B.by_priority(spark, sf_dir).groupBy("symbol").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    r = r.withColumn("step", F.explode(F.array(*map(F.lit, C.INTERVALS))))
    start, moved = C.clamped_start(F.col("a"), F.col("b"), F.col("step"))
    return r.select("symbol", "step", start.cast("string").alias("start"), moved.alias("clamped"))


# indicators over daily bars


def _plan(name: str, build: Callable[[Plan], dict[str, str]], ctes: str, select: str, columns: str, digits: int = 4, bars: Callable = B.daily, base: str = B.DAILY_SQL, kinds: str = "doubles") -> None:
    """A query of the named plan columns; ``select`` is SQL over ``ctes`` giving bar, symbol and ``columns``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        plan = Plan()
        wanted = build(plan)
        return rounded(plan.apply(bars(spark, sf_dir)).select("symbol", "bar", *[F.col(c).alias(a) for a, c in wanted.items()]), digits)

    ctes = f", {ctes}" if ctes else ""
    shape = {"doubles": columns} if kinds == "doubles" else {"plain": f"symbol, bar, {columns}"}
    shape.setdefault("plain", "symbol, bar")
    register(name, run, f"WITH RECURSIVE {base}{ctes}, result AS ({select}) " + shown("result", shape.get("doubles", ""), digits, shape["plain"]))


_plan("sma", lambda g: {"v20": g.sma("close", 20), "v50": g.sma("close", 50)}, "", f"SELECT symbol, bar, {sma('close', 20)} AS v20, {sma('close', 50)} AS v50 FROM bars", "v20, v50")
_plan("sma_sym", lambda g: {"v20": g.sma("close", 20)}, "", f"SELECT symbol, bar, {sma('close', 20)} AS v20 FROM bars", "v20", bars=B.by_priority, base=B.PRIORITY_SQL)
_plan("wma", lambda g: {"v10": g.wma("close", 10)}, "", "SELECT symbol, bar, CASE WHEN " + lag("close", 9) + " IS NOT NULL THEN (" + " + ".join(f"{10 - k} * {lag('close', k) if k else 'close'}" for k in range(10)) + ") / 55 END AS v10 FROM bars", "v10")
_plan("vwma", lambda g: {"v20": g.vwma("close", 20)}, "pv AS (SELECT *, close * volume AS cv FROM bars)", f"SELECT symbol, bar, {full('cv', 20, f'sum(cv) {over(20)} / nullif(sum(volume) {over(20)}, 0)')} AS v20 FROM pv", "v20", 6)
_plan("percentile_rank", lambda g: {"rank100": g.percentile_rank("close", 100)}, "", f"SELECT symbol, bar, {rank_of('close', 100)} AS rank100 FROM bars", "rank100")
register("percentile_rank_join", lambda s, d: rounded(ranges.percentile_rank(B.by_priority(s, d), "close", 100), 4), f"WITH {B.PRIORITY_SQL}, q AS (SELECT symbol, bar, {rank_of('close', 100)} AS rank FROM bars) SELECT symbol, bar, round(rank, 4) + 0.0 AS rank FROM q")
_plan("bollinger_width", lambda g: {"width": g.band_width(20)}, "", f"SELECT symbol, bar, 4.0 * {std('close', 20)} / nullif({sma('close', 20)}, 0) * 100 AS width FROM bars", "width")
_BBWP = f"wid AS MATERIALIZED (SELECT symbol, bar, 4.0 * {std('close', 13)} / nullif({sma('close', 13)}, 0) * 100 AS width FROM bars), rk AS MATERIALIZED (SELECT symbol, bar, {rank_of('width', 252)} AS bbwp FROM wid)"
_plan("bbwp", lambda g: {"bbwp": g.bbwp(13, 252)}, _BBWP, "SELECT * FROM rk", "bbwp")


def _bbwp_slope(g: Plan) -> dict[str, str]:
    mean = g.sma(g.bbwp(13, 252), 5)
    return {"falling": g.column("falling", (mean,), lambda: F.coalesce(F.col(mean) < W.previous(mean), F.lit(False)))}


_plan("bbwp_slope", _bbwp_slope, _BBWP + f", sl AS (SELECT symbol, bar, {sma('bbwp', 5)} AS m FROM rk)", f"SELECT symbol, bar, coalesce(m < {lag('m')}, false) AS falling FROM sl", "falling", kinds="plain")
_plan("pamrp_sma", lambda g: {"pamrp": g.pamrp(20, 350, "sma")}, f"pm AS MATERIALIZED (SELECT symbol, bar, close / nullif({sma('close', 20)}, 0) AS x FROM bars)", f"SELECT symbol, bar, {rank_of('x', 350)} AS pamrp FROM pm", "pamrp")
_plan("pamrp_vwma", lambda g: {"pamrp": g.pamrp(20, 200, "vwma")}, f"pv AS (SELECT *, close * volume AS cv FROM bars), pm AS MATERIALIZED (SELECT symbol, bar, close / nullif({full('cv', 20, f'sum(cv) {over(20)} / nullif(sum(volume) {over(20)}, 0)')}, 0) AS x FROM pv)", f"SELECT symbol, bar, {rank_of('x', 200)} AS pamrp FROM pm", "pamrp")
_plan("vwap_session", lambda g: {"vwap": g.vwap()}, "", f"SELECT symbol, bar, sum((high + low + close) / 3 * volume) {over(None, by='symbol, CAST(ts AS DATE)')} / nullif(sum(volume) {over(None, by='symbol, CAST(ts AS DATE)')}, 0) AS vwap FROM bars", "vwap", 6, bars=B.hourly, base=B.HOURLY_SQL)
_plan("true_range", lambda g: {"tr": g.true_range()}, RANGE_SQL, "SELECT symbol, bar, tr FROM rng", "tr")


def _pivots(g: Plan) -> dict[str, str]:
    return {"low": g.column("piv_low", (), lambda: W.pivot("close", 5, 5, True)), "high": g.column("piv_high", (), lambda: W.pivot("close", 5, 5, False))}


def _pivot_sql(x: str, f: str, left: int = 5, right: int = 5) -> str:
    frame = f"OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING)"
    return f"coalesce(count({x}) {frame} = {left + right + 1} AND {x} = {f}({x}) {frame}, false)"


_plan("pivots", _pivots, "", f"SELECT symbol, bar, {_pivot_sql('close', 'min')} AS low, {_pivot_sql('close', 'max')} AS high FROM bars", "low, high", kinds="plain")
_RSI = RANGE_SQL + ", " + ewm("rf", "moves", {"g": ("gain", 1 / 14), "l": ("loss", 1 / 14)}) + ", rsi AS MATERIALIZED (SELECT rf.symbol, rf.bar, close, CASE WHEN l = 0 THEN NULL WHEN g = 0 THEN 0.0 ELSE 100 - 100 / (1 + g / l) END AS rsi FROM rf JOIN bars USING (symbol, bar))"
_plan("rsi", lambda g: {"rsi": g.rsi(14)}, _RSI, "SELECT symbol, bar, rsi FROM rsi", "rsi")
_DIV = _RSI + f""", piv AS MATERIALIZED (SELECT *, {_pivot_sql('close', 'min')} AS lc, {_pivot_sql('rsi', 'min')} AS lr, {_pivot_sql('close', 'max')} AS hc, {_pivot_sql('rsi', 'max')} AS hr FROM rsi),
    no AS MATERIALIZED (SELECT *, {', '.join(f"coalesce(sum(CAST({f} AS INT)) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_{f}" for f in ('lc', 'lr', 'hc', 'hr'))} FROM piv)"""


def _div_sql(c: str, r: str, a: str, b: str) -> str:
    """j is among the last five pivots of both kinds before i."""
    return f"(SELECT DISTINCT i.symbol, i.bar FROM no i JOIN no j ON i.symbol = j.symbol AND j.bar < i.bar WHERE i.bar >= 5 AND i.{c} AND i.{r} AND j.{c} AND j.{r} AND i.n_{c} - j.n_{c} <= 5 AND i.n_{r} - j.n_{r} <= 5 AND i.close {a} j.close AND i.rsi {b} j.rsi)"


_plan("hidden_divergence", lambda g: dict(zip(("bull", "bear"), g.hidden_divergence(), strict=True)), _DIV, f"SELECT b.symbol, b.bar, u.bar IS NOT NULL AS bull, d.bar IS NOT NULL AS bear FROM bars b LEFT JOIN {_div_sql('lc', 'lr', '>', '<')} u USING (symbol, bar) LEFT JOIN {_div_sql('hc', 'hr', '<', '>')} d USING (symbol, bar)", "bull, bear", kinds="plain")
_CENTRE = "lr AS (SELECT *, ln(close / nullif(" + lag("close") + ", 0)) AS log_return FROM bars)"
_plan(
    "hpdr_bands", lambda g: {k.replace(".", "_"): v for k, v in g.range_bands(100, (1.0,)).items()}, _CENTRE,
    f"SELECT symbol, bar, {full('close', 100, f'quantile_cont(close, 0.5) {over(100)}')} AS center, {sma('log_return', 100)} AS mu_return, {std('log_return', 100)} AS sigma_return, {full('close', 100, f'quantile_cont(close, 0.8413447460685429) {over(100)}')} AS upper_1_0, {full('close', 100, f'quantile_cont(close, 0.15865525393145707) {over(100)}')} AS lower_1_0 FROM lr",
    "center, mu_return, sigma_return, upper_1_0, lower_1_0",
)
_plan("returns_pct", lambda g: {"r": g.column("r", (), lambda: W.pct_change("close"))}, "", f"SELECT symbol, bar, close / nullif({lag('close')}, 0) - 1 AS r FROM bars", "r", 6)
_plan("log_returns", lambda g: {"r": g.column("r", (), lambda: W.log_return("close"))}, "", f"SELECT symbol, bar, ln(close / nullif({lag('close')}, 0)) AS r FROM bars", "r", 6)
_plan("drawdown", lambda g: {"dd": g.column("dd", (), lambda: W.drawdown("close")), "dd_pct": g.column("dd_pct", (), lambda: W.drawdown_pct("close"))}, "", f"SELECT symbol, bar, close - max(close) {over()} AS dd, (close - max(close) {over()}) / nullif(max(close) {over()}, 0) * 100 AS dd_pct FROM bars", "dd, dd_pct")
_plan("best_so_far", lambda g: {"best": g.column("best", (), lambda: W.best_so_far("close"))}, "", f"SELECT symbol, bar, max(close) {over()} AS best FROM bars", "best")
_plan("normalised_curve", lambda g: {"v": g.column("v", (), lambda: W.normalised("close"))}, "", "SELECT symbol, bar, close / nullif(first(close) OVER (PARTITION BY symbol ORDER BY bar), 0) * 100 AS v FROM bars", "v", bars=B.by_priority, base=B.PRIORITY_SQL)

# folds

_plan("ema", lambda g: {"v12": g.ema("close", 12), "v26": g.ema("close", 26)}, ewm("f", "bars", {"v12": ("close", ema_alpha(12)), "v26": ("close", ema_alpha(26))}), "SELECT * FROM f", "v12, v26")
_plan("ema_sym", lambda g: {"v12": g.ema("close", 12)}, ewm("f", "bars", {"v12": ("close", ema_alpha(12))}), "SELECT * FROM f", "v12", bars=B.by_priority, base=B.PRIORITY_SQL)
_plan("rma", lambda g: {"v14": g.rma("close", 14)}, ewm("f", "bars", {"v14": ("close", 1 / 14)}), "SELECT * FROM f", "v14")
_plan("ma_dispatch", lambda g: {k: g.ma("close", 9, k.upper()) for k in ("sma", "ema", "rma")}, ewm("f", "bars", {"ema": ("close", ema_alpha(9)), "rma": ("close", 1 / 9)}), f"SELECT symbol, bar, s.v AS sma, ema, rma FROM f JOIN (SELECT symbol, bar, {sma('close', 9)} AS v FROM bars) s USING (symbol, bar)", "sma, ema, rma")
_plan("pamrp_ema", lambda g: {"pamrp": g.pamrp(20, 200, "ema")}, ewm("f", "bars", {"m": ("close", ema_alpha(20))}) + ", pm AS MATERIALIZED (SELECT symbol, bar, close / nullif(m, 0) AS x FROM f JOIN bars USING (symbol, bar))", f"SELECT symbol, bar, {rank_of('x', 200)} AS pamrp FROM pm", "pamrp")
_plan("atr", lambda g: {"atr": g.atr(14)}, RANGE_SQL + ", " + ewm("f", "rng", {"atr": ("tr", 1 / 14)}), "SELECT * FROM f", "atr")
_STOCH = _RSI + f", st AS (SELECT symbol, bar, CASE WHEN count(rsi) {over(14)} = 14 THEN (rsi - min(rsi) {over(14)}) / nullif(max(rsi) {over(14)} - min(rsi) {over(14)}, 0) * 100 END AS raw FROM rsi), k AS (SELECT symbol, bar, {sma('raw', 3)} AS k FROM st)"
_plan("stoch_rsi", lambda g: dict(zip(("k", "d"), g.stoch_rsi(14, 14, 3, 3), strict=True)), _STOCH, f"SELECT symbol, bar, k, {sma('k', 3)} AS d FROM k", "k, d")
_MACD = ewm("f", "bars", {"a": ("close", ema_alpha(12)), "b": ("close", ema_alpha(26))}) + ", ml AS MATERIALIZED (SELECT symbol, bar, a - b AS line FROM f), " + ewm("sg", "ml", {"sig": ("line", ema_alpha(9))})
_plan("macd", lambda g: dict(zip(("line", "sig", "hist"), g.macd(12, 26, 9), strict=True)), _MACD, "SELECT symbol, bar, line, sig, line - sig AS hist FROM ml JOIN sg USING (symbol, bar)", "line, sig, hist")
_ADX = RANGE_SQL + ", " + ewm("f", "moves", {"a": ("tr", 1 / 14), "p": ("plus_dm", 1 / 14), "m": ("minus_dm", 1 / 14)}) + ", di AS MATERIALIZED (SELECT symbol, bar, p / nullif(a, 0) * 100 AS pdi, m / nullif(a, 0) * 100 AS mdi FROM f), dx AS MATERIALIZED (SELECT *, coalesce(abs(pdi - mdi) / nullif(pdi + mdi, 0) * 100, 0.0) AS dx FROM di), " + ewm("ad", "dx", {"adx": ("dx", 1 / 14)})
_plan("adx", lambda g: dict(zip(("pdi", "mdi", "adx"), g.adx(14, 14), strict=True)), _ADX, "SELECT symbol, bar, pdi, mdi, adx FROM dx JOIN ad USING (symbol, bar)", "pdi, mdi, adx")
_SUPER = RANGE_SQL + ", " + ewm("f", "rng", {"a": ("tr", 1 / 10)}) + """, band AS MATERIALIZED (SELECT b.symbol, b.bar, b.close, (high + low) / 2 + 3.0 * a AS up, (high + low) / 2 - 3.0 * a AS dn FROM bars b JOIN f USING (symbol, bar)),
    turn AS (SELECT symbol, bar, up AS line, -1.0 AS dir FROM band WHERE bar = 0
        UNION ALL SELECT symbol, bar, CASE WHEN now > 0 THEN CASE WHEN was > 0 AND dn < line THEN line ELSE dn END ELSE CASE WHEN was < 0 AND up > line THEN line ELSE up END END, now
        FROM (SELECT s.symbol, s.bar, s.up, s.dn, p.line, p.dir AS was, CASE WHEN s.close > p.line THEN 1.0 WHEN s.close < p.line THEN -1.0 ELSE p.dir END AS now
              FROM turn p JOIN band s ON s.symbol = p.symbol AND s.bar = p.bar + 1))"""
_plan("supertrend", lambda g: dict(zip(("line", "dir"), g.supertrend(10, 3.0), strict=True)), _SUPER, "SELECT symbol, bar, line, CAST(dir AS DOUBLE) AS dir FROM turn", "line, dir")


@query(f"WITH RECURSIVE {B.DAILY_SQL}, {_SUPER} SELECT symbol, bar, CASE WHEN dir > 0 THEN round(line, 4) END AS rising, CASE WHEN dir < 0 THEN round(line, 4) END AS falling FROM turn")
def supertrend_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Plan()
    line, way = g.supertrend(10, 3.0)
    b = g.apply(B.daily(spark, sf_dir))
    return rounded(b.select("symbol", "bar", F.when(F.col(way) > 0, F.col(line)).alias("rising"), F.when(F.col(way) < 0, F.col(line)).alias("falling")), 4)


@query(f"""WITH {B.PRIORITY_SQL}, d AS (SELECT *, close - max(close) {over()} AS dd FROM bars), s AS (SELECT *, sum(CAST(dd >= 0 AS INT)) {over()} AS spell FROM d)
    SELECT symbol, max(n) AS longest FROM (SELECT symbol, spell, count(*) FILTER (dd < 0) AS n FROM s GROUP BY symbol, spell) GROUP BY symbol""")
def longest_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.by_priority(spark, sf_dir).withColumn("dd", W.drawdown("close")).withColumn("spell", F.sum((F.col("dd") >= 0).cast("int")).over(W.so_far()))
    return d.groupBy("symbol", "spell").agg(F.count_if(F.col("dd") < 0).alias("n")).groupBy("symbol").agg(F.max("n").alias("longest"))


@query(f"""WITH {B.DAILY_SQL} SELECT symbol, round(min(low) * 0.95, 4) AS bottom, round(max(high) * 1.05, 4) AS top, count(*) AS n, round(arg_min(close, ts), 4) AS first_close, round(arg_max(close, ts), 4) AS last_close FROM bars GROUP BY symbol""")
def price_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.daily(spark, sf_dir).groupBy("symbol").agg((F.min("low") * 0.95).alias("bottom"), (F.max("high") * 1.05).alias("top"), F.count("*").alias("n"), F.min_by("close", "ts").alias("first_close"), F.max_by("close", "ts").alias("last_close")), 4)


@query(f"WITH {B.DAILY_SQL} SELECT bar, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(close, 4) AS close FROM bars WHERE ts >= (SELECT max(ts) FROM bars) - INTERVAL 3 MONTH")
def chart_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.daily(spark, sf_dir)
    end = b.agg(F.max("ts").alias("_end"))
    return rounded(b.crossJoin(end).where(F.col("ts") >= F.col("_end") - F.expr("INTERVAL 3 MONTH")).select("bar", "ts", "close"), 4)


# signals of every spec, on daily bars

_SIGNALS: dict[str, tuple[dict, str, str]] = {
    "pamrp_entry": ({"pamrp_entry_lookback": 100}, f"pm AS MATERIALIZED (SELECT symbol, bar, close / nullif({sma('close', 20)}, 0) AS x FROM bars), r AS (SELECT symbol, bar, {rank_of('x', 100)} AS v FROM pm)", "SELECT symbol, bar, v < 20 AS l, v > 80 AS s FROM r"),
    "bbwp_entry": ({"bbwp_ma_filter": "decreasing"}, _BBWP + f", m AS (SELECT *, {sma('bbwp', 5)} AS a FROM rk), q AS (SELECT *, {lag('a')} AS b FROM m)", "SELECT symbol, bar, bbwp < 50 AND a < b AS l, bbwp > 50 AND a < b AS s FROM q"),
    "adx_entry": ({"adx_require_di": True, "adx_threshold": 10}, _ADX, "SELECT symbol, bar, adx > 10 AND pdi > mdi AS l, adx > 10 AND pdi < mdi AS s FROM dx JOIN ad USING (symbol, bar)"),
    "ma_trend": ({}, f"m AS (SELECT symbol, bar, {sma('close', 50)} AS a, {sma('close', 200)} AS b FROM bars)", "SELECT symbol, bar, a > b AS l, a < b AS s FROM m"),
    "rsi_entry": ({"rsi_oversold": 48, "rsi_overbought": 52}, _RSI, "SELECT symbol, bar, rsi < 48 AS l, rsi > 52 AS s FROM rsi"),
    "volume_entry": ({"volume_multiplier": 1.2}, f"m AS (SELECT symbol, bar, volume, {sma('volume', 20)} AS a FROM bars)", "SELECT symbol, bar, volume > a * 1.2 AS l, volume > a * 1.2 AS s FROM m"),
    "supertrend_entry": ({}, _SUPER, "SELECT symbol, bar, dir > 0 AS l, dir < 0 AS s FROM turn"),
    "macd_entry": ({"macd_mode": "crossover"}, _MACD, "SELECT symbol, bar, line > sig AS l, line < sig AS s FROM ml JOIN sg USING (symbol, bar)"),
    "stoch_rsi_entry": ({}, _STOCH, "SELECT symbol, bar, k < 20 AS l, k > 80 AS s FROM k"),
    "pamrp_exit": ({"pamrp_exit_lookback": 100}, f"pm AS MATERIALIZED (SELECT symbol, bar, close / nullif({sma('close', 20)}, 0) AS x FROM bars), r AS (SELECT symbol, bar, {rank_of('x', 100)} AS v FROM pm)", "SELECT symbol, bar, v > 70 AS l, v < 30 AS s FROM r"),
    "stoch_rsi_exit": ({}, _STOCH, "SELECT symbol, bar, k > 80 AS l, k < 20 AS s FROM k"),
    "ma_exit": ({}, ewm("f", "bars", {"a": ("close", ema_alpha(10)), "b": ("close", ema_alpha(20))}), "SELECT symbol, bar, a < b AS l, a > b AS s FROM f"),
    "bbwp_exit": ({}, _BBWP, "SELECT symbol, bar, bbwp > 80 AS l, bbwp < 20 AS s FROM rk"),
    "adx_exit": ({"adx_exit_threshold": 10}, _ADX, "SELECT symbol, bar, adx < 10 AS l, adx < 10 AS s FROM ad"),
    "macd_exit": ({"macd_exit_mode": "zero-line"}, _MACD, "SELECT symbol, bar, line < 0 AS l, line > 0 AS s FROM ml"),
    "rsi_exit": ({}, _RSI, "SELECT symbol, bar, rsi > 50 AS l, rsi < 50 AS s FROM rsi"),
    "supertrend_exit": ({}, _SUPER, "SELECT symbol, bar, dir < 0 AS l, dir > 0 AS s FROM turn"),
    "volume_exit": ({}, f"m AS (SELECT symbol, bar, volume, {sma('volume', 20)} AS a FROM bars)", "SELECT symbol, bar, volume < a AS l, volume < a AS s FROM m"),
}


def _spec_signal(key: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = {**P.defaults(), **_SIGNALS[key][0]}
        s, plan = specs.get(key), Plan()
        columns = s.compute(plan, p)
        b = plan.apply(B.daily(spark, sf_dir))
        return b.select("symbol", "bar", signals.sure(s.long(p, columns)).alias("go_long"), signals.sure(s.short(p, columns)).alias("go_short"))

    return run


for _key, (_, _ctes, _select) in _SIGNALS.items():
    register(f"sig_{_key}", _spec_signal(_key), f"WITH RECURSIVE {B.DAILY_SQL}, {_ctes} SELECT symbol, bar, coalesce(l, false) AS go_long, coalesce(s, false) AS go_short FROM ({_select})")

# composition

_MASKS = f"masks AS (SELECT symbol, bar, close, open, coalesce({sma('close', 5)} > {sma('close', 20)}, false) AS a, coalesce(volume > {sma('volume', 20)}, false) AS b FROM bars)"


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Plan()
    fast, slow, vol = g.sma("close", 5), g.sma("close", 20), g.sma("volume", 20)
    return g.apply(B.daily(spark, sf_dir)).select("symbol", "bar", (F.col(fast) > F.col(slow)).alias("a"), (F.col("volume") > F.col(vol)).alias("b"))


@query(f"WITH {B.DAILY_SQL}, {_MASKS} SELECT symbol, bar, a AND NOT coalesce({lag('a')}, false) AS fired FROM masks")
def edge_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masks(spark, sf_dir).select("symbol", "bar", signals.edge(F.col("a")).alias("fired"))


def _combined(operator: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: _masks(s, d).select("symbol", "bar", signals.combine([F.col("a"), F.col("b")], operator).alias("both"), signals.combine([], operator).alias("none"))


for _op in ("and", "or"):
    register(f"combine_{_op}", _combined(_op), f"WITH {B.DAILY_SQL}, {_MASKS} SELECT symbol, bar, a {_op} b AS both, false AS none FROM masks")

_OFF = {"pamrp_enabled": False, "bbwp_enabled": False, "pamrp_exit_enabled": False}
_COMPOSE = {**_OFF, "trade_direction": "both", "ma_trend_enabled": True, "ma_fast_length": 5, "ma_slow_length": 20, "volume_enabled": True, "volume_signal_mode": "filter", "rsi_exit_enabled": True, "ma_exit_enabled": True, "ma_exit_fast": 3, "ma_exit_slow": 10, "ma_exit_type": "sma"}
_ENTRY = f"en AS (SELECT symbol, bar, coalesce({sma('close', 5)} > {sma('close', 20)}, false) AS l, coalesce({sma('close', 5)} < {sma('close', 20)}, false) AS s, coalesce(volume > {sma('volume', 20)}, false) AS v, coalesce({sma('close', 3)} < {sma('close', 10)}, false) AS xl, coalesce({sma('close', 3)} > {sma('close', 10)}, false) AS xs FROM bars)"


def _composed(columns: tuple[str, ...], **more) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: signals.with_signals(B.daily(spark, d), P.make(**{**_COMPOSE, **more})).select("symbol", "bar", *columns)


def _edge_sql(x: str) -> str:
    return f"({x} AND NOT coalesce({lag(x)}, false))"


register("entry_composed", _composed(("entry_long", "entry_short")), f"WITH {B.DAILY_SQL}, {_ENTRY} SELECT symbol, bar, {_edge_sql('l')} AND v AS entry_long, {_edge_sql('s')} AND v AS entry_short FROM en")
register("role_override", _composed(("entry_long", "entry_short"), volume_signal_mode="trigger", ma_trend_signal_mode="filter"), f"WITH {B.DAILY_SQL}, {_ENTRY} SELECT symbol, bar, {_edge_sql('v')} AND l AS entry_long, {_edge_sql('v')} AND s AS entry_short FROM en")
for _op in ("or", "and"):
    register(f"exit_composed_{_op}", _composed(("exit_long_signal", "exit_short_signal"), exit_operator=_op), f"WITH RECURSIVE {B.DAILY_SQL}, {_RSI}, {_ENTRY} SELECT symbol, bar, xl {_op} coalesce(rsi > 50, false) AS exit_long_signal, xs {_op} coalesce(rsi < 50, false) AS exit_short_signal FROM en JOIN rsi USING (symbol, bar)")


@query(f"""WITH {B.PRIORITY_SQL}, s AS (SELECT symbol, bar, ts, CAST(close > {lag('close')} AS INT) AS w FROM bars), i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) - row_number() OVER (PARTITION BY symbol, w ORDER BY bar) AS isl FROM s WHERE w IS NOT NULL),
    r AS (SELECT symbol, w, isl, count(*) AS n FROM i GROUP BY ALL) SELECT symbol, max(n) FILTER (w = 1) AS max_up, max(n) FILTER (w = 0) AS max_down FROM r GROUP BY symbol""")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.by_priority(spark, sf_dir).withColumn("w", (F.col("close") > W.previous("close")).cast("int")).where("w IS NOT NULL")
    s = s.withColumn("isl", F.row_number().over(W.bars()) - F.row_number().over(Window.partitionBy("symbol", "w").orderBy("bar")))
    r = s.groupBy("symbol", "w", "isl").agg(F.count("*").alias("n"))
    return r.groupBy("symbol").agg(F.max(F.when(F.col("w") == 1, F.col("n"))).alias("max_up"), F.max(F.when(F.col("w") == 0, F.col("n"))).alias("max_down"))


