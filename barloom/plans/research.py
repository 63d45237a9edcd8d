"""Queries on calendars, folds, simulation and permutation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import stats as S
from barloom.operators import calendars as C
from barloom.operators import engine, search
from barloom.operators import simulate as M
from barloom.operators import params as P
from barloom.plans.backtests import _METRICS, _STOPPED, BASE, _events, engine_sql
from barloom.plans.catalogue import lag, over, query, register, rounded
from barloom.plans.series import _ADX
from barloom.sources import bars as B


def _returns_sql(unit: str = "day", base: str = B.DAILY_SQL, name: str = "rets") -> str:
    """CTE of (symbol, ts, r, tpy) from last closes per unit."""
    return f"""{base}, lasts AS (SELECT symbol, date_trunc('{unit}', ts)::TIMESTAMP AS ts, arg_max(close, ts) AS close FROM bars GROUP BY ALL),
    raw AS (SELECT symbol, ts, (close / nullif({lag('close', order='ts')}, 0) - 1) * 100 AS r FROM lasts),
    {name} AS MATERIALIZED (SELECT *, CASE WHEN max(isodow(ts)) OVER (PARTITION BY symbol) >= 6 THEN 365 ELSE 252 END AS tpy FROM raw WHERE r IS NOT NULL)"""


_N, _K = "count(r)", "count(*) FILTER (r > 0)"
_SCORE = "(({k} * 1.0 / {n}) + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n}) {sign} 1.96 * sqrt(({k} * 1.0 / {n}) * (1 - {k} * 1.0 / {n}) / {n} + 3.8416 / (4.0 * {n} * {n})) / (1 + 3.8416 / {n})"
_LOW = f"greatest(0.0, ({_SCORE.format(k=_K, n=_N, sign='-')}) * 100)"
_HIGH = f"least(100.0, ({_SCORE.format(k=_K, n=_N, sign='+')}) * 100)"


def _bucket_sql(bucket: str, source: str = "rets", tpy: str = "max(tpy)") -> str:
    sd, dsd = "coalesce(stddev_samp(r), 0.0)", "stddev_samp(r) FILTER (r < 0)"
    values = {
        "mean": "avg(r)", "median": "median(r)", "std": sd, "win_rate": f"{_K} * 100.0 / {_N}", "ci_low": _LOW, "ci_high": _HIGH, "avg_pos": "coalesce(avg(r) FILTER (r > 0), 0.0)", "avg_neg": "coalesce(avg(r) FILTER (r <= 0), 0.0)",
        "best": "max(r)", "worst": "min(r)", "total": "sum(r)", "sharpe": f"CASE WHEN {sd} > 1e-9 THEN avg(r) / {sd} * sqrt({tpy}) ELSE 0.0 END",
        "sortino": f"CASE WHEN coalesce({dsd}, 0.0) > 1e-9 THEN avg(r) / {dsd} * sqrt({tpy}) ELSE 0.0 END", "t_stat": f"CASE WHEN {_N} > 1 AND {sd} > 0 THEN avg(r) / {sd} * sqrt({_N}) ELSE 0.0 END",
    }
    return f"SELECT symbol, CAST({bucket} AS BIGINT) AS bucket, {_N} AS n, " + ", ".join(f"round({v}, 4) + 0.0 AS {k}" for k, v in values.items()) + f" FROM {source} GROUP BY symbol, {bucket}"


def _bucket(name: str, make: Callable[..., DataFrame], sql: str, bars: Callable = B.by_priority) -> None:
    register(name, lambda s, d: rounded(make(bars(s, d), p_values=False), 4), sql)


_bucket("cal_dow", C.day_of_week, f"WITH {_returns_sql(base=B.PRIORITY_SQL)} {_bucket_sql('isodow(ts) - 1')}")
_bucket("cal_month", C.by_month, f"WITH {_returns_sql('month', B.PRIORITY_SQL)} {_bucket_sql('month(ts)', tpy='12')}")
_bucket("cal_quarter", C.by_quarter, f"WITH {_returns_sql(base=B.PRIORITY_SQL)} {_bucket_sql('quarter(ts)')}")
_bucket("cal_dom", C.day_of_month, f"WITH {_returns_sql(base=B.DAILY_SQL)} {_bucket_sql('day(ts)')}", B.daily)
_bucket("cal_hour", C.by_hour, f"WITH {_returns_sql('hour', B.HOURLY_SQL)} {_bucket_sql('hour(ts)')}", B.hourly)


#: Two-sided p of Student's t: its density over x = sqrt(v) tan(a) is a power of cos(a), summed by Simpson's rule from a0 to pi / 2.
_T_TAIL = """(SELECT 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(pi()) * (pi() / 2 - a0) / 3000 * sum(CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(greatest(cos(a0 + (pi() / 2 - a0) * i / 1000), 0.0), v - 1))
    FROM range(1001) AS steps(i))"""
_DOW_P = f"""WITH {_returns_sql()}, b AS (SELECT symbol, isodow(ts) - 1 AS bucket, {_N} AS n, CASE WHEN {_N} > 1 AND stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt({_N}) ELSE 0.0 END AS t FROM rets GROUP BY symbol, isodow(ts)),
    a AS (SELECT *, n - 1.0 AS v, atan(abs(t) / sqrt(n - 1.0)) AS a0 FROM b), p AS (SELECT *, {_T_TAIL} AS p FROM a)
    SELECT symbol, CAST(bucket AS BIGINT) AS bucket, n, round(t, 6) + 0.0 AS t_stat, round(p, 6) + 0.0 AS p_value, CASE WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM p"""


@query(_DOW_P)
def cal_dow_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With p-values and stars; the incomplete beta function here, an integral in the SQL."""
    return rounded(C.day_of_week(B.daily(spark, sf_dir)).select("symbol", "bucket", "n", "t_stat", "p_value", "stars"), 6)


_KW = f"""WITH {_returns_sql()}, g AS (SELECT *, isodow(ts) AS g FROM rets), k AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM g) WHERE m >= 3),
    rk AS (SELECT *, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY r) AS t FROM k),
    e AS (SELECT g, count(*) AS n, sum(rank) AS rs, sum(t * t - 1) AS tie FROM rk GROUP BY g), a AS (SELECT count(*) AS groups, sum(n) AS n, sum(rs * rs / n) AS s, sum(tie) AS tie FROM e)
    SELECT groups, CAST(n AS BIGINT) AS n, round((12.0 / (n * (n + 1.0)) * s - 3 * (n + 1)) / (1 - tie / (n * 1.0 * n * n - n)), 6) AS h FROM a"""


@query(_KW)
def cal_kruskal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.kruskal(C.returns(B.daily(spark, sf_dir)), F.weekday("ts")).select("groups", "n", "h"))


def _heat(name: str, make: Callable, a: str, b: str, unit: str = "day", bars: Callable = B.daily, base: str = B.DAILY_SQL) -> None:
    register(name, lambda s, d: rounded(make(bars(s, d))), f"WITH {_returns_sql(unit, base)} SELECT symbol, CAST({a} AS BIGINT) AS a, CAST({b} AS BIGINT) AS b, round(avg(r), 6) AS mean, count(*) AS n FROM rets GROUP BY symbol, {a}, {b}")


_heat("cal_month_heatmap", C.month_heatmap, "year(ts)", "month(ts)", "month")
_heat("cal_year_dow", C.year_by_weekday, "year(ts)", "isodow(ts) - 1")
_heat("cal_dow_hour", C.weekday_by_hour, "isodow(ts) - 1", "hour(ts)", "hour", B.hourly, B.HOURLY_SQL)


@query(f"""WITH {_returns_sql(base=B.PRIORITY_SQL)}, c AS (SELECT *, exp(sum(ln(1 + r / 100)) OVER w) AS c FROM rets WINDOW w AS (PARTITION BY symbol, year(ts) ORDER BY ts ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT *, max(c) OVER (PARTITION BY symbol, year(ts) ORDER BY ts ROWS UNBOUNDED PRECEDING) AS p FROM c)
    SELECT symbol, year(ts) AS year, count(r) AS n, round((arg_max(c, ts) - 1) * 100, 4) AS total_return, round(avg(r), 4) AS mean, round(stddev_samp(r), 4) AS std, round({_K} * 100.0 / {_N}, 4) AS win_rate, round({_LOW}, 4) AS ci_low, round({_HIGH}, 4) AS ci_high,
        round(min((c - p) / p) * 100, 4) AS max_drawdown, round(avg(r) / stddev_samp(r) * sqrt(max(tpy)), 4) AS sharpe, round(CASE WHEN coalesce(stddev_samp(r) FILTER (r < 0), 0.0) > 1e-9 THEN avg(r) / stddev_samp(r) FILTER (r < 0) * sqrt(max(tpy)) ELSE 0.0 END, 4) AS sortino
    FROM p GROUP BY symbol, year(ts) HAVING count(r) >= 2""")
def cal_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.by_year(B.by_priority(spark, sf_dir)), 4)


@query(f"""WITH {_returns_sql(base=B.PRIORITY_SQL)}, cut AS (SELECT symbol, quantile_cont(r, 0.05) AS v95, quantile_cont(r, 0.01) AS v99 FROM rets GROUP BY symbol),
    m AS (SELECT symbol, count(r) AS n, avg(r) AS mean FROM rets GROUP BY symbol), mo AS (SELECT symbol, n, avg((r - mean) ^ 2) AS m2, avg((r - mean) ^ 3) AS m3, avg((r - mean) ^ 4) AS m4 FROM rets JOIN m USING (symbol) GROUP BY ALL),
    g AS (SELECT symbol, n, m3 / m2 ^ 1.5 AS g1, m4 / m2 ^ 2 - 3 AS g2 FROM mo)
    SELECT symbol, g.n, round(avg(r), 4) AS mean, round(stddev_samp(r), 4) AS std, round(max(g1 * sqrt(g.n * (g.n - 1.0)) / (g.n - 2)), 4) AS skew, round(max((g.n - 1.0) / ((g.n - 2.0) * (g.n - 3)) * ((g.n + 1) * g2 + 6)), 4) AS kurtosis, round({_K} * 100.0 / {_N}, 4) AS pct_positive,
        round(max(v95), 4) AS var_95, round(max(v99), 4) AS var_99, round(avg(r) FILTER (r <= v95), 4) AS cvar_95 FROM rets JOIN cut USING (symbol) JOIN g USING (symbol) GROUP BY symbol, g.n""")
def cal_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.distribution(B.by_priority(spark, sf_dir)).drop("jarque_bera", "jarque_bera_p"), 4)


@query(f"""WITH {_returns_sql(base=B.PRIORITY_SQL)}, m AS (SELECT symbol, avg(r) AS mean FROM rets GROUP BY symbol), mo AS (SELECT symbol, count(*) AS n, avg((r - mean) ^ 2) AS m2, avg((r - mean) ^ 3) AS m3, avg((r - mean) ^ 4) AS m4 FROM rets JOIN m USING (symbol) GROUP BY symbol)
    SELECT symbol, n, round(n / 6.0 * ((m3 / m2 ^ 1.5) ^ 2 + (m4 / m2 ^ 2 - 3) ^ 2 / 4), 2) AS jarque_bera, round(exp(-n / 12.0 * ((m3 / m2 ^ 1.5) ^ 2 + (m4 / m2 ^ 2 - 3) ^ 2 / 4)), 6) AS jarque_bera_p FROM mo""")
def cal_jarque_bera(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C.distribution(B.by_priority(spark, sf_dir))
    return d.select("symbol", "n", F.round("jarque_bera", 2).alias("jarque_bera"), F.round("jarque_bera_p", 6).alias("jarque_bera_p"))


@query(f"""WITH {_returns_sql()}, sp AS (SELECT symbol, min(r) AS a, (max(r) - min(r)) / 40 AS w FROM rets GROUP BY symbol), b AS (SELECT symbol, least(CAST(floor((r - a) / w) AS BIGINT), 39) AS bin, a, w FROM rets JOIN sp USING (symbol))
    SELECT symbol, bin, round(min(a + bin * w), 4) AS "left", round(min(a + (bin + 1) * w), 4) AS "right", count(*) AS n FROM b GROUP BY symbol, bin""")
def cal_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.histogram(C.returns(B.daily(spark, sf_dir)), "r", 40), 4)


@query(f"""WITH {_returns_sql(base=B.PRIORITY_SQL)}, s AS (SELECT symbol, ts, r > 0 AS w FROM rets), i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - row_number() OVER (PARTITION BY symbol, w ORDER BY ts) AS isl FROM s),
    u AS (SELECT symbol, w, isl, count(*) AS n, max(ts) AS e FROM i GROUP BY ALL)
    SELECT symbol, coalesce(max(n) FILTER (w), 0) AS max_win, coalesce(max(n) FILTER (NOT w), 0) AS max_loss, round(coalesce(avg(n) FILTER (w), 0.0), 6) AS avg_win, round(coalesce(avg(n) FILTER (NOT w), 0.0), 6) AS avg_loss, arg_max(CASE WHEN w THEN n ELSE -n END, e) AS current FROM u GROUP BY symbol""")
def cal_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.streaks(C.returns(B.by_priority(spark, sf_dir))))


_ACF = f"""WITH {_returns_sql(base=B.PRIORITY_SQL)}, d AS (SELECT symbol, ts, r - avg(r) OVER (PARTITION BY symbol) AS d FROM rets), l AS (SELECT *, {', '.join(f"d * {lag('d', k, order='ts')} AS p{k}" for k in range(1, 11))} FROM d),
    s AS (SELECT symbol, count(*) AS n, sum(d * d) AS v, {', '.join(f'sum(p{k}) / sum(d * d) AS a{k}' for k in range(1, 11))} FROM l GROUP BY symbol HAVING count(*) >= 20)"""


@query(_ACF + ", u AS (" + " UNION ALL ".join(f"SELECT symbol, n, {k} AS lag, a{k} AS acf FROM s" for k in range(1, 11)) + ") SELECT symbol, n, CAST(lag AS BIGINT) AS lag, round(acf, 6) + 0.0 AS acf, round(1.96 / sqrt(n), 6) AS band, abs(acf) > 1.96 / sqrt(n) AS flagged FROM u")
def cal_acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.autocorrelation(C.returns(B.by_priority(spark, sf_dir))))


_Q = "(n * (n + 2.0) * (" + " + ".join(f"a{k} * a{k} / (n - {k})" for k in range(1, 11)) + "))"
_TAIL = " + ".join("1.0" if i == 0 else f"pow(q / 2, {i}) / {[1, 1, 2, 6, 24][i]}.0" for i in range(5))


@query(f"{_ACF}, q AS (SELECT symbol, {_Q} AS q FROM s) SELECT symbol, round(q, 6) AS q, round(exp(-q / 2) * ({_TAIL}), 6) AS p FROM q")
def cal_ljung_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.ljung_box(C.autocorrelation(C.returns(B.by_priority(spark, sf_dir)))))


@query(f"""WITH {_returns_sql()}, b AS (SELECT symbol, isodow(ts) - 1 AS bucket, avg(r) AS mean, {_K} * 100.0 / {_N} AS w FROM rets GROUP BY ALL)
    SELECT symbol, arg_max(bucket, mean) AS best, round(max(mean), 6) AS best_mean, round(arg_max(w, mean), 6) AS best_win_rate, round(max(mean) * 252, 4) AS best_year, arg_min(bucket, mean) AS worst, round(min(mean), 6) AS worst_mean, round(arg_min(w, mean), 6) AS worst_win_rate, round(min(mean) * 252, 4) AS worst_year FROM b GROUP BY symbol""")
def cal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.summary(C.day_of_week(B.daily(spark, sf_dir), p_values=False), F.lit(252))
    return rounded(s).withColumns({c: F.round(c, 4) for c in ("best_year", "worst_year")})


_MONTHS = f"WITH {_returns_sql(base=B.PRIORITY_SQL)}, t AS (SELECT symbol, CAST(month(ts) AS BIGINT) AS month, {_K} AS k, {_N} AS n FROM rets GROUP BY ALL)"


@query(f"{_MONTHS} SELECT symbol, month, k, n, round(greatest(0.0, ({_SCORE.format(k='k', n='n', sign='-')}) * 100), 6) AS low, round(least(100.0, ({_SCORE.format(k='k', n='n', sign='+')}) * 100), 6) AS high FROM t")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the share of days with a gain, by month."""
    r = C.returns(B.by_priority(spark, sf_dir))
    t = r.groupBy("symbol", F.month("ts").cast("long").alias("month")).agg(F.count_if(F.col("r") > 0).alias("k"), F.count("r").alias("n"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return rounded(t.select("symbol", "month", "k", "n", low.alias("low"), high.alias("high")))


@query(f"""WITH {_returns_sql(base=B.PRIORITY_SQL)}, e AS (SELECT symbol, ts, cume_dist() OVER (PARTITION BY symbol ORDER BY round(abs(r), 9) DESC) AS p FROM rets)
    SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(p, 9) AS p, CASE WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars, CASE WHEN p < 0.01 THEN 'p<0.01' WHEN p < 0.05 THEN 'p<0.05' WHEN p < 0.10 THEN 'p<0.10' ELSE 'none' END AS badge FROM e""")
def significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each day's move: the share of the symbol's days that moved as much or more."""
    r = C.returns(B.by_priority(spark, sf_dir))
    p = F.cume_dist().over(Window.partitionBy("symbol").orderBy(F.desc(F.round(F.abs("r"), 9))))
    return rounded(r.select("symbol", "ts", p.alias("p")).select("symbol", "ts", "p", S.stars(F.col("p")).alias("stars"), S.badge(F.col("p")).alias("badge")), 9)


# folds


@query(f"""WITH {B.DAILY_SQL}, n AS (SELECT count(*) AS n FROM bars) SELECT 'train' AS part, bar, round(close, 4) AS close FROM bars, n WHERE bar < floor(n * 0.7) UNION ALL SELECT 'test', bar - CAST(floor(n * 0.7) AS BIGINT), round(close, 4) FROM bars, n WHERE bar >= floor(n * 0.7)""")
def split_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = search.split(B.daily(spark, sf_dir), 0.7)
    return rounded(a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("test"))).select("part", "bar", "close"), 4)


def _fold_sql(start: str) -> str:
    return f"""WITH {B.PRIORITY_SQL}, n AS (SELECT symbol, count(*) AS n, count(*) // 5 AS size FROM bars GROUP BY symbol), k AS (SELECT symbol, n, size, fold, fold * size AS edge FROM n, (SELECT unnest(range(1, 5)) AS fold)),
        w AS (SELECT symbol, fold, 'train' AS part, {start} AS a, edge AS b FROM k UNION ALL SELECT symbol, fold, 'test', edge, least(edge + size, n) FROM k)
        SELECT symbol, CAST(fold AS BIGINT) AS fold, part, count(*) AS n, round(sum(close), 2) AS total, CAST(min(bar - a) AS BIGINT) AS first_bar FROM bars JOIN w USING (symbol) WHERE bar >= a AND bar < b GROUP BY symbol, fold, part"""


def _folds(anchored: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: rounded(search.fold_table(B.by_priority(s, d), 5, anchored).groupBy("symbol", "fold", "part").agg(F.count("*").alias("n"), F.sum("close").alias("total"), F.min("bar").alias("first_bar")), 2)


register("fold_windows_rolling", _folds(False), _fold_sql("greatest(0, edge - CAST(floor(n * 0.7) AS BIGINT))"))
register("fold_windows_anchored", _folds(True), _fold_sql("0"))


@query(f"""WITH {B.PRIORITY_SQL}, f AS (SELECT symbol, bar // 400 AS fold, ts, bar % 400 AS bar, close AS v FROM bars), e AS (SELECT symbol, fold, arg_min(v, bar) AS a, arg_max(v, bar) AS b FROM f GROUP BY ALL),
    c AS (SELECT *, coalesce(exp(sum(ln(b / a)) OVER (PARTITION BY symbol ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0) * 10000 AS base FROM e)
    SELECT symbol, fold, bar, round(v / a * base, 2) AS equity FROM f JOIN c USING (symbol, fold)""")
def stitch_oos(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.by_priority(spark, sf_dir)
    e = b.select("symbol", F.floor(F.col("bar") / 400).alias("fold"), "ts", (F.col("bar") % 400).alias("bar"), F.col("close").alias("mtm_equity"))
    return rounded(search.stitch(e, engine.CAPITAL).select("symbol", "fold", "bar", "equity"), 2)


def _fold_parts(start: str = "greatest(0, edge - CAST(floor(n * 0.7) AS BIGINT))") -> str:
    """CTE ``f``: mean close, highest close and mean range of every fold's parts."""
    return f"""WITH {B.PRIORITY_SQL}, n AS (SELECT symbol, count(*) AS n, count(*) // 5 AS size FROM bars GROUP BY symbol), k AS (SELECT symbol, n, size, fold, fold * size AS edge FROM n, (SELECT unnest(range(1, 5)) AS fold)),
        w AS (SELECT symbol, fold, 'train' AS part, {start} AS a, edge AS b FROM k UNION ALL SELECT symbol, fold, 'test', edge, least(edge + size, n) FROM k),
        f AS (SELECT symbol, CAST(fold AS BIGINT) AS fold, part, avg(close) AS mean_close, max(close) AS top_close, avg((high - low) / close) AS reach FROM bars JOIN w USING (symbol) WHERE bar >= a AND bar < b GROUP BY symbol, fold, part)"""


def _fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    reach = F.avg((F.col("high") - F.col("low")) / F.col("close"))
    return search.fold_table(B.by_priority(spark, sf_dir), 5).groupBy("symbol", "fold", "part").agg(F.avg("close").alias("mean_close"), F.max("close").alias("top_close"), reach.alias("reach"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, fold, train_value, test_value): mean ranges of a fold's parts."""
    return _fitted(spark, sf_dir).groupBy("symbol", F.col("fold").cast("long").alias("fold")).agg(*[F.max(F.when(F.col("part") == x, F.col("reach"))).alias(f"{x}_value") for x in ("train", "test")])


_SCORED = "s AS (SELECT symbol, fold, max(reach) FILTER (part = 'train') AS train, max(reach) FILTER (part = 'test') AS test FROM f GROUP BY symbol, fold)"


@query(f"""{_fold_parts()}, v AS (UNPIVOT (SELECT symbol, fold, mean_close, top_close FROM f WHERE part = 'train') ON mean_close, top_close INTO NAME param VALUE v)
    SELECT symbol, param, round_even(stddev_pop(v) / abs(avg(v)), 4) AS cv FROM v GROUP BY symbol, param HAVING count(*) >= 2""")
def param_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what is fitted on the folds' train parts: the mean and the highest close."""
    fits = _fitted(spark, sf_dir).where("part = 'train'").unpivot(["symbol", "fold"], ["mean_close", "top_close"], "param", "value")
    return search.stability(fits, ("symbol", "param"))


@query(f"{_fold_parts()}, {_SCORED} SELECT symbol, round(avg(test) / avg(train), 6) AS efficiency FROM s GROUP BY symbol")
def efficiency_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.efficiency(_scored(spark, sf_dir)))


@query(f"{_fold_parts()}, {_SCORED} SELECT symbol, fold, round((train - test) / train * 100, 4) + 0.0 AS loss FROM s")
def degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(spark, sf_dir).select("symbol", "fold", search.degradation(F.col("train_value"), F.col("test_value")).alias("loss")), 4)


# simulation

_N_SIMS = 60
_LOG = f"WITH RECURSIVE {engine_sql(_STOPPED)}, tl AS MATERIALIZED (SELECT symbol, trade_no, pnl FROM log), sims AS (SELECT unnest(range({_N_SIMS})) AS sim_id)"
_SHUFFLE = f"{_LOG}, st AS (SELECT symbol, sim_id, row_number() OVER (PARTITION BY symbol, sim_id ORDER BY md5('42:' || sim_id || ':' || trade_no), trade_no) AS step, pnl AS change FROM tl, sims), paths AS MATERIALIZED (SELECT *, 10000.0 + sum(change) {over(by='symbol, sim_id', order='step')} AS equity FROM st)"
_PER_SIM = f"pk AS (SELECT *, greatest(max(equity) {over(by='symbol, sim_id', order='step')}, 10000.0) AS peak FROM paths), ps AS (SELECT symbol, sim_id, arg_max(equity, step) AS final, least(min((equity - peak) / CASE WHEN peak > 0 THEN peak ELSE 1.0 END * 100), 0.0) AS dd, least(min(equity), 10000.0) <= 5000 AS ruined FROM pk GROUP BY ALL)"


def _shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.trade_shuffle(_events(spark, sf_dir, bars=B.daily)[1], _N_SIMS)


@query(f"{_SHUFFLE}, {_PER_SIM} SELECT symbol, sim_id, round(final, 2) AS final, round(dd, 4) AS max_drawdown_pct, ruined FROM ps")
def mc_trade_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = M.per_simulation(_shuffled(spark, sf_dir), engine.CAPITAL)
    return p.select("symbol", "sim_id", F.round("final", 2).alias("final"), F.round("max_drawdown_pct", 4).alias("max_drawdown_pct"), "ruined")


@query(f"{_SHUFFLE} SELECT symbol, step, {', '.join(f'round(quantile_cont(equity, {q / 100}), 3) AS p{q}' for q in M.BANDS)} FROM paths GROUP BY symbol, step")
def mc_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.bands(_shuffled(spark, sf_dir)), 3)


@query(f"{_SHUFFLE}, {_PER_SIM} SELECT symbol, count(*) AS n, round(avg(CAST(ruined AS INT)), 6) AS risk_of_ruin, {', '.join(f'round(quantile_cont(dd, {q / 100}), 4) AS drawdown_p{q}' for q in (5, 50, 95))} FROM ps GROUP BY symbol")
def mc_ruin(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.summary(M.per_simulation(_shuffled(spark, sf_dir), engine.CAPITAL))
    return s.select("symbol", "n", F.round("risk_of_ruin", 6).alias("risk_of_ruin"), *[F.round(f"drawdown_p{q}", 4).alias(f"drawdown_p{q}") for q in (5, 50, 95)])


_U = "((CAST('0x' || left(md5({key}), 12) AS BIGINT) + 0.5) / 281474976710656.0)"
_BOOT = f"""WITH RECURSIVE {engine_sql(_STOPPED)}, sims AS (SELECT unnest(range({_N_SIMS})) AS sim_id), rr AS (SELECT symbol, bar, mtm / nullif({lag('mtm')}, 0) - 1 AS r FROM equity), r AS MATERIALIZED (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1 AS i, r FROM rr WHERE r IS NOT NULL),
    sz AS (SELECT symbol, count(*) AS n, CASE WHEN count(*) < 10 THEN 1 ELSE 5 END AS b FROM r GROUP BY symbol), bl AS (SELECT symbol, n, b, sim_id, unnest(range((n - 1) // b + 1)) AS block FROM sz, sims),
    s0 AS (SELECT *, CAST(floor({_U.format(key="'42:' || sim_id || ':' || block")} * (n - b + 1)) AS BIGINT) AS start FROM bl), s1 AS (SELECT symbol, n, b, sim_id, block, start, unnest(range(b)) AS k FROM s0),
    st AS (SELECT symbol, sim_id, block * b + k + 1 AS step, start + k AS i FROM s1 WHERE block * b + k + 1 <= n),
    f AS (SELECT s.symbol, sim_id, product(1 + r) AS g, stddev_pop(r) AS sd, avg(r) AS m FROM st s JOIN r USING (symbol, i) GROUP BY ALL)"""


@query(f"{_BOOT} SELECT symbol, sim_id, round(g, 6) AS growth, round(m / sd * sqrt(252), 4) AS sharpe FROM f")
def mc_block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, bars=B.daily)[2]
    p = M.per_simulation(M.block_bootstrap(e, _N_SIMS), engine.CAPITAL, per_year=252)
    return p.select("symbol", "sim_id", F.round(F.col("final") / engine.CAPITAL, 6).alias("growth"), F.round("sharpe", 4).alias("sharpe"))


@query(f"""{_LOG}, md AS (SELECT symbol, median(abs(pnl)) AS m FROM tl WHERE pnl <> 0 GROUP BY symbol), sz AS (SELECT symbol, trade_no, pnl, CASE WHEN pnl <> 0 THEN abs(pnl) ELSE coalesce(m, 1.0) END AS size FROM tl LEFT JOIN md USING (symbol)),
    st AS (SELECT symbol, sim_id, pnl + sqrt(-2 * ln({_U.format(key="'42:a:' || sim_id || ':' || trade_no")})) * cos(2 * pi() * {_U.format(key="'42:b:' || sim_id || ':' || trade_no")}) * size * 0.2 AS change FROM sz, sims)
    SELECT symbol, sim_id, round(10000 + sum(change), 2) AS final FROM st GROUP BY symbol, sim_id""")
def mc_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = M.per_simulation(M.noise(_events(spark, sf_dir, bars=B.daily)[1], _N_SIMS), engine.CAPITAL)
    return p.select("symbol", "sim_id", F.round("final", 2).alias("final"))


@query(f"""{_SHUFFLE}, {_PER_SIM}, sp AS (SELECT symbol, min(dd) AS a, (max(dd) - min(dd)) / 30 AS w FROM ps GROUP BY symbol), b AS (SELECT symbol, least(CAST(floor((dd - a) / w) AS BIGINT), 29) AS bin FROM ps JOIN sp USING (symbol)) SELECT symbol, bin, count(*) AS n FROM b GROUP BY symbol, bin""")
def mc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.histogram(M.per_simulation(_shuffled(spark, sf_dir), engine.CAPITAL), "max_drawdown_pct", 30).select("symbol", "bin", "n")


@query(f"""WITH {B.DAILY_SQL}, r AS (SELECT symbol, bar, close / nullif({lag('close')}, 0) - 1 AS r FROM bars), p AS (SELECT unnest(range(3)) AS perm_id), sh AS (SELECT symbol, perm_id, row_number() OVER (PARTITION BY symbol, perm_id ORDER BY md5('42:' || perm_id || ':' || bar), bar) AS k, r FROM r, p WHERE r IS NOT NULL),
    j AS (SELECT b.*, p.perm_id, coalesce(sh.r, 0.0) AS r FROM bars b CROSS JOIN p LEFT JOIN sh ON sh.symbol = b.symbol AND sh.perm_id = p.perm_id AND sh.k = b.bar),
    n AS (SELECT *, first(close) OVER (PARTITION BY perm_id ORDER BY bar) * exp(sum(ln(1 + r)) OVER (PARTITION BY perm_id ORDER BY bar ROWS UNBOUNDED PRECEDING)) AS nc FROM j)
    SELECT perm_id, bar, round(ln(nc), 8) AS close, round(ln(open * nc / close), 8) AS open, round(ln(greatest(high * nc / close, open * nc / close, nc)), 8) AS high, round(ln(least(low * nc / close, open * nc / close, nc)), 8) AS low, round(volume, 2) AS volume FROM n""")
def permute_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    # logarithms: prices grow to 1e11, where cents are beyond a double's digits
    logs = [F.ln(c).alias(c) for c in ("close", "open", "high", "low")]
    return rounded(M.permute_prices(B.daily(spark, sf_dir), 3).select("perm_id", "bar", *logs, "volume"), 8)


_RISK_ONLY = P.make(**{**BASE, "stop_loss_enabled": True, "stop_loss_pct_long": 20.0, "stop_loss_pct_short": 20.0})
_FILTERS = {"ma_trend_enabled": True, "ma_exit_enabled": True, "stop_loss_enabled": True}


#: Smaller than the defaults (100 permutations of 50 trials are 5,050 backtests); see the README.
PERMUTATIONS, TRIALS = 10, 20


@query()
def permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.permutation_test(B.daily(spark, sf_dir), _RISK_ONLY, _FILTERS, permutations=PERMUTATIONS, trials=TRIALS, batch=10)
    return rounded(M.p_value(found.scores), 6)


@query()
def optimize_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, parts = search.optimize(B.daily(spark, sf_dir), _RISK_ONLY, _FILTERS, trials=20, batch=10)
    return rounded(parts.select("symbol", "part", "num_trades", "profit_factor", "sharpe_ratio"), 6)


#: Only the stops are searched, in one batch that nothing was told before: 20 random sets.
_STOPS = {"ma_trend_enabled": True, "ma_exit_enabled": True, "stop_loss_enabled": True, "take_profit_enabled": True}
_STOPS_BASE = P.make(**{**BASE, "stop_loss_enabled": True, "take_profit_enabled": True})
_LIMITS = [f"{kind}_pct_{side}" for kind in ("stop_loss", "take_profit") for side in ("long", "short")]
_PINNED = {d.name: _STOPS_BASE[d.name] for d in search.dimensions(_STOPS) if d.name not in _LIMITS}
_DRAWN = search.Sampler(search.dimensions(_STOPS, _PINNED), 42).batch(20)


def _optimized_sql() -> str:
    """Every set over every part as a symbol of its own; the best of the train part is shown."""
    parts = "train AS (SELECT count(*) AS n FROM one), parts AS (SELECT unnest(['train', 'test', 'full']) AS part), ids AS (SELECT unnest(range(20)) AS id)"
    place = "CASE part WHEN 'test' THEN bar - CAST(floor(n * 0.7) AS BIGINT) ELSE bar END"
    bars = B.DAILY_SQL.replace("bars AS MATERIALIZED", "one AS MATERIALIZED") + f""", {parts}, bars AS MATERIALIZED (SELECT one.* REPLACE (id || '#' || part AS symbol, {place} AS bar) FROM one, train, parts, ids
        WHERE CASE part WHEN 'train' THEN bar < floor(n * 0.7) WHEN 'test' THEN bar >= floor(n * 0.7) ELSE true END)"""
    limits = {k: f"({[t[k] for t in _DRAWN]})[CAST(split_part(symbol, '#', 1) AS INT) + 1]" for k in _LIMITS}
    return f"""WITH RECURSIVE {engine_sql({**_STOPS_BASE, **limits}, bars=bars)}, {_METRICS}, r AS (SELECT CAST(split_part(symbol, '#', 1) AS INT) AS id, split_part(symbol, '#', 2) AS part, num_trades, profit_factor, sharpe FROM al),
        b AS (SELECT arg_max(id, (CASE WHEN num_trades >= 5 THEN sharpe ELSE -1e300 END, -id)) AS id FROM r WHERE part = 'train')
        SELECT 'ALL' AS symbol, part, num_trades, round(profit_factor, 4) AS profit_factor, round(sharpe, 4) AS sharpe_ratio FROM r JOIN b USING (id)"""


@query(_optimized_sql())
def optimize_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    study, parts = search.optimize(B.daily(spark, sf_dir), _STOPS_BASE, _STOPS, trials=20, batch=20, pinned=_PINNED)
    return rounded(parts.select("symbol", "part", "num_trades", "profit_factor", "sharpe_ratio"), 4)


_FOLDS, _TRIALS = 5, 50
#: The k-th fold's trials, all of them random.
_FOLD_SETS = {k: search.Sampler(search.dimensions(_STOPS, _PINNED), 42 + 7 * k).batch(_TRIALS) for k in range(1, _FOLDS)}


def _walked_sql() -> str:
    """Every fold's sets over its train and test windows, as symbols; the set that is best in training is tested."""
    base = B.DAILY_SQL.replace("bars AS MATERIALIZED", "one AS MATERIALIZED")
    windows = f"""w AS (SELECT count(*) AS n, count(*) // {_FOLDS} AS size FROM one), k AS (SELECT n, size, unnest(range(1, {_FOLDS})) AS fold FROM w),
        parts AS (SELECT fold, 'train' AS part, greatest(0, fold * size - CAST(floor(n * 0.7) AS BIGINT)) AS a, fold * size AS b FROM k UNION ALL SELECT fold, 'test', fold * size, least((fold + 1) * size, n) FROM k)"""
    bars = f"{base}, {windows}, bars AS MATERIALIZED (SELECT one.* REPLACE (id || '#' || fold || '#' || part AS symbol, bar - a AS bar) FROM one, parts, (SELECT unnest(range({_TRIALS})) AS id) WHERE bar >= a AND bar < b)"
    at = "(CAST(split_part(symbol, '#', 2) AS INT) - 1) * {} + CAST(split_part(symbol, '#', 1) AS INT) + 1".format(_TRIALS)
    limits = {x: f"({[t[x] for ts in _FOLD_SETS.values() for t in ts]})[{at}]" for x in _LIMITS}
    return f"""WITH RECURSIVE {engine_sql({**_STOPS_BASE, **limits}, bars=bars)}, {_METRICS},
        v AS (SELECT CAST(split_part(symbol, '#', 1) AS INT) AS id, CAST(split_part(symbol, '#', 2) AS BIGINT) AS fold, split_part(symbol, '#', 3) AS part, CASE WHEN num_trades >= 5 AND isfinite(sharpe) THEN sharpe ELSE CAST('-inf' AS DOUBLE) END AS value FROM al),
        best AS (SELECT fold, arg_max(id, (value, -id)) AS id, max(value) AS train_value FROM v WHERE part = 'train' AND isfinite(value) GROUP BY fold)
        SELECT 'ALL' AS symbol, b.fold, round(train_value, 4) AS train_value, round(coalesce(t.value, CAST('-inf' AS DOUBLE)), 4) AS test_value FROM best b LEFT JOIN v t ON t.fold = b.fold AND t.id = b.id AND t.part = 'test'"""


@query(_walked_sql())
def walk_forward_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.walk_forward(B.daily(spark, sf_dir), _STOPS_BASE, _STOPS, trials=200, folds=_FOLDS, batch=_TRIALS, pinned=_PINNED)["folds"], 4)


@query()
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.walk_forward(B.daily(spark, sf_dir), _RISK_ONLY, _FILTERS, trials=200, folds=5, batch=25)["folds"], 6)


_CHARACTER = f"""WITH RECURSIVE {B.PRIORITY_SQL}, {_ADX}, v AS (SELECT bars.symbol, bars.bar, close, a / nullif(close, 0) * 100 AS v, close / nullif({lag('close', by='bars.symbol', order='bars.bar')}, 0) - 1 AS r, adx, count(*) OVER (PARTITION BY bars.symbol) AS n
        FROM bars JOIN f USING (symbol, bar) JOIN ad USING (symbol, bar)),
    ends AS (SELECT symbol, arg_max(v, bar) AS atr_pct, arg_max(close, bar) AS close, arg_max(adx, bar) AS adx, max(n) AS n, stddev_samp(r) * sqrt(252) * 100 AS annual_vol, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252) AS sharpe,
        avg(close) FILTER (n - bar <= least(200, n // 2)) AS sma_long, avg(close) FILTER (n - bar <= least(50, n // 4)) AS sma_short FROM v GROUP BY symbol),
    rk AS (SELECT v.symbol, avg(CAST(v.v < e.atr_pct AS INT)) * 100 AS atr_rank FROM v JOIN ends e USING (symbol) GROUP BY v.symbol),
    o AS (SELECT *, (close / nullif(sma_long, 0) - 1) * 100 AS gap_pct FROM ends JOIN rk USING (symbol))
    SELECT symbol, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in ('atr_pct', 'close', 'adx', 'annual_vol', 'sharpe', 'atr_rank', 'sma_long', 'sma_short', 'gap_pct'))}, n,
        CASE WHEN atr_rank < 33 THEN 'low' WHEN atr_rank > 66 THEN 'high' ELSE 'medium' END AS volatility, CASE WHEN gap_pct > 0 THEN 'up' ELSE 'down' END AS trend,
        CASE WHEN abs(gap_pct) > 5 THEN 'strong' WHEN abs(gap_pct) > 2 THEN 'moderate' ELSE 'weak' END AS trend_strength, CASE WHEN adx < 20 THEN 'ranging' WHEN adx < 40 THEN 'trending' ELSE 'strong trend' END AS adx_regime FROM o"""


@query(_CHARACTER)
def market_characterization(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.session import characterize

    return rounded(characterize(B.by_priority(spark, sf_dir)), 4)


