"""Window functions over a symbol's bars. Windows are full: fewer than n values, or a null inside, give NULL."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F



def bars(by: str = "symbol") -> WindowSpec:
    """A symbol's bars in order (specs are made when used: they need a session)."""
    return Window.partitionBy(by).orderBy("bar")


def so_far() -> WindowSpec:
    return bars().rowsBetween(Window.unboundedPreceding, 0)


def whole() -> WindowSpec:
    return bars().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


Name = str | Column


def _c(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def last(n: int):
    return bars().rowsBetween(1 - n, 0)


def full(x: Name, n: int, value: Column) -> Column:
    return F.when(F.count(_c(x)).over(last(n)) == n, value)


def ratio(a: Column, b: Column) -> Column:
    """NULL where ``b`` is 0."""
    return a / F.nullif(b, F.lit(0.0))


def previous(x: Name, k: int = 1) -> Column:
    return F.lag(_c(x), k).over(bars())


def sma(x: Name, n: int) -> Column:
    return full(x, n, F.avg(_c(x)).over(last(n)))


def wma(x: Name, n: int) -> Column:
    """Linear weights, the newest the heaviest."""
    values = F.collect_list(_c(x)).over(last(n))
    total = F.aggregate(F.transform(values, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return full(x, n, total / (n * (n + 1) / 2))


def vwma(x: Name, volume: Name, n: int) -> Column:
    both = _c(x) * _c(volume)
    return full(both, n, ratio(F.sum(both).over(last(n)), F.sum(_c(volume)).over(last(n))))


def rolling_std(x: Name, n: int) -> Column:
    return full(x, n, F.stddev_samp(_c(x)).over(last(n)))


def percentile_rank(x: Name, lookback: int) -> Column:
    """Rank in percent of the value among the ``lookback`` before it; ties count half, see the mean-rank rule."""
    v = _c(x)
    earlier = F.collect_list(v).over(bars().rowsBetween(-lookback, -1))
    less = F.size(F.filter(earlier, lambda e: e < v))
    upto = F.size(F.filter(earlier, lambda e: e <= v))
    rank = (less + upto + (upto > less).cast("int")) * F.lit(50.0) / lookback
    return F.when(F.count(v).over(bars().rowsBetween(-lookback, 0)) == lookback + 1, rank)


def band_width(x: Name, n: int, mult: float = 2.0) -> Column:
    return ratio(2 * mult * rolling_std(x, n), sma(x, n)) * 100


def true_range() -> Column:
    before = previous("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def vwap() -> Column:
    """Cumulative within the calendar date."""
    day = Window.partitionBy("symbol", F.to_date("ts")).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return ratio(F.sum(typical * F.col("volume")).over(day), F.sum("volume").over(day))


def pivot(x: Name, left: int, right: int, low: bool) -> Column:
    """True where the value is the extreme of ``left`` bars before to ``right`` after; edges False."""
    around = bars().rowsBetween(-left, right)
    extreme = (F.min if low else F.max)(_c(x)).over(around)
    return F.coalesce((F.count(_c(x)).over(around) == left + right + 1) & (_c(x) == extreme), F.lit(False))


def pct_change(x: Name) -> Column:
    return ratio(_c(x), previous(x)) - 1


def log_return(x: Name) -> Column:
    return F.ln(ratio(_c(x), previous(x)))


def drawdown(x: Name) -> Column:
    return _c(x) - F.max(_c(x)).over(so_far())


def drawdown_pct(x: Name) -> Column:
    peak = F.max(_c(x)).over(so_far())
    return ratio(_c(x) - peak, peak) * 100


def best_so_far(x: Name) -> Column:
    return F.max(_c(x)).over(so_far())


def normalised(x: Name, base: float = 100.0) -> Column:
    return ratio(_c(x), F.first(_c(x)).over(whole())) * base


def compounded(x: Name) -> Column:
    """Running product of (1 + x) - 1."""
    return F.exp(F.sum(F.log1p(_c(x))).over(so_far())) - 1


def range_bands(close: Name, lookback: int = 252, z: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0, 2.5)) -> dict[str, Column]:
    """Rolling quantiles of the price at the normal probabilities of -z and z; its median; mean and std of log returns.

    The log return must be a column named ``log_return`` (windows don't nest).
    """
    x, w = _c(close), last(lookback)
    out = {"mu_return": sma("log_return", lookback), "sigma_return": rolling_std("log_return", lookback)}
    return out | {name: full(x, lookback, F.percentile(x, share).over(w)) for name, share in band_shares(z).items()}


def band_shares(z: tuple[float, ...]) -> dict[str, float]:
    """The share of prices below the median and each band."""
    return {"center": 0.5} | {f"{name}_{s:.1f}": NormalDist().cdf(sign * s) for s in z for sign, name in ((1, "upper"), (-1, "lower"))}
