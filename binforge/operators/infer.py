"""Bins inferred from data: one aggregate job for all axes, the rest on its one row."""

from __future__ import annotations

import builtins
import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from binforge.functions import binning as B

from .quantile import quantiles

COUNTS = ("default", "sqrt", "sturges", "rice", "doane")


def numeric(df: DataFrame, *cols: str) -> None:
    """ValueError unless the columns hold numbers, known from the schema alone."""
    for c in cols:
        kind = df.select(c).schema[0].dataType
        if not isinstance(kind, (NumericType, BooleanType)):
            raise ValueError(f"column {c} is of {kind.simpleString()}, not a number")


def present(df: DataFrame, *cols: str) -> DataFrame:
    """Rows with a value in each column."""
    return df.where(reduce(lambda p, q: p & q, (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols)))


def without_missing(df: DataFrame, cols: list[str], dropna: bool) -> DataFrame:
    """Rows with all values; with dropna off, ValueError where one is missing."""
    d = present(df, *cols)
    if not dropna and df.where(~reduce(lambda p, q: p & q, (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols))).limit(1).count():
        raise ValueError("bins can't be found in presence of missing values")
    return d


#: name: function of (df, column, **options) that gives a Binning.
REGISTRY: dict[str, Callable[..., B.Binning]] = {}


def register_binning(name: str):
    """Makes a function of (df, column, **options) known as bins="name"."""

    def put(f):
        REGISTRY[name] = f
        return f

    return put


def infer(df: DataFrame, col: str, bins=10, **options) -> B.Binning:
    """The binning that `bins` names: a Binning, a count, a method's name, edges or pairs, or a function of (df, col).

    options: range, bin_count, bin_width, q, qrange, kind ("time"), min_bin_width, max_bin_width, align, most_bins ("knuth").
    """
    return infer_all(df, [col], [bins], [options])[0]


def infer_all(df: DataFrame, cols: Sequence[str], bins: Sequence, options: Sequence[dict]) -> list[B.Binning]:
    """A binning for each column, over rows that have all of them; what they need of the data comes from one job."""
    numeric(df, *cols)
    d = present(df, *cols)
    needs, aggs = [], []
    for k, (c, b, how) in enumerate(zip(cols, bins, options)):
        need = _needs(F.col(c).cast("double"), b, **how)
        needs.append(list(need))
        aggs += [v.alias(f"{n}_{k}") for n, v in need.items()]
    row = d.agg(*aggs).first().asDict() if aggs else {}
    return [_finish(d, c, b, {n: row[f"{n}_{k}"] for n in names}, **how) for k, (c, b, names, how) in enumerate(zip(cols, bins, needs, options))]


def _needs(x: Column, bins, *, range=None, **_) -> dict[str, Column]:
    """The aggregates over the data that a binning is made of."""
    named = isinstance(bins, str) and bins not in ("quantile", "blocks") and bins not in REGISTRY
    if not named and not isinstance(bins, int):
        return {}
    if range:
        x = F.when(x.between(*map(float, range)), x)
    out = {"lo": F.min(x), "hi": F.max(x), "n": F.count(x)}
    if bins == "doane":
        out["skew"] = F.skewness(x)
    if bins == "scott":
        out["sd"] = F.stddev_pop(x)
    return out


def _finish(d: DataFrame, col: str, bins, m: dict, *, range=None, bin_count: int | None = None, bin_width: float = 1.0, q=None, qrange=(0.0, 1.0), kind: str | None = None, min_bin_width: float | None = None, max_bin_width: float | None = None, align: bool = True, most_bins: int | None = None, **more) -> B.Binning:
    if isinstance(bins, B.Binning):
        return bins
    if bins == "blocks":
        from . import blocks  # noqa: F401  registers itself
    if isinstance(bins, str) and bins in REGISTRY:
        given = dict(range=range, bin_count=bin_count, most_bins=most_bins, **more)
        return REGISTRY[bins](d, col, **{k: v for k, v in given.items() if v is not None})
    if more:
        raise ValueError(f"unknown options {sorted(more)}")
    if callable(bins):
        return bins(d, col)
    if not isinstance(bins, (int, str)):
        return B.static(bins)
    x = F.col(col).cast("double")
    if range:
        d = d.where(x.between(*map(float, range)))
    if bins == "quantile":
        if (q is None) == (bin_count is None):
            raise ValueError("quantile bins need either a count or the quantiles")
        at = q or [qrange[0] + (qrange[1] - qrange[0]) * i / bin_count for i in builtins.range(bin_count + 1)]
        return B.from_edges(quantiles(d, col, at))
    if not m["n"] and not range:
        raise ValueError("bins can't be inferred from no values")
    lo, hi = map(float, range) if range else (m["lo"], m["hi"])
    if isinstance(bins, int):
        return B.equal_width(lo, hi, bins)
    if bins == "numpy":
        return B.equal_width(lo, hi, bin_count or 10)
    if bins in COUNTS:
        return B.equal_width(lo, hi, B.ideal_bin_count(m["n"], bins, m["skew"] or 0.0 if bins == "doane" else 0.0))
    if bins == "fixed_width":
        return B.fixed_width(lo, hi, bin_width, align, closed=bool(range))
    if bins == "integer":
        return B.fixed_width(lo, hi, bin_width, shift=0.5 * bin_width - int(0.5 * bin_width) if bin_width != 1 else 0.5)
    if bins in ("pretty", "human"):
        nice = B.pretty_time_width if kind == "time" else B.pretty_width
        width = nice((hi - lo) / (bin_count or B.ideal_bin_count(m["n"])))
        return B.fixed_width(lo, hi, min(max(width, min_bin_width or width), max_bin_width or math.inf))
    if bins == "knuth":
        return B.equal_width(lo, hi, knuth_count(d, col, lo, hi, m["n"], most_bins))
    if bins == "exponential":
        return B.exponential(lo, hi, bin_count or B.ideal_bin_count(m["n"]))
    if bins == "scott":
        return B.fixed_width(lo, hi, 3.5 * m["sd"] * m["n"] ** (-1 / 3), align=False)
    if bins == "freedman":
        a, b = quantiles(d, col, [0.25, 0.75])
        return B.fixed_width(lo, hi, 2 * (b - a) * m["n"] ** (-1 / 3), align=False)
    raise ValueError(f"unknown binning {bins}")


#: Counts of bins that one pass over the values tries where all up to a bound are.
TRIED = 300


def knuth_count(df: DataFrame, col: str, lo: float, hi: float, n: int, most: int | None = None) -> int:
    """The count of equal bins with the highest posterior by Knuth's rule; with `most`, of the counts from 1 to it, all of which are tried.

    Without it, first counts that rise by an eighth are tried, as far as the posterior still rises at the upper end;
    then every count around the best. A pass counts the occupied bins of all its candidates
    with map-side sums; what reaches the driver is how often each frequency occurs.
    """
    known: dict[int, float] = {}
    if most is not None:
        if most < 1:
            raise ValueError("at least one bin is needed")
        for low in builtins.range(1, most + 1, TRIED):
            known |= _posteriors(df, col, lo, hi, n, list(builtins.range(low, min(low + TRIED, most + 1))))
        return max(known, key=lambda m: (known[m], -m))
    top = 1024
    counts = _rising(1, top)
    while True:
        known |= _posteriors(df, col, lo, hi, n, counts)
        best = max(known, key=lambda m: (known[m], -m))
        if best <= top // 2 or top >= B.MOST_BINS:
            break
        counts, top = _rising(top + 1, top * 8), top * 8
    while True:  # all between the tried neighbours of the best, at most 64 at once
        tried = sorted(known)
        k = tried.index(best)
        low, high = tried[max(k - 1, 0)], tried[min(k + 1, len(tried) - 1)]
        counts = [m for m in builtins.range(low + 1, high) if m not in known]
        if not counts:
            return best
        known |= _posteriors(df, col, lo, hi, n, counts[:: -(-len(counts) // 64)])
        best = max(known, key=lambda m: (known[m], -m))


def _rising(low: int, top: int) -> list[int]:
    out = [low]
    while out[-1] < top:
        out.append(min(top, max(out[-1] + 1, out[-1] * 9 // 8)))
    return out


def _posteriors(df: DataFrame, col: str, lo: float, hi: float, n: int, counts: list[int]) -> dict[int, float]:
    x = F.col(col).cast("double")
    values = df.where(x.between(lo, hi)).groupBy(x.alias("x")).agg(F.count("*").alias("rows"))  # equal values once for all counts
    fine = values.select("x", "rows", F.explode(F.array(*map(F.lit, counts))).alias("m"))
    at = F.least(F.floor((F.col("x") - lo) / (hi - lo) * F.col("m")), F.col("m") - 1)
    held = fine.groupBy("m", at.alias("k")).agg(F.sum("rows").alias("count")).groupBy("m", "count").agg(F.count("*").alias("times")).collect()
    logs = {m: n * math.log(m) + math.lgamma(m / 2) - m * math.lgamma(0.5) - math.lgamma(n + m / 2) for m in counts}
    empty = dict.fromkeys(counts, 0)
    for r in held:
        logs[r["m"]] += r["times"] * math.lgamma(r["count"] + 0.5)
        empty[r["m"]] += r["times"]
    return {m: logs[m] + (m - empty[m]) * math.lgamma(0.5) for m in counts}
