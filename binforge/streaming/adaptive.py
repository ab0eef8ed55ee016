"""Adaptive fixed-width histograms: a bin is an unbounded integer key on each axis, so axes grow with the data.

Tables of them add up by key, in 1-D (bin, left, right) and N-D (binI, leftI, rightI). Width and shift of each axis stand in the
metadata of its bin column; of tables without, they are read off the edges.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binforge.functions import meta
from binforge.functions.binning import MOST_BINS
from binforge.operators.infer import present


def _value(x: Column, width: float, shift: float) -> Column:
    """The bin of a value; one too far out for a whole number is refused."""
    k = F.floor((x - shift) / width)
    far = F.abs((x - shift) / width) > 9e15
    return F.when(far, F.raise_error(F.lit("a value is too far from the others for bins of this width")).cast("long")).otherwise(k.cast("long"))


def _edges(s: str, width: float, shift: float) -> list[Column]:
    k = F.col(f"bin{s}")
    return [k, (k * F.lit(float(width)) + F.lit(float(shift))).alias(f"left{s}"), ((k + 1) * F.lit(float(width)) + F.lit(float(shift))).alias(f"right{s}")]


def _told(hist: DataFrame, rules: Sequence[tuple[float, float]], names: Sequence[str | None]) -> DataFrame:
    return meta.described(hist, [meta.of_width(w, s, n) for (w, s), n in zip(rules, names)])


def _counted(df: DataFrame, cols: Sequence[str], axes: Sequence[str], rules: Sequence[tuple[float, float]], weights: str | None) -> DataFrame:
    if any(w <= 0 for w, _ in rules):
        raise ValueError("a positive width is needed")
    w = F.col(weights).cast("double") if weights else None
    sums = [F.count("*").alias("frequency"), F.count("*").cast("double").alias("error2")] if w is None else [F.sum(w).alias("frequency"), F.sum(w * w).alias("error2")]
    keys = [_value(F.col(c).cast("double"), *r).alias(f"bin{s}") for c, s, r in zip(cols, axes, rules)]
    got = present(df, *cols).groupBy(*keys).agg(*sums)
    return _told(got.select(*(e for s, r in zip(axes, rules) for e in _edges(s, *r)), "frequency", "error2"), rules, cols)


def adaptive(df: DataFrame, col: str, width: float, shift: float = 0.0, weights: str | None = None) -> DataFrame:
    """bin, left, right, frequency of a batch or a stream (complete or update mode; the state is a row per bin).

    With weights, also error2, the sum of their squares.
    """
    got = _counted(df, [col], [""], [(width, shift)], weights)
    return got if weights else got.drop("error2")


def adaptive_nd(df: DataFrame, cols: Sequence[str], widths: Sequence[float], weights: str | None = None, shifts: Sequence[float] | None = None, errors: bool = False) -> DataFrame:
    """binI, leftI, rightI for each axis, frequency: an N-D histogram whose axes all grow with the data; error2 with weights or where asked for."""
    shifts = list(shifts or [0.0] * len(cols))
    if not len(cols) == len(widths) == len(shifts):
        raise ValueError(f"{len(widths)} widths and {len(shifts)} shifts for {len(cols)} axes")
    got = _counted(df, cols, [str(i) for i in range(len(cols))], list(zip(widths, shifts)), weights)
    return got if weights or errors else got.drop("error2")


def rules_of(hist: DataFrame) -> list[tuple[float, float]]:
    """(width, shift) of each axis: from metadata, else from the edges of one row, which all others must agree with (one job)."""
    told = meta.axes_of(hist)
    if all(a and "width" in a for a in told):
        return [(a["width"], a["shift"]) for a in told]
    axes = meta.suffixes(hist)
    width = lambda s: F.col(f"right{s}") - F.col(f"left{s}")
    rule = lambda s: F.struct(width(s).alias("w"), (F.col(f"left{s}") - F.col(f"bin{s}") * width(s)).alias("s"))
    # of the bin nearest to zero, where rounding is least
    facts = hist.agg(*(v for s in axes for v in (F.min_by(rule(s), F.abs(F.col(f"bin{s}"))).alias(f"r{s}"), F.min(rule(s)).alias(f"a{s}"), F.max(rule(s)).alias(f"b{s}")))).first()
    if facts[f"r{axes[0]}"] is None:
        raise ValueError("an empty table doesn't tell its width; begin with adaptive()")
    out = [(facts[f"r{s}"]["w"], facts[f"r{s}"]["s"]) for s in axes]
    if not all(_near((facts[f"{k}{s}"]["w"], facts[f"{k}{s}"]["s"]), r) for s, r in zip(axes, out) for k in "ab"):
        raise ValueError("an adaptive histogram has one width and shift")
    return out


def _near(a: tuple[float, float], b: tuple[float, float]) -> bool:
    return abs(a[0] - b[0]) <= 1e-9 * abs(b[0]) and abs(a[1] - b[1]) <= 1e-6 * abs(b[0])


def _summed(parts: Sequence[DataFrame], rules: Sequence[tuple[float, float]]) -> DataFrame:
    """The parts' frequencies and errors by key, with edges by rule."""
    axes = meta.suffixes(parts[0])
    names = [a.get("name") if a else None for a in meta.axes_of(parts[0])]
    sums = ["frequency", *(["error2"] if any("error2" in p.columns for p in parts) else [])]
    # where a part has no weights, its frequencies are their own errors
    parts = [p if "error2" in p.columns or len(sums) == 1 else p.withColumn("error2", F.col("frequency").cast("double")) for p in parts]
    keys = [f"bin{s}" for s in axes]
    both = reduce(DataFrame.unionByName, (p.select(*keys, *sums) for p in parts)).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))
    return _told(both.select(*(e for s, r in zip(axes, rules) for e in _edges(s, *r)), *sums), rules, names)


def merge(*parts: DataFrame) -> DataFrame:
    """Adaptive histograms of any number of axes added up by key; ValueError unless they have one width and shift on each."""
    if len({tuple(meta.suffixes(p)) for p in parts}) > 1:
        raise ValueError("the histograms have different numbers of axes")
    told = [rules_of(p) for p in parts]
    if not all(_near(a, b) for rules in told for a, b in zip(rules, told[0])):
        raise ValueError("adaptive histograms need one width and shift to be put together")
    return _summed(parts, told[0])


def fill(hist: DataFrame, df: DataFrame, *cols: str, weights: str | None = None) -> DataFrame:
    """An adaptive histogram with a batch's values added; its axes grow where they need to."""
    axes, rules = meta.suffixes(hist), rules_of(hist)
    if len(cols) != len(axes):
        raise ValueError(f"{len(cols)} columns for {len(axes)} axes")
    more = _counted(df, cols, axes, rules, weights)
    return _summed([hist, more if weights or "error2" in hist.columns else more.drop("error2")], rules)


def fill_gaps(hist: DataFrame) -> DataFrame:
    """An adaptive histogram with the empty bins between its first and last on each axis."""
    axes, rules = meta.suffixes(hist), rules_of(hist)
    keys = [f"bin{s}" for s in axes]
    ends = hist.agg(*(f(k).alias(f"{n}_{k}") for k in keys for n, f in (("lo", F.min), ("hi", F.max))))
    count = reduce(lambda p, k: p * (F.col(f"hi_{k}") - F.col(f"lo_{k}") + 1).cast("double"), keys, F.lit(1.0))
    many = F.when(count > MOST_BINS, F.raise_error(F.lit(f"more than {MOST_BINS} bins between the first and the last")).cast("long"))
    grid = ends.where(F.col(f"lo_{keys[0]}").isNotNull())
    for n, k in enumerate(keys):
        grid = grid.withColumn(k, F.explode(F.sequence(F.coalesce(many, f"lo_{k}") if n == 0 else F.col(f"lo_{k}"), f"hi_{k}")))
    sums = [c for c in ("frequency", "error2") if c in hist.columns]
    full = grid.select(*keys).join(hist.select(*keys, *sums), keys, "left")
    filled = [F.coalesce(c, F.lit(0).cast(hist.schema[c].dataType)).alias(c) for c in sums]
    return _told(full.select(*(e for s, r in zip(axes, rules) for e in _edges(s, *r)), *filled), rules, [a.get("name") if a else None for a in meta.axes_of(hist)])
