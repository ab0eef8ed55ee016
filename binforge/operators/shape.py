"""Selections, merges and running sums of histogram tables (1-D: bin, left, right, frequency, error2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binforge.functions import meta

from .hist import _known_bins, assert_no_gap, running, with_total

_SUMS = ("frequency", "error2")


def _totals(hist: DataFrame) -> list[Column]:
    return [F.sum(c).alias(c) for c in _SUMS if c in hist.columns]


def _bounds(hist: DataFrame, start: int | None, stop: int | None, bin: str = "bin") -> tuple[int, int | None]:
    """start and stop from 0; negative ones are counted from the end, which takes a job."""
    start = start or 0
    if start < 0 or (stop is not None and stop < 0):
        n = (hist.agg(F.max(bin)).first()[0] or 0) + 1
        start, stop, _ = slice(start, stop).indices(n)
    return start, stop


def slice_bins(hist: DataFrame, start: int | None = 0, stop: int | None = None) -> DataFrame:
    """Bins start..stop-1, numbered from 0; negative bounds count from the end; see `dropped` for what falls outside."""
    start, stop = _bounds(hist, start, stop)
    d = hist.where(F.col("bin") >= start)
    d = d if stop is None else d.where(F.col("bin") < stop)
    return d.withColumn("bin", F.col("bin") - start)  # a new column: what was known of the axis goes


def dropped(hist: DataFrame, start: int | None = 0, stop: int | None = None) -> DataFrame:
    """underflow, overflow that slicing adds, in one row."""
    start, stop = _bounds(hist, start, stop)
    below = F.col("bin") < start
    above = F.lit(False) if stop is None else F.col("bin") >= stop
    return hist.agg(*(F.coalesce(F.sum(F.when(c, F.col("frequency"))), F.lit(0)).alias(n) for c, n in ((below, "underflow"), (above, "overflow"))))


def pick_bins(hist: DataFrame, keep: Column | Sequence[int]) -> DataFrame:
    """The bins of a mask or of a list of indices, numbered anew; gaps may remain between them."""
    d = hist.where(keep if isinstance(keep, Column) else F.col("bin").isin([int(k) for k in keep]))
    return d.withColumn("bin", F.row_number().over(Window.orderBy("left")).cast("long") - 1)


def select_axis(hist: DataFrame, axis: int, index: int | slice) -> DataFrame:
    """N-D: an index drops the axis, a slice keeps a part of it."""
    b = F.col(f"bin{axis}")
    if isinstance(index, slice):
        if index.step not in (None, 1):
            raise IndexError("the order of bins can't change")
        start, stop = _bounds(hist, index.start, index.stop, f"bin{axis}")
        d = hist.where(b >= start)
        d = d if stop is None else d.where(b < stop)
        return d.withColumn(f"bin{axis}", b - start)
    n = _known_bins(hist, axis) or (hist.agg(F.max(f"bin{axis}")).first()[0] or 0) + 1
    if not isinstance(index, int) or not -n <= index < n:
        raise IndexError(f"axis {axis} has bins 0 to {n - 1}")
    return hist.where(b == index % n).drop(f"bin{axis}", f"left{axis}", f"right{axis}")


def transpose(hist: DataFrame) -> DataFrame:
    """2-D: the axes change places."""
    swap = {f"{k}{i}": f"{k}{1 - i}" for k in ("bin", "left", "right") for i in (0, 1)}
    return hist.select(*(F.col(swap.get(c, c)).alias(c) for c in hist.columns))


def accumulate(hist: DataFrame, axis: int, n_axes: int) -> DataFrame:
    """Running sums of frequency along an axis; error2 stays."""
    rows, total = running(hist, F.col("frequency"), [f"bin{i}" for i in range(n_axes) if i != axis], f"bin{axis}", _known_bins(hist, axis))
    return rows.withColumn("_sum", total).select(*(F.col("_sum").alias(c) if c == "frequency" else F.col(c) for c in hist.columns))


def merge_axis(hist: DataFrame, axis: int, amount: int, n_axes: int) -> DataFrame:
    """N-D: every `amount` adjacent bins of an axis become one."""
    keys = [f"{k}{i}" for i in range(n_axes) if i != axis for k in ("bin", "left", "right")]
    merged = F.floor(F.col(f"bin{axis}") / amount).cast("long").alias(f"bin{axis}")
    got = hist.groupBy(*keys, merged).agg(F.min(f"left{axis}").alias(f"left{axis}"), F.max(f"right{axis}").alias(f"right{axis}"), *_totals(hist), assert_no_gap(hist, axis, str(axis)).alias("_whole"))
    return got.where(F.col("_whole").isNotNull()).drop("_whole")


def regroup(hist: DataFrame, groups: DataFrame, axis: int | None = None) -> DataFrame:
    """Bins put together by a map table (old, new) for an axis of any length, of 1-D tables or an axis of N-D ones.

    The map is joined, not collected. The job fails where a bin is left out or stands in two groups, where a group's bins are
    not neighbours, or where a gap lies within one. New numbers become 0, 1, ... in the order of the axis only if they are already.
    """
    s = "" if axis is None else str(axis)
    if f"bin{s}" not in hist.columns:
        raise ValueError(f"no axis {axis}")
    fails = lambda why, kind: F.raise_error(F.lit(why)).cast(kind)
    twice = F.when(F.count(F.lit(1)) > 1, fails("a bin is in two groups", "long")).otherwise(F.min("new").cast("long"))
    to = groups.groupBy(F.col("old").cast("long").alias("_old")).agg(twice.alias("_new"))
    # neighbours: as many old bins as lie between a group's ends
    spans = to.groupBy("_new").agg((F.max("_old") - F.min("_old") + 1 == F.count(F.lit(1))).alias("_together"))
    to = to.join(spans, "_new")
    named = F.when(F.col("_new").isNull(), fails("a bin is in no group", "long")).when(~F.col("_together"), fails("a group's bins are not neighbours", "long")).otherwise(F.col("_new"))
    rows = hist.join(to, hist[f"bin{s}"] == to["_old"], "left").withColumn("_to", named)
    others = [f"{k}{x}" for x in meta.suffixes(hist) if x != s for k in ("bin", "left", "right")]
    edges = [F.min(f"left{s}").alias(f"left{s}"), F.max(f"right{s}").alias(f"right{s}")]
    got = rows.groupBy(*others, "_to").agg(*edges, *_totals(hist), assert_no_gap(hist, axis, s).alias("_whole"))
    got = got.where(F.col("_whole").isNotNull()).withColumnRenamed("_to", f"bin{s}")
    return got.select(*(c for c in hist.columns if c in got.columns))


def merge_sparse(hist: DataFrame, least: float) -> DataFrame:
    """Adjacent bins joined until a bin holds more than `least`; a bin that holds it alone starts anew.

    One fold over the ordered bins, a table of the histogram's length and not of the data's.
    """
    rows = hist.agg(F.array_sort(F.collect_list(F.struct("bin", F.col("frequency").cast("double").alias("f")))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("group"), F.lit(0.0).alias("held"), F.array().cast("array<struct<bin:bigint,group:bigint>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        opens = (x["f"] >= least) & (s["held"] > 0)
        group = s["group"] + F.when(opens, 1).otherwise(0)
        held = F.when(opens, x["f"]).otherwise(s["held"] + x["f"])
        closes = held > least
        out = F.concat(s["out"], F.array(F.struct(x["bin"].alias("bin"), group.cast("long").alias("group"))))
        return F.struct((group + F.when(closes, 1).otherwise(0)).cast("long").alias("group"), F.when(closes, 0.0).otherwise(held).alias("held"), out.alias("out"))

    groups = rows.select(F.inline(F.aggregate("rows", start, step)["out"]))
    got = hist.join(F.broadcast(groups), "bin").groupBy(F.col("group").alias("bin"))
    got = got.agg(F.min("left").alias("left"), F.max("right").alias("right"), *_totals(hist), assert_no_gap(hist, "bin").alias("_whole"))
    return got.where(F.col("_whole").isNotNull()).drop("_whole")


def same_bins(a: DataFrame, b: DataFrame) -> bool:
    """Whether two histograms have the same edges, up to rounding."""
    near = lambda c: F.abs(F.col(f"x.{c}") - F.col(f"y.{c}")) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.col(f"y.{c}"))
    both = a.alias("x").join(b.alias("y"), F.col("x.bin") == F.col("y.bin"), "full")
    return both.where(~F.coalesce(near("left") & near("right"), F.lit(False))).limit(1).count() == 0


def plot_data(hist: DataFrame, density: bool = False, cumulative: bool = False) -> DataFrame:
    """bin, center, width, value, error; density and cumulative together give the distribution function."""
    width = F.col("right") - F.col("left")
    value, error = F.col("frequency").cast("double"), F.sqrt("error2")
    rows = hist
    if cumulative:
        rows, value = running(with_total(hist, "_total") if density else hist, value, n=_known_bins(hist))
        value = F.try_divide(value, F.col("_total")) if density else value
        error = F.lit(None).cast("double")
    elif density:
        value, error = value / width, error / width
    return rows.select("bin", ((F.col("left") + F.col("right")) / 2).alias("center"), width.alias("width"), value.alias("value"), error.alias("error"))


def bars(hist: DataFrame, width: int = 80) -> DataFrame:
    """bin, bar: each bin's share of the total as a line of #."""
    share = F.col("frequency") / F.col("_total")
    return with_total(hist, "_total").select("bin", F.repeat(F.lit("#"), F.coalesce(F.round(share * width), F.lit(0)).cast("int")).alias("bar"))


# --- collections: name, bin, left, right, frequency ----------------------------------------
def total_of(collection: DataFrame) -> DataFrame:
    """The sum of all members."""
    return collection.groupBy("bin", "left", "right").agg(F.sum("frequency").alias("frequency"))


def normalize_members(collection: DataFrame, by: str = "name") -> DataFrame:
    """Each member ("name") or each bin over all members ("bin") adds up to 1."""
    share = F.try_divide("frequency", F.sum("frequency").over(Window.partitionBy(by)))
    return collection.withColumn("frequency", F.coalesce(share, F.lit(0.0)))
