"""Histograms as small tidy DataFrames, from one hash aggregate over the data.

1-D: bin, left, right, frequency, error2. N-D: binI, leftI, rightI for each axis I.
Only occupied bins leave the aggregate; the grid fills in the rest afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binforge.functions import meta
from binforge.functions.binning import MOST_BINS

from . import arithmetic
from .infer import infer, infer_all, numeric, present, quantiles, without_missing


def _sums(weights: str | None) -> list[Column]:
    if weights is None:
        return [F.count("*").alias("frequency"), F.count("*").cast("double").alias("error2")]
    w = F.col(weights).cast("double")
    return [F.sum(w).alias("frequency"), F.sum(w * w).alias("error2")]


def counted(df: DataFrame, col: str, binning, weights: str | None = None) -> DataFrame:
    """bin, frequency, error2 with -1, n and null for what no bin holds."""
    return present(df, col).groupBy(binning.assign(F.col(col)).alias("bin")).agg(*_sums(weights))


def _filled(rows: DataFrame, got: DataFrame, keys: list[str]) -> list[Column]:
    """frequency and error2 of a grid joined with what was counted."""
    zero = F.lit(0).cast(got.schema["frequency"].dataType)
    return [F.coalesce("frequency", zero).alias("frequency"), F.coalesce("error2", F.lit(0.0)).alias("error2")]


def h1(df: DataFrame, col: str, bins=10, *, weights: str | None = None, dropna: bool = True, **how) -> DataFrame:
    """bin, left, right, frequency, error2."""
    numeric(df, col, *([weights] if weights else []))
    df = without_missing(df, [col], dropna)
    b = infer(df, col, bins, **how)
    got = counted(df, col, b, weights)
    full = b.grid(df.sparkSession).join(F.broadcast(got) if len(b) <= BROADCAST_BINS else got, "bin", "left")
    return meta.described(full.select("bin", "left", "right", *_filled(full, got, ["bin"])), [meta.of_binning(b, col)])


#: What was counted is sent to all tasks up to so many bins; more are joined by a shuffle.
BROADCAST_BINS = 100_000


def missed(df: DataFrame, col: str, bins=10, *, weights: str | None = None, **how) -> DataFrame:
    """underflow, overflow, inner_missed in one row."""
    b = infer(df, col, bins, **how)
    got, n = counted(df, col, b, weights), len(b.bins)
    part = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("frequency"))), F.lit(0)).alias(name)
    return got.agg(part(F.col("bin") == -1, "underflow"), part(F.col("bin") == n, "overflow"), part(F.col("bin").isNull(), "inner_missed"))


def statistics(df: DataFrame, col: str, weights: str | None = None) -> DataFrame:
    """sum, sum2, min, max, weight, mean, variance, std over the whole non-missing sample."""
    x, w = F.col(col).cast("double"), (F.col(weights).cast("double") if weights else F.lit(1.0))
    d = present(df, col).agg(F.sum(x * w).alias("sum"), F.sum(x * x * w).alias("sum2"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum(w).alias("weight"))
    return moments(d)


def moments(sums: DataFrame) -> DataFrame:
    """mean, variance, std added to rows of sum, sum2, weight."""
    d = sums.withColumn("mean", F.try_divide("sum", "weight"))
    d = d.withColumn("variance", F.try_divide(F.col("sum2") - F.try_divide(F.col("sum") * F.col("sum"), F.col("weight")), F.col("weight")))
    return d.withColumn("std", F.sqrt(F.greatest("variance", F.lit(0.0))))


def merge_statistics(*parts: DataFrame) -> DataFrame:
    """Statistics of samples put together, from the statistics of each."""
    both = reduce(DataFrame.unionByName, (p.select("sum", "sum2", "min", "max", "weight") for p in parts))
    return moments(both.agg(F.sum("sum").alias("sum"), F.sum("sum2").alias("sum2"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("weight").alias("weight")))


def median(df: DataFrame, col: str) -> float:
    """The exact median of the non-missing values."""
    return quantiles(df, col, [0.5])[0]


def per_axis(value, n: int, what: str) -> list:
    """An option for all axes, or a list of one for each."""
    if not isinstance(value, list):
        return [value] * n
    if len(value) != n:
        raise ValueError(f"{what}: {len(value)} given for {n} axes")
    return value


def h(df: DataFrame, cols: Sequence[str], bins=10, *, weights: str | None = None, dropna: bool = True, dense: bool = True, **how) -> DataFrame:
    """N-D: binI, leftI, rightI for each axis I, frequency, error2; with dense off, of occupied bins only.

    A list as long as there are axes has the bins of each, or an option's value for each; another list of numbers is the edges of all.
    """
    axes, got = counted_nd(df, cols, bins, weights=weights, dropna=dropna, **how)
    full = densified(df.sparkSession, axes, got) if dense else _edged(df.sparkSession, axes, got)
    return meta.described(full, [meta.of_binning(a, c) for a, c in zip(axes, cols)])


def counted_nd(df: DataFrame, cols: Sequence[str], bins=10, *, weights: str | None = None, dropna: bool = True, more: Sequence[Column] = (), **how) -> tuple[list, DataFrame]:
    """The axes, and what they hold: bin0, bin1, ..., frequency, error2, `more` sums; as in `counted` also what no bin holds."""
    cols = list(cols)
    if not cols:
        raise ValueError("at least one column is needed")
    numeric(df, *cols, *([weights] if weights else []))
    df, n = without_missing(df, cols, dropna), len(cols)
    if isinstance(bins, list) and len(bins) != n and all(isinstance(x, (int, float)) or (isinstance(x, tuple) and len(x) == 2) for x in bins):
        bins = [bins] * n  # edges, or pairs of them, of all axes
    options = {k: per_axis(v, n, k) for k, v in how.items()}
    axes = infer_all(df, cols, per_axis(bins, n, "bins"), [{k: v[i] for k, v in options.items() if v[i] is not None} for i in range(n)])
    # no filter on the indices: it would be pushed below and every index be computed twice
    keys = [a.assign(F.col(c)).alias(f"bin{i}") for i, (a, c) in enumerate(zip(axes, cols))]
    return axes, df.groupBy(*keys).agg(*_sums(weights), *more)


def _with_edges(spark, axes: Sequence, rows: DataFrame) -> DataFrame:
    """rows of bin0, bin1, ... with leftI, rightI."""
    for i, a in enumerate(axes):
        if a.rule:
            rows = rows.withColumns({f"left{i}": a.edge(F.col(f"bin{i}")), f"right{i}": a.edge(F.col(f"bin{i}") + 1)})
        else:
            rows = rows.join(F.broadcast(a.grid(spark, str(i))), f"bin{i}")  # uneven bins are listed by the driver
    return rows


def _edged(spark, axes: Sequence, got: DataFrame) -> DataFrame:
    """The occupied bins of the axes with their edges."""
    for i, a in enumerate(axes):
        got = got.where(F.col(f"bin{i}").between(0, len(a) - 1))
    return _with_edges(spark, axes, got).select(*(f"{k}{i}" for i in range(len(axes)) for k in ("bin", "left", "right")), "frequency", "error2")


def densified(spark, axes: Sequence, got: DataFrame) -> DataFrame:
    """All bins of the axes with what was counted in them; ValueError for more than MOST_BINS."""
    size = reduce(lambda p, a: p * len(a.bins), axes, 1)
    if size > MOST_BINS:
        raise ValueError(f"{size} bins are too many: more than {MOST_BINS}; with dense=False only occupied ones are made")
    # the grid of bins, a product of the axes and not of rows, made by the executors
    rows, step = spark.range(size), 1
    for i in reversed(range(len(axes))):
        rows = rows.withColumn(f"bin{i}", F.floor(F.col("id") / step).cast("long") % len(axes[i].bins))
        step *= len(axes[i].bins)
    rows = _with_edges(spark, axes, rows.drop("id"))
    names = [f"bin{i}" for i in range(len(axes))]
    rows = rows.join(F.broadcast(got) if size <= BROADCAST_BINS else got, names, "left")
    return rows.select(*(f"{k}{i}" for i in range(len(axes)) for k in ("bin", "left", "right")), *_filled(rows, got, names))


def h2(df: DataFrame, x: str, y: str, bins=10, **how) -> DataFrame:
    return h(df, [x, y], bins, **how)


def h3(df: DataFrame, x: str, y: str, z: str, bins=10, **how) -> DataFrame:
    return h(df, [x, y, z], bins, **how)


def collection(df: DataFrame, name: str, col: str, bins=10, *, weights: str | None = None, **how) -> DataFrame:
    """One histogram for each value of `name`, null among them, over shared bins."""
    numeric(df, col, *([weights] if weights else []))
    b = infer(df, col, bins, **how)
    # one pass: a name without values in any bin has its row with a null bin
    value = F.col(col).cast("double")
    here = value.isNotNull() & ~F.isnan(value)
    w = F.when(here, F.col(weights).cast("double") if weights else 1)
    got = df.groupBy(F.col(name).alias("name"), F.when(here, b.assign(F.col(col))).alias("bin")).agg(F.sum(w).alias("frequency"))
    names = got.select(F.col("name").alias("_name")).distinct()
    full = names.select("_name", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(b.bins) - 1).cast("long"))).alias("_bin"))
    full = full.join(got, F.col("_name").eqNullSafe(F.col("name")) & (F.col("_bin") == F.col("bin")), "left").select(F.col("_name").alias("name"), F.col("_bin").alias("bin"), "frequency")
    full = full.join(F.broadcast(b.grid(df.sparkSession)), "bin")
    kind = "double" if weights else "long"
    return full.select("name", "bin", "left", "right", F.coalesce("frequency", F.lit(0)).cast(kind).alias("frequency"))


# --- on histograms; bins are few, so windows here are over a small table ---------------
#: Bins up to which running sums are taken in one task; of more, by ranges of so many.
RUNNING_BINS = 1_000_000


def running(hist: DataFrame, value: Column, by: Sequence[str] = (), bin: str = "bin", n: int | None = None) -> Column | tuple[DataFrame, Column]:
    """hist and a column of the running sums of value along bins (within `by`).

    Where the axis is known to have more than RUNNING_BINS bins, each range of that many is summed on its own, after the totals of the ranges before.
    """
    along = lambda keys: Window.partitionBy(*keys).orderBy(bin).rowsBetween(Window.unboundedPreceding, 0)
    if not n or n <= RUNNING_BINS:
        return hist, F.sum(value).over(along(by))
    ranged = hist.withColumn("_range", F.floor(F.col(bin) / RUNNING_BINS)).withColumn("_value", value)
    totals = ranged.groupBy("_range", *by).agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *by, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    return ranged.join(totals, ["_range", *by]), F.col("_before") + F.sum("_value").over(along(["_range", *by]))


def _known_bins(hist: DataFrame, axis: int = 0) -> int | None:
    told = meta.axes_of(hist)[axis]
    return told.get("n") if told else None


def cumulative(hist: DataFrame) -> DataFrame:
    rows, total = running(hist, F.col("frequency"), n=_known_bins(hist))
    return rows.select(*hist.columns, total.alias("cumulative"))


def with_total(hist: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """hist with the sum of frequencies (within `by`): by a window, which takes all bins into a task, or of an axis known to be long by one more aggregate."""
    n = max((a.get("n") or 0 for a in meta.axes_of(hist) if a), default=0)
    if by or n <= RUNNING_BINS:
        return hist.withColumn(name, F.sum("frequency").over(Window.partitionBy(*by)))
    total = hist.agg(F.sum("frequency").alias(name)).select(name, F.lit(0).alias("_one"))  # a single row
    return hist.withColumn("_one", F.lit(0)).join(F.broadcast(total), "_one").drop("_one")


def normalize(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Frequencies over their total (within `by`), errors2 over its square."""
    h_ = with_total(hist, "_t", by)
    out = h_.withColumn("frequency", F.coalesce(F.try_divide(F.col("frequency"), "_t"), F.lit(0.0)))
    return (out.withColumn("error2", F.coalesce(F.try_divide(F.col("error2"), F.col("_t") * F.col("_t")), F.lit(0.0))) if "error2" in hist.columns else out).drop("_t")


def density(hist: DataFrame) -> DataFrame:
    return hist.withColumn("density", F.try_divide(F.col("frequency"), F.col("right") - F.col("left")))


def assert_no_gap(hist: DataFrame, group, axis: str = "") -> Column:
    """A boolean aggregate of a group of bins: true, or an error where the group spans a gap."""
    left, right = F.min(f"left{axis}"), F.max(f"right{axis}")
    width = F.sum(F.col(f"right{axis}") - F.col(f"left{axis}"))
    gap = F.abs(right - left - width) > 1e-8 + 1e-9 * F.abs(right)
    return F.when(gap, F.raise_error(F.lit("bins on both sides of a gap can't be merged"))).otherwise(F.lit(True).cast("string"))


def merge_bins(hist: DataFrame, amount: int) -> DataFrame:
    """Every `amount` adjacent bins become one; an error where a gap is between them."""
    if not isinstance(amount, int) or amount < 1:
        raise ValueError("a positive whole number of bins is needed")
    got = hist.groupBy(F.floor(F.col("bin") / amount).cast("long").alias("bin")).agg(F.min("left").alias("left"), F.max("right").alias("right"), F.sum("frequency").alias("frequency"), F.sum("error2").alias("error2"), assert_no_gap(hist, "bin").alias("_whole"))
    return got.where(F.col("_whole").isNotNull()).drop("_whole")


def axes_of(hist: DataFrame) -> int:
    return sum(c.startswith("bin") and c[3:].isdigit() for c in hist.columns)


def projection(hist: DataFrame, *axes: int) -> DataFrame:
    """The axes kept, in their own order; the others are summed over."""
    n = axes_of(hist)
    if not axes:
        raise ValueError("no axis to keep")
    if len(set(axes)) < len(axes):
        raise ValueError("an axis is named twice")
    if any(not isinstance(i, int) or not 0 <= i < n for i in axes):
        raise ValueError(f"axes are 0 to {n - 1}")
    if len(axes) >= n:
        raise ValueError("a projection has fewer axes")
    keys = [f"{k}{i}" for i in sorted(axes) for k in ("bin", "left", "right")]
    return hist.groupBy(*keys).agg(F.sum("frequency").alias("frequency"), F.sum("error2").alias("error2"))


def add(a: DataFrame, b: DataFrame, sign: int = 1, dense: bool | None = None) -> DataFrame:
    """a + b, or a - b where sign is -1, of tables with the same number of axes; errors add up either way.

    On each axis bins must be the same, or lie on one grid of equal widths and offset, along which the result grows; else ValueError.
    dense: whether the bins that lie between the two are made, which is usual in N-D; in 1-D without, bins are numbered as they are.
    A negative frequency fails the job, unless arithmetic is free.
    """
    axes = meta.suffixes(a)
    if axes != meta.suffixes(b):
        raise ValueError("the histograms have different numbers of axes")
    facts = [_facts(x, axes) for x in (a, b)]
    if not all(f["n"] for f in facts):
        grids = [None] * len(axes)  # one of them is empty
    else:
        grids = [_common_grid(a, b, s, *facts) for s in axes]
    keyed = [_on_grid(x, axes, grids) for x in (a, b.withColumn("frequency", F.col("frequency") * sign))]
    bins = [f"bin{s}" for s in axes]
    edges = [f(f"{e}{s}").alias(f"{e}{s}") for s in axes for e, f in (("left", F.min), ("right", F.max))]
    got = keyed[0].unionByName(keyed[1]).groupBy(*bins).agg(*edges, F.sum("frequency").alias("frequency"), F.sum("error2").alias("error2"))
    if sign < 0 and not arithmetic.is_free():
        refused = F.raise_error(F.lit("frequencies would be negative")).cast(got.schema["frequency"].dataType)
        got = got.withColumn("frequency", F.when(F.col("frequency") < 0, refused).otherwise(F.col("frequency")))
    if any(g and g["grown"] for g in grids):
        if len(axes) > 1 if dense is None else dense:
            got = _filled_between(got, axes, grids)
        elif len(axes) == 1:
            got = got.withColumn("bin", F.row_number().over(Window.orderBy("bin")) - 1)
    return got.select(*(F.col(f"{k}{s}").cast("long" if k == "bin" else "double").alias(f"{k}{s}") for s in axes for k in ("bin", "left", "right")), "frequency", "error2")


def _facts(hist: DataFrame, axes: list[str]):
    """One row: of each axis the least and greatest width, the ends and the last bin; n, the number of rows."""
    each = []
    for s in axes:
        width = F.col(f"right{s}") - F.col(f"left{s}")
        each += [F.min(width).alias(f"w{s}"), F.max(width).alias(f"v{s}"), F.min(f"left{s}").alias(f"lo{s}"), F.max(f"right{s}").alias(f"hi{s}"), F.max(f"bin{s}").alias(f"k{s}")]
    return hist.agg(*each, F.count(F.lit(1)).alias("n")).first()


def _common_grid(a: DataFrame, b: DataFrame, s: str, p, q) -> dict:
    """The grid of one width w that both tables' bins of an axis lie on; without w where uneven bins are the same, ValueError otherwise."""
    near = lambda x, y, by: abs(x - y) <= 1e-8 + 1e-5 * abs(by)
    w = p[f"w{s}"]
    if all(near(w, f[f"{k}{s}"], w) for f in (p, q) for k in "wv"):
        off = (q[f"lo{s}"] - p[f"lo{s}"]) / w
        if abs(off - round(off)) <= 1e-6:
            lo, hi = min(p[f"lo{s}"], q[f"lo{s}"]), max(p[f"hi{s}"], q[f"hi{s}"])
            grown = not (near(p[f"lo{s}"], q[f"lo{s}"], w) and near(p[f"hi{s}"], q[f"hi{s}"], w))
            return {"w": w, "lo": lo, "n": round((hi - lo) / w), "grown": grown}
    elif p[f"k{s}"] == q[f"k{s}"]:
        from .shape import same_bins

        if same_bins(*(x.select(*(F.col(f"{k}{s}").alias(k) for k in ("bin", "left", "right"))).distinct() for x in (a, b))):
            return {"w": None, "n": p[f"k{s}"] + 1, "grown": False}
    raise ValueError("the bins of the histograms are not compatible")


def _on_grid(hist: DataFrame, axes: list[str], grids: list[dict | None]) -> DataFrame:
    """hist with the bins' numbers on the common grids."""
    for s, g in zip(axes, grids):
        if g and g["w"]:
            hist = hist.withColumn(f"bin{s}", F.round((F.col(f"left{s}") - g["lo"]) / g["w"]).cast("long"))
    return hist


def _filled_between(got: DataFrame, axes: list[str], grids: list[dict | None]) -> DataFrame:
    """got with the bins of all axes that nothing was counted in."""
    size = reduce(lambda p, g: p * g["n"], grids, 1)
    if size > MOST_BINS:
        raise ValueError(f"{size} bins are too many: more than {MOST_BINS}")
    rows, step = got.sparkSession.range(size), 1
    for s, g in zip(axes, grids):
        rows = rows.withColumn(f"bin{s}", F.floor(F.col("id") / step).cast("long") % g["n"])
        step *= g["n"]
    for s, g in zip(axes, grids):
        left = F.col(f"bin{s}") * F.lit(g["w"] or 0.0) + F.lit(g.get("lo", 0.0))
        if g["w"]:
            rows = rows.withColumns({f"_left{s}": left, f"_right{s}": left + F.lit(g["w"])})
        else:
            own = got.groupBy(f"bin{s}").agg(F.min(f"left{s}").alias(f"_left{s}"), F.max(f"right{s}").alias(f"_right{s}"))
            rows = rows.join(own, f"bin{s}")
    full = rows.drop("id").join(got, [f"bin{s}" for s in axes], "left")
    edges = [F.coalesce(f"{e}{s}", f"_{e}{s}").alias(f"{e}{s}") for s in axes for e in ("left", "right")]
    return full.select(*(f"bin{s}" for s in axes), *edges, *_filled(full, got, []))


def scale(hist: DataFrame, by: float) -> DataFrame:
    if by < 0 and not arithmetic.is_free():
        raise ValueError("frequencies would be negative")
    return hist.withColumn("frequency", F.col("frequency") * by).withColumn("error2", F.col("error2") * by * by)
