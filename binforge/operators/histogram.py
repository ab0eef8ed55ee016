"""A histogram with its axes, names, missed values and statistics.

One aggregate job over the data gives everything: what each bin holds, what no bin holds
and, in 1-D, the sums that statistics need. What is kept is a row for each occupied bin, brought to the driver once;
rows of data never are. Histograms don't change: each method gives a new one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binforge.functions import binning as B

from . import arithmetic, coords
from .hist import counted_nd, densified, quantiles
from .infer import numeric, without_missing

#: Occupied bins that may be brought to the driver.
MOST_ROWS = 5_000_000
@dataclass(frozen=True)
class Statistics:
    """Sums over all values, whether a bin holds them or not; the median is lost by merging."""

    sum: float = 0.0
    sum2: float = 0.0
    min: float = math.inf
    max: float = -math.inf
    weight: float = 0.0
    median: float = math.nan

    @property
    def mean(self) -> float:
        return self.sum / self.weight if self.weight else math.nan

    @property
    def variance(self) -> float:
        return (self.sum2 - self.sum**2 / self.weight) / self.weight if self.weight > 0 else math.nan

    @property
    def std(self) -> float:
        return math.sqrt(max(self.variance, 0.0)) if self.weight > 0 else math.nan

    def __add__(self, other: Statistics) -> Statistics:
        return Statistics(self.sum + other.sum, self.sum2 + other.sum2, min(self.min, other.min), max(self.max, other.max), self.weight + other.weight)

    def scaled(self, by: float) -> Statistics:
        return replace(self, sum=self.sum * by, sum2=self.sum2 * by, weight=self.weight * by)


#: Of results whose values are not known any more.
INVALID = Statistics(math.nan, math.nan, math.nan, math.nan, math.nan)

Cell = tuple[float, float]  # frequency, error2


@dataclass(frozen=True)
class Histogram:
    spark: SparkSession = field(repr=False, compare=False)
    axes: tuple[B.Binning, ...]
    cells: dict[tuple[int | None, ...], Cell] = field(repr=False)  # by bin; -1, the number of bins and None are what no bin holds
    axis_names: tuple[str, ...]
    name: str | None = None
    title: str | None = None
    stats: Statistics = INVALID
    keep_missed: bool = True
    whole: bool = True  # frequencies are whole numbers
    adaptive: bool = False
    kind: str | None = None  # of coords.SYSTEMS
    radius: float = 1.0  # of surfaces
    meta: dict = field(default_factory=dict)  # whatever else is to be known, as JSON has it

    def __post_init__(self):
        if not arithmetic.is_free() and any(f < 0 for k, (f, _) in self.cells.items() if self._inside(k)):
            raise ValueError("frequencies would be negative")

    # --- made from data -----------------------------------------------------------------------
    @staticmethod
    def of(df: DataFrame, *cols: str, bins=10, weights: str | None = None, dropna: bool = True, name: str | None = None, title: str | None = None,
           axis_names: Sequence[str] | None = None, keep_missed: bool = True, dtype: str | None = None, adaptive: bool = False, median: bool = False, **how) -> Histogram:
        """Of one or more columns, all numeric ones where none is named. median asks for one more pass."""
        if not cols:
            cols = tuple(f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal") and f.name != weights)
        if dtype == "int" and weights and df.schema[weights].dataType.typeName() in ("float", "double", "decimal"):
            raise ValueError("whole frequencies can't hold weights that are not")
        if adaptive and bins not in ("fixed_width", "integer", "pretty", "human") and not (isinstance(bins, B.Binning) and bins.rule):
            raise ValueError("only bins of one fixed width can adapt")
        x, w = F.col(cols[0]).cast("double"), F.col(weights).cast("double") if weights else F.lit(1.0)
        sums = [F.sum(x * w).alias("sum"), F.sum(x * x * w).alias("sum2"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum(w).alias("weight")]
        axes, got = counted_nd(df, cols, bins, weights=weights, dropna=dropna, more=sums if len(cols) == 1 else (), **how)
        rows = got.limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise ValueError(f"more than {MOST_ROWS} occupied bins; h() keeps them as a table")
        names = tuple(axis_names or cols)
        if len(names) != len(cols):
            raise ValueError(f"{len(names)} axis names for {len(cols)} axes")
        stats = INVALID
        if len(cols) == 1:
            stats = sum((Statistics(*(r[k] for k in ("sum", "sum2", "min", "max", "weight"))) for r in rows), Statistics())
            if median and not weights and rows:
                stats = replace(stats, median=quantiles(df, cols[0], [0.5])[0])
        cells = {tuple(r[f"bin{i}"] for i in range(len(cols))): (r["frequency"], r["error2"]) for r in rows}
        whole = weights is None or df.schema[weights].dataType.typeName() not in ("float", "double", "decimal")
        out = Histogram(df.sparkSession, tuple(axes), cells, names, name, title, stats, keep_missed, whole and dtype != "float", adaptive)
        return out if keep_missed else out._only_bins()

    @staticmethod
    def empty(spark: SparkSession, *axes: B.Binning, axis_names: Sequence[str] | None = None, **more) -> Histogram:
        """Of no values, to be filled."""
        if not axes:
            raise ValueError("at least one axis is needed")
        names = tuple(axis_names or (f"axis{i}" for i in range(len(axes))))
        return Histogram(spark, tuple(axes), {}, names, stats=Statistics() if len(axes) == 1 else INVALID, **more)

    @staticmethod
    def special(df: DataFrame, kind: str, *cols: str, bins: Sequence | None = None, ranges: Sequence | None = None, transformed: bool = False, radius: float = 1.0, **how) -> Histogram:
        """Of a kind of coords.SYSTEMS: the columns' coordinates are transformed, unless they are already."""
        d, at = coords.transformed(df, kind, cols, transformed, [how["weights"]] if how.get("weights") else [])
        usual = coords.usual_bins(kind)
        bins = [usual[k] if b is None else b for k, b in enumerate(bins or [None] * len(at))]
        ranges = list(ranges or [None] * len(at))
        bins = [coords.even(b, r or coords.system(kind).ranges.get(a)) for a, b, r in zip(at, bins, ranges)]
        return replace(Histogram.of(d, *at, bins=bins, **how), kind=kind, radius=radius, stats=INVALID)

    # --- what it is ------------------------------------------------------------------------------
    @property
    def ndim(self) -> int:
        return len(self.axes)

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(a) for a in self.axes)

    @property
    def bin_count(self) -> int:
        return math.prod(self.shape)

    @property
    def binning(self) -> B.Binning:
        return self.axes[0]

    @property
    def edges(self):
        return self.axes[0].edges if self.ndim == 1 else [a.edges for a in self.axes]

    def _inside(self, key: tuple) -> bool:
        return all(k is not None and 0 <= k < len(a) for k, a in zip(key, self.axes))

    def frequencies(self) -> list[float]:
        """Of all bins, the last axis fastest."""
        return [self.cells.get(k, (0, 0))[0] for k in _every(self.shape)]

    def errors2(self) -> list[float]:
        return [self.cells.get(k, (0, 0))[1] for k in _every(self.shape)]

    @property
    def total(self) -> float:
        return sum(f for k, (f, _) in self.cells.items() if self._inside(k))

    @property
    def missed(self) -> float:
        return sum(f for k, (f, _) in self.cells.items() if not self._inside(k)) if self.keep_missed else math.nan

    def _outside(self, at: int | None) -> float:
        if self.ndim != 1:
            raise ValueError("known of one axis only")
        return self.cells.get((at,), (0, 0))[0] if self.keep_missed else math.nan

    @property
    def underflow(self) -> float:
        return self._outside(-1)

    @property
    def overflow(self) -> float:
        return self._outside(len(self.axes[0]))

    @property
    def inner_missed(self) -> float:
        return self._outside(None)

    def table(self) -> DataFrame:
        """All bins as rows: bin, left, right (binI, leftI, rightI in N-D), frequency, error2, and size of special kinds."""
        kind = "long" if self.whole else "double"
        names = [f"bin{i}" for i in range(self.ndim)]
        cast = int if self.whole else float
        rows = [(*k, cast(f), float(e)) for k, (f, e) in self.cells.items() if self._inside(k)]
        got = self.spark.createDataFrame(rows, ", ".join([*(f"{n} long" for n in names), f"frequency {kind}", "error2 double"]))
        full = densified(self.spark, self.axes, got)
        if self.kind:
            full = full.withColumn("size", coords.size_of(self.kind, self.radius))
        return full.withColumnsRenamed({"bin0": "bin", "left0": "left", "right0": "right"}) if self.ndim == 1 else full

    def axis(self, which: int | str) -> int:
        """The number of an axis, by number or name."""
        if isinstance(which, str):
            if which not in self.axis_names:
                raise ValueError(f"no axis {which}; there are {', '.join(self.axis_names)}")
            return self.axis_names.index(which)
        if not isinstance(which, int):
            raise TypeError("an axis is a number or a name")
        if not -self.ndim <= which < self.ndim:
            raise ValueError(f"axes are 0 to {self.ndim - 1}")
        return which % self.ndim

    def find_bin(self, value, axis: int | str | None = None, transformed: bool = False):
        """The bin of a value: in 1-D or on an axis -1 below, the number of bins above, None in a gap; in N-D a tuple, or None if missed."""
        if axis is not None:
            return self.axes[self.axis(axis)].find(value)
        if self.kind and not transformed:
            value = coords.point(self.kind, value)
            value = value[0] if self.ndim == 1 else value
        if self.ndim == 1:
            return self.axes[0].find(value)
        if not isinstance(value, (tuple, list)):
            raise TypeError(f"a tuple is needed, not {value!r}")
        if len(value) != self.ndim:
            raise ValueError(f"{len(value)} values for {self.ndim} axes")
        key = tuple(a.find(x) for a, x in zip(self.axes, value))
        return key if self._inside(key) else None

    # --- parts --------------------------------------------------------------------------------------
    def __getitem__(self, index):
        """h[i]: edges and frequency of a bin. h[a:b], h[mask], h[list]: a histogram. In N-D a tuple has an index for each axis."""
        if self.ndim > 1:
            index = index if isinstance(index, tuple) else (index,)
            if len(index) > self.ndim:
                raise IndexError(f"{len(index)} indices for {self.ndim} axes")
            if len(index) == self.ndim and all(isinstance(i, int) for i in index):
                k = tuple(range(n)[i] for n, i in zip(self.shape, index))
                return [a.bins[i] for a, i in zip(self.axes, k)], self.cells.get(k, (0, 0))[0]
            out, axis = self, 0
            for i in index:
                out = out.select(axis, i)
                axis += not isinstance(i, int)
            return out
        if isinstance(index, int):
            k = range(len(self.axes[0]))[index]
            return self.axes[0].bins[k], self.cells.get((k,), (0, 0))[0]
        return self._part(0, index)

    def select(self, axis: int | str, index) -> Histogram:
        """An index drops the axis, a slice, list or mask keeps a part of it."""
        i = self.axis(axis)
        if not isinstance(index, int):
            return self._part(i, index)
        if self.ndim == 1:
            raise ValueError("the only axis can't be dropped")
        k = range(len(self.axes[i]))[index]
        cells = {(*key[:i], *key[i + 1 :]): c for key, c in self.cells.items() if key[i] == k}
        return self._without([i], cells, self.kind)

    def _part(self, i: int, index) -> Histogram:
        kept, new = self.axes[i].kept(index), {}
        part = self.axes[i][index]
        place = {k: at for at, k in enumerate(kept)}
        for key, c in self.cells.items():
            k = key[i]
            if k in place:
                at = place[k]
            elif isinstance(index, slice) and k is not None:  # what a slice leaves out is missed on its side
                at = -1 if not kept or k < kept[0] else len(kept)
            else:
                if not isinstance(index, slice):
                    continue
                at = None
            _add(new, (*key[:i], at, *key[i + 1 :]), c)
        return replace(self, axes=(*self.axes[:i], part, *self.axes[i + 1 :]), cells=new, stats=INVALID, adaptive=False)

    def projection(self, *axes: int | str) -> Histogram:
        """The axes kept, in their own order; values that a dropped axis missed are missed still."""
        keep = [self.axis(a) for a in axes]
        if not keep:
            raise ValueError("no axis to keep")
        if len(set(keep)) < len(keep):
            raise ValueError("an axis is named twice")
        if len(keep) >= self.ndim:
            raise ValueError("a projection has fewer axes")
        keep = sorted(keep)
        cells: dict = {}
        for key, c in self.cells.items():
            if self._inside(key):
                _add(cells, tuple(key[i] for i in keep), c)
        kept = tuple(coords.system(self.kind).axes[i] for i in keep) if self.kind else ()
        out = self._without([i for i in range(self.ndim) if i not in keep], cells, coords.projected(self.kind, kept))
        return replace(out, radius=self.axes[0].bins[-1][1]) if (self.kind, out.kind) == ("cylindrical", "cylindrical_surface") else out

    def _without(self, axes: list[int], cells: dict, kind: str | None) -> Histogram:
        kept = [i for i in range(self.ndim) if i not in axes]
        kind = kind if kind and len(coords.system(kind).axes) == len(kept) else None
        return replace(self, axes=tuple(self.axes[i] for i in kept), cells=cells, axis_names=tuple(self.axis_names[i] for i in kept), stats=INVALID, kind=kind)

    def transpose(self) -> Histogram:
        if self.ndim != 2:
            raise ValueError("two axes are needed")
        return replace(self, axes=self.axes[::-1], axis_names=self.axis_names[::-1], cells={k[::-1]: c for k, c in self.cells.items()}, kind=None)

    def _only_bins(self) -> Histogram:
        return replace(self, cells={k: c for k, c in self.cells.items() if self._inside(k)}, keep_missed=False)

    def regroup(self, axis: int | str, groups: Sequence[Sequence[int]]) -> Histogram:
        """Each group of adjacent bins of an axis becomes one; every bin is in one group."""
        i = self.axis(axis)
        a = self.axes[i]
        if [k for g in groups for k in g] != list(range(len(a))):
            raise ValueError("groups must hold each bin once, in order")
        bins = []
        for g in groups:
            if any(a.bins[x][1] != a.bins[y][0] for x, y in zip(g, g[1:])):
                raise ValueError("bins on both sides of a gap can't be merged")
            bins.append((a.bins[g[0]][0], a.bins[g[-1]][1]))
        to = {k: at for at, g in enumerate(groups) for k in g} | {-1: -1, len(a): len(groups), None: None}
        cells: dict = {}
        for key, c in self.cells.items():
            _add(cells, (*key[:i], to[key[i]], *key[i + 1 :]), c)
        return replace(self, axes=(*self.axes[:i], B.Binning(tuple(bins), a.closed), *self.axes[i + 1 :]), cells=cells, adaptive=False)

    def merge_bins(self, amount: int | None = None, min_frequency: float | None = None, axis: int | str | None = None) -> Histogram:
        """Every `amount` adjacent bins become one, or as many as hold more than `min_frequency`; on all axes where none is named."""
        if axis is None:
            return reduce(lambda h, i: h.merge_bins(amount, min_frequency, i), range(self.ndim), self)
        i = self.axis(axis)
        n = len(self.axes[i])
        if amount is not None:
            if not isinstance(amount, int) or amount < 1:
                raise ValueError("a positive whole number of bins is needed")
            return self.regroup(i, [list(range(n))[k : k + amount] for k in range(0, n, amount)])
        if min_frequency is None:
            raise ValueError("either an amount or a least frequency is needed")
        freq = (self if self.ndim == 1 else self.projection(i)).frequencies()
        groups, held = [[]], 0.0
        for k, f in enumerate(freq):
            if f >= min_frequency and held > 0:
                groups, held = [*groups, []], 0.0
            groups[-1].append(k)
            held += f
            if held > min_frequency:
                groups, held = [*groups, []], 0.0
        return self.regroup(i, [g for g in groups if g])

    # --- algebra -------------------------------------------------------------------------------------
    def __add__(self, other: Histogram) -> Histogram:
        return self._combined(other, 1)

    def __radd__(self, other) -> Histogram:
        if isinstance(other, (int, float)) and other == 0:  # sum() begins with 0
            return self
        return self._combined(other, 1)

    __array_ufunc__ = None  # numpy leaves array + histogram to the histogram

    def __sub__(self, other: Histogram) -> Histogram:
        return self._combined(other, -1)

    def _combined(self, other, sign: int) -> Histogram:
        if not isinstance(other, Histogram):
            return self._with_array(other, lambda f, x: f + sign * x, lambda e, x: e + abs(x), "added to")
        if self.ndim != other.ndim:
            raise ValueError("the histograms have different numbers of axes")
        if self.kind != other.kind or (self.kind and not math.isclose(self.radius, other.radius)):
            raise ValueError(f"histograms of different coordinates: {self.kind or 'plain'} and {other.kind or 'plain'}, radius {self.radius} and {other.radius}")
        a, b = self, other
        if not all(x.same(y) for x, y in zip(a.axes, b.axes)):
            a, b = a._aligned(b), b._aligned(a)
        cells = dict(a.cells)
        for k, (f, e) in b.cells.items():
            g, d = cells.get(k, (0, 0))
            cells[k] = (g + sign * f, d + e)
        both = lambda x, y: x if x == y else None
        names = tuple(both(x, y) or f"axis{i}" for i, (x, y) in enumerate(zip(a.axis_names, b.axis_names)))
        stats = a.stats + b.stats if sign == 1 else INVALID
        meta = {k: both(a.meta.get(k), b.meta.get(k)) for k in a.meta.keys() | b.meta.keys()}
        return replace(a, cells=cells, axis_names=names, name=both(a.name, b.name), title=both(a.title, b.title), stats=stats, whole=a.whole and b.whole, keep_missed=a.keep_missed and b.keep_missed, meta=meta)

    def _with_array(self, other, frequency, error2, what: str) -> Histogram:
        """Free arithmetic: numbers for all bins, or one for each in the histogram's shape; what was missed isn't known any more."""
        if not arithmetic.is_free() or isinstance(other, (str, bytes)) or other is None:
            raise TypeError(f"only a number or a histogram of the same kind can be {what} a histogram")
        values = np.broadcast_to(np.asarray(other), self.shape)
        if values.dtype.kind not in "iufb":
            raise TypeError("numbers are needed")
        cells = {}
        for k in _every(self.shape):
            f, e = self.cells.get(k, (0, 0))
            x = values[k].item()
            cells[k] = (frequency(f, x), error2(e, x))
        whole = self.whole and values.dtype.kind in "iub" and all(float(f).is_integer() for f, _ in cells.values())
        return replace(self, cells=cells, stats=INVALID, keep_missed=False, whole=whole)

    def _aligned(self, other: Histogram) -> Histogram:
        """On axes that hold those of both, which must be of one width and offset and have missed nothing."""
        if self.missed not in (0, math.nan) and self.keep_missed and self.missed:
            raise ValueError("bins with missed values can't be extended")
        axes, cells = [], {k: c for k, c in self.cells.items() if self._inside(k)}
        for i, (a, b) in enumerate(zip(self.axes, other.axes)):
            if a.same(b):
                axes.append(a)
                continue
            if not (a.rule and b.rule) or not math.isclose(a.rule[1], b.rule[1]):
                raise ValueError("the bins of the histograms are not compatible")
            w = a.rule[1]
            off = (b.bins[0][0] - a.bins[0][0]) / w
            if abs(off - round(off)) > 1e-6:
                raise ValueError("the bins of the histograms are not compatible")
            axis, back = _extended(a, min(0, round(off)), max(len(a), round(off) + len(b)))
            axes.append(axis)
            cells = {(*k[:i], k[i] + back, *k[i + 1 :]): c for k, c in cells.items()}
        return replace(self, axes=tuple(axes), cells=cells)

    def __mul__(self, by) -> Histogram:
        if isinstance(by, Histogram):
            raise TypeError("histograms can't be multiplied by each other")
        if not isinstance(by, (int, float)):
            return self._with_array(by, lambda f, x: f * x, lambda e, x: e * x * x, "multiplied with")
        cells = {k: (f * by, e * by * by) for k, (f, e) in self.cells.items()}
        return replace(self, cells=cells, stats=self.stats.scaled(by), whole=self.whole and isinstance(by, int))

    __rmul__ = __mul__

    def __truediv__(self, by) -> Histogram:
        if isinstance(by, Histogram):
            raise TypeError("histograms can't be divided by each other")
        if not isinstance(by, (int, float)):
            return replace(self._with_array(by, lambda f, x: _over(f, x), lambda e, x: _over(e, x * x), "divided by"), whole=False)
        return replace(self * (1 / by), whole=False)

    def __eq__(self, other) -> bool:
        """Equal names, and bins, frequencies, errors and missed values equal up to rounding."""
        if not isinstance(other, Histogram) or self.ndim != other.ndim or not all(a.same(b) for a, b in zip(self.axes, other.axes)):
            return False
        near = lambda x, y: all(math.isclose(p, q, rel_tol=1e-5, abs_tol=1e-8) for p, q in zip(x, y))
        keys = self.cells.keys() | other.cells.keys()
        same = (self.name, self.title, self.axis_names, self.kind, self.meta) == (other.name, other.title, other.axis_names, other.kind, other.meta)
        return same and all(near(self.cells.get(k, (0, 0)), other.cells.get(k, (0, 0))) for k in keys)

    __hash__ = None

    def normalize(self, percent: bool = False) -> Histogram:
        return self * ((100 if percent else 1) / self.total) if self.total else self

    def numpy_like(self):
        """Frequencies in the histogram's shape, and edges, as numpy has them."""
        return np.array(self.frequencies()).reshape(self.shape), (np.array(self.edges) if self.ndim == 1 else [np.array(e) for e in self.edges])

    def densities(self) -> list[float]:
        """Frequencies over sizes, of all bins."""
        widths = [[r - x for x, r in a.bins] for a in self.axes]
        sizes = [r["size"] for r in self.table().orderBy(*self._order()).collect()] if self.kind else [math.prod(w[i] for w, i in zip(widths, k)) for k in _every(self.shape)]
        return [f / s for f, s in zip(self.frequencies(), sizes)]

    def _order(self) -> list[str]:
        return ["bin"] if self.ndim == 1 else [f"bin{i}" for i in range(self.ndim)]

    def cumulative(self) -> list[float]:
        total, out = 0, []
        for f in self.frequencies():
            total += f
            out.append(total)
        return out

    def set_dtype(self, dtype: str) -> Histogram:
        """"int" refuses frequencies that are not whole."""
        if dtype not in ("int", "float"):
            raise ValueError(f"unknown type {dtype}")
        if dtype == "int" and any(f != int(f) for f, _ in self.cells.values()):
            raise ValueError("some frequencies are not whole numbers")
        return replace(self, whole=dtype == "int")

    # --- filling -----------------------------------------------------------------------------------------
    def set_adaptive(self, on: bool = True) -> Histogram:
        if on and not all(a.rule for a in self.axes):
            raise ValueError("only bins of one fixed width can adapt")
        return replace(self, adaptive=on)

    def fill(self, value, weight: float = 1) -> Histogram:
        """With one value more."""
        return self.fill_values([value], [weight])

    def fill_values(self, values: Sequence, weights: Sequence[float] | None = None, transformed: bool = False) -> Histogram:
        """With a driver's list of values more, tuples in N-D; those with a missing part are left out."""
        points = [v if isinstance(v, (tuple, list)) else (v,) for v in values]
        if self.kind and not transformed:
            points = [coords.point(self.kind, p) for p in points]
        weights = list(weights) if weights is not None else [1] * len(points)
        if len(weights) != len(points):
            raise ValueError("a weight is needed for each value")
        if any(len(p) != self.ndim for p in points):
            raise ValueError(f"values of {self.ndim} parts are needed")
        both = [(p, w) for p, w in zip(points, weights) if all(x is not None and not math.isnan(x) for x in p)]
        out = self._grown([p for p, _ in both]) if self.adaptive else self
        cells, s = dict(out.cells), self.stats
        for p, w in both:
            key = tuple(a.find(x) if a.closed or x != a.bins[-1][1] else len(a) for a, x in zip(out.axes, p))
            if self.keep_missed or out._inside(key):
                _add(cells, key, (w, w * w))
        if self.ndim == 1 and both:
            xs = [p[0] for p, _ in both]
            s = s + Statistics(sum(x * w for (x,), w in both), sum(x * x * w for (x,), w in both), min(xs), max(xs), sum(w for _, w in both))
        return replace(out, cells=cells, stats=s, whole=self.whole and all(isinstance(w, int) for w in weights))

    def fill_n(self, df: DataFrame, *cols: str, weights: str | None = None, dropna: bool = True, transformed: bool = False) -> Histogram:
        """With the rows of a table more: one aggregate job, whose bins are added to these.

        A special histogram takes cartesian columns, unless they are transformed already.
        """
        if self.kind:
            df, cols = coords.transformed(df, self.kind, cols, transformed, [weights] if weights else [])
        if len(cols) != self.ndim:
            raise ValueError(f"{len(cols)} columns for {self.ndim} axes")
        grown = self
        if self.adaptive:
            numeric(df, *cols)
            df = without_missing(df, list(cols), dropna)
            ends = df.agg(*(f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max)))).first()
            if any(ends[f"lo{i}"] is None for i in range(self.ndim)):
                return self
            grown = self._grown([tuple(ends[f"{n}{i}"] for i in range(self.ndim)) for n in ("lo", "hi")])
        more = Histogram.of(df, *cols, bins=list(grown.axes), weights=weights, dropna=dropna, axis_names=self.axis_names, name=self.name, title=self.title, keep_missed=self.keep_missed)
        more = replace(more, kind=self.kind, radius=self.radius, meta=self.meta)
        return replace(grown + more, adaptive=self.adaptive, stats=INVALID if self.kind else grown.stats + more.stats)

    def _grown(self, points: list[tuple]) -> Histogram:
        axes, cells = [], dict(self.cells)
        for i, a in enumerate(self.axes):
            ks = [math.floor((p[i] - a.bins[0][0]) / a.rule[1]) for p in points]
            axis, back = _extended(a, min([0, *ks]), max([len(a) - 1, *ks]) + 1)
            moved = lambda k: k if k is None or k == -1 else k + back
            cells = {(*k[:i], moved(k[i]) if k[i] != len(a) else len(axis), *k[i + 1 :]): c for k, c in cells.items()}
            axes.append(axis)
        return replace(self, axes=tuple(axes), cells=cells)

    # --- kept elsewhere ------------------------------------------------------------------------------------
    def to_dict(self) -> dict:
        return {
            "version": 2, "type": "histogram", "kind": self.kind, "radius": self.radius, "name": self.name, "title": self.title, "axis_names": list(self.axis_names), "keep_missed": self.keep_missed,
            "whole": self.whole, "adaptive": self.adaptive, "meta": self.meta, "stats": vars(self.stats), "axes": [a.to_dict() for a in self.axes],
            "cells": [[list(k), *c] for k, c in sorted(self.cells.items(), key=repr)],
        }

    @staticmethod
    def from_dict(spark: SparkSession, d: dict) -> Histogram:
        if d["version"] > 2:
            raise ValueError(f"written by a newer version: {d['version']}")
        axes = tuple(map(B.Binning.from_dict, d["axes"]))
        cells = {tuple(k): (f, e) for k, f, e in d["cells"]}
        return Histogram(spark, axes, cells, tuple(d["axis_names"]), d["name"], d["title"], Statistics(**d["stats"]), d["keep_missed"], d["whole"], d["adaptive"], d["kind"], d["radius"], d.get("meta") or {})


def _every(shape: tuple[int, ...]) -> list[tuple[int, ...]]:
    out = [()]
    for n in shape:
        out = [(*k, i) for k in out for i in range(n)]
    return out


def _over(a: float, b: float) -> float:
    return a / b if b else math.nan if not a else math.copysign(math.inf, a)


def _add(cells: dict, key: tuple, c: Cell) -> None:
    f, e = cells.get(key, (0, 0))
    cells[key] = (f + c[0], e + c[1])


def _extended(a: B.Binning, low: int, high: int) -> tuple[B.Binning, int]:
    """A fixed-width axis that has bins low..high-1 of its own numbering, and by how much its old bins move."""
    first, width, shift = a.rule
    n = high - low
    if n > B.MOST_BINS:
        raise ValueError(f"{n} bins are too many")
    return B.equal_bins(first + low, width, shift, n, False), -low


def assert_histograms_equal(left: Histogram, right: Histogram, *, check_dtype: bool = True, check_frequencies: bool = True, check_bins: bool = True, check_binnings: bool = True, check_metadata: bool = True, rtol: float = 1e-7, atol: float = 0.0) -> None:
    """AssertionError, with the first difference, unless the histograms agree in what is checked."""
    if left.ndim != right.ndim or left.kind != right.kind:
        raise AssertionError(f"kinds differ: {left.ndim} axes, {left.kind} and {right.ndim} axes, {right.kind}")
    if check_dtype and left.whole != right.whole:
        raise AssertionError(f"types differ: whole frequencies {left.whole} and {right.whole}")
    near = lambda x, y: math.isclose(x, y, rel_tol=rtol, abs_tol=atol) or (math.isnan(x) and math.isnan(y))
    if left.shape != right.shape:
        raise AssertionError(f"shapes differ: {left.shape} and {right.shape}")
    if check_bins or check_binnings:
        for name, a, b in zip(left.axis_names, left.axes, right.axes):
            for k, (x, y) in enumerate(zip(a.bins, b.bins)):
                if not (near(x[0], y[0]) and near(x[1], y[1])):
                    raise AssertionError(f"axis {name}, bin {k}: {x} and {y}")
            if check_binnings and a.closed != b.closed:
                raise AssertionError(f"axis {name}: only one holds its last edge")
    if check_frequencies:
        for k in sorted(left.cells.keys() | right.cells.keys(), key=repr):
            if left._inside(k) and not near(left.cells.get(k, (0, 0))[0], right.cells.get(k, (0, 0))[0]):
                raise AssertionError(f"bin {k}: {left.cells.get(k, (0, 0))[0]} and {right.cells.get(k, (0, 0))[0]}")
    if check_metadata:
        told = lambda h: {"name": h.name, "title": h.title, "axis_names": h.axis_names, "radius": h.radius, **h.meta}
        if told(left) != told(right):
            raise AssertionError(f"metadata differ: {told(left)} and {told(right)}")


def cut(df: DataFrame, col: str, bins=10, name: str = "interval", **how) -> DataFrame:
    """df with the right-closed interval (left, right] that holds each value, null where none does."""
    from .infer import infer

    b = infer(df, col, bins, **how)
    x = F.col(col).cast("double")
    negated = B.from_edges([-e for e in reversed(b.edges)], closed=False)  # mirrored, right-closed bins are left-closed ones
    k = len(b) - 1 - negated.assign(-x)
    edges = F.array(*map(F.lit, b.edges))
    inside: Column = k.between(0, len(b) - 1)
    return df.withColumn(name, F.when(inside, F.struct(F.get(edges, k).alias("left"), F.get(edges, k + 1).alias("right"))))
