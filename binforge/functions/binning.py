"""Bin schemas of one axis and the column expression that places a value in them.

Index contract of ``assign``: -1 below the first edge, 0..n-1 inside, n above the
last edge, null in a gap or for null and NaN. Bins are [left, right); the last one
also holds its right edge where ``closed``.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Up to this many bins of uneven width are a tree of comparisons in generated code; more are searched in an array.
TREE = 256


@dataclass(frozen=True, eq=False)
class EqualBins(Sequence):
    """n bins whose k-th edge is (first + k) * width + shift, but for the last one where `last` puts it right; none is held."""

    first: float
    width: float
    shift: float
    n: int
    last: float

    def __len__(self) -> int:
        return self.n

    def edge(self, k: int) -> float:
        return self.last if k == self.n else (self.first + k) * self.width + self.shift

    def __getitem__(self, k):
        if isinstance(k, slice):
            return tuple((self.edge(i), self.edge(i + 1)) for i in range(self.n)[k])
        k = range(self.n)[k]
        return self.edge(k), self.edge(k + 1)

    def __iter__(self) -> Iterator[tuple[float, float]]:
        return ((self.edge(k), self.edge(k + 1)) for k in range(self.n))

    def __eq__(self, other) -> bool:
        return len(self) == len(other) and all(a == b for a, b in zip(self, other))

    def __hash__(self) -> int:
        return hash((self.n, self.edge(0), self.last))


@dataclass(frozen=True)
class Binning:
    """Rising, non-overlapping bins.

    rule: (first, width, shift) of bins whose k-th edge is (first + k) * width + shift, but for a last one that
    `bins` may have put right. Their index and edges are computed, so no list of them stands in a plan.
    """

    bins: Sequence[tuple[float, float]]  # a tuple, or EqualBins where a rule computes them
    closed: bool = True
    width: float | None = field(default=None, compare=False)  # of equal bins
    rule: tuple[float, float, float] | None = field(default=None, compare=False)

    def __post_init__(self):
        if not len(self.bins):
            raise ValueError("a binning needs at least one bin")
        if isinstance(self.bins, EqualBins):
            ends = [self.bins[k] for k in (0, max(0, len(self.bins) - 2), len(self.bins) - 1)]  # the others are as wide as the first
            if any(not a < b for a, b in ends):
                raise ValueError("bins must rise and not overlap")
            return
        if any(a >= b for a, b in self.bins) or any(x[1] > y[0] for x, y in zip(self.bins, self.bins[1:])):
            raise ValueError("bins must rise and not overlap")

    def __len__(self) -> int:
        return len(self.bins)

    def kept(self, index) -> list[int]:
        """The bins that a slice, a list of indices or a mask keeps, in order."""
        n = len(self.bins)
        if isinstance(index, slice):
            if index.step not in (None, 1):
                raise IndexError("the order of bins can't change")
            return list(range(n)[index])
        index = list(index)
        if index and isinstance(index[0], bool):
            if len(index) != n:
                raise IndexError("a mask needs a value for each bin")
            return [k for k, on in enumerate(index) if on]
        kept = [range(n)[k] for k in index]
        if any(b <= a for a, b in zip(kept, kept[1:])):
            raise IndexError("the order of bins can't change")
        return kept

    def __getitem__(self, index) -> Binning:
        """The bins of a slice, a list of indices or a mask; edges are no longer computed."""
        return Binning(tuple(self.bins[k] for k in self.kept(index)), self.closed)

    @property
    def consecutive(self) -> bool:
        return isinstance(self.bins, EqualBins) or all(x[1] == y[0] for x, y in zip(self.bins, self.bins[1:]))

    @property
    def regular(self) -> bool:
        """Whether all bins have the same width, up to rounding."""
        if isinstance(self.bins, EqualBins):
            return math.isclose(self.bins[-1][1] - self.bins[-1][0], self.bins.width, rel_tol=1e-9)
        w = [b - a for a, b in self.bins]
        return self.consecutive and all(math.isclose(x, w[0], rel_tol=1e-9) for x in w)

    @property
    def edges(self) -> list[float]:
        if not self.consecutive:
            raise ValueError("bins with gaps have no single list of edges")
        return [self.bins[0][0], *(b for _, b in self.bins)]

    @property
    def edges_with_gaps(self) -> tuple[list[float], list[int]]:
        """Edges of the bins and of the gaps between them, and which of the stretches are bins."""
        edges, mask = [self.bins[0][0]], []
        for a, b in self.bins:
            if a != edges[-1]:
                edges.append(a)
            mask.append(len(edges) - 1)
            edges.append(b)
        return edges, mask

    def within(self, other: Binning) -> bool:
        """Whether each bin is one of the other's."""
        theirs = set(other.bins)
        return all(b in theirs for b in self.bins)

    @property
    def total_width(self) -> float:
        return self.bins[-1][1] - self.bins[0][0] if isinstance(self.bins, EqualBins) else sum(b - a for a, b in self.bins)

    def same(self, other: Binning) -> bool:
        """Whether the edges are equal, up to rounding."""
        near = lambda x, y: abs(x - y) <= 1e-8 + 1e-5 * abs(y)
        if self.rule and self.rule == other.rule and len(self.bins) == len(other.bins):
            return near(self.bins[-1][1], other.bins[-1][1])
        return len(self.bins) == len(other.bins) and all(near(a, c) and near(b, d) for (a, b), (c, d) in zip(self.bins, other.bins))

    def as_static(self) -> Binning:
        return Binning(tuple(self.bins), self.closed)

    def as_fixed_width(self) -> Binning:
        """As bins of one width, whose index is computed; ValueError where widths differ."""
        if not self.regular:
            raise ValueError("bins of differing widths can't be of one width")
        lo, hi = self.bins[0]
        width = self.width or hi - lo
        exact = all(k * width + lo == a for k, (a, _) in enumerate(self.bins))
        return Binning(self.bins, self.closed, width, self.rule or ((0.0, width, lo) if exact else None))

    def find(self, x: float) -> int | None:
        """The bin of a value: -1 below, the number of bins above, None in a gap or for NaN. The last right edge belongs to the last bin."""
        if not isinstance(x, (int, float)):
            raise ValueError(f"a number is needed, not {x!r}")
        if math.isnan(x):
            return None
        k = bisect.bisect_right(self.bins, x, key=lambda b: b[0]) - 1
        if k < 0:
            return -1
        if x < self.bins[k][1]:
            return k
        if k == len(self.bins) - 1:
            return k if x == self.bins[k][1] else len(self.bins)
        return None

    def to_dict(self) -> dict:
        """What makes the binning; edges only where no rule computes them."""
        own = {"count": len(self.bins), "last": self.bins[-1][1]} if isinstance(self.bins, EqualBins) else {"bins": [list(b) for b in self.bins]}
        return own | {"closed": self.closed, "width": self.width, "rule": list(self.rule) if self.rule else None}

    @staticmethod
    def from_dict(d: dict) -> Binning:
        rule = tuple(map(float, d["rule"])) if d.get("rule") else None
        if "count" in d:
            return equal_bins(*rule, d["count"], d["closed"], d["last"])
        return Binning(tuple((float(x), float(y)) for x, y in d["bins"]), d["closed"], d["width"], rule)

    def edge(self, k: Column) -> Column:
        """The k-th edge of bins with a rule."""
        first, width, shift = self.rule
        e = (F.lit(float(first)) + k.cast("double")) * F.lit(float(width)) + F.lit(float(shift))
        n, last = len(self.bins), self.bins[-1][1]
        return e if last == (first + n) * width + shift else F.when(k == n, F.lit(last)).otherwise(e)

    def assign(self, x: Column) -> Column:
        x = x.cast("double")
        n, lo, last = len(self.bins), self.bins[0][0], self.bins[-1][1]
        over = x > last if self.closed else x >= last
        if self.rule:
            # arithmetic guess, put right by one where rounding misplaced it
            guess = F.least(F.greatest(F.floor((x - F.lit(lo)) / F.lit(self.rule[1])), F.lit(0)), F.lit(n - 1))
            k = guess + F.when(self.edge(guess) > x, -1).when((self.edge(guess + 1) <= x) & (guess < n - 1), 1).otherwise(0)
            inside = k
        else:
            lefts = [a for a, _ in self.bins]
            k = _search(x, lefts, 0, n) if n <= TREE else _bisect(x, lefts)
            inside = k if self.consecutive else F.when(x < F.get(F.array(*(F.lit(b) for _, b in self.bins)), k), k)
        out = F.when(x < lo, F.lit(-1)).when(over, F.lit(n)).when(x == last, F.lit(n - 1)).otherwise(inside)
        return F.when(x.isNotNull() & ~F.isnan(x), out).cast("long")

    def grid(self, spark: SparkSession, suffix: str = "") -> DataFrame:
        names = [f"{c}{suffix}" for c in ("bin", "left", "right")]
        if self.rule:
            k = F.col("id")
            return spark.range(len(self.bins)).select(k.alias(names[0]), self.edge(k).alias(names[1]), self.edge(k + 1).alias(names[2]))
        return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(self.bins)], f"{names[0]} long, {names[1]} double, {names[2]} double")


def _search(x: Column, lefts: list[float], lo: int, hi: int) -> Column:
    """Index of the last left edge not above x, as a balanced tree of comparisons."""
    if hi - lo == 1:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(x < lefts[mid], _search(x, lefts, lo, mid)).otherwise(_search(x, lefts, mid, hi))


def _bisect(x: Column, lefts: list[float]) -> Column:
    """The same for many edges: halving steps over one array."""
    edges = F.array(*map(F.lit, lefts))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(lefts)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        low = (s["hi"] - s["lo"] > 1) & (F.get(edges, mid) <= x)
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low | (s["hi"] - s["lo"] <= 1), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(lefts).bit_length() + 1)), start, step, lambda s: s["lo"])


def equal_bins(first: float, width: float, shift: float, n: int, closed: bool, last: float | None = None) -> Binning:
    """n bins by a rule; last: the right edge of the last one, where it is not to be computed."""
    rule = (float(first), float(width), float(shift))
    return Binning(EqualBins(*rule, n, float(last) if last is not None else (rule[0] + n) * rule[1] + rule[2]), closed, float(width), rule)


def from_edges(edges, closed: bool = True, width: float | None = None, rule: tuple[float, float, float] | None = None) -> Binning:
    edges = [float(e) for e in edges]
    return Binning(tuple(zip(edges, edges[1:])), closed, width, rule)


def as_binning(bins) -> Binning:
    """A binning of itself, of edges, or of pairs of edges, in lists or arrays."""
    return bins if isinstance(bins, Binning) else static(bins.tolist() if hasattr(bins, "tolist") else bins)


def is_rising(edges) -> bool:
    """Whether edges rise, or pairs of them, without overlaps."""
    try:
        as_binning(edges)
    except ValueError:
        return False
    return True


def static(bins) -> Binning:
    bins = list(bins)
    return Binning(tuple((float(a), float(b)) for a, b in bins)) if isinstance(bins[0], (tuple, list)) else from_edges(bins)


#: More bins than this are refused, where a width or a count would ask for them.
MOST_BINS = 50_000_000


def _checked(n: int) -> int:
    if n > MOST_BINS:
        raise ValueError(f"{n} bins are too many: more than {MOST_BINS}")
    return n


def equal_width(lo: float, hi: float, n: int) -> Binning:
    if not isinstance(n, int) or n < 1:
        raise ValueError("a positive number of bins is needed")
    if not (math.isfinite(lo) and math.isfinite(hi) and math.isfinite(hi - lo)) or lo >= hi:
        raise ValueError("equal bins need a finite range of more than one value")
    step = (hi - lo) / _checked(n)
    return equal_bins(0.0, step, lo, n, True, hi)


def fixed_width(lo: float, hi: float, width: float, align: bool = True, shift: float = 0.0, closed: bool = False) -> Binning:
    """Bins of one width that hold lo and hi, at multiples of it, or from lo where align is off."""
    if width <= 0:
        raise ValueError("a positive width is needed")
    _checked(math.ceil((hi - lo) / width))
    first = math.floor((lo - shift) / width)
    if not align:  # bins from lo itself
        n = max(1, math.ceil((hi - lo) / width))
        n += not closed and lo + n * width <= hi
        return equal_bins(0.0, width, lo, n, closed)
    n = max(0, math.ceil((hi - (first * width + shift)) / width))
    if n == 0 or (not closed and (first + n) * width + shift == hi):
        n += 1
    return equal_bins(first, width, shift, n, closed)


def pretty_width(raw: float) -> float:
    p = math.floor(math.log10(raw))
    return min((s * 10.0**p for s in STEPS), key=lambda w: abs(math.log(w / raw)))


#: Steps of seconds and minutes, of hours, of other units.
SIXTIETHS, DAY_PARTS, STEPS = (1, 2, 5, 10, 15, 20, 30), (1, 2, 3, 4, 6, 12), (0.5, 1, 2, 2.5, 5, 10)
#: Up to so many seconds a width is in parts of a second, seconds, minutes, hours; beyond, in days.
TIME_LIMITS = ((0.8, None, 1), (50, SIXTIETHS, 1), (3000, SIXTIETHS, 60), (70000, DAY_PARTS, 3600))


def pretty_time_width(raw: float) -> float:
    """The nearest width, in seconds, that divides clock time well."""
    for limit, steps, unit in TIME_LIMITS:
        if raw < limit:
            return pretty_width(raw) if steps is None else min((float(s * unit) for s in steps), key=lambda w: abs(math.log(w / raw)))
    return pretty_width(raw / 86400) * 86400


def exponential(lo: float, hi: float, n: int) -> Binning:
    if lo <= 0:
        raise ValueError("exponential bins need positive values")
    a, step = math.log10(lo), (math.log10(hi) - math.log10(lo)) / n
    return from_edges([lo] + [10 ** (a + i * step) for i in range(1, n)] + [hi])


def _doane(n: int, skew: float) -> int:
    if n < 3:
        return 1
    sigma = math.sqrt(6 * (n - 2) / (n + 1) * (n + 3))  # not the textbook's: results must be those that users have
    return math.ceil(1 + math.log2(n) + math.log2(1 + abs(skew) / sigma))


#: Numbers of bins by rule, of n values and their skew.
BIN_COUNTS = {
    "sqrt": lambda n, _: math.ceil(math.sqrt(n)),
    "sturges": lambda n, _: math.ceil(math.log2(n)) + 1,
    "rice": lambda n, _: math.ceil(2 * n ** (1 / 3)),
    "doane": _doane,
    "default": lambda n, _: 7 if n <= 32 else BIN_COUNTS["sturges"](n, 0.0),
}


def ideal_bin_count(n: int, method: str = "default", skew: float = 0.0) -> int:
    if method not in BIN_COUNTS:
        raise ValueError(f"unknown method {method}")
    return BIN_COUNTS[method](n, skew) if n >= 1 else 1
