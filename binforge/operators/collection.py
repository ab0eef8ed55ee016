"""A collection: histograms of one axis with shared bins, by name or number.

`Collection.of` makes all members in one aggregate over the data; `create` adds one of another table's column in the bins that are
there. Names may be null and may repeat: a name means the first member that has it. Collections don't change: each method gives a
new one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binforge.functions import meta
from binforge.functions.binning import Binning

from .histogram import MOST_ROWS, Histogram, Statistics
from .infer import infer, numeric


@dataclass(frozen=True)
class Collection:
    spark: SparkSession = field(repr=False, compare=False)
    binning: Binning
    members: tuple[Histogram, ...] = ()
    name: str | None = None
    title: str | None = None
    axis_name: str = "axis0"

    def __post_init__(self):
        if any(h.ndim != 1 or not h.axes[0].same(self.binning) for h in self.members):
            raise ValueError("the members of a collection share the bins of one axis")

    @staticmethod
    def from_histograms(*members: Histogram, name: str | None = None, title: str | None = None) -> Collection:
        if not members:
            raise ValueError("either members or a binning are needed")
        first = members[0]
        if first.ndim != 1:
            raise ValueError("the members of a collection have one axis")
        return Collection(first.spark, first.axes[0], members, name, title or name, first.axis_names[0])

    @staticmethod
    def of(df: DataFrame, by: str, col: str, bins=10, *, weights: str | None = None, name: str | None = None, title: str | None = None, **how) -> Collection:
        """A member for each value of `by`, null among them, in order, null last; what a member's bins don't hold is its missed."""
        numeric(df, col, *([weights] if weights else []))
        b = infer(df, col, bins, **how)
        x = F.col(col).cast("double")
        here = x.isNotNull() & ~F.isnan(x)
        w = F.when(here, F.col(weights).cast("double") if weights else F.lit(1))
        sums = {"frequency": F.sum(w), "error2": F.sum((w * w).cast("double")), "sum": F.sum(x * w), "sum2": F.sum(x * x * w), "min": F.min(F.when(here, x)), "max": F.max(F.when(here, x))}
        # a null bin is a gap's or a missing value's: told apart, as a member without values has to be there too
        got = df.groupBy(F.col(by).cast("string").alias("name"), here.alias("here"), F.when(here, b.assign(F.col(col))).alias("bin")).agg(*(v.alias(k) for k, v in sums.items()))
        rows = got.limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise ValueError(f"more than {MOST_ROWS} occupied bins; hist.collection() keeps them as a table")
        cells: dict = {}
        for r in rows:
            own = cells.setdefault(r["name"], ({}, []))
            if r["here"]:
                own[0][(r["bin"],)] = (r["frequency"], r["error2"])
                own[1].append(Statistics(r["sum"], r["sum2"], r["min"], r["max"], float(r["frequency"])))
        whole = not weights or df.schema[weights].dataType.typeName() not in ("float", "double", "decimal")
        members = tuple(Histogram(df.sparkSession, (b,), c, (col,), n, stats=sum(s, Statistics()), whole=whole) for n, (c, s) in sorted(cells.items(), key=lambda m: (m[0] is None, m[0] or "")))
        return Collection(df.sparkSession, b, members, name, title or name, col)

    @staticmethod
    def multi(spark: SparkSession, columns: dict[str, tuple[DataFrame, str]], bins=10, *, name: str | None = None, title: str | None = None, **how) -> Collection:
        """A member for each (table, column), over bins of all their values: one pass to find these, one to count."""
        if not columns:
            raise ValueError("at least one column is needed")
        parts = [d.select(F.lit(k).alias("name"), F.col(c).cast("double").alias("axis0")) for k, (d, c) in columns.items()]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        got = Collection.of(every, "name", "axis0", bins, name=name, title=title, **how)
        return replace(got, members=tuple(got[k] if k in got else Histogram.empty(spark, got.binning, axis_names=["axis0"], name=k) for k in columns))

    # --- as a container ------------------------------------------------------------------------------
    def __len__(self) -> int:
        return len(self.members)

    def __iter__(self) -> Iterator[Histogram]:
        return iter(self.members)

    def __getitem__(self, which: int | str | None) -> Histogram:
        if isinstance(which, int):
            return self.members[which]
        found = [h for h in self.members if h.name == which]
        if not found:
            raise KeyError(f"no histogram named {which!r}")
        return found[0]

    def __contains__(self, which) -> bool:
        """Of a name, or of a number of a member."""
        return -len(self) <= which < len(self) if isinstance(which, int) else any(h.name == which for h in self.members)

    @property
    def names(self) -> list[str | None]:
        return [h.name for h in self.members]

    def __eq__(self, other) -> bool:
        return isinstance(other, Collection) and self.binning.same(other.binning) and len(self) == len(other) and all(a == b for a, b in zip(self, other))

    __hash__ = None

    # --- grown ---------------------------------------------------------------------------------------
    def add(self, h: Histogram) -> Collection:
        return replace(self, members=(*self.members, h))

    def create(self, name: str | None, df: DataFrame, col: str, *, weights: str | None = None, dropna: bool = True, **more) -> Collection:
        """With a member of a table's column more, in the collection's bins."""
        return self.add(Histogram.of(df, col, bins=self.binning, weights=weights, dropna=dropna, name=name, axis_names=[self.axis_name], **more))

    # --- over all members ------------------------------------------------------------------------------
    def sum(self) -> Histogram:
        total = Histogram.empty(self.spark, self.binning, axis_names=[self.axis_name])
        for k, h in enumerate(self.members):
            total = total + h if k else h
        return replace(total, name=self.name, title=self.title)

    def normalize_all(self) -> Collection:
        """Each member adds up to 1."""
        return replace(self, members=tuple(h.normalize() for h in self.members))

    def normalize_bins(self) -> Collection:
        """Each bin adds up to 1 over all members; a bin that none has anything in stays empty."""
        total = self.sum().cells
        share = lambda k, c: (c[0] / total[k][0], c[1] / total[k][0] ** 2) if total[k][0] else (0.0, 0.0)
        inside = lambda h: {k: share(k, c) for k, c in h.cells.items() if h._inside(k)}
        return replace(self, members=tuple(replace(h, cells=inside(h), whole=False, keep_missed=False) for h in self.members))

    def table(self) -> DataFrame:
        """number, name, bin, left, right, frequency, error2: all bins of all members."""
        kind = "long" if all(h.whole for h in self.members) else "double"
        cast = int if kind == "long" else float
        rows = [(i, h.name, *k, cast(f), float(e)) for i, h in enumerate(self.members) for k, (f, e) in h.cells.items() if h._inside(k)]
        got = self.spark.createDataFrame(rows, f"number int, name string, bin long, frequency {kind}, error2 double")
        every = self.spark.createDataFrame([(i, h.name) for i, h in enumerate(self.members)], "number int, name string")
        n = len(self.binning)
        full = every.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).join(got.drop("name"), ["number", "bin"], "left").join(self.binning.grid(self.spark), "bin")
        zero = F.lit(0).cast(kind)
        out = full.select("number", "name", "bin", "left", "right", F.coalesce("frequency", zero).alias("frequency"), F.coalesce("error2", F.lit(0.0)).alias("error2"))
        return meta.described(out, [meta.of_binning(self.binning, self.axis_name)])

    # --- kept elsewhere ----------------------------------------------------------------------------------
    def to_dict(self) -> dict:
        return {"version": 2, "type": "collection", "name": self.name, "title": self.title, "axis_name": self.axis_name, "binning": self.binning.to_dict(), "histograms": [h.to_dict() for h in self.members]}

    @staticmethod
    def from_dict(spark: SparkSession, d: dict) -> Collection:
        if d["version"] > 2:
            raise ValueError(f"written by a newer version: {d['version']}")
        return Collection(spark, Binning.from_dict(d["binning"]), tuple(Histogram.from_dict(spark, h) for h in d["histograms"]), d["name"], d["title"], d["axis_name"])
