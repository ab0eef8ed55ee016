"""Coordinate transforms: columns that the N-D histogram then bins."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binforge.functions.binning import equal_width

from .hist import h


def radius(*xs: Column) -> Column:
    r = xs[0]
    for x in xs[1:]:
        r = F.hypot(r, x)
    return F.abs(r) if len(xs) == 1 else r


def azimuth(x: Column, y: Column) -> Column:
    return F.pmod(F.atan2(y, x), F.lit(2 * math.pi))


FULL = (0.0, 2 * math.pi)


def _even(bins, range_: tuple[float, float]):
    return equal_width(*range_, bins) if isinstance(bins, int) else bins


def inclination(x: Column, y: Column, z: Column) -> Column:
    return F.atan2(F.hypot(x, y), z)


# sizes of bins, from the columns leftI and rightI of the axes
def _width(i: int) -> Column:
    return F.col(f"right{i}") - F.col(f"left{i}")


def _powers(i: int, p: int) -> Column:
    return (F.col(f"right{i}") ** p - F.col(f"left{i}") ** p) / p


def _cap(i: int) -> Column:
    return F.cos(f"left{i}") - F.cos(f"right{i}")


def radial(df: DataFrame, x: str, y: str, z: str | None = None, bins=10, **how) -> DataFrame:
    d = df.select(radius(*(F.col(c) for c in (x, y, z) if c)).alias("r"), *_kept(how))
    size = math.pi * (F.col("right0") ** 2 - F.col("left0") ** 2)
    return h(d, ["r"], [bins], **how).withColumn("size", size)


def azimuthal(df: DataFrame, x: str, y: str, bins=16, range_=FULL, **how) -> DataFrame:
    d = df.select(azimuth(F.col(x), F.col(y)).alias("phi"), *_kept(how))
    return h(d, ["phi"], [_even(bins, range_)], **how).withColumn("size", _width(0))


def polar(df: DataFrame, x: str, y: str, radial_bins=10, phi_bins=16, phi_range=FULL, transformed: bool = False, **how) -> DataFrame:
    """Axis 0 is r, axis 1 is phi; size is the area of a bin. transformed: x and y are r and phi already."""
    r, phi = (F.col(x), F.col(y)) if transformed else (radius(F.col(x), F.col(y)), azimuth(F.col(x), F.col(y)))
    got = h(df.select(r.alias("r"), phi.alias("phi"), *_kept(how)), ["r", "phi"], [radial_bins, _even(phi_bins, phi_range)], **how)
    return got.withColumn("size", _powers(0, 2) * _width(1))


def spherical(df: DataFrame, x: str, y: str, z: str, radial_bins=10, theta_bins=16, phi_bins=16, theta_range=(0.0, math.pi), phi_range=FULL, **how) -> DataFrame:
    a, b, c = F.col(x), F.col(y), F.col(z)
    d = df.select(radius(a, b, c).alias("r"), inclination(a, b, c).alias("theta"), azimuth(a, b).alias("phi"), *_kept(how))
    got = h(d, ["r", "theta", "phi"], [radial_bins, _even(theta_bins, theta_range), _even(phi_bins, phi_range)], **how)
    return got.withColumn("size", _powers(0, 3) * _cap(1) * _width(2))


def spherical_surface(df: DataFrame, x: str, y: str, z: str, theta_bins=16, phi_bins=16, theta_range=(0.0, math.pi), phi_range=FULL, sphere: float = 1.0, **how) -> DataFrame:
    """Axis 0 is theta, axis 1 is phi; size is an area on a sphere of that radius."""
    a, b, c = F.col(x), F.col(y), F.col(z)
    d = df.select(inclination(a, b, c).alias("theta"), azimuth(a, b).alias("phi"), *_kept(how))
    got = h(d, ["theta", "phi"], [_even(theta_bins, theta_range), _even(phi_bins, phi_range)], **how)
    return got.withColumn("size", _cap(0) * _width(1) * sphere**2)


def cylindrical(df: DataFrame, x: str, y: str, z: str, rho_bins=10, phi_bins=16, z_bins=10, phi_range=FULL, **how) -> DataFrame:
    a, b = F.col(x), F.col(y)
    d = df.select(F.hypot(a, b).alias("rho"), azimuth(a, b).alias("phi"), F.col(z).alias("z"), *_kept(how))
    got = h(d, ["rho", "phi", "z"], [rho_bins, _even(phi_bins, phi_range), z_bins], **how)
    return got.withColumn("size", _powers(0, 2) * _width(1) * _width(2))


def cylindrical_surface(df: DataFrame, x: str, y: str, z: str, phi_bins=16, z_bins=10, phi_range=FULL, cylinder: float = 1.0, **how) -> DataFrame:
    """Axis 0 is phi, axis 1 is z; size is an area on a cylinder of that radius."""
    d = df.select(azimuth(F.col(x), F.col(y)).alias("phi"), F.col(z).alias("z"), *_kept(how))
    return h(d, ["phi", "z"], [_even(phi_bins, phi_range), z_bins], **how).withColumn("size", _width(0) * _width(1) * cylinder)


# --- coordinate systems by name, for histograms as objects ------------------------------------------
FULL_RANGES = {"phi": FULL, "theta": (0.0, math.pi)}
_COLUMNS = {
    "r": lambda x, y, *z: radius(x, y, *z), "rho": lambda x, y, *z: F.hypot(x, y), "phi": lambda x, y, *z: azimuth(x, y),
    "theta": inclination, "z": lambda x, y, z: z,
}
_POINTS = {
    "r": lambda *p: math.hypot(*p), "rho": lambda x, y, *z: math.hypot(x, y), "phi": lambda x, y, *z: math.atan2(y, x) % (2 * math.pi),
    "theta": lambda x, y, z: math.atan2(math.hypot(x, y), z), "z": lambda x, y, z: z,
}


@dataclass(frozen=True)
class Coordinates:
    """A coordinate system: its axes, each made from `sources` (a number, or several allowed) cartesian coordinates.

    columns, points: for each axis, a function of the source columns that gives a column, and of numbers that
    gives a number. size: of the bins, a column over leftI and rightI, from a radius. ranges: of axes that have a
    full one. projections: the system that some of the axes make up.
    """

    axes: tuple[str, ...]
    sources: tuple[int, ...]
    columns: Mapping[str, Callable[..., Column]]
    points: Mapping[str, Callable[..., float]]
    size: Callable[[float], Column] | None = None
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    projections: Mapping[tuple[str, ...], str] = field(default_factory=dict)

    def __post_init__(self):
        if not self.axes or len(set(self.axes)) < len(self.axes) or not self.sources:
            raise ValueError("a coordinate system has axes of different names and a number of sources")
        if missing := [a for a in self.axes if a not in self.columns or a not in self.points]:
            raise ValueError(f"no function for the axes {', '.join(missing)}")
        if any(a not in self.axes for kept in [*self.projections, self.ranges] for a in kept):
            raise ValueError("ranges and projections are of the system's axes")


SYSTEMS: dict[str, Coordinates] = {}


def register_coordinates(name: str, system: Coordinates) -> Coordinates:
    """Makes a system known as a kind of histogram, in place of one of that name."""
    SYSTEMS[name] = system
    return system


def _own(name: str, axes: tuple[str, ...], sources: tuple[int, ...], size: Callable[[float], Column], **projections: tuple[str, ...]) -> None:
    ranges = {a: FULL_RANGES[a] for a in axes if a in FULL_RANGES}
    register_coordinates(name, Coordinates(axes, sources, {a: _COLUMNS[a] for a in axes}, {a: _POINTS[a] for a in axes}, size, ranges, {v: k for k, v in projections.items()}))


_own("radial", ("r",), (2, 3), lambda _: math.pi * (F.col("right0") ** 2 - F.col("left0") ** 2))
_own("azimuthal", ("phi",), (2, 3), lambda _: _width(0))
_own("polar", ("r", "phi"), (2,), lambda _: _powers(0, 2) * _width(1), radial=("r",), azimuthal=("phi",))
_own("spherical", ("r", "theta", "phi"), (3,), lambda _: _powers(0, 3) * _cap(1) * _width(2), radial=("r",), spherical_surface=("theta", "phi"))
_own("spherical_surface", ("theta", "phi"), (3,), lambda r: _cap(0) * _width(1) * r**2)
_own("cylindrical", ("rho", "phi", "z"), (3,), lambda _: _powers(0, 2) * _width(1) * _width(2), radial=("rho",), azimuthal=("phi",), polar=("rho", "phi"), cylindrical_surface=("phi", "z"))
_own("cylindrical_surface", ("phi", "z"), (3,), lambda r: _width(0) * _width(1) * r, azimuthal=("phi",))


def system(kind: str) -> Coordinates:
    if kind not in SYSTEMS:
        raise ValueError(f"unknown kind {kind}")
    return SYSTEMS[kind]


def usual_bins(kind: str) -> list[int]:
    own = system(kind)
    return [16 if a in own.ranges else 10 for a in own.axes]


def even(bins, range_: tuple[float, float] | None):
    """Equal bins over a range where only a number of them is given."""
    return equal_width(*range_, bins) if isinstance(bins, int) and range_ else bins


def _known(kind: str, n: int, transformed: bool) -> Coordinates:
    own = system(kind)
    if n not in ((len(own.axes),) if transformed else own.sources):
        raise ValueError(f"{kind} isn't made from {n} coordinates")
    return own


def transformed(df: DataFrame, kind: str, cols, already: bool, keep: list[str]) -> tuple[DataFrame, tuple[str, ...]]:
    """Columns of the kind's axes, and their names."""
    own = _known(kind, len(cols), already)
    xs = [F.col(c).cast("double") for c in cols]
    made = xs if already else [own.columns[a](*xs) for a in own.axes]
    return df.select(*(x.alias(a) for a, x in zip(own.axes, made)), *keep), own.axes


def point(kind: str, value) -> tuple[float, ...]:
    """One point's coordinates."""
    own = _known(kind, len(value), False)
    return tuple(own.points[a](*value) for a in own.axes)


def projected(kind: str | None, axes: tuple[str, ...]) -> str | None:
    """The kind that the kept axes make up, if any."""
    return system(kind).projections.get(axes) if kind else None


def size_of(kind: str, r: float = 1.0) -> Column:
    """Sizes of bins, from the columns leftI and rightI: those of a system without sizes are products of widths."""
    own = system(kind)
    return own.size(r) if own.size else reduce(mul, map(_width, range(len(own.axes))))


def _kept(how: dict) -> list[str]:
    return [how["weights"]] if how.get("weights") else []
