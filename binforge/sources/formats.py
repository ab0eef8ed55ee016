"""Histograms and binnings as dicts and JSON, to pandas and back, and from Geant4 CSV.

A histogram table is small: its bins come to the driver, never the data's rows.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binforge.functions.binning import Binning, equal_width
from binforge.operators.collection import Collection
from binforge.operators.histogram import INVALID, Histogram, Statistics

from . import stored

VERSION = 2


def binning_to_dict(b: Binning) -> dict:
    return b.to_dict()


def binning_from_dict(d: dict) -> Binning:
    return Binning.from_dict(d)


def to_dict(hist: DataFrame | Histogram | Collection, **meta) -> dict:
    """A histogram of any dimension or a collection; `meta` goes with a table, which keeps its columns' metadata too."""
    if not isinstance(hist, DataFrame):
        return hist.to_dict()
    order = [c for c in hist.columns if c == "name" or c.startswith("bin")]
    rows = [r.asDict() for r in hist.orderBy(*order).collect()]
    return {"version": VERSION, "type": "table", "schema": hist.schema.jsonValue(), "rows": rows, "meta": meta}


def from_dict(spark: SparkSession, d: dict) -> DataFrame | Histogram | Collection:
    """What to_dict() was given: a table, a Histogram or a Collection."""
    from pyspark.sql.types import StructType

    if d.get("version", 0) > VERSION:
        raise ValueError(f"written by a newer version: {d['version']}")
    kind = d.get("type") or ("table" if "schema" in d else "histogram")
    if kind == "collection":
        return Collection.from_dict(spark, d)
    if kind == "histogram":
        return Histogram.from_dict(spark, d)
    if kind != "table":
        raise ValueError(f"unknown type {kind}")
    schema = StructType.fromJson(d["schema"])
    return spark.createDataFrame([tuple(r[f] for f in schema.names) for r in d["rows"]], schema)


def to_json(hist: DataFrame | Histogram | Collection, **meta) -> str:
    return json.dumps(to_dict(hist, **meta))


def from_json(spark: SparkSession, text: str) -> DataFrame | Histogram | Collection:
    return from_dict(spark, json.loads(text))


def save_json(hist: DataFrame | Histogram | Collection, path: str, **meta) -> None:
    hist_spark = hist.sparkSession if isinstance(hist, DataFrame) else hist.spark
    hist_spark.createDataFrame([(to_json(hist, **meta),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> DataFrame | Histogram | Collection:
    return from_json(spark, spark.read.text(path, wholetext=True).first()[0])


def as_histogram(hist: DataFrame) -> Histogram:
    """The object of a table that knows its axes."""
    return stored.from_table(hist)


def to_pandas(hist: DataFrame) -> pd.DataFrame:
    """frequency and error of a 1-D histogram over left-closed intervals."""
    d = hist.orderBy("bin").toPandas()
    at = pd.IntervalIndex.from_arrays(d["left"], d["right"], closed="left")
    return pd.DataFrame({"frequency": d["frequency"].to_numpy(), "error": d["error2"].to_numpy() ** 0.5}, index=at)


def binning_from_index(index: pd.IntervalIndex) -> Binning:
    if index.closed != "left":
        raise ValueError("intervals must be closed on the left")
    if index.is_overlapping:
        raise ValueError("intervals must not overlap")
    return Binning(tuple((float(i.left), float(i.right)) for i in index), closed=False)


def binning_to_index(b: Binning) -> pd.IntervalIndex:
    """Left-closed intervals; bins with gaps between them are refused."""
    if not b.consecutive:
        raise ValueError("bins with gaps have no interval index")
    return pd.IntervalIndex.from_breaks(b.edges, closed="left")


def to_series(hist: DataFrame) -> pd.Series:
    return to_pandas(hist)["frequency"]


def read_geant4(spark: SparkSession, path: str) -> Histogram:
    """A Geant4 CSV of one or two axes, with its title and, of one axis, its moments and what lies outside."""
    lines = [r[0] for r in spark.read.text(path).collect()]  # one histogram's file
    meta = [x[1:].split(" ", 1) for x in lines if x.startswith("#")]
    said = lambda key: [v for k, *rest in meta for v in rest if k == key]
    n_axes = int(said("dimension")[0])
    if n_axes not in (1, 2):
        raise ValueError(f"files of one or two axes are read, not of {n_axes}")
    axes = []
    for a in said("axis"):
        kind, n, lo, hi = a.split()
        if kind != "fixed":
            raise ValueError(f"unknown kind of axis {kind}")
        axes.append(equal_width(float(lo), float(hi), int(n)))
    rows = []
    for x in lines:
        try:
            rows.append([float(v) for v in x.split(",")])
        except ValueError:  # a line of names
            continue
    sizes = [len(a) + 2 for a in axes]
    if len(axes) != n_axes or len(rows) != math.prod(sizes):
        raise ValueError("a row for each bin, underflow and overflow are needed")
    cells = {}
    for k, r in enumerate(rows):
        key = (k - 1,) if n_axes == 1 else (k // sizes[1] - 1, k % sizes[1] - 1)
        if r[1] or r[2]:
            cells[key] = (r[1], r[2])
    inner = [r for k, r in enumerate(rows) if n_axes == 1 and 0 < k < sizes[0] - 1]
    stats = Statistics(sum=sum(r[3] for r in inner), sum2=sum(r[4] for r in inner), weight=sum(r[1] for r in inner)) if n_axes == 1 else INVALID
    title = (said("title") or [None])[0]
    return Histogram(spark, tuple(axes), cells, tuple(f"axis{i}" for i in range(n_axes)), title, title, stats, whole=False)


def load_geant4(spark: SparkSession, path: str) -> DataFrame:
    """bin, left, right, frequency, error2 of a 1-D Geant4 CSV; bin -1 is the underflow, n the overflow (no edges)."""
    lines = [r[0] for r in spark.read.text(path).collect()]  # one histogram's file
    axes = [x.split()[1:] for x in lines if x.startswith("#axis")]
    if len(axes) != 1:
        raise ValueError("a file of one axis is read")
    kind, n, lo, hi = axes[0][0], int(axes[0][1]), float(axes[0][2]), float(axes[0][3])
    if kind != "fixed":
        raise ValueError(f"unknown kind of axis {kind}")
    rows = [x.split(",") for x in lines if x and not x.startswith("#")]
    rows = rows[1:] if not rows[0][0].replace(".", "").isdigit() else rows
    if len(rows) != n + 2:
        raise ValueError("a row for each bin, underflow and overflow are needed")
    step = (hi - lo) / n
    out = [(k - 1, lo + (k - 1) * step if 0 < k <= n else None, lo + k * step if 0 < k <= n else None, float(r[1]), float(r[2])) for k, r in enumerate(rows)]
    return spark.createDataFrame(out, "bin long, left double, right double, frequency double, error2 double")


def geo_json(hist: DataFrame) -> str:
    """A 2-D histogram (latitude by longitude) as GeoJSON rectangles."""
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(F.array(corner("left1", "left0"), corner("right1", "left0"), corner("right1", "right0"), corner("left1", "right0"), corner("left1", "left0")))
    rows = hist.select(ring.alias("ring"), "frequency").collect()
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"frequency": r["frequency"]}, "geometry": {"type": "Polygon", "coordinates": r["ring"]}} for r in rows]})
