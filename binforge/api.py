"""Histograms of tables, and of small data that the driver holds already.

    from binforge import api
    api.h1(df, "x", "fixed_width", bin_width=5.0)
    api.h2(spark, [1, 2, 3], [4, 5, 6], bins=4)

A table's columns are named; lists, arrays, pandas Series and frames, given after a session, become a table first.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .operators.arithmetic import free_arithmetic
from .operators.collection import Collection
from .operators.histogram import Histogram, assert_histograms_equal, cut
from .operators.infer import register_binning

__all__ = ["Collection", "Histogram", "assert_histograms_equal", "cut", "free_arithmetic", "frame", "h", "h1", "h2", "h3", "register_binning", "special"]


def _column(values, name: str) -> pd.Series:
    s = values if isinstance(values, pd.Series) else pd.Series(np.asarray(list(values) if not hasattr(values, "__array__") else values).ravel())
    if pd.api.types.is_bool_dtype(s) or not pd.api.types.is_numeric_dtype(s):
        if len(s):
            raise ValueError(f"{name}: numbers are needed, not {s.dtype}")
    return s.astype("Float64").astype("float64").rename(str(s.name) if s.name is not None else name)


def frame(spark: SparkSession, *data, names: Sequence[str] | None = None) -> DataFrame:
    """A table of the columns given: Series, lists or arrays of one length, or one frame or array of two dimensions.

    Names are the Series' own, else axis0, axis1, ...; missing values stay missing.
    """
    if len(data) == 1 and isinstance(data[0], pd.DataFrame):
        columns = [_column(data[0][c], str(c)) for c in data[0].columns]
    elif len(data) == 1 and getattr(data[0], "ndim", 1) == 2:
        columns = [_column(c, f"axis{i}") for i, c in enumerate(np.asarray(data[0]).T)]
    else:
        if any(getattr(d, "ndim", 1) > 1 for d in data):
            raise ValueError("columns have one dimension")
        columns = [_column(d, f"axis{i}") for i, d in enumerate(data)]
    if len({len(c) for c in columns}) > 1:
        raise ValueError("columns are of different lengths")
    names = list(names or (c.name for c in columns))
    if len(names) != len(columns) or len(set(names)) < len(names):
        raise ValueError(f"{len(columns)} different names are needed")
    made = pd.DataFrame({n: c.reset_index(drop=True) for n, c in zip(names, columns)})
    return spark.createDataFrame(made, ", ".join(f"`{n}` double" for n in names))


def h(source: DataFrame | SparkSession, *data, bins=10, weights=None, dim: int | None = None, **how) -> Histogram:
    """Of a table's named columns, or, after a session, of data that frame() takes; weights alike."""
    if isinstance(source, DataFrame):
        d, cols = source, data
    else:
        d = frame(source, *data)
        cols = tuple(d.columns)
        if weights is not None:
            w = _column(weights, "weights")
            own = frame(source, *data).toPandas()
            if len(w) != len(own):
                raise ValueError("a weight is needed for each value")
            d, weights = source.createDataFrame(own.assign(_weight=w.to_numpy())), "_weight"
    if dim is not None and len(cols) != dim:
        raise ValueError(f"{len(cols)} columns for {dim} axes")
    return Histogram.of(d, *cols, bins=bins, weights=weights, **how)


def h1(source: DataFrame | SparkSession, data, bins=10, **how) -> Histogram:
    return h(source, data, bins=bins, dim=1, **how)


def h2(source: DataFrame | SparkSession, x, y, bins=10, **how) -> Histogram:
    return h(source, x, y, bins=bins, dim=2, **how)


def h3(source: DataFrame | SparkSession, x, y, z, bins=10, **how) -> Histogram:
    return h(source, x, y, z, bins=bins, dim=3, **how)


def special(source: DataFrame | SparkSession, kind: str, *data, **how) -> Histogram:
    """Of a kind of coords.SYSTEMS."""
    if isinstance(source, DataFrame):
        return Histogram.special(source, kind, *data, **how)
    d = frame(source, *data)
    return Histogram.special(d, kind, *d.columns, **how)


# names that users of older versions know
histogram, histogramdd = h1, h


def histogram2d(source, x, y, bins=10, **how) -> Histogram:
    return h2(source, x, y, bins, **how)


def polar_histogram(source, *data, **how) -> Histogram:
    return special(source, "polar", *data, **how)


def spherical_histogram(source, *data, **how) -> Histogram:
    return special(source, "spherical", *data, **how)


def cylindrical_histogram(source, *data, **how) -> Histogram:
    return special(source, "cylindrical", *data, **how)
