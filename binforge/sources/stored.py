"""Histograms kept as Parquet tables that know what they are.

One format for tables and objects: a row a bin, with the binning and name of each axis, the closed side and rule among them, in the
metadata of its bin column, and names, title, kind, statistics and the like in that of frequency. An object's table has its occupied
bins and what no bin holds (-1 below, the number of bins above, null in a gap). Spark and any other reader see a plain table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binforge.functions import meta
from binforge.operators.histogram import MOST_ROWS, Histogram, Statistics

VERSION = 1


def to_table(h: Histogram) -> DataFrame:
    """binI, frequency, error2 of the occupied bins and of what was missed, with all else as metadata."""
    kind = "long" if h.whole else "double"
    cast = int if h.whole else float
    rows = [(*k, cast(f), float(e)) for k, (f, e) in h.cells.items()]
    names = [f"bin{i}" for i in range(h.ndim)]
    got = h.spark.createDataFrame(rows, ", ".join([*(f"{n} long" for n in names), f"frequency {kind}", "error2 double"]))
    whole = {
        "version": VERSION, "name": h.name, "title": h.title, "kind": h.kind, "radius": h.radius, "whole": h.whole, "adaptive": h.adaptive, "keep_missed": h.keep_missed,
        "meta": h.meta, "stats": {k: repr(v) for k, v in vars(h.stats).items()},  # as text: JSON has no infinities
    }
    return meta.described(got, [{"name": n, "n": len(a), "binning": a.to_dict()} for n, a in zip(h.axis_names, h.axes)], whole)


def from_table(df: DataFrame) -> Histogram:
    """The histogram of a table of this format, or of one with its axes' metadata only, as h1() and h() give it."""
    axes, whole = meta.axes_of(df), meta.whole_of(df)
    binnings = [meta.binning_of(a) for a in axes]
    if not all(binnings):
        raise ValueError("the table's metadata doesn't have its binnings")
    if whole and whole["version"] > VERSION:
        raise ValueError(f"written by a newer version: {whole['version']}")
    keys = [f"bin{s}" for s in meta.suffixes(df)]
    found = df.where((F.col("frequency") != 0) | (F.col("error2") != 0)).select(*keys, "frequency", "error2").limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} occupied bins; keep it as a table")
    cells = {tuple(r[k] for k in keys): (r["frequency"], r["error2"]) for r in found}
    names = tuple(a.get("name") or f"axis{i}" for i, a in enumerate(axes))
    if not whole:
        return Histogram(df.sparkSession, tuple(binnings), cells, names, whole=df.schema["frequency"].dataType.typeName() == "long", keep_missed=False)
    stats = Statistics(**{k: float(v) for k, v in whole["stats"].items()})
    return Histogram(df.sparkSession, tuple(binnings), cells, names, whole["name"], whole["title"], stats, whole["keep_missed"], whole["whole"], whole["adaptive"], whole["kind"], whole["radius"], whole["meta"])


def save(h: Histogram | DataFrame, path: str, overwrite: bool = False) -> None:
    """A histogram, as an object or as a table with its metadata, as Parquet."""
    (to_table(h) if isinstance(h, Histogram) else h).write.mode("overwrite" if overwrite else "error").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load(spark: SparkSession, path: str) -> Histogram:
    return from_table(load_table(spark, path))


def go_on(spark: SparkSession, path: str, df: DataFrame, *cols: str, to: str, weights: str | None = None) -> Histogram:
    """The stored histogram filled with a table's rows more, stored at another path, so that a stop in between leaves the old one whole."""
    h = load(spark, path).fill_n(df, *cols, weights=weights)
    save(h, to)
    return h
