"""What a histogram table says of itself: metadata of its columns, which Parquet keeps.

Each axis's bin column has its binning, its name or, of adaptive tables, width and shift; the frequency column
has what belongs to the whole histogram.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binning import Binning

AXIS, WHOLE = "binforge.axis", "binforge.histogram"
#: Listed edges up to this number stand in metadata; of more, the number alone. Bins by a rule are computed.
MOST_LISTED = 10_000


def suffixes(hist: DataFrame) -> list[str]:
    """Of the axes' columns: "" for bin, left, right; "0", "1", ... in N-D."""
    return [""] if "bin" in hist.columns else [c[3:] for c in hist.columns if c.startswith("bin") and c[3:].isdigit()]


def of_binning(b: Binning, name: str | None = None) -> dict:
    listed = b.rule or len(b) <= MOST_LISTED
    return {"name": name, "n": len(b)} | ({"binning": b.to_dict()} if listed else {})


def of_width(width: float, shift: float, name: str | None = None) -> dict:
    return {"name": name, "width": float(width), "shift": float(shift)}


def described(hist: DataFrame, axes: list[dict | None], whole: dict | None = None) -> DataFrame:
    """hist with what is known of its axes, and of all of it."""
    told = {f"bin{s}": {AXIS: json.dumps(a)} for s, a in zip(suffixes(hist), axes, strict=True) if a}
    if whole is not None:
        told["frequency"] = {WHOLE: json.dumps(whole)}  # text, as Spark's metadata holds no nested lists
    return hist.select(*(F.col(c).alias(c, metadata=told[c]) if c in told else F.col(c) for c in hist.columns))


def axes_of(hist: DataFrame) -> list[dict | None]:
    """What is known of each axis, None where nothing is."""
    return [json.loads(hist.schema[f"bin{s}"].metadata.get(AXIS, "null")) for s in suffixes(hist)]


def binning_of(axis: dict | None) -> Binning | None:
    return Binning.from_dict(axis["binning"]) if axis and "binning" in axis else None


def whole_of(hist: DataFrame) -> dict | None:
    return json.loads(hist.schema["frequency"].metadata.get(WHOLE, "null"))
