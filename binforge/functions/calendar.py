"""Calendar bins: seconds to years, and several of each, of uneven length where the calendar is.

A timestamp's bin is a whole number of its unit since 1970 (years from year 0), so histograms of two tables add up by key. A
timestamp with a time zone is read by the session's clock; one without (timestamp_ntz) and a date as they stand.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import meta
from .binning import MOST_BINS

#: Seconds of the units of one length.
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400}
#: Months of the units of uneven length.
MONTHS = {"month": 1, "quarter": 3, "year": 12}
#: How many of each unit a level may have, from fine to coarse.
LEVELS = (
    ("second", (1, 2, 5, 10, 15, 20, 30)), ("minute", (1, 2, 5, 10, 15, 20, 30)), ("hour", (1, 2, 3, 4, 6, 12)), ("day", (1,)), ("week", (1, 2)),
    ("month", (1, 2)), ("quarter", (1, 2)), ("year", (1, 2, 5, 10, 20, 25, 50, 100, 200, 250, 500, 1000)),
)
EPOCH = datetime(1970, 1, 1)
MONDAY = 4 * 86400  # the first Monday after it, in seconds


@dataclass(frozen=True)
class Level:
    """`step` units of the calendar."""

    unit: str
    step: int = 1

    def __post_init__(self):
        if self.unit not in {**SECONDS, **MONTHS} or not isinstance(self.step, int) or self.step < 1:
            raise ValueError(f"no calendar bins of {self.step} {self.unit}")

    @property
    def seconds(self) -> float:
        """The usual length."""
        return self.step * (SECONDS.get(self.unit) or MONTHS[self.unit] * 365.2425 * 86400 / 12)

    def number(self, ts: Column) -> Column:
        """The bin of a timestamp or date."""
        if self.unit in MONTHS:
            months = F.year(ts) * 12 + F.month(ts) - 1 - (0 if self.unit == "year" else 1970 * 12)
            return F.floor(months / (MONTHS[self.unit] * self.step)).cast("long")
        shift = MONDAY if self.unit == "week" else 0
        # microseconds are left out before the division: a whole second is on one side of any edge
        seconds = F.timestamp_diff("SECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.date_trunc("SECOND", ts).cast("timestamp_ntz"))
        return F.floor((seconds - shift) / (SECONDS[self.unit] * self.step)).cast("long")

    def start(self, number: Column) -> Column:
        """The first moment of a bin, as timestamp_ntz."""
        if self.unit in MONTHS:
            months = number * (MONTHS[self.unit] * self.step) + (0 if self.unit == "year" else 1970 * 12)
            return F.make_timestamp_ntz(F.floor(months / 12).cast("int"), (months % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        shift = MONDAY if self.unit == "week" else 0
        return F.timestamp_add("SECOND", (number * (SECONDS[self.unit] * self.step) + shift).cast("long"), F.lit(EPOCH).cast("timestamp_ntz"))

    def number_of(self, t: datetime) -> int:
        """The same of one moment."""
        if self.unit in MONTHS:
            return (t.year * 12 + t.month - 1 - (0 if self.unit == "year" else 1970 * 12)) // (MONTHS[self.unit] * self.step)
        shift = MONDAY if self.unit == "week" else 0
        return ((t.replace(microsecond=0) - EPOCH) // timedelta(seconds=1) - shift) // (SECONDS[self.unit] * self.step)

    def start_of(self, number: int) -> datetime:
        if self.unit in MONTHS:
            year, month = divmod(number * MONTHS[self.unit] * self.step + (0 if self.unit == "year" else 1970 * 12), 12)
            return datetime(year, month + 1, 1)
        return EPOCH + timedelta(seconds=number * SECONDS[self.unit] * self.step + (MONDAY if self.unit == "week" else 0))


def level_of(lo: datetime, hi: datetime, most: int = 50) -> Level:
    """The finest level with at most `most` bins from lo to hi; the coarsest where none has."""
    if most < 1:
        raise ValueError("a positive number of bins is needed")
    if lo > hi:
        raise ValueError("a range begins before it ends")
    levels = [Level(unit, step) for unit, steps in LEVELS for step in steps]
    return next((v for v in levels if v.number_of(hi) - v.number_of(lo) < most), levels[-1])


def ticks(lo: datetime, hi: datetime, most: int = 10, level: Level | None = None) -> list[datetime]:
    """The starts of calendar bins from lo to hi, at most `most` of them where the level is left to choose."""
    level = level or level_of(lo, hi, most)
    first = level.number_of(lo)
    first += level.start_of(first) < lo
    return [level.start_of(k) for k in range(first, level.number_of(hi) + 1)]


def label_of(t: datetime, level: Level) -> str:
    """A tick's text: as much of the moment as its level tells apart."""
    if level.unit == "year":
        return f"{t.year}"
    if level.unit == "quarter":
        return f"{t.year} Q{(t.month + 2) // 3}"
    form = {"month": "%Y-%m", "week": "%Y-%m-%d", "day": "%Y-%m-%d", "hour": "%Y-%m-%d %H:%M", "minute": "%H:%M", "second": "%H:%M:%S"}[level.unit]
    return t.strftime(form)


def _moment(x) -> datetime:
    return datetime(x.year, x.month, x.day) if isinstance(x, date) and not isinstance(x, datetime) else x


def h1_calendar(df: DataFrame, col: str, level: Level | None = None, *, most: int = 50, weights: str | None = None) -> DataFrame:
    """bin, left, right (timestamp_ntz), frequency, error2 from the first to the last bin that holds a timestamp.

    Without a level, the data's range chooses it (one job). Nulls are left out; of no timestamps no bins are made.
    """
    kind = df.schema[col].dataType.typeName()
    if kind not in ("timestamp", "timestamp_ntz", "date"):
        raise ValueError(f"column {col} is of {kind}, not a timestamp or date")
    ts = F.col(col).cast("timestamp_ntz")
    d = df.where(F.col(col).isNotNull())
    if level is None:
        ends = d.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
        level = level_of(_moment(ends["lo"]), _moment(ends["hi"]), most) if ends["lo"] else Level("day")
    w = F.col(weights).cast("double") if weights else None
    sums = [F.count("*").alias("frequency"), F.count("*").cast("double").alias("error2")] if w is None else [F.sum(w).alias("frequency"), F.sum(w * w).alias("error2")]
    got = d.groupBy(level.number(ts).alias("bin")).agg(*sums)
    ends = got.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).where(F.col("lo").isNotNull())
    many = F.when(F.col("hi") - F.col("lo") >= MOST_BINS, F.raise_error(F.lit(f"more than {MOST_BINS} bins between the first and the last")).cast("long"))
    grid = ends.select(F.explode(F.sequence(F.coalesce(many, "lo"), "hi")).alias("bin"))
    full = grid.join(got, "bin", "left")
    zero = F.lit(0).cast(got.schema["frequency"].dataType)
    out = full.select("bin", level.start(F.col("bin")).alias("left"), level.start(F.col("bin") + 1).alias("right"), F.coalesce("frequency", zero).alias("frequency"), F.coalesce("error2", F.lit(0.0)).alias("error2"))
    return meta.described(out, [{"name": col, "calendar": {"unit": level.unit, "step": level.step}}])
