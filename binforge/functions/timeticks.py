"""Ticks of an axis in seconds: a level (how many of which unit), the ticks at its multiples, and their texts."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from datetime import timedelta

from .binning import TIME_LIMITS, Binning, pretty_time_width, pretty_width

#: Seconds of the units, and the letters that a written level begins with.
UNITS = {"sec": 1, "min": 60, "hour": 3600, "day": 86400}
WRITTEN = {"s": "sec", "sec": "sec", "secs": "sec", "m": "min", "min": "min", "mins": "min", "h": "hour", "hour": "hour", "hours": "hour", "d": "day", "day": "day", "days": "day"}
#: Fixed value: a range has about so many ticks.
IDEAL = 6


def parse_level(value: str | tuple | float | timedelta) -> tuple[str, float]:
    """("min", 5) of "5min", of itself, of seconds or a timedelta; "edge" and "center" are of the bins."""
    if isinstance(value, tuple):
        if len(value) != 2 or value[0] not in UNITS or not isinstance(value[1], (int, float)):
            raise ValueError(f"no level: {value}")
        return value
    if isinstance(value, timedelta):
        value = value.total_seconds()
    if isinstance(value, (int, float)):
        if not value > 0:
            raise ValueError(f"no level: {value}")
        unit = next(u for u in ("day", "hour", "min", "sec") if value % UNITS[u] == 0 or u == "sec")
        return unit, value / UNITS[unit]
    if not isinstance(value, str):
        raise TypeError(f"no level: {value!r}")
    if found := re.fullmatch(r"(center|edge)s?", value):
        return found[1], 0
    if found := re.fullmatch(r"(\d*\.?\d*)([a-z]+)", value):
        unit = WRITTEN.get(found[2])
        whole = found[1].isdigit() or not found[1]
        if unit and found[1] != "." and (whole or unit in ("sec", "day")):
            count = float(found[1] or 1)
            return unit, int(count) if unit in ("min", "hour") else count
    raise ValueError(f"no level: {value}")


def level_of(lo: float, hi: float) -> tuple[str, float]:
    """The level whose ticks are nearest to IDEAL over a range of seconds."""
    raw = (hi - lo) / IDEAL
    if not raw > 0:
        raise ValueError("a range begins before it ends")
    for (limit, steps, _), unit in zip(TIME_LIMITS, ("sec", "sec", "min", "hour")):
        if raw < limit:
            return unit, pretty_width(raw) if steps is None else pretty_time_width(raw) / UNITS[unit]
    return "day", pretty_width(raw / UNITS["day"])


def ticks(lo: float, hi: float, level: tuple[str, float] | None = None, binning: Binning | None = None) -> list[float]:
    """Multiples of the level from lo to hi; for "edge" and "center" those of the bins."""
    unit, count = level or level_of(lo, hi)
    if unit in ("edge", "center"):
        if binning is None:
            raise ValueError("ticks of bins need a binning")
        return binning.edges if unit == "edge" else [(a + b) / 2 for a, b in binning.bins]
    width = count * UNITS[unit]
    return [k * width for k in range(math.ceil(lo / width), math.floor(hi / width) + 1)]


def labels(at: Sequence[float], level: tuple[str, float]) -> list[str]:
    """Texts of ticks: days, or as much of hours, minutes and seconds as any of them needs; signs where one is negative."""
    short = lambda x: int(x) if x == int(x) else x
    if level[0] == "day":
        days = [t / UNITS["day"] for t in at]
        days = list(map(int, days)) if all(d == int(d) for d in days) else days
        return [f"{d} day{'' if d == 1 else 's'}" for d in days]
    parts = [(t < 0, int(abs(t) // 3600), int(abs(t) % 3600 // 60), short(abs(t) % 60)) for t in at]
    hours, minutes = any(h for _, h, _, _ in parts), any(h or m for _, h, m, _ in parts)
    seconds, signs = any(s for *_, s in parts) or not hours, any(n for n, *_ in parts)
    out = []
    for negative, h, m, s in parts:
        shown = [str(h)] * hours + [f"{m:02d}" if hours else str(m)] * minutes + [str(s).zfill(2) if minutes else str(s)] * seconds
        out.append(("-" if negative else "+") * signs + ":".join(shown))
    return out
