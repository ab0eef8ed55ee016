"""Exact quantiles of a column, any number of them over one shared partition of its values.

All ranks share the cells. At first there is one cell, from the least value to the greatest; each pass splits
every cell that still holds a wanted rank and too many values, by equal steps between its own least and greatest value, or, where that
left most of its values together, by a sketch of them. A pass is one aggregate job with a row for each cell. In the
end only the few cells that hold ranks are sorted, each by itself.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values that a cell may hold to be sorted in one task; cells of a pass, which come to the driver; cuts of a sketched cell.
BRACKET, CELLS, CUTS = 100_000, 65_536, 15


@dataclass
class Cell:
    """Values lo..hi, of which `below` smaller ones exist, `count` in number."""

    lo: float
    hi: float
    below: int
    count: int
    cuts: list[float] = field(default_factory=list)

    def steps(self, fan: int) -> float:
        """Steps for each unit of value, 0 where the cell can't be split by steps."""
        width = self.hi - self.lo
        scale = fan / width if width > 0 and math.isfinite(width) else 0.0
        return scale if math.isfinite(scale) else 0.0


def quantiles(df: DataFrame, col: str, at: Sequence[float], bracket: int = BRACKET) -> list[float]:
    """Exact quantiles with linear interpolation, of the values that are not missing."""
    x = F.col(col).cast("double")
    d = df.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"))
    row = d.agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    n = row["n"]
    if not n:
        raise ValueError("quantiles of no values")
    if any(not 0 <= q <= 1 for q in at):
        raise ValueError("quantiles are between 0 and 1")
    ranks = sorted({r for q in at for r in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))})
    value = _values(d, ranks, Cell(row["lo"], row["hi"], 0, n), bracket)
    out = []
    for q in at:
        p = q * (n - 1)
        a, b = value[math.floor(p)], value[math.ceil(p)]
        out.append(a + (b - a) * (p - math.floor(p)) if a != b else a)
    return out


def _values(d: DataFrame, ranks: list[int], whole: Cell, bracket: int) -> dict[int, float]:
    """The values of the ranks (from 0) of d's column x."""
    value: dict[int, float] = {}
    cells = {0: whole}
    placed = d.withColumn("cell", F.lit(0))
    while True:
        cells, wanted = _needed(cells, [r for r in ranks if r not in value], value)
        if not wanted:
            return value
        if all(c.count <= bracket for c in cells.values()):
            break
        placed, cells = _split(placed, cells, bracket)
    sent = d.sparkSession.createDataFrame([(k, r - cells[k].below + 1, r) for k, own in wanted.items() for r in own], "cell int, nth int, rank long")
    kept = d.sparkSession.createDataFrame([(k,) for k in cells], "cell int")
    rows = placed.join(F.broadcast(kept), "cell").withColumn("nth", F.row_number().over(Window.partitionBy("cell").orderBy("x")))  # at most `bracket` rows a cell
    got = rows.join(F.broadcast(sent), ["cell", "nth"]).select("rank", "x").collect()  # a row for each rank
    return value | {r["rank"]: r["x"] for r in got}


def _needed(cells: dict[int, Cell], ranks: list[int], value: dict[int, float]) -> tuple[dict[int, Cell], dict[int, list[int]]]:
    """The cells that hold ranks, and the ranks of each; those of cells of one value are known."""
    kept, wanted, at = {}, {}, 0
    for k, c in sorted(cells.items(), key=lambda kc: kc[1].below):
        while at < len(ranks) and ranks[at] < c.below:
            at += 1
        own = []
        while at < len(ranks) and ranks[at] < c.below + c.count:
            own.append(ranks[at])
            at += 1
        if own and c.lo == c.hi:
            value |= dict.fromkeys(own, c.lo)
        elif own:
            kept[k], wanted[k] = c, own
    return kept, wanted


def _split(placed: DataFrame, cells: dict[int, Cell], bracket: int) -> tuple[DataFrame, dict[int, Cell]]:
    """placed with the rows of the given cells in finer ones, other rows left out; and what the finer cells hold."""
    wide = [k for k, c in cells.items() if c.count > bracket]
    fan = max(2, (CELLS - len(cells)) // len(wide))
    rows, first, sizes = [], 0, {}
    for k, c in cells.items():
        n = 1 if k not in sizes and c.count <= bracket else 2 * len(c.cuts) + 1 if c.cuts else fan
        scale = c.steps(fan) if n == fan and not c.cuts else 0.0
        if c.count > bracket and not c.cuts and not scale:  # too wide or too narrow for steps
            c.cuts = _cuts(placed, [k])[k]
            n = 2 * len(c.cuts) + 1
        rows.append((k, first, n, c.lo, scale, c.cuts if c.count > bracket else []))
        sizes[k] = (first, n)
        first += n
    table = placed.sparkSession.createDataFrame(rows, "cell int, first int, n int, lo double, scale double, cuts array<double>")
    x, cuts = F.col("x"), F.col("cuts")
    step = F.least(F.floor((x - F.col("lo")) * F.col("scale")), F.col("n") - 1).cast("int")
    # a cut has a cell of its own, between those before and after it
    cut = F.size(F.filter(cuts, lambda e: e <= x)) + F.size(F.filter(cuts, lambda e: e < x))
    inner: Column = F.when(F.col("n") == 1, F.lit(0)).when(F.size(cuts) > 0, cut).otherwise(step)
    fine = placed.join(F.broadcast(table), "cell").select("x", (F.col("first") + inner).alias("cell"))
    got = {r["cell"]: r for r in fine.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    out, slow = {}, []
    for k, (start, n) in sizes.items():
        below = cells[k].below
        for j in range(start, start + n):
            if j in got:
                out[j] = Cell(got[j]["lo"], got[j]["hi"], below, got[j]["n"])
                below += got[j]["n"]
                if n > 1 and not cells[k].cuts and 2 * out[j].count > cells[k].count and out[j].count > bracket:
                    slow.append(j)
    for j, cuts_of in (_cuts(fine, slow) if slow else {}).items():
        out[j].cuts = cuts_of
    return fine, out


def _cuts(placed: DataFrame, of: list[int]) -> dict[int, list[float]]:
    """Values that part each cell about evenly, by a sketch."""
    at = F.array(*(F.lit(i / (CUTS + 1)) for i in range(1, CUTS + 1)))
    rows = placed.where(F.col("cell").isin(of)).groupBy("cell").agg(F.percentile_approx("x", at, 1000).alias("cuts"))
    return {r["cell"]: sorted(set(r["cuts"])) for r in rows.collect()}
