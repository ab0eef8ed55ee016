"""Binning in SQL: functions of a session, written in SQL and inlined into the plan, so they run where all columns do.

    register(spark)
    SELECT bin_of(x, 0, 50, 10) AS bin, count(*) FROM t GROUP BY 1
    SELECT g.*, coalesce(n, 0) FROM bin_grid(0, 50, 10) g LEFT JOIN (...) USING (bin)

Indices are those of Binning.assign: -1 below, the number of bins above, null for null and NaN.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from .binning import Binning

#: Rows of one level of a grid: bins are numbered by two levels, so up to the square of it.
LEVEL = 4096

_GUESS = "least(greatest(floor((x - lo) / {w}), 0), n - 1)"


def _placed(w: str, last: str) -> str:
    """SQL of the index of x among n bins from lo of width w: a guess, put right by one where rounding misplaced it."""
    k = _GUESS.format(w=w)
    edge = lambda k: f"(({k}) * {w} + lo)"
    return (
        f"CASE WHEN x IS NULL OR isnan(x) THEN NULL WHEN x < lo THEN -1 WHEN x > {last} THEN n WHEN x = {last} THEN n - 1 "
        f"ELSE {k} + CASE WHEN {edge(k)} > x THEN -1 WHEN {k} < n - 1 AND {edge(k + ' + 1')} <= x THEN 1 ELSE 0 END END"
    )


def register(spark: SparkSession) -> None:
    """bin_of(x, lo, hi, n), bin_by_width(x, width, shift), bin_left(bin, lo, hi, n), bin_right(bin, lo, hi, n); table functions bin_grid(lo, hi, n), edge_grid(edges)."""
    checked = "CASE WHEN n < 1 OR n IS NULL OR NOT lo < hi THEN raise_error('equal bins need a positive number and a range') ELSE {} END"
    for text in (
        f"bin_of(x DOUBLE, lo DOUBLE, hi DOUBLE, n BIGINT) RETURNS BIGINT RETURN {checked.format(_placed('((hi - lo) / n)', 'hi'))}",
        "bin_by_width(x DOUBLE, width DOUBLE, shift DOUBLE) RETURNS BIGINT RETURN CASE WHEN NOT width > 0 THEN raise_error('a positive width is needed') WHEN x IS NULL OR isnan(x) THEN NULL ELSE floor((x - shift) / width) END",
        "bin_left(bin BIGINT, lo DOUBLE, hi DOUBLE, n BIGINT) RETURNS DOUBLE RETURN CASE WHEN bin = n THEN hi ELSE bin * ((hi - lo) / n) + lo END",
        "bin_right(bin BIGINT, lo DOUBLE, hi DOUBLE, n BIGINT) RETURNS DOUBLE RETURN CASE WHEN bin + 1 = n THEN hi ELSE (bin + 1) * ((hi - lo) / n) + lo END",
        "bin_among(x DOUBLE, edges ARRAY<DOUBLE>) RETURNS BIGINT RETURN CASE WHEN x IS NULL OR isnan(x) THEN NULL WHEN x > edges[size(edges) - 1] THEN size(edges) - 1 WHEN x = edges[size(edges) - 1] THEN size(edges) - 2 "
        "ELSE size(filter(edges, e -> e <= x)) - 1 END",
        f"bin_grid(lo DOUBLE, hi DOUBLE, n BIGINT) RETURNS TABLE (bin BIGINT, left DOUBLE, right DOUBLE) RETURN "
        f"SELECT k, k * ((hi - lo) / n) + lo, CASE WHEN k + 1 = n THEN hi ELSE (k + 1) * ((hi - lo) / n) + lo END "
        f"FROM (SELECT a * {LEVEL} + b AS k FROM (SELECT explode(sequence(0L, (n - 1) div {LEVEL})) AS a) LATERAL VIEW explode(sequence(0L, {LEVEL - 1}L)) t AS b) WHERE k < n",
        "edge_grid(edges ARRAY<DOUBLE>) RETURNS TABLE (bin BIGINT, left DOUBLE, right DOUBLE) RETURN "
        "SELECT CAST(k AS BIGINT), edges[k], edges[k + 1] FROM (SELECT explode(sequence(0, size(edges) - 2)) AS k)",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")


def register_binning(spark: SparkSession, name: str, binning: Binning) -> None:
    """name(x): the bin of a value in any binning, by its rule or by halving its edges; name_grid(): its bins."""
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"{name!r} is no name of a function")
    if len(binning) > 10_000 and not binning.rule:
        raise ValueError("uneven bins are written out in the function: too many")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x DOUBLE) RETURNS BIGINT RETURN {_of(binning)}")
    if not binning.rule:
        grid = f"SELECT bin, left, right FROM VALUES {', '.join(f'({k}L, {_number(a)}, {_number(b)})' for k, (a, b) in enumerate(binning.bins))} AS t(bin, left, right)"
    else:
        first, w, shift = map(_number, binning.rule)
        edge = lambda k: f"(({first} + {k}) * {w} + {shift})"
        n = len(binning)
        grid = f"SELECT k, {edge('k')}, CASE WHEN k = {n - 1} THEN {_number(binning.bins[-1][1])} ELSE {edge('(k + 1)')} END FROM (SELECT a * {LEVEL} + b AS k FROM (SELECT explode(sequence(0L, {(n - 1) // LEVEL}L)) AS a) LATERAL VIEW explode(sequence(0L, {LEVEL - 1}L)) t AS b) WHERE k < {n}"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_grid() RETURNS TABLE (bin BIGINT, left DOUBLE, right DOUBLE) RETURN {grid}")


def _number(x: float) -> str:
    return f"{float(x)!r}D" if x not in (float("inf"), float("-inf")) else f"double('{'-' if x < 0 else ''}Infinity')"


def _of(b: Binning) -> str:
    n, lo, last = len(b), b.bins[0][0], b.bins[-1][1]
    top = f"WHEN x > {_number(last)} THEN {n} WHEN x = {_number(last)} THEN {n - 1 if b.closed else n}"
    if b.rule:
        first, w, shift = map(_number, b.rule)
        edge = lambda k: f"(({first} + ({k})) * {w} + {shift})"
        k = f"least(greatest(floor((x - {_number(lo)}) / {w}), 0), {n - 1})"
        inside = f"{k} + CASE WHEN {edge(k)} > x THEN -1 WHEN {k} < {n - 1} AND {edge(k + ' + 1')} <= x THEN 1 ELSE 0 END"
    else:
        inside = _halved(b, 0, n)
    return f"CASE WHEN x IS NULL OR isnan(x) THEN NULL WHEN x < {_number(lo)} THEN -1 {top} ELSE {inside} END"


def _halved(b: Binning, lo: int, hi: int) -> str:
    if hi - lo == 1:
        return str(lo) if lo + 1 == len(b) or b.bins[lo][1] == b.bins[lo + 1][0] else f"CASE WHEN x < {_number(b.bins[lo][1])} THEN {lo} END"
    mid = (lo + hi) // 2
    return f"CASE WHEN x < {_number(b.bins[mid][0])} THEN {_halved(b, lo, mid)} ELSE {_halved(b, mid, hi)} END"
