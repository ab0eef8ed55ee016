"""Bayesian blocks: the blocks of constant rate with the highest fitness (Scargle et al. 2013), for any number of distinct values.

The fitness of a block of N events over a width T is max over a rate r of N log r - T r, and each block costs a
prior. The best division up to a value is that up to some start, and one block from there. Of all starts only those are
kept that give the best for some rate: in every later comparison of two starts the values in common cancel out, so the stretches of rates
where a start is the best only shrink, and a start without any can never win (functional pruning, after Rigaill 2010 and Maidstone et
al. 2017). Some dozens stay, however many values there are, so the search takes about linear time, and all it carries from a value
to the next is a short list.

Spark sorts the distinct values into segments of bounded size. Each is searched by one executor task, which takes the list that the
segment before has left, writes for each value the start of its last block, and leaves its own list. Then the blocks are read off
from the last segment back to the first. Only lists, a row a segment and the blocks' edges come to the driver. The search of a segment needs that of the one before: segments bound memory, they
don't run at the same time.
"""

from __future__ import annotations

import base64
import math
import pickle
import sys
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binforge.functions import binning as B
from binforge.sources.io import shared_folder

from .infer import register_binning

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Distinct values of a segment, about.
SEGMENT = 500_000
TINY, HUGE = 1e-290, 1e290


class Search:
    """The best divisions up to each of the values met, by their events and widths."""

    def __init__(self, prior: float):
        self.prior = prior
        self.events, self.width, self.best = 0.0, 0.0, 0.0  # so far
        # starts in use: best division before each less the prior, events and width before it; and the rates where each is the best
        self.starts = [(0, -prior, 0.0, 0.0)]
        self.pieces = [(TINY, HUGE, 0)]  # low, high, place in starts
        self.met = 0

    def add(self, n: float, width: float) -> int:
        """One value more: the start of its last block, as the number of values before it."""
        self.events += n
        self.width += width
        self.met += 1
        best, last = -math.inf, 0
        for start, worth, events, before in self.starts:
            count, span = self.events - events, self.width - before
            fit = worth + count * (math.log(count / span) - 1.0) if span > 0 else math.inf
            if fit > best:
                best, last = fit, start
        self.best = best
        self._open()
        return last

    def _open(self) -> None:
        """The start after the last value takes the rates for which it is the best."""
        new = (self.met, self.best - self.prior, self.events, self.width)
        at, out = len(self.starts), []
        for low, high, k in self.pieces:
            _, worth, events, before = self.starts[k]
            n, t = self.events - events, self.width - before
            # the new start less the old one at rate r: d(r) = gap - n log r + t r, which has its least value at n / t
            gap = new[1] - worth
            ends = gap - n * math.log(low) + t * low, gap - n * math.log(high) + t * high
            if ends[0] <= 0 and ends[1] <= 0:
                out.append((low, high, k))
                continue
            least = n / t if t > 0 else HUGE
            if least <= low or least >= high or gap - n * math.log(least) + t * least >= 0:
                # no two crossings within
                if ends[0] > 0 and ends[1] > 0:
                    out.append((low, high, at))
                elif ends[0] > 0:
                    r = _crossing(gap, n, t, low, high)
                    out += [(low, r, at), (r, high, k)]
                else:
                    r = _crossing(gap, n, t, low, high)
                    out += [(low, r, k), (r, high, at)]
                continue
            if ends[0] > 0:
                r = _crossing(gap, n, t, low, least)
                out.append((low, r, at))
                low = r
            r = _crossing(gap, n, t, least, high) if ends[1] > 0 else high
            out.append((low, r, k))
            if r < high:
                out.append((r, high, at))
        pieces = []
        for low, high, k in out:
            if pieces and pieces[-1][2] == k:
                pieces[-1] = (pieces[-1][0], high, k)
            elif high > low:
                pieces.append((low, high, k))
        used = sorted({k for _, _, k in pieces})
        place = {k: i for i, k in enumerate(used)}
        self.starts = [self.starts[k] if k < at else new for k in used]
        self.pieces = [(low, high, place[k]) for low, high, k in pieces]


def _crossing(gap: float, n: float, t: float, low: float, high: float) -> float:
    """The rate between low and high where gap - n log r + t r changes its sign, over log r: by halving down to a small bracket, then by Newton's steps within it."""
    a, b = math.log(low), math.log(high)
    up = gap - n * b + t * high > 0
    u = (a + b) / 2
    for _ in range(200):
        r = math.exp(u)
        d = gap - n * u + t * r
        if (d > 0) == up:
            b = u
        else:
            a = u
        slope = t * r - n
        step = u - d / slope if slope and b - a < 2 else math.inf
        u, was = (step if a < step < b else (a + b) / 2), u
        if abs(u - was) <= 1e-15 * max(1.0, abs(u)):
            break
    return math.exp(u)


def _searched(state: bytes, first: float | None, after: float | None, segment: int):
    """pandas task of a segment: x, n in; number, last, edge of each value, and one row of the state, out.

    first: the least value before the segment's first edge, None for the first segment; after: the first value of the next one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("x")
        x, n = rows["x"].to_numpy(float), rows["n"].to_numpy(float)
        search: Search = pickle.loads(state)
        begin = search.met
        # edges between neighbours, the least and the greatest value themselves
        left = x[0] if first is None else (first + x[0]) / 2
        right = x[-1] if after is None else (x[-1] + after) / 2
        edges = np.r_[left, (x[1:] + x[:-1]) / 2, right]
        last = np.fromiter(map(search.add, n.tolist(), np.maximum(np.diff(edges), 1e-300).tolist()), np.int64, len(x))
        out = pd.DataFrame({"segment": segment, "number": np.arange(begin, begin + len(x)), "last": last, "edge": edges[:-1], "state": None})
        yield out
        yield pd.DataFrame({"segment": [segment], "number": [search.met], "last": [-1], "edge": [edges[-1]], "state": [base64.b64encode(pickle.dumps(search)).decode()]})

    return run


def _read_back(until: int):
    """pandas task of a segment: the blocks that end at value `until` and before, back to the segment's first; numbers and edges of their starts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("number")
        begin, last, edge = int(rows["number"].iloc[0]), rows["last"].to_numpy(), rows["edge"].to_numpy()
        k, starts = until, []
        while k > begin:
            k = int(last[k - 1 - begin])
            starts.append((k, edge[k - begin] if k >= begin else math.nan))
        yield pd.DataFrame(starts, columns=["number", "edge"])

    return run


@register_binning("blocks")
def bayesian_blocks(df: DataFrame, col: str, range=None, p0: float = 0.05, segment: int = SEGMENT) -> B.Binning:
    x = F.col(col).cast("double")
    d = df.where(x.between(*map(float, range))) if range else df
    spark, at = df.sparkSession, shared_folder(df.sparkSession, "blocks")
    d.where(x.isNotNull() & ~F.isnan(x)).groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{at}/values")
    values = spark.read.parquet(f"{at}/values")
    distinct, total = values.agg(F.count("x"), F.sum("n")).first()
    if distinct < 2:
        raise ValueError("blocks need more than one value")
    prior = 4 - math.log(73.53 * p0 * total**-0.478)
    parts = values.repartitionByRange(-(-distinct // segment), "x").withColumn("part", F.spark_partition_id())
    parts.write.partitionBy("part").parquet(f"{at}/parts")
    ends = spark.read.parquet(f"{at}/parts").groupBy("part").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("part").collect()  # a row a segment
    state = pickle.dumps(Search(prior))
    met = []
    for k, e in enumerate(ends):
        own = spark.read.parquet(f"{at}/parts").where(F.col("part") == e["part"]).select("x", "n").repartition(1)
        task = _searched(state, ends[k - 1]["hi"] if k else None, ends[k + 1]["lo"] if k + 1 < len(ends) else None, k)
        own.mapInPandas(task, "segment long, number long, last long, edge double, state string").write.parquet(f"{at}/searched/{k}")
        left = spark.read.parquet(f"{at}/searched/{k}").where("state IS NOT NULL").select("state", "number", "edge").first()
        state = base64.b64decode(left["state"])
        met.append(left["number"])
    edges, until = [left["edge"]], distinct
    while until:
        k = bisect_left(met, until)  # the segment of the value before `until`
        rows = spark.read.parquet(f"{at}/searched/{k}").where("state IS NULL").select("number", "last", "edge").repartition(1)
        blocks = rows.mapInPandas(_read_back(until), "number long, edge double").collect()  # a row a block
        edges += [b["edge"] for b in blocks[:-1]]
        until = blocks[-1]["number"]
        start = bisect_left(met, until + 1)
        edges.append(blocks[-1]["edge"] if start == k else spark.read.parquet(f"{at}/searched/{start}").where((F.col("number") == until) & F.col("state").isNull()).first()["edge"])
    return B.from_edges(edges[::-1])
