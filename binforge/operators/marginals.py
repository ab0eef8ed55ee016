"""All marginals of an N-D histogram at once, by grouping sets over its occupied cells."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hist import counted_nd


def marginals(df: DataFrame, cols: Sequence[str], bins=10, *, sizes: Sequence[int] = (1, 2), weights: str | None = None, dropna: bool = True, **how) -> DataFrame:
    """axes, bin0, bin1, ..., frequency, error2: the projections on each `sizes` of the columns, in their order.

    axes: the names, comma-joined; binK: the bin of the K-th of them, null beyond. As in a projection, only values that
    all axes hold count. The data is scanned once for its cells; the sets are made of these.
    """
    cols = list(cols)
    if any(not isinstance(k, int) or not 0 < k <= len(cols) for k in sizes) or not sizes:
        raise ValueError(f"marginals have 1 to {len(cols)} axes")
    if len(set(cols)) < len(cols):
        raise ValueError("an axis is named twice")
    axes, got = counted_nd(df, cols, bins, weights=weights, dropna=dropna, **how)
    keys = [f"bin{i}" for i in range(len(cols))]
    for k, a in zip(keys, axes):
        got = got.where(F.col(k).between(0, len(a) - 1))
    sets = [c for k in sorted(set(sizes)) for c in combinations(range(len(cols)), k)]
    rows = got.groupingSets([[F.col(keys[i]) for i in c] for c in sets], *keys).agg(F.sum("frequency").alias("frequency"), F.sum("error2").alias("error2"), F.grouping_id(*keys).alias("set"))
    number = lambda c: sum(1 << (len(cols) - 1 - i) for i in range(len(cols)) if i not in c)  # noqa: E731  bits of axes summed over
    pick = lambda values: F.coalesce(*(F.when(F.col("set") == number(c), v) for c, v in values))
    named = pick([(c, F.lit(",".join(cols[i] for i in c))) for c in sets]).alias("axes")
    placed = [pick([(c, F.col(keys[c[k]])) for c in sets if k < len(c)]).alias(f"bin{k}") for k in range(max(sizes))]
    return rows.select(named, *placed, "frequency", "error2")
