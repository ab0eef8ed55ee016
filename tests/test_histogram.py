"""Golden values and refusals of histograms as objects, of edges, quantiles and adaptive tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from binforge.functions import binning as B
from binforge.operators import hist, infer, shape
from binforge.operators.histogram import Histogram, Statistics, cut
from binforge.sources import examples, formats
from binforge.streaming import adaptive

EDGES, FREQ = [1.2, 1.4, 1.5, 1.7, 1.8], [4.0, 0.0, 3.0, 7.2]
VALS = [(0.1, 2), (-0.1, 0.7), (0.2, 1.5), (0.2, -1.5), (0.2, 1.47), (1.2, 1.23), (0.7, 0.5)]


def made(spark, edges, freq, **more):
    cells = {(k,): (f, f) for k, f in enumerate(freq)}
    return Histogram(spark, (B.from_edges(edges),), cells | more.pop("missed", {}), ("x",), **more)


@pytest.fixture(scope="module")
def example(spark):
    return made(spark, EDGES, FREQ, missed={(-1,): (2, 2), (4,): (1, 1)}, whole=False)


@pytest.fixture(scope="module")
def vals(spark):
    return spark.createDataFrame([(float(x), float(y), w) for (x, y), w in zip(VALS, [2, 1, 1, 1, 1, 2, 1])], "x double, y double, w long")


def column(spark, values, name="x"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"{name} double")


def test_missed_and_ranges(spark):
    d = column(spark, np.arange(0, 1, 0.01).round(2))
    h = Histogram.of(d, "x", bins=[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8])
    assert (h.underflow, h.overflow, h.total, h.missed) == (10, 19, 71, 29)
    h = Histogram.of(d, "x", bins=10, range=(0.5, 1.0))
    assert (h.underflow, h.overflow, h.total) == (50, 0, 50)
    assert math.isnan(Histogram.of(d, "x", keep_missed=False, range=(0.5, 1.0)).underflow)


def test_statistics(spark):
    d = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 1), (4.0, 2)], "x double, w long")
    s = Histogram.of(d, "x", median=True).stats
    assert (s.min, s.max, s.sum, s.sum2, s.weight, s.median, s.mean) == (1, 4, 10, 30, 4, 2.5, 2.5) and s.std == pytest.approx(math.sqrt(5 / 4))
    s = Histogram.of(d, "x", weights="w", median=True).stats
    assert (s.sum, s.sum2, s.weight, s.mean) == (14, 46, 5, 2.8) and math.isnan(s.median) and s.std == pytest.approx(math.sqrt(6.8 / 5))
    parts = [hist.statistics(d.where(c), "x", "w") for c in ("x < 3", "x >= 3")]
    assert hist.merge_statistics(*parts).first()[:7] == pytest.approx(hist.statistics(d, "x", "w").first()[:7])
    assert math.isnan(Statistics().mean) and hist.median(d, "x") == 2.5


def test_two_axes_and_gaps(spark, vals):
    h = Histogram.of(vals, "x", "y", bins=[0, 1, 2])
    assert h.frequencies() == [1, 3, 0, 1] and h.missed == 2 and h.axis_names == ("x", "y")
    gaps = [B.static([(-1, 0), (1, 2)]), B.static([(-2, -1), (1, 2)])]
    assert Histogram.of(vals, "x", "y", bins=gaps).frequencies() == [0, 0, 0, 1]
    w = Histogram.of(vals, "x", "y", bins=gaps, weights="w")
    assert w.frequencies() == [0, 0, 0, 2] and w.errors2() == [0, 0, 0, 4] and w.missed == 7
    rows = hist.h(vals, ["x", "y"], gaps, weights="w").orderBy("bin0", "bin1").collect()
    assert [(r["frequency"], r["error2"]) for r in rows] == [(0, 0), (0, 0), (0, 0), (2, 4)]


def test_ranges_for_each_axis(spark):
    v = np.linspace(0, 10, 100)
    d = spark.createDataFrame([(float(x), float(x)) for x in v], "x double, y double")
    a, b = Histogram.of(d, "x", "y", range=[(4, 5), None]).axes
    assert (a.edges[0], a.edges[-1], b.edges[0], b.edges[-1]) == (4, 5, 0, 10)
    with pytest.raises(ValueError):
        Histogram.of(d, "x", "y", range=[(4, 5)])


def test_find_bin(spark, example):
    for x, k in ((1, -1), (1.3, 0), (1.5, 2), (1.72, 3), (1.8, 3), (1.9, 4)):
        assert example.find_bin(x) == k
    gaps = example[[0, 3]]
    for x, k in ((1, -1), (1.3, 0), (1.45, None), (1.55, None), (1.75, 1), (1.8, 1), (1.9, 2), (math.nan, None)):
        assert gaps.find_bin(x) == k
    with pytest.raises(ValueError):
        example.find_bin([1])


def test_indexing(spark, example, vals):
    h = example[1:-1]
    assert h.frequencies() == [0, 3] and h.underflow == 6 and h.overflow == pytest.approx(8.2)
    assert example[-1] == ((1.7, 1.8), 7.2) and example[0][1] == 4
    mask = example[[f > 0 for f in FREQ]]
    assert [b[0] for b in mask.axes[0].bins] == [1.2, 1.5, 1.7] and mask.frequencies() == [4, 3, 7.2]
    for bad in (slice(None, None, 2), [True], [2, 1]):
        with pytest.raises(IndexError):
            example[bad]
    two = Histogram.of(vals, "x", "y", bins=[0, 1, 2])
    assert two[0, 1][1] == 3 and two[0].frequencies() == [1, 3] and two[:, -1].frequencies() == [3, 1] and two[1:, :].frequencies() == [0, 1]
    assert two.select("y", 0).frequencies() == [1, 0] and two.transpose().frequencies() == [1, 0, 3, 1]
    table = example.table()
    assert [r["frequency"] for r in shape.slice_bins(table, 1, -1).orderBy("bin").collect()] == [0, 3]
    assert shape.dropped(table, 1, -1).first()[:] == (4, 7.2)
    with pytest.raises(IndexError):
        two[0, 1, 2]


def test_projections(spark):
    rows = [(float(i % 4), float(i % 5), float(i % 6), float(i % 7)) for i in range(500)]
    d = spark.createDataFrame(rows, "a double, b double, c double, d double")
    h = Histogram.of(d, "a", "b", "c", "d", bins=[4, 5, 6, 7])
    assert h.shape == (4, 5, 6, 7) and h.projection("d", "a").axis_names == ("a", "d") and h.projection(2).total == 500
    assert h.projection("a", "b").frequencies() == Histogram.of(d, "a", "b", bins=[4, 5]).frequencies()
    for bad in (("a", "a"), (0, "a"), ("nope",), (9,), (), ("a", "b", "c", "d", "a")):
        with pytest.raises(ValueError):
            h.projection(*bad)
    table = hist.h(d, ["a", "b", "c"], [4, 5, 6])
    assert hist.projection(table, 2, 0).columns[:6] == ["bin0", "left0", "right0", "bin2", "left2", "right2"]
    for bad in ((0, 0), (3,), (), (0, 1, 2)):
        with pytest.raises(ValueError):
            hist.projection(table, *bad)


def test_algebra(spark, example):
    other = made(spark, EDGES, [1.0, 1.0, 0.0, 1.0], whole=False)
    assert (example + other).frequencies() == pytest.approx([5, 1, 3, 8.2]) and sum([example, other]).total == pytest.approx(17.2)
    assert (example - made(spark, EDGES, [1.0, 0.0, 0.0, 1.0])).frequencies() == pytest.approx([3, 0, 3, 6.2])
    nine = Histogram(spark, (B.from_edges([0, 1, 2, 3]),) * 2, {(i, j): (3 * i + j, 3 * i + j) for i in range(3) for j in range(3)}, ("x", "y"))
    twice = nine * 2 - nine
    assert twice.frequencies() == nine.frequencies() and twice.errors2() == [5 * e for e in nine.errors2()]
    assert (nine / 2).frequencies() == [f / 2 for f in nine.frequencies()] and nine == nine * 1 and nine != nine * 2
    for bad in (lambda: example * example, lambda: example / example, lambda: example * "2", lambda: example + 1):
        with pytest.raises(TypeError):
            bad()
    with pytest.raises(ValueError):
        example - made(spark, EDGES, [9.0, 0, 0, 0])
    with pytest.raises(ValueError):
        example + made(spark, [1.2, 1.4, 1.5, 1.7, 1.9], FREQ)
    with pytest.raises(ValueError):
        example + nine
    assert example.cumulative() == pytest.approx([4, 4, 7, 14.2]) and example.normalize(percent=True).total == pytest.approx(100)
    assert example.densities()[0] == pytest.approx(20)
    with pytest.raises(ValueError):
        example.set_dtype("int")
    assert nine.set_dtype("int").whole


def test_tables_of_unlike_bins_are_not_added(spark):
    t = lambda bins: spark.createDataFrame([(k, float(a), float(b), 1, 1.0) for k, (a, b) in enumerate(bins)], "bin long, left double, right double, frequency long, error2 double")
    with pytest.raises(ValueError):
        hist.add(t([(0, 1), (1, 2), (2, 3)]), t([(0.5, 1.5)]))
    with pytest.raises(ValueError):
        hist.add(t([(0, 1), (1, 3)]), t([(0, 2), (2, 3)]))
    assert sorted(r[:4] for r in hist.add(t([(0, 1), (1, 2)]), t([(3, 4)])).collect()) == [(0, 0, 1, 1), (1, 1, 2, 1), (2, 3, 4, 1)]
    with pytest.raises(Exception, match="gap"):
        hist.merge_bins(t([(0, 1), (2, 3)]), 2).collect()
    assert hist.merge_bins(t([(0, 1), (1, 2), (3, 4)]), 2).count() == 2


def test_merging(spark):
    rng = np.random.default_rng(1)
    d = column(spark, rng.normal(size=500))
    lo, hi = d.agg(F.min("x"), F.max("x")).first()
    fine = Histogram.of(d, "x", bins=B.equal_width(lo, hi, 120))
    assert fine.merge_bins(2).frequencies() == Histogram.of(d, "x", bins=B.equal_width(lo, hi, 60)).frequencies()
    with pytest.raises(ValueError):
        fine[[0, 2, 4, 6]].merge_bins(2)
    merged = fine.merge_bins(min_frequency=20)
    assert min(merged.frequencies()[:-1]) >= 20 and merged.total == fine.total
    two = Histogram(spark, (B.from_edges(range(5)), B.from_edges(range(3))), {(i, j): (i, i) for i in range(4) for j in range(2)}, ("x", "y"))
    assert two.merge_bins(2, axis="x").shape == (2, 2) and two.merge_bins(2).shape == (2, 1) and two.merge_bins(min_frequency=5, axis="x").shape == (2, 2)


def test_adaptive_fill(spark):
    h = Histogram.of(column(spark, [0.5, 1.5, 1.6, 2.5, 2.6, 2.7]), "x", bins="fixed_width", bin_width=1.0, adaptive=True)
    h = Histogram(spark, h.axes, {(1,): (1, 1), (2,): (2, 2)}, ("x",), adaptive=True)
    for x in (3.7, -0.7, 10.1):
        h = h.fill(x)
    assert h.frequencies() == [1, 0, 1, 2, 1, 0, 0, 0, 0, 0, 0, 1] and h.edges[0] == -1
    empty = Histogram(spark, (B.fixed_width(0, 0.5, 1.0),), {}, ("x",), stats=Statistics(), adaptive=True)
    got = empty.fill_n(column(spark, [0.4, 0.4, 1.0]), "x")
    assert got.frequencies() == [2, 1] and got.edges == [0, 1, 2] and got.stats.sum == pytest.approx(1.8)
    d = spark.createDataFrame([(0.4, 1), (0.5, 1), (0.6, 2), (1.2, 3)], "x double, w long")
    got = empty.fill_n(d, "x", weights="w")
    assert got.frequencies() == [4, 3] and got.errors2() == [6, 9]
    table = adaptive.adaptive(d, "x", 1.0, weights="w")
    assert sorted((r["frequency"], r["error2"]) for r in table.collect()) == [(3, 9), (4, 6)]
    more = adaptive.fill(table, column(spark, [5.5, None]), "x")
    assert sorted((r["bin"], r["frequency"], r["error2"]) for r in more.collect()) == [(0, 4, 6), (1, 3, 9), (5, 1, 1)]
    with pytest.raises(ValueError):
        made(spark, EDGES, FREQ).set_adaptive()
    two = Histogram.of(d.withColumn("y", F.col("x") * 2), "x", "y", bins="fixed_width", bin_width=1.0, adaptive=True)
    grown = two.fill((7.5, -0.5))
    assert grown.total == 5 and grown.shape == (8, 4) and grown.find_bin((7.5, -0.5)) == (7, 0)


def test_adaptive_addition(spark):
    h = lambda v: Histogram.of(column(spark, v), "x", bins="fixed_width", bin_width=10.0, adaptive=True)
    both = h([1, 43, 23]) + h([23, 51])
    assert both.frequencies() == [1, 0, 2, 0, 1, 1] and both.edges == [0, 10, 20, 30, 40, 50, 60]
    with pytest.raises(ValueError):
        h([1]) + Histogram.of(column(spark, [1]), "x", bins="fixed_width", bin_width=5.0)
    wide, narrow = adaptive.adaptive(column(spark, [1, 43]), "x", 10.0), adaptive.adaptive(column(spark, [1, 43]), "x", 5.0)
    for other in (narrow, adaptive.adaptive(column(spark, [1]), "x", 10.0, 3.0)):
        with pytest.raises(Exception, match="one width and shift"):
            adaptive.merge(wide, other).collect()
    far = adaptive.adaptive(column(spark, [0, 1e12]), "x", 1.0)
    assert far.count() == 2
    with pytest.raises(Exception, match="bins between"):
        adaptive.fill_gaps(far).collect()
    with pytest.raises(Exception, match="too far"):
        adaptive.adaptive(column(spark, [1e300]), "x", 1.0).collect()


def test_adaptive_stream(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("value")
    d.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = adaptive.adaptive(stream, "value", 10.0).writeStream.outputMode("complete").format("memory").queryName("filled").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination()
    assert sorted(spark.table("filled").collect()) == sorted(adaptive.adaptive(d, "value", 10.0).collect())


def test_refusals(spark, vals):
    with pytest.raises(ValueError):
        Histogram.of(spark.createDataFrame([("1",), ("2",)], "x string"), "x")
    with pytest.raises(ValueError):
        hist.h1(spark.createDataFrame([("1",), ("2",)], "x string"), "x")
    for f in (lambda d: hist.h1(d, "x", dropna=False), lambda d: Histogram.of(d, "x", dropna=False)):
        with pytest.raises(ValueError):
            f(column(spark, [1, 2, None]))
    for bad in ([], [1.0]):
        with pytest.raises(ValueError):
            Histogram.of(column(spark, bad), "x")
    with pytest.raises(ValueError):
        Histogram.of(column(spark, [1, 2]), "x", range=(0, math.inf))
    with pytest.raises(ValueError):
        Histogram.of(column(spark, []), "x", bins="quantile", bin_count=2)
    with pytest.raises(ValueError):
        Histogram.of(vals.withColumn("v", F.col("w") / 2), "x", weights="v", dtype="int")
    with pytest.raises(ValueError):
        Histogram.of(vals, "x", adaptive=True)
    with pytest.raises(ValueError):
        hist.h1(vals, "x", "fixed_width", bin_width=1e-12)
    assert Histogram.of(vals.withColumn("s", F.lit("a"))).axis_names == ("x", "y", "w")  # all numeric columns


def test_quantiles(spark):
    rng = np.random.default_rng(2)
    at = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    for values in (rng.lognormal(size=3000), rng.integers(0, 4, 3000), [5.0], [1, 2]):
        d = column(spark, values).repartition(3)
        for bracket in (100_000, 20):
            assert infer.quantiles(d, "x", at, bracket) == pytest.approx(np.quantile(np.asarray(values, float), at))
    d = column(spark, [0.1, 0.3, 0.4, 0.7, 1, 2, 2.6, 3.5, 10])
    edges = lambda **k: infer.infer(d, "x", "quantile", **k).edges
    assert edges(bin_count=2) == pytest.approx([0.1, 1, 10]) and edges(bin_count=3) == pytest.approx([0.1, 0.6, 2.2, 10])
    assert edges(bin_count=3, qrange=(0.4, 1)) == pytest.approx([0.76, 1.8, 2.96, 10]) and edges(q=[0.1, 0.7, 1]) == pytest.approx([0.26, 2.36, 10])


def test_golden_bins(spark):
    v = [1, 2, 3, 5, 6, 2, 4, 3, 2, 3, 4, 5, 6, 6, 1, 2, 5]
    assert infer.infer(column(spark, v), "x", "integer").edges == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5]
    assert B.fixed_width(4.6, 7.3, 1.0).edges == [4, 5, 6, 7, 8]
    d = column(spark, [0.1, 0.3, 0.4, 0.7, 1, 2, 2.5, 3.5, 10])
    assert infer.infer(d, "x", "exponential", bin_count=2).edges == pytest.approx([0.1, 1, 10])
    assert B.ideal_bin_count(2, "doane") == 1 and B.ideal_bin_count(0, "sqrt") == 1
    assert B.equal_width(0, 10, 5).as_static() == B.from_edges([0, 2, 4, 6, 8, 10]) and B.from_edges([0, 2, 4]).as_fixed_width().rule
    with pytest.raises(ValueError):
        B.from_edges([0, 2, 5]).as_fixed_width()
    assert B.from_edges([0, 2, 5])[1:].bins == ((2, 5),) and B.from_edges([0, 2, 5]).total_width == 5


@pytest.mark.parametrize("n", [3, 40, 700])
def test_values_on_edges(spark, n):
    """Uneven bins, by the tree and by bisection, and even ones, against a search in the list of edges."""
    rng = np.random.default_rng(n)
    for b in (B.from_edges(np.unique(rng.random(n + 1))), B.equal_width(0.1, 0.7, n), B.fixed_width(-0.3, 0.7, 1 / n)):
        x = [*b.edges, *rng.random(200) * 2 - 0.5, math.nan]
        got = {r[0]: r[1] for r in column(spark, x).select("x", b.assign(F.col("x"))).collect()}
        e = np.array(b.edges)
        for v, k in got.items():
            want = None if math.isnan(v) else int(np.searchsorted(e, v, "right")) - 1
            if want == len(b) and v == e[-1] and b.closed:
                want = len(b) - 1
            assert k == want, (v, k, want)
        rows = b.grid(spark).orderBy("bin").collect()
        assert [r["left"] for r in rows] + [rows[-1]["right"]] == b.edges


def test_null_names_in_collections(spark):
    d = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 3.0), ("b", None)], "g string, x double")
    rows = hist.collection(d, "g", "x", [0, 2, 4]).collect()
    assert sum(r["frequency"] for r in rows if r["name"] is None) == 2 and {r["name"] for r in rows} == {"a", "b", None} and len(rows) == 6


def test_cut_is_closed_on_the_right(spark):
    rows = cut(column(spark, [0, 1, 1.5, 2, 3, None]), "x", [0, 1, 2]).collect()
    assert [tuple(r[1]) if r[1] else None for r in rows] == [None, (0, 1), (1, 2), (1, 2), None, None]


def test_special_kinds(spark):
    d = spark.createDataFrame([(0.01, 0.01), (0.01, 0.99), (-1.0, 0.01), (-1.0, -0.01)], "x double, y double")
    assert Histogram.special(d, "azimuthal", "x", "y", bins=[4]).frequencies() == [2, 1, 1, 0]
    h = Histogram.special(d, "polar", "x", "y", bins=[2, 4])
    assert h.frequencies() == [1, 0, 0, 0, 1, 1, 1, 0]
    assert h.projection("phi").kind == "azimuthal" and h.projection("r").kind == "radial" and h.projection(1).frequencies() == [2, 1, 1, 0]
    assert h.find_bin((0.01, 0.99)) == (1, 0) and h.fill((0.01, 0.99)).total == 5
    p = Histogram(spark, (B.from_edges([0, 1, 2]),) * 2, {(0, 0): (1, 1), (0, 1): (2, 2), (1, 0): (3, 3), (1, 1): (4, 4)}, ("r", "phi"), kind="polar")
    assert p.densities() == pytest.approx([2, 4, 2, 4 / 1.5])
    three = spark.createDataFrame([(2.0, 2.0, 0.0), (2.0, 2.0, 2.0)], "x double, y double, z double")
    s = Histogram.special(three, "spherical", "x", "y", "z", bins=[[0, 2, 4], None, None])
    assert s.projection("theta", "phi").kind == "spherical_surface" and s.projection("r").kind == "radial" and s.shape == (2, 16, 16)
    c = Histogram.special(three, "cylindrical", "x", "y", "z", bins=[[0, 5], 4, [0, 1, 3]])
    assert c.projection("rho", "phi").kind == "polar" and c.projection("phi", "z").kind == "cylindrical_surface"
    with pytest.raises(ValueError):
        Histogram.special(d, "spherical", "x", "y")
    with pytest.raises(ValueError):
        Histogram.special(d, "conical", "x", "y")
    flat = Histogram.special(d.selectExpr("abs(x) as r", "y + 1 as phi"), "polar", "r", "phi", bins=[2, 4], transformed=True)
    assert flat.total == 4


def test_kept_elsewhere(spark, example):
    h = Histogram.of(column(spark, [1, 2, 3, 30]), "x", bins="fixed_width", bin_width=10.0, name="n", title="t", axis_names=["length"], adaptive=True)
    back = Histogram.from_dict(spark, h.to_dict())
    assert back == h and repr(back.stats) == repr(h.stats) and back.fill(55).total == 5 and back.title == "t"
    with pytest.raises(ValueError):
        Histogram.from_dict(spark, h.to_dict() | {"version": 9})
    merged = h + Histogram.of(column(spark, [1, 30]), "x", bins=h.axes[0], name="other", axis_names=["length"])
    assert merged.name is None and merged.axis_names == ("length",)


def test_own_binnings(spark):
    @infer.register_binning("thirds")
    def thirds(df, col, parts=3):
        lo, hi = df.agg(F.min(col), F.max(col)).first()
        return B.equal_width(lo, hi, parts)

    d = column(spark, [0, 1, 2, 9])
    assert len(Histogram.of(d, "x", bins="thirds").axes[0]) == 3 and len(Histogram.of(d, "x", bins="thirds", parts=5).axes[0]) == 5
    assert len(Histogram.of(d, "x", bins=lambda df, c: B.from_edges([0, 9])).axes[0]) == 1
    with pytest.raises(ValueError):
        Histogram.of(d, "x", bins="nope")


def test_blocks(spark):
    rng = np.random.default_rng(3)
    values = np.r_[rng.uniform(0, 10, 200), rng.uniform(4, 5, 400)]
    edges = infer.infer(column(spark, values), "x", "blocks").edges
    assert 4 <= len(edges) <= 7 and min(abs(np.array(edges) - 4)) < 0.15 and min(abs(np.array(edges) - 5)) < 0.15
    with pytest.raises(ValueError):
        infer.infer(column(spark, [1.0]), "x", "blocks")


def test_empty_and_views(spark):
    h = Histogram.empty(spark, B.from_edges([0, 1, 2]), B.from_edges([0, 5]), axis_names=["a", "b"])
    assert h.total == 0 and h.shape == (2, 1) and h.fill((0.5, 1)).total == 1
    f, e = h.fill((1.5, 1), 3).numpy_like()
    assert f.tolist() == [[0], [3]] and e[0].tolist() == [0, 1, 2]
    with pytest.raises(ValueError):
        Histogram.empty(spark)


def test_examples(spark):
    d = examples.normal(spark, 5000, 3)
    assert d.columns == ["x", "y", "z"] and abs(Histogram.of(d, "x").stats.mean) < 0.1 and examples.uniform(spark, 100, 2, 3).where("x < 2 or x > 3").count() == 0


def test_geant4_of_two_axes(spark, tmp_path):
    head = "#class h2d\n#title Both\n#dimension 2\n#axis fixed 2 0 8\n#axis fixed 1 0 1\n#bin_number 12\nentries,Sw,Sw2,Sxw0,Sx2w0,Sxw1,Sx2w1\n"
    (tmp_path / "h.csv").write_text(head + "".join(f"{k},{k},{2 * k},0,0,0,0\n" for k in range(12)))
    h = formats.read_geant4(spark, str(tmp_path / "h.csv"))
    assert h.shape == (2, 1) and h.frequencies() == [4, 7] and h.errors2() == [8, 14] and h.name == "Both" and h.missed == 66 - 11
    one = "#title One\n#dimension 1\n#axis fixed 2 0 8\nentries,Sw,Sw2,Sxw0,Sx2w0\n9,9,9,0,0\n1,1,1,.5,.25\n2,3,5,9,9\n1,2,4,9,9\n"
    (tmp_path / "h1.csv").write_text(one)
    h = formats.read_geant4(spark, str(tmp_path / "h1.csv"))
    assert (h.underflow, h.overflow, h.frequencies(), h.stats.sum) == (9, 2, [1, 3], 9.5)
    with pytest.raises(ValueError):
        formats.binning_to_index(B.static([(0, 1), (2, 3)]))
    assert formats.binning_from_index(formats.binning_to_index(B.from_edges([0, 1, 3]))).edges == [0, 1, 3]
    assert formats.to_series(h.table()).tolist() == [1, 3]
