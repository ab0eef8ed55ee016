"""Collections, coordinate systems, free arithmetic, SQL functions, calendar bins, regrouping, blocks, many quantiles, and results once wrong."""

import math
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from binforge import api
from binforge.functions import binning as B
from binforge.functions import calendar, sql, timeticks
from binforge.operators import blocks, coords, hist, infer, quantile, shape
from binforge.operators.arithmetic import free_arithmetic, is_free
from binforge.operators.collection import Collection
from binforge.operators.histogram import Histogram, assert_histograms_equal
from binforge.plans import catalog
from binforge.sources import formats


def column(spark, values, name="x"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"{name} double")


def two(spark, values):
    return spark.createDataFrame([tuple(map(float, v)) for v in values], "x double, y double")


# --- results that were wrong ------------------------------------------------------------------------------
def test_knuth_query_of_repeated_rows(spark, tmp_path):
    """Values that many rows share would have ever finer bins; the query takes the best of the counts that its SQL tries."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").crossJoin(spark.range(60).select())
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(c.execute(catalog.ORACLE_SQL["h1_knuth"]).fetchall())
    assert sorted(map(tuple, catalog.QUERIES["h1_knuth"](spark, str(tmp_path)).collect())) == want
    assert 200 < len(want) <= 300


def test_knuth_tries_all_up_to_a_bound(spark):
    d = column(spark, [x % 40 for x in range(2000)])
    score = infer._posteriors(d, "x", 0.0, 39.0, 2000, list(range(1, 31)))
    assert infer.knuth_count(d, "x", 0.0, 39.0, 2000, 30) == max(score, key=score.get) == len(infer.infer(d, "x", "knuth", most_bins=30).bins)
    with pytest.raises(ValueError):
        infer.infer(d, "x", "knuth", most_bins=0)


def test_fill_n_transforms(spark):
    d = two(spark, [(1, 0), (0, 2)])
    h = Histogram.special(d, "polar", "x", "y", bins=[2, 4], ranges=[(0.0, 2.0), None])
    assert h.fill_n(d, "x", "y").frequencies() == [2 * f for f in h.frequencies()]
    assert h.fill_n(two(spark, [(1, 0), (2, math.pi / 2)]), "x", "y", transformed=True).frequencies() == [2 * f for f in h.frequencies()]
    with pytest.raises(ValueError):
        h.fill_n(d, "x")


def test_adaptive_fill_n_leaves_out_missing(spark):
    h = Histogram.of(two(spark, [(1, 1)]), "x", "y", bins="fixed_width", bin_width=1.0, adaptive=True)
    d = spark.createDataFrame([(3.0, 4.0), (math.nan, 90.0), (None, -90.0), (2.0, math.nan)], "x double, y double")
    got = h.fill_n(d, "x", "y")
    assert got.total == 2 and got.shape == (3, 4)
    one = Histogram.of(column(spark, [1]), "x", bins="fixed_width", bin_width=1.0, adaptive=True)
    assert one.fill_n(column(spark, [None, math.nan]), "x") == one
    with pytest.raises(ValueError, match="missing"):
        one.fill_n(column(spark, [None]), "x", dropna=False)


def test_select_axis_out_of_range(spark):
    t = hist.h2(two(spark, [(0, 0), (1, 5)]), "x", "y", [2, 3])
    bare = t.sparkSession.createDataFrame(t.collect(), "bin0 long, left0 double, right0 double, bin1 long, left1 double, right1 double, frequency long, error2 double")
    for d in (t, bare):
        for bad in (-3, 2, 7):
            with pytest.raises(IndexError):
                shape.select_axis(d, 0, bad)
        assert [r["frequency"] for r in shape.select_axis(d, 0, -2).orderBy("bin1").collect()] == [1, 0, 0]


def test_signs_and_kinds(spark):
    d = two(spark, [(1, 0), (0, 2)])
    h = Histogram.of(d, "x", bins=2)
    for bad in (lambda: h * -1, lambda: h - h - h, lambda: hist.scale(hist.h1(d, "x"), -1.0)):
        with pytest.raises(ValueError, match="negative"):
            bad()
    polar = Histogram.special(d, "polar", "x", "y", bins=[2, 2], ranges=[(0.0, 2.0), (0.0, 2.0)])
    plain = Histogram.of(d, "x", "y", bins=2, range=(0.0, 2.0))
    with pytest.raises(ValueError, match="coordinates"):
        polar + plain


def test_cylinder_projects_on_its_surface(spark):
    d = spark.createDataFrame([(3.0, 0.0, 1.0), (0.0, 4.0, 2.0)], "x double, y double, z double")
    h = Histogram.special(d, "cylindrical", "x", "y", "z", bins=[[0.0, 2.0, 5.0], 4, [0.0, 1.5, 3.0]])
    surface = h.projection("phi", "z")
    assert surface.kind == "cylindrical_surface" and surface.radius == 5.0
    assert surface.densities() == pytest.approx([f / (math.pi / 2 * 1.5 * 5.0) for f in surface.frequencies()])
    assert surface.projection("phi").kind == "azimuthal" and h.projection("rho", "z").kind is None


def test_many_bins_take_no_room():
    b = B.fixed_width(0.0, 49_999_999.5, 1.0)
    assert len(b) == 50_000_000 and b.find(123.5) == 123 and b.bins[-1] == (49_999_999.0, 50_000_000.0)
    assert B.Binning.from_dict(b.to_dict()).rule == b.rule and len(B.Binning.from_dict(b.to_dict())) == len(b)
    small = B.equal_width(0.0, 1.0, 3)
    assert small == B.Binning(tuple(small.bins)) and list(small.bins[1:]) == list(small.bins)[1:] and formats.binning_from_dict(formats.binning_to_dict(small)).rule == small.rule


def test_running_sums_by_ranges(spark, monkeypatch):
    t = hist.h1(column(spark, np.random.default_rng(1).normal(size=500)), "x", 40)
    t2 = hist.h2(two(spark, np.random.default_rng(2).normal(size=(300, 2))), "x", "y", [30, 4])
    want = [sorted(map(tuple, f().collect())) for f in (lambda: hist.cumulative(t), lambda: shape.accumulate(t2, 0, 2), lambda: shape.plot_data(t, cumulative=True, density=True))]
    shares = lambda: [sorted(map(tuple, f.collect())) for f in (hist.normalize(t), hist.normalize(t2), shape.bars(t))]
    in_one = shares()
    monkeypatch.setattr(hist, "RUNNING_BINS", 7)
    assert shares() == in_one
    got = [sorted(map(tuple, f().collect())) for f in (lambda: hist.cumulative(t), lambda: shape.accumulate(t2, 0, 2), lambda: shape.plot_data(t, cumulative=True, density=True))]
    for a, b in zip(got, want):
        assert len(a) == len(b) and all(x[:-1] == pytest.approx(y[:-1]) for x, y in zip(a, b))


# --- collections ------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def named(spark):
    return spark.createDataFrame([("a", 1.0, 2.0), ("a", 9.0, 1.0), ("b", 2.0, 1.0), (None, 3.0, 4.0), ("c", None, 1.0), ("b", 4.0, 3.0)], "g string, x double, w double")


def test_collection_of_names(named):
    c = Collection.of(named, "g", "x", [0.0, 2.5, 5.0])
    assert c.names == ["a", "b", "c", None] and len(c) == 4 and "a" in c and None in c and "z" not in c and 3 in c and 4 not in c
    assert [h.frequencies() for h in c] == [[1, 0], [1, 1], [0, 0], [0, 1]] and c["a"].overflow == 1 and c[None].stats.sum == 3.0
    assert c["c"].total == 0 and c.sum().frequencies() == [2, 2] and c.sum().stats.sum == 19.0
    with pytest.raises(KeyError):
        c["z"]
    same = Collection.of(named, "g", "x", [0.0, 2.5, 5.0])
    assert c == same and c != same.add(same["a"]) and c != Collection.of(named, "g", "x", [0.0, 2.6, 5.0])
    assert formats.from_dict(named.sparkSession, formats.to_dict(c)) == c
    assert Collection.of(named, "g", "x", [0.0, 2.5, 5.0], weights="w")["a"].frequencies() == [2.0, 0]


def test_collection_grows(spark, named):
    c = Collection.of(named, "g", "x", [0.0, 2.5, 5.0], name="n")
    d = c.create("a", named.where("g = 'b'"), "x").create(None, named.limit(0), "x")
    assert len(d) == 6 and len(c) == 4 and d["a"] == c["a"] and d[4].frequencies() == [1, 1] and d[5].total == 0  # a name means its first
    assert d.sum().frequencies() == [3, 3] and d.title == "n"
    with pytest.raises(ValueError, match="share"):
        c.add(Histogram.of(named, "x", bins=[0.0, 1.0]))
    t = {(r["number"], r["bin"]): r["frequency"] for r in d.table().collect()}
    assert len(t) == 12 and t[(4, 1)] == 1 and t[(5, 0)] == 0
    assert [h.total for h in d.normalize_all()] == [1, 1, 0, 1, 1, 0]
    assert sum(h.frequencies()[0] for h in d.normalize_bins()) == pytest.approx(1)
    assert Collection.from_histograms(c["a"], c["b"]).sum().frequencies() == [2, 1]
    empty = Collection(spark, B.static([0.0, 1.0]))
    assert empty.sum().frequencies() == [0] and list(empty) == [] and empty.table().count() == 0
    with pytest.raises(ValueError):
        Collection.from_histograms()


def test_collection_of_columns(spark):
    c = Collection.multi(spark, {"p": (column(spark, [0, 1, 2]), "x"), "q": (column(spark, [8, 10], "y"), "y"), "none": (column(spark, []), "x")}, 5)
    assert c.names == ["p", "q", "none"] and c.binning.edges == [0, 2, 4, 6, 8, 10] and c["q"].frequencies() == [0, 0, 0, 0, 2] and c["none"].total == 0


# --- coordinate systems of one's own --------------------------------------------------------------------------------
@pytest.fixture
def elliptic():
    at = {"s": lambda x, y: F.hypot(x, y / 2), "phi": lambda x, y: coords.azimuth(x, y)}
    of = {"s": lambda x, y: math.hypot(x, y / 2), "phi": lambda x, y: math.atan2(y, x) % (2 * math.pi)}
    area = lambda _: (F.col("right0") ** 2 - F.col("left0") ** 2) * (F.col("right1") - F.col("left1"))
    coords.register_coordinates("elliptic", coords.Coordinates(("s", "phi"), (2,), at, of, area, {"phi": coords.FULL}, {("phi",): "azimuthal"}))
    yield
    del coords.SYSTEMS["elliptic"]


def test_own_coordinates(spark, elliptic):
    d = two(spark, [(1, 0), (0, 4), (-3, 0), (0.5, 0)])
    h = Histogram.special(d, "elliptic", "x", "y", bins=[[0.0, 1.5, 2.5], 4])
    assert h.axis_names == ("s", "phi") and h.shape == (2, 4) and h.frequencies() == [2, 0, 0, 0, 0, 1, 0, 0] and h.missed == 1
    assert h.find_bin((0, 4)) == (1, 1) and h.find_bin((2.0, 0.1), transformed=True) == (1, 0) and h.find_bin((-3, 0)) is None
    assert h.fill((0, 4)).frequencies()[5] == 2 and h.fill_n(d, "x", "y").frequencies() == [2 * f for f in h.frequencies()]
    assert h.projection("phi").kind == "azimuthal" and h.projection("s").kind is None and h.projection("phi").frequencies() == [2, 1, 0, 0]
    sizes = [r["size"] for r in h.table().orderBy("bin0", "bin1").collect()]
    assert sizes[0] == pytest.approx(1.5**2 * math.pi / 2) and h.densities()[5] == pytest.approx(1 / (4 * math.pi / 2))
    with pytest.raises(ValueError, match="unknown"):
        Histogram.special(d, "parabolic", "x", "y")
    with pytest.raises(ValueError, match="no function"):
        coords.Coordinates(("u",), (2,), {}, {})
    with pytest.raises(ValueError, match="made from"):
        h.find_bin((1, 2, 3))


# --- free arithmetic ---------------------------------------------------------------------------------------------------
def test_free_arithmetic(spark):
    h = Histogram.of(column(spark, [0, 1, 1, 3, 9]), "x", bins=[0.0, 1.0, 2.0, 4.0])
    for bad in (lambda: h + 1, lambda: h + [1, 2, 3], lambda: h * [1, 2, 3], lambda: h / np.array([1, 2, 3]), lambda: [1, 2, 3] * h):
        with pytest.raises(TypeError):
            bad()
    assert not is_free()
    with free_arithmetic():
        assert (h + [1, 2, 3]).frequencies() == [2, 4, 4] and (h + [1, 2, 3]).errors2() == [2, 4, 4]
        assert (h - 2).frequencies() == [-1, 0, -1] and (h - 2).errors2() == [3, 4, 3]
        assert (h * [2, 0, -1]).frequencies() == [2, 0, -1] and (h * [2, 0, -1]).errors2() == [4, 0, 1]
        assert (np.array([1, 2, 3]) * h).frequencies() == [1, 4, 3] and (h / np.array([2, 1, 4])).frequencies() == [0.5, 2, 0.25]
        got = h + 1
        assert math.isnan(got.missed) and math.isnan(got.stats.sum) and (h * -1).frequencies() == [-1, -2, -1]
        assert (h * [1.5, 1, 1]).whole is False and (h * [2, 2, 2]).whole
        with free_arithmetic(False):
            with pytest.raises(ValueError):
                h * -1
        with pytest.raises(ValueError):
            h + [1, 2]
        with pytest.raises(TypeError):
            h * h
        two_d = Histogram.of(two(spark, [(0, 0), (1, 1)]), "x", "y", bins=2)
        assert (two_d * [[1, 2], [3, 4]]).frequencies() == [1, 0, 0, 4] and (two_d + np.array([1, 2])).frequencies() == [2, 2, 1, 3]
    with pytest.raises(ValueError, match="negative"):
        h * -1


def test_histograms_compared(spark):
    h = Histogram.of(column(spark, [0, 1, 1, 3]), "x", bins=[0.0, 1.0, 2.0, 4.0], name="n")
    assert_histograms_equal(h, h)
    for other, why, off in (
        (h * 2, "bin", {"check_frequencies": False}), (h * 1.0, "types", {"check_dtype": False}),
        (Histogram.of(column(spark, [0, 1, 1, 3]), "x", bins=[0.0, 1.0, 2.0, 5.0], name="n"), "axis", {"check_bins": False, "check_binnings": False}),
        (Histogram.of(column(spark, [0, 1, 1, 3]), "x", bins=[0.0, 1.0, 2.0, 4.0], name="m"), "metadata", {"check_metadata": False}),
    ):
        with pytest.raises(AssertionError, match=why):
            assert_histograms_equal(h, other)
        assert_histograms_equal(h, other, **off)


# --- SQL ----------------------------------------------------------------------------------------------------------------
def test_sql_functions(spark):
    sql.register(spark)
    rng = np.random.default_rng(4)
    edges = B.equal_width(0.1, 0.7, 6).edges
    values = [*edges, *(math.nextafter(e, 9) for e in edges), *(math.nextafter(e, -9) for e in edges), *rng.uniform(-1, 2, 200), None, math.nan]
    d = column(spark, values)
    d.createOrReplaceTempView("points")
    b = B.equal_width(0.1, 0.7, 6)
    want = sorted(map(str, (r[0] for r in d.select(b.assign(F.col("x"))).collect())))
    assert sorted(str(r[0]) for r in spark.sql("SELECT bin_of(x, 0.1, 0.7, 6) FROM points").collect()) == want
    counts = spark.sql("SELECT g.bin, g.left, g.right, coalesce(n, 0) AS frequency FROM bin_grid(0.1, 0.7, 6) g LEFT JOIN (SELECT bin_of(x, 0.1, 0.7, 6) AS bin, count(*) AS n FROM points GROUP BY 1) USING (bin)")
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, hist.h1(d, "x", b).drop("error2").collect()))
    plan = spark.sql("SELECT bin_of(x, 0.1, 0.7, 6) AS bin, count(*) FROM points GROUP BY 1")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for name, own in (("gaps", B.static([(0.0, 0.2), (0.2, 0.3), (0.5, 0.6)])), ("fixed", B.fixed_width(0.1, 0.7, 0.1)), ("many", B.from_edges(np.linspace(0, 1, 400)))):
        sql.register_binning(spark, name, own)
        got = sorted(str(r[0]) for r in spark.sql(f"SELECT {name}(x) FROM points").collect())
        assert got == sorted(str(r[0]) for r in d.select(own.assign(F.col("x"))).collect())
        assert [tuple(r) for r in spark.sql(f"SELECT * FROM {name}_grid() ORDER BY bin").collect()] == [(k, *e) for k, e in enumerate(own.bins)]
    assert spark.sql("SELECT count(*), max(bin), max(right) FROM bin_grid(0, 1, 10000)").first()[:] == (10000, 9999, 1.0)
    got = spark.sql("SELECT bin_by_width(-1, 5, 0), bin_left(2, 0, 1, 4), bin_right(3, 0, 1, 4), bin_among(2, array(0, 1, 2, 3)), bin_among(3, array(0, 1, 2, 3)), bin_among(9, array(0, 1, 2, 3))").first()
    assert got[:] == (-1, 0.5, 1.0, 2, 2, 3) and spark.sql("SELECT * FROM edge_grid(array(0, 1, 5)) ORDER BY bin").collect() == [(0, 0.0, 1.0), (1, 1.0, 5.0)]
    with pytest.raises(Exception, match="positive"):
        spark.sql("SELECT bin_of(x, 1, 0, 6) FROM points").collect()
    with pytest.raises(ValueError):
        sql.register_binning(spark, "drop table", b)


# --- calendar -------------------------------------------------------------------------------------------------------------
MOMENTS = [datetime(2023, 12, 31, 23, 59, 59, 999999), datetime(2024, 1, 1), datetime(2024, 2, 29, 12, 30, 15), datetime(2024, 3, 31, 1, 2, 3), datetime(2025, 7, 6), datetime(1969, 12, 31, 23, 59, 59, 5), datetime(1901, 5, 5), None]


@pytest.mark.parametrize("unit", ["second", "minute", "hour", "day", "week", "month", "quarter", "year"])
def test_calendar_units(spark, unit):
    d = spark.createDataFrame([(t,) for t in MOMENTS], "t timestamp_ntz")
    level = calendar.Level(unit)
    n = level.number(F.col("t"))
    for r in d.select("t", n.alias("n"), level.start(n).alias("a"), level.start(n + 1).alias("b"), F.date_trunc(unit, "t").cast("timestamp_ntz").alias("want")).collect():
        if r["t"] is None:
            assert r["n"] is None
            continue
        assert r["a"] == r["want"] and r["a"] <= r["t"] < r["b"]
        assert level.number_of(r["t"]) == r["n"] and level.start_of(r["n"]) == r["a"]


def test_calendar_histograms(spark):
    d = spark.createDataFrame([(t,) for t in MOMENTS if not t or t.year > 2000], "t timestamp_ntz")
    h = calendar.h1_calendar(d, "t", calendar.Level("month"))
    got = h.orderBy("bin").collect()
    assert [r["frequency"] for r in got] == [1, 1, 1, 1] + [0] * 15 + [1] and got[2]["left"] == datetime(2024, 2, 1) and got[2]["right"] == datetime(2024, 3, 1)
    by_range = calendar.h1_calendar(d, "t", most=4).orderBy("bin").collect()
    assert [r["left"] for r in by_range] == [datetime(2023, 7, 1), datetime(2024, 1, 1), datetime(2024, 7, 1), datetime(2025, 1, 1)][: len(by_range)] or len(by_range) <= 4
    assert sum(r["frequency"] for r in by_range) == 5
    days = spark.createDataFrame([("2024-02-28",), ("2024-03-01",)], "t string").select(F.to_date("t").alias("t"))
    assert [r["frequency"] for r in calendar.h1_calendar(days, "t", calendar.Level("day")).orderBy("bin").collect()] == [1, 0, 1]
    assert calendar.h1_calendar(d.limit(0), "t").count() == 0
    for bad in (lambda: calendar.h1_calendar(column(spark, [1]), "x"), lambda: calendar.Level("fortnight"), lambda: calendar.level_of(MOMENTS[1], MOMENTS[0])):
        with pytest.raises(ValueError):
            bad()


def test_calendar_ticks():
    a = datetime(2024, 1, 1)
    for span, level in ((timedelta(seconds=9), ("second", 1)), (timedelta(minutes=9), ("minute", 1)), (timedelta(days=2), ("hour", 6)), (timedelta(days=9), ("day", 1)), (timedelta(days=60), ("week", 1)), (timedelta(days=1000), ("quarter", 2)), (timedelta(days=40000), ("year", 20))):
        found = calendar.level_of(a, a + span, 10)
        assert (found.unit, found.step) == level and 0 < len(calendar.ticks(a, a + span, 10)) <= 10
    assert [calendar.label_of(t, calendar.Level("quarter")) for t in calendar.ticks(datetime(2024, 1, 2), datetime(2024, 12, 31), level=calendar.Level("quarter"))] == ["2024 Q2", "2024 Q3", "2024 Q4"]


def test_time_ticks():
    assert timeticks.parse_level("5min") == ("min", 5) and timeticks.parse_level("h") == ("hour", 1) and timeticks.parse_level("1.5s") == ("sec", 1.5) and timeticks.parse_level("edges") == ("edge", 0)
    assert timeticks.parse_level(("day", 2)) == ("day", 2) and timeticks.parse_level(timedelta(minutes=90)) == ("min", 90)
    for bad in ("5 parsecs", "x", ("week", 1), "1.5h"):
        with pytest.raises(ValueError):
            timeticks.parse_level(bad)
    assert timeticks.level_of(0, 3) == ("sec", 0.5) and timeticks.level_of(0, 60) == ("sec", 10) and timeticks.level_of(0, 3600) == ("min", 10) and timeticks.level_of(0, 6 * 3600) == ("hour", 1) and timeticks.level_of(0, 12 * 86400) == ("day", 2)
    assert timeticks.ticks(-61, 125, ("min", 1)) == [-60, 0, 60, 120] and timeticks.ticks(0, 2, ("center", 0), B.static([0.0, 1.0, 2.0])) == [0.5, 1.5]
    assert timeticks.labels([-60, 0, 60, 120], ("min", 1)) == ["-1:00", "+0:00", "+1:00", "+2:00"] and timeticks.labels([0, 3600], ("hour", 1)) == ["0:00", "1:00"]
    assert timeticks.labels([86400, 172800], ("day", 1)) == ["1 day", "2 days"] and timeticks.labels([0.5, 1], ("sec", 0.5)) == ["0.5", "1"]


# --- regrouping -------------------------------------------------------------------------------------------------------------
def test_regroup_by_a_map(spark):
    t = hist.h1(column(spark, range(10)), "x", 10)
    to = lambda pairs: spark.createDataFrame(pairs, "old int, new int")
    got = shape.regroup(t, to([(k, 0 if k < 3 else 1 if k < 4 else 2) for k in range(10)])).orderBy("bin").collect()
    assert [(r["bin"], r["left"], r["frequency"]) for r in got] == [(0, 0.0, 3), (1, pytest.approx(2.7), 1), (2, pytest.approx(3.6), 6)]
    for bad, why in (([(k, 0) for k in range(9)], "no group"), ([(k, k % 2) for k in range(10)], "neighbours"), ([(k, 0) for k in range(10)] + [(3, 1)], "two groups")):
        with pytest.raises(Exception, match=why):
            shape.regroup(t, to(bad)).collect()
    gaps = hist.h1(column(spark, [0, 5]), "x", [(0.0, 1.0), (1.0, 2.0), (4.0, 6.0)])
    with pytest.raises(Exception, match="gap"):
        shape.regroup(gaps, to([(0, 0), (1, 1), (2, 1)])).collect()
    assert [r["frequency"] for r in shape.regroup(gaps, to([(0, 0), (1, 0), (2, 1)])).orderBy("bin").collect()] == [1, 1]
    t2 = hist.h2(two(spark, [(0, 0), (1, 1), (2, 2), (3, 3)]), "x", "y", [4, 4])
    got = shape.regroup(t2, to([(0, 0), (1, 0), (2, 1), (3, 1)]), axis=1)
    assert {(r["bin0"], r["bin1"]): r["frequency"] for r in got.collect() if r["frequency"]} == {(0, 0): 1, (1, 0): 1, (2, 1): 1, (3, 1): 1} and got.count() == 8 and got.columns == t2.columns


# --- blocks and quantiles -------------------------------------------------------------------------------------------------------
def full_search(v, n, p0=0.05):
    """Every start of every last block."""
    edges = np.r_[v[0], (v[1:] + v[:-1]) / 2, v[-1]]
    prior = 4 - math.log(73.53 * p0 * n.sum() ** -0.478)
    upto, best, last = np.cumsum(n), np.zeros(len(v)), np.zeros(len(v), int)
    for k in range(len(v)):
        count = upto[k] - np.r_[0, upto[:k]]
        fit = count * (np.log(count) - np.log(edges[k + 1] - edges[: k + 1])) - prior
        fit[1:] += best[:k]
        last[k] = np.argmax(fit)
        best[k] = fit[last[k]]
    cuts, k = [len(v)], len(v)
    while k:
        k = int(last[k - 1])
        cuts.append(k)
    return edges[cuts[::-1]].tolist()


@pytest.mark.parametrize("kind", ["normal", "steps", "whole", "wide"])
def test_blocks_equal_the_full_search(spark, kind):
    rng = np.random.default_rng(8)
    x = {"normal": rng.normal(size=2000), "steps": np.r_[rng.uniform(size=900), rng.uniform(0.3, 0.4, 900)], "whole": rng.integers(0, 60, 4000), "wide": rng.lognormal(3, 4, 1500)}[kind]
    v, n = np.unique(np.asarray(x, float), return_counts=True)
    d = column(spark, x).repartition(3)
    want = full_search(v, n.astype(float))
    assert infer.infer(d, "x", "blocks").edges == pytest.approx(want, rel=1e-12)
    assert blocks.bayesian_blocks(d, "x", segment=max(2, len(v) // 7)).edges == pytest.approx(want, rel=1e-12)  # over several segments


def test_blocks_prune_starts():
    s = blocks.Search(3.0)
    most = 0
    for w in np.diff(np.sort(np.random.default_rng(3).normal(size=20_001))):
        s.add(1.0, float(w))
        most = max(most, len(s.starts))
    assert most < 60


def test_many_quantiles(spark, monkeypatch):
    rng = np.random.default_rng(6)
    at = [k / 300 for k in range(301)]
    for values in (rng.normal(size=5000), rng.integers(0, 9, 5000), np.r_[rng.normal(size=3000), np.full(2000, 0.25)], np.exp(rng.normal(0, 60, 4000)), np.r_[-np.inf, rng.normal(size=2000), np.inf], [7.0]):
        d = column(spark, values).repartition(3)
        want = np.quantile(np.asarray(values, float), at, method="linear")
        for bracket, cells in ((100_000, 65_536), (40, 65_536), (15, 400)):
            monkeypatch.setattr(quantile, "CELLS", cells)
            got = infer.quantiles(d, "x", at, bracket)
            assert all(a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) or math.isnan(b) for a, b in zip(got, want))
    with pytest.raises(ValueError):
        infer.quantiles(column(spark, [1, 2]), "x", [1.5])


# --- data that the driver holds ------------------------------------------------------------------------------------------------
def test_small_data_of_the_driver(spark):
    s = pd.Series([1.0, 2.0, None, 9.0], name="len")
    h = api.h1(spark, s, 4)
    assert h.axis_names == ("len",) and h.frequencies() == [2, 0, 0, 1] and h == api.h1(spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "len double"), "len", 4)
    assert api.h1(spark, pd.Series([1, None, 3], dtype="Int64"), [0.0, 2.0, 4.0]).frequencies() == [1, 1]
    assert api.h2(spark, [1, 2, 3], np.array([4, 5, 6]), 2).axis_names == ("axis0", "axis1")
    assert api.h(spark, np.array([[0, 0], [1, 1], [1, 1]]), bins=2).frequencies() == [1, 0, 0, 2] == api.histogramdd(spark, pd.DataFrame({"a": [0, 1, 1], "b": [0, 1, 1]}), bins=2).frequencies()
    assert api.h1(spark, [1, 2], [0.0, 1.5, 3.0], weights=[3, 4]).frequencies() == [3, 4]
    assert api.polar_histogram(spark, [1.0, 0.0], [0.0, 2.0], bins=[2, 4], ranges=[(0.0, 2.0), None]).frequencies() == [0, 0, 0, 0, 1, 1, 0, 0]
    for bad in (lambda: api.h1(spark, ["a", "b"]), lambda: api.h1(spark, pd.Series(pd.to_datetime(["2024-01-01"]))), lambda: api.h2(spark, [1, 2], [1]), lambda: api.h(spark, np.zeros((2, 2, 2))), lambda: api.h3(spark, [1], [2], [3], weights=[1, 2])):
        with pytest.raises(ValueError):
            bad()
    assert api.frame(spark, [1, 2], names=["a b"]).columns == ["a b"]


def test_edges_and_gaps():
    b = B.as_binning([(0, 1), (1, 2), (4, 5)])
    assert b.edges_with_gaps == ([0, 1, 2, 4, 5], [0, 1, 3]) and B.as_binning(np.array([0, 1, 2])).edges_with_gaps == ([0, 1, 2], [0, 1])
    assert B.as_binning([0, 1, 2]).within(b) and not b.within(B.as_binning([0, 1, 2])) and B.as_binning(b) is b
    assert B.is_rising([0, 1, 2]) and not B.is_rising([0, 2, 1]) and B.is_rising([(0, 1), (3, 4)]) and not B.is_rising([(0, 2), (1, 3)])
    with pytest.raises(ValueError):
        b.edges
