"""Histograms that grow: tables of several axes, stores that go on after a stop, stored histograms, all marginals at once."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from binforge.functions import meta
from binforge.operators import coords, hist, shape
from binforge.operators.arithmetic import free_arithmetic
from binforge.operators.histogram import Histogram
from binforge.operators.marginals import marginals
from binforge.sources import formats, stored
from binforge.streaming import adaptive
from binforge.streaming.store import BinStore

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(11)
    rows = [(float(x), float(y), float(w)) for x, y, w in zip(rng.normal(0, 40, 3000), rng.exponential(9, 3000), rng.integers(1, 5, 3000))]
    return spark.createDataFrame(rows + [(None, 1.0, 1.0), (1.0, math.nan, 1.0)], "x double, y double, w double").repartition(3).cache()


def rows(d, *without):
    cols = [c for c in d.columns if c not in without]
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.select(*cols).collect())


# --- tables of several axes -----------------------------------------------------------------------------
def test_merge_and_fill_in_2d(spark, points):
    a, b = points.where("x < 0"), points.where("x >= 0 OR x IS NULL")
    whole = adaptive.adaptive_nd(points, ["x", "y"], [10.0, 5.0], weights="w", shifts=[1.0, 0.0])
    make = lambda d: adaptive.adaptive_nd(d, ["x", "y"], [10.0, 5.0], weights="w", shifts=[1.0, 0.0])
    assert rows(adaptive.merge(make(a), make(b))) == rows(whole)
    assert rows(adaptive.fill(make(a), b, "x", "y", weights="w")) == rows(whole)
    assert "error2" in whole.columns and "error2" not in adaptive.adaptive_nd(points, ["x", "y"], [10.0, 5.0]).columns
    with pytest.raises(ValueError, match="width"):
        adaptive.merge(make(a), adaptive.adaptive_nd(b, ["x", "y"], [10.0, 6.0], weights="w"))
    with pytest.raises(ValueError, match="axes"):
        adaptive.merge(make(a), adaptive.adaptive(b, "x", 10.0))
    with pytest.raises(Exception, match="too far"):
        adaptive.adaptive_nd(spark.createDataFrame([(1e300, 1.0)], "x double, y double"), ["x", "y"], [1.0, 1.0]).collect()
    # tables that have lost their metadata tell their rule by their edges
    bare = spark.createDataFrame([tuple(r) for r in make(a).collect()], make(a).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "))
    assert meta.axes_of(bare) == [None, None] and rows(adaptive.merge(bare, make(b))) == rows(whole)


def test_fill_gaps_in_2d(points):
    whole = adaptive.adaptive_nd(points, ["x", "y"], [25.0, 10.0], errors=True)
    full = adaptive.fill_gaps(whole).collect()
    held = {(r["bin0"], r["bin1"]): (r["frequency"], r["error2"]) for r in whole.collect()}
    (a, b), (c, d) = ((min(k), max(k)) for k in zip(*held))
    assert len(full) == (b - a + 1) * (d - c + 1)
    assert all((r["frequency"], r["error2"]) == held.get((r["bin0"], r["bin1"]), (0, 0)) and r["left1"] == 10.0 * r["bin1"] for r in full)
    weighted = adaptive.fill_gaps(adaptive.adaptive(points, "x", 25.0, weights="w"))
    assert sum(r["error2"] for r in weighted.collect()) == points.where("x IS NOT NULL").agg(F.sum(F.col("w") ** 2)).first()[0]


def test_add_in_2d(points):
    a, b = points.where("x < 10 AND y < 20"), points.where("x >= 30 AND y >= 10")
    bins = dict(bins=["fixed_width", [0.0, 1.0, 5.0, 100.0]], bin_width=[10.0, None])
    p, q = (hist.h(d, ["x", "y"], **bins) for d in (a, b))
    got = hist.add(p, q)
    want = hist.h(a.union(b), ["x", "y"], **bins)
    assert rows(got) == rows(want)  # with the empty bins between the two
    assert rows(hist.add(p, p)) == [(*r[:6], 2 * r[6], 2 * r[7]) for r in rows(p)]
    with pytest.raises(ValueError, match="compatible"):
        hist.add(p, hist.h(b, ["x", "y"], ["fixed_width", [0.0, 1.0, 6.0, 100.0]], bin_width=[10.0, None]))
    with pytest.raises(ValueError, match="compatible"):
        hist.add(p, hist.h(b, ["x", "y"], ["fixed_width", [0.0, 1.0, 5.0, 100.0]], bin_width=[7.0, None]))
    with pytest.raises(ValueError, match="axes"):
        hist.add(p, hist.h1(b, "x"))
    with pytest.raises(Exception, match="negative"):
        hist.add(p, hist.add(p, p), -1).collect()
    with free_arithmetic():
        assert sum(r["frequency"] for r in hist.add(p, hist.add(p, p), -1).collect()) == -sum(r[6] for r in rows(p))


def test_dense_grids_are_bounded(points):
    with pytest.raises(ValueError, match="dense"):
        hist.h(points, ["x", "y", "x"], [1000, 1000, 1000])
    sparse = hist.h(points, ["x", "y", "x"], [1000, 1000, 1000], dense=False)
    assert sparse.count() <= 3000 and sparse.agg(F.sum("frequency")).first()[0] == 3000
    assert rows(hist.h(points, ["x", "y"], [7, [0.0, 1.0, 500.0]], dense=False)) == [r for r in rows(hist.h(points, ["x", "y"], [7, [0.0, 1.0, 500.0]])) if r[6]]


# --- marginals ------------------------------------------------------------------------------------------
def test_marginals(points):
    d = points.withColumn("z", F.col("x") % 7)
    cols, bins = ["x", "y", "z"], [5, [0.0, 4.0, 20.0], 3]
    got = {}
    for r in marginals(d, cols, bins, weights="w").collect():
        got.setdefault(r["axes"], {})[(r["bin0"], r["bin1"])] = (r["frequency"], r["error2"])
    whole = hist.h(d, cols, bins, weights="w")
    for k in (1, 2):
        for c in itertools.combinations(range(3), k):
            want = {tuple([*(r[f"bin{i}"] for i in c), None][:2]): (r["frequency"], r["error2"]) for r in hist.projection(whole, *c).collect() if r["frequency"]}
            assert got[",".join(cols[i] for i in c)] == want
    assert len(got) == 6
    total = marginals(d, cols, bins, sizes=[3]).collect()
    assert {r["axes"] for r in total} == {"x,y,z"} and sum(r["frequency"] for r in total) == hist.h(d, cols, bins).agg(F.sum("frequency")).first()[0]
    for bad in ([], [0], [4]):
        with pytest.raises(ValueError):
            marginals(d, cols, bins, sizes=bad)


def test_marginals_scan_once(points):
    text = marginals(points, ["x", "y"], [[0.0, 1.0, 2.0], [0.0, 5.0]])._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Expand") == 1 and text.count("InMemoryRelation") == 1


# --- a store that goes on ----------------------------------------------------------------------------------
def test_a_replayed_batch_changes_nothing(spark, points, tmp_path):
    store = BinStore.create(spark, str(tmp_path / "s"), ["x", "y"], [10.0, 5.0], weights="w")
    parts = [points.where(F.col("x") < -20), points.where((F.col("x") >= -20) & (F.col("x") < 10)), points.where(F.col("x") >= 10), points.where("x IS NULL")]
    for k, p in enumerate(parts):
        store.put(p, k)
    whole = rows(adaptive.adaptive_nd(points, ["x", "y"], [10.0, 5.0], weights="w"))
    assert rows(store.table()) == whole
    store.put(parts[1], 1)  # again
    assert rows(store.table()) == whole
    store.compact()
    assert store._state() == (3, []) and rows(store.table()) == whole
    store.put(parts[2], 2)  # again, after it went into the base
    assert rows(store.table()) == whole
    assert store.add(parts[0]) == 4 and rows(store.table()) == rows(adaptive.adaptive_nd(points.union(parts[0]), ["x", "y"], [10.0, 5.0], weights="w"))
    with pytest.raises(ValueError, match="another"):
        BinStore.create(spark, str(tmp_path / "s"), ["x", "y"], [10.0, 6.0], weights="w")
    assert BinStore.create(spark, str(tmp_path / "s"), ["x", "y"], [10.0, 5.0], weights="w").rules == store.rules


def test_half_written_folders_do_not_count(spark, points, tmp_path):
    store = BinStore.create(spark, str(tmp_path / "s"), ["x"], [10.0])
    store.put(points, 0)
    want = rows(store.table())
    for folder in ("batches/1", "bases/0"):  # stopped before Spark marked them as whole
        adaptive.adaptive(points, "x", 10.0, weights="w").write.parquet(f"{store.path}/{folder}")
        (tmp_path / "s" / folder / "_SUCCESS").unlink()
    assert rows(store.table()) == want
    store.compact()
    assert rows(store.table()) == want and store._state() == (0, [])
    assert rows(BinStore(spark, store.path).table()) == rows(adaptive._counted(points, ["x"], [""], [(10.0, 0.0)], None))


def test_a_stream_stopped_between_batches(spark, tmp_path):
    d = spark.read.parquet(EVENTS).select("value", F.expr("CAST(event_id % 3 + 1 AS DOUBLE)").alias("w") if "event_id" in spark.read.parquet(EVENTS).columns else F.lit(2.0).alias("w"))
    d.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = BinStore.create(spark, str(tmp_path / "store"), ["value"], [10.0], weights="w")
    whole = store.put

    def stops(df, batch, *more):
        whole(df, batch, *more)
        if batch == 2:  # counted and written, but the stream doesn't come to know of it
            raise RuntimeError("stopped")

    store.put = stops
    first = store.start(stream(), str(tmp_path / "state"), availableNow=True)
    with pytest.raises(Exception, match="stopped"):
        first.awaitTermination()
    again = BinStore(spark, str(tmp_path / "store"))
    assert again._state()[1] == [0, 1, 2]
    seen = []
    put = again.put
    again.put = lambda df, batch, *more: (seen.append(batch), put(df, batch, *more))
    again.start(stream(), str(tmp_path / "state"), compact=4, availableNow=True).awaitTermination()
    assert seen[0] == 2 and again._state()[0] >= 3  # the batch in doubt was replayed; the store added up on the way
    assert rows(again.table()) == rows(adaptive.adaptive(d, "value", 10.0, weights="w"))


def test_a_store_of_polar_coordinates(spark, points, tmp_path):
    store = BinStore.create(spark, str(tmp_path / "s"), ["x", "y"], [20.0, math.pi / 4], kind="polar")
    store.add(points.where("w < 3"))
    store.add(points.where("w >= 3"))
    d, at = coords.transformed(points, "polar", ["x", "y"], False, [])
    assert rows(store.table()) == rows(adaptive.adaptive_nd(d, list(at), [20.0, math.pi / 4], errors=True))


# --- kept as a table ------------------------------------------------------------------------------------------
def test_saved_loaded_and_filled_on(spark, points, tmp_path):
    a, b = points.where("x < 0"), points.where("x >= 0")
    for k, (cols, how) in enumerate([(["x"], {"bins": "fixed_width", "bin_width": 10.0, "adaptive": True}), (["x", "y"], {"bins": [[-50.0, 0.0, 10.0, 50.0], 4]}), (["y"], {"bins": [(0.0, 1.0), (2.0, 3.0)]})]):
        h = Histogram.of(a, *cols, weights="w", name="n", title="t", **how)
        stored.save(h, f"{tmp_path}/{k}")
        back = stored.load(spark, f"{tmp_path}/{k}")
        assert back == h and back.axes == h.axes and [x.rule for x in back.axes] == [x.rule for x in h.axes] and repr(back.stats) == repr(h.stats) and back.missed == h.missed
        on = stored.go_on(spark, f"{tmp_path}/{k}", b, *cols, to=f"{tmp_path}/{k}-on", weights="w")
        assert on == h.fill_n(b, *cols, weights="w") and stored.load(spark, f"{tmp_path}/{k}-on") == on
        if k == 0:
            once = Histogram.of(points, "x", bins="fixed_width", bin_width=10.0, weights="w", name="n", title="t")
            assert on == once and on.stats.sum == pytest.approx(once.stats.sum)
    with pytest.raises(Exception, match="exist"):
        stored.save(h, f"{tmp_path}/0")


def test_tables_know_their_axes(spark, points, tmp_path):
    t = hist.h(points, ["x", "y"], [[-50.0, 0.0, 10.0], 4])
    stored.save(t, f"{tmp_path}/t")
    back = stored.load_table(spark, f"{tmp_path}/t")
    assert meta.axes_of(back) == meta.axes_of(t) and meta.binning_of(meta.axes_of(back)[1]).rule
    h = stored.from_table(back)
    of = Histogram.of(points, "x", "y", bins=[[-50.0, 0.0, 10.0], 4])
    assert h.frequencies() == of.frequencies() and h.axis_names == ("x", "y") and h.axes == of.axes
    assert rows(shape.select_axis(back, 0, -1)) == rows(shape.select_axis(t, 0, 1))
    with pytest.raises(ValueError):
        stored.from_table(spark.createDataFrame([(0, 1, 1.0)], "bin long, frequency long, error2 double"))
    text = formats.to_json(t)
    assert meta.axes_of(formats.from_json(spark, text)) == meta.axes_of(t)


def test_one_json_format(spark, points, tmp_path):
    h = Histogram.of(points, "x", bins="fixed_width", bin_width=25.0)
    formats.save_json(h, f"{tmp_path}/h")
    back = formats.load_json(spark, f"{tmp_path}/h")
    assert back == h and back.set_adaptive().fill(1000.0).shape[0] > h.shape[0]
    old = h.to_dict()
    old |= {"version": 1, "axes": [{"bins": [list(b) for b in a.bins], "closed": a.closed, "width": a.width, "rule": list(a.rule)} for a in h.axes]}
    del old["type"], old["meta"]
    assert formats.from_dict(spark, old) == h  # of the version before
    with pytest.raises(ValueError, match="newer"):
        formats.from_dict(spark, {"version": 9, "type": "histogram"})
