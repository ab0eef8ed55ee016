"""Queries of histograms that grow, are stored, collected, regrouped or made in SQL, each with its SQL where there is one."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from binforge.functions import calendar, sql
from binforge.operators import coords, hist, shape
from binforge.operators.arithmetic import free_arithmetic
from binforge.operators.collection import Collection
from binforge.operators.histogram import Histogram
from binforge.operators.marginals import marginals
from binforge.sources import stored
from binforge.sources.io import shared_folder, table
from binforge.streaming import adaptive as stream
from binforge.streaming.store import BinStore

from . import catalog as c

_FOUR, _FOUR_BINS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"], [10, 5, 4, 6]
_FIFTY = [0.0, 10.0, 20.0, 30.0, 40.0, 50.0]


def _flags(d):
    return [d.where(F.col("l_returnflag") == f) for f in "ANR"]


def _store(spark, sf_dir):
    """Three batches, one of them twice; added up; the last one again."""
    store = BinStore.create(spark, shared_folder(spark, "bins"), ["l_quantity", "l_extendedprice"], [10.0, 20000.0], weights="l_linenumber")
    parts = _flags(table(spark, sf_dir, "lineitem"))
    for batch in (0, 1, 1, 2):
        store.put(parts[batch], batch)
    store.compact()
    store.put(parts[2], 2)
    return store.table()


def _polar_store(spark, sf_dir):
    d = c._xyz(table(spark, sf_dir, "embeddings"))
    store = BinStore.create(spark, shared_folder(spark, "bins"), ["x", "y"], [0.125, math.pi / 8], kind="polar")
    for part in (d.where("z < 0"), d.where("z >= 0")):
        store.add(part)
    return store.table().select("bin0", "bin1", "frequency")


def _saved(spark, sf_dir):
    """Stored, loaded and filled on: as one pass over all."""
    a, *rest = _flags(table(spark, sf_dir, "lineitem"))
    at = shared_folder(spark, "histogram")
    stored.save(Histogram.of(a, "l_extendedprice", bins="fixed_width", bin_width=5000.0, adaptive=True), f"{at}/0")
    for k, part in enumerate(rest):
        stored.go_on(spark, f"{at}/{k}", part, "l_extendedprice", to=f"{at}/{k + 1}")
    return c._flat(stored.load(spark, f"{at}/{len(rest)}").table())


def _added_nd(d):
    at = lambda x: hist.h(x, ["l_quantity", "l_extendedprice"], ["fixed_width", "fixed_width"], bin_width=[10.0, 20000.0])
    low, high = d.where("l_quantity <= 15 AND l_returnflag = 'A'"), d.where("l_quantity > 35 AND l_returnflag <> 'A'")
    return hist.add(at(low), at(high)).select("bin0", "left0", "bin1", "left1", "frequency", "error2")


def _collection(d):
    own = Collection.of(d, "l_returnflag", "l_quantity", _FIFTY)
    return own.create("cheap", d.where("l_extendedprice < 20000"), "l_quantity").table().select("number", "name", "bin", "frequency", "error2")


def _elliptic(d):
    at = {"s": lambda x, y: F.hypot(x, y / 2), "phi": coords.azimuth}
    of = {"s": lambda x, y: math.hypot(x, y / 2), "phi": lambda x, y: math.atan2(y, x) % (2 * math.pi)}
    area = lambda _: (F.col("right0") ** 2 - F.col("left0") ** 2) * (F.col("right1") - F.col("left1"))
    coords.register_coordinates("elliptic", coords.Coordinates(("s", "phi"), (2,), at, of, area, {"phi": coords.FULL}, {("phi",): "azimuthal"}))
    return Histogram.special(c._xyz(d), "elliptic", "x", "y", bins=[c._RADII, 8]).table().select("bin0", "bin1", "frequency", F.round("size", 9).alias("size"))


def _polar_filled(d):
    d = c._xyz(d)
    got = Histogram.special(d, "polar", "x", "y", bins=[c._RADII, 8]).fill_n(d, "x", "y").table()
    return got.select("bin0", "bin1", "frequency", F.round("size", 9).alias("size"))


def _surface(d):
    got = Histogram.special(c._xyz(d), "cylindrical", "x", "y", "z", bins=[[0.0, 0.5, 2.0], 8, c._HEIGHTS]).projection("phi", "z").table()
    return got.select("bin0", "bin1", "frequency", F.round("size", 9).alias("size"))


def _regrouped(spark, sf_dir):
    h = hist.h1(table(spark, sf_dir, "orders"), "o_totalprice", 40)
    return c._flat(shape.regroup(h, spark.range(40).select(F.col("id").alias("old"), F.floor(F.sqrt("id")).alias("new"))))


def _free(d):
    h = Histogram.of(d, "l_quantity", bins=_FIFTY)
    with free_arithmetic():
        return (h * [1, 2, 3, 4, 5] - [10_000_000] * 5).table().select("bin", "frequency", "error2")


def _in_sql(spark, sf_dir):
    sql.register(spark)
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("binned_lineitem")
    return spark.sql("""
WITH m AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM binned_lineitem),
n AS (SELECT bin_of(l_quantity, lo, hi, 10) AS bin, count(*) AS n FROM binned_lineitem, m GROUP BY 1)
SELECT g.bin, round(g.left, 6) AS left, round(g.right, 6) AS right, coalesce(n, 0) AS frequency FROM m, LATERAL bin_grid(lo, hi, 10) g LEFT JOIN n ON n.bin = g.bin""")


def _calendar(d, col, *level, **how):
    got = calendar.h1_calendar(d, col, calendar.Level(*level) if level else None, **how)
    day = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(x)
    return got.select(day("left"), day("right"), "frequency")


QUERIES = {
    "h2_store_restarted": _store,
    "polar_store": _polar_store,
    "h1_saved_filled": _saved,
    "marginals_lineitem": c._on("lineitem", lambda d: marginals(d, _FOUR, _FOUR_BINS).select("axes", "bin0", F.coalesce("bin1", F.lit(-1)).alias("bin1"), "frequency")),
    "h2_added": c._on("lineitem", _added_nd),
    "h2_adaptive_merge": c._on("lineitem", lambda d: stream.merge(*(stream.adaptive_nd(x, ["l_quantity", "l_extendedprice"], [10.0, 20000.0], weights="l_linenumber") for x in _flags(d)))),
    "h2_adaptive_filled": c._on("lineitem", lambda d: stream.fill_gaps(stream.fill(stream.adaptive_nd(_flags(d)[0], ["l_quantity", "l_extendedprice"], [10.0, 20000.0], errors=True), d.where("l_returnflag <> 'A'"), "l_quantity", "l_extendedprice"))),
    "collection_object": c._on("lineitem", _collection),
    "collection_object_shares": c._on("lineitem", lambda d: Collection.of(d, "l_returnflag", "l_quantity", _FIFTY).normalize_bins().table().select("name", "bin", F.round("frequency", 9).alias("frequency"))),
    "h1_quantile_100": c._on("lineitem", lambda d: hist.h1(d, "l_extendedprice", "quantile", bin_count=100).select("bin", F.round("left", 4).alias("left"), F.round("right", 4).alias("right"), "frequency")),
    "h1_blocks": c._on("events", lambda d: hist.h1(d, "value", "blocks").select("bin", "left", "right", "frequency")),
    "elliptic_embeddings": c._on("embeddings", _elliptic),
    "polar_filled": c._on("embeddings", _polar_filled),
    "cylinder_surface_projected": c._on("embeddings", _surface),
    "h1_regrouped": _regrouped,
    "h1_free_arithmetic": c._on("lineitem", _free),
    "h1_in_sql": _in_sql,
    "h1_calendar_week": c._on("events", lambda d: _calendar(d, "ts", "week")),
    "h1_calendar_chosen": c._on("events", lambda d: _calendar(d, "ts", most=50)),
    "h1_calendar_quarter": c._on("orders", lambda d: _calendar(d, "o_orderdate", "quarter")),
    "h2_sparse": c._on("lineitem", lambda d: hist.h(d, ["l_quantity", "l_extendedprice"], [1000, 1000], dense=False).agg(F.count("*").alias("bins"), F.sum("frequency").alias("frequency"), F.max("frequency").alias("most"))),
}

_N4, _ = c._nd(list(zip(_FOUR, _FOUR_BINS)))
_SETS = [[i] for i in range(4)] + [[i, k] for i in range(4) for k in range(i + 1, 4)]
_KEYS = "floor(l_quantity / 10e0)::BIGINT b0, floor(l_extendedprice / 20000e0)::BIGINT b1"
_EDGES = "b0 AS bin0, b0 * 10e0 AS left0, b0 * 10e0 + 10 AS right0, b1 AS bin1, b1 * 20000e0 AS left1, b1 * 20000e0 + 20000 AS right1"
_SUMS = "sum(l_linenumber)::DOUBLE AS frequency, sum(l_linenumber * l_linenumber)::DOUBLE AS error2"
_NESTED = "WITH x AS (SELECT {} FROM lineitem WHERE {}), m AS (SELECT min(b0) a, max(b0) b, min(b1) c, max(b1) d FROM x), g AS (SELECT b0, b1 FROM (SELECT unnest(range(a, b + 1)) b0 FROM m), (SELECT unnest(range(c, d + 1)) b1 FROM m)), n AS (SELECT b0, b1, count(*) n FROM x GROUP BY ALL) "
_FIVE = "e AS (SELECT i AS bin, i * 10e0 l, i * 10e0 + 10 r FROM range(0, 5) t(i))"
_HELD = "q >= l AND (q < r OR (bin = 4 AND q = r))"
_CAL = """WITH d AS (SELECT date_trunc('{unit}', {col}) t FROM {table} WHERE {col} IS NOT NULL), m AS (SELECT min(t) a, max(t) b FROM d),
g AS (SELECT unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL {step})) t FROM m)
SELECT strftime(g.t, '%Y-%m-%d %H:%M:%S') AS "left", strftime(g.t + INTERVAL {step}, '%Y-%m-%d %H:%M:%S') AS "right", count(d.t) AS frequency FROM g LEFT JOIN d ON d.t = g.t GROUP BY g.t"""
_Q100 = ", ".join(str(k / 100) for k in range(101))

ORACLE_SQL = {
    "h2_store_restarted": f"SELECT {_EDGES}, {_SUMS} FROM (SELECT *, {_KEYS} FROM lineitem) GROUP BY b0, b1",
    "h2_adaptive_merge": f"SELECT {_EDGES}, {_SUMS} FROM (SELECT *, {_KEYS} FROM lineitem) GROUP BY b0, b1",
    "h2_adaptive_filled": _NESTED.format(_KEYS, "true") + f"SELECT {_EDGES}, coalesce(n, 0) AS frequency, coalesce(n, 0)::DOUBLE AS error2 FROM g LEFT JOIN n USING (b0, b1)",
    "polar_store": "WITH v AS (SELECT embedding[1]::DOUBLE x, embedding[2]::DOUBLE y FROM embeddings), u AS (SELECT sqrt(x*x+y*y) r, CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2*pi() ELSE atan2(y, x) END phi FROM v) SELECT floor(r / 0.125)::BIGINT AS bin0, floor(phi / (pi() / 8))::BIGINT AS bin1, count(*) AS frequency FROM u GROUP BY ALL",
    "h1_saved_filled": c.ORACLE_SQL["object_merged"],
    "marginals_lineitem": _N4 + " UNION ALL ".join(f"SELECT '{','.join(_FOUR[i] for i in s)}' AS axes, bin{s[0]} AS bin0, {f'bin{s[1]}' if len(s) > 1 else '-1::BIGINT'} AS bin1, sum(n)::BIGINT AS frequency FROM g GROUP BY ALL" for s in _SETS),
    "h2_added": _NESTED.format(_KEYS, "(l_quantity <= 15 AND l_returnflag = 'A') OR (l_quantity > 35 AND l_returnflag <> 'A')") + "SELECT b0 - a AS bin0, b0 * 10e0 AS left0, b1 - c AS bin1, b1 * 20000e0 AS left1, coalesce(n, 0) AS frequency, coalesce(n, 0)::DOUBLE AS error2 FROM g LEFT JOIN n USING (b0, b1), m",
    "collection_object": f"WITH {_FIVE}, n(number, name) AS (SELECT (row_number() OVER (ORDER BY f) - 1)::INT, f FROM (SELECT DISTINCT l_returnflag f FROM lineitem) UNION ALL SELECT (SELECT count(DISTINCT l_returnflag) FROM lineitem)::INT, 'cheap'), x AS (SELECT l_returnflag f, l_quantity q FROM lineitem UNION ALL SELECT 'cheap', l_quantity FROM lineitem WHERE l_extendedprice < 20000) SELECT number, name, bin, count(q) AS frequency, count(q)::DOUBLE AS error2 FROM n CROSS JOIN e LEFT JOIN x ON f = name AND {_HELD} GROUP BY ALL",
    "collection_object_shares": f"WITH {_FIVE}, x AS (SELECT l_returnflag f, l_quantity q FROM lineitem), n AS (SELECT f, bin, count(*) n FROM x JOIN e ON {_HELD} GROUP BY ALL) SELECT a.f AS name, e.bin, round(coalesce(n, 0) / (sum(coalesce(n, 0)) OVER (PARTITION BY e.bin))::DOUBLE, 9) AS frequency FROM (SELECT DISTINCT f FROM x) a CROSS JOIN e LEFT JOIN n ON n.f = a.f AND n.bin = e.bin",
    "h1_quantile_100": f"WITH q AS (SELECT quantile_cont(l_extendedprice, [{_Q100}]) q FROM lineitem), e AS (SELECT i - 1 AS bin, q[i] l, q[i+1] r FROM q, range(1, 101) t(i)) SELECT bin, round(l, 4) AS \"left\", round(r, 4) AS \"right\", count(l_extendedprice) AS frequency FROM e LEFT JOIN lineitem ON l_extendedprice >= l AND (l_extendedprice < r OR (bin = 99 AND l_extendedprice = r)) GROUP BY ALL",
    "elliptic_embeddings": c._angles([("s", c._RADII), c._PHI], "(r0 * r0 - l0 * l0) * (r1 - l1)").replace("sqrt(x*x+y*y) rho", "sqrt(x*x+y*y/4) s"),
    "polar_filled": c._angles([("rho", c._RADII), c._PHI], "(r0 * r0 - l0 * l0) / 2 * (r1 - l1)").replace("count(r) AS frequency", "2 * count(r) AS frequency"),
    "cylinder_surface_projected": c._angles([c._PHI, ("z", c._HEIGHTS)], "(r0 - l0) * (r1 - l1) * 2"),
    "h1_regrouped": c._sql("orders", "o_totalprice", 40, pick="floor(sqrt(bin))::BIGINT AS bin, round(min(l), 6) AS \"left\", round(max(r), 6) AS \"right\", sum(frequency)::BIGINT AS frequency", tail=" GROUP BY floor(sqrt(bin))"),
    "h1_free_arithmetic": f"WITH {_FIVE}, x AS (SELECT l_quantity q FROM lineitem) SELECT bin, (bin + 1) * count(q) - 10000000 AS frequency, ((bin + 1) * (bin + 1) * count(q) + 10000000)::DOUBLE AS error2 FROM e LEFT JOIN x ON {_HELD} GROUP BY bin",
    "h1_in_sql": c.ORACLE_SQL["h1_numpy_quantity"],
    "h1_calendar_week": _CAL.format(unit="week", col="ts", table="events", step="7 DAY"),
    "h1_calendar_chosen": _CAL.format(unit="day", col="ts", table="events", step="1 DAY"),
    "h1_calendar_quarter": _CAL.format(unit="quarter", col="o_orderdate", table="orders", step="3 MONTH"),
    "h2_sparse": "WITH m AS (SELECT min(l_quantity)::DOUBLE a, max(l_quantity)::DOUBLE b, min(l_extendedprice)::DOUBLE c, max(l_extendedprice)::DOUBLE d FROM lineitem), x AS (SELECT least(floor((l_quantity - a) / ((b - a) / 1000)), 999) i, least(floor((l_extendedprice - c) / ((d - c) / 1000)), 999) k FROM lineitem, m), n AS (SELECT count(*) n FROM x GROUP BY i, k) SELECT count(*) AS bins, sum(n)::BIGINT AS frequency, max(n) AS most FROM n",
}
