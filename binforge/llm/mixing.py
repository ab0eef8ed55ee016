"""Mixing sources to target weights by Pareto order sampling.

A source whose target is rho times its size gives floor(rho) certain whole copies
of each document; the rest is a sample with unequal inclusion probabilities: pi of a document is
c * size ** POWER, at most 1, with c such that the expected words are the rest of the target. Documents
whose pi is 1 are taken; the others are ranked by their random odds u/(1-u) over
their inclusion odds pi/(1-pi), u being a hash of the id and a seed, and taken in that order until the
words reach the rest, so the size of the sample is fixed in words. Documents of equal rank go in or stay out together.

Sizes are told apart by class (CLASSES to each power of two), so c is solved from a few hundred sums a source.
The place where a source's order stops is found from sums over 1024 ranges of rank,
then over 1024 parts of the one range that holds it; only rows of that last part are
put in order together, which no hot source can make large. A row for each source and class comes to
the driver: this is meant for thousands of sources, not for millions.

Defined results: null text has size 0; null source is a source of its own, the last;
a source or table without words takes nothing; repeated rows are documents of their
own and are taken alike; null ids share one u; other columns are kept by `mix` and ignored by `plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, materialize, table

WEIGHTS, SHARE, MOST, SEED, POWER = (5.0, 2.0, 1.0), 1.5, 2.0, 17, 0.5
PARTS, CLASSES = 1024, 4
#: Tables of a row for each source and class up to this many rows are broadcast (about 60 bytes each).
BROADCAST_ROWS = 200_000


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words to take of each source: share of all by weight, at most `most` times a source's size, the excess reshared."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weigh = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weigh[s] for s in open_)
        over = [s for s in open_ if left * weigh[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weigh[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def size_class(size: Column) -> Column:
    """CLASSES classes for each power of two; sizes 0 and 1 have class 0."""
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * CLASSES).cast("int")


def inclusion(words: dict[int, int], rest: float, power: float = POWER) -> dict[int, float]:
    """pi of each size class, from the words that each holds: c * 2 ** (class * power / CLASSES), at most 1, that expects `rest` words."""
    measure = {k: 2.0 ** (k * power / CLASSES) for k in words}
    left, open_, out = rest, sorted(words, reverse=True), {}
    while open_:  # the largest classes reach 1 first; the others share what they leave
        c = left / max(sum(words[k] * measure[k] for k in open_), 1e-300)
        k = open_[0]
        if c * measure[k] < 1:
            return out | {k: c * measure[k] for k in open_}
        out[k] = 1.0
        left = max(0.0, left - words[k])
        open_ = open_[1:]
    return out


def ranked(d: DataFrame, seed: int) -> DataFrame:
    """d (doc_id, pi) with u and rank, the random odds over the inclusion odds; certain documents have rank 0."""
    lot = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    u = (F.conv(F.substring(lot, 1, 10), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 40))
    odds = F.when(F.col("pi") >= 1, F.lit(0.0)).when(F.col("pi") > 0, (1 - F.col("pi")) / F.col("pi"))
    return d.withColumn("u", u).withColumn("rank", F.col("u") / (1 - F.col("u")) * odds)


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, power: float = POWER) -> DataFrame:
    """doc_id, h (hash of the text), source, size, source_size, target, pi, u, rank, copies."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text", F.col("text").isNull()).alias("h"))
    d = materialize(d.withColumn("class", size_class(F.col("size"))), "mix-sizes")
    words: dict[str | None, dict[int, int]] = {}
    for r in d.groupBy("source", "class").agg(F.sum("size").alias("n")).collect():
        words.setdefault(r["source"], {})[r["class"]] = r["n"]
    sizes = {s: sum(k.values()) for s, k in words.items()}
    goal = targets(sizes, weights, share, most)
    rows = []
    for s, n in sizes.items():
        whole = int(goal[s] // n) if n else 0
        rest = goal[s] - whole * n
        some = rest > 1e-9 * n
        rows += [(s, k, n, float(goal[s]), whole, float(rest) if some else 0.0, p) for k, p in inclusion(words[s], rest if some else 0.0, power).items()]
    per = docs.sparkSession.createDataFrame(rows, "s string, k int, source_size long, target double, whole int, rest double, pi double")
    small = (lambda x: F.broadcast(x)) if len(rows) <= BROADCAST_ROWS else (lambda x: x)
    of_source = F.col("source").eqNullSafe(F.col("s"))
    d = ranked(d.join(small(per), of_source & (F.col("class") == F.col("k"))).drop("s", "k", "class"), seed)
    # ranks between 0 and 1, by which rows fall into ranges and parts of ranges; -1 for certain documents
    v = F.col("rank") / (1 + F.col("rank"))
    at = F.least(F.floor(v * (PARTS * PARTS)), F.lit(PARTS * PARTS - 1)).cast("int")
    at = F.when(F.col("rank") > 0, at)
    d = d.withColumn("r1", F.when(F.col("rank") == 0, -1).otherwise(F.floor(at / PARTS).cast("int"))).withColumn("r2", at % PARTS)

    def stop(rows: DataFrame, by: str, base: Column) -> DataFrame:
        """The one value of `by` at which a source's words reach the rest of its target."""
        w = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        sums = rows.groupBy("source", by).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), base.alias("base"))
        upto = F.col("base") + F.coalesce(F.sum("n").over(w), F.lit(0))
        return sums.withColumn("before", upto).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest")))

    one = stop(d.where(F.col("r1").isNotNull()), "r1", F.lit(0)).select(F.col("source").alias("s"), F.col("r1").alias("c1"), F.col("before").alias("b1"))
    d1 = d.join(small(one), of_source, "left").drop("s")
    two = stop(d1.where((F.col("r1") == F.col("c1")) & (F.col("r1") >= 0)), "r2", F.max("b1")).select(F.col("source").alias("s"), F.col("r2").alias("c2"), F.col("before").alias("b2"))
    d2 = d1.join(small(two), of_source, "left").drop("s")
    edge = F.coalesce((F.col("r1") == F.col("c1")) & (F.col("r2") == F.col("c2")), F.lit(False))
    # all of a source's certain documents go in, and all where its order never stops
    low = (F.col("r1") < F.col("c1")) | ((F.col("r1") == F.col("c1")) & (F.col("r2") < F.col("c2"))) | (F.col("r1") == -1)
    low = F.coalesce(low, F.lit(False))
    w = Window.partitionBy("source").orderBy("rank")
    at_edge = d2.where(edge).withColumn("run", F.sum("size").over(w)).withColumn("own", F.sum("size").over(Window.partitionBy("source", "rank")))
    # the documents that cross the mark go in if that ends nearer to it
    at_edge = at_edge.withColumn("in", F.col("b2") + F.col("run") - F.col("own") / 2 <= F.col("rest")).drop("run", "own")
    both = d2.where(~edge).withColumn("in", low).unionByName(at_edge)
    copies = F.col("whole") + F.when(F.col("in") & (F.col("size") > 0) & (F.col("rest") > 0), 1).otherwise(0)
    return both.select("doc_id", "h", "source", "size", "source_size", "target", "pi", "u", "rank", copies.alias("copies"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """docs' rows, each as often as the plan takes it."""
    names = {c: free_name(docs, c) for c in ("mix_id", "mix_source", "mix_h", "mix_copies", "mix_copy")}
    i, s, h, n, k = names.values()
    # rows of one id, source and text are taken alike, so one row says it for all
    taken = plan(docs, **settings).where(F.col("copies") > 0).groupBy("doc_id", "source", "h").agg(F.max("copies").alias(n)).select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("h").alias(h), n)
    here = f"_{h}"
    d = docs.withColumn(here, F.xxhash64("text", F.col("text").isNull()))
    d = d.join(taken, (F.col(here) == F.col(h)) & F.col("doc_id").eqNullSafe(F.col(i)) & docs["source"].cast("string").eqNullSafe(F.col(s)))
    return d.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n)))).select(docs.columns)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).cast("long").alias("taken"), F.col("copies").cast("int").alias("copies"))


ORACLE = f"""
WITH w AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
c AS (SELECT *, floor(log2(greatest(size, 1)::DOUBLE) * {CLASSES})::INT AS class FROM w),
src AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM c GROUP BY source),
wt AS (SELECT *, CASE r % 3 WHEN 0 THEN {WEIGHTS[0]!r}::DOUBLE WHEN 1 THEN {WEIGHTS[1]!r}::DOUBLE ELSE {WEIGHTS[2]!r}::DOUBLE END AS weigh FROM src),
lv AS (SELECT *, ({SHARE!r}::DOUBLE * sum(n) OVER () - coalesce(sum({MOST!r}::DOUBLE * n) OVER (ORDER BY n / weigh, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weigh) OVER (ORDER BY n / weigh, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM wt),
lev AS (SELECT arg_min(level, n / weigh) AS level FROM lv WHERE level * weigh <= {MOST!r}::DOUBLE * n),
t AS (SELECT source, n, least({MOST!r}::DOUBLE * n, coalesce(level * weigh, {MOST!r}::DOUBLE * n)) AS target FROM wt, lev),
f AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS whole FROM t),
g AS (SELECT *, CASE WHEN target - whole * n > 1e-9 * n THEN target - whole * n ELSE 0 END AS rest FROM f),
k AS (SELECT source, class, sum(size) AS words, pow(2, class * {POWER!r}::DOUBLE / {CLASSES}) AS m FROM c GROUP BY ALL),
o AS (SELECT k.source, class, words, m, greatest(0, rest - coalesce(sum(words) OVER (PARTITION BY k.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / greatest(sum(words * m) OVER (PARTITION BY k.source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1e-300) AS c
      FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source),
z AS (SELECT source, arg_max(c, class) AS c, max(class) AS top FROM o WHERE c * m < 1 GROUP BY source),
pi AS (SELECT o.source, o.class, CASE WHEN top IS NULL OR o.class > top THEN 1e0 ELSE z.c * m END AS pi FROM o LEFT JOIN z ON o.source IS NOT DISTINCT FROM z.source),
u AS (SELECT doc_id, c.source, size, pi, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}'), 1, 10))::BIGINT + 0.5) / 1099511627776e0 AS u
      FROM c JOIN pi ON c.source IS NOT DISTINCT FROM pi.source AND c.class = pi.class),
q AS (SELECT *, CASE WHEN pi >= 1 THEN 0e0 WHEN pi > 0 THEN u / (1 - u) * ((1 - pi) / pi) END AS rank FROM u),
x AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank) - sum(size) OVER (PARTITION BY source, rank) / 2e0 AS middle FROM q)
SELECT doc_id, size, n AS source_size, round(target, 6) AS target, (size * copies)::BIGINT AS taken, copies FROM (
  SELECT x.*, n, target, (whole + CASE WHEN size > 0 AND rest > 0 AND (rank = 0 OR (rank > 0 AND middle <= rest)) THEN 1 ELSE 0 END)::INT AS copies
  FROM x JOIN g ON x.source IS NOT DISTINCT FROM g.source)
"""
