"""Benchmark decontamination by spaced-seed hashing.

Fixed masks of SPAN tokens hash only their 1 positions, so a substituted token
under a 0 leaves the hash as it is. Test hashes are joined with training hashes;
around each hit the item and the document are aligned token by token, without gaps.
It is an overlap if the best stretch scores MIN_SCORE or more (+1 for an equal token, -4 for
a substitution, which asks for four equal tokens of five), or if SHARE of the item's tokens
or more stand in place, which for short items allows the same rate of substitutions. Items
of LEAST to SPAN - 1 tokens are sought whole, by a mask as long as they are.

Seeds travel as hash, id and place. Where items are few, their seeds and tokens go to every
task; where they are many (more than BROADCAST_BYTES), seeds are joined by a shuffle and tokens fetched
for hits only. Both give the same rows.

Tokens are runs of letters and digits, lower case. Defined results: null or empty
texts, and items of fewer than LEAST tokens, have no overlap; repeated rows of a document or an item
count once, and texts that share an id are looked at each; null ids have rows of their own; an empty table
on either side gives no rows; other columns are ignored, and kept by `decontaminate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

MASKS = ("111111110000", "111011011010", "110101101101", "101100111011")
SPAN, LEAST = 12, 5
MIN_SCORE, SHARE = 9, 0.8
#: Test seeds (SEED_BYTES each) and tokens (8 bytes each) up to this many bytes are broadcast; more are joined by a shuffle.
BROADCAST_BYTES, SEED_BYTES = 64_000_000, 40


def _tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda x: F.xxhash64(x))


def _seeds(df: DataFrame, masks: list[str], at: str, whole: bool = False) -> DataFrame:
    """df (with tokens h) with a row for each place and mask; whole: a mask shorter than SPAN only for h of its length."""
    n = F.size("h")
    d = df.where(n >= min(map(len, masks))).withColumn(at, F.explode(F.sequence(F.lit(0), n - min(map(len, masks)))))
    keys = []
    for mask in masks:
        key = F.xxhash64(F.lit(mask), *(F.get("h", F.col(at) + k) for k, x in enumerate(mask) if x == "1"))
        fits = (n == len(mask)) if whole and len(mask) < SPAN else (F.col(at) + len(mask) <= n)
        keys.append(F.when(fits, key))
    return d.withColumn("seed", F.explode(F.array(*keys))).where(F.col("seed").isNotNull())


def _aligned(hits: DataFrame) -> DataFrame:
    """hits (id, item_id, shift, h, item) with score and matched of the whole diagonal, overlaps only."""
    lead = F.greatest(F.lit(0), -F.col("shift"))  # the item's tokens from its first that has a partner in the document
    first = F.col("shift") + lead
    size = F.least(F.size("item") - lead, F.size("h") - first)
    same = F.zip_with(F.slice("h", first + 1, size), F.slice("item", lead + 1, size), lambda x, y: x == y)
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        now = F.greatest(F.lit(0), s["now"] + F.when(x, 1).otherwise(-4))
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    d = hits.withColumn("same", same)
    d = d.select("id", "item_id", F.aggregate("same", zero, step)["best"].alias("score"), F.size(F.filter("same", lambda x: x)).alias("matched"), F.size("item").alias("n"))
    return d.where((F.col("score") >= MIN_SCORE) | (F.col("matched") >= SHARE * F.col("n")))


def _overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """id, item_id, score, matched: every overlapping alignment. docs: id, text; items: item_id, text."""
    test = items.select("item_id", _tokens(F.col("text")).alias("h")).where(F.size("h") >= LEAST)
    test = test.groupBy(F.xxhash64("item_id", F.col("item_id").isNull(), "h").alias("own")).agg(F.first("item_id").alias("item_id"), F.first("h").alias("h"))
    n = test.agg(F.coalesce(F.sum(F.greatest(F.size("h") - SPAN + 1, F.lit(1)) * len(MASKS) * SEED_BYTES + F.size("h") * 8), F.lit(0)).alias("bytes"), F.collect_set(F.when(F.size("h") < SPAN, F.size("h"))).alias("short")).first()
    masks = [*MASKS, *("1" * k for k in sorted(n["short"]))]  # at most SPAN - LEAST more
    seeds = _seeds(test, masks, "q", whole=True).select("seed", "own", "q").distinct()
    bodies = test.select("own", "item_id", F.col("h").alias("item"))
    d = docs.select("id", _tokens(F.col("text")).alias("h"))
    shift = (F.col("p") - F.col("q")).alias("shift")
    if n["bytes"] <= BROADCAST_BYTES:
        hits = _seeds(d, masks, "p").join(F.broadcast(seeds), "seed").select("id", "own", shift, "h").join(F.broadcast(bodies), "own")
        hits = hits.groupBy("id", "own", "shift").agg(*(F.first(c).alias(c) for c in ("h", "item_id", "item")))
    else:
        # hits without tokens, then the tokens of the documents that have any
        found = _seeds(d, masks, "p").select("seed", "id", "p").join(seeds, "seed").select("id", "own", shift).distinct()
        texts = d.join(found.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.first("h").alias("h"))
        hits = found.join(texts, "id").join(bodies, "own")
    return _aligned(hits)


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, matched: each document's overlaps with each item, the best one."""
    row = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text")
    d = docs.select(F.struct("doc_id", row.alias("row")).alias("id"), "text")
    best = F.max(F.struct("score", "matched")).alias("best")
    got = _overlaps(d, items).groupBy("id.doc_id", "item_id").agg(best)
    return got.select("doc_id", "item_id", F.col("best.score").cast("long").alias("score"), F.col("best.matched").cast("long").alias("matched"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those whose text overlaps an item."""
    key = free_name(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    bad = _overlaps(docs.select(F.xxhash64("text").alias("id"), "text"), items).select(F.col("id").alias(key)).distinct()
    return keyed.join(bad, key, "left_anti").select(docs.columns)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _oracle() -> str:
    masks = [*MASKS, *("1" * k for k in range(LEAST, SPAN))]
    key = lambda m: "array_to_string([" + ", ".join(f"t[p + {k + 1}]" for k, x in enumerate(m) if x == "1") + "], ' ')"
    fits = lambda m, item: f"len(t) = {len(m)}" if item and len(m) < SPAN else f"p + {len(m)} <= len(t)"
    seeds = lambda t, item: " UNION ALL ".join(f"SELECT id, p, {k} AS mask, {key(m)} AS seed FROM {t}, unnest(range(0, greatest(len(t) - {LEAST - 1}, 0))) AS r(p) WHERE {fits(m, item)}" for k, m in enumerate(masks))
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
    return rf"""
WITH d AS (SELECT doc_id AS id, {words} AS t FROM documents), i AS (SELECT * FROM (SELECT item_id AS id, {words} AS t FROM benchmark) WHERE len(t) >= {LEAST}),
ds AS ({seeds("d", False)}), qs AS ({seeds("i", True)}),
h AS (SELECT DISTINCT ds.id AS doc, qs.id AS item, ds.p - qs.p AS shift FROM ds JOIN qs USING (mask, seed)),
a AS (SELECT doc, item, shift, len(i.t) AS n, q, CASE WHEN d.t[q + shift + 1] = i.t[q + 1] THEN 1 ELSE -4 END AS v
      FROM h JOIN d ON d.id = h.doc JOIN i ON i.id = h.item, unnest(range(greatest(0, -shift), least(len(i.t), len(d.t) - shift))) AS r(q)),
s AS (SELECT *, sum(v) OVER (PARTITION BY doc, item, shift ORDER BY q) AS s FROM a),
m AS (SELECT *, least(0, min(s) OVER (PARTITION BY doc, item, shift ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS low FROM s),
b AS (SELECT doc, item, shift, n, greatest(0, max(s - coalesce(low, 0))) AS score, count(*) FILTER (v = 1) AS matched FROM m GROUP BY ALL)
SELECT doc AS doc_id, item AS item_id, max([score, matched])[1]::BIGINT AS score, max([score, matched])[2]::BIGINT AS matched
FROM b WHERE score >= {MIN_SCORE} OR matched >= {SHARE} * n GROUP BY doc, item
"""


ORACLE = _oracle()
