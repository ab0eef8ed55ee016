"""N-gram Jaccard self-join by universe partition and pigeonhole.

A document's set is its distinct shingles of N words (hashes of 64 bits). If two
sets link, their symmetric difference is at most 15/85 of the smaller one. Within a
size band the hash universe is cut into one segment more than that difference, so
linked sets agree wholly on one segment. Each set emits a key for each segment's
subset; a set is indexed in its own band and in those below that it can link with.

Cost-based allocation: agreeing on a segment of at most LIGHT elements says little
and would gather a large part of a band under one key. There the next segment
is given two units instead (its subset or any one-deletion neighbour may agree), in
one key together with the light subset; the pigeonhole count is the same.

Identical sets are first gathered under their smallest id. Sets under one key are then
verified against the key's smallest id; what that leaves apart is verified pair by pair
between different components only, so a large group of copies costs its size and
not its square, and no link between components is missed. Before texts are fetched, pairs
whose sizes or parity sketches rule out a link are left out; verification then counts
the intersection exactly.

So every link lies within a component. There all pairs are counted once more: members are
dealt by size and a hash of their id into blocks, and each two blocks that can hold links
meet once, their texts cut into shingles once a block. What leaves is a count a member
(n_links) or the links themselves (links()), not the pairs that were looked at.

A row is known by a hash of its id and text, so neither repeated nor null ids mix up texts.

Defined results: null, empty or wordless text has an empty set, links with nothing
and is its own component; fewer than N words make one shingle; repeated rows of an
id give a row each, whether their texts are equal or not; a component is named by its smallest
id that is not null, if it has one; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import LOWER, UPPER, WORD, materialize, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

N, PERCENT, LIGHT, SKETCH = 4, 85, 1, 1024
#: Ids of texts that are sent to all tasks, at most (16 bytes each, and what a hash table needs); more are shuffled with the texts.
SENT_IDS = 2_000_000
#: Shingles of a block, about; a longer text is a block of its own or shares one.
BLOCK = 200_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Words(dict):
    """Word hashes, kept for words already met; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, known: _Words, n: int = N) -> np.ndarray:
    """Sorted distinct shingle hashes of the whole text."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, len(w) if len(w) < n else n, np.uint64)
    for j in range(k):
        out = _mix(out * _A + h[j : len(h) - k + 1 + j])
    return np.unique(out)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the elements in each of SKETCH ranges, packed in 64-bit words; two sketches differ in
    no more bits than the sets differ in elements."""
    n = np.bincount((_mix(s * _B) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    return np.packbits((n & 1).astype(bool)).view(np.int64)


def may_link(na: Column, nb: Column, sa: Column, sb: Column) -> Column:
    """False only where sizes or sketches rule out a link."""
    bits = [F.bit_count(F.get(sa, F.lit(k)).bitwiseXOR(F.get(sb, F.lit(k)))) for k in range(SKETCH // 64)]
    apart = sum(bits[1:], bits[0])
    return (100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)) & ((100 + PERCENT) * apart <= (100 - PERCENT) * (na + nb))


def most_difference(smaller: int, percent: int = PERCENT) -> int:
    return (100 - percent) * smaller // percent


@lru_cache(maxsize=1)
def bands(percent: int = PERCENT, top: int = 1 << 40) -> list[int]:
    """The largest size of each band; a set links only within its band and with neighbours' sizes."""
    out = [1]
    while out[-1] < top:
        low = out[-1] + 1
        out.append(max(low, 27 * low // 20))
    return out


def keys(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Index keys of a set, over its band and the lower ones that it can link with."""
    n, top = len(s), bands(percent)
    own = int(np.searchsorted(top, n))
    out = []
    for b in range(own, -1, -1):
        if 100 * top[b] < percent * n:  # its largest set is too small to link
            break
        m = most_difference(top[b], percent) + 1
        seg = (_mix(s ^ np.uint64(0x51ED270B)) % np.uint64(m)).astype(np.int64)
        size = np.bincount(seg, minlength=m)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, seg, _mix(s * _A))
        tag = _mix((np.uint64(b + 1) << np.uint64(32)) + np.arange(m, dtype=np.uint64))
        exact = _mix(sums * _A + tag)
        if m == 1:
            out.append(exact)
            continue
        light = size <= LIGHT
        out.append(exact[~light])
        for i in np.flatnonzero(light):
            f = (i + 1) % m
            variants = np.r_[sums[f], sums[f] - _mix(s[seg == f] * _A)]
            out.append(_mix(variants * _B + exact[i : i + 1] * _A))
    return np.concatenate(out)


def row_key() -> Column:
    """What a row is known by: rows of equal id and text are the same."""
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for b in batches:
        size, same, parity = [], [], []
        for text in b.column("text").to_pylist():
            s = shingles(text, known)
            size.append(len(s))
            same.append(int(_mix(s * _C).sum(dtype=np.uint64).astype(np.int64)) if len(s) else None)
            parity.append(sketch(s))
        more = [pa.array(size, pa.int64()), pa.array(same, pa.int64()), pa.array(parity, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), *more], ["doc_id", "key", "n_shingles", "same", "sketch"])


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = _Words()
    for b in batches:
        for at in range(0, len(b), 200):
            part = b.iloc[at : at + 200]
            got = [keys(shingles(t, known)) for t in part["text"]]
            yield pd.DataFrame({"key": np.concatenate(got).view(np.int64), "id": np.repeat(part["id"].to_numpy(), [len(k) for k in got])})


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = _Words()
    for b in batches:
        keep = []
        for x, y in zip(b["ta"], b["tb"]):
            p, q = shingles(x, known), shingles(y, known)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(p) + len(q) - both))
        yield b.loc[keep, ["a", "b"]]


def of_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of texts whose id is among ids (a stored table). Few ids go to the texts, so that the others' texts aren't shuffled."""
    return texts.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "id", "left_semi")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b; a stored table) whose texts link. texts: id, text."""
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    texts = of_ids(texts, ids)
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInPandas(_checked, "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """id, comp (smallest id reachable) of every id on an edge (a, b); by label passing with jumps."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), name)
    comp = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")), name)
    while True:
        near = both.join(comp.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("n"))
        step = comp.join(near, "id").select("id", F.least("comp", "n").alias("comp"), F.col("comp").alias("was"))
        step = materialize(step, name)
        up = step.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        new = materialize(step.join(up, "comp").select("id", F.least("comp", "up").alias("comp"), "was"), name)
        if not new.where(F.col("comp") != F.col("was")).limit(1).count():
            return new.select("id", "comp")
        comp = new.select("id", "comp")


def _meeting(classes: DataFrame, texts: DataFrame, comp: DataFrame) -> DataFrame:
    """comp, s1, j1, s2, j2 (two blocks of a component), side, id, rows, text; sorted by the blocks.

    side: 0 and 1 in the first and second block, 2 where a block meets itself.
    """
    # sets that link are of one size class or of neighbouring ones: a class spans a little more than 85 to 100
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(math.log(100 / (PERCENT - 1)))).cast("int")
    m = comp.join(classes.select("id", "n_shingles", "rows", step.alias("s")), "id")
    cells = m.groupBy("comp", "s").agg(F.ceil(F.sum("n_shingles") / BLOCK).cast("int").alias("m"))
    cells = cells.groupBy("comp").agg(F.map_from_entries(F.collect_list(F.struct("s", "m"))).alias("cells"))  # a few dozen sizes at most
    m = m.join(cells, "comp").withColumn("j", F.pmod(F.xxhash64("id"), F.col("cells")[F.col("s")]).cast("int"))
    near = lambda by: F.coalesce(F.sequence(F.lit(0), F.col("cells")[F.col("s") + by] - 1), F.array().cast("array<int>"))
    of = lambda s1, j1, s2, j2, side: F.struct(s1.alias("s1"), j1.alias("j1"), s2.alias("s2"), j2.alias("j2"), side.alias("side"))
    s, j = F.col("s"), F.col("j")
    own = F.transform(near(0), lambda k: of(s, F.least(j, k), s, F.greatest(j, k), F.when(j == k, 2).when(j < k, 0).otherwise(1)))
    up = F.transform(near(1), lambda k: of(s, j, s + 1, k, F.lit(0)))
    down = F.transform(near(-1), lambda k: of(s - 1, k, s, j, F.lit(1)))
    key = ["comp", "s1", "j1", "s2", "j2"]
    m = m.join(of_ids(texts, comp.select("id")), "id").select("comp", F.explode(F.concat(own, up, down)).alias("at"), "id", "rows", "text").select("comp", "at.*", "id", "rows", "text")
    return m.repartition(*key).sortWithinPartitions(*key)


def _meetings(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """The rows of each two blocks, whole across batches."""
    held: list[tuple] = []
    for b in batches:
        for row in b.itertuples(index=False, name=None):
            if held and held[0][:5] != row[:5]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _links(rows: list[tuple], known: _Words) -> Iterator[tuple[int, list[int]]]:
    """Places in rows: one of the first block, those of the second that it links with."""
    first, second = ([k for k, r in enumerate(rows) if r[5] in (side, 2)] for side in (0, 1))
    if not first or not second or len(rows) < 2:
        return
    sets = [shingles(r[8], known) for r in rows]
    size = np.array([len(x) for x in sets])
    at = np.r_[0, np.cumsum(size)]
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    others = np.array(second)
    starts = np.r_[0, np.cumsum(size[others])[:-1]]
    theirs = np.concatenate([code[at[k] : at[k + 1]] for k in second])
    mine = np.zeros(len(values), np.int64)
    for k in first:
        mine[code[at[k] : at[k + 1]]] = 1
        both = np.add.reduceat(mine[theirs], starts)
        mine[code[at[k] : at[k + 1]]] = 0
        link = 100 * both >= PERCENT * (size[k] + size[others] - both)
        if rows[k][5] == 2:  # a block with itself: each pair once
            link &= others > k
        if link.any():
            yield k, others[link].tolist()


def _link_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = _Words()
    for rows in _meetings(batches):
        n = [0] * len(rows)
        for k, found in _links(rows, known):
            for x in found:
                n[k] += rows[x][7]
                n[x] += rows[k][7]
        some = [(r[6], x) for r, x in zip(rows, n) if x]
        if some:
            yield pd.DataFrame(some, columns=["id", "n"])


def _link_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = _Words()
    for rows in _meetings(batches):
        for k, found in _links(rows, known):
            yield pd.DataFrame([(min(rows[k][6], rows[x][6]), max(rows[k][6], rows[x][6])) for x in found], columns=["a", "b"])


def _class_id(docs: DataFrame) -> Column:
    """A whole number for each class: its smallest id, if that is a whole number and no other class has it, else a hash below zero.

    The smallest id of a group is the likeliest original of its near copies, which the others are compared with first.
    """
    key = F.col("first.key")
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return key
    alone = F.count("*").over(Window.partitionBy(F.coalesce(F.col("first.doc_id").cast("long"), key))) == 1
    return F.when(alone & F.col("first.doc_id").isNotNull(), F.col("first.doc_id").cast("long")).otherwise(F.when(key < 0, key).otherwise(-1 - key))


def _placed(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sets of the documents, classes of equal sets, a text of each class, components of linked classes."""
    d = docs.select("doc_id", row_key().alias("key"), "text")
    sets = materialize(d.mapInArrow(_sets, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, n_shingles long, same long, sketch array<long>"), "sets")
    some = sets.where(F.col("n_shingles") > 0)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    classes = some.groupBy("same", "n_shingles").agg(first, F.first("sketch").alias("sketch"), F.count("*").alias("rows"))
    classes = materialize(classes.withColumn("id", _class_id(docs)), "classes")
    names = classes.select("id", F.col("first.key").alias("key"))
    # an id has one key, so the join's shuffle is the only one of the texts
    texts = materialize(d.join(names, "key").groupBy("key", "id").agg(F.first("text").alias("text")).select("id", "text"), "texts", compression="zstd")
    # keys that two or more classes share, and each key's hub
    w = Window.partitionBy("key")
    shared = texts.mapInPandas(_keyed, "key long, id long").withColumn("hub", F.min("id").over(w)).withColumn("last", F.max("id").over(w))
    shared = materialize(shared.where(F.col("hub") != F.col("last")).select("key", "id", "hub"), "shared")
    stars = shared.where(F.col("id") != F.col("hub")).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    size = classes.select("id", F.col("n_shingles").alias("n"), "sketch")
    left, right = (size.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    likely = may_link(F.col("na"), F.col("nb"), F.col("sa"), F.col("sb"))
    stars = materialize(stars.join(left, "a").join(right, "b").where(likely).select("a", "b"), "likely")
    edges = materialize(verified(stars, texts), "stars")
    comp = components(edges)
    # what is still apart under a key, once more pair by pair, between components only
    placed = shared.select("key", "id").join(comp, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    w = Window.partitionBy("key")
    apart = placed.withColumn("lo", F.min("comp").over(w)).withColumn("hi", F.max("comp").over(w)).where(F.col("lo") != F.col("hi")).select("key", F.col("id").alias("a"), "comp")
    apart = materialize(apart.join(left, "a"), "apart")
    other = apart.select("key", F.col("a").alias("b"), F.col("comp").alias("cb"), F.col("na").alias("nb"), F.col("sa").alias("sb"))
    pairs = apart.join(other, "key").where((F.col("comp") != F.col("cb")) & (F.col("a") < F.col("b")) & likely).select("a", "b").distinct()
    pairs = materialize(pairs.join(stars, ["a", "b"], "left_anti"), "pairs")
    more = materialize(verified(pairs, texts), "more")
    if more.limit(1).count():
        comp = components(edges.union(more))
    return sets, classes, texts, comp


def links(docs: DataFrame) -> DataFrame:
    """a, b: every pair of classes that link, by their class ids, a < b."""
    _, classes, texts, comp = _placed(docs)
    names = [classes.select(F.col("id").alias(c), F.col("first.doc_id").alias(f"{c}_id")) for c in "ab"]
    pairs = _meeting(classes, texts, comp).mapInPandas(_link_pairs, "a long, b long").join(names[0], "a").join(names[1], "b")
    return pairs.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest id with the same set), n_links.

    n_links: other rows that the document links with, those of the same set among them.
    """
    sets, classes, texts, comp = _placed(docs)
    linked = _meeting(classes, texts, comp).mapInPandas(_link_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("others"))
    named = classes.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    low = named.groupBy("comp").agg(F.min("first.doc_id").alias("component_id"))
    named = named.join(low, "comp").join(linked, "id", "left")
    n_links = (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    named = named.select("same", "n_shingles", F.col("first.doc_id").alias("class_id"), "component_id", n_links)
    out = sets.drop("sketch", "key").join(named, ["same", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def representatives(docs: DataFrame) -> DataFrame:
    """key: row_key() of one row of each component, the one of the smallest id, and of every wordless row."""
    sets, classes, _, comp = _placed(docs)
    first = classes.join(comp, "id", "left").groupBy(F.coalesce("comp", "id")).agg(F.min("first").alias("first"))
    return first.select("first.key").union(sets.where(F.col("n_shingles") == 0).select("key").distinct())


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


#: Every pair by its common shingles: for small tables.
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {N - 1}], ' ') AS g FROM w, unnest(range(1, greatest(1, len(w) - {N - 1}) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT c.a, c.b, c = p.n AND c = q.n AS same FROM c JOIN n p ON p.doc_id = c.a JOIN n q ON q.doc_id = c.b WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
r(doc_id, reach) AS (SELECT DISTINCT a, a FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach),
p AS (SELECT doc_id, min(reach) AS low FROM r GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(*) AS links, min(CASE WHEN same THEN b END) AS first FROM l GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(low, doc_id) AS component_id, coalesce(least(doc_id, first), doc_id) AS class_id, coalesce(links, 0)::BIGINT AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN k USING (doc_id)
"""
