"""Source divergence audit: how unlike the sources of a language use its terms.

Terms are counted once, as integers of each task's own dictionary, by language and source. The counts are
dealt by ranges of (language, term), so that a range holds all of a term's counts in UTF-8 order; there the terms in
enough documents become a sorted array, and a term's id is its place in it by searchsorted, after the number of
its range. So ids are in UTF-8 order across ranges too, and ties are broken by them. Stretches of the ids are chunks; a chunk is
turned into dense vectors, one for each source, and its distances of sources and its best terms are found there.
Neither terms nor counts ever meet in one place: a chunk has up to CELLS counts at a time, distances are added up by
pairs of sources (which the result has too), terms ranked within a chunk before all chunks' are.

All arithmetic is in integers; a share p is divided in three steps of 1000, exact for sums up to 9 * 10^15.

Defined results: null text, lang and source are ''; every (lang, source) that occurs is a group, with or without terms; a
language without kept terms gives pairs of value 0; a language's only source has no pairs; repeated rows count each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOCUMENTS, SMOOTH, UNIT, TERM_RANKS = 30, 5, 1_000_000_000, 50
#: Most terms and most counts of a chunk (but for one term's), cells of dense vectors at once, sources of a block.
TERMS, COUNTS, CELLS, SOURCES = 8192, 262_144, 2_000_000, 256
#: Groups whose totals may be broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 200_000
#: Bytes of text counted at once.
BLOCK = 8_000_000

_IN_TERM = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of texts (large_binary, no nulls), lower-cased, and the number of the text of each."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    inside = _IN_TERM[raw]
    before = np.r_[False, inside[:-1]][: len(raw)]
    before[at[:-1][at[:-1] < len(raw)]] = False  # terms end with their text
    starts = np.flatnonzero(inside & ~before)
    kept = np.cumsum(inside)
    cut = np.r_[kept[starts] - 1, kept[-1] if len(raw) else 0].astype(np.int64)
    data = _LOWER[raw[inside]]
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cut), pa.py_buffer(data)])
    return terms, np.searchsorted(at, starts, "right") - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of each stretch of documents."""
    for whole in batches:
        if not whole.num_rows:
            continue
        whole = whole.set_column(2, "text", whole.column("text").cast(pa.large_binary()))
        size = np.cumsum(pc.binary_length(whole.column("text")).to_numpy())
        cut = [0, *(np.flatnonzero(np.diff(size // BLOCK)) + 1).tolist(), whole.num_rows]
        for b in (whole.slice(x, y - x) for x, y in zip(cut, cut[1:])):
            terms, doc = terms_of(b.column("text"))
            if not len(terms):
                continue
            code = terms.dictionary_encode()
            k = len(code.dictionary)
            lang, source = (b.column(c).dictionary_encode() for c in ("lang", "source"))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            # terms of a document once, then documents of a group
            each, n = np.unique(doc * k + code.indices.to_numpy(), return_counts=True)
            doc_of, term = np.divmod(each, k)
            cell, at, docs = np.unique(group[doc_of] * k + term, return_inverse=True, return_counts=True)
            total = np.zeros(len(cell), np.int64)
            np.add.at(total, at, n)
            of, term = np.divmod(cell, k)
            of_lang, of_source = np.divmod(of, len(source.dictionary))
            cols = [lang.dictionary.take(pa.array(of_lang)), source.dictionary.take(pa.array(of_source)), code.dictionary.take(pa.array(term)).cast(pa.binary()), pa.array(total), pa.array(docs, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term (UTF-8), n (occurrences), docs (documents with it)."""
    given = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    got = given.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    return got.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def chunks(counted: DataFrame, least: int = DOCUMENTS, ranges: int | None = None) -> DataFrame:
    """Kept terms and their counts: lang, first_id, terms (in order), sources, and source, term (places in these), n of each count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, numbered = [], 0, {}
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= COUNTS:
                whole = pa.Table.from_batches(held).combine_chunks()
                end = len(whole) - _last_run(whole)  # the last term may go on in the next batch
                yield from _chunked(whole.slice(0, end), least, numbered)
                held, rows = whole.slice(end).to_batches(), len(whole) - end
        if rows:
            yield from _chunked(pa.Table.from_batches(held).combine_chunks(), least, numbered)

    n = ranges or max(1, int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = counted.repartitionByRange(n, "lang", "term").sortWithinPartitions("lang", "term").withColumn("part", F.spark_partition_id())
    return dealt.mapInArrow(run, "lang string, first_id long, terms array<binary>, sources array<string>, source array<int>, term array<int>, n array<long>")


def _values(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _firsts(*cols: np.ndarray) -> np.ndarray:
    """Where the values of any column change."""
    n = len(cols[0])
    return np.flatnonzero(np.r_[[True] * min(n, 1), np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])


def _last_run(rows: pa.Table) -> int:
    """Rows of the last term."""
    return len(rows) - int(_firsts(_values(rows, "lang"), _values(rows, "term"))[-1])


def _chunked(rows: pa.Table, least: int, numbered: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Chunks of whole terms in order; numbered: how many kept terms of each language the range has had."""
    if not len(rows):
        return
    lang, term, docs = _values(rows, "lang"), _values(rows, "term"), _values(rows, "docs")
    first = _firsts(lang, term)
    kept = np.repeat(np.add.reduceat(docs, first) >= least, np.diff(np.r_[first, len(lang)]))
    rows = rows.filter(pa.array(kept))
    if not len(rows):
        return
    lang, term = lang[kept], term[kept]
    of_lang = np.r_[_firsts(lang), len(lang)]
    for x, y in zip(of_lang, of_lang[1:]):
        own = term[x:y]
        vocabulary = own[_firsts(own)]
        ids = np.searchsorted(vocabulary, own)
        base = (int(rows.column("part")[int(x)].as_py()) << 40) + numbered.get(lang[x], 0)
        numbered[lang[x]] = numbered.get(lang[x], 0) + len(vocabulary)
        for k in range(0, len(vocabulary), TERMS):
            a, b = np.searchsorted(ids, [k, k + TERMS])
            part = rows.slice(x + a, b - a)
            source = part.column("source").combine_chunks().dictionary_encode()
            listed = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang[x]]), pa.array([base + k]), listed(pa.array(vocabulary[k : k + TERMS], pa.binary())), listed(source.dictionary)]
                + [listed(source.indices), listed(pa.array(ids[a:b] - k, pa.int32())), listed(part.column("n").combine_chunks())],
                ["lang", "first_id", "terms", "sources", "source", "term", "n"],
            )


def _flat(row: dict, *names: str) -> list[np.ndarray]:
    return [np.array(row[c], np.int64) for c in names]


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, n: occurrences of a chunk's terms."""
    for b in batches:
        for row in b.select(["lang", "sources", "source", "n"]).to_pylist():
            source, n = _flat(row, "source", "n")
            total = np.zeros(len(row["sources"]), np.int64)
            np.add.at(total, source, n)
            yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(total), pa.string()), pa.array(row["sources"], pa.string()), pa.array(total)], ["lang", "source", "n"])


def languages(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, n_terms, groups: each source, in order, with its occurrences of kept terms."""
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = kept.mapInArrow(_totals, "lang string, source string, n long").groupBy("lang", "source").agg(F.sum("n").alias("n"))
    listed = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("groups"))
    sizes = kept.groupBy("lang").agg(F.sum(F.size("terms")).alias("n_terms"))
    return listed.join(sizes, "lang", "left").select("lang", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), "groups")


def shares(count: np.ndarray, total: np.ndarray, n_terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * n_terms)), in steps that stay within 64 bits."""
    out, rest = np.divmod(count + SMOOTH, total + SMOOTH * n_terms)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total + SMOOTH * n_terms)
        out = out * 1000 + digits
    return out + 1


def _best(value: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values, those of equal values by place."""
    return np.argsort(-value, kind="stable")[:k]


MEASURED = "lang string, source string, other string, term binary, id long, value long"


def _measured(ranks: int):
    """Of a chunk and a block of sources: distances to later sources (other), and each source's best terms."""

    def of_pairs(key: tuple[str, int], sums: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
        for k, row in enumerate(sums):
            a = key[1] * SOURCES + k
            n = len(names) - a - 1
            if n > 0:
                cols = [pa.array([key[0]] * n, pa.string()), pa.array([names[a]] * n, pa.string()), pa.array(names[a + 1 :], pa.string()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array(row[a + 1 :])]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "other", "term", "id", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells = {}, 0
        for row in (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist()):
            names = [g["source"] for g in row["groups"]]
            total, n_terms = np.array([g["n"] for g in row["groups"]], np.int64), row["n_terms"]
            first, last = row["block"] * SOURCES, min(len(names), (row["block"] + 1) * SOURCES)
            key = (row["lang"], row["block"])
            if key not in held:
                cells += (last - first) * len(names)
                held[key] = (np.zeros((last - first, len(names)), np.int64), names)
            place = np.array([names.index(s) for s in row["sources"]] if len(names) < 8 else np.searchsorted(np.array([s.encode() for s in names], object), [s.encode() for s in row["sources"]]), np.int64)
            source, term, n = _flat(row, "source", "term", "n")
            step = max(1, CELLS // len(names))
            for at in range(0, len(row["terms"]), step):
                own = (term >= at) & (term < at + step)
                count = np.zeros((len(names), min(step, len(row["terms"]) - at)), np.int64)
                count[place[source[own]], term[own] - at] = n[own]
                p, q = shares(count, total[:, None], n_terms), shares(count.sum(axis=0), total.sum(), n_terms)
                for k in range(first, last):
                    held[key][0][k - first, k + 1 :] += np.abs(p[k + 1 :] - p[k]).sum(axis=1)
                    value = np.where((count[k] > 0) & (p[k] > q), p[k] - q, 0)
                    best = _best(value, ranks)
                    best = best[value[best] > 0]
                    cols = [pa.array([row["lang"]] * len(best), pa.string()), pa.array([names[k]] * len(best), pa.string()), pa.nulls(len(best), pa.string())]
                    cols += [pa.array([row["terms"][at + t] for t in best], pa.binary()), pa.array(row["first_id"] + at + best), pa.array(value[best])]
                    yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "other", "term", "id", "value"])
            if cells > 4 * CELLS:
                for k, (sums, known) in held.items():
                    yield from of_pairs(k, sums, known)
                held, cells = {}, 0
        for k, (sums, known) in held.items():
            yield from of_pairs(k, sums, known)

    return run


def audit(docs: DataFrame, least: int = DOCUMENTS, ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the language's other sources, and terms that a source has more of than its language."""
    counted = materialize(counts(docs), "counts", compression="zstd")
    kept = materialize(chunks(counted, least), "chunks", compression="zstd")
    langs = materialize(languages(docs, kept), "languages")
    # a language without kept terms still has its pairs
    none = langs.select("lang", F.lit(0).cast("long").alias("first_id"), *(F.array().cast(kept.schema[c].dataType).alias(c) for c in kept.columns[2:]))
    sizes = langs.agg(F.sum(F.size("groups"))).first()[0] or 0
    known = F.broadcast(langs) if sizes <= BROADCAST_GROUPS else langs
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.size("groups") - 1) / SOURCES).cast("int"))).alias("block")
    measured = kept.unionByName(none).join(known, "lang").select("*", blocks).mapInArrow(_measured(ranks), MEASURED)
    measured = materialize(measured, "measured")
    pairs = measured.where(F.col("term").isNull()).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = F.inline(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", "value", both)
    within = Window.partitionBy("lang", "source")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(within.orderBy(F.desc("value"), "item")).alias("rank"))
    terms = measured.where(F.col("term").isNotNull()).withColumn("rank", F.row_number().over(within.orderBy(F.desc("value"), "id"))).where(F.col("rank") <= ranks)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT lang, source, r, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT r) >= {DOCUMENTS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
every AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + {SMOOTH})) // (sum(n) OVER (PARTITION BY lang, source) + {SMOOTH} * v) AS p FROM every JOIN sizes USING (lang)),
all_n AS (SELECT lang, term, sum(n) AS n FROM every GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + {SMOOTH})) // (sum(n) OVER (PARTITION BY lang) + {SMOOTH} * v) AS q FROM all_n JOIN sizes USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms) WHERE rank <= {TERM_RANKS}"""
