"""Product codes of vectors: 16 parts, each known by the nearest of 64 entries, learned by exact integer k-means.

Vectors become integers and are stored once as columnar blocks: a row has up to ROWS vectors, component after
component. Each round sends the codebooks to all tasks (their size depends on the vectors' length alone); a
task adds up distances dimension by dimension, and sums and counts of its parts go into int64 tensors by
np.add.at, which merge through a reduction tree (RDD treeAggregate), so the driver gets one pair of
tensors from the last few tasks, however many blocks there are.

Defined results: a row is dropped if its vector is null or holds null or non-finite components; the others need one
length, a multiple of the number of parts, or ValueError is raised, as it is for components whose squares would
not fit (beyond 2^28 as integers); with fewer vectors than entries there are as many entries as vectors; null
vec_ids come last, those of equal ids by their vectors; repeated rows are rows of their own; null labels are one label; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
ROWS, MOST = 4096, 1 << 28
#: Labels whose sums may be broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 200_000


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x); scaling by a power of two is exact."""
    y = np.floor(SCALE * x.astype(np.float64))
    if y.size and np.abs(y).max() > MOST:
        raise ValueError(f"components beyond {MOST // SCALE} are too large for exact sums of squares")
    return y.astype(np.int64)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_ids, labels, size, dim, data (int32, component after component) of blocks."""
    for whole in batches:
        for b in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
            vectors = b.column("embedding")
            dims = np.diff(vectors.offsets.to_numpy())
            if dims.min() != dims.max():
                raise ValueError("vectors are of different lengths")
            x = integers(vectors.flatten().to_numpy(zero_copy_only=False)).reshape(len(vectors), dims[0])
            one = pa.array([0, len(vectors)], pa.int32())
            cols = [pa.ListArray.from_arrays(one, b.column("vec_id")), pa.ListArray.from_arrays(one, b.column("label"))]
            cols += [pa.array([len(vectors)], pa.int32()), pa.array([dims[0]], pa.int32()), pa.array([np.ascontiguousarray(x.T).astype("<i4").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["vec_ids", "labels", "size", "dim", "data"])


def blocks(rows: DataFrame) -> DataFrame:
    """rows (vec_id, embedding, label), all usable, as stored blocks."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    got = rows.select("vec_id", "embedding", "label").mapInArrow(_packed, f"vec_ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, size int, dim int, data binary")
    return materialize(got, "blocks", compression="zstd")


def parted(data: bytes, size: int, parts: int) -> np.ndarray:
    """A block's integers: [part, dimension, vector]."""
    return np.frombuffer(data, "<i4").reshape(parts, -1, size)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest entry and the squared distance; x: [dimension, vector], book: [entry, dimension]; ties to the lower index."""
    distance = np.zeros((len(book), x.shape[1]), np.int64)
    for values, entries in zip(x, book.T):
        off = values.astype(np.int64)[None, :] - entries[:, None]
        distance += off * off
    at = distance.argmin(axis=0)
    return at, distance[at, np.arange(x.shape[1])]


def _adds(books: np.ndarray) -> Callable:
    """What treeAggregate does with a block: its parts are added to the entries that they are nearest to."""

    def add(total: tuple[np.ndarray, np.ndarray], block: tuple[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        sums, counts = total
        for k, x in enumerate(parted(block[1], block[0], len(books))):
            at, _ = nearest(x, books[k])
            np.add.at(sums[k], at, x.T)
            np.add.at(counts[k], at, 1)
        return sums, counts

    return add


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def refined(data: RDD, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: [part, entry, dimension]."""
    zero = (np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64))
    # tasks merge in groups of the square or cube root of their number, none of more than some dozens
    depth = 2 if data.getNumPartitions() <= 1024 else 3
    sums, counts = data.treeAggregate(zero, _adds(books), _merged, depth)
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)


def fit(rows: DataFrame, stored: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks [part, entry, dimension] of usable rows and their blocks: started by the smallest vec_ids, then refined."""
    dims = [r["dim"] for r in stored.select("dim").distinct().limit(2).collect()]
    if len(dims) > 1 or any(d % parts for d in dims):
        raise ValueError(f"vectors need one length, a multiple of {parts}")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    books = integers(np.array([r["embedding"] for r in first], np.float64)).reshape(len(first), parts, dims[0] // parts if dims else 0).transpose(1, 0, 2)
    data = stored.select("size", "data").rdd.map(lambda r: (r["size"], bytes(r["data"])))
    for _ in range(rounds if len(first) else 0):
        books = refined(data, books)
    return books


def sha256_of(books: np.ndarray) -> str:
    """Of all entries' decimal components by part, entry, place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(stored: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of all vectors of the blocks."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, 1) for k in range(whole.num_rows)):
                size = b.column("size")[0].as_py()
                codes, error = np.zeros((size, parts), np.uint8), np.zeros(size, np.int64)
                for k, x in enumerate(parted(b.column("data")[0].as_py(), size, parts)):
                    codes[:, k], off = nearest(x, books[k])
                    error += off
                text = codes.tobytes().hex()
                code = [text[at : at + 2 * parts] for at in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([b.column("vec_ids").flatten(), b.column("labels").flatten(), pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = {c: stored.schema[c].dataType.elementType.simpleString() for c in ("vec_ids", "labels")}
    return stored.mapInArrow(run, f"vec_id {kinds['vec_ids']}, label {kinds['labels']}, code string, error long")


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of each usable row, and the codebooks; entries: at most 256."""
    kept = rows.where(usable(F.col("embedding")))
    stored = blocks(kept)
    books = fit(kept, stored, parts, entries, rounds)
    return encoded(stored, books), books


def label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error, the sum of their errors over equal labels."""
    sums = materialize(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    got = label_errors(materialize(codes, "codes"))
    return got.select("vec_id", "code", "error", "label_error", F.lit(sha256_of(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """Rounds written out: parts p of vectors v, as lists of integers."""
    near = """
SELECT v.vec_id, v.label, v.p, v.x, arg_min(b.e, (d, b.e)) AS e, min(d) AS d FROM parts v JOIN {book} b USING (p),
LATERAL (SELECT list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d) GROUP BY ALL"""
    rounds = "".join(
        f""",
near{k} AS ({near.format(book=f"book{k}")}),
means{k} AS (SELECT p, e, list(m ORDER BY i) AS x FROM (
  SELECT p, e, i, floor(sum(x[i])::HUGEINT / count(*))::BIGINT AS m FROM near{k}, range(1, len(x) + 1) r(i) GROUP BY ALL) GROUP BY ALL),
book{k + 1} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN means{k} m USING (p, e))"""
        for k in range(ROUNDS)
    )
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, p, v[1 + p * len(v) // {PARTS} : (p + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) r(p)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS e FROM kept QUALIFY e < {ENTRIES}),
book0 AS (SELECT p, e, x FROM parts JOIN firsts USING (vec_id)){rounds},
final AS ({near.format(book=f"book{ROUNDS}")}),
codes AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM final GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256 FROM codes"""


ORACLE = _oracle()
