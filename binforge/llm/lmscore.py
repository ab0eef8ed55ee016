"""LM scoring by cross-entropy difference.

Two matched bigram models over words, a target model (documents labelled of good
quality) and a background model (all documents), share one vocabulary: every word of
the corpus, by 48 bits of its hash. A token's loss is -log2 of its interpolated
probability given the word before it, with the document's own counts taken out of
both models. A document's score is the mean difference, target less background:
lower is more like the target.

Counts come from all documents and grow with them. Documents are taken in batches of
about BATCH words. Each batch sends its distinct words and bigrams with their counts,
packed by slot of their hash; a slot adds up what all batches have sent, and sends each
batch the sums of what it asked for; the batch then scores its documents. A frequent
word is one entry a batch, so no slot is hot, and the number of slots follows the corpus. Once there are
more than PACKED_SLOTS, so that a packed row would hold a few entries only, entries are rows of their own: a grouped sum and
a join back. Results are the same.

Defined results: null, empty and wordless texts have no tokens, null losses and score;
with no target document the target model is the uniform base; repeated rows each count
and are scored; a null id is never a target, and its row is scored like others; ids of any type come back as they
were (they travel as Arrow data); other columns of the input are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialize, table
from .ngramjoin import _A, _mix, _Words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH = 1_000_000  # words
SLOT_CHARS, LEAST_SLOTS = 1_500_000, 16
PACKED_SLOTS = 50_000  # some 75 GB of text; a batch has some 300,000 pairs, so a packed row then holds six
MIX = (0.7, 0.25, 0.05)  # bigram, unigram, uniform base
BASE = 2.0**-24  # the uniform base's probability of a word, in both models
#: Target ids up to this many are broadcast (about 120 bytes each in a hash table); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
PACKED = "batch long, slot long, kind int, data binary, background binary, target binary, ids binary"
SCORED = "n_tokens long, target_loss double, background_loss double, score double"
DOCS, WORDS, PAIRS = 0, 1, 2


def planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each integer, all first bytes first, compressed."""
    return zstandard.compress(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 1)


def unplanes(data: bytes, width: int) -> np.ndarray:
    data = zstandard.decompress(data)
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel().astype(np.int64)


def word_hashes(text: str | None, known: _Words) -> np.ndarray:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    return np.fromiter(map(known.__getitem__, w), np.uint64, len(w)) >> np.uint64(16)


def pairs_of(at: np.ndarray, lens: np.ndarray, n: int) -> np.ndarray:
    """before * n + word of each token, from indices of words; before the first of a document stands 0."""
    before = np.r_[0, at[:-1]] if len(at) else at
    before[(np.cumsum(lens) - lens)[lens > 0]] = 0
    return before * n + at


def pair_hashes(pair: np.ndarray, word: np.ndarray) -> np.ndarray:
    before, after = np.divmod(pair, len(word))
    w = word.astype(np.uint64)
    return _mix(w[before] * _A + _mix(w[after]))


def slots_of(h: np.ndarray, slots: int) -> np.ndarray:
    return (h % np.uint64(slots)).astype(np.int64)


def _by_slot(slot: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The slots that occur and their stretches in an array ordered by slot."""
    starts = np.flatnonzero(np.r_[[True] * min(1, len(slot)), slot[1:] != slot[:-1]])
    return ((int(slot[a]), slice(a, b)) for a, b in zip(starts, [*starts[1:], len(slot)]))


def frozen(ids: list, kind: pa.DataType) -> bytes:
    """Ids as Arrow's bytes, whatever their type, nulls among them."""
    batch, out = pa.record_batch([pa.array(ids, kind)], ["doc_id"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def thawed(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column(0).combine_chunks()


def packed(docs: list[tuple[object, bool, np.ndarray]], kind: pa.DataType, batch: int, slots: int) -> Iterator[pa.RecordBatch]:
    """PACKED rows of a batch: its documents as word indices with their ids, its words and its pairs with their counts."""
    lens = np.array([len(h) for _, _, h in docs])
    good = np.array([g for _, g, _ in docs], bool)
    token = np.concatenate([h for _, _, h in docs])
    mark = np.repeat(good, lens)
    word, at = np.unique(token, return_inverse=True)
    # words ordered by slot, after the start mark, which is word 0 and known to all
    slot = slots_of(_mix(word), slots)
    order = np.argsort(slot, kind="stable")
    place = np.empty(len(word), np.int64)
    place[order] = np.arange(1, len(word) + 1)
    at = place[at]
    word, slot = np.r_[np.uint64(0), word[order]], slot[order]
    count = lambda i, n: (np.bincount(i, minlength=n), np.bincount(i[mark], minlength=n))
    spread = int(slots_of(_mix(np.array([batch], np.uint64)), slots)[0])
    rows = [(batch, spread, DOCS, planes(at, 4), planes(lens, 8), good.tobytes(), frozen([d for d, _, _ in docs], kind))]
    nb, nt = count(at, len(word))
    for s, x in _by_slot(slot):
        y = slice(x.start + 1, x.stop + 1)
        rows.append((batch, s, WORDS, planes(word[y], 6), planes(nb[y], 8), planes(nt[y], 8), None))
    pair, at = np.unique(pairs_of(at, lens, len(word)), return_inverse=True)
    nb, nt = count(at, len(pair))
    h = pair_hashes(pair, word)
    slot = slots_of(h, slots)
    order = np.argsort(slot, kind="stable")
    h, nb, nt = h[order] >> np.uint64(16), nb[order], nt[order]
    for s, x in _by_slot(slot[order]):
        rows.append((batch, s, PAIRS, planes(h[x], 6), planes(nb[x], 8), planes(nt[x], 8), None))
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
    for k in range(0, len(rows), 128):
        cols = zip(*rows[k : k + 128])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["batch", "slot", "kind", "data", "background", "target", "ids"])


def _packer(make: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size, made, part, kind = _Words(), [], 0, 0, 0, None
        for b in batches:
            kind = b.schema.field("doc_id").type
            for doc, text, good, part in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "is_target", "part"))):
                h = word_hashes(text, known)
                held.append((doc, good, h))
                size += len(h) + 16
                if size >= BATCH:
                    yield from make(held, kind, (int(part) << 32) + made)
                    held, size, made = [], 0, made + 1
        if held:
            yield from make(held, kind, (int(part) << 32) + made)

    return run


ENTRIES = "batch long, kind int, key long, background long, target long, data binary, lens binary, good binary, ids binary"


def entries(docs: list[tuple[object, bool, np.ndarray]], kind: pa.DataType, batch: int) -> Iterator[pa.RecordBatch]:
    """ENTRIES rows of a batch: its documents as places in its sorted words, and each of its words and pairs with its counts."""
    lens = np.array([len(h) for _, _, h in docs])
    good = np.array([g for _, g, _ in docs], bool)
    mark = np.repeat(good, lens)
    word, at = np.unique(np.concatenate([h for _, _, h in docs]), return_inverse=True)
    word, at = np.r_[np.uint64(0), word], at + 1
    pair, of = np.unique(pairs_of(at, lens, len(word)), return_inverse=True)
    made = [(WORDS, word[1:], at - 1), (PAIRS, pair_hashes(pair, word) >> np.uint64(16), of)]
    names = ["batch", "kind", "key", "background", "target", "data", "lens", "good", "ids"]
    none = [pa.array([None], t) for t in (pa.int64(), pa.int64(), pa.int64())]
    yield pa.RecordBatch.from_arrays([pa.array([batch]), pa.array([DOCS], pa.int32()), *none, *(pa.array([x], pa.binary()) for x in (planes(at, 4), planes(lens, 8), good.tobytes(), frozen([d for d, _, _ in docs], kind)))], names)
    for what, keys, i in made:
        if len(keys):
            counts = [np.bincount(i, minlength=len(keys)), np.bincount(i[mark], minlength=len(keys))]
            cols = [pa.array(np.full(len(keys), batch)), pa.array(np.full(len(keys), what, np.int32)), pa.array(keys.astype(np.int64)), *map(pa.array, counts)]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.nulls(len(keys), pa.binary()) for _ in range(4))], names)


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """A slot's rows with the sums over all batches in place of each batch's counts."""
    out = [rows[rows["kind"] == DOCS]]
    for kind in (WORDS, PAIRS):
        own = rows[rows["kind"] == kind]
        if not len(own):
            continue
        data = [unplanes(x, 6) for x in own["data"]]
        ends = np.cumsum([len(x) for x in data])[:-1]
        keys, at = np.unique(np.concatenate(data), return_inverse=True)
        sums = {}
        for c in ("background", "target"):
            n = np.concatenate([unplanes(x, 8) for x in own[c]])
            total = np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)
            sums[c] = [planes(x, 8) for x in np.split(total[at], ends)]
        out.append(own.assign(data=own["data"] if kind == WORDS else None, **sums))
    return pd.concat(out)


def losses(c_pair: np.ndarray, c_before: np.ndarray, c_word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """-log2 p of a word after another, from counts; n: the words that the model has seen."""
    p1 = c_word / np.maximum(n, 1)
    p2 = np.where(c_before > 0, c_pair / np.maximum(c_before, 1), p1)
    return -np.log2(MIX[0] * p2 + MIX[1] * p1 + MIX[2] * BASE)


def scored(token: np.ndarray, lens: np.ndarray, good: np.ndarray, doc: pa.Array, word: np.ndarray, sums: Callable, totals: dict) -> pa.Table:
    """A batch's documents with their losses. sums(model, pairs): counts of the model's words, and of the pairs (before * len(word) + word)."""
    out = {"n_tokens": lens, "target_loss": np.full(len(lens), np.nan), "background_loss": np.full(len(lens), np.nan)}
    if len(token):
        pair, at = np.unique(pairs_of(token, lens, len(word)), return_inverse=True)
        # a document's own counts of pairs and words, which are taken out
        owner = np.repeat(np.arange(len(lens)), lens)
        each, own_pair = np.unique(owner * len(pair) + at, return_counts=True)
        owner_of, kind = np.divmod(each, len(pair))
        before, after = np.divmod(pair[kind], len(word))
        seen, n = np.unique(owner * len(word) + token, return_counts=True)
        own = lambda w: np.where(w > 0, n[np.minimum(np.searchsorted(seen, owner_of * len(word) + w), len(n) - 1)], 1)
        own_before, own_after = own(before), own(after)
        for c, starts, n_all, takes in (("background", totals["docs"], totals["words"], np.ones(len(lens), bool)), ("target", totals["good_docs"], totals["good_words"], good)):
            take = takes[owner_of]
            c_word, c_pair = sums(c, pair)
            c_word = np.r_[starts, c_word]
            n_left = n_all - take * lens[owner_of]
            loss = losses(c_pair[kind] - take * own_pair, c_word[before] - take * own_before, c_word[after] - take * own_after, n_left)
            total = np.bincount(owner_of, weights=loss * own_pair, minlength=len(lens))
            out[f"{c}_loss"] = np.where(lens > 0, total / np.maximum(lens, 1), np.nan)
    out["score"] = out["target_loss"] - out["background_loss"]
    return pa.table({"doc_id": doc, "n_tokens": pa.array(lens), **{c: pa.array(out[c], from_pandas=True) for c in ("target_loss", "background_loss", "score")}})


def _scorer(slots: int, totals: dict) -> Callable[[pa.Table], pa.Table]:
    """Of packed rows."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pandas().sort_values(["kind", "slot"])
        head = rows[rows["kind"] == DOCS].iloc[0]
        whole = lambda kind, c, w: np.concatenate([unplanes(x, w) for x in rows.loc[rows["kind"] == kind, c]])
        token = unplanes(head["data"], 4)
        word = np.r_[0, whole(WORDS, "data", 6)] if len(token) else np.zeros(1, np.int64)

        def sums(c: str, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            place = np.empty(len(pair), np.int64)
            place[np.argsort(slots_of(pair_hashes(pair, word), slots), kind="stable")] = np.arange(len(pair))
            return whole(WORDS, c, 8), whole(PAIRS, c, 8)[place]

        return scored(token, unplanes(head["background"], 8), np.frombuffer(head["target"], bool), thawed(head["ids"]), word, sums, totals)

    return run


def _plain_scorer(totals: dict) -> Callable[[pa.Table], pa.Table]:
    """Of rows of an entry each, with the sums over all batches."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        of = lambda k: {c: table.column(c).filter(pa.array(kinds == k)).to_numpy() for c in ("key", "background", "target")}
        head = table.filter(pa.array(kinds == DOCS)).to_pylist()[0]
        words, pairs = of(WORDS), of(PAIRS)
        order, by_key = np.argsort(words["key"]), np.argsort(pairs["key"])
        word = np.r_[0, words["key"][order]].astype(np.int64)

        def sums(c: str, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keys = (pair_hashes(pair, word.astype(np.uint64)) >> np.uint64(16)).astype(np.int64)
            return words[c][order], pairs[c][by_key][np.searchsorted(pairs["key"][by_key], keys)]

        return scored(unplanes(head["data"], 4), unplanes(head["lens"], 8), np.frombuffer(head["good"], bool), thawed(head["ids"]), word, sums, totals)

    return run


def score(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score."""
    ids = target_ids.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().withColumn("is_target", F.lit(True))
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marked = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))
    if not few:  # a batch must come out alike if its task runs again
        marked = marked.sortWithinPartitions("doc_id", F.xxhash64("text"))
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = marked.select(n.alias("n"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"), "is_target")
    zero = F.lit(0).cast("long")
    totals = sized.agg(
        F.coalesce(F.sum("n"), zero).alias("words"), F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("chars"), zero).alias("chars"),
        F.coalesce(F.sum(F.when(F.col("is_target"), F.col("n"))), zero).alias("good_words"), F.count_if(F.col("is_target") & (F.col("n") > 0)).alias("good_docs"),
    ).first().asDict()
    slots = max(LEAST_SLOTS, -(-totals["chars"] // SLOT_CHARS))
    parted, out = marked.withColumn("part", F.spark_partition_id()), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCORED}"
    if slots <= PACKED_SLOTS:
        sent = parted.mapInArrow(_packer(lambda held, kind, batch: packed(held, kind, batch, slots)), PACKED)
        return sent.groupBy("slot").applyInPandas(_summed, PACKED).groupBy("batch").applyInArrow(_scorer(slots, totals), out)
    sent = materialize(parted.mapInArrow(_packer(entries), ENTRIES), "entries", compression="zstd")
    some = sent.where(F.col("kind") != DOCS)
    sums = some.groupBy("kind", "key").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))
    back = some.select("batch", "kind", "key").join(sums, ["kind", "key"])  # a frequent word has a row a batch, which AQE splits
    rows = sent.where(F.col("kind") == DOCS).unionByName(back, allowMissingColumns=True)
    return rows.groupBy("batch").applyInArrow(_plain_scorer(totals), out)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return score(table(spark, sf_dir, "documents"), good)
