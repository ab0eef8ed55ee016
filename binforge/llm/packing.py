"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

A sequence is filled greedily, always with the longest document left that fits. If a gap stays, its
smallest document is taken out again and the two unpacked documents that fill the expanded gap
most tightly take its place, if any pair fills it better.

What a sequence can hold depends on lengths alone, and there are no more lengths than a sequence has
tokens. So the packing is found on the counts of the lengths (a row a length comes to the driver), where
a pattern of lengths is repeated for as long as every choice stays the same: the same sequences as one by
one. Each length's documents are then numbered, by the place of their partition and within it, and a number says
which pattern, which repetition of it and which place in it a document has.

Longer documents are cut into pieces of a whole sequence and a rest. Texts are encoded word by word where
the tokenizer's file says that tokens part at white space, whole otherwise.

Defined results: null, empty and tokenless texts are the end id alone; repeated rows are documents of their own;
null ids are kept; an empty table gives no sequence; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .tokenstore import LETTERS, SIMPLE, _byte_letters, _Words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIZE, END = 2048, 0
#: Bytes of text encoded at once, about.
BLOCK = 2_000_000
#: Rows of first numbers (a partition and length each, some 40 bytes) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
PRE_TOKENS = re.compile(r"[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def drops_white_space(spec: dict) -> bool:
    """Whether a tokenizer file's tokens are those of the words between white space, and of letters, single digits and signs within."""
    norm, pre, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec["model"]
    steps = [n["type"] for n in norm.get("normalizers", [norm])]
    splits = pre.get("pretokenizers", [])
    return (
        steps == ["NFC", "Replace", "Lowercase"] and norm["normalizers"][1].get("pattern") == {"Regex": r"\s+"} and norm["normalizers"][1].get("content") == " "
        and [s["type"] for s in splits] == ["Split", "ByteLevel"] and splits[0].get("invert") and splits[0].get("behavior") == "Removed"
        and str(splits[0]["pattern"].get("Regex", "")).endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and not splits[1].get("add_prefix_space") and not splits[1].get("use_regex", True)
        and model.get("type") == "BPE" and not model.get("dropout") and not spec.get("truncation") and not spec.get("padding")
        and all(not any(c.isspace() for c in t["content"]) and not t["content"].isalnum() and not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word") for t in spec.get("added_tokens", []))
    )


class Encoder:
    """Ids of whole texts as one array, and where each text's end."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.code, self.kind, self.width = ("I", "<u4", 4) if self.tokenizer.get_vocab_size() > 1 << 16 else ("H", "<u2", 2)
        self.by_word = drops_white_space(spec)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.runs, self.words = _Words(self._run), _Words(self._word)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> bytes:
        """Ids of one pre-token in lower case."""
        shown = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        if not SIMPLE.fullmatch(word) or any(a in word for a in self.added):
            return self._whole(word)
        word = word.lower()
        return self.runs[word] if LETTERS.fullmatch(word) else b"".join(map(self.runs.__getitem__, PRE_TOKENS.findall(word)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, and the number of them up to each text's end; null is empty."""
        texts = texts.fill_null("")
        if not self.by_word:
            ids = list(map(self._whole, texts.to_pylist()))
            return np.frombuffer(b"".join(ids), self.kind), np.cumsum([len(x) // self.width for x in ids], dtype=np.int64)
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        code = words.flatten().dictionary_encode()
        ids = list(map(self.words.__getitem__, code.dictionary.to_pylist()))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        start, at = np.cumsum(size) - size, code.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n)
        every = np.frombuffer(b"".join(ids), self.kind)
        every = every[np.repeat(start[at] - (ends - n), n) + np.arange(n.sum())]
        offsets = words.offsets.to_numpy()
        return every, np.r_[0, ends][offsets[1:] - offsets[0]]


def _encoder(path: str) -> Encoder:
    """This process's encoder of a file. It lives under a module name of its own, as functions are sent by value."""
    import os
    import types

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = sys.modules.setdefault("_binforge_pack_encoders", types.ModuleType("_binforge_pack_encoders"))
    if getattr(kept, "path", None) != path:
        kept.path, kept.encoder = path, Encoder(path)
    return kept.encoder


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in stretches of about BLOCK bytes of text."""
    for b in batches:
        if b.num_rows:
            size = np.cumsum(pc.binary_length(b.column("text").fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64))
            cut = [0, *(np.flatnonzero(np.diff(size // BLOCK)) + 1).tolist(), b.num_rows]
            yield from (b.slice(x, y - x) for x, y in zip(cut, cut[1:]))


def nth_of_kind(kind: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many of its kind stand before each one, seen[kind] of them before the first; seen is brought up to date."""
    order = np.argsort(kind, kind="stable")
    n = np.bincount(kind, minlength=len(seen))
    out = np.empty(len(kind), np.int64)
    out[order] = np.arange(len(kind)) - np.repeat(np.cumsum(n) - n, n)
    out += seen[kind]
    seen += n
    return out


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian, 2 or 4 bytes each), part, nth (of its length in its partition)."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = _encoder(path), np.zeros(size + 1, np.int64)
        for b in _blocks(batches):
            ids, ends = encoder.encode(b.column("text"))
            ends = ends + np.arange(1, b.num_rows + 1)  # with the end ids
            whole = np.full(ends[-1], end, encoder.kind)
            text = np.ones(len(whole), bool)
            text[ends - 1] = False
            whole[text] = ids
            n = np.diff(ends, prepend=0)
            count = -(-n // size)
            doc = np.repeat(np.arange(b.num_rows), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            length = np.minimum(n[doc] - piece * size, size)
            cut = np.r_[0, np.cumsum(length)] * encoder.width
            held = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(whole)]).cast(pa.binary())
            cols = [b.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * size, pa.int64()), pa.array(length, pa.int32()), held]
            cols += [b.column("part").take(pa.array(doc)), pa.array(nth_of_kind(length, seen))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", "text", F.spark_partition_id().alias("part"))
    return given.mapInArrow(run, f"doc_id {kind}, piece int, start long, length int, ids binary, part int, nth long")


@dataclass
class Packing:
    """Stretches of numbers of one length: those from `first` on are in sequences from `sequence` on, `each` to a sequence, from place `offset`."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence and offset of each document of a length, by its number."""
        r = np.searchsorted((self.length << 44) + self.first, (length.astype(np.int64) << 44) + number, "right") - 1
        nth = number - self.first[r]
        return self.sequence[r] + nth // self.each[r], self.offset[r] + nth % self.each[r] * length


def _longest(counts: np.ndarray) -> np.ndarray:
    """For each length the longest one left that is no longer; 0 for none."""
    return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))


def greedy(counts: np.ndarray, size: int) -> tuple[dict[int, int], int]:
    """The lengths that fill one sequence greedily, with their numbers, and the gap left."""
    longest, held, gap, most = _longest(counts), {}, size, size
    while k := int(longest[min(gap, most)]):
        held[k] = min(int(counts[k]), gap // k)
        gap -= k * held[k]
        most = k - 1
    return held, gap


def tightest_pair(counts: np.ndarray, room: int, least: int) -> tuple[int, int] | None:
    """The two lengths left with the greatest sum over `least` and up to `room`; of equal sums the one with the longest."""
    longest = _longest(counts)
    x = np.flatnonzero(counts[: room + 1] > 0)
    x = x[x > 0]
    if not len(x):
        return None
    y = longest[np.minimum(np.maximum(room - x, 0), np.where(counts[x] > 1, x, x - 1))]
    total = np.where(y > 0, x + y, 0)
    best = len(x) - 1 - int(np.argmax(total[::-1]))
    return (int(x[best]), int(y[best])) if total[best] > least else None


def best_two_fit(counts: np.ndarray, size: int) -> Packing:
    """The packing of counts[length] documents of each length; a pattern is repeated while its choices stay the same."""
    left, given = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64)
    runs, sequence = [], 0
    while left.any():
        first, gap = greedy(left, size)
        final = dict(first)
        if gap:
            smallest = min(first)
            for k, n in first.items():
                left[k] -= n
            pair = tightest_pair(left, gap + smallest, smallest)
            for k, n in first.items():
                left[k] += n
            if pair:
                for k, n in ((smallest, -1), (pair[0], 1), (pair[1], 1)):
                    final[k] = final.get(k, 0) + n
                final = {k: n for k, n in final.items() if n}
        needed = {k: max(n, first.get(k, 0)) for k, n in final.items()}
        if final != first:  # the pair comes on top of what the greedy fill holds
            needed = {k: max(needed[k], first.get(k, 0) + pair.count(k)) for k in final}
        times = min((int(left[k]) - needed[k]) // n + 1 for k, n in final.items())
        at = 0
        for k in sorted(final, reverse=True):
            runs.append((k, int(given[k]), sequence, final[k], at))
            given[k] += times * final[k]
            left[k] -= times * final[k]
            at += k * final[k]
        sequence += times
    cols = np.array(sorted(runs), np.int64).reshape(-1, 5).T
    return Packing(*cols, sequence)


def numbered(of: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """of (pieces) with `number` among all of its length, and how many each length has."""
    counts = materialize(of.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", "length", before.alias("before"))
    if counts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    return of.join(starts, ["part", "length"]).withColumn("number", F.col("before") + F.col("nth")).drop("before"), totals


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset: each piece of a document with its ids and its place."""
    of, totals = numbered(materialize(pieces(docs, path, size, end), "pieces", compression="zstd"))
    counts = np.zeros(size + 1, np.int64)
    counts[list(totals)] = list(totals.values())
    sent = docs.sparkSession.sparkContext.broadcast(best_two_fit(counts, size))  # some patterns a length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = sent.value.place(b.column("length").to_numpy(), b.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *map(pa.array, got)], [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return of.select(*names, "number").mapInArrow(run, f"doc_id {kind}, piece int, start long, length int, ids binary, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids, doc_ids of each sequence, from what pack() gives; no sequence is longer than its size."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    got = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    return got.select("sequence_id", "n_tokens", joined.alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def _crc(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """ids_crc32, of the ids as 32-bit integers, in place of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide = (np.frombuffer(x.as_buffer(), f"<u{width}").astype("<u4") for x in b.column("ids"))
            at = b.schema.get_field_index("ids")
            yield b.set_column(at, "ids_crc32", pa.array([zlib.crc32(x) for x in wide], pa.int64()))

    return run


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pack(table(spark, sf_dir, "documents"))
    out = ", ".join("ids_crc32 long" if f.name == "ids" else f"{f.name} {f.dataType.simpleString()}" for f in got.schema)
    return got.mapInArrow(_crc(_encoder(tokenizer_path()).width), out)
