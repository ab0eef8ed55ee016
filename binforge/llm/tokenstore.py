"""Token ids in a content-addressed store.

A document's ids (with the end id) are cut where a rolling hash of the last WINDOW
ids ends in zero bits, so equal passages give equal chunks wherever they stand. The
store is three Parquet folders: ``chunks`` holds each unique chunk once (digest, ids as
little-endian unsigned integers of `width` bytes: 2, or 4 where the vocabulary needs them);
``recipes`` holds each document's place, length, list of digests and Merkle root, file
after file and row after row in ascending doc_id order; ``ranges`` holds where each file's
documents start. Reading checks every chunk against its digest and every document
against its root.

``read_documents`` gives the ids themselves; ``verify`` gives each document's crc32,
combined from the crc32 of its chunks, so that no chunk is moved to verify.

Texts are encoded word by word where the tokenizer's file says that tokens part there
(byte-level BPE with its own pattern, no prefix space, no normalizer), whole otherwise.
Words met before are looked up; the table of them lives as long as the Python process.

Defined results: null and empty texts are the end id alone; repeated rows are stored
as documents of their own, after each other; null ids come first; an empty table makes an
empty store; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END, WINDOW, MEAN_BITS, LEAST, MOST = 2, 8, 8, 64, 1024
#: White space other than single spaces and line ends between words.
ODD_SPACE = r"^[ \n]|[ \n]\z|[ \n][ \n]|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A word of the letters, digits and signs whose class every version of the tables agrees on, and its runs of one class.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
SIMPLE = re.compile(rf"[{_LETTER}]+|(?:[{_LETTER}]+|[0-9]+|[!-&(-/:-@\[-`{{-~]+)+")
LETTERS = re.compile(rf"[{_LETTER}]+")
RUNS = re.compile(rf"[{_LETTER}]+|[0-9]+|[^{_LETTER}0-9]+")
#: Longest word kept, most words kept in a process in each of two tables, misses after which a full one is emptied, bytes of text encoded at once, about.
KEPT_WORD, KEPT_WORDS, RENEW, BLOCK = 48, 400_000, 20_000_000, 4_000_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def parts_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer file's tokens part before every space between two words."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return (
        pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
        and model.get("type") == "BPE" and not model.get("dropout")
        and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        and all(not any(c.isspace() for c in t["content"]) and not t["content"].isalnum() and not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word") for t in spec.get("added_tokens", []))
    )


def _byte_letters() -> dict[int, str]:
    """The character by which byte-level BPE writes each byte: itself if printable, else the next one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash of the last WINDOW ids ends in zero bits."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = x.copy()
    for k in range(1, WINDOW):
        h[k:] += x[:-k] << np.uint64(k)
    return np.flatnonzero(h * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - MEAN_BITS) == 0) + 1


def cuts(found: list[int], n: int) -> list[int]:
    """Ends of the chunks of n ids, from the marks among them: at least LEAST and at most MOST apart.

    No mark closer than LEAST > WINDOW to the start counts, so it doesn't matter what stands before the ids.
    """
    out, last = [], 0
    for m in found:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST and m < n:
            last = m
            out.append(last)
    while n - last > MOST:
        last += MOST
        out.append(last)
    return out + [n]


def merkle(digests: list[bytes]) -> bytes:
    level = list(digests)
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() for i in range(0, len(level), 2)]
    return level[0]


def digest_of(ids: bytes) -> bytes:
    return hashlib.sha256(ids).digest()[:20]


class _Words(dict):
    """Ids, as bytes, of words already met. The frequent ones come early, so a full table takes no more, until it has missed RENEW words."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode, self.missed = encode, 0

    def __missing__(self, word: str) -> bytes:
        got = self.encode(word)
        if len(self) < KEPT_WORDS:
            if len(word) <= KEPT_WORD:
                self[word] = got
        else:
            self.missed += 1
            if self.missed >= RENEW:
                self.clear()
                self.missed = 0
        return got


class Encoder:
    """Ids of whole texts, as bytes of `width` an id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.width = 4 if self.tokenizer.get_vocab_size() > 1 << 16 else 2
        self.kind, self.code = (f"<u{self.width}", "I" if self.width == 4 else "H")
        self.by_word = parts_at_spaces(spec)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.bare = _Words(lambda w: self._word("", w))
        self.line = self._whole("\n") if self.by_word else b""
        # as `_blocks` writes words: the first of a text after a return, the first of a line after a line end
        self.known = _Words(self._marked)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> bytes:
        """Ids of one pre-token."""
        if run.isascii():  # signs, digits and letters stand for themselves
            shown = self.letters[32] + run[1:] if run[0] == " " else run
        else:
            shown = run.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _marked(self, word: str) -> bytes:
        if word[:1] > "\r":
            return self._word(" ", word)
        return self.bare[word[1:]] if word[:1] == "\r" else self.line + self.bare[word[1:]] if word[:1] == "\n" else self._word(" ", word)

    def _word(self, space: str, word: str) -> bytes:
        if LETTERS.fullmatch(word):
            return self._run(space + word)
        if not SIMPLE.fullmatch(word) or any(a in word for a in self.added):
            return self._whole(space + word)
        first, *rest = RUNS.findall(word)
        if not rest:
            return self._run(space + first)
        # the first run has most likely been met as a word of its own
        return (self.known[first] if space else self.bare[first]) + b"".join(map(self.bare.__getitem__, rest))

    def ids(self, text: str) -> bytes:
        return self.all_ids(pa.array([text], pa.string()))[0]

    def all_ids(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; null is empty."""
        texts = texts.fill_null("")
        if not self.by_word:
            return [self._whole(t) for t in texts.to_pylist()]
        odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False)
        out = [b""] * len(texts)
        for k in np.flatnonzero(odd):
            out[k] = self._pieces(texts[k].as_py())
        plain = np.flatnonzero(~odd)
        size = pc.binary_length(texts).to_numpy()[plain]
        block = np.cumsum(size) // BLOCK
        for at in np.split(plain, np.flatnonzero(np.diff(block)) + 1) if len(plain) else []:
            for k, ids in zip(at, self._block(texts.take(pa.array(at)))):
                out[k] = ids
        return out

    def _block(self, texts: pa.Array) -> Iterator[bytes]:
        """Texts that have single spaces and line ends between words only: each distinct word is looked up once."""
        marked = pc.binary_join_element_wise("\r", pc.replace_substring(texts, "\n", " \n"), "")
        words = pc.split_pattern(marked, " ")
        code = words.flatten().dictionary_encode()
        ids = list(map(self.known.__getitem__, code.dictionary.to_numpy(zero_copy_only=False)))
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // self.width
        start = np.cumsum(size, dtype=np.int32) - size
        at = code.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n, dtype=np.int32)
        from_ = np.repeat(start[at] - (ends - n), n)
        from_ += np.arange(ends[-1], dtype=np.int32)
        every = np.frombuffer(b"".join(ids), self.kind)[from_].tobytes()
        cut = np.r_[0, ends][words.offsets.to_numpy()] * self.width
        return (every[x:y] for x, y in zip(cut.tolist(), cut[1:].tolist()))

    def _pieces(self, text: str) -> bytes:
        """A text with other white space: cut only at single spaces between two words."""
        first, *rest = BETWEEN.split(text)
        return b"".join([self.bare[first], *(self._word(" ", w) if w[:1] in "\r\n" else self.known[w] for w in rest)])


#: A space between two characters that are no white space.
BETWEEN = re.compile(r" (?<=\S )(?=\S)")


def _encoder(path: str) -> Encoder:
    """This process's encoder of a file. It lives under a module name of its own, as functions are sent by value."""
    import os
    import types

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = sys.modules.setdefault("_binforge_encoders", types.ModuleType("_binforge_encoders"))
    if getattr(kept, "path", None) != path:
        kept.path, kept.encoder = path, Encoder(path)
    return kept.encoder


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, recipe, root, new; `new` has the chunks (digest, ids) that the task hasn't given before."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, given = _encoder(path), set()
        each, end_id = encoder.width, np.array([END], encoder.kind).tobytes()
        for whole in batches:
            for b in (whole.slice(at, 1000) for at in range(0, whole.num_rows, 1000)):
                n_tokens, roots, recipes, n_recipe, digests, chunks, n_new = [], [], [], [0], [], [], [0]
                every = [ids + end_id for ids in encoder.all_ids(b.column("text"))]
                ends = np.cumsum([len(x) // each for x in every])
                found = marks(np.frombuffer(b"".join(every), encoder.kind))
                upto = np.searchsorted(found, ends, "right")
                for data, n, first, last, mark in zip(every, np.diff(ends, prepend=0).tolist(), [0, *ends], [0, *upto], upto):
                    recipe, own, last = [], (found[last:mark] - first).tolist(), 0
                    for end in cuts(own, n):
                        chunk = data[last * each : end * each]
                        recipe.append(d := digest_of(chunk))
                        if d not in given:
                            if len(given) >= 200_000:  # a bound on memory; a chunk given twice is stored once all the same
                                given.clear()
                            given.add(d)
                            digests.append(d)
                            chunks.append(chunk)
                        last = end
                    n_tokens.append(n)
                    roots.append(merkle(recipe))
                    recipes += recipe
                    n_recipe.append(len(recipes))
                    n_new.append(len(digests))
                listed = lambda ends, flat: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                new = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(chunks, pa.binary())], ["digest", "ids"])
                cols = [b.column("doc_id"), pa.array(n_tokens, pa.int64()), listed(n_recipe, pa.array(recipes, pa.binary())), pa.array(roots, pa.binary()), listed(n_new, new)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "recipe", "root", "new"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, recipe array<binary>, root binary, new array<struct<digest:binary,ids:binary>>")


def _placed_in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids before each document within its range, whose documents come in order."""
    before = 0
    for b in batches:
        n = b.column("n_tokens").to_numpy()
        at = before + np.cumsum(n) - n
        before += int(n.sum())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], [*b.schema.names, "at"])


def write(docs: DataFrame, at: str, path: str | None = None) -> str:
    """Store docs' ids under `at`."""
    spark = docs.sparkSession
    path = path or tokenizer_path()
    width = _encoder(path).width
    done = materialize(encode(docs, path), "ids", compression="zstd")
    # a task gives a chunk about once, so there is nothing to gain from looking for equal ones before the shuffle
    chunks = done.select(F.inline("new")).repartition("digest").dropDuplicates(["digest"]).withColumn("width", F.lit(width))
    chunks.write.option("compression", "zstd").parquet(f"{at}/chunks")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    recipes = done.select("doc_id", "n_tokens", "recipe", "root").repartitionByRange(n, F.col("doc_id").asc_nulls_first())
    recipes = recipes.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root").withColumn("part", F.spark_partition_id())
    recipes = recipes.mapInArrow(_placed_in_range, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, recipe array<binary>, root binary, part int, at long")
    recipes.write.option("compression", "zstd").parquet(f"{at}/recipes")
    # where each range starts: a row per partition
    sums = sorted((r["part"], r["n"]) for r in spark.read.parquet(f"{at}/recipes").groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, base = 0, []
    for part, k in sums:
        base.append((part, before))
        before += k
    spark.createDataFrame(base, "part int, base long").coalesce(1).write.parquet(f"{at}/ranges")
    return at


# crc32 of a concatenation from the crc32 of its parts, by zlib's method: appending n zero
# bytes is a linear map over GF(2), kept as one matrix for each power of two.
def _times(matrix: list[int], v: int) -> int:
    out, i = 0, 0
    while v:
        if v & 1:
            out ^= matrix[i]
        v >>= 1
        i += 1
    return out


def _zero_maps() -> list[list[int]]:
    one = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    for _ in range(3):
        one = [_times(one, x) for x in one]
    maps = [one]
    for _ in range(40):
        maps.append([_times(maps[-1], x) for x in maps[-1]])
    return maps


def _byte_tables() -> np.ndarray:
    """For each power of two of zero bytes, what each value of each byte of a crc becomes: [power, byte, value]."""
    return np.array([[[_times(m, v << (8 * k)) for v in range(256)] for k in range(4)] for m in _zero_maps()], np.uint32)


def crc_joined(crc: np.ndarray, size: np.ndarray, start: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """crc32 of each document from the crc32 and bytes of its parts; start: each document's first part.

    Each part is followed by zero bytes for the parts after it, and all are added up without carry.
    """
    total = np.cumsum(size)
    after = np.repeat(np.r_[total[start[1:] - 1], total[-1:]], np.diff(np.r_[start, len(crc)])) - total
    out, k = crc.astype(np.uint32), 0
    while (after >> k).any():
        on = np.flatnonzero((after >> k) & 1)
        v, t = out[on], tables[k]
        out[on] = t[0][v & 255] ^ t[1][(v >> 8) & 255] ^ t[2][(v >> 16) & 255] ^ t[3][v >> 24]
        k += 1
    return np.bitwise_xor.reduceat(out, start)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        ids, width = b.column("ids"), b.column("width")[0].as_py()  # one width a store
        offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        data = memoryview(ids.buffers()[2])[int(offsets[0]) : int(offsets[-1])]
        at = (offsets - offsets[0]).tolist()
        wide, up = memoryview(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()), 4 // width
        crc = [zlib.crc32(wide[x * up : y * up]) for x, y in zip(at, at[1:])]
        whole = [digest_of(data[x:y]) == d for x, y, d in zip(at, at[1:], b.column("digest").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(crc, pa.int64()), pa.array(np.diff(at) * up, pa.int64()), pa.array(whole)], ["digest", "crc", "bytes", "whole"])


def _manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = _byte_tables()
    for b in batches:
        if not b.num_rows:
            continue
        parts = b.column("parts")
        start = parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
        flat = parts.flatten()
        k, crc, size, whole = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("k", "crc", "bytes", "whole"))
        digest = flat.field("digest").to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(b.num_rows), np.diff(np.r_[start, len(k)]))
        order = np.lexsort((k, owner))
        ends = np.r_[start[1:], len(k)]
        roots = [merkle(digest[order[x:y]].tolist()) == r for x, y, r in zip(start, ends, b.column("root").to_pylist())]
        ok = np.array(roots, bool) & np.logical_and.reduceat(whole, start) & (np.add.reduceat(size, start) == 4 * b.column("n_tokens").to_numpy())
        joined = crc_joined(crc[order], size[order], start, tables).astype(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(joined), pa.array(ok)], ["doc_id", "start", "n_tokens", "ids_crc32", "verified"])


def _placed(spark: SparkSession, at: str) -> DataFrame:
    ranges = F.broadcast(spark.read.parquet(f"{at}/ranges"))  # a row for each file of recipes
    got = spark.read.parquet(f"{at}/recipes").join(ranges, "part").withColumn("start", F.col("base") + F.col("at"))
    return got.select("doc_id", "start", "n_tokens", "root", F.posexplode("recipe").alias("k", "digest"))


def verify(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified, from the store's files."""
    chunks = spark.read.parquet(f"{at}/chunks").mapInArrow(_checked, "digest binary, crc long, bytes long, whole boolean")
    joined = _placed(spark, at).join(chunks, "digest")
    docs = joined.groupBy("start", "doc_id", "n_tokens", "root").agg(F.collect_list(F.struct("k", "digest", "crc", "bytes", "whole")).alias("parts"))
    return docs.select("doc_id", "start", "n_tokens", "root", "parts").mapInArrow(_manifest, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long, verified boolean")


def read_documents(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, width, ids as binary (little-endian unsigned integers of `width` bytes), put together from chunks."""
    got = _placed(spark, at).join(spark.read.parquet(f"{at}/chunks"), "digest")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])
    return got.groupBy("doc_id", "start").agg(F.first("width").alias("width"), F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    return verify(spark, write(table(spark, sf_dir, "documents"), at))
