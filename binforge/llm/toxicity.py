"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts and lexicon are folded alike: lower case, accents off, look-alike letters of
other scripts and digit substitutions to one letter each (1, l and | all become i).
A sign such as ! or $ may end a word or stand for a letter: at a word's end it is read
both ways, within a word as the letter. Hits must stand as whole words; those inside an
exception phrase don't count. The logarithms of the hits' weights, in all and by length,
give the score through a logistic curve.

Weights are log odds of a word's presence in toxic and other training documents. Exception
phrases are learned too: pairs of neighbouring words, one of the lexicon, that are no more
frequent in toxic documents than elsewhere. All are fitted on at most about SAMPLE labelled rows, chosen by a hash
of their id among those whose crc32(doc_id) mod 5 is not 0; only those ids are sent to all
tasks, and only their texts are kept.

Defined results: null and empty texts score as a text without hits; with no
labelled rows the lexicon is empty and every score 0; repeated rows give a row each
(repeated labels count once, the highest); a null id is not held out, and has no label; other columns of the input
are ignored.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, held_out, materialize, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 20_000
MIN_DOCS, MIN_ODDS = 3, 2.5
#: Look-alikes and digit substitutions, each line to the letter before it.
ALIKE = {
    "a": "@4аα", "b": "8вβ", "c": "сϲ", "d": "ԁ", "e": "3еε", "g": "9ɡ",
    "h": "һ", "i": "1!|lіιӏı", "j": "ј", "k": "кκ", "m": "м", "n": "η", "o": "0оο",
    "p": "рρ", "s": "5$ѕ", "t": "7тτ", "u": "υ", "v": "ν", "x": "хχ", "y": "уγ",
}
FOLD = {ord(c): to for to, cs in ALIKE.items() for c in cs}
#: Signs among them that also end a word.
SIGNS = "@!|$"
TRAILING = re.compile(r"[@!|$]+(?!\w)")


def plain(text: str) -> str:
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text.lower()


def fold(text: str) -> str:
    return plain(text).translate(FOLD)


def readings(text: str) -> list[str]:
    """The folded text, and where signs end words, the one that keeps them as signs; places agree."""
    low = plain(text)
    folded = low.translate(FOLD)
    if not any(c in low for c in SIGNS) or not TRAILING.search(low):
        return [folded]
    parts, last = [], 0
    for m in TRAILING.finditer(low):
        parts += [folded[last : m.start()], m[0]]
        last = m.end()
    return [folded, "".join(parts) + folded[last:]]


def hits(text: str, automaton, exceptions: list[str]) -> list[str]:
    """Lexicon words that stand in the text, exceptions aside."""
    found = set()
    for folded in readings(text):
        spans = None
        for end, word in automaton.iter(folded):
            start = end - len(word) + 1
            if (start and _in_word(folded[start - 1])) or (end + 1 < len(folded) and _in_word(folded[end + 1])):
                continue
            if spans is None:  # sought only in texts with a hit
                spans = [(m.start(), m.end()) for p in exceptions for m in re.finditer(rf"\b{re.escape(p)}\b", folded)]
            if not any(a <= start and end < b for a, b in spans):
                found.add((start, word))
    return [word for _, word in sorted(found)]


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def features(found: list[str], weights: dict[str, float], length: int) -> tuple[float, float]:
    total = sum(weights[w] for w in found)
    return math.log1p(total), math.log1p(total / math.sqrt(1 + length / 5))


def build(weights: dict[str, float]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in weights:
        a.add_word(w, w)
    a.make_automaton()
    return a


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, slightly ridged."""
    a = np.c_[np.ones(len(x)), x]
    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(b))
        b += np.clip(np.linalg.solve(h, a.T @ (y - p) - 1e-2 * b), -5, 5)
    return b


def training(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic of the training rows."""
    marks = labels.where(F.col("toxic").isNotNull() & (fold_of(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = marks.count()
    share = min(1.0, sample / max(n, 1))
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1.0))
    # some `sample` rows of 12 bytes, whatever the size of labels
    return materialize(docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("text", "toxic"), "toxicity-training")


def _log_odds(size) -> Column:
    a, n = F.col("a"), F.col("n")
    return F.log((a + 0.5) / (size["a"] + 1)) - F.log((n - a + 0.5) / (size["n"] - size["a"] + 1))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The lexicon's weights, the exception phrases and the curve, from a sample of the training rows."""
    train = training(docs, labels, sample)
    size = train.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("a")).first()
    counts = [F.sum("toxic").cast("long").alias("a"), F.count("*").alias("n")]
    words = train.mapInPandas(_word_sets, "word string, toxic int").groupBy("word").agg(*counts)
    # a word has MIN_DOCS toxic documents of the sample, which bounds the lexicon
    rows = words.where((F.col("a") >= MIN_DOCS) & (F.col("word") != "")).select("word", _log_odds(size).alias("w")).where(F.col("w") >= MIN_ODDS).collect()
    weights = {r["word"]: r["w"] for r in rows}
    model = {"weights": weights, "exceptions": [], "curve": [-30.0, 0.0, 0.0]}
    if not weights:
        return model
    near = train.mapInPandas(lambda it: _neighbours(it, weights), "pair string, toxic int").groupBy("pair").agg(*counts)
    # as many again as MIN_DOCS of the sample's documents stand behind each
    mild = near.where((F.col("n") - F.col("a") >= MIN_DOCS) & (_log_odds(size) <= 0)).select("pair").collect()
    model["exceptions"] = sorted(r["pair"] for r in mild)
    seen = train.mapInPandas(lambda it: _features(it, model), "toxic int, x double, y double").toPandas()
    model["curve"] = _curve(seen[["x", "y"]].to_numpy(float), seen["toxic"].to_numpy(float)).tolist()
    return model


def _word_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(w, int(y)) for t, y in zip(b["text"], b["toxic"]) for w in {w for r in readings(_str(t)) for w in re.findall(r"\w+", r)}]
        yield pd.DataFrame(rows, columns=["word", "toxic"])


def _neighbours(batches: Iterator[pd.DataFrame], weights: dict[str, float]) -> Iterator[pd.DataFrame]:
    """The pairs of neighbouring words of a text, each once, with one of the lexicon in them."""
    automaton = build(weights)
    for b in batches:
        rows = []
        for t, y in zip(b["text"], b["toxic"]):
            if hits(_str(t), automaton, []):
                w = re.findall(r"\w+", readings(_str(t))[-1])
                rows += [(p, int(y)) for p in {f"{x} {z}" for x, z in zip(w, w[1:]) if x in weights or z in weights}]
        yield pd.DataFrame(rows, columns=["pair", "toxic"])


def _str(text) -> str:
    return text if isinstance(text, str) else ""


def _features(batches: Iterator[pd.DataFrame], model: dict) -> Iterator[pd.DataFrame]:
    automaton, weights = build(model["weights"]), model["weights"]
    for b in batches:
        texts = list(map(_str, b["text"]))
        xy = [features(hits(t, automaton, model["exceptions"]), weights, len(t)) for t in texts]
        yield pd.DataFrame({"toxic": b["toxic"].to_numpy(), "x": [v[0] for v in xy], "y": [v[1] for v in xy]})


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits."""
    weights, curve = model["weights"], model["curve"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build(weights) if weights else None
        for b in batches:
            scores, n_hits = [], []
            for text in map(_str, b.column("text").to_pylist()):
                found = hits(text, automaton, model["exceptions"]) if weights else []
                x, y = features(found, weights, len(text))
                z = max(-30.0, min(30.0, curve[0] + curve[1] * x + curve[2] * y))
                scores.append(1 / (1 + math.exp(-z)))
                n_hits.append(len(found))
            more = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(n_hits, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *more], ["doc_id", "score", "predicted", "n_hits"])

    got = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int, n_hits long")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_hits")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
