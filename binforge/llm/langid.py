"""Language identification by hierarchical discrimination.

A linear model picks the language family; within it, one-versus-one linear support
vector machines vote. Features are hashed counts of letter 1-, 2- and 3-grams of
the whole text, with their square roots scaled to unit length.

The models are fitted on at most about PER_LANG documents of each language, chosen by a hash
of their id among rows with a lang whose crc32(doc_id) mod 5 is not 0. Each model is fitted by a
task of its own: one for the families, from at most about PER_FAMILY documents of each, and one for each two
languages of a family. The driver gets the weights only.

How like its language a text is: the cosine with the language's mean vector. The least one
accepted is calibrated for texts of about as many letters, on pieces of the training
documents; a text below it gets a score under 0.5, so one in a language that was never
learned, or letter junk, can be told. A few letters prove little either way.

Defined results: null text and text without a letter are ``und`` with score 0; with
no labelled row every text is ``und``; repeated rows give a row each; a null id is neither learned from nor held
out; other columns are kept as they are, and a name they have already can't be asked for.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import fold_of, held_out, materialize, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS, PER_LANG, PER_FAMILY = 13, 300, 600
#: The least cosine accepted: this quantile of the training pieces' cosines, times the slack.
LEAST, SLACK = 0.005, 0.9
#: Languages of one family; any other language is a family of its own.
FAMILIES = {x: f for f, xs in {"germanic": "en de nl sv da no is af", "romance": "fr es it pt ro ca", "slavic": "ru uk pl cs sk bg sr hr"}.items() for x in xs.split()}
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def vector(text: str | None) -> np.ndarray | None:
    """Unit vector of hashed letter n-grams; None without a letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[c]
    if not is_letter.any():
        return None
    c = np.where(is_letter, c, 32).astype(np.uint64)
    c = np.r_[np.uint64(32), c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]], np.uint64(32)]
    k = (c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    two = k[:-1] * np.uint64(3) + (k[1:] >> np.uint64(7))
    three = two[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + (k[2:] >> np.uint64(11))
    h = np.concatenate([g * np.uint64(0x165667B19E3779F9) >> np.uint64(64 - BITS) for g in (k, two, three)])
    v = np.sqrt(np.bincount(h.astype(np.int64), minlength=1 << BITS))
    return (v / np.linalg.norm(v)).astype(np.float32)


def svm(a: np.ndarray, y: np.ndarray, rounds: int = 120, reg: float = 1e-4) -> np.ndarray:
    """Linear SVM, squared hinge loss, by accelerated gradient steps; y is +1 or -1, classes weigh alike."""
    c = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = z = np.zeros(a.shape[1], np.float32)
    for t in range(rounds):
        loss = np.maximum(0, 1 - y * (a @ z))
        new = z - np.float32(0.2) * (np.float32(reg) * z - 2 * ((c * y * loss) @ a))
        z, w = new + np.float32(t / (t + 3)) * (new - w), new
    return w


def _trained(rows: pd.DataFrame) -> pd.DataFrame:
    """The weights of one problem: the families against each other, two languages, or a language's mean."""
    problem = rows["problem"].iloc[0]
    kind, _, rest = problem.partition(":")
    a = np.ones((len(rows), (1 << BITS) + 1), np.float32)  # the last column is the bias
    for k, v in enumerate(rows["v"]):
        a[k, :-1] = np.frombuffer(v, np.float16)
    lang = rows["lang"].to_numpy()
    if kind == "mean":
        m = a[:, :-1].mean(0)
        made = [(rest, m / np.linalg.norm(m))]
    elif kind == "pair":
        made = [(rest, svm(a, np.where(lang == rest.split("\t")[0], 1, -1).astype(np.float32)))]
    else:
        family = np.array([FAMILIES.get(x, x) for x in lang])
        made = [(f, svm(a, np.where(family == f, 1, -1).astype(np.float32))) for f in sorted(set(family))]
    return pd.DataFrame([(kind, name, w.astype("<f4").tobytes()) for name, w in made], columns=["kind", "name", "weights"])


def _problems(langs: list[str]) -> dict[str, list[str]]:
    """For each language, the problems that its documents are sent to."""
    out = {x: [f"mean:{x}"] for x in langs}
    for a, b in combinations(langs, 2):
        if FAMILIES.get(a, a) == FAMILIES.get(b, b):
            for x in (a, b):
                out[x].append(f"pair:{a}\t{b}")
    return out


def fit(docs: DataFrame, per_lang: int = PER_LANG, per_family: int = PER_FAMILY) -> dict:
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id")) != 0)).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {"langs": []}
    full = 1 << 30
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(full))
    part = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(full if n <= per_lang else int(full * per_lang / n)))))
    few = materialize(rows.where(lot < part[F.col("lang")]).withColumn("lot", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(full))).select("text", "lang", "lot"), "languages")
    vectors = few.mapInPandas(_vectors, "lang string, lot long, v binary")
    taken = {x: min(n, per_lang) for x, n in counts.items()}
    langs = sorted(counts)
    size = {x: sum(n for y, n in taken.items() if FAMILIES.get(y, y) == FAMILIES.get(x, x)) for x in langs}
    at = lambda values: F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))[F.col("lang")]
    own = at({x: F.array(*map(F.lit, p)) for x, p in _problems(langs).items()})
    share = at({x: F.lit(min(full, int(full * per_family / size[x]))) for x in langs})
    several = len({FAMILIES.get(x, x) for x in langs}) > 1
    sent = F.when(F.lit(several) & (F.col("lot") < share), F.concat(own, F.array(F.lit("first:")))).otherwise(own)
    # a group is bounded by per_lang and per_family; its weights are all that leaves it
    got = vectors.select("lang", "v", F.explode(sent).alias("problem")).groupBy("problem").applyInPandas(_trained, "kind string, name string, weights binary").collect()
    weights = {(r["kind"], r["name"]): np.frombuffer(r["weights"], "<f4") for r in got}
    split = lambda w: (w[:-1], float(w[-1]))
    langs = sorted(n for k, n in weights if k == "mean")  # those with a letter in some text
    families = sorted({FAMILIES.get(x, x) for x in langs})
    model = {"langs": langs, "families": families, "members": {f: [x for x in langs if FAMILIES.get(x, x) == f] for f in families}}
    model["first"] = [split(weights["first", f]) for f in families] if len(families) > 1 else []
    model["pairs"] = {tuple(n.split("\t")): split(w) for (k, n), w in weights.items() if k == "pair" and set(n.split("\t")) <= set(langs)}
    model["means"] = {x: weights["mean", x] for x in langs}
    cosines = few.mapInPandas(_cosines(model["means"]), "lang string, size int, cosine double").groupBy("lang", "size").agg(F.percentile_approx("cosine", LEAST, 10_000).alias("least"))
    model["least"] = {(r["lang"], r["size"]): SLACK * r["least"] for r in cosines.collect()}  # some twenty sizes a language
    return model


def size_of(text: str) -> int:
    """Letters of a text, as a power of two."""
    return int(letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].sum()).bit_length()


def _pieces(text: str) -> Iterator[str]:
    w, n = text.split(), 1
    while n < len(w):
        yield " ".join(w[:n])
        yield " ".join(w[len(w) - n :])
        n *= 2
    yield text


def _cosines(means: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(lang, size_of(t), float(v @ means[lang])) for lang, text in zip(b["lang"], b["text"]) if lang in means for t in _pieces(text) if (v := vector(t)) is not None]
            yield pd.DataFrame(rows, columns=["lang", "size", "cosine"])

    return run


def _least(model: dict, lang: str, size: int) -> float:
    """That of the size, or of the next smaller one that training had."""
    return next((model["least"][lang, k] for k in range(size, 0, -1) if (lang, k) in model["least"]), 0.0)


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), 200):
            part = b.iloc[at : at + 200]
            rows = [(lang, lot, v.astype(np.float16).tobytes()) for lang, lot, t in zip(part["lang"], part["lot"], part["text"]) if (v := vector(t)) is not None]
            yield pd.DataFrame(rows, columns=["lang", "lot", "v"])


def _sure(margin: float) -> float:
    return float(1 / (1 + np.exp(-4 * margin)))


def classify(text: str | None, model: dict) -> tuple[str, float]:
    v = vector(text) if model["langs"] else None
    if v is None:
        return "und", 0.0
    score, family = 1.0, model["families"][0]
    if model["first"]:
        margins = [float(v @ w + b) for w, b in model["first"]]
        order = np.argsort(margins)[::-1]
        family = model["families"][order[0]]
        score = _sure((margins[order[0]] - margins[order[1]]) / 2)
    members = model["members"][family]
    votes = dict.fromkeys(members, 0.0)
    for (a, b), (w, c) in model["pairs"].items():
        if a in votes and b in votes:
            p = _sure(float(v @ w + c))
            votes[a] += (p > 0.5) + p / len(members)
            votes[b] += (p <= 0.5) + (1 - p) / len(members)
    best = max(members, key=lambda m: votes[m])
    for (a, b), (w, c) in model["pairs"].items():
        if best in (a, b):
            p = _sure(float(v @ w + c))
            score = min(score, p if a == best else 1 - p)
    cosine, least = float(v @ model["means"][best]), _least(model, best, size_of(text))
    return best, score if cosine >= least else min(score, 0.5 * cosine / least)


def predict(docs: DataFrame, model: dict, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs' columns, untouched, with the predicted language and its score under the names given."""
    if {lang.lower(), score.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs have a column {lang} or {score} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            got = [classify(t, model) for t in b.column("text").to_pylist()]
            more = [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, lang, score])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())]))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = predict(docs.select("doc_id", "text"), fit(docs))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
