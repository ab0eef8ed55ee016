"""The pipeline's stages on odd rows and against brute force."""

import random
import re

import pytest

import corpus_pipeline
from binforge.llm import decontaminate, mixing
from binforge.llm.common import table

SF = "/root/testdata/sf0.001"
# names that operators use inside
EXTRA = ["score", "h", "key", "id", "part", "lang_pred", "rank", "copies", "row", "seed", "size", "class", "text_key", "row_key"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = [f"{a}{b}{c}" for a in ("the", "an", "ing", "er", "ou") for b in ("st", "th", "re", "on", "wh") for c in ("ed", "ly", "and", "in", "es")]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    out, base = [], [text(40) for _ in range(12)]
    for k, t in enumerate(base):
        out.append((k, t))
        w = t.split()
        w[0] = "changed"
        out += [(100 + k, " ".join(w)), (200 + k, t), (200 + k, t)]  # a near copy, an exact one, a repeated row
    out += [(None, base[3]), (None, text(40)), (None, text(40)), (7, text(50)), (300, None), (301, ""), (302, "..."), (302, "..."), (303, text(20000))]
    rng.shuffle(out)
    return [(i, t, "en", rng.choice(["a", "b", None]), len(t or ""), *(f"{c}{k}" for c in EXTRA)) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:4])
def test_columns_are_kept_as_they_are(spark, docs, rows, name, stage):
    got = stage(spark, docs, SF)
    assert got.schema.names == docs.schema.names
    kept = [tuple(r) for r in got.collect()]
    assert kept and set(kept) <= set(rows)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_empty_table(spark, name, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), SF).count() == 0


def test_language_keeps_every_row_of_a_learned_language(spark, docs, rows):
    got = sorted(map(repr, map(tuple, corpus_pipeline.language(spark, docs, SF).collect())))
    assert got == sorted(repr(r) for r in rows if re.search("[a-z]", r[1] or ""))


def test_one_row_of_each_component(spark, docs, rows):
    distinct = list({(r[0], r[1]) for r in rows})
    sets = [shingle_set(t) for _, t in distinct]
    comp = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(len(sets)):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    want = []
    for c in set(comp):
        members = [distinct[k] for k in range(len(sets)) if comp[k] == c]
        want.append(min((i is None, i or 0) for i, _ in members))
    got = [(r["doc_id"] is None, r["doc_id"] or 0) for r in corpus_pipeline.near_copies(spark, docs, SF).collect()]
    assert sorted(got) == sorted(want)


def test_decontamination_goes_by_text(spark, docs, rows):
    passage = table(spark, SF, "benchmark").first()["text"]
    bad = [(r[0], f"{r[1] or ''} {passage} and so on", *r[2:]) for r in rows if r[0] in (None, 5, 300)]
    got = corpus_pipeline.decontaminated(spark, docs.union(spark.createDataFrame(bad, SCHEMA)), SF).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows))


def test_mix_takes_what_the_plan_says(spark, docs):
    got, want = {}, {}
    for r in corpus_pipeline.mixed(spark, docs, SF).collect():
        k = (r["doc_id"], r["source"], len(words(r["text"])))
        got[k] = got.get(k, 0) + 1
    for r in mixing.plan(docs).collect():
        k = (r["doc_id"], r["source"], r["size"])
        want[k] = want.get(k, 0) + r["copies"]
    assert got == {k: n for k, n in want.items() if n}


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and all(r["verified"] for r in got)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    bad = {r["doc_id"] for r in decontaminate.overlaps(table(spark, SF, "documents"), table(spark, SF, "benchmark")).collect()}
    assert bad and not bad & {r["doc_id"] for r in got}
