"""Cases that the operators once left out, by brute force."""

import re

import numpy as np

import corpus_pipeline
from binforge.llm import licenses, ngramjoin
from binforge.llm.common import materialize, table


def brute_links(texts):
    """doc_id: the other documents that it links with."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    return {a: {b for b in sets if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])} for a in sets}


def test_every_link_within_a_component(spark, monkeypatch):
    rng = np.random.default_rng(7)
    texts = {0: None, 1: "", 2: "one two"}
    for size in (12, 60, 200):
        w = [f"t{x}" for x in rng.integers(0, 10**6, size)]
        for k in range(25):  # near copies of several lengths, and a chain that drifts away
            v = w[: size - int(rng.integers(0, size // 8))]
            v[int(rng.integers(0, len(v)))] = f"e{k % 20}"
            texts[len(texts)] = " ".join(v)
            w[k % size] = f"d{k}" if k % 3 == 0 else w[k % size]
        texts[len(texts)] = texts[len(texts) - 1]
    want = brute_links(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (ngramjoin.BLOCK, 300):  # the second deals each component over many blocks
        monkeypatch.setattr(ngramjoin, "BLOCK", block)
        got = ngramjoin.join(docs).collect()
        assert {r["doc_id"]: r["n_links"] for r in got} == {i: len(x) for i, x in want.items()}
        classes = {r["class_id"] for r in got}
        pairs = [(r["a"], r["b"]) for r in ngramjoin.links(docs).collect()]
        assert len(pairs) == len(set(pairs))
        assert set(pairs) == {(a, b) for a in classes for b in want[a] & classes if a < b}


def test_only_texts_of_pairs_are_shuffled(spark, monkeypatch):
    """Verification leaves texts that are on no pair where they are; beyond the bound they are shuffled, with the same result."""
    line = " ".join(f"w{k}" for k in range(40))
    texts = materialize(spark.createDataFrame([(k, f"{line} e{k}" if k < 6 else f"other {k}") for k in range(300)], "id long, text string"), "texts")
    pairs = materialize(spark.createDataFrame([(0, 1), (0, 5), (2, 7), (3, 4)], "a long, b long"), "pairs")
    for sent in (ngramjoin.SENT_IDS, 0):
        monkeypatch.setattr(ngramjoin, "SENT_IDS", sent)
        got = ngramjoin.verified(pairs, texts)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "LeftSemi" in plan
        assert sent == 0 or "BroadcastHashJoin [id" in plan
        assert sorted(map(tuple, got.collect())) == [(0, 1), (0, 5), (3, 4)]


def test_a_hub_unlike_the_others_is_no_square(spark):
    """Near copies under common keys with a first text that few of them link with."""
    rng = np.random.default_rng(9)
    base = [f"t{x}" for x in rng.integers(0, 10**6, 400)]
    texts = {0: " ".join(base[:330] + [f"o{k}" for k in range(70)])}
    for k in range(1, 60):
        w = list(base)
        w[int(rng.integers(0, 400))] = f"e{k}"
        texts[k] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngramjoin.join(docs).collect()}
    want = brute_links(texts)
    assert {i: n for i, (_, n) in got.items()} == {i: len(x) for i, x in want.items()}
    assert {c for i, (c, _) in got.items() if i} == {1} and got[0][0] == 0 and not want[0]


def test_six_notices_in_one_file(spark):
    notices = {
        "apache-2.0": "Licensed under the Apache License, Version 2.0.",
        "mit": "Released under the MIT License.",
        "bsd": "Redistribution and use in source and binary forms.",
        "gpl": "Licensed under the GNU General Public License version 3.",
        "mpl-2.0": "Subject to the terms of the Mozilla Public License.",
        "cc-by": "Creative Commons Attribution License.",
    }
    # one licence in a third of all files makes its words common
    rows = [(k, notices["mit"] if k % 3 else "no notice") for k in range(30)] + [(99, " ".join(notices.values()) + " binary forms terms subject creative")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99]["labels"] == ",".join(sorted(notices)) and abs(got[99]["score"] - 1) < 1e-9
    assert got[1]["labels"] == "mit" and got[0]["labels"] == ""


def test_unlearned_languages_are_rejected(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    strange = [
        "Съешь же ещё этих мягких французских булок, да выпей чаю. Широкая электрификация южных губерний даст мощный толчок.",
        "Zażółć gęślą jaźń. Litwo, ojczyzno moja, ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie, kto cię stracił.",
        "xq zzkv qqwx jjzk vxxq wkkz qzqz xvxv kqjx zzqx wvqk jxqz kkvq xzwq",
    ]
    odd = [(-1 - k, t) for k, t in enumerate(strange)]
    clean = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text").collect()
    short = [(10**6 + k, " ".join(r["text"].split()[:n])) for k, r in enumerate(clean[:60]) for n in (1, 3, 6)]
    rows = spark.createDataFrame(odd + short, "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) lang", "'s' source", "cast(0 as long) n_chars")
    got = [r["doc_id"] for r in corpus_pipeline.language(spark, docs.select("doc_id", "text", "lang", "source", "n_chars").union(rows), "").collect()]
    ids = {r["doc_id"] for r in clean}
    assert min(got) >= 0
    assert sum(i in ids for i in got) >= 0.98 * len(clean) and sum(i >= 10**6 for i in got) >= 0.95 * len(short)
