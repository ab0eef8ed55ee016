"""The training-data operators against brute force, an exact round trip or held-out labels, and odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from binforge.llm import decontaminate, langid, licenses, lmscore, mixing, ngramjoin, quality, secrets, tokenstore, toxicity
from binforge.llm.common import table

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, h string"
BASE = " ".join(f"w{i}" for i in range(60))
ODD = [
    (1, None, "en", "a", 0, 1.0, "x"), (2, "", "en", "a", 0, 1.0, "x"), (3, BASE, "en", None, 0, 1.0, "x"), (3, BASE, "en", None, 0, 1.0, "x"),
    (4, BASE + " tail", None, "a", 0, 1.0, "x"), (5, "one two", "fr", "b", 0, 1.0, "x"), (6, "Ab " * 30000, "fr", "b", 0, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(odd, none):
    led = quality.ledger(odd)
    got = {r["doc_id"]: r for r in led.collect()}
    assert got[1]["n_words"] == 0 and got[3]["n_words"] == 60 and got[6]["n_repeat_words"] == 30000
    assert quality.ledger(none).count() == 0
    rows = {r["rule"]: r for r in quality.ablation(led, quality.V1).collect()}
    assert rows["repeated_windows"]["only_this"] == 1


def test_quality_windows(spark):
    texts = ["a b c a b c a b", "a a a a", "x y z", "p q r s p q r t p q r", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.measure(docs).collect():
        w = texts[r["doc_id"]].split()
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(g)
        assert r["n_repeat_words"] == len({i + k for i, x in enumerate(g) if n[x] > 1 for k in range(3)})


def test_language(spark, odd, none):
    model = langid.fit(table(spark, SF, "documents"))
    got = langid.predict(table(spark, SF, "documents"), model).where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).select("lang", "lang_pred").collect()
    assert sum(r[0] == r[1] for r in got) >= 0.9 * len(got)
    with pytest.raises(ValueError):  # odd has a column score already
        langid.predict(odd, model)
    back = langid.predict(odd, model, "told", "sure").collect()
    assert {r["doc_id"]: r["told"] for r in back}[1] == "und"
    assert sorted((repr(tuple(r)[:-2]) for r in back)) == sorted(repr(r) for r in map(tuple, odd.collect()))
    assert langid.predict(none, langid.fit(none), "told", "sure").count() == 0


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    return comp


def test_ngram_join(spark, odd, none):
    rng = np.random.default_rng(5)
    texts, k = {}, 0
    for size in (3, 5, 8, 12, 30, 90, 200):
        for _ in range(3):
            w = [f"t{x}" for x in rng.integers(0, 10**6, size)]
            for edits in (0, 0, 1, 2, 3, 4):
                v = list(w)
                for at in rng.integers(0, size, edits):
                    v[at] = f"e{rng.integers(10**6)}"
                texts[k] = " ".join(v)
                k += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngramjoin.join(docs).collect()} == brute_components(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.join(odd).collect()}
    assert got[1] == (0, 1) and got[3] == (57, 3) and got[4] == (58, 3) and got[5] == (1, 5)
    assert ngramjoin.join(none).count() == 0


def test_secrets(spark, none):
    key = "A1b2C3d4E5f6G7h8"
    rows = [(i, f"password = {key}{i if i > 5 else ''} and AKIA{'Z' * 14}", f"s{i}") for i in range(8)] + [(9, None, None)]
    got = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0]["n_assign"] == 1 and got[0]["n_access"] == 1 and got[0]["n_live"] == 0
    assert got[7]["n_live"] == 1 and got[0]["spans"].startswith("assign:0:27,access:")
    assert got[9]["spans"] == "" and secrets.scan(none).count() == 0


def brute_spans(text):
    """Base and own spans by scanning with each pattern from the end of the match before."""
    out = []
    for k, (name, pattern) in enumerate([("assign", secrets.ASSIGN), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"), *secrets.EXTRA.items()]):
        at = 0
        while m := re.compile(pattern, re.ASCII).search(text, at):
            at = m.end()
            value = m[2] if name == "assign" else m[0]
            if (name, len(value) >= 12) == ("assign", False) or (name == "access" and len(value) < 18) or (name == "hex" and len(value) < 16):
                continue
            out.append((m.start(), k, m.end(), name, value))
    return sorted(out)


def test_secrets_by_brute_force(spark):
    rng = np.random.default_rng(4)
    pieces = ["password = hunter2hunter2", "Token:'abcDEF123456789'", "api_key=short", "AKIA" + "Q" * 16, "AKIA7", "deadbeefdeadbeef01", "0123456789abcde", "ghp_" + "a1B2" * 6, "xoxb-1234567890-abc",
              "sk-" + "z9" * 10, "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK", "plain words", "übrig ✓", "SECRET = \"0123456789abcdef0123\"", "\n"]
    rows = [(int(i), " ".join(rng.choice(pieces, rng.integers(0, 9))), rng.choice(["a", "b", "c", None])) for i in range(150)]
    rows += [(400 + k, f"token = only{k}only{k}only{k} {pieces[k]}", "a") for k in range(5)]
    rows += [(1, None, "a"), (2, "", "b"), (3, "x " * 200_000 + pieces[0], "c"), (7, rows[7][1], rows[7][2]), (None, pieces[5], "a")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, source string, hash string, live string")
    owners, repos = {}, {}
    for i, t, o in rows:
        for s in brute_spans(t or ""):
            owners.setdefault(s[4], set()).add(o)
            repos.setdefault(s[4], set()).add((i, o))
    live = {v for v in owners if len(owners[v]) <= secrets.MAX_OWNERS and len(repos[v]) <= secrets.MAX_REPOS}
    want = []
    for i, t, _ in rows:
        spans = brute_spans(t or "")
        base = [s for s in spans if s[1] < 3]
        joined = lambda x: ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in x)
        values = {s[4] for s in spans}
        want.append((i, *(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(s for s in spans if s[1] < 3 or s[4] in live), len(values & live), len(values - live)))
    assert any(w[6] for w in want) and any(w[7] for w in want)
    for hot in (secrets.HOT, 5):  # the second sends verdicts of common candidates by a broadcast
        got = list(map(tuple, secrets.scan(docs, hot=hot).collect()))
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_widely_copied_secrets_are_examples(spark):
    key = "ghp_" + "a1B2" * 6
    rows = [(k, key, "one owner") for k in range(secrets.MAX_REPOS + 1)] + [(1000, "ghp_" + "c3D4" * 6, "one owner")]
    got = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0]["n_example"] == 1 and got[0]["spans"] == "" and got[1000]["n_live"] == 1 and got[1000]["spans"] == "github:0:28"


def test_toxicity(spark, odd, none):
    docs, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    caught = sum(r["predicted"] and r["toxic"] for r in got)
    assert caught >= 0.6 * sum(r["toxic"] for r in got) and caught >= 0.9 * sum(r["predicted"] for r in got)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and not any(r["n_hits"] for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert {r["score"] < 1e-9 for r in toxicity.score(odd, toxicity.fit(docs, labels.where("false"))).collect()} == {True}


def test_toxic_words_in_disguise():
    lexicon = {toxicity.fold(w): 1.0 for w in ("idiot", "clown", "ass")}
    automaton = toxicity.build(lexicon)
    n = lambda t: len(toxicity.hits(t, automaton, [toxicity.fold(x) for x in ("clown fish", "class clown")]))
    for t in ("you idiot now", "you idiot! now", "idiot$", "1D10Т!!!", "(ïdiot)", "!d!ot", "a$$", "as$", "@ss!", "cIown"):
        assert n(t) == 1, t
    for t in ("idiots", "class", "clown fish", "a class clown", "assume!", ""):
        assert n(t) == 0, t
    assert n("idiot! clown fish, clown, idiot") == 3


def test_toxicity_learns_exceptions(spark):
    rows = [(k, "you are a gronk today" if k % 2 else "the gronk valve was opened") for k in range(1, 80)] + [(k, "plain words here") for k in range(80, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 80 and k % 2)) for k, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert "gronk vaive" in model["exceptions"] or "gronk" not in model["weights"]


def test_token_store_round_trip(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    docs = odd.select("doc_id", "text").union(table(spark, SF, "documents").select(F.col("doc_id") + 100, "text"))
    at = tokenstore.write(docs, str(tmp_path / "store"))
    tok, start, want = Tokenizer.from_file(tokenstore.tokenizer_path()), 0, []
    for doc, text in sorted(map(tuple, docs.collect()), key=lambda r: r[0]):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), True))
        start += len(ids)
    assert sorted(map(tuple, tokenstore.verify(spark, at).collect())) == want
    back = {(r["doc_id"], r["start"]): zlib.crc32(np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4").tobytes()) for r in tokenstore.read_documents(spark, at).collect()}
    assert back == {(w[0], w[1]): w[3] for w in want}


def test_token_store_order_and_empty(spark, none, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame([((k * 37) % 1000, f"text {k}") for k in range(1000)] + [(None, "no id"), (5, "text again")], "doc_id long, text string")
        at = tokenstore.write(docs.repartition(5), str(tmp_path / "store"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ids = [i for f in sorted((tmp_path / "store" / "recipes").glob("part-*.parquet")) for i in pq.read_table(f)["doc_id"].to_pylist()]
    assert ids[0] is None and ids[1:] == sorted(ids[1:]) and len(ids) == 1002
    got = sorted(map(tuple, tokenstore.verify(spark, at).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == ids and all(r[4] for r in got) and [r[1] + r[2] for r in got][:-1] == [r[1] for r in got][1:]
    digests = [r[0] for r in spark.read.parquet(f"{at}/chunks").select("digest").collect()]
    assert len(digests) == len(set(map(bytes, digests)))
    assert tokenstore.verify(spark, tokenstore.write(none, str(tmp_path / "empty"))).count() == 0


def test_token_store_of_another_tokenizer(spark, tmp_path):
    """Not cut at spaces: a tokenizer that lower-cases and drops white space."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Some words,  here\nand there", "", None, "it's o'clock"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tok = Tokenizer.from_file(path)
    want = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for k, t in enumerate(texts)}
    back = tokenstore.read_documents(spark, tokenstore.write(docs, str(tmp_path / "store"), path)).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], f"<u{r['width']}").tolist() for r in back} == want


def test_words_and_whole_texts_encode_alike():
    e = tokenstore.Encoder(tokenstore.tokenizer_path())
    odd = ["", " ", "\n", "a\tb  c", " lead", "trail ", "it's o'clock 's x", "über den Fluß, 3rd 10% a_b\n\nx", "«quoté» 日本語 ﬁ ǆ ª²", "<|endoftext|> a<|endoftext|>b"]
    odd += ["x \x1c y\x1cz \x85 q", "naïve—dash … …\xa0a\n b\n", "don't\nwon't I'LL", "a\r\nb", "12abc34 !!!x", "x\n\ny z\n", "a \u2003 b"]
    for text in odd:
        assert e.ids(text) == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, e.kind).tobytes(), repr(text)


def test_decontaminate(spark, odd, none):
    item = " ".join(f"b{i}" for i in range(30))
    changed = item.replace("b9 ", "zz ").replace("b20 ", "yy ")
    docs = spark.createDataFrame([(1, "start " + item), (2, changed + " end"), (3, BASE), (4, None), (5, "b1 b2 b3 b4")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.overlaps(docs, items).collect()} == {1, 2}
    assert decontaminate.decontaminate(odd, items).count() == len(ODD)
    assert decontaminate.overlaps(none, items).count() == 0 and decontaminate.overlaps(odd, items.where("false")).count() == 0
    assert decontaminate.decontaminate(odd, items.where("false")).count() == len(ODD)


def brute_overlap(a, b):
    """Whether some ungapped alignment of token lists a and b is an overlap."""
    for shift in range(1 - len(b), len(a)):
        lo = max(0, -shift)
        same = [x == y for x, y in zip(a[shift + lo :], b[lo:])]
        now = best = 0
        for s in same:
            now = max(0, now + (1 if s else -4))
            best = max(best, now)
        if best >= decontaminate.MIN_SCORE or sum(same) >= decontaminate.SHARE * len(b):
            return True
    return False


def test_decontaminate_recall(spark, monkeypatch):
    rng = np.random.default_rng(11)
    items, docs = [], []
    for k in range(400):
        n = int(rng.choice([5, 8, 11, 12, 16, 20, 30, 50]))
        item = [f"t{x}" for x in rng.integers(0, 10**6, n)]
        items.append((k, item))
        changed = list(item)
        if n >= decontaminate.SPAN:
            for at in rng.choice(n, int(rng.integers(0, n // 5 + 1)), replace=False):
                changed[at] = "other"
        docs.append((k, [f"l{x}" for x in range(int(rng.integers(0, 9)))] + changed + ["end"]))
        docs.append((1000 + k, [f"u{x}" for x in rng.integers(0, 10**6, 40)]))
    want = {(i, k) for k, item in items for i, d in docs if i % 1000 == k and brute_overlap(d, item)}
    frame = lambda rows, c: spark.createDataFrame([(i, " ".join(t)) for i, t in rows], f"{c} long, text string")
    found = []
    for most in (decontaminate.BROADCAST_BYTES, 0):  # the second joins seeds by a shuffle
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
        found.append(sorted(map(tuple, decontaminate.overlaps(frame(docs, "doc_id"), frame(items, "item_id")).collect())))
    assert found[0] == found[1]
    got = {r[:2] for r in found[0]}
    assert got <= want and len(want) >= 390 and len(got) >= 0.95 * len(want)
    assert {r for r in want if len(items[r[1]][1]) < decontaminate.SPAN} <= got  # short items whole, without loss


def brute_losses(docs, good):
    """Word bigram losses by plain counting, each document's own counts taken out."""
    toks = [(i, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in docs]

    def counts(pick):
        word, pair = Counter(), Counter()
        for i, w in pick:
            if w:
                word.update([None, *w])
                pair.update(zip([None, *w], w))
        return word, pair

    out = []
    for k, (i, w) in enumerate(toks):
        row = []
        for rows in (toks, [x for x in toks if x[0] in good]):
            rows = [x for x in rows if x is not toks[k]]
            word, pair = counts(rows)
            n = sum(v for x, v in word.items() if x is not None)
            loss = []
            for a, b in zip([None, *w], w):
                p1 = word[b] / n if n else 0.0
                p2 = pair[a, b] / word[a] if word[a] else p1
                loss.append(-np.log2(0.7 * p2 + 0.25 * p1 + 0.05 * 2.0**-24))
            row.append(sum(loss) / len(loss) if loss else None)
        out.append((i, len(w), row[1], row[0]))
    return out


def test_lm_score(spark, odd, none, monkeypatch):
    docs = table(spark, SF, "documents")
    good = docs.where("lang = 'en'").select("doc_id")
    few = docs.limit(40).select("doc_id", F.substring("text", 1, 1500).alias("text")).union(odd.select("doc_id", "text")).cache()
    want = sorted(brute_losses([tuple(r) for r in few.collect()], {r[0] for r in good.collect()}), key=repr)
    for batch, slots in ((lmscore.BATCH, lmscore.PACKED_SLOTS), (700, lmscore.PACKED_SLOTS), (700, 1)):  # packed by slot, and an entry a row
        monkeypatch.setattr(lmscore, "BATCH", batch)
        monkeypatch.setattr(lmscore, "PACKED_SLOTS", slots)
        got = sorted((tuple(r)[:4] for r in lmscore.score(few, good).collect()), key=repr)
        assert len(got) == len(want)
        for g, w in zip(sorted(got, key=lambda r: r[:2]), sorted(want, key=lambda r: r[:2])):
            assert g[:2] == w[:2] and (g[2:] == w[2:] or np.allclose(g[2:], w[2:]))
    got = lmscore.score(docs, good).join(docs.select("doc_id", "lang"), "doc_id").groupBy(F.col("lang") == "en").agg(F.avg("score").alias("s")).collect()
    s = {r[0]: r[1] for r in got}
    assert s[True] < s[False]
    assert {r["doc_id"]: r["score"] for r in lmscore.score(odd, good).collect()}[1] is None
    assert lmscore.score(odd, none).where("target_loss is not null").count() == 5
    assert lmscore.score(none, good).count() == 0


def test_mixing(spark, odd, none):
    docs = table(spark, SF01, "documents")
    got = mixing.plan(docs).collect()
    taken, goal, most = Counter(), {}, {}
    for r in got:
        taken[r["source"]] += r["size"] * r["copies"]
        goal[r["source"]] = r["target"]
        most[r["source"]] = max(most.get(r["source"], 0), r["size"])
        assert r["copies"] <= 2 and 0 <= r["pi"] <= 1
    assert all(abs(taken[s] - goal[s]) <= most[s] for s in goal)
    # the order is that of Pareto ranks, not of u: within a source, of the documents left to chance, the lowest ranks are in
    chance, n_pi = {}, set()
    for r in got:
        whole = int(r["target"] // r["source_size"])
        if 0 < r["pi"] < 1 and r["size"]:
            assert abs(r["rank"] - r["u"] / (1 - r["u"]) * (1 - r["pi"]) / r["pi"]) <= 1e-9 * r["rank"]
            chance.setdefault(r["source"], []).append((r["rank"], r["u"], r["copies"] > whole))
            n_pi.add((r["source"], r["pi"]))
        elif r["size"]:
            assert r["copies"] == whole + (r["pi"] == 1)
    assert chance and len(n_pi) > 3 * len(chance)
    for rows in chance.values():
        inside, outside = ([r for r in rows if r[2] == x] for x in (True, False))
        assert max(r[0] for r in inside) < min(r[0] for r in outside)
        assert max(r[1] for r in inside) > min(r[1] for r in outside)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.plan(docs.repartition(7)).collect()))
    assert mixing.plan(odd).count() == len(ODD) and mixing.plan(none).count() == 0
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(none).count() == 0


def test_inclusion():
    words = {0: 100, 4: 50, 12: 400, 40: 30}
    for rest in (0.0, 1.0, 90.0, 300.0, 580.0):
        pi = mixing.inclusion(words, rest)
        assert abs(sum(words[k] * pi[k] for k in words) - rest) < 1e-6 and max(pi.values()) <= 1
        free = [k for k in words if 0 < pi[k] < 1]
        assert all(abs(pi[a] / pi[b] - 2 ** ((a - b) * mixing.POWER / mixing.CLASSES)) < 1e-9 for a in free for b in free)


def test_licenses(spark, odd, none):
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, "All rights reserved. CC BY"), (3, None), (4, "license"), (5, "Released under the MIT License.")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "apache-2.0" and got[2]["base_labels"] == "cc-by,reserved" and got[2]["n_base"] == 2
    assert got[3]["n_words"] == 0 and got[4]["labels"] == "" and got[5]["labels"] == "mit" and (got[2]["first_word"], got[2]["last_word"]) == (0, 3)
    assert licenses.scan(none).count() == 0 and licenses.scan(odd).count() == len(ODD)


def plain_licences(words, n, df):
    """labels and score of a file's words: every beginning of every template."""
    labels, best = set(), 0.0
    for label, text, own in licenses.TEMPLATES:
        t = licenses.word_list(text)
        common = lambda x: df[x] * licenses.COMMON > n
        few = sorted(set(t), key=lambda x: (df[x], [-ord(c) for c in x], -len(x)))[: licenses.FEWEST]
        rare = [j for j, x in enumerate(t) if not common(x) or x in few]
        at = {}
        for i, x in enumerate(words):
            for j in rare:
                if t[j] == x:
                    at.setdefault(i - j, set()).add(j)
            for f, p in enumerate(own):
                w = p.split()
                if words[i : i + len(w)] == w:
                    at.setdefault(i - next(o for o in range(len(t)) if t[o : o + len(w)] == w), set()).add(-1 - f)
        for o in at:
            codes = set().union(*(at.get(o + s, set()) for s in range(-licenses.SLACK, licenses.SLACK + 1)))
            share = sum(c >= 0 for c in codes) / len(rare)
            if sum(c < 0 for c in codes) == len(own) and share >= licenses.LEAST:
                labels.add(label)
                best = max(best, share)
    return labels, best


def test_licenses_by_brute_force(spark):
    rng = np.random.default_rng(6)
    notices = [t for _, t, _ in licenses.TEMPLATES] + [p.upper() for p, _ in licenses.BASE_PHRASES]
    rows = []
    for i in range(120):
        parts = list(rng.choice(notices, rng.integers(0, 5))) + list(rng.choice(["some words", "license license", "Creative forms", "é2 – terms\n"], 3))
        rng.shuffle(parts)
        w = " ".join(parts).split(" ")
        for _ in range(int(rng.integers(0, 1 + len(w) // 8))):  # words changed, put in, left out
            k = int(rng.integers(0, len(w)))
            w[k : k + int(rng.integers(0, 2))] = list(rng.choice(["another", "license", "of", "compiled"], int(rng.integers(0, 2))))
            w = w or ["x"]
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "word " * 100_000 + notices[1]), (203, "general public license " * 3_000), (3, rows[3][1]), (None, notices[0])]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, v string, places string, row int")
    words = {k: re.findall(licenses.LICENSE_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for k, (_, t) in enumerate(rows)}
    df = {x: sum(x in set(w) for w in words.values()) for x in licenses.vocabulary()}
    want = []
    for k, (i, _) in enumerate(rows):
        w = words[k]
        base = [(p, label) for phrase, label in licenses.BASE_PHRASES for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        labels, best = plain_licences(w, len(rows), df)
        starts = [p for p, _ in base]
        want.append((i, len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels | {x for _, x in base})), round(max(best, 0.5 if base else 0.0), 6)))
    got = [tuple(r) for r in licenses.scan(docs).collect()]
    key = lambda r: repr(r[:7])
    for g, x in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:7] == x[:7] and abs(g[7] - x[7]) < 2e-6


def test_licences_with_words_changed(spark):
    mit, bsd = (next(t for label, t, _ in licenses.TEMPLATES if label == own and len(t) > 100) for own in ("mit", "bsd"))
    rows = [
        (1, "We ship source and binary forms of the tool."), (2, mit.replace("person", "individual")), (3, bsd.replace("binary forms", "compiled binary forms")),
        (4, mit.replace("hereby granted", "given")), (5, "Permission is hereby granted, free of charge, to park here."), (6, "mit " * 50), (7, "the mozilla foundation and the public license of the city"),
        (8, "no licence at all"), (9, bsd[: len(bsd) // 2]),
        *((k, "other texts") for k in range(100, 200)),
    ]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: v for k, v in got.items() if v} == {2: "mit", 3: "bsd", 9: "bsd"}


def test_sql(spark):
    """The queries that have SQL, on the small tables."""
    import duckdb

    from binforge.llm.queries import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    for name in ("documents", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, SF)
        r = c.execute(sql)
        columns = [x[0] for x in r.description]
        assert sorted(columns) == sorted(df.columns), name
        assert sorted(repr(tuple(x)) for x in df.select(columns).collect()) == sorted(repr(x) for x in r.fetchall()), name
