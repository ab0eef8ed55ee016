"""Packing, vector codes and the divergence audit by brute force, and odd inputs."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from binforge.llm import divergence, langid, lmscore, packing, quality, secrets, toxicity, vectorcodes
from binforge.llm.common import held_out, materialize, table

SF = "/root/testdata/sf0.001"


def plain_best_two_fit(lengths, size):
    """Sequence by sequence, over a list of lengths."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        own = []
        for x in list(left):
            if sum(own) + x <= size:
                own.append(x)
                left.remove(x)
        gap, small = size - sum(own), min(own)
        if gap:
            pairs = [(x + y, x, y) for i, x in enumerate(left) for y in left[i + 1 :] if small < x + y <= gap + small]
            if pairs:
                _, x, y = max(pairs)
                own.remove(small)
                own += [x, y]
                left.remove(x)
                left.remove(y)
                left = sorted([*left, small], reverse=True)
        out.append(sorted(own, reverse=True))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_patterns_are_the_sequences_one_by_one(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(5, 60))
    lengths = rng.integers(1, size + 1, int(rng.integers(1, 160))) if seed % 2 else rng.choice(rng.integers(1, size + 1, 6), 150)
    counts = np.bincount(lengths, minlength=size + 1)
    got = packing.best_two_fit(counts, size)
    numbers = packing.nth_of_kind(lengths, np.zeros(size + 1, np.int64))
    sequence, offset = got.place(lengths, numbers)
    held = [sorted(lengths[sequence == s].tolist(), reverse=True) for s in range(got.sequences)]
    assert held == plain_best_two_fit(lengths.tolist(), size)
    for s in range(got.sequences):
        at = np.argsort(offset[sequence == s])
        own = lengths[sequence == s][at]
        assert (offset[sequence == s][at] == np.cumsum(own) - own).all() and own.sum() <= size


def test_two_fit_beats_greedy():
    # greedy: 6 + 3, and a gap of 1; 2 + 2 fit the expanded gap of 4
    got = packing.best_two_fit(np.bincount([6, 3, 2, 2], minlength=11), 10)
    sequence, _ = got.place(np.array([6, 3, 2, 2]), np.array([0, 0, 0, 1]))
    assert sequence.tolist() == [0, 1, 0, 0]


def test_words_encode_as_whole_texts():
    encoder = packing.Encoder(packing.tokenizer_path())
    assert encoder.by_word
    texts = [
        "It's Öl—naïve ÀÉ re%%% a_b__c 12345 x9y", "don't 'tis 'sab O'Neil's", " lead\n\ntrail \t tab\tbed\r\n", "<|startoftext|>a <|endoftext|> b<|endoftext|>c", "é ́x ﬁ ß İI Σς 日本語 한국",
        "a b c", "", "\n", "#$%&*<>|", "x" * 3000, "\x00\x01a\x7f", "½ ² ٣ 𝔘", "…“q” (r)",
    ]
    ids, ends = encoder.encode(pa.array([*texts, None]))
    for text, x, y in zip([*texts, ""], np.r_[0, ends], ends):
        assert ids[x:y].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def placed_by_brute_force(texts, rows, size):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    got, seen = {}, {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, text in texts.items():
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(got[doc], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in own] == [(k, s, min(size, len(ids) - s)) for k, s in enumerate(range(0, len(ids), size))]
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert np.frombuffer(r["ids"], "<u2").tolist() == part.tolist() if "ids" in r.asDict() else r["ids_crc32"] == zlib.crc32(part)
    for own in seen.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [at for at, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= size
    return len(seen)


def test_packing_of_a_table(spark, monkeypatch):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    rows = packing.op11_best_fit_packing(spark, SF).collect()
    n, tokens = placed_by_brute_force(texts, rows, 2048), sum(r["length"] for r in rows)
    assert n <= 1.02 * tokens / 2048 + 1
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)  # first numbers joined by a shuffle
    assert len({r["sequence_id"] for r in packing.op11_best_fit_packing(spark, SF).collect()}) == n


def test_packing_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b " * 3000), (4, "same text"), (5, "same text"), (2**60 + 1, "one"), (None, "null id")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, length string, part int")
    got = packing.pack(docs, size=64)
    kept = got.collect()
    placed_by_brute_force(dict(rows), kept, 64)
    assert {r["doc_id"] for r in kept} == {i for i, _ in rows}
    whole = {r["sequence_id"]: r for r in packing.sequences(got).collect()}
    for r in kept:
        s = whole[r["sequence_id"]]
        assert bytes(s["ids"])[2 * r["offset"] :].startswith(bytes(r["ids"])) and r["doc_id"] in s["doc_ids"] and s["n_tokens"] <= 64
    again = packing.pack(spark.createDataFrame([(1, "same"), (1, "same")], "doc_id long, text string")).collect()
    assert len(again) == 2 and len({(r["sequence_id"], r["offset"]) for r in again}) == 2
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [int(np.floor(np.float64(x) * 256)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))
    d = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    off = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(r[1], p) for r in order[:entries]] for p in range(parts)]
    near = lambda v, p: min((off(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        fresh = []
        for p in range(parts):
            held = {}
            for _, v, _ in kept:
                held.setdefault(near(v, p)[1], []).append(cut(v, p))
            fresh.append([[sum(x) // len(x) for x in zip(*held[k])] if k in held else e for k, e in enumerate(books[p])])
        books = fresh
    out = [(i, lab, [near(v, p) for p in range(parts)]) for i, v, lab in kept]
    by_label = Counter()
    for _, lab, n in out:
        by_label[lab] += sum(x for x, _ in n)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in n), sum(x for x, _ in n), by_label[lab], sha) for i, lab, n in out), key=str)


def digest(spark, docs):
    codes, books = vectorcodes.compress(docs)
    rows = vectorcodes.label_errors(codes).collect()
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], vectorcodes.sha256_of(books)) for r in rows), key=str)


def test_vector_codes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=32)], int(rng.integers(0, 3)) if i % 7 else None) for i in range(150)]
    rows += [(200, None, 1), (201, [None] + [0.0] * 31, 1), (202, [float("nan")] * 32, 1), (203, [float("-inf")] + [0.0] * 31, 2), (None, [0.5] * 32, 1), (2**60 + 1, [-0.001] * 32, None), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<float>, label int, size int, code string").repartition(5)
    assert digest(spark, docs) == plain_codes(rows)
    monkeypatch.setattr(vectorcodes, "ROWS", 9)
    monkeypatch.setattr(vectorcodes, "BROADCAST_LABELS", 0)
    assert digest(spark, docs) == plain_codes(rows)
    few = docs.where("vec_id < 10")
    assert digest(spark, few) == plain_codes([r for r in rows if r[0] is not None and r[0] < 10])
    assert digest(spark, docs.where("vec_id = 200")) == [] and digest(spark, docs.limit(0)) == []
    with pytest.raises(Exception, match="length"):
        vectorcodes.compress(spark.createDataFrame([(1, [0.0] * 15, 1)], "vec_id long, embedding array<float>, label int"))


def plain_audit(rows, least, ranks):
    counts, docs, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        w = [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts.update((lang, source, t) for t in w)
        docs.update((lang, t) for t in set(w))
    out = []
    for lang, source in groups:
        kept = sorted((t for (g, t), n in docs.items() if g == lang and n >= least), key=str.encode)
        n = lambda s: [counts[lang, s, t] for t in kept]  # noqa: E731, B023
        share = lambda c: [1 + 10**9 * (x + 5) // (sum(c) + 5 * len(kept)) for x in c]  # noqa: E731, B023
        sources = [s for g, s in groups if g == lang]
        p, q = share(n(source)), share([sum(x) for x in zip(*map(n, sources))])
        pairs = [(-sum(abs(x - y) for x, y in zip(p, share(n(s)))), s.encode()) for s in sources if s != source]
        terms = [(y - x, t.encode()) for x, y, t, c in zip(p, q, kept, n(source)) if c and x > y]
        for part, got in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
            out += [(lang, source, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(got)]
    return sorted(out)


def test_divergence(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["the", "The", "naïve", "Ärger", "ärger", "b2c", "日本", "z", "é", "a-b", "x_y", "𝔘n", "￿q", "q" * 5000]
    rows = [(" ".join(rng.choice(words, int(rng.integers(0, 30)))), str(rng.choice(["en", "de"])), f"s{int(rng.integers(0, 12))}") for _ in range(400)]
    rows += [(None, "en", None), ("the z", None, None), ("", "fr", "only"), ("rare", "xx", "a"), ("rare", "xx", "b"), ("the the z", "en", "ünter"), rows[0], rows[0]]
    docs = spark.createDataFrame([(i, *r, 1, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, term string")
    read = lambda d, **k: sorted(map(tuple, divergence.audit(d, **k).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert read(docs) == plain_audit(rows, 30, 50)
    for name, small in (("TERMS", 3), ("COUNTS", 20), ("CELLS", 50), ("SOURCES", 4), ("BLOCK", 300), ("BROADCAST_GROUPS", 0)):
        monkeypatch.setattr(divergence, name, small)
    assert read(docs, least=5, ranks=4) == plain_audit(rows, 5, 4)
    assert read(docs.limit(0)) == []


def test_shares_of_large_counts():
    for c, n, v in ((6 * 10**12, 10**13, 10**8), (0, 0, 3), (7, 7, 1), (10**9, 9 * 10**15, 10)):
        got = divergence.shares(np.array([c]), np.array([n]), v)
        assert int(got[0]) == 1 + 10**9 * (c + 5) // (n + 5 * v)


def test_lm_scores_keep_ids(spark, monkeypatch):
    """Null ids and ids beyond 2^53 in one batch, repeated rows, clashing names, and ids that are no numbers."""
    ids = [None, 2**53 + 1, 2**53 + 3, -(2**62) - 1, None, 2**53 + 1, 7]
    texts = ["a b a", "a b c", "c c c d", "", None, "a b c", "e"]
    docs = spark.createDataFrame([(i, t, True, 3, b"x") for i, t in zip(ids, texts)], "doc_id long, text string, is_target boolean, part int, ids binary").coalesce(1)
    good = spark.createDataFrame([(2**53 + 1, 1), (None, 1), (7, 1)], "doc_id long, quality int")
    got = lmscore.score(docs, good).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in got) == sorted((i is None, i or 0, len((t or "").split())) for i, t in zip(ids, texts))
    plain = lmscore.score(docs.where("doc_id IS NOT NULL AND length(text) > 0"), good).collect()
    assert all(r["score"] is not None for r in plain) and all((r["score"] is None) == (r["n_tokens"] == 0) for r in got)
    named = {r["doc_id"]: r["score"] for r in lmscore.score(docs.withColumn("doc_id", F.concat(F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), good.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))).collect()}
    assert named["d7"] == {r["doc_id"]: r["score"] for r in got}[7]
    for batch, slots in ((20, 1), (lmscore.BATCH, 1), (20, lmscore.PACKED_SLOTS)):  # entries as rows of their own, and packed
        monkeypatch.setattr(lmscore, "BATCH", batch)
        monkeypatch.setattr(lmscore, "PACKED_SLOTS", slots)
        key = lambda r: repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r))
        assert sorted(map(key, lmscore.score(docs, good).collect())) == sorted(map(key, got))


# --- toxicity by plain matching and counting -------------------------------------------------------------------
def plain_readings(text):
    """A text character by character: accents off, look-alikes to one letter, signs at a word's end both ways."""
    alike = {c: to for to, cs in toxicity.ALIKE.items() for c in cs}
    low = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    whole = "".join(alike.get(c, c) for c in low)
    ends = [i for i, c in enumerate(low) if c in toxicity.SIGNS and not re.match(r"[@!|$]*\w", low[i:])]
    kept = "".join(low[i] if i in ends else c for i, c in enumerate(whole))
    return [whole, kept] if ends else [whole]


def plain_hits(text, lexicon, exceptions):
    found = set()
    for t in plain_readings(text):
        out = [(m.start(), m.end()) for x in exceptions for m in re.finditer(rf"\b{re.escape(x)}\b", t)]
        for w in lexicon:
            for m in re.finditer(rf"(?<!\w)(?={re.escape(w)}(?!\w))", t):
                if not any(a <= m.start() and m.start() + len(w) <= b for a, b in out):
                    found.add((m.start(), w))
    return [w for _, w in sorted(found)]


def test_toxicity_by_plain_matching(spark):
    """Lexicon, exceptions, hits and scores of the fitted model by counting words and matching one by one."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    extra = [(10**6 + k, t) for k, t in enumerate(["", "!!!", "id!ot idi0t", "a" * 5000, "ÏDÏOT|", "x$ y"])] + [(None, "nothing"), (10**6, "again")]
    model = toxicity.fit(docs, labels)
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    train = [(r["text"] or "", marks[r["doc_id"]]) for r in docs.collect() if r["doc_id"] in marks]
    n, a = Counter(), Counter()
    for t, y in train:
        words = {w for r in plain_readings(t) for w in re.findall(r"\w+", r)}
        n.update(words)
        a.update(words if y else ())
    size = (sum(y for _, y in train), len(train))
    odds = lambda x, m: math.log((x + 0.5) / (size[0] + 1)) - math.log((m - x + 0.5) / (size[1] - size[0] + 1))
    want = {w: odds(a[w], n[w]) for w in n if a[w] >= toxicity.MIN_DOCS and odds(a[w], n[w]) >= toxicity.MIN_ODDS}
    assert model["weights"].keys() == want.keys() and all(math.isclose(model["weights"][w], want[w]) for w in want) and want
    every = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = {}
    for r in toxicity.score(every, model).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    c = model["curve"]
    texts = {}
    for r in every.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    for i, own in texts.items():
        plain = []
        for t in own:
            total = sum(want[w] for w in plain_hits(t, want, model["exceptions"]))
            z = c[0] + c[1] * math.log1p(total) + c[2] * math.log1p(total / math.sqrt(1 + len(t) / 5))
            plain.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        assert sorted(r["score"] for r in rows[i]) == pytest.approx(sorted(plain), rel=1e-9)
        assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for r in rows[i])


# --- language ID by plain counting -------------------------------------------------------------------------------
def plain_vector(text):
    """Letter 1-, 2- and 3-grams of a text, one by one, hashed as the model has them."""
    low = (text or "").lower()
    if not any(c.isalpha() for c in low):
        return None
    c, mask = [32], (1 << 64) - 1
    for x in low:
        x = ord(x) if x.isalpha() else 32
        if x != 32 or c[-1] != 32 or len(c) == 1:
            c.append(x)
    c.append(32)
    k = [(x + 1) * 0x9E3779B97F4A7C15 & mask for x in c]
    two = [(a * 3 + (b >> 7)) & mask for a, b in zip(k, k[1:])]
    three = [(a * 0xC2B2AE3D27D4EB4F + (b >> 11)) & mask for a, b in zip(two, k[2:])]
    counts = Counter((g * 0x165667B19E3779F9 & mask) >> (64 - langid.BITS) for g in [*k, *two, *three])
    v = np.zeros(1 << langid.BITS)
    for h, n in counts.items():
        v[h] = math.sqrt(n)
    return v / math.sqrt(sum(counts.values()))


def test_languages_by_plain_counting(spark):
    """Predictions and scores of the fitted models by dense sums over plainly counted n-grams."""
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10**6, "", None), (10**6 + 1, "12 34 !", "en"), (10**6 + 2, None, "de"), (None, "der die das und nicht", None), (10**6 + 3, "é", None), (10**6 + 3, "é", None), (10**6 + 4, "  a  b\n\nc ", None)], "doc_id long, text string, lang string")
    every = docs.union(odd)
    model = langid.fit(every)
    sure = lambda m: 1 / (1 + math.exp(-4 * m))
    seen = 0
    for r in langid.predict(every, model).collect():
        v = plain_vector(r["text"])
        if v is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        margin = lambda w: float(v @ w[0].astype(float)) + w[1]  # noqa: B023, E731
        first = sorted(((margin(w), f) for w, f in zip(model["first"], model["families"])), reverse=True)
        family = first[0][1] if first else model["families"][0]
        score = sure((first[0][0] - first[1][0]) / 2) if first else 1.0
        votes = {x: 0.0 for x in model["members"][family]}
        p = {pair: sure(margin(w)) for pair, w in model["pairs"].items() if pair[0] in votes and pair[1] in votes}
        for (a, b), x in p.items():
            votes[a] += (x > 0.5) + x / len(votes)
            votes[b] += (x <= 0.5) + (1 - x) / len(votes)
        best = max(votes, key=votes.get)
        score = min([score, *(x if a == best else 1 - x for (a, b), x in p.items() if best in (a, b))])
        cosine, letters = float(v @ model["means"][best].astype(float)), sum(c.isalpha() for c in r["text"])
        least = next((model["least"][best, k] for k in range(letters.bit_length(), 0, -1) if (best, k) in model["least"]), 0.0)
        near = [x for _, x in sorted(votes.items(), key=lambda kv: -kv[1])]
        if cosine < least:
            score = min(score, 0.5 * cosine / least)
        if len(near) < 2 or near[0] - near[1] > 1e-3:
            assert r["lang_pred"] == best and r["score"] == pytest.approx(score, abs=1e-4)
            seen += 1
    assert seen > 150
    marks = {r["doc_id"]: r["held_out"] for r in langid.predict(every, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out")).collect()}
    assert marks[None] is False and all(m == (zlib.crc32(str(i).encode()) % 5 == 0) for i, m in marks.items() if i is not None)


def test_common_secrets_beyond_a_broadcast(spark, monkeypatch):
    key = "AKIA" + "Z" * 20
    rows = [(k, f"{key} password = own{k:04d}abcdefgh token: shared{k % 3}abcdefgh", f"s{k % 7}") for k in range(60)] + [(None, key, None), (3, key, "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(repr, secrets.scan(docs, hot=5).collect()))
    monkeypatch.setattr(secrets, "BROADCAST_HASHES", 0)
    assert sorted(map(repr, secrets.scan(docs, hot=5).collect())) == want == sorted(map(repr, secrets.scan(docs, hot=10**6).collect()))


def test_quality_versions_and_ablation(spark):
    """Policies applied and rules left out, on the ledger's bits alone; null ids and repeated rows."""
    rows = [(None, "few words"), (1, "a b c " * 40), (1, "a b c " * 40), (2, " ".join(f"word{k}" for k in range(60))), (3, " ".join(f"{k}" for k in range(10, 70))), (4, " ".join("x" * 30 + str(k) for k in range(60))), (None, None)]
    docs = spark.createDataFrame([(*r, 7, "p") for r in rows], "doc_id long, text string, fail_bits long, policy string")
    led = materialize(quality.ledger(docs), "ledger")
    got = sorted(((r["doc_id"] or 0, r["fail_bits"]) for r in led.collect()))
    assert [i for i, _ in got] == [0, 0, 1, 1, 2, 3, 4] and sum(b == 0 for _, b in got) == 2
    one, two = (quality.apply_policy(led, p) for p in (quality.V1, quality.V2))
    assert one.where("kept").count() == 2 and two.where("kept").count() == 3
    for r in quality.ablation(led, quality.V1).collect():
        without = quality.Policy("x", tuple(x for x in quality.RULE_NAMES if x != r["rule"]))
        assert quality.apply_policy(led, without).where("kept").count() == 2 + r["only_this"]
        assert led.where(quality.sole_rule(quality.V1) == r["rule"]).count() == r["only_this"]
