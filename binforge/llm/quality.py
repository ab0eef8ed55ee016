"""Quality rules: every rule is evaluated once into a ledger of failure bits.

The ledger holds one row per document: its measurements and a bitmask with bit k
set where rule k fails. A policy is a version and a mask of rules; applying it, or
asking what would change without one rule, is integer arithmetic on the ledger and
never looks at a text again.

Defined results: null or empty text measures 0 everywhere and fails ``few_words``;
repeated rows give a row each; null ids are ids like others; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, words

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _rules() -> list[tuple[str, Column]]:
    c = F.col
    return [
        ("few_words", c("n_words") < 50),
        ("repeated_windows", 100 * c("n_repeat_words") > 50 * c("n_words")),
        ("symbols", 100 * c("n_symbols") > 10 * c("n_words")),
        ("repeated_lines", 100 * c("n_dup_lines") > 30 * c("n_lines")),
        ("short_words", c("word_chars") < 2 * c("n_words")),
        ("long_words", c("word_chars") > 20 * c("n_words")),
    ]


RULE_NAMES = ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...] = RULE_NAMES

    @property
    def mask(self) -> int:
        return sum(1 << RULE_NAMES.index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
V1 = Policy("v1")
#: Without the rules on the lengths of words, which drop tables and code.
V2 = Policy("v2", ("few_words", "repeated_windows", "symbols", "repeated_lines"))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and MEASURES, of whole texts, inside each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(
        "doc_id",
        words(F.col("text")).alias("w"),
        F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0).alias("lines"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    n = F.size("w")
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    # a window is known by 64 bits of its words, compared within one document only
    d = d.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.transform(at, lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))).alias("h"),
    )
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs)).drop("h")

    def twice(x: Column, k: Column) -> Column:
        near = [F.get("s", k - 1)["h"], F.get("s", k + 1)["h"]]
        return F.coalesce(near[0] == x["h"], F.lit(False)) | F.coalesce(near[1] == x["h"], F.lit(False))

    d = d.withColumn("p", F.sort_array(F.transform(F.filter("s", twice), lambda x: x["i"]))).drop("s")
    new = F.transform("p", lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get("p", k - 1))).cast("long"))
    covered = F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).select("doc_id", *MEASURES)


def ledger(docs: DataFrame) -> DataFrame:
    bits = sum((F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, failed) in enumerate(_rules())), F.lit(0))
    return measure(docs).withColumn("fail_bits", bits.cast("long"))


def apply_policy(led: DataFrame, policy: Policy) -> DataFrame:
    return led.withColumn("policy", F.lit(policy.version)).withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(led: DataFrame, policy: Policy) -> DataFrame:
    """A row per rule of the policy: how many fail it, and how many only it drops."""
    held = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    sums = []
    for r in policy.rules:
        bit = 1 << RULE_NAMES.index(r)
        sums.append(F.struct(F.lit(r).alias("rule"), F.count_if(held.bitwiseAND(F.lit(bit)) != 0).alias("fails"), F.count_if(held == bit).alias("only_this")))
    return led.agg(F.array(*sums).alias("x")).select(F.inline("x"))


def sole_rule(policy: Policy) -> Column:
    """The rule that alone drops a document; null where none or several do."""
    held = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    return F.coalesce(*(F.when(held == 1 << RULE_NAMES.index(r), F.lit(r)) for r in policy.rules))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = materialize(ledger(table(spark, sf_dir, "documents")), "quality-ledger")
    failed = F.col("fail_bits").bitwiseAND(F.lit(BASE.mask)) != 0
    both = apply_policy(apply_policy(led, V2).withColumnRenamed("kept", "kept_v2"), V1).withColumn("sole_rule", sole_rule(V1))
    drops = ablation(led, V1).select(F.col("rule").alias("sole_rule"), F.col("only_this").alias("sole_rule_drops"))  # a row a rule
    got = both.join(F.broadcast(drops), "sole_rule", "left")
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits", "policy", "kept_v2", "sole_rule", F.coalesce("sole_rule_drops", F.lit(0)).alias("sole_rule_drops"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM w, unnest(range(1, len(w) - 1)) AS r(i)),
two AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM two, range(0, 3) AS s(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100*n_repeat_words > 50*n_words THEN 2 ELSE 0 END
        + CASE WHEN 100*n_symbols > 10*n_words THEN 4 ELSE 0 END + CASE WHEN 100*n_dup_lines > 30*n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2*n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20*n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits, 'v1' AS policy, (fail_bits & 15) = 0 AS kept_v2,
       CASE fail_bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbols' WHEN 8 THEN 'repeated_lines' WHEN 16 THEN 'short_words' WHEN 32 THEN 'long_words' END AS sole_rule,
       CASE WHEN bit_count(fail_bits) = 1 THEN count(*) OVER (PARTITION BY fail_bits) ELSE 0 END::BIGINT AS sole_rule_drops FROM b
"""
