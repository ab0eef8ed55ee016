"""The corpus pipeline: five stages over documents, each written and read again.

Belongs to subpackage llm. Language ID, near copies, benchmark decontamination,
mixing to target weights, token store.

Every stage but the last returns the columns of its input, whatever they are called. Defined
results: a null or letterless text is rejected by the first stage, whatever its id; a null id is
an id like another; repeated rows (equal id and text) are one document to the second stage, which keeps
one of them, and documents of their own elsewhere, kept, dropped or mixed alike; an empty table
gives an empty store.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binforge.llm import decontaminate, langid, mixing, ngramjoin, tokenstore
from binforge.llm.common import free_name, materialize, shared_dir, table

#: A prediction less sure than this is rejected, as is a text without a letter. The models' votes alone
#: give no less; a text that is too unlike the language it got does (see langid).
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language stay."""
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    got = langid.predict(docs, langid.fit(docs), lang, score)
    return got.where((F.col(lang) != "und") & (F.col(score) >= SURE)).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that of the smallest id. Wordless texts are no copies of each other."""
    key = free_name(docs, "row_key")
    kept = ngramjoin.representatives(docs).withColumnRenamed("key", key)
    one = docs.withColumn(key, ngramjoin.row_key()).dropDuplicates([key])
    return one.join(kept, key, "left_semi").select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a passage of benchmark stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A store of the texts' ids, and what its files say of each document."""
    return tokenstore.verify(spark, tokenstore.write(docs, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"))


STAGES = [("language_id", language), ("ngram_join", near_copies), ("decontaminate", decontaminated), ("mix_sources", mixed), ("token_store", tokens)]

#: Trained models and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
