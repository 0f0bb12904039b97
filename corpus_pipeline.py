"""The corpus pipeline: STAGES over the documents, each written and reread.

Quality rules drop documents, near-dedup keeps one of each group, substring
dedup cuts passages that a document with a smaller id has, decontamination drops
documents with a benchmark passage, and BPE gives the token counts and digests
of what is left.  Every stage works on all that its predecessor kept; all but
the last return the columns of documents, further ones too.  What a stage stores
on its way goes when its own table is written.

Rows: a null text has no words, so quality rules drop it; a null doc_id counts as
the largest, and of a group of near-duplicates the row with the least doc_id
stays, of rows that repeat one doc_id with other texts the one of the least hash;
repeated rows are one group, of which one row stays; texts of any length are read
whole; a text may end up empty; an empty table gives an empty table; columns that
clash with names used inside keep their values.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import bpe, decontaminate, quality, simhash, substring_dedup
from attesta.llm.common import of_one_step, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts may end up empty; n_chars follows the text."""
    cut = substring_dedup.removed(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", passage_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

#: The fingerprints' XXH64 and the learned rules can't be said in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with of_one_step():
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"), stays=True)
    return STAGES[-1][1](spark, docs, sf_dir)
