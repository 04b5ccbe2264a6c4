"""A training corpus from documents: what is kept of each stage is a table that the next one reads.

1. quality: documents that the classifier rejects go.
2. near_duplicates: one document of each group of linked ones stays, the one with the smallest id.
3. substrings: words in passages that occur more than once are cut out.
4. decontamination: spans that hold a benchmark window are cut out.
5. tokens: texts are encoded, decoded and compared.

Texts that a stage finds nothing in stay as they are, and stages 3 and 4 keep every document, also one that becomes empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripchain.llm import bpe, decontaminate, jaccard, quality, substrings
from tripchain.llm.common import Scratch, free_name, table

VOCABULARY = "byte_bpe_50k.json"


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    name = free_name(docs, "_score")
    scored = quality.score(docs, quality.fit(docs, labels), name=name)
    return scored.where(F.col(name) >= 0.3).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, exact); exact says that decoding gave the text again."""
    path = public_tokenizers.path(VOCABULARY)
    both = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), path)
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [("quality", good), ("near_duplicates", near_duplicates), ("substrings", repeated_passages),
          ("decontamination", decontaminated), ("tokens", tokens)]

#: SQL expresses neither the classifier nor the encoding; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        written = Scratch(spark)
        try:
            docs = written.keep(stage(spark, docs, sf_dir), f"stage-{name}")
        finally:
            read.drop()  # what the stage has read
        read = written
    return docs
