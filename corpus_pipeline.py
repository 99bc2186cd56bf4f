"""The corpus pipeline: five stages over the documents, each written as Parquet and read again by the next.

STAGES lists (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of docs. run() applies them to the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolweave.llm import decontaminate, language, mixing, ngram_join, substring_dedup
from toolweave.llm.common import drop_rows, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language can't be told."""
    gone = written(language.identify(docs).where(~F.col("kept")).select("doc", "print").distinct(), "rejected")
    return drop_rows(docs, gone, "doc_id", "text")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by 0.8 of their five-word shingles."""
    return ngram_join.keep_one(docs, words=5, percent=80)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the words that an earlier document holds in a 13-word window; white space elsewhere stays, as do emptied rows."""
    cut = substring_dedup.remove_repeats(docs, layout=True)
    new = {"text": F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("kept_text")), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which a twentieth or more of the words lie in benchmark windows."""
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus in training order: a row for each time a document is taken, with its position, the words and the text."""
    return mixing.in_order(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("substring_dedup", substring),
    ("decontamination", benchmark_decontamination),
    ("mixing", source_mix),
]

#: SQL can't express the trained language model of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
