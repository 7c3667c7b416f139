"""The training-corpus pipeline: each stage works on all that the stage before kept.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next one's ``docs``. All but the last return the columns of ``documents``, and any others that ``docs`` has.

Edge cases of all stages: a null text counts as empty; language ID drops it, and so do texts without a letter; the other filters keep it,
and packing gives it a sequence of its end id. Texts of any length are read whole. Rows that repeat, with or without an id,
are near copies of each other, and one stays; texts that tie go by the order of the rows. An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import INNER, saved, table
from ledgerloom.llm.decontaminate import remove_leaks
from ledgerloom.llm.language_id import keep_identified, learned
from ledgerloom.llm.minhash import near_duplicates
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.secret_scan import redact


ROW = INNER + "row"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: those without a letter, and those with a narrow margin."""
    return keep_identified(docs, learned(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, the first.

    Rows are told apart by a number, not by ``doc_id``: rows that share an id are judged by their texts, and of equal rows one stays.
    The numbers are written with the rows, so that all later steps see the same ones.
    """
    numbered = saved(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered-rows")
    gone = near_duplicates(numbered.select(F.col(ROW).alias("doc_id"), "text"), words_each=5, percent=80).where("not kept").select(F.col("doc_id").alias(ROW))
    return numbered.join(gone, ROW, "left_anti").select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; ``n_chars`` follows the text."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in clean.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: Compression, fingerprints and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
