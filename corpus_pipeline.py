"""The corpus pipeline: documents in, packed windows out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. ``run`` writes what each stage returns as Parquet in the shared folder and reads it
back for the next, so a lost executor costs one stage's tasks and no stage is computed twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import jaccard, line_dedup, packing, pii, quality
from newsloom.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _shaped(docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars counts the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably bad, by the votes of the rules, go; so do null texts."""
    return quality.keep_good(docs).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go; a document of which nothing is left goes as well."""
    left = line_dedup.dedup(docs)
    return _shaped(left.filter(F.length(F.trim("text")) > 0))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return jaccard.drop_near_duplicates(docs).select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by surrogates."""
    return _shaped(pii.anonymise(docs, pii.session_key(spark)))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of training tokens as spans of the documents."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("personal data", replace_personal_data),
    ("packing", pack_windows),
]

#: Weak supervision and dynamic programming are not for SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs, f"stage{number}")
    return docs
