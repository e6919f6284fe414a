"""The corpus pipeline: language ID, near-dedup, decontamination, secret redaction, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import decontaminate, langid, mixing, secrets, simhash
from claimloom.plans.durable import cut
from claimloom.sources.tables import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; undetermined and ambiguous ones go.

    Null, empty and letterless texts are undetermined. Repeated rows share
    their fate. Without any labelled text there is nothing to learn from, and
    all stay. An empty table stays empty; columns may have any names.
    """
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar documents (5-word shingles, Jaccard 0.8 or more).

    Null and wordless texts are copies of each other, so one of them stays;
    so does one of repeated rows. Null ids never name a group that has an id.
    An empty table stays empty; columns may have any names.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and wordless texts contain nothing and stay, as do repeated rows; null
    and wordless items are in nothing. An empty table stays empty, an empty
    `benchmark` leaves all. Columns may have any names.
    """
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind.

    Null texts stay null, repeated rows stay, an empty table stays empty.
    n_chars follows the text where it is an integer; columns may have any names.
    """
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes, in training order, with the words taken and the position.

    Null and wordless texts have no word to take and go; a null source is one
    of its own, the last. Repeated rows share their places and all stay. An
    empty table stays empty; columns named like new ones are replaced.
    """
    return mixing.mixed_copies(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_redaction", secret_redaction),
    ("source_mixing", source_mixing),
]

#: SQL can express neither the trained classifier nor components of similarity links.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
