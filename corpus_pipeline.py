"""Corpus pipeline: language ID, near duplicates, repeated passages, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns
the columns of ``documents``; the last returns the mixture (doc_id, domain, lang, source,
tokens, copies), rows that are taken at least once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, jaccard, language, mixing, suffix
from barloom.llm.common import saved, ship, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; a missing language is filled in.

    Null texts and texts without a letter are rejected; repeated rows and rows without an id are judged
    like any other; of an empty table nothing is left; columns beyond those of documents are dropped.
    """
    docs = docs.select(*COLUMNS)
    ship(spark)
    said = language.identify(docs, language.fit(docs)).where(~F.col("rejected"))
    return said.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: the one of the least doc_id, null ids last.

    Of rows that are alike in all columns one stays; rows that share a doc_id but not a text are told
    apart. Texts without words, nulls among them, link with nothing and stay.
    """
    ship(spark)
    return jaccard.keep_one(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 400-byte strings and repeated passages of over 50 words are taken out of the texts; every document stays, if only empty.

    Both are judged on the texts as they come in; what stays keeps its white space. A null text stays null, with a null n_chars; rows of equal texts, whatever their ids, lose what is long enough.
    """
    ship(spark)
    return suffix.cut_texts(docs.select(*COLUMNS), suffix.BYTES, suffix.PASSAGE).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; null and empty texts hold none and stay, repeated rows alike."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the target weights take, with the number of times; ties in the draw go to the shorter text."""
    return mixing.mix(docs.select(*COLUMNS)).where("copies > 0")


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", mixture),
]

#: Classifier, components and suffix sorting can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
