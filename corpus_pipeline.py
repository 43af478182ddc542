"""A training corpus from documents: good ones, one of each group of near copies, without personal data, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import near, packing, pii_crf, quality
from cairn.llm.common import cut, importable, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the weak-label classifier, fitted on all of them, keeps.

    A null text counts as an empty one; equal rows are judged alike; an empty table stays empty.
    """
    importable(spark)
    return quality.keep_good(docs, quality.fit(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id; see near.one_of_each."""
    importable(spark)
    return near.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked.

    Every row stays, also those without a text or an id, and every other column as it was.
    """
    importable(spark)
    return pii_crf.mask(docs, pii_crf.fit(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences.

    A null or empty text is one piece, its end token; each of several equal rows has pieces of its own.
    """
    importable(spark)
    return packing.pack_documents(docs, size=1024)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("PII", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: The classifier and the field are trained and tokens come from a tokenizer: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; what one stage keeps is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
