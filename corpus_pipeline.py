"""The corpus pipeline: five stages from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Stages work on all that their predecessor kept.

Edge cases, for every stage: nulls in any column are kept as they are (a null text counts as empty, but stays
null); texts are taken whole, however long; rows that repeat a doc_id and text are one document to the stages that
compare documents, and different texts under one doc_id, or without one, are different documents; an empty
table gives an empty table of the same columns; extra columns pass through, whatever their names, but for the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, jaccard, packing, pii, toxicity
from tessera.llm.common import discard, table, written


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts; empty texts and repeated rows are scored like any others."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group linked by 5-word shingle similarity of 0.8 or more.

    Ties of the doc_id go to the least text digest, null doc_ids come last; texts without words are linked with
    nothing, and those without a doc_id all stay.
    """
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; another text under a contaminated document's doc_id stays."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows. Texts without any stay as they are, null included."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a null or empty text is just the end token."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: SQL cannot express the classifier, the bootstrapped patterns or the plan of packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
