"""The corpus pipeline: five stages from raw documents to a weighted mix.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept; all but the last return the columns of ``docs``. :func:`run` writes each
stage's result to the shared folder and rereads it, so a stage is computed once
and a lost executor costs no more than its running tasks.

Defined cases are those of the operators: an empty table passes through empty,
null texts count as empty, repeated rows are separate documents until the
second stage keeps one of each group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trawlkit.llm.common import saved, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of undetermined language; ``lang`` becomes the predicted one."""
    from trawlkit.llm.langid import keep_known

    return keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest ``doc_id``, of each component of similar texts."""
    from trawlkit.llm.similar import keep_one

    return keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    from trawlkit.llm.decontaminate import decontaminate

    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; ``n_chars`` follows the new text."""
    from trawlkit.llm.pii import redacted

    return redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the weighted mix takes of each document that is left."""
    from trawlkit.llm.mixing import mix_report

    return mix_report(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("leaks", leaks), ("personal_data", personal_data), ("mix", mix)]
#: SQL expresses neither the trained classifiers nor XXH64 fingerprints; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
