"""A corpus pipeline of five stages; each reads what the one before it wrote.

All stages read whole tables with the columns doc_id, text and, for the last, lang; n_chars is counted anew where it is
there and a text changes. Other columns, whatever their names, pass through, and all stages but the last return the
columns that they got; the last adds mix_rate and mix_copies, or replaces them. An empty table stays empty with its
columns. Rows that are equal in all that a stage reads are treated alike, but for near_dedup, which keeps one of them.
"""

from __future__ import annotations

import uuid

from deltaspan.llm import decontaminate, mixing, near_duplicates, pii, quality
from deltaspan.llm.common import shared_folder, table
from pyspark.sql import DataFrame, SparkSession


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null, empty and short texts do, by the base rule; a posterior of 0.5 stays. Very long texts are read whole."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the least doc_id, any one of rows with the same id and text.

    Each null or empty text is a class of its own by its doc_id; those without an id are one.
    """
    return near_duplicates.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, 0.8 of its shingles or more, go; null and empty texts hold none."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; every row stays, a null text stays null."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the rate at which the mixture takes them; languages are the domains.

    Every row stays. Rows without a language aren't learnt from and get the rate of their text's posterior; without any
    language all rates are 1.
    """
    return mixing.mix(docs, docs, "lang")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("mixing", mixture),
]

#: Posteriors, classes of near-duplicates and fitted rates aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what lies between them is written to the folder in spark.checkpoint.dir.

    What a stage has written goes once the next one is written; that of the last but one stays, as the result reads it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    shared = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        path = f"{shared}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            _delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
