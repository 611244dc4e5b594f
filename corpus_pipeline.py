"""The corpus pipeline: toxicity, exact and near deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  The driver writes a stage's rows as Parquet and
reads them again as the next one's docs; run() chains the stages lazily, apart
from the checkpoints that they take themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.common import durable, table
from auditlake.llm.decontam import decontaminate
from auditlake.llm.exact import exact_dedup
from auditlake.llm.packing import pack_documents
from auditlake.llm.simhash import near_dedup
from auditlake.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: Compression distances, fingerprints and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = durable(docs)
    return docs
