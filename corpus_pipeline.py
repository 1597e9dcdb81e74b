"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of documents. Defined cases: null
texts count as empty, so the quality rules reject them; repeated rows are one
document to the stages that remove copies and to the mix, which gives it what
it takes of all of them, and separate ones to the others; a null doc_id stays
null; extra columns pass through; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keepsight.llm import stages
from keepsight.llm.packing import pack_documents
from keepsight.llm.tables import Table, keep, scope, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.pass_quality(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mixing), ("best_fit_packing", packing)]

#: Tokenising and packing are beyond SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another; what a stage wrote on its way is deleted once its documents are written."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scope():
            found = Table(stage(spark, docs, sf_dir), f"stage-{name}")
            keep(found)
        if read:
            read.drop()
        docs, read = found.read(), found
    return STAGES[-1][1](spark, docs, sf_dir)
