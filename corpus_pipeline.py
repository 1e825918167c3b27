"""From raw documents to packed training sequences: each stage is one operator of granary.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import decontaminate, jaccard_join, line_dedup, packing, quality, queries
from granary.llm._store import stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; the others go.

    Null and empty texts weigh 1 and stay. Rows equal in doc_id and text are
    drawn or left together. Without labels every document stays. An empty table gives none.
    """
    return quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that nearly repeat an earlier one.

    Null and empty texts and rows with a null doc_id stay as they are. Rows equal
    in doc_id and text count as one document and lose the same lines. A document
    of which only blank lines are left goes. An empty table gives none.
    """
    return line_dedup.drop_repeated_lines(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the smallest doc_id.

    Null and empty texts and rows with a null doc_id stay. Rows that repeat a
    doc_id stay or go together. An empty table gives none.
    """
    return jaccard_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts and rows with a null doc_id stay. Of rows that repeat a
    doc_id all go if one holds a passage. An empty table gives none, an empty benchmark leaves all.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the documents that are left lies in a sequence.

    Null and empty texts are a document of the end token alone; every row is
    packed, repeated or not. An empty table gives none.
    """
    return packing.pack(docs, queries.vocabulary_path(), **queries.PACKING)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram jaccard join", jaccard_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express models, sketches and packing; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each stage's rows are written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"stage{k}")
    return docs
