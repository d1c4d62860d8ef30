"""A training corpus from documents: toxic documents go, repeated lines go, one of each near-duplicate group stays, sources are mixed, tokens are packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import stage_table
from quillspark.llm.linededup import dedup_lines
from quillspark.llm.mixing import mix_sources
from quillspark.llm.nearcopies import drop_near_copies
from quillspark.llm.packing import pack_documents
from quillspark.llm.toxicity import score_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chained probability of being toxic reaches the threshold go."""
    return score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("not is_toxic").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, from end to end, from all documents but the first; n_chars follows the text."""
    out = dedup_lines(docs, whole=True).drop("n_removed")
    return (out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of their five-word shingles of 0.8 or more, one stays."""
    return drop_near_copies(docs, shingle_words=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix_sources(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its token ids and its place in a sequence."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: None: neither trained models nor fingerprints can be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
