"""A training corpus from raw documents: toxic documents, recurring lines, near duplicates and leaked benchmark items go, then sources are mixed.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and is written as Parquet before the next
one reads it. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from attest.llm.common import shared_dir, table
from attest.llm.decontamination import drop_leaks
from attest.llm.line_templates import drop_recurring_lines
from attest.llm.mixing import mix_sources, readings
from attest.llm.simhash import drop_near_copies
from attest.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, learned from labels, is below 0.3; all where there are no labels of both kinds. Null and empty texts are scored as well."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that other documents had before; a null text stays null, and n_chars is what it was."""
    return drop_recurring_lines(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies: texts whose five-word shingles are to 0.8 or more the same."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, as it is or in other words; all where the benchmark is empty."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that a document is read in training (reading 0 or 1), with its text, the words read of it and its place in training (at), sorted by that."""
    kept = [c for c in docs.columns if c not in ("doc_id", "source")]
    return readings(mix_sources(docs, keep=kept, ordered=False))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: Learned scores, fingerprints and latent retrieval have no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; the result is in training order.

    It is sorted after it is read, since Spark packs the pieces of files into tasks by size and not by name.
    """
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs.orderBy("at", "doc_id", "reading")
