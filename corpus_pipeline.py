"""Training-corpus pipeline: toxic documents go, near duplicates and leaks go, secrets are masked, the rest is packed.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is
written as Parquet and read again as the next stage's ``docs``. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizcontacts.llm.common import Scratch, held_out, table
from bizcontacts.llm.decontaminate import find_leaks
from bizcontacts.llm.jaccard_join import jaccard_components
from bizcontacts.llm.packing import document_items, pack_documents
from bizcontacts.llm.secret_scan import labelled_findings, redact_secrets, train_forest
from bizcontacts.llm.toxicity import score_toxicity, toxicity_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is predicted go; the model learns from the labels of the documents at hand.

    Null and empty texts stay.
    """
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id"))
    scored = score_toxicity(docs.select(*COLUMNS), toxicity_model(docs, labels), carry=COLUMNS[1:])
    return scored.filter("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: that of the smallest id, all its rows included.

    Documents without words, and rows without id, are in no group and stay.
    """
    parts = jaccard_components(docs, Scratch(spark, "pipeline_join"))
    gone = parts.filter("component_id <> doc_id").select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    found = find_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), carry=COLUMNS[1:])
    return found.filter("not contaminated").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts give way to a mark, and n_chars follows."""
    clean = redact_secrets(docs.select(*COLUMNS), train_forest(labelled_findings(spark)))
    changed = F.when(F.contains("text", F.lit("[SECRET]")), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in bins."""
    return pack_documents(document_items(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]
# Trained models and the bin search are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
