"""Queries of the ten operators over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizcontacts.llm.chat_format import TIE, chat_digest, conversation_events, render_chats
from bizcontacts.llm.common import Scratch, held_out, table
from bizcontacts.llm.conversation_repair import conversation_edits, damage_turns, repair_digest
from bizcontacts.llm.decontaminate import find_leaks
from bizcontacts.llm.jaccard_join import jaccard_components
from bizcontacts.llm.language_id import identify_languages
from bizcontacts.llm.merkle import folded_root, merkle_manifest, proof_digest, tampered_leaf
from bizcontacts.llm.near_vectors import near_vectors
from bizcontacts.llm.packing import document_items, pack_documents
from bizcontacts.llm.secret_scan import labelled_findings, secret_report, train_forest
from bizcontacts.llm.token_counts import token_counts
from bizcontacts.llm.token_files import read_token_files, write_token_files
from bizcontacts.llm.toxicity import score_toxicity, toxicity_model
from bizcontacts.llm.vector_packing import pack_examples

# The conversation whose texts look like the template's own marks.
MARKED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id"))
    model = toxicity_model(docs, labels)
    return score_toxicity(docs.withColumn("held_out", held_out("doc_id")), model, carry=("held_out",))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"), train_forest(labelled_findings(spark)))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), Scratch(spark, "op4"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), Scratch(spark, "op6"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "op7").root
    write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(document_items(table(spark, sf_dir, "documents")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame(MARKED, "conv_id long, turn long, role string, text string")
    rendered = render_chats(conversation_events(turns.unionByName(marked)), TIE)
    return chat_digest(Scratch(spark, "op9").save(rendered, "rendered"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id"))
    train = docs.filter(~F.col("held_out")).select("lang", "text")
    return identify_languages(docs, train, carry=("held_out",))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    sealed = merkle_manifest(table(spark, sf_dir, "documents"), Scratch(spark, "op11"), carry={"found": tampered_leaf()})
    folded = sealed.withColumn("folded_root", folded_root(F.coalesce("found", "leaf")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair_digest(conversation_edits(damage_turns(turns), Scratch(spark, "op12")), turns)


def op13_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_examples(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "segment", "loss_tokens")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_token_counts, op2_toxicity, op3_secret_scan, op4_near_vectors, op5_decontamination, op6_jaccard_join,
        op7_token_files, op8_packing, op9_chat_format, op10_language_id, op11_merkle_manifest,
        op12_conversation_repair, op13_vector_packing)}
