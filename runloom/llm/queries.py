"""Queries over the given tables that apply the operators with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.chat_format import format_conversations, read_back
from runloom.llm.conversation_repair import damaged, repair_report
from runloom.llm.decontaminate import decontaminate
from runloom.llm.lexical_search import lexical_search
from runloom.llm.license_scan import license_scan
from runloom.llm.line_dedup import dedup_lines
from runloom.llm.mixing import mix_documents
from runloom.llm.ngram_jaccard import ngram_jaccard_components
from runloom.llm.oracle import ORACLE_SQL
from runloom.llm.packing import pack_documents
from runloom.llm.quality_classifier import classify_quality
from runloom.llm.quality_rules import quality_rules
from runloom.llm.sharding import shard_documents
from runloom.llm.tables import documents
from runloom.llm.warc import read_warc, write_warc


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and number -7, whose two texts are made of control strings."""
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    control = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(control)
    return read_back(format_conversations(rows))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), near=True)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(documents(spark, sf_dir), n=4, num=85, den=100)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_sentences", F.size("matches").cast("long").alias("n_matches"), F.array_join("licenses", ",").alias("licenses"), F.array_join("unmatched", ",").alias("unmatched"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_kept", F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("class_distance", "word_distance")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_warc(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(documents(spark, sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_report(damaged(rows), rows)


QUERIES = {
    f.__name__: f
    for f in (op1_chat_format, op2_decontaminate, op3_ngram_jaccard, op4_quality_classifier, op5_license_scan, op6_line_dedup, op7_quality_rules, op8_sharding, op9_warc, op10_mixing, op11_lexical_search, op12_packing, op13_conversation_repair)
}

__all__ = ["ORACLE_SQL", "QUERIES"]
