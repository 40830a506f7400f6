"""The driver's tables in the shape of the retrieval model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import table


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as chunks: the source is the vault, the language the room, the first line the heading."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("c"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("chunk_id"),
        "doc_id",
        F.col("source").alias("vault_id"),
        F.col("lang").alias("room"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.array(F.split_part("text", F.lit("\n"), F.lit(1))).alias("heading_path"),
        F.array("lang").alias("tags"),
        F.col("text").alias("content"),
    )


def document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest-like row for each document, with its labels as typed properties."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(labels, "doc_id", "left").select(
        F.concat(F.lit("s"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("source_key"),
        "doc_id",
        F.col("source").alias("vault_id"),
        F.col("lang").alias("room"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.lit("text").alias("format"),
        F.when(F.col("n_chars") > 4000, "partial").otherwise("complete").alias("coverage"),
        F.octet_length("text").cast("long").alias("byte_length"),
        F.sha2("text", 256).alias("content_hash"),
        F.ceil(F.greatest(F.col("n_chars"), F.lit(1)) / 4000).cast("long").alias("chunk_count"),
        (F.lit(1_700_000_000) - F.col("doc_id") * 3600).cast("long").alias("mtime"),
        "quality",
        "toxic",
    )
