"""Judged relevance: metrics of ranked lists against graded judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(hits: DataFrame, judgments: DataFrame) -> DataFrame:
    """Per query: success@1, reciprocal rank of the first grade 3, recall@10 and @100, hard negatives in the top 10.

    ``hits``: query_id, rank, source, chunk_id; ``judgments``: query_id, source, grade, hard_negative.
    """
    j = judgments.select("query_id", "source", "grade", "hard_negative")
    rows = hits.join(j, ["query_id", "source"], "left")
    good = F.coalesce(F.col("grade"), F.lit(0)) >= 1
    per = rows.groupBy("query_id").agg(
        F.max(F.when((F.col("rank") == 1) & (F.col("grade") == 3), 1).otherwise(0)).alias("success_at_1"),
        F.min(F.when(F.col("grade") == 3, F.col("rank"))).alias("first3"),
        F.countDistinct(F.when(good & (F.col("rank") <= 10), F.col("source"))).alias("found10"),
        F.countDistinct(F.when(good & (F.col("rank") <= 100), F.col("source"))).alias("found100"),
        F.count_if((F.col("rank") <= 10) & F.coalesce("hard_negative", F.lit(False))).alias("hard_negatives_top_10"),
        F.countDistinct(F.when(F.col("rank") <= 10, F.col("source"))).alias("distinct_sources_top_10"),
        F.count("*").alias("total_hits"),
    )
    most = rows.where("rank <= 10").groupBy("query_id", "source").count().groupBy("query_id").agg(F.max("count").alias("max_chunks_per_source_top_10"))
    relevant = j.where("grade >= 1").groupBy("query_id").agg(F.countDistinct("source").alias("relevant"))
    out = relevant.join(per, "query_id", "left").join(most, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "query_id",
        zero("success_at_1").cast("int").alias("success_at_1"),
        F.round(F.coalesce(1 / F.col("first3"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(zero("found10") / F.col("relevant"), 6).alias("recall_at_10"),
        F.round(zero("found100") / F.col("relevant"), 6).alias("recall_at_100"),
        zero("hard_negatives_top_10").cast("long").alias("hard_negatives_top_10"),
        zero("distinct_sources_top_10").cast("long").alias("distinct_sources_top_10"),
        zero("max_chunks_per_source_top_10").cast("long").alias("max_chunks_per_source_top_10"),
        zero("total_hits").cast("long").alias("total_hits"),
    )


def latency_percentile(times: DataFrame, column: str, share: float = 0.95) -> DataFrame:
    return times.agg(F.percentile(column, share).alias(f"p{round(share * 100)}"))
