"""Batch reports and timing statistics; all are partial + final aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def batch_report(results: DataFrame, error: str = "error") -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(error).isNull()).alias("successful"),
        F.count_if(F.col(error).isNotNull()).alias("failed"),
    )


def corpus_totals(results: DataFrame) -> DataFrame:
    """results: total_words and total_images per document."""
    zero = F.lit(0).cast("bigint")
    return results.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("total_words"), zero).alias("words"),
        F.coalesce(F.sum("total_images"), zero).alias("images"),
    )


def _stats() -> list:
    return [
        F.count(F.lit(1)).alias("count"), F.sum("duration").alias("total"), F.avg("duration").alias("avg"),
        F.min("duration").alias("min"), F.max("duration").alias("max"),
    ]


def perf_stats(perf: DataFrame, operation: str) -> DataFrame:
    """Statistics of one operation; a single row with count 0 when it never ran."""
    return perf.where(F.col("operation") == operation).agg(*_stats()).select(
        F.lit(operation).alias("operation"), "count", "total", "avg", "min", "max")


def perf_stats_all(perf: DataFrame) -> DataFrame:
    return perf.groupBy("operation").agg(*_stats())
