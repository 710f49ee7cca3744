"""Converter routes: (file_type, strategy) -> converter.

Routes are data. They are joined without a broadcast hint, so the planner
broadcasts them only after seeing that they are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave import rules
from folioweave.session import values_table


def built_in_routes(spark: SparkSession) -> DataFrame:
    """Routes of the built-in converters, one per routable type and usable strategy."""
    rows = []
    for kind in sorted(set(rules.ROUTABLE_EXTENSION_TYPES.values())):
        rows += [(kind, s, "general") for s in ("markitdown", "fast", "auto")]
    rows += [("pdf", "ocr", "ocr")]
    rows += [(kind, "default", kind) for kind in ("html", "docx", "xlsx")]
    return values_table(spark, rows, ["file_type", "strategy", "converter"])


def strategies_per_type(routes: DataFrame) -> DataFrame:
    """Sorted strategies of each type; sets stay small because strategies are an enum."""
    return routes.groupBy("file_type").agg(F.array_sort(F.collect_set("strategy")).alias("strategies"))


def route(df: DataFrame, routes: DataFrame) -> DataFrame:
    """Adds converter and route_error: exact match, else the type's default (not for PDF)."""
    exact = routes.select("file_type", "strategy", F.col("converter").alias("_exact"))
    default = routes.where("strategy = 'default' and file_type <> 'pdf'").select(
        "file_type", F.col("converter").alias("_default"))
    known = strategies_per_type(routes).select("file_type", F.array_join("strategies", ", ").alias("_known"))
    joined = (
        df.join(exact, ["file_type", "strategy"], "left")
        .join(default, "file_type", "left")
        .join(known, "file_type", "left")
    )
    kind = F.upper(F.coalesce("file_type", F.lit("unknown")))
    converter = F.coalesce("_exact", "_default")
    message = F.concat(
        F.lit("No converter available for "), kind, F.lit(" with strategy '"), F.col("strategy"),
        F.lit("'. Available strategies for "), kind, F.lit(": ["), F.coalesce("_known", F.lit("")), F.lit("]"),
    )
    return (
        joined.withColumn("converter", converter)
        .withColumn("route_error", F.when(converter.isNull(), message))
        .drop("_exact", "_default", "_known")
    )


def capability_matrix(routes: DataFrame, strategies: list[str]) -> DataFrame:
    """One row per type, one boolean column per strategy."""
    pivoted = routes.groupBy("file_type").pivot("strategy", strategies).agg(F.count(F.lit(1)))
    return pivoted.select(
        "file_type", *[(F.coalesce(F.col(f"`{s}`"), F.lit(0)) > 0).alias(s) for s in strategies])


def format_gaps(detected: DataFrame, routes: DataFrame) -> DataFrame:
    """Types that can be detected but have no route."""
    return detected.select("file_type").distinct().join(
        routes.select("file_type").distinct(), "file_type", "left_anti")


def formats_common(*accepted: DataFrame) -> DataFrame:
    """Extensions every entry point accepts."""
    out = accepted[0].select("ext")
    for other in accepted[1:]:
        out = out.intersect(other.select("ext"))
    return out


def union_results(*dfs: DataFrame) -> DataFrame:
    """Results of several converters as one table; missing columns become null."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
