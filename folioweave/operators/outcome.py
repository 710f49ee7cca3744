"""Errors, warnings and fallbacks as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.functions.text import _col


def first_success(attempts: list[tuple[str, Column]]) -> Column:
    """struct(value, converter, error) of the first attempt that is not null."""
    tried = [F.when(c.isNotNull(), F.struct(c.alias("value"), F.lit(n).alias("converter"))) for n, c in attempts]
    won = F.coalesce(*tried)
    names = ", ".join(n for n, _ in attempts)
    return F.struct(
        won["value"].alias("value"), won["converter"].alias("converter"),
        F.when(won.isNull(), F.lit(f"all converters failed: {names}")).alias("error"))


def guard(df: DataFrame, value: str, message: Column, fail_fast: bool = False) -> DataFrame:
    """status/error columns: a null value is an error row; `fail_fast` fails the job instead."""
    bad = F.col(value).isNull()
    out = df.withColumn("status", F.when(bad, F.lit("error")).otherwise(F.lit("ok")))
    error = F.when(bad, F.raise_error(message).cast("string") if fail_fast else message)
    return out.withColumn("error", error)


def merge_warnings(a, b) -> Column:
    """Warnings of both, order kept; null counts as none."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(_col(a), none), F.coalesce(_col(b), none))


def enrich(results: DataFrame, meta: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Adds richer metadata; a document without it only gets a warning.

    results has a `warnings array<string>`; meta has one row per key.
    """
    found = meta.select(key, *columns, F.lit(True).alias("_found"))
    note = F.when(F.col("_found").isNull(), F.array(F.lit("Rich metadata extraction failed: no metadata")))
    return (
        results.join(found, key, "left")
        .withColumn("warnings", merge_warnings("warnings", note)).drop("_found")
    )


def attach_assets(results: DataFrame, images: DataFrame | None, tables: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """Image and table totals per document; children are counted before the join."""
    out = results
    for child, name in ((images, "total_images"), (tables, "total_tables")):
        zero = F.lit(0).cast("bigint")
        if child is None:
            out = out.withColumn(name, zero)
        else:
            n = child.groupBy(key).agg(F.count(F.lit(1)).alias(name))
            out = out.join(n, key, "left").withColumn(name, F.coalesce(name, zero))
    return out
