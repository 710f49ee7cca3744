"""File and table scans, and the sinks that persist results."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folioweave.operators.grouping import block_of
from folioweave.sources.delimited import csv_cells, scan_csv_cells  # noqa: F401  part of this module's interface

CORPUS_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
CHILDREN_PER_PART = 4096


def scan_corpus(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """Files as rows (path, modificationTime, length, content); `{a,b}` patterns work.

    Queries that leave `content` out do not read the files.
    """
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower()).load(folder)
    )


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_corpus_stream(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files as they arrive; new ones are picked up by each micro-batch."""
    return (
        spark.readStream.format("binaryFile").schema(CORPUS_SCHEMA)
        .option("pathGlobFilter", pattern).load(folder)
    )


# ---------------------------------------------------------------- sinks


def with_output_path(results: DataFrame, path: str = "path") -> DataFrame:
    """output_path: the input path with its suffix replaced by .md."""
    return results.withColumn("output_path", F.concat(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit(".md")))


def write_markdown(results: DataFrame, out_dir: str, mode: str = "overwrite") -> None:
    """Persist results as Parquet by file type; readers of one type skip the others."""
    with_output_path(results).write.mode(mode).partitionBy("file_type").parquet(out_dir)


def _put_files(rows, root: str, name: str, body: str) -> None:
    for row in rows:
        target = os.path.join(root, row[name].lstrip("/"))
        os.makedirs(os.path.dirname(target), exist_ok=True)
        data = row[body]
        data = data.encode("utf-8") if isinstance(data, str) else bytes(data)
        # a retried or speculative task writes its own file and renames over the last one
        staged = f"{target}.{os.getpid()}.part"
        with open(staged, "wb") as f:
            f.write(data)
        os.replace(staged, target)


def export_files(df: DataFrame, root: str, name: str, body: str) -> None:
    """One file per row below `root`, a folder mounted on every executor."""
    df.select(name, body).foreachPartition(lambda rows: _put_files(rows, root, name, body))


def image_file_names(images: DataFrame, stem: str = "stem") -> DataFrame:
    """file_name: `<stem>_images/image_<page>_<index>.<format>`."""
    return images.withColumn("file_name", F.format_string(
        "%s_images/image_%d_%d.%s", F.col(stem), F.col("page_number"), F.col("image_index"), F.col("format")))


def write_images(images: DataFrame, out_dir: str, mode: str = "overwrite") -> None:
    """Persist image bytes with their file names as Parquet."""
    image_file_names(images).write.mode(mode).parquet(out_dir)


def record_metrics(rows: DataFrame, path: str) -> None:
    """Append (operation, duration, ts, attrs) measurements."""
    rows.select("operation", "duration", "ts", "attrs").write.mode("append").parquet(path)


def write_observed(df: DataFrame, path: str, metrics_path: str, operation: str, attrs: dict[str, str] | None = None, mode: str = "overwrite") -> dict:
    """Write a table and append what was written to the metrics table; the rows are counted while they are written."""
    spark = df.sparkSession
    seen = Observation()
    began = time.time()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).parquet(path)
    facts = {**(attrs or {}), "rows": str(seen.get["rows"])}
    row = spark.createDataFrame([(operation, time.time() - began, facts)], "operation string, duration double, attrs map<string,string>")
    record_metrics(row.withColumn("ts", F.current_timestamp()), metrics_path)
    return facts


def export_json(results: DataFrame, images: DataFrame, tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, part, json): markdown, metadata, images[] and tables[] of each document.

    Children beyond CHILDREN_PER_PART go to further parts of the document, which
    hold only children; an ordinary document has part 0 alone.
    """
    def nested(child: DataFrame, index: str, name: str) -> DataFrame:
        cols = [c for c in child.columns if c != key]
        first = F.struct(index, *[c for c in cols if c != index])
        return child.select(key, block_of(index, CHILDREN_PER_PART).alias("part"), first.alias("_s")).groupBy(
            key, "part").agg(F.array_sort(F.collect_list("_s")).alias(name))

    meta = [c for c in results.columns if c not in (key, "markdown")]
    body = results.select(key, F.lit(0).cast("bigint").alias("part"), "markdown",
                          F.struct(*meta).alias("metadata"))
    out = body.join(nested(images, "image_index", "images"), [key, "part"], "full").join(
        nested(tables, "table_index", "tables"), [key, "part"], "full")
    for name in ("images", "tables"):
        kind = out.schema[name].dataType
        out = out.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out.select(key, "part", F.to_json(F.struct("markdown", "images", "tables", "metadata")).alias("json"))
