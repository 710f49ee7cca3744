"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.session import shared_dir

# Text that Python tasks hold decomposed into words at a time.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder all executors share (`spark.checkpoint.dir`).

    Only a local session without that setting gets a folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "folioweave-checkpoints"))
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage through a compressed table in the shared folder, for wide or long intermediate results."""
    return kept(df, label)[0]


def kept(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As `stored`, and the path, for `forget` once the readers have written what they make of it."""
    path = shared_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes, so that a batch of very long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def text_slices(texts: Sequence[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of about `chars` characters each; one row is never cut."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_of(c: str = "text") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def fold_of(c: str, parts: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(c).cast("string").cast("binary")) % parts


def as_document(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: other columns cannot clash with those the operators add."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def free_names(columns: Sequence[str], *wanted: str) -> list[str]:
    """The wanted names, lengthened until none is that of a column (Spark does not tell upper from lower case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables whose readers have written their results."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
