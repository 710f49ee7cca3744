"""Registered queries of this folder: name -> (Spark callable, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm import alignment, chats, decontam, extract, mixing, passages, quality, resharding, simhash, topk, toxicity, warc, whitening
from folioweave.llm.common import fold_of, table, text_of
from folioweave.session import shared_dir


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", (fold_of("doc_id", quality.FOLDS) == quality.HELD_OUT).alias("held_out"),
        F.col("quality_score").alias("score"), (F.col("quality_score") >= quality.CUT).cast("int").alias("predicted"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), mixing.PRODUCTION).select(
        "doc_id", F.col("mix_domain").alias("domain"), F.coalesce("lang", F.lit(mixing.NONE)).alias("lang"),
        F.coalesce("source", F.lit(mixing.NONE)).alias("source"), F.col("mix_tokens").alias("tokens"), F.col("mix_copies").alias("copies"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_main_text(table(spark, sf_dir, "pages"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path, payload=False).where("gap is null").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.rendered(table(spark, sf_dir, "conversations"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return found.select(
        "doc_id", (fold_of("doc_id", toxicity.FOLDS) == toxicity.HELD_OUT).alias("held_out"),
        F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"), "tox_reject")


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the byte-level and the piece tokenizer."""
    return alignment.aligned(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 32 largest components of all vectors."""
    rows = whitening.integer_rows(table(spark, sf_dir, "embeddings"))
    model = whitening.fit(rows)
    return whitening.whitened(rows, model).withColumn("identity_error", F.lit(whitening.identity_error(rows, model)))


def op13_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out by source and dealt anew to eight shards of equal bytes; read back from the files."""
    layout = resharding.resharded(table(spark, sf_dir, "documents"), shared_dir(spark, "layout"))
    rows = layout.slots(F.col("doc_id").cast("bigint").alias("doc_id"), F.crc32(text_of().cast("binary")).alias("text_crc32"))
    return rows.select("doc.doc_id", "size", "doc.text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"),
                       F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    "op1_quality": (op1_quality, None),
    "op2_mixing": (op2_mixing, mixing.mix_sql(mixing.PRODUCTION)),
    "op3_topk": (op3_topk, topk.TOP_SQL),
    "op4_extract": (op4_extract, None),
    "op5_passages": (op5_passages, None),
    "op6_warc": (op6_warc, warc.ARCHIVE_SQL),
    "op7_chats": (op7_chats, chats.RENDERED_SQL),
    "op8_toxicity": (op8_toxicity, None),
    "op9_decontam": (op9_decontam, None),
    "op10_simhash": (op10_simhash, None),
    "op11_alignment": (op11_alignment, None),
    "op12_whitening": (op12_whitening, None),
    "op13_resharding": (op13_resharding, None),
}
