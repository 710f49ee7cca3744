"""File-type detection: all rules are `when` chains or broadcasts of fixed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave import rules
from folioweave.functions.text import _col
from folioweave.session import values_table


def extension_table(spark: SparkSession) -> DataFrame:
    return values_table(spark, list(rules.EXTENSION_TYPES.items()), ["ext", "file_type"])


def mime_table(spark: SparkSession) -> DataFrame:
    return values_table(spark, list(rules.MIME_TYPES.items()), ["mime", "file_type"])


def file_ext(path) -> Column:
    """Lower-cased suffix with its dot, '' when the name has none."""
    name = F.regexp_extract(_col(path), r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+?(\.[^./\\]+)$", 1))


def type_by_ext(df: DataFrame, ext: str = "ext", out: str = "file_type") -> DataFrame:
    lookup = extension_table(df.sparkSession).select(F.col("ext").alias("_e"), F.col("file_type").alias(out))
    # fixed table of under forty rows: the broadcast cannot grow with the data
    return df.join(F.broadcast(lookup), df[ext] == F.col("_e"), "left").drop("_e")


def type_by_mime(df: DataFrame, mime: str = "mime", out: str = "file_type") -> DataFrame:
    lookup = mime_table(df.sparkSession).select(F.col("mime").alias("_m"), F.col("file_type").alias(out))
    return df.join(F.broadcast(lookup), df[mime] == F.col("_m"), "left").drop("_m")


def _starts(content: Column, name: str, signature: bytes) -> Column:
    if name == "html":  # letter case and leading blanks do not matter for markup
        head = F.decode(F.substring(content, 1, rules.HEADER_BYTES), "ISO-8859-1")
        return F.startswith(F.lower(F.ltrim(F.regexp_replace(head, r"^[\s]+", ""))),
                            F.lit(signature.decode().lower()))
    return F.startswith(content, F.lit(signature))


def signature_name(content) -> Column:
    """Name of the first signature the leading bytes match, null if none does."""
    c = _col(content).cast("binary")
    return F.coalesce(*[F.when(_starts(c, n, s), F.lit(n)) for n, _, s in rules.SIGNATURES])


def magic_type(content) -> Column:
    """Routable type of the first matching signature."""
    c = _col(content).cast("binary")
    return F.coalesce(*[F.when(_starts(c, n, s), F.lit(t)) for n, t, s in rules.SIGNATURES])


def type_by_magic(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("signature", signature_name(content)).withColumn("magic_type", magic_type(content))


def magic_ok(content, file_type) -> Column:
    """Do the leading bytes agree with the claimed type? True for types without signature."""
    c, t = _col(content).cast("binary"), _col(file_type)
    by_type: dict[str, list[Column]] = {}
    for name, _, sig in rules.SIGNATURES:
        for claimed in rules.ZIP_BASED_TYPES if name == "zip" else [name]:
            by_type.setdefault(claimed, []).append(_starts(c, name, sig))
    chain = None
    for claimed, tests in by_type.items():
        agrees = reduce(lambda a, b: a | b, tests)
        chain = F.when(t == claimed, agrees) if chain is None else chain.when(t == claimed, agrees)
    return F.coalesce(chain.otherwise(F.lit(True)), F.lit(True))


def sniff_html(text) -> Column:
    head = F.lower(F.substring(_col(text), 1, rules.SNIFF_CHARS))
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(head, F.lit(m)) for m in rules.HTML_MARKERS]),
                      F.lit(False))


def detect_type(
    df: DataFrame,
    path: str = "path",
    content: str = "content",
    mime: str | None = None,
    allow_fallback: bool = True,
    text_passthrough: bool = False,
    package_type: str | None = None,
) -> DataFrame:
    """Adds file_type, detected_by and error; the layers are tried in order.

    extension confirmed by signature -> MIME column -> signature -> markup sniffing.
    `package_type` names a column that tells ZIP-based packages apart where the
    extension did not settle it. An unsupported row keeps a null type and an error.
    """
    c = F.col(content)
    out = type_by_ext(df.withColumn("_ext", file_ext(path)), "_ext", "_by_ext")
    ext_layer = (
        F.when(magic_ok(c, F.col("_by_ext")), F.col("_by_ext")) if allow_fallback else F.col("_by_ext")
    )
    if mime:
        out = type_by_mime(out, mime, "_by_mime")
    else:
        out = out.withColumn("_by_mime", F.lit(None).cast("string"))
    by_magic = magic_type(c)
    if package_type:
        by_magic = F.when(by_magic == "zip", F.coalesce(F.col(package_type), by_magic)).otherwise(by_magic)
    text = c.cast("string") if dict(df.dtypes)[content] == "binary" else c
    sniffed = F.when(sniff_html(text), F.lit("html")) if allow_fallback else F.lit(None).cast("string")
    plain = F.when((F.col("_ext") == ".txt") & F.lit(text_passthrough), F.lit("text"))
    layers = [("extension", ext_layer), ("mime", F.col("_by_mime")), ("magic", by_magic),
              ("content", sniffed), ("text", plain)]
    found = F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("t"), F.lit(n).alias("by"))) for n, v in layers])
    return (
        out.withColumn("_found", found)
        .withColumn("file_type", F.col("_found.t"))
        .withColumn("detected_by", F.coalesce(F.col("_found.by"), F.lit("unsupported")))
        .withColumn("error", F.when(F.col("_found").isNull(),
                                    F.concat(F.lit("Could not determine file type for: "), F.col(path))))
        .drop("_found", "_ext", "_by_ext", "_by_mime")
    )


def only_supported(df: DataFrame) -> DataFrame:
    return df.where(F.col("file_type").isNotNull())


def only_unsupported(df: DataFrame) -> DataFrame:
    return df.where(F.col("file_type").isNull())


def validate_ext(df: DataFrame, ext: str, converter: str, supported: list[str]) -> DataFrame:
    """Adds ext_ok and ext_error for the extensions a converter accepts."""
    ok = F.coalesce(F.col(ext).isin(supported), F.lit(False))
    message = F.format_string(
        "File extension '%s' not supported by " + converter + ". Supported extensions: " + ", ".join(supported),
        F.col(ext),
    )
    return df.withColumn("ext_ok", ok).withColumn("ext_error", F.when(~ok, message))


def distinct_types(df: DataFrame, col: str = "file_type") -> DataFrame:
    return df.where(F.col(col).isNotNull()).select(col).distinct()
