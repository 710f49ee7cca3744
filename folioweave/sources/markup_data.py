"""JSON and XML documents held in a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPENED = 3           # levels that are opened where a document lies; deeper ones are cut into tokens
PARSER_DEPTH = 1000  # the built-in parser takes no deeper documents

_BRACKETS = r"[\[{]"
_TOKEN = (r'(?s)"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|[\[\]{},:]'
          r"|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null|[ \t\n\r]++|.")


def _below(path: Column, key: Column, pos: Column) -> Column:
    """Path of a member or an item."""
    dot = F.when(path != "", F.lit(".")).otherwise(F.lit(""))
    return F.when(key.isNotNull(), F.concat(path, dot, key)).otherwise(F.concat(path, F.lit("["), pos.cast("string"), F.lit("]")))


def _scalar(raw: Column) -> Column:
    """A token's value as text, as the built-in parser writes it."""
    return F.try_parse_json(raw).cast("string")


def _tokens(docs: DataFrame) -> DataFrame:
    """(row, path, key, pos, raw, kind): tokens of the texts without blanks; kind is the bracket or mark, s, n, or x for what is none."""
    src = docs.withColumn("row", F.monotonically_increasing_id()).repartition("row")
    raw = src.select("row", "path", "key", F.posexplode(F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0))).alias("pos", "raw"))
    first = F.substring("raw", 1, 1)
    whole = F.length("raw") > 1
    kind = (F.when(first.rlike(r"[\[\]{},:]"), first).when(whole & (first == '"'), "s")
            .when(first.rlike("[0-9]") | (whole & first.rlike("[-tfn]")), "n").otherwise("x"))
    return raw.where(~F.col("raw").rlike(r"^[ \t\n\r]")).withColumn("kind", kind)


def deep_json(docs: DataFrame) -> DataFrame:
    """(key, path, value, error) of texts (key, path, text) of any depth, in a plan that does not depend on them.

    Running counts give each token the container it lies in; from that and the tokens
    before it follows whether it may stand there, so validity is a fact of single
    tokens. A leaf's path is made of what its enclosing containers are called, level
    by level: as many rows as the path has parts. `path` is put before the paths
    within. Invalid texts and repeated member names give one row with an error, blank
    texts none.
    """
    row = Window.partitionBy("row").orderBy("pos")
    kind = F.col("kind")
    opens, closes = kind.isin("[", "{"), kind.isin("]", "}")
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    out = _tokens(docs).select(
        "*", F.sum(step).over(row.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"), F.lag("kind").over(row).alias("p"),
        F.lag("kind", 2).over(row).alias("pp"), F.lag("raw", 2).over(row).alias("name"), F.lead("kind").over(row).alias("next"))
    # a bracket that opens stands in the container around it and begins another; one that closes ends its own
    entry = lambda level, role: F.struct(level.alias("level"), F.lit(role).alias("role"))
    entries = F.when(opens, F.array(entry(F.col("depth") - 1, "token"), entry(F.col("depth"), "begin"))).when(
        closes, F.array(entry(F.col("depth") + 1, "token"))).otherwise(F.array(entry(F.col("depth"), "token")))
    out = out.select("*", F.explode(entries).alias("e")).select("*", "e.level", "e.role").drop("e")
    level = Window.partitionBy("row", "level").orderBy("pos", F.col("role") != "begin").rowsBetween(Window.unboundedPreceding, 0)
    commas = F.sum(((kind == ",") & (F.col("role") == "token")).cast("int")).over(level)
    out = out.withColumn("commas", commas).withColumn(
        "box", F.last(F.when(F.col("role") == "begin", F.struct("kind", "pos", "commas")), ignorenulls=True).over(level))
    out = out.withColumn("within", F.when(F.col("level") > 0, F.col("box.kind")))

    p, pp, within = F.col("p"), F.col("pp"), F.col("within")
    is_key = (within == "{") & p.isin("{", ",") & (kind == "s")
    may_begin = F.when(within.isNull(), p.isNull() & (F.col("level") == 0)).when(within == "[", p.isin("[", ",")).otherwise(p == ":")
    ended = p.isin("n", "]", "}") | ((p == "s") & ((within == "[") | (pp == ":")))
    legal = (
        F.when(kind == "x", False).when(kind == ",", within.isNotNull() & ended)
        .when(kind == ":", (within == "{") & (p == "s") & pp.isin("{", ","))
        .when(kind == "]", (within == "[") & (ended | (p == "["))).when(kind == "}", (within == "{") & (ended | (p == "{")))
        .otherwise(may_begin | is_key))
    value = (kind.isin("n") | opens | ((kind == "s") & ~F.coalesce(is_key, F.lit(False)))) & (F.col("role") == "token")
    member = F.when(within == "{", _scalar(F.col("name")))
    part = F.when(within == "{", F.concat(F.lit("."), member)).when(
        within == "[", F.concat(F.lit("["), (F.col("commas") - F.col("box.commas")).cast("string"), F.lit("]")))
    same = Window.partitionBy("row", "level", "box.pos", "member")
    out = out.withColumn("ok", F.coalesce(legal, F.lit(False)) | (F.col("role") == "begin")).withColumn("value", value).withColumn(
        "part", F.when(value, part)).withColumn("member", F.when(value, member))
    out = out.withColumn("twice", F.col("member").isNotNull() & (F.count(F.lit(1)).over(same) > 1))
    whole = Window.partitionBy("row")
    last = F.max(F.struct("pos", "depth")).over(whole)["depth"]
    out = out.withColumn("valid", F.min(F.col("ok") & ~F.col("twice")).over(whole) & (last == 0))

    empty = opens & F.col("next").isin("]", "}")
    leaf = F.col("value") & (~opens | empty)
    text = F.when(opens, F.when(kind == "[", "[]").otherwise("{}")).otherwise(_scalar(F.col("raw")))
    events = out.where("valid and value").withColumn("text", text).withColumn("leaf", leaf)
    # a leaf looks up, on every level above it, the last value that began there
    asked = F.concat(F.array(F.struct("level", "part", F.lit(0).alias("of"))), F.when(
        F.col("leaf") & (F.col("level") > 1), F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("level") - 1)), lambda n: F.struct(
            n.cast("bigint").alias("level"), F.lit(None).cast("string").alias("part"), F.lit(1).alias("of")))).otherwise(
        F.array().cast("array<struct<level:bigint,part:string,of:int>>")))
    rows = events.select("row", "path", "key", "pos", "leaf", "text", F.explode(asked).alias("a")).select("*", "a.*").drop("a")
    found = F.last("part", ignorenulls=True).over(Window.partitionBy("row", "level").orderBy("pos", F.col("of").desc()).rowsBetween(
        Window.unboundedPreceding, 0))
    leaves = rows.withColumn("part", found).where("leaf").groupBy("row", "pos").agg(
        F.first("key").alias("key"), F.first("path").alias("path"), F.max("text").alias("text"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "part"))), lambda s: F.coalesce(s["part"], F.lit(""))), "").alias("inner"))
    inner = F.when((F.col("path") == "") & F.col("inner").startswith("."), F.substring("inner", F.lit(2), F.length("inner"))).otherwise(F.col("inner"))
    none = F.lit(None).cast("string")
    good = leaves.select("key", F.concat("path", inner).alias("path"), F.col("text").alias("value"), none.alias("error"))
    bad = out.where("not valid").groupBy("row").agg(F.first("key").alias("key"), F.first("path").alias("path")).select(
        "key", "path", none.alias("value"), F.lit("invalid JSON").alias("error"))
    return good.unionByName(bad)


def scan_json(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, path, value, error): one row per leaf, e.g. `items[0]`.

    The first OPENED levels are opened by the built-in parser where the document lies.
    What is nested deeper, and documents too deep for that parser, are cut into tokens
    (`deep_json`); no job runs beforehand, and a deep document costs only itself.
    Invalid JSON gives one row with an error.
    """
    spark = df.sparkSession
    brackets = F.regexp_count(col, F.lit(_BRACKETS))

    def opened(rows: DataFrame) -> DataFrame:
        # inside brackets the parser also sees what follows the first value
        wrapped = rows.select(F.col(key).alias("key"), F.try_parse_json(F.concat(F.lit("["), F.col(col), F.lit("]"))).alias("w"))
        single = F.try_variant_get("w", "$[1]", "variant").isNull()
        out = wrapped.select("key", F.lit("").alias("path"), F.when(single, F.try_variant_get("w", "$[0]", "variant")).alias("v"))
        out = out.withColumn("error", F.when(F.col("v").isNull(), F.lit("invalid JSON"))).withColumnRenamed("key", "id")
        for _ in range(OPENED):
            inner = out.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()))
            deeper = F.col("pos").isNotNull()
            out = inner.select("id", F.when(deeper, _below(F.col("path"), F.col("key"), F.col("pos"))).otherwise(F.col("path")).alias("path"),
                               F.when(deeper, F.col("value")).otherwise(F.col("v")).alias("v"), "error")
        text = F.col("v").cast("string")
        nested = F.when(text.rlike(r"^[\[{]") & ~text.isin("[]", "{}"), F.schema_of_variant("v").rlike("^(ARRAY|OBJECT)<"))
        return out.select(F.col("id").alias("key"), "path", text.alias("value"), "error", F.coalesce(nested, F.lit(False)).alias("nested"))

    own = brackets > PARSER_DEPTH - 2
    shallow, many = df.where(F.coalesce(~own, F.lit(True))), df.where(own)
    below = opened(shallow.where(brackets > OPENED)).where("nested").select("key", "path", F.col("value").alias("text"))
    whole = many.select(F.col(key).alias("key"), F.lit("").alias("path"), F.col(col).cast("string").alias("text"))
    done = opened(shallow).where("not nested").drop("nested").unionByName(deep_json(below.unionByName(whole)))
    return done.select(F.col("key").alias(key), "path", "value", "error")


def xml_is_well_formed(col: str):
    """False for text the XML parser rejects."""
    parsed = F.from_xml(F.col(col), "_bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    return parsed.isNotNull() & parsed["_bad"].isNull()


def scan_xml(df: DataFrame, key: str, col: str, row_tag: str | None = None) -> DataFrame:
    """(key, node_no, text, error): non-blank text nodes, of `row_tag` elements if given.

    Element names are compared without their prefix. Malformed XML gives one row
    with an error.
    """
    scope = f"//*[local-name()='{row_tag}']" if row_tag else ""
    nodes = F.xpath(col, F.lit(f"{scope}//text()[normalize-space()]"))
    ok = xml_is_well_formed(col)
    tagged = df.select(key, ok.alias("_ok"), F.col(col))
    texts = F.when(F.col("_ok"), nodes)
    out = tagged.select(key, "_ok", F.posexplode_outer(texts).alias("node_no", "text"))
    return out.where(~F.col("_ok") | F.col("text").isNotNull()).select(
        key, F.col("node_no").cast("bigint").alias("node_no"), "text",
        F.when(~F.col("_ok"), F.lit("invalid XML")).alias("error"))
