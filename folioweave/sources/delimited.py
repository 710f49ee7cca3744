"""Delimited files, read by lines, so that a large file is many splits.

Whether a line begins within a quoted field depends on all lines before it, but only
through one bit. A line maps that bit to the one after it: it keeps it, turns it
round, or sets it. So each split says what it does to either bit and how many records
begin in it in either case; a running composition over one row per split gives every
split its bit and its first record's number. Files without a quoted line break, known
from the same summary, need no window over lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLOSED = r'(?:"(?:[^"]++|"")*+"[^,]*+|(?!")[^,]*+),'   # a field that ends in its line
_OPENS = rf'(?:{_CLOSED})*+"(?:[^"]++|"")*+$'             # the last field does not
_FIELD = r'''(?:"(?:[^"]++|"")*+"[^,\n]*+|[^,\n]*+)'''


def record_cells(records: DataFrame) -> DataFrame:
    """(doc_id, row_index, rec) to cells. A quote counts only at the start of a field and if it is closed."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), F.col("rec")), F.lit(f",({_FIELD})"), F.lit(1))

    def plain(f: Column) -> Column:
        inner = F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
        return F.when(f.startswith('"') & f.endswith('"') & (F.length(f) >= 2), inner).otherwise(f)

    cells = records.select("doc_id", "row_index", F.posexplode(F.transform(fields, plain)).alias("col_index", "text"))
    return cells.select(
        "doc_id", F.lit(0).cast("bigint").alias("table_index"), F.col("row_index").cast("bigint").alias("row_index"),
        F.col("col_index").cast("bigint").alias("col_index"), "text", (F.col("row_index") == 0).alias("is_header"))


def csv_cells(docs: DataFrame, content: str = "content") -> DataFrame:
    """Delimited text (doc_id, content) to cells; quoted fields may hold commas and newlines.

    For texts that are rows already; files are better read by `scan_csv_cells`. The
    patterns are possessive: they need no stack, however many fields a record has.
    """
    body = F.replace(F.col(content), F.lit("\r\n"), F.lit("\n"))
    records = F.regexp_extract_all(body, F.lit(f"{_FIELD}(?:,{_FIELD})*+"), F.lit(0))
    records = F.filter(records, lambda r: r != "")
    return record_cells(docs.select("doc_id", F.posexplode(records).alias("row_index", "rec")))


def _lines(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(doc_id, split, id, raw, inside_after, inside_stays): lines with what they do to the bit `within quotes`."""
    text = spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(folder)
    raw = text.select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("split"),
                      F.regexp_replace("value", "\r$", "").alias("line"), F.col("value").cast("binary").alias("raw"), F.is_valid_utf8("value").alias("utf8"))
    outside = F.col("line").rlike(f"^{_OPENS}")
    again = F.col("line").rlike(rf'^(?:[^"]++|"")*+"[^,]*+,{_OPENS}')  # closes a quote and opens another
    inside = F.col("line").rlike(r'^(?:[^"]++|"")*+$') | again
    # ids rise along a split
    return raw.select("doc_id", "split", F.monotonically_increasing_id().alias("id"), "raw", "utf8", (F.col("line") != "").alias("some"),
                      outside.alias("opens"), inside.alias("stays"), again.alias("again"))


def _bits(lines: DataFrame) -> DataFrame:
    """Adds, for either bit at the begin of the split, the bit at the begin of the line (`in0`, `in1`) and after it."""
    before = Window.partitionBy("doc_id", "split").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return _composed(lines, "opens", "stays", before, "in0", "in1")


def _composed(rows: DataFrame, zero: str, one: str, before: Window, out0: str, out1: str) -> DataFrame:
    """The bit before each row if the first one found 0 or 1; `zero`, `one`: what a row makes of either.

    A row that makes the same of both sets the bit; rows that turn it round are counted.
    """
    turns = F.col(zero) & ~F.col(one)
    counted = rows.withColumn("_turns", F.coalesce(F.sum(turns.cast("int")).over(before), F.lit(0)))
    fixed = F.last(F.when(F.col(zero) == F.col(one), F.struct(F.col(zero).alias("bit"), F.col("_turns").alias("at"))), ignorenulls=True).over(before)
    marked = counted.withColumn("_set", fixed)
    odd = lambda n: n % 2 == 1
    known = F.col("_set.bit") != odd(F.col("_turns") - F.col("_set.at"))
    return marked.select("*", F.coalesce(known, odd(F.col("_turns"))).alias(out0), F.coalesce(known, ~odd(F.col("_turns"))).alias(out1)).drop("_turns", "_set")


def _splits(lines: DataFrame) -> DataFrame:
    """One row per split: what it does to the bit, records that begin in it, its last line that opens a quote beyond its end, for either bit; its lines."""
    bits = _bits(lines)
    after = {n: F.when(F.col(f"in{n}"), F.col("stays")).otherwise(F.col("opens")) for n in (0, 1)}
    begins = {n: ~F.col(f"in{n}") & F.col("some") for n in (0, 1)}
    opens = {n: F.when(F.col(f"in{n}"), F.col("again")).otherwise(F.col("opens")) for n in (0, 1)}
    upto = Window.partitionBy("doc_id", "split").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = bits.select("*", F.sum(F.col("some").cast("int")).over(upto).alias("nth"),
                           *[F.sum(begins[n].cast("int")).over(upto).alias(f"begun{n}") for n in (0, 1)])
    return numbered.groupBy("doc_id", "split").agg(
        F.max_by(after[0], "id").alias("zero"), F.max_by(after[1], "id").alias("one"),
        *[F.count_if(begins[n]).alias(f"begins{n}") for n in (0, 1)],
        *[F.max(F.when(opens[n], F.struct("id", "nth", F.col(f"begun{n}").alias("begun")))).alias(f"last{n}") for n in (0, 1)],
        F.count_if("some").alias("lines"))


def _numbered_splits(splits: DataFrame) -> DataFrame:
    """Splits with their bit, the records and lines before them, and, of files that end within quotes, the line that opened the last one.

    That quote is never closed, so it counts as a character: the lines after it are
    records of their own.
    """
    file = Window.partitionBy("doc_id").orderBy("split")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    out = _composed(splits, "zero", "one", before, "bit", "_").drop("_")
    own = lambda name: F.when(F.col("bit"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    out = out.select("doc_id", "split", "bit", "lines", F.when(F.col("bit"), F.col("one")).otherwise(F.col("zero")).alias("bit_after"),
                     own("begins").alias("begins"), own("last").alias("last"))
    out = out.select("*", F.coalesce(F.sum("begins").over(before), F.lit(0)).alias("records_before"),
                     F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("lines_before"))
    whole = Window.partitionBy("doc_id")
    last = F.when(F.col("last").isNotNull(), F.struct("split", F.col("last.id").alias("id"), (F.col("lines_before") + F.col("last.nth")).alias("nth"),
                                                      (F.col("records_before") + F.col("last.begun") - 1).alias("record")))
    ends_open = F.max_by("bit_after", "split").over(whole)
    return out.select("doc_id", "split", "bit", "records_before", "lines_before", F.when(ends_open, F.max(last).over(whole)).alias("open"))


def csv_records(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(doc_id, row_index, rec): records of all files, numbered from 0; blank ones are left out.

    Files are split like any text: one of many times the split size is read by as many
    tasks. A file without a quoted line break is one record a line, numbered by counts
    per split; only lines of other files are sorted, split by split, and joined to
    records. A file that is not UTF-8 throughout is read as Latin-1.
    """
    lines = _lines(spark, folder, pattern)
    files = lines.groupBy("doc_id").agg(F.bool_and("utf8").alias("file_utf8"), F.bool_or("opens").alias("breaks"))
    text = F.regexp_replace(F.when(F.col("file_utf8"), F.col("raw").cast("string")).otherwise(F.decode("raw", "ISO-8859-1")), "\r$", "")

    # numbered where they are read: the lines of a split follow one another
    some = lines.where("some").withColumn("id", F.monotonically_increasing_id()).join(files, "doc_id").where("not breaks")
    counts = some.groupBy("doc_id", "split").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("doc_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("doc_id", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    single = some.join(starts, ["doc_id", "split"]).select("doc_id", (F.col("id") + F.col("shift")).alias("row_index"), text.alias("rec"))

    broken = lines.join(files, "doc_id").where("breaks")
    splits = _numbered_splits(_splits(broken))
    upto = Window.partitionBy("doc_id", "split").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    placed = _bits(broken).withColumn("nth", F.sum(F.col("some").cast("int")).over(upto)).join(splits, ["doc_id", "split"])
    after_open = F.col("open").isNotNull() & (F.struct("split", "id") > F.struct("open.split", "open.id"))
    within = F.when(F.col("bit"), F.col("in1")).otherwise(F.col("in0")) & ~after_open
    placed = placed.withColumn("after_open", after_open).withColumn("within", within).where("within or some")
    begins = (~F.col("within") & ~F.col("after_open")).cast("int")
    number = F.when(F.col("after_open"), F.col("open.record") + F.col("lines_before") + F.col("nth") - F.col("open.nth")).otherwise(
        F.col("records_before") + F.sum(begins).over(upto) - 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "id", text.alias("text")))), lambda s: s["text"]), "\n")
    several = placed.withColumn("row_index", number).groupBy("doc_id", "row_index").agg(joined.alias("rec"))
    return single.unionByName(several)


def scan_csv_cells(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """CSV files to cells, one document per file, named by its address."""
    return record_cells(csv_records(spark, folder, pattern))
