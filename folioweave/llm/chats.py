"""Chat formatting: snapshots of growing conversations collapse to the longest, which are rendered.

All steps are column expressions. A turn's digest covers its number and all its rows;
the rolling hash of a prefix is the xor of the digests so far (two independent 64-bit
ones), so it is a running aggregate. Running values go over blocks of turns first, so
a conversation of any length is never one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.llm.common import checkpointed

BLOCK = 1024      # turns whose running hash one window computes
PART = 256        # turns of one rendered row
FIRST = -(1 << 63)  # place of rows without a turn number: before all others

_DEC = "decimal(20,0)"


def _clean(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.coalesce(F.col("turn").cast("bigint"), F.lit(FIRST)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id is not null")


def _block(size: int) -> Column:
    return F.floor(F.col("turn") / size).cast("bigint")


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, h1, h2, rows, last: the rolling hash up to each turn, rows so far, whether it is the last turn.

    Rows with the same turn number count as one turn, whatever their order.
    """
    rows = _clean(conversations)
    row = [F.xxhash64(F.lit(salt), F.length("role"), "role", "text").cast(_DEC) for salt in (1, 2)]
    turns = (
        rows.groupBy("conv_id", "turn")
        .agg(F.sum(row[0]).alias("s1"), F.sum(row[1]).alias("s2"), F.count(F.lit(1)).alias("n"))
        .select("conv_id", "turn", "n", F.xxhash64(F.lit(1), "turn", "n", "s1").alias("d1"), F.xxhash64(F.lit(2), "turn", "n", "s2").alias("d2"))
        .withColumn("block", _block(BLOCK))
    )
    turns = checkpointed(turns)
    order = Window.partitionBy("conv_id").orderBy("block")
    before, group = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("conv_id")
    blocks = (
        turns.groupBy("conv_id", "block")
        .agg(F.bit_xor("d1").alias("b1"), F.bit_xor("d2").alias("b2"), F.sum("n").alias("bn"), F.max("turn").alias("top"))
        .select("conv_id", "block", F.coalesce(F.bit_xor("b1").over(before), F.lit(0)).alias("p1"),
                F.coalesce(F.bit_xor("b2").over(before), F.lit(0)).alias("p2"),
                F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("pn"), F.max("top").over(group).alias("end"))
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    own = turns.select("conv_id", "block", "turn", F.bit_xor("d1").over(inside).alias("w1"), F.bit_xor("d2").over(inside).alias("w2"),
                       F.sum("n").over(inside).alias("wn"))
    return own.join(blocks, ["conv_id", "block"]).select(
        "conv_id", "turn", F.col("w1").bitwiseXOR(F.col("p1")).alias("h1"), F.col("w2").bitwiseXOR(F.col("p2")).alias("h2"),
        (F.col("wn") + F.col("pn")).alias("rows"), (F.col("turn") == F.col("end")).alias("last"))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, n_rows, n_same of the conversations that are no proper prefix of another one.

    Of equal conversations the smallest conv_id is kept; n_same is how many there
    are. Rows with a null conv_id take no part.
    """
    hashes = checkpointed(prefix_hashes(conversations))
    whole = hashes.where("last").groupBy("h1", "h2").agg(
        F.min("conv_id").alias("conv_id"), F.first("rows").alias("n_rows"), F.count(F.lit(1)).alias("n_same"))
    inner = hashes.where("not last").select("h1", "h2").distinct()
    return whole.join(inner, ["h1", "h2"], "left_anti").select("conv_id", "n_rows", "n_same")


def rendered(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_rows, n_same, text: kept conversations in chat markup, PART turn numbers a row.

    Parts in order, joined, are the whole conversation; usual ones have part 0 only.
    A null role or text is rendered empty; rows of one turn stand in the order of role
    and text. An empty table gives no rows.
    """
    kept = checkpointed(maximal_conversations(conversations))
    rows = _clean(conversations).join(kept, "conv_id").withColumn("part", _block(PART))
    line = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
        lambda r: F.concat(F.lit("<|"), r["role"], F.lit("|>\n"), r["text"], F.lit("<|end|>\n")))
    return rows.groupBy("conv_id", "part").agg(
        F.first("n_rows").alias("n_rows"), F.first("n_same").alias("n_same"), F.array_join(line, "").alias("text"))


RENDERED_SQL = f"""WITH r AS (SELECT conv_id, coalesce(turn, {FIRST}) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, turn, count(*) AS n, string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY role, text) AS body
    FROM r GROUP BY ALL),
p AS (SELECT conv_id, turn, turn = max(turn) OVER (PARTITION BY conv_id) AS last, sum(n) OVER (PARTITION BY conv_id) AS n_rows,
    md5(string_agg(turn || ':' || length(body) || ':' || body, '' ) OVER (PARTITION BY conv_id ORDER BY turn)) AS prefix FROM t),
k AS (SELECT min(conv_id) AS conv_id, any_value(n_rows)::BIGINT AS n_rows, count(*) AS n_same FROM p WHERE last
    AND prefix NOT IN (SELECT prefix FROM p WHERE NOT last) GROUP BY prefix)
SELECT conv_id, floor(turn / {PART})::BIGINT AS part, n_rows, n_same,
    string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS text
FROM r JOIN k USING (conv_id) GROUP BY ALL"""
