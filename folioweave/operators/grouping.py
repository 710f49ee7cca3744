"""Group statistics and running numbers that survive hot groups.

A plain window over a group sends the whole group to one task. Here every group
is cut into blocks by a value of its rows (page number, row number, ...): rows
are only ever grouped by (keys, block), and the window that spans a group runs
over one narrow row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def block_of(c, size: int = BLOCK) -> Column:
    """Block number of an integer column."""
    return F.floor((F.col(c) if isinstance(c, str) else c) / size).cast("bigint")


def with_group_stats(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    stats: dict[str, tuple[Callable[[Column], Column], Column]],
    keep: str | None = None,
) -> DataFrame:
    """Add per-group values; each stat is (decomposable aggregate, expression).

    With `keep` the block stays as a column of that name, and an aggregate over
    (keys, block) that follows needs no shuffle of its own.
    """
    name_of = keep or "_block"
    tagged = df.withColumn(name_of, block)
    cut = [*keys, name_of]
    partial = tagged.groupBy(*cut).agg(*[fn(e).alias(name) for name, (fn, e) in stats.items()])
    w = Window.partitionBy(*keys)
    totals = partial.select(*cut, *[fn(F.col(n)).over(w).alias(n) for n, (fn, _) in stats.items()])
    joined = tagged.join(totals, cut)
    return joined if keep else joined.drop(name_of)


def running_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: Sequence[Column], name: str,
    total: str | None = None,
) -> DataFrame:
    """0-based number of each row within its group, in `order`; `total` adds the group's size.

    `blocks` must not decrease along `order`; rows of one block meet in one task,
    a whole group never does.
    """
    names = [f"_b{i}" for i in range(len(blocks))]
    tagged = df.select("*", *[b.alias(n) for b, n in zip(blocks, names)])
    cut = [*keys, *names]
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*keys)
    extra = [F.sum("_n").over(group).alias(total)] if total else []
    starts = (
        tagged.groupBy(*cut).agg(F.count(F.lit(1)).alias("_n"))
        .select(*cut, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), *extra)
    )
    local = F.row_number().over(Window.partitionBy(*cut).orderBy(*order))
    return (
        tagged.withColumn("_local", local).join(starts, cut)
        .withColumn(name, (F.col("_start") + F.col("_local") - 1).cast("bigint"))
        .drop("_local", "_start", *names)
    )
