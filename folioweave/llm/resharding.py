"""Resharding by minimum-cost flow: new shard sizes with the fewest bytes moved, only affected files rewritten.

A layout is a folder of Parquet files, <path>/shard=S/block=B/, in which each row knows
its size. A block holds what some of the writing tasks put into a shard; there are at
most BLOCKS of them to a shard, so a table of block sizes has a bound that does not
depend on the rows.

Bytes are sent from old shards to new ones by a minimum-cost flow: a byte that stays
costs nothing, one that moves costs one (or what a matrix of the caller says). Rows
larger than a small part of a shard, of which there are few at any size of the corpus,
are placed first, one by one, and the flow is solved again for the rest. Flows are then
cut out of the shards block by block; the few blocks at a border of two flows are cut
between rows. Blocks that stay whole are not read again: their files are part of the
new layout as they are.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioweave.llm.common import free_names, stored
from folioweave.session import shared_dir

BLOCKS = 1024   # blocks of a shard at most
HEAVY = 4096    # a row is placed on its own if it has more than this part of the mean new shard


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[int]]) -> list[list[int]]:
    """flow[i][j]: how much of supply i goes to j, all of it, within the capacities, at the least total cost.

    Successive shortest paths with potentials, over the sources and sinks only: an
    augmenting path alternates between sending more from i to j and taking back what j
    got from another i.
    """
    rows, cols = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities are too small")
    flow = [[0] * cols for _ in range(rows)]
    left, room = list(supply), list(capacity)
    lift = [0] * rows + [min((cost[i][j] for i in range(rows)), default=0) for j in range(cols)]
    while any(left):
        far = [None] * (rows + cols)
        came = [-1] * (rows + cols)
        queue = [(0, i) for i in range(rows) if left[i]]
        for _, i in queue:
            far[i] = 0
        # costs are reduced by the distances of earlier rounds, which keeps them from being negative
        heapq.heapify(queue)
        done = [False] * (rows + cols)
        while queue:
            d, u = heapq.heappop(queue)
            if done[u]:
                continue
            done[u] = True
            if u < rows:
                steps = [(rows + j, cost[u][j] + lift[u] - lift[rows + j]) for j in range(cols)]
            else:
                steps = [(i, -cost[i][u - rows] + lift[u] - lift[i]) for i in range(rows) if flow[i][u - rows]]
            for v, w in steps:
                if far[v] is None or d + w < far[v]:
                    far[v], came[v] = d + w, u
                    heapq.heappush(queue, (d + w, v))
        ends = [rows + j for j in range(cols) if room[j] and far[rows + j] is not None]
        end = min(ends, key=lambda v: (far[v] + lift[v], v))
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        path.reverse()
        back = [flow[v][u - rows] for u, v in zip(path, path[1:]) if u >= rows]
        amount = min([left[path[0]], room[end - rows], *back])
        for u, v in zip(path, path[1:]):
            if u < rows:
                flow[u][v - rows] += amount
            else:
                flow[v][u - rows] -= amount
        left[path[0]] -= amount
        room[end - rows] -= amount
        reach = max(x for x in far if x is not None)
        lift = [x + (reach if f is None else f) for x, f in zip(lift, far)]
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def moving_costs(old: int, new: int) -> list[list[int]]:
    """Nothing for what stays, one for each byte that moves."""
    return [[int(i != j) for j in range(new)] for i in range(old)]


def _levelled(capacity: list[int], taken: list[int], need: int) -> list[int]:
    """Capacities left beside what is taken, cut down together until they hold exactly `need`."""
    room = [max(0, c - t) for c, t in zip(capacity, taken)]
    spare = sum(room) - need
    while spare > 0:
        open_ = [j for j, r in enumerate(room) if r]
        for j in open_:
            part = min(room[j], max(1, spare // len(open_)), spare)
            room[j] -= part
            spare -= part
    return room


@dataclass
class Plan:
    """Where the rows go. All lists have a bounded length: shards times BLOCKS, shards times HEAVY."""

    heavy: list[tuple[str, int, int]]            # file, row in it, new shard
    whole: list[tuple[int, int, int]]            # old shard, block, new shard
    cut: list[tuple[int, int, int, int]]         # old shard, block, byte after the piece, new shard; piece by piece
    moved: int                                   # bytes whose shard changes
    touched: list[tuple[int, int]]               # (old shard, block) to write again


def plan_moves(blocks: list[tuple[int, int, int]], heavy: list[tuple[int, int, str, int, int]], old: int, new: int,
               cost: Sequence[Sequence[int]] | None = None, capacity: Sequence[int] | None = None) -> Plan:
    """Blocks (shard, block, bytes without heavy rows) and heavy rows (shard, block, file, row, bytes) dealt to the new shards.

    Heavy rows stay where they fit, the largest first; the others go where, beside what
    can stay there, most is free. The flow then deals the rest of the bytes.
    """
    cost = cost or moving_costs(old, new)
    light = [0] * old
    for s, _, n in blocks:
        light[s] += n
    sizes = list(light)
    for s, _, _, _, n in heavy:
        sizes[s] += n
    capacity = list(capacity) if capacity is not None else equal_capacities(sum(sizes), new)
    if sum(capacity) < sum(sizes):
        raise ValueError("the capacities are too small")
    taken, moved, placed, touched = [0] * new, 0, [], set()
    free = [c - min(c, sizes[j] if j < old else 0) for j, c in enumerate(capacity)]
    for s, b, file, row, n in sorted(heavy, key=lambda h: (-h[4], h[0], h[2], h[3])):
        if s < new and taken[s] + n <= capacity[s]:
            to = s
        else:
            to = min(range(new), key=lambda j: (free[j] < n, cost[s][j] if free[j] >= n else 0, -free[j], j))
            free[to] -= n
            touched.add((s, b))
            moved += n * (to != s)
        taken[to] += n
        placed.append((file, row, to))
    flow = min_cost_flow(light, _levelled(capacity, taken, sum(light)), cost)
    whole, cut = [], []
    by_shard: list[list[tuple[int, int]]] = [[] for _ in range(old)]
    for s, b, n in sorted(blocks):
        by_shard[s].append((b, n))
    for s in range(old):
        # what stays comes first, then the new shards in turn
        turns = [[to, flow[s][to]] for to in sorted(range(new), key=lambda j: (j != s, j)) if flow[s][to]]
        moved += sum(n for to, n in turns if to != s)
        for b, n in by_shard[s]:
            if n and turns[0][1] >= n:
                whole.append((s, b, turns[0][0]))
            at = 0
            while at < n:
                to, have = turns[0]
                part = min(have, n - at)
                if part < n:
                    cut.append((s, b, at + part, to))
                if part < n or to != s:
                    touched.add((s, b))
                at += part
                turns[0][1] -= part
                if not turns[0][1]:
                    turns.pop(0)
    return Plan(placed, whole, cut, moved, sorted(touched))


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text, none for null, and one for the row."""
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("bigint") + 1


@dataclass
class Layout:
    """Files of one generation: folders, each with the (shard, block) pairs of it that count (None: all)."""

    spark: SparkSession
    schema: T.StructType  # of the rows
    shards: int
    parts: list[tuple[str, list[tuple[int, int]] | None]]
    moved: int = 0        # bytes that changed their shard on the way to this generation
    rewritten: int = 0    # blocks that were written again

    def names(self) -> list[str]:
        """What the files call a row's size, its shard and its block: as no column of the rows is called."""
        return free_names(self.schema.names, "shard_bytes", "shard", "block")

    def rows(self, *columns: Column) -> DataFrame:
        """doc (a struct of the given columns, or of all), size, shard, block, part, file, row.

        `part` numbers the folder, `file` and `row` say where the row lies.
        """
        size, shard, block = self.names()
        schema = T.StructType([*self.schema.fields, T.StructField(size, T.LongType()), T.StructField(shard, T.IntegerType()),
                               T.StructField(block, T.IntegerType())])
        doc = F.struct(*(columns or [F.col(f"`{c}`") for c in self.schema.names]))
        out = None
        for part, (path, keep) in enumerate(self.parts):
            one = self.spark.read.schema(schema).parquet(path)
            if keep is not None:  # a filter on folders: others are not opened
                one = one.where(_among(keep, shard, block))
            one = one.select(doc.alias("doc"), F.col(size).alias("size"), F.col(shard).alias("shard"), F.col(block).alias("block"),
                             F.lit(part).alias("part"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
            out = one if out is None else out.unionByName(one)
        return out

    def slots(self, *columns: Column) -> DataFrame:
        """doc (as in `rows`), size, shard, slot: the row's number within its shard, from 0, without gaps.

        A row's slot is its place in its file behind the rows of the files before it; so
        rows are not sorted, and windows see one row per file or per block only.
        """
        files = self.rows(F.lit(0).alias("none")).groupBy("shard", "part", "block", "file").agg(F.count(F.lit(1)).alias("n"))
        inside = Window.partitionBy("shard", "part", "block").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        before = Window.partitionBy("shard").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
        files = stored(files.withColumn("in_block", F.coalesce(F.sum("n").over(inside), F.lit(0))), "layout-files")
        starts = files.groupBy("shard", "part", "block").agg(F.sum("n").alias("n")).select(
            "shard", "part", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("block_start"))
        places = files.join(starts, ["shard", "part", "block"]).select("file", (F.col("block_start") + F.col("in_block")).alias("start"))
        places = stored(places, "layout-starts")  # one row per file; from its size the planner decides how to join
        return self.rows(*columns).select("doc", "size", "shard", "file", "row").join(places, "file").select(
            "doc", "size", "shard", (F.col("start") + F.col("row")).alias("slot"))


def _among(pairs: Sequence[tuple[int, int]], shard: str = "shard", block: str = "block") -> Column:
    """Whether (shard, block) is one of the pairs, as a filter on folders."""
    by: dict[int, list[int]] = {}
    for s, b in pairs:
        by.setdefault(s, []).append(b)
    out = F.lit(False)
    for s, blocks in sorted(by.items()):
        out = out | ((F.col(shard) == s) & F.col(block).isin(sorted(blocks)))
    return out


def _written(layout: Layout, rows: DataFrame, path: str) -> None:
    """doc, size, shard as files below <path>/shard=S/block=B; nothing is shuffled."""
    size, shard, block = layout.names()
    rows.select(*[F.col("doc").getField(c).alias(c) for c in layout.schema.names], F.col("size").alias(size),
                F.col("shard").cast("int").alias(shard), (F.spark_partition_id() % BLOCKS).alias(block)).write.partitionBy(
        shard, block).parquet(path)


def write_layout(docs: DataFrame, path: str, shard: Column, shards: int) -> Layout:
    """Rows laid out below `path` by a column of shard numbers (null: 0); `docs` needs a column text."""
    layout = Layout(docs.sparkSession, docs.schema, shards, [(path, None)])
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    _written(layout, docs.select(whole.alias("doc"), byte_size(F.col("text")).alias("size"),
                                 F.coalesce(shard.cast("int"), F.lit(0)).alias("shard")), path)
    return layout


def reshard(layout: Layout, new: int, cost: Sequence[Sequence[int]] | None = None, capacity: Sequence[int] | None = None) -> Layout:
    """The layout in `new` shards, of equal bytes unless `capacity` says otherwise, with the least bytes moved.

    One narrow pass sums up blocks and finds heavy rows, the flow is solved on the
    driver, one pass reads the affected blocks and writes them anew. Other files become
    part of the result as they are; nothing is deleted or changed, so a failed attempt
    leaves the old generation whole. The layout must lie in one folder.
    """
    if len(layout.parts) != 1 or new < 1:
        raise ValueError("a layout of one folder can be dealt to one shard or more")
    spark, (path, _) = layout.spark, layout.parts[0]
    narrow = layout.rows(F.lit(0).alias("none")).drop("doc")
    total = narrow.agg(F.sum("size").alias("n")).first()["n"] or 0
    line = max(1, total // (new * HEAVY))
    # at most `new` * HEAVY rows can have more bytes than this
    heavy = [tuple(r) for r in narrow.where(F.col("size") > line).select("shard", "block", "file", "row", "size").collect()]
    blocks = [tuple(r) for r in narrow.groupBy("shard", "block").agg(
        F.sum(F.when(F.col("size") <= line, F.col("size")).otherwise(0)).alias("n")).collect()]  # at most shards * BLOCKS
    old = max([layout.shards, *(s + 1 for s, _, _ in blocks)])
    plan = plan_moves(blocks, heavy, old, new, cost, capacity)
    if not plan.touched:
        return Layout(spark, layout.schema, new, layout.parts)

    touched = set(plan.touched)
    ways = _ways(spark, plan, touched, narrow.where(F.col("size") <= line))
    some = layout.rows().where(_among(plan.touched)).join(
        F.broadcast(ways), ["shard", "block"], "left").where(
        "from_file is null or struct(file, row) >= struct(from_file, from_row)").where(
        "upto_file is null or struct(file, row) < struct(upto_file, upto_row)")
    if plan.heavy:
        own = spark.createDataFrame(plan.heavy, "file string, row bigint, own int")  # at most `new` * HEAVY rows
        some = some.join(F.broadcast(own), ["file", "row"], "left")
    else:
        some = some.withColumn("own", F.lit(None).cast("int"))
    there = shared_dir(spark, "reshard")
    _written(layout, some.select("doc", "size", F.coalesce("own", "way", "shard").alias("shard")), there)
    kept = sorted({(s, b) for s, b, _ in blocks} - touched)
    return Layout(spark, layout.schema, new, [(path, kept), (there, None)], plan.moved, len(touched))


def _ways(spark: SparkSession, plan: Plan, touched: set[tuple[int, int]], light: DataFrame) -> DataFrame:
    """shard, block, from (file, row), upto (file, row), way: one row per affected block or piece of one.

    A block is cut where the running sum of its light rows, in file order, passes the
    end of a piece; the middle of a row decides. Only blocks that are cut are summed.
    """
    rows = [(s, b, None, None, None, None, to) for s, b, to in plan.whole if (s, b) in touched]
    if plan.cut:
        ends = spark.createDataFrame([(s, b, n) for s, b, n, _ in plan.cut], "shard int, block int, end bigint")  # a few for each flow
        upto = Window.partitionBy("shard", "block").orderBy("file", "row").rowsBetween(Window.unboundedPreceding, 0)
        summed = light.where(_among(sorted({(s, b) for s, b, *_ in plan.cut}))).withColumn(
            "mid", F.sum("size").over(upto) - F.expr("size div 2") - 1)
        first = {(r["shard"], r["block"], r["end"]): (r["at"]["file"], r["at"]["row"]) for r in summed.join(
            F.broadcast(ends), ["shard", "block"]).where("mid >= end").groupBy("shard", "block", "end").agg(
            F.min(F.struct("file", "row")).alias("at")).collect()}
        before, at = None, None
        for s, b, end, to in plan.cut:
            at = at if before == (s, b) else (None, None)
            stop = first.get((s, b, end), (None, None))
            if at != (None, None) or before != (s, b):
                rows.append((s, b, *at, *stop, to))
            before, at = (s, b), stop
    return spark.createDataFrame(rows, "shard int, block int, from_file string, from_row bigint, upto_file string, upto_row bigint, way int")


OLD_SHARDS = 6
NEW_SHARDS = 8


def old_shard(source: Column, shards: int = OLD_SHARDS) -> Column:
    """Shard of a document before: by its source, so that sizes are uneven."""
    return (F.crc32(F.coalesce(source.cast("string"), F.lit("")).cast("binary")) % shards).cast("int")


def resharded(docs: DataFrame, path: str, new: int = NEW_SHARDS) -> Layout:
    """`docs` laid out by source below `path` and dealt anew to `new` shards of equal bytes.

    Rows count as often as they occur; null and empty texts are rows of one byte. Rows
    without a source lie in the shard of the empty name. An empty table gives no rows.
    Columns may have any names.
    """
    source = F.col("source") if "source" in docs.columns else F.lit("")
    return reshard(write_layout(docs, path, old_shard(source), OLD_SHARDS), new)
