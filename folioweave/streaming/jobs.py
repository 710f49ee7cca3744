"""Streams: conversion as documents arrive, job states, timing windows, expiry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioweave.operators.reuse import live_results

# Rank of a job state: terminal states win over anything that arrives late.
STATUS_RANK = {"pending": 0, "processing": 1, "completed": 2, "failed": 2}


def stream_pages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet page files as a stream, with the schema of what is already there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def convert_stream(
    stream: DataFrame, results_path: str, checkpoint: str, convert: Callable[[DataFrame], DataFrame],
    key: str = "doc_id",
) -> StreamingQuery:
    """Convert new rows as they arrive and append the results; nothing is converted twice.

    Each micro-batch writes its own partition of the results and replaces it when
    the batch is replayed after a failure. Rows whose key earlier batches have
    already produced are left out before conversion.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, batch_id: int) -> None:
        target = f"{results_path}/batch={batch_id}"
        fresh = df.dropDuplicates([key])
        if batch_id > 0:
            done = spark.read.option("basePath", results_path).parquet(results_path)
            # a replayed batch must not see its own earlier output
            fresh = fresh.join(done.where(F.col("batch") < batch_id).select(key), key, "left_anti")
        convert(fresh).write.mode("overwrite").parquet(target)

    return (
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_results(spark: SparkSession, results_path: str) -> DataFrame:
    return spark.read.option("basePath", results_path).parquet(results_path).drop("batch")


# ---------------------------------------------------------------- conversion by content


def _keyed_states(spark: SparkSession) -> None:
    """State on disk, key by key: a micro-batch touches the keys it has, however many there are."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _first_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each hash among a task's rows, so that copies of one content do not all travel."""
    seen: set[str] = set()
    for b in batches:
        stay = []
        for h in b.column(0).to_pylist():
            stay.append(h not in seen)
            seen.add(h)
        yield b.filter(pa.array(stay, pa.bool_()))


def convert_contents(
    stream: DataFrame, root: str, convert: Callable[[DataFrame], DataFrame], key: str = "doc_id", content: str = "content", config: str = "",
) -> list[StreamingQuery]:
    """Convert each distinct content once, whatever documents hold it; two streams below `root`.

    `versions` gets (key, content_hash) of every row that arrives, `results` what
    `convert` makes of (content_hash, <content>). Whether a content was converted before
    is a look-up in the state store, so a micro-batch costs its own rows only; copies
    within a task go before the shuffle. A changed document is a new content and is
    converted; a known content under a new key is not. `config` tells settings apart.
    A replayed micro-batch replaces its own rows. Rows without content make no version.
    """
    spark = stream.sparkSession
    _keyed_states(spark)
    keyed = stream.where(F.col(content).isNotNull()).select(
        F.sha2(F.concat(F.lit(config), F.lit(":"), F.col(content)), 256).alias("content_hash"), key, content)

    def put(name: str, make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        return lambda df, batch: make(df).write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")

    rows = keyed.select("content_hash", content)
    once = rows.mapInArrow(_first_in_task, rows.schema).dropDuplicates(["content_hash"])
    parts = (("versions", keyed.select(key, "content_hash"), lambda df: df), ("results", once, convert))
    return [df.writeStream.foreachBatch(put(name, make)).option("checkpointLocation", f"{root}/checkpoint-{name}").trigger(availableNow=True).start()
            for name, df, make in parts]


def current_results(spark: SparkSession, root: str, key: str = "doc_id") -> DataFrame:
    """The result of every document's newest version."""
    versions = spark.read.option("basePath", f"{root}/versions").parquet(f"{root}/versions")
    newest = versions.groupBy(key).agg(F.max(F.struct("batch", "content_hash"))["content_hash"].alias("content_hash"))
    results = spark.read.option("basePath", f"{root}/results").parquet(f"{root}/results").drop("batch")
    return newest.join(results, "content_hash")


# ---------------------------------------------------------------- job states


def _ranked(status: Column) -> Column:
    chain = None
    for name, rank in STATUS_RANK.items():
        chain = F.when(status == name, rank) if chain is None else chain.when(status == name, rank)
    return chain.otherwise(-1)


def job_status(events: DataFrame) -> DataFrame:
    """Latest state per job from (job_id, status, progress, message, ts); batch or stream.

    A terminal state is not undone by an event that arrives or was written later.
    """
    rank = _ranked(F.col("status"))
    newest = F.max(F.struct(rank.alias("rank"), F.col("ts"), F.col("status"), F.col("progress"), F.col("message")))
    return events.groupBy("job_id").agg(newest.alias("s")).select(
        "job_id", "s.status", "s.progress", "s.message", "s.ts")


def _judge(ttl_ms: int) -> Callable:
    """The state machine of a group of jobs, as a function of their events and their state: per job rank and time of the last
    accepted event and when the state may go.

    Events are sorted by time, so the state before an event has the highest rank of the job's state and of its earlier events of
    the micro-batch that are not older than that state: all jobs are judged at once.
    """

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        jobs = pd.DataFrame(dict(zip(_STATE, state.get if state.exists else [[]] * 4)), dtype="int64").set_index("job")
        if not state.hasTimedOut:
            events = pd.concat(list(rows), ignore_index=True)
            events = events.sort_values(["job_id", "us", "rank", "progress", "message"], ignore_index=True)
            job, us, rank = (events[c].to_numpy("int64") for c in ("job_id", "us", "rank"))
            before = jobs.reindex(job)
            at_rank = before["rank"].fillna(-1).to_numpy("int64")
            known = ~before["rank"].isna().to_numpy()
            # looked up as whole numbers: microseconds as floats would lose digits
            at_us = np.full(len(job), np.iinfo("int64").min)
            at_us[known] = jobs["us"].loc[job[known]].to_numpy()
            late = us < at_us
            first = np.r_[True, job[1:] != job[:-1]]
            nth = np.cumsum(first)
            # a running maximum that starts anew with each job, as ranks are below 4
            highest = np.maximum.accumulate(nth * 4 + np.where(late, -1, rank) + 1) - nth * 4 - 1
            at_rank = np.maximum(at_rank, np.where(first, -1, np.r_[-1, highest[:-1]]))
            verdicts = np.select([rank < 0, at_rank >= 2, rank < at_rank, late], ["unknown", "ended", "backward", "late"], "")
            rejected = pd.Series(verdicts, dtype=object).where(verdicts != "", None)
            moved = verdicts == ""
            accepted = pd.DataFrame({"job": job[moved], "rank": rank[moved], "us": us[moved]}).groupby("job").last()
            accepted["due"] = 0
            jobs = pd.concat([jobs.loc[~jobs.index.isin(accepted.index)], accepted])
            due = pd.Series(us // 1000 + ttl_ms).groupby(job).max()
            due = due[due.index.isin(jobs.index)]
            jobs.loc[due.index, "due"] = due
            yield events[["job_id", "status", "progress", "message", "us"]].assign(rejected=rejected)
        # as a timeout of its own for each job would
        jobs = jobs[jobs["due"] >= state.getCurrentWatermarkMs()]
        if len(jobs):
            state.update(tuple(c.tolist() for _, c in jobs.reset_index().items()))
            state.setTimeoutTimestamp(int(jobs["due"].min()))
        elif state.exists:
            state.remove()

    return run


_STATE = ("job", "rank", "us", "due")
_VERDICTS = "job_id bigint, status string, progress double, message string, us bigint, rejected string"


def job_transitions(events: DataFrame, ttl_ms: int = 30 * 24 * 3600 * 1000, groups: int = 4096) -> DataFrame:
    """(job_id, status, progress, message, ts, rejected): every event of the stream with why it was rejected, or null.

    A job moves from pending to processing to completed or failed, or stays where it is.
    Rejected are events of unknown status, of a job that has ended, of an earlier state,
    and such as are older than the state. State lies in the state store, four numbers per
    job, and goes when events arrive that are more than twice `ttl_ms` later than the
    job's own. Events more than `ttl_ms` behind the newest are dropped.
    Events of a micro-batch are taken in order of their time; those of a job that earlier
    batches have moved on are judged by its state. The current state of a job is its
    last accepted event.

    Jobs are judged in `groups` groups by the hash of their number, a group at once. A
    micro-batch costs its own rows and the live jobs of the groups they fall into; many
    millions of live jobs ask for more groups. The number holds for the life of a checkpoint.
    """
    _keyed_states(events.sparkSession)
    plain = events.select(F.col("job_id").cast("bigint").alias("job_id"), "status", F.col("progress").cast("double").alias("progress"), "message",
                          F.col("ts").cast("timestamp").alias("ts")).where("job_id is not null and ts is not null").withWatermark(
        "ts", f"{ttl_ms} milliseconds")
    ready = plain.select("*", F.unix_micros("ts").alias("us"), _ranked(F.col("status")).alias("rank"),
                         F.pmod(F.xxhash64("job_id"), F.lit(groups)).alias("job_group"))
    return ready.groupBy("job_group").applyInPandasWithState(
        _judge(ttl_ms), _VERDICTS, "job array<bigint>, rank array<bigint>, us array<bigint>, due array<bigint>", "update",
        GroupStateTimeout.EventTimeTimeout,
    ).select("job_id", "status", "progress", "message", F.timestamp_micros("us").alias("ts"), "rejected")


def dedup_ttl(stream: DataFrame, key: list[str], ts: str, ttl: str = "24 hours") -> DataFrame:
    """Drop rows whose key was seen within the last `ttl` of event time."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(key)


def perf_window(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Timing statistics per tumbling window and operation; rows later than `late` are dropped."""
    return (
        stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "operation")
        .agg(F.count(F.lit(1)).alias("count"), F.sum("duration").alias("total"), F.avg("duration").alias("avg"),
             F.min("duration").alias("min"), F.max("duration").alias("max"))
        .select(F.col("w.start").alias("window_start"), "operation", "count", "total", "avg", "min", "max")
    )


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; the sink is a Parquet table."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def write_dated(results: DataFrame, path: str, ts: str = "converted_at", mode: str = "append") -> None:
    """Results by day, so that old ones go folder by folder."""
    results.withColumn("day", F.to_date(ts)).write.mode(mode).partitionBy("day").parquet(path)


def expire_dated(spark: SparkSession, path: str, now: str, hours: int, ts: str = "converted_at") -> None:
    """Expire entries of a table by day: whole days are dropped, the day of the limit is written again, others are not touched.

    The rewritten day is staged beside the table, and replaces its folder alone. Run
    again after a failure, it does what is left.
    """
    limit = spark.range(1).select((F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(hours)} HOURS")).alias("t")).select(
        F.to_date("t").alias("day"), F.date_format("t", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t")).first()
    table = spark.read.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    for name in names:
        if name.startswith("day=") and name[4:] != "__HIVE_DEFAULT_PARTITION__" and name[4:] < str(limit["day"]):
            fs.delete(hadoop.Path(root, name), True)
    if f"day={limit['day']}" in names:
        staged = f"{path.rstrip('/')}-staged"
        edge = table.where(F.col("day") == F.lit(limit["day"])).where(F.col(ts) >= F.lit(limit["t"]).cast(dict(table.dtypes)[ts]))
        edge.write.mode("overwrite").parquet(staged)
        kept = spark.read.schema(edge.schema).parquet(staged)
        if kept.limit(1).count():
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        else:
            fs.delete(hadoop.Path(root, f"day={limit['day']}"), True)
        fs.delete(hadoop.Path(staged), True)


def expire_table(spark: SparkSession, path: str, target: str, now, hours: int, ts: str = "converted_at") -> None:
    """Write the entries of the results table that have not expired to `target`."""
    live_results(spark.read.parquet(path), now, hours, ts).write.mode("overwrite").parquet(target)
