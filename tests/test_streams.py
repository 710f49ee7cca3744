"""Registered streams over tables that are one file or a folder of files."""

import random

import pytest
from pyspark.sql import functions as F

from folioweave.catalog import streams
from folioweave.streaming import jobs

PAGES = [(i, f"http://a.example/{i}", f"<html><head><title>T{i}</title></head><body><p>Text {i}</p></body></html>") for i in range(12)]
EVENTS = [(i, i % 5, "view", float(i), "{}", 86400 * (i // 8)) for i in range(40)]


def _write(df, folder, name, one_file):
    """As a folder of three files, or as a single file beside the others."""
    if not one_file:
        return df.repartition(3).write.parquet(f"{folder}/{name}.parquet")
    import pyarrow.parquet as pq

    pq.write_table(df.toArrow(), f"{folder}/{name}.parquet")


@pytest.mark.parametrize("one_file", [True, False])
def test_streams_read_files_and_folders(spark, tmp_path, one_file):
    d = str(tmp_path)
    _write(spark.createDataFrame(PAGES, "page_id long, url string, html string"), d, "pages", one_file)
    events = spark.createDataFrame(EVENTS, "event_id long, user_id long, event_type string, value double, props string, t long")
    _write(events.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).drop("t"), d, "events", one_file)
    got = streams.convert_stream(spark, d).collect()
    assert sorted((r.doc_id, r.title) for r in got) == [(i, f"T{i}") for i in range(12)]
    assert sorted(r.user_id for r in streams.dedup_ttl(spark, d).collect()) == list(range(5))
    assert sum(r["count"] for r in streams.perf_window(spark, d).collect()) == 24  # windows the watermark has not passed stay open
    assert {r.job_id for r in streams.job_status(spark, d).collect()} == set(range(10))


def _one_by_one(batches):
    """The state machine event by event."""
    state, out = {}, []
    for rows in batches:
        for j, status, progress, message, us in sorted(rows, key=lambda r: (r[0], r[4], jobs.STATUS_RANK.get(r[1], -1), r[2] is None, r[2] or 0, r[3])):
            rank, now = jobs.STATUS_RANK.get(status, -1), state.get(j, (-1, -1))
            why = ("unknown" if rank < 0 else "ended" if now[0] >= 2 else "backward" if rank < now[0] else "late" if us < now[1] else None)
            if why is None:
                state[j] = (rank, us)
            out.append((j, status, progress, message, us, why))
    return sorted(out, key=repr)


def test_job_machine_judges_groups_of_jobs(spark, tmp_path):
    """Many jobs of one group, several files a micro-batch, null values: as judged event by event."""
    rnd = random.Random(7)
    kinds = ["pending"] * 4 + ["processing"] * 4 + ["completed", "failed", "odd", None]
    batches = [[(rnd.choice([5, 2**61 + 1, -3, *range(20)]), rnd.choice(kinds), rnd.choice([None, 0.5, 1.0]), f"m{b}-{n}", 1_700_000_000_000_000 + rnd.randrange(10**9))
                for n in range(90)] for b in range(4)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, "job_id long, status string, progress double, message string, us long").select(
            "job_id", "status", "progress", "message", F.timestamp_micros("us").alias("ts")).repartition(3).write.mode("append").parquet(src)
        q = jobs.job_transitions(jobs.stream_pages(spark, src), 400 * 24 * 3600 * 1000, groups=3).writeStream.outputMode("update").foreachBatch(
            lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(240)
    got = spark.read.parquet(out).select("job_id", "status", "progress", "message", F.unix_micros("ts"), "rejected").collect()
    assert sorted((tuple(r) for r in got), key=repr) == _one_by_one(batches)
