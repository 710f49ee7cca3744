"""Streaming jobs, run over what is there and then stopped."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioweave.catalog.common import table
from folioweave.catalog.documents import R_STATS, rounded
from folioweave.catalog.markup import SQL_RESULTS, SQL_VISIBLE
from folioweave.operators.markup import html_to_text
from folioweave.plans.pages import pages_to_results
from folioweave.session import shared_dir
from folioweave.sources.files import scan_corpus_stream
from folioweave.sources.files import write_observed as write_metrics
from folioweave.streaming import jobs


def _table_stream(s, d, name):
    """A table as a stream, be it one file or a folder of files; a pattern, as the plain path of a stream has to be a folder."""
    return s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _events_stream(s, d):
    """The event table as a stream; ts becomes a zoned timestamp, as watermarks need."""
    return _table_stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def convert_stream(s, d):
    out = shared_dir(s, "converted")
    keyed = _table_stream(s, d, "pages").withColumn("doc_id", F.col("page_id"))
    q = jobs.convert_stream(keyed, f"{out}/results", f"{out}/checkpoint", lambda df: pages_to_results(df.drop("doc_id")))
    q.awaitTermination()
    return jobs.read_results(s, f"{out}/results").select("doc_id", "title", "total_links", "total_words", F.md5("markdown").alias("markdown_md5"))


def job_events(df):
    kind = F.col("event_type")
    status = (F.when(kind == "view", "pending").when(kind == "click", "processing").when(kind == "error", "failed")
              .when(kind == "purchase", "completed").otherwise("processing"))
    return df.select((F.floor(F.col("event_id") / 4)).cast("bigint").alias("job_id"), status.alias("status"), F.col("value").alias("progress"),
                     F.col("props").alias("message"), "ts")


def job_status(s, d):
    """Latest state per job from the stream; complete mode, so the sink holds the whole state."""
    name = "job_" + shared_dir(s, "x").rsplit("-", 1)[1]
    out = shared_dir(s, "jobs")

    def put(df, batch_id):
        df.write.mode("overwrite").parquet(f"{out}/{name}")

    (jobs.job_status(job_events(_events_stream(s, d))).writeStream.outputMode("complete").foreachBatch(put)
     .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    return s.read.parquet(f"{out}/{name}").select("job_id", "status", "progress", "message")


SQL_JOBS = """WITH j AS (SELECT event_id // 4 AS job_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'processing' END AS status,
  value AS progress, props AS message, ts FROM events)
SELECT job_id, status, progress, message FROM j
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY CASE status WHEN 'pending' THEN 0 WHEN 'processing' THEN 1 ELSE 2 END DESC, ts DESC, status DESC, progress DESC, message DESC) = 1"""


def job_transitions(s, d):
    """Events in three micro-batches, dealt so that many come late: each accepted or rejected by the state of its job."""
    out = shared_dir(s, "machine")
    e = job_events(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn(
        "nth", F.row_number().over(Window.partitionBy("job_id").orderBy("ts", "status", "progress", "message")) % 3)
    e.write.partitionBy("nth").parquet(f"{out}/dealt")
    dealt = s.read.schema(e.schema).parquet(f"{out}/dealt")
    for batch in (1, 2, 0):  # the stream goes on with the files that have come, however many, as one micro-batch
        dealt.where(F.col("nth") == batch).drop("nth").write.mode("append").parquet(f"{out}/in")
        q = jobs.job_transitions(jobs.stream_pages(s, f"{out}/in"), 400 * 24 * 3600 * 1000).writeStream.outputMode("update").foreachBatch(
            lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")).option("checkpointLocation", f"{out}/checkpoint")
        q.trigger(availableNow=True).start().awaitTermination()
    return s.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows").select("job_id", "status", "progress", "message", "rejected")


SQL_MACHINE = """WITH RECURSIVE j AS (SELECT event_id // 4 AS job_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'processing' END AS status,
  value AS progress, props AS message, ts FROM events),
n AS (SELECT *, CASE status WHEN 'pending' THEN 0 WHEN 'processing' THEN 1 ELSE 2 END AS rank, (row_number() OVER (PARTITION BY job_id ORDER BY ts, status, progress, message) + 2) % 3 AS batch FROM j),
o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY batch, ts, rank, progress, message) AS nth FROM n),
m AS (SELECT o.*, NULL::VARCHAR AS rejected, rank AS at_rank, ts AS at_ts FROM o WHERE nth = 1
  UNION ALL SELECT o.*, CASE WHEN m.at_rank >= 2 THEN 'ended' WHEN o.rank < m.at_rank THEN 'backward' WHEN o.ts < m.at_ts THEN 'late' END,
    CASE WHEN m.at_rank >= 2 OR o.rank < m.at_rank OR o.ts < m.at_ts THEN m.at_rank ELSE o.rank END, CASE WHEN m.at_rank >= 2 OR o.rank < m.at_rank OR o.ts < m.at_ts THEN m.at_ts ELSE o.ts END
  FROM m JOIN o ON o.job_id = m.job_id AND o.nth = m.nth + 1)
SELECT job_id, status, progress, message, rejected FROM m"""


def convert_contents(s, d):
    """Pages, then the same pages under other numbers, then changed versions of some, in three micro-batches; conversions that ran."""
    out = shared_dir(s, "contents")
    p = table(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("content"))
    arrivals = (p, p.withColumn("doc_id", F.col("doc_id") + 1_000_000),
                p.where("doc_id % 10 = 0").withColumn("content", F.concat("content", F.lit("<p>changed</p>"))))
    for part in arrivals:  # files are taken in the order of their time
        part.coalesce(1).write.mode("append").parquet(f"{out}/in")

    def convert(df):
        texts = html_to_text(df.select(F.col("content_hash").alias("page_id"), F.col("content").alias("html")))
        return texts.select(F.col("page_id").alias("content_hash"), F.md5("text").alias("text_md5"))

    for q in jobs.convert_contents(jobs.stream_pages(s, f"{out}/in", 1), out, convert):
        q.awaitTermination()
    ran = s.read.parquet(f"{out}/results").agg(F.count(F.lit(1)).alias("conversions"))
    return jobs.current_results(s, out).select("doc_id", "text_md5").join(ran).select("doc_id", "text_md5", "conversions")


SQL_CONTENTS = f"""WITH v AS (SELECT page_id AS doc_id, html, 0 AS n FROM pages UNION ALL SELECT page_id + 1000000, html, 1 FROM pages UNION ALL SELECT page_id, html || '<p>changed</p>', 2 FROM pages WHERE page_id % 10 = 0),
w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1), pages AS (SELECT doc_id AS page_id, html FROM w)
SELECT page_id AS doc_id, md5(text) AS text_md5, (SELECT count(DISTINCT html) FROM v) AS conversions FROM (SELECT page_id, {SQL_VISIBLE} AS text FROM pages)"""


def dedup_ttl(s, d):
    """Users seen in the stream, each once: the data arrives in one batch, so no state expires in between."""
    out = shared_dir(s, "dedup")
    one = jobs.dedup_ttl(_events_stream(s, d).select("user_id", "ts"), ["user_id"], "ts", "24 hours")
    jobs.run_available(one.select("user_id"), f"{out}/rows", f"{out}/checkpoint")
    return s.read.parquet(f"{out}/rows")


def perf_window(s, d):
    """Windows closed by the watermark; the last ones stay open, as in any stream."""
    out = shared_dir(s, "perf")
    e = _events_stream(s, d).select(F.col("event_type").alias("operation"), F.col("value").alias("duration"), "ts")
    jobs.run_available(jobs.perf_window(e, "1 day", "1 hour"), f"{out}/rows", f"{out}/checkpoint")
    r = s.read.parquet(f"{out}/rows")
    return rounded(r.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "operation", "count", "total", "avg", "min", "max"), "total", "avg")


SQL_PERF = f"""WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS operation, {R_STATS}
FROM events, m WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= mark GROUP BY 1, 2"""


def scan_stream(s, d):
    """The given Parquet files arriving as binary files."""
    out = shared_dir(s, "files")
    f = scan_corpus_stream(s, d, "*.parquet").select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")
    jobs.run_available(f, f"{out}/rows", f"{out}/checkpoint")
    return s.read.parquet(f"{out}/rows")


def expire_table(s, d):
    """Write events as results, drop what is older than ten days, read back what stays."""
    out = shared_dir(s, "expire")
    table(s, d, "events").select("event_id", F.col("ts").alias("converted_at")).write.parquet(f"{out}/all")
    jobs.expire_table(s, f"{out}/all", f"{out}/kept", "2024-01-20 00:00:00", 240)
    return s.read.parquet(f"{out}/kept").select("event_id")


def expire_dated(s, d):
    """The same by days: old ones dropped whole, the day of the limit written again."""
    out = shared_dir(s, "dated")
    jobs.write_dated(table(s, d, "events").select("event_id", F.col("ts").alias("converted_at")), out)
    jobs.expire_dated(s, out, "2024-01-20 07:30:00", 240)
    return s.read.parquet(out).select("event_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


def write_observed(s, d):
    """Rows of three writes as the metrics table has them, counted on the way."""
    out = shared_dir(s, "observed")
    for kind in ("view", "click", "error"):
        rows = table(s, d, "events").where(F.col("event_type") == kind)
        write_metrics(rows, f"{out}/{kind}", f"{out}/metrics", "write", {"kind": kind})
    return s.read.parquet(f"{out}/metrics").select("operation", F.col("attrs")["kind"].alias("kind"), F.col("attrs")["rows"].cast("bigint").alias("n"))


QUERIES = {
    "job_transitions": (job_transitions, SQL_MACHINE),
    "convert_contents": (convert_contents, SQL_CONTENTS),
    "expire_dated": (expire_dated, "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE ts >= TIMESTAMP '2024-01-20 07:30:00' - INTERVAL 240 HOUR"),
    "write_observed": (write_observed, "SELECT 'write' AS operation, event_type AS kind, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY event_type"),
    "convert_stream": (convert_stream, f"SELECT doc_id, title, total_links, total_words, md5(markdown) AS markdown_md5 FROM ({SQL_RESULTS})"),
    "job_status": (job_status, SQL_JOBS),
    "dedup_ttl": (dedup_ttl, "SELECT DISTINCT user_id FROM events"),
    "perf_window": (perf_window, SQL_PERF),
    "scan_corpus_stream": (scan_stream, None),
    "expire_table": (expire_table, "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 240 HOUR"),
}
