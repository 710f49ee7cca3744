"""Result reuse: conversions are keyed by (content_hash, config_hash).

The results table holds one row per key. Look-ups are equi-joins against it; a
content that a third of the corpus shares is a hot key on the left side only,
which AQE splits because the right side has a single row for it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave import rules

KEY = ["content_hash", "config_hash"]


def _fresh(now: Column, hours: int, ts: str = "converted_at") -> Column:
    return F.col(ts) >= now - F.expr(f"INTERVAL {int(hours)} HOURS")


def _now(now: datetime | str | None, df: DataFrame, ts: str) -> Column:
    kind = dict(df.dtypes)[ts]
    return F.lit(str(now)).cast(kind) if now is not None else F.current_timestamp().cast(kind)


def cache_hits(df: DataFrame, results: DataFrame, now=None, max_age_hours: int = rules.CACHE_HOURS) -> DataFrame:
    """Documents with an unexpired result, and the newest such result."""
    live = results.where(_fresh(_now(now, results, "converted_at"), max_age_hours))
    rest = [c for c in results.columns if c not in (*KEY, "converted_at")]
    return df.join(latest_result(live, KEY, "converted_at", rest[0]) if rest else live.distinct(), KEY)


def cache_misses(df: DataFrame, results: DataFrame, now=None, max_age_hours: int = rules.CACHE_HOURS) -> DataFrame:
    """Documents that have to be converted now."""
    live = results.where(_fresh(_now(now, results, "converted_at"), max_age_hours))
    return df.join(live.select(*KEY), KEY, "left_anti")


def convert_once(df: DataFrame, content: str, fn: Callable[[DataFrame], DataFrame], key: str = "content_hash") -> DataFrame:
    """Run `fn` on each distinct content and give its result to every copy.

    `fn` maps (content_hash, <content>) to (content_hash, ...). Copies are dropped
    before the shuffle as well as after it; the join back moves only hashes and
    the caller's remaining columns. Rows without content, and those `fn` gives
    nothing for, stay with nulls.
    """
    keyed = df if key in df.columns else df.withColumn(key, F.sha2(F.col(content), 256))
    distinct = keyed.where(F.col(key).isNotNull()).select(key, content).dropDuplicates([key])
    return keyed.drop(content).join(fn(distinct), key, "left")


def latest_result(results: DataFrame, key: list[str], ts: str, tie: str) -> DataFrame:
    """Newest row per key; an aggregate, so copies are reduced before the shuffle."""
    rest = [c for c in results.columns if c not in (*key, ts, tie)]
    newest = F.max(F.struct(ts, tie, *rest)).alias("_r")
    return results.groupBy(*key).agg(newest).select(*key, "_r.*")


def cache_stats(results: DataFrame, value: str, max_age_hours: int = rules.CACHE_HOURS) -> DataFrame:
    size = F.sum(F.octet_length(value)) / F.lit(1048576.0)
    return results.agg(
        F.count(F.lit(1)).alias("num_entries"),
        F.coalesce(size, F.lit(0.0)).alias("total_size_mb"),
    ).withColumn("max_age_hours", F.lit(max_age_hours).cast("bigint"))


def live_results(results: DataFrame, now, hours: int, ts: str = "converted_at") -> DataFrame:
    """Rows that have not expired."""
    return results.where(_fresh(_now(now, results, ts), hours, ts))


def expire_results(results: DataFrame, now, hours: int, ts: str = "converted_at") -> DataFrame:
    """How many entries expire and how many stay."""
    fresh = _fresh(_now(now, results, ts), hours, ts)
    return results.agg(F.count_if(~fresh).alias("expired"), F.count_if(fresh).alias("kept"))


def resolve_options(df: DataFrame, options: DataFrame, defaults: dict[str, object], key: str = "doc_id") -> DataFrame:
    """Per-document overrides on top of the batch defaults.

    options: one row per key with some of the option columns; null means default.
    """
    given = [c for c in options.columns if c != key]
    unknown = set(given) - set(defaults)
    if unknown:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    renamed = options.select(key, *[F.col(c).alias(f"_o_{c}") for c in given])
    out = df.join(renamed, key, "left")
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(f"_o_{name}"), F.lit(value)) if name in given else F.lit(value))
    return out.drop(*[f"_o_{c}" for c in given])
