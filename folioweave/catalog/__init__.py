"""Registered queries: operator name -> (Spark callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


def collect_catalog() -> dict[str, tuple[QueryFn, str | None]]:
    from folioweave.catalog import (
        detection, documents, markup, outcomes, packages, scalars, streams, tables,
    )

    out: dict[str, tuple[QueryFn, str | None]] = {}
    for module in (scalars, detection, documents, tables, markup, outcomes, packages, streams):
        for name, entry in module.QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} is registered twice")
            out[name] = entry
    return out
