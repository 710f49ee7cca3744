"""User converters: functions over Arrow batches, routed by (file_type, strategy)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.operators.routing import route
from folioweave.session import values_table

ConverterFn = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
RESULT_SCHEMA = "path string, markdown string, error string"


@dataclass(frozen=True)
class Converter:
    name: str
    fn: ConverterFn
    extensions: tuple[str, ...]
    supports_ocr: bool = False
    available: bool = True


class ConverterRegistry:
    """Converters by (file_type, strategy). Batches hold path and content; results follow RESULT_SCHEMA."""

    def __init__(self) -> None:
        self._routes: dict[tuple[str, str], Converter] = {}

    def register_converter(self, file_type: str, strategy: str, name: str, fn: ConverterFn,
                           extensions: tuple[str, ...] = (), supports_ocr: bool = False, available: bool = True) -> None:
        self._routes[(file_type, strategy)] = Converter(name, fn, tuple(extensions), supports_ocr, available)

    def describe(self, spark: SparkSession) -> DataFrame:
        """Routes with name, extensions, OCR support and availability."""
        rows = [(t, s, c.name, ",".join(c.extensions), c.supports_ocr, c.available)
                for (t, s), c in sorted(self._routes.items())]
        return values_table(spark, rows, ["file_type", "strategy", "converter", "extensions", "supports_ocr", "available"])

    def routes(self, spark: SparkSession) -> DataFrame:
        return self.describe(spark).where("available").select("file_type", "strategy", "converter")

    def convert(self, df: DataFrame) -> DataFrame:
        """df (path, content, file_type, strategy) -> results with converter; unrouted rows keep an error.

        One pass: batches are dispatched by type and strategy, so two converters of one
        display name stay apart.
        """
        found = {key: c.fn for key, c in self._routes.items() if c.available}
        routed = route(df, self.routes(df.sparkSession))
        schema = pa.schema([("path", pa.string()), ("markdown", pa.string()), ("error", pa.string())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                routes = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist()))
                names = b.column(4).to_pylist()
                for key in dict.fromkeys(routes):
                    mine = pa.array([i for i, r in enumerate(routes) if r == key])
                    part = pa.RecordBatch.from_arrays([b.column(i).take(mine) for i in (0, 1)], names=["path", "content"])
                    fn = found.get(key) or found[(key[0], "default")]  # as route() falls back
                    for out in fn(iter([part])):
                        out = pa.Table.from_batches([out]).select(schema.names).cast(schema)
                        out = out.append_column("converter", pa.array([names[mine[0].as_py()]] * out.num_rows, pa.string()))
                        yield from out.to_batches()

        done = routed.where(F.col("converter").isNotNull()).select(
            "path", "content", "file_type", "strategy", "converter").mapInArrow(run, RESULT_SCHEMA + ", converter string")
        return routed.where(F.col("converter").isNull()).select(
            "path", F.lit(None).cast("string").alias("markdown"), F.col("route_error").alias("error"),
            F.lit(None).cast("string").alias("converter")).unionByName(done)
