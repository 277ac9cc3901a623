"""The time-series operators on streams: windows and gap sessions.

State is bounded by the watermark; rows that come later than it are dropped there, and late_rows lists them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(stream: DataFrame, t: str, keys: list[str], delay: str, width: str, hop: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates over sliding event-time windows: keys, window_start, window_stop and the aggregates."""
    grouped = stream.withWatermark(t, delay).groupBy(*keys, F.window(t, width, hop).alias("_w")).agg(*aggregates)
    return grouped.withColumns({"window_start": F.col("_w.start"), "window_stop": F.col("_w.end")}).drop("_w")


def sessions(stream: DataFrame, t: str, keys: list[str], delay: str, max_gap: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates over the stretches between gaps longer than max_gap: keys, t_start, t_stop (last time plus the gap)."""
    grouped = stream.withWatermark(t, delay).groupBy(*keys, F.session_window(t, max_gap).alias("_w")).agg(*aggregates)
    return grouped.withColumns({"t_start": F.col("_w.start"), "t_stop": F.col("_w.end")}).drop("_w")


def drain(spark: SparkSession, make: Callable[[DataFrame], DataFrame], path: str, schema, out: str, files: int | None = None) -> DataFrame:
    """Run a streaming query over all Parquet files there are now, appending to ``out``; returns what was written.

    The checkpoint lies beside the output, so a query that is cut off goes on where it was. The path is read as a pattern,
    since a stream takes a single file in that form only.
    """
    path = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
    sink = make(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/_state").option("path", f"{out}/rows")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def late_rows(spark: SparkSession, path: str, schema, t: str, delay: str, closes: Column, out: str, files: int | None = None) -> DataFrame:
    """Rows that a windowed query with this delay drops, with the batch in which they came: all their windows had closed.

    closes is the end of a row's last window. The watermark of a batch is the latest time of the batches before it less the
    delay, as of a query with the same files a batch. Marks and rows are written by batch, so a batch that runs again after a
    failure gives the same. Rows without a time are none. No state is kept but a mark a batch.
    """
    marks, late = f"{out}/marks", f"{out}/late"

    def each(batch: DataFrame, k: int) -> None:
        session = batch.sparkSession
        mark = session.read.schema("mark timestamp, batch long").parquet(marks).filter(F.col("batch") < k).agg(F.max("mark")).first()[0] if k else None
        found = batch.filter(closes <= F.lit(mark) - F.expr(f"INTERVAL {delay}")) if mark is not None else batch.limit(0)
        found.write.mode("overwrite").parquet(f"{late}/batch={k}")
        batch.agg(F.max(t).alias("mark")).write.mode("overwrite").parquet(f"{marks}/batch={k}")

    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{path[:-1]}[{path[-1]}]")
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{out}/_state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema.add("batch", "long") if not isinstance(schema, str) else f"{schema}, batch long").parquet(late)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, or under the warehouse where that is unset; a cluster shares both."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
