"""Structured Streaming: verdicts of arriving files, and windowed statistics of an event stream.

State is keyed by file or by window and bounded by watermarks; nothing is kept for windows
that the watermark has passed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



#: Files of one batch at most, so that the list of them that the driver holds is bounded.
BATCH_FILES = 20_000


def local_path(uri: str) -> str:
    """The path of a ``file:`` URI, whatever characters its name has."""
    return unquote(re.sub("^file:(//)?", "", uri)) if uri.startswith("file:") else uri


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*.gpkg") -> DataFrame:
    """A stream of container files as they arrive: path, time and size, without their content."""
    files = spark.readStream.option("maxFilesPerTrigger", BATCH_FILES).format("binaryFile").option("pathGlobFilter", pattern).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("path", "modificationTime", "length")


def validate_arrivals(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], as_of: str, checkpoint: str):
    """Validate each batch of new files and hand its findings to ``sink(findings, batch_id)``.

    A batch is one validation plan over its files; exactly-once results need a sink that
    overwrites by batch id.
    """
    from ..plans.validate import findings
    from ..sources.gpkg import read_catalog

    def batch(files: DataFrame, batch_id: int) -> None:
        paths = [local_path(r.path) for r in files.select("path").toLocalIterator()]
        if paths:
            sink(findings(read_catalog(spark, json.dumps(paths)), as_of), batch_id)

    return arriving_files(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_statistics(events: DataFrame, *, late: str = "10 minutes", window: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Tumbling windows over ``ts``: count, sum and extremes of ``value``; rows later than ``late`` are dropped by the watermark."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), by)
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
        .select(F.col("window.start").alias("start"), by, "n", "total", "low", "high")
    )
