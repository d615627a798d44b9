"""Files that come in again: their old rows leave every index, the new ones enter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def upserted(files: DataFrame, changed: DataFrame) -> DataFrame:
    """The table of files with those of ``changed`` added or put in place; all indexes follow from it."""
    return files.join(changed.select("path").distinct(), "path", "left_anti").select(*files.columns).unionByName(changed.select(*files.columns))


def replaced(index: DataFrame, changed: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """An index table with the rows of changed files exchanged, so that it needn't be built anew."""
    return index.join(changed.select(F.col("path").alias(key)).distinct(), key, "left_anti").select(*index.columns).unionByName(fresh.select(*index.columns))


def latest(changed: DataFrame, version: str) -> DataFrame:
    """The last version of each path in a batch."""
    return changed.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc(version)))).where("_n = 1").drop("_n")


def follow(stream: DataFrame, folder: str, build: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Keeps a table in versions under ``folder`` up to date with a stream of (path, version, ...) rows.

    Every batch is put over the latest version and written as the next; a batch that is run
    again after a failure writes the same version.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        fresh = build(latest(rows, "version"))
        out = fresh if number == 0 else upserted(spark.read.parquet(f"{folder}/v={number - 1}"), fresh)
        out.write.mode("overwrite").parquet(f"{folder}/v={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(events: DataFrame, time: str, key: str, window: str = "14 days", late: str = "1 day") -> DataFrame:
    """(window, key, n) of a stream of events, by tumbling windows; what comes later than ``late`` is left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
