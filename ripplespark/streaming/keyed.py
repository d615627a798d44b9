"""Tables of rows by file that take changes in proportion to the changes.

A table lies in buckets by a hash of its key.  Every batch of changes is written on its own,
only the rows of keys that it touches; a key that lost all its rows has a tombstone.  Readers
put the batches over the base.  Compaction rewrites only buckets with enough batches and says
last, in a mark, up to which batch each of them has been taken in, so that a reader sees the
table before or after it, never between.  One writer numbers the batches; a batch that is
written again after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .upsert import latest

BUCKETS = 64
#: A bucket with so many batches is worth rewriting.
MANY = 8


class KeyedTable:
    """Rows of a schema, any number for each value of ``key``, under a folder."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType, key: str = "path", buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if own := {n.lower() for n in self.schema.fieldNames()} & {"batch", "bucket", "gen", "gone"}:
            raise ValueError(f"names that the table itself uses: {', '.join(sorted(own))}")

    def _read(self, part: str, more: str) -> DataFrame:
        schema = StructType([*(self.schema.fields if part != "marks" else []), *StructType.fromDDL(more).fields])
        path = f"{self.folder}/{part}"
        try:
            return self.spark.read.schema(schema).option("basePath", path).parquet(path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error.getCondition() or error):
                raise
            return self.spark.createDataFrame([], schema)

    def put(self, rows: DataFrame, number: int, touched: DataFrame | None = None) -> None:
        """All rows of the touched keys as they are now; keys of ``touched`` (key) without a row go."""
        rows = rows.select(self.schema.fieldNames()).withColumn("gone", F.lit(False))
        if touched is not None:
            lost = touched.select(self.key).where(F.col(self.key).isNotNull()).distinct().join(rows.select(self.key), self.key, "left_anti")
            rows = rows.unionByName(lost.withColumn("gone", F.lit(True)), allowMissingColumns=True)
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        rows.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.folder}/delta/batch={number}")

    def _parts(self) -> tuple[DataFrame, DataFrame]:
        """The base, and the batches that aren't in it yet."""
        marks = self._read("marks", "bucket int, upto bigint, gen string")
        newest = marks.groupBy("bucket").agg(F.max_by(F.struct("upto", "gen"), F.struct("upto", "gen")).alias("m")).select("bucket", "m.upto", "m.gen")
        base = self._read("base", "gen string, bucket int").join(newest.select("bucket", "gen"), ["bucket", "gen"], "left_semi")
        delta = self._read("delta", "gone boolean, batch bigint, bucket int").join(newest.select("bucket", "upto"), "bucket", "left").where("upto IS NULL OR batch > upto").drop("upto")
        return base, delta

    def _over(self, base: DataFrame, delta: DataFrame) -> DataFrame:
        last = delta.groupBy("bucket", self.key).agg(F.max("batch").alias("batch"))
        fresh = delta.join(last, ["bucket", self.key, "batch"], "left_semi").where("NOT gone")
        old = base.join(last, ["bucket", self.key], "left_anti")
        columns = [*self.schema.fieldNames(), "bucket"]
        return old.select(columns).unionByName(fresh.select(columns))

    def read(self) -> DataFrame:
        return self._over(*self._parts()).drop("bucket")

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; only these are compared with the batches."""
        asked = keys.select(self.key).distinct().withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        base, delta = (part.join(asked, ["bucket", self.key], "left_semi") for part in self._parts())
        return self._over(base, delta).drop("bucket")

    def compact(self, many: int = MANY) -> int:
        """Rewrites the buckets that ``many`` batches or more wait for, and returns their number."""
        base, delta = self._parts()
        due = delta.select("bucket", "batch").distinct().groupBy("bucket").agg(F.count("*").alias("n"), F.max("batch").alias("upto")).where(F.col("n") >= many).select("bucket", "upto").collect()  # a row for each bucket at most
        if not due:
            return 0
        some = F.col("bucket").isin([r["bucket"] for r in due])
        gen = uuid4().hex
        self._over(base.where(some), delta.where(some)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/base/gen={gen}")
        marks = self.spark.createDataFrame([(r["bucket"], r["upto"]) for r in due], "bucket int, upto bigint")
        marks.coalesce(1).write.parquet(f"{self.folder}/marks/gen={gen}")
        return len(due)


def follow(stream: DataFrame, files: KeyedTable, build: Callable[[DataFrame], DataFrame], checkpoint: str, indexes: Mapping[str, tuple[KeyedTable, Callable[[DataFrame], DataFrame]]] | None = None, many: int = MANY) -> StreamingQuery:
    """Keeps a table of files and its indexes up to date with a stream of (path, version, gone, ...) rows.

    build turns a batch's last version of each path into rows of ``files``; an index's
    function turns rows of ``files`` into its own, so only touched paths are extracted anew.
    """

    def batch(rows: DataFrame, number: int) -> None:
        last = latest(rows, "version").persist()
        gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in last.columns else F.lit(False)
        fresh = build(last.where(~gone)).persist()
        touched = last.select(F.col("path").alias(files.key))
        files.put(fresh, number, touched)
        for table, of in (indexes or {}).values():
            table.put(of(fresh), number, touched.withColumnRenamed(files.key, table.key))
        for table in (files, *(t for t, _ in (indexes or {}).values())):
            table.compact(many)
        fresh.unpersist()
        last.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
