"""Stored decisions on pairs, and stored values by the digest of what they were computed from.

Both are folders that only ever gain files.  Every append is a folder of its own, so writers
at the same time don't meet, and what a lost writer leaves has no committed file and is not
read.  Readers need no lock: compaction writes a new base and, last, the list of the batches
that went into it; whichever base a reader picks, it adds the batches that this one lacks.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import saved


def _parts(spark: SparkSession, folder: str, schema: str, key: str) -> DataFrame:
    """All committed parts under a folder, with the part's name as ``key``; none if the folder isn't there."""
    try:
        return spark.read.schema(f"{schema}, {key} string").option("basePath", folder).parquet(folder)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition() or error):
            raise
        return spark.createDataFrame([], f"{schema}, {key} string")


class LockStore:
    """Decisions (changed, test, state, reason, confirmed_at) with an order ``at``; the last one on a pair holds.

    Of decisions of the same time on a pair, that of the greatest state, reason and time of
    confirmation holds, so that every reader sees the same. ``at`` orders writers; it may be a
    clock's or a counter's.
    """

    ROW = "changed string, test string, state string, reason string, confirmed_at string, at bigint"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def append(self, news: DataFrame) -> str:
        """Adds decisions and returns the name of their batch."""
        batch = uuid4().hex
        columns = [c.split()[0] for c in self.ROW.split(", ")]
        news.select(*(F.col(c).cast("bigint" if c == "at" else "string") for c in columns)).write.parquet(f"{self.folder}/log/batch={batch}")
        return batch

    def _base(self) -> tuple[DataFrame, DataFrame]:
        """The base that most batches went into, and these batches."""
        listed = _parts(self.spark, f"{self.folder}/absorbed", "batch string", "base")
        best = listed.groupBy("base").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "base").select("base").first()
        name = best["base"] if best else ""
        rows = _parts(self.spark, f"{self.folder}/base", self.ROW, "base").where(F.col("base") == name).drop("base")
        return rows, listed.where(F.col("base") == name).select("batch")

    def read(self) -> DataFrame:
        """The decision that holds on each pair."""
        base, absorbed = self._base()
        log = _parts(self.spark, f"{self.folder}/log", self.ROW, "batch")
        return _last(base.unionByName(log.join(absorbed, "batch", "left_anti").drop("batch")))

    def compact(self) -> int:
        """Writes a base of all batches so far and returns how many they are; readers and writers may go on meanwhile."""
        base, absorbed = self._base()
        log = _parts(self.spark, f"{self.folder}/log", self.ROW, "batch")
        # The names first: batches that are added after this aren't in the base, nor on its list.
        names = saved(log.select("batch").unionByName(absorbed).distinct(), "batches")
        name = uuid4().hex
        rows = base.unionByName(log.join(names, "batch", "left_semi").join(absorbed, "batch", "left_anti").drop("batch"))
        _last(rows).write.parquet(f"{self.folder}/base/base={name}")
        names.coalesce(1).write.parquet(f"{self.folder}/absorbed/base={name}")
        return names.count()


def _last(rows: DataFrame) -> DataFrame:
    """Of each pair the last decision."""
    last = F.max(F.struct("at", "state", "reason", "confirmed_at")).alias("d")
    return rows.groupBy("changed", "test").agg(last).select("changed", "test", "d.state", "d.reason", "d.confirmed_at", "d.at")


class ContentCache:
    """Values by the sha1 of their text, in folders by the digest's first two digits.

    A lookup reads only the folders of digests that are asked for. Two writers may compute the
    same value; it is then stored twice and read once.
    """

    def __init__(self, spark: SparkSession, folder: str, value: str = "double"):
        self.spark, self.folder, self.value = spark, folder.rstrip("/"), value

    def stored(self) -> DataFrame:
        """(part, digest, value)"""
        try:
            return self.spark.read.schema(f"digest string, value {self.value}, batch string, part string").option("basePath", self.folder).parquet(self.folder).drop("batch")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error.getCondition() or error):
                raise
            return self.spark.createDataFrame([], f"digest string, value {self.value}, part string")

    def values(self, texts: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``texts`` (text, ...) with ``value``; ``compute`` turns (digest, text) of what is new, each once, into (digest, value).

        Values that it leaves out or gives as null are not stored: they come back as null and
        are computed again next time. A null text has a null value.
        """
        keyed = texts.withColumn("digest", F.sha1(F.col("text").cast("binary")))
        asked = keyed.where("digest IS NOT NULL").select("digest", "text").dropDuplicates(["digest"]).withColumn("part", F.substring("digest", 1, 2))
        known = self.stored()
        fresh = saved(asked.join(known.select("part", "digest"), ["part", "digest"], "left_anti").select("digest", "text"), "cache-asked")
        new = saved(compute(fresh).where("value IS NOT NULL").select("digest", F.col("value").cast(self.value).alias("value")).dropDuplicates(["digest"]), "cache-new")
        if not new.isEmpty():
            new.withColumn("part", F.substring("digest", 1, 2)).repartition("part").write.partitionBy("part").parquet(f"{self.folder}/batch={uuid4().hex}")
        held = known.join(asked.select("part", "digest"), ["part", "digest"], "left_semi").select("digest", "value").dropDuplicates(["digest"])
        return keyed.join(held.unionByName(new), "digest", "left").select(*texts.columns, "value")
