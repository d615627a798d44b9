"""How the operators read the tables of a folder and run functions over Arrow batches."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Arrow batches of whole texts are bounded by size, so that a worker's memory is too.
BATCH_BYTES = "4m"


def _bounded_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # its default
        spark.conf.set(name, BATCH_BYTES)


def texts(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator needs, with null texts as empty ones."""
    _bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as no column of ``df`` has."""
    while name.lower() in map(str.lower, df.columns):
        name = "_" + name
    return name


def over_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``f`` on every Arrow batch; an empty batch yields nothing."""

    _bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return df.mapInArrow(run, schema)


def tasks(n: int, most: int = 20_000) -> int:
    """How many tasks share n pieces of work whose rows are small; given as a number, it isn't cut by adaptive execution."""
    return max(1, min(int(n), most))


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster's machines share, as ``spark.checkpoint.dir`` names it.

    Where that is unset and one machine does all the work, as in tests, a temporary folder is
    made for the application, which goes when Python ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        key = spark.sparkContext.applicationId
        if key not in _own:
            _own[key] = tempfile.mkdtemp(prefix="ripplespark-")
            atexit.register(shutil.rmtree, _own[key], ignore_errors=True)
        folder = _own[key]
    return folder.rstrip("/")


def saved(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again, which cuts its lineage.

    Nothing reads the shuffle files of a plan that has been written, so they are dropped.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid4().hex}"
    drop = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(drop)
    spark.conf.set(drop, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(drop, before)
    return spark.read.schema(df.schema).parquet(path)
