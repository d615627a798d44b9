"""What results look like to readers: flat lists, one line for each test, counts and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fusion import band_rank


def flat(results: DataFrame, most: int | None = None) -> DataFrame:
    """All pairs by score; ties by changed file and test."""
    ordered = results.orderBy(F.desc("score"), "changed", "test")
    return ordered if most is None else ordered.limit(most)


def by_test(results: DataFrame) -> DataFrame:
    """Each test once, as its best pair has it: the higher band, then the higher score, then the first changed file."""
    columns = [c for c in results.columns if c != "test"]
    # struct order: the largest wins, so the file's name is turned round by taking the least of equal ones
    top = results.groupBy("test").agg(F.max(F.struct(band_rank("confidence").alias("b"), "score")).alias("top"))
    best = results.join(top, "test").where((band_rank("confidence") == F.col("top.b")) & (F.col("score") == F.col("top.score")))
    first = best.groupBy("test").agg(F.min_by(F.struct(*columns), "changed").alias("r"))
    return first.select("test", "r.*").orderBy(F.desc(band_rank("confidence")), F.desc("score"), "test")


def band_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("confidence").agg(F.count("*").alias("tests"))


def rerank_summary(outcomes: DataFrame) -> DataFrame:
    """One row: how many pairs were judged, dropped and left unevaluated, and whether there was any judging."""
    return outcomes.agg(F.count_if("judged").alias("judged"), F.count_if(~F.col("kept")).alias("dropped"), F.count_if("failed").alias("failed"), F.coalesce(F.bool_or("judged"), F.lit(False)).alias("active"))


def share_log(frequency: DataFrame, k: int = 30) -> DataFrame:
    """The selectors that most tests use, for the log."""
    return frequency.orderBy(F.desc("n_tests"), "value").limit(k)
