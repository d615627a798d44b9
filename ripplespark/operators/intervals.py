"""Pairs of events that lie near each other in time, without comparing all with all.

Time is cut into buckets as wide as the window.  An event and any other within the window lie
in the same bucket or in neighbouring ones, so one side stands in three buckets and the join
is one on key and bucket, which Spark splits where a bucket is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def near_in_time(left: DataFrame, right: DataFrame, window: int, key: str | None = None, time: str = "ts") -> DataFrame:
    """Pairs of rows whose times (whole numbers) differ by at most ``window``, and whose keys are equal.

    The right side's columns but the key come back with ``other_`` before their names; null
    times and keys have no partner. Equal rows pair each.
    """
    cut = lambda c: F.floor(F.col(c) / window)
    other = right.select(*(F.col(c).alias(c if c == key else f"other_{c}") for c in right.columns))
    three = left.withColumn("_bucket", F.explode(F.transform(F.array(*(F.lit(k) for k in (-1, 0, 1))), lambda k: cut(time) + k)))
    met = three.join(other.withColumn("_bucket", cut(f"other_{time}")), [*([key] if key else []), "_bucket"])
    return met.where(F.abs(F.col(time) - F.col(f"other_{time}")) <= window).drop("_bucket")


def counted_near(events: DataFrame, window: int, key: str, time: str = "ts") -> DataFrame:
    """Rows with ``near``: how many other rows of the key lie within the window. No pair is made.

    Rows of a key are sorted by time and counted by a moving range, so that a key takes a sort, not a product.
    """
    per = Window.partitionBy(key).orderBy(time).rangeBetween(-window, window)
    return events.withColumn("near", F.when(F.col(time).isNotNull() & F.col(key).isNotNull(), F.count("*").over(per) - 1))
