"""Pairs by common time buckets, and a judge's calls over tasks."""

from __future__ import annotations

import itertools
import random

from ripplespark.config import Rerank
from ripplespark.operators import judge as J
from ripplespark.sources import history as H


def test_pairs_meet_once_for_many_buckets(spark):
    rng = random.Random(5)
    held = {f"f{k}": {rng.randrange(-130, 200) for _ in range(rng.randrange(1, 40))} for k in range(25)}
    df = spark.createDataFrame([(p, b) for p, bs in held.items() for b in bs], "path string, bucket bigint")
    found = H.shared_buckets(df, 4)
    assert {tuple(r) for r in found.collect()} == {(a, b, len(held[a] & held[b])) for a, b in itertools.product(held, held) if a < b and held[a] & held[b]}


def test_calls_are_shared_by_tasks_within_the_bound(spark):
    prompts = spark.range(64).selectExpr("id", "cast(id AS STRING) AS prompt")
    for calls in (1, 4, 9):
        got = J.replied(prompts, lambda p: p, Rerank(concurrency=calls))
        assert got.rdd.getNumPartitions() <= calls and (calls == 1 or got.rdd.getNumPartitions() > 1) and {r.reply for r in got.collect()} == {str(k) for k in range(64)}


def test_pairs_are_written_once_and_never_shuffled(spark):
    rng = random.Random(8)
    held = {f"f{k}": {rng.choice((-600, 0, 300, 490, 1000, 1100)) + rng.randrange(12) for _ in range(rng.randrange(1, 9))} for k in range(40)}
    df = spark.createDataFrame([(p, b) for p, bs in held.items() for b in bs], "path string, bucket bigint")
    more = spark.createDataFrame([(p, len(bs)) for p, bs in held.items()], "path string, n int")
    found = H.shared_buckets(df, 3, more)
    expected = {(a, b, len(held[a] & held[b]), len(held[a]), len(held[b])) for a, b in itertools.product(held, held) if a < b and held[a] & held[b]}
    got = [tuple(r) for r in found.select("a", "b", "co", "a_n", "b_n").collect()]
    assert set(got) == expected and len(got) == len(expected)
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = [k for k, line in enumerate(lines) if "SortMergeJoin [tile" in line]
    assert len(joins) == 2 and not any("Exchange" in line or "Aggregate" in line for line in lines[: joins[0]])
    assert sum("Exchange" in line and "tile" in line for line in lines) == 4  # either join's sides; nothing is shuffled after
