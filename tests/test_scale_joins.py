"""Joins that leave out early what can't count: cones, names, vectors in blocks, times in buckets."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from ripplespark.config import Rerank
from ripplespark.operators import graph as G
from ripplespark.operators import intervals, scorers, vectors


def test_cones_that_stop_early_equal_cut_ones(spark):
    rng = random.Random(3)
    edges = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(130)} | {("hub", f"n{k}") for k in range(30)} | {("n1", "hub"), ("n2", "n1")}
    graph = spark.createDataFrame(sorted((a, b) for a, b in edges if a != b), "src string, dst string")
    seeds = spark.createDataFrame([(f"n{k}",) for k in range(60)] + [("hub",), ("alone",), ("n1",)], "path string")
    for most in (1, 12, 30):
        full = G.cone(seeds, graph, 3)
        size = full.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") <= most)
        cut = {tuple(r) for r in full.join(size, "seed").select("seed", "node", "depth", (F.col("n") - 1).alias("cone_size")).collect()}
        assert {tuple(r) for r in G.capped_cone(seeds, graph, 3, most).collect()} == cut and cut


def test_names_meet_by_rare_tokens(spark):
    rng = random.Random(6)
    words = ["common", "index", *(f"word{k}" for k in range(12)), "word1extra", "ab"]
    name = lambda: [rng.choice(words[:2]) if rng.random() < 0.6 else rng.choice(words) for _ in range(rng.randint(1, 4))]
    src, tests = {f"s{k}": name() for k in range(60)}, {f"t{k}": name() for k in range(60)}
    inside = lambda a, b: a != b and min(len(a), len(b)) >= 5 and (a in b or b in a)
    needed = set()
    for (s, c), (t, d) in itertools.product(src.items(), tests.items()):
        exact = sum(x in d for x in c)
        fuzzy = sum(x not in d and any(inside(x, y) for y in d) for x in c)
        if (exact + 0.9 * fuzzy) / min(len(set(c)), len(set(d))) >= 0.5:
            needed.add((s, t))
    got = {tuple(r) for r in scorers.name_pairs(spark.createDataFrame(list(src.items()), "changed string, ct array<string>"), spark.createDataFrame(list(tests.items()), "test string, tt array<string>"), 0.5).collect()}
    assert needed <= got and len(needed) > 500
    # A token that all names have brings no pairs together where each name has rare ones beside it.
    wide = spark.createDataFrame([(f"s{k}", ["common", f"a{k}", f"b{k}", f"c{k}"]) for k in range(200)], "changed string, ct array<string>")
    other = spark.createDataFrame([(f"t{k}", ["common", f"a{k}", f"b{k}", f"d{k}"]) for k in range(200)], "test string, tt array<string>")
    assert scorers.name_pairs(wide, other, 0.5).count() == 200


def test_vectors_in_blocks_equal_plain_comparison(spark):
    rng = np.random.default_rng(2)
    rows = [(k, int(k % 3) if k % 10 else None, [float(x) for x in rng.normal(size=5)]) for k in range(300)]
    rows += [(1000 + k, 1, rows[4][2]) for k in range(50)] + [(2000, 1, [0.0] * 5), (2001, 1, []), (2002, 2, [1.0, 0.5]), (2003, 1, None), (None, 1, rows[4][2]), (2004, 1, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, label long, vector array<double>").repartition(3)
    cfg = Rerank(top_k=7, min_similarity=0.2)
    got = sorted(map(tuple, vectors.top_k_in_blocks(df.where("id % 20 = 4"), df, cfg, rows=64).collect()))
    full = {i: (c, np.pad(v, (0, 5 - len(v)))) for i, c, v in rows if i is not None and v is not None and None not in v}

    def score(a, b):
        norm = np.linalg.norm(full[a][1]) * np.linalg.norm(full[b][1])
        return round(0.7 * (full[a][0] is not None and full[a][0] == full[b][0]) + 0.3 * (full[a][1] @ full[b][1] / norm if norm else 0.0), 12)

    expected = []
    for a in (i for i in full if i % 20 == 4):
        best = sorted((-score(a, b), b) for b in full if b != a)[:7]
        expected += [(a, b, -s, n) for n, (s, b) in enumerate(best, 1) if -s >= 0.2]
    assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in sorted(expected)]
    assert np.allclose([x[2] for x in got], [x[2] for x in sorted(expected)])
    assert vectors.top_k_in_blocks(df.where("id IS NULL"), df, cfg).count() == 0


def test_events_near_in_time(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice([None, rng.randint(-200, 200)])) for k in range(150)] + [(900, "a", 10), (901, "a", 10)]
    df = spark.createDataFrame(rows, "id int, key string, ts long")
    close = lambda x, y: x[2] is not None and y[2] is not None and abs(x[2] - y[2]) <= 15
    assert sorted((r.id, r.other_id) for r in intervals.near_in_time(df, df, 15, "key").collect()) == sorted((x[0], y[0]) for x in rows for y in rows if x[1] is not None and x[1] == y[1] and close(x, y))
    assert intervals.near_in_time(df, df, 15).count() == sum(close(x, y) for x in rows for y in rows)
    near = {r.id: r.near for r in intervals.counted_near(df, 15, "key").collect()}
    assert near == {x[0]: sum(x[1] == y[1] and close(x, y) for y in rows) - 1 if x[1] is not None and x[2] is not None else None for x in rows}
