"""Tables and histories that take changes in proportion to the changes, against rebuilding all."""

import os
import random
import subprocess

import pytest

from pyspark.sql import functions as F

from ripplespark.__main__ import arguments
from ripplespark.sources import history as H
from ripplespark.streaming.keyed import KeyedTable, follow


def test_batches_equal_a_full_rebuild(spark, tmp_path):
    rng = random.Random(1)
    table, now = KeyedTable(spark, str(tmp_path / "t"), "path string, word string, n int", buckets=4), {}
    assert table.read().count() == 0
    for number in range(6):
        paths = {f"f{rng.randrange(25)}" for _ in range(20 if number == 0 else 4)}
        batch = {p: [(p, f"w{rng.randrange(5)}", k) for k in range(rng.randint(0, 3))] for p in paths}
        now |= batch
        rows = [r for p in batch for r in batch[p]]
        table.put(spark.createDataFrame(rows, table.schema), number, spark.createDataFrame([(p,) for p in paths], "path string"))
        written = spark.read.parquet(f"{tmp_path}/t/delta/batch={number}")
        assert written.count() == len(rows) + sum(not batch[p] for p in paths)  # its own size, whatever the table's
        if number == 3:
            assert table.compact(2) > 0
    full = sorted(r for p in now for r in now[p])
    assert sorted(map(tuple, table.read().collect())) == full
    assert sorted(map(tuple, table.get(spark.createDataFrame([("f1",), ("f2",), ("none",)], "path string")).collect())) == [r for r in full if r[0] in ("f1", "f2")]
    assert table.compact(1) > 0 and table.compact(1) == 0 and sorted(map(tuple, table.read().collect())) == full
    table.put(spark.createDataFrame([("f1", "again", 9)], table.schema), 5)  # a batch that is written again, though it has been taken in
    assert sorted(map(tuple, table.read().collect())) == full


def test_a_stream_of_files_keeps_its_index(spark, tmp_path):
    schema = "path string, version int, gone boolean, imports array<string>"
    files = KeyedTable(spark, str(tmp_path / "files"), "path string, imports array<string>", buckets=4)
    edges = KeyedTable(spark, str(tmp_path / "edges"), "src string, dst string", "src", 4)
    follow_ = lambda: follow(spark.readStream.schema(schema).json(str(tmp_path / "in")), files, lambda f: f.select("path", "imports"), str(tmp_path / "ck"), {"graph": (edges, lambda f: f.select(F.col("path").alias("src"), F.explode("imports").alias("dst")))}, 2).awaitTermination()
    (tmp_path / "in").mkdir()

    def send(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        follow_()

    send(("a", 1, None, ["b", "c"]), ("b", 1, None, ["c"]), ("c", 1, None, []))
    send(("a", 2, None, ["x"]), ("a", 3, None, ["c"]), ("c", 2, True, None))
    send(("d", 1, False, ["a"]))
    assert sorted((r.path, r.imports) for r in files.read().collect()) == [("a", ["c"]), ("b", ["c"]), ("d", ["a"])]
    assert sorted(map(tuple, edges.read().collect())) == [("a", "c"), ("b", "c"), ("d", "a")]
    assert spark.read.parquet(str(tmp_path / "edges" / "delta" / "batch=2")).count() == 1


def same(a, b):
    plain = lambda df: sorted((r.repo, r.path, r.created_at, r.updated_at, [tuple(c) for c in r.commits]) for r in df.collect())
    assert plain(a) == plain(b)


def test_newer_records_merge_into_histories(spark, tmp_path):
    old = [("r", 0, "30\n\nM\ta.ts\nM\tb.ts"), ("r", 1, "20\n\nR100\tz.ts\ta.ts"), ("r", 2, "10\n\nA\tz.ts\nA\tb.ts\nA\tc.ts")]
    new = [("r", 0, "60\n\nA\ta.ts\nM\tq.ts"), ("r", 1, "50\n\nR090\tp.ts\tq.ts\nD\tc.ts"), ("r", 2, "40\n\nR100\ta.ts\tp.ts\nC100\tb.ts\te.ts\nM\tb.ts")]
    kind = "repo string, pos int, record string"
    store = H.Histories(spark, str(tmp_path))
    store.add(spark.createDataFrame(old, kind), 0)
    same(store.read(), H.parse(spark.createDataFrame(old, kind)))
    store.add(spark.createDataFrame(new, kind), 1, {"r": 3})
    same(store.read(), H.parse(spark.createDataFrame(new + [(r, p + 3, x) for r, p, x in old], kind)))
    assert {r.path for r in store.read().collect()} == {"a.ts", "q.ts", "b.ts", "c.ts", "e.ts"}


@pytest.mark.parametrize("rewrite", [False, True])
def test_histories_of_a_repository(spark, tmp_path, rewrite):
    root, clock = tmp_path / "repo", iter(range(1_700_000_000, 1_800_000_000, 1000))
    root.mkdir()

    def git(*args):
        t = f"{next(clock)} +0000"
        env = os.environ | {"GIT_AUTHOR_DATE": t, "GIT_COMMITTER_DATE": t, "GIT_CONFIG_GLOBAL": "/dev/null"}
        subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@y.z", "-C", str(root), *args], check=True, capture_output=True, env=env)

    def commit(**files):
        for name, text in files.items():
            (root / f"{name}.ts").write_text(text)
        git("add", "-A")
        git("commit", "-m", "x")

    git("init", "-q")
    commit(a="one\ntwo\nthree\n", b="b\n")
    commit(a="one\ntwo\nthree\nfour\n")
    store = H.Histories(spark, str(tmp_path / "store"))
    assert store.update(str(root)) == 2 and store.update(str(root)) == 0
    if rewrite:
        git("reset", "--hard", "HEAD~1")
    git("mv", "a.ts", "moved.ts")
    commit(b="b2\n")
    commit(a="new\n", c="c\n")
    assert store.update(str(root)) == (3 if rewrite else 2)
    same(store.read(), H.parse(H.git_log(spark, str(root))))


def test_result_options():
    got = arguments(["analyze", "--min-confidence", "0.5", "--max-results", "3"])
    assert (got.min_confidence, got.max_results, got.all) == (0.5, 3, False) and arguments(["analyze", "--all"]).all
