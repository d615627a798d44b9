"""Commit history from a log with one record for each commit.

A record is 'seconds', an empty line and one line for each file: a status, a tab and a
path, or for renames and copies the old and the new path.  Records come newest first.
"""

from __future__ import annotations

import subprocess
from collections.abc import Mapping
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplespark.streaming.keyed import KeyedTable

from .files import saved, shared_folder

#: What git is asked for.
LOG = ["-c", "core.quotePath=false", "log", "--no-merges", "-M", "--name-status", "--pretty=format:%x00%ct"]
_PIECE = 1 << 20


def git_log(spark: SparkSession, root: str, span: str | None = None) -> DataFrame:
    """(repo, pos, record) of a repository's log, or of a span of commits; no rows where there is none, or only a part of it.

    The log goes to a file in the shared folder piece by piece, each record with its number,
    and Spark reads it in splits; neither the driver nor a task holds it whole.
    """
    empty = spark.createDataFrame([], "repo string, pos int, record string")
    git = ["git", "-C", root]
    try:
        asked = subprocess.run([*git, "rev-parse", "--is-shallow-repository"], capture_output=True, text=True, check=True, timeout=60)
        if asked.stdout.strip() != "false":
            return empty
        path = f"{shared_folder(spark).removeprefix('file://')}/log-{uuid4().hex}"
        with subprocess.Popen([*git, *LOG, *([span] if span else [])], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run:
            numbered(spark, path, run.stdout)
        if run.returncode:
            return empty
    except (OSError, subprocess.SubprocessError):
        return empty
    read = spark.read.option("lineSep", "\u0001").text(path).where("value <> ''")
    return read.select(F.lit(root).alias("repo"), F.substring_index("value", "\u0000", 1).cast("int").alias("pos"), F.expr("substring(value, instr(value, '\u0000') + 1)").alias("record")).where("trim(record) <> ''")


def numbered(spark: SparkSession, path: str, log) -> None:
    """Writes a log's records, which a zero byte begins, with their numbers before them."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop)
    n, rest = 0, b""
    try:
        while piece := log.read(_PIECE):
            *whole, rest = (rest + piece).split(b"\0")
            out.write(bytearray(b"".join(b"%d\0%s\1" % (n + k, r) for k, r in enumerate(whole))))
            n += len(whole)
        out.write(bytearray(b"%d\0%s\1" % (n, rest)))
    finally:
        out.close()


def records(logs: DataFrame) -> DataFrame:
    """(repo, pos, record) of logs (repo, raw)."""
    return logs.select("repo", F.posexplode(F.split("raw", "\u0000")).alias("pos", "record")).where("trim(record) <> ''")


def _read(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What records (repo, pos, record) touch (repo, pos, ts, size, path), and renames (repo, at, old, new)."""
    lines = F.filter(F.split("record", r"\r?\n"), lambda x: F.trim(x) != "")
    head = found.withColumn("l", lines)
    head = head.where("size(l) > 0").select("repo", "pos", F.expr("try_cast(trim(l[0]) AS BIGINT)").alias("ts"), F.expr("slice(l, 2, greatest(size(l) - 1, 0))").alias("files")).where("ts IS NOT NULL")
    each = head.select("repo", "pos", "ts", F.size("files").alias("size"), F.explode("files").alias("line")).select("repo", "pos", "ts", "size", F.split("line", "\t").alias("f"))
    touched = each.where("f[0] NOT LIKE 'D%'").select("repo", "pos", "ts", "size", F.when(F.expr("f[0] RLIKE '^[RC]'"), F.get("f", F.lit(2))).otherwise(F.get("f", F.lit(1))).alias("path")).where("path IS NOT NULL")
    renames = each.where("f[0] LIKE 'R%' AND size(f) > 2").select("repo", F.col("pos").alias("at"), F.get("f", F.lit(1)).alias("old"), F.get("f", F.lit(2)).alias("new"))
    return touched, renames


def parse(found: DataFrame) -> DataFrame:
    """(repo, path, created_at, updated_at, commits) of records (repo, pos, record).

    A commit's size is the number of its files, deleted ones too; files are known by their
    latest name. Commits are in the order of the log, newest first.
    """
    named = latest_names(*_read(found))
    commit = F.struct(F.col("pos"), F.col("ts"), F.col("size"))
    files = named.groupBy("repo", "path").agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.array_sort(F.collect_set(commit)).alias("c"))
    return files.select("repo", "path", "created_at", "updated_at", F.transform("c", lambda c: F.struct(c["ts"].alias("ts"), c["size"].alias("size"))).alias("commits"))


def latest_names(touched: DataFrame, renames: DataFrame) -> DataFrame:
    """``touched`` (repo, pos, ts, size, path) with the name that each path has now.

    A rename holds for records at or after it in the log, which are older. Each step
    follows the next rename of those paths that have one, and what it leaves is written, so
    that a chain of any length costs what it moves.
    """
    columns = ["repo", "pos", "ts", "size", "path"]
    if renames.isEmpty():
        return touched
    renames = saved(renames.distinct(), "renames")
    settled, now = [], touched.withColumn("until", F.col("pos"))
    while True:
        hit = (F.col("path") == F.col("old")) & (F.col("n.repo") == F.col("r.repo")) & (F.col("at") <= F.col("until"))
        step = now.alias("n").join(renames.alias("r"), hit, "left").groupBy("n.repo", "pos", "ts", "size", "path", "until").agg(F.max_by(F.struct("new", "at"), "at").alias("next"))
        step = saved(step, "renamed")
        settled.append(step.where("next IS NULL").select(*columns))
        moved = step.where("next IS NOT NULL")
        if moved.isEmpty():
            break
        now = moved.select("repo", "pos", "ts", "size", F.col("next.new").alias("path"), (F.col("next.at") - 1).alias("until"))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def buckets(commits: DataFrame, window_s: int, max_files: int = 30) -> DataFrame:
    """(repo, path, bucket) of commits (repo, path, ts, size) that aren't too large."""
    return commits.where(F.col("size") <= max_files).select("repo", "path", F.floor(F.col("ts") / window_s).alias("bucket")).distinct()


#: Bits of a number, and numbers of a page: pairs meet by pages of 62 * 8 buckets.
_BITS, _WORDS = 62, 8


def shared_buckets(buckets: DataFrame, blocks: int = 16, more: DataFrame | None = None) -> DataFrame:
    """(a, b, co) of distinct (path, bucket): pairs a < b with a bucket in common, and how many.

    The bits of a few numbers stand for a page of buckets. Files are dealt over blocks, and every two blocks are a
    task, in which their files meet page by page. A pair is written by the first page with a
    bucket in common, which knows of the later ones, so pairs are never grouped or shuffled.
    more: (path, ...) of every file; its other columns come with either side as a_... and b_....
    """
    page, words = F.floor(F.col("bucket") / (_BITS * _WORDS)).alias("page"), [f"w{k}" for k in range(_WORDS)]
    at = F.pmod(F.col("bucket"), F.lit(_BITS * _WORDS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(bucket, {_BITS}) AS INT))")
    pages = buckets.groupBy("path", page).agg(*(F.coalesce(F.bit_or(F.when(F.floor(at / _BITS) == k, bit)), F.lit(0)).cast("long").alias(w) for k, w in enumerate(words)))
    every = pages.groupBy("path").agg(F.collect_list(F.struct("page", F.array(*words).alias("words"))).alias("pages"))
    held = every.select("path", F.explode("pages").alias("p"), F.when(F.size("pages") > 1, F.col("pages")).alias("pages"))
    held = held.select("path", F.col("p.page").alias("page"), *(F.col("p.words")[k].alias(w) for k, w in enumerate(words)), "pages")
    others = [] if more is None else [c for c in more.columns if c != "path"]
    held = held if more is None else held.join(more, "path")
    block = F.pmod(F.xxhash64("path"), F.lit(blocks)).cast("int")
    # a file goes to the tasks of its block with every block; of two blocks, the lower one's files stand on the left
    held = held.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = held.withColumn("tile", F.least("block", "other") * blocks + F.greatest("block", "other"))
    side = lambda p, which: which.select("tile", "page", *(F.col(c).alias(f"{p}_{c}") for c in ("path", "block", *words, "pages", *others)))
    dealt = lambda df: df.repartition(blocks * (blocks + 1) // 2, "tile", "page")
    own = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"x_{w}").bitwiseAND(F.col(f"y_{w}"))) for w in words))

    def meet(held: DataFrame) -> DataFrame:
        left, right = side("x", held.where("block <= other")), side("y", held.where("block >= other"))
        return dealt(left).hint("merge").join(dealt(right), ["tile", "page"]).withColumn("own", own).where("own > 0 AND (x_block < y_block OR x_path < y_path)")

    # where either file has one page only, nothing is before or after it; such pairs, mostly all, stand apart for their plain expressions
    one = meet(held).where("x_pages IS NULL OR y_pages IS NULL").withColumn("co", F.col("own").cast("long"))
    several = meet(held.where("pages IS NOT NULL")).where(~F.exists("x_pages", lambda p: (p["page"] < F.col("page")) & (_common("y_pages", p) > 0)))
    later = F.aggregate("x_pages", F.lit(0), lambda n, p: n + F.when(p["page"] > F.col("page"), _common("y_pages", p)).otherwise(0))
    met = one.unionByName(several.withColumn("co", (F.col("own") + later).cast("long")))
    first = F.col("x_path") < F.col("y_path")
    pick = lambda c: (F.when(first, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}")), F.when(first, F.col(f"y_{c}")).otherwise(F.col(f"x_{c}")))
    ends = [(f"a_{c}" if c != "path" else "a", f"b_{c}" if c != "path" else "b", *pick(c)) for c in ("path", *others)]
    return met.select(*(x.alias(n) for n, _, x, _ in ends[:1]), *(y.alias(n) for _, n, _, y in ends[:1]), "co", *(c for a, b, x, y in ends[1:] for c in (x.alias(a), y.alias(b))))


def _common(pages: str, page: Column) -> Column:
    """How many buckets of a page are in the same page of an array of pages."""
    same = F.filter(pages, lambda q: q["page"] == page["page"])
    return F.aggregate(F.flatten(F.transform(same, lambda q: F.zip_with(q["words"], page["words"], lambda v, w: F.bit_count(v.bitwiseAND(w))))), F.lit(0), lambda n, c: n + c)


class Histories:
    """Histories of files that take in a log's newer records only, and write only the files that these touch or rename.

    Commits are numbered from the oldest on, so that what is stored keeps its numbers. A log
    that has been rewritten, so that the last known commit isn't in it, is read anew.
    """

    ROW = "name string, repo string, path string, commits array<struct<n:bigint,ts:bigint,size:int>>"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.table = KeyedTable(spark, f"{self.folder}/files", self.ROW, "name")
        self.heads = KeyedTable(spark, f"{self.folder}/heads", "repo string, head string, commits bigint, number bigint", "repo", 1)

    def read(self) -> DataFrame:
        """As ``parse`` gives them."""
        newest = F.reverse(F.array_sort("commits"))
        plain = F.transform(newest, lambda c: F.struct(c["ts"].alias("ts"), c["size"].alias("size")))
        times = F.transform("commits", lambda c: c["ts"])
        return self.table.read().select("repo", "path", F.array_min(times).alias("created_at"), F.array_max(times).alias("updated_at"), plain.alias("commits"))

    def add(self, found: DataFrame, number: int, before: Mapping[str, int] | None = None) -> None:
        """Takes in records (repo, pos, record) that are newer than all before; before: how many commits of a repository are known."""
        found = saved(found, "newer")
        most = found.groupBy("repo").agg(F.max("pos").alias("last"))
        known = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in (before or {"": 0}).items() for x in kv)), F.col("repo")), F.lit(0)).cast("bigint")
        touched, renames = _read(found)
        renames = saved(renames, "newer-renames")
        commit = F.struct((known + F.col("last") - F.col("pos")).cast("bigint").alias("n"), "ts", "size")
        news = latest_names(touched, renames).join(most, "repo").groupBy("repo", "path").agg(F.collect_set(commit).alias("commits"))
        # What is known under an old name is as if it stood behind all newer records.
        name = F.concat("repo", F.lit("\u0000"), "path")
        old = self.table.get(renames.select(F.concat("repo", F.lit("\u0000"), "old").alias("name")))
        numbered_ = saved(old.withColumn("ts", F.monotonically_increasing_id()), "renamed-files")
        behind = numbered_.select("repo", F.lit(2**31 - 1).alias("pos"), "ts", F.lit(0).alias("size"), "path")
        moved = latest_names(behind, renames).select("repo", "ts", F.col("path").alias("now")).join(numbered_, ["repo", "ts"])
        moved = moved.select("repo", F.col("now").alias("path"), "commits")
        both = saved(news.unionByName(moved).withColumn("name", name), "touched-files")
        gone = numbered_.select("name").join(both.select("name"), "name", "left_anti")
        stay = self.table.get(both.select("name")).join(numbered_.select("name"), "name", "left_anti").select("repo", "path", "commits", "name")
        rows = both.unionByName(stay).groupBy("name", "repo", "path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("commits")))).alias("commits"))
        self.table.put(rows, number, both.select("name").unionByName(gone))

    def update(self, root: str) -> int:
        """Takes in what a repository's log has gained and returns how many records that is."""
        git = ["git", "-C", root]
        said = subprocess.run([*git, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=60)
        if said.returncode:
            return 0
        head = said.stdout.strip()
        known = self.heads.get(self.spark.createDataFrame([(root,)], "repo string")).first()
        if known and subprocess.run([*git, "merge-base", "--is-ancestor", known["head"], head], capture_output=True, timeout=60).returncode:
            lost = self.table.read().where(F.col("repo") == root)
            self.table.put(lost.limit(0), known["number"] + 1, lost.select("name"))
            known = {"head": None, "commits": 0, "number": known["number"] + 1}
        number = known["number"] + 1 if known else 0
        if known and known["head"] == head:
            return 0
        found = saved(git_log(self.spark, root, f"{known['head']}..{head}" if known and known["head"] else None), "log")
        n = found.count()
        commits = known["commits"] if known else 0
        if n:
            self.add(found, number, {root: commits})
        self.heads.put(self.spark.createDataFrame([(root, head, commits + n, number)], self.heads.schema), number)
        return n
