"""Files, change lists, locale texts and saved registries as tables."""

from __future__ import annotations

import atexit
import json
import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Iterable
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplespark.config import Config
from ripplespark.functions import text as T

# Endings of sources and tests.
SOURCE_FILES = r"(?i)\.(tsx?|jsx?)$"
TEST_FILES = r"(?i)(\.(cy|spec|test|e2e)\.(tsx?|jsx?)$|(^|/)__tests__/)"
#: Rules by which tests are never suggested: a part of any folder or file name, or a whole file name.
EXCLUSIONS = [("interops-specs", "segment", "InterOps"), ("dm-sanity", "name", "dmSanity.cy.ts")]
DIFF_CHARS = 4000


def glob_regex(pattern: str) -> str:
    """A glob with **, *, ? and {a,b} as a regular expression for whole paths."""
    out, braces = "", 0
    for token in re.findall(r"\*\*/|\*\*|\*|\?|\{|\}|,|.", pattern, re.S):
        braces += (token == "{") - (token == "}")
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(token) or ("|" if token == "," and braces else re.escape(token))
    return f"^{out}$"


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(repo_root, path, content) of every file under a folder, one row a file."""
    raw = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("content"))
    inside = re.escape(root.rstrip("/").removeprefix("file://"))
    return raw.select(F.lit(root.rstrip("/")).alias("repo_root"), F.regexp_replace(F.expr("url_decode(replace(uri, '+', '%2B'))"), f"^(?:[a-z]+:/*(?=/))?{inside}/", "").alias("path"), "content")


def without_ignored(files: DataFrame, cfg: Config) -> DataFrame:
    """Files in no ignored folder that match no excluded pattern."""
    folders = "|".join(map(re.escape, cfg.source.ignore_dirs))
    kept = files.where(~F.col("path").rlike(f"(^|/)({folders})/"))
    for pattern in cfg.source.exclude:
        kept = kept.where(~F.col("path").rlike(glob_regex(pattern)))
    return kept


def source_files(files: DataFrame, cfg: Config, tests: str = TEST_FILES) -> DataFrame:
    """Source files; what is a test is no source."""
    return without_ignored(files, cfg).where(F.col("path").rlike(SOURCE_FILES) & ~F.col("path").rlike(tests))


def test_files(roots: Iterable[DataFrame], cfg: Config, patterns: list[str] | None = None) -> DataFrame:
    """Tests of one or more repositories, each file once."""
    parts = list(roots)
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    wanted = "|".join(f"(?:{glob_regex(p)})" for p in patterns) if patterns else TEST_FILES
    return without_ignored(both, cfg).where(F.col("path").rlike(wanted)).dropDuplicates(["repo_root", "path"])


def excluded(tests: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Tests with the first rule against them, or null: of (id, 'segment' or 'name', text), without regard to case."""
    rule = F.lit(None).cast("string")
    for name, kind, text in reversed(EXCLUSIONS if rules is None else rules):
        hit = F.lower(T.basename("path")) == text.lower() if kind == "name" else F.exists(T.segments("path"), lambda s: F.lower(s).contains(text.lower()))  # noqa: B023
        rule = F.when(hit, F.lit(name)).otherwise(rule)
    return tests.withColumn("rule", rule)


def suggestable(tests: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Tests that no rule excludes, and the others as (path, rule)."""
    marked = excluded(tests, rules)
    return marked.where("rule IS NULL").drop("rule"), marked.where("rule IS NOT NULL").select("path", "rule")


# changes -------------------------------------------------------------------------------


def explicit_changes(spark: SparkSession, given: str) -> DataFrame:
    """(path) of a list with spaces or commas between."""
    row = spark.createDataFrame([(given,)], "given string")
    return row.select(F.explode(F.split("given", r"[\s,]+")).alias("path")).where("path <> ''").dropDuplicates()


def _git(root: str, *args: str) -> str | None:
    try:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True, timeout=120).stdout
    except (OSError, subprocess.SubprocessError):
        return None


def changed_paths(spark: SparkSession, root: str, base: str | None = None, target: str | None = None) -> DataFrame:
    """(path) of changed files: between two commits, else in the work tree, else in the last commit; none on errors."""
    ranges = [f"{base}..{target}"] if base and target else ["HEAD", "HEAD~1..HEAD"]
    names: list[str] = []
    for r in ranges:
        names = [x for x in (_git(root, "diff", "--name-only", r) or "").splitlines() if x]
        if names:
            break
    return spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "path string")


def changed_diffs(spark: SparkSession, root: str, base: str | None = None, target: str | None = None) -> DataFrame:
    """(path, diff) of changed files with a line of context, by one call of git; none on errors."""
    ranges = [f"{base}..{target}"] if base and target else ["HEAD", "HEAD~1..HEAD"]
    for r in ranges:
        parts = re.split(r"(?m)^(?=diff --git )", _git(root, "diff", "--unified=1", "--no-color", r) or "")
        found = [(m[1], part) for part in parts if (m := re.search(r"(?m)^(?:\+\+\+ b/|rename to |diff --git a/.* b/)(.+)$", part[part.find("\n+++ ") + 1 :] if "\n+++ b/" in part else part))]
        if found:
            return spark.createDataFrame(found, "path string, diff string")
    return spark.createDataFrame([], "path string, diff string")


def diff_texts(changes: DataFrame) -> DataFrame:
    """(path, summary) of (path, diff, content): the diff, else the content, else the path, cut to a length."""
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    return changes.select("path", F.substring(F.coalesce(blank("diff"), blank("content"), "path"), 1, DIFF_CHARS).alias("summary"))


# locale texts --------------------------------------------------------------------------

_HOLES = [r"\{\{\s*[^{}]*\}\}", r"%\([^()]*\)[sd]", r"\{[^{}]*\}"]


def flattened(value: object, prefix: str = "") -> list[tuple[str, str]]:
    """Texts of a nested object by dotted key."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in flattened(v, f"{prefix}.{k}" if prefix else str(k))]
    return [(prefix, value)] if isinstance(value, str) and prefix else []


def locale_texts(files: DataFrame, namespaced: bool = False) -> tuple[DataFrame, DataFrame]:
    """Texts (key, text, static_text, is_dynamic) of locale files (path, content), and warnings (path, code).

    With ``namespaced`` the file's name stands before its keys.
    """

    @F.pandas_udf("struct<ok:boolean,texts:array<struct<key:string,text:string>>>")
    def parsed(content: pd.Series) -> pd.DataFrame:
        out = []
        for text in content:
            try:
                out.append((True, [{"key": k, "text": v} for k, v in flattened(json.loads(text))]))
            except (TypeError, ValueError):
                out.append((False, []))
        return pd.DataFrame(out, columns=["ok", "texts"])

    read = files.withColumn("p", parsed("content"))
    space = F.concat(F.regexp_replace(T.basename("path"), r"\.json$", ""), F.lit(".")) if namespaced else F.lit("")
    each = read.select(space.alias("space"), F.explode("p.texts").alias("t")).select(F.concat("space", "t.key").alias("key"), F.col("t.text").alias("text"))
    static = F.col("text")
    for hole in _HOLES:
        static = F.regexp_replace(static, hole, " ")
    texts = each.select("key", "text", F.trim(F.regexp_replace(static, r"\s+", " ")).alias("static_text"), F.col("text").rlike("|".join(_HOLES)).alias("is_dynamic"))
    code = F.when(F.col("content").isNull(), "FILE_NOT_FOUND").when(~F.col("p.ok"), "INVALID_JSON").when(F.size("p.texts") == 0, "EMPTY_TRANSLATION_FILE")
    return texts, read.select("path", code.alias("code")).where("code IS NOT NULL")


def missing_locales(spark: SparkSession, wanted: list[str], files: DataFrame) -> DataFrame:
    """(path, code) of wanted folders in which no file was found."""
    folders = spark.createDataFrame([(w.rstrip("/"),) for w in wanted], "path string")
    found = files.select(T.dirname("path").alias("path")).distinct()
    return folders.join(found, "path", "left_anti").select("path", F.lit("LOCALE_DIR_MISSING").alias("code"))


# aliases -------------------------------------------------------------------------------


def tsconfig_aliases(configs: dict[str, dict], start: str) -> tuple[dict[str, str], list[str]]:
    """(prefix → target, base folders) of a tsconfig and those that it extends or refers to; nearer files win.

    configs: parsed files by path. Config files are few and small; this runs in the driver.
    """
    aliases: dict[str, str] = {}
    roots: list[str] = []
    seen, todo = set(), [start]
    while todo:
        path = todo.pop(0)
        if path in seen or path not in configs:
            continue
        seen.add(path)
        here, options = path.rpartition("/")[0], configs[path].get("compilerOptions", {})
        join = lambda *parts: re.sub(r"/\.(?=/|$)|^\./", "", "/".join(p for p in parts if p))
        base = join(here, options.get("baseUrl", "").rstrip("/"))
        if "baseUrl" in options:
            roots.append(base)
        for prefix, targets in options.get("paths", {}).items():
            if targets:
                aliases.setdefault(prefix.removesuffix("/*"), join(base, targets[0].removesuffix("/*")))
        more = [configs[path].get("extends"), *(r.get("path") for r in configs[path].get("references", []))]
        todo += [join(here, m) if m.endswith(".json") else join(here, m, "tsconfig.json") for m in more if m]
    return aliases, roots


def tsconfig_of(root: str) -> tuple[dict[str, str], list[str]]:
    """Aliases and base folders, from the root on, of the tsconfig or jsconfig in it and in the folders above; nearer ones win."""
    root = os.path.abspath(root.removeprefix("file://"))
    aliases: dict[str, str] = {}
    bases: list[str] = []
    folder = root
    while True:
        for name in ("tsconfig.json", "tsconfig.base.json", "jsconfig.json"):
            start = os.path.join(folder, name)
            if os.path.isfile(start):
                found, roots = tsconfig_aliases(_ConfigFiles(), start)
                inside = lambda p: os.path.relpath(p, root).replace(os.sep, "/").removeprefix("./")
                for prefix, target in found.items():
                    aliases.setdefault(prefix, inside(target))
                bases += [b for b in (inside(r) for r in roots) if not b.startswith("..") and b not in bases]
        above = os.path.dirname(folder)
        if above == folder:
            return aliases, ["" if b == "." else b for b in bases]
        folder = above


class _ConfigFiles(dict):
    """Configs by path, read when asked for; comments and commas before a closing bracket are put up with."""

    def __contains__(self, path: object) -> bool:
        if path not in self.keys():
            try:
                with open(str(path), encoding="utf-8") as file:
                    text = re.sub(r'("(?:[^"\\\n]|\\.)*")|/\*.*?\*/|//[^\n]*', lambda m: m[1] or "", file.read(), flags=re.S)
                self[path] = json.loads(re.sub(r",(\s*[}\]])", r"\1", text))
            except (OSError, ValueError):
                return False
        return True


def bundler_aliases(files: DataFrame) -> DataFrame:
    """(prefix, target) that bundler configs (path, content) name, in three usual forms."""
    q, key = r"""["']([^"']+)["']""", r"""["']?([@\w~$./-]+)["']?"""
    forms = [rf"{key}\s*:\s*path\.resolve\(\s*__dirname\s*,\s*{q}\s*\)", rf"find\s*:\s*{q}\s*,\s*replacement\s*:\s*path\.resolve\(\s*__dirname\s*,\s*{q}\s*\)", rf"find\s*:\s*{q}\s*,\s*replacement\s*:\s*{q}"]
    found = None
    for form in forms:
        pairs = F.arrays_zip(F.regexp_extract_all("content", F.lit(form), 1).alias("k"), F.regexp_extract_all("content", F.lit(form), 2).alias("v"))
        part = files.select(F.explode(pairs).alias("p")).select(F.col("p.k").alias("prefix"), F.regexp_replace("p.v", r"^\./|/$", "").alias("target"))
        found = part if found is None else found.unionByName(part)
    return found.where("prefix NOT IN ('find', 'replacement')").dropDuplicates(["prefix"])


# stored tables -------------------------------------------------------------------------


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
    """``df`` written to the shared folder and read again, which cuts its lineage and lets several plans use it."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid4().hex}"
    df.write.parquet(path)
    return never_broadcast(df.sparkSession.read.schema(df.schema).parquet(path))


def never_broadcast(stored: DataFrame) -> DataFrame:
    """A stored table whose joins sort and merge.

    What a few columns of wide, well packed rows take in memory is a hundred times what the
    planner reckons from the file's size, so it would send millions of paths through the driver.
    """
    return stored.hint("merge")


def write_registry(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table as Parquet in a folder of its own."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_registry(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {name: never_broadcast(spark.read.parquet(f"{folder}/{name}")) for name in names}


def manifest(files: DataFrame) -> DataFrame:
    """(repo_root, path, digest) of contents, by which a stored registry is known to be stale."""
    return files.select("repo_root", "path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"))


def stale(files: DataFrame, stored: DataFrame) -> DataFrame:
    """(repo_root, path) of files that are new, gone or have another content than the stored manifest says."""
    now = manifest(files)
    both = now.withColumnRenamed("digest", "now").join(stored.withColumnRenamed("digest", "then"), ["repo_root", "path"], "full_outer")
    return both.where("now IS DISTINCT FROM then").select("repo_root", "path")


def results_json(results: DataFrame) -> DataFrame:
    """One JSON text for each changed file with its ranked tests."""
    tests = F.array_sort(F.collect_list(F.struct("rank", "test", "score", "confidence", "explanation")))
    return results.groupBy("changed").agg(tests.alias("tests")).select(F.to_json(F.struct("changed", "tests")).alias("value"))


def write_results(results: DataFrame, folder: str) -> None:
    results_json(results).write.mode("overwrite").text(folder)

