"""Indexes over the table of files: exploded pairs instead of maps, so that lookups are joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplespark.functions import text as T


def sources(files: DataFrame) -> DataFrame:
    return files.where("type = 'source'")


def tests(files: DataFrame) -> DataFrame:
    return files.where("type = 'test'")


def selectors(files: DataFrame) -> DataFrame:
    """(value, path, attr, pos) of selectors in source files."""
    each = sources(files).select("path", F.posexplode("selectors").alias("pos", "s"))
    return each.select(F.col("s.value").alias("value"), "path", F.col("s.attr").alias("attr"), "pos").where("value <> ''")


def test_selectors(files: DataFrame) -> DataFrame:
    """(test, pos, type, value): selectors of tests in normal form; others are left out."""
    each = tests(files).select(F.col("path").alias("test"), F.posexplode("cypress.selectors").alias("pos", "s"))
    return each.select("test", "pos", T.normal_selector("s.type", "s.value").alias("n")).where("n IS NOT NULL").select("test", "pos", "n.type", "n.value")


def test_ids(files: DataFrame) -> DataFrame:
    """(test, pos, value) of id selectors in tests."""
    each = tests(files).select(F.col("path").alias("test"), F.posexplode("cypress.selectors").alias("pos", "s"))
    return each.where("s.type = 'id'").select("test", "pos", F.col("s.value").alias("value"))


def selector_frequency(files: DataFrame) -> DataFrame:
    """(value, n_tests, share): how many tests use a selector, and their share of all tests."""
    n = tests(files).agg(F.count("*").alias("n"))
    counted = test_selectors(files).select("test", "value").distinct().groupBy("value").agg(F.count("*").alias("n_tests"))
    return counted.join(n).select("value", "n_tests", (F.col("n_tests") / F.col("n")).alias("share"))


def top_selectors(files: DataFrame, k: int = 30) -> DataFrame:
    return selector_frequency(files).orderBy(F.desc("n_tests"), "value").limit(k)


def routes(files: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """(pattern, component, ordinal): for each route pattern the file that renders it; the last definition wins.

    A route names a component. Its file is the import of the declaring file with that base
    name (or an index file in a folder of that name), else the source file of that name,
    else the declaring file. ``extracted`` (pattern, component) overrides.
    """
    declared = sources(files).select("path", "imports", F.posexplode("routes").alias("pos", "r")).select("path", "pos", F.col("r.path").alias("pattern"), F.col("r.component").alias("name"), F.col("r.component_path").alias("given"), "imports").where("pattern IS NOT NULL")
    bare = lambda c: F.regexp_replace(T.basename(c), T.SOURCE_ENDING, "")
    imported = declared.select("path", "pos", "name", F.posexplode("imports").alias("k", "target"))
    hit = (bare("target") == F.col("name")) | ((bare("target") == "index") & (T.basename(T.dirname("target")) == F.col("name")))
    by_import = imported.where(hit).groupBy("path", "pos").agg(F.min_by("target", "k").alias("by_import"))
    named = sources(files).select(bare("path").alias("name"), F.col("path").alias("p")).groupBy("name").agg(F.max("p").alias("by_name"))
    found = declared.join(by_import, ["path", "pos"], "left").join(named, "name", "left")
    found = found.select("pattern", F.coalesce("given", "by_import", "by_name", "path").alias("component"), F.struct("path", "pos").alias("ordinal"))
    base = found.groupBy("pattern").agg(F.max_by("component", "ordinal").alias("component"), F.min("ordinal").alias("ordinal"))
    if extracted is None:
        return base
    both = base.join(extracted.select("pattern", F.col("component").alias("better")), "pattern", "full_outer")
    return both.select("pattern", F.coalesce("better", "component").alias("component"), F.coalesce("ordinal", F.struct(F.col("better").alias("path"), F.lit(0).alias("pos"))).alias("ordinal"))


def visits(files: DataFrame) -> DataFrame:
    """(test, pos, raw, url) of routes that tests visit."""
    return tests(files).select(F.col("path").alias("test"), F.posexplode("cypress.visited_routes").alias("pos", "raw")).withColumn("url", T.visited_url("raw"))


def texts(files: DataFrame) -> DataFrame:
    """(text, path) of shown texts of more than three characters, trimmed and in lower case."""
    each = sources(files).select(F.explode(F.transform("jsx_text", lambda t: F.lower(F.trim(t)))).alias("text"), "path")
    return each.where(F.length("text") > 3).distinct()


def action_types(files: DataFrame) -> DataFrame:
    """(value, path, pos) of action types in sources and tests, at their first place in the file."""
    return files.select("path", F.posexplode("action_types").alias("pos", "value")).groupBy("value", "path").agg(F.min("pos").alias("pos"))


def chains(redux: DataFrame, graph: DataFrame) -> DataFrame:
    """(slice, role, path) from extracted roles, and as 'consumer' the files that import a slice's selectors.

    redux: (path, slice, role). Files of role 'types' and files without a slice are no members.
    """
    members = redux.where("slice IS NOT NULL AND role <> 'types'").select("slice", "role", "path").distinct()
    selected = members.where("role = 'selectors'").select("slice", F.col("path").alias("dst"))
    consumers = graph.join(selected, "dst").select("slice", F.lit("consumer").alias("role"), F.col("src").alias("path"))
    return members.unionByName(consumers.distinct())


def with_chain_actions(files: DataFrame, chain: DataFrame) -> DataFrame:
    """Files, where the action types of a slice's members are also those of its slice file."""
    each = chain.where("role <> 'consumer'").join(action_types(files), "path").select("slice", "value")
    more = each.join(chain.where("role = 'slice'").select("slice", "path"), "slice").groupBy("path").agg(F.array_sort(F.collect_set("value")).alias("more"))
    empty = F.array().cast("array<string>")
    return files.join(more, "path", "left").withColumn("action_types", F.array_union(F.coalesce("action_types", empty), F.coalesce("more", empty))).drop("more").select(*files.columns)


def token_shares(files: DataFrame) -> DataFrame:
    """(token, share): the share of all files whose name has the token."""
    n = files.agg(F.count("*").alias("n"))
    tokens = F.when(F.col("type") == "test", T.name_tokens("path", True)).otherwise(T.name_tokens("path", False))
    counted = files.select("path", F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("files"))
    return counted.join(n).select("token", (F.col("files") / F.col("n")).alias("share"))


def title_idf(files: DataFrame) -> DataFrame:
    """(token, idf) of words in titles of tests: 1 - ln(df) / ln(N + 1), at least 0.1; N counts all tests."""
    n = tests(files).agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    each = titles(files).select(F.explode("tokens").alias("token"))  # distinct in a test already
    df = each.groupBy("token").agg(F.count("*").alias("df"))
    return df.join(n).select("token", F.greatest(F.lit(0.1), 1 - F.ln("df") / F.ln(F.col("n") + 1)).alias("idf"))


def titles(files: DataFrame) -> DataFrame:
    """(test, tokens): the distinct words of a test's titles."""
    empty = F.array().cast("array<string>")
    all_titles = F.concat(F.coalesce("cypress.describes", empty), F.coalesce("cypress.its", empty))
    tokens = F.array_distinct(F.flatten(F.transform(all_titles, T.title_tokens)))
    return tests(files).select(F.col("path").alias("test"), tokens.alias("tokens")).where(F.size("tokens") > 0)


def translations(entries: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text, key) for exact and static texts of translations, and (key, path) of the files that use them."""
    exact = entries.select("key", F.lower(F.trim("text")).alias("text"))
    static = entries.where("is_dynamic").select("key", F.lower(F.trim("static_text")).alias("text"))
    used = sources(files).select(F.explode("translation_keys").alias("key"), "path").distinct()
    return exact.unionByName(static).where("text <> ''").distinct(), used


def stats(files: DataFrame, graph: DataFrame) -> DataFrame:
    """One row of counters over the indexes."""
    n = lambda cond: F.count_if(F.expr(cond)).alias
    total = files.agg(F.count("*").alias("files"), n("type = 'source'")("sources"), n("type = 'test'")("tests"), F.sum(F.when(F.col("routes").isNull(), 0).otherwise(F.size("routes"))).alias("routes"))
    more = [graph.agg(F.count("*").alias("edges")), selectors(files).agg(F.count_distinct("value").alias("selectors")), action_types(files).agg(F.count_distinct("value").alias("action_types"))]
    for part in more:
        total = total.join(part)
    return total


def lookup(files: DataFrame, paths: DataFrame) -> DataFrame:
    """The files with these paths."""
    return files.join(paths.select("path").distinct(), "path", "left_semi")
