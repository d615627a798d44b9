"""From the code of one or more repositories to the registry that scorers join."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplespark.config import Config, load
from ripplespark.operators import extract as E
from ripplespark.operators import index as I
from ripplespark.operators import resolve as R
from ripplespark.operators import routes as RT
from ripplespark.operators.scorers import Registry
from ripplespark.sources import files as sources
from ripplespark.sources import history as H

def json_files(spark: SparkSession, root: str, cfg: Config) -> DataFrame:
    """(path, content) of the JSON files under a folder that constants may come from."""
    return sources.without_ignored(sources.contents(spark, root), cfg).where(F.col("path").rlike(r"\.json$")).select("path", "content")


def scanned(spark: SparkSession, root: str, cfg: Config, test_roots: tuple[str, ...] = ()) -> DataFrame:
    """(repo_root, path, content, type) of the sources under a folder, and of the tests there and under further ones."""
    own = sources.contents(spark, root)
    tests = sources.test_files([own, *(sources.contents(spark, r) for r in test_roots)], cfg)
    return sources.source_files(own, cfg).withColumn("type", F.lit("source")).unionByName(tests.withColumn("type", F.lit("test")))


def resolved_specs(files: DataFrame, aliases: DataFrame, roots: list[str], targets: DataFrame | None = None) -> DataFrame:
    """(path, spec, target) of every import in files (path, content) that leads to one of them, or of targets (path)."""
    some = files.where(F.col("content").contains("import") | F.col("content").contains("export") | F.col("content").contains("require"))
    specs = some.select("path", F.explode_outer(E.of_code("content", E.imports)).alias("spec")).where("spec IS NOT NULL")
    specs = sources.saved(specs, "specs")  # relative ones, aliases and roots each read them
    return R.resolve_imports(specs, files if targets is None else targets, aliases, roots)


def identifiers_in_tests(files: DataFrame, resolved: DataFrame, data: DataFrame | None = None) -> DataFrame:
    """(path, value) of selectors that tests take from imported objects of constants, and from JSON files in data (path, content).

    resolved: (path, spec, target) of imports, also of those that lead to JSON files.
    """
    tests = files.where("type = 'test'")
    names = RT.bindings(tests).join(resolved, ["path", "spec"])
    consts = R.constants(files)
    consts = (consts if data is None else consts.unionByName(R.json_constants(data))).select(F.col("path").alias("target"), "name", "key", "value")
    spaces = names.where("imported = '*'").select("path", "target", F.col("name").alias("local"))
    whole = consts.join(spaces, "target").select("path", F.col("local").alias("name"), "target", "key", "value").distinct()
    named = consts.join(names.where("imported <> '*'").select("path", "target", F.col("name").alias("local"), "imported"), "target")
    named = named.where("name = imported OR imported = 'default'").select("path", F.col("local").alias("name"), "target", "key", "value")
    meant = sources.saved(whole.unionByName(named).distinct(), "meant")
    return E.with_constants(tests, meant.select("target", "name", "key", "value").distinct(), meant.select("path", "name", "target").distinct())


def build(files: DataFrame, aliases: DataFrame | None = None, roots: list[str] | None = None, cfg: Config | None = None, i18n: DataFrame | None = None, history: DataFrame | None = None, data: DataFrame | None = None, only: Collection[str] | None = None) -> Registry:
    """The registry of files (repo_root, path, content, type).

    only: names of the facts that are wanted, as of ``extract``; imports, routes and roles are always found.
    data: (path, content) of JSON files that constants may be imported from; they are no nodes of the graph.
    aliases: (prefix, target) of imports; roots: folders that bare imports are looked up in.
    What tables derive from each other is written once: the facts of files, and where
    imports lead. Files are read several times, so they should come from a stored table. Imports that
    lead to no file are left out of the graph.
    """
    spark, cfg = files.sparkSession, cfg or load()
    aliases = spark.createDataFrame([], "prefix string, target string") if aliases is None else aliases
    resolved = sources.saved(resolved_specs(files, aliases, roots or []), "resolved")
    columns = E.extract(files).columns
    read = {"imports", "routes"}  # written anew below, from where they lead
    wanted = {f.name for f in E.extract(files).schema} | {f"cypress.{f.name}" for f in E.extract(files).schema["cypress"].dataType} if only is None else set(only)
    wanted |= {"action_type_consts", "imported_idents"} if "action_types" in wanted else set()
    facts = sources.saved(E.extract(files, wanted - read), "facts")
    # the graph, and what index files pass on
    graph = resolved.select(F.col("path").alias("src"), F.col("target").alias("dst")).distinct()
    barrels = files.where(R.is_barrel(F.col("path"), F.coalesce("content", F.lit("")))).select("path")
    graph = R.expand_barrels(graph, barrels)
    imports = graph.groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("targets"))
    # literals behind imported names
    facts = R.with_imported_actions(facts, resolved) if "action_types" in wanted else facts
    held = E.of_code(F.coalesce("content", F.lit("")), lambda c: E.redux_roles(F.col("path"), c))
    roles = files.where("type = 'source'").select("path", F.explode_outer(held).alias("r")).where("r IS NOT NULL").select("path", "r.slice", "r.role")
    roles = sources.saved(roles, "roles")  # several joins go by them
    facts = I.with_chain_actions(facts, I.chains(roles, graph)) if "action_types" in wanted else facts
    # selectors behind constants
    if "cypress.selectors" in wanted:
        named = resolved
        if data is not None:
            held = data.where(F.col("path").rlike(r"\.json$"))
            named = resolved.unionByName(resolved_specs(files.where("type = 'test'"), aliases, roots or [], held))
        more = identifiers_in_tests(files, named, data).groupBy("path").agg(F.array_sort(F.collect_set("value")).alias("values"))
        css = F.transform(F.coalesce("values", F.array().cast("array<string>")), lambda v: E.css_selector(v))
        facts = facts.join(more, "path", "left").withColumn("cypress", F.when(F.col("cypress").isNotNull(), F.col("cypress").withField("selectors", F.array_union("cypress.selectors", css)))).drop("values")
    # imports as files
    empty = F.array().cast("array<string>")
    facts = facts.join(imports, "path", "left").withColumn("imports", F.coalesce("targets", empty)).select(*columns)
    # routes with the files of their components; of one pattern the last definition counts
    exports = E.export_table(files).join(resolved.select(F.col("path").alias("file"), "spec", F.col("target").alias("source")), ["file", "spec"], "left")
    exports = sources.saved(exports.where("spec IS NULL OR source IS NOT NULL").select("file", "exported", "local", "source"), "exports")  # each step through index files joins them
    routes = sources.saved(RT.located(files.where("type = 'source'"), resolved, exports), "routes")
    extracted = routes.where("component_path IS NOT NULL").groupBy("pattern").agg(F.max_by("component_path", F.struct("path", "at")).alias("component"))
    listed = routes.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", F.struct(F.col("pattern").alias("path"), "component", "component_path", "is_lazy", "is_dynamic").alias("r")))).alias("found"))
    kind = facts.schema["routes"].dataType
    facts = facts.join(listed, "path", "left").withColumn("routes", F.coalesce(F.transform("found", lambda x: x["r"]).cast(kind), F.when(F.col("type") == "source", F.array().cast(kind)))).drop("found")
    return Registry(sources.saved(facts, "files"), cfg, redux=roles, i18n=i18n, history=history, extracted_routes=extracted)


def of_repository(spark: SparkSession, root: str, cfg: Config | None = None, test_roots: tuple[str, ...] = (), locales: str | None = None) -> Registry:
    """The registry of a repository on disk, with its aliases, locale texts and commit history."""
    cfg = cfg or load()
    files = sources.saved(scanned(spark, root, cfg, test_roots), "scanned")
    found, bases = sources.tsconfig_of(root)
    aliases = spark.createDataFrame(list(found.items()), "prefix string, target string")
    bundler = sources.bundler_aliases(files.where(F.col("path").rlike(r"(^|/)(vite|webpack|rollup)\.config\.[cm]?[jt]s$")))
    aliases = aliases.unionByName(bundler.join(aliases, "prefix", "left_anti"))
    i18n = None if locales is None else sources.locale_texts(sources.contents(spark, locales).where("path LIKE '%.json'"))[0]
    return build(files, aliases, ["", *bases], cfg, i18n, H.parse(H.git_log(spark, root.rstrip("/"))), json_files(spark, root, cfg))
