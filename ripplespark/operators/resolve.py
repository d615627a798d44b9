"""Which file an import means: every file says which paths can mean it, and imports are joined to these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplespark.functions import text as T
from ripplespark.schema import EXTENSIONS

DEPTH = 5


def meant_by(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(target, base, k) of files (path): the paths without ending that can mean each, by rank.

    A path means best the file of just that name, then one with an ending, then a folder's index.
    """
    path = F.col("path")
    whole = F.struct(path.alias("base"), F.lit(0).alias("k"))
    cut = lambda tail, k: F.when(path.endswith(tail), F.struct(F.substr(path, F.lit(1), F.length(path) - len(tail)).alias("base"), F.lit(k).alias("k")))
    ways = F.array(whole, *(cut(e, 1 + i) for i, e in enumerate(extensions)), *(cut(f"/index{e}", 1 + len(extensions) + i) for i, e in enumerate(extensions)))
    return files.select(path.alias("target"), F.explode(F.filter(ways, lambda x: x.isNotNull())).alias("w")).select("target", "w.base", "w.k")


def bases(imports: DataFrame, aliases: DataFrame, roots: list[str]) -> DataFrame:
    """(path, spec, way, base): where each import (path, spec) can point.

    Relative ones go by the file's folder; others by every alias (prefix, target) that they
    begin with, or else by the base folders in order.
    """
    relative = F.col("spec").startswith(".")
    near = imports.where(relative).select("path", "spec", F.lit(0).alias("way"), T.normal_path(F.concat(T.dirname("path"), F.lit("/"), F.col("spec"))).alias("base"))
    far = imports.where(~relative)
    # an alias is the whole import or its first parts, so both meet on these
    parts = F.split("spec", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    tail = F.substr(F.col("spec"), F.length("prefix") + 1)
    by_alias = far.select("path", "spec", F.explode(heads).alias("prefix")).join(aliases, "prefix").select("path", "spec", (1000 - F.length("prefix")).alias("way"), T.normal_path(F.concat("target", tail)).alias("base"))
    by_root = far.join(by_alias.select("path", "spec"), ["path", "spec"], "left_anti").select("path", "spec", F.posexplode(F.array(*(F.lit(r) for r in roots)) if roots else F.array().cast("array<string>")).alias("way", "root"))
    rooted = by_root.select("path", "spec", "way", T.normal_path(F.concat("root", F.lit("/"), F.col("spec"))).alias("base"))
    return near.unionByName(by_alias).unionByName(rooted)


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame, roots: list[str] | None = None, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, spec, target) of imports (path, spec): the first candidate that exists; others are dropped."""
    found = bases(imports.distinct(), aliases, roots or []).join(meant_by(files.select("path").distinct(), extensions), "base")
    return found.groupBy("path", "spec").agg(F.min_by("target", F.struct("way", "k")).alias("target"))


def longest_alias(specs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(spec, resolved) by the longest alias that is the import or stands before a slash in it."""
    parts = F.split("spec", "/")
    heads = specs.select("spec").distinct().select("spec", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("prefix"))
    best = heads.join(aliases, "prefix").groupBy("spec").agg(F.max_by(F.struct("prefix", "target"), F.length("prefix")).alias("a"))
    return best.select("spec", F.concat("a.target", F.substr(F.col("spec"), F.length("a.prefix") + 1)).alias("resolved"))


def merged_aliases(*layers: dict[str, str]) -> dict[str, str]:
    """Aliases of several repositories; later ones win."""
    return {k: v for layer in layers for k, v in layer.items()}


def expand_barrels(graph: DataFrame, barrels: DataFrame) -> DataFrame:
    """Edges, and for each import of a barrel (path) those to what the barrel exports; one level deep."""
    inner = graph.join(barrels.select(F.col("path").alias("src")), "src", "left_semi").select(F.col("src").alias("via"), F.col("dst").alias("leaf"))
    more = graph.join(inner, F.col("dst") == F.col("via")).where("src <> leaf").select("src", F.col("leaf").alias("dst"))
    return graph.unionByName(more).distinct()


def is_barrel(path: Column, content: Column) -> Column:
    """An index file with nothing but imports and exports from elsewhere."""
    bare = F.regexp_replace(F.regexp_replace(content, r"(?s)/\*.*?\*/", ""), r"(?m)//.*$", "")
    left = F.regexp_replace(bare, r"""(?s)\b(import|export)\b[^;'"]*?\bfrom\s*["'][^"']+["']\s*;?|\bimport\s*["'][^"']+["']\s*;?""", "")
    return T.basename(path).rlike(r"(?i)^index\.[jt]sx?$") & content.rlike(r"""\bexport\b[^;'"]*\bfrom\b""") & (F.trim(F.regexp_replace(left, r"\s+", "")) == "")


def exported_symbols(wanted: DataFrame, exports: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(file, symbol, target): the file that really defines a symbol which a file exports.

    exports: (file, exported, local, source); exported '*' passes on all of source, and a
    null source means the file itself defines it. Named exports come before stars.
    """
    walk = wanted.select("file", "symbol", F.col("file").alias("at"), F.col("symbol").alias("name"), F.lit(0).alias("stars"))
    done = None
    for _ in range(depth):
        step = walk.join(exports.withColumnRenamed("file", "at"), "at").where("exported = name OR (exported = '*' AND source IS NOT NULL)")
        step = step.select("file", "symbol", F.col("at"), F.when(F.col("exported") == "*", F.col("name")).otherwise(F.coalesce("local", "name")).alias("name"), (F.col("stars") * 2 + (F.col("exported") == "*").cast("int")).alias("stars"), "source")
        here = step.where("source IS NULL").select("file", "symbol", F.col("at").alias("target"), "stars")
        done = here if done is None else done.unionByName(here)
        walk = step.where("source IS NOT NULL AND source <> at").select("file", "symbol", F.col("source").alias("at"), "name", "stars")
    return done.groupBy("file", "symbol").agg(F.min_by("target", F.struct("stars", "target")).alias("target"))


def constants(files: DataFrame) -> DataFrame:
    """(path, name, key, value): string members of exported constant objects and enums (path, content)."""
    form = r"(?s)export\s+(?:const|enum)\s+(\w+)\s*(?::[^={]+)?=?\s*(?:Object\.freeze\(\s*)?\{([^{}]*)\}"
    member = r"""["']?([\w-]+)["']?\s*[:=]\s*["'`]([^"'`$]*)["'`]"""
    blocks = F.arrays_zip(F.regexp_extract_all("content", F.lit(form), 1).alias("name"), F.regexp_extract_all("content", F.lit(form), 2).alias("body"))
    some = files.where(F.col("content").contains("export"))
    each = some.select("path", F.explode(blocks).alias("b")).select("path", F.col("b.name").alias("name"), F.col("b.body").alias("body"))
    pairs = F.arrays_zip(F.regexp_extract_all("body", F.lit(member), 1).alias("k"), F.regexp_extract_all("body", F.lit(member), 2).alias("v"))
    return each.select("path", "name", F.explode(pairs).alias("m")).select("path", "name", F.col("m.k").alias("key"), F.col("m.v").alias("value"))


def json_constants(files: DataFrame) -> DataFrame:
    """(path, name, key, value): string members of the objects that .json files hold; what is no object has none.

    They are exports of the whole file, so they are named 'default'.
    """
    found = F.from_json("content", "map<string,variant>", {"mode": "PERMISSIVE"})
    each = files.where(F.col("path").rlike(r"\.json$")).select("path", F.explode(found).alias("key", "v"))
    return each.where(F.schema_of_variant("v") == "STRING").select("path", F.lit("default").alias("name"), "key", F.try_variant_get("v", "$", "string").alias("value"))


def with_imported_actions(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """Files, where literals behind imported names count as the importer's action types.

    resolved: (path, spec, target) of imports.
    """
    idents = files.select("path", F.explode("imported_idents").alias("i")).select("path", F.col("i.module").alias("spec"), F.col("i.name").alias("name"))
    consts = files.select(F.col("path").alias("target"), F.explode("action_type_consts").alias("name", "value"))
    more = idents.join(resolved, ["path", "spec"]).join(consts, ["target", "name"]).groupBy("path").agg(F.array_sort(F.collect_set("value")).alias("more"))
    empty = F.array().cast("array<string>")
    return files.join(more, "path", "left").withColumn("action_types", F.array_union(F.coalesce("action_types", empty), F.coalesce("more", empty))).select(*files.columns)
