"""Routes of an application from code text: tags, nested route objects, constants as paths, files of components.

A file's route objects are read by one fold over its braces and the properties that matter,
with the enclosing objects on a stack; nothing leaves the JVM.  Paths are stitched after
constants are looked up, so each route carries the paths of the routes around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplespark.functions import text as T
from ripplespark.sources import files as sources

from . import resolve as R
from .extract import every, of_code

_TEXT = r"""(?:"[^"\n]*"|'[^'\n]*'|`[^`$\n]*`)"""
_REF = r"[A-Za-z_$][\w$]*\.[\w$]+"
_INNER = r"(?:[^<>]|=>|</?[\w.]+[^<>]*>)"
_TAG = rf"(?s)<Route\b({_INNER}*?)(?<!=)>(?=(?:\s*<([\w.]+))?)"
_IMPORT = r"""(?s)\bimport\(\s*["']([^"']+)"""
_TOKEN = rf"""(?s)\{{|\}}|\bchildren\s*:\s*\[|\bpath\s*:\s*(?:{_TEXT}|{_REF})|\bindex\s*:\s*true\b|\b(?:element|Component|component)\s*:\s*[(<\s]*(?:[\w.]+\s*>\s*<\s*)*[\w.]+|\blazy\s*:\s*[^{{}}]*?\bimport\(\s*["'][^"']+["']|{_TEXT}"""
_OPEN = "struct<at:int,path:string,component:string,module:string,is_index:boolean,has_children:boolean>"
_FOUND = "struct<at:int,chain:array<string>,component:string,module:string,is_index:boolean>"


def _last_name(c: Column) -> Column:
    """The innermost tag of an element within wrappers, or the name given."""
    return F.nullif(F.regexp_extract(c, r"([\w.]+)$", 1), F.lit(""))


def object_routes(c: Column) -> Column:
    """(at, chain, component, module, is_index) of route objects; chain: paths, as in the code, from the outermost route around to its own."""
    tokens = every(c, _TOKEN, 0)
    numbered = F.transform(tokens, lambda t, k: F.struct(t.alias("t"), k.alias("k")))
    start = F.struct(F.array().cast(f"array<{_OPEN}>").alias("stack"), F.array().cast(f"array<{_FOUND}>").alias("found"))
    opened = lambda k: F.struct(k.alias("at"), *(F.lit(None).cast("string").alias(n) for n in ("path", "component", "module")), F.lit(False).alias("is_index"), F.lit(False).alias("has_children"))

    def is_route(o: Column) -> Column:
        return (o["path"].isNotNull() | o["is_index"]) & (o["component"].isNotNull() | o["module"].isNotNull())

    def step(state: Column, x: Column) -> Column:
        stack, found, t = state["stack"], state["found"], x["t"]
        below, top = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))), F.get(stack, F.size(stack) - 1)
        value = F.regexp_replace(t, r"(?s)^\w+\s*:\s*", "")
        field = lambda name, begins, v: F.when(t.rlike(begins), v).otherwise(top[name]).alias(name)
        changed = F.struct(
            top["at"].alias("at"), field("path", r"^path\b", value), field("component", r"^(?:element|Component|component)\b", _last_name(value)), field("module", r"^lazy\b", F.regexp_extract(t, _IMPORT, 1)),
            field("is_index", r"^index\b", F.lit(True)), field("has_children", r"^children\b", F.lit(True)),
        )
        around = F.filter(below, lambda o: o["has_children"])
        nested = (F.size(below) > 0) & F.get(below, F.size(below) - 1)["has_children"] & F.forall(around, is_route)
        chain = F.concat(F.when(nested, F.transform(around, lambda o: o["path"])).otherwise(F.array().cast("array<string>")), F.array(top["path"]))
        done = F.struct(top["at"].alias("at"), chain.alias("chain"), top["component"].alias("component"), top["module"].alias("module"), top["is_index"].alias("is_index"))
        pushed = F.struct(F.concat(stack, F.array(opened(x["k"]))).alias("stack"), found.alias("found"))
        popped = F.struct(below.alias("stack"), F.when(is_route(top), F.concat(found, F.array(done))).otherwise(found).alias("found"))
        noted = F.struct(F.concat(below, F.array(changed)).alias("stack"), found.alias("found"))
        return F.when(t == "{", pushed).when(F.size(stack) == 0, state).when(t == "}", popped).when(t.rlike(r"^\w+\s*:"), noted).otherwise(state)

    found = F.aggregate(numbered, start, step)["found"]
    ordered = F.array_sort(found)
    return F.when(c.rlike(r"\b(?:path|index)\s*:"), ordered).otherwise(F.array().cast(f"array<{_FOUND}>"))


def tag_routes(c: Column) -> Column:
    """The same of Route tags, which stand for themselves."""
    tags = F.arrays_zip(every(c, _TAG, 1).alias("a"), every(c, _TAG, 2).alias("child"))

    def route(x: Column, k: Column) -> Column:
        a = x["a"]
        path = F.nullif(F.regexp_extract(a, rf"\bpath\s*=\s*\{{?\s*({_TEXT}|{_REF})", 1), F.lit(""))
        shown = F.coalesce(
            _last_name(F.nullif(F.regexp_extract(a, r"(?s)\b(?:element|component|Component)\s*=\s*\{?([(<\s]*(?:[\w.]+\s*>\s*<\s*)*[\w.]+)", 1), F.lit(""))),
            F.when(~a.endswith("/"), F.nullif(x["child"], F.lit(""))),
        )
        module = F.when(a.rlike(r"\blazy\s*="), F.nullif(F.regexp_extract(a, _IMPORT, 1), F.lit("")))
        index = a.rlike(r"(?:^|\s)index(?:\s|/|=|$)")
        return F.struct(k.alias("at"), F.array(path).alias("chain"), shown.alias("component"), module.alias("module"), index.alias("is_index"))

    is_route = lambda r: (F.get(r["chain"], F.lit(0)).isNotNull() | r["is_index"]) & (r["component"].isNotNull() | r["module"].isNotNull())
    return F.filter(F.transform(tags, route), is_route)


def definitions(files: DataFrame) -> DataFrame:
    """(path, kind, at, chain, component, module, is_index): every route in files (path, content)."""
    some = files.where(F.col("content").rlike(r"<Route\b|\b(?:path|index)\s*:"))
    each = lambda kind, found: some.select("path", F.lit(kind).alias("kind"), F.explode_outer(of_code("content", found)).alias("r")).where("r IS NOT NULL").select("path", "kind", "r.*")
    return each("tag", tag_routes).unionByName(each("object", object_routes))


def bindings(files: DataFrame) -> DataFrame:
    """(path, name, imported, spec): local names of imports; imported is 'default', '*' for a namespace, or the name exported."""
    clause = r"""(?s)\bimport\s+(?:type\s+)?([\w$*{},\s]+?)\s+from\s*["']([^"'\n]*)["']"""
    clauses = of_code("content", lambda c: F.arrays_zip(every(c, clause, 1).alias("n"), every(c, clause, 2).alias("m")))
    some = files.where(F.col("content").contains("import"))
    each = some.select("path", F.explode_outer(clauses).alias("i")).where("i IS NOT NULL").select("path", F.col("i.n").alias("n"), F.col("i.m").alias("spec"))
    inside = F.regexp_extract("n", r"(?s)\{([^}]*)\}", 1)
    one = lambda name, imported: F.struct(name.alias("name"), imported.alias("imported"))
    named = F.filter(F.transform(F.split(inside, ","), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), "^type ", "")), lambda x: x != "")
    named = F.transform(named, lambda x: one(F.regexp_replace(x, "^.* as ", ""), F.regexp_replace(x, " as .*$", "")))
    others = F.array(one(F.regexp_extract("n", r"\*\s*as\s+([\w$]+)", 1), F.lit("*")), one(F.regexp_extract("n", r"^\s*([\w$]+)", 1), F.lit("default")))
    found = each.select("path", "spec", F.explode_outer(F.concat(named, F.filter(others, lambda x: x["name"] != ""))).alias("b")).where("b IS NOT NULL")
    return found.select("path", "b.name", "b.imported", "spec")


def located(files: DataFrame, resolved: DataFrame, exports: DataFrame) -> DataFrame:
    """(path, at, kind, pattern, component, component_path, is_lazy, is_dynamic, is_index) of all routes.

    resolved: (path, spec, target) of imports; exports: (file, exported, local, source) with
    the files that exports come from. A path that is a constant of an imported object is
    looked up there; a route whose own path stays unknown is left out. Definitions are read
    by several joins and stored once; what comes of as many files as there are is never broadcast.
    """
    found, large = sources.saved(definitions(files), "definitions"), sources.never_broadcast
    names = large(large(bindings(files)).join(resolved, ["path", "spec"]).select("path", "name", "imported", "target"))
    # paths
    part = found.select("path", "kind", "at", F.posexplode("chain").alias("k", "raw"))
    literal = F.regexp_extract("raw", r"""^["'`](.*)["'`]$""", 1)
    refs = part.where(F.col("raw").rlike(rf"^{_REF}$")).select("path", "kind", "at", "k", F.substring_index("raw", ".", 1).alias("name"), F.substring_index("raw", ".", -1).alias("key"))
    consts = large(R.constants(files)).select(F.col("path").alias("target"), F.col("name").alias("owner"), "key", "value")
    own = consts.select(F.col("target").alias("path"), F.col("owner").alias("name"), F.lit("*").alias("imported"), F.col("target").alias("target")).distinct()
    meant = refs.join(large(names.unionByName(own).distinct()), ["path", "name"]).join(consts, ["target", "key"])
    meant = meant.groupBy("path", "kind", "at", "k").agg(F.min_by("value", F.struct(F.col("owner") != F.col("name"), "owner")).alias("value"))
    whole = part.join(large(meant), ["path", "kind", "at", "k"], "left").select("path", "kind", "at", "k", F.coalesce("value", F.when(F.col("raw").rlike("^[\"'`]"), literal)).alias("value"))
    chain = whole.groupBy("path", "kind", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("parts"))
    above = F.aggregate(F.slice("parts", 1, F.size("parts") - 1), F.lit(""), lambda a, x: F.when(x.isNull(), a).when(x.startswith("/") | (a == ""), x).otherwise(F.replace(F.concat(a, F.lit("/"), x), F.lit("//"), F.lit("/"))))
    last = F.element_at("parts", -1)
    joined = F.when(last.startswith("/") | (F.col("above") == ""), last).otherwise(F.replace(F.concat("above", F.lit("/"), last), F.lit("//"), F.lit("/")))
    empty = F.when(F.col("kind") == "tag", "").otherwise(F.when(F.col("above") == "", "/").otherwise(F.col("above")))
    located = found.select("path", "kind", "at", "component", "module", "is_index").join(chain.withColumn("above", above), ["path", "kind", "at"])
    located = located.withColumn("pattern", F.coalesce(joined, F.when(F.col("is_index"), empty))).where("pattern IS NOT NULL").drop("parts", "above")
    # files of components: by what a name is bound to, through the files that pass it on
    head, member = F.substring_index("component", ".", 1), F.when(F.col("component").contains("."), F.substring_index("component", ".", -1))
    wanted = located.select("path", "component", head.alias("name"), member.alias("member")).distinct().join(names, ["path", "name"])
    wanted = wanted.select("path", "component", "target", F.when(F.col("imported") == "*", F.col("member")).otherwise(F.col("imported")).alias("symbol"))
    ends = R.exported_symbols(wanted.where("symbol IS NOT NULL").select(F.col("target").alias("file"), "symbol").distinct(), exports)
    shown = wanted.join(large(ends.select(F.col("file").alias("target"), "symbol", F.col("target").alias("end"))), ["target", "symbol"], "left")
    shown = shown.groupBy("path", "component").agg(F.min(F.coalesce("end", "target")).alias("by_name"))
    lazy = resolved.select("path", F.col("spec").alias("module"), F.col("target").alias("by_module"))
    out = located.join(large(shown), ["path", "component"], "left").join(lazy, ["path", "module"], "left")
    name = F.coalesce("component", F.regexp_replace(T.basename(F.coalesce("by_module", "module")), T.SOURCE_ENDING, ""))
    return out.select("path", "at", "kind", "pattern", name.alias("component"), F.coalesce("by_module", "by_name").alias("component_path"), F.col("module").isNotNull().alias("is_lazy"), T.is_dynamic("pattern").alias("is_dynamic"), "is_index")
