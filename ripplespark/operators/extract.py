"""Facts about files from their text, as column expressions.

There is no TypeScript parser here: what a file states is read by regular expressions on
text without comments.  What nests, the comments themselves and the texts between tags,
is read by the lexer in one pass over each file; attribute expressions other than literals,
and component wrappers deeper than one call are left out, see the README.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ripplespark import schema
from ripplespark.functions import text as T

from . import lexer

# Attributes that name elements for tests, commands that every test has, and names of shortcuts to elements.
SELECTOR_ATTRIBUTES = "data-testid data-test-id data-test data-cy data-qa data-e2e data-automation data-automation-id dataTestId testId id aria-label".split()
BUILT_IN_COMMANDS = (
    "visit get find contains click type submit trigger check uncheck select deselect scrollIntoView scrollTo dblclick rightclick hover focus blur clear selectFile clearFile "
    "intercept request wait as spread wrap within should and then invoke its spy stub clock tick viewport url location hash go reload back forward document window log debug pause"
).split()
SELECTOR_COMMAND = r"(?i)^(?:get|find)By(?:TestId|DataTestId|DataTest|DataCy|DataQa|DataE2e|Test|Cy|Qa|E2e|AutomationId|Id|Sel|SelLike|Selector)$"
ACTION_TYPE = r"^(?:[a-z][a-zA-Z0-9]*/)?[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$"

_Q = r"""["'`]"""
_S = r"""["']([^"'\n]*)["']"""


def code(content: Column | str) -> Column:
    """The text without comments, strings left as they are; in the JVM, for what doesn't hang on nesting.

    A // after a colon is part of a url, as in texts between tags.
    """
    c = F.col(content) if isinstance(content, str) else content
    kept = r"""("(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`|:(?=//))"""
    return F.regexp_replace(c, rf"(?s){kept}|/\*.*?\*/|(?<!:)//[^\n]*", "$1")


def of_code(content: Column | str, read: Callable[[Column], Column]) -> Column:
    """What ``read`` finds in the text without comments, which is made once however often ``read`` names it."""
    return F.get(F.transform(F.array(code(content)), read), F.lit(0))


def every(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _word(name: str) -> str:
    """A pattern of the name where a word begins; the name comes first, as to look for a word's edge at every character takes long."""
    return rf"{name}(?<=\b{name})"


def _some(c: Column) -> Column:
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != "")))


def imports(c: Column) -> Column:
    """Modules of imports, re-exports, import() and require()."""
    return _some(F.flatten(F.array(every(c, rf"\b(?:import|export)\b[^;'\"`]*?\bfrom\s*{_S}"), every(c, rf"\bimport\s*{_S}"), every(c, rf"\b(?:import|require)\s*\(\s*{_S}\s*\)"))))


def import_kinds(c: Column) -> Column:
    """Imports as (kind, names, module): default, named, namespace, type, side-effect, dynamic, require, re-export."""
    clause = rf"\bimport\s+(type\s+)?([\w*${{}},\s]+?)\s+from\s*{_S}"
    zipped = F.arrays_zip(every(c, clause, 1).alias("t"), every(c, clause, 2).alias("n"), every(c, clause, 3).alias("m"))
    kind = lambda x: F.when(x["t"] != "", "type").when(x["n"].contains("*"), "namespace").when(x["n"].contains("{"), "named").otherwise("default")
    plain = lambda pattern, k: F.transform(every(c, pattern), lambda m: F.struct(F.lit(k).alias("kind"), F.lit("").alias("names"), m.alias("module")))
    return F.concat(F.transform(zipped, lambda x: F.struct(kind(x).alias("kind"), F.trim(x["n"]).alias("names"), x["m"].alias("module"))), plain(rf"\bimport\s*{_S}", "side-effect"),
                    plain(rf"\bimport\s*\(\s*{_S}\s*\)", "dynamic"), plain(rf"\brequire\s*\(\s*{_S}\s*\)", "require"), plain(rf"\bexport\b[^;'\"`]*?\bfrom\s*{_S}", "re-export"))


def named_imports(c: Column) -> Column:
    """(name, module) of names in braces; 'a as b' is a."""
    clause = rf"\bimport\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?\{{([^}}]*)\}}\s*from\s*{_S}"
    zipped = F.arrays_zip(every(c, clause, 1).alias("n"), every(c, clause, 2).alias("m"))
    names = lambda x: F.transform(F.filter(F.split(x["n"], ","), lambda n: F.trim(n) != ""), lambda n: F.struct(F.regexp_replace(F.trim(n), r"^type\s+|\s+as\s+.*$", "").alias("name"), x["m"].alias("module")))
    return F.flatten(F.transform(zipped, names))


def exports(c: Column) -> Column:
    """Names in export clauses; declarations with 'export' before them aren't meant."""
    clauses = F.flatten(F.transform(every(c, r"\bexport\s*\{([^}]*)\}"), lambda x: F.split(x, ",")))
    return _some(F.transform(clauses, lambda n: F.regexp_replace(F.trim(n), r"^.*\s+as\s+", "")))


def export_table(files: DataFrame) -> DataFrame:
    """(file, exported, local, spec) of export clauses, stars and declarations; spec is the module passed on, or null."""
    c, files = code("content"), files.where(F.col("content").contains("export"))
    clause = rf"\bexport\s*(\{{[^}}]*\}}|\*)\s*(?:as\s+\w+\s*)?(?:from\s*{_S})?"
    each = files.select(F.col("path").alias("file"), F.explode(F.arrays_zip(every(c, clause, 1).alias("n"), every(c, clause, 2).alias("m"))).alias("x")).select("file", "x.n", F.nullif("x.m", F.lit("")).alias("spec"))
    stars = each.where("n = '*' AND spec IS NOT NULL").select("file", F.lit("*").alias("exported"), F.lit(None).cast("string").alias("local"), "spec")
    names = each.where("n <> '*'").select("file", "spec", F.explode(F.split(F.regexp_replace("n", r"[{}]", ""), ",")).alias("n")).select("file", "spec", F.trim("n").alias("n")).where("n <> ''")
    named = names.select("file", F.regexp_replace("n", r"^.*\s+as\s+", "").alias("exported"), F.regexp_replace("n", r"\s+as\s+.*$", "").alias("local"), "spec")
    declared = files.select(F.col("path").alias("file"), F.explode(every(c, r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:const|let|var|function\*?|class|enum|interface|type)\s+(\w+)")).alias("exported"))
    own = lambda df: df.select("file", "exported", F.col("exported").alias("local"), F.lit(None).cast("string").alias("spec"))
    default = files.where(c.rlike(r"\bexport\s+default\b")).select(F.col("path").alias("file"), F.lit("default").alias("exported"))
    return stars.unionByName(named).unionByName(own(declared)).unionByName(own(default))


def selectors(c: Column) -> Column:
    """(attr, value) in JSX attributes and object members: literals, and templates up to their first hole."""
    attrs = "|".join(SELECTOR_ATTRIBUTES)
    forms = [rf"""(?<![\w-])({attrs})\s*=\s*(?:\{{\s*)?["'`]([^"'`$\n]+)""", rf"""["']({attrs})["']\s*:\s*["'`]([^"'`$\n]+)"""]
    pairs = [F.transform(F.arrays_zip(every(c, f, 1).alias("a"), every(c, f, 2).alias("v")), lambda x: F.struct(x["a"].alias("attr"), x["v"].alias("value"))) for f in forms]
    return F.array_distinct(F.concat(*pairs))


def translation_keys(c: Column) -> Column:
    return _some(every(c, rf"(?<![\w.])(?:i18n\.)?t\(\s*{_S}"))


def action_types(c: Column) -> Column:
    """Literals in the form of action types, keys of keyMirror, and members of ...Types."""
    literal = every(c, rf"{_Q}([\w/]{{5,80}}){_Q}")
    mirrored = F.flatten(F.transform(every(c, r"(?s)\bkeyMirror\(\s*\{([^}]*)\}"), lambda b: every(b, r"(\w+)\s*:")))
    member = every(c, r"\b\w*Types\.([A-Z][A-Z0-9_]*)\b")
    return _some(F.filter(F.concat(literal, mirrored, member), lambda x: x.rlike(ACTION_TYPE) & F.length(x).between(5, 80)))


def action_constants(c: Column) -> Column:
    """Exported constants whose literal is an action type, as a map."""
    form = rf"{_word('export')}\s+const\s+(\w+)\s*(?::[^=]+)?=\s*{_Q}([\w/]{{5,80}}){_Q}"
    pairs = F.filter(F.arrays_zip(every(c, form, 1).alias("k"), every(c, form, 2).alias("v")), lambda x: x["v"].rlike(ACTION_TYPE))
    return F.map_from_entries(F.transform(_first_by(pairs), lambda x: F.struct(x["k"], x["v"])))


def _first_by(pairs: Column) -> Column:
    """Pairs without those whose k came before."""
    seen = lambda kept, x: F.when(F.exists(kept, lambda y: y["k"] == x["k"]), kept).otherwise(F.concat(kept, F.array(x)))
    return F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), seen)


def redux_usage(c: Column) -> Column:
    combined = F.flatten(F.transform(every(c, r"(?s)\bcreateSelector\(\s*\[?([^()]*?)\]?\s*,\s*\("), lambda x: F.transform(F.split(x, ","), lambda y: F.trim(y))))
    return F.struct(
        _some(F.concat(every(c, r"\buseSelector\(\s*(\w+)"), combined)).alias("selectors_used"), _some(every(c, r"\bdispatch\(\s*([\w.]+)\(")).alias("actions_dispatched"),
        _some(every(c, rf"(?s)\bcreateSlice\(\s*\{{[^}}]*?\bname\s*:\s*{_S}")).alias("slices_defined"),
    )


def redux_roles(path: Column, c: Column) -> Column:
    """(slice, role) of all parts of a slice's state that a file holds; empty where it holds none."""
    folder = F.regexp_extract(path, r"(?:^|/)(?:store|state|features|redux)/([^/]+)/", 1)
    defined = F.nullif(F.element_at(F.concat(redux_usage(c)["slices_defined"], F.array(folder)), 1), F.lit(""))
    signs = [
        ("slice", c.rlike(r"\bcreateSlice\(")), ("saga", c.rlike(r"\bfunction\s*\*")), ("selectors", c.rlike(r"\bcreateSelector\(|\(\s*\w+\s*:\s*RootState\b")), ("actions", c.rlike(r"\bcreateAction\(")),
        ("reducer", c.rlike(r"\bcreateReducer\(|\(\s*state\b[^)]*,\s*action\b") & ~c.rlike(r"\bcreateSlice\(")), ("types", T.basename(path).rlike(r"(?i)types\.[jt]s$")),
    ]
    return F.filter(F.array(*(F.when(found, F.struct(defined.alias("slice"), F.lit(role).alias("role"))) for role, found in signs)), lambda x: x.isNotNull())


def redux_role(path: Column, c: Column) -> Column:
    """(slice, role): the first part of a slice's state that a file holds; null where it holds none."""
    return F.get(redux_roles(path, c), F.lit(0))


def routes(c: Column) -> Column:
    """(path, component, component_path, is_lazy, is_dynamic) of Route tags and route objects, as a flat list."""
    tag = r"(?s)<\w*Route\b((?:[^<>]|=>|<\w+[^<>]*/?>)*?)(?<!=)>(?=(?:\s*<(\w+))?)"
    tags = F.transform(F.arrays_zip(every(c, tag, 1).alias("a"), every(c, tag, 2).alias("child")), lambda x: F.struct(x["a"].alias("a"), F.when(x["a"].endswith("/"), "").otherwise(x["child"]).alias("child")))
    entry = r"(?s)\{\s*(path\s*:\s*[\"'`][^\"'`]*[\"'`](?:[^{}]|\{[^{}]*\})*)"
    objects = F.transform(every(c, entry), lambda a: F.struct(a.alias("a"), F.lit("").alias("child")))
    lazy = r"(?s)\b(?:lazy|React\.lazy)\s*\(\s*\(\)\s*=>\s*import\(\s*[\"']([^\"']+)"

    def route(x: Column) -> Column:
        path = F.regexp_extract(x["a"], r"""\bpath\s*[=:]\s*\{?\s*["'`]([^"'`]*)""", 1)
        shown = F.coalesce(*(F.nullif(F.regexp_extract(x["a"], p, 1), F.lit("")) for p in (r"\b(?:element|Component)\s*[=:]\s*\{?\s*<\s*(?:\w+>\s*<\s*)?(\w+)", r"\b(?:component|Component)\s*[=:]\s*\{?\s*(\w+)", r"\blazy\s*[=:][^,]*?import\(\s*[\"']([^\"']+)")), F.nullif(x["child"], F.lit("")))
        module = F.nullif(F.regexp_extract(x["a"], r"import\(\s*[\"']([^\"']+)", 1), F.lit(""))
        return F.struct(path.alias("path"), shown.alias("component"), F.lit(None).cast("string").alias("component_path"), (x["a"].rlike(r"\blazy\b") | module.isNotNull()).alias("is_lazy"), T.is_dynamic(path).alias("is_dynamic"))

    found = F.transform(F.concat(tags, objects), route)
    return F.filter(found, lambda r: (r["path"] != "") & (r["component"].isNotNull() | F.size(every(c, lazy)).cast("boolean")))


# tests ---------------------------------------------------------------------------------


def titles(c: Column, *names: str) -> Column:
    own = "|".join(rf"{n}(?<![\w.]{n})" for n in names)  # the name comes first, as to look behind at every character takes long
    return every(c, rf"(?:{own})\(\s*[\"'`]([^\"'`]+)")


def custom_commands(c: Column) -> Column:
    return F.array_except(_some(every(c, r"\bcy\s*\.\s*([a-zA-Z]\w*)")), F.array(*(F.lit(x) for x in BUILT_IN_COMMANDS)))


def visited_routes(c: Column) -> Column:
    """Arguments of cy.visit, holes of templates as '*', and of own commands if they begin with a slash."""
    visit = every(c, r"\bcy\s*\.\s*visit\(\s*[\"'`]([^\"'`]+)")
    own = F.arrays_zip(every(c, r"\bcy\s*\.\s*([a-zA-Z]\w*)\(\s*[\"'`](/[^\"'`]*)", 1).alias("n"), every(c, r"\bcy\s*\.\s*([a-zA-Z]\w*)\(\s*[\"'`](/[^\"'`]*)", 2).alias("v"))
    more = F.transform(F.filter(own, lambda x: ~x["n"].isin(BUILT_IN_COMMANDS)), lambda x: x["v"])
    return _some(F.transform(F.concat(visit, more), lambda v: F.regexp_replace(v, r"\$\{[^}]*\}", "*")))


def css_selector(raw: Column) -> Column:
    """(type, value, raw) of a css selector: test ids first, then ids, classes and all others."""
    attr = lambda names: F.regexp_extract(raw, rf"""\[(?:{names})=["']?([^"'\]]*)""", 1)
    make = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.alias("value"), raw.alias("raw"))
    generic = "data-test|data-qa|data-e2e|data-test-id|data-automation-id|data-automation"
    return (
        F.when(attr("data-testid") != "", make("data-testid", attr("data-testid"))).when(attr("data-cy") != "", make("data-cy", attr("data-cy"))).when(attr(generic) != "", make("data-testid", attr(generic)))
        .when(raw.rlike(r"^#[\w-]+$"), make("id", F.substr(raw, F.lit(2)))).when(raw.rlike(r"^\.[\w-]+$"), make("class", F.substr(raw, F.lit(2)))).otherwise(make("complex", raw))
    )


def test_selectors(c: Column) -> Column:
    """Selectors of get and find, and of commands that take a selector's value."""
    css = every(c, r"""\.\s*(?:get|find)\(\s*(?:'([^'\n]+)'|"([^"\n]+)"|`([^`\n]+)`)""", 0)
    plain = F.transform(css, lambda x: css_selector(F.regexp_replace(F.regexp_replace(x, r"""^\.\s*(?:get|find)\(\s*["'`]""", ""), r"""["'`]$""", "")))
    calls = F.arrays_zip(every(c, r"\bcy\s*\.\s*([a-zA-Z]\w*)\(\s*[\"'`]([^\"'`]+)", 1).alias("n"), every(c, r"\bcy\s*\.\s*([a-zA-Z]\w*)\(\s*[\"'`]([^\"'`]+)", 2).alias("v"))
    kind = lambda n: F.when(n.rlike(r"(?i)cy$"), "data-cy").when(n.rlike(r"(?i)by(id)$"), "id").otherwise("data-testid")
    named = F.transform(F.filter(calls, lambda x: x["n"].rlike(SELECTOR_COMMAND)), lambda x: F.struct(kind(x["n"]).alias("type"), x["v"].alias("value"), x["v"].alias("raw")))
    return F.filter(F.array_distinct(F.concat(plain, named)), lambda s: ~s["value"].startswith("@"))


def contains_text(c: Column) -> Column:
    """Texts that tests look for; of a regular expression its source."""
    return _some(F.concat(every(c, r"\.\s*contains\(\s*(?:[\"'`][^\"'`\n]*[\"'`]\s*,\s*)?[\"'`]([^\"'`\n]+)[\"'`]\s*[,)]"), every(c, r"\.\s*contains\(\s*/((?:[^/\\\n]|\\.)+)/")))


def intercepts(c: Column) -> Column:
    """(method, url_pattern): 'METHOD', url; or a url alone, which means GET."""
    two = r"\bcy\s*\.\s*intercept\(\s*[\"'`]([A-Z]+)[\"'`]\s*,\s*[\"'`]([^\"'`]+)"
    both = F.transform(F.arrays_zip(every(c, two, 1).alias("m"), every(c, two, 2).alias("u")), lambda x: F.struct(x["m"].alias("method"), x["u"].alias("url_pattern")))
    one = F.filter(every(c, r"\bcy\s*\.\s*intercept\(\s*[\"'`]([^\"'`]+)"), lambda u: ~u.rlike("^[A-Z]+$"))
    return F.concat(both, F.transform(one, lambda u: F.struct(F.lit("GET").alias("method"), u.alias("url_pattern"))))


def url_assertions(c: Column) -> Column:
    form = r"\bcy\s*\.\s*url\(\s*\)\s*\.\s*should\(\s*[\"'`]([^\"'`]+)[\"'`]\s*,\s*[\"'`]([^\"'`]+)"
    return F.transform(F.arrays_zip(every(c, form, 1).alias("o"), every(c, form, 2).alias("e")), lambda x: F.struct(x["o"].alias("operator"), x["e"].alias("expected")))


def with_constants(files: DataFrame, consts: DataFrame, idents: DataFrame) -> DataFrame:
    """(path, value): what cy.get(ids.x) means, by constants (target, name, key, value) and imports (path, name, target)."""
    form = r"\.\s*(?:get|find)\(\s*(\w+)\.(\w+)\s*\)"
    members = of_code("content", lambda c: F.arrays_zip(every(c, form, 1).alias("n"), every(c, form, 2).alias("k")))
    used = files.select("path", F.explode_outer(members).alias("u")).where("u IS NOT NULL")
    return used.select("path", F.col("u.n").alias("name"), F.col("u.k").alias("key")).join(idents, ["path", "name"]).join(consts, ["target", "name", "key"]).select("path", "value").distinct()


def as_read(files: DataFrame) -> DataFrame:
    """Files (path, content) as the lexer reads them: with columns lexed, and c for the code."""
    return files.withColumn("lexed", lexer.read("content", "path")).withColumn("c", F.col("lexed.code"))


def extract(files: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """Files (repo_root, path, content, type) with all facts, in the form of the table of files.

    only: names of the facts that are wanted, as 'selectors' or 'cypress.visited_routes'; the others are null and not looked for.
    """
    base = as_read(files)
    c, test = F.col("c"), F.col("type") == "test"
    kinds = {f.name: f.dataType for f in _parse_datatype_string(schema.FILES)}
    inner = {f"cypress.{f.name}": f.dataType for f in kinds["cypress"]}

    def fact(name: str, found: Column) -> Column:
        return (found if only is None or name in only else F.lit(None).cast((kinds | inner)[name])).alias(name.removeprefix("cypress."))

    cypress = F.struct(
        fact("cypress.visited_routes", visited_routes(c)), fact("cypress.selectors", test_selectors(c)), fact("cypress.contains_text", contains_text(c)), fact("cypress.intercepts", intercepts(c)),
        fact("cypress.url_assertions", url_assertions(c)), fact("cypress.custom_commands", custom_commands(c)), fact("cypress.describes", titles(c, "describe", "context")), fact("cypress.its", titles(c, "it")),
    )
    return base.select(
        "repo_root", "path", T.basename("path").alias("name"), "type", fact("exports", exports(c)), fact("imports", imports(c)), fact("classes", _some(every(c, _word("class") + r"\s+(\w+)"))),
        fact("functions", _some(every(c, _word("function") + r"\s*\*?\s*(\w+)"))), fact("interfaces", _some(every(c, _word("interface") + r"\s+(\w+)"))), F.array().cast("array<string>").alias("keywords"),
        fact("selectors", F.when(~test, selectors(c))), fact("jsx_text", F.when(~test, F.col("lexed.jsx_text"))), fact("translation_keys", F.when(~test, translation_keys(c))), fact("routes", F.when(~test, routes(c))),
        fact("redux", redux_usage(c)), fact("action_types", action_types(c)), fact("action_type_consts", action_constants(c)), fact("imported_idents", named_imports(c)), F.when(test, cypress).alias("cypress"),
    )
