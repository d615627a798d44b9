"""Evidence between changed files and tests: one join for each kind, never files times tests.

Every scorer takes a ``Registry`` and the changed files (column ``path``) and returns
signals, at most one for each pair: (changed, test, type, weight, anchor_eligible, reason).
Pairs without evidence have no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import cached_property
from math import prod
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplespark.config import Config
from ripplespark.functions import text as T
from ripplespark.sources import files as sources

from . import graph as G
from . import index as I

#: What a full match of each kind weighs.
WEIGHTS = {
    "direct-import": 0.95, "route-match": 0.85, "selector-match": 0.80, "transitive-import": 0.70, "filename-match": 0.82, "redux-chain": 0.75,
    "redux-consumer": 0.65, "translation-match": 0.85, "selector-id-match": 0.65, "api-intercept": 0.55, "colocation": 0.75, "describe-block": 0.70,
    "dependent-selector": 0.65, "action-type": 0.60, "usage-site": 0.55, "temporal-coherence": 0.45,
}


#: What files may have that a scorer can't do without; it is left out of plans over a registry in which no file has it.
FACTS = {
    "visits": "size(cypress.visited_routes) > 0", "ids": "exists(cypress.selectors, s -> s.type = 'id')", "titles": "size(cypress.describes) > 0 OR size(cypress.its) > 0",
    "intercepts": "size(cypress.intercepts) > 0", "actions": "size(action_types) > 0", "source_imports": "type = 'source' AND size(imports) > 0",
}
NEEDS = {
    "route-match": "visits", "redux-consumer": "visits", "selector-id-match": "ids", "describe-block": "titles", "api-intercept": "intercepts", "action-type": "actions",
    "transitive-import": "source_imports", "dependent-selector": "source_imports",
}


@dataclass
class Registry:
    """The tables that scorers join: files, and what some kinds of evidence need besides."""

    files: DataFrame
    config: Config
    redux: DataFrame | None = None  # (path, slice, role)
    i18n: DataFrame | None = None  # (key, text, static_text, is_dynamic)
    history: DataFrame | None = None  # (repo, path, created_at, updated_at, commits)
    extracted_routes: DataFrame | None = None  # (pattern, component)
    facts: frozenset[str] | None = None  # what any file has, of ``FACTS``; None: not looked for

    def stored(self) -> Registry:
        """The same with its tables and import graph written to the shared folder and read again.

        Every scorer reads these tables, some several times: plans over stored tables are
        short, and nothing is parsed or grouped twice.
        """
        spark = self.files.sparkSession
        folder = f"{sources.shared_folder(spark)}/registry-{uuid4().hex}"
        sources.write_registry({"files": self.files} | ({} if self.history is None else {"history": self.history}), folder)
        sources.write_registry({"graph": G.edges(spark.read.parquet(f"{folder}/files"))}, folder)
        read = sources.read_registry(spark, folder, ["files", "graph"] + ([] if self.history is None else ["history"]))
        found = read["files"].agg(*(F.coalesce(F.bool_or(F.expr(has)), F.lit(False)).alias(name) for name, has in FACTS.items())).first().asDict()
        out = replace(self, files=read["files"], history=read.get("history"), facts=frozenset(k for k, v in found.items() if v))
        out.__dict__["graph"] = read["graph"]
        return out

    @cached_property
    def graph(self) -> DataFrame:
        return G.edges(self.files)

    @cached_property
    def in_degree(self) -> DataFrame:
        return G.in_degree(self.graph)

    @cached_property
    def chains(self) -> DataFrame | None:
        return None if self.redux is None else I.chains(self.redux, self.graph)

    @cached_property
    def routes(self) -> DataFrame:
        return I.routes(self.files, self.extracted_routes)

    @cached_property
    def n_tests(self) -> DataFrame:
        return I.tests(self.files).agg(F.count("*").alias("n_tests_all"))

    @cached_property
    def resolved_visits(self) -> DataFrame:
        """(test, pos, raw, url, component, specificity) of visits that a route resolves."""
        visits = I.visits(self.files)
        return visits.join(resolve_routes(visits.select("url"), self.routes), "url")

    def little_imported(self, changed: DataFrame) -> DataFrame:
        """The changed files that few enough files import for walks from them to mean something."""
        return changed.join(self.in_degree, "path", "left").where(F.coalesce("importers", F.lit(0)) <= self.config.scoring.max_fan_out).select("path")


def signals(df: DataFrame, kind: str, weight: Column, reason: Column, eligible: Column | None = None) -> DataFrame:
    """Rows (changed, test) in the form of signals."""
    return df.select("changed", "test", F.lit(kind).alias("type"), weight.cast("double").alias("weight"), (F.lit(True) if eligible is None else eligible).alias("anchor_eligible"), reason.alias("reason"))


def resolve_routes(urls: DataFrame, routes: DataFrame) -> DataFrame:
    """(url, component, specificity): the route that renders each distinct url (column ``url``).

    An equal pattern comes first, then the most specific pattern that fits the whole url,
    then the most specific one that fits up to a segment, at half its specificity. Equally
    specific patterns go by their order. Urls and patterns meet on their first segment, or
    on none where the pattern's is no literal.
    """
    urls = urls.select("url").distinct()
    equal = urls.join(routes, F.col("url") == F.col("pattern")).select("url", "component", F.lit(0).alias("tier"), F.lit(1.0).alias("specificity"), "ordinal")
    patterns = routes.select("pattern", "component", "ordinal", T.route_block("pattern", True).alias("block"), T.route_body("pattern").alias("body"), T.route_specificity("pattern").alias("s"), T.is_dynamic("pattern").alias("dynamic"))
    keyed = urls.select("url", F.explode(F.array_distinct(F.array(F.lit(""), T.route_block("url", False)))).alias("block"))
    near = keyed.join(patterns, "block").where(F.expr("rlike(url, concat('^', body, '(/.*)?$'))"))
    whole = near.where(F.col("dynamic") & F.expr("rlike(url, concat('^', body, '/?$'))")).select("url", "component", F.lit(1).alias("tier"), F.col("s").alias("specificity"), "ordinal")
    prefix = near.where(F.expr("rlike(url, concat('^', body, '/.+$'))")).select("url", "component", F.lit(2).alias("tier"), (F.col("s") * 0.5).alias("specificity"), "ordinal")
    best = F.min_by(F.struct("component", "specificity"), F.struct("tier", -F.col("specificity"), "ordinal"))
    return equal.unionByName(whole).unionByName(prefix).groupBy("url").agg(best.alias("b")).select("url", "b.component", "b.specificity")


def direct_import(reg: Registry, changed: DataFrame) -> DataFrame:
    tests = I.tests(reg.files).select(F.col("path").alias("test"))
    pairs = reg.graph.select(F.col("src").alias("test"), F.col("dst").alias("changed")).join(changed.select(F.col("path").alias("changed")), "changed", "left_semi").join(tests, "test", "left_semi")
    return signals(pairs, "direct-import", F.lit(WEIGHTS["direct-import"]), F.concat(F.lit("Test imports "), F.col("changed")))


def transitive_import(reg: Registry, changed: DataFrame) -> DataFrame:
    seeds = reg.little_imported(changed)
    via = reg.graph.select(F.col("src").alias("via"), F.col("dst").alias("changed")).join(seeds.select(F.col("path").alias("changed")), "changed", "left_semi")
    tests = I.tests(reg.files).select(F.col("path").alias("test"), F.explode("imports").alias("via"))
    pairs = tests.join(via, "via").groupBy("changed", "test").agg(F.min("via").alias("via"))
    return signals(pairs, "transitive-import", F.lit(WEIGHTS["transitive-import"]), F.concat_ws(" ", F.lit("Test imports"), "via", F.lit("which imports"), "changed"))


def route_match(reg: Registry, changed: DataFrame) -> DataFrame:
    """The first visited route whose component is the changed file or reaches it counts, not the best one."""
    cfg, w = reg.config.scoring, WEIGHTS["route-match"]
    visits = reg.resolved_visits
    traffic = visits.select("test", "component").distinct().groupBy("component").agg(F.count("*").alias("visitors"))
    own = changed.select(F.col("path").alias("changed"), F.col("path").alias("component"), F.lit(0).alias("depth"))
    reach = G.cone(reg.little_imported(changed), G.reverse(reg.graph), 3).where("depth > 0").select(F.col("seed").alias("changed"), F.col("node").alias("component"), "depth")
    damp = F.pow(1 - F.when(F.col("n_tests_all") > 0, F.col("visitors") / F.col("n_tests_all")).otherwise(0), cfg.route_traffic_exponent)
    weight = F.when(F.col("depth") == 0, w * (0.5 + 0.5 * F.col("specificity"))).otherwise(w * (0.3 + 0.7 * F.col("specificity")) / (F.col("depth") + 1) * damp)
    hits = visits.join(own.unionByName(reach).distinct(), "component").join(traffic, "component").join(reg.n_tests).withColumn("weight", weight)
    first = hits.groupBy("changed", "test").agg(F.min_by(F.struct("weight", "raw", "component", "depth"), F.struct("pos", "depth")).alias("h")).select("changed", "test", "h.*")
    return signals(first, "route-match", F.col("weight"), F.concat_ws(" ", F.lit("Test visits"), "raw", F.lit("rendered by"), "component", F.lit("at depth"), F.col("depth").cast("string")))


def _prefix_pairs(left: DataFrame, right: DataFrame, least: int = 3) -> DataFrame:
    """(tv, value) of two vocabularies (columns ``tv`` and ``value``) where one is a proper prefix of the other.

    Each text's own prefixes are looked up as whole texts of the other side, so that texts
    that merely begin alike never meet.
    """
    def meet(long: str, short: str, many: DataFrame, few: DataFrame) -> DataFrame:
        heads = F.transform(F.sequence(F.lit(least), F.length(long) - 1), lambda k: F.substr(F.col(long), F.lit(1), k))
        return many.where(F.length(long) > least).select(long, F.explode(heads).alias(short)).join(few, short).select("tv", "value")

    return meet("tv", "value", left, right).unionByName(meet("value", "tv", right, left))


def _selector_hits(tests: DataFrame, origin: DataFrame) -> DataFrame:
    """(changed, test, value, depth, exact): what tests (test, pos, value) hit in origin (changed, value, depth), one for each.

    An equal value wins; else the first value of which one is a prefix of the other, both
    of three characters or more.
    """
    equal = tests.join(origin, "value").select("changed", "test", "pos", "value", "depth", F.lit(True).alias("exact"))
    pairs = _prefix_pairs(tests.select(F.col("value").alias("tv")).distinct(), origin.select("value").distinct())
    near = pairs.join(origin, "value").join(tests.select("test", "pos", F.col("value").alias("tv")), "tv")
    one = near.groupBy("changed", "test", "pos").agg(F.min_by(F.struct("value", "depth"), F.struct("depth", "value")).alias("h")).select("changed", "test", "pos", "h.*", F.lit(False).alias("exact"))
    return equal.unionByName(one.join(equal.select("changed", "test", "pos"), ["changed", "test", "pos"], "left_anti")).drop("pos")


def _classes(rows: DataFrame, name: str, held: Column) -> tuple[DataFrame, DataFrame]:
    """(kind, name) of files, and (name, h) of what each kind holds, where ``name`` is the kind: files that hold the same are of one kind.

    What kinds hold is stored: several joins read it, and it doesn't grow with copies of files.
    """
    each = rows.groupBy(name).agg(held.alias("held")).select(name, "held", F.unhex(F.md5(F.to_json("held"))).alias("kind"))
    kinds = each.groupBy("kind").agg(F.any_value("held").alias("held")).select(F.col("kind").alias(name), F.explode("held").alias("h"))
    return each.select("kind", name), sources.saved(kinds, f"kinds-{name}")


@dataclass
class Kinds:
    """Rows on (changed, test) that are kinds of files, and the files of either kind.

    What a file hits hangs on the selectors it has and on nothing else, so files with the same ones are
    matched once.
    """

    rows: DataFrame
    own: DataFrame  # (kind, changed)
    used: DataFrame  # (kind, test)

    def _on_kinds(self) -> DataFrame:
        return self.rows.withColumnsRenamed({"changed": "changed_kind", "test": "test_kind"})

    def _members(self) -> tuple[DataFrame, DataFrame]:
        return tuple(sources.never_broadcast(df.withColumnRenamed("kind", f"{name}_kind")) for df, name in ((self.own, "changed"), (self.used, "test")))

    def of_files(self) -> DataFrame:
        """The same rows on files. Pairs are only written out, never grouped or shuffled. Tests come in first, as a test hits few kinds."""
        own, used = self._members()
        return self._on_kinds().join(used, "test_kind").drop("test_kind").join(own, "changed_kind").select(self.rows.columns)

    def of_pairs(self, pairs: DataFrame) -> DataFrame:
        """The rows on files of given pairs (changed, test), without writing out others."""
        own, used = self._members()
        kinds = pairs.select("changed", "test").join(own, "changed").join(used, "test")
        return kinds.join(self._on_kinds(), ["changed_kind", "test_kind"]).select(self.rows.columns)


def _hits_of_kinds(reg: Registry, origin: DataFrame) -> Kinds:
    """Hits between kinds of changed files and kinds of tests."""
    own, origins = _classes(origin, "changed", F.array_sort(F.collect_list(F.struct("value", "depth"))))
    # where a selector stands in a test tells it from others, and means no more
    places = F.array_sort(F.collect_list(F.struct("pos", "value")))
    plain = F.transform(F.array_sort(places["value"]), lambda v, k: F.struct(k.alias("pos"), v.alias("value")))
    used, tests = _classes(I.test_selectors(reg.files).select("test", "pos", "value"), "test", F.when(F.size(F.array_distinct(places["pos"])) == F.size(places), plain).otherwise(places))
    return Kinds(_selector_hits(tests.select("test", "h.*"), origins.select("changed", "h.*")), own, used)


def _kept_hits(reg: Registry, hits: DataFrame) -> DataFrame:
    """Hits without selectors that more than a tenth of the tests use; with their share."""
    shares = I.selector_frequency(reg.files).select("value", "share")
    return hits.join(shares, "value", "left").withColumn("share", F.coalesce("share", F.lit(0.0))).where(F.col("share") <= reg.config.scoring.ubiquitous_selector)


def _own_selectors(reg: Registry, changed: DataFrame) -> DataFrame:
    """(changed, n): how many selectors each changed file has."""
    n = I.selectors(reg.files).groupBy("path").agg(F.count("*").alias("n"))
    return changed.join(n, "path", "left").select(F.col("path").alias("changed"), F.coalesce("n", F.lit(0)).alias("n"))


def _selectors_of(reg: Registry, reached: DataFrame) -> DataFrame:
    each = reached.join(I.selectors(reg.files).select(F.col("path").alias("node"), "value"), "node")
    return each.groupBy(F.col("seed").alias("changed"), "value").agg(F.min("depth").alias("depth"))


def selector_match(reg: Registry, changed: DataFrame) -> DataFrame:
    """Selectors of the changed file, and of its imports up to two steps away if it has fewer than three."""
    return selector_kinds(reg, changed).of_files()


def selector_kinds(reg: Registry, changed: DataFrame) -> Kinds:
    """The signals of ``selector_match`` between kinds of files."""
    few = _own_selectors(reg, changed).where("n < 3").select(F.col("changed").alias("path"))
    reached = G.cone(changed, reg.graph, 0).unionByName(G.cone(few, reg.graph, 2)).groupBy("seed", "node").agg(F.min("depth").alias("depth"))
    kinds = _hits_of_kinds(reg, _selectors_of(reg, reached))
    kept = _kept_hits(reg, kinds.rows).join(reg.n_tests)
    quality = F.when(F.max("n_tests_all") > 1, F.max(F.pow(1 - F.col("share"), 2))).otherwise(1.0)
    found = kept.groupBy("changed", "test").agg(F.count_if("exact").alias("exact"), F.count("*").alias("n"), F.min("depth").alias("depth"), quality.alias("quality"), F.array_sort(F.collect_set("value")).alias("values"))
    depth = F.when(F.col("depth") == 0, 1.0).when(F.col("depth") == 1, 0.7).otherwise(0.45)
    weight = WEIGHTS["selector-match"] * F.when(F.col("exact") == 0, 0.7).otherwise(1.0) * depth * F.greatest(F.lit(0.35), F.least(F.lit(1.0), F.col("n") / 3)) * F.col("quality")
    return replace(kinds, rows=signals(found, "selector-match", weight, F.concat(F.lit("Test selectors match: "), F.array_join("values", ", "))))


def dependent_selector(reg: Registry, changed: DataFrame) -> DataFrame:
    """Selectors of files that depend on a changed file with fewer than three of its own."""
    few = _own_selectors(reg, changed).where("n < 3").select(F.col("changed").alias("path"))
    reached = G.cone(few, G.reverse(reg.graph), 2).where("depth > 0")
    kinds = _hits_of_kinds(reg, _selectors_of(reg, reached))
    kept = _kept_hits(reg, kinds.rows)
    found = kept.groupBy("changed", "test").agg(F.count_if("exact").alias("exact"), F.count("*").alias("n"), F.min("depth").alias("depth"), F.array_sort(F.collect_set("value")).alias("values"))
    weight = WEIGHTS["dependent-selector"] * F.when(F.col("exact") == 0, 0.6).otherwise(1.0) * F.when(F.col("depth") >= 2, 0.6).otherwise(1.0) * F.least(F.lit(1.0), F.col("n") / 3)
    return replace(kinds, rows=signals(found, "dependent-selector", weight, F.concat(F.lit("Dependent selectors match: "), F.array_join("values", ", ")))).of_files()


def selector_id(reg: Registry, changed: DataFrame) -> DataFrame:
    ids = I.selectors(reg.files).where("attr = 'id'").select(F.col("path").alias("changed"), "value").join(changed.select(F.col("path").alias("changed")), "changed", "left_semi")
    found = I.test_ids(reg.files).join(ids.distinct(), "value").groupBy("changed", "test").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return signals(found, "selector-id-match", F.lit(WEIGHTS["selector-id-match"]), F.concat(F.lit("Ids match: "), F.array_join("values", ", ")))


def filename_match(reg: Registry, changed: DataFrame) -> DataFrame:
    """Equal names, folders named after the file, or shared name tokens, in this order.

    Shared tokens without one that is rare among file names don't make an anchor.
    """
    w, least = WEIGHTS["filename-match"], 0.5
    src = changed.select(F.col("path").alias("changed"), T.name_tokens("path", False).alias("ct"), T.parent_tokens("path", False).alias("cp"), T.feature_identity("path").alias("cf")).withColumn("joined", F.array_join("ct", ""))
    tests = I.tests(reg.files).select(F.col("path").alias("test"), T.name_tokens("path", True).alias("tt"), T.parent_tokens("path", True).alias("tp"), T.feature_identity("path").alias("tf"), T.segments("path").alias("segs"))
    tests = sources.saved(tests, "test-names")  # several joins read them
    equal = tests.where("size(tt) > 0").select("test", F.array_join("tt", "").alias("joined")).join(src.where("joined <> ''").select("changed", "ct", "joined"), "joined")
    generic = F.col("joined").isin(T.GENERIC_NAMES)
    identical = signals(equal, "filename-match", F.when(generic, w * 0.2).otherwise(max(w, 0.95)), F.concat(F.lit("Identical basename: "), F.array_join("ct", "-"))).withColumn("step", F.lit(1))
    folder = tests.select("test", F.explode(F.slice("segs", 1, F.greatest(F.size("segs") - 1, F.lit(0)))).alias("seg")).select("test", T.without(T.words("seg"), T.FILENAME_STOPWORDS, 2).alias("st"))
    keys = folder.select("test", F.array_join("st", "").alias("joined"), F.lit(True).alias("whole")).unionByName(folder.select("test", F.explode("st").alias("joined"), F.lit(False).alias("whole")))
    under = keys.distinct().join(src.where("length(joined) >= 3").select("changed", "ct", "joined"), "joined").where("whole OR (size(ct) = 1 AND length(joined) >= 5)").select("changed", "test", "ct").distinct()
    ancestor = signals(under, "filename-match", F.lit(w * 0.85), F.concat(F.lit("Test lies in a folder named "), F.array_join("ct", "-"))).withColumn("step", F.lit(2))

    # Shared tokens: pairs come from rare tokens and from containment, what they share is counted on the pairs.
    pair = name_pairs(src.select("changed", "ct"), tests.select("test", "tt"), least)
    shares = src.select("changed", F.explode(F.array_distinct("ct")).alias("token")).join(I.token_shares(reg.files).select("token", "share"), "token").groupBy("changed").agg(F.map_from_entries(F.collect_list(F.struct("token", "share"))).alias("shares"))
    full = pair.join(src, "changed").join(tests.drop("segs"), "test").join(shares, "changed", "left")
    within = lambda t: F.exists("tt", lambda o: (o != t) & (F.length(t) >= 5) & (F.length(o) >= 5) & (F.contains(o, t) | F.contains(t, o)))
    full = full.withColumn("exact", F.filter("ct", lambda t: F.array_contains("tt", t))).withColumn("fuzzy", F.filter("ct", lambda t: ~F.array_contains("tt", t) & within(t)))
    every = F.concat("exact", "fuzzy")
    rare = lambda t: F.coalesce(F.try_element_at("shares", t), F.lit(0.0)) < reg.config.scoring.filename_ambiguity
    full = full.where(F.size(every) > 0).select(
        "*", F.size("exact").alias("n_exact"), F.size("fuzzy").alias("n_fuzzy"), F.array_min(every).alias("any"), F.array_sort(F.array_distinct(every)).alias("tokens"),
        (F.exists("exact", lambda t: F.length(t) >= 3) | (F.size("fuzzy") > 0)).alias("strong"), F.exists(every, rare).alias("distinctive"),
    )
    n_c, n_t = F.size(F.array_distinct("ct")), F.size(F.array_distinct("tt"))
    ratio = (F.col("n_exact") + 0.9 * F.col("n_fuzzy")) / F.least(n_c, n_t)
    every_c, every_t = F.array_union("ct", "cp"), F.array_union("tt", "tp")
    all_ratio = F.size(F.array_intersect(every_c, every_t)) / F.least(F.size(every_c), F.size(every_t))
    secondary = (F.col("n_exact") == 1) & (F.col("n_fuzzy") == 0) & (F.length("any") <= 10) & (n_c > 1) & ~T.shares_feature(F.col("cf"), F.col("tf"))
    graded = full.where(F.col("strong") & (ratio >= least) & ~secondary)
    weight = w * F.least(F.lit(1.0), ratio + F.when(all_ratio > ratio, 0.2).otherwise(0.0))
    overlap = signals(graded, "filename-match", weight, F.concat(F.lit("Names share "), F.array_join("tokens", ", ")), F.col("distinctive")).withColumn("step", F.lit(3))
    best = identical.unionByName(ancestor).unionByName(overlap).groupBy("changed", "test").agg(F.min_by(F.struct("type", "weight", "anchor_eligible", "reason"), "step").alias("s"))
    return best.select("changed", "test", "s.*")


def name_pairs(src: DataFrame, tests: DataFrame, least: float) -> DataFrame:
    """Distinct (changed, test) that can share ``least`` of the smaller one's tokens: src (changed, ct), tests (test, tt).

    Tokens are put in one order, rarest first. Who shares so many of a name's n tokens shares
    one of its first n - ceil(least * n) + 1, so a token that many names have only counts where a name
    has hardly another. Names with repeated tokens, which count more than once, go in whole.
    Pairs by containment come from the two vocabularies.
    """
    c_tokens = src.select("changed", F.explode(F.array_distinct("ct")).alias("token"))
    t_tokens = tests.select("test", F.explode(F.array_distinct("tt")).alias("token"))
    often = t_tokens.groupBy("token").agg(F.count("*").alias("often"))
    repeated = src.where(F.size("ct") > F.size(F.array_distinct("ct"))).select("changed").distinct().withColumn("whole", F.lit(True))

    def first(tokens: DataFrame, name: str) -> DataFrame:
        ordered = tokens.join(often, "token", "left").withColumn("often", F.coalesce("often", F.lit(0)))
        per = Window.partitionBy(name)
        ordered = ordered.withColumn("n", F.count("*").over(per)).withColumn("k", F.row_number().over(per.orderBy("often", "token")))
        return ordered.withColumn("first", F.col("k") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select(name, "token", "n", "first")

    c = first(c_tokens, "changed").join(repeated, "changed", "left").select("changed", "token", F.col("n").alias("c_n"), (F.col("first") | F.coalesce("whole", F.lit(False))).alias("c_first"), F.coalesce("whole", F.lit(False)).alias("whole"))
    t = first(t_tokens, "test").select("test", "token", F.col("n").alias("t_n"), F.col("first").alias("t_first"))
    by_c = c.where("c_first").join(t, "token").where("c_n <= t_n OR whole")
    by_t = c.join(t.where("t_first"), "token").where("t_n < c_n")
    words = contained(c_tokens.select("token").distinct(), t_tokens.select("token").distinct(), 5, False)
    fuzzy = c_tokens.join(words, "token").join(t_tokens.select("test", F.col("token").alias("other")), "other")
    return by_c.select("changed", "test").unionByName(by_t.select("changed", "test")).unionByName(fuzzy.select("changed", "test")).distinct()


def contained(left: DataFrame, right: DataFrame, least: int = 5, shorter: bool = True) -> DataFrame:
    """(token, other) of two vocabularies (column ``token``) where one, but not both, lies in the other.

    The shorter's first ``least`` characters are among the runs of that length in the
    longer, which both are joined on; one of fewer characters is itself such a run.
    Without ``shorter`` both must have ``least`` characters or more.
    """
    def meet(small: DataFrame, large: DataFrame, size: int, exactly: bool) -> DataFrame:
        runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("large") - size + 1), lambda k: F.substr(F.col("large"), k, F.lit(size))))
        few = small.where(F.length("small") == size if exactly else F.length("small") >= size).withColumn("run", F.substring("small", 1, size))
        many = large.where(F.length("large") >= size).withColumn("run", F.explode(runs))
        return few.join(many, "run").where("small <> large AND contains(large, small)").select("small", "large")

    sizes = [(least, False), *((k, True) for k in range(1, least) if shorter)]
    named = lambda df, c: df.select(F.col("token").alias(c))
    found = [meet(named(left, "small"), named(right, "large"), *s).select(F.col("small").alias("token"), F.col("large").alias("other")) for s in sizes]
    found += [meet(named(right, "small"), named(left, "large"), *s).select(F.col("large").alias("token"), F.col("small").alias("other")) for s in sizes]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def redux_chain(reg: Registry, changed: DataFrame) -> DataFrame:
    """A test that imports a member or a consumer of the changed file's slice, or uses a consumer's selector."""
    if reg.chains is None:
        return _none(changed)
    mine = _slices(reg, changed)
    imports = I.tests(reg.files).select(F.col("path").alias("test"), F.explode("imports").alias("path"))
    by_import = imports.join(reg.chains.select("slice", "path"), "path").select("slice", "test")
    kinds = I.test_selectors(reg.files).where("type IN ('data-testid', 'data-cy')")
    owners = kinds.join(I.selectors(reg.files).select("value", "path"), "value").select("test", "path")
    by_selector = owners.join(reg.chains.where("role = 'consumer'").select("slice", "path"), "path").select("slice", "test")
    pairs = by_import.unionByName(by_selector).join(mine, "slice").groupBy("changed", "test").agg(F.min("slice").alias("slice"))
    return signals(pairs, "redux-chain", F.lit(WEIGHTS["redux-chain"]), F.concat(F.lit("Shared slice "), F.col("slice")))


def redux_consumer(reg: Registry, changed: DataFrame) -> DataFrame:
    """A test that visits a route whose component, or an import of it up to two steps away, consumes the slice."""
    if reg.chains is None:
        return _none(changed)
    mine = _slices(reg, changed)
    visited = I.visits(reg.files).join(reg.routes.select(F.col("pattern").alias("raw"), "component"), "raw").select("test", "pos", "component")
    reach = G.cone(visited.select(F.col("component").alias("path")), reg.graph, 2)
    consumed = reach.join(reg.chains.where("role = 'consumer'").select("slice", F.col("path").alias("node")), "node").groupBy(F.col("seed").alias("component"), "slice").agg(F.min("depth").alias("depth"))
    first = visited.join(consumed, "component").join(mine, "slice").groupBy("changed", "test").agg(F.min_by(F.struct("depth", "slice"), F.struct("slice", "pos")).alias("h")).select("changed", "test", "h.*")
    factor = F.when(F.col("depth") == 0, 1.0).when(F.col("depth") == 1, 0.7).otherwise(0.45)
    return signals(first, "redux-consumer", WEIGHTS["redux-consumer"] * factor, F.concat(F.lit("Visits a consumer of slice "), F.col("slice")))


def _slices(reg: Registry, changed: DataFrame) -> DataFrame:
    return reg.chains.where("role <> 'consumer'").select("slice", F.col("path").alias("changed")).distinct().join(changed.select(F.col("path").alias("changed")), "changed", "left_semi")


def _none(changed: DataFrame) -> DataFrame:
    nothing = changed.where("false").select(F.col("path").alias("changed"), F.col("path").alias("test"))
    return signals(nothing, "none", F.lit(0.0), F.lit(""))


def translation_match(reg: Registry, changed: DataFrame) -> DataFrame:
    """A test that looks for a text whose key is, contains or lies in a key that the changed file uses."""
    if reg.i18n is None:
        return _none(changed)
    texts, _ = I.translations(reg.i18n, reg.files)
    own = changed.join(reg.files.select("path", "translation_keys"), "path").select(F.col("path").alias("changed"), F.explode("translation_keys").alias("k")).distinct()
    used = I.tests(reg.files).select(F.col("path").alias("test"), F.explode(F.transform("cypress.contains_text", lambda t: F.lower(F.trim(t)))).alias("text")).distinct()
    keys = used.join(texts, "text").select("test", "key").distinct()
    lies_in = contained(own.select(F.col("k").alias("token")).distinct(), keys.select(F.col("key").alias("token")).distinct(), 3)
    same = own.select(F.col("k").alias("token"), F.col("k").alias("other")).distinct()
    found = own.join(lies_in.union(same).select(F.col("token").alias("k"), F.col("other").alias("key")), "k").join(keys, "key").groupBy("changed", "test").agg(F.min("key").alias("key"))
    return signals(found, "translation-match", F.lit(WEIGHTS["translation-match"]), F.concat(F.lit("Test looks for the text of "), F.col("key")))


def api_intercept(reg: Registry, changed: DataFrame) -> DataFrame:
    """A test that intercepts a url whose path, or a leading part of it, the changed API file's path ends with.

    The path's endings are listed at segment starts and in between, so that pairs meet by
    equality. The empty path, as of '/api/*', matches every API file.
    """
    rows = changed.where("path LIKE '%/api/%' OR path LIKE '%/routes/%' OR path LIKE '%/handlers/%'").select(F.col("path").alias("changed"), F.regexp_replace("path", r"\.[jt]sx?$", "").alias("p"))
    ends = rows.select("changed", F.explode(F.transform(F.sequence(F.lit(1), F.length("p") + 1), lambda k: F.substr(F.col("p"), k))).alias("end"))
    calls = I.tests(reg.files).select(F.col("path").alias("test"), F.posexplode("cypress.intercepts").alias("pos", "c")).select("test", "pos", F.col("c.method").alias("method"), F.col("c.url_pattern").alias("url"))
    segment = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^/api/", ""), r"\*", ""), "/$", "")
    parts = F.filter(F.split(segment, "/"), lambda s: s != "")
    leading = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))
    wanted = calls.select("test", "pos", "method", "url", F.explode(F.array_union(F.array(segment), leading)).alias("end"))
    found = wanted.join(ends.distinct(), "end").groupBy("changed", "test").agg(F.min_by(F.struct("method", "url"), "pos").alias("c"))
    return signals(found, "api-intercept", F.lit(WEIGHTS["api-intercept"]), F.concat_ws(" ", F.lit("Test intercepts"), "c.method", "c.url"))


def colocation(reg: Registry, changed: DataFrame) -> DataFrame:
    """Same folder, a __tests__ folder in it, one folder up or down, or close cousins.

    All of them share a leading part of at most two folders less than either has, so
    folders meet on these parts.
    """
    def prefixes(df: DataFrame, name: str, other: tuple[str, str]) -> DataFrame:
        parts = F.filter(F.split(T.dirname("path"), "/"), lambda s: s != "")
        each = df.select(F.col("path").alias(name), parts.alias(f"{name}_parts"))
        n = F.size(f"{name}_parts")
        key = lambda kind, size: F.struct(F.lit(kind).alias("kind"), size.alias("shared"))
        whole = F.array(key("same", n), key(other[0], n))
        above = F.when(n > 1, F.array(key(other[1], n - 1))).otherwise(F.array().cast(whole_type))
        near = F.when(n >= 3, F.transform(F.sequence(F.greatest(n - 2, F.lit(3)), n), lambda k: key("near", k))).otherwise(F.array().cast(whole_type))
        keyed = each.withColumn("k", F.explode(F.concat(whole.cast(whole_type), above, near.cast(whole_type))))
        return keyed.select(name, f"{name}_parts", "k.kind", "k.shared").withColumn("prefix", F.array_join(F.slice(f"{name}_parts", 1, F.col("shared")), "/"))

    # a folder meets equal ones, those just below or above it, and such as share three folders or more
    whole_type = "array<struct<kind:string,shared:int>>"
    near = prefixes(changed.select("path"), "changed", ("below", "above")).join(prefixes(I.tests(reg.files).select("path"), "test", ("above", "below")), ["kind", "shared", "prefix"])
    pair = near.groupBy("changed", "test").agg(F.max("shared").alias("shared"), F.any_value("changed_parts").alias("c"), F.any_value("test_parts").alias("t"))
    n_c, n_t = F.size("c"), F.size("t")
    factor = (
        F.when((n_c == n_t) & (F.col("shared") == n_c), 1.0)
        .when((n_t == n_c + 1) & (F.col("shared") == n_c) & (F.element_at("t", -1) == "__tests__"), 0.85)
        .when((n_t == n_c + 1) & (F.col("shared") == n_c) & (n_c >= 2), 0.7)
        .when((n_c == n_t + 1) & (F.col("shared") == n_t) & (n_t >= 2), 0.7)
        .when((F.col("shared") >= F.greatest(n_c, n_t) - 2) & (F.col("shared") >= 3), 0.4)
    )
    found = pair.withColumn("factor", factor).where("factor IS NOT NULL")
    return signals(found, "colocation", WEIGHTS["colocation"] * F.col("factor"), F.concat(F.lit("Colocated: "), F.array_join("t", "/")))


def describe_block(reg: Registry, changed: DataFrame) -> DataFrame:
    """Words of the changed file's name in the titles of a test, weighed by how rare they are in titles."""
    src = changed.select(F.col("path").alias("changed"), T.title_source_tokens("path").alias("ct"), T.feature_identity("path").alias("cf")).where("size(ct) > 0")
    idf = I.title_idf(reg.files)
    c_tokens = src.select("changed", F.explode("ct").alias("token")).join(idf, "token", "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
    mass = c_tokens.groupBy("changed").agg(F.sum("idf").alias("mass"))
    hit = c_tokens.join(I.titles(reg.files).select("test", F.explode("tokens").alias("token")), "token")
    pair = hit.groupBy("changed", "test").agg(F.count("*").alias("n"), F.sum("idf").alias("hit"), F.max("idf").alias("best"), F.min("token").alias("any"), F.array_sort(F.collect_set("token")).alias("tokens"))
    full = pair.join(mass, "changed").join(src, "changed").withColumn("tf", T.feature_identity("test"))
    ratio, n_c = F.col("hit") / F.col("mass"), F.size("ct")
    common = (F.col("n") >= 2) & (F.col("best") < 0.55) & (F.col("hit") / F.col("n") < 0.5)
    little = ((F.col("n") == 1) & (F.col("best") < 0.35)) | ((n_c >= 4) & (ratio < 0.4)) | ((F.col("best") < 0.45) & (ratio < 0.5)) | (common & (ratio >= 0.9) & (n_c <= 2))
    stray = (F.col("n") == 1) & (F.length("any") <= 10) & (n_c > 1) & ~T.shares_feature(F.col("cf"), F.col("tf"))
    return signals(full.where(~little & ~stray), "describe-block", WEIGHTS["describe-block"] * F.least(F.lit(1.0), 0.6 + 0.4 * ratio), F.concat(F.lit("Titles mention "), F.array_join("tokens", ", ")))


def action_type(reg: Registry, changed: DataFrame, first: int = 40, most_owners: int = 25, shown: int = 3) -> DataFrame:
    """Action types among the changed file's first 40 that the test has too and not more than 25 files own."""
    actions = I.action_types(reg.files)
    own = changed.join(actions, "path").where(F.col("pos") < first).select(F.col("path").alias("changed"), "value", "pos")
    rare = actions.groupBy("value").agg(F.count("*").alias("owners")).where(F.col("owners") <= most_owners)
    used = actions.join(I.tests(reg.files).select("path"), "path", "left_semi").select(F.col("path").alias("test"), "value")
    found = own.join(rare, "value").join(used, "value").groupBy("changed", "test").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "value"))), 1, shown)["value"].alias("values"))
    return signals(found, "action-type", F.lit(WEIGHTS["action-type"]), F.concat(F.lit("Shared action types: "), F.array_join("values", ", ")))


def usage_site(reg: Registry, changed: DataFrame, steps: int = 3) -> DataFrame:
    """A test whose imports (or, without any, whose visited components) use the changed file within three steps.

    Its cone is all that does so, tests as well; with fewer steps neither reaches further than these.
    """
    cfg = reg.config.scoring
    cone = G.capped_cone(reg.little_imported(changed), G.reverse(reg.graph), steps, cfg.max_cone)
    tests = I.tests(reg.files)
    imports = tests.select(F.col("path").alias("test"), F.explode("imports").alias("node"))
    bare = tests.where("imports IS NULL OR size(imports) = 0").select(F.col("path").alias("test"))
    visited = I.visits(reg.files).join(reg.routes.select(F.col("pattern").alias("raw"), F.col("component").alias("node")), "raw").join(bare, "test", "left_semi").select("test", "node")
    pair = imports.unionByName(visited).join(cone, "node").groupBy(F.col("seed").alias("changed"), "test").agg(F.min(F.greatest("depth", F.lit(1))).alias("depth"), F.max(F.col("depth") == 0).alias("own"), F.max("cone_size").alias("cone_size"))
    depth = F.when(F.col("own"), 1).otherwise(F.col("depth"))
    factor = F.when(depth == 1, 0.4).when(depth == 2, 0.85).otherwise(0.6) * F.when(F.col("cone_size") > 0, F.greatest(F.lit(0.3), 1 - F.col("cone_size") / cfg.max_cone)).otherwise(1.0)
    return signals(pair, "usage-site", WEIGHTS["usage-site"] * factor, F.concat(F.lit("Imports a user of the changed file at depth "), depth.cast("string")))


def creation_weight(gap_days: Column, reg_temporal) -> Column:
    """Full weight for a small gap between creations, falling to none; a test made before its source has half the time."""
    soft = F.when(gap_days >= 0, reg_temporal.soft_days).otherwise(reg_temporal.soft_days / 2)
    hard = F.when(gap_days >= 0, reg_temporal.hard_days).otherwise(reg_temporal.soft_days)
    gap = F.abs(gap_days)
    return F.when(gap <= soft, reg_temporal.max_weight).when((gap >= hard) | (hard <= soft), 0.0).otherwise(reg_temporal.max_weight * (hard - gap) / (hard - soft))


def coupling_weight(co: Column, a: Column, b: Column, windows: Column, most: float) -> Column:
    """Weight of shared windows beyond chance: co of them, where the two have a and b of all windows."""
    lift = co / (a * b / windows)
    return F.when((co >= 2) & (lift > 1), most * (1 - 1 / lift)).otherwise(0.0)


def temporal_coherence(reg: Registry, changed: DataFrame, pairs: DataFrame) -> DataFrame:
    """How closely the creation and the updates of two files go together; for given pairs (changed, test).

    It only corroborates: it never makes a pair a candidate, so the pairs that other
    evidence has found are all it needs.
    """
    if reg.history is None:
        return _none(changed)
    t = reg.config.scoring.temporal
    window = t.window_days * 86400
    repo = reg.files.select("path", F.coalesce("repo_root", F.lit("")).alias("repo"))
    past = reg.history.withColumn("repo", F.coalesce("repo", F.lit(""))).join(repo, ["repo", "path"], "left_semi")
    past = past.withColumn("buckets", F.array_distinct(F.transform(F.filter("commits", lambda c: c["size"] <= t.max_commit_files), lambda c: F.floor(c["ts"] / window))))
    side = lambda name, p: past.select(F.col("path").alias(name), F.col("created_at").alias(f"{p}_made"), F.col("updated_at").alias(f"{p}_last"), F.col("buckets").alias(f"{p}_b"))
    both = pairs.select("changed", "test").distinct().join(side("changed", "c"), "changed").join(side("test", "t"), "test")
    made = creation_weight((F.col("t_made") - F.col("c_made")) / 86400, t)
    windows = F.greatest(F.lit(1), F.floor((F.greatest("c_last", "t_last") - F.least("c_made", "t_made")) / window) + 1)
    n_c, n_t, co = F.size("c_b"), F.size("t_b"), F.size(F.array_intersect("c_b", "t_b"))
    coupled = F.when((n_c > 0) & (n_t > 0), coupling_weight(co, n_c, n_t, windows, t.max_weight)).otherwise(0.0)
    weight = F.least(F.lit(t.max_weight), 1 - (1 - made) * (1 - coupled))
    return signals(both.withColumn("w", weight).where("w > 0"), "temporal-coherence", F.col("w"), F.lit("Created or changed at the same times"))


#: A scorer by its name; ``temporal_coherence`` stands apart, as it needs pairs.
SCORERS: dict[str, Callable[[Registry, DataFrame], DataFrame]] = {
    "direct-import": direct_import, "route-match": route_match, "selector-match": selector_match, "transitive-import": transitive_import,
    "filename-match": filename_match, "redux-chain": redux_chain, "redux-consumer": redux_consumer, "translation-match": translation_match,
    "selector-id-match": selector_id, "api-intercept": api_intercept, "colocation": colocation, "describe-block": describe_block,
    "dependent-selector": dependent_selector, "action-type": action_type, "usage-site": usage_site,
}


#: What no signal of a kind weighs more than. A kind without an entry, as of a registered scorer, may weigh anything.
LIMITS = WEIGHTS | {"filename-match": max(WEIGHTS["filename-match"], 0.95)}
_BUILT_IN = dict(SCORERS)


def usable(reg: Registry) -> dict[str, Callable[[Registry, DataFrame], DataFrame]]:
    """The scorers that can find anything in the registry."""
    idle = {redux_chain, redux_consumer} if reg.redux is None else set()
    idle |= {translation_match} if reg.i18n is None else set()
    return {k: f for k, f in SCORERS.items() if f not in idle and (reg.facts is None or NEEDS.get(k) is None or NEEDS[k] in reg.facts)}


def least_doubt(reg: Registry, kinds: Iterable[str], factor: float = 1.0) -> float:
    """The least that signals of these kinds and temporal ones, damped by a factor, can leave of the doubt about a pair, which is 1 - its score."""
    limits = [LIMITS[kind] if SCORERS.get(kind) is _BUILT_IN.get(kind, ...) else None for kind in kinds]
    limits += [] if reg.history is None else [reg.config.scoring.temporal.max_weight]
    return prod(0.0 if limit is None else 1 - min(max(limit * factor, 0.0), 1.0) for limit in limits)


def register(name: str, scorer: Callable[[Registry, DataFrame], DataFrame]) -> None:
    """Adds a scorer, or puts it in another's place."""
    SCORERS[name] = scorer


def unregister(name: str) -> None:
    SCORERS.pop(name, None)
