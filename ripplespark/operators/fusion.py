"""From signals to ranked results: gates, damping, noisy-or, bands, explanations and cuts. The order matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplespark.config import Scoring

NARROW_ANCHORS = ("direct-import", "filename-match", "colocation")
MEDIUM_ANCHORS = ("route-match", "selector-match", "selector-id-match", "transitive-import")
#: What a result says about its strongest signals.
EXPLANATIONS = {
    "direct-import": "Imports the changed file itself",
    "transitive-import": "Imports a file that imports the changed one",
    "route-match": "Opens a page on which the changed file is shown",
    "selector-match": "Uses elements that the changed file marks for tests",
    "selector-id-match": "Looks up ids that the changed file sets",
    "filename-match": "Has the changed file's name",
    "translation-match": "Expects a text whose key the changed file uses",
    "redux-chain": "Shares a slice of state with the changed file",
    "redux-consumer": "Opens a page that reads state which the changed file holds",
    "api-intercept": "Replaces a call that the changed file answers",
    "colocation": "Stands next to the changed file",
    "describe-block": "Speaks of the changed file in its titles",
    "temporal-coherence": "Came about or changed at the same times as the changed file",
}
WEAK = "Little speaks for this test; look at it if in doubt."


def describe_gate(signals: DataFrame) -> DataFrame:
    """Titles alone prove nothing: describe-block goes where no other signal than the temporal one stands by it."""
    other = F.max(~F.col("type").isin("describe-block", "temporal-coherence")).over(Window.partitionBy("changed", "test"))
    return signals.withColumn("_other", other).where("type <> 'describe-block' OR _other").drop("_other")


def is_anchor(hub: Column) -> Column:
    medium = F.col("type").isin(*MEDIUM_ANCHORS) & ~hub
    return F.coalesce("anchor_eligible", F.lit(True)) & (F.col("type").isin(*NARROW_ANCHORS) | medium)


def anchor_gate(signals: DataFrame, hubs: DataFrame) -> DataFrame:
    """Only pairs with a signal that ties them to the file itself; from a hub (column ``path``), wide ones don't."""
    marked = signals.join(hubs.select(F.col("path").alias("changed"), F.lit(True).alias("hub")), "changed", "left")
    anchored = F.max(is_anchor(F.coalesce("hub", F.lit(False)))).over(Window.partitionBy("changed", "test"))
    return marked.withColumn("_anchored", anchored).where("_anchored").drop("_anchored", "hub")


def dampen(signals: DataFrame, ubiquity: DataFrame, cfg: Scoring | None = None) -> DataFrame:
    """Weights of files (path, ubiquity) that most sources import are cut; the old weight stays beside."""
    cfg = cfg or Scoring()
    wide = ubiquity.where(F.col("ubiquity") > cfg.ubiquity_threshold).select(F.col("path").alias("changed"), "ubiquity")
    joined = signals.join(wide, "changed", "left")
    out = joined.withColumn("original_weight", F.when(F.col("ubiquity").isNotNull(), F.col("weight")))
    return out.withColumn("weight", F.when(F.col("ubiquity").isNotNull(), F.col("weight") * cfg.ubiquity_factor).otherwise(F.col("weight"))).drop("ubiquity")


def noisy_or(weight: Column | str) -> Column:
    """1 - product(1 - w) over weights held between 0 and 1; 0 where there are none."""
    w = F.col(weight) if isinstance(weight, str) else weight
    return F.coalesce(1 - F.product(1 - F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0))), F.lit(0.0))


def band(score: Column | str, cfg: Scoring | None = None) -> Column:
    cfg, score = cfg or Scoring(), F.col(score) if isinstance(score, str) else score
    return F.when(score >= cfg.high_confidence, "high").when(score >= cfg.min_confidence, "medium").otherwise("low")


def band_rank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "high", 2).when(c == "medium", 1).otherwise(0)


def explanation(signals: Column) -> Column:
    """The two strongest of an array of signals (weight, type, reason) in words."""
    said = F.create_map(*(F.lit(x) for kv in EXPLANATIONS.items() for x in kv))
    best = F.slice(F.reverse(F.array_sort(signals)), 1, 2)
    words = F.transform(best, lambda s: F.coalesce(said[s["type"]], s["reason"], F.lit("This test is connected to the changed file")))
    return F.when(F.size(signals) == 0, WEAK).otherwise(F.concat(F.array_join(words, ". "), F.lit(".")))


def fuse(signals: DataFrame, cfg: Scoring | None = None) -> DataFrame:
    """(changed, test, score, confidence, n_signals, signals, explanation) of every pair.

    Scores are rounded to twelve places, so that equal evidence ties in whatever order it is multiplied.
    """
    each = F.struct("weight", "type", "reason", "anchor_eligible")
    found = signals.groupBy("changed", "test").agg(F.round(noisy_or("weight"), 12).alias("score"), F.count("*").cast("int").alias("n_signals"), F.array_sort(F.collect_list(each)).alias("signals"))  # as many as there are scorers
    return found.select("changed", "test", "score", band("score", cfg).alias("confidence"), "n_signals", "signals", explanation(F.col("signals")).alias("explanation"))


def results(scored: DataFrame, cfg: Scoring | None = None, all_results: bool = False) -> DataFrame:
    """Per changed file the ``max_results`` best pairs of at least ``min_confidence``, with their rank; ties by test."""
    cfg = cfg or Scoring()
    ranked = scored.where(F.col("score") >= cfg.min_confidence).withColumn("rank", F.row_number().over(Window.partitionBy("changed").orderBy(F.desc("score"), "test")))
    return ranked if all_results else ranked.where(F.col("rank") <= (cfg.max_results or 10))


def split_ubiquitous(selectors: DataFrame, frequency: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Selectors (value) with their share of tests and whether it is above the threshold."""
    return selectors.select("value").distinct().join(frequency.select("value", "share"), "value", "left").select("value", F.coalesce("share", F.lit(0.0)).alias("share"), (F.coalesce("share", F.lit(0.0)) > threshold).alias("ubiquitous"))


def shares_text(split: DataFrame) -> DataFrame:
    """One row: ubiquitous selectors with their shares, widest first."""
    wide = split.where("ubiquitous").groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "value"))).alias("x"))
    return wide.select(F.array_join(F.transform("x", lambda e: F.concat(e["value"], F.lit(" "), F.format_number(-e["s"] * 100, 0), F.lit("%"))), ", ").alias("text"))
