"""The whole analysis: which tests do changed files matter to, how much, and why."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplespark.operators import fusion, graph
from ripplespark.operators.scorers import Registry, least_doubt, selector_kinds, selector_match, temporal_coherence, usable
from ripplespark.sources.files import saved


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def known(reg: Registry, changed: DataFrame) -> DataFrame:
    """The changed files that the registry has; others have no results."""
    return changed.select("path").distinct().join(reg.files.where("type = 'source'").select("path"), "path", "left_semi")


def all_signals(reg: Registry, changed: DataFrame) -> DataFrame:
    """Every scorer's signals, and the temporal ones of the pairs that any other has."""
    found = _union([scorer(reg, changed) for scorer in usable(reg).values()])
    return found if reg.history is None else found.unionByName(temporal_coherence(reg, changed, found))


def anchored_signals(reg: Registry, changed: DataFrame, best: int | None = None) -> DataFrame:
    """The same signals, of anchored pairs only: anchors come first and the others are cut down to their pairs.

    Right where the anchor gate is on, as other pairs would score 0. A hub's wide anchors don't count.
    Where only the ``best`` pairs of a file are asked for, pairs that can't be among them may be left out.
    """
    kinds = (*fusion.NARROW_ANCHORS, *fusion.MEDIUM_ANCHORS)
    scorers = usable(reg)
    bounded = best is not None and scorers.get("selector-match") is selector_match and 0 <= reg.config.scoring.ubiquity_factor <= 1
    first = [scorers[k](reg, changed) for k in kinds if k in scorers and not (bounded and k == "selector-match")]
    hubs = graph.hubs(reg.files, reg.config.scoring).select(F.col("path").alias("changed"), F.lit(True).alias("hub"))
    if not bounded or not first:
        anchors = saved(_union(first or [selector_match(reg, changed)]), "anchors")
    else:
        anchors = _with_selectors(reg, changed, saved(_union(first), "narrow-anchors"), hubs, lambda factor: least_doubt(reg, scorers.keys() - set(kinds), factor), best)
    pairs = anchors.join(hubs, "changed", "left").where(fusion.is_anchor(F.coalesce("hub", F.lit(False)))).select("changed", "test").distinct()
    pairs = saved(pairs, "pairs")
    support = [scorer(reg, changed) for k, scorer in scorers.items() if k not in kinds]
    if reg.history is not None:
        support.append(temporal_coherence(reg, changed, pairs))
    return _union([anchors, *support]).join(pairs, ["changed", "test"], "left_semi")


def _with_selectors(reg: Registry, changed: DataFrame, first: DataFrame, hubs: DataFrame, doubt: Callable[[float], float], best: int) -> DataFrame:
    """Other anchors' signals (first) and those of selectors, which join every copy of a file with every copy of a test.

    More evidence never lowers a score, so a file's ``best`` pairs have at least the score that its ``best``-th pair has
    by ``first`` alone. A pair that nothing but a selector ties to the file is left out if even the most that is
    missing, which would leave ``doubt`` of its doubt where evidence is damped by a factor, couldn't bring it there. This is mostly known of whole kinds of files.
    """
    cfg = reg.config.scoring
    selectors = selector_kinds(reg, changed)
    selectors = replace(selectors, **{k: saved(getattr(selectors, k), f"selector-{k}") for k in ("rows", "own", "used")})
    ubiquity = graph.ubiquity(reg.files, reg.graph)
    known = fusion.dampen(first, ubiquity, cfg).join(hubs, "changed", "left")
    known = known.groupBy("changed", "test").agg(F.max(fusion.is_anchor(F.coalesce("hub", F.lit(False)))).alias("anchored"), fusion.noisy_or("weight").alias("least"))
    known = saved(known, "known")
    ranked = known.where("anchored").withColumn("rank", F.row_number().over(Window.partitionBy("changed").orderBy(F.desc("least"))))
    bars = ranked.where(F.col("rank") == best).select("changed", F.col("least").alias("bar"))
    # the weight that a selector must have; scores are rounded to twelve places, and damping cuts all evidence for a file alike
    bar = F.greatest(F.coalesce("bar", F.lit(0.0)), F.lit(cfg.min_confidence)) - 1e-9
    need = lambda factor: (1 - (1 - bar) / doubt(factor)) / factor if doubt(factor) and factor else F.lit(-1.0)
    wide = ubiquity.where(F.col("ubiquity") > cfg.ubiquity_threshold).select(F.col("path").alias("changed"), F.lit(True).alias("wide"))
    needed = selectors.own.join(hubs, "changed", "left_anti").join(bars, "changed", "left").join(wide, "changed", "left")
    needed = saved(needed.select("kind", "changed", F.when(F.col("wide"), need(cfg.ubiquity_factor)).otherwise(need(1.0)).alias("need")), "needed")
    lowest = needed.groupBy(F.col("kind").alias("changed")).agg(F.min("need").alias("need"))
    rows = selectors.rows.join(lowest, "changed").where("weight > need").select(selectors.rows.columns)
    new = replace(selectors, rows=rows, own=needed.select("kind", "changed")).of_files().join(needed.select("changed", "need"), "changed").where("weight > need").select(first.columns)
    return saved(_union([first, selectors.of_pairs(known), new.join(known.select("changed", "test"), ["changed", "test"], "left_anti")]), "anchors")


def gated(reg: Registry, signals: DataFrame, anchored: bool = False) -> DataFrame:
    """Titles' gate, anchors' gate and damping, in this order.

    Where every pair is known to have an anchor, both gates would let all signals through and are left out.
    """
    cfg = reg.config.scoring
    if not anchored:
        signals = fusion.describe_gate(signals)
        if cfg.require_anchor:
            signals = fusion.anchor_gate(signals, graph.hubs(reg.files, cfg))
    return fusion.dampen(signals, graph.ubiquity(reg.files, reg.graph), cfg)


def analyse(reg: Registry, changed: DataFrame, all_results: bool = False, anchor_first: bool = True) -> DataFrame:
    """(changed, test, score, confidence, n_signals, signals, explanation, rank) for the changed files (path)."""
    reg = reg.stored() if reg.facts is None else reg
    cfg, changed = reg.config.scoring, saved(known(reg, changed), "changed")
    first = anchor_first and cfg.require_anchor and cfg.min_confidence > 0
    signals = anchored_signals(reg, changed, None if all_results else cfg.max_results or 10) if first else all_signals(reg, changed)
    return fusion.results(fusion.fuse(gated(reg, signals, first), cfg), cfg, all_results)
