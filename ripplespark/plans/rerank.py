"""The second look as one plan: earlier decisions, triage, split, prompts, calls, verdicts, scores, new decisions.

Every stage is a table in a folder of the run.  A stage whose table is complete is read, not
made again, so a run that was lost in the middle goes on where it stopped, and no judge is
asked twice about what it has answered.  Nothing that fails loses a pair: a change that can't
be triaged counts as behaviour, a pair without a verdict stays with the note that it wasn't
evaluated, and its score is what it was.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplespark.config import Rerank, Scoring
from ripplespark.operators import rerank as R
from ripplespark.operators.fusion import band, results
from ripplespark.operators.judge import Ask, replied
from ripplespark.sources.stores import LockStore

STRICT = "Decide whether this test would fail if the change broke what it touches. A shared name, folder or library alone is no reason to say so."
BROAD = "Decide whether this test runs any code that the change touches, directly or through pages and state that depend on it. When in doubt, say that it does."
TRIAGE = "Decide whether this change is cosmetic: blanks, comments, order of imports or names without any effect on what the code does."
VERDICT_FORM = 'Reply with JSON only: {"relevant": true or false, "confidence": 0 to 1, "why": [{"tag": "", "file": "", "point": ""}]}'
TRIAGE_FORM = 'Reply with JSON only: {"cosmetic": true or false, "confidence": 0 to 1, "why": ""}'
#: What a kept pair's note says where the judge gave no point of its own.
NOTES = {
    "Not evaluated": "The judge gave no usable answer, so the test stays; look at it yourself",
    "Direct match": "The test imports the changed file or stands next to it",
    "Low confidence": "The judge doubts this test, but not surely enough to leave it out",
    "Strong match": "The evidence was strong enough without a judge",
}


class Stages:
    """Tables of a run by name, each made once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.made: list[str] = []

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stored table, or else what ``make`` gives, stored; a table without its mark of success is made anew."""
        path = f"{self.folder}/{name}"
        try:
            self.spark.read.text(f"{path}/_SUCCESS")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error.getCondition() or error):
                raise
            make().write.mode("overwrite").parquet(path)
            self.made.append(name)
        return self.spark.read.parquet(path)


@dataclass(frozen=True)
class Style:
    """How the judge is asked and what its verdicts move.

    task: what a prompt asks for; triage: whether changes are looked at first; fuse: whether a
    verdict's confidence moves the score of pairs that were judged, or only keeps and drops.
    """

    task: str = STRICT
    triage: bool = False
    fuse: bool = True
    protect: bool = True


def triaged(changes: DataFrame, ask: Ask, cfg: Rerank, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(changed, cosmetic, confidence) of changes (changed, summary); what can't be read is no cosmetic change."""
    prompts = changes.select("changed", F.concat(F.lit(TRIAGE + "\n\nCHANGE "), "changed", F.lit("\n"), F.coalesce("summary", F.lit("")), F.lit("\n\n" + TRIAGE_FORM)).alias("prompt"))
    got = replied(prompts, ask, cfg, wait=wait).withColumn("_v", F.try_parse_json(F.regexp_extract("reply", r"(?s)\{.*\}", 0)))
    cosmetic = F.expr("schema_of_variant(try_variant_get(_v, '$.cosmetic', 'variant')) = 'BOOLEAN'") & F.try_variant_get("_v", "$.cosmetic", "boolean")
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_variant_get("_v", "$.confidence", "double")))
    return got.select("changed", F.coalesce(cosmetic, F.lit(False)).alias("cosmetic"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"))


def asked_pairs(split: DataFrame, summaries: DataFrame, excerpts: DataFrame, task: str) -> DataFrame:
    """(changed, test, prompt) of pairs to be judged, each with its own prompt; missing texts are left empty."""
    judge = split.where("fate = 'judge'").select("changed", "test")
    both = judge.join(summaries.select("changed", "summary"), "changed", "left").join(excerpts.select("test", "excerpt"), "test", "left")
    parts = [F.lit(task + "\n\nCHANGE "), "changed", F.lit("\n"), F.coalesce("summary", F.lit("")), F.lit("\n\nTEST "), "test", F.lit("\n"), F.coalesce("excerpt", F.lit("")), F.lit("\n\n" + VERDICT_FORM)]
    return both.select("changed", "test", F.concat(*parts).alias("prompt"))


def fused_score(prior: Column, verdict: Column) -> Column:
    """Late fusion with a verdict's confidence; one against a test counts as what is left of 1."""
    graded = F.when(verdict["relevant"], verdict["confidence"]).otherwise(1 - verdict["confidence"]) * 5
    return F.round(F.when(verdict.isNull(), prior).otherwise(R.late_score(prior, graded)), 12)


def decisions(decided: DataFrame, cfg: Rerank, at: int) -> DataFrame:
    """Sure verdicts as decisions for a lock: confirmed or rejected, with the judge's first point."""
    sure = decided.where(F.col("verdict").isNotNull() & (F.col("verdict.confidence") >= cfg.drop_confidence))
    reason = F.coalesce(F.get("verdict.why", F.lit(0))["point"], F.lit(""))
    return sure.select("changed", "test", F.when(F.col("verdict.relevant"), "confirmed").otherwise("rejected").alias("state"), reason.alias("reason"), F.lit(None).cast("string").alias("confirmed_at"), F.lit(at).cast("bigint").alias("at"))


def rerank(
    pairs: DataFrame, summaries: DataFrame, excerpts: DataFrame, ask: Ask, folder: str, cfg: Rerank | None = None, scoring: Scoring | None = None,
    style: Style | None = None, store: LockStore | None = None, at: int = 0, wait: Callable[[float], None] = time.sleep, all_results: bool = False,
) -> DataFrame:
    """(changed, test, prior, score, confidence, note, points, rank, outcome): what is left of analysed pairs, scored and banded anew.

    pairs: changed, test, score and signals, as the analysis gives them; summaries: changed and
    summary; excerpts: test and excerpt; both may lack some. folder: where the run's stages are.
    """
    cfg, scoring, style = cfg or Rerank(), scoring or Scoring(), style or Style()
    stages = Stages(pairs.sparkSession, folder)
    pairs = pairs.select(F.col("changed").cast("string").alias("changed"), F.col("test").cast("string").alias("test"), "score", "signals")
    lock = store.read() if store else pairs.sparkSession.createDataFrame([], "changed string, test string, state string")
    open_ = stages.table("open", lambda: R.partition_by_lock(pairs, lock))
    if style.triage:
        changes = open_.select("changed").distinct().join(summaries, "changed")
        open_ = R.untriaged(open_, stages.table("triage", lambda: triaged(changes, ask, cfg, wait)), cfg)
    split = stages.table("split", lambda: R.banded(open_, cfg, style.protect))
    prompts = stages.table("prompts", lambda: asked_pairs(split, summaries, excerpts, style.task))
    replies = stages.table("replies", lambda: replied(prompts, ask, cfg, wait=wait).drop("prompt"))
    verdicts = R.verdict(replies).select("changed", "test", "outcome", "verdict")
    decided = stages.table("decided", lambda: R.decided(split.join(verdicts, ["changed", "test"], "left"), cfg))
    if store:
        stages.table("decisions", lambda: _stored(store, decisions(decided, cfg, at)))
    score = fused_score(F.col("score"), F.col("verdict")) if style.fuse else F.col("score")
    score = F.when(F.col("score") >= cfg.auto_keep, F.col("score")).otherwise(score)
    said = F.create_map(*(F.lit(x) for kv in NOTES.items() for x in kv))
    own = F.coalesce(F.size("verdict.why") > 0, F.lit(False)) & F.coalesce("verdict.relevant", F.lit(False))
    plain = F.array(F.struct(F.col("note").alias("tag"), F.col("changed").alias("file"), said[F.col("note")].alias("point")))
    kept = decided.where("kept").select("changed", "test", F.col("score").alias("prior"), score.alias("score"), "note", F.when(own, F.col("verdict.why")).otherwise(plain).alias("points"), F.coalesce("outcome", F.lit("unasked")).alias("outcome"))
    return results(kept.withColumn("confidence", band("score", scoring)), scoring, all_results)


def _stored(store: LockStore, news: DataFrame) -> DataFrame:
    """Appends decisions and gives their number; a run that is taken up again doesn't come here twice."""
    rows = news.count()
    if rows:
        store.append(news)
    return news.sparkSession.range(1).select(F.lit(rows).cast("bigint").alias("decisions"))
