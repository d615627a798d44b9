"""One query for each numbered operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocation, decontaminate, hard_negatives, html_text, language, near_dedup, pii, quality, secret_scan, token_counts, toxicity, warc
from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies that every document is in."""
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


@query
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and hashes of the ids and of the decoded text, for every document."""
    return bpe.round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    return toxicity.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return language.held_out_predictions(table(spark, sf_dir, "documents"))


@query
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.main_text(table(spark, sf_dir, "pages"), "page_id", "html", "url")


@query
def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it comes back from normalised archives."""
    return warc.archived(table(spark, sf_dir, "pages")).drop("url")


ORACLES["op6_warc_round_trip"] = warc.SQL


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document, counted in flat token files."""
    return token_counts.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts for every document."""
    return quality.measured(table(spark, sf_dir, "documents"))


ORACLES["op8_quality_cascade"] = quality.SQL


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; a document is a repository, its source the owner."""
    return secret_scan.report(secret_scan.scan(table(spark, sf_dir, "documents")))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items."""
    return decontaminate.report(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


ORACLES["op10_decontamination"] = decontaminate.SQL


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector for each of its positives; every seventh vector has another label."""
    label = F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)")
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


ORACLES["op11_hard_negatives"] = hard_negatives.SQL


@query
def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.report(pii.scan(table(spark, sf_dir, "documents")))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    return collocation.phrases(table(spark, sf_dir, "documents"))


ORACLES["op13_collocations"] = collocation.SQL
