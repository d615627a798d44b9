"""Gates, fusion, bands and views on signals between parts and orders."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplespark.config import Scoring
from ripplespark.operators import fusion, views

from . import query, table

_SIGNALS = """s AS (SELECT 'p' || l_partkey AS changed, 'o' || l_orderkey AS test,
  CASE l_returnflag WHEN 'A' THEN '{a}' WHEN 'R' THEN '{r}' ELSE '{n}' END AS type, l_discount * 5 AS weight, l_linenumber <> 1 AS eligible FROM lineitem)"""


def signals(spark: SparkSession, sf_dir: str, a: str, r: str, n: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", a).when(F.col("l_returnflag") == "R", r).otherwise(n)
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), "l_partkey").alias("changed"), F.concat(F.lit("o"), "l_orderkey").alias("test"), kind.alias("type"),
        (F.col("l_discount") * 5).alias("weight"), (F.col("l_linenumber") != 1).alias("anchor_eligible"), F.lit("line item").alias("reason"),
    )


@query("SELECT l_orderkey AS order_key, round(1 - product(1 - greatest(least(l_discount, 1), 0)), 6) AS score FROM lineitem GROUP BY 1")
def noisy_or_orders(spark, sf_dir):
    """Discounts of an order's items joined by noisy-or."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.round(fusion.noisy_or("l_discount"), 6).alias("score"))


@query("""SELECT CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS pairs
FROM (SELECT l_orderkey, round(1 - product(1 - least(l_discount * 5, 1)), 6) AS score FROM lineitem GROUP BY 1) GROUP BY 1""")
def confidence_bands(spark, sf_dir):
    """Orders by the band of their score."""
    scored = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(fusion.noisy_or(F.col("l_discount") * 5), 6).alias("score"))
    return scored.groupBy(fusion.band("score").alias("confidence")).agg(F.count("*").alias("pairs"))


@query("WITH " + _SIGNALS.format(a="describe-block", r="temporal-coherence", n="action-type") + """
SELECT changed, test, type, count(*) AS signals FROM (SELECT *, bool_or(type = 'action-type') OVER (PARTITION BY changed, test) AS other FROM s)
WHERE type <> 'describe-block' OR other GROUP BY ALL""")
def describe_gate(spark, sf_dir):
    """Signals left when titles need another signal beside them."""
    kept = fusion.describe_gate(signals(spark, sf_dir, "describe-block", "temporal-coherence", "action-type"))
    return kept.groupBy("changed", "test", "type").agg(F.count("*").alias("signals"))


@query("WITH " + _SIGNALS.format(a="direct-import", r="route-match", n="redux-chain") + """,
h AS (SELECT 'p' || p_partkey AS changed FROM part WHERE p_size >= 40),
m AS (SELECT s.*, s.changed IN (SELECT changed FROM h) AS hub FROM s),
g AS (SELECT *, bool_or(eligible AND (type = 'direct-import' OR (type = 'route-match' AND NOT hub))) OVER (PARTITION BY changed, test) AS anchored FROM m)
SELECT changed, test, count(*) AS signals FROM g WHERE anchored GROUP BY ALL""")
def anchor_gate(spark, sf_dir):
    """Pairs with an anchor; from large parts, which play hubs, routes are none."""
    hubs = table(spark, sf_dir, "part").where("p_size >= 40").select(F.concat(F.lit("p"), "p_partkey").alias("path"))
    kept = fusion.anchor_gate(signals(spark, sf_dir, "direct-import", "route-match", "redux-chain"), hubs)
    return kept.groupBy("changed", "test").agg(F.count("*").alias("signals"))


@query("WITH " + _SIGNALS.format(a="direct-import", r="route-match", n="redux-chain") + """,
u AS (SELECT 'p' || l_partkey AS changed, count(DISTINCT l_orderkey) / (SELECT count(*) FROM orders) AS ubiquity FROM lineitem GROUP BY 1),
d AS (SELECT changed, test, weight * CASE WHEN ubiquity > 0.002 THEN 0.3 ELSE 1 END AS weight, ubiquity > 0.002 AS damped FROM s JOIN u USING (changed))
SELECT changed, test, round(1 - product(1 - least(weight, 1)), 6) AS score, bool_or(damped) AS damped FROM d GROUP BY 1, 2""")
def ubiquity_damping(spark, sf_dir):
    """Scores of pairs when parts in more than a fixed share of orders weigh less."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").distinct()
    n = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))
    ubiquity = lines.groupBy("l_partkey").agg(F.count("*").alias("used")).join(n).select(F.concat(F.lit("p"), "l_partkey").alias("path"), (F.col("used") / F.col("n")).alias("ubiquity"))
    damped = fusion.dampen(signals(spark, sf_dir, "direct-import", "route-match", "redux-chain"), ubiquity, replace(Scoring(), ubiquity_threshold=0.002))
    return damped.groupBy("changed", "test").agg(F.round(fusion.noisy_or("weight"), 6).alias("score"), F.bool_or(F.col("original_weight").isNotNull()).alias("damped"))


_SCORED = """WITH r AS (SELECT 'c' || o_custkey AS changed, 'o' || o_orderkey AS test, round(o_totalprice / 600000 + 1e-9, 6) AS score FROM orders),
b AS (SELECT *, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM r)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("changed"), F.concat(F.lit("o"), "o_orderkey").alias("test"), F.round(F.col("o_totalprice") / 600000 + 1e-9, 6).alias("score"))
    return rows.withColumn("confidence", fusion.band("score"))


@query(_SCORED + """ SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY changed ORDER BY score DESC, test)::INT AS rank FROM b WHERE score >= 0.4) WHERE rank <= 3""")
def topk_per_changed(spark, sf_dir):
    """The three best orders of each customer, if they are good enough."""
    return fusion.results(scored(spark, sf_dir), replace(Scoring(), max_results=3))


@query("""WITH r AS (SELECT 'p' || l_partkey AS changed, 'o' || l_orderkey AS test, round(max(l_discount) * 10, 6) AS score FROM lineitem GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM r)
SELECT test, changed, score, confidence FROM (SELECT *, row_number() OVER (PARTITION BY test ORDER BY score DESC, changed) AS n FROM b) WHERE n = 1""")
def dedupe_by_test(spark, sf_dir):
    """Each order once, with the part that it has its best score with."""
    best = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("p"), "l_partkey").alias("changed"), F.concat(F.lit("o"), "l_orderkey").alias("test")).agg(F.round(F.max("l_discount") * 10, 6).alias("score"))
    return views.by_test(best.withColumn("confidence", fusion.band("score")))


@query(_SCORED + " SELECT confidence, count(*) AS tests FROM b GROUP BY 1")
def band_counts(spark, sf_dir):
    """How many orders are in which band."""
    return views.band_counts(scored(spark, sf_dir))


@query(_SCORED + " SELECT * FROM b ORDER BY score DESC, changed, test LIMIT 100")
def flat_results(spark, sf_dir):
    """The hundred best pairs of all; the limit is what the view is for."""
    return views.flat(scored(spark, sf_dir), 100)
