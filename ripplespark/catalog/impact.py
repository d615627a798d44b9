"""The whole analysis: which orders do parts matter to, by what they import, show and when they changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplespark import schema
from ripplespark.config import load
from ripplespark.operators.scorers import Registry
from ripplespark.plans import impact

from . import query, table


def shaped(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Rows with some columns of the table of files, and null for the others."""
    kind = spark.createDataFrame([], schema.FILES).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind))


def part_path(key: str) -> F.Column:
    return F.concat(F.lit("src/parts/p"), F.col(key), F.lit(".ts"))


def order_path(key: str) -> F.Column:
    return F.concat(F.lit("e2e/orders/o"), F.col(key), F.lit(".cy.ts"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sources with one selector each; orders as tests that import parts and use their selectors."""
    parts, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    value = F.concat_ws("-", "p_brand", "p_type", F.lpad(F.col("p_size").cast("string"), 2, "0"))
    sources = parts.select(part_path("p_partkey").alias("path"), F.concat(F.lit("p"), "p_partkey", F.lit(".ts")).alias("name"), F.lit("source").alias("type"), F.array(F.struct(F.lit("data-testid").alias("attr"), value.alias("value"))).alias("selectors"))
    shown = lines.select("l_orderkey", "l_partkey").join(parts.select(F.col("p_partkey").alias("l_partkey"), value.alias("value")), "l_partkey")
    shown = shown.select("l_orderkey", "l_partkey", "value").repartition("l_orderkey")  # keys are shuffled, not sets of paths; sets hold an item once
    orders = shown.groupBy("l_orderkey").agg(F.collect_set(part_path("l_partkey")).alias("imports"), F.collect_set("value").alias("values"))  # an order has a few items
    chosen = F.transform("values", lambda v: F.struct(F.lit("data-testid").alias("type"), v.alias("value"), v.alias("raw")))
    cypress = F.struct(F.array().cast("array<string>").alias("visited_routes"), chosen.alias("selectors"), *(F.lit(None).cast(t).alias(n) for n, t in (("contains_text", "array<string>"), ("intercepts", "array<struct<method:string,url_pattern:string>>"), ("url_assertions", "array<struct<operator:string,expected:string>>"), ("custom_commands", "array<string>"), ("describes", "array<string>"), ("its", "array<string>"))))
    tests = orders.select(order_path("l_orderkey").alias("path"), F.concat(F.lit("o"), "l_orderkey", F.lit(".cy.ts")).alias("name"), F.lit("test").alias("type"), "imports", cypress.alias("cypress"))
    return shaped(sources, spark).unionByName(shaped(tests, spark))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and orders as files that ship dates changed."""
    lines = table(spark, sf_dir, "lineitem")
    ts = F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
    each = lines.select(part_path("l_partkey").alias("path"), ts.alias("ts")).unionByName(lines.select(order_path("l_orderkey").alias("path"), ts.alias("ts"))).distinct()
    commit = F.struct("ts", F.lit(1).alias("size"))
    return each.groupBy("path").agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.collect_list(commit).alias("commits")).withColumn("repo", F.lit(""))


_FILES = """p AS (SELECT 'src/parts/p' || p_partkey || '.ts' AS changed, p_partkey, p_brand || '-' || p_type || '-' || lpad(p_size::VARCHAR, 2, '0') AS value FROM part),
l AS (SELECT DISTINCT 'e2e/orders/o' || l_orderkey || '.cy.ts' AS test, l_partkey FROM lineitem),
tv AS (SELECT DISTINCT test, value FROM l JOIN p ON p_partkey = l_partkey),
n AS (SELECT count(DISTINCT test) AS n FROM l),
fr AS (SELECT value, count(*) / (SELECT n FROM n) AS share FROM tv GROUP BY 1)"""
FLAGSHIP = f"""WITH {_FILES},
di AS (SELECT changed, test, 0.95 AS w, 'direct-import' AS type FROM l JOIN p ON p_partkey = l_partkey),
sm AS (SELECT changed, test, 0.8 * 0.35 * CASE WHEN (SELECT n FROM n) > 1 THEN (1 - share) * (1 - share) ELSE 1 END AS w, 'selector-match' AS type FROM tv JOIN p USING (value) JOIN fr USING (value) WHERE share <= 0.1),
base AS (SELECT * FROM di UNION ALL SELECT * FROM sm),
c AS (SELECT 'src/parts/p' || l_partkey || '.ts' AS path, epoch(l_shipdate)::BIGINT AS ts FROM lineitem UNION SELECT 'e2e/orders/o' || l_orderkey || '.cy.ts', epoch(l_shipdate)::BIGINT FROM lineitem),
h AS (SELECT path, min(ts) AS made, max(ts) AS last, list(DISTINCT floor(ts / 1209600)) AS b FROM c GROUP BY 1),
pr AS (SELECT DISTINCT changed, test FROM base),
us AS (SELECT changed, test, 0.55 * 0.4 * greatest(0.3, 1 - k / 80.0) AS w, 'usage-site' AS type FROM di JOIN (SELECT changed, count(*) AS k FROM di GROUP BY 1) USING (changed) WHERE k < 80),
t0 AS (SELECT changed, test, (t.made - s.made) / 86400 AS gap, len(s.b) AS nc, len(t.b) AS nt, len(list_intersect(s.b, t.b)) AS co,
  greatest(1, floor((greatest(s.last, t.last) - least(s.made, t.made)) / 1209600) + 1) AS win FROM pr JOIN h s ON s.path = changed JOIN h t ON t.path = test),
t1 AS (SELECT *, CASE WHEN gap >= 0 THEN 14.0 ELSE 7.0 END AS soft, CASE WHEN gap >= 0 THEN 28.0 ELSE 14.0 END AS hard FROM t0),
t2 AS (SELECT changed, test, CASE WHEN abs(gap) <= soft THEN 0.45 WHEN abs(gap) >= hard THEN 0 ELSE 0.45 * (hard - abs(gap)) / (hard - soft) END AS cw,
  CASE WHEN co >= 2 AND co / (nc * nt / win) > 1 THEN 0.45 * (1 - 1 / (co / (nc * nt / win))) ELSE 0 END AS uw FROM t1),
tc AS (SELECT changed, test, least(0.45, 1 - (1 - cw) * (1 - uw)) AS w, 'temporal-coherence' AS type FROM t2 WHERE least(0.45, 1 - (1 - cw) * (1 - uw)) > 0),
s AS (SELECT * FROM base UNION ALL SELECT * FROM us UNION ALL SELECT * FROM tc),
u AS (SELECT 'src/parts/p' || l_partkey || '.ts' AS changed, count(*) / (SELECT count(*) FROM part) AS ubiquity FROM l GROUP BY 1),
d AS (SELECT changed, test, w * CASE WHEN coalesce(ubiquity, 0) > 0.7 THEN 0.3 ELSE 1 END AS w FROM s LEFT JOIN u USING (changed)),
f AS (SELECT changed, test, 1 - product(1 - least(w, 1)) AS score, count(*) AS n_signals FROM d GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY changed ORDER BY round(score, 12) DESC, test) AS rank FROM f WHERE round(score, 12) >= 0.4)
SELECT changed, test, round(score, 6) AS score, CASE WHEN score >= 0.8 THEN 'high' ELSE 'medium' END AS confidence, n_signals::INT AS n_signals, rank::INT AS rank FROM k WHERE rank <= 10"""


def registry(spark: SparkSession, sf_dir: str) -> Registry:
    return Registry(files(spark, sf_dir), load(), history=history(spark, sf_dir))



@query(FLAGSHIP)
def flagship_impact(spark, sf_dir):
    """All parts have changed: the ten orders that each matters to most."""
    changed = table(spark, sf_dir, "part").select(part_path("p_partkey").alias("path"))
    out = impact.analyse(registry(spark, sf_dir), changed)
    return out.select("changed", "test", F.round("score", 6).alias("score"), "confidence", "n_signals", "rank")
