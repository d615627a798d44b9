"""Bands, verdicts, locks and similarity on pairs that tables stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplespark.config import Rerank
from ripplespark.operators import rerank as R
from ripplespark.operators.vectors import top_k_in_blocks

from . import query, table

_K = "json_extract_string(props, '$.k')::INT"


def k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


@query("""WITH q AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id AS query, b.vec_id AS hit, 0.7 * CASE WHEN a.label = b.label THEN 1 ELSE 0 END + 0.3 * list_cosine_similarity(a.e, b.e) AS mixed FROM q a, q b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query, hit, round(mixed, 6) AS mixed, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY mixed DESC, hit) AS rank FROM s) WHERE rank <= 30 AND mixed >= 0.3""")
def cosine_topk(spark, sf_dir):
    """For every hundredth vector the thirty best of all others, by label and direction."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    best = top_k_in_blocks(v.where("id % 100 = 0"), v)  # a stated set of queries, against all rows, in blocks
    return best.select("query", "hit", F.round("mixed", 6).alias("mixed"), "rank")


@query("""WITH q AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id AS query, b.vec_id AS hit, 0.7 * CASE WHEN a.label = b.label THEN 1 ELSE 0 END + 0.3 * list_cosine_similarity(a.e, b.e) AS mixed FROM q a JOIN q b ON b.vec_id > a.vec_id AND b.vec_id <= a.vec_id + 40)
SELECT query, hit, round(mixed, 6) AS mixed, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY mixed DESC, hit) AS rank, count(*) OVER (PARTITION BY query) AS n FROM s) WHERE n <= 30 OR rank <= 30 AND mixed >= 0.3""")
def similar_candidates(spark, sf_dir):
    """Of the forty vectors after each one, given as its candidates, the thirty best."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("path"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    after = v.select(F.col("path").alias("changed"), F.col("label").alias("mine"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.col("path") + k)).alias("path"))
    pairs = after.join(v.select("path", "label"), "path").select("changed", F.col("path").alias("test"), (F.col("mine") == F.col("label")).cast("double").alias("prior"))
    return R.similar_top_k(pairs, v).select(F.col("changed").alias("query"), F.col("test").alias("hit"), F.round("mixed", 6).alias("mixed"), "rank")


_REPLIES = f"""r AS (SELECT event_id, {_K} AS k, CASE WHEN {_K} % 7 = 0 THEN 'sorry, none' WHEN {_K} % 5 = 0 THEN '{{"relevant": "yes"}}'
  ELSE 'so: {{"relevant": ' || CASE WHEN {_K} % 2 = 0 THEN 'true' ELSE 'false' END || ', "confidence": ' || {_K} / 50.0 || ', "why": ["k' || {_K} || '"]}} done' END AS reply FROM events)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = k()
    said = F.concat(F.lit('so: {"relevant": '), F.when(n % 2 == 0, "true").otherwise("false"), F.lit(', "confidence": '), (n / 50.0).cast("string"), F.lit(', "why": ["k'), n.cast("string"), F.lit('"]} done'))
    return table(spark, sf_dir, "events").select("event_id", n.alias("k"), F.when(n % 7 == 0, "sorry, none").when(n % 5 == 0, '{"relevant": "yes"}').otherwise(said).alias("reply"))


@query(f"""WITH {_REPLIES} SELECT event_id, CASE WHEN k % 7 <> 0 AND k % 5 <> 0 THEN k % 2 = 0 END AS relevant, round(CASE WHEN k % 7 <> 0 AND k % 5 <> 0 THEN least(1, k / 50.0) END, 6) AS confidence,
CASE WHEN k % 7 <> 0 AND k % 5 <> 0 THEN 'k' || k END AS point FROM r""")
def verdict_parse(spark, sf_dir):
    """Verdicts in replies, some of which hold none."""
    v = R.verdict(replies(spark, sf_dir))
    return v.select("event_id", "verdict.relevant", F.round("verdict.confidence", 6).alias("confidence"), F.get("verdict.why", F.lit(0))["point"].alias("point"))


@query(f"WITH {_REPLIES} SELECT k % 7 = 0 OR k % 5 = 0 AS failed, NOT (k % 7 <> 0 AND k % 5 <> 0 AND k % 2 = 1 AND k / 50.0 >= 0.9) AS kept, count(*) AS pairs FROM r GROUP BY 1, 2")
def drop_rule(spark, sf_dir):
    """Pairs that verdicts keep and drop, and such whose verdict failed."""
    out = R.decided(R.verdict(replies(spark, sf_dir)).withColumn("fate", F.lit("judge")))
    return out.groupBy("failed", "kept").agg(F.count("*").alias("pairs"))


@query("SELECT o_orderkey, round(least(1, 0.4 * (o_totalprice / 600000) + 0.6 * (o_orderkey % 6) / 5) + 1e-9, 6) AS score FROM orders")
def late_fusion(spark, sf_dir):
    """Scores with a verdict from 0 to 5."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(R.late_score(F.col("o_totalprice") / 600000, F.col("o_orderkey") % 6) + 1e-9, 6).alias("score"))


@query("""SELECT o_orderkey, round(least(1, CASE WHEN o_orderkey % 7 = 6 THEN o_totalprice / 600000 + 0.15 ELSE o_totalprice / 600000 * [0, 0.5, 0.85, 1.0, 1.15, 1.3][(o_orderkey % 7) + 1] END) + 1e-9, 6) AS score FROM orders""")
def bucket_fusion(spark, sf_dir):
    """Scores with a verdict's factor, or without a verdict."""
    bucket = F.when(F.col("o_orderkey") % 7 != 6, F.col("o_orderkey") % 7)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(R.bucket_score(F.col("o_totalprice") / 600000, bucket) + 1e-9, 6).alias("score"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.array(F.struct(F.when(F.col("o_orderpriority") == "1-URGENT", "colocation").otherwise("redux-chain").alias("type")))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("changed"), F.col("o_orderkey").alias("test"), F.round(F.col("o_totalprice") / 500000 + 1e-9, 6).alias("score"), flags.alias("signals"))


@query("""WITH p AS (SELECT o_custkey AS changed, o_orderkey AS test, round(o_totalprice / 500000 + 1e-9, 6) AS score, o_orderpriority = '1-URGENT' AS own FROM orders),
f AS (SELECT *, CASE WHEN score >= 0.9 THEN 'auto-kept' WHEN score < 0.4 THEN 'below-band' WHEN own THEN 'protected' ELSE 'judge' END AS fate FROM p)
SELECT changed, test, CASE WHEN fate = 'judge' AND row_number() OVER (PARTITION BY changed, fate ORDER BY score DESC, test) > 3 THEN 'over-cap' ELSE fate END AS fate FROM f""")
def band_split(spark, sf_dir):
    """Which pairs a judge would see."""
    return R.banded(pairs(spark, sf_dir), Rerank(band_max=0.9, max_candidates=3)).select("changed", "test", "fate")


@query("""WITH w AS (SELECT o_custkey AS changed, o_orderkey AS test, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice / 500000 + 1e-9, 6) DESC, o_orderkey) - 1 AS n FROM orders)
SELECT changed, test, (n // 4)::BIGINT AS call, (n % 4 + 1)::INT AS i FROM w""")
def listwise_windows(spark, sf_dir):
    """Candidates in calls of four."""
    return R.windows(pairs(spark, sf_dir), 4).select("changed", "test", "call", F.col("i").cast("int").alias("i"))


@query("""SELECT d.doc_id, CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS score, CASE WHEN quality = 1 THEN 'confirmed' ELSE 'unknown' END AS state
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS DISTINCT FROM 0""")
def lock_partition(spark, sf_dir):
    """Documents by earlier decisions on them: good ones gain, bad ones go."""
    docs = table(spark, sf_dir, "documents").select(F.lit("c").alias("changed"), "doc_id", F.col("doc_id").alias("test"), F.lit(0.9).alias("score"))
    lock = table(spark, sf_dir, "labels").select(F.lit("c").alias("changed"), F.col("doc_id").alias("test"), F.when(F.col("quality") == 1, "confirmed").otherwise("rejected").alias("state"))
    return R.partition_by_lock(docs, lock).select("doc_id", F.round("score", 6).alias("score"), "state")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def triage_drop(spark, sf_dir):
    """Documents without those whose label says that nothing is to be done."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("changed"), "source")
    triage = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("changed"), (F.col("toxic") == 1).alias("cosmetic"), F.lit(1.0).alias("confidence"))
    return R.untriaged(docs, triage).withColumnRenamed("changed", "doc_id")


@query(f"""WITH e AS (SELECT event_id, {_K} AS k FROM events)
SELECT event_id, CASE WHEN k % 3 = 0 THEN true ELSE k % 6 > 0 END AS relevant, (CASE WHEN k % 3 = 0 THEN 3 ELSE least(5, k % 6) END)::INT AS confidence FROM e""")
def bucket_replies(spark, sf_dir):
    """Verdicts from 0 to 5 in replies, some of which can't be read."""
    n = k()
    reply = F.when(n % 3 == 0, "???").otherwise(F.concat(F.lit('```json\n{"score": "'), (n % 6).cast("string"), F.lit('", "reason": "x"}\n```')))
    return R.parsed_replies(table(spark, sf_dir, "events").select("event_id", reply.alias("reply")), "bucket").select("event_id", "relevant", "confidence")


@query("SELECT conv_id, turn, length(coalesce(text, ''))::DOUBLE AS value FROM conversations")
def content_cache(spark, sf_dir):
    """Values of texts by their digest, computed once for each text that a cache lacks."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    value = F.length("text").cast("double").alias("value")
    cache = rows.where("turn = 0").select(F.sha1(F.col("text").cast("binary")).alias("digest"), value).distinct()
    return R.cached(rows, cache, lambda new: new.select("digest", value))[0].select("conv_id", "turn", "value")
