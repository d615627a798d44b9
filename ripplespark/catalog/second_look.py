"""The second look over pairs that orders stand for, its stores, and events near each other in time."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplespark.config import Rerank, Scoring
from ripplespark.operators.intervals import counted_near, near_in_time
from ripplespark.operators.judge import JudgeError
from ripplespark.plans.rerank import rerank
from ripplespark.sources.files import shared_folder
from ripplespark.sources.history import Histories
from ripplespark.sources.stores import ContentCache, LockStore
from ripplespark.streaming.keyed import KeyedTable

from . import query, table


def folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid4().hex}"


def judged(prompt: str) -> str:
    """A judge that goes by an order's number: it refuses some, is unclear about others, and is more or less sure of the rest."""
    n = int(prompt.split("TEST o")[1].split("\n")[0])
    if n % 7 == 0:
        raise JudgeError("refused", 400)
    if n % 5 == 0:
        return "I can't say"
    return f'{{"relevant": {str(n % 2 == 0).lower()}, "confidence": {(n % 50) / 50}, "why": ["k{n % 50}"]}}'


_CFG = Rerank(band_max=0.9, max_candidates=3, concurrency=8)


@query("""WITH p AS (SELECT o_orderkey AS n, 'c' || o_custkey AS changed, 'o' || o_orderkey AS test, round(o_totalprice / 500000 + 1e-9, 6) AS score, o_orderpriority = '1-URGENT' AS own FROM orders WHERE o_orderkey % 11 <> 0),
q AS (SELECT * REPLACE (CASE WHEN n % 13 = 0 THEN least(1, score + 0.2) ELSE score END AS score) FROM p),
f AS (SELECT *, CASE WHEN score >= 0.9 THEN 'auto-kept' WHEN score < 0.4 THEN 'below-band' WHEN own THEN 'protected' ELSE 'judge' END AS fate FROM q),
c AS (SELECT * REPLACE (CASE WHEN fate = 'judge' AND row_number() OVER (PARTITION BY changed, fate ORDER BY score DESC, test) > 3 THEN 'over-cap' ELSE fate END AS fate) FROM f),
v AS (SELECT *, CASE WHEN fate <> 'judge' THEN 'unasked' WHEN n % 7 = 0 THEN 'refused' ELSE 'answered' END AS outcome, fate = 'judge' AND n % 7 <> 0 AND n % 5 <> 0 AS told, n % 2 = 0 AS relevant, (n % 50) / 50.0::DOUBLE AS sure FROM c),
k AS (SELECT changed, test, score AS prior, outcome,
  round(CASE WHEN score >= 0.9 OR NOT told THEN score ELSE least(1, 0.4 * score + 0.6 * ((CASE WHEN relevant THEN sure ELSE 1 - sure END) * 5) / 5) END, 12) AS score,
  CASE WHEN fate = 'judge' AND NOT told OR fate IN ('over-cap', 'below-band') THEN 'Not evaluated' WHEN fate = 'protected' THEN 'Direct match' WHEN fate = 'judge' AND NOT relevant THEN 'Low confidence' ELSE 'Strong match' END AS note,
  CASE WHEN told AND relevant THEN 'k' || (n % 50) END AS point
  FROM v WHERE NOT (told AND NOT relevant AND sure >= 0.9))
SELECT changed, test, prior, round(score, 6) AS score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.35 THEN 'medium' ELSE 'low' END AS confidence, note, point, outcome, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY changed ORDER BY score DESC, test) AS rank FROM k WHERE score >= 0.35) WHERE rank <= 5""")
def rerank_plan(spark, sf_dir):
    """Orders as tests of customers: earlier decisions, split, calls that may fail, verdicts, new scores, bands and ranks."""
    orders = table(spark, sf_dir, "orders")
    changed, test = F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    flags = F.array(F.struct(F.when(F.col("o_orderpriority") == "1-URGENT", "colocation").otherwise("redux-chain").alias("type")))
    pairs = orders.select(changed.alias("changed"), test.alias("test"), F.round(F.col("o_totalprice") / 500000 + 1e-9, 6).alias("score"), flags.alias("signals"))
    state = F.when(F.col("o_orderkey") % 11 == 0, "rejected").when(F.col("o_orderkey") % 13 == 0, "confirmed")
    store = LockStore(spark, folder(spark, "lock"))
    store.append(orders.select(changed.alias("changed"), test.alias("test"), state.alias("state"), F.lit("").alias("reason"), F.lit(None).alias("confirmed_at"), F.lit(0).alias("at")).where("state IS NOT NULL"))
    summaries = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("changed"), F.col("c_name").alias("summary"))
    excerpts = orders.select(test.alias("test"), F.col("o_orderstatus").alias("excerpt"))
    out = rerank(pairs, summaries, excerpts, judged, folder(spark, "second-look"), _CFG, Scoring(min_confidence=0.35, max_results=5), store=store, at=1)
    own = F.when(F.get("points", F.lit(0))["file"] == "", F.get("points", F.lit(0))["point"])
    return out.select("changed", "test", "prior", F.round("score", 6).alias("score"), "confidence", "note", own.alias("point"), "outcome", "rank")


@query("""SELECT 'u' || user_id AS changed, event_type AS test, arg_max(CASE WHEN event_id % 3 = 0 THEN 'rejected' ELSE 'confirmed' END, event_id) AS state, max(event_id) AS "at"
FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL""")
def lock_store(spark, sf_dir):
    """Users' events as decisions on pairs, added by two writers with a compaction between: the last of each pair."""
    events = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL")
    state = F.when(F.col("event_id") % 3 == 0, "rejected").otherwise("confirmed")
    rows = events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("changed"), F.col("event_type").alias("test"), state.alias("state"), F.lit("").alias("reason"), F.lit(None).alias("confirmed_at"), F.col("event_id").alias("at"))
    store = LockStore(spark, folder(spark, "lock"))
    store.append(rows.where("at % 2 = 1"))
    store.compact()
    store.append(rows.where("at % 2 = 0"))
    return store.read().select("changed", "test", "state", "at")


@query("SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN length(text)::DOUBLE END AS value, text IS NOT NULL AS known FROM conversations")
def cached_twice(spark, sf_dir):
    """Values of all texts from a stored cache that has seen them before: the second run computes none of them."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    cache = ContentCache(spark, folder(spark, "cache"))
    cache.values(rows, lambda new: new.select("digest", F.length("text").cast("double").alias("value")))
    again = cache.values(rows, lambda new: new.select("digest", F.lit(-1.0).alias("value")))  # so that what was computed anew would show
    return again.select("conv_id", "turn", "value", (F.col("value") >= 0).alias("known")).na.fill(False, ["known"])


_DAYS = "date_diff('day', TIMESTAMP '1990-01-01', o_orderdate)"


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long").alias("day"))


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey, {_DAYS} AS day FROM orders)
SELECT a.o_custkey, a.o_orderkey, b.o_orderkey AS other, b.day - a.day AS gap FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(a.day - b.day) <= 30""")
def orders_near_in_time(spark, sf_dir):
    """Pairs of a customer's orders that came about within a month of each other."""
    o = dated(spark, sf_dir)
    met = near_in_time(o, o, 30, "o_custkey", "day").where("o_orderkey < other_o_orderkey")
    return met.select("o_custkey", "o_orderkey", F.col("other_o_orderkey").alias("other"), (F.col("other_day") - F.col("day")).alias("gap"))


@query(f"""WITH o AS (SELECT o_orderkey, o_orderpriority, {_DAYS} AS day FROM orders)
SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority ORDER BY day RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING) - 1 AS near FROM o WHERE o_orderpriority IS NOT NULL AND day IS NOT NULL""")
def orders_of_a_week(spark, sf_dir):
    """How many other orders of its urgency lie within a week of each order."""
    o = dated(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    return counted_near(o, 7, "o_orderpriority", "day").where("near IS NOT NULL").select("o_orderkey", "near")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS path, round(o_totalprice + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, 2) AS price
FROM orders WHERE o_orderkey IS NOT NULL AND o_orderpriority IS DISTINCT FROM '1-URGENT'""")
def incremental_registry(spark, sf_dir):
    """Orders as files in a table that takes changes by batches: all, then changed ones, then those that go."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey IS NOT NULL")
    rows = orders.select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_totalprice").alias("price"), "o_orderstatus", "o_orderpriority")
    files = KeyedTable(spark, folder(spark, "files"), "path string, price double", buckets=16)
    files.put(rows, 0)
    files.put(rows.where("o_orderstatus = 'F'").withColumn("price", F.col("price") + 1), 1)
    files.compact(2)
    files.put(rows.limit(0), 2, rows.where("o_orderpriority = '1-URGENT'").select("path"))
    return files.read().select("path", F.round("price", 2).alias("price"))


@query("""WITH t AS (SELECT o_orderkey AS k, o_custkey AS c, coalesce(o_orderpriority = '1-URGENT', false) AS moved, max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS last FROM orders),
p AS (SELECT k, CASE WHEN moved OR k <= last THEN 'd' ELSE 'c' END || c || '.ts' AS path FROM t)
SELECT path, min(k)::BIGINT AS created_at, max(k)::BIGINT AS updated_at, count(*)::BIGINT AS n_commits, max(k)::BIGINT AS newest FROM p GROUP BY path""")
def incremental_log(spark, sf_dir):
    """Orders as commits of customers' files, some of which rename: the older half is read first, the newer merged in."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey", F.lit(".ts")).alias("c"), F.concat(F.lit("d"), "o_custkey", F.lit(".ts")).alias("d"), F.coalesce(F.col("o_orderpriority") == "1-URGENT", F.lit(False)).alias("moved"))
    most = orders.agg(F.max("o_orderkey")).first()[0] or 0
    line = F.when(F.col("moved"), F.concat(F.lit("R100\t"), "c", F.lit("\t"), "d")).otherwise(F.concat(F.lit("M\t"), "c"))
    found = orders.select(F.lit("r").alias("repo"), (most - F.col("o_orderkey")).cast("int").alias("pos"), F.concat(F.col("o_orderkey").cast("string"), F.lit("\n\n"), line).alias("record"))
    store = Histories(spark, folder(spark, "histories"))
    store.add(found.where(F.col("pos") >= most // 2), 0)
    store.add(found.where(F.col("pos") < most // 2), 1, {"r": most})
    return store.read().select("path", "created_at", "updated_at", F.size("commits").cast("long").alias("n_commits"), F.get("commits", F.lit(0))["ts"].alias("newest"))
