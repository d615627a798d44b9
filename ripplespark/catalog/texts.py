"""Words, titles and code in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplespark.functions import text as T
from ripplespark.operators import extract as E
from ripplespark.operators import scorers as S
from ripplespark.streaming import upsert

from . import impact, query, table

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(T.TITLE_STOPWORDS))
_WORDS = r"regexp_extract_all(lower(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[a-z0-9]+')"


@query(f"""WITH t AS (SELECT DISTINCT doc_id, unnest({_WORDS.format(c="text")}) AS token FROM documents),
d AS (SELECT token, count(*) AS df FROM t WHERE length(token) >= 3 AND token NOT IN ({_STOP}) GROUP BY 1)
SELECT token, round(greatest(0.1, 1 - ln(df) / ln((SELECT count(*) FROM documents) + 1)), 6) AS idf FROM d""")
def token_idf_documents(spark, sf_dir):
    """How rare words are, with documents as titles of tests."""
    from ripplespark.operators import index as I

    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    cypress = F.struct(null("array<string>", "visited_routes"), null("array<struct<type:string,value:string,raw:string>>", "selectors"), null("array<string>", "contains_text"), null("array<struct<method:string,url_pattern:string>>", "intercepts"),
                       null("array<struct<operator:string,expected:string>>", "url_assertions"), null("array<string>", "custom_commands"), F.array("text").alias("describes"), null("array<string>", "its"))
    files = impact.shaped(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("test").alias("type"), cypress.alias("cypress")), spark)
    return I.title_idf(files).withColumn("idf", F.round("idf", 6))


@query(f"""WITH b AS (SELECT DISTINCT unnest({_WORDS.format(c="text")}) AS token FROM benchmark), c AS (SELECT DISTINCT unnest({_WORDS.format(c="text")}) AS other FROM conversations)
SELECT token, other FROM b, c WHERE length(token) >= 5 AND length(other) >= 5 AND token <> other AND (contains(token, other) OR contains(other, token))""")
def contained_words(spark, sf_dir):
    """Words of benchmark items and of conversations of which one lies in the other."""
    vocabulary = lambda name: table(spark, sf_dir, name).select(F.explode(T.words("text")).alias("token")).distinct()
    return S.contained(vocabulary("benchmark"), vocabulary("conversations"), 5, False)


@query("""SELECT 'o' || l_orderkey AS path, count(DISTINCT l_partkey) AS imports, min(l_partkey) AS least FROM lineitem GROUP BY 1""")
def extracted_imports(spark, sf_dir):
    """Imports read from code with an import for each part of an order."""
    line = F.concat(F.lit("import { P } from './p"), "l_partkey", F.lit("'; // import x from 'y'"))
    code = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("o"), "l_orderkey").alias("path")).agg(F.array_join(F.collect_list(line), "\n").alias("content"))
    found = code.select("path", E.imports(E.code("content")).alias("i"))
    return found.select("path", F.size("i").cast("long").alias("imports"), F.array_min(F.transform("i", lambda s: F.substr(s, F.lit(4)).cast("long"))).alias("least"))


@query(r"""SELECT page_id, regexp_extract_all(html, '<div class="([^"]*)"', 1)[1] AS block, len(regexp_extract_all(html, '<a href="(/[^"]*)"', 1))::INT AS links FROM pages""")
def html_attributes(spark, sf_dir):
    """Attributes read from pages by the extractor's expressions."""
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.get(E.every(html, '<div class="([^"]*)"'), F.lit(0)).alias("block"), F.size(E.every(html, '<a href="(/[^"]*)"')).alias("links"))


@query("""SELECT epoch(time_bucket(INTERVAL '14 days', ts, TIMESTAMP '1970-01-01'))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def window_counts(spark, sf_dir):
    """Events by type in windows of fourteen days since 1970."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return upsert.window_counts(events, "ts", "event_type").select(F.unix_timestamp("window.start").alias("start"), "event_type", "n")


@query("""SELECT * FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT * REPLACE (-o_totalprice AS o_totalprice) FROM orders WHERE o_orderstatus = 'F'""")
def incremental_upsert(spark, sf_dir):
    """The table of orders after all finished ones came in again with another price."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "path")
    changed = orders.where("o_orderstatus = 'F'").withColumn("o_totalprice", -F.col("o_totalprice"))
    return upsert.upserted(orders, changed).withColumnRenamed("path", "o_orderkey")
