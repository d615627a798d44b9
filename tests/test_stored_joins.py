"""Stored tables aren't sent through the driver, however small a few of their columns look, and code is made plain once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplespark import catalog
from ripplespark.catalog import impact
from ripplespark.operators import extract as E
from ripplespark.plans import registry as build_plan
from ripplespark.sources import files as sources


def test_joins_of_stored_tables_sort_and_merge(spark):
    stored = sources.saved(spark.range(100).selectExpr("cast(id AS STRING) AS path", "array(id) AS more"), "wide")
    plan = spark.range(10).selectExpr("cast(id AS STRING) AS path").join(stored.where("size(more) > 0").select("path"), "path", "left_semi")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Broadcast" not in text and plan.count() == 10


def test_comments_are_taken_out_once_for_each_file(spark):
    files = spark.createDataFrame([("a.ts", "import a from './b'; // import c from './d'"), ("b.ts", None)], "path string, content string")
    specs = build_plan.resolved_specs(files, spark.createDataFrame([], "prefix string, target string"), [])
    assert [tuple(r) for r in specs.collect()] == [("a.ts", "./b", "b.ts")]
    kinds = files.select(F.explode_outer(E.of_code("content", E.import_kinds)).alias("k"))
    assert kinds._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(content") == 1


def test_routes_of_all_files_are_not_sent_through_the_driver(spark):
    plan = catalog.QUERIES["extracted_routes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_selectors_are_matched_on_stored_files(spark):
    plan = catalog.QUERIES["selector_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "cypress" in plan and "l_partkey" not in plan


def test_line_items_are_shuffled_as_keys(spark):
    lines = impact.files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    shuffled = [line for line in lines if "Exchange hashpartitioning" in line]
    assert len(shuffled) == 1 and "REPARTITION_BY_COL" in shuffled[0]
