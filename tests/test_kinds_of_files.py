"""Files with the same selectors are matched once; who is in a cone goes by the steps asked for."""

from __future__ import annotations

import duckdb

import __spark_entry__
from ripplespark import catalog
from ripplespark.operators import scorers as S

from .helpers import entry, paths, registry, rows


def selector(*values: str) -> dict:
    return {"selectors": [{"type": "data-testid", "value": v, "raw": v} for v in values]}


def held(*values: str) -> list:
    return [{"attr": "data-testid", "value": v} for v in values]


def test_pairs_of_copies_are_written_out_last(spark):
    plan = catalog.QUERIES["selector_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("Exchange") and plan.index("Join") < plan.index("HashAggregate")


def test_copies_and_others_get_what_each_gets_alone(spark):
    sources = [entry(f"src/a{k}.ts", selectors=held("save", "send")) for k in range(3)] + [entry("src/b.ts", selectors=held("send")), entry("src/c.ts", selectors=held("sender-box"))]
    tests = [entry(f"e2e/t{k}.cy.ts", cypress=selector(*v)) for k, v in enumerate([("save", "send"), ("send", "save"), ("send",), ("send", "send"), ("none",)])]
    others = [entry(f"e2e/o{k}.cy.ts") for k in range(95)]
    changed = [s["path"] for s in sources]
    whole = rows(S.selector_match(registry(spark, *sources, *tests, *others), paths(spark, *changed)))
    assert len(whole) == 20  # every source, the prefix included, with every test but the last
    for source in (sources[0], sources[3], sources[4]):
        for k, test in enumerate(tests[:4]):
            alone = rows(S.selector_match(registry(spark, source, *tests, *others), paths(spark, source["path"])))
            assert alone[source["path"], test["path"]] == whole[source["path"], test["path"]]
    assert whole["src/a0.ts", "e2e/t0.cy.ts"]["weight"] == whole["src/a2.ts", "e2e/t1.cy.ts"]["weight"] > whole["src/a1.ts", "e2e/t2.cy.ts"]["weight"]


def test_usage_sites_weights_are_those_of_its_sql_where_orders_are_many(spark):
    folder = "/root/testdata/sf0.1"
    found = {tuple(r) for r in catalog.QUERIES["usage_site"](spark, folder).select("changed", "weight").distinct().collect()}
    con = duckdb.connect()
    for t in ("customer", "orders", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert found == set(con.execute(f"SELECT DISTINCT changed, weight FROM ({__spark_entry__.oracle_sql()['usage_site']})").fetchall())
