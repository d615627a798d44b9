"""Queries over code that nests, written from the tables' rows: texts, comments, bodies of tests, constants in JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplespark.operators import lexer as L
from ripplespark.operators import rerank as RR
from ripplespark.plans import registry as build_plan

from . import query, spread, table
from .code import _text

_NESTED = """// part <<key>>, from 'old<<key>>
const glob = 'src/**/*.ts'; /* `not a template <p>gone</p> */
const url = `http://x/${on ? `a/${more /* deep */}` : '//b'}`; // <p>gone</p>
const odd = /[/*'"`]/.test(name) && <<size>> / 2 / 3;
if (a < b && c > d) { e = <T extends X>(f: T) => f; }
const view = <Card title={`T ${n}`} on={() => <i>in <<size>></i>}>Part <<key>> of {n > 1 ? <b>many</b> : 'one'}, size
   <<size>><br/>don't // stop</Card>;
"""
_PLAIN = """
const glob = 'src/**/*.ts';
const url = `http://x/${on ? `a/${more }` : '//b'}`;
const odd = /[/*'"`]/.test(name) && <<size>> / 2 / 3;
if (a < b && c > d) { e = <T extends X>(f: T) => f; }
const view = <Card title={`T ${n}`} on={() => <i>in <<size>></i>}>Part <<key>> of {n > 1 ? <b>many</b> : 'one'}, size
   <<size>><br/>don't // stop</Card>;
"""
_P = "'src/parts/P' || p_partkey || '.tsx'"


def _sql(text: str) -> str:
    return "replace(replace('" + text.replace("'", "''") + "', '<<key>>', p_partkey::VARCHAR), '<<size>>', p_size::VARCHAR)"


def nested_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' code with templates in templates, tags in props, and comments that are none."""
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    return parts.select(F.concat(F.lit("src/parts/P"), "p_partkey", F.lit(".tsx")).alias("path"), _text(_NESTED, key="p_partkey", size="p_size").alias("content"))


@query(f"SELECT {_P} AS path, unnest(['in ' || p_size, 'Part ' || p_partkey || ' of', 'many', ', size ' || p_size, 'don''t // stop']) AS value FROM part")
def lexed_texts(spark, sf_dir):
    """Texts between the tags of parts' code, at any depth."""
    return nested_code(spark, sf_dir).select("path", F.explode(L.read("content", "path")["jsx_text"]).alias("value"))


@query(f"SELECT {_P} AS path, md5(regexp_replace({_sql(_PLAIN)}, '\\s+', ' ', 'g')) AS code FROM part")
def lexed_code(spark, sf_dir):
    """Parts' code without comments; runs of blanks as one, by digest."""
    return nested_code(spark, sf_dir).select("path", F.md5(F.regexp_replace(L.read("content", "path")["code"], r"[ \n]+", " ")).alias("code"))


_TEST = """describe('Order <<key>>', () => {
  it(`takes ${f({ a: (1) })} (`, async ({ page }, x = (1, (2))) => { /* } */ // {
  });
  test('pays }', function () {<<body>>});
});
"""


@query("""SELECT 'e2e/o' || o_orderkey || '.cy.ts' AS path, CASE o_orderkey % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS empty FROM orders""")
def stub_tests(spark, sf_dir):
    """Orders' tests, and whether all their bodies are empty: every fourth visits, every fourth holds a comment, a block of blanks or a string."""
    orders = table(spark, sf_dir, "orders")
    kind = F.col("o_orderkey") % 4
    body = F.when(kind == 0, " cy.visit('/') ").when(kind == 1, " /* later { */ ").when(kind == 2, "\n  ").otherwise("{ '' }")
    tests = orders.select(F.concat(F.lit("e2e/o"), "o_orderkey", F.lit(".cy.ts")).alias("path"), F.col("o_orderkey"), body.alias("body")).withColumn("content", _text(_TEST, key="o_orderkey", body="body"))
    return tests.select("path", RR.bodies_empty(F.col("content")).alias("empty"))


@query("""SELECT 'e2e/o' || o_orderkey || '.cy.ts' AS path, CASE WHEN o_orderkey % 2 = 0 THEN '.json-' ELSE '.code-' END || o_custkey AS value FROM orders""")
def selectors_behind_json(spark, sf_dir):
    """Selectors that orders' tests take from constants of customers: in JSON files for even orders, in code for odd ones."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    even = F.col("o_orderkey") % 2 == 0
    key = lambda end: F.concat(F.lit("'../ids/c"), F.col("o_custkey"), F.lit(end))
    spec = F.when(even, F.concat(F.lit("import ids from "), key(".json'"))).otherwise(F.concat(F.lit("import { ids } from "), key("'")))
    tests = orders.select(F.concat(F.lit("e2e/o"), "o_orderkey", F.lit(".cy.ts")).alias("path"), F.concat(spec, F.lit(";\nit('a', () => { cy.get(ids.row); cy.get(ids.count) });\n")).alias("content"), F.lit("test").alias("type"))
    code = customers.select(F.concat(F.lit("ids/c"), "c_custkey", F.lit(".ts")).alias("path"), F.concat(F.lit("export const ids = { row: '.code-"), "c_custkey", F.lit("' };")).alias("content"), F.lit("source").alias("type"))
    data = customers.select(F.concat(F.lit("ids/c"), "c_custkey", F.lit(".json")).alias("path"), F.concat(F.lit('{"row": ".json-'), "c_custkey", F.lit('", "count": 7, "more": {"row": "no"}}')).alias("content"))
    files, aliases = tests.unionByName(code), spark.createDataFrame([], "prefix string, target string")
    resolved = build_plan.resolved_specs(tests, aliases, [], files).unionByName(build_plan.resolved_specs(tests, aliases, [], data))
    return build_plan.identifiers_in_tests(files, resolved, data)
