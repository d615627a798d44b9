"""Facts and evidence from code texts that are written from the tables.

Parts are components, customers' nations are shared state, orders are tests.  Each file's
text is made from its row by one expression; the operators read it as they read any code,
and the SQL says from the row what the code states.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplespark.operators import extract as E
from ripplespark.operators import index as I
from ripplespark.operators import resolve as R
from ripplespark.operators import routes as RT
from ripplespark.operators import scorers as S
from ripplespark.plans import registry as build_plan
from ripplespark.sources import files as sources

from . import impact, query, spread, table


def _text(template: str, **columns: str) -> Column:
    """The template with columns in place of <<name>>."""
    out = F.lit(template)
    for name, column in columns.items():
        out = F.replace(out, F.lit(f"<<{name}>>"), F.col(column).cast("string"))
    return out


_PART = """// part <<key>>, formerly import old from './old<<key>>'
import React, { useState as use, memo } from 'react';
import * as shared from "../shared/s<<size>>";
import { BRAND_KIND } from './types';
export { Part<<key>>, helper as help<<key>> } from './impl';
const old = require('./old');
const Later = lazy(() => import('./later/L<<size>>'));
export const PART_<<key>> = 'parts/PART_<<key>>';
class Part<<key>> {}
interface Shape<<key>> {}
function* watch<<key>>() { yield put({ type: 'PART_<<key>>_SEEN' }); }
const rows = useSelector(selectPart<<size>>); dispatch(loadPart<<size>>());
const view = <div data-testid="part-<<key>>" id='p<<key>>'><span>Part number <<key>></span>{t('part.<<size>>.title')}</div>;
const table = [{ path: '/parts/<<key>>', element: <Part<<key>> />, children: [{ path: 'edit/:id', element: <Edit<<size>> /> }] }];
const more = <Routes><Route path="/p<<key>>" element={<Guard><Page<<key>> /></Guard>} /></Routes>;
"""
_ORDER = """describe('Order <<key>> flow', () => {
  it(`ships for customer <<cust>>`, () => {
    cy.visit('/orders/<<key>>?tab=1'); cy.loginAs('/home<<cust>>');
    cy.get('[data-testid="order-<<key>>"]').click(); cy.find("#c<<cust>>"); cy.getByTestId('by-<<key>>'); cy.get('@alias'); cy.get(ids.k<<key>>);
    cy.contains('Order <<key>>'); cy.contains(/Total (<<cust>>|x)/);
    cy.intercept('POST', '/api/orders/<<key>>'); cy.intercept('/api/customers/*');
    cy.url().should('include', '/done/<<key>>');
  });
});
"""


def part_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    return parts.select(F.lit("r").alias("repo_root"), F.concat(F.lit("src/parts/P"), "p_partkey", F.lit(".tsx")).alias("path"), _text(_PART, key="p_partkey", size="p_size").alias("content"), F.lit("source").alias("type"))


def order_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    return orders.select(F.lit("r").alias("repo_root"), F.concat(F.lit("e2e/o"), "o_orderkey", F.lit(".cy.ts")).alias("path"), _text(_ORDER, key="o_orderkey", cust="o_custkey").alias("content"), F.lit("test").alias("type"))


def _listed(df: DataFrame, column: str) -> DataFrame:
    return _each(E.extract(df), F.col(column))


def _each(facts: DataFrame, found: Column) -> DataFrame:
    """(path, value) of facts that are never null; as an outer explode, which isn't led by a filter that finds them all once more."""
    return facts.select("path", F.explode_outer(found).alias("value")).where("value IS NOT NULL")


_P = "'src/parts/P' || p_partkey || '.tsx'"
_O = "'e2e/o' || o_orderkey || '.cy.ts'"


def _values(path: str, source: str, *values: str) -> str:
    return " UNION ALL ".join(f"SELECT {path} AS path, {v} AS value FROM {source}" for v in values)


# sources -------------------------------------------------------------------------------


@query(_values(_P, "part", "'react'", "'../shared/s' || p_size", "'./types'", "'./impl'", "'./old'", "'./later/L' || p_size"))
def extracted_modules(spark, sf_dir):
    """Modules that parts' code imports, re-exports, requires or loads."""
    return _listed(part_code(spark, sf_dir), "imports")


@query(_values(_P, "part", "'Part' || p_partkey", "'help' || p_partkey"))
def extracted_exports(spark, sf_dir):
    """Names in parts' export clauses."""
    return _listed(part_code(spark, sf_dir), "exports")


@query(f"SELECT {_P} AS path, 'Part' || p_partkey AS classes, 'watch' || p_partkey AS functions, 'Shape' || p_partkey AS interfaces FROM part")
def extracted_declarations(spark, sf_dir):
    """Classes, functions and interfaces of parts' code."""
    one = lambda c: F.array_join(c, ",").alias(c)
    return E.extract(part_code(spark, sf_dir)).select("path", one("classes"), one("functions"), one("interfaces"))


@query(f"SELECT {_P} AS path, 'data-testid' AS attr, 'part-' || p_partkey AS value FROM part UNION ALL SELECT {_P}, 'id', 'p' || p_partkey FROM part")
def extracted_selectors(spark, sf_dir):
    """Attributes that tests can find elements of parts by."""
    return I.selectors(E.extract(part_code(spark, sf_dir))).select("path", "attr", "value")


@query(_values(_P, "part", "'Part number ' || p_partkey"))
def extracted_jsx_text(spark, sf_dir):
    """Texts that parts show."""
    return _listed(part_code(spark, sf_dir), "jsx_text")


@query("SELECT 'part number ' || p_partkey AS text, 'src/parts/P' || p_partkey || '.tsx' AS path FROM part")
def text_index(spark, sf_dir):
    """Shown texts as they are looked up."""
    return I.texts(E.extract(part_code(spark, sf_dir)))


@query(_values(_P, "part", "'part.' || p_size || '.title'"))
def extracted_translation_keys(spark, sf_dir):
    """Keys of translations in parts' code."""
    return _listed(part_code(spark, sf_dir), "translation_keys")


@query(f"SELECT {_P} AS path, 'selectPart' || p_size AS selectors_used, 'loadPart' || p_size AS actions_dispatched FROM part")
def extracted_redux_usage(spark, sf_dir):
    """Selectors used and actions dispatched by parts."""
    return E.extract(part_code(spark, sf_dir)).select("path", F.array_join("redux.selectors_used", ",").alias("selectors_used"), F.array_join("redux.actions_dispatched", ",").alias("actions_dispatched"))


@query(_values(_P, "part", "'parts/PART_' || p_partkey", "'PART_' || p_partkey || '_SEEN'"))
def extracted_action_types(spark, sf_dir):
    """Literals of parts' code that have the form of action types."""
    return _listed(part_code(spark, sf_dir), "action_types")


@query(f"SELECT {_P} AS path, 'PART_' || p_partkey AS name, 'parts/PART_' || p_partkey AS value FROM part")
def extracted_action_constants(spark, sf_dir):
    """Exported constants that are action types."""
    return E.extract(part_code(spark, sf_dir)).select("path", F.explode_outer("action_type_consts").alias("name", "value")).where("name IS NOT NULL")  # outer, as in _each


@query(f"SELECT {_P} AS path, '/p' || p_partkey AS pattern, 'Page' || p_partkey AS component FROM part")
def extracted_route_tags(spark, sf_dir):
    """Route tags with the component inside its guard."""
    tags = part_code(spark, sf_dir).select("path", F.explode(RT.tag_routes(E.code("content"))).alias("r"))
    return tags.select("path", F.replace(F.col("r.chain")[0], F.lit('"'), F.lit("")).alias("pattern"), F.col("r.component").alias("component"))


@query(f"""SELECT {_P} AS path, '/p' || p_partkey AS pattern, 'Page' || p_partkey AS component, false AS is_dynamic FROM part
UNION ALL SELECT {_P}, '/parts/' || p_partkey, 'Part' || p_partkey, false FROM part UNION ALL SELECT {_P}, '/parts/' || p_partkey || '/edit/:id', 'Edit' || p_size, true FROM part""")
def extracted_routes(spark, sf_dir):
    """All routes of parts' code, with paths of nested ones stitched."""
    files = part_code(spark, sf_dir)
    nothing = spark.createDataFrame([], "path string, spec string, target string")
    exports = spark.createDataFrame([], "file string, exported string, local string, source string")
    return RT.located(files, nothing, exports).select("path", "pattern", "component", "is_dynamic")


@query(f"""SELECT {_P} AS path, unnest(['named', 'namespace', 'named', 'require', 'dynamic', 're-export']) AS kind, unnest(['react', '../shared/s' || p_size, './types', './old', './later/L' || p_size, './impl']) AS module FROM part""")
def extracted_import_kinds(spark, sf_dir):
    """How parts import what."""
    return part_code(spark, sf_dir).select("path", F.explode(E.of_code("content", E.import_kinds)).alias("k")).select("path", "k.kind", "k.module")


@query(f"""SELECT {_P} AS path, unnest(['React', 'use', 'memo', 'shared', 'BRAND_KIND']) AS name, unnest(['default', 'useState', 'memo', '*', 'BRAND_KIND']) AS imported, unnest(['react', 'react', 'react', '../shared/s' || p_size, './types']) AS spec FROM part""")
def import_bindings(spark, sf_dir):
    """Local names of what parts import."""
    return RT.bindings(part_code(spark, sf_dir))


# tests ---------------------------------------------------------------------------------


def _cypress(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    return _listed(order_code(spark, sf_dir), f"cypress.{field}")


@query(_values(_O, "orders", "'Order ' || o_orderkey || ' flow'", "'ships for customer ' || o_custkey"))
def extracted_titles(spark, sf_dir):
    """Titles of orders' tests."""
    c = F.col("c")
    return _each(E.as_read(order_code(spark, sf_dir)), F.concat(E.titles(c, "describe", "context"), E.titles(c, "it")))


@query(_values(_O, "orders", "'/orders/' || o_orderkey || '?tab=1'", "'/home' || o_custkey"))
def extracted_visits(spark, sf_dir):
    """What orders' tests visit."""
    return _cypress(spark, sf_dir, "visited_routes")


@query(f"""SELECT {_O} AS path, unnest(['data-testid', 'id', 'data-testid']) AS type, unnest(['order-' || o_orderkey, 'c' || o_custkey, 'by-' || o_orderkey]) AS value FROM orders""")
def extracted_test_selectors(spark, sf_dir):
    """Selectors of orders' tests, of plain and of own commands."""
    return _cypress(spark, sf_dir, "selectors").select("path", "value.type", "value.value")


@query(_values(_O, "orders", "'loginAs'", "'getByTestId'"))
def extracted_commands(spark, sf_dir):
    """Own commands of orders' tests."""
    return _cypress(spark, sf_dir, "custom_commands")


@query(_values(_O, "orders", "'Order ' || o_orderkey", "'Total (' || o_custkey || '|x)'"))
def extracted_contains(spark, sf_dir):
    """Texts and patterns that orders' tests look for."""
    return _cypress(spark, sf_dir, "contains_text")


@query(f"SELECT {_O} AS path, unnest(['POST', 'GET']) AS method, unnest(['/api/orders/' || o_orderkey, '/api/customers/*']) AS url_pattern FROM orders")
def extracted_intercepts(spark, sf_dir):
    """Calls that orders' tests intercept."""
    return _cypress(spark, sf_dir, "intercepts").select("path", "value.method", "value.url_pattern")


@query(f"SELECT {_O} AS path, 'include' AS operator, '/done/' || o_orderkey AS expected FROM orders")
def extracted_url_assertions(spark, sf_dir):
    """Where orders' tests must end up."""
    return _cypress(spark, sf_dir, "url_assertions").select("path", "value.operator", "value.expected")


@query(f"SELECT {_O} AS path, '.row-' || o_custkey AS value FROM orders")
def selectors_behind_constants(spark, sf_dir):
    """Selectors that orders' tests take from objects of constants, one object for each order."""
    orders = table(spark, sf_dir, "orders")
    ids = orders.select(F.concat(F.lit("e2e/ids"), "o_orderkey", F.lit(".ts")).alias("path"), F.concat(F.lit("export const ids = { other: 'x', k"), "o_orderkey", F.lit(": '.row-"), "o_custkey", F.lit("' };")).alias("content"))
    idents = orders.select(F.concat(F.lit("e2e/o"), "o_orderkey", F.lit(".cy.ts")).alias("path"), F.lit("ids").alias("name"), F.concat(F.lit("e2e/ids"), "o_orderkey", F.lit(".ts")).alias("target"))
    return E.with_constants(order_code(spark, sf_dir), R.constants(ids).withColumnRenamed("path", "target"), idents)


# state, barrels, whole registries --------------------------------------------------------


@query("""SELECT 'src/store/n' || n_nationkey || '/state.ts' AS path, 'nation' || n_nationkey AS slice, unnest(['slice', 'saga', 'selectors']) AS role FROM nation
UNION ALL SELECT 'src/store/n' || n_nationkey || '/types.ts', 'n' || n_nationkey, 'types' FROM nation""")
def redux_roles(spark, sf_dir):
    """Every part of nations' state that a file holds."""
    nation = table(spark, sf_dir, "nation")
    state = nation.select(F.concat(F.lit("src/store/n"), "n_nationkey", F.lit("/state.ts")).alias("path"), _text("export const s = createSlice({ name: 'nation<<key>>', reducers: {} });\nfunction* go() {}\nexport const all = (state: RootState) => state.x;", key="n_nationkey").alias("content"))
    types = nation.select(F.concat(F.lit("src/store/n"), "n_nationkey", F.lit("/types.ts")).alias("path"), F.lit("export type A = 1").alias("content"))
    return state.unionByName(types).select("path", F.explode(E.redux_roles(F.col("path"), E.code("content"))).alias("r")).select("path", "r.slice", "r.role")


@query("SELECT 'src/r' || n_regionkey || '/index.ts' AS file, 'N' || n_nationkey AS symbol, 'src/r' || n_regionkey || '/n' || n_nationkey || '.ts' AS target FROM nation")
def symbol_walk(spark, sf_dir):
    """The file behind each nation that a region's index passes on, by name or by star, through a second index."""
    nation = table(spark, sf_dir, "nation")
    at = lambda tail: F.concat(F.lit("src/r"), "n_regionkey", F.lit(tail))
    leaf, name = F.concat(at("/n"), "n_nationkey", F.lit(".ts")), F.concat(F.lit("N"), "n_nationkey")
    first = nation.select(at("/index.ts").alias("file"), F.lit("*").alias("exported"), F.lit(None).cast("string").alias("local"), at("/all/index.ts").alias("source")).distinct()
    second = nation.select(at("/all/index.ts").alias("file"), name.alias("exported"), F.lit("default").alias("local"), leaf.alias("source"))
    last = nation.select(leaf.alias("file"), F.lit("default").alias("exported"), F.lit("default").alias("local"), F.lit(None).cast("string").alias("source"))
    return R.exported_symbols(nation.select(at("/index.ts").alias("file"), name.alias("symbol")), first.unionByName(second).unionByName(last))


@query("""WITH e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)
SELECT src, dst FROM e UNION SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src""")
def barrel_expansion(spark, sf_dir):
    """Customers import their nation's region through the nation, as an index file."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    edges = customer.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst")).unionByName(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst")))
    return R.expand_barrels(edges, nation.select(F.concat(F.lit("n"), "n_nationkey").alias("path")))


@query("""SELECT 'src/cust/C' || c_custkey || '.ts' AS path, 'src/nations/N' || c_nationkey || '.ts' AS target FROM customer
UNION ALL SELECT 'src/cust/C' || c_custkey || '.ts', 'src/regions/R' || n_regionkey || '.ts' FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 2 = 1""")
def registry_build_imports(spark, sf_dir):
    """Where imports lead in a registry built from code: by alias, and, for odd customers, through an index that passes regions on."""
    return shop(spark, sf_dir).files.where("path LIKE 'src/cust/%'").select("path", F.explode("imports").alias("target")).where("target NOT LIKE '%index.ts'")


@query("""SELECT '/nations/' || n_nationkey AS pattern, 'src/nations/N' || n_nationkey || '.ts' AS component FROM nation""")
def registry_build_routes(spark, sf_dir):
    """Routes of the built registry: constants as paths, components by their files."""
    return shop(spark, sf_dir, _VISITS).extracted_routes


@query("""SELECT DISTINCT 'src/nations/N' || c_nationkey || '.ts' AS changed, 'e2e/o' || o_orderkey || '.cy.ts' AS test, round(0.85, 6)::DOUBLE AS weight FROM orders JOIN customer ON c_custkey = o_custkey""")
def route_match(spark, sf_dir):
    """Orders' tests that visit the page of their customer's nation."""
    reg = shop(spark, sf_dir, _VISITS)
    return S.route_match(reg, _changed(reg, "src/nations/")).select("changed", "test", F.round("weight", 6).alias("weight"))


@query("""SELECT DISTINCT 'src/nations/N' || c_nationkey || '.ts' AS changed, 'e2e/o' || o_orderkey || '.cy.ts' AS test FROM orders JOIN customer ON c_custkey = o_custkey""")
def selector_id(spark, sf_dir):
    """Orders' tests that look for their nation's element by id."""
    reg = shop(spark, sf_dir)
    return S.selector_id(reg, _changed(reg, "src/nations/")).select("changed", "test")


@query("""WITH t AS (SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT 'src/nations/N' || c_nationkey || '.ts' AS changed, 'e2e/o' || o_orderkey || '.cy.ts' AS test FROM t""")
def translation_match(spark, sf_dir):
    """Orders' tests that look for the text of their nation's key."""
    reg = shop(spark, sf_dir)
    return S.translation_match(reg, _changed(reg, "src/nations/")).select("changed", "test")


@query("""SELECT 'src/store/n' || c_nationkey || '/state.ts' AS changed, 'e2e/o' || o_orderkey || '.cy.ts' AS test, 0.65::DOUBLE AS weight FROM orders JOIN customer ON c_custkey = o_custkey""")
def redux_consumer(spark, sf_dir):
    """Orders' tests that visit the page which shows their nation's state."""
    reg = shop(spark, sf_dir, _VISITS)
    return S.redux_consumer(reg, _changed(reg, "src/store/")).select("changed", "test", F.round("weight", 6).alias("weight"))


@query("""SELECT 'src/store/n' || c_nationkey || '/state.ts' AS changed, 'e2e/o' || o_orderkey || '.cy.ts' AS test FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 = 0""")
def redux_chain(spark, sf_dir):
    """Every third order's test imports its nation's page, which shows the nation's state."""
    reg = shop(spark, sf_dir)
    return S.redux_chain(reg, _changed(reg, "src/store/")).select("changed", "test")


@query("""SELECT slice, role, path FROM (SELECT 'nation' || n_nationkey AS slice, unnest(['slice', 'selectors']) AS role, 'src/store/n' || n_nationkey || '/state.ts' AS path FROM nation)
UNION ALL SELECT 'nation' || n_nationkey, 'consumer', 'src/nations/N' || n_nationkey || '.ts' FROM nation""")
def redux_chains(spark, sf_dir):
    """Members and consumers of nations' state."""
    return shop(spark, sf_dir).chains.select("slice", "role", "path").distinct()


@query("""SELECT 'src/store/n' || c_nationkey || '/state.ts' AS changed, 'e2e/o' || o_orderkey || '.cy.ts' AS test, 0.6::DOUBLE AS weight FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 = 0""")
def action_type(spark, sf_dir):
    """Tests that state the action type of their nation's state; any number of files may own it here."""
    reg = shop(spark, sf_dir)
    return S.action_type(reg, _changed(reg, "src/store/"), most_owners=10**9).select("changed", "test", "weight")


@query("SELECT 'src/nations/N' || n_nationkey || '.ts' AS path, 'nation' || n_nationkey AS slice FROM nation WHERE false UNION ALL SELECT 'src/store/n' || n_nationkey || '/state.ts', 'nation/NATION_' || n_nationkey || '_LOADED' FROM nation")
def chain_actions(spark, sf_dir):
    """Action types of slices' members, as those of the slice's file."""
    reg = shop(spark, sf_dir)
    files = I.with_chain_actions(reg.files.withColumn("action_types", F.when(F.col("path").startswith("src/store/"), F.col("action_types"))), reg.chains)
    return files.where("path LIKE 'src/store/%'").select("path", F.explode("action_types").alias("slice"))


@query("""SELECT pattern, 1::DOUBLE AS share FROM (SELECT '/nations/' || c_nationkey AS pattern FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)""")
def visited_patterns(spark, sf_dir):
    """Visited urls and how specific the patterns are that they resolve to."""
    return shop(spark, sf_dir, _VISITS).resolved_visits.select(F.col("raw").alias("pattern"), F.col("specificity").alias("share")).distinct()


# nations and customers as files of their own -----------------------------------------------


def _tests(df: DataFrame, spark: SparkSession, **given: Column) -> DataFrame:
    """Tests with some fields of what they do, and empty ones for the others."""
    kinds = {"visited_routes": "array<string>", "selectors": "array<struct<type:string,value:string,raw:string>>", "contains_text": "array<string>", "intercepts": "array<struct<method:string,url_pattern:string>>",
             "url_assertions": "array<struct<operator:string,expected:string>>", "custom_commands": "array<string>", "describes": "array<string>", "its": "array<string>"}
    cypress = F.struct(*(given.get(n, F.array()).cast(t).alias(n) for n, t in kinds.items()))
    return impact.shaped(df.withColumn("type", F.lit("test")).withColumn("cypress", cypress), spark)


@query("""SELECT 'r' || n_regionkey AS changed, 'c' || c_custkey AS test, round(0.65 / 3, 6)::DOUBLE AS weight FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE (SELECT count(*) FROM customer x WHERE x.c_nationkey = n_nationkey) <= 0.1 * (SELECT count(*) FROM customer)""")
def dependent_selector(spark, sf_dir):
    """Customers, as tests, that use a selector of a nation, which depends on the changed region."""
    nation, region, customer = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    box = lambda k: F.concat(F.lit("nation-"), F.col(k), F.lit("-box"))
    nations = impact.shaped(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("path"), F.lit("source").alias("type"), F.array(F.concat(F.lit("r"), "n_regionkey")).alias("imports"), F.array(F.struct(F.lit("data-testid").alias("attr"), box("n_nationkey").alias("value"))).alias("selectors")), spark)
    regions = impact.shaped(region.select(F.concat(F.lit("r"), "r_regionkey").alias("path"), F.lit("source").alias("type")), spark)
    tests = _tests(customer.select(F.concat(F.lit("c"), "c_custkey").alias("path"), "c_nationkey"), spark, selectors=F.array(F.struct(F.lit("data-testid").alias("type"), box("c_nationkey").alias("value"), box("c_nationkey").alias("raw"))))
    reg = S.Registry(nations.unionByName(regions).unionByName(tests), impact.load())
    return S.dependent_selector(reg, regions.select("path")).select("changed", "test", F.round("weight", 6).alias("weight"))


@query("""WITH d AS (SELECT c_nationkey AS n, 1 - ln(count(*)) / ln((SELECT count(*) FROM customer) + 1) AS idf FROM customer GROUP BY 1)
SELECT 'n' || n AS changed, 'c' || c_custkey AS test, 0.7::DOUBLE AS weight FROM customer JOIN d ON n = c_nationkey WHERE idf >= 0.35""")
def describe_block(spark, sf_dir):
    """Customers, as tests, whose titles name their nation, where not too many do."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    word = lambda k: F.translate(F.concat(F.lit("zq"), F.lpad(F.col(k).cast("string"), 2, "0")), "0123456789", "abcdefghij")
    sources = impact.shaped(nation.select(F.concat(F.lit("src/zone/"), word("n_nationkey"), F.lit(".ts")).alias("path"), F.lit("source").alias("type")), spark)
    tests = _tests(customer.select(F.concat(F.lit("c"), "c_custkey").alias("path"), "c_nationkey"), spark, describes=F.array(F.concat(F.lit("About "), word("c_nationkey"))))
    reg = S.Registry(sources.unionByName(tests), impact.load())
    back = F.concat(F.lit("n"), F.translate(F.regexp_extract("changed", "zq(..)", 1), "abcdefghij", "0123456789").cast("int"))
    return S.describe_block(reg, sources.select("path")).select(back.alias("changed"), "test", F.round("weight", 6).alias("weight"))


_NATION = """import { all } from '../store/n<<key>>/state';
export default function N<<key>>() { useSelector(all); return <div id="nation-<<key>>">{t('nation.<<key>>.name')}</div> }
"""
_STATE = """export const s = createSlice({ name: 'nation<<key>>', reducers: {} });
export const all = (state: RootState) => state.x;
export const NATION_<<key>>_LOADED = 'nation/NATION_<<key>>_LOADED';
"""
_CUSTOMER = """import N from '@/nations/N<<nation>>';
<<more>>"""
_TEST = """<<more>>describe('Order', () => { it('x', () => { cy.visit('/nations/<<nation>>'); cy.get('#nation-<<nation>>'); cy.contains('Nation number <<nation>>'); }) });
"""


def shop_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as pages with state, customers that import them, regions behind an index, orders as tests."""
    nation, region = (table(spark, sf_dir, t) for t in ("nation", "region"))
    customer, orders = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")), spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))

    def file(df: DataFrame, path: Column, content: Column, kind: str = "source") -> DataFrame:
        return df.select(F.lit("shop").alias("repo_root"), path.alias("path"), content.alias("content"), F.lit(kind).alias("type"))

    named = lambda a, k, b: F.concat(F.lit(a), F.col(k), F.lit(b))
    odd = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    odd = odd.withColumn("more", F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lit("import { R"), "n_regionkey", F.lit(" } from '../regions/r"), "n_regionkey", F.lit("/index';"))).otherwise(""))
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    placed = placed.withColumn("more", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("import N from '../src/nations/N"), "c_nationkey", F.lit("';\nconst a = 'nation/NATION_"), "c_nationkey", F.lit("_LOADED';\n"))).otherwise(""))
    paths = nation.agg(F.concat(F.lit("export const Paths = { "), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("N"), "n_nationkey", F.lit(": '/nations/"), "n_nationkey", F.lit("'")))), ", "), F.lit(" };")).alias("content"))
    router = nation.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("import N"), "n_nationkey", F.lit(" from './nations/N"), "n_nationkey", F.lit("';")))), "\n").alias("imports"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<Route path={Paths.N"), "n_nationkey", F.lit("} element={<N"), "n_nationkey", F.lit(" />} />")))), "\n").alias("tags"))
    parts = [
        file(nation, named("src/nations/N", "n_nationkey", ".ts"), _text(_NATION, key="n_nationkey")), file(nation, named("src/store/n", "n_nationkey", "/state.ts"), _text(_STATE, key="n_nationkey")),
        file(region, named("src/regions/R", "r_regionkey", ".ts"), named("export const R", "r_regionkey", " = 1;")), file(region, named("src/regions/r", "r_regionkey", "/index.ts"), F.concat(F.lit("export { R"), "r_regionkey", F.lit(" } from '../R"), "r_regionkey", F.lit("';"))),
        file(odd, named("src/cust/C", "c_custkey", ".ts"), _text(_CUSTOMER, nation="c_nationkey", more="more")), file(placed, named("e2e/o", "o_orderkey", ".cy.ts"), _text(_TEST, nation="c_nationkey", more="more"), "test"),
        file(paths, F.lit("src/paths.ts"), F.col("content")), file(router, F.lit("src/Router.tsx"), F.concat(F.lit("import { Paths } from './paths';\n"), "imports", F.lit("\nconst x = <Routes>"), "tags", F.lit("</Routes>;"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: What scorers that go by visits read of the facts.
_VISITS = ("cypress.visited_routes",)


@cache
def shop(spark: SparkSession, sf_dir: str, only: tuple[str, ...] | None = None) -> S.Registry:
    """The registry built from the shop's code, with all facts or only some, once for each folder."""
    nation = table(spark, sf_dir, "nation")
    texts = nation.select(F.concat(F.lit("nation."), "n_nationkey", F.lit(".name")).alias("key"), F.concat(F.lit("Nation number "), "n_nationkey").alias("text"))
    i18n = texts.select("key", "text", F.col("text").alias("static_text"), F.lit(False).alias("is_dynamic"))
    cfg = impact.load({"scoring": {"ubiquitous_selector": 1.0, "max_fan_out": 10**6}})
    aliases = spark.createDataFrame([("@", "src")], "prefix string, target string")
    return build_plan.build(sources.saved(shop_code(spark, sf_dir), "code"), aliases, [], cfg, i18n, only=only)


def _changed(reg: S.Registry, folder: str) -> DataFrame:
    return reg.files.where(F.col("type") == "source").where(F.col("path").startswith(folder)).select("path")
