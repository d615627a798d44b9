from pyspark.sql import functions as F

from ripplespark.operators import extract as E
from ripplespark.operators import index as I
from ripplespark.operators import resolve as R
from tests.helpers import entry, paths, table

SPEC = """
/** Signs a user in. */
import React, { useState as use } from 'react';
import { LOGIN_OK } from '../store/types';
import type { T } from './t';
import * as ids from "./ids";
export { Login, helper as help } from './Login';
export * from './all';
const Lazy = lazy(() => import('./pages/Lazy'));
const old = require("./old");
import './side.css';
export const ORDER_SENT = 'order/ORDER_SENT';
export const enum E { A = 'x' }
class Foo {}
interface Bar {}
function* saga() { yield put({ type: 'USER_LOGGED_IN' }); }
// import bad from 'commented';
const el = <div data-testid="login-form" id={'user'}><label aria-label={`Pick ${n}`}>User name</label>{t('auth.login')}</div>;
const o = { 'data-cy': "cy-one" };
const s = useSelector(selectUser); dispatch(loadUser());
const K = keyMirror({ FIRST_ONE: null });
const r = <Routes><Route path="/users/:id" element={<User />} /><Route path="/lazy" lazy={() => import('./pages/L')} /></Routes>;
const url = 'http://example.org/x';
"""
CY = """
describe('Login flow', () => {
  it(`works`, () => {
    cy.visit('/login?x=1'); cy.visit(`/users/${id}/edit`); cy.loginByXstate('/home');
    cy.get('[data-testid="login-submit"]').click(); cy.find("#user"); cy.get('.cls'); cy.get('[data-qa=qa-1]'); cy.get('div > a');
    cy.getByTestId('by-test'); cy.findByDataCy('by-cy'); cy.get('@alias');
    cy.contains('Welcome back'); cy.contains(/Sign (in|up)/); cy.contains('h1', 'Title');
    cy.intercept('POST', '/api/login'); cy.intercept('/api/users/*');
    cy.url().should('include', '/home');
  });
});
"""


def extracted(spark):
    df = spark.createDataFrame([("r", "src/a.tsx", SPEC, "source"), ("r", "e2e/a.cy.ts", CY, "test"), ("r", "src/none.ts", None, "source")], "repo_root string, path string, content string, type string")
    return {r["path"]: r for r in E.extract(df).collect()}


def test_source_facts(spark):
    r = extracted(spark)["src/a.tsx"]
    assert set(r["imports"]) == {"react", "../store/types", "./t", "./ids", "./Login", "./all", "./pages/Lazy", "./pages/L", "./old", "./side.css"}
    assert r["exports"] == ["Login", "help"] and r["classes"] == ["Foo"] and r["interfaces"] == ["Bar"] and "saga" in r["functions"]
    assert {(s["attr"], s["value"]) for s in r["selectors"]} == {("data-testid", "login-form"), ("id", "user"), ("aria-label", "Pick "), ("data-cy", "cy-one")}
    assert "User name" in r["jsx_text"] and r["translation_keys"] == ["auth.login"]
    assert r["redux"]["selectors_used"] == ["selectUser"] and r["redux"]["actions_dispatched"] == ["loadUser"]
    assert {"order/ORDER_SENT", "USER_LOGGED_IN", "FIRST_ONE"} <= set(r["action_types"]) and r["action_type_consts"] == {"ORDER_SENT": "order/ORDER_SENT"}
    assert {("useState", "react"), ("LOGIN_OK", "../store/types")} <= {(i["name"], i["module"]) for i in r["imported_idents"]}
    assert {(x["path"], x["component"], x["is_lazy"], x["is_dynamic"]) for x in r["routes"]} == {("/users/:id", "User", False, True), ("/lazy", "./pages/L", True, False)}
    assert r["cypress"] is None


def test_test_facts(spark):
    c = extracted(spark)["e2e/a.cy.ts"]["cypress"]
    assert set(c["visited_routes"]) == {"/login?x=1", "/users/*/edit", "/home"}
    assert {(s["type"], s["value"]) for s in c["selectors"]} == {("data-testid", "login-submit"), ("id", "user"), ("class", "cls"), ("data-testid", "qa-1"), ("complex", "div > a"), ("data-testid", "by-test"), ("data-cy", "by-cy")}
    assert set(c["contains_text"]) == {"Welcome back", "Sign (in|up)", "Title"}
    assert {(i["method"], i["url_pattern"]) for i in c["intercepts"]} == {("POST", "/api/login"), ("GET", "/api/users/*")}
    assert [tuple(u) for u in c["url_assertions"]] == [("include", "/home")]
    assert c["describes"] == ["Login flow"] and c["its"] == ["works"] and set(c["custom_commands"]) == {"loginByXstate", "getByTestId", "findByDataCy"}


def test_roles_and_kinds(spark):
    rows = [("src/store/cart/s.ts", "export const s = createSlice({ name: 'basket', reducers: {} })"), ("src/store/cart/saga.ts", "function* go() {}"), ("src/store/cart/sel.ts", "const x = (state: RootState) => state.a"), ("src/features/pay/types.ts", "export type X = 1"), ("src/x.ts", "const a = 1")]
    df = spark.createDataFrame(rows, "path string, content string").withColumn("r", E.redux_role(F.col("path"), F.col("content")))
    assert {r["path"]: r["r"] and tuple(r["r"]) for r in df.collect()} == {"src/store/cart/s.ts": ("basket", "slice"), "src/store/cart/saga.ts": ("cart", "saga"), "src/store/cart/sel.ts": ("cart", "selectors"), "src/features/pay/types.ts": ("pay", "types"), "src/x.ts": None}
    kinds = spark.createDataFrame([(SPEC,)], "content string").select(E.import_kinds(E.code("content")).alias("k")).first()["k"]
    assert {("named", "../store/types"), ("type", "./t"), ("namespace", "./ids"), ("require", "./old"), ("side-effect", "./side.css"), ("re-export", "./all")} <= {(k["kind"], k["module"]) for k in kinds}


def test_imports_resolve(spark):
    files = paths(spark, "src/a.tsx", "src/b/index.ts", "src/b.ts", "lib/x.ts", "lib/long/y.ts", "types/z.d.ts", "base/q.js")
    imports = spark.createDataFrame([("src/a.tsx", s) for s in ("./b", "./b/index", "../lib/x", "@/x", "@/long/y", "@long/y", "q", "react", "./missing")], "path string, spec string")
    aliases = spark.createDataFrame([("@", "lib"), ("@long", "lib/long")], "prefix string, target string")
    got = {r["spec"]: r["target"] for r in R.resolve_imports(imports, files, aliases, ["base"]).collect()}
    assert got == {"./b": "src/b.ts", "./b/index": "src/b/index.ts", "../lib/x": "lib/x.ts", "@/x": "lib/x.ts", "@/long/y": "lib/long/y.ts", "@long/y": "lib/long/y.ts", "q": "base/q.js"}
    assert {r["spec"]: r["resolved"] for r in R.longest_alias(imports, aliases).collect()} == {"@/x": "lib/x", "@/long/y": "lib/long/y", "@long/y": "lib/long/y"}
    assert R.merged_aliases({"@": "a", "x": "b"}, {"@": "c"}) == {"@": "c", "x": "b"}


def test_barrels_and_symbols(spark):
    graph = spark.createDataFrame([("t", "b/index.ts"), ("b/index.ts", "b/A.tsx"), ("b/index.ts", "b/B.tsx")], "src string, dst string")
    assert {(r["src"], r["dst"]) for r in R.expand_barrels(graph, paths(spark, "b/index.ts")).collect()} >= {("t", "b/A.tsx"), ("t", "b/B.tsx")}
    texts = spark.createDataFrame([("b/index.ts", "// all\nexport { A } from './A';\nexport * from './B';\n"), ("c/index.ts", "export * from './C';\nconst x = 1;"), ("d/x.ts", "export * from './B'")], "path string, content string")
    assert {r["path"] for r in texts.where(R.is_barrel(F.col("path"), F.col("content"))).collect()} == {"b/index.ts"}
    exports = spark.createDataFrame([("i", "X", "Y", "m"), ("i", "*", None, "n"), ("m", "Y", "Y", None), ("n", "Z", "Z", None), ("n", "X", "X", None)], "file string, exported string, local string, source string")
    wanted = spark.createDataFrame([("i", "X"), ("i", "Z"), ("i", "none")], "file string, symbol string")
    assert {r["symbol"]: r["target"] for r in R.exported_symbols(wanted, exports).collect()} == {"X": "m", "Z": "n"}


def test_constants(spark):
    files = spark.createDataFrame([("ids.ts", "export const ids = { save: 'save-btn', n: 1, 'x-y': \"z\" } as const;\nexport enum R { Home = '/home' }\nexport const F = Object.freeze({ a: 'b' });"), ("t.cy.ts", "cy.get(ids.save)")], "path string, content string")
    got = {(r["name"], r["key"], r["value"]) for r in R.constants(files).collect()}
    assert got == {("ids", "save", "save-btn"), ("ids", "x-y", "z"), ("R", "Home", "/home"), ("F", "a", "b")}
    idents = spark.createDataFrame([("t.cy.ts", "ids", "ids.ts")], "path string, name string, target string")
    assert [r["value"] for r in E.with_constants(files, R.constants(files).withColumnRenamed("path", "target"), idents).collect()] == ["save-btn"]
    fs = table(spark, entry("a.ts", imported_idents=[{"name": "X", "module": "./c"}], action_types=["A_B"]), entry("c.ts", action_type_consts={"X": "C_D"}))
    resolved = spark.createDataFrame([("a.ts", "./c", "c.ts")], "path string, spec string, target string")
    assert {r["path"]: r["action_types"] for r in R.with_imported_actions(fs, resolved).collect()}["a.ts"] == ["A_B", "C_D"]


def test_indexes(spark):
    route = lambda p, c: {"path": p, "component": c, "component_path": None, "is_lazy": False, "is_dynamic": False}
    fs = table(spark, entry("src/App.tsx", imports=["src/pages/Home.tsx", "src/About/index.tsx"], routes=[route("/", "Home"), route("/about", "About"), route("/far", "Far"), route("/own", "Nowhere"), route("/", "Far")]), entry("src/pages/Home.tsx", jsx_text=[" Hello There ", "abc"]), entry("src/About/index.tsx"), entry("src/Far.tsx"))
    assert {r["pattern"]: r["component"] for r in I.routes(fs).collect()} == {"/": "src/Far.tsx", "/about": "src/About/index.tsx", "/far": "src/Far.tsx", "/own": "src/App.tsx"}
    better = spark.createDataFrame([("/own", "src/Real.tsx"), ("/new", "src/New.tsx")], "pattern string, component string")
    got = {r["pattern"]: r["component"] for r in I.routes(fs, better).collect()}
    assert got["/own"] == "src/Real.tsx" and got["/new"] == "src/New.tsx" and got["/far"] == "src/Far.tsx"
    assert [tuple(r) for r in I.texts(fs).collect()] == [("hello there", "src/pages/Home.tsx")]
    chain = spark.createDataFrame([("s", "slice", "src/Far.tsx"), ("s", "saga", "src/x.ts")], "slice string, role string, path string")
    more = table(spark, entry("src/Far.tsx", action_types=["A_B"]), entry("src/x.ts", action_types=["C_D"]))
    assert {r["path"]: sorted(r["action_types"]) for r in I.with_chain_actions(more, chain).collect()}["src/Far.tsx"] == ["A_B", "C_D"]
    stats = I.stats(fs, spark.createDataFrame([("a", "b")], "src string, dst string")).first()
    assert (stats["files"], stats["sources"], stats["tests"], stats["routes"], stats["edges"]) == (4, 4, 0, 5, 1)
    assert I.lookup(fs, paths(spark, "src/Far.tsx")).count() == 1
