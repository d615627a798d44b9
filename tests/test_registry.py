"""From files on disk to a registry and to results."""

import json
import subprocess
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ripplespark import __main__ as runner
from ripplespark import config
from ripplespark.operators import routes as RT
from ripplespark.plans import impact, registry
from ripplespark.sources import files as sources
from ripplespark.sources import history as H

FILES = {
    "tsconfig.json": '{ // comment\n "compilerOptions": {"baseUrl": ".", "paths": {"@dm/*": ["src/dm/*"],}}}',
    "src/dm/components/index.ts": "export { default as ManageDevices } from './ManageDevices'\n",
    "src/dm/components/ManageDevices/index.tsx": "export default function ManageDevices() { return <div data-testid=\"device-table\">{t('devices.title')}</div> }\n",
    "src/dm/components/Routing/index.ts": "export const ProtectedRoute = (p: any) => p.children\n",
    "src/dm/containers/index.ts": "export { FirmwarePackagesContainer } from './firmwarePackages'\n",
    "src/dm/containers/firmwarePackages/index.ts": "export { FirmwarePackagesContainer } from './firmwarePackages'\n",
    "src/dm/containers/firmwarePackages/firmwarePackages.tsx": "export const FirmwarePackagesContainer = () => null\n",
    "src/dm/paths.ts": "export const RouterPath = { USERS: '/all-users', DEEP: 'deep' } as const\n",
    "src/dm/Users.tsx": "export default () => null\n",
    "src/dm/Router.tsx": """
import { Route, Routes } from 'react-router-dom'
import * as DMContainers from '@dm/containers'
import { ManageDevices } from '@dm/components'
import { ProtectedRoute } from '@dm/components/Routing'
import { RouterPath } from './paths'
import Users from './Users'
export const table = [
  { path: '/admin', element: <ManageDevices />, children: [
    { index: true, element: <Users /> }, { path: 'users', element: <Users /> }, { path: RouterPath.DEEP, lazy: () => import('./Users') } ] },
]
export default function Router() {
  return (<Routes>
    <Route path="/managedevices" element={(<ProtectedRoute><ManageDevices /></ProtectedRoute>)} />
    <Route path="/firmwarepackages" element={(<ProtectedRoute><DMContainers.FirmwarePackagesContainer /></ProtectedRoute>)} />
    <Route path={RouterPath.USERS} element={<Users />} />
    <Route index element={<Users />} />
  </Routes>)
}
""",
    "src/store/cart/slice.ts": "import { createSlice, createSelector } from '@reduxjs/toolkit'\nexport const s = createSlice({ name: 'cart', reducers: {} })\nexport const total = (state: RootState) => state.cart\nexport const CART_PAID = 'cart/CART_PAID'\n",
    "src/Cart.tsx": "import { total, CART_PAID } from './store/cart/slice'\nexport const Cart = () => useSelector(total)\n",
    "cypress/ids.ts": "export const ids = { table: '[data-testid=device-table]', other: 'x' }\n",
    "cypress/ids.json": '{"row": "[data-cy=row]", "n": 1, "deep": {"row": "no"}}',
    "cypress/broken.json": '{"row": ',
    "cypress/list.json": '["row"]',
    "cypress/e2e/devices.cy.ts": "import { ids } from '../ids'\nimport more from '../ids.json'\nimport * as broken from '../broken.json'\nimport list from '../list.json'\n"
    "describe('Manage devices', () => { it('lists', () => { cy.visit('/managedevices'); cy.get(ids.table); cy.get(more.row); cy.get(more.n); cy.get(more.deep); cy.get(broken.row); cy.get(list.row) }) })\n",
    "cypress/e2e/cart.cy.ts": "import { Cart } from '../../src/Cart'\ndescribe('Cart', () => { it('pays', () => {}) })\n",
    "node_modules/x/index.ts": "export const no = 1\n",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    for k in range(5):
        git("mv", f"src/n{k}.ts" if k else "src/dm/paths.ts", f"src/n{k + 1}.ts")
        git("commit", "-qm", f"move {k}")
    git("mv", "src/n5.ts", "src/dm/paths.ts")
    git("commit", "-qm", "back")
    return root


@pytest.fixture(scope="module")
def built(spark, repo):
    return registry.of_repository(spark, str(repo))


def test_routes_lead_to_the_files_of_their_components(built):
    got = {r["pattern"]: r["component"] for r in built.extracted_routes.collect()}
    devices, users = "src/dm/components/ManageDevices/index.tsx", "src/dm/Users.tsx"
    assert got == {
        "/managedevices": devices, "/firmwarepackages": "src/dm/containers/firmwarePackages/firmwarePackages.tsx", "/all-users": users, "": users,
        "/admin": users, "/admin/users": users, "/admin/deep": users,
    }


def test_registry_of_files_on_disk(built):
    files = {r["path"]: r for r in built.files.collect()}
    assert "node_modules/x/index.ts" not in files and files["cypress/e2e/cart.cy.ts"]["type"] == "test"
    assert files["cypress/e2e/cart.cy.ts"]["imports"] == ["src/Cart.tsx"] and "src/dm/components/ManageDevices/index.tsx" in files["src/dm/Router.tsx"]["imports"]
    assert "cart/CART_PAID" in files["src/Cart.tsx"]["action_types"]
    assert [tuple(s)[:2] for s in files["cypress/e2e/devices.cy.ts"]["cypress"]["selectors"]] == [("data-cy", "row"), ("data-testid", "device-table")]
    assert {(r["slice"], r["role"], r["path"]) for r in built.chains.collect()} == {("cart", "slice", "src/store/cart/slice.ts"), ("cart", "selectors", "src/store/cart/slice.ts"), ("cart", "consumer", "src/Cart.tsx")}


def test_history_follows_renames_to_the_end(built):
    past = {r["path"]: len(r["commits"]) for r in built.history.collect()}
    assert past["src/dm/paths.ts"] == 7 and not any(p.startswith("src/n") for p in past)


def test_results_of_changes(spark, built):
    changed = spark.createDataFrame([("src/dm/components/ManageDevices/index.tsx",), ("src/store/cart/slice.ts",), ("gone.ts",)], "path string")
    got = {(r["changed"], r["test"]): {s["type"] for s in r["signals"]} for r in impact.analyse(built, changed).collect()}
    assert {"route-match"} <= got["src/dm/components/ManageDevices/index.tsx", "cypress/e2e/devices.cy.ts"]
    assert {"transitive-import", "redux-chain"} <= got["src/store/cart/slice.ts", "cypress/e2e/cart.cy.ts"]


def test_runners(spark, repo, built, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(registry, "of_repository", lambda spark, root, cfg, tests, locales: replace(built, config=cfg))
    (repo / config.CONFIG_FILE).write_text(json.dumps({"scoring": {"max_results": 1}}))
    runner.main(["registry", "build", "--root", str(repo), "--out", str(tmp_path / "r")], spark)
    assert spark.read.parquet(str(tmp_path / "r" / "routes")).count() == 7
    runner.main(["analyze", "--root", str(repo), "--changed", "src/store/cart/slice.ts"], spark)
    (line,) = capsys.readouterr().out.strip().splitlines()
    assert [t["test"] for t in json.loads(line)["tests"]] == ["cypress/e2e/cart.cy.ts"]
    (repo / "src/Cart.tsx").write_text("import { total } from './store/cart/slice'\nexport const Cart = 2\n")
    diff = {r["path"]: r["diff"] for r in sources.changed_diffs(spark, str(repo)).collect()}
    assert set(diff) == {"src/Cart.tsx"} and "+export const Cart = 2" in diff["src/Cart.tsx"]
    with pytest.raises(ValueError, match="unknown settings"):
        (repo / config.CONFIG_FILE).write_text('{"nothing": 1}')
        config.read(str(repo))


def test_route_objects_in_odd_code(spark):
    rows = [("a.ts", "const r = [{ path: '/a', handle: { path: 'x' }, element: <A b={{ c: 1 }} />, children: [{ path: '/abs', Component: B }, { element: <C /> }] }]; const o = { path: 'no component' }"), ("b.ts", None), ("c.ts", ""), ("d.ts", "} ] { path: '/open', element: <D />")]
    found = RT.definitions(spark.createDataFrame(rows, "path string, content string")).collect()
    assert {(r["path"], tuple(r["chain"]), r["component"]) for r in found} == {("a.ts", ("'/a'",), "A"), ("a.ts", ("'/a'", "'/abs'"), "B")}
    assert H.git_log(spark, "/nowhere").columns == ["repo", "pos", "record"] and F is not None
