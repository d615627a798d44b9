import pytest

from ripplespark.operators import scorers as S
from ripplespark.plans import impact
from tests.helpers import entry, paths, registry, rows, weight


def sel(*pairs):
    return {"selectors": [{"type": t, "value": v, "raw": v} for t, v in pairs]}


def own(*values, attr="data-testid"):
    return [{"attr": attr, "value": v} for v in values]


def test_direct_import(spark):
    reg = registry(spark, entry("src/Button.tsx"), entry("src/A.tsx"), entry("src/__tests__/Button.test.tsx", imports=["src/Button.tsx"]))
    assert weight(S.direct_import(reg, paths(spark, "src/Button.tsx"))) == 0.95
    out = impact.analyse(reg, paths(spark, "src/Button.tsx")).collect()
    assert len(out) == 1 and out[0]["score"] >= 0.95 and out[0]["confidence"] == "high" and "Imports the changed file itself" in out[0]["explanation"]


def test_unknown_file_has_no_results(spark):
    reg = registry(spark, entry("src/a.ts"), entry("a.cy.ts", imports=["src/a.ts"]))
    assert impact.analyse(reg, paths(spark, "src/missing.ts")).isEmpty()


def test_transitive_import_and_fan_out(spark):
    files = [entry("src/a.ts"), entry("src/b.ts", imports=["src/a.ts"]), entry("t.cy.ts", imports=["src/b.ts"])]
    assert weight(S.transitive_import(registry(spark, *files), paths(spark, "src/a.ts"))) == 0.70
    narrow = registry(spark, *files, config={"scoring": {"max_fan_out": 0}})
    assert weight(S.transitive_import(narrow, paths(spark, "src/a.ts"))) is None


def test_one_selector_match(spark):
    reg = registry(spark, entry("src/Login.tsx", selectors=own("login-submit")), entry("x.cy.ts", cypress=sel(("data-testid", "login-submit"))), config={"scoring": {"ubiquitous_selector": 1.0}})
    assert weight(S.selector_match(reg, paths(spark, "src/Login.tsx"))) == pytest.approx(0.28)


def test_selector_prefix_depth_and_ubiquity(spark):
    tests = [entry(f"t{k}.cy.ts", cypress=sel(("data-testid", "other"))) for k in range(19)]
    reg = registry(spark, entry("src/A.tsx", imports=["src/B.tsx"]), entry("src/B.tsx", selectors=own("save-button", "other")), entry("a.cy.ts", cypress=sel(("complex", "[data-test-id=save-button-main]"))), *tests)
    out = rows(S.selector_match(reg, paths(spark, "src/A.tsx")))
    assert set(out) == {("src/A.tsx", "a.cy.ts")}  # 'other' is in most tests
    assert out["src/A.tsx", "a.cy.ts"]["weight"] == pytest.approx(0.8 * 0.7 * 0.7 * 0.35)


def test_dependent_selector(spark):
    more = [entry(f"t{k}.cy.ts") for k in range(20)]
    reg = registry(spark, entry("src/hook.ts"), entry("src/V.tsx", imports=["src/hook.ts"], selectors=own("a-one", "b-two", "c-three")), entry("v.cy.ts", cypress=sel(("data-testid", "a-one"), ("data-testid", "b-two"))), *more)
    assert weight(S.dependent_selector(reg, paths(spark, "src/hook.ts"))) == pytest.approx(0.65 * 2 / 3)
    assert weight(S.dependent_selector(reg, paths(spark, "src/V.tsx"))) is None


def test_selector_id(spark):
    reg = registry(spark, entry("src/F.tsx", selectors=own("user-name", attr="id")), entry("f.cy.ts", cypress=sel(("id", "user-name"))))
    assert weight(S.selector_id(reg, paths(spark, "src/F.tsx"))) == 0.65


def route(path, component_path):
    return {"path": path, "component": "X", "component_path": component_path, "is_lazy": False, "is_dynamic": ":" in path}


def test_routes_resolve_by_tier(spark):
    routes = [route("/users/:id", "U.tsx"), route("/users/new", "N.tsx"), route("/files/*", "F.tsx"), route("/about", "A.tsx"), route("/:any", "Y.tsx")]
    reg = registry(spark, entry("R.tsx", routes=routes))
    urls = spark.createDataFrame([("/users/new",), ("/users/7",), ("/files/a/b",), ("/about/team",), ("/zzz",), ("/users/7/",), ("/none/x/y",)], "url string")
    got = {r["url"]: (r["component"], r["specificity"]) for r in S.resolve_routes(urls, reg.routes).collect()}
    assert got["/users/new"] == ("N.tsx", 1.0)
    assert got["/users/7"] == ("U.tsx", 0.5) and got["/users/7/"] == ("U.tsx", 0.5)
    assert got["/files/a/b"] == ("F.tsx", 0.5)
    assert got["/about/team"] == ("A.tsx", 0.5)
    assert got["/zzz"] == ("Y.tsx", 0.0)
    assert got["/none/x/y"] == ("Y.tsx", 0.0)


def test_route_traffic_damps(spark):
    def reg(visitors):
        tests = [entry(f"t{k}.cy.ts", cypress={"visited_routes": ["/manage"]} if k < visitors else None) for k in range(10)]
        return registry(spark, entry("src/Page.tsx", imports=["src/c.ts"]), entry("src/c.ts"), entry("src/R.tsx", routes=[route("/manage", "src/Page.tsx")]), *tests)

    changed = paths(spark, "src/c.ts")
    eight = {r["weight"] for r in S.route_match(reg(8), changed).collect()}
    assert len(eight) == 1 and eight.pop() == pytest.approx(0.85 * 1.0 / 2 * 0.2)
    assert weight(S.route_match(reg(1), paths(spark, "src/Page.tsx"))) == pytest.approx(0.85)


def test_first_visited_route_wins(spark):
    reg = registry(spark, entry("src/P.tsx", imports=["src/c.ts"]), entry("src/Q.tsx"), entry("src/c.ts"), entry("src/R.tsx", routes=[route("/a/:id", "src/P.tsx"), route("/c", "src/c.ts")]),
                   entry("t.cy.ts", cypress={"visited_routes": ["/nowhere", "/a/1?x=1", "#/c", "/c"]}), entry("u.cy.ts"))
    assert weight(S.route_match(reg, paths(spark, "src/c.ts"))) == pytest.approx(0.85 * (0.3 + 0.35) / 2 * 0.5)


@pytest.mark.parametrize(
    ("changed", "test", "expected"),
    [
        ("src/LoginForm.tsx", "cypress/e2e/loginForm.cy.ts", 0.95),
        ("src/a/utils.ts", "b/utils.test.ts", 0.82 * 0.2),
        ("src/FileManager.tsx", "cypress/e2e/FileManager/basic.cy.ts", 0.82 * 0.85),
        ("src/facility.tsx", "cypress/AddAndEditFacility/flow.cy.ts", 0.82 * 0.85),
        ("src/cart/CartSummary.tsx", "cypress/cart/summary.cy.ts", 0.82),
        ("src/dm/facility.tsx", "cypress/dm/addfacilityandmore.cy.ts", 0.82 * 0.9),
        ("backstage/backstage_category.tsx", "e2e/channel_sidebar/category.cy.ts", None),
        ("src/auth/PasswordInput.tsx", "cypress/e2e/auth/login.cy.ts", None),
        ("src/profile/index.ts", "cypress/profile.cy.ts", 0.95),
        ("src/auth/index.cognito.tsx", "cypress/cognito.cy.ts", 0.95),
    ],
)
def test_filename_match(spark, changed, test, expected):
    got = weight(S.filename_match(registry(spark, entry(changed, "source"), entry(test, "test")), paths(spark, changed)))
    assert got == (pytest.approx(expected) if expected else None)


def test_ambiguous_names_are_no_anchor(spark):
    many = [entry(f"src/x{k}/devicesList{'abcdefghij'[k]}.ts") for k in range(10)]
    reg = registry(spark, entry("src/DevicesListPanel.tsx"), entry("e2e/devicesListView.cy.ts"), *many, *[entry(f"src/Other{k}.ts") for k in range(8)])
    row = rows(S.filename_match(reg, paths(spark, "src/DevicesListPanel.tsx")))["src/DevicesListPanel.tsx", "e2e/devicesListView.cy.ts"]
    assert row["anchor_eligible"] is False
    reg = registry(spark, entry("src/Provisioning.tsx"), entry("e2e/deviceProvisioning.cy.ts"), *many, *[entry(f"src/Other{k}.ts") for k in range(18)])
    assert rows(S.filename_match(reg, paths(spark, "src/Provisioning.tsx")))["src/Provisioning.tsx", "e2e/deviceProvisioning.cy.ts"]["anchor_eligible"]


@pytest.mark.parametrize(
    ("changed", "test", "factor"),
    [
        ("src/a/X.ts", "src/a/X.test.ts", 1.0), ("src/a/X.ts", "src/a/__tests__/X.test.ts", 0.85), ("src/a/X.ts", "src/a/b/X.test.ts", 0.7), ("src/a/b/X.ts", "src/a/X.test.ts", 0.7),
        ("src/a/b/c/d/X.ts", "src/a/b/e/f/X.test.ts", 0.4), ("src/X.ts", "src/b/X.test.ts", None), ("src/a/b/X.ts", "src/c/d/X.test.ts", None), ("X.ts", "X.test.ts", 1.0),
    ],
)
def test_colocation(spark, changed, test, factor):
    got = weight(S.colocation(registry(spark, entry(changed), entry(test)), paths(spark, changed)))
    assert got == (pytest.approx(0.75 * factor) if factor else None)


def test_describe_block(spark):
    titled = lambda *t: {"describes": list(t)}
    reg = registry(spark, entry("src/backstage/signup.tsx"), entry("e2e/backstage/a.cy.ts", cypress=titled("Signup flow")), entry("e2e/b.cy.ts", cypress=titled("cart")), entry("e2e/c.cy.ts"))
    assert weight(S.describe_block(reg, paths(spark, "src/backstage/signup.tsx"))) == pytest.approx(0.70)
    common = registry(spark, entry("src/post.tsx"), *[entry(f"e2e/t{k}.cy.ts", cypress=titled("post it")) for k in range(9)])
    assert S.describe_block(common, paths(spark, "src/post.tsx")).isEmpty()  # in every test's titles


def test_action_types(spark):
    reg = registry(spark, entry("src/saga.ts", action_types=["order/ORDER_PLACED", "ORDER_FAILED"]), entry("o.cy.ts", action_types=["order/ORDER_PLACED"]))
    assert weight(S.action_type(reg, paths(spark, "src/saga.ts"))) == 0.6
    wide = registry(spark, entry("src/saga.ts", action_types=["A_B_C"]), *[entry(f"o{k}.cy.ts", action_types=["A_B_C"]) for k in range(25)])
    assert S.action_type(wide, paths(spark, "src/saga.ts")).isEmpty()


def test_api_intercepts(spark):
    calls = lambda url: {"intercepts": [{"method": "GET", "url_pattern": url}]}
    reg = registry(spark, entry("src/api/users.ts"), entry("src/users.ts"), entry("a.cy.ts", cypress=calls("/api/users/*")), entry("b.cy.ts", cypress=calls("/api/users/7")), entry("c.cy.ts", cypress=calls("/api/*")), entry("d.cy.ts", cypress=calls("/api/orders")))
    assert {k[1] for k in rows(S.api_intercept(reg, paths(spark, "src/api/users.ts")))} == {"a.cy.ts", "b.cy.ts", "c.cy.ts"}
    assert S.api_intercept(reg, paths(spark, "src/users.ts")).isEmpty()


def test_translations(spark):
    i18n = spark.createDataFrame([("auth.login.title", "Sign in", "Sign in", False), ("cart.count", "{{n}} items", "items", True)], "key string, text string, static_text string, is_dynamic boolean")
    files = [entry("src/L.tsx", translation_keys=["auth.login"]), entry("src/C.tsx", translation_keys=["cart.count"]), entry("l.cy.ts", cypress={"contains_text": ["Sign In"]}), entry("c.cy.ts", cypress={"contains_text": ["items"]})]
    reg = registry(spark, *files, i18n=i18n)
    assert set(rows(S.translation_match(reg, paths(spark, "src/L.tsx", "src/C.tsx")))) == {("src/L.tsx", "l.cy.ts"), ("src/C.tsx", "c.cy.ts")}


def test_usage_site(spark):
    reg = registry(spark, entry("src/c.ts"), entry("src/b.ts", imports=["src/c.ts"]), entry("src/a.ts", imports=["src/b.ts"]), entry("t.cy.ts", imports=["src/a.ts"]))
    assert weight(S.usage_site(reg, paths(spark, "src/c.ts"))) == pytest.approx(0.55 * 0.85 * (1 - 3 / 80))


def test_redux(spark):
    redux = spark.createDataFrame([("src/store/cart/slice.ts", "cart", "slice"), ("src/store/cart/selectors.ts", "cart", "selectors"), ("src/store/cart/saga.ts", "cart", "saga"), ("src/store/types.ts", "cart", "types")], "path string, slice string, role string")
    files = [entry("src/store/cart/slice.ts"), entry("src/store/cart/selectors.ts"), entry("src/store/cart/saga.ts"), entry("src/Cart.tsx", imports=["src/store/cart/selectors.ts"], selectors=own("cart-total")), entry("src/Page.tsx", imports=["src/Cart.tsx"]),
             entry("src/R.tsx", routes=[route("/cart", "src/Page.tsx")]), entry("a.cy.ts", imports=["src/Cart.tsx"]), entry("b.cy.ts", cypress=sel(("data-cy", "cart-total"))), entry("c.cy.ts", cypress={"visited_routes": ["/cart"]})]
    reg = registry(spark, *files, redux=redux)
    for member in ("src/store/cart/slice.ts", "src/store/cart/saga.ts"):
        assert {k[1] for k in rows(S.redux_chain(reg, paths(spark, member)))} == {"a.cy.ts", "b.cy.ts"}
        assert weight(S.redux_consumer(reg, paths(spark, member))) == pytest.approx(0.65 * 0.7)
    assert S.redux_chain(reg, paths(spark, "src/store/types.ts")).isEmpty()


BASE = 1_600_000_000
DAY = 86400


def past(spark, c, t, size=1, created=(0, 0)):
    rows_ = [("", "src/c.ts", BASE + created[0] * DAY, BASE + max(c) * 14 * DAY, [(BASE + k * 14 * DAY, size) for k in c]), ("", "t.cy.ts", BASE + created[1] * DAY, BASE + max(t) * 14 * DAY, [(BASE + k * 14 * DAY, size) for k in t])]
    return spark.createDataFrame(rows_, "repo string, path string, created_at bigint, updated_at bigint, commits array<struct<ts:bigint,size:int>>")


@pytest.mark.parametrize(("gap", "expected"), [(7, 0.45), (21, 0.225), (40, 0), (-20, 0)])
def test_creation_gap(spark, gap, expected):
    reg = registry(spark, entry("src/c.ts"), entry("t.cy.ts"), history=past(spark, [0], [0], 99, (0, gap)))
    pairs = spark.createDataFrame([("src/c.ts", "t.cy.ts")], "changed string, test string")
    assert (weight(S.temporal_coherence(reg, paths(spark, "src/c.ts"), pairs)) or 0) == pytest.approx(expected)


@pytest.mark.parametrize(("c", "t", "size", "fires"), [([0, 5], [0, 5], 1, True), ([0, 5], [0, 1, 2, 3, 4, 5], 1, False), ([0], [0], 1, False), ([0, 5], [0, 5], 31, False)])
def test_update_coupling(spark, c, t, size, fires):
    reg = registry(spark, entry("src/c.ts"), entry("t.cy.ts"), history=past(spark, c, t, size, (0, 28)))
    pairs = spark.createDataFrame([("src/c.ts", "t.cy.ts")], "changed string, test string")
    assert (not S.temporal_coherence(reg, paths(spark, "src/c.ts"), pairs).isEmpty()) == fires
