import pytest
from pyspark.sql import functions as F

from ripplespark.operators import fusion, graph
from ripplespark.operators import scorers as S
from ripplespark.plans import impact
from tests.helpers import entry, paths, registry, table

SIGNAL = "changed string, test string, type string, weight double, anchor_eligible boolean, reason string"


def signals(spark, *rows):
    return spark.createDataFrame([("c", t, k, w, e, "r") for t, k, w, e in rows], SIGNAL)


def test_noisy_or(spark):
    assert fusion.fuse(signals(spark, ("t", "colocation", 0.8, True), ("t", "route-match", 0.4, True))).first()["score"] == pytest.approx(0.88)
    assert spark.range(0).agg(fusion.noisy_or(F.col("id").cast("double")).alias("x")).first()["x"] == 0
    assert spark.createDataFrame([(1.0,), (0.5,), (7.0,)], "w double").agg(fusion.noisy_or("w").alias("x")).first()["x"] == 1


def test_gates(spark):
    some = signals(spark, ("a", "describe-block", 0.7, True), ("b", "describe-block", 0.7, True), ("b", "redux-chain", 0.75, True), ("d", "describe-block", 0.7, True), ("d", "temporal-coherence", 0.4, True),
                   ("e", "filename-match", 0.8, False), ("f", "route-match", 0.8, True), ("g", "colocation", 0.7, True))
    kept = {(r["test"], r["type"]) for r in fusion.describe_gate(some).collect()}
    assert ("a", "describe-block") not in kept and ("d", "describe-block") not in kept and ("b", "describe-block") in kept
    none, hub = paths(spark, "other"), paths(spark, "c")
    assert {r["test"] for r in fusion.anchor_gate(some, none).collect()} == {"f", "g"}
    assert {r["test"] for r in fusion.anchor_gate(some, hub).collect()} == {"g"}


def test_redux_alone_is_no_candidate_unless_the_gate_is_off(spark):
    redux = spark.createDataFrame([("src/dm/sagas/manageDevices.ts", "dm", "saga"), ("src/dm/sel.ts", "dm", "selectors")], "path string, slice string, role string")
    files = [entry("src/dm/sagas/manageDevices.ts"), entry("src/dm/sel.ts"), entry("cypress/e2e/loadingIcons.cy.ts", imports=["src/dm/sel.ts"]), entry("cypress/e2e/manageDevices.cy.ts", imports=["src/dm/sel.ts"])]
    changed = paths(spark, "src/dm/sagas/manageDevices.ts")
    out = impact.analyse(registry(spark, *files, redux=redux), changed).collect()
    assert [r["test"] for r in out] == ["cypress/e2e/manageDevices.cy.ts"] and out[0]["score"] > 0.4
    off = {r["test"]: r["score"] for r in impact.analyse(registry(spark, *files, redux=redux, config={"scoring": {"require_anchor": False}}), changed).collect()}
    assert off["cypress/e2e/loadingIcons.cy.ts"] == pytest.approx(0.75)


def test_ubiquity(spark):
    others = [entry(f"src/f{k}.ts", imports=["src/theme.ts"] if k < 9 else []) for k in range(9)]
    reg = registry(spark, entry("src/theme.ts"), *others, entry("x/y.cy.ts", imports=["src/theme.ts"]), config={"scoring": {"min_confidence": 0.0}})
    row = impact.analyse(reg, paths(spark, "src/theme.ts"), anchor_first=False).first()
    assert row["score"] < 0.4


def test_hub_roles(spark):
    many = [f"m{k}" for k in range(8)]
    route = {"path": "/x", "component": "X", "component_path": None, "is_lazy": False, "is_dynamic": False}
    files = table(spark, entry("a/index.ts", exports=many, imports=many), entry("b/index.ts", exports=many), entry("src/Router.tsx"), entry("src/App.tsx", routes=[route] * 5), entry("src/x.ts", exports=many, imports=many), entry("router.ts", "test"))
    assert {r["path"]: r["role"] for r in graph.hubs(files).collect()} == {"a/index.ts": "barrel", "src/Router.tsx": "router", "src/App.tsx": "router"}


def test_results_and_explanations(spark):
    scored = fusion.fuse(signals(spark, ("a", "colocation", 0.9, True), ("b", "colocation", 0.9, True), ("c", "route-match", 0.3, True), ("d", "direct-import", 0.95, True), ("d", "redux-chain", 0.75, True), ("d", "route-match", 0.2, True)))
    out = fusion.results(scored).collect()
    assert [(r["test"], r["rank"]) for r in out] == [("d", 1), ("a", 2), ("b", 3)]
    assert out[0]["explanation"] == f"{fusion.EXPLANATIONS['direct-import']}. {fusion.EXPLANATIONS['redux-chain']}."


def test_both_plans_agree(spark):
    own = [{"attr": "data-testid", "value": f"btn-{k}"} for k in range(3)]
    files = [entry("src/cart/CartPanel.tsx", selectors=own, action_types=["ADD_TO_CART"], imports=["src/cart/api.ts"]), entry("src/cart/api.ts"), entry("src/cart/index.ts", imports=["src/cart/CartPanel.tsx"]),
             entry("src/cart/CartPanel.test.tsx", imports=["src/cart/CartPanel.tsx"]), entry("e2e/cart/panel.cy.ts", action_types=["ADD_TO_CART"], cypress={"selectors": [{"type": "data-testid", "value": "btn-1", "raw": ""}], "describes": ["cart panel"]}),
             entry("e2e/other.cy.ts", action_types=["ADD_TO_CART"], cypress={"describes": ["cart panel"]})]
    reg, changed = registry(spark, *files), paths(spark, "src/cart/CartPanel.tsx", "src/cart/api.ts")
    a, b = ({(r["changed"], r["test"]): round(r["score"], 9) for r in impact.analyse(reg, changed, anchor_first=x).collect()} for x in (True, False))
    assert a == b and len(a) >= 2


def test_register(spark):
    S.register("always", lambda reg, changed: S.signals(changed.selectExpr("path AS changed", "'t' AS test"), "always", F.lit(0.5), F.lit("x")))
    try:
        assert "always" in {r["type"] for r in impact.all_signals(registry(spark, entry("a.ts")), paths(spark, "a.ts")).collect()}
    finally:
        S.unregister("always")
    assert "always" not in S.SCORERS
