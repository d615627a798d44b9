"""Only pairs that can be among a file's best are written out, and the best are those of all pairs."""

from __future__ import annotations

import random

from ripplespark.operators import scorers as S
from ripplespark.plans import impact

from .helpers import entry, paths, registry

CREATED = 1_700_000_000


def held(*values: str) -> list:
    return [{"attr": "data-testid", "value": v} for v in values]


def selector(*values: str) -> dict:
    return {"selectors": [{"type": "data-testid", "value": v, "raw": v} for v in values]}


def test_pairs_that_selectors_alone_tie_are_not_written_out_where_importers_fill_the_list(spark):
    sources = [entry(f"src/a{k}.ts", selectors=held("save")) for k in range(3)]
    importers = [entry(f"e2e/i{k}.cy.ts", imports=["src/a0.ts", "src/a1.ts"], cypress=selector("save")) for k in range(12)]
    users = [entry(f"e2e/u{k}.cy.ts", cypress=selector("save")) for k in range(20)]
    others = [entry(f"e2e/o{k}.cy.ts") for k in range(400)] + [entry(f"src/b{k}.ts") for k in range(30)]
    reg = registry(spark, *sources, *importers, *users, *others).stored()
    changed = paths(spark, *(s["path"] for s in sources))
    got = {(r["changed"], r["test"]) for r in impact.anchored_signals(reg, changed, 10).collect()}
    assert {t for c, t in got if c in ("src/a0.ts", "src/a1.ts")} == {t["path"] for t in importers}
    assert {t for c, t in got if c == "src/a2.ts"} == {t["path"] for t in importers + users}


def test_the_best_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(11)
    words = ["save", "send", "open", "list", "sender"]
    sources = [entry(f"src/{'index' if k == 4 else 'a'}{k}.ts", selectors=held(*rng.sample(words, rng.randrange(3)))) for k in range(8)] + [entry("src/router.ts", selectors=held("save"))]
    tests = [entry(f"e2e/t{k}.cy.ts", imports=[s["path"] for s in sources if rng.random() < 0.25], cypress=selector(*rng.sample(words, rng.randrange(3)))) for k in range(60)]
    others = [entry(f"e2e/o{k}.cy.ts") for k in range(600)]
    history = spark.createDataFrame([("", f["path"], CREATED + 86400 * at, CREATED + 86400 * (at + 20), [(CREATED + 86400 * at, 1), (CREATED + 86400 * (at + 20), 1)]) for f in sources + tests for at in [rng.randrange(60)]], "repo string, path string, created_at bigint, updated_at bigint, commits array<struct<ts:bigint,size:int>>")
    changed = paths(spark, *(s["path"] for s in sources))
    reg = registry(spark, *sources, *tests, *others, history=history, config={"scoring": {"max_results": 3, "ubiquity_threshold": 0.2}}).stored()
    every = [r for r in impact.analyse(reg, changed, all_results=True).collect() if r["rank"] <= 3]
    assert sorted(map(str, impact.analyse(reg, changed).collect())) == sorted(map(str, every)) and every


def test_a_registered_scorer_may_weigh_anything(spark):
    reg = registry(spark, entry("src/a.ts"))
    assert S.least_doubt(reg, ["usage-site"]) == 1 - S.WEIGHTS["usage-site"]
    S.register("usage-site", lambda reg, changed: S.usage_site(reg, changed))
    try:
        assert S.least_doubt(reg, ["usage-site"]) == 0
    finally:
        S.register("usage-site", S.usage_site)
