"""A registry for one kind of evidence looks for the facts which that reads, and finds them as a whole one does."""

from __future__ import annotations

from ripplespark.operators import extract as E

CODE = "describe('x', () => { cy.visit('/a'); cy.get('#b'); cy.intercept('/api/c'); });\nclass D {} dispatch(go());"


def test_only_wanted_facts_are_looked_for(spark):
    files = spark.createDataFrame([("r", "a.ts", CODE, "source"), ("r", "a.cy.ts", CODE, "test")], "repo_root string, path string, content string, type string")
    whole, some = E.extract(files), E.extract(files, ("cypress.visited_routes", "classes"))
    assert some.schema.simpleString() == whole.schema.simpleString()
    for a, b in zip(whole.orderBy("path").collect(), some.orderBy("path").collect(), strict=True):
        assert (a["path"], a["type"], a["classes"]) == (b["path"], b["type"], b["classes"]) and a["redux"] is not None and b["redux"] is None
        if a["type"] == "test":
            assert b["cypress"]["visited_routes"] == a["cypress"]["visited_routes"] == ["/a"] and b["cypress"]["selectors"] is None and a["cypress"]["selectors"]
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "useSelector" not in plan and "dispatch" not in plan
