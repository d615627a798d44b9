"""Code is searched once for what several tables hold."""

from __future__ import annotations

from ripplespark.operators import routes as RT


def test_imports_of_a_clause_are_found_in_one_reading(spark):
    content = "import React, { useState as use, type Kind } from 'react'; /* import gone from 'gone' */ import * as all from './all';"
    files = spark.createDataFrame([("a.ts", content), ("b.ts", "cy.get('x')"), ("c.ts", None)], "path string, content string")
    found = RT.bindings(files)
    assert sorted(found.collect()) == [("a.ts", "Kind", "Kind", "react"), ("a.ts", "React", "default", "react"), ("a.ts", "all", "*", "./all"), ("a.ts", "use", "useState", "react")]
    assert found._jdf.queryExecution().executedPlan().toString().count("Union") == 0
