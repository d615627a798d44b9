"""Code of many files: read once, by all tasks, and as the lexer reads it whichever way it takes."""

from __future__ import annotations

import pytest

from ripplespark import catalog
from ripplespark.operators import lexer as L


@pytest.mark.parametrize("name", ["extracted_titles", "extracted_intercepts", "extracted_url_assertions", "extracted_exports", "extracted_declarations", "extracted_redux_usage", "text_index", "extracted_translation_keys", "extracted_action_types", "extracted_action_constants", "extracted_selectors", "lexed_texts"])
def test_files_are_read_once_and_by_several_tasks(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "RoundRobinPartitioning" in plan


@pytest.mark.parametrize("source", [
    "a +++ /x/ // c", "i++ / 2 / 3 // c", "return /['\"]/ // c", "returns / 2 / 3 // c", "{ a } /x'/ // c", "f('a') / g('/* b') /* c */", "'open\n/* c */ x", "`a ${b /* c */}` // d", "`/* a */` // 'b",
    "cy.intercept('/api/*'); // it's\nx", "/* open 'x", "",
])
def test_the_short_way_gives_what_the_lexer_gives(source):
    got = L.lex(source, False)
    assert L.code_and_texts(source, False) == (got.code, got.texts) and "c */" not in got.code


def test_plain_code_takes_few_steps(monkeypatch):
    taken = []
    monkeypatch.setattr(L, "_ends_operand", lambda run, before: taken.append(run) or False)
    L.lex("const total = one + two * (three - four); call(total, 'x', \"y\");\n" * 100, False)
    assert len(taken) == 1
