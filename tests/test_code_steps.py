"""What reading the code of many files costs: few steps a tag, each fact found once."""

from __future__ import annotations

import pytest

from ripplespark import catalog
from ripplespark.operators import extract as E
from ripplespark.operators import lexer as L


class _Counted:
    def __init__(self, pattern, taken):
        self.pattern, self.taken = pattern, taken

    def match(self, text, at):
        self.taken.append(at)
        return self.pattern.match(text, at)


def test_an_element_takes_two_steps(monkeypatch):
    taken = []
    for name in ("_AFTER_OPERAND", "_AT_START", "_IN_TAG", "_CHILDREN", "_TEMPLATE"):
        monkeypatch.setattr(L, name, _Counted(getattr(L, name), taken))
    code, texts = L.code_and_texts("const x = <ul>" + "<li id='a' className=\"b > c\">some text</li>" * 100 + "</ul>;")
    assert texts == ["some text"] * 100 and code.count("<li") == 100
    assert len(taken) <= 210


@pytest.mark.parametrize(("source", "texts"), [
    ("x = <A b=\"y>z\" c='}'>t // u</A>; // c */", ["t // u"]), ("x = <A /* c */ b={<i>in</i>} />; /* c */ y", ["in"]), ("x = <><A b />one<br/>two < {three}</>", ["one", "two", "<"]),
    ("x = <A b={`${<i>hole</i>}`} // c */\n>t</A>", ["hole", "t"]), ("x = <A b='open", []), ("f(a < b, '<i>no</i>')", []),
])
def test_tags_are_read_to_their_end(source, texts):
    got = L.lex(source)
    assert got.texts == texts and "c */" not in got.code
    assert L.code_and_texts(source) == (got.code, got.texts)


def test_constants_of_a_file_are_found_once(spark):
    plan = catalog.QUERIES["extracted_action_constants"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("map_from_entries") == 1


def test_declarations_and_constants_begin_with_a_word(spark):
    content = "class A {} subclass B; éclass C {} class\nclass D\nfunction* f() {} myfunction g; interface\tI {} export const A_B = 'my/A_B'; reexport const C_D = 'my/C_D'; export const E_F = 'e';"
    files = spark.createDataFrame([("r", "a.ts", content, "source"), ("r", "b.ts", None, "source")], "repo_root string, path string, content string, type string")
    got = E.extract(files).select("path", "classes", "functions", "interfaces", "action_type_consts").orderBy("path").collect()
    assert [tuple(r) for r in got] == [("a.ts", ["A", "class"], ["f"], ["I"], {"A_B": "my/A_B"}), ("b.ts", [], [], [], {})]
