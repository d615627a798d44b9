"""The lexer on what nests: templates, JSX, regular expressions, comments, and bodies of tests."""

from __future__ import annotations

import pytest

from ripplespark.operators import lexer as L
from ripplespark.operators import rerank as R


@pytest.mark.parametrize(("source", "code"), [
    ("a /* b */ c // d\ne", "a   c  \ne"),
    ("const glob = 'src/**/*.ts'; // all\nconst more = \"/* no comment */\"", "const glob = 'src/**/*.ts';  \nconst more = \"/* no comment */\""),
    ("const u = `http://x/${a ? `//${b /* c */}` : '//d'}`; // e", "const u = `http://x/${a ? `//${b  }` : '//d'}`;  "),
    ("const r = /['\"`/*]\\/\\/[/*]/g; x = a / b // c\n/ d", "const r = /['\"`/*]\\/\\/[/*]/g; x = a / b  \n/ d"),
    ("<p>Don't // cut</p>; // cut", "<p>Don't // cut</p>;  "),
    ("<A b={/* c */ d} // e\n/>", "<A b={  d}  \n/>"),
    ("/* open", " "), ("", ""), ("'open\nx // y", "'open\nx  "), ("`open ${ x", "`open ${ x"), ("}}} // x", "}}}  "),
])
def test_comments_and_nothing_else_go(source, code):
    assert L.lex(source).code == code


@pytest.mark.parametrize(("source", "texts"), [
    ("return <p>Hello {name}, you have <b>{n > 1 ? 'many' : <i>one</i>}</b> new mails</p>", ["Hello", ", you have", "one", "new mails"]),
    ("x = <><A on={() => a > b && <B>in a prop</B>}>two\n   lines</A> tail</>", ["in a prop", "two lines", "tail"]),
    ("if (a < b && c > d) { e = <T extends X>(f: T) => f; g = <T,>(h: T) => h }", []),
    ("useState<Foo>(1); const y = a <b> c", []),
    ("const s = `<p>${ok ? <q>deep</q> : `<r>no</r>`}</p>`", ["deep"]),
    ("x = <a title='1 > 0'>it's</a>; y = '<p>no</p>'", ["it's"]),
])
def test_texts_between_tags(source, texts):
    assert L.lex(source).texts == texts


def test_tags_that_never_close_are_no_tags():
    got = L.lex("const a = <Foo>bar; // gone\nconst b = 'x' // gone")
    assert got.texts == [] and "gone" not in got.code


@pytest.mark.parametrize(("source", "empty"), [
    ("it('a', () => {})", True), ("it(`a ${f({b: (1)})}`, async ({ page }, x = (1, (2))) => { /* } */ // {\n })", True),
    ("it('a', () => { run() })", False), ("it('a', () => {}); test('b', () => { '' })", False), ("it('a (((', () => { /* x */ }); test('b {', function () {})", True),
    ("it('a', { retries: 2 }, () => {})", False), ("it('a')", False), ("it('a', () => run())", False), ("it('a', () => {", False), ("describe('a', () => {})", False), ("", False),
    ("describe('d', () => { it('a', () => {}); it('b', () => { }) })", True), ("it('a', () => { it('b', () => {}) })", False), ("it('a', () => { ` ` })", False), ("it('a', () => { /}/ })", False),
])
def test_bodies_by_braces(spark, source, empty):
    assert L.bodies_empty(L.lex(source).bare) is empty


def test_as_columns(spark):
    rows = [("a.tsx", "x = <p>One</p> // c"), ("b.ts", "x = <Foo>one; y = <Foo>two</Foo> // c"), ("c.cy.js", "it('a', ((x) => ((y) => { })))"), ("d.tsx", None), (None, "it('e', () => {})")]
    files = spark.createDataFrame(rows, "path string, content string")
    got = {r["path"]: r for r in files.select("path", L.lexed("content", "path").alias("l"), R.bodies_empty(files["content"]).alias("e")).select("path", "l.*", "e").collect()}
    assert got["a.tsx"]["jsx_text"] == ["One"] and got["b.ts"]["jsx_text"] == [] and got["a.tsx"]["code"].endswith("</p>  ")
    assert (got["d.tsx"]["code"], got["d.tsx"]["jsx_text"], got["d.tsx"]["e"]) == ("", [], False) and got[None]["e"] is True


def test_time_grows_with_the_text():
    deep = "`${" * 20000 + "1" + "}`" * 20000
    assert L.lex(deep).code == deep
    wide = "<p>" * 20000 + "x" + "</p>" * 20000
    assert L.lex(wide).texts == ["x"]
    assert L.bodies_empty("it('', () => {" * 20000) is False
