"""Code read by a lexer: what regular expressions can't tell apart because it nests.

One pass over a file keeps a stack of what it is in: code, a template, a tag, or the children
of a tag; holes of templates and braces of JSX are code again, to any depth.  A slash after an
operand divides, elsewhere it begins a regular expression; a ``<`` after an operand compares,
elsewhere it opens a tag.  What lies between such signs, closed strings included, is taken in
one run; only its end says whether an operand came last.  A file whose tags don't close is read
once more without JSX, so a wrong guess costs a second pass and not the rest of the file.  Null
texts count as empty.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

#: Words after which an expression begins.
BEFORE_EXPRESSION = frozenset("return case default typeof instanceof in of new delete void throw else do yield await export extends".split())
KIND = StructType().add("code", StringType()).add("jsx_text", ArrayType(StringType())).add("bodies_empty", BooleanType())

_COMMENT = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
_STRING = r"""(?P<string>"(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\.)*+'?)"""
_WHOLE = r""""(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'"""
_RUN = rf"""(?P<run>(?:[^/<{{}}`"']++|{_WHOLE}|\{{(?:[^/<{{}}`"']++|{_WHOLE})*+\}})++)(?P<sign>[{{}}`])?+"""
_PLAIN = r"(?P<alone>[{}`])|(?P<other>.)"
_REGEX = r"(?P<regex>/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[A-Za-z]*)"
_ATTRIBUTES = r"""(?:[^/>"'{]++|"[^"]*+"?+|'[^']*+'?+)*+"""
_REST = rf"{_ATTRIBUTES}(?:(?P<whole>/>)|(?P<children>>)|(?P<inside>\{{))?+"
_TAG = rf"(?P<tag><(?:(?=>)|[A-Za-z_$][\w.$:-]*(?!\s*,|\s+extends\b)(?=[\s/>]))){_REST}"
_AFTER_OPERAND, _AT_START, _WITHOUT_JSX = (re.compile("|".join(p), re.S) for p in ((_RUN, _COMMENT, _STRING, _PLAIN), (_RUN, _COMMENT, _STRING, _REGEX, _TAG, _PLAIN), (_RUN, _COMMENT, _STRING, _REGEX, _PLAIN)))
_CLOSED = re.compile(_WHOLE, re.S)
_EASY = rf"""[^/"'`]++|{_WHOLE}|`(?:[^`\\$]|\\.|\$(?!\{{))*+`"""
_ONLY_EASY, _OF_EASY = re.compile(rf"(?:{_EASY}|{_COMMENT})*+", re.S), re.compile(rf"((?:{_EASY})++)|{_COMMENT}", re.S)
_LAST_WORD = re.compile(r"[\w$]+\Z")
_TEMPLATE = re.compile(r"(?:[^`\\$]++|\\.|\$(?!\{))*+(?:(?P<tick>`)|(?P<hole>\$\{)|.)?+", re.S)
_IN_TAG = re.compile(rf"{_ATTRIBUTES}(?:{_COMMENT}|(?P<empty>/>)|(?P<children>>)|(?P<hole>\{{)|.)?+", re.S)
_CHILDREN = re.compile(rf"(?P<text>[^<{{]*+)(?:(?P<leave></[^>]*>)|(?P<tag><[A-Za-z_$][\w.$:-]*|<(?=>)){_REST}|(?P<hole>\{{)|(?P<other>.))?+", re.S)
_VALUE = re.compile(r"""[^"']*+(?:"[^"]*+"?+|'[^']*+'?+)""")
# What a file's text can be in, beside code, for which the stack holds how many braces are open.
_TICKS, _TAGS, _BETWEEN = -1, -2, -3
_CALL = re.compile(r"\b(?:it|test)\s*\(|[(){}]")


class Lexed(NamedTuple):
    """A file without comments, the texts between its tags, and its code without what strings, templates and texts hold."""

    code: str
    texts: list[str]
    bare: str


def _ends_operand(run: str, before: bool) -> bool:
    """Whether an operand came last after a run; blanks leave that as it was ``before``."""
    run = run.rstrip()
    if not run:
        return before
    last = run[-1]
    if last in "\"')]":
        return True
    if last in "+-":
        return (len(run) - len(run.rstrip(last))) % 2 == 0
    word = _LAST_WORD.search(run, max(0, len(run) - 12))
    return word is not None and word[0] not in BEFORE_EXPRESSION


def lex(source: str, jsx: bool = True, with_bare: bool = True) -> Lexed:
    """A file read in one pass; ``bare`` costs a third more and stays empty without ``with_bare``.

    A step takes a run together with the sign that ends it, and a tag's attributes with its end.
    """
    code: list[str] = []
    bare: list[str] = []
    texts: list[str] = []
    stack = [0]
    templates, operand, at, copied, size = 0, False, 0, 0, len(source)
    at_start = (_AT_START if jsx else _WITHOUT_JSX).match
    after_operand, in_template, in_tag, between = _AFTER_OPERAND.match, _TEMPLATE.match, _IN_TAG.match, _CHILDREN.match
    while at < size:
        mode, begin, shown = stack[-1], at, ""
        if mode >= 0:
            found = (after_operand if operand else at_start)(source, at)
            kind, at = found.lastgroup, found.end()
            if kind == "run":
                operand = _ends_operand(found[0], operand)
                if with_bare:
                    shown = _emptied(found[0])
            elif kind == "sign" or kind == "alone":
                sign = source[at - 1]
                operand = False
                if sign == "{":
                    stack[-1] = mode + 1
                elif sign == "`":
                    if with_bare and not templates:
                        bare.append(_emptied(source[begin : at - 1]))
                    stack.append(_TICKS)
                    templates += 1
                elif mode:
                    stack[-1] = mode - 1
                elif len(stack) > 1:
                    stack.pop()
                if with_bare:
                    shown = _emptied(source[begin:at])
            elif kind == "comment":
                code += source[copied:begin], " "
                copied = at
                shown = " "
            elif kind == "string":
                shown = '""'
                operand = True
            elif kind == "regex":
                shown = "0"
                operand = True
            elif kind == "other":
                shown = found[0]
                operand = False
            else:
                operand = _open_tag(stack, kind)
                if with_bare:
                    shown = _without_values(found, kind)
        elif mode == _BETWEEN:
            found = between(source, at)
            kind, at = found.lastgroup, found.end()
            text = found["text"].split()
            if text:
                texts.append(" ".join(text))
            if kind == "leave":
                stack.pop()
                operand = True
                shown = found["leave"]
            elif kind == "hole":
                stack.append(0)
                operand = False
                shown = "{"
            elif kind == "other":
                texts.append(found["other"])
            elif kind != "text":
                operand = _open_tag(stack, kind)
                if with_bare:
                    shown = _without_values(found, kind)
        elif mode == _TAGS:
            found = in_tag(source, at)
            kind, at = found.lastgroup, found.end()
            if with_bare:
                shown = _shown_values(source[begin : found.start(kind)] if kind else found[0])
            if kind == "comment":
                code += source[copied : found.start(kind)], " "
                copied = at
                shown += " "
            elif kind:
                shown += found[kind]
                if kind == "children":
                    stack[-1] = _BETWEEN
                elif kind == "empty":
                    stack.pop()
                    operand = True
                else:
                    stack.append(0)
                    operand = False
        else:
            found = in_template(source, at)
            kind, at = found.lastgroup, found.end()
            if kind == "tick":
                stack.pop()
                templates -= 1
                operand = True
                if templates == 1:
                    bare.append('"')
                shown = '"'
            elif kind == "hole":
                stack.append(0)
                operand = False
        if with_bare and not templates:
            bare.append(shown)
    if jsx and (_TAGS in stack or _BETWEEN in stack):
        return lex(source, False, with_bare)
    code.append(source[copied:])
    return Lexed("".join(code), texts, "".join(bare) if with_bare else "")


def _open_tag(stack: list[int], kind: str) -> bool:
    """Goes into a tag as far as it was read: whole, to its children or into a hole; whether an operand came last."""
    if kind == "whole":
        return True
    stack.append(_BETWEEN if kind == "children" else _TAGS)
    if kind == "inside":
        stack.append(0)
    return False


def _emptied(run: str) -> str:
    """A run without what its strings hold."""
    return _CLOSED.sub('""', run) if '"' in run or "'" in run else run


def _shown_values(attributes: str) -> str:
    """An empty string for each value."""
    return '""' * len(_VALUE.findall(attributes)) if '"' in attributes or "'" in attributes else ""


def _without_values(found: re.Match, kind: str) -> str:
    """A tag as far as it was read, its attributes as the strings that they hold, empty."""
    last = "" if kind == "tag" else found[kind]
    return found["tag"] + _shown_values(found.string[found.end("tag") : found.end() - len(last)]) + last


def bodies_empty(bare: str) -> bool:
    """Whether there are tests, and the first braces beside every test's name hold nothing.

    bare: code without comments and without what its strings hold.  A test without braces
    of its own, or whose braces don't meet, isn't empty.
    """
    waiting: list[int] = []  # how deep in parentheses the tests are whose braces haven't come
    bodies: list[tuple[int, int]] = []
    depth, some = 0, False
    braces: list[tuple[int, bool]] = []
    for found in _CALL.finditer(bare):
        token = found[0]
        if token == "{":
            mine = bool(waiting) and waiting[-1] == depth
            if mine:
                waiting.pop()
            braces.append((found.end(), mine))
        elif token == "}":
            if braces:
                start, mine = braces.pop()
                if mine:
                    bodies.append((start, found.start()))
        elif token == ")":
            if waiting and waiting[-1] == depth:
                return False
            depth -= 1
        else:
            depth += 1
            if token != "(":
                some = True
                waiting.append(depth)
    if not some or waiting or any(mine for _, mine in braces):
        return False
    return all(not bare[a:b].strip() for a, b in bodies)


def code_and_texts(source: str, jsx: bool = True) -> tuple[str, list[str]]:
    """A file without comments, and the texts between its tags.

    Without tags and holes, and with slashes in strings and comments alone, nothing nests: one pattern takes the comments out.
    """
    if (not jsx or "<" not in source) and _ONLY_EASY.fullmatch(source):
        return _OF_EASY.sub(lambda m: m[1] or " ", source), []
    got = lex(source, jsx, False)
    return got.code, got.texts


@F.arrow_udf(KIND)
def _lexed(content: pa.Array, path: pa.Array) -> pa.Array:
    rows = []
    for text, name in zip(content.to_pylist(), path.to_pylist(), strict=True):
        got = lex(text or "", not (name or "").endswith(".ts"))
        rows.append({"code": got.code, "jsx_text": list(dict.fromkeys(got.texts)), "bodies_empty": bodies_empty(got.bare)})
    return pa.array(rows, pa.struct([("code", pa.string()), ("jsx_text", pa.list_(pa.string())), ("bodies_empty", pa.bool_())]))


@F.arrow_udf(StructType().add("code", StringType()).add("jsx_text", ArrayType(StringType())))
def _read(content: pa.Array, path: pa.Array) -> pa.Array:
    read = [code_and_texts(text or "", not (name or "").endswith(".ts")) for text, name in zip(content.to_pylist(), path.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([code for code, _ in read], pa.string()), pa.array([list(dict.fromkeys(texts)) for _, texts in read], pa.list_(pa.string()))], ["code", "jsx_text"])


_read = _read.asNondeterministic()  # so that no filter on a fact is pushed below it, where it would read every file once more


def read(content: str, path: str) -> Column:
    """(code, jsx_text) of a file, each file read once."""
    return _read(F.col(content), F.col(path))


def lexed(content: Column | str, path: Column | str | None = None) -> Column:
    """(code, jsx_text, bodies_empty) of a file; files that end with .ts hold no JSX."""
    c = F.col(content) if isinstance(content, str) else content
    return _lexed(c, F.lit("") if path is None else F.col(path) if isinstance(path, str) else path)
