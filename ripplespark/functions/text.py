"""Column expressions over names, paths, urls and route patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in file names, titles and folders.
INDEX_NAMES = ["index", "main", "default", "entry"]
GENERIC_NAMES = (
    "utils util helpers helper types type constants const config configs defaults common shared hooks styles style theme misc errors "
    "validation validators fixtures mocks queries mutations selectors actions reducers handlers data api model models service services"
).split()
LAYER_WORDS = "actions action reducers reducer selectors selector hooks hook use".split()
FILENAME_STOPWORDS = (
    "test tests spec specs it should describe when given e2e unit integration int bench stories story fixture fixtures mock mocks cy cypress "
    "page pages component components container containers the"
).split() + LAYER_WORDS
TITLE_STOPWORDS = (
    "test tests spec specs it should describe when given and or the a an of for with page pages component components view views "
    "e2e unit integration renders works shows displays handles cypress"
).split() + LAYER_WORDS
FOLDER_STOPWORDS = "test tests spec specs the of for with cy".split()
STRUCTURAL_FOLDERS = (
    "src lib app apps packages webapp channels e2e e2e-tests cypress tests test integration specs spec components pages page views containers "
    "utils helpers hooks actions reducers selectors services types constants config"
).split()
SOURCE_ENDING = r"(?i)\.(tsx?|jsx?|mts|cts|mjs|cjs|vue|svelte|astro)$"
TEST_ENDING = r"(?i)\.(cy|spec|test|e2e|int|integration|unit|bench|stories)\.(ts|js)x?$"
FOLDER_TEST_ENDING = r"(?i)\.(cy|spec|test|e2e|int|integration|unit)\.(ts|js)x?$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: Column | str) -> Column:
    """Lower-cased words of an identifier: camelCase and ACRONYMWord are cut, as is whatever is no letter or digit."""
    cut = F.regexp_replace(F.regexp_replace(_c(c), "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(cut), "[^a-z0-9]+"), lambda w: w != "")


def without(c: Column, stopwords: list[str], least: int) -> Column:
    return F.filter(c, lambda w: (F.length(w) >= least) & ~w.isin(stopwords))


def segments(path: Column | str) -> Column:
    return F.filter(F.split(_c(path), r"[\\/]+"), lambda s: s != "")


def basename(path: Column | str) -> Column:
    return F.regexp_replace(_c(path), r"^.*[\\/]", "")


def dirname(path: Column | str) -> Column:
    """The folder of a path; '.' if it has none."""
    path = _c(path)
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def normal_path(path: Column | str, root: str = "") -> Column:
    """Relative to ``root`` with forward slashes; '.' and 'x/..' are resolved."""
    parts = F.filter(F.split(F.regexp_replace(_c(path), r"\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    step = lambda kept, s: F.when((s == "..") & (F.size(kept) > 0) & (F.element_at(kept, -1) != ".."), F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(s)))
    clean = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    root = root.strip("/")
    return F.when(clean.startswith(root + "/"), F.substr(clean, F.lit(len(root) + 2))).otherwise(clean) if root else clean


def bare_name(path: Column | str, is_test: bool) -> Column:
    """The base name without its ending; for index files what follows the dot, or else the folder's name."""
    base = F.regexp_replace(basename(path), TEST_ENDING if is_test else SOURCE_ENDING, "")
    first = F.lower(F.substring_index(base, ".", 1))
    index = first.isin(INDEX_NAMES)
    return F.when(index & base.contains("."), F.regexp_replace(base, r"^[^.]*\.", "")).when(index, basename(dirname(path))).otherwise(base)


def name_tokens(path: Column | str, is_test: bool) -> Column:
    return without(words(bare_name(path, is_test)), FILENAME_STOPWORDS, 2)


def parent_tokens(path: Column | str, is_test: bool) -> Column:
    """Tokens of the folder, or of the folder above if the folder's name stands for an index file."""
    base = F.lower(F.regexp_replace(basename(path), TEST_ENDING if is_test else SOURCE_ENDING, ""))
    folder = F.when(base.isin(INDEX_NAMES), dirname(dirname(path))).otherwise(dirname(path))
    name = F.regexp_replace(folder, r"^.*/", "")
    return F.when(name.isin("", ".", "/"), F.array().cast("array<string>")).otherwise(without(words(name), FILENAME_STOPWORDS, 2))


def title_tokens(c: Column | str) -> Column:
    return F.array_distinct(without(words(c), TITLE_STOPWORDS, 3))


def title_source_tokens(path: Column | str) -> Column:
    base = F.regexp_replace(F.regexp_replace(basename(path), SOURCE_ENDING, ""), TEST_ENDING, "")
    return title_tokens(F.when(F.lower(base).isin(INDEX_NAMES), basename(dirname(path))).otherwise(base))


def feature_identity(path: Column | str) -> Column:
    """Tokens of folders that aren't merely structural; if there are none, of the base name."""
    parts = segments(path)
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    tokens = without(F.flatten(F.transform(folders, words)), FOLDER_STOPWORDS + STRUCTURAL_FOLDERS, 2)
    base = F.regexp_replace(F.regexp_replace(basename(path), FOLDER_TEST_ENDING, ""), r"(?i)\.[a-z]+$", "")
    return F.array_distinct(F.when(F.size(tokens) > 0, tokens).otherwise(without(words(base), FOLDER_STOPWORDS, 2)))


def shares_feature(a: Column, b: Column) -> Column:
    """Whether two identities overlap; where one is empty nothing can be told, which counts as yes."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


# routes --------------------------------------------------------------------------------


def visited_url(url: Column | str) -> Column:
    """A visited url without its query and a leading hash."""
    return F.regexp_replace(F.regexp_replace(_c(url), r"(?s)\?.*$", ""), "^/?#", "")


def route_body(pattern: Column | str) -> Column:
    """The pattern as a regular expression: ':name' is one segment, '*' anything."""
    escaped = F.regexp_replace(_c(pattern), r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.regexp_replace(F.regexp_replace(escaped, ":([A-Za-z_][A-Za-z0-9_]*)", "[^/]+"), r"\*", ".*")


def route_specificity(pattern: Column | str) -> Column:
    """The share of segments that are literal."""
    parts = F.filter(F.split(_c(pattern), "/"), lambda s: s != "")
    literal = F.filter(parts, lambda s: ~s.isin("*", "**") & ~s.startswith(":"))
    return F.when(F.size(parts) == 0, F.lit(0.0)).otherwise(F.size(literal) / F.size(parts))


def is_dynamic(pattern: Column | str) -> Column:
    return _c(pattern).contains(":") | _c(pattern).contains("*")


def route_block(path: Column | str, pattern: bool) -> Column:
    """A key that a url shares with the patterns that can match it: the first segment if it is literal."""
    first = F.element_at(F.concat(F.filter(F.split(_c(path), "/"), lambda s: s != ""), F.array(F.lit(""))), 1)
    return F.when(first.contains(":") | first.contains("*") | ~_c(path).startswith("/"), F.lit("")).otherwise(first) if pattern else first


# selectors -----------------------------------------------------------------------------

_ATTRIBUTE_SELECTOR = r"""(?i)^\s*\[\s*(data-[a-z][a-z0-9-]*)\s*=\s*["']?([^"'\]\s]+)["']?\s*\]\s*$"""


def normal_selector(kind: Column | str, value: Column | str) -> Column:
    """(type, value) of a test's selector, whole attribute selectors unwrapped; null for ids, classes and others."""
    kind, value = _c(kind), _c(value)
    attr = F.lower(F.regexp_extract(value, _ATTRIBUTE_SELECTOR, 1))
    make = lambda t, v: F.struct(t.alias("type"), v.alias("value"))
    return (
        F.when(value.isNull() | (value == ""), F.lit(None))
        .when(kind.isin("data-testid", "data-cy"), make(kind, value))
        .when(attr == "data-cy", make(F.lit("data-cy"), F.regexp_extract(value, _ATTRIBUTE_SELECTOR, 2)))
        .when(attr != "", make(F.lit("data-testid"), F.regexp_extract(value, _ATTRIBUTE_SELECTOR, 2)))
    )


# display -------------------------------------------------------------------------------


def short_path(path: Column | str) -> Column:
    """The last two parts after an ellipsis, if the path has more than three."""
    parts = F.split(F.regexp_replace(_c(path), r"\\", "/"), "/")
    return F.when(F.size(parts) > 3, F.concat(F.lit("…/"), F.array_join(F.slice(parts, -2, 2), "/"))).otherwise(_c(path))


def elapsed(ms: Column | str) -> Column:
    """Milliseconds in whole seconds, as '12s' or '2m 5s'."""
    total = F.floor(_c(ms) / 1000 + 0.5)
    seconds = F.concat((total % 60).cast("string"), F.lit("s"))
    return F.when(total >= 60, F.concat(F.floor(total / 60).cast("string"), F.lit("m "), seconds)).otherwise(seconds)


def wrapped(text: Column | str, width: int) -> Column:
    """The text's lines when words are wrapped at ``width``; a longer word has a line of its own."""
    fits = lambda lines, w: F.length(F.element_at(lines, -1)) + F.length(w) + 1 <= width
    join = lambda lines, w: F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.concat(F.element_at(lines, -1), F.lit(" "), w)))
    step = lambda lines, w: F.when(F.size(lines) == 0, F.array(w)).when(fits(lines, w), join(lines, w)).otherwise(F.concat(lines, F.array(w)))
    return F.aggregate(F.filter(F.split(_c(text), r"\s+"), lambda w: w != ""), F.array().cast("array<string>"), step)
