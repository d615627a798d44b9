"""Personal data by weak supervision, in DataFrame functions only.

Patterns find candidates of every kind in each whole text.  Labelers of three sorts vote on
each: its shape, a gazetteer, and the words around it; a vote is 1, -1 or 0 (no opinion).
Expectation-maximisation over the counts of vote patterns, of which there are at most
``len(KINDS) * 3 ** len(LABELERS)``, estimates how reliable each labeler is and how likely
each pattern means personal data.  These posteriors are the soft labels of the final span
classifier, a naive Bayes model over kind, shape and neighbouring words, which sees no votes
and so also judges candidates that no labeler had an opinion on.

Base kinds (email, ip, card, phone) are always reported; candidates of further kinds are if
the classifier gives them ``KEEP`` or more and they overlap no base span.

A pattern's matches are found by one replacement that puts a mark on either side of each,
and a split at the marks; what stands between gives offsets as a running sum over a text's
matches, which is a window over small rows.  Nested repetitions are avoided: separators
inside a match are first turned into a mark of their own, so that each pattern is a run of
one character class, linear and without recursion in texts of any length.

Null texts count as empty and have no spans.  Repeated rows and rows of the same or a null
id are kept and scanned each.  Columns other than id and text are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tables

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("ssn", "iban", "national", "person", "born")
KINDS = (*BASE_KINDS, *MORE_KINDS)
LABELERS = ("shape", "gazetteer", "context", "denial", "edge")
#: Least score of a reported span of a further kind.
KEEP = 0.5
ROUNDS = 25
BUCKETS = 1024
CONTEXT = 48

_INNER, _EDGE, _FREE = "\x01", "\x02", "\x03"  # the first two are turned into the third in texts

#: Gazetteers: top-level domains, country codes of phones and bank accounts, given names, titles.
DOMAINS = "com org net edu gov mil int info biz io co de fr es it nl pt pl se no dk fi at ch be uk ie us ca mx br ar cl au nz jp cn kr in ru ua cz gr tr za eu".split()
DIALS = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
BANKS = "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split()
NAMES = (
    "Alice Andrew Anna Anne Antonio Barbara Carlos Charles Christine Daniel David Elena Elizabeth Emily Emma Erik Eva Felix Francesca Francisco George Hannah Hans Helen Henry "
    "Isabel James Jean Jennifer John Jorge Joseph Juan Julia Karen Karl Katharina Laura Linda Lisa Louis Lucas Lukas Manuel Marco Maria Marie Mark Martin Mary Michael Miguel Monika "
    "Nicolas Nina Olivia Patricia Paul Pedro Peter Pierre Richard Robert Sandra Sarah Sofia Sophie Stefan Stephen Susan Thomas Ursula William"
).split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Mme Monsieur Madame Sr Sra".split()
#: Words before a span that speak for its kind.
WORDS = {
    "email": "mail|e-mail|contact|write|address|reach",
    "ip": "ip|host|server|address|login|from|client|peer",
    "card": "card|visa|mastercard|amex|credit|debit|payment|pay",
    "phone": "phone|tel|call|mobile|cell|fax|whatsapp|contact",
    "ssn": "ssn|social|security|taxpayer|tin",
    "iban": "iban|account|bank|konto|compte|cuenta|transfer",
    "national": "phone|tel|call|mobile|cell|fax|contact",
    "person": "name|named|mr|mrs|ms|dr|dear|signed|by|patient|employee",
    "born": "born|birth|birthday|dob|geboren|naissance|nacimiento",
}
#: Words before a number that say that it is something else.
DENIALS = "version|v|release|isbn|issn|sku|invoice|order|serial|part|model|figure|fig|table|page|chapter|section|build|id"


def _mark(text: Column, pattern: str) -> Column:
    """The text split so that every second piece is a match."""
    return F.split(F.regexp_replace(text, pattern, f"{_EDGE}$0{_EDGE}"), _EDGE)


def _pieces(kind: str, text: Column, dotted: Column, joined: Column) -> tuple[Column, Column]:
    """A cheap test that a text may have matches of the kind, and the pieces around them."""
    local = "A-Za-z0-9._%+\\x01-"
    names, titles = "|".join(NAMES), "|".join(TITLES)
    digit = F.col("digits")
    return {
        # The start of a run, or where the last match has ended: no other place in a run can be leftmost.
        "email": (text.contains("@"), _mark(dotted, rf"(?:\G|(?<![{local}]))[{local}]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++")),
        "ip": (digit & text.contains("."), _mark(text, r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")),
        "card": (digit, _mark(joined, r"[0-9][0-9\x01]{12,}+")),  # fewer are no 13 digits
        "phone": (digit & text.contains("+"), _mark(text, r"\+[0-9][\x20().0-9-]+[0-9]")),
        "ssn": (digit & text.contains("-"), _mark(text, r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")),
        "iban": (digit, _mark(text, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
        "national": (digit, _mark(text, r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9A-Za-z-])")),
        "person": (F.lit(True), _mark(text, rf"\b(?=[A-Z])(?:(?:{titles})\.?\x20[A-Z][a-z]{{1,30}}(?:\x20[A-Z][a-z]{{1,30}})?|(?:{names})\x20[A-Z][a-z]{{1,30}})\b")),
        "born": (digit, _mark(text, r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9./-])")),
    }[kind]


_FOUND = "array<struct<kind:string,before:int,size:int,value:string,left:string,right:string>>"


def _matches(kind: str) -> Column:
    """The matches in a column of pieces."""
    piece = lambda k: F.get(F.col(kind), k)
    restored = lambda part: F.translate(part, _INNER, "." if kind == "email" else " ")
    each = lambda k: F.struct(
        F.lit(kind).alias("kind"), F.length(piece(2 * k)).alias("before"), F.length(piece(2 * k + 1)).alias("size"), restored(piece(2 * k + 1)).alias("value"),
        restored(F.right(piece(2 * k), F.lit(CONTEXT))).alias("left"), restored(F.left(piece(2 * k + 2), F.lit(CONTEXT))).alias("right"),
    )
    last = F.floor((F.size(kind) - 3) / 2).cast("int")
    return F.when(F.size(kind) > 1, F.transform(F.sequence(F.lit(0), last), each)).otherwise(F.array()).cast(_FOUND)


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: a row number, its id, and all matches with the characters before each, in order by kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = F.when(text.contains(_INNER) | text.contains(_EDGE), F.translate(text, _INNER + _EDGE, _FREE * 2)).otherwise(text)
    df = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digits", F.col("text").rlike("[0-9]"))
    text = F.col("text")
    dotted = F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _INNER)
    joined = F.regexp_replace(text, r"(?<=[0-9])[\x20-](?=[0-9])", _INNER)
    for kind in KINDS:
        hint, pieces = _pieces(kind, text, dotted, joined)
        df = df.withColumn(kind, F.when(hint, pieces))
    return df.select(F.monotonically_increasing_id().alias("row"), "id", F.concat(*(_matches(k) for k in KINDS)).alias("found"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled, nine subtracted beyond nine; the sum ends in 0."""
    places = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda k: F.substring(F.reverse(digits), k, F.lit(1)).cast("int") * (2 - k % 2))
    return F.aggregate(places, F.lit(0), lambda total, d: total + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _iban(value: Column) -> Column:
    """The number that the account with its first four characters last stands for leaves 1 when divided by 97."""
    bare = F.translate(value, " ", "")
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))
    code = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda total, c: F.when(c == "", total).otherwise((total * F.when(c.rlike("[0-9]"), 10).otherwise(100) + code(c)) % 97))
    return rest == 1


def valid(kind: Column, value: Column) -> Column:
    """What a match of a kind must fulfil besides its pattern."""
    size = F.length(_digits(value))
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (
        F.when(kind == "ip", value.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$"))
        .when(kind == "card", F.when(size.between(13, 19), _luhn(_digits(value))).otherwise(False))
        .when(kind == "phone", size.between(9, 15))
        .otherwise(True)
    )


def votes(spans: DataFrame) -> DataFrame:
    """Adds a vote of every labeler to rows of kind, value, left and right."""
    kind, value, left, right = (F.col(c) for c in ("kind", "value", "left", "right"))
    by_kind = lambda cases: F.coalesce(*(F.when(kind == k, c) for k, c in cases.items()))
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    shape = by_kind({
        "email": value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[^@]+\.[A-Za-z]{2,24}$"),
        "ip": value.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$"),
        "card": value.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"),
        "phone": ~value.rlike(r"[().-]{4,}|\.\.|--|\x20\x20"),
        "ssn": ~value.rlike("^(?:000|666|9)|-00-|-0000$"),
        "iban": _iban(value),
        "national": value.rlike(r"^\(?[2-9][0-9]{2}\)?[.\x20-]?[2-9]"),
        "person": value.rlike(r"^(?:\S+\.? )?[A-Z][a-z]{2,19} [A-Z][a-z]{2,19}$"),
        "born": value.rlike(r"^(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[./](?:0?[1-9]|1[0-2])[./](?:19|20)[0-9]{2})$"),
    })
    gazetteer = by_kind({
        "email": F.lower(F.substring_index(value, ".", -1)).isin(DOMAINS),
        "ip": ~value.rlike(r"^(?:0|10|127|22[4-9]|2[3-5][0-9])\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\."),
        "card": _digits(value).rlike("^(?:4|5[1-5]|2[2-7]|3[4-7]|6)"),
        "phone": _digits(value).rlike("^(?:" + "|".join(DIALS) + ")"),
        "iban": F.substring(value, 1, 2).isin(BANKS),
        "person": value.rlike(r"(?:^|\s)(?:" + "|".join(NAMES) + r")\s"),
    })
    before = F.lower(left)
    said = by_kind({k: before.rlike(rf"(?:^|[^a-z])(?:{words})[^a-z]") for k, words in WORDS.items()})
    denied = F.when(kind.isin("person", "email"), F.lit(False)).otherwise(before.rlike(rf"(?:^|[^a-z])(?:{DENIALS})[^a-z0-9]{{1,3}}$"))
    embedded = left.rlike("[A-Za-z0-9_.=/-]$") | right.rlike("^(?:[A-Za-z0-9_=/]|[.-][A-Za-z0-9])")
    yes_no = lambda c: F.coalesce(F.when(c, 1).when(~c, -1), F.lit(0))
    return spans.withColumns({
        "shape": yes_no(shape), "gazetteer": yes_no(gazetteer), "context": F.when(said, 1).otherwise(0), "denial": F.when(denied, -1).otherwise(0), "edge": F.when(embedded, -1).otherwise(1),
    })


def learned(counts: Sequence[Mapping], rounds: int = ROUNDS) -> tuple[list[dict], dict[str, dict[int, tuple[float, float]]]]:
    """Posteriors of vote patterns, and what each labeler says of either class.

    counts: kind, the labelers' votes and n, one for each pattern that occurs; their number is
    bounded by what patterns there are.  Starts from the majority of votes.  The second result
    gives, by labeler and vote, its probability on what is personal data and on what isn't.
    """
    weigh = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
    posts = [weigh(1.5 * sum(c[v] for v in LABELERS)) for c in counts]
    tables_: dict[str, dict[int, tuple[float, float]]] = {}
    for _ in range(rounds):
        prior, tables_ = {}, {}
        for kind in KINDS:
            own = [(c["n"], p) for c, p in zip(counts, posts, strict=True) if c["kind"] == kind]
            prior[kind] = (sum(n * p for n, p in own) + 1) / (sum(n for n, _ in own) + 2)
        yes, no = (sum(c["n"] * q for c, q in zip(counts, qs, strict=True)) for qs in (posts, [1 - p for p in posts]))
        for v in LABELERS:
            tables_[v] = {}
            for vote in (-1, 0, 1):
                told = [(c["n"], p) for c, p in zip(counts, posts, strict=True) if c[v] == vote]
                # A labeler is taken to be right more often than not, which keeps the classes from changing places.
                tables_[v][vote] = ((sum(n * p for n, p in told) + 1 + (vote > 0)) / (yes + 4), (sum(n * (1 - p) for n, p in told) + 1 + (vote < 0)) / (no + 4))
        posts = [weigh(math.log(prior[c["kind"]] / (1 - prior[c["kind"]])) + sum(math.log(tables_[v][c[v]][0] / tables_[v][c[v]][1]) for v in LABELERS)) for c in counts]
    return [{"kind": c["kind"], **{v: c[v] for v in LABELERS}, "p": p} for c, p in zip(counts, posts, strict=True)], tables_


def _small(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of rows that the plan itself holds."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def features(spans: DataFrame) -> DataFrame:
    """Adds the classifier's features, each a number below ``BUCKETS``; none looks at votes."""
    value, left, right = (F.col(c) for c in ("value", "left", "right"))
    bucket = lambda *cols: F.pmod(F.xxhash64(*cols), F.lit(BUCKETS)).cast("int")
    form = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), "[a-z]+", "a"), "[A-Z]+", "A")
    return spans.withColumns({
        "f0": bucket(F.left(form, F.lit(24))), "f1": bucket(F.lower(F.regexp_extract(left, r"([\p{L}]+)[^\p{L}]*$", 1))), "f2": bucket(F.lower(F.regexp_extract(right, r"^[^\p{L}]*([\p{L}]+)", 1))),
        "f3": bucket(F.right(left, F.lit(1)).rlike("[A-Za-z0-9_=/.-]"), F.left(right, F.lit(1)).rlike("[A-Za-z0-9_=/]")), "f4": bucket(F.length("value")),
    })


SLOTS = ("f0", "f1", "f2", "f3", "f4")


def scored(spans: DataFrame, soft: DataFrame) -> DataFrame:
    """Adds ``score``: naive Bayes over the features of each kind, learned from all spans with posteriors ``p`` by vote pattern.

    A bucket's evidence is how its odds differ from those of its kind, and it is drawn towards
    these by as much as one span.
    """
    taught = features(spans).join(F.broadcast(soft), ["kind", *LABELERS])
    logit = lambda yes, no: F.log(yes) - F.log(no)
    # At most len(KINDS) rows, and len(KINDS) * len(SLOTS) * BUCKETS.
    kinds = tables.saved(taught.groupBy("kind").agg(((F.sum("p") + 0.5) / (F.count("*") + 1)).alias("rate")), "pii-kinds")
    seen = taught.select("kind", "p", F.posexplode(F.array(*SLOTS)).alias("slot", "bucket")).groupBy("kind", "slot", "bucket").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    rate = F.col("rate")
    model = tables.saved(seen.join(F.broadcast(kinds), "kind").select("kind", "slot", "bucket", (logit(F.col("yes") + rate, F.col("no") + 1 - rate) - logit(rate, 1 - rate)).alias("odds")), "pii-model")
    out = features(spans).join(F.broadcast(kinds), "kind")
    for k, slot in enumerate(SLOTS):
        own = model.where(F.col("slot") == k).select("kind", F.col("bucket").alias(slot), F.col("odds").alias(f"o{k}"))
        out = out.join(F.broadcast(own), ["kind", slot], "left")
    total = logit(rate, 1 - rate) + sum((F.col(f"o{k}") for k in range(len(SLOTS))), F.lit(0.0))
    return out.select(*spans.columns, (1 / (1 + F.exp(-total))).alias("score"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """Rows (id, spans), one for each row of ``df``.

    spans: kind, start and end (code points, end exclusive), base, score and value, by kind as
    listed in ``KINDS``, then by start.  Scores of base spans are the classifier's, too, but
    decide nothing.
    """
    spark = df.sparkSession
    found = tables.saved(candidates(df, id_col, text_col), "pii-matches")
    run = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    each = found.where(F.size("found") > 0).select("row", F.posexplode("found").alias("n", "c")).select("row", "n", "c.*").repartition("row")
    each = each.withColumn("end", F.sum(F.col("before").cast("long") + F.col("size")).over(run)).withColumn("start", F.col("end") - F.col("size"))
    each = votes(each.where(valid(F.col("kind"), F.col("value"))).withColumn("base", F.col("kind").isin(*BASE_KINDS)))
    each = tables.saved(each.select("row", "kind", "start", "end", "base", "value", "left", "right", *LABELERS), "pii-spans")
    counts = each.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")).collect()
    soft, _ = learned([c.asDict() for c in counts])
    judged = scored(each, _small(spark, soft, "kind string, " + ", ".join(f"{v} int" for v in LABELERS) + ", p double"))
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy("start", "end").rowsBetween(1, Window.unboundedFollowing)
    covered = F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(after) < F.col("end"), F.lit(False))
    order = F.array_position(F.lit(list(KINDS)), F.col("kind"))
    span = F.struct(order.alias("k"), "start", "kind", "end", "base", "score", "value")
    kept = judged.repartition("row").withColumn("covered", covered).where(F.col("base") | (~F.col("covered") & (F.col("score") >= keep)))
    kept = kept.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    spans = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["score"].alias("score"), s["value"].alias("value")))
    kept = kept.select("row", spans.alias("spans"))
    none = F.array().cast(kept.schema["spans"].dataType)
    some = found.where(F.size("found") > 0).select("row", "id").join(kept, "row", "left").select("id", F.coalesce("spans", none).alias("spans"))
    return some.unionByName(found.where(F.size("found") == 0).select("id", none.alias("spans"))).withColumnRenamed("id", id_col)


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What ``scan`` gives, as counts, a digest of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scanned.select(
        id_col, *(count(k) for k in BASE_KINDS), F.sha2(text(F.filter("spans", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_more"),
    )
