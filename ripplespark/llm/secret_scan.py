"""Secret scans: patterns find candidates, their spread over the corpus tells examples from live ones.

One pass finds candidates in every whole text.  The three base kinds always count.  For
the other kinds, and as a verdict on the base ones, the hash of each candidate's value is
counted by distinct repositories and distinct owners over the whole corpus: a value that
many owners hold was copied from documentation, one that few hold looks live, in however
many of their repositories it stands.  Only hashes, places and owners are shuffled, never texts or values.

Null texts count as empty.  A null owner or repository counts as one of its own.
Repeated rows are each scanned; their values are counted once for each repository.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables

#: A value with more owners than this is a copied example.
MAX_OWNERS = 3

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{32,}")  # a run of 32 or more is always a whole run
BASE_KINDS = ("assign", "access", "hex")
#: Further kinds: a literal that must be in the text, and the pattern.
MORE_KINDS = {
    "github": ("gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    "google": ("AIza", re.compile(r"AIza[0-9A-Za-z_-]{35}")),
    "jwt": ("eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")),
    "private_key": ("PRIVATE KEY-----", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]+-----END [A-Z ]*PRIVATE KEY-----")),
    "slack": ("xox", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    "stripe": ("_live_", re.compile(r"[rs]k_live_[A-Za-z0-9]{16,}")),
    "url_login": ("://", re.compile(r"(?<=://)[A-Za-z0-9._-]+:[^\s:/@]{6,}(?=@)")),
}
#: Runs that may be keys without a known form must mix letters and digits and be this random.
_RUN = re.compile(r"(?a:\b[A-Za-z0-9_]{24,}\b)")
RUN_BITS = 3.5
KINDS = (*BASE_KINDS, *MORE_KINDS, "random")


def bits(text: str) -> float:
    """Entropy of the text's characters."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def base_candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base kinds, each leftmost and without overlaps in its kind."""
    found = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(h in low for h in _HINTS):
            found += [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]
    return found


class Taken:
    """Places that spans of a text cover, as ranges in order that don't touch the same character."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.add(spans)

    def add(self, spans: list[tuple[int, int]]) -> None:
        ends: list[int] = []
        starts: list[int] = []
        for a, b in sorted([*zip(getattr(self, "starts", ()), getattr(self, "ends", ()), strict=True), *spans]):
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        self.starts, self.ends = starts, ends

    def free(self, a: int, b: int) -> bool:
        k = bisect.bisect_right(self.ends, a)
        return k == len(self.starts) or self.starts[k] >= b


def more_candidates(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Candidates of further kinds that overlap no base one and none before them."""
    taken, found = Taken([(a, b) for _, a, b, _ in base]), []
    patterns = [(kind, p) for kind, (hint, p) in MORE_KINDS.items() if hint in text]
    for kind, pattern in [*patterns, ("random", _RUN)]:
        new = []  # of one pattern, so without overlaps
        for m in pattern.finditer(text):
            value = m[0]
            if kind == "random" and (value.isalpha() or value.isdigit() or bits(value) < RUN_BITS or not any(c.isdigit() for c in value)):
                continue
            if taken.free(*m.span()):
                new.append((kind, *m.span(), value))
        if new:
            taken.add([(a, b) for _, a, b, _ in new])
            found += new
    return found


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """Per row: its id, a row number, owner and repository, and its candidates in order of place."""
    kind = "array<struct<kind:string,start:bigint,end:bigint,hash:binary>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.binary())]))
    order = {k: n for n, k in enumerate(KINDS)}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column(1).to_pylist():
            found = base_candidates(text)
            found += more_candidates(text, found)
            found.sort(key=lambda c: (c[1], order[c[0]]))
            out.append([{"kind": k, "start": a, "end": b, "hash": _hash(v)} for k, a, b, v in found])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(out, arrow)], ["id", "owner", "repo", "found"])

    src = tables.texts(df, id_col, text_col, F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"))
    return tables.over_batches(src, run, f"id {src.schema['id'].dataType.simpleString()}, owner string, repo string, found {kind}").withColumn("row", F.monotonically_increasing_id())


def spread(found: DataFrame) -> DataFrame:
    """For each candidate hash, by how many owners and in how many repositories it is found."""
    each = found.select("owner", "repo", F.explode("found.hash").alias("hash"))
    owners = each.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias("owners"))
    repos = each.groupBy("hash", "repo").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias("repos"))
    return owners.join(repos, "hash")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = MAX_OWNERS) -> DataFrame:
    """Rows (id, spans): every row's secrets in order of place.

    spans: kind, start, end (code points), owners, repos, base and live.  Base kinds are
    all there; of the others, those that are live.
    """
    found = tables.saved(candidates(df, id_col, text_col, owner_col, repo_col), "secrets")
    some = found.where(F.size("found") > 0).select("row", F.posexplode("found").alias("n", "c"))
    judged = some.select("row", "n", "c.*").join(spread(found), "hash")
    live = F.col("owners") <= max_owners
    base = F.col("kind").isin(*BASE_KINDS)
    spans = judged.withColumn("base", base).withColumn("live", live).where("base OR live").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("n", "kind", "start", "end", "owners", "repos", "base", "live"))).alias("spans"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return found.select("row", "id").join(spans, "row", "left").select(F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans"))


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What ``scan`` gives, as counts, a digest of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scanned.select(
        id_col, *(count(k) for k in BASE_KINDS), F.sha2(text(F.filter("spans", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with a mark in place of every span; spans may overlap."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _hash(value: str) -> bytes:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).digest()[:16]


def redacted(df: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", owner_col: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """The rows with their columns, secrets in the text masked and its length put right.

    Base kinds are masked wherever they stand, further kinds where they look live. Texts
    without a candidate of a further kind are masked straight from their scan; only the
    others wait for what owners hold, and of these only hashes and places are shuffled but
    for the rows of few texts that get their spans.
    """
    own = df.columns
    extra = {c: tables.unused(df, f"_{c}") for c in ("row", "owner", "spans", "more")}

    def masked(columns: dict[str, pa.Array], spans: list[list[tuple[int, int]]]) -> list[pa.Array]:
        hit = [k for k, s in enumerate(spans) if s]
        if hit:
            texts = columns[text_col].to_pylist()
            for k in hit:
                texts[k] = mask(texts[k], spans[k])
            columns[text_col] = pa.array(texts, columns[text_col].type)
            if size_col in own:
                sizes = columns[size_col].to_pylist()
                for k in hit:
                    sizes[k] = len(texts[k])
                columns[size_col] = pa.array(sizes, columns[size_col].type)
        return [columns[n] for n in own]

    def found(batch: pa.RecordBatch):
        for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
            base = base_candidates(text or "")
            yield base, more_candidates(text or "", base)

    def settled(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = list(found(batch))
        batch = batch.filter(pa.array([not more for _, more in spans]))
        return pa.RecordBatch.from_arrays(masked({n: batch.column(k) for k, n in enumerate(own)}, [[c[1:3] for c in base] for base, more in spans if not more]), own)

    place = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    named = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("hash", pa.binary())])

    def open_ones(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = list(found(batch))
        batch = batch.filter(pa.array([bool(more) for _, more in spans]))
        spans = [s for s in spans if s[1]]
        base = pa.array([[{"start": c[1], "end": c[2]} for c in b] for b, _ in spans], pa.list_(place))
        more = pa.array([[{"start": c[1], "end": c[2], "hash": _hash(c[3])} for c in m] for _, m in spans], pa.list_(named))
        return pa.RecordBatch.from_arrays([*batch.columns, base, more], [*own, extra["spans"], extra["more"]])

    kinds = [(f.name, f.dataType.simpleString()) for f in df.schema] + [(extra["spans"], "array<struct<start:bigint,end:bigint>>"), (extra["more"], "array<struct<start:bigint,end:bigint,hash:binary>>")]
    waiting = tables.over_batches(df, open_ones, ", ".join(f"`{n}` {k}" for n, k in kinds)).withColumn(extra["row"], F.monotonically_increasing_id())
    waiting = tables.saved(waiting, "candidates")
    each = waiting.select(F.col(extra["row"]).alias("row"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.explode(extra["more"]).alias("c")).select("row", "owner", "c.*")
    live = each.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias("owners")).where(F.col("owners") <= max_owners)
    spans = tables.saved(each.join(live.select("hash"), "hash", "left_semi").groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("live")), "spans")
    name = tables.unused(waiting, "live")
    both = waiting.join(spans.select(F.col("row").alias(extra["row"]), F.col("live").alias(name)), extra["row"], "left")
    both = both.withColumn(extra["spans"], F.concat(extra["spans"], F.coalesce(name, F.array().cast("array<struct<start:bigint,end:bigint>>")))).select(*own, extra["spans"])

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        spans = [[(s["start"], s["end"]) for s in row] for row in columns.pop(extra["spans"]).to_pylist()]
        return pa.RecordBatch.from_arrays(masked(columns, spans), own)

    return tables.over_batches(df, settled, df.schema).unionByName(tables.over_batches(both, judged, df.schema))
