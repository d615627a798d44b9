"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Items and documents are lower-cased (A to Z only) and cut into words of letters, digits
and non-ASCII characters; a normalised text is its words between single spaces.  The
automaton holds every window of ``width`` consecutive item words (an item of fewer words
is one window), with the items that have it, and each document is scanned once.  Places
of hits are mapped back to words and to code points of the original text.

The automaton is broadcast in blocks of at most ``BLOCK_CHARS`` characters of windows, so
its size is bounded whatever the benchmark's; each block costs one pass over the texts,
and what passes before the last find is written, so that a worker holds one automaton.

Null or wordless items have no windows; null documents have no words.  Items without an
id are reported under the empty id; rows that share an id count as one item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from uuid import uuid4

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables

WIDTH = 10
BLOCK_CHARS = 4_000_000
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Bytes of normalised text: A to Z in lower case, what belongs to no word a space.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows_of(text: str | None, width: int) -> list[str]:
    """The distinct windows of an item, each between spaces, one character for a byte."""
    words = words_of((text or "").encode())
    runs = [words[i : i + width] for i in range(max(1, len(words) - width + 1))] if words else []
    return list(dict.fromkeys(" " + b" ".join(run).decode("latin-1") + " " for run in runs))


def window_blocks(items: Iterator, width: int, most: int = BLOCK_CHARS) -> Iterator[dict[str, set[str]]]:
    """Windows with the ids of their items, in blocks of so many characters or of one item."""
    block: dict[str, set[str]] = {}
    held = 0
    for item, text in items:
        for window in windows_of(text, width):
            if held > most:
                yield block
                block, held = {}, 0
            held += len(window) * (window not in block)
            block.setdefault(window, set()).add("" if item is None else str(item))
    if block:
        yield block


_built: dict[str, ahocorasick.Automaton] = {}


def automaton(shared) -> ahocorasick.Automaton:
    """The automaton of a broadcast block, which has a name; a Python worker holds one at a time."""
    name, block = shared.value
    if name not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for window, items in block.items():
            made.add_word(window, (len(window), sorted(items)))
        made.make_automaton()
        _built[name] = made
    return _built[name]


def scan(text: bytes, machine: ahocorasick.Automaton | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """How many words the text has, the ranges of hit words (merged, in order), and the items found."""
    words = words_of(text)
    if machine is None or not words:
        return len(words), [], set()
    normal = " " + b" ".join(words).decode("latin-1") + " "
    found = [(end - size + 1, end, items) for end, (size, items) in machine.iter(normal)]
    if not found:
        return len(words), [], set()
    spaces = np.flatnonzero(np.frombuffer(normal.encode("latin-1"), np.uint8) == 32)
    first = np.searchsorted(spaces, [f[0] for f in found]).tolist()
    last = np.searchsorted(spaces, [f[1] for f in found]).tolist()
    ranges: list[tuple[int, int]] = []
    for a, b in sorted(zip(first, last, strict=True)):
        if ranges and a <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]))
        else:
            ranges.append((a, b))
    return len(words), ranges, {x for f in found for x in f[2]}


def find(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS, carry: bool = False) -> DataFrame:
    """Rows (id, n_words, hits, items) of every document.

    hits: ranges (first word, word after the last; code point start and end), merged;
    items: the ids found, as sorted strings. ``carry`` keeps the document's own columns
    instead of its id alone, with the three columns added in a struct as the last column.
    """
    items = ((r[0], r[1]) for r in benchmark.select(F.col(item_col).cast("string"), F.col(item_text_col).cast("string")).toLocalIterator())
    context = documents.sparkSession.sparkContext
    kind = "struct<n_words:bigint,hits:array<struct<first:int,last:int,start:bigint,end:bigint>>,items:array<string>>"
    base = documents if carry else tables.texts(documents, id_col, text_col)
    column = text_col if carry else "text"
    name = tables.unused(base, "found")
    out = base.withColumn(name, F.lit(None).cast(kind))
    arrow = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def one_pass(df: DataFrame, shared) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            machine = automaton(shared) if shared else None
            at = batch.schema.get_field_index(name)
            rows = []
            for raw, old in zip(batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist(), batch.column(at).to_pylist(), strict=True):
                raw = raw or b""
                n, ranges, found = scan(raw, machine)
                hits = []
                if ranges:
                    place = [m.span() for m in _WORD.finditer(raw.lower().decode())]  # bytes.lower() changes A to Z only
                    hits = [{"first": a, "last": b, "start": place[a][0], "end": place[b - 1][1]} for a, b in ranges]
                rows.append({"n_words": n, "hits": merged((old["hits"] if old else []) + hits), "items": sorted(found | set(old["items"] if old else ()))})
            return batch.set_column(at, batch.schema.field(at).name, pa.array(rows, arrow))

        return tables.over_batches(df, run, df.schema)

    shared = None
    for block in window_blocks(items, width, block_chars):
        if shared:
            out = tables.saved(one_pass(out, shared), "passed")
            shared.destroy()
        shared = context.broadcast((uuid4().hex, block))
    out = one_pass(out, shared)
    return out if carry else out.select(F.col("id").alias(id_col), "found.*")


def merged(hits: list[dict]) -> list[dict]:
    """Ranges in order, those that touch the same word as one."""
    out: list[dict] = []
    for hit in sorted(hits, key=lambda h: (h["first"], h["last"])):
        if out and hit["first"] <= out[-1]["last"]:
            if hit["last"] > out[-1]["last"]:
                out[-1] = out[-1] | {"last": hit["last"], "end": hit["end"]}
        else:
            out.append(hit)
    return out


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What ``find`` gives, as counts, a digest of the items and a verdict."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + (h["last"] - h["first"]).cast("long"))
    return found.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def keep_clean(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns; nothing is shuffled."""
    out = find(documents, benchmark, text_col=text_col, carry=True, **options)
    return out.where(F.size(F.col(out.columns[-1])["hits"]) == 0).drop(out.columns[-1])


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g'), '[^ ]+') AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g'), '[^ ]+') AS ws FROM benchmark),
p AS (SELECT item, ws, least(len(ws), 10) AS width, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, width, array_to_string(list_slice(ws, i, i + width - 1), ' ') AS win FROM p),
dw AS (SELECT row, width, ws, unnest(range(1, len(ws) - width + 2)) AS i FROM d, (SELECT DISTINCT width FROM win) WHERE len(ws) >= width),
hit AS (SELECT row, i, dw.width, item FROM dw JOIN win ON win.width = dw.width AND win.win = array_to_string(list_slice(ws, i, i + dw.width - 1), ' ')),
n AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(i, i + width)) AS k FROM hit) GROUP BY row),
it AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM hit) GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (row) LEFT JOIN it USING (row)
"""
