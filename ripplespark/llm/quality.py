"""Quality rules as a short-circuit cascade over blocks of texts.

A rule looks at a block of texts and says which ones it rejects.  On a small sample each
rule is timed and its rejections are counted; the rules then run by falling rejections
per second, and every rule sees only the texts that the earlier ones let through.  The
order changes the cost, never the verdict: a text is kept if no rule rejects it.

Words are runs of anything but blanks (space, tab, line feed, vertical tab, form feed,
carriage return).  Null texts have no words.  Repeated rows are judged each for itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat, tables

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
#: Counts of a block that have one number a text.
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_upper", "n_repeat_words")


class Block:
    """Texts of a block with counts that are made when a rule first asks for them."""

    def __init__(self, data: np.ndarray | None, offsets: np.ndarray, cut: tuple[Block, np.ndarray] | None = None):
        self.offsets, self.n, self._cut = offsets, len(offsets) - 1, cut
        if data is not None:
            self.data = data

    def only(self, keep: np.ndarray) -> Block:
        """The same, of the texts at these places, with their counts so far; bytes are copied when a count needs them."""
        part = Block(None, np.r_[0, np.cumsum(np.diff(self.offsets)[keep])], (self, keep))
        made = vars(self)
        vars(part).update({name: made[name][keep] for name in _COUNTS if name in made})
        if "lines" in made:
            part.lines = tuple(x[keep] for x in made["lines"])
        return part

    @cached_property
    def data(self) -> np.ndarray:
        whole, keep = self._cut
        chosen = np.zeros(whole.n, bool)
        chosen[keep] = True
        return whole.data[np.repeat(chosen, np.diff(whole.offsets))]

    def _sums(self, mask: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(mask)]
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    @cached_property
    def inside(self) -> np.ndarray:
        return flat.NOT_BLANK[self.data]

    @cached_property
    def words(self) -> flat.Words:
        return flat.find_words(self.data, self.offsets, flat.NOT_BLANK)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.bincount(self.words.doc, minlength=self.n)

    @cached_property
    def word_chars(self) -> np.ndarray:
        """Code points in words: every byte but the later ones of a sequence."""
        return self._sums(self.inside & ((self.data & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._sums(_SYMBOL[self.data])

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self._sums(_UPPER[self.data])

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Per text: lines with a word, and those of them equal to an earlier line of the text."""
        breaks = np.flatnonzero(self.data == 10)
        start = np.sort(np.r_[self.offsets[:-1], breaks + 1])
        end = np.sort(np.r_[breaks, self.offsets[1:]])
        doc = np.sort(np.r_[np.arange(self.n), np.searchsorted(self.offsets, breaks, "right") - 1])
        seen = np.r_[0, np.cumsum(self.inside)]
        full = np.flatnonzero(seen[end] > seen[start])
        start, end, doc = start[full], end[full], doc[full]
        hashes = flat.hash_ranges(self.data, start, end)
        order = np.lexsort((hashes, doc))
        hashes, of = hashes[order], doc[order]
        again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1]))
        return np.bincount(doc, minlength=self.n), np.bincount(of[again], minlength=self.n)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words within three-word windows that the text has twice or more."""
        words = self.words
        windows, first = flat.window_hashes(flat.hash_ranges(self.data, words.start, words.end), words.doc, 3)
        if not len(windows):
            return np.zeros(self.n, np.int64)
        keys = flat.mix(windows + words.doc[first].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        order = np.argsort(keys)
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        repeated = first[order[np.r_[same, False] | np.r_[False, same]]]
        covered = np.zeros(len(words.doc), bool)
        for k in range(3):
            covered[repeated + k] = True
        return np.bincount(words.doc[covered], minlength=self.n)


Rule = Callable[[Block], np.ndarray]

#: Rejections that every caller has: too short, or mostly repeated.
BASE: dict[str, Rule] = {
    "few_words": lambda b: b.n_words < 50,
    "repeated_words": lambda b: 100 * b.n_repeat_words > 50 * b.n_words,
}
#: Rejections of text that is no prose, all far from what prose has.
MORE: dict[str, Rule] = {
    "symbols": lambda b: 10 * b.n_symbols > b.n_words,
    "repeated_lines": lambda b: 100 * b.lines[1] > 30 * b.lines[0],
    "shouting": lambda b: 100 * b.n_upper > 50 * b.word_chars,
    "word_length": lambda b: (b.word_chars < 2 * b.n_words) | (b.word_chars > 25 * b.n_words),
}
#: What the sample for the order of rules holds at most: rows, and bytes of a text. One row in so many is looked at.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_STEP = 256, 1 << 16, 32


def blocks_of(column: pa.Array) -> Iterator[tuple[int, int, Block]]:
    data, offsets = flat.views(column)
    for a, b in flat.blocks(offsets):
        yield a, b, Block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def ranked(df: DataFrame, rules: dict[str, Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules by rejections per second on a sample, which Spark gathers from as few files as it needs.

    Only the order comes from this sample; its bounds are those of what the driver reads,
    and longer texts take no part in it.
    """
    some = tables.texts(df, text_col, text_col).select("text").where(F.octet_length("text") <= SAMPLE_BYTES)
    spread = some.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_STEP)) == 0).head(sample_rows) or some.head(sample_rows)
    sample = pa.array([r["text"] for r in spread], pa.string())
    rate: dict[str, float] = {}
    for name, rule in rules.items():
        spent, rejected = 1e-6, 0
        for _, _, block in blocks_of(sample):
            began = time.perf_counter()
            rejected += int(rule(block).sum())
            spent += time.perf_counter() - began
        rate[name] = (rejected + 0.5) / spent
    return sorted(rules, key=lambda name: (-rate[name], name))


def first_rejection(block: Block, rules: dict[str, Rule], order: list[str], passed: np.ndarray | None = None) -> np.ndarray:
    """For each text the place in ``order`` of the first rule that rejects it, or -1.

    Texts that haven't ``passed`` before are left out.  A block is cut down once less than
    half of it is left, so that later rules touch less; what was counted stays counted.
    """
    found, part, at = np.full(block.n, -1), block, np.arange(block.n)
    live = np.ones(block.n, bool) if passed is None else passed.copy()
    for k, name in enumerate(order):
        n = int(live.sum())
        if not n:
            break
        if 2 * n < len(at):
            left = np.flatnonzero(live)
            part, at, live = part.only(left), at[left], np.ones(n, bool)
        rejected = rules[name](part) & live
        found[at[rejected]] = k
        live &= ~rejected
    return found


def judge(df: DataFrame, rules: dict[str, Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """Rows (id, kept, rejected_by): the verdict on every text and the first rule against it, null if none.

    Which of several rules is named depends on the order, and so on the clock unless it is given.
    """
    rules = BASE | MORE if rules is None else rules
    order = order or ranked(df, rules, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.concatenate([first_rejection(block, rules, order) for _, _, block in blocks_of(batch.column(1))])
        by = pa.array([order[k] if k >= 0 else None for k in found.tolist()], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found < 0), by], ["id", "kept", "rejected_by"])

    src = tables.texts(df, id_col, text_col)
    return tables.over_batches(src, run, f"id {src.schema['id'].dataType.simpleString()}, kept boolean, rejected_by string").withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, rules: dict[str, Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The rows whose text no rule rejects, with all their columns; nothing is shuffled."""
    rules = BASE | MORE if rules is None else rules
    order = ranked(df, rules, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index(text_col)).fill_null("")
        return batch.filter(pa.array(np.concatenate([first_rejection(block, rules, order) for _, _, block in blocks_of(texts)]) < 0))

    return tables.over_batches(df, run, df.schema)


def measured(df: DataFrame, more: dict[str, Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base counts of every text, whether the base rules reject it, and the cascade's verdict on the others."""
    more = MORE if more is None else more
    order = ranked(df, more, text_col)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for _, _, block in blocks_of(batch.column(1)):
            failed = BASE["few_words"](block) | BASE["repeated_words"](block)
            # every row gives its counts, so they are made first, and rules on them cost nothing more
            counts = [block.n_words, block.word_chars, block.n_symbols, block.lines[1], block.n_repeat_words]
            kept = ~failed & (first_rejection(block, more, order, passed=~failed) < 0)
            parts.append([*counts, failed, kept])
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.bool_()) for c in columns[5:])], ["id", *names, "base_failed", "kept"])

    src = tables.texts(df, id_col, text_col)
    schema = f"id {src.schema['id'].dataType.simpleString()}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean"
    return tables.over_batches(src, run, schema).withColumnRenamed("id", id_col)


#: The same in SQL. Lines and windows are numbered by their place in the text.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
s AS (SELECT row, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY row ORDER BY i)),
r AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, word, b, c) AS n FROM s WHERE c IS NOT NULL) WHERE n > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS t(k) GROUP BY row),
lines AS (SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
words AS (SELECT row, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY row),
f AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
      FROM d LEFT JOIN words USING (row) LEFT JOIN lines USING (row) LEFT JOIN covered USING (row)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines OR 100 * n_upper > 50 * word_chars OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM b
"""
