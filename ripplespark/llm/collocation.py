"""Phrase collocation mining with merged count-min sketches and an exact second pass.

First pass: every task counts the words and phrases of its texts into a count-min sketch of
``DEPTH`` rows, which it sends as the cells that it touched, by chunks of the rows; sketches
are merged by adding the chunks up.  A sketch never counts too little, so whatever it gives
fewer than ``least`` can't be frequent.  Second pass: every task counts again, looks each
word and phrase up in the merged sketch, and sends on only those that may be frequent; these
are added up exactly, by their own text.  Counts inside a task are exact as well: words are
numbered by a dictionary, phrases by pairs of numbers, never by hashes.

The sketch has a cell for about every four bytes of text, 2**30 at most in a row; of the
merged one only a bit a cell is kept, so that a worker holds ``DEPTH`` times 128 MB at most.
A corpus beyond 4 GB of text fills the cells and lets more through to the second pass, which
then moves more, but finds the same.

Words and phrases are counted in each language apart, so a language that holds most rows
makes no large group: sums are by phrase, pre-aggregated in each task, and of each language
only the best ``top`` of each task meet in the last one.

Null texts count as empty, a null language as ``und``.  Repeated rows count each.  A table
without candidates gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files, flat, tables

LEAST = 10
TOP = 2000
SHARES = 32
NO_LANG = "und"
DEPTH = 2
BYTES_A_CELL = 4
LEAST_BITS, MOST_BITS = 20, 30
#: A row of the sketch is sent in so many parts at most, whatever its width.
PARTS = 512
#: A task sends its sketch on whenever so many words and phrases have come together.
FLUSH = 1 << 20

#: Words end at blanks, pieces at these.
_BLANKS, _ENDS = b" \t", b".,;:!?\n\x0b\x0c\r"
_IN_WORD, _IN_PIECE = flat.byte_table(_BLANKS + _ENDS), flat.byte_table(_ENDS)
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Counts(NamedTuple):
    """Phrases of up to three words of a batch with their counts.

    words: the distinct words of each language; lang: the language of each, as a number in
    langs; totals: words in all by language; by_size[k]: for phrases of k + 1 words, an array
    of word numbers for each place, and the counts.
    """

    langs: list[str]
    words: pa.Array
    lang: np.ndarray
    totals: np.ndarray
    by_size: list[tuple[list[np.ndarray], np.ndarray]]


def _words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as an array of strings."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)])
    out = data[np.arange(at[-1]) + np.repeat(start - at[:-1], size)]
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)])


def counted(texts: pa.Array, langs: pa.Array) -> Counts:
    """Exact counts of the words and phrases of a batch of texts."""
    data, offsets = flat.views(texts)
    data = flat.LOWER[data]
    found = flat.find_words(data, offsets, _IN_WORD)
    coded = langs.dictionary_encode()
    names, of_text = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = _words(data, found.start, found.end).dictionary_encode()
    # A word of another language is another word.
    pairs, ids = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(names)) + of_text[found.doc], return_inverse=True)
    lang, word = pairs % max(1, len(names)), pairs // max(1, len(names))
    n = len(ids)
    # Neighbours are of one piece if no end of a piece or text lies between them.
    ends = np.concatenate([[0], np.cumsum(~_IN_PIECE[data])])
    near = (found.doc[1:] == found.doc[:-1]) & (ends[found.start[1:]] == ends[found.end[:-1]]) if n else np.zeros(0, bool)
    sizes = [([np.arange(len(pairs))], np.bincount(ids, minlength=len(pairs)))]
    twos = np.flatnonzero(near)
    two, number, times = np.unique(ids[twos] * len(pairs) + ids[twos + 1], return_inverse=True, return_counts=True) if len(twos) else (np.zeros(0, np.int64),) * 3
    sizes.append(([two // max(1, len(pairs)), two % max(1, len(pairs))], times))
    threes = np.flatnonzero(near[:-1] & near[1:]) if n > 2 else np.zeros(0, np.int64)
    first = np.zeros(max(n, 1), np.int64)
    first[twos] = number
    three, times = np.unique(first[threes] * len(pairs) + ids[threes + 2], return_counts=True)
    pair = three // max(1, len(pairs))
    sizes.append(([two[pair] // max(1, len(pairs)), two[pair] % max(1, len(pairs)), three % max(1, len(pairs))], times))
    totals = np.bincount(of_text[found.doc], minlength=len(names)) if n else np.zeros(len(names), np.int64)
    return Counts(names, words.dictionary.take(pa.array(word)), lang, totals, sizes)


def hashes(found: Counts) -> list[np.ndarray]:
    """64-bit hashes of the words and phrases, language included, as every task gives them."""
    data, offsets = flat.views(found.words)
    own = flat.hash_ranges(data, offsets[:-1], offsets[1:])
    name, at = flat.views(pa.array(found.langs, pa.large_string()))
    own = flat.mix(own ^ flat.mix(flat.hash_ranges(name, at[:-1], at[1:]) + np.uint64(1))[found.lang]) if len(own) else own
    out = []
    for places, _ in found.by_size:
        h = np.full(len(places[0]), np.uint64(len(places)))
        for ids in places:
            h = h * np.uint64(0x9FB21C651E98DF25) + own[ids]
        out.append(flat.mix(h))
    return out


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch."""
    return (flat.mix(h ^ _SEEDS[row]) >> np.uint64(64 - bits)).astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Counts]:
    """Counts of blocks of about a megabyte of text, which bound what a worker holds."""
    for batch in batches:
        offsets = flat.views(batch.column(1))[1]
        for first, last in flat.blocks(offsets):
            part = batch.slice(first, last - first)
            yield counted(part.column(1), part.column(2))


_PARTS = "sketch int, chunk int, k int, gap binary, n binary"


def chunk_bits(bits: int) -> int:
    return max(3, bits - PARTS.bit_length() + 1)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in the least width that holds them all."""
    return x.astype(next(kind for kind in ("<u1", "<u2", "<u4", "<u8") if int(x.max(initial=0)) <= np.iinfo(kind).max)).tobytes()


def _unpacked(data: bytes, k: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // k}").astype(np.int64)


def _parts(h: np.ndarray, n: np.ndarray, bits: int) -> pa.RecordBatch:
    """A sketch as rows: of each chunk that was touched, the gaps between its cells and their counts."""
    out: tuple[list, ...] = ([], [], [], [], [])
    for row in range(DEPTH):
        at, place = np.unique(cells(h, row, bits), return_inverse=True)
        sums = np.bincount(place, n, len(at)).astype(np.int64)
        chunk = at >> chunk_bits(bits)
        low = at & ((1 << chunk_bits(bits)) - 1)
        starts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(at) else np.zeros(0, np.int64)
        for a, b in zip(starts, [*starts[1:], len(at)], strict=True):
            for column, x in zip(out, (row, int(chunk[a]), int(b - a), _packed(np.diff(low[a:b], prepend=0)), _packed(sums[a:b])), strict=True):
                column.append(x)
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["sketch", "chunk", "k", "gap", "n"])


def sketched(src: DataFrame, bits: int) -> DataFrame:
    """The sketches of all tasks, in parts; src: id, text, lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n, size = [], [], 0
        for found in blocks(batches):
            for own, (_, times) in zip(hashes(found), found.by_size, strict=True):
                h.append(own)
                n.append(times)
                size += len(own)
            if size >= FLUSH:
                yield _parts(np.concatenate(h), np.concatenate(n), bits)
                h, n, size = [], [], 0
        if size:
            yield _parts(np.concatenate(h), np.concatenate(n), bits)

    return src.mapInArrow(run, _PARTS)


def merged(parts: DataFrame, bits: int, least: int) -> DataFrame:
    """The merged sketch, as a bit for each cell whose count reaches ``least``, by chunk."""
    width = 1 << chunk_bits(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, chunk, k, gap, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key := (row, chunk)) not in sums:
                    sums[key] = np.zeros(width, np.int64)
                sums[key][np.cumsum(_unpacked(gap, k))] += _unpacked(n, k)  # cells of a part differ
        for (row, chunk), own in sums.items():
            if (own >= least).any():
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([chunk], pa.int32()), pa.array([np.packbits(own >= least, bitorder="little").tobytes()])], ["sketch", "chunk", "bits"])

    # The sums of a task take 32 MB or so.
    dealt = parts.repartition(tables.tasks(max(8, (DEPTH << bits) >> 22)), "sketch", "chunk")
    return dealt.mapInArrow(run, "sketch int, chunk int, bits binary")


_HELD: dict[tuple, np.ndarray] = {}


def _sketch(paths: tuple[str, ...], bits: int) -> np.ndarray:
    """The merged sketch from its files, once for each worker: a row of packed bits for each of its rows."""
    if paths not in _HELD:
        _HELD.clear()
        full = np.zeros((DEPTH, (1 << bits) // 8), np.uint8)
        for path in paths:
            system, local = files.located(path)
            with system.open_input_file(local) as f:
                for batch in pq.ParquetFile(f).iter_batches(16, columns=["sketch", "chunk", "bits"]):
                    for row, chunk, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        at = chunk << (chunk_bits(bits) - 3)
                        full[row, at : at + len(own)] = np.frombuffer(own, np.uint8)
        _HELD[paths] = full
    return _HELD[paths]


def survivors(src: DataFrame, sketch: DataFrame, bits: int) -> DataFrame:
    """Rows (lang, phrase, size, n): exact counts of what the sketch lets through, by language; a null phrase has all words."""
    paths = tuple(sorted(sketch.inputFiles()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = _sketch(paths, bits)
        for found in blocks(batches):
            langs = pa.array(found.langs, pa.large_string())
            out = [(langs, pa.nulls(len(langs), pa.large_string()), np.zeros(len(langs), np.int32), found.totals)]
            for h, (places, times) in zip(hashes(found), found.by_size, strict=True):
                kept = np.arange(len(h))
                for row in range(DEPTH):
                    at = cells(h[kept], row, bits)
                    kept = kept[(full[row, at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
                each = [found.words.take(pa.array(ids[kept])) for ids in places]
                phrase = each[0] if len(each) == 1 else pc.binary_join_element_wise(*each, pa.scalar(" ", pa.large_string()))
                out.append((langs.take(pa.array(found.lang[places[0][kept]])), phrase, np.full(len(kept), len(places), np.int32), times[kept]))
            for columns in out:
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x).cast(t) for x, t in zip(columns, kinds, strict=True)], ["lang", "phrase", "size", "n"])

    each = src.mapInArrow(run, "lang string, phrase string, size int, n bigint")
    return each.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))


def phrases(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = LEAST, share: int = 50, top: int = TOP) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the best phrases of two or three words of each language.

    a is how often the phrase stands in a piece; l and r are those of its two parts at the
    cut that scores least, the first such cut if several do; n is the language's words and
    the score floor(1000000 * a * a / (l * r)).  A phrase inside a longer candidate that has
    at least ``share`` percent of its count is left out.
    """
    src = tables.texts(df, id_col, text_col, F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"))
    size = src.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // BYTES_A_CELL).bit_length()))
    sketch = tables.saved(merged(sketched(src, bits), bits, least), "sketch")
    counts = tables.saved(survivors(src, sketch, bits).where(F.col("phrase").isNull() | (F.col("n") >= least)), "phrases")
    whole = counts.where("phrase IS NULL").select("lang", F.col("n").alias("n_words"))
    part = lambda name, n: counts.where("phrase IS NOT NULL").select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    found = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.substring_index("phrase", " ", 1).alias("head"), F.substring_index("phrase", " ", -1).alias("tail"))
    start, end = F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)
    found = found.withColumn("start", F.when(F.col("size") == 3, start)).withColumn("end", F.when(F.col("size") == 3, end))
    # Longer candidates are of three words, and each holds two of two.
    inside = found.where("size = 3").select("lang", "a", F.explode(F.array("start", "end")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    found = found.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)).drop("longer")
    # The parts of what is frequent are frequent, so all are among the counts.
    found = found.join(part("head", "n_head"), ["lang", "head"]).join(part("tail", "n_tail"), ["lang", "tail"])
    found = found.join(part("start", "n_start"), ["lang", "start"], "left").join(part("end", "n_end"), ["lang", "end"], "left")
    big = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    score = lambda l, r: F.expr(f"CAST((1000000BD * ({big('a')} * {big('a')})) div ({big(l)} * {big(r)}) AS BIGINT)")
    one = F.col("size") == 2
    cut = lambda l, r: F.struct(score(l, r).alias("score"), F.col(l).alias("l"), F.col(r).alias("r"))
    first, second = cut("n_head", "n_end"), cut("n_start", "n_tail")
    best = F.when(one, cut("n_head", "n_tail")).when(second["score"] < first["score"], second).otherwise(first)
    found = found.select("lang", "phrase", "a", best.alias("best")).join(whole, "lang")
    # A language's best are the best of its shares, so that no task gets more than SHARES times as many rows as are asked for.
    best_of = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("best.score"), F.desc("a"), "phrase"))
    shares = found.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).withColumn("rank", best_of("lang", "share")).where(F.col("rank") <= top)
    ranked = shares.withColumn("rank", best_of("lang")).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", F.col("n_words").alias("n"), "best.score")


#: DuckDB SQL with the rows of ``phrases`` with its own values, by plain counting.
SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT COALESCE(lang, 'und') AS lang,
          unnest(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
        FROM documents)
), words AS (
  SELECT piece, lang, unnest(w) AS w1, unnest(range(1, len(w) + 1)) AS i FROM pieces
), runs AS (
  SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY piece ORDER BY i)
), f1 AS (SELECT lang, w1, count(*) AS n FROM runs GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS n FROM runs WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS n FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
inside AS (
  SELECT lang, w1, w2, max(n) AS longer FROM (SELECT lang, w1, w2, n FROM f3 UNION ALL SELECT lang, w2, w3, n FROM f3) GROUP BY ALL
), cuts AS (
  SELECT f.lang, f.w1 || ' ' || f.w2 AS phrase, 1 AS k, f.n AS a, l.n AS l, r.n AS r
  FROM f2 f JOIN f1 l ON l.lang = f.lang AND l.w1 = f.w1 JOIN f1 r ON r.lang = f.lang AND r.w1 = f.w2
  LEFT JOIN inside i ON i.lang = f.lang AND i.w1 = f.w1 AND i.w2 = f.w2
  WHERE f.n >= 10 AND NOT COALESCE(100 * i.longer >= 50 * f.n, false)
  UNION ALL
  SELECT f.lang, f.w1 || ' ' || f.w2 || ' ' || f.w3, 1, f.n, l.n, r.n
  FROM f3 f JOIN f1 l ON l.lang = f.lang AND l.w1 = f.w1 JOIN f2 r ON r.lang = f.lang AND r.w1 = f.w2 AND r.w2 = f.w3
  UNION ALL
  SELECT f.lang, f.w1 || ' ' || f.w2 || ' ' || f.w3, 2, f.n, l.n, r.n
  FROM f3 f JOIN f2 l ON l.lang = f.lang AND l.w1 = f.w1 AND l.w2 = f.w2 JOIN f1 r ON r.lang = f.lang AND r.w1 = f.w3
), scored AS (
  SELECT lang, phrase, k, a, l, r, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE cut = 1
)
SELECT k.lang, rank, phrase, a, l, r, n.n AS n, score
FROM ranked k JOIN (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f1 GROUP BY lang) n ON n.lang = k.lang
WHERE rank <= 2000
"""
