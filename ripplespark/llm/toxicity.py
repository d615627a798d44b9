"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learned from document labels.

A sentence's probability is the logistic of a bias and the weights of its distinct telling
words, and 0 without any; a document is toxic unless every sentence is harmless and the label isn't noise:
1 - (1 - leak) * product(1 - p).  Only documents are labelled; the gradient of the
noisy-or gives credit to the sentences that explain a label, and so a scored text comes
with the places of the sentences that offend by themselves.

Learning uses about ``TRAIN_TEXTS`` labelled texts, and of either label about
``TRAIN_LEAST`` at least, chosen by a hash of text and id; rows that repeat both count once,
so that no group of copies fills or empties the sample.  The executors count in how many toxic and other texts each hashed word occurs; the ``WORDS``
words that tell most are kept, texts shrink to the sentences with such words, and the
driver fits the weights.  Model and training data don't grow with the corpus.

Null and empty texts score what a text without sentences does, the leak.  Labels that are
null or given several times for an id: nulls are ignored, the highest counts.  Without
labelled texts the score is 0.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat, tables

TRAIN_TEXTS, TRAIN_LEAST, WORDS, SUPPORT = 12_000, 1000, 2048, 5
CELLS = 1 << 18
STEPS, PENALTY = 400, 1e-6
#: Words, and their first bytes, that differ between labels by less than so many standard errors are left out.
TELLING = 4.0
PREFIX = 7
THRESHOLD = 0.3
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


class Model(NamedTuple):
    """Weights by cell, bias and leak (all as log odds but the leak)."""

    weight: np.ndarray
    bias: float
    leak: float


def words_by_sentence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, flat.Words]:
    """Text, sentence (numbered through the block) and two cells of every word, and the words' places.

    One cell is the word's, the other that of its first ``PREFIX`` bytes, or again the
    word's if it is no longer. A sentence ends at a full stop, exclamation or question
    mark, line break or end of text.
    """
    data = flat.LOWER[data]
    words = flat.find_words(data, offsets, flat.ALNUM)
    before = np.r_[0, np.cumsum(_STOP[data])][words.start]
    sentence = np.cumsum(np.r_[False, (before[1:] != before[:-1]) | (words.doc[1:] != words.doc[:-1])]) if len(before) else before
    whole = flat.hash_ranges(data, words.start, words.end)
    part = flat.hash_ranges(data, words.start, np.minimum(words.end, words.start + PREFIX))
    cell = np.stack([whole, np.where(words.end - words.start > PREFIX, flat.mix(part), whole)], 1) >> np.uint64(46)
    return words.doc, sentence, cell.astype(np.int64), words


def _blocks(batch: pa.RecordBatch, column: int):
    data, offsets = flat.views(batch.column(column))
    for a, b in flat.blocks(offsets):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a number and any of its row of cells, in order."""
    both = np.unique((a[:, None] if b.ndim == 2 else a) * np.int64(CELLS) + b)
    return both // CELLS, both % CELLS


def fit(bags: list[list[np.ndarray]], toxic: np.ndarray, size: int, start: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak of the noisy-or by gradient descent; bags: a text's sentences as arrays of word numbers."""
    sentence_of = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    flat_bags = [s for b in bags for s in b]
    at = np.repeat(np.arange(len(flat_bags)), [len(s) for s in flat_bags])
    word = np.concatenate(flat_bags) if flat_bags else np.zeros(0, np.int64)
    y = toxic.astype(float)
    theta = np.r_[start, -5.0, np.log(0.05 / 0.95)]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        logit = theta[size] + np.bincount(at, theta[word], len(flat_bags))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        leak = 1 / (1 + np.exp(-theta[size + 1]))
        harmless = np.log1p(-leak) + np.bincount(sentence_of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(bags))
        rest = np.clip(np.exp(harmless), 1e-9, 1 - 1e-9)
        # d loss / d log(rest): 1 for label 0 is -1, for label 1 rest / (1 - rest)
        slope = np.where(y > 0, rest / (1 - rest), -1.0) / len(bags)
        of_logit = slope[sentence_of] * -p  # d log(1 - p) / d logit = -p
        gradient = np.r_[np.bincount(word, of_logit[at], size), of_logit.sum(), (slope * -leak).sum()]
        gradient[:size] += PENALTY * theta[:size]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:size], float(theta[size]), float(1 / (1 + np.exp(-theta[size + 1])))


def labelled_sample(df: DataFrame, given: DataFrame, id_col: str, text_col: str, train_texts: int = TRAIN_TEXTS) -> DataFrame | None:
    """Rows (toxic, text): a sample of the texts of ``df`` whose id has a label in ``given`` (id, toxic).

    Ids and hashes meet the labels; only the chosen ids, of bounded number, go back to the texts.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text, F.col(id_col).cast("string"), F.lit(3)).alias("hash")).join(given, "id").distinct()
    rows = tables.saved(rows, "labelled")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n:
        return None
    place = F.pmod(F.col("hash"), F.lit(1 << 20)) / (1 << 20)
    share = {k: min(1.0, max(train_texts / sum(n.values()), TRAIN_LEAST / v)) for k, v in n.items()}
    chosen = rows.where(place < F.when(F.col("toxic"), share.get(True, 1.0)).otherwise(share.get(False, 1.0)))
    name = F.xxhash64(text, F.col(id_col).cast("string"), F.lit(3))
    sample = df.select(name.alias("hash"), text.alias("text")).join(F.broadcast(chosen.select("hash", "toxic").distinct()), "hash")
    return tables.saved(sample.dropDuplicates(["hash"]).select("toxic", "text"), "sample")


def train(df: DataFrame, label_col: str = "toxic", text_col: str = "text", train_texts: int = TRAIN_TEXTS, id_col: str = "doc_id") -> Model | None:
    """The model of texts with a label in a column of their own, or None if there are none."""
    tables._bounded_batches(df.sparkSession)
    given = df.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).alias("toxic"))
    return train_on(labelled_sample(df, given, id_col, text_col, train_texts))


def train_on(sample: DataFrame | None) -> Model | None:
    """The model of a bounded sample (toxic, text)."""
    if sample is None:
        return None

    def count(batches):
        for batch in batches:
            label, total = batch.column(0).to_numpy(zero_copy_only=False), np.zeros(2 * CELLS + 2, np.int64)
            for a, b, data, offsets in _blocks(batch, 1):
                doc, _, cell, _ = words_by_sentence(data, offsets)
                doc, cell = _pairs(doc, cell)
                total[: 2 * CELLS] += np.bincount(cell + CELLS * label[a + doc], minlength=2 * CELLS)
                total[2 * CELLS :] += np.bincount(label[a:b], minlength=2)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "n"])

    counted = sample.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).where(f"n >= {SUPPORT} OR at >= {2 * CELLS}")
    total = np.zeros(2 * CELLS + 2)
    got = counted.toArrow()
    total[got.column(0).to_numpy()] = got.column(1).to_numpy()
    other, toxic, sizes = total[:CELLS], total[CELLS : 2 * CELLS], total[2 * CELLS :]
    if not sizes.all():  # one kind of label only
        return Model(np.zeros(CELLS, np.float32), -30.0, float(sizes[1] > 0))
    share = [(c + 0.5) / (s + 1) for c, s in ((toxic, sizes[1]), (other, sizes[0]))]
    odds = np.log(share[0] / share[1])
    pooled = (toxic + other + 1) / (sizes.sum() + 2)
    told = (share[0] - share[1]) / np.sqrt(pooled * (1 - pooled) * (1 / sizes).sum())  # in standard errors
    chosen = np.argsort(-np.abs(told), kind="stable")[:WORDS]
    chosen = np.sort(chosen[np.abs(told[chosen]) > TELLING])
    if not len(chosen):
        return Model(np.zeros(CELLS, np.float32), -30.0, float(sizes[1] / sizes.sum()))
    number = np.full(CELLS, -1)
    number[chosen] = np.arange(len(chosen))

    def shrink(batches):
        for batch in batches:
            out: list[list[list[int]]] = []
            for a, b, data, offsets in _blocks(batch, 1):
                doc, sentence, cell, _ = words_by_sentence(data, offsets)
                of = dict(zip(sentence.tolist(), doc.tolist(), strict=True))
                bags: list[list[list[int]]] = [[] for _ in range(b - a)]
                s, w = _pairs(sentence, number[cell] + 1)
                s, w = s[w > 0], w[w > 0] - 1
                edges = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True]) if len(s) else np.zeros(1, np.int64)
                for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    bags[of[int(s[i])]].append(w[i:j].tolist())
                out += bags
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.list_(pa.int32())))], ["toxic", "bags"])

    small = sample.mapInArrow(shrink, "toxic boolean, bags array<array<int>>").toArrow()
    bags = [[np.array(s) for s in b] for b in small.column(1).to_pylist()]
    weight, bias, leak = fit(bags, np.array(small.column(0).to_pylist(), bool), len(chosen), np.clip(odds[chosen], -3, 3))
    full = np.zeros(CELLS, np.float32)
    full[chosen] = weight
    return Model(full, bias, leak)


def sentence_scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, probability, first and last byte of every sentence."""
    doc, sentence, cell, words = words_by_sentence(data, offsets)
    if not len(doc):
        return doc, np.zeros(0), doc, doc
    n = int(sentence[-1]) + 1
    logit = np.full(n, model.bias)
    told = np.flatnonzero(model.weight[cell].any(1))
    s, w = _pairs(sentence[told], cell[told])
    logit += np.bincount(s, model.weight[w], n)
    first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
    logit[np.bincount(s, minlength=n) == 0] = -np.inf  # as in learning, which leaves such sentences out
    return doc[first], np.where(np.isneginf(logit), 0.0, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))), words.start[first], words.end[np.r_[first[1:], len(doc)] - 1]


_SPANS = "array<struct<start:int,end:int,score:double>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def score(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", *more: str, least: float = THRESHOLD) -> DataFrame:
    """Rows (id, score, offending), and the columns named in ``more``.

    offending: where the sentences lie whose own probability is ``least`` or more, in code
    points from the first word to behind the last, in order of place; empty without any.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, parts, counts = shared.value, [np.zeros(0)], [np.zeros(1, np.int64)]
        spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))]
        for a, b, data, offsets in _blocks(batch, 1):
            if model is None:
                parts.append(np.zeros(b - a))
                counts.append(np.zeros(b - a, np.int64))
                continue
            doc, p, start, end = sentence_scores(model, data, offsets)
            parts.append(1 - (1 - model.leak) * np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), b - a)))
            hit = np.flatnonzero(p >= least)
            point = np.r_[0, np.cumsum(data & 0xC0 != 0x80)]  # code points before every byte
            before = point[offsets[doc[hit]]]
            spans.append(((point[start[hit]] - before).astype(np.int32), (point[end[hit]] - before).astype(np.int32), p[hit]))
            counts.append(np.bincount(doc[hit], minlength=b - a))
        columns = [pa.array(np.concatenate(c)) for c in zip(*spans, strict=True)]
        found = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_SPAN)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(np.concatenate(parts), 0, 1)), found, *batch.columns[2:]], names)

    src = tables.texts(df, id_col, text_col, *more)
    names = ["id", "score", "offending", *more]
    kinds = [src.schema["id"].dataType.simpleString(), "double", _SPANS, *(src.schema[c].dataType.simpleString() for c in more)]
    return tables.over_batches(src, run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))).withColumnRenamed("id", id_col)


def offending(df: DataFrame, model: Model, least: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, sentence, score): the sentences whose own probability is ``least`` or more."""
    text = tables.unused(df, "_text")
    found = score(df.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit(""))), model, id_col, text_col, text, least=least)
    each = found.select(id_col, F.col(text).alias("text"), F.explode("offending").alias("at"))
    return each.select(id_col, F.expr("substring(text, at.start + 1, at.end - at.start)").alias("sentence"), "at.score")


def _folded(df: DataFrame, folds: int, held: int, id_col: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
    return df.withColumn("held_out", F.coalesce(fold == held, F.lit(True)))


def held_out_scores(documents: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Rows (id, held_out, score, predicted, offending); labels of ids whose crc32 leaves ``held``, and of null ids, are not learned."""
    folded = _folded(documents, folds, held, id_col)
    given = labels.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).alias("toxic")).where("toxic IS NOT NULL")
    tables._bounded_batches(documents.sparkSession)
    model = train_on(labelled_sample(folded.where("NOT held_out"), given, id_col, text_col))
    return score(folded, model, id_col, text_col, "held_out").select(id_col, "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")
