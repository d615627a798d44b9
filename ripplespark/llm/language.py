"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, whatever is no letter becomes a space, and every run of one to
three characters is hashed to one of ``CELLS`` cells.  Training counts cells by language
over a sample of about ``TRAIN_TEXTS`` texts of each language, chosen by a hash of text and
id, in the executors.  All values are learned.  The matrix of log probabilities, cells by
languages, is broadcast, in blocks of ``AT_A_TIME`` languages, 8 MB each, whose size doesn't
depend on the corpus; where there are several, they are files in the shared folder and a
worker holds one at a time.  Scoring counts the cells of a few texts at a time and
multiplies the counts that aren't zero with the matrix.

Null texts and texts without a letter are ``und`` with score 0, and so are all texts if
there is nothing to learn from.  Equal scores go to the language that sorts first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files, flat, tables

CELLS = 1 << 15
TRAIN_TEXTS = 2000
AT_A_TIME = 64
_GRAMS = (1, 2, 3)
_AT_ONCE = 64
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index and cell of every n-gram; and whether each text has a letter."""
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[code]
    doc = np.repeat(np.arange(len(texts)), size)
    has = np.bincount(doc[letter], minlength=len(texts)) > 0
    code = np.where(letter, code, np.uint32(32)).astype(np.uint64)
    space = code == 32
    keep = np.ones(len(code), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (doc[1:] == doc[:-1]))  # one space for many
    code, doc = code[keep], doc[keep]
    docs, made = [], []
    for n in _GRAMS:
        if len(code) < n:
            continue
        stop = len(code) - n + 1
        value = np.full(stop, n, np.uint64)
        for k in range(n):
            value = value * np.uint64(0x9E3779B97F4A7C15) + code[k : k + stop]
        whole = doc[:stop] == doc[n - 1 :]
        docs.append(doc[:stop][whole])
        made.append((flat.mix(value[whole]) >> np.uint64(49)).astype(np.int64))
    return np.concatenate(docs) if docs else doc, np.concatenate(made) if made else doc, has


def _lower_texts(column: pa.Array):
    _, offsets = flat.views(column)
    for a, b in flat.blocks(offsets, 1 << 20):
        texts = [t.lower() for t in column.slice(a, b - a).to_pylist()]
        for k in range(0, len(texts), _AT_ONCE):
            yield texts[k : k + _AT_ONCE]


Model = list[tuple[list[str], np.ndarray]]


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text", train_texts: int = TRAIN_TEXTS, id_col: str = "doc_id", at_a_time: int = AT_A_TIME) -> Model:
    """Blocks of languages in order, each with the log probabilities of cells and the log priors as a last row."""
    tables._bounded_batches(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(text, F.col(id_col).cast("string"), F.lit(7)).alias("hash"))
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(n)
    return [_block(rows, langs[k : k + at_a_time], n, train_texts) for k in range(0, len(langs), at_a_time)]


def _block(rows: DataFrame, langs: list[str], n: dict[str, int], train_texts: int) -> tuple[list[str], np.ndarray]:
    share = F.create_map(*(x for k in langs for x in (F.lit(k), F.lit(min(1.0, train_texts / n[k])))))
    sample = rows.where(F.pmod("hash", F.lit(1 << 20)) < F.try_element_at(share, F.col("lang")) * (1 << 20)).select("lang", "text")

    def run(batches):
        place = {k: i for i, k in enumerate(langs)}
        for batch in batches:
            lang = np.array([place[x] for x in batch.column(0).to_pylist()])
            counts, at = np.zeros(len(langs) * CELLS, np.int64), 0
            for texts in _lower_texts(batch.column(1)):
                doc, cell, _ = cells(texts)
                counts += np.bincount(lang[at + doc] * CELLS + cell, minlength=len(counts))
                at += len(texts)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["at", "n"])

    counts = np.zeros(len(langs) * CELLS)
    got = sample.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a number for each cell of the block at most
    counts[got.column("at").to_numpy()] = got.column("n").to_numpy()
    counts = counts.reshape(len(langs), CELLS) + 0.5
    prior = np.array([n[k] for k in langs], float)
    return langs, np.vstack([np.log(counts / counts.sum(1, keepdims=True)).T, np.log(prior / sum(n.values()))]).astype(np.float32)


def _stored(matrix: np.ndarray, folder: str) -> str:
    out, path = files.new_file(folder, ".npy")
    with out:
        out.write(np.ascontiguousarray(matrix).tobytes())
    return path


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Rows (id, lang_pred, score), and the columns named in ``more``."""
    langs = [names for names, _ in model]
    if len(model) > 1:
        folder = tables.shared_folder(df.sparkSession)
        shared, paths = None, [_stored(matrix, folder) for _, matrix in model]
    else:
        shared, paths = df.sparkSession.sparkContext.broadcast(model[0][1] if model else None), [""]

    def block(k: int) -> np.ndarray:
        if shared is not None:
            return shared.value
        with files.reader(paths[k]) as f:
            return np.frombuffer(f.read(), np.float32).reshape(CELLS + 1, len(langs[k]))

    def run(batches):
        for batch in batches:
            size = batch.num_rows
            best, high, total, has = np.full(size, "und", object), np.full(size, -np.inf), np.full(size, -np.inf), np.zeros(size, bool)
            for k, names in enumerate(langs):
                matrix, at = block(k), 0
                log, prior = matrix[:-1], matrix[-1]
                for texts in _lower_texts(batch.column(1)):
                    doc, cell, letters = cells(texts)
                    here = np.arange(at, at + len(texts))
                    has[here], at = letters, at + len(texts)
                    counts = np.bincount(doc * CELLS + cell, minlength=len(texts) * CELLS)
                    some = np.flatnonzero(counts)
                    logit = np.tile(prior.astype(np.float64), (len(texts), 1))
                    if len(some):
                        of = some // CELLS
                        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                        logit[of[first]] += np.add.reduceat(log[some % CELLS] * counts[some, None], first, dtype=np.float64)
                    top = logit.argmax(axis=1)
                    most = logit[np.arange(len(texts)), top]
                    total[here] = np.logaddexp(total[here], most + np.log(np.exp(logit - most[:, None]).sum(axis=1)))
                    better = most > high[here]  # equal ones stay with the language that sorts first
                    best[here[better]], high[here[better]] = np.array(names, object)[top[better]], most[better]
            score = np.where(has & (high > -np.inf), np.exp(np.minimum(0, high - np.where(np.isfinite(total), total, 0))), 0.0)
            best = np.where(has, best, "und")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.tolist(), pa.string()), pa.array(score), *batch.columns[2:]], names_)

    src = tables.texts(df, id_col, text_col, *more)
    names_ = ["id", "lang_pred", "score", *more]
    kinds = [src.schema["id"].dataType.simpleString(), "string", "double", *(src.schema[c].dataType.simpleString() for c in more)]
    return src.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names_, kinds, strict=True))).withColumnRenamed("id", id_col)


def held_out_predictions(df: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (id, held_out, lang_pred, score); every ``folds``-th id by its crc32 is not learned from, nor are null ids."""
    folded = df.withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(True)))
    model = train(folded.where("NOT held_out"), lang_col, text_col, id_col=id_col)
    return predict(folded, model, id_col, text_col, "held_out").select(id_col, "held_out", "lang_pred", "score")
