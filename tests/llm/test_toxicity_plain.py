"""Scores and offending sentences against a plain reading of the model, one text at a time."""

from __future__ import annotations

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from ripplespark.llm import toxicity


def plain(model, text):
    """(score, spans) of a text: sentences cut at stops, words by bytes, a cell for each word and for its first bytes."""
    raw = (text or "").encode()
    log_rest, spans, at = math.log1p(-model.leak), [], 0
    for sentence in re.split(rb"[.!?\n]", raw):
        words = [(m.start(), m.end()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", sentence)]
        cells = {int(c) for a, b in words for c in toxicity.words_by_sentence(np.frombuffer(sentence[a:b], np.uint8), np.array([0, b - a]))[2][0]}
        told = [float(model.weight[c]) for c in cells if model.weight[c]]
        if told:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, model.bias + sum(told)))))
            log_rest += math.log1p(-min(p, 1 - 1e-12))
            if p >= toxicity.THRESHOLD:
                spans.append((len(raw[: at + words[0][0]].decode()), len(raw[: at + words[-1][1]].decode()), p))
        at += len(sentence) + 1
    return 1 - math.exp(log_rest), spans


def corpus():
    r = random.Random(4)
    clean = "We met in the garden. The weather was fine! Über den Wolken? A plain report\nwith several lines. Nothing to add here".split(" ")
    return [(k, " ".join(r.choices(clean, k=30)) + (". You vile worthless scum! And on it goes" if k % 3 == 0 else ""), k % 3 == 0) for k in range(400)]


def test_against_a_plain_version(spark):
    rows = corpus()
    odd = [(1000, None), (1001, ""), (1002, "..!\n?"), (1003, "é. scum über vile ☃! ok 😀 scum"), (1003, "é. scum über vile ☃! ok 😀 scum"), (None, "vile"), (1004, "scum. " * 30000), (1005, "VILE Scum, worthless")]
    df = spark.createDataFrame([(k, t) for k, t, _ in rows] + odd, "doc_id long, text string").withColumns({"id": F.lit("x"), "score": F.lit(1), "offending": F.lit(2), "held_out": F.lit(3), "_text": F.lit(4), "toxic": F.lit(1)})
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic boolean").withColumn("toxic", F.col("toxic").cast("int")))
    got = sorted(toxicity.score(df, model).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    want = sorted([(k, t) for k, t, _ in rows] + odd, key=lambda r: (r[0] is None, r[0]))
    assert [r["doc_id"] for r in got] == [k for k, _ in want]
    for r, (_, text) in zip(got, want, strict=True):
        score, spans = plain(model, text)
        assert abs(r["score"] - score) < 1e-6
        assert [(s["start"], s["end"]) for s in r["offending"]] == [s[:2] for s in spans]
        assert all(abs(s["score"] - p) < 1e-6 for s, (_, _, p) in zip(r["offending"], spans, strict=True))
    assert sum(len(r["offending"]) for r in got) > 30_000
    sentences = {(x["doc_id"], x["sentence"]) for x in toxicity.offending(df.where("doc_id = 1003"), model).collect()}
    assert sentences and all(s in "é. scum über vile ☃! ok 😀 scum" for _, s in sentences)


def test_held_out_rows_with_places_and_ties(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(k + 5000, "You vile worthless scum!") for k in range(8)], "doc_id long, text string").withColumns({"score": F.lit(None), "predicted": F.lit("a"), "hash": F.lit(0)})
    labels = spark.createDataFrame([(k, int(y)) for k, _, y in rows], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.held_out_scores(docs, labels).collect()}
    assert len(out) == len(rows) + 8 and out[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted", "offending"}
    assert len({out[k + 5000]["score"] for k in range(8)}) == 1  # equal texts score alike
    assert all(bool(out[k]["offending"]) == y == bool(out[k]["predicted"]) for k, _, y in rows)
    empty = toxicity.held_out_scores(docs, labels.where("false")).collect()
    assert {(r["score"], len(r["offending"])) for r in empty} == {(0.0, 0)}
