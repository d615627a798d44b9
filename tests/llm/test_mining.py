"""Hard negatives, personal data and collocations against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplespark.llm import collocation, hard_negatives, pii

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_negatives(rows, anchor, positives=5, negatives=3):
    """Every anchor compared with every row; rows: (id, vector, label)."""
    fine = [(n, i, np.floor(256 * np.array(v, dtype=float)).astype(int).tolist(), c) for n, (i, v, c) in enumerate(rows)
            if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for n, i, v, c in fine:
        if not anchor(i):
            continue
        ranked = sorted(((-score(v, w), j, m, d) for m, j, w, d in fine if m != n))
        for s, p, _, _ in [x for x in ranked if x[3] == c][:positives]:
            near = [(t, j) for t, j, _, d in ranked if d != c and -50 * s <= -100 * t <= -95 * s][:negatives]
            out += [(i, p, k, j, -s, -t) for k, (t, j) in enumerate(near, 1)]
    return sorted(out)


def mined(spark, rows, anchor, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS + ", row string").repartition(4)
    return sorted(map(tuple, hard_negatives.mine(df, anchor, **more).collect()))


def test_hard_negatives_equal_plain_comparison(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(6, 12))
    rows = [(k, [float(x) for x in np.float32(middles[k % 6] + rng.normal(size=12) * 0.7) / 4], int(k % 6) % 4) for k in range(700)]
    rows += [(900, rows[0][1], 0)] * 150 + [(901, rows[0][1], 1)] * 150 + [(50, rows[50][1], rows[50][2])]
    got = mined(spark, rows, F.col("vec_id") % 50 == 0)
    assert got == plain_negatives(rows, lambda i: i % 50 == 0)
    assert len(got) > 300


def test_hard_negatives_of_odd_rows(spark):
    rows = [
        (0, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.4, 0.4], 2), (3, [0.4, 0.4], 2), (4, None, 1), (5, [None, 0.5], 1), (6, [float("nan"), 0.5], 2), (7, [float("inf"), 0.5], 2),
        (None, [0.5, 0.5], 1), (8, [0.5, 0.5], None), (9, [], 1), (10, [0.45], 2), (11, [0.3, 0.3, 0.3], 2), (0, [0.5, 0.5], 1), (50, [-0.5, -0.5], 1), (100, [0.0, 0.0], 3), (101, [0.0, 0.0], 3),
    ]
    got = mined(spark, rows, F.col("vec_id") % 50 == 0)
    assert got == plain_negatives(rows, lambda i: i % 50 == 0) and got
    assert mined(spark, [], F.col("vec_id") % 50 == 0) == []
    assert mined(spark, [(0, [], 1), (1, [], 1), (2, [], 2)], F.col("vec_id") == 0) == [(0, 1, 1, 2, 0, 0)]
    large = [(0, [2.0**20, 1.0], 1), (1, [2.0**20, 2.0], 1), (2, [943718.0, 2.0], 2)]
    assert mined(spark, large, F.col("vec_id") == 0) == plain_negatives(large, lambda i: i == 0)


def test_brackets_hold_exact_scores():
    rng = np.random.default_rng(1)
    rows, asks = (rng.integers(-200, 200, (n, 9)) for n in (300, 40))
    most = float(max(hard_negatives.squares(rows).max(), hard_negatives.squares(asks).max()))
    pivots = hard_negatives.chosen(rows[:50], most, 6)
    stored = hard_negatives.distances(rows, np.sqrt(most - hard_negatives.squares(rows)), pivots)
    asked = hard_negatives.distances(asks, np.zeros(len(asks)), pivots)
    low, high = hard_negatives.brackets(asked, hard_negatives.squares(asks), stored, most)
    exact = hard_negatives.products(asks, rows)
    assert (low <= exact).all() and (exact <= high).all()
    assert (high < exact.max(axis=1)[:, None]).any()  # so some rows need no exact score


def plain_spans(text):
    """Base spans by the patterns as they are stated."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(digits) <= 19 and sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_base_spans_of_personal_data_equal_plain_patterns(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("0123456789 -.+@()aZ_%\x01\x02é𝒳") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice(["4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "256.1.1.1", "a.b@c.de", "_x@y.org.", "+1 (543) 555-9258", " ", ".", "-", "7", "@"]) for _ in range(12)) for _ in range(2000)]
    texts += ["x@" + "a." * 20000 + "b", "1" * 2000, "1 " * 3000, "a." * 2000, "1." * 2000, "+" * 30000 + "1", "a@" * 20000, "a@b.c" * 3000, "4111111111111111 x " * 1500, None, "", "\x01\x02"]
    df = spark.createDataFrame([(k % 4000 if k != 7 else None, t, [k]) for k, t in enumerate(texts)], "doc_id long, text string, row array<int>").repartition(4)
    scanned = pii.scan(df)
    got = pii.report(scanned).collect()
    assert len(got) == len(texts)
    digest = lambda t: hashlib.sha256(plain_spans(t or "").encode()).hexdigest()
    assert Counter(r.base_sha256 for r in got) == Counter(map(digest, texts))
    n = Counter()
    for r in got:
        n.update({k: r[f"n_{k}"] for k in pii.BASE_KINDS})
    assert n == Counter(part.split(":")[0] for t in texts for part in plain_spans(t or "").split(",") if part)
    assert pii.report(pii.scan(df.limit(0))).count() == 0
    nulls = pii.report(pii.scan(df.limit(3).withColumn("text", F.lit(None)))).collect()
    assert [r.spans for r in nulls] == ["", "", ""]


def test_further_personal_data_is_learned(spark):
    good = "Mr. John Smith, born 12.03.1980, phone (415) 555-2671, ssn 123-45-6789, iban DE89 3704 0044 0532 0130 00, mail ann.lee@acme.com"
    bad = "Order part 000-00-0000 of version 99.99.2999."
    df = spark.createDataFrame([(k, good.replace("1980", str(1950 + k % 40)).replace("6789", str(1000 + k))) for k in range(40)] + [(100 + k, bad) for k in range(40)], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in pii.scan(df).collect()}
    assert {k for k, _ in got[3]} == {"person", "born", "national", "ssn", "iban", "email"}
    assert not got[103]


def test_reliabilities_of_labelers():
    rng = random.Random(2)
    right = {"shape": 0.95, "gazetteer": 0.8, "context": 0.6, "denial": 0.55, "edge": 0.9}
    seen, truth = Counter(), Counter()
    for _ in range(20000):
        yes = rng.random() < 0.4
        pattern = tuple((1 if (rng.random() < right[v]) == yes else -1) if rng.random() < 0.8 else 0 for v in pii.LABELERS)
        seen[pattern] += 1
        truth[pattern] += yes
    posteriors, told = pii.learned([{"kind": "ssn", **dict(zip(pii.LABELERS, p, strict=True)), "n": n} for p, n in seen.items()])
    assert told["shape"][1][0] > told["gazetteer"][1][0] > told["denial"][1][0]
    assert abs(told["shape"][1][0] - 0.8 * 0.95) < 0.05
    wrong = sum(abs((x["p"] >= 0.5) * seen[p] - truth[p]) for x in posteriors for p in [tuple(x[v] for v in pii.LABELERS)])
    assert wrong < 0.08 * 20000


def plain_phrases(docs, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            f[lang or "und"].update(" ".join(words[k : k + size]) for size in (1, 2, 3) for k in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if a >= least and " " in p}
        kept = []
        for p, a in some.items():
            words = p.split(" ")
            if any(len(q.split(" ")) > len(words) and f" {p} " in f" {q} " and 100 * b >= 50 * a for q, b in some.items()):
                continue
            cuts = [(1000000 * a * a // (counts[" ".join(words[:k])] * counts[" ".join(words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            kept.append((-score, -a, p.encode(), p, counts[" ".join(words[:k])], counts[" ".join(words[k:])]))
        out += [(lang, rank, p, -a, left, right, n[lang], -s) for rank, (s, a, _, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def test_collocations_equal_plain_counts(spark):
    rng = random.Random(8)
    words = ["New", "york", "city", "É", "ß", "𝒳x", "a\x0b", "the", "of", "1.5", "b\xa0c", "re\x00d"]
    docs = [(rng.choice(["en", "en", "en", None, "und", "ça"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(rng.randint(0, 80)))) for _ in range(400)]
    docs += [("en", None), (None, ""), ("en", "! ? ; \t")] + [("fr", "pomme de terre. " * 12), ("fr", "a a a a a a a a a a a a a a")] + [("en", "the the the city " * 4000)]
    df = spark.createDataFrame([(k, t, lang, "x") for k, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, phrase string").repartition(3)
    got = sorted(map(tuple, collocation.phrases(df).collect()))
    assert got == plain_phrases(docs)
    assert collocation.phrases(df.limit(0)).count() == 0
    assert sorted(map(tuple, collocation.phrases(df, top=2).collect())) == plain_phrases(docs, top=2)


@pytest.mark.parametrize("bits", [20, 16])
def test_sketch_never_counts_too_little(spark, bits):
    docs = [(k, f"w{k % 30} w{k % 7} w{k % 11} only{k}", "en") for k in range(900)]
    src = spark.createDataFrame(docs, "id long, text string, lang string").repartition(3)
    sketch = collocation.tables.saved(collocation.merged(collocation.sketched(src, bits), bits, 10), "sketch")
    kept = {r.phrase for r in collocation.survivors(src, sketch, bits).collect()}
    assert {p for _, _, p, *_ in plain_phrases([(lang, t) for _, t, lang in docs])} <= kept
    if bits == 20:
        assert not any(p and p.startswith("only") for p in kept)
