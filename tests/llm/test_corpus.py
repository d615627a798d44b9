"""Near-dedup and the models, against brute force and on held-out rows; archives and token files there and back."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ripplespark.llm import bpe, files, flat, html_text, language, near_dedup, token_counts, toxicity, warc

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def words(seed, n):
    r = random.Random(seed)
    return [f"{r.choice('bcdfgklmnprst')}{r.choice('aeiou')}{r.choice('lnrst')}{r.randint(0, 99)}" for _ in range(n)]


def table(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in texts], "doc_id long, text string, _key string, _id int").repartition(3)


# near copies ---------------------------------------------------------------------------


def plain_classes(texts):
    """Class of each row by comparing all pairs of texts."""
    def bag(text):
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return Counter(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else Counter()

    bags, n = [bag(t) for _, t in texts], len(texts)
    one_each = [bag(t) for t in {t or "" for _, t in texts}]
    held, different = Counter(s for b in one_each for s in b), sum(map(bool, one_each))
    idf = lambda s: math.log(1 + different / (held[s] + 0.1 * different))
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(n):
        for j in range(i):
            both = set(bags[i]) | set(bags[j])
            low = sum(min(bags[i][s], bags[j][s]) * idf(s) for s in both)
            high = sum(max(bags[i][s], bags[j][s]) * idf(s) for s in both)
            if (texts[i][1] or "") == (texts[j][1] or "") or (high and low / high >= 0.8):
                parent[root(i)] = root(j)
    least = {}
    for k, (key, _) in enumerate(texts):
        if key is not None:
            least[root(k)] = min(key, least.get(root(k), key))
    return [(key, least.get(root(k)), sum(root(j) == root(k) for j in range(n))) for k, (key, _) in enumerate(texts)]


@pytest.fixture(scope="module")
def copies():
    base = {k: words(k, 120) for k in range(12)}
    texts = [(k, " ".join(w)) for k, w in base.items()]
    texts += [(100 + k, " ".join(base[0][:k] + ["changed"] + base[0][k + 1 :])) for k in range(0, 120, 8)]
    texts += [(200, " ".join(base[1][:90] + words(77, 30))), (201, " ".join(w.upper() for w in base[2])), (300, None), (301, ""), (302, "..."), (303, "..."), (304, "two words"), (305, "Two words"), (306, "two word")]
    return texts + texts[:2] + [(None, " ".join(base[3])), (5, " ".join(base[4] + ["end"]))]


def test_near_classes_equal_brute_force(spark, copies):
    got = sorted(map(tuple, near_dedup.near_classes(table(spark, copies)).collect()), key=repr)
    assert got == sorted(plain_classes(copies), key=repr)


def test_one_row_of_each_class_stays(spark, copies):
    df = table(spark, copies)
    kept = near_dedup.keep_first(df)
    want = Counter(c for _, c, _ in set(plain_classes(copies)))
    assert kept.columns == df.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(list(want))
    assert near_dedup.keep_first(df.where("false")).count() == 0 and near_dedup.near_classes(df.where("false")).count() == 0


def test_classes_whose_ids_are_all_null_keep_a_row(spark):
    alike = words(20, 120)
    texts = [(None, " ".join(words(21, 120))), (None, " ".join(words(22, 120))), (None, " ".join(alike)), (None, " ".join([*alike, "end"])), (None, "..."), (1, "one two")]
    kept = [r["text"] for r in near_dedup.keep_first(table(spark, texts)).collect()]
    assert len(kept) == 5 and {texts[k][1] for k in (0, 1, 4, 5)} <= set(kept)


def test_blocks_of_seen_or_wordless_texts_and_very_long_ones(spark):
    """A block may hold nothing new: a text of more than a block, again, and blocks without words."""
    long = " ".join(f"{w}{k}" for k in range(1500) for w in words(8, 100))
    texts = [(1, long), (2, long), (3, "... " * 300_000), (4, "... " * 300_000), (5, long + " end"), (6, "--")]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    got = sorted((r["doc_id"], r["class_id"]) for r in near_dedup.near_classes(df).collect())
    assert len(long) > flat.BLOCK_BYTES and got == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 1), (6, 6)]


def test_chains_and_large_groups(spark):
    """Copies of copies hold together, though the ends are far apart; the driver sees none of them."""
    chain, now = [], words(5, 200)
    for k in range(12):
        chain.append((k, " ".join(now)))
        now = now[:10 * k] + words(1000 + k, 4) + now[10 * k + 4 :]
    group = [(500 + k, " ".join(words(9, 150) + [f"tail{k}"])) for k in range(300)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(table(spark, chain + group)).collect()}
    assert {got[k] for k in range(12)} == {0} and {got[500 + k] for k in range(300)} == {500}


def drawn_rows(spark, vectors):
    """Texts as they are drawn, all in one band; vectors: weights of shingles by key."""
    made = []
    for key, weights in vectors.items():
        hashes = np.array(sorted(weights), np.uint64)
        packed = near_dedup.packed(hashes, np.array([weights[h] for h in hashes.tolist()], np.float32))
        made.append((bytearray(key.encode()), [7], bytearray(packed), float(sum(weights.values()))))
    drawn = spark.createDataFrame(made, "key binary, bands array<bigint>, shingles binary, mass double")
    return drawn.select("key", "bands"), lambda keys: drawn.join(keys, "key", "left_semi").select("key", "shingles", "mass")


def label_sets(labels):
    groups = {}
    for r in labels.collect() if labels is not None else []:
        groups.setdefault(bytes(r["label"]), set()).add(bytes(r["key"]).decode())
    return sorted(map(sorted, groups.values()))


def test_texts_of_a_band_are_compared_where_pivots_are_far(spark):
    """The two least keys are near each other; pivots are the greatest ones, which are near none."""
    vectors = {k: {100 * n + j: 1.0 for j in range(20)} for n, k in enumerate("cdefghi")}
    vectors |= {"a": {j + 5000: 1.0 for j in range(20)}, "b": {j + 5001: 1.0 for j in range(20)}}
    assert label_sets(near_dedup._labels(*drawn_rows(spark, vectors))) == [["a", "b"]]


def test_every_pair_of_a_large_band_is_linked_or_compared(spark):
    """Far texts have the greatest keys and become pivots; x joins a pivot, and y is near x but not near the pivot."""
    run = lambda a, n=20: {j: 1.0 for j in range(a, a + n)}
    vectors = {f"t{n:02}": run(1000 * (n + 10)) for n in range(60)}
    vectors |= {"a": run(100), "b": run(101), "c": run(300), "d": run(301), "z": run(500), "x": run(502), "y": run(504)}
    assert label_sets(near_dedup._labels(*drawn_rows(spark, vectors))) == [["a", "b"], ["c", "d"], ["x", "y", "z"]]


def drawn_texts(texts, frequent=None):
    """Shingle hashes and weights of each text, and its band keys, as the operator makes them."""
    data, offsets = flat.views(pa.array(texts))
    doc, hashes, counts = near_dedup.shingles(data, offsets)
    weight = near_dedup.weights(hashes, counts, frequent or near_dedup.Frequencies(1, 0, np.zeros((near_dedup.DEPTH, 1 << near_dedup.BITS), np.int64)))
    return [(hashes[doc == k], weight[doc == k]) for k in range(len(texts))], near_dedup.band_keys(doc, hashes, weight)


@pytest.mark.parametrize(("n", "other"), [(400, 60), (400, 20), (3000, 300), (60, 4)])
def test_samples_agree_as_often_as_texts_are_similar(n, other):
    texts, want = [], []
    for k in range(40):
        a = words(100 * n + k, n)
        texts += [" ".join(a), " ".join(a[: n - other] + words(7 * k + 1, other))]
    bags, (at, keys) = drawn_texts(texts)
    assert at.tolist() == list(range(80))
    for k in range(0, 80, 2):
        want.append(near_dedup.similarity(*(near_dedup.packed(*b) for b in bags[k : k + 2])))
    plain = (n - other - 4) / (n - 4 + other)
    assert np.allclose(want, plain, atol=0.01)
    agree = (keys[0::2] == keys[1::2]).mean()  # over 640 bands
    assert abs(agree - np.mean(np.array(want) ** near_dedup.ROWS)) < 0.08


def counted(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    keyed = df.select(F.col("doc_id").alias("id"), "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"))
    return near_dedup.frequencies(near_dedup.shingled(keyed))


def test_frequencies_count_different_texts(spark):
    """A passage in 4 of 40 texts weighs the same however many copies of an unrelated text there are."""
    passage = words(50, 30)
    texts = [" ".join(words(500 + k, 40) + (passage if k < 4 else [])) for k in range(40)]
    one, many = counted(spark, texts), counted(spark, texts + [texts[20]] * 60 + ["", "..."])
    assert one.texts == many.texts == 40 and one.load == many.load == 0 and (one.cells == many.cells).all()
    data, offsets = flat.views(pa.array([" ".join(passage)]))
    _, hashes, counts = near_dedup.shingles(data, offsets)
    assert np.allclose(near_dedup.weights(hashes, counts, many), math.log(1 + 40 / (4 + 0.1 * 40)), rtol=1e-6)
    assert near_dedup.weights(hashes[:0], counts[:0], many).shape == (0,) and counted(spark, ["..."]).texts == 0


def test_counts_in_a_text_of_any_size(spark):
    texts = ["a b c d e " * 400, "x y z", "one two three four five six", "... "]
    df = spark.createDataFrame([(bytearray(bytes([k])), t) for k, t in enumerate(texts)], "key binary, text string")
    rows = {r["key"][0]: r for r in near_dedup.shingled(df).collect()}
    batch = pa.record_batch([pa.array([bytes(r["hashes"]) for r in rows.values()], pa.binary()), pa.array([bytes(r["counts"]) for r in rows.values()], pa.binary())], ["hashes", "counts"])
    doc, _, counts = near_dedup._unpacked(batch)
    got = {k: sorted(counts[doc == n].tolist()) for n, k in enumerate(rows)}
    assert got == {0: [399, 399, 399, 399, 400], 1: [1], 2: [1, 1]}


def test_recall_against_all_pairs(spark):
    """Recall over all pairs of texts of a similarity of 0.8 or more, by exact counts of the texts that hold a shingle."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = [(10**6 + 100 * i + k, " ".join(w[:j] + [f"new{k}"] + w[j + 1 :])) for i, w in enumerate([words(31, 150), words(32, 60)]) for k in range(90) for j in [k % 50]]
    df = df.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    texts = sorted({t or "" for _, t in rows})
    found = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    plain = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter() for w in found]
    held, different = Counter(s for b in plain for s in b), sum(map(bool, plain))
    bags = [(list(b), np.array([n * math.log(1 + different / (held[s] + 0.1 * different)) for s, n in b.items()])) for b in plain]
    holders, total = {}, [float(w.sum()) for _, w in bags]
    for k, (h, w) in enumerate(bags):
        for s, x in zip(h, w.tolist(), strict=True):
            holders.setdefault(s, []).append((k, x))
    shared = Counter()
    for held in holders.values():
        for i, (a, x) in enumerate(held):
            for b, y in held[:i]:
                shared[a, b] += min(x, y)
    near = [p for p, x in shared.items() if x >= 0.8 * (total[p[0]] + total[p[1]] - x)]
    linked = [p for p, x in shared.items() if x >= 0.799 * (total[p[0]] + total[p[1]] - x)]
    found = near_dedup.near_classes(df).collect()
    text_of = dict(rows)
    group = {text_of[r["doc_id"]] or "": r["class_id"] for r in found}
    assert len(near) > 1000 and np.mean([group[texts[a]] == group[texts[b]] for a, b in near]) > 0.99
    parent = {t: t for t in texts}  # and no class holds what no chain of near pairs links

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in linked:  # counts of the sketch may differ a little
        parent[root(texts[a])] = root(texts[b])
    assert all(len({root(t) for t in texts if group[t] == g}) == 1 for g in set(group.values()))


# models --------------------------------------------------------------------------------


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.held_out_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(out) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.95 and all(0 <= r["score"] <= 1 for r in out)


def test_language_of_odd_texts(spark):
    rows = [(k, t, g) for k, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 6 + [(None, "en"), ("123 !", None), ("", "de"), ("the dog " * 20000, None)])]
    df = spark.createDataFrame(rows + rows[:2] + [(None, "und die katze", None)], "doc_id long, text string, lang string")
    out = language.held_out_predictions(df).collect()
    got = {r["doc_id"]: r["lang_pred"] for r in out}
    assert len(out) == len(rows) + 3 and got[12] == got[13] == got[14] == "und" and got[15] == "en" and got[None] == "de"
    assert {r["lang_pred"] for r in language.held_out_predictions(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.held_out_predictions(df.where("false")).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    out = toxicity.held_out_scores(some, labels).join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    ranked = sorted(out, key=lambda r: r["score"])
    n1 = sum(r["toxic"] for r in out)
    auc = (sum(k + 1 for k, r in enumerate(ranked) if r["toxic"]) - n1 * (n1 + 1) / 2) / (n1 * (len(out) - n1))
    assert auc > 0.9 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)


def test_toxic_sentences_are_located_and_odd_rows_scored(spark):
    r = random.Random(3)
    clean = ["The garden is green today.", "We read a book.", "Rain fell on the old town.", "Bread was sold there."]
    rows = [(k, " ".join(r.choices(clean, k=6) + (["You vile worthless scum!"] if k % 3 == 0 else [])), int(k % 3 == 0)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df)
    found = {(x["doc_id"], x["sentence"]) for x in toxicity.offending(df, model).collect()}
    assert found == {(k, "You vile worthless scum") for k, _, y in rows if y}
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "scum " * 50000), (None, "vile")], "doc_id long, text string")
    labels = df.select("doc_id", "toxic").union(spark.createDataFrame([(0, 0), (1, None)], "doc_id long, toxic int"))
    out = toxicity.held_out_scores(df.select("doc_id", "text").union(odd), labels).collect()
    assert len(out) == 404 and all(0 <= x["score"] <= 1 for x in out)
    assert {x["score"] for x in toxicity.held_out_scores(odd, labels.where("false")).collect()} == {0.0}
    assert toxicity.held_out_scores(odd.where("false"), labels).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    parent = np.array([-1, 0, 0, 1, 1, 2])
    trees = html_text.Forest(parent, np.array([0, 1, 1, 2, 2, 2]), np.array([False, True, False, True, False, False]), np.eye(6, dtype=np.float32))
    model = html_text.Model(rng.normal(size=6), rng.normal(size=(2, 2, 2)))
    total, on = 0.0, np.zeros(6)
    for code in range(64):
        y = np.array([code >> k & 1 for k in range(6)])
        p = math.exp((model.weights * y).sum() + sum(model.edges[int(trees.inline[k]), y[parent[k]], y[k]] for k in range(1, 6)))
        total, on = total + p, on + p * y
    assert np.allclose(html_text.marginals(trees, model)[0], on / total, atol=1e-6)


def test_main_text(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav><article><h1>A &amp; B</h1>
    <p>First  paragraph of <b>this</b> text, which is long enough to read.</p><p>Second one, with some words more than the first has.<script>var x = 1;</script></article>
    <div class="comments"><h3>Comments</h3><div class="comment"><p>Nice, thanks.</p></div></div><footer>&copy; Nobody</footer></body></html>"""
    rows = [(1, page, "u"), (2, None, None), (3, "", "u"), (4, "<html><body><script>x</script></body>", "u"), (1, page, "u"), (None, page, "u")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string").withColumn("text", F.lit(7)).withColumn("id", F.lit(8))
    out = html_text.main_text(df, "page_id", "html", "url").collect()
    text = "A & B\nFirst paragraph of this text, which is long enough to read.\nSecond one, with some words more than the first has."
    assert sorted(((r["page_id"], r["text"], r["n_chars"]) for r in out), key=repr) == sorted([(1, text, len(text))] * 2 + [(None, text, len(text))] + [(k, "", 0) for k in (2, 3, 4)], key=repr)
    assert html_text.main_text(df.where("false"), "page_id", "html").count() == 0
    pages, labels = html_text.labelled_pages(60, seed=99)
    p = html_text.marginals(html_text.forest(pages), html_text.trained())[0]
    assert np.mean((p >= 0.5) == np.concatenate(labels)) > 0.95


@pytest.mark.parametrize("before", ["<head><title>T</title>", "<head><title>T", "<head><meta charset=utf-8><script>'<body>'</script><title>T</title><body>", "<body><select><option>no", "<object><param name=a>no", "<noscript>no", "<svg><path d=''/>no"])
def test_unclosed_elements_do_not_swallow_the_page(before):
    got = html_text.parse(f"{before}<div><p>First words.</p></div><select><option>x</select><p>Last words.</p>").texts
    assert [t for _, _, t in got] == ["First words.", "Last words."]
    assert [t for _, _, t in html_text.parse("<head><title>T</title>Plain text").texts] == ["Plain text"]


LINES = "<p>One line of an article, which goes on for a while.</p>"
WHOLE = "One line of an article, which goes on for a while."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<html><head><title>x</title><body><article>{LINES}</article>", WHOLE),
        (f"<body><article><svg class=i />{LINES}<svg/>{LINES}</article><svg></svg>", f"{WHOLE}\n{WHOLE}"),
        (f"<body><article>{LINES}<svg a=b/>no</svg>{LINES}</article>", f"{WHOLE}\n{WHOLE}"),
        (f"<body><object>{LINES}", WHOLE),
        (f"<body><select><option>no{LINES}", WHOLE),
        (f"<body><article><div/>{LINES}<a href=/x/>more of it</a> and the end</article><footer>foot</footer>", f"{WHOLE}\nmore of it and the end"),
        ("<article><p>Short one.</p></article>", "Short one."),
        ("<html><body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>Short one.</p></article><footer>c</footer></body></html>", "T\nShort one."),
        ("<p>Hello world.</p>", "Hello world."),
        ("Just plain text", "Just plain text"),
        ("<div id=content><p>Two words.</p></div>", "Two words."),
        ("<body><nav><a href=/>Home</a> <a href=/x>News</a></nav><footer>Nobody</footer>", ""),
        ("<body><div class=content><p>" + "Some words. " * 100_000 + "</p></div>", "Some words. " * 99_999 + "Some words."),
        ("<div>" * 50_000 + "<b>" * 50_000 + "deep text" + "</i>" * 50_000, "deep text"),
        ("<article>" + LINES * 3000 + "</article>", "\n".join([WHOLE] * 3000)),
    ],
)
def test_pages_keep_their_text(page, text):
    assert html_text.extract([html_text.parse(page)], html_text.trained()) == [text]


def test_text_of_held_out_layouts():
    pages, labels = html_text.labelled_pages(200, seed=77)
    same = 0
    for page, y, got in zip(pages, labels, html_text.extract(pages, html_text.trained()), strict=True):
        blocks = {}
        for node, block, text in page.texts:
            if y[node]:
                blocks.setdefault(block, []).append(text)
        same += got == "\n".join(filter(None, (" ".join("".join(b).split()) for b in blocks.values())))
    assert same >= 0.95 * len(pages)


# files ---------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big, other = "<p>" + "é" * 300 + "</p>", "<p>" + "x" * 200 + "</p>"
    rows = [(5, "http://a/1", big), (2, "http://a/ü\n", big), (9, None, other), (9, "again", other), (3, "s", "small"), (4, "s", "small"), (6, "n", None), (None, "no id", big), (7, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n", F.lit(1)).repartition(2)
    out = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archived(df).collect()]
    def told(key, html, first):
        raw = (html or "").encode()
        again = len(raw) >= 100 and key != first
        return key, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None
    assert sorted(out, key=repr) == sorted([told(k, h, {big: 2, other: 9}.get(h)) for k, _, h in rows], key=repr)
    assert warc.archived(df.where("false")).count() == 0
    assert sorted((r["url"] or "" for r in warc.archived(df).collect())) == sorted(u or "" for _, u, _ in rows)
    named = spark.createDataFrame([("a%20b ü\r\n", "http://a/%41?ü= x", big), ("100%", "http://a/%41", big), ("zz", None, big)], "page_id string, url string, html string")
    out = {r["page_id"]: (r["url"], r["record_type"], r["refers_to"]) for r in warc.archived(named).collect()}
    assert out == {"100%": ("http://a/%41", "response", None), "a%20b ü\r\n": ("http://a/%41?ü= x", "revisit", "100%"), "zz": (None, "revisit", "100%")}


def test_normalised_archives_have_a_member_for_each_record(spark, tmp_path):
    df = spark.createDataFrame([(k, f"http://a/{k}", f"<p>{k}</p>" * 200) for k in range(20)], "page_id long, url string, html string").coalesce(1)
    written = warc.write(df, str(tmp_path / "w"), file_bytes=5000)
    index = warc.normalise(written, warc.revisits(written)).collect()
    assert len({r["path"] for r in index}) > 3 and len(index) == 20
    for r in index:
        with open(r["path"], "rb") as file:
            file.seek(r["offset"])
            raw = zlib.decompress(file.read(r["length"]), 31)
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and b"\r\nWARC-Date: 20" in raw and b"\r\nWARC-Record-ID: <urn:" in raw
    with open(index[0]["path"] + ".index") as file:
        assert [line.split("\t")[0] for line in file] == [str(r["offset"]) for r in index if r["path"] == index[0]["path"]]
    with pytest.raises(ValueError, match="cut short"):
        list(warc.records(iter([b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"])))


@pytest.mark.parametrize("block_tokens", [3, 7, 1 << 18])
def test_token_counts_over_block_borders(spark, tmp_path, block_tokens):
    sizes, end = [0, 2, 0, 9, 1, 30, 3], 49407
    ids = np.concatenate([np.r_[np.arange(1, n + 1), end] for n in sizes] + [[1, 2]]).astype("<u2")
    (tmp_path / "a").write_bytes(ids.tobytes())
    (tmp_path / "b").write_bytes(b"")
    paths = spark.createDataFrame([(str(tmp_path / "a"), len(ids)), (str(tmp_path / "b"), 0)], "path string, tokens long")
    for run_blocks in (1, 2, 4096):
        got = sorted((r["n"], r["start"], r["tokens"]) for r in token_counts.count(paths, end, block_tokens, run_blocks).collect())
        starts = np.cumsum([0] + [n + 1 for n in sizes]).tolist()
        assert got == [(k, starts[k], n) for k, n in enumerate([*sizes, 2])], run_blocks


def test_token_counts_of_documents(spark):
    texts = [(1, "one two three"), (2, None), (3, ""), (1, "one two three"), (None, "x"), (4, "word " * 20000), (5, "a <|endoftext|> b")]
    df = table(spark, texts)
    told = Tokenizer.from_file(PATH)
    told.no_truncation()
    told.no_padding()
    plain = lambda t: len(told.encode((t or "").replace("<|", "< |"), add_special_tokens=False).ids)
    own = int(bpe.WordBPE(PATH, specials=False).encode([texts[-1][1]])[1][0])  # special strings count as plain text here
    want = sorted(((k, own if k == 5 else plain(t)) for k, t in texts), key=repr)
    assert sorted(map(tuple, token_counts.counted(df, PATH).collect()), key=repr) == want
    assert token_counts.counted(df.where("false"), PATH).count() == 0


# shared parts and the pipeline -----------------------------------------------------------


def test_flat_words_and_hashes():
    texts = ["", "a b", "über  x", "", "a b"]
    import pyarrow as pa

    data, offsets = flat.views(pa.array(["skip", *texts]).slice(1))
    found = flat.find_words(data, offsets, flat.NOT_BLANK)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(found.start, found.end, strict=True)] == ["a", "b", "über", "x", "a", "b"] and found.doc.tolist() == [1, 1, 2, 2, 4, 4]
    hashes = flat.hash_ranges(data, found.start, found.end)
    assert hashes[0] == hashes[4] and len(set(hashes.tolist())) == 4
    assert [r for r in flat.blocks(np.array([0, 5, 5, 50, 51]), 10)] == [(0, 2), (2, 3), (3, 4)]
    assert files.located("/x/y")[1] == "/x/y"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = docs.columns
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == own, name
        before, kept = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (now, after))
        assert kept <= before
        now = after.persist()
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in now.select("doc_id").collect()}
    one = out.where("n_tokens > 0").first()
    assert hashlib.sha256(np.array(one["ids"], "<u4").tobytes()).hexdigest() == one["ids_sha256"]


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, extra columns of clashing names, and no rows at all."""
    good = [" ".join(words(40 + k, 80)) for k in range(3)]
    rows = [(1, good[0], "en", "a", 1), (1, good[0], "en", "a", 1), (None, good[1], None, None, None), (2, None, None, None, None), (3, "", "en", "a", 0), (4, good[2] + " ghp_" + "a1B2" * 9, "en", "b", 5), (5, good[0] + " end", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(1) for c in ("id", "ids", "found", "spans", "row", "live", "of", "_row", "n_words")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]) for r in out)) == ["1", "4", "None"]
    (tmp_path / "none").mkdir()
    docs.where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "benchmark.parquet")).write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
