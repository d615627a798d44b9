"""MinHash near-dedup: consistent weighted sampling over TF-IDF shingles, banded and verified.

Words are lower-cased runs of letters, digits and non-ASCII characters; shingles are five
words in a row (a text of fewer words is one shingle).  A shingle weighs its count in the
text times its inverse document frequency ln(1 + N / (k + SMOOTHING * N)), where N is how
many different texts have shingles and k how many of them hold this one: copies, of this
text or of others, change no weight.  All k are kept in one count-min sketch whose size is
the same for any corpus, merged by adding up.  k comes out at most the mean load of a cell
too low, and more than twice that too high for one shingle in 3 ** DEPTH at most.  The mean
load is N times a text's average number of shingles over 2 ** BITS, mostly far less than
smoothing adds to k, and counted as nought where cells outnumber the corpus's shingles.
Smoothing bounds how much more a changed word weighs than the rest of a text of many copies.

Improved consistent weighted sampling draws ``BANDS * ROWS`` samples of a text, equal in two
texts with the probability of their weighted Jaccard similarity.  Texts that share a band
are compared with the band's pivot, the member that meets most others, so that a group of
n copies costs n comparisons and not n squared.  Members that don't match their pivot meet
further pivots.  Then every pair of a band that is in different components and was not
compared is compared, also of members that joined a pivot, unless bounds prove it apart:
similarity is at most the ratio of the texts' total weights, and distance (1 - similarity)
is a metric, so two texts are at least as far apart as their distances to the band's first
pivot differ.  Every link is verified by the weighted Jaccard similarity of all shingles,
which hashes of 32 bits stand for: among 20,000 shingles that adds 0.00005 to a similarity
at most in expectation.

Null texts count as empty.  Equal texts are one class, also wordless ones; a wordless text
is near no other.  Repeated rows and rows with a null id are ordinary members of a class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat, tables

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
#: This share of all texts is added to a shingle's document frequency.
SMOOTHING = 0.1
#: Rows of the sketch and the bits of their width; it is sent in so many parts, which are first added up in so many groups.
DEPTH, BITS, PARTS, GROUPS = 4, 18, 64, 64
#: Rounds of pivots before all that remain apart are compared; what rounding may add to a bound.
ROUNDS, SLACK = 3, 1e-3
#: Bands of up to so many texts give pairs; larger ones are compared by pairs of blocks of so many bytes.
SMALL, COMPARED_BYTES = 50, 8 << 20
_CELLS = 1 << 16
_rng = np.random.default_rng(20240229)
_gamma_r, _gamma_c, _beta = _rng.gamma(2, 1, _CELLS), _rng.gamma(2, 1, _CELLS), _rng.random(_CELLS)
#: r, 1 / r, ln c - r and beta by cell: a sample of weight S is at t = floor(ln S / r + beta), its value ln c - r * (t - beta) - r.
_R, _INVERSE, _LOG_C, _BETA = (x.astype(np.float32) for x in (_gamma_r, 1 / _gamma_r, np.log(_gamma_c), _beta))
_ODD = _rng.integers(1 << 62, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH = _rng.integers(1 << 62, size=DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, hash of 32 bits and count of every distinct shingle, in order of text and hash."""
    data = flat.LOWER[data]
    words = flat.find_words(data, offsets, flat.ALNUM)
    hashes = flat.hash_ranges(data, words.start, words.end)
    made, first = flat.window_hashes(hashes, words.doc, WIDTH)
    doc = words.doc[first]
    n = np.bincount(words.doc, minlength=len(offsets) - 1)
    short = np.flatnonzero((n > 0) & (n < WIDTH))
    if len(short):  # one shingle of all the words
        at = np.cumsum(n) - n
        one = hashes[at[short]]
        for k in range(1, WIDTH - 1):
            more = n[short] > k
            one[more] = flat.mix(one[more]) + hashes[at[short[more]] + k]
        made, doc = np.r_[made, flat.mix(one)], np.r_[doc, short]
    made = made >> np.uint64(32)
    order = np.lexsort((made, doc))
    made, doc = made[order], doc[order]
    new = np.flatnonzero(np.r_[True, (made[1:] != made[:-1]) | (doc[1:] != doc[:-1])]) if len(made) else np.zeros(0, np.int64)
    return doc[new], made[new], np.diff(np.r_[new, len(made)])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = flat.views(batch.column(batch.schema.get_field_index("text")))
        for a, b in flat.blocks(offsets):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def shingled(texts: DataFrame) -> DataFrame:
    """Rows (key, hashes, counts) for every different text that has words; key is its digest.

    Hashes are in order, 4 bytes each; counts have as many bytes each as the largest needs.
    """

    def run(batches):
        for batch, data, offsets in _blocks(batches):
            doc, hashes, counts = shingles(data, offsets)
            at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
            ends = np.r_[at[1:], len(doc)].tolist()
            own = [hashes[a:b].astype(np.uint32).tobytes() for a, b in zip(at.tolist(), ends, strict=False)]
            times = [counts[a:b].astype(np.min_scalar_type(int(counts[a:b].max()))).tobytes() for a, b in zip(at.tolist(), ends, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[at])), pa.array(own, pa.binary()), pa.array(times, pa.binary())], ["key", "hashes", "counts"])

    return texts.select("key", "text").dropDuplicates(["key"]).mapInArrow(run, "key binary, hashes binary, counts binary")


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, hash and count of every shingle of a batch of ``shingled``."""
    (raw, at), (times, own) = (flat.views(batch.column(batch.schema.get_field_index(c))) for c in ("hashes", "counts"))
    n = np.diff(at) // 4
    width = np.diff(own) // np.maximum(n, 1)
    counts = np.ones(int(n.sum()), np.int64)
    first = np.cumsum(n) - n
    for k in range(len(n)):
        counts[first[k] : first[k] + n[k]] = times[own[k] : own[k + 1]].view(f"u{width[k]}")
    return np.repeat(np.arange(len(n)), n), raw.view(np.uint32).astype(np.uint64), counts


class Frequencies(NamedTuple):
    """How many texts have shingles, the mean load of a cell, and the sketch: a row of cells for each of its hashes."""

    texts: int
    load: int
    cells: np.ndarray


def _cells(mixed: np.ndarray, row: int) -> np.ndarray:
    return ((mixed * _SKETCH[row]) >> np.uint64(64 - BITS)).astype(np.intp)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of all cells of each part and group; a part's number is -1 for texts and shingles."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for part, group, cells, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            now = np.frombuffer(cells, f"u{width}").astype(np.int64)
            sums[part, group] = sums[part, group] + now if (part, group) in sums else now
    yield _parts(sums)


def _parts(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    kinds = [np.min_scalar_type(int(x.max())) for x in sums.values()]
    cells = [x.astype(t).tobytes() for x, t in zip(sums.values(), kinds, strict=True)]
    columns = ([k[0] for k in sums], [k[1] for k in sums], cells, [t.itemsize for t in kinds])
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.int32()), strict=True)], ["part", "group", "cells", "width"])


def frequencies(of: DataFrame) -> Frequencies:
    """The sketch of how many texts of ``shingled`` hold each shingle.

    A task sends its own sketch in parts. These are added up in groups and then once more, so
    that no task adds up a part of all; the driver takes a sketch of DEPTH * 2 ** BITS cells.
    """

    def count(batches):
        cells, totals = np.zeros((DEPTH, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            hashes = flat.mix(flat.views(batch.column(0))[0].view(np.uint32).astype(np.uint64))
            for row in range(DEPTH):
                cells[row] += np.bincount(_cells(hashes, row), minlength=1 << BITS)
            totals += batch.num_rows, len(hashes)
        group = TaskContext.get().partitionId() % GROUPS
        if totals[0]:
            yield _parts({(-1, group): totals} | {(k, group): x for k, x in enumerate(cells.reshape(PARTS, -1)) if x.any()})

    schema = "part int, group int, cells binary, width int"
    grouped = of.select("hashes").mapInArrow(count, schema).repartition("part", "group").mapInArrow(_added, schema)
    whole = grouped.withColumn("group", F.lit(0)).repartition("part").mapInArrow(_added, schema).toArrow()
    cells, totals = np.zeros((PARTS, (DEPTH << BITS) // PARTS), np.int64), np.zeros(2, np.int64)
    for part, _, raw, width in zip(*(c.to_pylist() for c in whole.columns), strict=True):
        (totals if part < 0 else cells[part])[:] += np.frombuffer(raw, f"u{width}").astype(np.int64)
    return Frequencies(int(totals[0]), int(totals[1]) >> BITS, cells.reshape(DEPTH, -1))


def weights(hashes: np.ndarray, counts: np.ndarray, common: Frequencies) -> np.ndarray:
    """Count times inverse document frequency."""
    mixed = flat.mix(hashes)
    held = np.min([common.cells[row][_cells(mixed, row)] for row in range(DEPTH)], 0)
    return (counts * np.log1p(common.texts / (np.maximum(held - common.load, 1) + SMOOTHING * common.texts))).astype(np.float32)


def band_keys(doc: np.ndarray, hashes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and for each its band keys, a row of ``BANDS`` numbers.

    Three parts of a hash of shingle and sample choose r, c and beta each for itself, from
    tables of 65,536 draws: two shingles share all three with a chance of 2 ** -48.
    """
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    if not len(first):
        return doc, np.zeros((0, BANDS), np.uint64)
    run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(doc)]))
    log, mixed = np.log(weight), flat.mix(hashes)
    keys = np.empty((len(first), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(first), band, np.uint64)
        for row in range(ROWS):
            made = mixed * _ODD[band * ROWS + row]
            at_r, at_c, at_beta = ((made >> np.uint64(k) & np.uint64(_CELLS - 1)).astype(np.intp) for k in (48, 32, 16))
            r, beta = _R[at_r], _BETA[at_beta]
            step = np.floor(log * _INVERSE[at_r] + beta)
            a = _LOG_C[at_c] - r * (step - beta + np.float32(1))
            least = np.flatnonzero(a == np.minimum.reduceat(a, first)[run])
            pick = least[np.flatnonzero(np.r_[True, run[least[1:]] != run[least[:-1]]])]  # of equal ones that of the smallest hash
            key = flat.mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + flat.mix(mixed[pick] + step[pick].astype(np.int64).view(np.uint64)))
        keys[:, band] = key
    return doc[first], keys


def packed(hashes: np.ndarray, weight: np.ndarray) -> bytes:
    """Shingles of a text for comparison: sorted hashes of 32 bits, then weights."""
    return hashes.astype(np.uint32).tobytes() + weight.astype(np.float32).tobytes()


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed texts."""
    (h, w), (g, v) = ((np.frombuffer(x, np.uint32, len(x) // 8), np.frombuffer(x, np.float32, len(x) // 8, len(x) // 2)) for x in (a, b))
    if not len(h) or not len(g):
        return 0.0
    at = np.minimum(np.searchsorted(g, h), len(g) - 1)
    hit = g[at] == h
    least = float(np.minimum(w[hit], v[at[hit]]).sum(dtype=np.float64))
    return least / (float(w.sum(dtype=np.float64)) + float(v.sum(dtype=np.float64)) - least)


def _drawn(of: DataFrame, shared: Broadcast) -> DataFrame:
    """Rows (key, bands)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, hashes, counts = _unpacked(batch)
        _, bands = band_keys(doc, hashes, weights(hashes, counts, Frequencies(*shared.value)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(bands.view(np.int64)), pa.list_(pa.int64()))], ["key", "bands"])

    return tables.over_batches(of, run, "key binary, bands array<bigint>")


def _weighed(of: DataFrame, shared: Broadcast) -> DataFrame:
    """Rows (key, shingles, mass): shingles as they are compared, and their total weight."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, hashes, counts = _unpacked(batch)
        weight = weights(hashes, counts, Frequencies(*shared.value))
        edges = np.searchsorted(doc, np.arange(batch.num_rows + 1)).tolist()
        vectors = [packed(hashes[a:b], weight[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary()), pa.array(np.bincount(doc, weight, batch.num_rows))], ["key", "shingles", "mass"])

    return tables.over_batches(of, run, "key binary, shingles binary, mass double")


def _compared(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The pairs (a, b) with their weighted Jaccard similarity ``near``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = [similarity(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.float64())], ["a", "b", "near"])

    both = pairs.join(vectors.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(vectors.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    return tables.saved(tables.over_batches(both.select("a", "b", "x", "y"), run, "a binary, b binary, near double"), "compared")


def components(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows (key, label): for every linked text the smallest key of its component.

    labels: what earlier links gave; new links then join whole components. Each round every
    node takes the smallest label around it and the label of that label, until none changes.
    """
    if labels is not None:
        ends = links
        for end in ("a", "b"):
            ends = ends.join(labels.select(F.col("key").alias(end), F.col("label").alias(f"{end}_label")), end, "left").withColumn(end, F.coalesce(f"{end}_label", end)).drop(f"{end}_label")
        links = ends.where("a <> b")
    edges = tables.saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    now = tables.saved(edges.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = edges.join(now.select(F.col("key").alias("b"), F.col("label").alias("other")), "b").groupBy(F.col("a").alias("key")).agg(F.min("other").alias("other"))
        lower = now.join(near, "key").select("key", F.col("label").alias("was"), F.least("label", "other").alias("label"))
        up = now.select(F.col("key").alias("label"), F.col("label").alias("up"))
        after = tables.saved(lower.join(up, "label", "left").select("key", "was", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        now = after.select("key", "label")
        if after.where("was <> label").isEmpty():
            break
    if labels is None:
        return now
    moved = now.select(F.col("key").alias("label"), F.col("label").alias("to"))
    old = labels.join(moved, "label", "left").select("key", F.coalesce("to", "label").alias("label"))
    return tables.saved(old.unionByName(now.join(labels.select("key"), "key", "left_anti")), "labels")


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, class_id, class_size), one for each row of ``df``: the smallest id of its class and the class's rows."""
    return _classes(df, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "class_size")


def _classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = tables.texts(df, id_col, text_col).withColumn("key", _digest(F.col("text")))
    of = tables.saved(shingled(texts), "shingled")
    shared = df.sparkSession.sparkContext.broadcast(tuple(frequencies(of)))
    labels = _labels(tables.saved(_drawn(of, shared), "drawn"), lambda keys: _weighed(of.join(keys, "key", "left_semi"), shared))
    rows = tables.saved(texts.select("id", "key"), "rows")
    one = rows.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    if labels is not None:
        one = one.join(labels, "key", "left")
    one = tables.saved(one.select("key", "least", "rows", F.coalesce("label", "key").alias("label") if labels is not None else F.col("key").alias("label")), "texts")
    whole = one.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_size"), F.min_by("key", F.struct(F.col("least").isNull(), "least", "key")).alias("class_key"))
    classes = one.select("key", "label").join(whole, "label").select("key", "class_id", "class_size", "class_key")
    return rows.join(classes, "key")


def _labels(drawn: DataFrame, weighed: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """Component labels of all texts that are near another; ``weighed`` gives the vectors of a table of keys."""
    spread = drawn.select("key", F.explode("bands").alias("band"))
    # saved, so that no grouping by band stands in the stages of joins by band, whose large bands Spark can then split
    size = tables.saved(spread.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("size")).where("low <> high").select("band", "size"), "sizes")
    members = tables.saved(spread.join(size, "band"), "members")
    met = members.groupBy("key").agg(F.sum("size").alias("met"))
    vectors = tables.saved(weighed(met.select("key")), "vectors")
    left = tables.saved(members.join(met, "key"), "left")
    labels, tested, first, far = None, None, None, F.col("near") < THRESHOLD
    for _ in range(ROUNDS):
        pivots = tables.saved(left.groupBy("band").agg(F.max(F.struct("met", "key"))["key"].alias("pivot")), "pivots")
        pairs = left.join(pivots, "band").where("key <> pivot").select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct()
        compared = _compared(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), vectors)
        if tested is None:
            tested, first = compared, pivots
        else:
            tested = tested.unionByName(compared)
        links = compared.where(~far).select("a", "b")
        if not links.isEmpty():
            labels = components(links, labels)
        named = _named(left, labels)
        of_pivot = _named(pivots.select("band", F.col("pivot").alias("key")), labels).select("band", F.col("label").alias("pivot_label"))
        left = tables.saved(named.join(of_pivot, "band").where("label <> pivot_label").select("key", "band", "size", "met"), "left")
        if left.isEmpty():
            break
    apart = _apart(_named(members, labels), first, tested, vectors)
    few = _compared(_few(apart.where(F.col("size") <= SMALL), tested), vectors).where(~far).select("a", "b")
    links = tables.saved(few.unionByName(_many(apart.where(F.col("size") > SMALL), vectors)).distinct(), "links")
    return labels if links.isEmpty() else components(links, labels)


def _apart(named: DataFrame, first: DataFrame, tested: DataFrame, vectors: DataFrame) -> DataFrame:
    """The members of bands with several components, with what bounds their similarity.

    Of each band all members meet those ``outside`` its largest component, so that a large
    component with a few other texts costs its size times their number.
    """
    held = named.groupBy("band", "label").agg(F.count("*").alias("held"))
    apart = tables.saved(held.groupBy("band").agg(F.max(F.struct("held", "label"))["label"].alias("largest"), F.count("*").alias("labels")).where("labels > 1").select("band", "largest"), "bands")
    met = named.join(apart, "band").join(first, "band").withColumns({"a": F.least("key", "pivot"), "b": F.greatest("key", "pivot")})
    met = met.join(tested, ["a", "b"], "left").join(vectors.select("key", "mass", F.length("shingles").alias("bytes")), "key")
    near = F.when(F.col("key") == F.col("pivot"), 1.0).otherwise(F.col("near"))
    return tables.saved(met.select("band", "size", "key", "label", (F.col("label") != F.col("largest")).alias("outside"), "mass", "bytes", near.alias("near")), "apart")


def _few(apart: DataFrame, tested: DataFrame) -> DataFrame:
    """Pairs of a band in different components, neither compared nor proved apart by bounds."""
    outside = apart.where("outside").select("band", *(F.col(c).alias(f"other_{c}") for c in ("key", "label", "mass", "near")))
    pairs = apart.join(outside, "band").where(
        (F.col("label") != F.col("other_label")) & (F.least("mass", "other_mass") >= (THRESHOLD - SLACK) * F.greatest("mass", "other_mass"))
        & (F.abs(F.col("near") - F.col("other_near")) <= 1 - THRESHOLD + SLACK)
    )
    return pairs.select(F.least("key", "other_key").alias("a"), F.greatest("key", "other_key").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")


def near_pairs(block: pa.Table) -> pa.Table:
    """Pairs (a, b) of near texts in different components, one of them from rows with ``other``, the other from the rest."""
    other = block.column("other").to_numpy()
    one, two = (block.filter(pa.array(k)) for k in (~other, other))
    made: tuple[list, list] = ([], [])
    if one.num_rows and two.num_rows:
        vectors = one.column("shingles").to_pylist()
        n = np.array([len(v) // 8 for v in vectors])
        hashes = np.concatenate([np.frombuffer(v, np.uint32, k) for v, k in zip(vectors, n.tolist(), strict=True)])
        weight = np.concatenate([np.frombuffer(v, np.float32, k, 4 * k) for v, k in zip(vectors, n.tolist(), strict=True)])
        text = np.repeat(np.arange(len(n)), n)
        known, code = np.unique(hashes, return_inverse=True)
        dense = np.zeros(len(known), np.float32)
        ids = {label: k for k, label in enumerate(set(one.column("label").to_pylist()) | set(two.column("label").to_pylist()))}
        labels, others = (np.array([ids[x] for x in t.column("label").to_pylist()]) for t in (one, two))
        (mass, near), (masses, nears) = ((t.column("mass").to_numpy(), t.column("near").to_numpy()) for t in (one, two))
        keys = one.column("key").to_pylist()
        for k, (key, v) in enumerate(zip(two.column("key").to_pylist(), two.column("shingles").to_pylist(), strict=True)):
            may = (labels != others[k]) & (np.minimum(mass, masses[k]) >= (THRESHOLD - SLACK) * np.maximum(mass, masses[k])) & (np.abs(near - nears[k]) <= 1 - THRESHOLD + SLACK)
            if not may.any():
                continue
            h, w = np.frombuffer(v, np.uint32, len(v) // 8), np.frombuffer(v, np.float32, len(v) // 8, len(v) // 2)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            dense[at[hit]] = w[hit]
            inside = np.flatnonzero(may[text] & (dense[code] > 0))
            shared = np.bincount(text[inside], np.minimum(weight[inside], dense[code[inside]]), len(n))
            dense[at[hit]] = 0
            for j in np.flatnonzero(may & (shared >= (THRESHOLD - SLACK) * (mass + masses[k] - shared))).tolist():
                if similarity(vectors[j], v) >= THRESHOLD:
                    made[0].append(min(keys[j], key))
                    made[1].append(max(keys[j], key))
    return pa.table({"a": pa.array(made[0], pa.binary()), "b": pa.array(made[1], pa.binary())})


def _many(apart: DataFrame, vectors: DataFrame) -> DataFrame:
    """Near pairs of large bands: every block of a band's members meets every block of those outside.

    A text's vector goes to a task once for each block it meets and not once for each pair.
    """
    blocks = lambda size: F.greatest(F.ceil(F.sum(size) / COMPARED_BYTES), F.lit(1)).cast("int")
    numbers = tables.saved(apart.groupBy("band").agg(blocks("bytes").alias("ones"), blocks(F.when(F.col("outside"), F.col("bytes"))).alias("twos")), "numbers")
    dealt = apart.join(numbers, "band").join(vectors.select("key", "shingles"), "key")
    of = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["band", "key", "label", "mass", "near", "shingles"]
    one = dealt.select(*columns, F.lit(False).alias("other"), of("ones").alias("i"), all_of("twos").alias("j"))
    two = dealt.where("outside").select(*columns, F.lit(True).alias("other"), all_of("ones").alias("i"), of("twos").alias("j"))
    return one.unionByName(two).groupBy("band", "i", "j").applyInArrow(near_pairs, "a binary, b binary")


def _named(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The members with their component's label, which is their own key as long as they have none."""
    if labels is None:
        return members.withColumn("label", F.col("key"))
    return members.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _row_key(key: Column, row_id: Column) -> Column:
    return F.concat(key, F.coalesce(F.concat(F.lit("="), row_id.cast("string")), F.lit("")).cast("binary"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class with all its columns: that of the smallest id.

    Of rows with that id and text, the one whose columns have the smallest hash stays. Whole
    rows are shuffled once, by text and id together, so that copies are spread over tasks.
    """
    keep = _classes(df, id_col, text_col).where(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key")))
    name = tables.unused(df, "_row")
    keep = keep.select(_row_key(F.col("key"), F.col("id")).alias(name)).distinct()
    text_key = _digest(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    own = [f"`{c}`" for c in df.columns]
    # Maps have no hash, but their JSON has.
    hashed = [F.to_json(F.struct(F.col(f"`{f.name}`").alias("x")), {"ignoreNullFields": "false"}) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    kept = df.withColumn(name, _row_key(text_key, F.col(id_col))).join(keep, name)
    return kept.groupBy(name).agg(F.min_by(F.struct(*own), F.xxhash64(*hashed)).alias("of")).select("of.*")
