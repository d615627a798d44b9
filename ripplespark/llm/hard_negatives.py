"""Hard negatives by a pivot table over augmented vectors.

Vectors are quantised to whole numbers, so that scores, which are inner products, are exact.
A row x gets one component more, sqrt(M^2 - |x|^2) with M the largest length; an anchor q
gets a zero.  Then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x: the larger the score, the nearer the
point.  Of every row the distances to a few pivots are stored; by the triangle inequality
they bracket its distance to an anchor, and so its score.  Brackets of whole blocks decide
which pairs of an anchor block and a row block meet at all, brackets of rows which rows of
such a pair are checked; what is left gets its exact score.

Two passes: the first finds each anchor's best rows of its own label, the second, for each
of these positives, the best rows of other labels within its window of scores.  Rows lie in
blocks of bounded bytes, dealt by label and distance from pivots; anchors, too.  The anchors
are a stated set of queries: their blocks meet row blocks, never rows one by one in a join.
Of each pair of blocks only a few rows an anchor come out.

Rows with a null id, label or vector, or a null or non-finite component, take no part.
Vectors of other lengths are as if zeros followed them.  Repeated rows are rows of their own:
each anchor gives rows of its own, and a copy of an anchor is another row.  Scores beyond
64 bits raise an error.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables

PIVOTS = 8
#: Pivots are chosen among so many rows, those of the least hashes of id and label.
SAMPLE = 1024
BLOCK_BYTES = 8 << 20
MOST_ROWS = 1 << 15
#: Distances computed in floating point are off by less than this share of M.
SLACK = 1e-6


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def usable(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of a matrix, with zeros behind short ones."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    starts = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(starts, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, in floating point where that is exact."""
    top = lambda m: max(-int(m.min(initial=0)), int(m.max(initial=0)))
    bound = top(a) * top(b) * max(1, a.shape[1])
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = a.astype(object) @ b.astype(object).T
    if len(exact) and max(abs(int(x)) for x in exact.ravel()) >= 1 << 63:
        raise OverflowError("a score doesn't fit into 64 bits")
    return exact.astype(np.int64)


def squares(m: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", m.astype(np.float64), m.astype(np.float64))


def chosen(sample: np.ndarray, most: float, n: int) -> np.ndarray:
    """Up to n rows far from each other after augmentation: each next one is the farthest from those before."""
    full = np.hstack([sample.astype(np.float64), np.sqrt(np.maximum(0, most - squares(sample)))[:, None]])
    if not len(full):
        return full
    out = [int(np.argmax(squares(full - full.mean(axis=0))))]
    near = squares(full - full[out[0]])
    while len(out) < min(n, len(full)) and near.max() > 0:
        out.append(int(np.argmax(near)))
        near = np.minimum(near, squares(full - full[out[-1]]))
    return full[out]


def distances(rows: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of rows with their added component from each pivot."""
    full = np.hstack([rows.astype(np.float64), last[:, None]])
    return np.sqrt(np.maximum(0, squares(full)[:, None] + squares(pivots)[None, :] - 2 * full @ pivots.T))


def brackets(query: np.ndarray, norms: np.ndarray, stored: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of queries (their distances from pivots and squared lengths) and rows (stored distances)."""
    slack = SLACK * np.sqrt(most) + 1e-9
    low = np.zeros((len(query), len(stored)))
    high = np.full(low.shape, np.inf)
    for p in range(stored.shape[1]):
        np.maximum(low, np.abs(query[:, p, None] - stored[None, :, p]), out=low)
        np.minimum(high, query[:, p, None] + stored[None, :, p], out=high)
    total = (norms + most)[:, None]
    return (total - (high + slack) ** 2) / 2, (total - np.maximum(0, low - slack) ** 2) / 2


_BLOCK = "block bigint, row array<bigint>, id array<bigint>, label array<bigint>, v binary, p binary, least array<double>, most array<double>, labels array<bigint>"


def blocked(rows: DataFrame, n_rows: int, width: int, pivots: np.ndarray, most: float, own: bool) -> DataFrame:
    """Blocks of rows: their matrix and distances as bytes, and their bounds and labels.

    own: whether rows get their added component, as stored rows do, or a zero, as anchors.
    """
    size = int(max(1, min(MOST_ROWS, BLOCK_BYTES // (8 * max(1, width)))))

    def far(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = matrix(batch.column(3), width)
        last = np.sqrt(np.maximum(0, most - squares(v))) if own else np.zeros(len(v))
        d = distances(v, last, pivots)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))], [*batch.schema.names, "cell", "far"])

    kinds = "row bigint, id bigint, label bigint, v array<bigint>"
    dealt = tables.over_batches(rows.select("row", "id", "label", "v"), far, kinds + ", cell int, far double")
    # Copies are dealt by their number; labels and cells that many rows share take several ranges.
    n = tables.tasks(max(1, -(-n_rows // size), min(32, n_rows // 256)))
    dealt = dealt.repartitionByRange(n, "label", "cell", "far", F.xxhash64("row")).coalesce(n).sortWithinPartitions("label", "cell", "far").select("row", "id", "label", "v")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            row, id_, label = (table.column(k).to_numpy() for k in range(3))
            v = matrix(table.column(3).chunk(0), width)
            last = np.sqrt(np.maximum(0, most - squares(v))) if own else np.zeros(len(v))
            d = distances(v, last, pivots)
            cols = [[int(row[0])], [row], [id_], [label], [_bytes(v)], [d.astype("<f8").tobytes()], [d.min(axis=0)], [d.max(axis=0)], [np.unique(label)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], [x.split()[0] for x in _BLOCK.split(", ")])

        held, n_held = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - n_held)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n_held += part.num_rows
                if n_held == size:
                    yield block(held)
                    held, n_held = [], 0
        if held:
            yield block(held)

    return dealt.mapInArrow(packed, _BLOCK)


_TYPES = (pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.binary(), *[pa.list_(pa.float64())] * 2, pa.list_(pa.int64()))


def _bytes(v: np.ndarray) -> bytes:
    """Whole numbers by the least width that holds them, told by the first byte."""
    for kind in ("<i1", "<i2", "<i4", "<i8"):
        info = np.iinfo(kind)
        if not v.size or (v.min() >= info.min and v.max() <= info.max):
            break
    return kind[2].encode() + v.astype(kind).tobytes()


def _matrix(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data[1:], f"<i{data[:1].decode()}").reshape(n, -1) if len(data) > 1 else np.zeros((n, 0), np.int64)


def _met(anchors: DataFrame, rows: DataFrame, n: int, same_label: bool) -> DataFrame:
    """Numbers of pairs of an anchor block and a row block whose labels and brackets allow a result.

    Every row block has one of n slots and every anchor block takes part in all, so that they
    meet by slot; only numbers, labels and bounds of blocks are moved.  Anchor blocks with a
    column ``reach`` meet no row block that lies farther away than that.
    """
    facts = ("block", "least", "most", "labels")
    a = anchors.select(*(F.col(c).alias(f"a_{c}") for c in (*facts, *(["reach"] if "reach" in anchors.columns else []))), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    r = rows.select(*(F.col(c).alias(f"r_{c}") for c in facts), F.pmod(F.xxhash64("block"), F.lit(n)).cast("int").alias("slot"))
    met = a.join(r, "slot")
    shared = F.arrays_overlap("a_labels", "r_labels")
    met = met.where(shared if same_label else ~(shared & (F.size("a_labels") == 1) & (F.size("r_labels") == 1)))
    if "reach" in anchors.columns:
        gap = F.array_max(F.transform(F.arrays_zip("a_least", "a_most", "r_least", "r_most"), lambda z: F.greatest(z["r_least"] - z["a_most"], z["a_least"] - z["r_most"])))
        met = met.where(gap <= F.col("a_reach"))
    return met.select("a_block", "r_block")


def _pairs(met: DataFrame, anchors: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    left = anchors.select(*(F.col(c).alias(f"a_{c}") for c in anchors.columns))
    right = rows.select(*(F.col(c).alias(f"r_{c}") for c in ("block", "row", "id", "label", "v", "p")))
    return met.join(left, "a_block").repartition(n, "r_block").join(right.repartition(n, "r_block"), "r_block")


def _best(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """The places of the highest scores, ties by smaller id."""
    if len(scores) > count:
        edge = np.partition(scores, len(scores) - count)[len(scores) - count]
        kept = np.flatnonzero(scores >= edge)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], -scores[kept]))][:count]


def _lists(column: pa.Array, k: int, kind: type = np.int64) -> np.ndarray:
    return np.asarray(column[k].values.to_numpy(zero_copy_only=False), kind)


def mine(
    df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    is_anchor: a condition over the columns of ``df``.  A negative's score lies between
    ``low`` and ``high`` percent of the positive's, ends included.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector_col).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))).withColumn("v", quantised(F.col("v"), scale))
    rows = tables.saved(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    facts = rows.agg(F.max(F.size("v")).alias("width"), F.max(square).alias("most"), F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors")).first()
    width, most = int(facts["width"] or 0), float(facts["most"] or 0)
    sample = rows.orderBy(F.xxhash64("id", "label"), "row").select("v").limit(SAMPLE).toArrow()["v"].combine_chunks()
    pivots = chosen(matrix(sample if isinstance(sample, pa.Array) else pa.array([], pa.list_(pa.int64())), width), most, PIVOTS)
    kept = tables.saved(blocked(rows, facts["n"], width, pivots, most, True), "row-blocks")
    asked = tables.saved(blocked(rows.where("anchor"), facts["anchors"] or 0, width, pivots, most, False), "anchor-blocks")
    n = tables.tasks(max(1, min(256, kept.count())))

    def first_pass(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        out: list[list] = [[] for _ in range(7)]
        for k in range(batch.num_rows):
            a_row, a_id, a_label = (_lists(c[f"a_{x}"], k) for x in ("row", "id", "label"))
            r_row, r_id, r_label = (_lists(c[f"r_{x}"], k) for x in ("row", "id", "label"))
            av, rv = _matrix(c["a_v"][k].as_py(), len(a_row)), _matrix(c["r_v"][k].as_py(), len(r_row))
            ap, rp = (np.frombuffer(c[x][k].as_py(), "<f8").reshape(-1, len(pivots)) for x in ("a_p", "r_p"))
            for own in np.intersect1d(a_label, r_label):
                here = np.flatnonzero(r_label == own)
                asks = np.flatnonzero(a_label == own)
                for some in np.array_split(asks, -(-len(asks) // 64)):
                    floor, roof = brackets(ap[some], squares(av[some]), rp[here], most)
                    # The anchor itself may be among the rows, so one lower bound more than positives.
                    edge = np.partition(floor, -min(positives + 1, len(here)), axis=1)[:, -min(positives + 1, len(here))]
                    near = roof >= edge[:, None]
                    used = np.flatnonzero(near.any(axis=0))
                    exact = products(av[some], rv[here[used]])
                    for j, a in enumerate(some):
                        fit = used[near[j, used] & (r_row[here[used]] != a_row[a])]
                        at = np.searchsorted(used, fit)
                        for b in _best(exact[j, at], r_id[here[fit]], positives):
                            for column, x in zip(out, (a_row[a], a_id[a], own, c["a_block"][k].as_py(), r_row[here[fit[b]]], r_id[here[fit[b]]], exact[j, at[b]]), strict=True):
                                column.append(int(x))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a_row", "anchor_id", "label", "a_block", "row", "positive_id", "score"])

    schema = "a_row bigint, anchor_id bigint, label bigint, a_block bigint, row bigint, positive_id bigint, score bigint"
    found = tables.over_batches(_pairs(_met(asked, kept, n, True), asked, kept, n), first_pass, schema)
    order = Window.partitionBy("a_row").orderBy(F.desc("score"), "positive_id", "row")
    found = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives)
    found = tables.saved(found.where("score >= 0").select("a_row", "a_block", "anchor_id", "positive_id", "score", "k"), "positives")  # a negative score has an empty window

    # Windows go with the blocks of their anchors, in the order of these.
    each = found.groupBy("a_row", "a_block").agg(F.array_sort(F.collect_list(F.struct("k", "positive_id", "score"))).alias("own"))
    each = each.groupBy("a_block").agg(F.collect_list(F.struct("a_row", "own")).alias("windows"), F.min(F.array_min(F.transform("own", lambda x: x["score"]))).alias("lowest"))
    # score >= s means that the squared distance is at most |q|^2 + M^2 - 2 s, with |q|^2 at most M^2.
    reach = F.sqrt(F.greatest(F.lit(0.0), F.lit(2 * most) - F.col("lowest") * 2 * low / 100)) + SLACK * most**0.5 + 1e-6
    again = asked.join(each.withColumn("reach", reach).withColumnRenamed("a_block", "block"), "block").select(*asked.columns, "windows", "reach")

    def second_pass(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        out: list[list] = [[] for _ in range(8)]
        for k in range(batch.num_rows):
            a_row, a_id, a_label = (_lists(c[f"a_{x}"], k) for x in ("row", "id", "label"))
            r_row, r_id, r_label = (_lists(c[f"r_{x}"], k) for x in ("row", "id", "label"))
            av, rv = _matrix(c["a_v"][k].as_py(), len(a_row)), _matrix(c["r_v"][k].as_py(), len(r_row))
            ap, rp = (np.frombuffer(c[x][k].as_py(), "<f8").reshape(-1, len(pivots)) for x in ("a_p", "r_p"))
            place = {int(r): j for j, r in enumerate(a_row)}
            asks = [(place[w["a_row"]], w["own"]) for w in c["a_windows"][k].as_py()]
            for lo in range(0, len(asks), 64):
                part = asks[lo : lo + 64]
                at = np.array([a for a, _ in part])
                least = np.array([min(-(-x["score"] * low // 100) for x in own) for _, own in part])
                largest = np.array([max(x["score"] * high // 100 for x in own) for _, own in part])
                floor, roof = brackets(ap[at], squares(av[at]), rp, most)
                open_ = (roof >= least[:, None]) & (floor <= largest[:, None]) & (a_label[at][:, None] != r_label[None, :])
                used = np.flatnonzero(open_.any(axis=0))
                if not len(used):
                    continue
                exact = products(av[at], rv[used])
                for j, (a, own) in enumerate(part):
                    fit = np.flatnonzero(open_[j, used] & (exact[j] >= least[j]) & (exact[j] <= largest[j]))
                    if not len(fit):
                        continue
                    # From the highest score; a window's best follow the place where it ends.
                    fit = fit[np.lexsort((r_id[used[fit]], -exact[j, fit]))]
                    falling = -exact[j, fit]
                    for x in own:
                        first = int(np.searchsorted(falling, -(x["score"] * high // 100), "left"))
                        for b in fit[first : first + negatives]:
                            if exact[j, b] * 100 >= x["score"] * low:
                                for column, y in zip(out, (a_row[a], a_id[a], x["k"], x["positive_id"], x["score"], r_row[used[b]], r_id[used[b]], exact[j, b]), strict=True):
                                    column.append(int(y))
        names = ["a_row", "anchor_id", "k", "positive_id", "positive_score", "row", "negative_id", "negative_score"]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)

    schema = "a_row bigint, anchor_id bigint, k bigint, positive_id bigint, positive_score bigint, row bigint, negative_id bigint, negative_score bigint"
    found = tables.over_batches(_pairs(_met(again, kept, n, False), again, kept, n), second_pass, schema)
    order = Window.partitionBy("a_row", "k").orderBy(F.desc("negative_score"), "negative_id", "row")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: DuckDB SQL with the rows of ``mine`` as the query asks, by comparing every anchor with all rows.
SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS row, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.row AS a_row, a.id AS anchor_id, a.label AS a_label, r.row, r.id, r.label, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.id % 50 = 0 AND a.row <> r.row
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY a_row ORDER BY score DESC, id, row) AS k FROM scored WHERE label = a_label QUALIFY k <= 5
), found AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.a_row, p.k ORDER BY n.score DESC, n.id, n.row) AS rank
  FROM positives p JOIN scored n ON n.a_row = p.a_row AND n.label <> p.label AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3
"""
