"""The best of all vectors for each of a stated set of queries, by blocks and matrix products.

Both sides are normalised and packed into blocks of bounded size.  Every block of queries
meets every block of vectors once, by slot numbers, not row by row; of each such pair only
the best of each query are kept, and these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplespark.config import Rerank
from ripplespark.sources.files import saved

BLOCK_ROWS = 4096
_BLOCK = "block string, id array<bigint>, label array<bigint>, v binary"
_BLOCK_TYPES = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())


def packed(vectors: DataFrame, width: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of rows (id, label, vector): their directions as a matrix; without a length, zeros. Short vectors end in zeros."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        column = table.column(2).chunk(0)
        sizes = np.diff(column.offsets.to_numpy())
        m = np.zeros((len(sizes), width))
        m[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        norm = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
        m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
        ids, labels = table.column(0).to_pylist(), table.column(1).to_pylist()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([f"{ids[0]}-{len(ids)}-{hash(m.tobytes()) & 0xFFFFFFFF}"], [ids], [labels], [m.tobytes()]), _BLOCK_TYPES, strict=True)], ["block", "id", "label", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == rows:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return vectors.select("id", "label", F.col("vector").cast("array<double>")).mapInArrow(run, _BLOCK)


def top_k_in_blocks(asked: DataFrame, vectors: DataFrame, cfg: Rerank | None = None, rows: int = BLOCK_ROWS) -> DataFrame:
    """(query, hit, mixed, rank): of all other vectors the ``top_k`` best for each asked one.

    Both sides have id, label and vector; an equal label is a prior of 1, another one of 0.
    Scores mix prior and cosine as ``similar_top_k`` does, are rounded to twelve places, so
    that copies tie, and must reach ``min_similarity``; ties by id. Rows with a null id or
    vector, or a null component, take no part; a null label equals none.
    """
    cfg = cfg or Rerank()
    k, share, least = cfg.top_k, cfg.prior_share, cfg.min_similarity
    cols = (F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), "vector")
    fine = "id IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL)"
    asked, vectors = asked.select(*cols).where(fine), vectors.select(*cols).where(fine)
    width = vectors.agg(F.max(F.size("vector"))).unionByName(asked.agg(F.max(F.size("vector")))).agg(F.max(F.col("max(size(vector))"))).first()[0] or 0
    stored, queries = saved(packed(vectors, width, rows), "vector-blocks"), saved(packed(asked, width, rows), "query-blocks")
    slots = max(1, min(512, stored.count()))
    left = queries.select(F.col("id").alias("a_id"), F.col("label").alias("a_label"), F.col("v").alias("a_v"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    right = stored.select("id", "label", "v", F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int").alias("slot"))
    pairs = left.repartition(slots, "slot").join(right.repartition(slots, "slot"), "slot").drop("slot")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a_id, a_label, a_v, id_, label, v in zip(*(c for c in batch.columns), strict=True):
                ids = np.array(id_.as_py())
                own, mine = label.as_py(), a_label.as_py()
                numbers = np.array([-1 if x is None else x for x in own])
                known = np.array([x is not None for x in own])
                scores = (1 - share) * (np.frombuffer(a_v.as_py()).reshape(-1, width) @ np.frombuffer(v.as_py()).reshape(-1, width).T) if width else np.zeros((len(mine), len(ids)))
                out = []
                for n, q in enumerate(a_id.as_py()):
                    s = np.round(scores[n] + (share * (known & (numbers == mine[n])) if mine[n] is not None else 0.0), 12)
                    fit = np.flatnonzero((ids != q) & (s >= least))
                    fit = fit[np.lexsort((ids[fit], -s[fit]))][:k]
                    out.append((np.full(len(fit), q), ids[fit], s[fit]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out]), t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query", "hit", "mixed"])

    found = pairs.select("a_id", "a_label", "a_v", "id", "label", "v").mapInArrow(best, "query bigint, hit bigint, mixed double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("mixed"), "hit")))
    return ranked.where(F.col("rank") <= k)
