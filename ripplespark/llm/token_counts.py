"""Token counts of flat token files: a vectorised separator scan with a prefix scan over blocks.

A flat token file is nothing but little-endian 16-bit ids, every document followed by an
end-of-document id; nothing tells where documents begin.  ``count`` cuts the files into
blocks of fixed size, finds the separators of a block with one comparison, and reports
each document that ends in it.  What stands before a block's first separator belongs to a
document begun earlier: a prefix scan over the file's blocks gives where that is, and how
many documents end before the block.  The scan has two levels, over the blocks of a run of
``RUN_BLOCKS`` and over the runs of a file, so that a huge file isn't one task's work.

A document may span any number of blocks.  Tokens after a file's last separator are a last
document.  Empty files have none.  Null texts count as empty and give documents of no tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, files, flat, tables

BLOCK_TOKENS = 1 << 18
FILE_TOKENS = 1 << 23
RUN_BLOCKS = 1 << 12


def write(df: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Writes token files; rows (path, tokens) of the files, and (path, n, id) of what is the n-th document in which.

    Special strings in texts are encoded as plain text, so that the separator stands at ends only.
    """
    if bpe.loaded(tokenizer).size > 1 << 16:
        raise ValueError("a flat token file holds ids of 16 bits; the vocabulary has more")
    end = np.uint16(bpe.loaded(tokenizer).special["<|endoftext|>"])

    def run(batches):
        out, path, held, ids = None, "", 0, []

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path] * len(ids), pa.string()), pa.array(range(len(ids)), pa.int64()), pa.array(ids, kind), pa.array([held] * len(ids), pa.int64())], ["path", "n", "id", "tokens"])

        for batch in batches:
            kind = batch.column(0).type
            _, offsets = flat.views(batch.column(1))
            for a, b in flat.blocks(offsets):
                if out is None:
                    (out, path), held, ids = files.new_file(folder, ".tokens"), 0, []
                tokens, count = bpe.loaded(tokenizer, specials=False).encode(batch.column(1).slice(a, b - a).to_pylist())
                out.write(np.insert(tokens.astype("<u2"), np.cumsum(count), end).tobytes())
                held += len(tokens) + len(count)
                ids += batch.column(0).slice(a, b - a).to_pylist()
                if held >= file_tokens:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    src = tables.texts(df, id_col, text_col)
    written = tables.saved(src.mapInArrow(run, f"path string, n long, id {src.schema['id'].dataType.simpleString()}, tokens long"), "tokens")
    return written.groupBy("path").agg(F.max("tokens").alias("tokens")), written.select("path", "n", "id")


def count(paths: DataFrame, end: int, block_tokens: int = BLOCK_TOKENS, run_blocks: int = RUN_BLOCKS) -> DataFrame:
    """Rows (path, n, start, tokens): place and length of the n-th document of every file (path, tokens)."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(block_tokens).cast("long"))
    n = paths.agg(F.sum(F.ceil(F.col("tokens") / block_tokens))).first()[0] or 0
    cut = paths.where("tokens > 0").select("path", F.col("tokens").alias("size"), F.explode(starts).alias("at")).repartition(tables.tasks(n // 16), "path", "at")
    schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("ends", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                with files.reader(row["path"]) as source:
                    ids = np.frombuffer(source.read_at(2 * min(block_tokens, row["size"] - row["at"]), 2 * row["at"]), "<u2")
                found = np.flatnonzero(ids == end)
                head, tail = (int(found[0]), len(ids) - int(found[-1]) - 1) if len(found) else (len(ids), len(ids))
                rows.append({"path": row["path"], "at": row["at"], "head": head, "tail": tail, "ends": found + row["at"]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    blocks = tables.saved(cut.mapInArrow(run, "path string, at long, head long, tail long, ends array<long>"), "blocks")
    last_end = F.max(F.when(F.size("ends") > 0, F.element_at("ends", -1)))
    run_of = F.floor(F.col("at") / (block_tokens * run_blocks)).alias("run")
    runs = blocks.groupBy("path", run_of).agg(F.sum(F.size("ends")).alias("in_run"), last_end.alias("last_of_run"))
    so_far = Window.partitionBy("path").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("path", "run", F.coalesce(F.sum("in_run").over(so_far), F.lit(0)).alias("seen_before"), F.max("last_of_run").over(so_far).alias("last_before"))
    before = Window.partitionBy("path", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    scanned = blocks.select("path", run_of, "at", "ends").join(runs, ["path", "run"]).select(
        "path", "ends", (F.col("seen_before") + F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0))).alias("seen"),
        F.coalesce(last_end.over(before), "last_before", F.lit(-1)).alias("last"),
    )
    each = scanned.select("path", "seen", "last", F.posexplode("ends").alias("k", "end"), "ends")
    start = F.when(F.col("k") == 0, F.col("last")).otherwise(F.get("ends", F.col("k") - 1)) + 1
    whole = each.select("path", (F.col("seen") + F.col("k")).alias("n"), start.alias("start"), (F.col("end") - start).alias("tokens"))
    # what follows a file's last separator
    rest = blocks.groupBy("path").agg(F.max(F.when(F.size("ends") > 0, F.element_at("ends", -1))).alias("last"), F.sum(F.size("ends")).alias("n")).join(paths, "path")
    start = F.coalesce("last", F.lit(-1)) + 1
    return whole.unionByName(rest.where(start < F.col("tokens")).select("path", "n", start.alias("start"), (F.col("tokens") - start).alias("tokens")))


def counted(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens): writes all texts to token files in the shared folder and counts these."""
    paths, order = write(df, f"{tables.shared_folder(df.sparkSession)}/tokens", tokenizer, id_col, text_col)
    lengths = count(paths, bpe.loaded(tokenizer).special["<|endoftext|>"])
    return order.join(lengths, ["path", "n"]).select(F.col("id").alias(id_col), F.col("tokens").alias("n_tokens"))
