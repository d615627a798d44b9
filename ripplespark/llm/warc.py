"""WARC archives: written as whole-file gzip streams, normalised to one member for each record.

``write`` turns pages into monolithic ``.warc.gz`` files straight from their scan, and
tells each record's payload digest.  ``normalise`` inflates such a file once, in pieces,
rewrites every record as a gzip member of its own (a record whose payload another one
holds becomes a revisit without payload), and writes an index of offsets beside it.
``read`` fetches records by that index, member by member; a revisit's payload is that of the
response it refers to, found by its record id, and must have the digest the revisit tells.

Only ids, digests and places are shuffled, never payloads.  Files hold ``FILE_BYTES`` of
records or one record more, which bounds a task's work; a task holds one record at a time.

Null html is an empty payload.  Records of the smallest page_id of a digest are responses,
also repeated rows of it; null ids come after all others.  Extra columns are ignored.
Ids and urls come back as they were: what a header line can't hold is percent-encoded, and
a url that this changes is kept in a header of its own too.
"""

from __future__ import annotations

import hashlib
import time
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files, tables

FILE_BYTES = 16 << 20
#: Smaller payloads are always stored.
REVISIT_BYTES = 100
_PIECE = 1 << 20
_GZIP = 31  # zlib's window bits for a gzip member


_URL = "!#$%&()*+,-./:;=?@[]_~'"


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """The bytes of a WARC record."""
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def url_fields(url: str) -> dict[str, str]:
    """The header of a url, and of the url as it was if that can't stand in one."""
    sent = quote(url, safe=_URL)
    return ({"WARC-Target-URI": sent} if sent else {}) | ({"X-Target": quote(url)} if sent != url else {})


def record_id(path: str, n: int) -> str:
    return f"<urn:sha1:{hashlib.sha1(f'{path}/{n}'.encode()).hexdigest()}>"


def http_block(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, in pieces."""
    machine = zlib.decompressobj(_GZIP)
    for piece in pieces:
        while piece:
            out = machine.decompress(piece, _PIECE)
            if out:
                yield out
            piece = machine.unconsumed_tail
            if machine.eof:
                piece, machine = machine.unused_data, zlib.decompressobj(_GZIP)


def records(content: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC stream."""
    held = bytearray()
    ended = False

    def more(n: int) -> bool:
        nonlocal ended
        while len(held) < n and not ended:
            piece = next(content, None)
            ended = piece is None
            held.extend(piece or b"")
        return len(held) >= n

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0 and more(len(held) + 1):
            pass
        if at < 0:
            if held.strip():
                raise ValueError("a WARC record is cut short")
            return
        lines = held[:at].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        if not more(at + 4 + size + 4):
            raise ValueError("a WARC record is cut short")
        yield headers, bytes(held[at + 4 : at + 4 + size])
        del held[: at + 8 + size]


def _pieces(path: str) -> Iterator[bytes]:
    with files.stream(path) as source:
        while piece := source.read(_PIECE):
            yield piece


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Rows (path, n, page, bytes, digest): every record written, by file and place in it."""
    tables._bounded_batches(pages.sparkSession)
    src = pages.select(F.col(id_col).cast("string").alias("page"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))

    def run(batches):
        out, path, held, rows, gz = None, "", 0, [], None

        def closed():
            out.write(gz.flush())
            out.close()
            return pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("n", pa.int64()), ("page", pa.string()), ("bytes", pa.int64()), ("digest", pa.string())]))

        for batch in batches:
            for page, url, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if out is None:
                    out, path = files.new_file(folder, ".warc.gz")
                    gz, held, rows = zlib.compressobj(1, zlib.DEFLATED, _GZIP), 0, []
                digest = hashlib.sha256(payload).hexdigest()
                fields = {"WARC-Record-ID": record_id(path, len(rows)), "WARC-Date": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response"}
                fields |= url_fields(url) | ({"X-Page-ID": quote(page)} if page is not None else {})
                made = record("response", fields, http_block(payload))
                out.write(gz.compress(made))
                rows.append({"path": path, "n": len(rows), "page": page, "bytes": len(payload), "digest": digest})
                held += len(made)
                if held >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return tables.saved(src.mapInArrow(run, "path string, n long, page string, bytes long, digest string"), "written")


def revisits(written: DataFrame, id_type: str = "bigint", least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Rows (path, n, refers_to, first_path, first_n) of the records whose payload the record of a smaller id holds, and where that one is."""
    ids = written.where(F.col("bytes") >= least_bytes).select("path", "n", "digest", F.col("page").cast(id_type).alias("page"))
    first = ids.where("page IS NOT NULL").groupBy("digest").agg(F.min(F.struct("page", "path", "n")).alias("first"))
    counted = ids.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1").select("digest")
    first = tables.saved(first.join(counted, "digest").select("digest", "first"), "firsts")  # so that a digest of many rows can be split
    again = ids.join(first, "digest").where("page IS NULL OR page <> first.page")
    return again.select("path", "n", F.col("first.page").cast("string").alias("refers_to"), F.col("first.path").alias("first_path"), F.col("first.n").alias("first_n"))


def normalise(written: DataFrame, revisit: DataFrame) -> DataFrame:
    """Rows (path, n, offset, length): every record of the normalised files, which are the index beside each file too."""
    named = revisit.groupBy("path").agg(F.collect_list(F.struct("n", "refers_to", "first_path", "first_n")).alias("revisits"))  # as many as a file's records at most
    paths = written.select("path").distinct()
    each = paths.join(named, "path", "left").select("path", "revisits").repartition(tables.tasks(paths.count()), "path")

    def one(path: str, refers: dict[int, dict]) -> Iterator[tuple[str, int, int, int]]:
        out, name = files.beside(path.removesuffix(".warc.gz"), ".warc.gz")
        index = files.index_of(name)
        at = 0
        with out, index:
            for n, (headers, block) in enumerate(records(inflated(_pieces(path)))):
                kind = headers.pop("WARC-Type")
                del headers["Content-Length"]
                if n in refers:
                    kind, block = "revisit", block[: block.index(b"\r\n\r\n") + 4]
                    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers[n]["first_path"], refers[n]["first_n"]), "X-Refers-To-Page-ID": quote(refers[n]["refers_to"])}
                gz = zlib.compressobj(4, zlib.DEFLATED, _GZIP)
                member = gz.compress(record(kind, headers, block)) + gz.flush()
                out.write(member)
                index.write(f"{at}\t{len(member)}\t{kind}\t{headers['WARC-Record-ID']}\n".encode())
                yield name, n, at, len(member)
                at += len(member)

    def run(batches):
        schema = pa.schema([("path", pa.string()), ("n", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                rows = list(one(row["path"], {r["n"]: r for r in row["revisits"] or ()}))
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return tables.saved(each.mapInArrow(run, "path string, n long, offset long, length long"), "index")


def read(index: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Rows (page, url, payload_bytes, payload_digest, record_type, refers_to) of the indexed records.

    The digest of a stored payload is computed anew and held against the record's own. Length
    and digest of a revisit are those of the response it refers to.
    """
    schema = pa.schema([(c, pa.string()) for c in ("record", "page", "url")] + [("payload_bytes", pa.int64())] + [(c, pa.string()) for c in ("payload_digest", "record_type", "refers_to", "resolves_to")])

    def run(batches):
        path, source = None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["path"] != path:
                    if source:
                        source.close()
                    path = row["path"]
                    source = files.reader(path)
                ((headers, block),) = records(inflated(iter([source.read_at(row["length"], row["offset"])])))
                kind, told, size = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:"), None
                if kind == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    size = len(payload)
                    if hashlib.sha256(payload).hexdigest() != told:
                        raise ValueError(f"payload of {headers['WARC-Record-ID']} doesn't match its digest")
                page, url, first = headers.get("X-Page-ID"), headers.get("X-Target"), headers.get("X-Refers-To-Page-ID")
                rows.append({
                    "record": headers["WARC-Record-ID"], "page": page and unquote(page), "url": headers.get("WARC-Target-URI") if url is None else unquote(url), "payload_bytes": size,
                    "payload_digest": told, "record_type": kind, "refers_to": first and unquote(first), "resolves_to": headers.get("WARC-Refers-To"),
                })
            yield pa.RecordBatch.from_pylist(rows, schema)

    tasks = tables.tasks(index.select("path").distinct().count())
    kinds = "record string, page string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, resolves_to string"
    rows = tables.saved(index.repartition(tasks, "path").sortWithinPartitions("path", "offset").mapInArrow(run, kinds), "records")
    held = rows.where("record_type = 'response'").select(F.col("record").alias("resolves_to"), F.col("payload_bytes").alias("held_bytes"), F.col("payload_digest").alias("held_digest"))
    resolved = rows.where("record_type <> 'response'").join(held, "resolves_to", "left")
    digest = F.when(F.col("held_digest") == F.col("payload_digest"), F.col("held_digest")).otherwise(F.raise_error(F.concat(F.lit("no response with the payload of the revisit "), "record")))
    resolved = resolved.withColumns({"payload_digest": digest, "payload_bytes": F.col("held_bytes")})
    columns = ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    out = rows.where("record_type = 'response'").select(*columns).unionByName(resolved.select(*columns))
    return out.withColumn("page", F.col("page").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the pages to archives in the shared folder, normalises them and reads them back."""
    id_type = pages.schema[id_col].dataType.simpleString()
    folder = f"{tables.shared_folder(pages.sparkSession)}/warc"
    written = write(pages, folder, id_col, url_col, html_col)
    index = normalise(written, revisits(written, id_type))
    return read(index, id_type).withColumnRenamed("page", id_col)


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
