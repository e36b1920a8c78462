"""WARC archives as tables of bounded chunks.

A payload never needs to be in one piece here: it is streamed as rows (record,
chunk number, bytes) of at most CHUNK bytes, each with the SHA-1 of all bytes
up to its end. In an archive a chunk is a segment of its record in the sense of
WARC/1.1 (``WARC-Segment-Number``, ``continuation``), so Spark's text writer can
lay out the files in any store, and a reader needs one segment at a time.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, written

#: Bytes of a chunk, and rows of an archive file: together they bound a file.
CHUNK, FILE_ROWS = 1 << 16, 1024
#: A batch of chunk rows is handed on at this many bytes.
_FLUSH = 1 << 23
_CHUNKS = "rec bigint, page_id bigint, url string, seq int, last boolean, size bigint, digest binary, data binary"


def _split(text: str, size: int) -> Iterator[bytes]:
    """UTF-8 pieces of at most ``size`` bytes, cut between characters."""
    step = size // 4
    if len(text) <= step:
        yield text.encode()
        return
    for i in range(0, len(text), step):
        yield text[i : i + step].encode()


def _chunk(size: int):
    def run(batches):
        names = [f.split()[0] for f in _CHUNKS.split(", ")]
        types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary())
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            rows, held = [], 0
            for rec, page, url, html in zip(*(b.column(i) for i in range(4)), strict=True):
                sha, total, seq, waiting = hashlib.sha1(), 0, 0, None
                for piece in _split(html.as_py() or "", size):
                    if waiting is not None:
                        rows.append(waiting)
                    sha.update(piece)
                    total += len(piece)
                    waiting = (rec.as_py(), page.as_py(), url.as_py(), seq, False, total, sha.digest(), pack(piece))
                    seq += 1
                    held += len(piece)
                    if held >= _FLUSH and rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
                rows.append((*waiting[:4], True, *waiting[5:]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def chunk_table(pages: DataFrame, chunk: int = CHUNK, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Rows (rec, page_id, url, seq, last, size, digest, data) of all payloads.

    ``size`` and ``digest`` (SHA-1) cover the payload up to the row's end: those
    of the last row are the payload's. ``data`` is the chunk, compressed. A null
    payload is one empty row.
    """
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.monotonically_increasing_id().alias("rec"), F.col(id_col).cast("bigint").alias("page_id"), url.alias("url"), F.col(payload_col).cast("string").alias("html"))
    return rows.mapInArrow(_chunk(chunk), _CHUNKS)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _uri(url: str | None, page: int | None) -> str:
    made = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    return made or f"urn:page:{page}"


def _segment(row: dict) -> str:
    """A chunk row as a segment of a WARC record, without the last line end."""
    seq, kind = row["seq"], row["kind"]
    block = b"" if kind == "revisit" else zstandard.decompress(row["data"])
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind if seq == 0 else 'continuation'}",
        f"WARC-Record-ID: <urn:record:{row['rec']}:{seq + 1}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_uri(row['url'], row['page_id'])}",
    ]
    if row["page_id"] is not None:
        head.append(f"WARC-Page-ID: {row['page_id']}")
    whole = row["last"] and seq == 0
    if row["last"]:
        head += [f"WARC-Payload-Digest: sha1:{base32(row['digest'])}", f"WARC-Payload-Length: {row['size']}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:record:{row['refers_rec']}:1>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        if row["refers_to"] is not None:
            head.append(f"WARC-Refers-To-Page-ID: {row['refers_to']}")
    elif not whole:
        head += [f"WARC-Segment-Number: {seq + 1}", f"WARC-Segment-Origin-ID: <urn:record:{row['rec']}:1>"]
        if row["last"]:
            head.append(f"WARC-Segment-Total-Length: {row['size']}")
    head += ["Content-Type: text/html; charset=utf-8", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head) + "\r\n\r\n" + block.decode() + "\r\n"


def write_archives(pages: DataFrame, path: str | None = None, least: int = 0, chunk: int = CHUNK, **columns: str) -> str:
    """Writes gzipped archives of ``pages``; returns their folder.

    Of the records whose payloads are equal and have at least ``least`` bytes,
    the one with the largest page_id is the response; the others are revisits
    that refer to it and carry no payload. Records of one page_id (repeated
    rows) rank by the order read, a null page_id ranks last; a null payload is
    an empty one; no pages make no archives. Equal payloads meet as (digest,
    largest) pairs that are combined before the shuffle, so a payload that a
    third of the pages has isn't gathered anywhere.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    table, scratch = written(chunk_table(pages, chunk, **columns), "chunks")
    ends = table.where("last").select("rec", "page_id", "digest", "size")
    key = F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", (-F.col("rec")).alias("early"))
    best, scratch2 = written(ends.groupBy("digest").agg(F.max(key).alias("best")), "best")
    # both sides are plain shuffles: a hot digest is split by adaptive execution
    kinds = ends.join(best, "digest").select(
        "rec",
        (F.col("size") < least).alias("small"),
        (-F.col("best.early")).alias("refers_rec"),
        F.col("best.page_id").alias("refers_to"),
    )
    kinds = kinds.select("rec", F.when(F.col("small") | (F.col("rec") == F.col("refers_rec")), "response").otherwise("revisit").alias("kind"), "refers_rec", "refers_to")
    kinds, scratch3 = written(kinds, "kinds")
    # the same join at every size: chunks move once, compressed; revisits keep their last row, without data
    full = table.join(kinds.hint("merge"), "rec").where((F.col("kind") == "response") | F.col("last"))
    full = full.withColumn("data", F.when(F.col("kind") == "response", F.col("data"))).withColumn("seq", F.when(F.col("kind") == "response", F.col("seq")).otherwise(0))

    def lines(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_segment(r) for r in b.to_pylist()], pa.string())], names=["value"])

    ordered = full.sortWithinPartitions("rec", "seq")
    ordered.mapInArrow(lines, "value string").write.option("lineSep", "\r\n").option("maxRecordsPerFile", FILE_ROWS).option("compression", "gzip").text(path)
    from .shared import delete

    for p in (scratch, scratch2, scratch3):
        delete(spark, p)
    return path


def segments(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every segment of a gzipped archive, framed by
    Content-Length; inflates as far as the next segment needs."""
    inflate, held, at, given = zlib.decompressobj(31), bytearray(), 0, 0

    def more() -> bool:
        nonlocal inflate, given
        while given < len(data) or inflate.unconsumed_tail:
            tail = inflate.unconsumed_tail
            if not tail:
                tail, given = data[given : given + (1 << 16)], given + (1 << 16)
            got = inflate.decompress(tail, 1 << 18)
            if inflate.eof and inflate.unused_data:
                rest, inflate = inflate.unused_data, zlib.decompressobj(31)
                got += inflate.decompress(rest)
            held.extend(got)
            if got:
                return True
        return False

    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if held[at:].strip():
                    raise ValueError("the archive ends within a header")
                return
        lines = held[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record starts here: {lines[0][:40]!r}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        while len(held) < end + 4 + size + 4:
            if not more():
                raise ValueError("the archive ends within a block")
        yield head, bytes(held[end + 4 : end + 4 + size])
        at = end + 4 + size + 4
        if at >= 1 << 20:
            del held[:at]
            at = 0


_SEGMENTS = "rec bigint, seq int, last boolean, page_id bigint, kind string, refers_to bigint, size bigint, said string, digest string, data binary"


def _parse(batches):
    names = [f.split()[0] for f in _SEGMENTS.split(", ")]
    types = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
    for b in batches:
        for content in b.column(0):
            rows, held = [], 0
            for head, block in segments(content.as_py()):
                if f"sha1:{base32(hashlib.sha1(block).digest())}" != head["WARC-Block-Digest"]:
                    raise ValueError(f"{head['WARC-Record-ID']}: the block has another digest")
                seq = int(head.get("WARC-Segment-Number", 1)) - 1
                last = "WARC-Payload-Digest" in head
                one = last and seq == 0
                rec = int((head.get("WARC-Segment-Origin-ID") or head["WARC-Record-ID"]).split(":")[2])
                said = head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
                # a record in one segment is measured here, the others chunk by chunk later on
                size = int(head["WARC-Payload-Length"]) if head["WARC-Type"] == "revisit" else len(block)
                found = said if head["WARC-Type"] == "revisit" else base32(hashlib.sha1(block).digest()) if one else None
                page, to = head.get("WARC-Page-ID"), head.get("WARC-Refers-To-Page-ID")
                rows.append((rec, seq, last, page and int(page), head["WARC-Type"], to and int(to), size, said, found, None if one else block))
                held += 0 if one else len(block)
                if held >= _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


_RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _gather(batches):
    """Segments sorted by record and number to records; digests run on from
    chunk to chunk, also over batches."""
    names = [f.split()[0] for f in _RECORDS.split(", ")]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    sha, size, next_seq, kind = hashlib.sha1(), 0, 0, ""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            if r["digest"] is None:
                if r["seq"] != (next_seq if r["seq"] else 0):
                    raise ValueError(f"record {r['rec']} misses a segment")
                if r["seq"] == 0:
                    sha, size, kind = hashlib.sha1(), 0, r["kind"]
                sha.update(r["data"])
                size, next_seq = size + r["size"], r["seq"] + 1
                if not r["last"]:
                    continue
                r |= {"size": size, "digest": base32(sha.digest()), "kind": kind}
            if r["digest"] != r["said"]:
                raise ValueError(f"record {r['rec']}: the payload has another digest")
            rows.append((r["page_id"], r["size"], r["digest"], r["kind"], r["refers_to"]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Blocks and payloads are checked against their digests. A file is bounded
    by FILE_ROWS segments; within one, inflated bytes are held a segment at a
    time. Only payloads of several segments travel, chunk by chunk, to be
    hashed in order.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    parts = files.mapInArrow(_parse, _SEGMENTS)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = parts.repartition(n, "rec").sortWithinPartitions("rec", "seq")
    return ordered.mapInArrow(_gather, _RECORDS)
