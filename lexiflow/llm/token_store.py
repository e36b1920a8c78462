"""Token ids in a content-addressed store of chunks.

Each document's id stream is cut where a rolling hash of the last 32 ids says
so, hence equal passages give equal chunks wherever they stand. A chunk is
stored once under its digest; a document is a recipe of chunk digests, sealed
by the root of a Merkle tree over them. Layout below a store's folder:

``data/kind=chunk``   digest, payload (a byte 2 or 4, then little-endian ids of that width)
``data/kind=recipe``  as encoded, before positions are known
``manifest``          doc_id, start, n_tokens, digests, sizes, root: range-partitioned and
                      sorted by doc_id, so its files in order list the ids of all documents
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_path, library_encoder
from .shared import new_path

END_ID, DIGEST = 2, 20
#: Shortest and longest chunk in ids; a cut has a chance of one in 2**MEAN_BITS.
SHORTEST, LONGEST, MEAN_BITS = 64, 4096, 9
_GEAR = (np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)).astype(np.uint32)


def cut_points(ids: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end: the hash of the 32 ids up to there
    has MEAN_BITS leading zeros. Within 32 ids of its start a stream has none."""
    h = _GEAR[ids & np.uint32(0xFFFF)] ^ (ids >> np.uint32(16))
    for step in (1, 2, 4, 8, 16):
        older = np.zeros_like(h)
        older[step:] = h[:-step] << np.uint32(step)
        h = h + older
    return np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1


def chunk_sizes(n: int, points: np.ndarray) -> list[int]:
    """Lengths of the chunks of a stream of n ids, given its cut points."""
    sizes, at = [], 0
    for p in [*points.tolist(), n]:
        while p - at > LONGEST:
            sizes.append(LONGEST)
            at += LONGEST
        if p - at >= SHORTEST or p == n and p > at:
            sizes.append(p - at)
            at = p
    return sizes


def pack(ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return (b"\4" if wide else b"\2") + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u4" if payload[0] == 4 else "<u2", offset=1).astype("<u4")


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=DIGEST).digest()


def merkle_root(digests: list[bytes]) -> bytes:
    """Root over leaves; an odd last node moves up as it is."""
    level = digests or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@lru_cache(2 * LONGEST)
def _zeros(n: int) -> int:
    """x to the power of 8n modulo the CRC-32 polynomial, bits reflected."""
    out, square = 1 << 31, 1 << 23
    while n:
        if n & 1:
            out = _times(out, square)
        square, n = _times(square, square), n >> 1
    return out


def _times(a: int, b: int) -> int:
    out, m = 0, 1 << 31
    while True:
        if a & m:
            out ^= b
            if not a & (m - 1):
                return out
        m >>= 1
        b = b >> 1 ^ 0xEDB88320 if b & 1 else b >> 1
        if not m:
            return out


def join_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a whole from (crc, bytes) of its parts in order."""
    out = 0
    for crc, size in parts:
        out = _times(out, _zeros(size)) ^ crc if out else crc
    return out


_ENCODED = "kind string, digest binary, payload binary, uid bigint, doc_id bigint, n_tokens bigint, sizes array<int>, digests binary, root binary"


def _encode(path: str, end_id: int):
    def run(batches):
        enc = library_encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256).to_pydict()
                rows, seen = [], set()
                streams = [np.append(x, np.uint32(end_id)) for x in enc.encode([t or "" for t in part["text"]])]
                ends = np.cumsum([len(x) for x in streams])
                points = cut_points(np.concatenate(streams)) if streams else []
                for i, ids in enumerate(streams):
                    first = ends[i] - len(ids)
                    mine = points[np.searchsorted(points, first + 32, "right") : np.searchsorted(points, ends[i])] - first
                    sizes, names, p = chunk_sizes(len(ids), mine), [], 0
                    for n in sizes:
                        payload = pack(ids[p : p + n])
                        names.append(digest(payload))
                        if names[-1] not in seen:
                            seen.add(names[-1])
                            rows.append(("chunk", names[-1], payload, None, None, n, None, None, None))
                        p += n
                    uid = part["uid"][i]
                    rows.append(("recipe", b"recipe" + uid.to_bytes(8, "big"), None, uid, part["doc_id"][i], len(ids), sizes, b"".join(names), merkle_root(names)))
                types = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in _ENCODED.split(", ")])

    return run


def write_store(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes ``docs`` and writes a store; returns its folder.

    Chunks and recipes leave the encoding stage in one shuffle, keyed by
    digest: equal chunks meet after being combined on the map side (a chunk of
    every document is one row per task there), recipes pass through. A null
    text counts as empty: its only id is the end id. Documents with the same
    id, repeated rows too, keep one recipe each, in the order read; null ids
    come first; no rows make an empty store. Other columns aren't stored.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(_encode(tokenizer or default_path(), end_id), _ENCODED)
    rest = [c for c in made.columns if c not in ("kind", "digest")]
    made.groupBy("kind", "digest").agg(*(F.first(c).alias(c) for c in rest)).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/data")
    _write_manifest(spark, path)
    return path


def _data(spark: SparkSession, path: str, kind: str, columns: str) -> DataFrame:
    return spark.read.schema(f"{columns}, kind string").parquet(f"{path}/data").where(F.col("kind") == kind).drop("kind")


def _write_manifest(spark: SparkSession, path: str) -> None:
    recipes = _data(spark, path, "recipe", "uid bigint, doc_id bigint, n_tokens bigint, sizes array<int>, digests binary, root binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = (F.col("doc_id").asc_nulls_first(), F.col("uid"))
    dealt = recipes.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    dealt.sortWithinPartitions(*order).write.parquet(f"{path}/ranges")
    dealt = spark.read.schema(dealt.schema).parquet(f"{path}/ranges")
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum("n_tokens").alias("t")).select("part", F.coalesce(F.sum("t").over(over), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(F.broadcast(totals), "part").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    placed = placed.select("doc_id", "uid", "start", "n_tokens", "sizes", "digests", "root")
    placed.repartitionByRange(n, *order).sortWithinPartitions(*order).write.parquet(f"{path}/manifest")
    from .shared import delete

    delete(spark, f"{path}/ranges")
    delete(spark, f"{path}/data/kind=recipe")


_MANIFEST = "doc_id bigint, uid bigint, start bigint, n_tokens bigint, sizes array<int>, digests binary, root binary"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return _data(spark, path, "chunk", "digest binary, payload binary")


def _verify(batches):
    """Chunk files to (digest, crc, size), each payload checked against its name."""
    for b in batches:
        crc, size = [], []
        for name, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if digest(payload) != name:
                raise ValueError(f"chunk {name.hex()} holds other bytes")
            ids = unpack(payload).tobytes()
            crc.append(zlib.crc32(ids))
            size.append(len(ids))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crc, pa.int64()), pa.array(size, pa.int64())], names=["digest", "crc", "size"])


def _listed(batches):
    """Manifest rows to one row (uid, seq, digest) per chunk, roots checked."""
    for b in batches:
        uid, seq, names = [], [], []
        for u, d, root in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            own = [d[i : i + DIGEST] for i in range(0, len(d), DIGEST)]
            if merkle_root(own) != root:
                raise ValueError(f"the recipe of row {u} doesn't match its Merkle root")
            uid += [u] * len(own)
            seq += range(len(own))
            names += own
        yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(seq, pa.int32()), pa.array(names, pa.binary())], names=["uid", "seq", "digest"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    Every stored chunk is read and checked where it lies; only its CRC-32 and
    length travel, and a document's CRC-32 is put together from its chunks'.
    A missing or altered chunk, recipe or length is an error.
    """
    have = chunks(spark, path).mapInArrow(_verify, "digest binary, crc bigint, size bigint")
    want = manifest(spark, path).select("uid", "digests", "root").mapInArrow(_listed, "uid bigint, seq int, digest binary")
    met = want.join(have, "digest", "left").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("seq", "crc", "size"))).alias("parts"))

    @F.arrow_udf("bigint")
    def whole(parts: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for ps, k in zip(parts.to_pylist(), n.to_pylist(), strict=True):
            if any(p["crc"] is None for p in ps) or sum(p["size"] for p in ps) != 4 * k:
                raise ValueError("a document's chunks are missing or of other lengths")
            out.append(join_crc([(p["crc"], p["size"]) for p in ps]))
        return pa.array(out, pa.int64())

    index = manifest(spark, path).select("uid", "doc_id", "start", "n_tokens")
    return index.join(met, "uid").select("doc_id", "start", "n_tokens", whole("parts", "n_tokens").alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Whole id streams from the files: doc_id, start, ids (array of int)."""
    want = manifest(spark, path).select("uid", "digests", "root").mapInArrow(_listed, "uid bigint, seq int, digest binary")
    met = want.join(chunks(spark, path), "digest").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("seq", "payload"))).alias("parts"))

    @F.arrow_udf("array<int>")
    def whole(parts: pa.Array) -> pa.Array:
        return pa.array([np.concatenate([unpack(p["payload"]) for p in ps]).astype(np.int32) for ps in parts.to_pylist()], pa.list_(pa.int32()))

    return manifest(spark, path).select("uid", "doc_id", "start").join(met, "uid").select("doc_id", "start", whole("parts").alias("ids"))
