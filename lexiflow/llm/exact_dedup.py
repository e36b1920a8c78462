"""Exact deduplication by a minimal perfect hash over historical digests.

The digests seen earlier (the history) are split by their leading bits into
parts; each part gets a minimal perfect hash whose slots hold the full digest,
the locator of the winner and the number of copies. A new digest is looked up
by position and accepted only if all its bytes agree with the slot; digests
that aren't members are grouped among themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .shared import stable, temporary, unused, written

#: Distinct digests that a part should hold of the history, and of the new rows.
PART = 1 << 14
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def normal_digest(text: str | None) -> bytes:
    """SHA-256 of the text in UTF-8, A-Z lower-cased; null counts as empty."""
    return hashlib.sha256((text or "").encode().lower()).digest()


def _digests(texts: pa.Array) -> pa.Array:
    # translate() in the JVM takes twice the CPU time (README)
    return pa.array([normal_digest(t.as_py()) for t in texts], pa.binary())


class PerfectHash:
    """Distinct 32-byte digests to slots 0 to n-1, in about 3 bits each.

    In each level the keys left are hashed to twice as many bits; those alone
    on theirs stay there and the others go on. A slot is the number of set
    bits before the key's own. Keys that share the 64 bits that are hashed
    never part; they are held in ``rest`` by all their bytes.
    """

    def __init__(self, digests: np.ndarray):
        self.levels: list[np.ndarray] = []
        self.rest: dict[bytes, int] = {}
        key, left = self._keys(digests), np.arange(len(digests))
        while len(left) and len(self.levels) < 40:
            size = max(64, 2 * len(left))
            at = self._at(key[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append(alone)
            left = left[~alone[at]]
        self.before = np.cumsum([0, *(int(x.sum()) for x in self.levels)])
        self.rank = [np.cumsum(x) - 1 for x in self.levels]
        self.rest = {digests[i].tobytes(): int(self.before[-1]) + j for j, i in enumerate(left)}

    @staticmethod
    def _keys(digests: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(digests[:, 8:16]).view(np.uint64).ravel()

    @staticmethod
    def _at(key: np.ndarray, level: int, size: int) -> np.ndarray:
        x = key + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """A slot for every key; -1, or any other key's slot, for nonmembers."""
        out, key = np.full(len(digests), -1, np.int64), self._keys(digests)
        left = np.arange(len(digests))
        for level, (bits, rank) in enumerate(zip(self.levels, self.rank, strict=True)):
            at = self._at(key[left], level, len(bits))
            on = bits[at]
            out[left[on]] = self.before[level] + rank[at[on]]
            left = left[~on]
        for i in left:
            out[i] = self.rest.get(digests[i].tobytes(), -1)
        return out


def _array(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _probe(key, history: pa.Table, new: pa.Table) -> pa.Table:
    """One part: digests with history and new copies put together."""
    old, fresh = _array(history["digest"]), _array(new["digest"])
    hashed = PerfectHash(old)
    own = hashed.slots(old)
    slot_of = np.empty(len(old), np.int64)
    slot_of[own] = np.arange(len(old))
    names = old[slot_of]
    winner = [history["best"][int(i)].as_py() for i in slot_of]
    count = history["n"].to_numpy()[slot_of].astype(np.int64)
    at = hashed.slots(fresh)
    member = at >= 0
    member[member] = (names[at[member]] == fresh[member]).all(axis=1)
    best, n = new["best"].to_pylist(), new["n"].to_numpy()
    rank = lambda x: (True, x["id"], x["early"]) if x["has"] else (False, x["early"])
    for i in np.flatnonzero(member):
        j = at[i]
        count[j] += n[i]
        winner[j] = max(winner[j], best[i], key=rank)
    others = np.flatnonzero(~member)
    rows = [x.tobytes() for x in names] + [fresh[i].tobytes() for i in others]
    return pa.table(
        {
            "digest": pa.array(rows, pa.binary()),
            "best": pa.array(winner + [best[i] for i in others], history.schema.field("best").type),
            "n": pa.array([*count.tolist(), *(int(n[i]) for i in others)], pa.int64()),
        }
    )


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("own").alias("best"), F.count("*").alias("n"))


def merge_groups(history: DataFrame, new: DataFrame) -> DataFrame:
    """Two tables of distinct digests (digest, best, n) to one.

    Parts follow the digests' leading bits, so they are even whatever the
    texts are; their number follows the larger of the two tables.
    """
    most = max(history.count(), new.count())
    parts = max(int(history.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + most // PART)
    part = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint"), F.lit(parts)).alias("part")
    a, b = history.select(part, "*").groupBy("part"), new.select(part, "*").groupBy("part")
    return a.cogroup(b).applyInArrow(_probe, history.schema)


def groups(docs: DataFrame, history, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (uid, doc_id, digest) of ``docs``, and per digest (digest, best, n).

    ``history``: a condition on ``docs`` that holds for rows seen earlier.
    Copies are combined before each shuffle, so a text that a third of the
    rows have is a row per task.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.arrow_udf(_digests, "binary")(F.col(text_col)).alias("digest"), F.coalesce(history, F.lit(False)).alias("seen"))
    with temporary(docs.sparkSession) as keep:
        rows, p1 = written(rows, "digests")
        own = rows.withColumn("own", F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id").alias("id"), (-F.col("uid")).alias("early")))
        old, _ = written(_groups(own.where("seen")), "history")
        new, _ = written(_groups(own.where("not seen")), "new")
        merged, p2 = written(merge_groups(old, new), "groups")
        keep(p1, p2)
    return rows, merged


def older_half(docs: DataFrame, id_col: str = "doc_id"):
    """A condition for the rows up to the middle of the range of ids (of ids that
    aren't numbers, for those with an even hash)."""
    if not isinstance(docs.schema[id_col].dataType, NumericType):
        return F.pmod(F.xxhash64(id_col), F.lit(2)) == 0
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    return F.lit(False) if low is None else F.col(id_col) <= (int(low) + int(high)) // 2


def exact_duplicates(docs: DataFrame, history=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. Of equal texts the row with the largest doc_id stays; of rows with
    that doc_id too (repeated rows) the first read, and a null doc_id yields
    to any other; ids are of any type that orders. ``history`` (a condition; by default the older half) says
    which rows the perfect hash is built from; it doesn't change the result.
    An empty table gives no rows.
    """
    rows, merged = groups(docs, older_half(docs, id_col) if history is None else history, id_col, text_col)
    return rows.join(merged, "digest").select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("uid") == -F.col("best.early")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, history=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, as :func:`exact_duplicates` keeps it."""
    docs = stable(docs)
    rows, merged = groups(docs, older_half(docs, id_col) if history is None else history, id_col, text_col)
    uid = unused(docs, "uid")
    gone = rows.join(merged, "digest").where(F.col("uid") != -F.col("best.early")).select(F.col("uid").alias(uid))
    return docs.withColumn(uid, F.monotonically_increasing_id()).join(gone, uid, "left_anti").drop(uid)
