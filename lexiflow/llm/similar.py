"""Near-duplicates at a stated share of common shingles, by ball hashing.

Texts that share 0.8 of their five-word shingles differ in about a seventh of a
SimHash's bits: ten of 64, too many for balls around it. So a text has a wider
fingerprint, of LANES values of BITS bits, and the balls are those of each lane:
two texts meet where any lane differs in at most ``2 * HALF`` bits, which their
variants with at most ``HALF`` bits flipped tell. Pairs that meet are held
against the whole fingerprint, and those left against the shingles themselves,
so a link is exact. At a similarity of exactly 0.8 one pair in a hundred never
meets; the share falls fast above it (README).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import stable, temporary, unused, written
from .simhash import _pieces, near_links

WORDS, SIMILARITY = 5, 0.8
LANES, BITS, HALF = 16, 40, 2
#: Bits of all lanes that similar texts may differ in: at 0.8 they differ in 97 on
#: average, with a deviation of 9, and unrelated texts in 320.
MOST = 160
#: Bits of a variant's prefix that one task goes through.
INNER = 8
_WIDE = -(-LANES * BITS // 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(i: int) -> np.uint64:
    return np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) & (2**64 - 1))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words, A-Z lower-cased
    (of fewer words: of all; without words: none)."""
    kept, found = np.zeros(0, np.uint64), []
    for part in _pieces((text or "").encode()):
        kept = np.concatenate((kept, np.fromiter(map(xxhash.xxh64_intdigest, part), np.uint64, len(part))))
        n = len(kept) - words + 1
        if n > 0:
            h = np.zeros(n, np.uint64)
            for j in range(words):
                h = _mix(h + kept[j : j + n] + _odd(j))
            found.append(np.unique(h))
            kept = kept[n:]
    if found:
        return np.unique(np.concatenate(found))
    if not len(kept):
        return kept
    h = np.zeros(1, np.uint64)
    for j, x in enumerate(kept):
        h = _mix(h + x + _odd(j))
    return h


def lanes(hashes: np.ndarray) -> np.ndarray:
    """LANES values of BITS bits: a bit is 1 if it is set in over half the hashes."""
    ones = np.zeros(64 * _WIDE, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        for i in range(_WIDE):
            ones[64 * i : 64 * i + 64] += np.unpackbits(_mix(part + _odd(100 + i)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes))[: LANES * BITS].reshape(LANES, BITS)
    return bits @ (np.int64(1) << np.arange(BITS, dtype=np.int64))


def _print_batches(words: int):
    def run(batches):
        for b in batches:
            digests, values, sizes = [], [], []
            for t in b.column(1):
                h = shingles(t.as_py(), words)
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                values.append(lanes(h).tolist())
                sizes.append(len(h))
            cols = [b.column(0), pa.array(digests, pa.binary()), pa.array(values, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["uid", "digest", "lanes", "n"])

    return run


def _set_batches(words: int):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingles(t.as_py(), words).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["uid", "hashes"])

    return run


def _candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, away) of nodes that meet in a lane, if their whole fingerprints and sizes allow a link."""
    values = nodes.select("uid", F.posexplode("lanes").alias("lane", "fp"))
    firsts, _ = written(values.groupBy("lane", "fp").agg(F.min("uid").alias("first"), F.count("*").alias("c")), "values")
    links, _ = written(near_links(firsts.select("lane", "fp"), HALF, BITS, INNER), "lane-links")
    met = links.join(firsts.select("lane", F.col("fp").alias("a"), F.col("first").alias("x")), ["lane", "a"])
    met = met.join(firsts.select("lane", F.col("fp").alias("b"), F.col("first").alias("y")), ["lane", "b"]).select("x", "y")
    # texts of one value meet its first
    same = values.join(firsts.where("c > 1").select("lane", "fp", "first"), ["lane", "fp"]).where("uid <> first").select(F.col("uid").alias("x"), F.col("first").alias("y"))
    pairs = met.union(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()
    one, two = (nodes.select(F.col("uid").alias(i), F.col("lanes").alias(f"l{i}"), F.col("n").alias(f"n{i}")) for i in "ab")
    away = F.aggregate(F.zip_with("la", "lb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") >= F.greatest("na", "nb") * similarity)
    return both.select("a", "b", away.alias("away")).where(F.col("away") <= MOST)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs whose texts share enough of their shingles."""
    one, two = (sets.select(F.col("uid").alias(i), F.col("hashes").alias(f"h{i}")) for i in "ab")
    common = F.size(F.array_intersect("ha", "hb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", common.alias("c"), (F.size("ha") + F.size("hb")).alias("s"))
    return both.where(F.col("c") >= F.lit(similarity) * (F.col("s") - F.col("c"))).select("a", "b")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row (uid, id, component, keeper) per row of ``docs``.

    Rows are linked where the sets of their shingles of ``words`` words (A-Z
    lower-cased, split at blanks; the whole of shorter texts) have a Jaccard
    similarity of ``similarity`` or more. ``component`` is the smallest id
    reachable (nulls last), ``keeper`` the uid of the first row with it; uid
    numbers the rows of ``docs`` as they are read.

    Texts with equal sets are one node, so null and wordless texts are linked
    to each other and to nothing else, and copies cost no pairs. Every node's
    nearest candidates are verified first, pairs that verified links connect
    already are left out, and the rest follow in larger shares until none is
    left: no candidate is dropped, and a large group takes a link a node, not
    all its pairs. No rows give no rows.
    """
    docs = stable(docs)
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with temporary(docs.sparkSession) as keep:
        made = texts.select("uid", "text").mapInArrow(_print_batches(words), "uid bigint, digest binary, lanes array<bigint>, n bigint")
        prints, _ = written(made, "prints")
        # the set of a text is known by its digest; its node is the first row with it
        nodes, _ = written(prints.groupBy("digest").agg(F.min(F.struct("uid", "lanes", "n")).alias("s")).select("digest", "s.*"), "nodes")
        left, _ = written(_candidates(nodes, similarity), "pairs")
        needed = left.select(F.col("a").alias("uid")).union(left.select("b")).distinct()
        sets, _ = written(texts.select("uid", "text").join(needed, "uid", "left_semi").mapInArrow(_set_batches(words), "uid bigint, hashes array<bigint>"), "sets")
        links, member, share = None, None, 1
        while not left.isEmpty():
            ends = left.select("a", "b", "away", F.explode(F.array("a", "b")).alias("end"))
            near = Window.partitionBy("end").orderBy("away", "a", "b")
            now, _ = written(ends.withColumn("r", F.row_number().over(near)).where(F.col("r") <= share).select("a", "b").distinct(), "now")
            good, _ = written(_verified(now, sets, similarity), "links")
            links = good if links is None else links.union(good)
            member, _ = written(connected_components(links), "member")
            one, two = (member.select(F.col("node").alias(i), F.col("root").alias(f"r{i}")) for i in "ab")
            open_ = left.join(now, ["a", "b"], "left_anti").join(one, "a", "left").join(two, "b", "left")
            left, _ = written(open_.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", "away"), "pairs")
            share *= 4
        root = F.col("uid")
        named = nodes.select("uid", "digest")
        if member is not None:
            named, root = named.join(member, F.col("uid") == F.col("node"), "left"), F.coalesce("root", "uid")
        rows = prints.select(F.col("uid").alias("own"), "digest").join(named.select("digest", root.alias("root")), "digest").select(F.col("own").alias("uid"), "root")
        ids = texts.select("uid", "id")
        rows, p1 = written(rows.join(ids, "uid"), "rows")
        best, p2 = written(rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("s")), "best")
        keep(p1, p2)
    return rows.join(best, "root").select("uid", "id", F.col("s.id").alias("component"), F.col("s.uid").alias("keeper"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component of :func:`similar_groups`: the one
    with the smallest id (of repeated ids the first read). Same columns."""
    docs = stable(docs)
    uid = unused(docs, "uid")
    gone = similar_groups(docs, id_col, text_col, words, similarity).where("uid <> keeper").select(F.col("uid").alias(uid))
    return docs.withColumn(uid, F.monotonically_increasing_id()).join(gone, uid, "left_anti").drop(uid)
