"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most ``2 * HALF`` bits share a
variant with at most ``HALF`` bits flipped in either. So every fingerprint
stands for all its variants, variants are the shuffle key, and those that
collide are linked.

There are 2,081 variants of a fingerprint for HALF = 2. Shuffled one by one they
would be 2,081 rows; instead the shuffle key is a variant's leading bits, and a
fingerprint travels once to each prefix that one of its variants has (1 + k +
k(k-1)/2 of them for k bits). Where it arrives, the variants with this prefix
are laid out and sorted. Their number per prefix is known from a histogram of
2^k counts, k following the number of fingerprints, so a task's memory is
bounded; a prefix with too many of them (near copies agree in their leading
bits) is split by a linear syndrome of the other bits, which spreads near
copies evenly. No bucket is cut or sampled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import stable, temporary, unused, words_at_blanks, written

SHINGLE, SEED, HALF = 4, 42, 2
#: Variants that a bucket should hold, and bytes of text hashed at once.
BUCKET, PIECE = 1 << 20, 1 << 21
_BLANKS = b" \t\n\r\x0b\x0c"


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """Words, about PIECE bytes at a time."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + PIECE)
        while end < n and data[end] not in _BLANKS:
            end += 1
        yield words_at_blanks(data[at:end])
        at = end


def _hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of every run of n words, joined by a blank."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    one = xxhash.xxh64_intdigest
    return np.array([one(joined[a:b], SEED) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text; 0 without words."""
    if not text:
        return 0
    ones, total, kept = np.zeros(64, np.int64), 0, []
    for words in _pieces(text.encode()):
        kept += words
        if len(kept) >= shingle:
            h = _hashes(kept, shingle)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(h)
            kept = kept[len(kept) - shingle + 1 :]
    if not total:
        if not kept:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(kept), SEED)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _print_batches(shingle: int):
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(b.num_columns - 1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp, pa.int64())], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (id, fp), fp signed; null and wordless texts have fingerprint 0."""
    kind = docs.schema[id_col].dataType.simpleString() if isinstance(id_col, str) else "bigint"
    return docs.select(F.col(id_col) if isinstance(id_col, str) else id_col, text_col).mapInArrow(_print_batches(shingle), f"id {kind}, fp bigint")


def _masks(bits: int, most: int) -> np.ndarray:
    """All masks over the low ``bits`` bits with at most ``most`` of them set."""
    return np.array([sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(bits), n)], np.uint64)


def _syndrome(v: np.ndarray, bits: int) -> np.ndarray:
    """A linear code of v's bits: of a xor of two values, the xor of theirs."""
    out = np.zeros(v.shape, np.uint64)
    for i in range(bits):
        row = np.uint64(((i + 1) * 0x9E3779B97F4A7C15 ^ (i + 7) * 0xC2B2AE3D27D4EB4F) & (2**64 - 1))
        out |= (np.bitwise_count(v & row).astype(np.uint64) & np.uint64(1)) << np.uint64(i)
    return out


def _emit(k: int, half: int, bits: int, splits: dict[tuple[int, int], int]):
    """Rows (lane, fp) to rows (lane, bucket, part, blob of the fingerprints sent there)."""

    def run(batches):
        near = _masks(k, half)
        for b in batches:
            lanes, every = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            rows = []
            for lane in np.unique(lanes).tolist():
                v = every[lanes == lane]
                bucket = ((v >> np.uint64(bits - k))[:, None] ^ near).ravel()
                order = np.argsort(bucket, kind="stable")
                bucket, v = bucket[order], np.repeat(v, len(near))[order]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                for i, z in zip([0, *cuts], [*cuts, len(v)], strict=True):
                    if z > i:
                        blob, own = v[i:z].tobytes(), int(bucket[i])
                        rows += [(lane, own, part, blob) for part in range(1 << splits.get((lane, own), 0))]
            names = (("lane", pa.int32()), ("bucket", pa.int32()), ("part", pa.int32()), ("blob", pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, (_, t) in enumerate(names)], names=[n for n, _ in names])

    return run


def _forest(links: np.ndarray) -> np.ndarray:
    """Links that span every component: Kruskal's, those of fewest bits first."""
    up: dict[int, int] = {}

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    away = np.bitwise_count(links[:, 0] ^ links[:, 1])
    kept = []
    order = np.lexsort((links[:, 1], links[:, 0], away))
    for i, x, y in zip(order.tolist(), *links[order].T.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append(i)
    return links[kept]


_NONE = np.zeros((0, 2), np.uint64)


def collisions(prints: np.ndarray, bucket: int, part: int, k: int, half: int, split: int, bits: int = 64) -> np.ndarray:
    """Links (unsigned) between distinct fingerprints with a common variant in a bucket part."""
    low = bits - k
    away = np.bitwise_count((prints >> np.uint64(low)) ^ np.uint64(bucket))
    values, owners = [], []
    for d in range(half + 1):
        own, masks = prints[away == d], _masks(low, half - d)
        if not len(own):
            continue
        pairs = [(own, masks)]
        if split:
            mine, code = _syndrome(own & np.uint64((1 << low) - 1), split), _syndrome(masks, split)
            pairs = [(own[mine == g], masks[code == (np.uint64(part) ^ g)]) for g in np.unique(mine)]
        for o, m in pairs:
            if len(o) and len(m):
                values.append(((o & np.uint64((1 << low) - 1))[:, None] ^ m).ravel())
                owners.append((o, len(m)))
    if not values:
        return _NONE
    everything = np.concatenate(values)
    everything.sort()
    hit = np.unique(everything[1:][everything[1:] == everything[:-1]])
    del everything
    if not len(hit):
        return _NONE
    mark = np.zeros(1 << 16, bool)
    spread, far = np.uint64(0x9E3779B97F4A7C15), np.uint64(48)
    mark[(hit * spread) >> far] = True
    at, who = [], []
    for v, (o, n) in zip(values, owners, strict=True):
        i = np.flatnonzero(mark[(v * spread) >> far])
        x = v[i]
        j = np.minimum(np.searchsorted(hit, x), len(hit) - 1)
        same = hit[j] == x
        at.append(j[same])
        who.append(o[i[same] // n])
    at, who = np.concatenate(at), np.concatenate(who)
    order = np.lexsort((who, at))
    at, who = at[order], who[order]
    new = np.concatenate(([True], at[1:] != at[:-1]))
    first = who[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    link = np.unique(np.stack([who[~new], first[~new]], 1), axis=0)
    link = link[(np.bitwise_count(link[:, 0] ^ link[:, 1]) <= 2 * half) & (link[:, 0] != link[:, 1])]
    return _forest(link)


def _meet(k: int, inner: int, half: int, bits: int, splits: dict[tuple[int, int], int]):
    def run(key, group):
        lane, bucket, part = (x.as_py() for x in key)
        prints = np.unique(np.frombuffer(b"".join(x.as_py() for c in group.column("blob").chunks for x in c), np.uint64))
        found = []
        # variants are laid out a longer prefix at a time
        for i in range(bucket << inner, (bucket + 1) << inner):
            split = splits.get((lane, i), 0)
            if part < 1 << split:
                found.append(collisions(prints, i, part, k + inner, half, split, bits))
        links = _forest(np.concatenate(found)) if found else _NONE
        links = links.view(np.int64)
        return pa.table({"lane": pa.array([lane] * len(links), pa.int32()), "a": pa.array(links[:, 0], pa.int64()), "b": pa.array(links[:, 1], pa.int64())})

    return run


def near_links(nodes: DataFrame, half: int = HALF, bits: int = 64, inner: int = 0) -> DataFrame:
    """Distinct rows (lane, fp) to rows (lane, a, b): links between fingerprints of a
    lane that span every component of those at most ``2 * half`` of ``bits`` bits apart.

    ``inner``: bits of the prefix that a task goes through by itself, so that a
    fingerprint is sent to fewer places.
    """
    lanes = {r["lane"]: r["n"] for r in nodes.groupBy("lane").agg(F.count("*").alias("n")).collect()}  # a row per lane
    every = sum(math.comb(bits, i) for i in range(half + 1))
    whole = min(16, max(2 + inner, math.ceil(math.log2(max(1, max(lanes.values(), default=0) * every / BUCKET)))))
    k = whole - inner
    # at most 2^16 counts a lane come to the driver, however many rows there are
    counts = {lane: np.zeros(1 << whole) for lane in lanes}
    for r in nodes.groupBy("lane", F.shiftrightunsigned("fp", bits - whole).alias("p")).count().collect():
        counts[r["lane"]][r["p"]] = r["count"]
    splits: dict[tuple[int, int], int] = {}
    for lane, c in counts.items():
        load = np.zeros(1 << whole)
        for m in _masks(whole, half):
            rest = half - int(m).bit_count()
            load += c[np.arange(1 << whole) ^ int(m)] * sum(math.comb(bits - whole, i) for i in range(rest + 1))
        splits.update({(lane, int(i)): min(16, math.ceil(math.log2(load[i] / (4 * BUCKET)))) for i in np.flatnonzero(load > 4 * BUCKET)})
    parts: dict[tuple[int, int], int] = {}
    for (lane, i), n in splits.items():
        parts[lane, i >> inner] = max(n, parts.get((lane, i >> inner), 0))
    sent = nodes.select("lane", "fp").mapInArrow(_emit(k, half, bits, parts), "lane int, bucket int, part int, blob binary")
    return sent.groupBy("lane", "bucket", "part").applyInArrow(_meet(k, inner, half, bits, splits), "lane int, a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, half: int = HALF) -> DataFrame:
    """One row (id, fp, component) per row of ``docs``.

    ``component`` is the smallest id reachable over links of at most
    ``2 * half`` differing bits. Null or empty texts have fingerprint 0 and
    link like any other; texts of fewer words than a shingle hash whole; rows
    with equal texts, or repeated rows, share a fingerprint and a component;
    a null id counts for no component's smallest; no rows give no rows.
    """
    with temporary(docs.sparkSession) as keep:
        prints, p1 = written(fingerprints(docs, id_col, text_col, shingle), "prints")
        nodes, _ = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
        links, _ = written(near_links(nodes.select(F.lit(0).alias("lane"), "fp"), half), "links")
        member, _ = written(connected_components(links), "member")
        known = nodes.join(member, nodes.fp == member.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        known, _ = written(known, "members")
        named, _ = written(known.groupBy("root").agg(F.min("least").alias("component")), "components")
        classes, p2 = written(known.join(named, "root").select("fp", "component"), "classes")
        keep(p1, p2)
    return prints.join(classes, "fp").select("id", "fp", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one row of each component of :func:`near_duplicates`.

    The row with the smallest id stays (of repeated ids the first row read;
    null ids yield to others). Columns are those of ``docs``.
    """
    docs = stable(docs)
    uid = unused(docs, "uid")
    rows = docs.withColumn(uid, F.monotonically_increasing_id())
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("i"), F.col(uid).alias("u"))
    found = near_duplicates(rows.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text")
    gone = found.where("id.u <> component.u").select(F.col("id.u").alias(uid))
    return rows.join(gone, uid, "left_anti").drop(uid)
