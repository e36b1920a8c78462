"""Benchmark decontamination with suffix arrays over the training texts.

Every batch of documents is a shard. Its words become numbers of the benchmark
vocabulary (0: not in it, which ends every match), and the suffixes that can
start a match are sorted: a suffix array, sparse because a suffix whose run of
benchmark words is too short matches nothing. Every benchmark suffix is binary
searched in it; equal neighbours are its verbatim occurrences. How far these go
on is read off their neighbours in the benchmark's own suffix array.

The benchmark is read once, in blocks of bounded size, and every block is
broadcast. A worker holds one block at a time and searches it in the shard at
hand, so documents are read once, whatever the benchmark's size. A block's
arrays take 9 bytes a word in memory and its vocabulary about 150 a distinct
word: with BLOCK 4 MB, 20 MB for prose and 120 MB if no word is repeated.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import WORD_BYTES, unused

WINDOW = 10
#: Suffixes of documents are ordered by this many words.
DEPTH = 32
#: UTF-8 bytes of benchmark text in a block.
BLOCK = 4 << 20
#: Bytes of document text in a shard.
SHARD = 8 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def suffix_order(ids: np.ndarray, most: int) -> np.ndarray:
    """Places of an array in the order of what follows them, by doubled ranks;
    ``most`` words decide at most (0 ends an item and comes first)."""
    rank, k = ids.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while k < most:
        behind = np.zeros(len(ids), np.int64)
        behind[: len(ids) - k] = rank[k:] + 1
        order = np.lexsort((behind, rank))
        new = np.concatenate(([True], (rank[order[1:]] != rank[order[:-1]]) | (behind[order[1:]] != behind[order[:-1]])))
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.cumsum(new)
        if new.all():
            break
        k *= 2
    return order


class Suffixes:
    """A block of the benchmark: vocabulary, and its suffixes in order.

    ``ids`` are the items' words, a 0 behind each item; ``order`` the starts of
    windows, those with equal windows together: ``heads`` are where a new
    window begins there, ``sizes`` the windows' words.
    """

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.names: list = []
        rows = []
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            if ids:
                rows.append(np.array([*ids, 0], np.uint32))
                self.names.append(item)
        self.ids = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
        lengths = np.array([len(r) - 1 for r in rows], np.int64)
        self.first = (np.cumsum(lengths + 1) - lengths - 1).astype(np.int64)
        self.end = self.first + lengths
        owner = np.repeat(np.arange(len(rows)), lengths + 1)
        order = suffix_order(self.ids, int(lengths.max(initial=0)) + 1)
        size = np.minimum(window, lengths)[owner] if rows else np.zeros(0, np.int64)
        order = order[order + size[order] <= self.end[owner[order]]]
        self.order, size, owner = order.astype(np.uint32), size[order], owner[order]
        # a window is new where its size or any of its words differs from the one before
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = size[1:] != size[:-1]
            for j in range(window):
                a, b = order[1:], order[:-1]
                inside = (j < size[1:]) & ~new[1:]
                new[1:][inside] |= self.ids[a[inside] + j] != self.ids[b[inside] + j]
        self.heads = np.append(np.flatnonzero(new), len(order)).astype(np.uint32)
        self.sizes = size[self.heads[:-1]].astype(np.uint8 if window < 256 else np.int64)
        self.need = np.full(len(self.vocab) + 1, 1 << 30, np.int64)
        np.minimum.at(self.need, self.ids[order], size)
        self.depth = max(window, DEPTH)

    def owners(self, lo: int, hi: int) -> np.ndarray:
        """Items (numbers) of a range of suffixes."""
        return np.unique(np.searchsorted(self.first, self.order[lo:hi], "right") - 1)

    def longest(self, raw: bytes, lo: int, hi: int, run: bytes) -> tuple[int, int]:
        """The most words that a run shares with a suffix of a range, and that one's place.

        The nearest suffixes before and behind the run's place in the order share most.
        """
        order, first, end = self.order, self.first, self.end

        def key(i: int) -> bytes:
            s = int(order[i])
            z = min(int(end[np.searchsorted(first, s, "right") - 1]), s + len(run) // 4)
            return raw[4 * s : 4 * z]

        at, best = bisect_left(range(hi), run, lo, key=key), (0, lo)
        for i in (at - 1, at):
            if lo <= i < hi:
                other = key(i)
                n = min(len(other), len(run)) // 4
                differs = np.flatnonzero(np.frombuffer(other[: 4 * n], np.uint32) != np.frombuffer(run[: 4 * n], np.uint32))
                best = max(best, (int(differs[0]) if len(differs) else n, i), key=lambda x: (x[0], -x[1]))
        return best

    def shard(self, texts: list[str | None]) -> list[dict]:
        """Per text: n_words, spans hit, item numbers, and the longest match."""
        get = self.vocab.get
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        # a 0 after each text keeps matches inside it
        first = np.cumsum(sizes + 1) - sizes - 1
        ids = np.zeros(int(sizes.sum()) + len(texts), np.uint32)
        for a, w in zip(first.tolist(), words, strict=True):
            ids[a : a + len(w)] = [get(x, 0) for x in w]
        out = [{"n_words": len(w), "spans": [], "items": set(), "longest": 0, "longest_item": None, "longest_at": None} for w in words]
        del words
        stops = np.flatnonzero(ids == 0)
        maybe = np.flatnonzero(ids)
        if not len(maybe):
            return out
        end = stops[np.searchsorted(stops, maybe)]
        keep = end - maybe >= self.need[ids[maybe]]
        at, end = maybe[keep].tolist(), end[keep].tolist()
        if not at:
            return out
        raw, depth, own = ids.astype(">u4").tobytes(), self.depth, self.ids.astype(">u4").tobytes()
        order = sorted(zip((raw[4 * a : 4 * min(e, a + depth)] for a, e in zip(at, end, strict=True)), at, end, strict=True))
        keys = [k for k, _, _ in order]
        array, ends = [a for _, a, _ in order], [e for _, _, e in order]
        del order
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for lo_b, hi_b, size in zip(self.heads[:-1].tolist(), self.heads[1:].tolist(), self.sizes.tolist(), strict=True):
            s = int(self.order[lo_b])
            head = own[4 * s : 4 * (s + size)]
            lo = bisect_left(keys, head)
            if lo == len(keys) or not keys[lo].startswith(head):
                continue
            hi = bisect_left(keys, head + b"\xff\xff\xff\xff", lo)
            found = set(self.owners(lo_b, hi_b).tolist())
            where = array[lo:hi]
            docs = (np.searchsorted(first, where, "right") - 1).tolist()
            for a, e, d in zip(where, ends[lo:hi], docs, strict=True):
                place, mine = a - int(first[d]), out[d]
                hits[d].append((place, place + size))
                mine["items"] |= found
                # only a run longer than the longest match so far can hold a longer one
                if e - a > mine["longest"]:
                    n, i = self.longest(own, lo_b, hi_b, raw[4 * a : 4 * e])
                    if n > mine["longest"]:
                        mine.update(longest=n, longest_item=int(np.searchsorted(self.first, self.order[i], "right")) - 1, longest_at=place)
        for d, spans in hits.items():
            out[d]["spans"] = merge(spans)
        return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _type(item) -> tuple[str, pa.DataType]:
    """Spark's and Arrow's type of findings, for items with ids of a Spark type."""
    name, kind = item.simpleString(), to_arrow_type(item)
    spark = f"struct<n_words:bigint,spans:array<struct<a:bigint,z:bigint>>,items:array<{name}>,longest:bigint,longest_item:{name},longest_at:bigint>"
    span = pa.struct([("a", pa.int64()), ("z", pa.int64())])
    return spark, pa.struct([("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(kind)), ("longest", pa.int64()), ("longest_item", kind), ("longest_at", pa.int64())])


def _shards(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t or "")
        if held >= SHARD:
            yield part
            part, held = [], 0
    if part:
        yield part


def _search(blocks: list, item):
    """Column function: texts to what all blocks of the benchmark find in them."""
    spark_type, arrow_type = _type(item)

    @F.arrow_udf(spark_type)
    def found(texts: pa.Array) -> pa.Array:
        rows: list[dict] = []
        for block in blocks:
            side, at = block.value, 0
            for part in _shards(texts.to_pylist()):
                for r in side.shard(part):
                    names = {side.names[i] for i in r["items"]}
                    if r["longest"]:
                        r["longest_item"] = side.names[r["longest_item"]]
                    if at == len(rows):
                        rows.append(r | {"items": names})
                    else:
                        old = rows[at]
                        old["spans"] += r["spans"]
                        old["items"] |= names
                        if r["longest"] > old["longest"]:
                            old.update(longest=r["longest"], longest_item=r["longest_item"], longest_at=r["longest_at"])
                    at += 1
            if len(blocks) > 1:
                # a worker keeps one block at a time; the file of a broadcast stays with the executor
                vars(block).pop("_value", None)
        for r in rows:
            r["spans"] = [{"a": a, "z": z} for a, z in merge(r["spans"])]
            r["items"] = sorted(x for x in r["items"] if x is not None)
        return pa.array(rows, arrow_type)

    return found.asNondeterministic()


def _summed(spans: pa.Array, items: pa.Array) -> pa.Array:
    out = []
    for s, i in zip(spans.to_pylist(), items.to_pylist(), strict=True):
        names = sorted({str(x) for x in i})
        hit = sum(x["z"] - x["a"] for x in s)
        out.append({"n_hit": hit, "n_items": len(names), "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest()})
    return pa.array(out, pa.struct([("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string())]))


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block: int = BLOCK) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark's items in lists of about ``block`` bytes of text (one longer
    item is a list of its own); the driver holds one list at a time."""
    part, held = [], 0
    for r in benchmark.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).toLocalIterator():
        size = len((r["text"] or "").encode()) + 16
        if part and held + size > block:
            yield part
            part, held = [], 0
        part.append((r["item"], r["text"]))
        held += size
    if part:
        yield part


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block: int = BLOCK) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of what the benchmark finds; the column's name.

    Its fields: n_words, spans (hit words, merged), items, longest (words of
    the longest verbatim match), longest_item, longest_at. Documents are read
    once and not shuffled.
    """
    name = unused(docs, "found")
    context = docs.sparkSession.sparkContext
    sides = [context.broadcast(Suffixes(part, window)) for part in blocks(benchmark, block=block)]
    sides = sides or [context.broadcast(Suffixes([], window))]
    return docs.withColumn(name, _search(sides, benchmark.schema["item_id"].dataType)(F.col(text_col))), name


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, longest, longest_item, longest_at.

    A window is ``window`` consecutive words of an item; a shorter item is one
    window, an item without words none. Null or empty texts have no words, on
    either side. An item with a null id counts its hits but has no name in the
    list of items; rows with the same item id are one item; ids may be of any
    type. An empty benchmark hits nothing; repeated documents repeat; of equally
    long matches the first of the smallest window in the benchmark's order is
    given; texts of any length are searched whole.
    """
    found, f = matches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, "text", window, block)
    summed = F.arrow_udf(_summed, "struct<n_hit:bigint,n_items:bigint,items_sha256:string>")
    found = found.withColumn("s", summed(F.col(f)["spans"], F.col(f)["items"]))
    return found.select("doc_id", F.col(f)["n_words"].alias("n_words"), "s.*", (F.col("s.n_hit") > 0).alias("contaminated"), *(F.col(f)[c].alias(c) for c in ("longest", "longest_item", "longest_at")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that a benchmark window occurs in; same columns."""
    found, f = matches(docs, benchmark, text_col, window)
    return found.where(F.size(F.col(f)["spans"]) == 0).drop(f)
