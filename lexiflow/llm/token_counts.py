"""Token counts that follow edits.

A document keeps its pre-tokens (characters and ids of each) in blocks, and a
segment tree over the blocks' sums. An edit changes pre-tokens only from the
one before the white space at its start up to where the old and new cuts agree
again; only this region is encoded, its blocks are replaced, and the sums above them are
renewed. Trees are kept: a table of texts and trees is written once, edits are
applied to it, and the result is such a table again. Special tokens' strings
count as ordinary text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, default_path, load, pattern
from .shared import written

#: Pre-tokens of a block as built; a block of four times as many is built anew.
BLOCK = 64


class CountTree:
    """Pre-tokens of one text under a segment tree of (characters, ids).

    Characters and ids of all pre-tokens are flat arrays; a block is a stretch
    of them, or a list of its own once it was replaced.
    """

    def __init__(self, chars: np.ndarray, ids: np.ndarray):
        self._build(chars, ids)

    def _build(self, chars: np.ndarray, ids: np.ndarray) -> None:
        n = len(chars)
        self.count = -(-n // BLOCK) or 1
        self.bounds = np.minimum(np.arange(self.count + 1) * BLOCK, n)
        self.flat, self.own = (chars, ids), {}
        self.size = 1 << (self.count - 1).bit_length()
        self.sums = []
        for x in self.flat:
            upto = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
            tree = np.zeros(2 * self.size, np.int64)
            tree[self.size : self.size + self.count] = upto[self.bounds[1:]] - upto[self.bounds[:-1]]
            width = self.size
            while width > 1:
                tree[width // 2 : width] = tree[width : 2 * width : 2] + tree[width + 1 : 2 * width : 2]
                width //= 2
            self.sums.append(tree)

    @classmethod
    def of_state(cls, data: bytes) -> CountTree:
        """A tree as :meth:`state` gave it; no sum is computed anew."""
        tree = cls.__new__(cls)
        tree.count, n, width = np.frombuffer(data, np.int32, 3).tolist()
        kind, at = np.dtype(f"u{width}"), 12 + 4 * tree.count
        tree.bounds = np.concatenate(([0], np.cumsum(np.frombuffer(data, np.int32, tree.count, 12))))
        tree.flat, tree.own = (np.frombuffer(data, kind, n, at), np.frombuffer(data, kind, n, at + n * width)), {}
        tree.size = 1 << (tree.count - 1).bit_length()
        at += 2 * n * width
        tree.sums = [np.frombuffer(data, np.int64, 2 * tree.size, at + 16 * tree.size * i).copy() for i in (0, 1)]
        return tree

    def state(self) -> bytes:
        """Numbers of blocks and pre-tokens, pre-tokens of each block, characters and
        ids of each pre-token, and the tree's sums, the root at 1."""
        chars, ids = self._all()
        width = 2 if max(chars.max(initial=0), ids.max(initial=0)) < 1 << 16 else 4
        sizes = [len(self.block(i)[0]) if i in self.own else int(self.bounds[i + 1] - self.bounds[i]) for i in range(self.count)]
        head = np.array([self.count, len(chars), width, *sizes], np.int32)
        return b"".join(x.tobytes() for x in (head, chars.astype(f"u{width}"), ids.astype(f"u{width}"), *self.sums))

    def _all(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters and ids of all pre-tokens, replaced blocks in their places."""
        if not self.own:
            return self.flat
        out, at = ([], []), 0
        for i in [*sorted(self.own), self.count]:
            for j in (0, 1):
                out[j].append(self.flat[j][self.bounds[at] : self.bounds[i]])
                if i < self.count:
                    out[j].append(np.array(self.own[i][j], np.int64))
            at = i + 1
        return np.concatenate(out[0]).astype(np.int64), np.concatenate(out[1]).astype(np.int64)

    def block(self, i: int) -> tuple[list[int], list[int]]:
        found = self.own.get(i)
        return found or tuple(x[self.bounds[i] : self.bounds[i + 1]].tolist() for x in self.flat)

    @property
    def pretokens(self) -> int:
        return int(self.bounds[-1]) + sum(len(c) - int(self.bounds[i + 1] - self.bounds[i]) for i, (c, _) in self.own.items())

    @property
    def chars(self) -> int:
        return int(self.sums[0][1])

    @property
    def tokens(self) -> int:
        return int(self.sums[1][1])

    def find(self, at: int) -> tuple[int, int]:
        """The block with the first pre-token that ends at ``at`` or later, and the block's start."""
        i, before, sums = 1, 0, self.sums[0]
        while i < self.size:
            i *= 2
            if before + sums[i] < at:
                before += int(sums[i])
                i += 1
        return min(i - self.size, self.count - 1), before

    def replace(self, first: int, last: int, chars: list[int], ids: list[int]) -> None:
        """Puts pre-tokens in place of all those in the blocks first to last."""
        if len(chars) > 4 * BLOCK * (last - first + 1):
            self.own.update({i: ([], []) for i in range(first, last + 1)})
            self.own[first] = chars, ids
            self._build(*self._all())
            return
        step = -(-len(chars) // (last - first + 1)) or 1
        for j, i in enumerate(range(first, last + 1)):
            self.own[i] = own = chars[j * step : (j + 1) * step], ids[j * step : (j + 1) * step]
            for tree, x in zip(self.sums, own, strict=True):
                tree[self.size + i] = sum(x)
        level = {(self.size + i) // 2 for i in range(first, last + 1)}
        while level and 0 not in level:
            for i in level:
                for tree in self.sums:
                    tree[i] = tree[2 * i] + tree[2 * i + 1]
            level = {i // 2 for i in level}


class EditedCounts:
    """A text, its tree, and edits on them; ``encoded`` counts pre-tokens encoded."""

    def __init__(self, text: str, tree: CountTree, count):
        self.text, self.tree, self.count, self.encoded = text, tree, count, 0

    def edit(self, at: int, drop: int, put: str) -> None:
        """Replaces ``drop`` characters from ``at`` (both cut to the text) by ``put``."""
        at = min(max(0, at), len(self.text))
        drop = min(max(0, drop), len(self.text) - at)
        new = self.text[:at] + put + self.text[at + drop :]
        tree, shift, resume = self.tree, len(put) - drop, at + len(put)
        # cuts before here don't depend on what is at the edit or behind it: a run of white space
        # may join, and a quote sees two characters ahead ('re)
        back = max(0, at - 1)
        while back and self.text[back - 1].isspace():
            back -= 1
        first, start = tree.find(back)
        # pre-tokens of the first block that end before there stay
        kept_c, kept_n = [], []
        for c, n in zip(*tree.block(first), strict=True):
            if start + c >= back:
                break
            kept_c.append(c)
            kept_n.append(n)
            start += c
        # old cuts are walked along with the new ones until both agree
        last, i, old = first, len(kept_c), start
        here = tree.block(last)
        p, words, match = start, [], pattern().match
        while True:
            while old + shift < p or old < at + drop:
                if i == len(here[0]):
                    if last + 1 == tree.count:
                        break
                    last, i = last + 1, 0
                    here = tree.block(last)
                    continue
                old += here[0][i]
                i += 1
            if p >= resume and old + shift == p:
                break
            if p >= len(new):
                break
            m = match(new, p)
            words.append(m[0])
            p = m.end()
        self.encoded += len(words)
        tail_c, tail_n = here[0][i:], here[1][i:]
        if p >= len(new):
            tail_c, tail_n = [], []
            last = tree.count - 1
        tree.replace(first, last, kept_c + [len(w) for w in words] + tail_c, kept_n + [self.count(w) for w in words] + tail_n)
        self.text = new


def counter(path: str):
    """A function from a pre-token to its number of ids, with a bounded memory."""
    bpe, memory = load(path), {}

    def count(word: str) -> int:
        n = memory.get(word)
        if n is None:
            n = len(bpe.word(word.encode()))
            if len(memory) >= 1 << 17:
                memory.clear()
            if len(word) <= 64:
                memory[word] = n
        return n

    return count


_COUNTS = [("n_tokens_before", pa.int64()), ("n_tokens", pa.int64()), ("n_pretokens", pa.int64()), ("n_encoded", pa.int64()), ("n_chars", pa.int64()), ("text_crc32", pa.int64())]
_COUNTS_SCHEMA = ", ".join(f"{n} bigint" for n, _ in _COUNTS)
#: Documents made into rows at once.
_SLICE = 256
_WORKER: dict[str, tuple] = {}


def _tools(path: str) -> tuple:
    if path not in _WORKER:
        _WORKER[path] = Encoder(load(path).words, {}, None), counter(path)
    return _WORKER[path]


def count_state(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every document's text and tree, to be written and edited later: doc_id, text,
    tree (:meth:`CountTree.state`), and the columns ``keep``. A null text counts as empty."""
    path, keep = path or default_path(), keep or []
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keep)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)

    def run(batches):
        enc, _ = _tools(path)
        for b in batches:
            for at in range(0, b.num_rows, _SLICE):
                part = b.slice(at, _SLICE)
                trees = pa.array([CountTree(*x).state() for x in enc.counts(part.column(1).to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, trees], names=[*part.schema.names, "tree"])

    return given.mapInArrow(run, f"{own}, tree binary")


def edit_state(state: DataFrame, edits: str = "edits", path: str | None = None, trees: bool = True) -> DataFrame:
    """Applies each row's edits to a table of :func:`count_state`, which may have been
    read from a store: doc_id, text and tree after the edits (unless ``trees``
    is false), and the counts.

    ``edits`` is a column ``array<struct<at:int,drop:int,put:string>>``, applied
    in order, each to the text that the one before it left: from character
    ``at``, ``drop`` characters give way to ``put``. Places beyond the text are
    cut to it, null edits and null arrays change nothing, a null ``put`` is
    empty. Only what the edits touch is encoded.

    Counts: n_tokens_before, n_tokens (after), n_pretokens (after), n_encoded
    (pre-tokens encoded for the edits), n_chars and text_crc32 of the text.
    """
    path = path or default_path()
    kind = state.schema["doc_id"].dataType.simpleString()

    def run(batches):
        _, count = _tools(path)
        for b in batches:
            for at in range(0, b.num_rows, _SLICE):
                part = b.slice(at, _SLICE)
                docs, rows = [], []
                for text, todo, tree in zip(*(part.column(i) for i in (1, 2, 3)), strict=True):
                    doc = EditedCounts(text.as_py(), CountTree.of_state(tree.as_py()), count)
                    before = doc.tree.tokens
                    for e in todo.as_py() or []:
                        if e is not None:
                            doc.edit(e["at"] or 0, e["drop"] or 0, e["put"] or "")
                    rows.append((before, doc.tree.tokens, doc.tree.pretokens, doc.encoded, len(doc.text), zlib.crc32(doc.text.encode())))
                    if trees:
                        docs.append((doc.text, doc.tree.state()))
                counts = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _COUNTS, strict=True)]
                after = [pa.array([d[0] for d in docs], pa.string()), pa.array([d[1] for d in docs], pa.binary())] if trees else []
                yield pa.RecordBatch.from_arrays([part.column(0), *after, *counts], names=["doc_id", *(("text", "tree") if trees else ()), *(n for n, _ in _COUNTS)])

    return state.select("doc_id", "text", edits, "tree").mapInArrow(run, f"doc_id {kind}, {'text string, tree binary, ' if trees else ''}{_COUNTS_SCHEMA}")


def edit_table(state: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """:func:`edit_state` by rows (doc_id, seq, at, drop, put): those of a document in
    the order of seq. Documents without edits stay; edits of no document do nothing."""
    one = F.struct("seq", F.col("at").cast("int").alias("at"), F.col("drop").cast("int").alias("drop"), "put")
    lists = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("edits"))
    lists = lists.select("doc_id", F.transform("edits", lambda e: F.struct(e["at"].alias("at"), e["drop"].alias("drop"), e["put"].alias("put"))).alias("edits"))
    return edit_state(state.join(lists, "doc_id", "left"), "edits", path)


def edited_counts(docs: DataFrame, edits: str = "edits", path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of :func:`edit_state`, for a column of edits: all trees are
    built and written, and the edits applied to what is read back.

    A null text counts as empty, repeated rows repeat, no rows give none, other
    columns, of any name, aren't read; a long text costs its first count, and
    from then on what its edits touch.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(edits).alias("edits"))
    state, _ = written(count_state(given, path, keep=["edits"]), "trees")
    return edit_state(state, "edits", path, trees=False)


def sample_edits(text_col: str = "text", id_col: str = "doc_id"):
    """Three edits that follow from a row: an insertion after a third of the
    text, a deletion from its middle, and a replacement at a place that the id
    sets. They stand for a stream of revisions."""
    n = F.length(F.coalesce(F.col(text_col), F.lit("")))
    place = F.pmod(F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)) * 7919, n.cast("bigint") + 1)

    def one(at, drop: int, put: str):
        return F.struct(at.cast("int").alias("at"), F.lit(drop).alias("drop"), F.lit(put).alias("put"))

    return F.array(one(F.floor(n / 3), 0, " it's été"), one(F.floor(n / 2), 7, ""), one(place, 5, "  2024\n\nnew"))
