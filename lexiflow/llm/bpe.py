"""Byte-level BPE of whole texts, vectorised up to distinct pre-tokens.

A batch of texts is cut into pre-tokens by comparing the classes of
neighbouring characters in one array pass. Pre-tokens are grouped by a 128-bit
hash, every distinct one is encoded once per worker (a bounded cache keeps
results across batches), and ids are put together by array indexing.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters handled per array pass, cached pre-tokens, and bytes from which a
#: pre-token is merged by a heap instead of by scans.
SPAN, CACHED, HEAP = 1 << 20, 1_000_000, 256
#: Bits of a slot in the table of merges, and the rank of pairs without one.
PAIR_BITS, NONE = 18, np.iinfo(np.int32).max
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_FREE = np.uint64(2**64 - 1)


@lru_cache(4)
def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point, as the tokenizers library sees it.

    Unicode versions differ between libraries; where the two tables at hand
    disagree, the library itself is asked.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    out = np.full(0x110000, OTHER, np.uint8)
    chars = [chr(i) for i in range(0x110000)]
    general = np.array([unicodedata.category(c)[0] for c in chars])
    out[general == "L"], out[general == "N"] = LETTER, NUMBER
    whole = "".join(c if not 0xD800 <= i < 0xE000 else "\0" for i, c in enumerate(chars))
    newer = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, whole):
            newer[m.start() : m.end()] = kind
    out[newer == SPACE] = SPACE
    ask = ByteLevel(add_prefix_space=False)
    for i in np.flatnonzero(out != newer):
        if not 0xD800 <= i < 0xE000:
            cuts = [b for _, b in ask.pre_tokenize_str(f"a{chars[i] * 2}1")]
            out[i] = LETTER if cuts[0] == (0, 3) else NUMBER if cuts[1] == (1, 4) else OTHER if cuts[1] == (1, 3) else SPACE
    return out


def boundaries(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each code point starts a pre-token; ``first``: starts of texts.

    The cuts are those of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+|
    ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    n = len(cp)
    kind = classes()[cp]
    opens = np.zeros(n, bool)
    opens[first] = True
    ends = np.ones(n, bool)
    ends[:-1] = opens[1:]
    ws = kind == SPACE
    blank = cp == 32
    prior = np.empty(n, np.uint8)
    prior[0], prior[1:] = 255, kind[:-1]
    prior[opens] = 255
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    after_blank[opens] = False
    next_ws = np.ones(n, bool)
    next_ws[:-1] = ws[1:]
    next_ws[ends] = True
    start = np.where(ws, (prior != SPACE) | ~next_ws, (kind != prior) & ~after_blank)
    # a contraction: an apostrophe at a start, not after a blank, with its ending
    for i in np.flatnonzero((cp == 39) & start):
        tail = "".join(map(chr, cp[i + 1 : i + 3]))
        size = 1 if tail[:1] in ("s", "t", "m", "d") else 2 if tail in ("re", "ve", "ll") else 0
        if size and tail and not opens[i + 1 : i + 1 + size].any():
            start[i + 1 : i + 1 + size] = False
            if i + 1 + size < n and kind[i + 1 + size] == LETTER:
                start[i + 1 + size] = True
    return start


class Bpe:
    """Merges of a byte-level BPE file, by the contiguous rank array."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        # bytes stand as printable characters in the file; the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
        byte = {c: b for b, c in char.items()}
        self.single = [vocab[char[b]] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for t, i in vocab.items():
            self.token[i] = bytes(byte[c] for c in t)
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pair.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def word(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        if len(data) > HEAP:
            return self._long(data)
        one, get = self.single, self.pair.get
        parts = [one[b] for b in data]
        none = (1 << 60, 0)
        ranks = [get(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low is none or low[0] == 1 << 60:
                break
            i = ranks.index(low)
            parts[i] = low[1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], low[1]), none)
            if i < len(ranks):
                ranks[i] = get((low[1], parts[i + 1]), none)
        return parts

    def _long(self, data: bytes) -> list[int]:
        """The same for a long pre-token: linked parts and a heap of ranks."""
        ids = [self.single[b] for b in data]
        n = len(ids)
        left, right, get = list(range(-1, n - 1)), list(range(1, n + 1)), self.pair.get
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1])))]
        heapify(heap)
        while heap:
            _, i, a, b, new = heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = new, -1, right[j]
            if right[i] < n:
                left[right[i]] = i
                if r := get((new, ids[right[i]])):
                    heappush(heap, (r[0], i, new, ids[right[i]], r[1]))
            if left[i] >= 0 and (r := get((ids[left[i]], new))):
                heappush(heap, (r[0], left[i], ids[left[i]], new, r[1]))
        return [x for x in ids if x >= 0]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE where they don't merge."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        keys, ranks = self.pairs
        slot = ((key * _B1) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = np.full(len(key), NONE, np.int32)
        todo = np.arange(len(key))
        while len(todo):
            found = keys[slot]
            same = found == key[todo]
            out[todo[same]] = ranks[slot[same]]
            on = ~same & (found != _FREE)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << PAIR_BITS) - 1)
        return out

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The merges as an open-addressed table: keys, ranks."""
        keys, ranks = np.full(1 << PAIR_BITS, _FREE), np.zeros(1 << PAIR_BITS, np.int32)
        for (a, b), (rank, _) in self.pair.items():
            key = a << 32 | b
            at = ((key * int(_B1)) & (2**64 - 1)) >> (64 - PAIR_BITS)
            while keys[at] != _FREE:
                at = (at + 1) & ((1 << PAIR_BITS) - 1)
            keys[at], ranks[at] = key, rank
        return keys, ranks

    @cached_property
    def merged(self) -> np.ndarray:
        """The id that a merge of each rank makes."""
        out = np.zeros(max((r for r, _ in self.pair.values()), default=0) + 1, np.int32)
        for rank, new in self.pair.values():
            out[rank] = new
        return out

    def many(self, words: list[bytes]) -> list[list[int]]:
        """Ids of short pre-tokens, all worked on together.

        A row of ``part`` holds a pre-token's parts, a row of ``rank`` the
        ranks of its neighbours. In each round every row's smallest rank is
        found by a scan, the boundary there is deleted, and the ranks on both
        sides are looked up again; rows without a merge are done.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        wide = int(size.max()) + 1
        part = np.full((len(words), wide), -1, np.int32)
        data = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(len(words)), size)
        part[row, np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)] = np.array(self.single, np.int32)[data]
        rank = np.full((len(words), wide), NONE, np.int32)
        r, c = np.nonzero(part[:, 1:] >= 0)
        rank[r, c] = self._rank(part[r, c], part[r, c + 1])
        out: list[list[int]] = [[]] * len(words)
        who, cols = np.arange(len(words)), np.arange(wide - 1)
        while len(who):
            at = rank.argmin(1)
            low = rank[np.arange(len(who)), at]
            done = low == NONE
            if done.any():
                for i, p in zip(who[done].tolist(), part[done].tolist(), strict=True):
                    out[i] = p[: p.index(-1)]
                go = ~done
                who, part, rank, at, low = who[go], part[go], rank[go], at[go], low[go]
                if not len(who):
                    break
            here = np.arange(len(who))
            new = self.merged[low]
            part[here, at] = new
            part[:, :-1] = np.where(cols > at[:, None], part[:, 1:], part[:, :-1])
            rank[:, :-1] = np.where(cols >= at[:, None], rank[:, 1:], rank[:, :-1])
            rank[here, at] = NONE
            ok = part[here, at + 1] >= 0
            rank[here[ok], at[ok]] = self._rank(new[ok], part[here[ok], at[ok] + 1])
            ok = at > 0
            rank[here[ok], at[ok] - 1] = self._rank(part[here[ok], at[ok] - 1], new[ok])
        return out

    def words(self, words: list[str]) -> list[list[int]]:
        data = [w.encode() for w in words]
        out: list[list[int]] = [[]] * len(data)
        left = set(range(len(data)))
        for most in (8, 14, 24):
            if len(own := [i for i in left if len(data[i]) <= most]) >= 64:
                left.difference_update(own)
                for i, ids in zip(own, self.many([data[i] for i in own]), strict=True):
                    out[i] = ids
        for i in left:
            out[i] = self.word(data[i])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Bytes of all ids, special ones too, read as UTF-8."""
        return b"".join(map(self.token.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(2)
def load(path: str) -> Bpe:
    return Bpe(path)


def _safe_cut(text: str, at: int) -> int:
    """A place from ``at`` on where a text can be cut between pre-tokens."""
    m = regex.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])").search(text, at)
    return m.start() if m else len(text)


@lru_cache(1)
def pattern() -> regex.Pattern:
    """The pre-token pattern, its classes being those of :func:`classes`."""
    kind = classes()

    def ranges(which: int) -> str:
        at = np.flatnonzero(np.diff(np.concatenate(([False], kind == which, [False])).astype(np.int8)))
        return "".join(f"\\U{a:08X}-\\U{z - 1:08X}" for a, z in zip(at[::2].tolist(), at[1::2].tolist(), strict=True))

    l, n, s = (ranges(x) for x in (LETTER, NUMBER, SPACE))  # noqa: E741
    return regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{l}]+| ?[{n}]+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+")


class _Known:
    """Encoded pre-tokens by hash: open addressing, all in arrays.

    ``key`` holds the first hash of a slot and ``at`` its entry; an entry has
    the second hash, the length, and where its ids are. A pre-token is found
    only if all of these agree.
    """

    def __init__(self):
        self.bits = (2 * CACHED).bit_length()
        self.clear()

    def clear(self) -> None:
        self.n = self.used = 0
        self.key, self.at = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        self.second, self.length, self.offset, self.size = np.zeros(1024, np.uint64), np.zeros(1024, np.int32), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, "<u4")

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * _B2) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h1, h2, length) -> np.ndarray:
        """Entries, or -1."""
        out = np.full(len(h1), -1, np.int64)
        todo, slot, last = np.arange(len(h1)), self._slot(h1), (1 << self.bits) - 1
        while len(todo):
            at = self.at[slot]
            same = (at >= 0) & (self.key[slot] == h1[todo])
            out[todo[same]] = at[same]
            on = (at >= 0) & ~same
            todo, slot = todo[on], (slot[on] + 1) & last
        sure = out >= 0
        sure[sure] = (self.second[out[sure]] == h2[sure]) & (self.length[out[sure]] == length[sure])
        out[~sure] = -1
        return out

    def extra(self, n: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Entries without a slot."""
        first, m = self.n, len(n)
        while len(self.offset) < first + m:
            for name in ("second", "length", "offset", "size"):
                setattr(self, name, np.concatenate((x := getattr(self, name), np.zeros(len(x), x.dtype))))
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), "<u4")))
        self.size[first : first + m] = n
        self.offset[first : first + m] = self.used + np.cumsum(n) - n
        self.ids[self.used : self.used + len(ids)] = ids
        self.n, self.used = first + m, self.used + len(ids)
        return np.arange(first, first + m)

    def add(self, h1, h2, length, n, ids) -> None:
        """Entries for hashes, each one once, that have none."""
        own = self.extra(n, ids).astype(np.int32)
        self.second[own], self.length[own] = h2, length
        todo, slot, last = np.arange(len(h1)), self._slot(h1), (1 << self.bits) - 1
        while len(todo):
            # a hash that is there already (its pre-token is another one) gets no slot
            free = self.at[slot] < 0
            twin = ~free & (self.key[slot] == h1[todo])
            self.at[slot[free]] = own[todo[free]]
            won = free & (self.at[slot] == own[todo])
            self.key[slot[won]] = h1[todo[won]]
            on = ~won & ~twin
            todo, slot = todo[on], (slot[on] + 1) & last

    def shrink(self) -> None:
        """Forget everything once the entries or ids are too many."""
        if self.n > 2 * CACHED or self.used > 16 * CACHED:
            self.clear()


class Encoder:
    """Texts to ids; ``words`` encodes a list of distinct pre-tokens."""

    def __init__(self, words: Callable[[list[str]], list[list[int]]], special: dict[str, int], split):
        self.words, self.special, self.split = words, special, split
        self.known = _Known()

    def _made(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and all ids of words."""
        made = self.words(words)
        n = np.fromiter(map(len, made), np.int64, len(made))
        return n, np.fromiter(chain.from_iterable(made), "<u4", int(n.sum()))

    def pieces(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens of a few texts: the joined text, their starts and ends in it, texts' starts."""
        joined = "".join(texts)
        first = np.cumsum([0, *map(len, texts)])[:-1]
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = np.flatnonzero(boundaries(cp, first[first < len(cp)]))
        return joined, starts, np.append(starts[1:], len(cp)), first

    def _codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens of texts, not all empty: starts and ends in the joined
        text, entries in ``known``, starts of the texts."""
        joined, starts, ends, first = self.pieces(texts)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
        within = np.arange(len(cp)) - np.repeat(starts, ends - starts)
        mixed = (cp + np.uint64(1)) * _B2
        mixed ^= mixed >> np.uint64(29)
        power = _powers(int(within.max()) + 1)[within]
        h1 = np.add.reduceat(mixed * power, starts)
        h2 = np.add.reduceat((mixed ^ (cp << np.uint64(40))) * (power ^ (power >> np.uint64(31)) | np.uint64(1)), starts)
        length = ends - starts
        known = self.known
        code = known.find(h1, h2, length)
        if len(miss := np.flatnonzero(code < 0)):
            _, rep = np.unique(h1[miss], return_index=True)
            rep = miss[rep]
            if known.n + len(rep) > CACHED:
                known.clear()
                code[:] = -1
                miss = np.arange(len(h1))
                rep = np.unique(h1, return_index=True)[1]
            made = self._made([joined[a:z] for a, z in zip(starts[rep].tolist(), ends[rep].tolist(), strict=True)])
            known.add(h1[rep], h2[rep], length[rep], *made)
            code[miss] = known.find(h1[miss], h2[miss], length[miss])
            if len(odd := np.flatnonzero(code < 0)):  # two pre-tokens with one hash: each is encoded for itself
                made = self._made([joined[a:z] for a, z in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)])
                code[odd] = known.extra(*made)
        return starts, ends, code, first

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        if not any(texts):
            return [np.zeros(0, "<u4")] * len(texts)
        starts, _, code, first = self._codes(texts)
        known = self.known
        n = known.size[code]
        upto = np.cumsum(n)
        ids = known.ids[np.repeat(known.offset[code] - upto + n, n) + np.arange(upto[-1])]
        known.shrink()
        # ids before each text: those of the pre-tokens that start before it
        upto = np.append(0, upto)
        at = upto[np.searchsorted(starts, first)]
        return np.split(ids, at[1:])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, special tokens' strings read as such."""
        flat: list[str | int] = []
        count: list[int] = []
        for t in texts:
            n, at = len(flat), 0
            if self.split and "<" in t or self.split and self.split.search(t):
                for m in self.split.finditer(t):
                    flat += [*self._cuts(t[at : m.start()]), self.special[m[0]]]
                    at = m.end()
            flat += self._cuts(t[at:] if at else t)
            count.append(len(flat) - n)
        done: list[np.ndarray] = []
        block: list[str] = []
        held = 0
        for x in flat:
            if isinstance(x, int):
                done += self._block(block) if block else []
                block, held = [], 0
                done.append(np.array([x], "<u4"))
                continue
            block.append(x)
            held += len(x)
            if held >= SPAN:
                done += self._block(block)
                block, held = [], 0
        done += self._block(block) if block else []
        out, i = [], 0
        for n in count:
            out.append(done[i] if n == 1 else np.concatenate(done[i : i + n]))
            i += n
        return out

    def counts(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Characters and ids of each pre-token of each text, read as ordinary text."""
        out = []
        for i in range(0, len(texts), 256):
            part = texts[i : i + 256]
            if sum(map(len, part)) > 2 * SPAN:
                out += [tuple(np.concatenate(x) for x in zip(*(self._sizes([p])[0] for p in self._cuts(t)), strict=True)) for t in part]
            else:
                out += self._sizes(part)
        return out

    def _sizes(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        if not any(texts):
            return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
        starts, ends, code, first = self._codes(texts)
        n, chars = self.known.size[code], ends - starts
        self.known.shrink()
        cuts = np.searchsorted(starts, first)[1:]
        return list(zip(np.split(chars, cuts), np.split(n, cuts), strict=True))

    @staticmethod
    def _cuts(text: str) -> Iterator[str]:
        while len(text) > 2 * SPAN and (at := _safe_cut(text, SPAN)) < len(text):
            yield text[:at]
            text = text[at:]
        yield text


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n, 1024) - 1, _B1))))
    return _POWERS[:n]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """By this module's own merges."""
    bpe = load(path)
    return Encoder(bpe.words, bpe.special, bpe.split)


@lru_cache(2)
def library_encoder(path: str) -> Encoder:
    """By the tokenizers library, asked once for each distinct pre-token."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    special = {t.content: i for i, t in lib.get_added_tokens_decoder().items()}
    split = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
    plain = regex.compile(r"\s")

    def words(ws: list[str]) -> list[list[int]]:
        # pre-tokens without inner white space are encoded by the library in one
        # text, each on a line: line ends are pre-tokens of their own there
        lines = [w for w in ws if not plain.search(w, 1) and w not in special and not w.isspace()]
        made: dict[str, list[int]] = {}
        if lines:
            ids = lib.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids
            cuts = np.flatnonzero(np.array(ids, np.int64) == line_end).tolist()
            parts = [ids[a:z] for a, z in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True)]
            if len(parts) == len(lines):
                made = dict(zip(lines, parts, strict=True))
        rest = [w for w in ws if w not in made]
        if rest:
            made.update(zip(rest, (e.ids for e in lib.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        return [made[w] for w in ws]

    line_end = lib.encode("\n", add_special_tokens=False).ids[0]
    return Encoder(words, special, split)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256, exact) per document.

    Ids are hashed as little-endian unsigned 32-bit integers, decoded texts as
    UTF-8; ``exact`` says whether decoding gave the text back. A null text
    counts as empty (no ids). Rows don't depend on each other: repeated rows
    repeat, no rows give none, and a text of any length is encoded in spans
    that end between pre-tokens.
    """
    path = path or default_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own, bpe = encoder(path), load(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n, first, second, exact = [], [], [], []
                for text, ids in zip(texts, own.encode(texts), strict=True):
                    back = bpe.decode(ids)
                    n.append(len(ids))
                    first.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    second.append(hashlib.sha256(back.encode()).hexdigest())
                    exact.append(back == text)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string()), pa.array(exact, pa.bool_())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean")


def encoded(docs: DataFrame, path: str | None = None, text_col: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with its ids (array of int) in a column, the operator's other output.

    A column named ``into`` is replaced; other columns, and repeated rows, stay.
    """
    path = path or default_path()

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        made = encoder(path).encode([t or "" for t in texts.to_pylist()])
        return pa.array([x.astype(np.int32) for x in made], pa.list_(pa.int32()))

    return docs.withColumn(into, ids(F.col(text_col)))


def decoded(docs: DataFrame, path: str | None = None, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """The text of an ids column (null: empty), in a column that replaces one named ``into``."""
    path = path or default_path()

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        return pa.array([load(path).decode(np.array(x.as_py() or [], np.int64)) for x in ids], pa.string())

    return docs.withColumn(into, text(F.col(ids_col)))
