"""Finite-state lexicons in the binary VFST format: reader, traversal, compiler.

Header of 16 bytes (two cookies, a byte that says weighted), the symbol table
(count, then NUL-terminated UTF-8: epsilon, flag diacritics, single characters,
multi-character symbols), padding, and cells of transitions. A state is the
index of its first cell; the last field there counts the cells that follow,
255 meaning that the next cell holds the count.
"""

from __future__ import annotations

import math
import struct
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np

# fixed values
COOKIES = (0x00013A6E, 0x000351FA)
STEPS, OUTPUTS = 100_000, 100
_PLAIN = np.dtype([("sym_in", "<u2"), ("sym_out", "<u2"), ("info", "<u4")])
_WEIGHTED = np.dtype([("sym_in", "<u4"), ("sym_out", "<u4"), ("target", "<u4"), ("weight", "<i2"), ("more", "u1"), ("pad", "u1")])


class Transducer:
    """A lexicon that maps words to outputs, each with a weight (0 if unweighted)."""

    def __init__(self, data: bytes):
        one, two, weighted = struct.unpack_from("<IIB", data)
        if (one, two) != COOKIES:
            raise ValueError("not a VFST file of this byte order")
        self.weighted = bool(weighted)
        count, at = struct.unpack_from("<H", data, 16)[0], 18
        self.symbols: list[str] = []
        for _ in range(count):
            end = data.index(b"\0", at)
            self.symbols.append(data[at:end].decode())
            at = end + 1
        kind = _WEIGHTED if self.weighted else _PLAIN
        at += -at % kind.itemsize
        self.cells = np.frombuffer(data, kind, (len(data) - at) // kind.itemsize, at)
        self.normal = next((i for i, s in enumerate(self.symbols) if i and not s.startswith("@")), count)
        self.final = 0xFFFFFFFF if self.weighted else 0xFFFF
        self.flags = {i: s.strip("@").split(".") for i, s in enumerate(self.symbols[: self.normal]) if i}
        self.taken = 0

    @cached_property
    def ordinal(self) -> dict[str, int]:
        return {s: i for i, s in enumerate(self.symbols) if i >= self.normal and len(s) == 1}

    def _arcs(self, state: int) -> list[tuple[int, int, int, int]]:
        """(symbol in, symbol out, target, weight) of a state, in file order."""
        known = self.__dict__.setdefault("_known", {})
        if state not in known:
            cell = self.cells[state]
            more = int(cell["more"]) if self.weighted else int(cell["info"]) >> 24
            # the count includes nothing of the state's first cell; an overflow cell isn't an arc
            rows = [state, *range(state + 1, state + more + 1)]
            if more == 255:
                over = self.cells[state + 1]
                size = int(over["sym_in"]) if self.weighted else int.from_bytes(over.tobytes()[:4], "little")
                rows = [state, *range(state + 2, state + size + 2)]
            out = []
            for r in rows:
                c = self.cells[r]
                out.append((int(c["sym_in"]), int(c["sym_out"]), int(c["target"]) if self.weighted else int(c["info"]) & 0xFFFFFF, int(c["weight"]) if self.weighted else 0))
            known[state] = out
        return known[state]

    def _fitting(self, state: int, code: int | None) -> list[tuple[int, int, int, int]]:
        """Arcs that a character may take: final cells, empty ones and flags, then its own, in file order."""
        table = self.__dict__.setdefault("_table", {})
        found = table.get(state)
        if found is None:
            free = [a for a in self._arcs(state) if a[0] == self.final or a[0] < self.normal]
            own: dict[int, list] = {}
            for a in self._arcs(state):
                if a[0] != self.final and a[0] >= self.normal:
                    own.setdefault(a[0], list(free)).append(a)
            found = table[state] = (free, own)
        return found[0] if code is None else found[1].get(code, found[0])

    def _pass(self, flag: list[str], values: dict[str, str]) -> dict[str, str] | None:
        """The flag values after a diacritic, or None where it blocks."""
        op, feature, value = flag[0], flag[1], flag[2] if len(flag) > 2 else None
        now = values.get(feature)
        if op == "P" or op == "U" and (now is None or now == value):
            return {**values, feature: value}
        if op == "C":
            return {k: v for k, v in values.items() if k != feature}
        if op == "R":
            return values if (now is not None if value is None else now == value) else None
        if op == "D":
            return None if (now is not None if value is None else now == value) else values
        return None

    def lookup(self, word: str, prefixes: bool = False, viable: Callable[[str], bool] | None = None) -> Iterator[tuple[str, int, int]]:
        """(output, weight, characters read) of every path, depth first in file
        order; with ``prefixes`` paths may end before the word does. Where
        ``viable`` refuses an output so far, the search goes back behind it.
        It gives up after STEPS transitions without an output; ``taken`` counts
        the transitions of all searches.
        """
        codes = [self.ordinal.get(c, -1) for c in word]
        code = lambda at: codes[at] if at < len(codes) else None
        stack = [(0, "", 0, {}, iter(self._fitting(0, code(0))))] if len(self.cells) else []
        steps = 0
        while stack:
            at, out, weight, values, arcs = stack[-1]
            arc = next(arcs, None)
            if arc is None:
                stack.pop()
                continue
            steps += 1
            self.taken += 1
            if steps > STEPS:
                return
            sym, told, target, cost = arc
            if sym == self.final:
                if at == len(codes) or prefixes:
                    steps = 0
                    yield out, weight + cost, at
                continue
            after, step = values, 1
            if sym < self.normal:
                after, step = values if sym == 0 else self._pass(self.flags[sym], values), 0
                if after is None:
                    continue
            more = self.symbols[told] if told >= self.normal else ""
            if more and viable is not None and not viable(out + more):
                continue
            stack.append((at + step, out + more, weight + cost, after, iter(self._fitting(target, code(at + step)))))

    def first_not_reached(self, word: str) -> int:
        """The place of the first character that no path reads; the word's length if all are read."""
        reach = Reach(self)
        return next((i for i in range(len(word)) if not reach.of(word[: i + 1])), len(word))

    def accepts(self, word: str) -> bool:
        return next(self.lookup(word), None) is not None

    def analyses(self, word: str) -> list[dict[str, str]]:
        """Outputs of the lower-cased word with their probability weights."""
        out = []
        for text, weight, _ in self.lookup("".join(c.lower()[:1] for c in word)):
            out.append({"FSTOUTPUT": text} | ({"WEIGHT": f"{probability(weight):.9f}"} if self.weighted else {}))
            if len(out) == OUTPUTS:
                break
        return out


def probability(weight: int) -> float:
    """A log weight as a probability."""
    return math.exp(-0.01 * weight)


class Reach:
    """States of a lexicon behind every prefix asked for, with their flags and least weights."""

    def __init__(self, t: Transducer):
        self.t = t
        self.memory: dict[str, dict[tuple, int]] = {"": self._closed({(0, ()): 0})} if len(t.cells) else {"": {}}

    def _closed(self, states: dict[tuple, int]) -> dict[tuple, int]:
        """With what empty transitions and flags lead to."""
        t, todo = self.t, list(states.items())
        while todo:
            (state, flags), weight = todo.pop()
            for sym, _, target, cost in t._fitting(state, None):
                if sym == t.final:
                    continue
                after = dict(flags) if sym == 0 else t._pass(t.flags[sym], dict(flags))
                if after is None:
                    continue
                key = target, tuple(sorted(after.items()))
                if weight + cost < states.get(key, 1 << 60):
                    states[key] = weight + cost
                    todo.append((key, weight + cost))
        return states

    def of(self, text: str) -> dict[tuple, int]:
        found = self.memory.get(text)
        if found is None:
            code, then = self.t.ordinal.get(text[-1], -1), {}
            for (state, flags), weight in self.of(text[:-1]).items():
                for sym, _, target, cost in self.t._fitting(state, code):
                    if sym == code:
                        key = target, flags
                        then[key] = min(then.get(key, 1 << 60), weight + cost)
            found = self.memory[text] = self._closed(then)
        return found

    def weight(self, text: str) -> int | None:
        """The least weight of the text as a word of the lexicon."""
        ends = (w + cost for (state, _), w in self.of(text).items() for sym, _, _, cost in self.t._fitting(state, None) if sym == self.t.final)
        return min(ends, default=None)


def corrections(word: str, errors: Transducer, lexicon: Transducer, most: int = 5) -> list[tuple[str, int]]:
    """Words of the lexicon that the error model makes of ``word``, with the
    smallest sum of both weights, ascending. The two are composed: the error
    model's search goes back as soon as no word of the lexicon begins like its
    output."""
    best: dict[str, int] = {}
    reach = Reach(lexicon)
    for text, cost, _ in errors.lookup(word, viable=lambda out: bool(reach.of(out))):
        own = reach.weight(text)
        if own is not None and cost + own < best.get(text, 1 << 60):
            best[text] = cost + own
    return sorted(best.items(), key=lambda x: x[1])[:most]


def _escaped(s: str) -> str:
    return {"@0@": "", "@_SPACE_@": " ", "@_EPSILON_SYMBOL_@": ""}.get(s, s)


def _log_weight(p: str) -> int:
    return round(-100 * math.log(float(p)))


def compile_att(text: str, weighted: bool = False) -> bytes:
    """AT&T text (source, target, in, out[, weight]; finals: state[, weight]) to VFST.

    Weights are probabilities; they are stored as logarithms.
    """
    arcs: dict[int, list[tuple[str, str, int, int]]] = defaultdict(list)
    finals: dict[int, int] = {}
    for line in text.splitlines():
        f = line.split("\t") if "\t" in line else line.split()
        if len(f) >= 4:
            arcs[int(f[0])].append((_escaped(f[2]), _escaped(f[3]), int(f[1]), _log_weight(f[4]) if len(f) > 4 else 0))
        elif f:
            finals[int(f[0])] = _log_weight(f[1]) if len(f) > 1 else 0
    used = {s for rows in arcs.values() for a, b, _, _ in rows for s in (a, b) if s}
    flags = sorted(s for s in used if s.startswith("@"))
    single, multi = sorted(s for s in used if len(s) == 1), sorted(s for s in used if len(s) > 1 and not s.startswith("@"))
    symbols = ["", *flags, *single, *multi]
    code = {s: i for i, s in enumerate(symbols)}
    states = sorted({0, *arcs, *finals, *(t for rows in arcs.values() for _, _, t, _ in rows)})
    final = 0xFFFFFFFF if weighted else 0xFFFF
    rows = {s: ([(final, 0, -1, finals[s])] if s in finals else []) + sorted((code[a], code[b], t, w) for a, b, t, w in arcs[s]) for s in states}
    # a state without any cell still needs one that nothing matches
    rows = {s: r or [(final - 1, 0, -1, 0)] for s, r in rows.items()}
    start, at = {}, 0
    for s in states:
        start[s] = at
        at += len(rows[s]) + (len(rows[s]) > 255)
    out = bytearray(struct.pack("<IIB7x", *COOKIES, int(weighted)) + struct.pack("<H", len(symbols)))
    for s in symbols:
        out += s.encode() + b"\0"
    size = 16 if weighted else 8
    out += bytes(-len(out) % size)
    for s in states:
        more = len(rows[s]) - 1
        for i, (a, b, t, w) in enumerate(rows[s]):
            count = (255 if more >= 255 else more) if i == 0 else 0
            target = start[t] if t >= 0 else 0
            out += struct.pack("<IIIhBB", a, b, target, w, count, 0) if weighted else struct.pack("<HHI", a, b, target | count << 24)
            if i == 0 and more >= 255:
                out += struct.pack("<I", more) + bytes(size - 4)
    return bytes(out)


def read_transducer(spark, path: str) -> bytes:
    """A VFST file's bytes by Spark's own reader (one file, at most 512 MB)."""
    rows = spark.read.format("binaryFile").load(path).select("length", "content").take(2)
    if len(rows) != 1 or rows[0]["length"] > 512 << 20:
        raise ValueError(f"{path}: one VFST file of at most 512 MB is expected")
    return bytes(rows[0]["content"])
