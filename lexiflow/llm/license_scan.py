"""License notices, exact and with a few edits.

A notice of n characters that may have k edits is split into k + 1 pieces: one
of them must stand unchanged in any match. An Aho-Corasick automaton finds the
pieces in the normalised text (lower-case words, one blank between), and only
the surroundings of a piece are searched by the regex library's bounded-error
matching, which counts the edits and gives the span. A match is of whole words.
That library tries an edit only where a character differs, so it misses a few
matches whose edit must stand on a character that fits ("apache license version"
before a blank); a window where it finds none is aligned cell by cell instead.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD_BYTES

#: Phrases whose consecutive words are a base place, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices searched with edits, with their labels.
NOTICES = {
    "released under the mit license": "mit",
    "under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache-2",
    "apache license version 2": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution": "cc-by",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "boost software license": "bsl-1",
    "eclipse public license": "epl",
    "this is free and unencumbered software": "unlicense",
}
#: Edits allowed: one per this many characters of a notice, and at most so many.
CHARS_PER_EDIT = 10
MOST_EDITS = 3


def normal(text: str | None) -> str:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z lower-cased, joined by blanks."""
    return b" ".join((text or "").encode().translate(WORD_BYTES).split()).decode()


def edits_for(notice: str, per: int = CHARS_PER_EDIT, most: int = MOST_EDITS) -> int:
    return min(most, len(notice) // per)


@lru_cache(4)
def _searcher(notices: tuple[tuple[str, str], ...], per: int, most: int):
    import ahocorasick

    seeds = ahocorasick.Automaton()
    found: dict[str, list[tuple[int, int]]] = {}
    compiled = []
    for i, (notice, label) in enumerate(notices):
        k = edits_for(notice, per, most)
        compiled.append((notice, label, k))
        step = len(notice) / (k + 1)
        cuts = [round(step * j) for j in range(k + 2)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            found.setdefault(notice[a:z], []).append((i, a))
    for seed, where in found.items():
        seeds.add_word(seed, (len(seed), where))
    if found:
        seeds.make_automaton()
    return (seeds if found else None), compiled


@lru_cache(256)
def _pattern(notice: str, most: int):
    return regex.compile(f"(?b)(?<= )(?:{regex.escape(notice)}){{e<={most}}}(?= )")


@lru_cache(1 << 14)
def _verified(notice: str, most: int, around: str) -> tuple[int, int, int] | None:
    """(edits, start, end) of the run of whole words nearest to a notice, in a text
    with a further character on either side."""
    if m := _pattern(notice, most).search(around):
        return sum(m.fuzzy_counts), m.start(), m.end()
    return _aligned(notice, most, around)


def _aligned(notice: str, most: int, around: str) -> tuple[int, int, int] | None:
    """As :func:`_verified`, by edit distances of all whole words in the window."""
    # a cell is edits * scale + start, so the least one has the leftmost start
    n, scale, best = len(notice), len(around), None
    never = (most + 1) * scale
    column, live = [never] * (n + 1), False
    for j in range(1, len(around)):
        c = around[j]
        if c == " " and column[n] < never and (best is None or column[n] < best[0]):
            best = column[n], j
        if around[j - 1] == " ":
            column, live = [min(x, i * scale + j) for i, x in enumerate(column)], True
        if live:
            x = column[0] + scale
            new = [x]
            for i in range(n):
                x = min(column[i] if notice[i] == c else column[i] + scale, column[i + 1] + scale, x + scale)
                new.append(x)
            column, live = new, min(new) < never
    return None if best is None else (best[0] // scale, best[0] % scale, best[1])


def fuzzy_spans(text: str, notices=NOTICES, per: int = CHARS_PER_EDIT, most: int = MOST_EDITS) -> list[tuple[str, int, int, int, int]]:
    """(label, first character, end, edits, notice length) in a normalised text.

    Of overlapping matches the best is given: the smallest share of edits, then
    the longest notice, then the leftmost, then the first label.
    """
    seeds, compiled = _searcher(tuple(notices.items()), per, most)
    if seeds is None or not text:
        return []
    near: dict[int, set[int]] = {}
    for end, (size, where) in seeds.iter(text):
        for i, offset in where:
            near.setdefault(i, set()).add(end + 1 - size - offset)
    out = []
    padded = f" {text} "
    for i, begins in near.items():
        notice, label, k = compiled[i]
        for begin in begins:
            # one more character on either side shows whether words start and end there
            a, z = max(0, begin - k), min(len(text), begin + len(notice) + k)
            if m := _verified(notice, k, padded[a : z + 2]):
                out.append((label, a + m[1] - 1, a + m[2] - 1, m[0], len(notice)))
    # where notices overlap, the one that fits with the smallest share of edits stands
    kept: list[tuple[int, int, tuple]] = []
    for x in sorted(set(out), key=lambda x: (x[3] / x[4], -x[4], x[1], x[0])):
        i = bisect_right(kept, (x[1], x[2], x))
        if (i == 0 or kept[i - 1][1] <= x[1]) and (i == len(kept) or x[2] <= kept[i][0]):
            kept.insert(i, (x[1], x[2], x))
    return [x for _, _, x in kept]


def base_places(text: str, phrases=PHRASES) -> list[tuple[int, str]]:
    """(number of the first word, label) of every base place in a normalised text."""
    out, padded, blanks = [], f" {text} ", None
    for phrase, label in phrases.items():
        at = padded.find(f" {phrase} ")
        while at >= 0:
            if blanks is None:
                blanks = [i for i, c in enumerate(text) if c == " "]
            out.append((bisect_right(blanks, at - 1), label))
            at = padded.find(f" {phrase} ", at + 1)
    return sorted(out)


def scan_text(text: str | None, phrases=PHRASES, notices=NOTICES, per: int = CHARS_PER_EDIT, most: int = MOST_EDITS) -> dict:
    words = normal(text)
    base = base_places(words, phrases)
    spans = fuzzy_spans(words, notices, per, most)
    labels = {x for _, x in base}
    score = 1.0 if base else max((1 - e / n for _, _, _, e, n in spans), default=0.0)
    return {
        "n_words": words.count(" ") + 1 if words else 0,
        "n_base": len(base),
        "first_word": base[0][0] if base else None,
        "last_word": base[-1][0] if base else None,
        "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(labels | {x[0] for x in spans})),
        "score": score,
        "spans": [{"label": x, "first": words.count(" ", 0, a + 1), "words": words[a:z].strip().count(" ") + 1, "edits": e, "found": words[a:z].strip()} for x, a, z, e, _ in spans],
    }


_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("edits", pa.int64()), ("found", pa.string())])
_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))]
_SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first:bigint,words:bigint,edits:bigint,found:string>>"


def license_scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, per: int = CHARS_PER_EDIT, most: int = MOST_EDITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, spans.

    ``labels`` are the base labels and those of notices found with edits;
    ``score`` is 1 with a base place, else the largest share of characters
    that an edited notice kept, 0 without any. ``spans`` lists the latter's
    matches in words. ``per`` and ``most`` bound the edits of a notice: one per
    so many characters, and so many at most. A null or empty text has no words
    and no labels; repeated rows repeat; an empty table gives no rows; a text
    of any length is scanned whole; other columns, of any name, aren't read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [scan_text(t.as_py(), phrases, notices, per, most) for t in b.column(1)]
            cols = [pa.array([r[n] for r in rows], t) for n, t in _FIELDS]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *(n for n, _ in _FIELDS)])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, {_SCHEMA}")
