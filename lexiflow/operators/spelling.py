"""Spelling verdicts, suggestions and hyphenation of single words.

Word rules are plain functions over an analyzer (word to analyses, each a
mapping with at least STRUCTURE); :mod:`lexiflow.operators.words` runs them on
the distinct words of a column. Verdicts are ordered: OK is the smallest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

from ..functions.chars import CONSONANT, SOFT_HYPHEN, VOWEL, compositions

OK, CAPITALIZE_FIRST, CAPITALIZATION_ERROR, FAILED = range(4)
LONGEST_WORD = 255
Analysis = dict[str, str]
Analyzer = Callable[[str], list[Analysis]]


@dataclass(frozen=True)
class SpellOptions:
    ignore_dot: bool = False
    ignore_numbers: bool = False
    ignore_uppercase: bool = False
    ignore_nonwords: bool = True
    accept_first_uppercase: bool = True
    accept_all_uppercase: bool = True
    accept_missing_hyphens: bool = False
    accept_extra_hyphens: bool = False


@dataclass(frozen=True)
class HyphenOptions:
    ugly: bool = True
    hyphenate_unknown: bool = True
    min_length: int = 2
    ignore_dot: bool = False


def low(c: str) -> str:
    return c.lower()[:1]


def up(c: str) -> str:
    return c.upper()[:1]


def vowel(c: str) -> bool:
    return low(c) in VOWEL


def consonant(c: str) -> bool:
    return low(c) in CONSONANT


def lowered(word: str) -> str:
    return "".join(map(low, word))


def case_of(word: str) -> str:
    if word.lower() == word == word.upper():
        return "NO_LETTERS"
    if word.upper() == word:
        return "ALL_UPPER"
    if word[1:].lower() != word[1:]:
        return "COMPLEX"
    return "FIRST_UPPER" if low(word[0]) != word[0] else "ALL_LOWER"


_SPELLED = {"’": "'", "‐": "-", "‑": "-", "℃": "°C", "℉": "°F", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
_COMPOSED = dict(compositions())


def normalized(word: str) -> str:
    out, i = [], 0
    while i < len(word):
        if one := _COMPOSED.get(word[i : i + 2]):
            out.append(one)
            i += 2
        else:
            out.append(_SPELLED.get(word[i], word[i]))
            i += 1
    return "".join(out)


def nonword(word: str) -> bool:
    n = len(word)
    if n < 4:
        return False
    slash, at = word.find("/", 0, n - 3), word.find("@")
    return (
        slash >= 0 and word[slash + 1] == "/" and "." in word[slash + 2 :]
        or at > 0 and "." in word[at + 1 :]
        or n >= 5 and lowered(word[:4]) == "www." and "." in word[4:]
    )


def nonword_strict(word: str) -> bool:
    n = len(word)
    if n < 4:
        return False
    slash, at = word.find("/", 0, n - 3), word.find("@", 0, n - 3)
    return (
        slash >= 0 and word[slash + 1] == "/" and "." in word[slash + 2 :]
        or at >= 0 and word[at + 1] != "." and "." in word[at + 2 :]
        or n >= 7 and word[:4] == "www." and word[4] != "." and "." in word[5:]
    )


# ---- verdicts ------------------------------------------------------------------


def structure_verdict(word: str, structure: str) -> int:
    """How the case of a word fits a STRUCTURE (i, j: capital; p, q: small)."""
    result = OK
    for i, (c, s) in enumerate(zip(word, structure.replace("=", ""), strict=False)):
        if c != low(c):
            if s in "pq":
                return CAPITALIZATION_ERROR
        elif c != up(c) and s in "ij":
            if i:
                return CAPITALIZATION_ERROR
            result = CAPITALIZE_FIRST
    return result


@dataclass
class Speller:
    """Verdicts by an analyzer, with the rules for hyphens and soft hyphens."""

    analyze: Analyzer
    options: SpellOptions = field(default_factory=SpellOptions)

    def plain(self, word: str) -> int:
        """The best verdict of the word's analyses."""
        return min((structure_verdict(word, a["STRUCTURE"]) for a in self.analyze(word) if "STRUCTURE" in a), default=FAILED)

    def spell(self, word: str) -> int:
        if SOFT_HYPHEN not in word:
            return self._hyphens(word)
        parts = word.split(SOFT_HYPHEN)
        if not all(parts):  # at an end, or two together
            return FAILED
        bare = "".join(parts)
        result = self._hyphens(bare)
        if result != FAILED:
            marks = hyphen_pattern(bare, self.analyze, HyphenOptions(min_length=3, ignore_dot=True), union=True)
            at = 0
            for p in parts[:-1]:
                at += len(p)
                if marks[at] != "-":
                    return FAILED
        return result

    def _hyphens(self, word: str) -> int:
        result, n = self.plain(word), len(word)
        at = word.find("-", 1, n - 1) if result != OK and n > 3 else -1
        if at < 0:
            return result
        joined = word[:at] + word[at + 1 :]
        if self.options.accept_extra_hyphens and at > 1 and joined[at : at + 1] != "-" and self._hyphens(joined) == OK:
            return OK
        # pop-opisto: the hyphen repeats the vowel and consonant before it
        before, behind = lowered(word[max(0, at - 2) : at]), lowered(word[at + 1 : at + 3])
        if at >= 2 and n - at >= 3 and before == behind and vowel(before[0]) and consonant(before[1]):
            other = self.plain(joined)
            if other < result:
                return other
        # a word and a suffix that may follow any word
        last = word.rfind("-", 1, n - 1)
        head = self.spell(word[:last])
        if head != FAILED and any(a.get("MALAGA_VAPAA_JALKIOSA") == "true" for a in self.analyze(word[last + 1 :])):
            return head
        # syy-silta: the joined word reads both with and without a boundary there
        best = {True: FAILED, False: FAILED}
        for a in self.analyze(joined):
            if (s := a.get("STRUCTURE")) is None:
                continue
            seen = i = 0
            while seen < at and i < len(s):
                seen += s[i] != "="
                i += 1
            if seen == at:
                bound = s[i : i + 1] == "="
                best[bound] = min(best[bound], structure_verdict(joined, s))
        if FAILED not in best.values() and best[True] < result:
            return best[True]
        return result

    def _missing(self, word: str) -> int:
        result = self.spell(word)
        if result != FAILED or not self.options.accept_missing_hyphens or len(word) < 2 or word[0] == word[-1] == "-":
            return result
        return self.spell(("" if word[0] == "-" else "-") + word + ("-" if word[0] == "-" or word[-1] != "-" else ""))

    def accepts(self, word: str) -> bool:
        """Whether a word as written is correct under the options."""
        o = self.options
        if not word:
            return True
        if len(word) > LONGEST_WORD:
            return False
        word = normalized(word)
        case = case_of(word)
        if o.ignore_numbers and any(c in "0123456789" for c in word) or o.ignore_uppercase and case == "ALL_UPPER" or o.ignore_nonwords and nonword(word):
            return True
        if case == "ALL_UPPER" and not o.accept_all_uppercase:
            case = "COMPLEX"
        dotted = o.ignore_dot and word.endswith(".")
        if case in ("COMPLEX", "NO_LETTERS"):
            own = low(word[0]) + word[1:]
            capital = o.accept_first_uppercase and low(word[0]) != word[0]
            fits = lambda r: r == OK or r == CAPITALIZE_FIRST and capital
            return fits(self._missing(own)) or dotted and fits(self._missing(own[:-1]))
        fits = {
            "ALL_LOWER": lambda r: r == OK,
            "FIRST_UPPER": lambda r: r == OK and o.accept_first_uppercase or r == CAPITALIZE_FIRST,
            "ALL_UPPER": lambda r: r != FAILED,
        }[case]
        own = lowered(word)
        return fits(self._missing(own[:-1] if dotted else own)) or dotted and fits(self._missing(own))


# ---- hyphenation ---------------------------------------------------------------

# fixed values
SPLIT_VOWELS = frozenset("ae ao ea eo ia io oa oe ua ue ye eä eö iä iö yä äe öe".split())
LONG_CONSONANTS = ("štš", "shtsh", "tsh", "tš", "zh")
SPLIT_AFTER = ("ie", "ai")
_NO_BREAK_AFTER = "/.:&%'"


def _rules_allowed(word: str, ugly: bool) -> bool:
    return len(word) > 1 and (ugly or not nonword_strict(word) and word[-1] not in "0123456789")


def _room(word: str, marks: list[str], at: int) -> bool:
    """A vowel on both sides of a new break; the first character never counts."""
    if not 0 < at < len(word) - 1:
        return False
    i = at - 1
    left = False
    while i > 0 and marks[i] not in "-=":
        left |= vowel(word[i])
        i -= 1
    if not left:
        return False
    for c, m in zip(word[at:], marks[at:], strict=True):
        if m in "-=" or c == ".":
            return False
        if vowel(c):
            return True
    return False


def syllable_marks(part: str, marks: list[str], ugly: bool) -> list[str]:
    """Marks of one component with the syllable rules applied."""
    if not _rules_allowed(part, ugly) or marks[0] == "X":
        return marks
    word, n, marks = lowered(part), len(part), marks[:]
    pairs = [a + b for a, b in pairwise(word)]
    lead = next((i for i, c in enumerate(word) if not consonant(c)), n)
    for i in range(max(1, lead), n - 1):  # before a consonant and vowel
        if consonant(word[i]) and vowel(word[i + 1]) and word[i - 1] not in _NO_BREAK_AFTER and (i <= 1 or ugly or word[i - 2] != "'"):
            marks[i] = "-"
    for i in range(1, n - 1):  # an apostrophe before a vowel is a boundary
        if word[i] == "'" and vowel(word[i + 1]):
            marks[i] = "="
    for i in range(1, n - 1):  # around a long vowel
        if vowel(word[i]) and word[i] == word[i + 1]:
            if vowel(word[i - 1]) and _room(word, marks, i):
                marks[i] = "-"
            if i + 2 < n and _room(word, marks, i + 2):
                marks[i + 2] = "-"
    for i, pair in enumerate(pairs):  # vowels that are no diphthong
        if marks[i + 1] == " " and pair in SPLIT_VOWELS:
            marks[i + 1] = "-"
    for i in range(1, n - 1):  # clusters that stay whole
        for cluster in LONG_CONSONANTS:
            if word.startswith(cluster, i):
                for k in range(i + 1, min(i + len(cluster), n - 1) + 1):
                    if marks[k] == "-":
                        marks[k], marks[i] = " ", "-"
    if not ugly:
        marks[1] = marks[n - 1] = " "
        for i, (a, b) in enumerate(pairwise(word)):
            if vowel(a) and vowel(b):
                marks[i + 1] = " "
    else:
        for i in range(max(0, n - 3)):
            if pairs[i] in SPLIT_AFTER and marks[i + 1] != "-" and vowel(word[i + 2]) and _room(word, marks, i + 2):
                marks[i + 2] = "-"
    return marks


def compound_marks(structure: str, n: int) -> list[str]:
    """Boundaries that a STRUCTURE sets in a word of n characters."""
    marks, codes, i = [" "] * n, structure.removeprefix("="), 0
    for at in range(n):
        if i >= len(codes):
            break
        if codes.startswith("-=", i):
            if at:
                marks[at] = "="
            i += 2
        elif codes[i] == "=":
            marks[at] = "-"
            i += 2
        else:
            if codes[i] in "jq":
                marks[at] = "X"
            i += 1
    return marks


def _components(word: str, marks: list[str], options: HyphenOptions) -> list[str]:
    """Syllable rules inside every component of a reading."""
    marks, n = marks[:], len(word)
    start = next((i for i, m in enumerate(marks) if m != "="), n)
    end = start + 1
    while start < n:
        if end < n and marks[end] in " X":
            end += 1
            continue
        if end > n:
            break
        if end - start >= options.min_length:
            marks[start:end] = syllable_marks(word[start:end], marks[start:end], options.ugly)
        if end == n:
            break
        start = end + 1 if marks[end] == "=" else end
        end = start + 1
    return marks


def hyphen_pattern(word: str, analyze: Analyzer, options: HyphenOptions | None = None, union: bool = False) -> str:
    """Pattern as long as the word: ' ' no break, '-' break, '=' break that
    takes the character's place. Only breaks of all readings count, or with
    ``union`` those of any."""
    o, n = options or HyphenOptions(), len(word)
    if n < o.min_length:
        return " " * n
    lower = lowered(word)
    readings, size = analyze(lower)[:31], n
    if not readings and o.ignore_dot and n > 1 and word[-1] == ".":
        readings = analyze(lower[:-1])[:31]
        size = n - 1 if readings else n
    if readings:
        found = [compound_marks(a["STRUCTURE"], size) if "STRUCTURE" in a else [" "] * size for a in readings]
        found = [m + [" "] * (n - size) for m in found]
    else:
        one = [" " if o.hyphenate_unknown else "X"] * n
        if _rules_allowed(word, o.ugly):
            one[1 : n - 1] = ["=" if c == "-" else m for c, m in zip(word[1 : n - 1], one[1 : n - 1], strict=True)]
        found = [one]
    cuts = [sum(m not in " X" for m in f) for f in found]
    if min(cuts) == 0:  # a reading as one word rules out those as compounds
        found = _pruned(found, cuts)
    done = [_components(word[:size], f[:size], o) + f[size:] for f in found]
    base = [" " if m == "X" else m for m in done[0]]
    for i in range(n):
        for other in done[1:]:
            if union and other[i] == "-":
                base[i] = "-"
            elif not union and other[i] in " X":
                base[i] = " "
    return "".join(base)


def _pruned(found: list[list[str]], cuts: list[int]) -> list[list[str]]:
    """Readings without boundaries; a removed one's place is taken by the last."""
    rows, i = list(zip(found, cuts, strict=True)), 0
    while i < len(rows):
        if rows[i][1]:
            rows[i] = rows[-1]
            rows.pop()
        else:
            i += 1
    return [f for f, _ in rows]


def insert_hyphens(word: str, pattern: str, separator: str = "-", allow_context_changes: bool = True) -> str:
    """The word with ``separator`` at its breaks; a break that takes a
    character's place keeps it if it is a hyphen, and is left out where context
    changes aren't allowed."""
    out = []
    for c, m in zip(word, pattern, strict=True):
        if m == "-":
            out.append(separator + c)
        elif m == "=" and allow_context_changes and c != "-":
            out.append(separator)
        else:
            out.append(c)
    return "".join(out)


# ---- suggestions ---------------------------------------------------------------

BACK, FRONT = "aou", "äöy"
PRIMARY_INSERTIONS, OTHER_INSERTIONS = "aitesn", "ulkoämrvpyhjdögfbcw:xzqå'."
# fixed values: characters typed for others, as pairs of what is written and what may be meant
REPLACEMENTS = {
    1: ".,asiuiotrtdersšsanmuilkklkgoiäömnrertvbpbpoythjjhjkdtdsdföägfghgkfgfdbpbncvcswewvxczžzxqaåoåpåäåöaeiktyea",
    2: "1q2q2w3w3e4e4r5r5t6t6y7y7u8u8i9i9o0o0p+pie",
    3: "essdnhujlökjopäpmkrdvgplyhhujideölgtfvbvckwaxszaqkåaaåeéaâkcscijxz",
    4: "qwqswqwswdedefrfrgtftgthygyjuhukilokolpöpäsesxdrbgfefrftfcgygbgvhyhnhbhgjujmjnkikokmlolpöpöåäåzsxdcdcfcxvfbhnjnbmjewpåaqswszdwdcdxvcawazsq",
    5: "aooaoutlsraieääeuvvuoddokqpvvpqeeqaddarsetteryyrtuutyiiyuoippioåhvvhhmmh",
}
OCR = "0oliiluoouaääaoööosššszžžzeééeaââapbbpeffeqooqnmmnuvvuoccobhhb" + "".join(f"_{c}" for c in "abcdefghijklmnopqrstuvwxyzäö")


def table(flat: str) -> list[tuple[str, str]]:
    return list(zip(flat[::2], flat[1::2], strict=True))


# fixed values: weights of a noun's case
CASE_WEIGHT = {
    "nimento": 2, "omanto": 3, "osanto": 5, "sisaolento": 8, "sisaeronto": 12, "sisatulento": 8, "ulkoolento": 12, "ulkoeronto": 30,
    "ulkotulento": 20, "olento": 20, "tulento": 20, "vajanto": 60, "seuranto": 60, "keinonto": 20,
}
NOMINAL = frozenset("nimisana laatusana nimisana_laatusana asemosana etunimi sukunimi paikannimi nimi".split())


def reading_priority(analysis: Analysis, verdict: int) -> int:
    """Smaller is better: weight of the case, eightfold per compound part, times the verdict."""
    weight = CASE_WEIGHT.get(analysis.get("SIJAMUOTO", ""), 4) if analysis.get("CLASS") in NOMINAL else 4
    parts = min(5, analysis.get("STRUCTURE", "=p").count("="))
    return weight * (1 if parts == 0 else 8 ** (parts - 1)) * (verdict + 1)


def priority(analyses: list[Analysis], verdict: int) -> int:
    if verdict == FAILED:
        return 2**31 - 1 if not analyses else min(reading_priority(a, 2**31 - 2) for a in analyses)
    return min((reading_priority(a, verdict) for a in analyses), default=verdict + 1)


def recased(word: str, structure: str) -> str:
    """A word in the case that a STRUCTURE asks for."""
    return "".join(up(c) if s in "ij" else low(c) if s in "pq" else c for c, s in zip(word, structure.replace("=", ""), strict=False)) + word[len(structure.replace("=", "")) :]


def vowel_changes(w: str) -> Iterator[str]:
    at = [i for i, c in enumerate(w) if c in BACK + FRONT]
    if not 0 < len(at) <= 7:
        return
    other = dict(zip(BACK + FRONT, FRONT + BACK, strict=True))
    for pattern in range(1, 1 << len(at)):
        out = list(w)
        for bit, i in enumerate(at):
            if pattern >> bit & 1:
                out[i] = other[w[i]]
        yield "".join(out)


def replaced(w: str, pairs: list[tuple[str, str]]) -> Iterator[str]:
    for a, b in pairs:
        for x, y in ((a, b), (up(a), up(b))) if up(a) != a else ((a, b),):
            for i, c in enumerate(w):
                if c == x:
                    yield w[:i] + y + w[i + 1 :]


def deleted(w: str) -> Iterator[str]:
    for i in range(len(w) if len(w) > 1 else 0):
        if not i or low(w[i]) != low(w[i - 1]):
            yield w[:i] + w[i + 1 :]


def hyphen_inserted(w: str) -> Iterator[str]:
    n = len(w)
    if n < 4:
        return
    for j in range(2, n - 1):
        if "-" not in w[j - 2 : j + 2]:
            yield w[:j] + "-" + w[j:]
    j = 0
    while j < n:
        if w[j : j + 1] == w[j + 1 : j + 2]:
            j += 2
        else:
            if w[j] not in "-'":
                yield w[: j + 1] + w[j:]
            j += 1


def doubles_replaced(w: str, pairs: list[tuple[str, str]]) -> Iterator[str]:
    w, i = lowered(w), 0
    while i < len(w) - 1:
        if w[i] == w[i + 1]:
            yield from (w[:i] + 2 * b + w[i + 2 :] for a, b in pairs if a == w[i])
            i += 1
        i += 1


def inserted(w: str, chars: str) -> Iterator[str]:
    for c in chars if w else "":
        for j in range(len(w)):
            if c != low(w[j]) and (not j or c != low(w[j - 1])):
                yield w[:j] + c + w[j:]
        if c != w[-1]:
            yield w + c


def swapped(w: str) -> Iterator[str]:
    n = len(w)
    far = 10 if n <= 8 else 50 // n
    harmony = {frozenset(p) for p in zip(BACK, FRONT, strict=True)}
    for i in range(n):
        for j in range(i + 1, min(n, i + far + 1)):
            a, b = low(w[i]), low(w[j])
            if a != b and frozenset((a, b)) not in harmony:
                yield w[:i] + w[j] + w[i + 1 : j] + w[i] + w[j + 1 :]


def repeats_deleted(w: str) -> Iterator[str]:
    if len(w) >= 6:
        yield from dict.fromkeys(w[:i] + w[i + 2 :] for i in range(len(w) - 3) if w[i : i + 2] == w[i + 2 : i + 4])


def replaced_twice(w: str, pairs: list[tuple[str, str]]) -> Iterator[str]:
    for a, b in pairs:
        for i, c in enumerate(w):
            if c == a:
                first = w[:i] + b + w[i + 1 :]
                for x, y in pairs:
                    for j in range(i, len(w)):
                        if first[j] == x:
                            yield first[:j] + y + first[j + 1 :]


class _Full(Exception):
    pass


@dataclass
class _Search:
    """Suggestions found so far for one word, and what was spent on them."""

    speller: Speller
    slots: int
    budget: int
    found: dict[str, int] = field(default_factory=dict)
    spent: int = 0

    def done(self) -> bool:
        return len(self.found) >= self.slots or self.spent >= self.budget * (1 if self.found else 2)

    def add(self, word: str, weight: int) -> None:
        if len(self.found) < self.slots and word not in self.found:
            self.found[word] = weight * (len(self.found) + 5)

    def probe(self, word: str) -> None:
        if self.done():
            raise _Full
        verdict = self.speller.spell(word)
        self.spent += 1
        if verdict == FAILED:
            return
        analyses = self.speller.analyze(word)
        self.spent += 1
        if verdict == CAPITALIZATION_ERROR:
            if analyses:
                self.add(recased(word, analyses[0]["STRUCTURE"]) if "STRUCTURE" in analyses[0] else word, priority(analyses, verdict))
        else:
            self.add(up(word[0]) + word[1:] if verdict == CAPITALIZE_FIRST else word, priority(analyses, verdict))

    def _half(self, word: str) -> tuple[bool, int, str]:
        capital = low(word[0]) != word[0]
        own = low(word[0]) + word[1:]
        verdict = self.speller.spell(own)
        shown = up(own[0]) + own[1:] if capital or verdict == CAPITALIZE_FIRST else own
        self.spent += 2
        return verdict in (OK, CAPITALIZE_FIRST), priority(self.speller.analyze(shown), verdict), shown

    def split(self, w: str) -> None:
        """Two words, cut from right to left; a hyphen at the cut weighs sixfold."""
        if len(w) < 4:
            return
        for i in range(len(w) - 2, 1, -1):
            if w[i - 2] == "-" or w[i - 1] == "-" or w[i + 1] == "-":
                continue
            ok, weight, first = self._half(w[:i])
            if not ok and w[i - 1] == ".":
                bare, other, shown = self._half(w[: i - 1])
                if bare:
                    ok, weight, first = True, other, shown + "."
            if ok and (rest := w[i + (w[i] == "-") :]):
                ok, other, second = self._half(rest)
                if ok:
                    self.add(f"{first} {second}", min(weight + other, 2**31 - 1) * (6 if w[i] == "-" else 1))
            if self.done():
                return


def _typing(w: str) -> list[Iterator[str] | None]:
    t = {i: table(x) for i, x in REPLACEMENTS.items()}
    return [
        vowel_changes(w), replaced(w, t[1]), deleted(w), hyphen_inserted(w), None, doubles_replaced(w, t[1]), replaced(w, t[2]),
        inserted(w, PRIMARY_INSERTIONS), swapped(w), replaced(w, t[3]), inserted(w, OTHER_INSERTIONS), replaced(w, t[4]),
        doubles_replaced(w, t[2]), doubles_replaced(w, t[3]), doubles_replaced(w, t[4]), repeats_deleted(w), replaced(w, t[5]),
    ]


def suggest(word: str, speller: Speller, most: int = 5, ocr: bool = False) -> list[str]:
    """At most ``most`` suggestions, best first.

    Candidates come in a fixed order and each costs its probes, so the budget
    (800, for scanned text 2,000, doubled while nothing is found) decides how
    far the search gets; early finds weigh less.
    """
    if not word:
        return []
    search = _Search(speller, 3 * most, 2000 if ocr else 800)
    try:
        search.probe(word)
        if not ocr and SOFT_HYPHEN in word:
            search.probe(word.replace(SOFT_HYPHEN, ""))
        if not search.found:
            pairs = table(OCR)
            for stream in [replaced(word, pairs), replaced_twice(word, pairs)] if ocr else _typing(word):
                if search.done():
                    break
                if stream is None:
                    search.split(word)
                else:
                    for candidate in stream:
                        search.probe(candidate)
    except _Full:
        pass
    return sorted(search.found, key=search.found.get)[:most]


def suggest_as_written(word: str, speller: Speller, most: int = 5, ocr: bool = False) -> list[str]:
    """Suggestions in the case of the word, its final dot kept; none for single characters."""
    own = normalized(word)
    if len(own) < 2:
        return []
    out = suggest(own, speller, most, ocr)
    if not out and own.endswith(".") and len(own) > 2:
        out = [f"{x}." for x in suggest(own[:-1], speller, most, ocr)]
    case = case_of(own)
    if case == "ALL_UPPER":
        out = [x.upper() for x in out]
    elif case == "FIRST_UPPER":
        out = [up(x[0]) + x[1:] for x in out]
    return list(dict.fromkeys(out))
