"""Grammar findings of paragraphs.

The look-ahead checks (white space, commas, repeated words, end punctuation)
also exist as JVM expressions in :mod:`lexiflow.operators.local_checks`. Here a
paragraph is walked once with all checks; word flags come from an analyzer,
and without one (no lexicon) no word has any.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import SOFT_HYPHEN
from ..functions.python import arrow
from ..sources.vfst import Transducer
from .spelling import Analysis, Analyzer, low, up
from .tokens import paragraphs, python_sentences, python_tokens

# fixed values: code, name, English and Finnish description
CODES = [
    (1, "INVALID_SPELLING", "Incorrect spelling of word(s)", "Virheellinen kirjoitusasu"),
    (2, "EXTRA_WHITESPACE", "Remove extra space.", "Poista ylimääräinen väli."),
    (3, "SPACE_BEFORE_PUNCTUATION", "Extra space before punctuation", "Ylimääräinen väli välimerkin edessä"),
    (4, "EXTRA_COMMA", "Remove extra comma.", "Poista ylimääräinen pilkku."),
    (5, "INVALID_SENTENCE_STARTER", "Invalid character at the start of a sentence", "Virheellinen virkkeen aloittava merkki"),
    (6, "WRITE_FIRST_LOWERCASE", "Consider writing the word in lowercase.", "Harkitse sanan kirjoittamista pienellä alkukirjaimella."),
    (7, "WRITE_FIRST_UPPERCASE", "The word must be written with a capital letter.", "Sana on kirjoitettava isolla alkukirjaimella."),
    (8, "REPEATING_WORD", "The word appears twice.", "Sana on kirjoitettu kahteen kertaan."),
    (9, "TERMINATING_PUNCTUATION_MISSING", "Punctuation is missing at the end of a sentence.", "Välimerkki puuttuu virkkeen lopusta."),
    (10, "INVALID_PUNCTUATION_AT_END_OF_QUOTATION", "Invalid punctuation at the end of a quotation", "Virheelliset välimerkit lainauksen lopussa"),
    (11, "FOREIGN_QUOTATION_MARK", "Quotation mark not suitable for Finnish text", "Suomenkieliseen tekstiin sopimaton lainausmerkki"),
    (12, "MISPLACED_CLOSING_PARENTHESIS", "Misplaced closing parenthesis", "Väärin sijoitettu sulkumerkki"),
    (13, "NEGATIVE_VERB_MISMATCH", "Negative verb and main verb do not agree.", "Kieltoverbi ja pääverbi eivät sovi yhteen."),
    (14, "A_INFINITIVE_REQUIRED", "The latter verb should be in the a/ä infinitive form.", "Jälkimmäisen verbin tulisi olla a/ä-päätteisessä infinitiivissä."),
    (15, "MA_INFINITIVE_REQUIRED", "The latter verb should be in the maan/mään infinitive form.", "Jälkimmäisen verbin tulisi olla maan/mään-päätteisessä infinitiivissä."),
    (16, "MISPLACED_CONJUNCTION", "A conjunction (ja, tai, mutta, ...) cannot be the last word of a sentence.", "Sidesana (ja, tai, mutta, ...) ei voi olla virkkeen viimeinen sana."),
    (17, "MISSING_MAIN_VERB", "Check whether a main verb is missing from the sentence.", "Tarkista, puuttuuko virkkeestä pääverbi tai -verbejä."),
    (18, "EXTRA_MAIN_VERB", "A comma may be missing, or there may be an extra verb.", "Virkkeestä saattaa puuttua pilkku, tai siinä voi olla ylimääräinen verbi."),
]
QUOTES = '"»”'
MAY_START = "()'-“–—" + QUOTES
SEPARATING = ".:…–—"


@dataclass(frozen=True)
class GrammarOptions:
    """``most_sentences`` and ``most_tokens``: bounds of a paragraph and of a
    sentence, beyond which nothing is checked; by default there are none."""

    accept_titles: bool = False
    accept_unfinished_paragraphs: bool = False
    accept_bulleted_lists: bool = False
    most_sentences: int | None = None
    most_tokens: int | None = None


# fixed values: the bounds of a checker that works on fixed tables
BOUNDED = GrammarOptions(most_sentences=200, most_tokens=500)


@dataclass
class Word:
    """A token with the flags that the analyses of its word give."""

    kind: str
    text: str
    pos: int
    valid: bool = False
    small_initial: bool = True
    place_genitive: bool = False
    maybe_place: bool = False
    conjunction: bool = False
    maybe_conjunction: bool = False
    negative: bool = False
    main_verb: bool = False
    maybe_main_verb: bool = False
    positive: bool = False
    requires: str | None = None
    follower: str | None = None
    maybe_start: bool = False

    @property
    def first(self) -> str:
        return self.text[:1]

    @property
    def end(self) -> int:
        return self.pos + len(self.text)


Error = tuple[int, int, int, list[str]]


def flagged(word: Word, analyses: list[Analysis]) -> Word:
    """Sets the flags: some hold if all analyses agree, some if any does."""
    if not analyses:
        return word
    w = word
    initial = [a.get("STRUCTURE", "")[1:2] for a in analyses]
    small = [c in ("p", "q") for c in initial]
    cls = [a.get("CLASS") for a in analyses]
    mood = [a.get("MOOD") for a in analyses]
    joins = [c == "sidesana" or c == "kieltosana" and w.text.endswith("ä") for c in cls]
    w.valid, w.small_initial = True, all(small)
    w.place_genitive = any(not s and c == "paikannimi" and a.get("SIJAMUOTO") == "omanto" for s, c, a in zip(small, cls, analyses, strict=True))
    w.maybe_place = any("POSSIBLE_GEOGRAPHICAL_NAME" in a for a in analyses)
    w.conjunction, w.maybe_conjunction = all(joins), any(joins)
    w.negative = all(c == "kieltosana" for c in cls)
    w.main_verb = all(c == "teonsana" and m == "indicative" for c, m in zip(cls, mood, strict=True))
    w.maybe_main_verb = any(
        c is None or c == "teonsana" and m not in ("A-infinitive", "E-infinitive") and a.get("NEGATIVE") != "true" for c, m, a in zip(cls, mood, analyses, strict=True)
    )
    w.positive = all(
        c == "teonsana" and a.get("NEGATIVE") == "false" and not (m in (None, "conditional") and a.get("PERSON") in (None, "3")) for c, m, a in zip(cls, mood, analyses, strict=True)
    )
    wants = [{"A-infinitive": "A", "MA-infinitive": "MA"}.get(a.get("REQUIRE_FOLLOWING_VERB", "")) for a in analyses]
    w.requires = wants[0] if all(x == wants[0] for x in wants) else None
    gives = {("A" if m == "A-infinitive" else "MA") for m in mood if m in ("A-infinitive", "MA-infinitive")}
    lacking = any(a.get("PARTICIPLE") == "agent" and a.get("SIJAMUOTO") == "vajanto" for a in analyses)
    w.follower = None if lacking or len(gives) != 1 else gives.pop()
    return w


@dataclass
class Paragraph:
    sentences: list[list[Word]]
    starts: list[int]


def read_paragraph(text: str, analyze: Analyzer | None = None, options: GrammarOptions | None = None) -> Paragraph:
    """Sentences of words; boundaries that are only possible don't split.

    With a bound on tokens, a sentence of more makes the whole paragraph
    structural: all boundaries split and no word has flags.
    """
    o, parts = options or GrammarOptions(), python_tokens(text)
    cuts = python_sentences(text, parts=parts)
    ends, glue = [], False
    for kind, start, n in cuts:
        if glue:
            ends[-1] = start + n
        else:
            ends.append(start + n)
        glue = kind == "POSSIBLE"
    groups = _grouped(parts, ends)[: o.most_sentences]
    plain = o.most_tokens is not None and any(len(g) > o.most_tokens for _, g in groups)
    if plain:
        groups = _grouped(parts, [a + n for _, a, n in cuts])[: o.most_sentences]
    made = [_words(g[: o.most_tokens], a, None if plain else analyze, plain) for a, g in groups]
    return Paragraph(made, [a for a, _ in groups])


def _grouped(parts: list[tuple[str, str]], ends: list[int]) -> list[tuple[int, list[tuple[str, str]]]]:
    """Tokens up to each end, with their start."""
    out, at, i = [], 0, 0
    for end in ends:
        first, start = i, at
        while at < end:
            at += len(parts[i][1])
            i += 1
        out.append((start, parts[first:i]))
    return out


def _words(parts: list[tuple[str, str]], at: int, analyze: Analyzer | None, plain: bool = False) -> list[Word]:
    out, opens = [], False
    for kind, tok in parts:
        w = Word(kind, tok, at)
        if kind == "WORD":
            if analyze:
                flagged(w, analyze(tok.replace(SOFT_HYPHEN, "")))
            w.maybe_start, opens = opens and not plain, False
        elif kind == "PUNCTUATION" and (tok == "..." or tok in SEPARATING):
            opens = True
        out.append(w)
        at += len(tok)
    return out


# ---- checks of a sentence ------------------------------------------------------


def local_punctuation(s: list[Word]) -> list[Error]:
    out: list[Error] = []
    i = 0
    while i < len(s):
        t, nxt = s[i], s[i + 1] if i + 1 < len(s) else None
        comma = nxt is not None and nxt.kind == "PUNCTUATION" and nxt.first == ","
        if t.kind == "WHITESPACE":
            if len(t.text) > 1:
                out.append((2, t.pos, len(t.text), [" "]))
            elif comma:
                out.append((3, t.pos, 2, [","]))
        elif t.kind == "PUNCTUATION":
            if t.first == "[" and i + 2 < len(s) and s[i + 2].first == "]":
                i += 3  # a reference such as [1]
                continue
            if i == 0:
                if t.first not in MAY_START:
                    out.append((5, max(0, t.pos - 1), 2 if t.pos else 1, []))
            elif t.first == "," and comma:
                out.append((4, t.pos, 2, [","]))
        i += 1
    return out


def quotations(s: list[Word]) -> list[Error]:
    out: list[Error] = []
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        if a.kind != "PUNCTUATION":
            continue
        if a.first == "“":
            return [*out, (11, a.pos, 1, ["”"])]
        if b.kind == c.kind == "PUNCTUATION" and b.first in QUOTES and c.first == "," and a.first in ".!?":
            out.append((10, a.pos, 3, [f"{b.first}," if a.first == "." else a.first + b.first]))
    return out


def repeated_words(s: list[Word]) -> list[Error]:
    out: list[Error] = []
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        same = a.kind == c.kind == "WORD" and b.kind == "WHITESPACE" and len(a.text) == len(c.text) and a.text.lower() == c.text.lower()
        if same and a.first not in "0123456789" and a.text not in ("ollut", "olleet", "sillä"):
            out.append((8, a.pos, c.end - a.pos, [a.text]))
    return out


def verbs(s: list[Word], start: int, o: GrammarOptions) -> list[Error]:
    out: list[Error] = []
    if not s or s[0].kind == "PUNCTUATION":
        return out
    if o.accept_bulleted_lists and start == 0 and (s[0].first != up(s[0].first) or not s[0].small_initial):
        return out
    verb: Word | None = None
    at = words = 0
    found, last = False, None
    for i, w in enumerate(s):
        if w.first == "\t":
            return out
        if w.kind == "WORD":
            words += 1
            found |= not w.valid or w.maybe_main_verb or w.negative
            ahead = s[i + 2].text if i + 2 < len(s) else ""
            if w.maybe_conjunction or w.text.startswith("siinä") and ahead.startswith("missä") or w.text.startswith("kävi") and ahead.startswith("miten"):
                verb = None
            elif w.main_verb:
                if verb is None:
                    verb, at = w, i
                else:
                    if not (i == at + 2 and verb.text == w.text):
                        out.append((18, verb.pos, w.end - verb.pos, []))
                    verb = None
        elif w.kind == "PUNCTUATION":
            verb = None
        if w.kind != "WHITESPACE":
            last = w
    if last is not None and not found and words >= 2 and last.first in ".?" and last.text != "...":
        out.append((17, start, last.end - start, []))
    return out


def verb_pairs(s: list[Word]) -> list[Error]:
    negative: list[Error] = []
    required: list[Error] = []
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        if a.kind == c.kind == "WORD" and b.kind == "WHITESPACE":
            if a.negative and c.positive:
                negative.append((13, a.pos, c.end - a.pos, []))
            if a.requires and c.follower and a.requires != c.follower:
                required.append((14 if a.requires == "A" else 15, a.pos, c.end - a.pos, []))
    return negative + required


def last_conjunction(s: list[Word]) -> list[Error]:
    s = s[:-1] if s and s[-1].kind == "WHITESPACE" else s
    if len(s) >= 2 and s[-2].conjunction and s[-2].text != "vaan" and s[-1].text == ".":
        return [(16, s[-2].pos, len(s[-2].text), [])]
    return []


def autocorrections(s: list[Word], table: dict[str, str] | Transducer) -> list[Error]:
    """Known wrong phrases that begin at a word and end at a token's end, the
    longest first; a phrase also matches with a capital first letter. The
    phrases are a table, or an automaton from wrong to right ones."""
    out: list[Error] = []
    if not table or not s:
        return out
    text, base = "".join(w.text for w in s), s[0].pos
    ends = {w.end - base for w in s}
    found = _from_automaton if isinstance(table, Transducer) else _from_table
    for w in s:
        if w.kind != "WORD":
            continue
        a = w.pos - base
        z, right = found(table, text, a, ends)
        if not z and low(text[a]) != text[a]:
            z, right = found(table, text[:a] + low(text[a]) + text[a + 1 :], a, ends)
            right = up(right[:1]) + right[1:]
        if z:
            out.append((1, w.pos, z - a, [right]))
    return out


def _from_table(table: dict[str, str], text: str, a: int, ends: set[int]) -> tuple[int, str]:
    most = max(map(len, table))
    for z in sorted((e for e in ends if a < e <= a + most), reverse=True):
        if right := table.get(text[a:z]):
            return z, right
    return 0, ""


def _from_automaton(phrases: Transducer, text: str, a: int, ends: set[int]) -> tuple[int, str]:
    hits = [(a + n, right) for right, _, n in phrases.lookup(text[a:], prefixes=True) if n and a + n in ends]
    return max(hits, key=lambda x: x[0], default=(0, ""))


# ---- capitals and parentheses of a paragraph -----------------------------------


def _listed(word: str) -> bool:
    import re

    return len(word) == 1 or bool(re.fullmatch(r"[0-9]+(\.[0-9]+)*|[ivxIVX]+", word))


def _chapter(word: str) -> bool:
    import re

    return bool(re.fullmatch(r"[0-9]+(\.[0-9]+)*", word))


@dataclass
class _Capitals:
    """An automaton over words and the separators behind each of them."""

    options: GrammarOptions
    quotes: list[str] = field(default_factory=list)
    ended: bool = False
    errors: list[Error] = field(default_factory=list)

    def mark(self, gap: list[Word]) -> bool:
        quoted = False
        for t in gap:
            if t.kind != "PUNCTUATION":
                continue
            c = t.first
            if c in QUOTES:
                quoted = True
                if self.quotes and self.quotes[-1] == c:
                    self.quotes.pop()
                else:
                    self.quotes.append(c)
            elif c in "([":
                self.quotes.append(c)
            elif c in ")]":
                if not self.quotes:
                    self.errors.append((12, t.pos, 1, []))
                elif self.quotes[-1] in "([":
                    self.quotes.pop()
            elif c in ".!?":
                self.ended = True
        return quoted

    @staticmethod
    def closes(gap: list[Word]) -> bool:
        last = next((t.first for t in reversed(gap) if t.kind == "PUNCTUATION" and t.first != ","), "")
        return last != "" and last in ".?!"

    def step(self, state: str, before: Word | None, word: Word | None, gap: list[Word]) -> str:
        o = self.options
        if state == "INITIAL":
            self.mark(gap)
            return "QUOTED" if self.quotes else "ANY" if o.accept_bulleted_lists or any(t.text == "-" for t in gap) else "UPPER"
        if state == "QUOTED":
            quoted = self.mark(gap)
            if self.quotes:
                return "QUOTED"
            closes, ended = self.closes(gap), self.ended
            if closes or quoted or ended:
                self.ended = False
            return "UPPER" if closes else "ANY" if quoted or ended else "LOWER"
        if word is None:
            return "ANY"
        if gap and gap[0].first == ")" and _listed(word.text):
            self.mark(gap[1:])
            return "ANY"
        if state == "UPPER":
            if low(word.first) == word.first and word.first not in "0123456789" and not word.maybe_start:
                self.errors.append((7, word.pos, len(word.text), [up(word.first) + word.text[1:]]))
        elif state == "LOWER" and self.too_high(word):
            self.errors.append((6, word.pos, len(word.text), [low(word.first) + word.text[1:]]))
        self.mark(gap)
        if self.quotes:
            return "QUOTED"
        tab = any(t.text == "\t" for t in gap)
        place = state != "ANY" and word.place_genitive and len(gap) == 1 and gap[0].first == " "
        if tab or place:
            return "ANY"
        if state != "LOWER" and o.accept_titles and _chapter(word.text):
            return "ANY"
        if state == "UPPER" and word.text.isascii() and word.text.isdigit() and before is not None and before.kind != "WHITESPACE":
            return "ANY"
        if self.closes(gap):
            self.ended = True
            return "UPPER"
        return "LOWER"

    @staticmethod
    def too_high(w: Word) -> bool:
        if not (w.valid and w.small_initial and low(w.first) != w.first) or w.maybe_start or w.maybe_place:
            return False
        return len(w.text) > 1 and w.text[1] not in "-:" and w.text.upper() != w.text


def _skipped(s: list[Word]) -> bool:
    """All capitals, or with a foreign quote before the first small letter."""
    for t in s:
        if t.first == "“":
            return True
        if t.kind == "WORD" and t.text.upper() != t.text:
            return False
    return True


def capitals(p: Paragraph, o: GrammarOptions) -> list[Error]:
    """Errors 6, 7 and 12. The paragraph's last token is never tested as a word."""
    stream = [w for s in p.sentences if not _skipped(s) for w in s]
    # the walk ends with the last sentence's last token, even within skipped ones
    auto, state, i, n = _Capitals(o), "INITIAL", 0, len(stream)
    word, before = None, None
    while i < n:
        gap: list[Word] = []
        own_before, before = before, word
        current = word
        word = None
        while i < n:
            t = stream[i]
            i += 1
            if t.kind == "WORD":
                word = t
                break
            gap.append(t)
            before = t
        state = auto.step(state, own_before, current, gap)
    return auto.errors


def end_punctuation(p: Paragraph, o: GrammarOptions) -> list[Error]:
    if o.accept_titles and len(p.sentences) == 1 or o.accept_unfinished_paragraphs or o.accept_bulleted_lists:
        return []
    if not p.sentences or not p.sentences[-1] or p.sentences[-1][-1].kind == "PUNCTUATION":
        return []
    last = p.sentences[-1][-1]
    return [(9, last.pos, len(last.text), [])]


def paragraph_errors(text: str, analyze: Analyzer | None = None, options: GrammarOptions | None = None, table: dict[str, str] | Transducer | None = None) -> list[Error]:
    """All findings (code, start, length, suggestions), by start and then check order."""
    o, out = options or GrammarOptions(), []
    p = read_paragraph(text, analyze, o)
    for s, start in zip(p.sentences, p.starts, strict=True):
        out += local_punctuation(s) + quotations(s) + repeated_words(s) + verbs(s, start, o) + verb_pairs(s) + last_conjunction(s) + autocorrections(s, table or {})
    out += capitals(p, o) + end_punctuation(p, o)
    return sorted(out, key=lambda e: e[1])


_KIND = "array<struct<error_code:int,start_pos:int,error_len:int,suggestions:array<string>>>"


def error_array(text: Column, analyzer: Callable[[], Analyzer] | None = None, options: GrammarOptions | None = None, table: dict[str, str] | bytes | None = None) -> Column:
    """Array of findings of a paragraph column; ``analyzer`` makes the worker's
    analyzer, ``table`` holds wrong phrases (a dictionary, or a VFST file's bytes)."""

    def run(texts: pa.Array) -> pa.Array:
        known = Transducer(table) if isinstance(table, bytes) else table
        kind = pa.list_(pa.struct([("error_code", pa.int32()), ("start_pos", pa.int32()), ("error_len", pa.int32()), ("suggestions", pa.list_(pa.string()))]))
        analyze = analyzer() if analyzer else None
        names = ("error_code", "start_pos", "error_len", "suggestions")
        return pa.array([None if t is None else [dict(zip(names, e, strict=True)) for e in paragraph_errors(t, analyze, options, known)] for t in texts.to_pylist()], kind)

    return arrow(run, _KIND)(text)


def grammar_errors(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, analyzer=None, options: GrammarOptions | None = None, table: dict[str, str] | bytes | None = None) -> DataFrame:
    """One row per finding in the paragraphs (lines) of a text: kept columns,
    par_idx, start_pos (in the whole text), error_code, error_len, suggestions.

    All sentences and tokens are checked; ``options`` may bound them (BOUNDED).
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c != text_col]
    rows = paragraphs(df, text_col, keep).select(*keep, "par_idx", "start", F.explode(error_array(F.col("paragraph"), analyzer, options, table)).alias("__e"))
    return rows.select(*keep, "par_idx", (F.col("start") + F.col("__e.start_pos")).alias("start_pos"), "__e.error_code", "__e.error_len", "__e.suggestions")


def descriptions(spark, language: str = "en"):
    """Dimension (error_code, name, description), Finnish for ``fi`` and its variants, else English."""
    at = 3 if language.startswith("fi") else 2
    return spark.createDataFrame([(c[0], c[1], c[at]) for c in CODES], "error_code int, name string, description string")
