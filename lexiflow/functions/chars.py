"""Character classes and word predicates as column expressions.

Classes are fixed code point ranges, not the regex engine's: ``À``, ``×`` and
``÷`` are no letters, and no-break spaces are white space. All expressions give
null for null and stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: first and last code points of the ranges
LETTER_RANGES = [
    (0x41, 0x5A), (0x61, 0x7A), (0xC1, 0xD6), (0xD8, 0xF6), (0xF8, 0x2AF), (0x400, 0x481), (0x48A, 0x527), (0x1400, 0x15C3), (0xFB00, 0xFB04),
]
DIGIT_RANGES = [(0x30, 0x39)]
SPACE_RANGES = [
    (0x20, 0x20), (0x09, 0x0D), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F),
    (0x205F, 0x205F), (0x3000, 0x3000),
]
QUOTES = '"\u00BB\u201D'
PUNCTUATION = ".,;-!?:'()[]{}/&\u00AD\u2019\u2010\u2011\u2013\u2014\u201C\u2026" + QUOTES


def _body(ranges: list[tuple[int, int]]) -> str:
    return "".join(chr(a) if a == z else f"{chr(a)}-{chr(z)}" for a, z in ranges)


# bodies of bracket expressions, for Java's and Python's regex alike
LETTER, DIGIT, SPACE = _body(LETTER_RANGES), _body(DIGIT_RANGES), _body(SPACE_RANGES)
QUOTE = QUOTES
PUNCT = "".join(f"\\{c}" if c in "-[]" else c for c in PUNCTUATION)
HYPHEN = "\\-\u00AD\u2010\u2011"
#: Letters below U+0100 one by one: Java looks these up in a table.
FAST_LETTER = "".join(chr(c) for a, z in LETTER_RANGES for c in range(a, min(z, 0xFF) + 1))
VOWEL = "aeiouy\u00E4\u00F6"
CONSONANT = "bcdfghjklmnpqrstvwxz\u0161\u017E"

SOFT_HYPHEN = "\u00AD"


def _is(body: str):
    return lambda c: c.rlike(f"^[{body}]")


def within(code: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a code point is in some range; single ones are looked up in a set."""
    single = [a for a, z in ranges if a == z]
    out = code.isin(*single) if single else F.lit(False)
    for a, z in reversed(ranges):
        if a != z:
            out = code.between(a, z) | out
    return out


def char_type(c: Column) -> Column:
    """LETTER, WHITESPACE, PUNCTUATION, DIGIT or UNKNOWN, by the first character.

    Comparisons of its code point, so that no pattern is run per character.
    """
    return F.when(F.length(c) > 0, code_type(F.ascii(c)))


def code_type(code: Column) -> Column:
    """The same by a code point column."""
    return (
        F.when(code.isNull(), None)
        .when(within(code, LETTER_RANGES), "LETTER")
        .when(within(code, SPACE_RANGES), "WHITESPACE")
        .when(within(code, [(ord(x), ord(x)) for x in PUNCTUATION]), "PUNCTUATION")
        .when(within(code, DIGIT_RANGES), "DIGIT")
        .otherwise("UNKNOWN")
    )


def simple_upper(c: Column) -> Column:
    """First character of the full upper-case mapping: ß gives S, not SS."""
    return F.substring(F.upper(c), 1, 1)


def simple_lower(c: Column) -> Column:
    return F.substring(F.lower(c), 1, 1)


def is_upper(c: Column) -> Column:
    return c != simple_lower(c)


def is_lower(c: Column) -> Column:
    return c != simple_upper(c)


def is_vowel(c: Column) -> Column:
    """One of aeiouyäö, either case; å isn't one."""
    return F.lower(c).rlike(f"^[{VOWEL}]")


def is_consonant(c: Column) -> Column:
    return F.lower(c).rlike(f"^[{CONSONANT}]")


def is_whitespace(c: Column) -> Column:
    return _is(SPACE)(c)


def is_quote(c: Column) -> Column:
    return _is(QUOTE)(c)


def equals_ignore_case(a: Column, b: Column) -> Column:
    return (F.length(a) == F.length(b)) & (F.lower(a) == F.lower(b))


def detect_case(w: Column) -> Column:
    """NO_LETTERS, ALL_UPPER, COMPLEX, FIRST_UPPER or ALL_LOWER.

    Only characters with two cases count: without a lower-case one a word is
    ALL_UPPER, with a capital after the first character COMPLEX.
    """
    rest = F.substring(w, 2, 1 << 30)
    return (
        F.when(w.isNull(), None)
        .when((F.lower(w) == w) & (F.upper(w) == w), "NO_LETTERS")
        .when(F.upper(w) == w, "ALL_UPPER")
        .when(F.lower(rest) != rest, "COMPLEX")
        .when(is_upper(F.substring(w, 1, 1)), "FIRST_UPPER")
        .otherwise("ALL_LOWER")
    )


def set_case(w: Column, case: Column) -> Column:
    """The word in the case asked for; NO_LETTERS and COMPLEX leave it."""
    return (
        F.when(case == "ALL_LOWER", F.lower(w))
        .when(case == "ALL_UPPER", F.upper(w))
        .when(case == "FIRST_UPPER", F.concat(simple_upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))
        .otherwise(w)
    )


# fixed values: base letters that each combining mark is composed with
_MARKS = {
    "\u0300": "AEIOUaeiou\u0415\u0435",
    "\u0301": "AEIOUYaeiouy\u0413\u0433",
    "\u0302": "AEIOUaeiou",
    "\u0303": "ANOano",
    "\u0308": "AEIOUaeiouy\u0415\u0435\u041E\u043E",
    "\u030A": "Aa",
    "\u0327": "Cc",
    "\u030C": "SsZz",
    "\u0306": "\u0418\u0438",
}
# fixed values: single characters and ligatures that are spelled out
_SPELLED = {"\u2019": "'", "\u2010": "-", "\u2011": "-", "\u2103": "\u00B0C", "\u2109": "\u00B0F", "\uFB00": "ff", "\uFB01": "fi", "\uFB02": "fl", "\uFB03": "ffi", "\uFB04": "ffl"}


def compositions() -> list[tuple[str, str]]:
    """(base letter and mark, composed letter), from Unicode's own table."""
    import unicodedata

    return [(base + mark, unicodedata.normalize("NFC", base + mark)) for mark, bases in _MARKS.items() for base in bases]


def normalize(w: Column) -> Column:
    """Composes letters with their marks, then spells out typographic characters.

    The order matters: a mark after a ligature isn't composed with the
    ligature's last letter. Words without any such character, nearly all, pass
    after one test.
    """
    touched = w.rlike(f"[{''.join(_MARKS)}{''.join(_SPELLED)}]")
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in [*compositions(), *_SPELLED.items()]))
    return F.when(touched, F.aggregate(pairs, w, lambda text, p: F.replace(text, p["a"], p["b"]))).otherwise(w)


def strip_soft_hyphens(w: Column) -> Column:
    return F.replace(w, F.lit(SOFT_HYPHEN), F.lit(""))


_SLASHES = r"(?s)^[^/]*//(?=.{2}).*\."


def is_nonword(w: Column) -> Column:
    """URLs and e-mail addresses as the speller sees them, from 4 characters
    on: the first slash is doubled and a dot follows; an ``@`` that isn't first
    and a dot after it; ``www.`` in any case and another dot (5 characters)."""
    return (F.length(w) >= 4) & (w.rlike(_SLASHES) | w.rlike(r"(?s)^[^@]+@.*\.") | w.rlike(r"(?si)^www\..*\."))


def is_nonword_strict(w: Column) -> Column:
    """The hyphenator's variant: no dot right after the ``@``; ``www.`` only in
    lower case, with another character before its next dot, from 7 characters."""
    return (F.length(w) >= 4) & (
        w.rlike(_SLASHES) | w.rlike(r"(?s)^[^@]*@(?=.{3})[^.].*\.") | ((F.length(w) >= 7) & w.rlike(r"(?s)^www\.[^.].*\."))
    )


def is_integer(w: Column) -> Column:
    return w.rlike("^[0-9]+$")


def is_chapter_number(w: Column) -> Column:
    return w.rlike(r"^[0-9]+(\.[0-9]+)*$")


def is_roman_numeral(w: Column) -> Column:
    return w.rlike("^[ivxIVX]+$")


def is_possible_list_item(w: Column) -> Column:
    return (F.length(w) == 1) | is_integer(w) | is_chapter_number(w) | is_roman_numeral(w)


def has_digit(w: Column) -> Column:
    return w.rlike("[0-9]")
