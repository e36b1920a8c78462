"""Tokens, sentences and paragraphs of a text column.

A token is what one pattern matches; it runs in the JVM over whole texts. Java
matches the connectors inside a word by recursion, so texts with an unbroken
run of over LONG_RUN characters take the same pattern in Python instead.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import DIGIT, DIGIT_RANGES, FAST_LETTER, HYPHEN, LETTER, LETTER_RANGES, PUNCT, PUNCTUATION, QUOTE, SPACE, SPACE_RANGES, within
from ..functions.python import arrow

LONG_RUN = 1000


def token_pattern(ignore_dot: bool = False) -> str:
    """One alternative per kind of token; together they cover any text.

    With ``ignore_dot`` a dot right after a word belongs to it.
    """
    ld, stop = LETTER + DIGIT, rf"(?!\.(?:\z|[{SPACE}]))"
    mail = ld + r"#$%*+=\^_`|~!&'\-/?{}"
    unknown = f"[^{ld}{SPACE}{PUNCT}]"
    url = rf"(?=[\s\S]{{12}})https?://(?:[{ld}=#%]|{stop}[{PUNCT}])*+"
    # the first dot after the @ must not end the address, nor may another @ follow it
    email = rf"(?=[\s\S]{{6}})(?=[{mail}.]*+@[{mail}]*+{stop}\.)[{mail}.]*+@(?:[{mail}]|{stop}\.)*+(?!@)"
    number = rf"(?:[{DIGIT}]++|\.(?=[{DIGIT}])|[{HYPHEN}](?=[{DIGIT}])|(?<=[{DIGIT}]),(?=[{DIGIT}]))"
    word = rf"(?:[{ld}]++|['\u2019:.](?=[{LETTER}])|[{HYPHEN}](?=[{ld}])|(?<=[{DIGIT}]),(?=[{DIGIT}]))"
    tail = rf"[{HYPHEN}](?=\z|[{QUOTE}{SPACE},]|{unknown})"
    if ignore_dot:
        tail = rf"(?:{tail}|\.)"
    core = f"(?:{number}++{word}*+(?:{tail})?+|{word}++(?:{tail})?+|{tail})"
    inside = f"(?:{url}|{email}|{core})"
    # most tokens: letters whose end shows at once that no address or connector follows, and single blanks
    end = "" if ignore_dot else "."
    plain = rf"[{FAST_LETTER}]++(?=[ \n]|\z|[,;!?:)\"{end}](?:[ \n]|\z))| (?=[{FAST_LETTER}])"
    return rf"{plain}|(?=[{ld}]){inside}|[\-\u2010\u2011]{inside}|[{SPACE}]++|\.\.\.|[\s\S]"


TOKEN = token_pattern()


def _python(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"\z", r"\Z"))


def _split_all(texts: pa.Array) -> pa.Array:
    find = _python(TOKEN).findall
    return pa.array([None if t is None else find(t) for t in texts.to_pylist()], pa.list_(pa.string()))


def split_tokens(text: Column, ignore_dot: bool = False) -> Column:
    """Array of the token strings of a text; their concatenation is the text."""
    if ignore_dot:
        return F.regexp_extract_all(text, F.lit(token_pattern(True)), F.lit(0))
    long_run = text.rlike(rf"\S{{{LONG_RUN}}}")
    python = arrow(_split_all, "array<string>")
    return F.coalesce(F.when(~long_run, F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))), python(F.when(long_run, text)))


def token_type(token: Column, code: Column | None = None) -> Column:
    """WORD, WHITESPACE, PUNCTUATION or UNKNOWN of a token string.

    ``code``: its first code point, if it is at hand as a column; conditions
    would otherwise read it from the string again and again.
    """
    code = F.ascii(token) if code is None else code
    hyphened = code.isin(0x2D, 0x2010, 0x2011) & (F.length(token) > 1)
    return (
        F.when(token.isNull(), None)
        .when(within(code, LETTER_RANGES) | within(code, DIGIT_RANGES) | hyphened, "WORD")
        .when(within(code, SPACE_RANGES), "WHITESPACE")
        .when(within(code, [(ord(x), ord(x)) for x in PUNCTUATION]), "PUNCTUATION")
        .otherwise("UNKNOWN")
    )


def _is_word(token: Column, code: Column) -> Column:
    plain = code.between(0x61, 0x7A) | code.between(0x41, 0x5A)
    return plain | (token_type(token, code) == "WORD")


def coded_tokens(text: Column) -> Column:
    """Array of (t, c): token strings and their first code points."""
    return F.transform(split_tokens(text), lambda t: F.struct(t.alias("t"), F.ascii(t).alias("c")))


def _starts(sizes: pa.Array) -> pa.Array:
    """Running sums inside each list, all lists in one pass."""
    flat = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = sizes.offsets.to_numpy() - sizes.offsets[0].as_py()
    upto = np.concatenate(([0], np.cumsum(flat)))
    start = upto[:-1] - np.repeat(upto[offsets[:-1]], np.diff(offsets))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(start, pa.int32()), mask=sizes.is_null() if sizes.null_count else None)


def running_starts(sizes: Column) -> Column:
    """Array of lengths to array of starts."""
    return arrow(_starts, "array<int>")(sizes)


def token_array(text: Column) -> Column:
    """Array of (token_type, text) without positions, JVM only."""
    return F.transform(coded_tokens(text), lambda x: F.struct(token_type(x["t"], x["c"]).alias("token_type"), x["t"].alias("text")))


def tokens(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, positions: bool = True) -> DataFrame:
    """One row per token: the kept columns, token_idx, token_type, text, token_len[, pos].

    Offsets count code points from 0. A null or empty text has no tokens. No
    shuffle: positions are running sums inside a row's own array.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c != text_col]
    cut = df.select(*keep, coded_tokens(F.col(text_col)).alias("__t"))
    if positions:
        cut = cut.withColumn("__p", running_starts(F.transform("__t", lambda x: F.length(x["t"]))))
        cut = cut.select(*keep, F.posexplode(F.arrays_zip(F.col("__t").alias("x"), F.col("__p").alias("p"))).alias("token_idx", "__x"))
        text, code, extra = F.col("__x.x.t"), F.col("__x.x.c"), [F.col("__x.p").alias("pos")]
    else:
        cut = cut.select(*keep, F.posexplode("__t").alias("token_idx", "__x"))
        text, code, extra = F.col("__x.t"), F.col("__x.c"), []
    return cut.select(*keep, "token_idx", token_type(text, code).alias("token_type"), text.alias("text"), F.length(text).alias("token_len"), *extra)


def type_counts(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows (kept columns, token_type, n, n_chars): a text's tokens of each type.

    Tokens are counted inside their array: at most four rows a text leave it, not one a token.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c != text_col]

    def typed(t: Column) -> Column:
        code = F.ascii(t)
        plain = F.when(code.between(0x61, 0x7A) | code.between(0x41, 0x5A), "WORD").when(code == 0x20, "WHITESPACE")
        return F.struct(plain.otherwise(token_type(t, code)).alias("k"), F.length(t).alias("n"))

    def counted(kind: str) -> Column:
        own = F.filter("__z", lambda x: x["k"] == kind)
        return F.struct(F.lit(kind).alias("token_type"), F.size(own).cast("bigint").alias("n"), F.aggregate(own, F.lit(0).cast("bigint"), lambda s, x: s + x["n"]).alias("n_chars"))

    cut = df.select(*keep, F.transform(split_tokens(F.col(text_col)), typed).alias("__z"))
    kinds = F.array(*map(counted, ("WORD", "WHITESPACE", "PUNCTUATION", "UNKNOWN")))
    return cut.select(*keep, F.inline(kinds)).where("n > 0")


def word_tokens(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows (kept columns, word) of the word tokens."""
    keep = [c for c in (keep if keep is not None else df.columns) if c != text_col]
    cut = df.select(*keep, F.explode(coded_tokens(F.col(text_col))).alias("__x")).where(_is_word(F.col("__x.t"), F.col("__x.c")))
    return cut.select(*keep, F.col("__x.t").alias("word"))


# ---- sentences ---------------------------------------------------------------

_KINDS: dict[str, str] = {}
_FIND: list = []


def _kind(c: str) -> str:
    """Type of a token by its first character, remembered."""
    kind = _KINDS.get(c)
    if kind is None:
        x = ord(c)
        hit = lambda ranges: any(a <= x <= z for a, z in ranges)
        kind = _KINDS[c] = "WORD" if hit(LETTER_RANGES) or hit(DIGIT_RANGES) else "WHITESPACE" if hit(SPACE_RANGES) else "PUNCTUATION" if c in PUNCTUATION else "UNKNOWN"
    return kind


def python_tokens(text: str) -> list[tuple[str, str]]:
    """(token_type, text) of every token, by the same pattern."""
    if not _FIND:
        _FIND.append(_python(TOKEN).findall)
    return [("WORD" if t[0] in "-\u2010\u2011" and len(t) > 1 else _kind(t[0]), t) for t in _FIND[0](text)]


#: Abbreviations with their dots, or a test of a word with its dot (a speller).
Known = frozenset[str] | Callable[[str], bool]


def _dotted(word: str, known: Known) -> bool:
    """Whether a dot after this word is part of it: initials, ordinals and
    dates, and words that a lexicon knows with their dot."""
    if len(word) == 1 and word != word.lower()[:1]:
        return True
    return all(c in ".-0123456789" for c in word) or (known(f"{word}.") if callable(known) else f"{word}." in known)


def python_sentences(text: str, known: Known = frozenset(), parts: list[tuple[str, str]] | None = None) -> list[tuple[str, int, int]]:
    """(type, start, length); the rest of a text is of type NONE.

    ``known``: abbreviations that keep their dot; ``parts``: the text's tokens, if at hand.
    """
    out: list[tuple[str, int, int]] = []
    begin = at = 0
    ended = quoted = soft = False
    before = ("", "")
    parts = python_tokens(text) if parts is None else parts
    for i, (kind, tok) in enumerate(parts):
        if ended and not quoted:
            if kind != "WHITESPACE":
                close = soft or before[0] != "WHITESPACE" and kind == "WORD"
                out.append(("POSSIBLE" if close else "PROBABLE", begin, at - begin))
                begin, ended, soft, quoted, before = at, False, False, False, ("", "")
                # a boundary token opens the next sentence and is looked at anew
                if kind == "PUNCTUATION":
                    ended, soft, quoted = _mark(tok, before, parts, i, ended, soft, quoted, at == begin, known)
        elif kind == "PUNCTUATION":
            ended, soft, quoted = _mark(tok, before, parts, i, ended, soft, quoted, at == begin, known)
        before = (kind, tok)
        at += len(tok)
    if at > begin:
        out.append(("NONE", begin, at - begin))
    return out


def _mark(tok, before, parts, i, ended, soft, quoted, first, known) -> tuple[bool, bool, bool]:
    """What a punctuation token does to (end found, end is soft, in quotation)."""
    if tok in ("!", "?"):
        return True, soft or quoted, quoted
    if tok in ("...", "\u2026", ":"):
        return True, True, quoted
    if tok == ".":
        return True, soft or not first and before[0] == "WORD" and _dotted(before[1], known), quoted
    if tok in ('"', "\u00BB", "\u201D", "\u201C"):
        if quoted and i + 1 < len(parts) and parts[i + 1][1].startswith(","):
            return False, False, False
        return ended, soft, not quoted
    return ended, soft, quoted


_SENTENCES = "array<struct<sentence_type:string,start:int,sentence_len:int>>"


def sentence_array(text: Column, abbreviations: frozenset[str] = frozenset(), speller: Callable[[], Callable[[str], bool]] | None = None) -> Column:
    """Array of (sentence_type, start, sentence_len); lengths sum to the text's.

    ``speller`` makes a worker's test of words: a dot belongs to a word that is
    right with it.
    """

    def run(texts: pa.Array) -> pa.Array:
        known = speller() if speller else abbreviations
        kind = pa.list_(pa.struct([("sentence_type", pa.string()), ("start", pa.int32()), ("sentence_len", pa.int32())]))
        return pa.array([None if t is None else [{"sentence_type": k, "start": s, "sentence_len": n} for k, s, n in python_sentences(t, known)] for t in texts.to_pylist()], kind)

    return arrow(run, _SENTENCES)(text)


def sentences(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, abbreviations: frozenset[str] = frozenset(), speller=None) -> DataFrame:
    """One row per sentence: kept columns, sentence_idx, sentence_type, start, sentence_len, sentence.

    PROBABLE and POSSIBLE say how sure the boundary behind a sentence is; the
    text's rest is NONE. Trailing white space belongs to a sentence.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c != text_col]
    rows = df.select(*keep, text_col, F.posexplode(sentence_array(F.col(text_col), abbreviations, speller)).alias("sentence_idx", "__s"))
    return rows.select(*keep, "sentence_idx", "__s.*", F.substring(F.col(text_col), F.col("__s.start") + 1, F.col("__s.sentence_len")).alias("sentence"))


def paragraphs(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per non-empty line: kept columns, par_idx, start, paragraph.

    A carriage return before the line feed isn't part of the paragraph; starts
    are offsets into the whole text.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c != text_col]
    rows = df.select(*keep, F.split(F.col(text_col), "\n").alias("__l"))
    rows = rows.withColumn("__p", running_starts(F.transform("__l", lambda x: F.length(x) + 1)))
    rows = rows.select(*keep, F.posexplode(F.arrays_zip(F.col("__l").alias("l"), F.col("__p").alias("p"))).alias("par_idx", "__x"))
    line = F.regexp_replace(F.col("__x.l"), "\r$", "")
    return rows.select(*keep, "par_idx", F.col("__x.p").alias("start"), line.alias("paragraph")).where("paragraph <> ''")
