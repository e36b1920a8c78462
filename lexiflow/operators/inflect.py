"""Inflected forms, consonant gradation and vowel harmony, all in the JVM.

Inflection is an equi-join of words with rules on their class: a rule takes a
strong or weak stem, strips a suffix and adds an ending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_C = "qwrtpsdfghjklzxcvbnm"
# fixed values: stems that end in a vowel and a consonant have the weak grade; its strong one
_CLOSED = [("ng", "nk"), ("mm", "mp"), ("nn", "nt"), ("ll", "lt"), ("rr", "rt"), ("d", "t"), ("t", "tt"), ("k", "kk"), ("p", "pp"), ("v", "p")]
# fixed values: class, pattern of the stem's end, its other grade ($1, $2 as matched)
_TO_WEAK = {
    "av1": [
        ("tt(.)", "t$1"), ("kk(.)", "k$1"), ("pp(.)", "p$1"), ("mp(.)", "mm$1"), (f"p([^{_C}])", "v$1"), ("nt(.)", "nn$1"), ("lt(.)", "ll$1"),
        ("rt(.)", "rr$1"), ("t(.)", "d$1"), ("nk(.)", "ng$1"), ("uku", "uvu"), ("yky", "yvy"),
    ],
    "av3": [(f"([{_C}])k(.)", "$1j$2"), (".k(.)", "j$1")],
    "av5": [("k(.)", r"\$$1")],
}
_TO_STRONG = {
    "av2": [
        ("ng(.)", "nk$1"), ("mm(.)", "mp$1"), ("nn(.)", "nt$1"), ("ll(.)", "lt$1"), ("rr(.)", "rt$1"), ("d(.)", "t$1"), ("([tkpbg])(.)", "$1$1$2"),
        ("v(.)", "p$1"),
    ],
    "av4": [("j(.)", "k$1"), ("j(..)", "k$1")],
    "av6": [(f"(.[{_C}])", "k$1"), (f"([^{_C}])", "k$1")],
}
_SHORTEST = {"av1": 3, "av2": 2, "av3": 3, "av4": 3, "av5": 2, "av6": 1}


def gradation(word: Column, grade: Column) -> Column:
    """struct(strong, weak) of a stem in class '-' or av1 to av6; null if the class doesn't fit it."""
    both = lambda s, w: F.struct(s.alias("strong"), w.alias("weak"))
    out = F.when(grade == "-", both(word, word))
    closed = (F.length(word) >= 3) & word.rlike(f"(?i)[^{_C}][{_C}]$")
    for weak, strong in _CLOSED:
        end = f"{weak}([^{_C}][{_C}])$"
        out = out.when(closed & word.rlike(end), both(F.regexp_replace(word, end, f"{strong}$1"), word))
    for table, to_weak in ((_TO_WEAK, True), (_TO_STRONG, False)):
        for name, rules in table.items():
            for pattern, other in rules:
                made = F.regexp_replace(word, f"{pattern}$", other)
                fits = (grade == name) & (F.length(word) >= _SHORTEST[name]) & word.rlike(f"{pattern}$")
                out = out.when(fits, both(word, made) if to_weak else both(made, word))
    return out


# fixed values: letters of the gradation classes by the end of a word
_LETTER_CLOSED = [("ng", "G"), ("mm", "H"), ("nn", "J"), ("ll", "I"), ("rr", "K"), ("d", "F"), ("t", "C"), ("k", "A"), ("p", "B"), ("v", "E")]
_LETTERS = {
    "av1": [
        ("tt.", "C"), ("kk.", "A"), ("pp.", "B"), ("mp.", "H"), (f"p[^{_C}]", "E"), ("nt.", "J"), ("lt.", "I"), ("rt.", "K"), ("t.", "F"), ("nk.", "G"),
        ("uku", "M"), ("yky", "M"),
    ],
    "av2": [
        ("ng..", "G"), ("mm..", "H"), ("nn..", "J"), ("ll..", "I"), ("rr..", "K"), ("d..", "F"), ("t..", "C"), ("k..", "A"), ("p..", "B"), ("b..", "O"),
        ("g..", "P"), ("v..", "E"),
    ],
    "av3": [("k.", "L")],
    "av4": [("j.", "L"), ("j..", "L")],
    "av5": [("k.", "D")],
}


def gradation_letter(word: Column, grade: Column) -> Column:
    """Letter of the gradation pattern; empty where none fits."""
    known = grade.isin("av1", "av2", "av3", "av4", "av5", "av6") & (F.length(word) > 0)
    out = F.when(~known, "")
    for end, letter in _LETTER_CLOSED:
        out = out.when(word.rlike(f"{end}[^{_C}][{_C}]$"), letter)
    for name, rules in _LETTERS.items():
        for end, letter in rules:
            out = out.when((grade == name) & word.rlike(f"{end}$"), letter)
    return out.when(grade == "av6", "D").otherwise("")


def _last(word: Column, letters: str) -> Column:
    """Place of the last of some letters, -1 if none."""
    return F.when(word.rlike(f"[{letters}]"), F.length(F.regexp_extract(word, f"(?s)^(.*)[{letters}]", 1))).otherwise(-1)


def _simple_vowels(word: Column) -> Column:
    w = F.lower(word)
    back, front, y = _last(w, "aoåu"), _last(w, "äö"), _last(w, "y")
    return (
        F.when((back > -1) & (F.greatest(front, y) == -1), "BACK")
        .when(back == -1, "FRONT")
        .when(y < F.greatest(back, front), F.when(back > front, "BACK").otherwise("FRONT"))
        .otherwise("BOTH")
    )


def vowel_type(word: Column) -> Column:
    """FRONT, BACK or BOTH endings. What follows the last ``=`` or ``-`` counts;
    with a ``|`` the part behind it and the whole must agree."""
    tail = F.regexp_extract(word, r"(?s)([^=\-]*)$", 1)
    behind = F.regexp_extract(tail, r"(?s)\|(.*)$", 1)
    inner = F.regexp_replace(behind, r"(?s)^.*\|", "")
    whole, part = _simple_vowels(tail), _simple_vowels(inner)
    return (
        F.when(word.isNull(), None)
        .when(word.rlike(r"[=\-|]$"), "BOTH")
        .when(~tail.contains("|"), whole)
        .when(whole == part, whole)
        .otherwise("BOTH")
    )


def to_front(text: Column) -> Column:
    return F.translate(text, "aou", "äöy")


def conditional_apostrophe(word: Column) -> Column:
    """A ``$`` between equal vowels becomes an apostrophe (a and ä only if doubled before), else nothing."""
    return F.when(~word.contains("$"), word).when(word.rlike(r".([iouyö])\$\1") | word.rlike(r"([iouyö])\$\1") | word.rlike(r"([aä])\1\$\1"), F.replace(word, F.lit("$"), F.lit("'"))).otherwise(
        F.replace(word, F.lit("$"), F.lit(""))
    )


# fixed values: what capitals stand for in a rule's word pattern
_CAPITALS = {"V": "(?:a|e|i|o|u|y|ä|ö|é|è|á|ó|â)", "C": "(?:b|c|d|f|g|h|j|k|l|m|n|p|q|r|s|t|v|w|x|z|š|ž)", "A": "(?:a|ä)", "O": "(?:o|ö)", "U": "(?:u|y)"}


def word_pattern(pattern: str) -> str:
    for capital, body in _CAPITALS.items():
        pattern = pattern.replace(capital, body)
    return f"(?i)^.*{pattern}$"


def inflect(words: DataFrame, rules: DataFrame) -> DataFrame:
    """All forms of rows (word, infclass): (word, infclass, form, inflected, characteristic, priority).

    ``infclass`` may end in ``-av1`` to ``-av6``. ``rules`` comes from
    :func:`lexiflow.sources.wordlists.inflection_rules`. A word of both vowel
    types gets both endings.
    """
    w = words.select("word", "infclass", F.regexp_extract("infclass", "^([^-]*)", 1).alias("__class"), F.expr("coalesce(nullif(regexp_extract(infclass, '-(.*)$', 1), ''), '-')").alias("__av"))
    kind = F.when(F.col("__av") == "-", "-").when(F.col("__av").isin("av1", "av3", "av5"), "sw").when(F.col("__av").isin("av2", "av4", "av6"), "ws")
    # both once per word, before the rules multiply the rows
    w = w.withColumn("__kind", kind).withColumn("__v", vowel_type(F.col("word"))).withColumn("__w", gradation(F.col("word"), F.col("__av")))
    fits = (w["__class"] == rules["rule_class"]) & ((w["__kind"] == "-") | (w["__kind"] == rules["gradation"]))
    j = w.join(rules, fits).where(F.rlike(F.col("word"), F.col("pattern")))
    stem = F.when(F.col("rmsfx") == "", F.col("word")).otherwise(F.expr("substring(word, 1, length(word) - length(rmsfx))"))
    j = j.withColumn("__g", F.when(F.col("rmsfx") == "", F.col("__w")).otherwise(gradation(stem, F.col("__av")))).where("__g is not null")
    base = F.when(F.col("grade") == "s", F.col("__g.strong")).otherwise(F.col("__g.weak"))
    j = j.withColumn("__b", base).withColumn("__s", F.expr("replace(replace(substring(__b, 1, length(__b) - length(strip)), '=', ''), '|', '')"))
    back = F.when(F.col("__v").isin("BACK", "BOTH") & F.expr("endswith(__b, condition)"), conditional_apostrophe(F.concat("__s", "affix")))
    front = F.when(F.col("__v").isin("FRONT", "BOTH") & F.expr("endswith(__b, translate(condition, 'aou', 'äöy'))"), conditional_apostrophe(F.concat("__s", to_front(F.col("affix")))))
    made = j.select("word", "infclass", "form", F.explode(F.array_compact(F.array_distinct(F.array(back, front)))).alias("inflected"), "characteristic", "priority")
    return made
