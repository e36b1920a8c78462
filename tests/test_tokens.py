"""Tokens against a plain state machine, sentences, paragraphs."""

from __future__ import annotations

import random

import pytest
import regex
from pyspark.sql import functions as F

from lexiflow.functions import chars as C
from lexiflow.operators import tokens as T

KINDS = [(k, regex.compile(f"[{b}]")) for k, b in (("L", C.LETTER), ("W", C.SPACE), ("P", C.PUNCT), ("D", C.DIGIT))]


def kind(c: str) -> str:
    return next((k for k, p in KINDS if p.match(c)), "U")


def address(s: str) -> int:
    """Length of an e-mail address at the start, else 0."""
    at = dot = False
    end = len(s)
    for i, c in enumerate(s):
        k = kind(c)
        final = c == "." and (i + 1 == len(s) or kind(s[i + 1]) == "W")
        if c == "@":
            if at:
                return 0
            at = True
        elif k == "W" or k == "U" and c not in "#$%*+=^_`|~" or k == "P" and c not in "!&'-/?{}." or c == "." and at and final:
            end = i
            break
        elif c == "." and at:
            dot = True
    return end if len(s) >= 6 and at and dot else 0


def word(s: str) -> int:
    for p in ("https://", "http://"):
        if len(s) >= 12 and s.startswith(p):
            for i in range(len(p), len(s)):
                k = kind(s[i])
                if k == "W" or k == "U" and s[i] not in "=#%" or s[i] == "." and (i + 1 == len(s) or kind(s[i + 1]) == "W"):
                    return i
            return len(s)
    if n := address(s):
        return n
    n, number, letters = 0, False, False
    while n < len(s):
        c, k = s[n], kind(s[n])
        after = kind(s[n + 1]) if n + 1 < len(s) else ""
        if k in "LD":
            number, letters = k == "D", letters or k == "L"
        elif c in "'’:":
            if after != "L":
                return n
        elif c in "-­‐‑":
            if after not in ("L", "D"):
                return n + (after in ("", "W", "U") or s[n + 1] in '",»”')
        elif c == ".":
            if not (after == "L" or after == "D" and not letters):
                return n
        elif not (c == "," and number and after == "D"):
            return n
        n += 1
    return n


def machine(s: str) -> list[str]:
    out = []
    while s:
        k = kind(s[0])
        if k in "LD":
            n = word(s)
        elif k == "W":
            n = next((i for i, c in enumerate(s) if kind(c) != "W"), len(s))
        elif s[0] in "-‐‑":
            n = 1 + (word(s[1:]) if len(s) > 1 else 0)
        else:
            n = 3 if s.startswith("...") else 1
        out.append(s[:n])
        s = s[n:]
    return out


def test_tokens_equal_a_state_machine(spark):
    rng = random.Random(5)
    pieces = [*"ab9A.,-':@\"! \n?#/=%…”»’‐À😀ä", "http://", "https://", "www.", "...", "­", "a.b@c.d", "ab", "1,2", "x" * 13]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(18))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = dict(df.select("i", T.split_tokens(F.col("text"))).collect())
    for i, t in enumerate(texts):
        assert got[i] == machine(t), t
        assert [x for _, x in T.python_tokens(t)] == got[i]


def test_long_connected_words_use_the_python_pattern(spark):
    texts = ["1," * 4000 + "2", "a-" * 3000 + " b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = dict(df.select("i", T.split_tokens(F.col("text"))).collect())
    assert len(got[0]) == 1 and "".join(got[1]) == texts[1]


def test_positions_types_and_nulls(spark):
    df = spark.createDataFrame([(1, "Hei, 😀 maailma"), (2, None), (3, "")], "id int, text string")
    rows = [tuple(r) for r in T.tokens(df).orderBy("id", "token_idx").collect()]
    assert rows == [
        (1, 0, "WORD", "Hei", 3, 0),
        (1, 1, "PUNCTUATION", ",", 1, 3),
        (1, 2, "WHITESPACE", " ", 1, 4),
        (1, 3, "UNKNOWN", "😀", 1, 5),
        (1, 4, "WHITESPACE", " ", 1, 6),
        (1, 5, "WORD", "maailma", 7, 7),
    ]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Sataa vettä. Tuulee.", [("PROBABLE", 13), ("NONE", 7)]),
        ("K. Niemi tuli.", [("POSSIBLE", 3), ("NONE", 11)]),
        ("Kello on 3. Lähdetään!", [("POSSIBLE", 12), ("NONE", 10)]),
        ("Niin... ehkä", [("POSSIBLE", 8), ("NONE", 4)]),
        ('"Tule!" Hän meni.', [("POSSIBLE", 8), ("NONE", 9)]),
        ('Hän sanoi "ei.", ja meni.', [("NONE", 25)]),
        ("", []),
    ],
)
def test_sentences(text, expected):
    got = T.python_sentences(text)
    assert [(k, n) for k, _, n in got] == expected
    assert sum(n for *_, n in got) == len(text)


def test_abbreviations_of_a_lexicon_make_a_boundary_only_possible():
    assert T.python_sentences("Ks. sivu.", frozenset({"Ks."}))[0][0] == "POSSIBLE"
    assert T.python_sentences("Ks. sivu.")[0][0] == "PROBABLE"


def test_paragraphs_keep_offsets(spark):
    df = spark.createDataFrame([("x\r\n\nyz\nw",)], "text string")
    assert [tuple(r) for r in T.paragraphs(df).collect()] == [(0, 0, "x"), (2, 4, "yz"), (3, 7, "w")]
