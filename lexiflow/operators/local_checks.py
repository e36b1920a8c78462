"""Look-ahead checks of a paragraph as JVM expressions over its token array.

No shuffle: neighbours are array elements. Each function gives an array of
(code, token_idx) of findings within a paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import DIGIT, PUNCT
from .tokens import paragraphs, token_array


def _where(tokens: Column, width: int, test) -> Column:
    """Indexes from 0 at which ``test`` holds for ``width`` tokens from there on."""
    last = F.size(tokens) - width
    ids = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(ids, lambda i: test(*(F.get(tokens, i + k) for k in range(width))))


def extra_whitespace(tokens: Column) -> Column:
    return _where(tokens, 1, lambda t: (t["token_type"] == "WHITESPACE") & (F.length(t["text"]) > 1))


def space_before_comma(tokens: Column) -> Column:
    return _where(tokens, 2, lambda a, b: (a["token_type"] == "WHITESPACE") & (F.length(a["text"]) == 1) & (b["text"] == ","))


def extra_comma(tokens: Column) -> Column:
    return _where(tokens, 2, lambda a, b: (a["text"] == ",") & (b["text"] == ","))


def repeated_word(tokens: Column) -> Column:
    def test(a, b, c):
        same = F.lower(a["text"]) == F.lower(c["text"])
        kinds = (a["token_type"] == "WORD") & (b["token_type"] == "WHITESPACE") & (c["token_type"] == "WORD")
        return kinds & same & ~a["text"].rlike(f"^[{DIGIT}]") & ~a["text"].isin("ollut", "olleet", "sillä")

    return _where(tokens, 3, test)


def unfinished(paragraph: Column) -> Column:
    """Whether a paragraph doesn't end in punctuation."""
    return ~paragraph.rlike(rf"[{PUNCT}]\z")


CHECKS = {2: extra_whitespace, 3: space_before_comma, 4: extra_comma, 8: repeated_word}


def local_findings(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows (kept columns, par_idx, error_code, token_idx) of all local checks."""
    keep = [c for c in (keep if keep is not None else df.columns) if c != text_col]
    rows = paragraphs(df, text_col, keep).withColumn("__t", token_array(F.col("paragraph")))
    t = F.col("__t")

    def coded(code: int, at: Column) -> Column:
        return F.transform(at, lambda i: F.struct(F.lit(code).alias("error_code"), i.alias("token_idx")))

    found = F.flatten(F.array(*(coded(code, check(t)) for code, check in CHECKS.items())))
    return rows.select(*keep, "par_idx", F.explode(found).alias("__e")).select(*keep, "par_idx", "__e.*")
