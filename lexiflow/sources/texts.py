"""Readers of plain text: words, lines and paragraphs, CoNLL-U, page text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chars import SPACE


def trimmed(c):
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def word_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(word): trimmed lines that aren't empty; a folder can be read as a stream."""
    lines = (spark.readStream if stream else spark.read).text(path)
    return lines.select(trimmed(F.col("value")).alias("word")).where("word <> ''")


def paragraphs_of_lines(texts: DataFrame, text_col: str = "text", blank_lines: bool = False) -> DataFrame:
    """One row per paragraph: a line each, or lines up to a blank one joined by a blank."""
    if not blank_lines:
        cut = F.split(F.col(text_col), "\n")
    else:
        cut = F.transform(F.split(F.col(text_col), rf"\n[{SPACE}]*\n"), lambda p: F.regexp_replace(p, "\n", " "))
    keep = [c for c in texts.columns if c != text_col]
    return texts.select(*keep, F.posexplode(cut).alias("par_idx", "paragraph")).where(trimmed(F.col("paragraph")) != "")


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """(id, form, lemma, feats map) of the token lines of a CoNLL-U file."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("value not like '#%' and length(value) > 0").select(f.alias("f")).where(F.size("f") >= 6)
    feats = F.when(F.col("f")[5] != "_", F.expr("str_to_map(f[5], '[|]', '=')"))
    return rows.select(F.col("f")[0].alias("id"), F.col("f")[1].alias("form"), F.col("f")[2].alias("lemma"), feats.alias("feats"))


def element_texts(spark: SparkSession, path: str, element: str = "text") -> DataFrame:
    """(text) of every such element of XML files, for instance of a wiki dump's pages."""
    rows = spark.read.format("xml").option("rowTag", element).option("valueTag", "_VALUE").schema("_VALUE string").load(path)
    return rows.select(F.col("_VALUE").alias("text")).where("text is not null")


def corpus_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word) of white-space pieces, cut to letters and hyphens at both ends (a
    dot after a letter stays), without pieces that have markup characters."""
    ends = r"^[^\p{L}\-]+(?=.)|(?<=.)(?:(?<![\p{L}]\.)[^\p{L}\-.]|(?<!\p{L})\.)+$"
    pieces = df.select(F.explode(F.split(F.col(text_col), r"\s+")).alias("word"))
    return pieces.select(F.regexp_replace("word", ends, "").alias("word")).where(r"word <> '' and not word rlike '[|\\[\\]/{}]' and word rlike '\\p{L}'")
