"""Aggregations: readability, base forms, word lists, differences of runs."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.python import arrow
from ..plans.storage import written
from .tokens import python_sentences, python_tokens
from .words import AnalyzerMaker, analyses, hyphenated, per_distinct, syllables

# fixed value: syllables of the base form from which a word is long
LONG_BASE = 4


def _profiles(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts.to_pylist():
        parts = python_tokens(t or "")
        words = Counter(w for k, w in parts if k == "WORD")
        out.append(
            {
                "sentences": sum(k != "POSSIBLE" for k, *_ in python_sentences(t or "", parts=parts)),
                "punctuation": sum(k == "PUNCTUATION" for k, _ in parts),
                "words": [{"word": w, "n": n} for w, n in words.items()],
            }
        )
    word = pa.struct([("word", pa.string()), ("n", pa.int64())])
    return pa.array(out, pa.struct([("sentences", pa.int64()), ("punctuation", pa.int64()), ("words", pa.list_(word))]))


def text_profile(text: Column) -> Column:
    """Sentences (of sure or final boundaries), punctuation tokens, and words with
    their counts, from one pass over a text; a null text has none."""
    return arrow(_profiles, "struct<sentences:bigint,punctuation:bigint,words:array<struct<word:string,n:bigint>>>")(text)


def scores(sentences: Column, words: Column, syllable_count: Column, known: Column, long_known: Column) -> list[Column]:
    """Flesch reading ease, Flesch-Kincaid grade and Wiio index; 0 without words or sentences."""
    s, w, y = (c.cast("double") for c in (sentences, words, syllable_count))
    some = (sentences > 0) & (known > 0)
    return [
        F.when(some, F.lit(206.823) - 1.015 * w / s - 84.6 * y / w).otherwise(0.0).alias("reading_ease"),
        F.when(some, 0.39 * w / s + 11.8 * y / w - 15.59).otherwise(0.0).alias("grade_level"),
        F.when(some, F.lit(2.7) + 30.0 * long_known / known).otherwise(0.0).alias("wiio_index"),
    ]


def readability(df: DataFrame, keys: list[str], text_col: str = "text", analyzer: AnalyzerMaker | None = None) -> DataFrame:
    """One row per group of ``keys``: n_sentences, n_words, n_syllables,
    n_letters (characters of words), n_characters (with punctuation), n_known,
    n_long (words whose base form has LONG_BASE syllables) and the three scores.

    Words are hyphenated once per distinct word. Without an analyzer every word
    counts as known, and as its own base form.
    """
    # one pass over the texts; its rows are used for sentences, for words and for distinct words
    rows, _ = written(df.select(*keys, text_profile(F.col(text_col)).alias("__t")), "profiles")
    texts = rows.groupBy(*keys).agg(F.sum("__t.sentences").alias("n_sentences"), F.sum("__t.punctuation").alias("__q"))
    words = rows.select(*keys, F.explode("__t.words").alias("__w")).groupBy(*keys, F.col("__w.word").alias("word")).agg(F.sum("__w.n").alias("n"))
    distinct = rows.select(F.explode("__t.words.word").alias("word")).distinct()
    if analyzer is None:
        known = per_distinct(distinct, "word", "__p", hyphenated).select("word", syllables(F.col("__p")).alias("__s"), syllables(F.col("__p")).alias("__b"))
    else:
        has = F.filter(F.col("__a"), lambda a: F.element_at(a, "BASEFORM").isNotNull())
        made = per_distinct(distinct, "word", "__p", lambda w: F.struct(hyphenated(w, analyzer).alias("p"), analyses(w, analyzer).alias("a")))
        made = made.select("word", F.col("__p.p").alias("__p"), F.col("__p.a").alias("__a")).select("word", "__p", F.element_at(F.get(has, 0), "BASEFORM").alias("__base"))
        made = per_distinct(made, "__base", "__r", lambda w: hyphenated(w, analyzer))
        known = made.select("word", syllables(F.col("__p")).alias("__s"), syllables(F.col("__r")).alias("__b"))
    agg = words.join(known, "word").groupBy(*keys).agg(
        F.sum("n").alias("n_words"),
        F.sum(F.col("__s") * F.col("n")).alias("n_syllables"),
        F.sum(F.length("word") * F.col("n")).alias("n_letters"),
        F.sum(F.when(F.col("__b").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.when(F.col("__b") >= LONG_BASE, F.col("n")).otherwise(0)).alias("n_long"),
    )
    counts = ["n_words", "n_syllables", "n_letters", "n_known", "n_long"]
    out = texts.join(agg, keys, "left").na.fill(0, counts)
    out = out.select(*keys, "n_sentences", *counts[:3], (F.col("n_letters") + F.col("__q")).alias("n_characters"), *counts[3:])
    return out.select("*", *scores(F.col("n_sentences"), F.col("n_words"), F.col("n_syllables"), F.col("n_known"), F.col("n_long")))


def prefer_common_nouns(word: Column, readings: Column) -> Column:
    """For a word in lower case, readings with a capital first letter go if others remain."""
    common = F.filter(readings, lambda a: ~a["STRUCTURE"].startswith("=i"))
    small = F.substring(word, 1, 1) == F.lower(F.substring(word, 1, 1))
    return F.when(small & (F.size(common) > 0), common).otherwise(readings)


def base_form_frequencies(readings: DataFrame) -> DataFrame:
    """(baseform, freq) from rows (word, n, baseforms): every reading of a word
    gets an equal share of its n; words without readings are under null."""
    share = F.col("n") / F.size("baseforms")
    known = readings.where(F.size("baseforms") > 0).select(F.explode("baseforms").alias("baseform"), share.alias("f"))
    unknown = readings.where(F.coalesce(F.size("baseforms"), F.lit(0)) <= 0).select(F.lit(None).cast("string").alias("baseform"), F.col("n").cast("double").alias("f"))
    return known.unionByName(unknown).groupBy("baseform").agg(F.sum("f").alias("freq"))


def base_form_syllables(words: DataFrame, keys: list[str], base_col: str = "baseform") -> DataFrame:
    """Histogram (keys, n_syllables, freq) of base forms; 0 for unknown words."""
    made = per_distinct(words, base_col, "__p", lambda w: hyphenated(w))
    n = F.when(F.col(base_col).isNull(), 0).otherwise(syllables(F.col("__p")))
    return made.groupBy(*keys, n.alias("n_syllables")).agg(F.count("*").alias("freq"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two runs has, as often as it has them more; ``side`` says which."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def lexicon_differences(a: DataFrame, b: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Keys of two lexicons that are missing or differ in a value: (key, status)."""
    left = a.groupBy(key).agg(*(F.array_sort(F.collect_set(v)).alias(f"{v}__a") for v in values), F.lit(1).alias("__in_a"))
    right = b.groupBy(key).agg(*(F.array_sort(F.collect_set(v)).alias(f"{v}__b") for v in values), F.lit(1).alias("__in_b"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"{v}__a").eqNullSafe(F.col(f"{v}__b"))
    status = F.when(F.col("__in_b").isNull(), "only first").when(F.col("__in_a").isNull(), "only second").when(~same, "differs")
    return left.join(right, key, "full").select(key, status.alias("status")).where("status is not null")
