"""Word operators over a column: distinct words, one Arrow function, join back.

A word of a language occurs again and again, so the costly part runs once per
distinct word; the results are joined back by the word. Adaptive execution
broadcasts the distinct side when it is small and splits hot words otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.python import arrow
from ..sources.vfst import Transducer, corrections, probability
from .spelling import Analyzer, HyphenOptions, Speller, SpellOptions, hyphen_pattern, suggest, suggest_as_written, up

AnalyzerMaker = Callable[[], Analyzer]


def no_analyzer() -> Analyzer:
    """For texts without a lexicon: no word is known."""
    return lambda word: []


def per_distinct(df: DataFrame, word_col: str, into: str, column: Callable[[Column], Column]) -> DataFrame:
    """``df`` with a column computed once per distinct word."""
    words = df.select(F.col(word_col).alias("__w")).where("__w is not null").distinct()
    # few bytes may be much work: the words are dealt evenly, not packed by size
    words = words.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    made = words.select("__w", column(F.col("__w")).alias(into))
    return df.join(made, df[word_col] == made["__w"], "left").drop("__w")


def hyphenated(word: Column, analyzer: AnalyzerMaker = no_analyzer, options: HyphenOptions | None = None, union: bool = False) -> Column:
    """Hyphenation pattern of a word column, as long as the word."""

    def run(words: pa.Array) -> pa.Array:
        analyze = analyzer()
        return pa.array([None if w is None else hyphen_pattern(w, analyze, options, union) for w in words.to_pylist()], pa.string())

    return arrow(run, "string")(word)


def insert_hyphens(word: Column, pattern: Column, separator: str = "-", allow_context_changes: bool = True) -> Column:
    """The word with a separator at its breaks, in the JVM."""
    sep = F.lit(separator)

    def one(c: Column, m: Column) -> Column:
        taken = (m == "=") & (c != "-") if allow_context_changes else F.lit(False)
        return F.when(m == "-", F.concat(sep, c)).when(taken, sep).otherwise(c)

    return F.array_join(F.zip_with(F.split(word, ""), F.split(pattern, ""), one), "")


def syllables(pattern: Column) -> Column:
    """Syllables of a hyphenation pattern."""
    return F.length(F.replace(pattern, F.lit(" "), F.lit(""))) + 1


def spelled_right(word: Column, analyzer: AnalyzerMaker, options: SpellOptions | None = None) -> Column:
    def run(words: pa.Array) -> pa.Array:
        speller = Speller(analyzer(), options or SpellOptions())
        return pa.array([None if w is None else speller.accepts(w) for w in words.to_pylist()], pa.bool_())

    return arrow(run, "boolean")(word)


def suggestions(word: Column, analyzer: AnalyzerMaker, most: int = 5, ocr: bool = False, options: SpellOptions | None = None, as_written: bool = False) -> Column:
    """Ranked corrections of a word; ``as_written`` restores its case and dot."""

    def run(words: pa.Array) -> pa.Array:
        speller = Speller(analyzer(), options or SpellOptions())
        find = suggest_as_written if as_written else suggest
        return pa.array([None if w is None else find(w, speller, most, ocr) for w in words.to_pylist()], pa.list_(pa.string()))

    return arrow(run, "array<string>")(word)


def analyses(word: Column, analyzer: AnalyzerMaker) -> Column:
    """Array of attribute maps of a word, in the analyzer's order."""

    def run(words: pa.Array) -> pa.Array:
        analyze = analyzer()
        return pa.array([None if w is None else [list(a.items()) for a in analyze(w)] if len(w) <= 255 else [] for w in words.to_pylist()], pa.list_(pa.map_(pa.string(), pa.string())))

    return arrow(run, "array<map<string,string>>")(word)


def corrected(word: Column, errors: bytes, lexicon: bytes, most: int = 5) -> Column:
    """Corrections by a weighted error model and lexicon, best first."""

    def run(words: pa.Array) -> pa.Array:
        made = [_transducer(errors), _transducer(lexicon)]
        return pa.array([None if w is None else [x for x, _ in corrections(w, *made, most)] for w in words.to_pylist()], pa.list_(pa.string()))

    return arrow(run, "array<string>")(word)


def weighted_corrections(word: Column, errors: bytes, lexicon: bytes, most: int = 5) -> Column:
    """As :func:`corrected`, with every correction's probability."""
    row = pa.struct([("word", pa.string()), ("probability", pa.float64())])

    def run(words: pa.Array) -> pa.Array:
        made = [_transducer(errors), _transducer(lexicon)]
        return pa.array([None if w is None else [{"word": x, "probability": probability(n)} for x, n in corrections(w, *made, most)] for w in words.to_pylist()], pa.list_(row))

    return arrow(run, "array<struct<word:string,probability:double>>")(word)


def accepted(word: Column, lexicon: bytes) -> Column:
    """Verdict by a lexicon that accepts words as written: 0 right, 1 with a capital, 3 not."""

    def run(words: pa.Array) -> pa.Array:
        t = _transducer(lexicon)
        return pa.array([None if w is None else 0 if t.accepts(w) else 1 if w and t.accepts(up(w[0]) + w[1:]) else 3 for w in words.to_pylist()], pa.int32())

    return arrow(run, "int")(word)


_WORKER: dict[bytes, Transducer] = {}


def _transducer(data: bytes) -> Transducer:
    """One per worker."""
    if data not in _WORKER:
        _WORKER[data] = Transducer(data)
    return _WORKER[data]
