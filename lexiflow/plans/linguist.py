"""One object for all operators on words and texts, and their SQL names.

Options are fixed when it is made; a changed option is another object
(:meth:`Linguist.having`). Methods on strings run here, those on DataFrames
build plans.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.python import arrow, prepare
from ..operators import grammar, reports, spelling, tokens, words
from ..operators.grammar import GrammarOptions
from ..operators.morphology import VALUES
from ..operators.spelling import HyphenOptions, Speller, SpellOptions
from ..sources import dictionaries

VERSION = "0.1"


@dataclass(frozen=True)
class Linguist:
    """``analyzer`` makes a worker's analyzer; without one no word is known."""

    analyzer: words.AnalyzerMaker = words.no_analyzer
    spelling: SpellOptions = field(default_factory=SpellOptions)
    hyphens: HyphenOptions = field(default_factory=HyphenOptions)
    grammar: GrammarOptions = field(default_factory=GrammarOptions)
    replacements: tuple[tuple[str, str], ...] = ()
    most_suggestions: int = 5
    ocr: bool = False

    def having(self, **options) -> Linguist:
        """With other options; those of spelling, hyphens and grammar by their own names.

        ``ignore_dot`` holds for spelling and hyphenation alike.
        """
        own = {f: {} for f in ("spelling", "hyphens", "grammar")}
        rest = {}
        for k, v in options.items():
            homes = [f for f in own if k in getattr(self, f).__dataclass_fields__]
            for f in homes:
                own[f][k] = v
            if not homes:
                rest[k] = v
        return replace(self, **{f: replace(getattr(self, f), **kv) for f, kv in own.items() if kv}, **rest)

    # on strings

    def spell(self, word: str) -> bool:
        return Speller(self.analyzer(), self.spelling).accepts(word)

    def suggest(self, word: str) -> list[str]:
        return spelling.suggest(word, Speller(self.analyzer(), self.spelling), self.most_suggestions, self.ocr)

    def analyze(self, word: str) -> list[dict[str, str]]:
        return self.analyzer()(word) if len(word) <= spelling.LONGEST_WORD else []

    def hyphenate(self, word: str) -> str:
        return spelling.hyphen_pattern(word, self.analyzer(), self.hyphens)

    def insert_hyphens(self, word: str, separator: str = "-", allow_context_changes: bool = True) -> str:
        return spelling.insert_hyphens(word, self.hyphenate(word), separator, allow_context_changes)

    def grammar_errors(self, text: str) -> list[grammar.Error]:
        """Findings of all paragraphs, placed in the whole text."""
        out, at = [], 0
        for line in text.split("\n"):
            own = line.removesuffix("\r")
            out += [(c, at + s, n, w) for c, s, n, w in grammar.paragraph_errors(own, self.analyzer(), self.grammar, dict(self.replacements))] if own else []
            at += len(line) + 1
        return out

    def tokens(self, text: str) -> list[tuple[str, str]]:
        return tokens.python_tokens(text)

    def sentences(self, text: str) -> list[tuple[str, str]]:
        return [(k, text[a : a + n]) for k, a, n in tokens.python_sentences(text)]

    @staticmethod
    def languages(spark: SparkSession, paths: list[str], needs: str | None = None) -> list[str]:
        """Languages of the dictionaries in a search path."""
        return dictionaries.languages(spark, paths, needs)

    @staticmethod
    def attribute_values(name: str) -> list[str] | None:
        return VALUES.get(name)

    # on columns of distinct words or texts

    def spell_column(self, word: Column) -> Column:
        return words.spelled_right(word, self.analyzer, self.spelling)

    def suggest_column(self, word: Column) -> Column:
        return words.suggestions(word, self.analyzer, self.most_suggestions, self.ocr, self.spelling)

    def analyze_column(self, word: Column) -> Column:
        return words.analyses(word, self.analyzer)

    def hyphenate_column(self, word: Column) -> Column:
        return words.hyphenated(word, self.analyzer, self.hyphens)

    # on DataFrames

    def check_words(self, df: DataFrame, word_col: str = "word") -> DataFrame:
        """With ``ok`` and, for wrong words, ``suggestions``; once per distinct word."""
        out = words.per_distinct(df, word_col, "ok", self.spell_column)
        wrong = F.when(~F.col("__ok"), F.col(word_col))
        made = out.select(F.col(word_col), F.col("ok").alias("__ok")).distinct().where("not __ok").select(F.col(word_col).alias("__w"), self.suggest_column(wrong).alias("suggestions"))
        return out.join(made, out[word_col] == made["__w"], "left").drop("__w")

    def check_grammar(self, df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
        return grammar.grammar_errors(df, text_col, keep, self.analyzer, self.grammar, dict(self.replacements))

    def readability(self, df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
        return reports.readability(df, keys, text_col, None if self.analyzer is words.no_analyzer else self.analyzer)

    def register(self, spark: SparkSession, prefix: str = "lx_") -> list[str]:
        """SQL functions: spell, suggest, analyze, hyphenate, tokens, sentences, grammar."""
        prepare(spark)
        me = self

        def per(kind: str, each):
            def run(values: pa.Array) -> pa.Array:
                f = each()
                return pa.array([None if v is None else f(v) for v in values.to_pylist()], _ARROW[kind])

            return arrow(run, kind)

        made = {
            "spell": per("boolean", lambda: me.spell),
            "suggest": per("array<string>", lambda: me.suggest),
            "hyphenate": per("string", lambda: me.hyphenate),
            "analyze": per("array<map<string,string>>", lambda: lambda w: [list(a.items()) for a in me.analyze(w)]),
            "tokens": per("array<string>", lambda: lambda t: [x for _, x in me.tokens(t)]),
            "sentences": per("array<string>", lambda: lambda t: [x for _, x in me.sentences(t)]),
            "grammar": per("array<int>", lambda: lambda t: [e[0] for e in me.grammar_errors(t)]),
        }
        for name, f in made.items():
            spark.udf.register(prefix + name, f)
        return [prefix + n for n in made]


_ARROW = {
    "boolean": pa.bool_(),
    "string": pa.string(),
    "array<string>": pa.list_(pa.string()),
    "array<int>": pa.list_(pa.int32()),
    "array<map<string,string>>": pa.list_(pa.map_(pa.string(), pa.string())),
}
