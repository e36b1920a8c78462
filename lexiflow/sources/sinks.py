"""Lines of text from results, for the text writer."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.python import prepare


def spell_lines(df: DataFrame, word: str = "word", ok: str = "ok", suggestions: str | None = None) -> DataFrame:
    """``C: word`` or ``W: word``, the latter followed by ``S: suggestion`` lines."""
    first = F.concat(F.when(F.col(ok), "C: ").otherwise("W: "), F.col(word))
    if suggestions is None:
        return df.select(first.alias("value"))
    more = F.when(~F.col(ok), F.transform(F.col(suggestions), lambda s: F.concat(F.lit("S: "), s))).otherwise(F.array().cast("array<string>"))
    return df.select(F.explode(F.concat(F.array(first), F.coalesce(more, F.array().cast("array<string>")))).alias("value"))


def analysis_lines(word: Column, analyses: Column) -> Column:
    """A block per word: its analyses numbered, attributes in order of their names."""
    block = F.transform(analyses, lambda a: F.array_join(F.transform(F.array_sort(F.map_entries(a)), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), e["value"])), "\n"))
    return F.concat_ws("\n", word, F.array_join(block, "\n\n"))


def escaped(text: Column) -> Column:
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def token_lines(tokens: DataFrame) -> DataFrame:
    """``TYPE [start..end] "text"`` of token rows."""
    return tokens.select(F.format_string('%s [%d..%d] "%s"', "token_type", "pos", F.col("pos") + F.col("token_len"), escaped(F.col("text"))).alias("value"))


def grammar_lines(text: Column, start: Column, length: Column, suggestions: Column, description: Column) -> Column:
    """A finding with the piece of text it is about and what could stand there."""
    piece = F.substring(text, start + 1, length)
    return F.concat(F.lit("["), piece, F.lit("] "), description, F.when(F.size(suggestions) > 0, F.concat(F.lit(" -> "), F.array_join(suggestions, " / "))).otherwise(""))


def write_xml(elements: DataFrame, path: str, root: str = "root") -> None:
    """A string column of elements as XML files, one root element a file."""

    def whole(batches):
        yield pa.RecordBatch.from_arrays([pa.array([f"<{root}>"])], names=["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([f"</{root}>"])], names=["value"])

    prepare(elements.sparkSession)
    elements.mapInArrow(whole, "value string").write.text(path)
