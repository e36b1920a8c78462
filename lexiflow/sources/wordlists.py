"""Readers of word databases, replacement lists and inflection tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inflect import word_pattern


def word_database(spark: SparkSession, path: str) -> DataFrame:
    """(id, forms, classes, inflections) of the ``<word>`` elements of an XML file."""
    shape = (
        "_id string, forms struct<form:array<string>>, classes struct<wclass:array<string>>,"
        " inflection struct<infclass:array<struct<_VALUE:string,_type:string>>>"
    )
    rows = spark.read.format("xml").option("rowTag", "word").option("valueTag", "_VALUE").schema(shape).load(path)
    return rows.select(F.col("_id").alias("id"), F.col("forms.form").alias("forms"), F.col("classes.wclass").alias("classes"), F.col("inflection.infclass").alias("inflections"))


def replacements(spark: SparkSession, path: str) -> DataFrame:
    """(incorrect, correct) of ``<replacement>`` elements; ``=`` marks are dropped."""
    rows = spark.read.format("xml").option("rowTag", "replacement").schema("incorrect string, correct string").load(path)
    return rows.select(*(F.replace(c, F.lit("="), F.lit("")).alias(c) for c in ("incorrect", "correct")))


_CHARACTERISTIC = frozenset(
    "nominatiivi genetiivi partitiivi illatiivi nominatiivi_mon genetiivi_mon partitiivi_mon illatiivi_mon infinitiivi_1 preesens_yks_1"
    " imperfekti_yks_3 kondit_yks_3 imperatiivi_yks_3 partisiippi_2 imperfekti_pass".split()
)


def _expanded(strip: str, affix: str) -> list[tuple[str, str, str]]:
    """(strip, affix, condition) for each letter of a class such as ``([ou])``, repeated as ``(1)``."""
    strip, affix = ("" if x == "0" else x for x in (strip, affix))
    m = re.fullmatch(r"(\w*)\(?\[(\w+)\]\)?(\w*)", strip)
    if not m:
        return [(strip, affix, strip)]
    return [(s := m[1] + c + m[3], affix.replace("(1)", c), s) for c in m[2]]


def parse_inflections(text: str) -> list[tuple]:
    """Rows of an affix table: blocks of headers and rules, ``end: class`` closing each."""
    rows, head, inside = [], {}, False
    for line in (x.split("#")[0].strip() for x in text.splitlines()):
        if not line:
            continue
        name, _, value = line.partition(":")
        if not inside and _:
            if name.strip() == "rules":
                inside = True
            elif name.strip() == "end":
                head = {}
            else:
                head[name.strip()] = value.strip()
        elif inside and line.startswith("end:"):
            inside = False
        elif inside:
            f = line.split()
            options = dict((o.split("=") + ["1"])[:2] for o in f[4].split(",")) if len(f) > 4 else {}
            if options.get("ps") == "r":
                continue
            form = f[0].removeprefix("!")
            for cls in head.get("sm-class", "").split():
                for strip, affix, condition in _expanded(f[1], f[2]):
                    rows.append(
                        (
                            cls, word_pattern(head.get("match-word", "")), head.get("rmsfx", ""), head.get("consonant-gradation", "-"), form,
                            f[3], strip, affix, condition, f[0] != form or form in _CHARACTERISTIC, int(options.get("prio", 1)),
                        )
                    )
    return rows


RULES = (
    "rule_class string, pattern string, rmsfx string, gradation string, form string, grade string, strip string, affix string, condition string,"
    " characteristic boolean, priority int"
)


def inflection_rules(spark: SparkSession, text: str) -> DataFrame:
    """Inflection rules of an affix table's text as a relation."""
    return spark.createDataFrame(parse_inflections(text), RULES)
