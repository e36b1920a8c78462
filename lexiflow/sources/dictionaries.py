"""Dictionaries in a search path: folders with an index of their properties."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.morphology import automaton_analyzer
from ..operators.spelling import Analyzer
from .vfst import Transducer, read_transducer

AnalyzerMaker = Callable[[], Analyzer]
#: Format versions that can be read, newest first.
VERSIONS = ("5",)
LEXICON, AUTOCORRECTION, ERRORS = "mor.vfst", "autocorr.vfst", "err.vfst"


#: The environment variable with a folder of dictionaries, and the folder below one.
VARIABLE, FOLDER = "LEXIFLOW_DICTIONARIES", f"{VERSIONS[0]}/mor-standard"


def search_path(explicit: str | None = None, environment: Mapping[str, str] | None = None, system: Sequence[str] = ("/etc", "/usr/lib", "/usr/share")) -> list[str]:
    """Folders that may hold a dictionary, best first: the one given, that of the
    environment variable and its standard folder, the home folder's, the
    system's, and the current one."""
    env = os.environ if environment is None else environment
    out = [explicit] if explicit else []
    if own := env.get(VARIABLE):
        out += [own, f"{own}/{FOLDER}"]
    if home := env.get("HOME"):
        out.append(f"{home}/.lexiflow/{FOLDER}")
    return [*out, *(f"{s}/lexiflow/{FOLDER}" for s in system), os.getcwd()]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, paths: Sequence[str]) -> tuple[AnalyzerMaker, bytes | None]:
    """The analyzer of the first folder with a lexicon, and its automaton of wrong
    phrases (for the grammar check's ``table``) if it has one."""
    for p in paths:
        if _exists(spark, f"{p}/{LEXICON}"):
            phrases = read_transducer(spark, f"{p}/{AUTOCORRECTION}") if _exists(spark, f"{p}/{AUTOCORRECTION}") else None
            return automaton_analyzer(read_transducer(spark, f"{p}/{LEXICON}")), phrases
    raise FileNotFoundError(f"no {LEXICON} in any of {', '.join(paths)}")


def languages(spark: SparkSession, paths: list[str], needs: str | None = None) -> list[str]:
    """Languages of the dictionaries found; with ``needs`` (spelling, hyphenation
    or grammar) those whose backend can do it."""
    rows = catalog(spark, paths).where("rank = 1")
    if needs:
        able = {"spelling": ["finnishVfst", "vfst"], "hyphenation": ["finnishVfst"], "grammar": ["finnishVfst"]}[needs]
        rows = rows.where(F.col("backend").isin(*able))
    return sorted(r["language"] for r in rows.select("language").distinct().collect())


def catalog(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, language, script, variant, description, backend, properties) of the
    dictionaries found, in search order; of equal languages and variants the
    first counts (``rank`` 1).

    A dictionary is a folder with ``index.txt`` (lines ``key: value``) below
    ``<path>/<version>/<folder>``.
    """
    found = None
    for i, p in enumerate(paths):
        for v in VERSIONS:
            try:
                one = spark.read.text(f"{p}/{v}/*/index.txt", wholetext=True).select(F.lit(i).alias("place"), F.regexp_replace("_metadata.file_path", "/index.txt$", "").alias("path"), "value")
            except Exception as e:  # a search path may not exist
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                continue
            found = one if found is None else found.union(one)
    if found is None:
        found = spark.createDataFrame([], "place int, path string, value string")
    pairs = F.filter(F.split("value", "\r?\n"), lambda x: x.contains(":") & ~x.startswith("#"))
    props = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, "^[^:]*:", "")))))
    rows = found.withColumn("properties", props)
    get = lambda k: F.element_at("properties", k)
    rows = rows.select(
        "place", "path",
        F.coalesce(get("Language-Code"), F.lit("fi")).alias("language"),
        F.coalesce(get("Language-Script"), F.lit("")).alias("script"),
        F.coalesce(get("Language-Variant"), F.lit("standard")).alias("variant"),
        F.coalesce(get("Description"), F.lit("")).alias("description"),
        F.coalesce(get("Morphology-Backend"), F.lit("null")).alias("backend"),
        "properties",
    )
    # a handful of folders: one partition is enough
    from pyspark.sql import Window

    order = Window.partitionBy("language", "script", "variant").orderBy("place", "path")
    return rows.withColumn("rank", F.row_number().over(order)).drop("place")


@dataclass(frozen=True)
class LanguageTag:
    """A tag such as ``fi``, ``fi-Latn`` or ``fi-x-medicine``."""

    language: str
    script: str = ""
    variant: str = ""

    @staticmethod
    def parse(tag: str) -> LanguageTag:
        head, _, private = tag.partition("-x-")
        parts = head.replace("_", "-").split("-")
        script = next((p.title() for p in parts[1:] if len(p) == 4 and p.isalpha()), "")
        return LanguageTag(parts[0].lower(), script, private.replace("-", ""))


def find(spark: SparkSession, paths: list[str], tag: str) -> dict | None:
    """The dictionary for a language tag: the variant asked for, else the standard one."""
    want = LanguageTag.parse(tag)
    own = catalog(spark, paths).where((F.col("rank") == 1) & (F.col("language") == want.language))
    if want.script:
        own = own.where(F.col("script").isin(want.script, ""))
    own = own.where(F.lower("variant") == want.variant.lower()) if want.variant else own.orderBy((F.col("variant") != "standard").cast("int"), "variant")
    rows = own.limit(1).collect()
    return rows[0].asDict() if rows else None


def analyzer_of(spark: SparkSession, entry: dict):
    """Maker of the analyzer that a dictionary's backend names."""
    backend = entry["backend"]
    if backend == "null":
        return lambda: lambda word: []
    data = read_transducer(spark, f"{entry['path']}/{LEXICON}")
    if backend == "finnishVfst":
        return automaton_analyzer(data)
    if backend == "vfst":
        return lambda: _plain(Transducer(data))
    raise ValueError(f"backend {backend} isn't available")


def _plain(t: Transducer) -> Analyzer:
    return lambda word: [{"STRUCTURE": "=" + "p" * len(word)} | a for a in t.analyses(word)]
