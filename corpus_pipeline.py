"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run`
writes every stage's rows as Parquet and gives them to the next one.

All stages but the last return the columns of their input, of any name, and in
each of them an empty table gives no rows, nulls in columns beside the text and
the id change nothing, and texts of any length are read whole. A null text has
no letters and goes in the first stage; where a later one is given such texts,
they count as empty. Repeated rows are copies of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiflow.llm import bpe, decontam, exact_dedup, langid, similar
from lexiflow.llm.shared import delete, prepare, table, temporary, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go; no predicted language or score rejects any other."""
    prepare(spark)
    return langid.keep_identified(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays."""
    prepare(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the row with the smallest doc_id stays.

    Links: five-word shingles with a similarity of 0.8 or more, verified.
    """
    prepare(spark)
    return similar.drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a window of a benchmark item occurs in go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document left."""
    prepare(spark)
    return bpe.encode_decode(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe_tokens),
]

#: The language model, fingerprints and BPE can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, one after the other.

    A stage's rows are deleted when the next one's are written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with temporary(spark) as keep:
            docs, path = written(stage(spark, docs, sf_dir), f"stage{i + 1}")
            keep(path)
        if before:
            delete(spark, before)
        before = path
    return docs
