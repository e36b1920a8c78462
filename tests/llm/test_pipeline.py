"""The pipeline's stages against brute force on the smallest table."""

from __future__ import annotations

import os
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def low(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_stages(spark):
    from tests.llm.test_operators import WORD, plain_similar

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = {i: t for i, t in left.items() if t and any(map(str.isalpha, t))}
    best: dict[str, int] = {}
    for i, t in left.items():
        best[low(t)] = max(best.get(low(t), -1), i)
    left = {i: t for i, t in left.items() if best[low(t)] == i}
    roots = plain_similar(left)
    left = {i: t for i, t in left.items() if roots[i] == i}
    windows = set()
    for t in items:
        w = WORD.findall(low(t or ""))
        windows |= {" ".join(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()

    def hit(t):
        w = f" {' '.join(WORD.findall(low(t)))} "
        return any(f" {x} " in w for x in windows)

    left = {i: t for i, t in left.items() if not hit(t)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(left)
    assert all(r["exact"] for r in got)
    assert len(left) < docs.count()


def test_stages_stand_nulls_repeats_and_clashing_names(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from it all"
    rows = [(1, text, None), (1, text, "x"), (None, text.upper(), None), (2, None, None), (3, "", "y"), (4, "1 2 3", "z"), (5, "x" * 3_000_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `__uid` string").selectExpr("*", "'found' AS `__found`", "'de' AS lang")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF)
        assert left.columns == docs.columns, name
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 5]


def test_stages_keep_columns_and_stand_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0
