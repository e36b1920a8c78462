"""Candidates are made only of words within reach of the lexicon, and are never broadcast."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from lexiflow import queries
from lexiflow.operators import lexicon

SF = "/root/testdata/sf0.001"
BACK = {
    "insertion": (lexicon.insertions, lexicon.insertion_sources),
    "replacement": (lambda w: lexicon.replacements(w, queries._PAIRS), lambda x: lexicon.replacement_sources(x, queries._PAIRS)),
    "two_replacements": (lambda w: lexicon.two_replacements(w, queries._FEW), lambda x: lexicon.two_replacement_sources(x, queries._FEW)),
    "swap": (lexicon.swaps, lexicon.swap_sources),
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", list(BACK))
def test_only_words_within_reach(spark, monkeypatch, name):
    seen, known = [], lexicon.known_candidates
    monkeypatch.setattr(lexicon, "known_candidates", lambda made, lex: seen.append((made, lex)) or known(made, lex))
    got = queries.QUERIES[f"suggest_{name}"](spark, SF)
    (made, lex), plan = seen[0], got._jdf.queryExecution().executedPlan().toString()
    words = {r[0] for r in made.select("word").distinct().collect()}
    assert words and words == {r[0] for r in made.join(lex.select("surface"), F.lower("candidate") == F.col("surface")).select("word").distinct().collect()}
    assert "Broadcast" not in plan


@pytest.mark.parametrize("name", list(BACK))
def test_no_word_is_lost(spark, name):
    make, sources = BACK[name]
    r = random.Random(7)
    texts = {"".join(r.choice("aeiotsnrdšäöuy.,ß") for _ in range(r.choice((1, 2, 3, 3, 4, 4, 5, 9, 12)))) for _ in range(3000)}
    made = sorted(texts)
    # half of the lexicon is made of the words themselves, so that long ones are near to it too
    some = make(spark.createDataFrame([(w,) for w in made], "word string")).where("xxhash64(candidate) % 50 = 0").select("candidate")
    surfaces = sorted({x[0] for x in some.collect()} | set(made[::2]))
    lex = spark.createDataFrame([(x, 1) for x in surfaces], "surface string, freq long")
    words = spark.createDataFrame([(w,) for w in made], "word string")
    full = lexicon.known_candidates(make(words), lex).collect()
    few = lexicon.known_candidates(make(lexicon.within_reach(words, sources(lex))), lex).collect()
    assert len(full) > 100 and max(len(x.word) for x in full) > 8
    assert sorted(map(tuple, few)) == sorted(map(tuple, full))
