"""Characters, spelling, hyphenation, suggestions, grammar, morphology, inflection."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from lexiflow.functions import chars as C
from lexiflow.operators import features, grammar, inflect, lexicon, local_checks, morphology, reports, spelling, words
from lexiflow.sources import sinks, texts, vfst, wordlists


def noun(n: int, case: str = "nimento", first: str = "p") -> dict:
    return {"STRUCTURE": "=" + first + "p" * (n - 1), "CLASS": "nimisana", "SIJAMUOTO": case}


LEXICON = {
    "talo": [noun(4)],
    "auto": [noun(4)],
    "oslo": [{"STRUCTURE": "=ippp", "CLASS": "paikannimi", "SIJAMUOTO": "nimento"}],
    "autotalo": [{"STRUCTURE": "=pppp=pppp", "CLASS": "nimisana", "SIJAMUOTO": "nimento"}],
    "syysilta": [{"STRUCTURE": "=ppp=ppppp"}, {"STRUCTURE": "=pppppppp"}],
    "popopisto": [{"STRUCTURE": "=ppp=pppppp"}],
    "mainen": [{"STRUCTURE": "=pppppp", "MALAGA_VAPAA_JALKIOSA": "true"}],
    "-talo-": [{"STRUCTURE": "-pppp-"}],
}


def speller(**o) -> spelling.Speller:
    return spelling.Speller(morphology.table_analyzer(LEXICON)(), spelling.SpellOptions(**o))


@pytest.mark.parametrize(
    ("word", "options", "ok"),
    [
        ("", {}, True),
        ("talo", {}, True),
        ("Talo", {}, True),
        ("Talo", {"accept_first_uppercase": False}, False),
        ("TALO", {}, True),
        ("TALO", {"accept_all_uppercase": False}, False),
        ("tAlo", {}, False),
        ("oslo", {}, False),
        ("Oslo", {}, True),
        ("ollo", {}, False),
        ("ta1lo", {"ignore_numbers": True}, True),
        ("XYZ", {"ignore_uppercase": True}, True),
        ("http://a.bc", {}, True),
        ("http://a.bc", {"ignore_nonwords": False}, False),
        ("talo.", {}, False),
        ("talo.", {"ignore_dot": True}, True),
        ("x" * 256, {}, False),
        ("auto­talo", {}, True),
        ("aut­otalo", {}, False),
        ("­talo", {}, False),
        ("auto-talo", {}, False),
        ("auto-talo", {"accept_extra_hyphens": True}, True),
        ("pop-opisto", {}, True),
        ("talo-mainen", {}, True),
        ("syy-silta", {}, True),
    ],
)
def test_spelling(word, options, ok):
    assert speller(**options).accepts(word) is ok


@pytest.mark.parametrize(
    ("word", "shown"),
    [
        ("ajatella", "a-ja-tel-la"),
        ("kesäaika", "ke-säai-ka"),
        ("maa", "maa"),
        ("aie", "aie"),
        ("vaa'an", "vaa-an"),
        ("kaksi-osa", "kak-si-o-sa"),
        ("tšekki", "tšek-ki"),
        ("x", "x"),
        ("", ""),
    ],
)
def test_hyphenation_of_unknown_words(word, shown):
    p = spelling.hyphen_pattern(word, lambda w: [])
    assert len(p) == len(word)
    assert spelling.insert_hyphens(word, p) == shown


def test_hyphenation_options_and_compounds():
    analyze = morphology.table_analyzer(LEXICON)()
    assert spelling.hyphen_pattern("autotalo", analyze) == "  - - - "
    assert spelling.hyphen_pattern("ilo", lambda w: [], spelling.HyphenOptions(ugly=False)) == "   "
    assert spelling.hyphen_pattern("ajatella", lambda w: [], spelling.HyphenOptions(hyphenate_unknown=False)) == " " * 8


def test_native_hyphen_insertion_equals_python(spark):
    rows = [("vaa'an", "   =  "), ("a-b", " = "), ("talo", "  - ")]
    df = spark.createDataFrame(rows, "w string, p string")
    got = [r[0] for r in df.select(words.insert_hyphens(F.col("w"), F.col("p"))).collect()]
    assert got == [spelling.insert_hyphens(w, p) for w, p in rows]


@pytest.mark.parametrize(
    ("word", "best"),
    [("tallo", "talo"), ("tlao", "talo"), ("tal", "talo"), ("osla", "Oslo"), ("qqqq", None), ("taloauto", "talo auto"), ("oslo", "Oslo"), ("taalo", "talo"), ("talo", "talo")],
)
def test_suggestions(word, best):
    got = spelling.suggest(word, speller())
    assert (got[0] if got else None) == best


def test_suggested_words_are_of_all_documents_by_the_whole_lexicon(spark, tmp_path):
    """Rare lexicon words (three times) are right and are suggested; unknown words of documents are corrected."""
    from lexiflow.queries import LEAST, suggested_words

    # 2,100 words that are all commoner than the rare one
    common = ["".join(x) for x in itertools.product("bcdfghjklmnp", "aeiou", "bcdfghjk", "aeiou")][:2100]
    text = " ".join(common * 201 + ["harvinainen"] * LEAST + ["harvinaine", "Qqqqq"])
    spark.createDataFrame([(1, "fi", "s", text)], "doc_id bigint, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "toinen")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["word"]: (r["ok"], r["suggestions"]) for r in suggested_words(spark, str(tmp_path)).collect()}
    assert set(got) == {*common, "harvinainen", "harvinaine", "qqqqq"}
    rows = {w: [noun(len(w))] for w in [*common, "harvinainen"]}
    plain = spelling.Speller(morphology.table_analyzer(rows)(), spelling.SpellOptions())
    assert got["harvinainen"][0] and got["harvinaine"] == (False, "harvinainen") and not got["qqqqq"][0]
    for w in [*common[::50], *common[-10:], "harvinainen", "harvinaine", "qqqqq"]:
        assert got[w] == (plain.accepts(w), ",".join(spelling.suggest(w, plain))), w


def test_suggestions_follow_the_case_as_written():
    assert spelling.suggest_as_written("TALLO", speller())[0] == "TALO"
    assert spelling.suggest_as_written("t", speller()) == []


def test_replacement_tables_are_pairs():
    for flat in [*spelling.REPLACEMENTS.values(), spelling.OCR]:
        assert len(flat) % 2 == 0


def test_native_candidates_equal_the_generators(spark):
    given = ["talo", "aitta", "ää", "x", "papapa", "koira-aita", "yötä", "aaab", "kaappii", "oo'oo"]
    w = spark.createDataFrame([(x,) for x in given], "word string")
    for native, plain in (
        (lexicon.deletions, spelling.deleted),
        (lexicon.swaps, spelling.swapped),
        (lexicon.insertions, lambda x: spelling.inserted(x, "aitesn")),
        (lambda d: lexicon.replacements(d, spelling.table(spelling.REPLACEMENTS[2])), lambda x: spelling.replaced(x, spelling.table(spelling.REPLACEMENTS[2]))),
        (lexicon.vowel_changes, spelling.vowel_changes),
        (lexicon.repeat_deletions, spelling.repeats_deleted),
        (lambda d: lexicon.hyphen_insertions(d).union(lexicon.doublings(d)), spelling.hyphen_inserted),
        (lambda d: lexicon.double_replacements(d, spelling.table(spelling.REPLACEMENTS[1])), lambda x: spelling.doubles_replaced(x, spelling.table(spelling.REPLACEMENTS[1]))),
        (lambda d: lexicon.two_replacements(d, spelling.table(spelling.REPLACEMENTS[1])), lambda x: spelling.replaced_twice(x, spelling.table(spelling.REPLACEMENTS[1]))),
    ):
        got: dict[str, list] = {}
        for r in native(w).orderBy("word", "seq").collect():
            got.setdefault(r["word"], []).append(r["candidate"])
        for x in given:
            assert sorted(set(got.get(x, []))) == sorted(set(plain(x))), (native, x)


def test_native_spell_equals_the_speller(spark):
    plain = {k: v for k, v in LEXICON.items() if "-" not in k}
    lex = spark.createDataFrame([(k, a["STRUCTURE"]) for k, v in plain.items() for a in v], "surface string, structure string")
    given = ["talo", "Talo", "TALO", "tAlo", "oslo", "Oslo", "OSLO", "ollo", "http://a.bc", "talo.", "", None, "123"]
    df = spark.createDataFrame([(x,) for x in given], "word string")
    for o in (spelling.SpellOptions(), spelling.SpellOptions(ignore_dot=True, accept_all_uppercase=False, accept_first_uppercase=False)):
        got = {r["word"]: r["ok"] for r in lexicon.spell(df, lex, options=o).collect()}
        own = spelling.Speller(lambda w: plain.get(spelling.lowered(w), []), o)
        assert got == {x: None if x is None else own.accepts(x) for x in given}


def test_unknown_and_anagrams(spark):
    lex = spark.createDataFrame([("talo",)], "surface string")
    df = spark.createDataFrame([("Talo",), ("lato",)], "word string")
    assert [r["word"] for r in lexicon.unknown_words(df, lex).collect()] == ["lato"]
    w = spark.createDataFrame([("talo",), ("lato",), ("auto",)], "word string")
    assert [tuple(r) for r in lexicon.anagrams(w).collect()] == [("alot", 2, "lato", "talo")]


def test_characters_and_cases(spark):
    given = ["a", "À", "Á", "×", " ", " ", "!", "»", "7", "@", "ß"]
    df = spark.createDataFrame([(x,) for x in given], "c string")
    c = F.col("c")
    got = [r[0] for r in df.select(C.char_type(c)).collect()]
    assert got == ["LETTER", "UNKNOWN", "LETTER", "UNKNOWN", "WHITESPACE", "WHITESPACE", "PUNCTUATION", "PUNCTUATION", "DIGIT", "UNKNOWN", "LETTER"]
    assert df.where("c = 'ß'").select(C.simple_upper(c)).first()[0] == "S"
    w = ["talo", "Talo", "TALO", "tAlo", "123", "A", "", "A1", "1a", "Å-b"]
    df = spark.createDataFrame([(x,) for x in w], "w string")
    assert [r[0] for r in df.select(C.detect_case(F.col("w"))).collect()] == [spelling.case_of(x) if x else "NO_LETTERS" for x in w]


def test_normalization(spark):
    given = ["äiti", "oﬁ", "ﬁ́", "koira’n", "20℃", "é"]
    df = spark.createDataFrame([(x,) for x in given], "w string")
    assert [r[0] for r in df.select(C.normalize(F.col("w"))).collect()] == [spelling.normalized(x) for x in given]
    assert spelling.normalized("äiti") == "äiti"
    assert len(C.compositions()) == 67


def test_nonwords(spark):
    given = ["http://a.b", "a//b.", "//x.y", "a@b.c", "@a.b", "www.a", "WWW.a.b", "www.a.bc", "www..ab", "ab", "a/b//c.d", "x@.ab", "a//."]
    df = spark.createDataFrame([(x,) for x in given], "w string")
    got = df.select(C.is_nonword(F.col("w")), C.is_nonword_strict(F.col("w"))).collect()
    assert [tuple(r) for r in got] == [(spelling.nonword(x), spelling.nonword_strict(x)) for x in given]


@pytest.mark.parametrize(
    ("text", "errors"),
    [
        ("Talo , joka on.", [(3, 4, 2)]),
        ("Talo  on.", [(2, 4, 2)]),
        ("Talo,, joka on.", [(4, 4, 2)]),
        ("Se on on talo.", [(8, 3, 5)]),
        ("talo on.", [(7, 0, 4)]),
        ("Talo on", [(9, 5, 2)]),
        ("Talo) on.", [(12, 4, 1)]),
        ('Sanoi: "Ei.", ja meni.', [(10, 10, 3)]),
        ("Se on “talo” tai muu.", [(11, 6, 1)]),
        ("Yksi [1] kaksi.", []),
        ("Oulu. ; talo.", [(5, 5, 2)]),
        ("", []),
    ],
)
def test_grammar_without_a_lexicon(text, errors):
    assert [e[:3] for e in grammar.paragraph_errors(text)] == errors


VERBS = {
    "en": [{"STRUCTURE": "=pp", "CLASS": "kieltosana"}],
    "tulen": [{"STRUCTURE": "=ppppp", "CLASS": "teonsana", "MOOD": "indicative", "NEGATIVE": "false", "PERSON": "1"}],
    "alkaa": [{"STRUCTURE": "=ppppp", "CLASS": "teonsana", "MOOD": "indicative", "NEGATIVE": "both", "REQUIRE_FOLLOWING_VERB": "A-infinitive"}],
    "syömään": [{"STRUCTURE": "=ppppppp", "CLASS": "teonsana", "MOOD": "MA-infinitive"}],
    "ja": [{"STRUCTURE": "=pp", "CLASS": "sidesana"}],
    "talo": [noun(4)],
    "auto": [noun(4)],
}


@pytest.mark.parametrize(
    ("text", "code"),
    [("Minä en tulen.", 13), ("Hän alkaa syömään.", 14), ("Talo ja.", 16), ("Talo auto.", 17), ("Tulen alkaa.", 18), ("Minä Talo tulen.", 6)],
)
def test_grammar_with_a_lexicon(text, code):
    found = grammar.paragraph_errors(text, lambda w: VERBS.get(spelling.lowered(w), []))
    assert code in [e[0] for e in found]


def test_autocorrection_and_options():
    found = grammar.paragraph_errors("Alas päin mennään.", table={"alas päin": "alaspäin"})
    assert found == [(1, 0, 9, ["Alaspäin"])]
    free = grammar.GrammarOptions(accept_unfinished_paragraphs=True)
    assert grammar.paragraph_errors("Talo on", options=free) == []


def test_grammar_rows_and_native_checks_agree(spark):
    df = spark.createDataFrame([(1, "Talo  on on , x.\nauto,, y"), (2, None), (3, "")], "id int, text string")
    got = {(r["par_idx"], r["error_code"]) for r in grammar.grammar_errors(df).collect()}
    native = {(r["par_idx"], r["error_code"]) for r in local_checks.local_findings(df).collect()}
    assert native == {(0, 2), (0, 8), (0, 3), (1, 4)}
    assert native <= got
    assert grammar.descriptions(spark).count() == 18


ATT = "0\t1\tk\tk\t1\n1\t2\ta\ta\t0.5\n2\t3\tt\tt\t1\n1\t4\to\to\t1\n4\t3\tt\tt\t1\n3\t0.5\n"


@pytest.mark.parametrize("weighted", [False, True])
def test_automaton_round_trip(weighted):
    t = vfst.Transducer(vfst.compile_att(ATT, weighted))
    assert [o for o, _, _ in t.lookup("kat")] == ["kat"]
    assert not t.accepts("ka") and not t.accepts("") and not t.accepts("katt")
    assert [n for _, _, n in t.lookup("kott", prefixes=True)] == [3]
    if weighted:
        assert t.analyses("KAT")[0]["WEIGHT"].startswith("0.2")


def test_automaton_flags_and_wide_states():
    flags = "0\t1\t@P.F.a@\t@0@\n0\t1\t@P.F.b@\t@0@\n1\t2\tx\tx\n2\t3\t@R.F.a@\t@0@\n3\n"
    assert len(list(vfst.Transducer(vfst.compile_att(flags)).lookup("x"))) == 1
    wide = "".join(f"0\t1\t{chr(0x4E00 + i)}\t{chr(0x4E00 + i)}\n" for i in range(300)) + "1\n"
    for weighted in (False, True):
        t = vfst.Transducer(vfst.compile_att(wide, weighted))
        assert t.accepts(chr(0x4E00)) and t.accepts(chr(0x4E00 + 299)) and not t.accepts("a")


def test_error_model_composition():
    lexicon_ = vfst.Transducer(vfst.compile_att(ATT, True))
    errors = vfst.Transducer(vfst.compile_att("0\t0\tk\tk\t1\n0\t0\tt\tt\t1\n0\t0\te\ta\t0.9\n0\t0\te\to\t0.5\n0\n", True))
    assert [w for w, _ in vfst.corrections("ket", errors, lexicon_)] == ["kot", "kat"]


def test_composition_goes_back_where_no_word_begins_so():
    """The same corrections as of all outputs, at a small part of the transitions."""
    letters = "abcdefghij"
    errors = vfst.compile_att("".join(f"0\t0\t{a}\t{b}\t{1 if a == b else 0.5}\n" for a in letters for b in letters) + "0\n", True)
    words_ = ["abcdef", "abcdeg", "jihgfe"]
    lines = "".join(f"{0 if j == 0 else 100 * i + j}\t{100 * i + j + 1}\t{c}\t{c}\t1\n" for i, w in enumerate(words_) for j, c in enumerate(w))
    known = vfst.compile_att(lines + "".join(f"{100 * i + 6}\n" for i in range(3)), True)
    one, lexicon_ = vfst.Transducer(errors), vfst.Transducer(known)
    got = vfst.corrections("abcdef", one, lexicon_)
    assert sorted(w for w, _ in got) == sorted(words_) and got[0] == ("abcdef", 0)
    assert one.taken < 400  # all outputs are a million
    assert lexicon_.first_not_reached("abcxef") == 3 and lexicon_.first_not_reached("abcdeg") == 6 and lexicon_.first_not_reached("x") == 0
    fan = vfst.Transducer(vfst.compile_att("".join(f"0\t1\t{chr(97 + i)}\tx\n" for i in range(26)) + "1\n"))
    assert fan.accepts("z") and fan.taken < 4  # arcs of other characters aren't walked


def test_sentences_ask_a_speller(spark):
    from lexiflow.operators import tokens

    text = "Se on esim. talo. Toinen."
    kinds = [k for k, *_ in tokens.python_sentences(text, lambda w: w == "esim.")]
    assert kinds == ["POSSIBLE", "PROBABLE", "NONE"] and [k for k, *_ in tokens.python_sentences(text)] == ["PROBABLE", "PROBABLE", "NONE"]
    df = spark.createDataFrame([(text,)], "text string")
    got = tokens.sentences(df, speller=lambda: lambda w: w == "esim.").collect()
    assert [r["sentence_type"] for r in got] == kinds


def test_wrong_phrases_from_an_automaton(spark):
    def phrase(i, a, b):
        at = [0, *range(1000 * i, 1000 * i + len(a) - 1), 1]
        shown = lambda c: {" ": "@_SPACE_@", "": "@0@"}.get(c, c)
        return "".join(f"{x}\t{y}\t{shown(c)}\t{shown(b[j : j + 1])}\n" for j, (x, y, c) in enumerate(zip(at, at[1:], a, strict=False)))

    data = vfst.compile_att(phrase(1, "joten kuten", "jotenkuten") + phrase(2, "joten kuten ei", "jotenkuten") + "1\n")
    table = {"joten kuten": "jotenkuten", "joten kuten ei": "jotenkuten"}
    for text in ("Se on joten kuten hyvä.", "Joten kuten ei.", "Se joten kutenkin on."):
        want = grammar.paragraph_errors(text, table=table)
        assert grammar.paragraph_errors(text, table=vfst.Transducer(data)) == want
    df = spark.createDataFrame([("Se on joten kuten hyvä.",)], "text string")
    (r,) = grammar.grammar_errors(df, table=data).where("error_code = 1").collect()
    assert (r["start_pos"], r["error_len"], r["suggestions"]) == (6, 11, ["jotenkuten"])


@pytest.mark.parametrize(
    ("output", "n", "expected"),
    [
        ("[Ln][Xp]talo[X]talo[Sn][Ny]", 4, {"CLASS": "nimisana", "SIJAMUOTO": "nimento", "NUMBER": "singular", "BASEFORM": "talo", "STRUCTURE": "=pppp"}),
        ("[Lep][Xp]Oslo[X]oslo[Sg][Ny]n", 5, {"CLASS": "paikannimi", "STRUCTURE": "=ipppp", "BASEFORM": "Oslo"}),
        ("[Lt][Xp]tulla[X]tul[Tt][Ap][P1][Ny][Ef]en", 5, {"CLASS": "teonsana", "MOOD": "indicative", "PERSON": "1", "NEGATIVE": "false", "BASEFORM": "tulla"}),
        ("[Ll][Xp]iso[X]iso[Cc][Sn][Ny]mpi", 6, {"CLASS": "laatusana", "COMPARISON": "comparative"}),
        ("[Ln][Xp]auto[X]auto[Sn][Ny][Bh][Bc][Ln][Xp]talo[X]talo[Sn][Ny]", 8, {"STRUCTURE": "=pppp=pppp", "BASEFORM": "autotalo", "WORDBASES": "+auto(auto)+talo(talo)"}),
    ],
)
def test_analyses_of_tagged_outputs(output, n, expected):
    (a,) = morphology.analysis_of(output, n)
    assert {k: a.get(k) for k in expected} == expected


def test_compound_hyphens_decide_validity():
    head, tail = "[Ln][Xp]kala[X]kala[Sn][Ny]", "[Bh][Bc][Ln][Xp]aika[X]aika[Sn][Ny]"
    assert morphology.analysis_of(head + tail, 8) == []
    assert len(morphology.analysis_of(head + "-" + tail, 9)) == 1


def test_inflection(spark):
    text = (
        "class: 1\nsm-class: valo\nmatch-word: (?:O|U)\nconsonant-gradation: sw\nrules:\nnominatiivi\t0\t0\ts\ngenetiivi\t0\tn\tw\n"
        "partitiivi\t0\ta\ts\nilla\t([ouy])\t(1)(1)n\ts\nold\t0\tx\ts\tps=r\nend: rules\nend: class\n"
    )
    rules = wordlists.inflection_rules(spark, text)
    w = spark.createDataFrame([("katto", "valo-av1"), ("hyty", "valo"), ("talo", "valo"), ("kala", "valo")], "word string, infclass string")
    got = {(r["word"], r["form"]): r["inflected"] for r in inflect.inflect(w, rules).collect()}
    assert got["katto", "genetiivi"] == "katon" and got["katto", "illa"] == "kattoon" and got["hyty", "partitiivi"] == "hytyä"
    assert ("kala", "genetiivi") not in got and ("talo", "old") not in got


def test_gradation_and_vowels(spark):
    rows = [("katto", "av1", "kato", "C"), ("kampa", "av1", "kamma", "H"), ("puku", "av1", "puvu", "M"), ("ruoka", "av5", "ruo$a", "D"), ("arki", "av3", "arji", "L")]
    df = spark.createDataFrame(rows, "w string, g string, weak string, letter string")
    for r in df.withColumn("x", inflect.gradation(F.col("w"), F.col("g"))).withColumn("y", inflect.gradation_letter(F.col("w"), F.col("g"))).collect():
        assert (r["x"]["weak"], r["y"]) == (r["weak"], r["letter"])
    v = spark.createDataFrame([("talo", "BACK"), ("kylä", "FRONT"), ("tie", "FRONT"), ("fysiikka", "BACK"), ("vety=auto", "BACK"), ("analyysi", "BOTH"), ("x-", "BOTH")], "w string, v string")
    for r in v.withColumn("x", inflect.vowel_type(F.col("w"))).collect():
        assert r["x"] == r["v"], r


def test_no_sentence_or_token_is_left_unchecked():
    many = " ".join(f"Talo  {i}." for i in range(260))
    found = [e for e in grammar.paragraph_errors(many) if e[0] == 2]
    assert len(found) == 260
    assert len([e for e in grammar.paragraph_errors(many, options=grammar.BOUNDED) if e[0] == 2]) == 200
    long = " ".join(["talo"] * 600) + "."
    assert len([e for e in grammar.paragraph_errors(long) if e[0] == 8]) == 599
    assert len([e for e in grammar.paragraph_errors(long, options=grammar.BOUNDED) if e[0] == 8]) == 249


def test_descriptions_and_closed_values(spark):
    both = {lang: {r["error_code"]: r["description"] for r in grammar.descriptions(spark, lang).collect()} for lang in ("fi", "fi-x-standard", "en", "sv")}
    assert both["fi"] == both["fi-x-standard"] and both["en"] == both["sv"]
    assert both["fi"][2] == "Poista ylimääräinen väli." and both["en"][18] == "A comma may be missing, or there may be an extra verb."
    assert len(both["fi"]) == 18 and all(both["fi"][c] != both["en"][c] for c in both["fi"])
    assert morphology.VALUES["FOCUS"] == ["läs", "kAAn", "kin", "hAn", "pA", "s"]
    assert len(morphology.VALUES["SIJAMUOTO"]) == 16 and morphology.VALUES["MOOD"][-1] == "MAINEN-infinitive"


def test_readability_by_base_forms(spark):
    known = {"taloissa": "talo", "autoista": "autotallirakennus", "on": "olla"}
    made = morphology.table_analyzer({w: [{"BASEFORM": b, "STRUCTURE": "=" + "p" * len(w)}] for w, b in known.items()})
    df = spark.createDataFrame([(1, "Taloissa on xyz, autoista. On!")], "id int, text string")
    (r,) = reports.readability(df, ["id"], analyzer=made).collect()
    assert (r["n_sentences"], r["n_words"], r["n_known"], r["n_long"]) == (2, 5, 4, 1)
    assert r["n_characters"] == r["n_letters"] + 3 == 26
    syllables = 3 + 1 + 1 + 3 + 1
    assert r["n_syllables"] == syllables
    assert r["wiio_index"] == pytest.approx(2.7 + 30 / 4)
    assert r["reading_ease"] == pytest.approx(206.823 - 1.015 * 5 / 2 - 84.6 * syllables / 5)
    assert r["grade_level"] == pytest.approx(0.39 * 5 / 2 + 11.8 * syllables / 5 - 15.59)


def test_reports(spark):
    df = spark.createDataFrame([(1, "Talo on iso. Auto on uusi."), (2, ""), (3, None)], "id int, text string")
    got = {r["id"]: r for r in reports.readability(df, ["id"]).collect()}
    assert (got[1]["n_sentences"], got[1]["n_words"]) == (2, 6)
    assert got[2]["reading_ease"] == 0.0 and got[3]["n_words"] == 0
    r = spark.createDataFrame([("a", 4, ["x", "y"]), ("b", 1, ["x"]), ("c", 2, [])], "word string, n long, baseforms array<string>")
    assert {x["baseform"]: x["freq"] for x in reports.base_form_frequencies(r).collect()} == {"x": 3.0, "y": 2.0, None: 2.0}


def test_features(spark):
    a = {"BASEFORM": "talo", "SIJAMUOTO": "omanto", "NUMBER": "plural", "KYSYMYSLIITE": "true"}
    df = spark.createDataFrame([("talojenko", [a])], "form string, analyses array<map<string,string>>")
    got = df.select(features.features(F.col("analyses")[0])).first()[0]
    assert got == {"Case": "Gen", "Number": "Plur", "Clitic": "Ko"}
    bank = spark.createDataFrame([("talojenko", "talo", {"Case": "Nom"})], "form string, lemma string, feats map<string,string>")
    assert features.treebank_differences(bank, df).count() == 1


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "w.txt").write_text(" talo \n\nauto\n")
    assert [r[0] for r in texts.word_lines(spark, str(tmp_path / "w.txt")).collect()] == ["talo", "auto"]
    (tmp_path / "t.conllu").write_text("# x\n1\tTalot\ttalo\tNOUN\t_\tCase=Nom|Number=Plur\n\n")
    assert texts.conllu(spark, str(tmp_path / "t.conllu")).first()["feats"] == {"Case": "Nom", "Number": "Plur"}
    (tmp_path / "r.xml").write_text("<a><replacement><incorrect>alas päin</incorrect><correct>alas=päin</correct></replacement></a>")
    assert tuple(wordlists.replacements(spark, str(tmp_path / "r.xml")).first()) == ("alas päin", "alaspäin")
    (tmp_path / "d.xml").write_text('<l><word id="w1"><forms><form>talo</form></forms><classes><wclass>noun</wclass></classes><inflection><infclass type="x">valo</infclass></inflection></word></l>')
    assert wordlists.word_database(spark, str(tmp_path / "d.xml")).first()["forms"] == ["talo"]
    df = spark.createDataFrame([("talo", True, ["x"]), ("tlao", False, ["talo"])], "word string, ok boolean, s array<string>")
    assert [r[0] for r in sinks.spell_lines(df, suggestions="s").collect()] == ["C: talo", "W: tlao", "S: talo"]
    p = spark.createDataFrame([("a\nb\n\nc",)], "text string")
    assert [r["paragraph"] for r in texts.paragraphs_of_lines(p, blank_lines=True).collect()] == ["a b", "c"]


def test_streams_equal_tables(spark, tmp_path):
    from lexiflow.streaming import words as S

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("talo on iso\n")
    lines = spark.readStream.text(str(tmp_path / "in"))
    got = S.run_available(S.token_stream(lines), spark, str(tmp_path / "out"))
    assert got.where("token_type = 'WORD'").count() == 3


def test_linguist_and_sql_names(spark):
    from lexiflow.plans.linguist import Linguist

    me = Linguist(morphology.table_analyzer(LEXICON))
    assert me.spell("talo") and not me.spell("tallo") and me.suggest("tallo") == ["talo"]
    assert me.having(ignore_dot=True).spell("talo.") and me.having(ignore_dot=True).hyphens.ignore_dot
    assert [t for _, t in me.tokens("On talo.")] == ["On", " ", "talo", "."]
    assert me.grammar_errors("Talo.\r\nauto.") == [(7, 7, 4, ["Auto"])]
    assert me.attribute_values("NUMBER") == ["singular", "plural"] and me.attribute_values("x") is None
    df = spark.createDataFrame([("talo",), ("tallo",), ("talo",), (None,)], "word string")
    got = sorted((r["word"] or "", r["ok"], r["suggestions"]) for r in me.check_words(df).collect())
    assert got == [("", None, None), ("tallo", False, ["talo"]), ("talo", True, None), ("talo", True, None)]
    me.register(spark)
    assert spark.sql("SELECT lx_spell('talo') AND lx_suggest('tallo')[0] = 'talo'").first()[0]


def test_dictionary_catalog(spark, tmp_path):
    from lexiflow.sources import dictionaries as D

    for name, variant in (("a", "standard"), ("b", "medicine")):
        d = tmp_path / "5" / name
        d.mkdir(parents=True)
        (d / "index.txt").write_text(f"Language-Code: fi\nLanguage-Variant: {variant}\nDescription: x: y\nMorphology-Backend: vfst\n")
        (d / D.LEXICON).write_bytes(vfst.compile_att(ATT))
    paths = [str(tmp_path / "none"), str(tmp_path)]
    assert D.catalog(spark, paths).count() == 2
    assert D.find(spark, paths, "fi")["variant"] == "standard" and D.find(spark, paths, "fi-x-medicine")["description"] == "x: y"
    assert D.find(spark, paths, "sv") is None
    assert D.analyzer_of(spark, D.find(spark, paths, "fi"))()("kat")


def test_dictionaries_of_the_search_path(spark, tmp_path):
    from lexiflow.sources import dictionaries as D

    home = tmp_path / "home"
    (home / ".lexiflow" / D.FOLDER).mkdir(parents=True)
    paths = D.search_path("given", {D.VARIABLE: "own", "HOME": str(home)})
    assert paths[:4] == ["given", "own", f"own/{D.FOLDER}", f"{home}/.lexiflow/{D.FOLDER}"] and len(paths) == 8
    with pytest.raises(FileNotFoundError):
        D.load(spark, paths[2:4])
    (home / ".lexiflow" / D.FOLDER / D.LEXICON).write_bytes(vfst.compile_att(ATT))
    made, phrases = D.load(spark, paths[2:4])
    assert made()("x") == [] and phrases is None
    (home / ".lexiflow" / D.FOLDER / D.AUTOCORRECTION).write_bytes(vfst.compile_att(ATT))
    assert D.load(spark, paths[2:4])[1]
    d = tmp_path / "all" / "5" / "a"
    d.mkdir(parents=True)
    (d / "index.txt").write_text("Language-Code: fi\nMorphology-Backend: null\n")
    assert D.languages(spark, [str(tmp_path / "all")]) == ["fi"] and D.languages(spark, [str(tmp_path / "all")], "spelling") == []


def test_weighted_words_and_dimensions(spark):
    t = vfst.compile_att(ATT, True)
    df = spark.createDataFrame([("kat",), ("ket",), (None,)], "w string")
    errors = vfst.compile_att("0\t0\tk\tk\t1\n0\t0\tt\tt\t1\n0\t0\te\ta\t0.9\n0\n", True)
    got = [tuple(r) for r in df.select(words.accepted(F.col("w"), t), words.corrected(F.col("w"), errors, t)).collect()]
    assert got == [(0, []), (3, ["kat"]), (None, None)]
    assert morphology.attribute_values(spark).count() > 40 and morphology.tag_codes(spark).count() > 50


def test_element_texts(spark, tmp_path):
    (tmp_path / "wiki.xml").write_text("<m><page><title>x</title><revision><text>talo [[auto]] on</text></revision></page></m>")
    rows = texts.element_texts(spark, str(tmp_path / "wiki.xml"))
    assert [r["word"] for r in texts.corpus_words(rows).collect()] == ["talo", "auto", "on"]


def test_line_tools(capsys, monkeypatch):
    import io

    from lexiflow import cli

    for tool, expected in (("hyphenate", "ta-lo"), ("spell", "W: talo"), ("tokenize", 'WORD [0..4] "talo"'), ("baseform", "unknown 1"), ("readability", "words 1"), ("grammar", "Punctuation is missing")):
        monkeypatch.setattr("sys.stdin", io.StringIO("talo\n"))
        cli.main([tool])
        assert expected in capsys.readouterr().out
