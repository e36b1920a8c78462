"""The lexicon as a relation, probed by joins; all in the JVM.

Columns: surface (lower case, the key), structure, and any attributes. Words
look it up by equi-join; adaptive execution picks a broadcast when the distinct
words or the lexicon are small and a sort-merge join otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chars import LETTER, detect_case, has_digit, is_lower, is_nonword, is_upper, normalize, simple_lower, simple_upper
from .spelling import SpellOptions

LETTER_RUN = f"[{LETTER}]+"


def letter_runs(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows (kept columns, word) of maximal runs of letters."""
    keep = [c for c in (keep if keep is not None else df.columns) if c != text_col]
    return df.select(*keep, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LETTER_RUN), F.lit(0))).alias("word"))


def word_frequencies(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, freq) of lower-cased letter runs; counted on the map side first."""
    return letter_runs(df, text_col, []).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("freq"))


def frequency_band(freq: Column) -> Column:
    return F.when(freq > 1000, "over 1000").when(freq > 500, "501-1000").when(freq > 100, "101-500").otherwise("to 100")


def corpus_lexicon(freq: DataFrame, least: int = 3) -> DataFrame:
    """Words that a corpus has at least ``least`` times, as a lexicon relation."""
    return freq.where(F.col("freq") >= least).select(F.col("word").alias("surface"), F.concat(F.lit("="), F.repeat(F.lit("p"), F.length("word"))).alias("structure"), "freq")


def structure_verdict(word: Column, structure: Column) -> Column:
    """0 fits, 1 wants a capital at the start, 2 other case errors."""
    bare = F.replace(structure, F.lit("="), F.lit(""))

    def one(c: Column, s: Column) -> Column:
        return (
            F.when(s.isNull() | c.isNull(), 0)
            .when(is_upper(c) & s.isin("p", "q"), 2)
            .when(is_lower(c) & ~is_upper(c) & s.isin("i", "j"), 1)
            .otherwise(0)
        )

    def worst(each: Column) -> Column:
        later = F.when(F.size(each) > 1, F.array_max(F.slice(each, F.lit(2), F.greatest(F.size(each) - 1, F.lit(1))))).otherwise(0)
        first = F.element_at(each, 1)
        return F.when((later > 0) | (first == 2), 2).otherwise(first)

    chars = F.split(word, "")
    each = F.zip_with(chars, F.slice(F.split(bare, ""), F.lit(1), F.size(chars)), one)
    # in an array of one, the codes are worked out once and used by name
    general = F.element_at(F.transform(F.array(each), worst), 1)
    small = bare.rlike("^[pq]+$") & (F.length(bare) >= F.length(word))
    return F.when(F.length(word) == 0, 0).when(small, F.when(F.lower(word) == word, 0).otherwise(2)).otherwise(general)


def spell(words: DataFrame, lexicon: DataFrame, word_col: str = "word", options: SpellOptions | None = None) -> DataFrame:
    """``words`` (distinct rows are cheapest) with a boolean column ``ok``.

    Each word has at most two keys, with and without a final dot; the lexicon
    is reduced to the best verdict per key and case pattern before it is joined
    back. Hyphen and soft-hyphen rules need an analyzer (see the word
    functions); here a word is looked up as it is.
    """
    o = options or SpellOptions()
    w = words.withColumn("__n", normalize(F.col(word_col))).withColumn("__c", detect_case(F.col("__n")))
    case = F.when((F.col("__c") == "ALL_UPPER") & F.lit(not o.accept_all_uppercase), "COMPLEX").otherwise(F.col("__c"))
    w = w.withColumn("__c", case)
    bypass = (F.length("__n") == 0) | (has_digit(F.col("__n")) & F.lit(o.ignore_numbers)) | (F.lit(o.ignore_uppercase) & (detect_case(F.col("__n")) == "ALL_UPPER")) | (F.lit(o.ignore_nonwords) & is_nonword(F.col("__n")))
    as_is = F.concat(simple_lower(F.substring("__n", 1, 1)), F.substring("__n", 2, 1 << 30))
    lower = F.when(F.length(F.lower("__n")) == F.length("__n"), F.lower("__n")).otherwise(F.array_join(F.transform(F.split("__n", ""), simple_lower), ""))
    w = w.withColumn("__k", F.when(F.col("__c").isin("COMPLEX", "NO_LETTERS"), as_is).otherwise(lower))
    keys = F.array_distinct(F.array("__k", F.regexp_replace("__k", r"\.$", ""))) if o.ignore_dot else F.array("__k")
    probe = w.where(~bypass).select("__k", F.explode(keys).alias("__q")).distinct()
    lex = lexicon.select(F.col("surface").alias("__s"), "structure")
    found = probe.join(lex, F.lower("__q") == F.col("__s")).groupBy("__k").agg(F.min(structure_verdict(F.col("__q"), F.col("structure"))).alias("__v"))
    v = F.coalesce(F.col("__v"), F.lit(3))
    capital = F.lit(o.accept_first_uppercase) & is_upper(F.substring("__n", 1, 1))
    ok = (
        F.when(F.col("__n").isNull(), None)
        .when(bypass, True)
        .when(F.length(word_col) > 255, False)
        .when(F.col("__c").isin("COMPLEX", "NO_LETTERS"), (v == 0) | ((v == 1) & capital))
        .when(F.col("__c") == "ALL_LOWER", v == 0)
        .when(F.col("__c") == "FIRST_UPPER", (v == 1) | ((v == 0) & F.lit(o.accept_first_uppercase)))
        .otherwise(v < 3)
    )
    return w.join(found, "__k", "left").withColumn("ok", ok).drop("__n", "__c", "__k", "__v")


def unknown_words(words: DataFrame, lexicon: DataFrame, word_col: str = "word") -> DataFrame:
    """Rows whose lower-cased word the lexicon lacks (anti join)."""
    return words.join(lexicon.select("surface").distinct(), F.lower(word_col) == F.col("surface"), "left_anti")


def letter_key(word: Column) -> Column:
    return F.array_join(F.array_sort(F.split(word, "")), "")


def anagrams(words: DataFrame, word_col: str = "word") -> DataFrame:
    """Groups of distinct words with the same letters: (letters, n_words, first_word, last_word).

    Keyed by sorted letters, so nothing is permuted and no pairs are made.
    """
    keyed = words.select(F.col(word_col).alias("w")).distinct().withColumn("letters", letter_key(F.col("w")))
    return keyed.groupBy("letters").agg(F.count("*").alias("n_words"), F.min("w").alias("first_word"), F.max("w").alias("last_word")).where("n_words > 1")


# ---- candidates of suggestions, as rows ------------------------------------------
# Each gives (word, gen_idx, seq, candidate): seq orders a generator's candidates.


def _positions(words: DataFrame, first, last) -> DataFrame:
    return words.where(last >= first).select("word", F.explode(F.sequence(first, last)).alias("i"))


def _left(i: Column) -> Column:
    return F.expr("substring(word, 1, i - 1)")


def deletions(words: DataFrame) -> DataFrame:
    """One character less, runs of a character only once."""
    rows = _positions(words.where(F.length("word") > 1), F.lit(1), F.length("word"))
    keep = (F.col("i") == 1) | F.expr("lower(substring(word, i, 1)) <> lower(substring(word, i - 1, 1))")
    return rows.where(keep).select("word", F.lit(3).alias("gen_idx"), F.col("i").alias("seq"), F.expr("concat(substring(word, 1, i - 1), substring(word, i + 1))").alias("candidate"))


def swaps(words: DataFrame) -> DataFrame:
    """Two characters change places, at most 10 apart (50 / length in longer
    words); equal ones and pairs of vowel harmony stay."""
    n = F.length("word")
    far = F.when(n <= 8, 10).otherwise(F.floor(F.lit(50) / n)).cast("int")
    rows = words.where(n > 1).select("word", n.alias("n"), far.alias("far"), F.explode(F.sequence(F.lit(1), n - 1)).alias("i"))
    rows = rows.where(F.least(F.col("n"), F.col("i") + F.col("far")) > F.col("i"))
    rows = rows.select("word", "i", F.explode(F.sequence(F.col("i") + 1, F.least(F.col("n"), F.col("i") + F.col("far")))).alias("j"))
    rows = rows.withColumn("a", F.expr("lower(substring(word, i, 1))")).withColumn("b", F.expr("lower(substring(word, j, 1))"))
    rows = rows.where("a <> b and concat(a, b) not in ('aä', 'äa', 'oö', 'öo', 'uy', 'yu')")
    made = F.expr("concat(substring(word, 1, i - 1), substring(word, j, 1), substring(word, i + 1, j - i - 1), substring(word, i, 1), substring(word, j + 1))")
    return rows.select("word", F.lit(9).alias("gen_idx"), (F.col("i") * 1000 + F.col("j")).alias("seq"), made.alias("candidate"))


def insertions(words: DataFrame, chars: str = "aitesn", gen_idx: int = 8) -> DataFrame:
    """A character more at each place, unless it equals a neighbour."""
    rows = words.where(F.length("word") > 0).select("word", F.posexplode(F.split(F.lit(chars), "")).alias("k", "c"))
    rows = rows.select("word", "k", "c", F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("i"))
    fits = F.expr("(i > length(word) or c <> lower(substring(word, i, 1))) and (i = 1 or c <> lower(substring(word, i - 1, 1)))")
    made = F.expr("concat(substring(word, 1, i - 1), c, substring(word, i))")
    return rows.where(fits).select("word", F.lit(gen_idx).alias("gen_idx"), (F.col("k") * 1000 + F.col("i")).alias("seq"), made.alias("candidate"))


def replacements(words: DataFrame, pairs: list[tuple[str, str]], gen_idx: int = 2) -> DataFrame:
    """One character for another, pair by pair."""
    known = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))
    rows = words.where(F.length("word") > 0).select("word", F.posexplode(known).alias("k", "p")).where("instr(word, p.a) > 0")
    rows = rows.select("word", "k", "p", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i")).where("substring(word, i, 1) = p.a")
    made = F.expr("concat(substring(word, 1, i - 1), p.b, substring(word, i + 1))")
    return rows.select("word", F.lit(gen_idx).alias("gen_idx"), (F.col("k") * 1000 + F.col("i")).alias("seq"), made.alias("candidate"))


def splits(words: DataFrame) -> DataFrame:
    """Two parts of at least two characters, cut from right to left: also the
    columns first_part and second_part."""
    rows = _positions(words, F.lit(2), F.length("word") - 2)
    rows = rows.select("word", F.lit(5).alias("gen_idx"), (F.length("word") - F.col("i")).alias("seq"), F.expr("substring(word, 1, i)").alias("first_part"), F.expr("substring(word, i + 1)").alias("second_part"))
    return rows.withColumn("candidate", F.concat_ws(" ", "first_part", "second_part"))


def hyphen_insertions(words: DataFrame) -> DataFrame:
    """A hyphen at each inner place with none near."""
    rows = _positions(words.where(F.length("word") >= 4), F.lit(2), F.length("word") - 2)
    made = F.expr("concat(substring(word, 1, i), '-', substring(word, i + 1))")
    return rows.where("instr(substring(word, i - 1, 4), '-') = 0").select("word", F.lit(4).alias("gen_idx"), F.col("i").alias("seq"), made.alias("candidate"))


def _run(i: str) -> str:
    """Length of the run of one character that ends at a place."""
    return f"({i} - length(rtrim(substring(word, {i}, 1), substring(word, 1, {i}))))"


def doublings(words: DataFrame) -> DataFrame:
    """A character twice that isn't yet (the last one of a run of an odd number); a generator with the hyphens."""
    rows = _positions(words.where(F.length("word") >= 4), F.lit(1), F.length("word"))
    alone = F.expr(f"substring(word, i, 1) not in ('-', \"'\") and substring(word, i, 1) <> substring(word, i + 1, 1) and {_run('i')} % 2 = 1")
    made = F.expr("concat(substring(word, 1, i), substring(word, i))")
    return rows.where(alone).select("word", F.lit(4).alias("gen_idx"), (F.col("i") + 1000).alias("seq"), made.alias("candidate"))


def double_replacements(words: DataFrame, pairs: list[tuple[str, str]], gen_idx: int = 6) -> DataFrame:
    """Both of two equal neighbours for two others."""
    known = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))
    rows = _positions(words.where(F.length("word") > 1), F.lit(1), F.length("word") - 1)
    rows = rows.where(F.expr(f"substring(word, i, 1) = substring(word, i + 1, 1) and {_run('i')} % 2 = 1"))
    rows = rows.select("word", "i", F.posexplode(known).alias("k", "p")).where("substring(word, i, 1) = p.a")
    made = F.expr("concat(substring(word, 1, i - 1), p.b, p.b, substring(word, i + 2))")
    return rows.select("word", F.lit(gen_idx).alias("gen_idx"), (F.col("i") * 1000 + F.col("k")).alias("seq"), made.alias("candidate"))


def two_replacements(words: DataFrame, pairs: list[tuple[str, str]], gen_idx: int = 15) -> DataFrame:
    """One character for another, and then one at the same place or behind it."""
    first = replacements(words, pairs, gen_idx)
    known = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))
    rows = first.select("word", "seq", "candidate", (F.col("seq") % 1000).alias("i"), F.posexplode(known).alias("k", "p")).where("instr(substring(candidate, i), p.a) > 0")
    rows = rows.select("word", "seq", "candidate", "k", "p", F.explode(F.sequence(F.col("i"), F.length("candidate"))).alias("j")).where("substring(candidate, j, 1) = p.a")
    made = F.expr("concat(substring(candidate, 1, j - 1), p.b, substring(candidate, j + 1))")
    return rows.select("word", F.lit(gen_idx).alias("gen_idx"), (F.col("seq").cast("bigint") * 1000000 + F.col("k") * 1000 + F.col("j")).alias("seq"), made.alias("candidate"))


def repeat_deletions(words: DataFrame) -> DataFrame:
    """One of two equal neighbouring pairs of characters less."""
    rows = _positions(words.where(F.length("word") >= 6), F.lit(1), F.length("word") - 3)
    made = F.expr("concat(substring(word, 1, i - 1), substring(word, i + 2))")
    return rows.where("substring(word, i, 2) = substring(word, i + 2, 2)").select("word", F.lit(16).alias("gen_idx"), F.col("i").alias("seq"), made.alias("candidate"))


def vowel_changes(words: DataFrame) -> DataFrame:
    """All ways to flip a/ä, o/ö and u/y in words with 1 to 7 such vowels."""
    at = F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.expr("'x'").isNotNull() & F.instr(F.lit("aouäöy"), F.substring(F.col("word"), i, F.lit(1))).cast("boolean"))
    rows = words.where(F.length("word") > 0).withColumn("at", at).where("size(at) between 1 and 7")
    rows = rows.select("word", "at", F.explode(F.expr("sequence(1, cast(pow(2, size(at)) as int) - 1)")).alias("m"))
    made = F.expr(
        "array_join(transform(split(word, ''), (c, i) -> case when array_position(at, i + 1) > 0"
        " and (shiftright(m, cast(array_position(at, i + 1) as int) - 1) & 1) = 1 then translate(c, 'aouäöy', 'äöyaou') else c end), '')"
    )
    return rows.select("word", F.lit(1).alias("gen_idx"), F.col("m").alias("seq"), made.alias("candidate"))


def insertion_sources(lexicon: DataFrame, chars: str = "aitesn") -> DataFrame:
    """(word) of all words that ``insertions`` can turn into one of the lexicon."""
    rows = _positions(lexicon.select(F.col("surface").alias("word")), F.lit(1), F.length("word")).withColumn("c", F.expr("substring(word, i, 1)"))
    fits = F.expr("c <> substring(word, i + 1, 1) and (i = 1 or c <> substring(word, i - 1, 1))")
    return rows.where((F.instr(F.lit(chars), F.col("c")) > 0) & fits).select(F.expr("concat(substring(word, 1, i - 1), substring(word, i + 1))").alias("word"))


def replacement_sources(lexicon: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(word) of all words that ``replacements`` can turn into one of the lexicon."""
    return replacements(lexicon.select(F.col("surface").alias("word")), [(b, a) for a, b in pairs]).select(F.col("candidate").alias("word"))


def two_replacement_sources(lexicon: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(word) of all words that ``two_replacements`` can turn into one of the lexicon.
    Replacements at two places can be undone in either order, at one place the later goes first."""
    return two_replacements(lexicon.select(F.col("surface").alias("word")), [(b, a) for a, b in pairs]).select(F.col("candidate").alias("word"))


def swap_sources(lexicon: DataFrame) -> DataFrame:
    """(word) of all words that ``swaps`` can turn into one of the lexicon: a swap undoes itself."""
    return swaps(lexicon.select(F.col("surface").alias("word"))).select(F.col("candidate").alias("word"))


def within_reach(words: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of ``words`` (lower case) that are among ``sources``, or have the hash of one.

    Candidates need to be made of these words only. Hashes travel instead of
    words, and nothing is broadcast: to Catalyst, rows of an explode are no more
    than those before it.
    """
    keys = sources.select(F.xxhash64("word").alias("__h"))
    return words.withColumn("__h", F.xxhash64("word")).join(keys.hint("merge"), "__h", "left_semi").drop("__h")


def known_candidates(candidates: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Candidates that the lexicon has, with its frequency."""
    lex = lexicon.groupBy("surface").agg(F.max("freq").alias("freq"))
    return candidates.join(lex, F.lower("candidate") == F.col("surface")).drop("surface")


def top_suggestions(candidates: DataFrame, lexicon: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` best known candidates of each word: (word, rank, candidate).

    Repeated candidates count where they came first; generator order and place
    decide, so results don't depend on the partitioning. Window limits are
    pushed below the shuffle.
    """
    found = known_candidates(candidates.select("word", "gen_idx", "seq", "candidate"), lexicon)
    once = found.groupBy("word", "candidate").agg(F.min(F.struct("gen_idx", "seq")).alias("o"))
    order = Window.partitionBy("word").orderBy("o.gen_idx", "o.seq", "candidate")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("word", "rank", "candidate")


def capitalised(word: Column) -> Column:
    return F.concat(simple_upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))
