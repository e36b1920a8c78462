"""Queries over the standard tables, and the same in SQL.

Every query reads whole tables. ``ORACLE_SQL`` has the SQL of those that SQL can
express; patterns with look-around and the finite-state folds have none and are
tested against plain Python state machines instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .functions import chars
from .functions.python import prepare
from .operators import features, grammar, inflect, lexicon, local_checks, morphology, reports, spelling, tokens, words
from .plans.storage import new_path, spread, written
from .sources import sinks, texts, vfst, wordlists
from .streaming import words as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


def _frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.word_frequencies(spread(table(spark, sf_dir, "documents").select("text")))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word frequencies for queries that need them more than once."""
    return written(_frequencies(spark, sf_dir), "words")[0]


#: Letter runs in SQL, and the corpus lexicon (words that occur LEAST times or more).
LEAST = 3
RUN = f"[{chars.LETTER}]+"
_RUNS = f"SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '{RUN}')) AS word FROM documents"
_FREQ = f"SELECT lower(word) AS word, count(*) AS freq FROM ({_RUNS}) GROUP BY 1"
_LEX = f"freq AS ({_FREQ}), lex AS (SELECT word AS surface, freq FROM freq WHERE freq >= {LEAST}), unk AS (SELECT word FROM freq WHERE freq < {LEAST})"


# ---- characters and words --------------------------------------------------------

_CLASSES = {"letters": chars.LETTER, "digits": chars.DIGIT, "spaces": chars.SPACE, "punctuation": chars.PUNCT}


def _sql_class(body: str) -> str:
    return body.replace("'", "''")


@query(
    "SELECT lang, sum(length(text))::BIGINT AS n_chars, "
    + ", ".join(f"sum(length(regexp_replace(text, '[^{_sql_class(b)}]', '', 'g')))::BIGINT AS n_{n}" for n, b in _CLASSES.items())
    + ", sum(length(regexp_replace(lower(text), '[^aeiouyäö]', '', 'g')))::BIGINT AS n_vowels FROM documents GROUP BY lang"
)
def char_class_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each class by language."""
    text = F.col("text")
    counts = [F.sum(F.length(F.regexp_replace(text, f"[^{b}]", ""))).alias(f"n_{n}") for n, b in _CLASSES.items()]
    vowels = F.sum(F.length(F.regexp_replace(F.lower(text), f"[^{chars.VOWEL}]", ""))).alias("n_vowels")
    return _documents(spark, sf_dir).groupBy("lang").agg(F.sum(F.length(text)).alias("n_chars"), *counts, vowels)


_CASE_SQL = """CASE WHEN lower(word) = word AND upper(word) = word THEN 'NO_LETTERS' WHEN upper(word) = word THEN 'ALL_UPPER'
 WHEN lower(word[2:]) <> word[2:] THEN 'COMPLEX' WHEN lower(word[1]) <> word[1] THEN 'FIRST_UPPER' ELSE 'ALL_LOWER' END"""


@query(f"SELECT lang, {_CASE_SQL} AS word_case, count(*) AS n, count(DISTINCT word) AS n_distinct FROM ({_RUNS}) GROUP BY 1, 2")
def case_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case classes of words by language; classified once per distinct word."""
    runs = lexicon.letter_runs(_documents(spark, sf_dir), keep=["lang"]).groupBy("lang", "word").agg(F.count("*").alias("c"))
    return runs.groupBy("lang", chars.detect_case(F.col("word")).alias("word_case")).agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"))


def _sql_replace(expr: str, pairs) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, '{a.replace(chr(39), 2 * chr(39))}', '{b.replace(chr(39), 2 * chr(39))}')"
    return expr


#: Letters that several characters stand for in capitals, from Unicode's own table.
_SPECIAL = [(chr(c), chr(c).upper()) for c in (0xDF, 0x149, 0x1F0, 0x390, 0x3B0, 0x587, *range(0x1E96, 0x1E9B), *range(0xFB00, 0xFB07))]


def _sql_upper(expr: str) -> str:
    return f"upper({_sql_replace(expr, _SPECIAL)})"


@query(f"SELECT word, {_sql_upper('word[1]')}[1] || lower(word[2:]) AS titled, {_sql_upper('word')} AS uppered, lower(word) AS lowered FROM (SELECT DISTINCT word FROM ({_RUNS}))")
def case_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in other cases; a letter of several capitals gives the first of them at the start."""
    w = lexicon.letter_runs(_documents(spark, sf_dir), keep=[]).distinct()
    c = F.col("word")
    return w.select("word", *(chars.set_case(c, F.lit(k)).alias(n) for k, n in (("FIRST_UPPER", "titled"), ("ALL_UPPER", "uppered"), ("ALL_LOWER", "lowered"))))


@query(
    f"""SELECT c, n, CASE WHEN regexp_matches(c, '[{chars.LETTER}]') THEN 'LETTER' WHEN regexp_matches(c, '[{chars.SPACE}]') THEN 'WHITESPACE'
     WHEN regexp_matches(c, '[{_sql_class(chars.PUNCT)}]') THEN 'PUNCTUATION' WHEN regexp_matches(c, '[0-9]') THEN 'DIGIT' ELSE 'UNKNOWN' END AS kind,
     {_sql_upper("c")}[1] AS simple_upper, lower(c)[1] AS simple_lower, {_sql_upper("c")}[1] <> c AS lower_case, lower(c)[1] <> c AS upper_case,
     regexp_matches(c, '[aeiouyäöAEIOUYÄÖ]') AS vowel, regexp_matches(lower(c), '[bcdfghjklmnpqrstvwxzšž]') AS consonant, c IN ('"', '»', '”') AS quote_mark
    FROM (SELECT unnest(string_split(text, '')) AS c, count(*) AS n FROM (SELECT text FROM documents UNION ALL SELECT html FROM pages) GROUP BY 1)"""
)
def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every character of texts and pages with its class, cases and predicates."""
    both = _documents(spark, sf_dir).select("text").union(spread(table(spark, sf_dir, "pages").select("html")))
    c = F.col("c")
    n = both.select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    return n.select(
        "c", "n", chars.char_type(c).alias("kind"), chars.simple_upper(c).alias("simple_upper"), chars.simple_lower(c).alias("simple_lower"), chars.is_lower(c).alias("lower_case"),
        chars.is_upper(c).alias("upper_case"), chars.is_vowel(c).alias("vowel"), chars.is_consonant(c).alias("consonant"), chars.is_quote(c).alias("quote_mark"),
    )


@query(
    f"""SELECT lang, count(*) AS n, count(*) FILTER (lower(a) = lower(b) AND length(a) = length(b)) AS n_equal FROM
    (SELECT lang, w[i] AS a, w[i + 1] AS b FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM (SELECT lang, regexp_extract_all(text, '{RUN}') AS w FROM documents))) GROUP BY lang"""
)
def equal_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring words that are equal but for their case."""
    w = _documents(spark, sf_dir).select("lang", F.regexp_extract_all("text", F.lit(RUN), F.lit(0)).alias("w")).where("size(w) > 1")
    pairs = w.select("lang", F.inline(F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("a"), F.expr("slice(w, 2, size(w) - 1)").alias("b"))))
    return pairs.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(chars.equals_ignore_case(F.col("a"), F.col("b"))).alias("n_equal"))


@query(
    "SELECT doc_id, md5("
    + _sql_replace("text", [*chars.compositions(), *chars._SPELLED.items()])
    + ") AS digest, length("
    + _sql_replace("text", [*chars.compositions(), *chars._SPELLED.items()])
    + ") AS n_chars, length(replace(text, chr(173), '')) AS n_hard FROM documents"
)
def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = chars.normalize(F.col("text"))
    hard = F.length(chars.strip_soft_hyphens(F.col("text"))).cast("bigint")
    return _documents(spark, sf_dir).select("doc_id", F.md5(n.cast("binary")).alias("digest"), F.length(n).cast("bigint").alias("n_chars"), hard.alias("n_hard"))


@query(_FREQ)
def word_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequencies(spark, sf_dir)


_BAND = "CASE WHEN freq > 1000 THEN 'over 1000' WHEN freq > 500 THEN '501-1000' WHEN freq > 100 THEN '101-500' ELSE 'to 100' END"


@query(f"SELECT {_BAND} AS band, count(*) AS n_words, sum(freq)::BIGINT AS n_tokens FROM ({_FREQ}) GROUP BY 1")
def frequency_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequencies(spark, sf_dir).groupBy(lexicon.frequency_band(F.col("freq")).alias("band")).agg(F.count("*").alias("n_words"), F.sum("freq").alias("n_tokens"))


@query(
    """SELECT count(*) AS n_pieces, count(*) FILTER (regexp_full_match(w, '[0-9]+')) AS n_integers,
    count(*) FILTER (regexp_full_match(w, '[0-9]+(\\.[0-9]+)*')) AS n_chapters, count(*) FILTER (regexp_full_match(w, '[ivxIVX]+')) AS n_roman,
    count(*) FILTER (length(w) = 1 OR regexp_full_match(w, '[0-9]+(\\.[0-9]+)*') OR regexp_full_match(w, '[ivxIVX]+')) AS n_items,
    count(*) FILTER (regexp_matches(w, '[0-9]')) AS n_with_digit
    FROM (SELECT unnest(regexp_extract_all(text, '[^ \\n\\t]+')) AS w FROM conversations)"""
)
def list_item_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \n\t]+"), F.lit(0))).alias("w"))
    c = F.col("w")
    tests = {"n_integers": chars.is_integer, "n_chapters": chars.is_chapter_number, "n_roman": chars.is_roman_numeral, "n_items": chars.is_possible_list_item, "n_with_digit": chars.has_digit}
    return w.agg(F.count("*").alias("n_pieces"), *(F.count_if(t(c)).alias(n) for n, t in tests.items()))


@query(
    r"""SELECT w, length(w) >= 4 AND (regexp_matches(w, '(?s)^[^/]*//(.+\.|\..)') OR regexp_matches(w, '(?s)^[^@]+@.*\.') OR regexp_matches(w, '(?si)^www\..*\.')) AS loose,
    length(w) >= 4 AND (regexp_matches(w, '(?s)^[^/]*//(.+\.|\..)') OR (regexp_matches(w, '(?s)^[^@]*@[^.].*\.') AND regexp_matches(w, '(?s)^[^@]*@...'))
      OR (length(w) >= 7 AND regexp_matches(w, '(?s)^www\.[^.].*\.'))) AS strict
    FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \n\t]+')) AS w FROM documents UNION SELECT DISTINCT url FROM pages)"""
)
def nonwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs and addresses, as the speller and as the hyphenator see them."""
    w = _documents(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \n\t]+"), F.lit(0))).alias("w"))
    w = w.union(table(spark, sf_dir, "pages").select("url")).distinct()
    return w.select("w", chars.is_nonword(F.col("w")).alias("loose"), chars.is_nonword_strict(F.col("w")).alias("strict"))


# ---- tokens, sentences, paragraphs -------------------------------------------------


_TOKENS = oracle.tokens("text")


@query(f"SELECT lang, {oracle.kind('t')} AS token_type, count(*) AS n, sum(length(t))::BIGINT AS n_chars FROM (SELECT lang, unnest({_TOKENS}) AS t FROM documents) GROUP BY ALL")
def token_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each type by language."""
    rows = tokens.type_counts(_documents(spark, sf_dir), keep=["lang"])
    return rows.groupBy("lang", "token_type").agg(F.sum("n").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("SELECT doc_id, length(text)::BIGINT AS n_chars, length(text)::BIGINT AS covered, true AS same FROM documents WHERE length(text) > 0")
def token_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens cover a text: put together they are the text, and the last one ends where it does."""
    cut = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", tokens.split_tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    rows = cut.withColumn("p", tokens.running_starts(F.transform("t", F.length)))
    covered = (F.element_at("p", -1) + F.length(F.element_at("t", -1))).cast("bigint")
    return rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), covered.alias("covered"), (F.array_join("t", "") == F.col("text")).alias("same"))


@query(
    f"""SELECT t AS word, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS t FROM (SELECT text FROM documents UNION ALL SELECT url FROM pages))
    WHERE {oracle.kind("t")} = 'WORD' AND (contains(t, '@') OR regexp_matches(t, '^https?://')) GROUP BY 1"""
)
def url_email_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word tokens that are URLs or e-mail addresses, in texts and page addresses."""
    both = _documents(spark, sf_dir).select("text").union(table(spark, sf_dir, "pages").select("url"))
    w = tokens.word_tokens(both)
    return w.where(F.col("word").contains("@") | F.col("word").rlike("^https?://")).groupBy("word").agg(F.count("*").alias("n"))


@query(
    f"""WITH s AS ({oracle.sentences(f"SELECT lang, length(text) AS n, {_TOKENS} AS toks FROM documents WHERE length(text) > 0", "lang, n")})
    SELECT lang, k AS sentence_type, sum(c)::BIGINT AS n, sum(l)::BIGINT AS n_chars FROM (SELECT lang, 'PROBABLE' AS k, a.np AS c, a.cp AS l FROM s UNION ALL SELECT lang, 'POSSIBLE', a.ns, a.cs FROM s
     UNION ALL SELECT lang, 'NONE', 1, n - a.b FROM s) GROUP BY ALL HAVING sum(c) > 0"""
)
def sentence_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("lang", F.explode(tokens.sentence_array(F.col("text"))).alias("s"))
    return rows.groupBy("lang", "s.sentence_type").agg(F.count("*").alias("n"), F.sum("s.sentence_len").alias("n_chars"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, t, i, {oracle.kind("t")} AS k FROM (SELECT conv_id, turn, unnest({_TOKENS}) AS t, generate_subscripts({_TOKENS}, 1) AS i FROM conversations)),
    p AS (SELECT *, sum(length(t)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS z FROM t)
    SELECT k || ' [' || (z - length(t))::INT || '..' || z::INT || '] "' || replace(replace(replace(t, chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '"' AS value, count(*) AS n FROM p GROUP BY 1"""
)
def token_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token lines of conversations, counted."""
    rows = tokens.tokens(spread(table(spark, sf_dir, "conversations").select("text")))
    return sinks.token_lines(rows).groupBy("value").agg(F.count("*").alias("n"))


@query(
    """SELECT doc_id, (i - 1)::INTEGER AS par_idx, (sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(l) - 1)::INTEGER AS start,
    md5(regexp_replace(l, '\\r$', '')) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
    QUALIFY regexp_replace(l, '\\r$', '') <> ''"""
)
def paragraph_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "par_idx", "start", F.md5(F.col("paragraph").cast("binary")).alias("digest"))


# ---- grammar -------------------------------------------------------------------


_FINDINGS = oracle.findings(oracle.paragraph_tokens("documents", "lang"), "lang")


@query(
    f"""WITH p AS ({oracle.paragraph_tokens("documents", "lang")}), t AS (SELECT lang, par, t, i, {oracle.kind("t")} AS k FROM (SELECT lang, par, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM p)),
    n AS (SELECT *, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2, lead(k, 1) OVER w AS k1, lead(k, 2) OVER w AS k2 FROM t WINDOW w AS (PARTITION BY par ORDER BY i))
    SELECT lang, c AS error_code, count(*) AS n FROM (SELECT lang, 2 AS c FROM n WHERE k = 'WHITESPACE' AND length(t) > 1 UNION ALL SELECT lang, 3 FROM n WHERE k = 'WHITESPACE' AND length(t) = 1 AND t1 = ','
     UNION ALL SELECT lang, 4 FROM n WHERE t = ',' AND t1 = ',' UNION ALL SELECT lang, 8 FROM n WHERE k = 'WORD' AND k1 = 'WHITESPACE' AND k2 = 'WORD' AND lower(t) = lower(t2)
     AND NOT regexp_matches(t, '^[0-9]') AND t NOT IN ('ollut', 'olleet', 'sillä')) GROUP BY ALL"""
)
def local_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space, commas and repeated words, JVM only."""
    rows = local_checks.local_findings(_documents(spark, sf_dir), keep=["lang"])
    return rows.groupBy("lang", "error_code").agg(F.count("*").alias("n"))


@query(
    f"""WITH d(error_code, name, description) AS (VALUES {", ".join(str(tuple(x.replace("'", "’") if isinstance(x, str) else x for x in c[:3])) for c in grammar.CODES)})
    SELECT lang, error_code, n, name, description FROM (SELECT lang, error_code, count(*) AS n FROM ({_FINDINGS}) GROUP BY ALL) JOIN d USING (error_code)"""
)
def grammar_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks that need no lexicon, with their descriptions."""
    rows = grammar.grammar_errors(_documents(spark, sf_dir), keep=["lang"])
    counts = rows.groupBy("lang", "error_code").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(grammar.descriptions(spark)), "error_code", "left")  # 18 rows


@query(f"WITH p AS (SELECT page_id AS doc_id, 'html' AS lang, html AS text FROM pages) SELECT error_code, count(*) AS n FROM ({oracle.findings(oracle.paragraph_tokens('p', 'lang'), 'lang')}) GROUP BY ALL")
def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same checks on page sources, which have punctuation of all kinds."""
    rows = grammar.grammar_errors(spread(table(spark, sf_dir, "pages").select("html")), "html", keep=[])
    return rows.groupBy("error_code").agg(F.count("*").alias("n"))


@query(
    f"""SELECT lang, count(*) AS n_paragraphs, count(*) FILTER (NOT regexp_matches(p, '[{_sql_class(chars.PUNCT)}]$')) AS n_unfinished
    FROM (SELECT lang, regexp_replace(unnest(string_split(text, chr(10))), '\\r$', '') AS p FROM documents) WHERE p <> '' GROUP BY lang"""
)
def unfinished_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tokens.paragraphs(_documents(spark, sf_dir), keep=["lang"])
    return p.groupBy("lang").agg(F.count("*").alias("n_paragraphs"), F.count_if(local_checks.unfinished(F.col("paragraph"))).alias("n_unfinished"))


_PHRASES = [("of of", "of"), ("in to", "into"), ("the the", "the"), ("de la", "della"), ("und und", "und"), ("is is the", "is the")]


@query(
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '{RUN}') AS w FROM documents),
    g AS (SELECT doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (VALUES (2), (3)) t(n) WHERE len(w) >= n)),
    p(incorrect, correct) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _PHRASES)})
    SELECT doc_id, incorrect, correct, count(*) AS n FROM g JOIN p ON g = incorrect GROUP BY ALL"""
)
def autocorrect_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known wrong phrases: word n-grams joined with the replacement table."""
    p = spark.createDataFrame(_PHRASES, "incorrect string, correct string")
    w = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(RUN), F.lit(0)).alias("w"))
    grams = [
        w.where(F.size("w") >= n).select("doc_id", F.explode(F.expr(f"transform(sequence(1, size(w) - {n - 1}), i -> array_join(slice(w, i, {n}), ' '))")).alias("g"))
        for n in sorted({a.count(" ") + 1 for a, _ in _PHRASES})
    ]
    every = grams[0]
    for g in grams[1:]:
        every = every.union(g)
    return every.join(F.broadcast(p), F.col("g") == F.col("incorrect")).groupBy("doc_id", "incorrect", "correct").agg(F.count("*").alias("n"))


_WRONG = {"the the": "the", "is is the": "is the", "of of": "of", "in to": "into"}
_ONE_CAPITAL = "upper(g[1]) || g[2:]"


@query(
    f"""WITH p(g, r) AS (VALUES {", ".join(str(x) for x in _WRONG.items())}), e AS (SELECT g, r FROM p UNION ALL SELECT {_ONE_CAPITAL}, upper(r[1]) || r[2:] FROM p),
    s AS ({oracle.sentences(oracle.paragraph_tokens("documents", "lang"), "lang, par")}),
    t AS (SELECT lang, par, unnest(toks) AS t, generate_subscripts(toks, 1) AS i, unnest(list_transform(range(1, len(toks) + 1), lambda i: len(list_filter(a.cuts, lambda c: c <= i)))) AS snt FROM s),
    n AS (SELECT lang, par, i, t, string_agg(t, '') OVER (PARTITION BY par, snt ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS two, string_agg(t, '') OVER (PARTITION BY par, snt ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS three FROM t)
    SELECT lang, r AS correct, count(*) AS n FROM (SELECT lang, par, i, max_by(r, length(g)) AS r FROM n JOIN e ON g = two OR g = three WHERE {oracle.kind("t")} = 'WORD' GROUP BY ALL) GROUP BY ALL"""
)
def autocorrect_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong phrases that the grammar check finds by its replacement table."""
    rows = grammar.grammar_errors(_documents(spark, sf_dir), keep=["lang"], table=_WRONG).where("error_code = 1")
    return rows.groupBy("lang", F.col("suggestions")[0].alias("correct")).agg(F.count("*").alias("n"))


# ---- lexicon, spelling, suggestions -------------------------------------------------


@query(f"WITH {_LEX} SELECT lang, count(*) AS n_words, count(*) FILTER (surface IS NOT NULL) AS n_known FROM ({_RUNS}) r LEFT JOIN lex ON lower(r.word) = surface GROUP BY lang")
def spell_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are correct by a lexicon of the corpus's repeated words."""
    # texts are read once: frequencies follow from the counts by language
    counted, _ = written(lexicon.letter_runs(_documents(spark, sf_dir), keep=["lang"]).groupBy("lang", F.lower("word").alias("word")).agg(F.count("*").alias("c")), "words")
    freq, _ = written(counted.groupBy("word").agg(F.sum("c").alias("freq")), "frequencies")
    ok = lexicon.spell(freq.select("word"), lexicon.corpus_lexicon(freq, LEAST))
    return counted.join(ok, "word").groupBy("lang").agg(F.sum("c").alias("n_words"), F.sum(F.when(F.col("ok"), F.col("c")).otherwise(0)).alias("n_known"))


@query(f"SELECT word, freq FROM ({_FREQ}) WHERE freq < {LEAST}")
def unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = _counted(spark, sf_dir)
    return lexicon.unknown_words(freq, lexicon.corpus_lexicon(freq, LEAST))


#: Words with a dot at times; names are words that the documents mostly write with a capital.
_PIECES = f"SELECT unnest(regexp_extract_all(text, '[{chars.LETTER}]+[.]?')) AS word FROM documents"
_NAMES = f"SELECT lower(word) AS surface, CASE WHEN 2 * count(*) FILTER (lower(word[1]) <> word[1]) > count(*) THEN 'i' ELSE 'p' END AS first FROM ({_RUNS}) GROUP BY 1 HAVING count(*) >= {LEAST}"


@query(
    f"""WITH n AS ({_NAMES}), w AS (SELECT word, {_sql_replace("word", chars._SPELLED.items())} AS w, count(*) AS c FROM ({_PIECES}) GROUP BY 1),
    c AS (SELECT *, {_CASE_SQL.replace("word", "w")} AS k FROM w), q AS (SELECT *, CASE WHEN k IN ('COMPLEX', 'NO_LETTERS') THEN lower(w[1]) || w[2:] ELSE lower(w) END AS q FROM c),
    p AS (SELECT word, w, k, c, q, unnest(list_distinct([q, regexp_replace(q, '[.]$', '')])) AS x FROM q),
    v AS (SELECT word, min(CASE WHEN lower(x[2:]) <> x[2:] THEN 2 WHEN first = 'i' AND {_sql_upper("x[1]")}[1] <> x[1] THEN 1 ELSE 0 END) AS v FROM p JOIN n ON lower(x) = surface GROUP BY 1),
    r AS (SELECT k, c, coalesce(v, 3) AS v, lower(w[1])[1] <> w[1] AS capital FROM q LEFT JOIN v USING (word))
    SELECT k AS word_case, CASE WHEN k IN ('COMPLEX', 'NO_LETTERS') THEN v = 0 OR (v = 1 AND capital) WHEN k = 'ALL_LOWER' THEN v = 0 WHEN k = 'FIRST_UPPER' THEN v < 2 ELSE v < 3 END AS ok,
     count(*) AS n_distinct, sum(c)::BIGINT AS n FROM r GROUP BY ALL"""
)
def spell_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of words as written, with final dots, by a lexicon of names and common words."""
    docs = _documents(spark, sf_dir)
    runs = lexicon.letter_runs(docs, keep=[]).groupBy("word").agg(F.count("*").alias("c"))
    names = runs.groupBy(F.lower("word").alias("surface")).agg(F.sum("c").alias("n"), F.sum(F.when(chars.is_upper(F.substring("word", 1, 1)), F.col("c")).otherwise(0)).alias("u")).where(F.col("n") >= LEAST)
    first = F.when(2 * F.col("u") > F.col("n"), "=i").otherwise("=p")
    lex = names.select("surface", F.concat(first, F.repeat(F.lit("p"), F.length("surface") - 1)).alias("structure"))
    w = docs.select(F.explode(F.regexp_extract_all("text", F.lit(f"[{chars.LETTER}]+[.]?"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    got = lexicon.spell(w, lex, options=spelling.SpellOptions(ignore_dot=True))
    return got.groupBy(chars.detect_case(chars.normalize(F.col("word"))).alias("word_case"), "ok").agg(F.count("*").alias("n_distinct"), F.sum("c").alias("n"))


@query(
    f"""SELECT word, CASE WHEN list_max(list_transform(string_split(word, ''), lambda c, i: CASE WHEN lower(c) <> c AND i > 1 THEN 2 ELSE 0 END)) = 2 THEN 2
    WHEN lower(word[1]) <> word[1] THEN 0 ELSE 1 END AS verdict FROM (SELECT DISTINCT word FROM ({_RUNS}))"""
)
def structure_case_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How words fit the case pattern of a name (a capital, then small letters)."""
    w = lexicon.letter_runs(_documents(spark, sf_dir), keep=[]).distinct()
    pattern = F.concat(F.lit("=i"), F.repeat(F.lit("p"), F.length("word") - 1))
    return w.select("word", lexicon.structure_verdict(F.col("word"), pattern).cast("int").alias("verdict"))


def _candidates(spark: SparkSession, sf_dir: str, make, sources=None) -> DataFrame:
    """``sources`` gives the words that ``make`` can turn into one of a lexicon; only they have candidates then."""
    freq = _counted(spark, sf_dir)
    lex = lexicon.corpus_lexicon(freq, LEAST)
    unknown = freq.where(F.col("freq") < LEAST).select("word")
    made = make(lexicon.within_reach(unknown, sources(lex))).hint("merge") if sources else make(unknown)
    found = lexicon.known_candidates(made, lex)
    return found.groupBy("word", "candidate").agg(F.min("seq").cast("bigint").alias("seq"), F.max("freq").alias("freq"))


def _candidate_sql(rows: str) -> str:
    return f"WITH {_LEX}, c AS ({rows}) SELECT word, candidate, min(seq)::BIGINT AS seq, max(freq) AS freq FROM c JOIN lex ON lower(candidate) = surface GROUP BY 1, 2"


_DELETE = """SELECT word, i AS seq, word[1 : i - 1] || word[i + 1 :] AS candidate FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM unk WHERE length(word) > 1)
 WHERE i = 1 OR word[i] <> word[i - 1]"""
_SWAP = """SELECT word, i * 1000 + j AS seq, word[1 : i - 1] || word[j] || word[i + 1 : j - 1] || word[i] || word[j + 1 :] AS candidate
 FROM (SELECT word, i, unnest(range(i + 1, least(length(word), i + CASE WHEN length(word) <= 8 THEN 10 ELSE 50 // length(word) END) + 1)) AS j
  FROM (SELECT word, unnest(range(1, length(word))) AS i FROM unk WHERE length(word) > 1))
 WHERE word[i] <> word[j] AND word[i] || word[j] NOT IN ('aä', 'äa', 'oö', 'öo', 'uy', 'yu')"""
_INSERT = """SELECT word, (k - 1) * 1000 + i AS seq, word[1 : i - 1] || 'aitesn'[k] || word[i :] AS candidate
 FROM (SELECT word, k, unnest(range(1, length(word) + 2)) AS i FROM unk, range(1, 7) t(k))
 WHERE (i > length(word) OR 'aitesn'[k] <> word[i]) AND (i = 1 OR 'aitesn'[k] <> word[i - 1])"""
_PAIRS = spelling.table(spelling.REPLACEMENTS[1])
_REPLACE = f"""SELECT word, k * 1000 + i AS seq, word[1 : i - 1] || b || word[i + 1 :] AS candidate
 FROM (SELECT word, k, a, b, unnest(range(1, length(word) + 1)) AS i FROM unk, (VALUES {", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(_PAIRS))}) p(k, a, b) WHERE contains(word, a))
 WHERE word[i] = a"""
_HYPHEN = """SELECT word, i AS seq, word[1 : i] || '-' || word[i + 1 :] AS candidate FROM (SELECT word, unnest(range(2, length(word) - 1)) AS i FROM unk WHERE length(word) >= 4)"""
_REPEAT = """SELECT word, i AS seq, word[1 : i - 1] || word[i + 2 :] AS candidate FROM (SELECT word, unnest(range(1, length(word) - 2)) AS i FROM unk WHERE length(word) >= 6)
 WHERE word[i : i + 1] = word[i + 2 : i + 3]"""


@query(_candidate_sql(_DELETE))
def suggest_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, lexicon.deletions)


@query(_candidate_sql(_SWAP))
def suggest_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, lexicon.swaps, lexicon.swap_sources)


@query(_candidate_sql(_INSERT))
def suggest_insertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, lexicon.insertions, lexicon.insertion_sources)


@query(_candidate_sql(_REPLACE))
def suggest_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, lambda u: lexicon.replacements(u, _PAIRS), lambda lex: lexicon.replacement_sources(lex, _PAIRS))


_DOUBLE = """SELECT word, i + 1000 AS seq, word[1 : i] || word[i :] AS candidate FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM unk WHERE length(word) >= 4)
 WHERE word[i] NOT IN ('-', '''') AND word[i] <> word[i + 1] AND (i - length(rtrim(word[1 : i], word[i]))) % 2 = 1"""
_FEW = _PAIRS[:8]
_FEW_ROWS = ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(_FEW))
_BOTH = f"""SELECT word, i * 1000 + k AS seq, word[1 : i - 1] || b || b || word[i + 2 :] AS candidate FROM (SELECT word, unnest(range(1, length(word))) AS i FROM unk WHERE length(word) > 1),
 (VALUES {", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(_PAIRS))}) p(k, a, b) WHERE word[i] = a AND word[i + 1] = a AND (i - length(rtrim(word[1 : i], word[i]))) % 2 = 1"""
_TWICE = f"""SELECT word, seq * 1000000 + k * 1000 + j AS seq, c[1 : j - 1] || b || c[j + 1 :] AS candidate FROM
 (SELECT word, seq, c, q.k, q.a, q.b, unnest(range(i, length(c) + 1)) AS j FROM (SELECT word, k * 1000 + i AS seq, i, word[1 : i - 1] || b || word[i + 1 :] AS c
   FROM (SELECT word, k, a, b, unnest(range(1, length(word) + 1)) AS i FROM unk, (VALUES {_FEW_ROWS}) p(k, a, b)) WHERE word[i] = a), (VALUES {_FEW_ROWS}) q(k, a, b)) WHERE c[j] = a"""


@query(_candidate_sql(_DOUBLE))
def suggest_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, lexicon.doublings)


@query(_candidate_sql(_BOTH))
def suggest_double_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, lambda u: lexicon.double_replacements(u, _PAIRS))


@query(_candidate_sql(_TWICE))
def suggest_two_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replacements by the first pairs of the table."""
    return _candidates(spark, sf_dir, lambda u: lexicon.two_replacements(u, _FEW), lambda lex: lexicon.two_replacement_sources(lex, _FEW))


@query(_candidate_sql(_REPEAT))
def suggest_repeat_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, lexicon.repeat_deletions)


@query(
    _candidate_sql(
        """SELECT word, m AS seq, array_to_string(list_transform(string_split(word, ''), lambda c, i: CASE WHEN list_contains(p, i) AND (m >> (list_position(p, i) - 1)) & 1 = 1
        THEN translate(c, 'aouäöy', 'äöyaou') ELSE c END), '') AS candidate
        FROM (SELECT word, p, unnest(range(1, (2 ** len(p))::BIGINT)) AS m FROM (SELECT word, list_filter(range(1, length(word) + 1), lambda i: contains('aouäöy', word[i])) AS p FROM unk)
        WHERE len(p) BETWEEN 1 AND 7)"""
    )
)
def suggest_vowel_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, lexicon.vowel_changes)


@query(
    f"""WITH f AS MATERIALIZED ({_FREQ}), c AS (SELECT word, word[1 : i] AS a, word[i + 1 :] AS b FROM (SELECT word, unnest(range(2, length(word) - 1)) AS i FROM f WHERE freq < {LEAST} AND length(word) >= 4)),
    one AS MATERIALIZED (SELECT c.word, a, b, f.freq AS fa FROM c JOIN f ON a = f.word WHERE f.freq >= {LEAST})
    SELECT one.word, a || ' ' || b AS candidate, fa + f.freq AS freq FROM one JOIN f ON b = f.word WHERE f.freq >= {LEAST}"""
)
def suggest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown words that are two known words: two lexicon joins."""
    freq = _counted(spark, sf_dir)
    lex = lexicon.corpus_lexicon(freq, LEAST).select("surface", "freq")
    parts = lexicon.splits(freq.where(F.col("freq") < LEAST).select("word"))
    one, two = lex.toDF("first_part", "f1"), lex.toDF("second_part", "f2")
    return parts.join(one, "first_part").join(two, "second_part").select("word", "candidate", (F.col("f1") + F.col("f2")).alias("freq"))


@query(
    f"""WITH {_LEX}, c AS (SELECT word, 2 AS g, seq, candidate FROM ({_REPLACE}) UNION ALL SELECT word, 3, seq, candidate FROM ({_DELETE})
      UNION ALL SELECT word, 4, seq, candidate FROM ({_HYPHEN}) UNION ALL SELECT word, 8, seq, candidate FROM ({_INSERT}) UNION ALL SELECT word, 9, seq, candidate FROM ({_SWAP})),
    o AS (SELECT word, candidate, min((g, seq)) AS o FROM c JOIN lex ON lower(candidate) = surface GROUP BY 1, 2)
    SELECT word, row_number() OVER (PARTITION BY word ORDER BY o, candidate)::INTEGER AS rank, candidate FROM o QUALIFY rank <= 5"""
)
def suggest_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every unknown word."""
    freq = _counted(spark, sf_dir)
    unknown = freq.where(F.col("freq") < LEAST).select("word")
    made = lexicon.replacements(unknown, _PAIRS)
    for more in (lexicon.deletions, lexicon.hyphen_insertions, lexicon.insertions, lexicon.swaps):
        made = made.unionByName(more(unknown))
    return lexicon.top_suggestions(made, lexicon.corpus_lexicon(freq, LEAST))


@query(
    f"""SELECT array_to_string(list_sort(string_split(word, '')), '') AS letters, count(*) AS n_words, min(word) AS first_word, max(word) AS last_word
    FROM (SELECT DISTINCT lower(word) AS word FROM ({_RUNS})) GROUP BY 1 HAVING count(*) > 1"""
)
def anagram_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.anagrams(_frequencies(spark, sf_dir))


# ---- hyphenation and reports ---------------------------------------------------------


_INSERTED = "array_to_string(list_transform(range(1, length(word) + 1), lambda i: CASE pattern[i] WHEN '-' THEN '-' || word[i] WHEN '=' THEN CASE WHEN word[i] = '-' THEN '-' ELSE '-' END ELSE word[i] END), '')"
_SYLLABLES = "length(replace(pattern, ' ', '')) + 1"
_WORD_TOKENS = f"SELECT DISTINCT t AS word FROM (SELECT unnest({_TOKENS}) AS t FROM documents) WHERE {oracle.kind('t')} = 'WORD'"


@query(f"SELECT word, pattern, {_INSERTED} AS hyphenated, ({_SYLLABLES})::INT AS n_syllables FROM ({oracle.hyphenated(f'SELECT DISTINCT word FROM ({_RUNS})')})")
def hyphenated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct word with its breaks and syllables, by the rules for unknown words."""
    w = lexicon.letter_runs(_documents(spark, sf_dir), keep=[]).distinct().withColumn("pattern", words.hyphenated(F.col("word")))
    return w.select("word", "pattern", words.insert_hyphens(F.col("word"), F.col("pattern")).alias("hyphenated"), words.syllables(F.col("pattern")).alias("n_syllables"))


@query(
    f"""WITH d AS MATERIALIZED (SELECT doc_id, {_TOKENS} AS toks FROM documents), p AS MATERIALIZED ({oracle.hyphenated(_WORD_TOKENS)}),
    s AS (SELECT doc_id, CASE WHEN len(toks) > 0 THEN a.np + 1 ELSE 0 END AS s FROM ({oracle.sentences("SELECT doc_id, toks FROM d", "doc_id")})),
    t AS (SELECT doc_id, t, {oracle.kind("t")} AS k FROM (SELECT doc_id, unnest(toks) AS t FROM d)),
    w AS (SELECT doc_id, count(*) FILTER (k = 'WORD') AS w, coalesce(sum({_SYLLABLES}) FILTER (k = 'WORD'), 0)::BIGINT AS y, coalesce(sum(length(t)) FILTER (k = 'WORD'), 0)::BIGINT AS l,
       count(*) FILTER (k = 'PUNCTUATION') AS q, count(*) FILTER (k = 'WORD' AND {_SYLLABLES} >= {reports.LONG_BASE}) AS g FROM t LEFT JOIN p ON t = word GROUP BY doc_id),
    r AS (SELECT doc_id, s::BIGINT AS s, coalesce(w, 0) AS w, coalesce(y, 0) AS y, coalesce(l, 0) AS l, coalesce(q, 0) AS q, coalesce(g, 0) AS g FROM s LEFT JOIN w USING (doc_id))
    SELECT doc_id, s AS n_sentences, w AS n_words, y AS n_syllables, l AS n_letters, l + q AS n_characters, w AS n_known, g AS n_long,
     round(CASE WHEN s > 0 AND w > 0 THEN 206.823 - 1.015 * w / s - 84.6 * y / w ELSE 0 END, 6)::DOUBLE AS reading_ease, round(CASE WHEN s > 0 AND w > 0 THEN 0.39 * w / s + 11.8 * y / w - 15.59 ELSE 0 END, 6)::DOUBLE AS grade_level,
     round(CASE WHEN s > 0 AND w > 0 THEN 2.7 + 30.0 * g / w ELSE 0 END, 6)::DOUBLE AS wiio_index FROM r"""
)
def readability_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.readability(_documents(spark, sf_dir), ["doc_id"])
    return out.select(*(F.round(c, 6).alias(c) if c in ("reading_ease", "grade_level", "wiio_index") else c for c in out.columns))


@query(f"SELECT ({_SYLLABLES})::INT AS n_syllables, count(*) AS freq FROM ({oracle.hyphenated(f'SELECT DISTINCT lower(word) AS word FROM ({_RUNS})')}) GROUP BY 1")
def syllable_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words by their syllables."""
    w = lexicon.letter_runs(_documents(spark, sf_dir), keep=[]).select(F.lower("word").alias("baseform")).distinct()
    return reports.base_form_syllables(w, [])


_SCORES_SQL = f"""SELECT lang, source, count(*) AS n_documents, sum(n_words)::BIGINT AS n_words, sum(n_letters)::BIGINT AS n_letters, avg(n_words) AS words_per_document
 FROM (SELECT doc_id, any_value(lang) AS lang, any_value(source) AS source, count(word) AS n_words, coalesce(sum(length(word)), 0) AS n_letters FROM
 (SELECT doc_id, lang, source, NULL AS word FROM documents UNION ALL SELECT doc_id, lang, source, word FROM ({_RUNS})) GROUP BY doc_id) GROUP BY CUBE (lang, source)"""


@query(_SCORES_SQL)
def length_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and letter totals over all groupings of language and source."""
    found = F.regexp_extract_all("text", F.lit(RUN), F.lit(0))
    d = _documents(spark, sf_dir).select("lang", "source", F.size(found).alias("w"), F.coalesce(F.length(F.array_join(found, "")), F.lit(0)).alias("l"))
    return d.cube("lang", "source").agg(F.count("*").alias("n_documents"), F.sum("w").alias("n_words"), F.sum("l").alias("n_letters"), F.avg("w").alias("words_per_document"))


_STEMS = ["s", "en", "er", "ing", "ed", "e", "n"]


@query(
    f"""WITH f AS ({_FREQ}), r AS (SELECT word, freq, list_filter([{", ".join(f"CASE WHEN word LIKE '_%{s}' THEN word[1 : length(word) - {len(s)}] END" for s in _STEMS)}], lambda x: x IS NOT NULL) AS b FROM f)
    SELECT baseform, round(sum(f), 6) AS freq FROM (SELECT unnest(b) AS baseform, freq / len(b) AS f FROM r UNION ALL SELECT NULL, freq::DOUBLE FROM r WHERE len(b) = 0) GROUP BY 1"""
)
def baseform_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base forms by equal shares of a word's readings (here: stems without a known ending)."""
    stems = F.array(*(F.when(F.col("word").like(f"_%{s}"), F.expr(f"substring(word, 1, length(word) - {len(s)})")) for s in _STEMS))
    r = _frequencies(spark, sf_dir).select("word", F.col("freq").alias("n"), F.array_compact(stems).alias("baseforms"))
    return reports.base_form_frequencies(r).select("baseform", F.round("freq", 6).alias("freq"))


@query(
    f"""WITH w AS (SELECT DISTINCT lower(word) AS w FROM ({_RUNS})), p AS (SELECT w,
     CASE WHEN regexp_matches(w, '[aoåu]') THEN length(regexp_extract(w, '(?s)^(.*)[aoåu]', 1)) ELSE -1 END AS b,
     CASE WHEN regexp_matches(w, '[äö]') THEN length(regexp_extract(w, '(?s)^(.*)[äö]', 1)) ELSE -1 END AS f,
     CASE WHEN regexp_matches(w, '[y]') THEN length(regexp_extract(w, '(?s)^(.*)[y]', 1)) ELSE -1 END AS y FROM w)
    SELECT CASE WHEN b > -1 AND greatest(f, y) = -1 THEN 'BACK' WHEN b = -1 THEN 'FRONT' WHEN y < greatest(b, f) THEN CASE WHEN b > f THEN 'BACK' ELSE 'FRONT' END ELSE 'BOTH' END AS vowel_type,
     count(*) AS n FROM p GROUP BY 1"""
)
def vowel_harmony(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = lexicon.letter_runs(_documents(spark, sf_dir), keep=[]).select(F.lower("word").alias("w")).distinct()
    return w.groupBy(inflect.vowel_type(F.col("w")).alias("vowel_type")).agg(F.count("*").alias("n"))


@query(
    f"""WITH f AS ({_FREQ}), a AS (SELECT word FROM ({_FREQ.replace("documents", "(SELECT * FROM documents WHERE lang = 'en')")}) WHERE freq > 1),
     b AS (SELECT word FROM ({_FREQ.replace("documents", "(SELECT * FROM documents WHERE lang = 'fr')")}) WHERE freq > 1)
    SELECT word, 'first' AS side FROM (SELECT word FROM a EXCEPT ALL SELECT word FROM b) UNION ALL SELECT word, 'second' FROM (SELECT word FROM b EXCEPT ALL SELECT word FROM a)"""
)
def wordlist_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated words that only one of two languages has."""
    docs = _documents(spark, sf_dir)
    a, b = (lexicon.word_frequencies(docs.where(F.col("lang") == x)).where("freq > 1").select("word") for x in ("en", "fr"))
    return reports.differences(a, b)


@query(
    f"""WITH c AS (SELECT lang, lower(word) AS word, length(word)::BIGINT AS l, count(*) AS n FROM ({_RUNS}) WHERE lang IN ('en', 'de') GROUP BY ALL HAVING count(*) > 1),
     a AS (SELECT word, n FROM c WHERE lang = 'en'), b AS (SELECT word, n FROM c WHERE lang = 'de')
    SELECT * FROM (SELECT coalesce(a.word, b.word) AS word, CASE WHEN b.word IS NULL THEN 'only first' WHEN a.word IS NULL THEN 'only second' WHEN a.n <> b.n THEN 'differs' END AS status
     FROM a FULL JOIN b ON a.word = b.word) WHERE status IS NOT NULL"""
)
def lexicon_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lexicons compared key by key (here: repeated words and their counts)."""
    docs = _documents(spark, sf_dir)
    a, b = (lexicon.word_frequencies(docs.where(F.col("lang") == x)).where("freq > 1") for x in ("en", "de"))
    return reports.lexicon_differences(a, b, "word", ["freq"])


@query("SELECT w AS weight, round(exp(-0.01 * w), 9) AS probability FROM (SELECT DISTINCT (length(text) % 1000)::INTEGER AS w FROM documents)")
def weight_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select((F.length("text") % 1000).alias("weight")).distinct()
    return w.select("weight", F.round(F.exp(F.lit(-0.01) * F.col("weight")), 9).alias("probability"))


# ---- automaton, morphology, inflection -----------------------------------------------

#: The words that part names are made of: a small lexicon of bounded size.
_PART_WORDS = "anvil blue bolt cold gear gizmo hot large new old plate red ring rod small widget".split()
#: Endings, the tags before them, and what they say.
_ENDINGS = [
    ("", "[Sn][Ny]", {"SIJAMUOTO": "nimento", "NUMBER": "singular"}),
    ("s", "[Sg][Ny]", {"SIJAMUOTO": "omanto", "NUMBER": "singular"}),
    ("ta", "[Sp][Nm]", {"SIJAMUOTO": "osanto", "NUMBER": "plural"}),
    ("kin", "[Sn][Ny][Fkin]", {"SIJAMUOTO": "nimento", "NUMBER": "singular", "FOCUS": "kin"}),
    ("ni", "[Sn][Ny][O1y]", {"SIJAMUOTO": "nimento", "NUMBER": "singular", "POSSESSIVE": "1s"}),
    ("ko", "[Sn][Ny][Fko]", {"SIJAMUOTO": "nimento", "NUMBER": "singular", "KYSYMYSLIITE": "true"}),
]


def _part_lexicon() -> str:
    """The words, their endings and their compounds in AT&T form, and a verb and a place name."""
    arcs, state = [], [100]

    def path(at: int, chars: str, tag: str, end: int) -> None:
        """Characters from a state to another one, a tag before them."""
        steps = [("@0@", tag), *((c, c) for c in chars)]
        for i, (x, y) in enumerate(steps):
            to = end if i + 1 == len(steps) else (state.__setitem__(0, state[0] + 1) or state[0])
            arcs.append((at, to, x, y))
            at = to

    for n, w in enumerate(_PART_WORDS):
        path(0, w, f"[Ln][Xp]{w}[X][Xs]{n}[X]", 1)
    for chars, tags, _ in _ENDINGS:
        path(1, chars, tags, 2)
    path(1, "", "[Sn][Ny][Bh][Bc]", 0)
    path(1, "", "[Sn][Ny]", 3)
    path(3, "-", "", 4)
    path(4, "", "[Bh][Bc]", 0)
    path(0, "is", "[Lt][Xp]is[X]", 5)
    path(5, "", "[Tt][Ap][P3][Ef]", 2)
    path(0, "in", "[Lep][Xp]In[X]", 6)
    path(6, "", "[Sn][Ny]", 2)
    return "".join(f"{a}\t{b}\t{x}\t{y or '@0@'}\n" for a, b, x, y in arcs) + "2\n"


def _part_analyses(rows: DataFrame, col: str) -> DataFrame:
    made = morphology.automaton_analyzer(vfst.compile_att(_part_lexicon()))
    return rows.withColumn("a", F.explode(words.analyses(F.col(col), made)))


def _attributes(*names: str):
    return [F.element_at("a", k).alias(k.lower()) for k in names]


_ENDING_ROWS = ", ".join("(" + ", ".join(f"'{x}'" if x is not None else "NULL" for x in (e, *(v.get(k) for k in ("SIJAMUOTO", "NUMBER", "FOCUS", "POSSESSIVE", "KYSYMYSLIITE")))) + ")" for e, _, v in _ENDINGS)
_FORMS_SQL = f"""SELECT word || e AS form, word, e, sijamuoto, number, focus, possessive, kysymysliite
 FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), (VALUES {_ENDING_ROWS}) t(e, sijamuoto, number, focus, possessive, kysymysliite)"""
_WORD_NUMBERS = ", ".join(f"('{w}', {i})" for i, w in enumerate(_PART_WORDS))


def _part_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return w.select("word", F.explode(F.array(*(F.lit(e) for e, *_ in _ENDINGS))).alias("e")).select("word", F.concat("word", "e").alias("form"))


@query(
    f"""SELECT form, word AS baseform, 'nimisana' AS class, sijamuoto, number, focus, possessive, kysymysliite, '=' || repeat('p', length(form)) AS structure,
    '+' || word || '(' || word || ')' AS wordbases, '+' || word || '(w' || n || ')' AS wordids FROM ({_FORMS_SQL}) JOIN (VALUES {_WORD_NUMBERS}) w(w, n) ON word = w"""
)
def word_form_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inflected part-name words analysed by a compiled finite-state lexicon."""
    names = ("BASEFORM", "CLASS", "SIJAMUOTO", "NUMBER", "FOCUS", "POSSESSIVE", "KYSYMYSLIITE", "STRUCTURE", "WORDBASES", "WORDIDS")
    return _part_analyses(_part_forms(spark, sf_dir), "form").select("form", *_attributes(*names))


@query(
    f"""WITH c AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS a, string_split(p_name, ' ')[1] AS b, h FROM part, (VALUES (''), ('-')) t(h) WHERE p_name LIKE '% %')
    SELECT a || h || b AS form, a || h || b AS baseform, '=' || repeat('p', length(a)) || h || '=' || repeat('p', length(b)) AS structure,
     '+' || a || '(' || a || ')' || CASE WHEN h = '-' THEN '+-' ELSE '' END || '+' || b || '(' || b || ')' AS wordbases
    FROM c WHERE (h = '-') = (a[-1] = b[1] AND contains('{chars.VOWEL}', b[1]))"""
)
def compound_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounds of part names (noun first), with and without a hyphen: one of the two is valid."""
    w = F.split("p_name", " ")
    c = table(spark, sf_dir, "part").where("p_name like '% %'").select(w[1].alias("x"), w[0].alias("y")).distinct()
    c = c.select(F.explode(F.array(F.concat("x", "y"), F.concat("x", F.lit("-"), "y"))).alias("form"))
    return _part_analyses(c, "form").select("form", *_attributes("BASEFORM", "STRUCTURE", "WORDBASES"))


@query(
    f"""SELECT word, count(*) AS n, 'nimisana' AS class, NULL::VARCHAR AS mood, '=' || repeat('p', length(word)) AS structure FROM ({_FREQ.replace("count(*) AS freq", "NULL AS f")}) JOIN (VALUES {_WORD_NUMBERS}) w(w, i) ON word = w GROUP BY ALL
    UNION ALL SELECT word, count(*), CASE word WHEN 'is' THEN 'teonsana' ELSE 'paikannimi' END, CASE word WHEN 'is' THEN 'indicative' END, CASE word WHEN 'is' THEN '=pp' ELSE '=ip' END
     FROM ({_FREQ.replace("count(*) AS freq", "NULL AS f")}) WHERE word IN ('is', 'in') GROUP BY ALL"""
)
def automaton_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses of every distinct word of the documents that the finite-state lexicon accepts as it is."""
    w = lexicon.letter_runs(_documents(spark, sf_dir), keep=[]).select(F.lower("word").alias("word")).distinct()
    w = w.where(F.col("word").isin(*_PART_WORDS, "is", "in"))
    return _part_analyses(w, "word").groupBy("word", *_attributes("CLASS", "MOOD", "STRUCTURE")).agg(F.count("*").alias("n"))


@query(
    f"""SELECT form, 'Case' AS feature, CASE sijamuoto WHEN 'nimento' THEN 'Nom' WHEN 'omanto' THEN 'Gen' ELSE 'Par' END AS value FROM ({_FORMS_SQL})
    UNION ALL SELECT form, 'Number', CASE number WHEN 'singular' THEN 'Sing' ELSE 'Plur' END FROM ({_FORMS_SQL})
    UNION ALL SELECT form, 'Clitic', CASE WHEN focus = 'kin' THEN 'Kin' ELSE 'Ko' END FROM ({_FORMS_SQL}) WHERE focus IS NOT NULL OR kysymysliite IS NOT NULL
    UNION ALL SELECT form, 'Person[psor]', '1' FROM ({_FORMS_SQL}) WHERE possessive IS NOT NULL UNION ALL SELECT form, 'Number[psor]', 'Sing' FROM ({_FORMS_SQL}) WHERE possessive IS NOT NULL"""
)
def treebank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part_analyses(_part_forms(spark, sf_dir), "form")
    return rows.select("form", F.explode(features.features(F.col("a"))).alias("feature", "value"))


@query(
    f"""SELECT form, word AS lemma, CASE WHEN sijamuoto = 'osanto' THEN 'Case' END AS differing FROM ({_FORMS_SQL}) WHERE sijamuoto = 'osanto'
    UNION ALL SELECT form, 'x' || word, NULL FROM ({_FORMS_SQL}) WHERE sijamuoto = 'omanto'"""
)
def treebank_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A treebank written and read as CoNLL-U against the analyses: its genitives
    have another lemma, and its partitives are called essives."""
    forms = _part_forms(spark, sf_dir).distinct()
    genitive, partitive = F.col("form") == F.concat("word", F.lit("s")), F.col("form") == F.concat("word", F.lit("ta"))
    lemma = F.when(genitive, F.concat(F.lit("x"), F.col("word"))).otherwise(F.col("word"))
    feats = F.when(genitive, "Case=Gen").when(partitive, "Case=Ess|Number=Plur").otherwise("_")
    line = F.concat_ws("\t", F.lit("1"), "form", lemma, F.lit("NOUN"), F.lit("_"), feats, F.lit("0"), F.lit("root"), F.lit("_"), F.lit("_"))
    path = new_path(spark, "treebank")
    forms.select(F.concat(F.lit("# text\n"), line, F.lit("\n")).alias("value")).write.text(path)
    made = morphology.automaton_analyzer(vfst.compile_att(_part_lexicon()))
    bank = texts.conllu(spark, path)
    analysed = bank.select("form").distinct().select("form", words.analyses(F.col("form"), made).alias("analyses"))
    found = features.treebank_differences(bank, analysed)
    return found.select("form", "lemma", F.get(F.map_keys("differing"), 0).alias("differing"))


def _hyphen_lexicon() -> dict[str, list[dict[str, str]]]:
    """Part words, noun-first compounds, and forms that the rules for hyphens are about."""
    one = lambda *parts: {"STRUCTURE": "=" + "=".join("p" * len(x) for x in parts), "CLASS": "nimisana"}
    rows = {w: [one(w)] for w in _PART_WORDS}
    rows["new"][0]["MALAGA_VAPAA_JALKIOSA"] = "true"
    for w in _PART_WORDS:
        rows.update({w + a: [one(w, a)] for a in _PART_WORDS if a != "rod"})
        rows[w + "rod"] = [one(w, "rod"), one(w + "rod")]
        rows[w + w[-2:] + "isto"] = [one(w, w[-2:] + "isto")]
        rows[f"-pre{w}-"] = [{"STRUCTURE": "-" + "p" * (len(w) + 3) + "-"}]
    return rows


@query(
    f"""WITH p AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS n, string_split(p_name, ' ')[1] AS a FROM part WHERE p_name LIKE '% %'), w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)
    SELECT n || a AS form, true AS strict, true AS lenient FROM p UNION ALL SELECT n || '-' || a, a = 'new', true FROM p UNION ALL SELECT n || chr(173) || a, true, true FROM p
    UNION ALL SELECT n[1] || chr(173) || n[2:] || a, false, false FROM p UNION ALL SELECT upper(n || a), true, true FROM p UNION ALL SELECT upper(n[1]) || n[2:] || a, true, true FROM p
    UNION ALL SELECT n || upper(a), false, false FROM p UNION ALL SELECT n || a || '.', false, true FROM p
    UNION ALL SELECT w || '-' || w[-2:] || 'isto', regexp_matches(w, '[{chars.VOWEL}][{chars.CONSONANT}]$'), true FROM w
    UNION ALL SELECT w || '-rod', true, true FROM w UNION ALL SELECT 'pre' || w, false, true FROM w UNION ALL SELECT w || 'zz', false, false FROM w"""
)
def hyphen_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names joined, with hyphens missing, extra or soft, in several cases and with a dot, by strict and lenient options."""
    made = morphology.table_analyzer(_hyphen_lexicon())
    pair = F.split("p_name", " ")
    p = table(spark, sf_dir, "part").where("p_name like '% %'").select(pair[1].alias("n"), pair[0].alias("a")).distinct()
    w = table(spark, sf_dir, "part").select(F.explode(pair).alias("w")).distinct()
    soft = chars.SOFT_HYPHEN
    joined = [
        "concat(n, a)", "concat(n, '-', a)", f"concat(n, '{soft}', a)", f"concat(left(n, 1), '{soft}', substring(n, 2), a)", "upper(concat(n, a))",
        "concat(upper(left(n, 1)), substring(n, 2), a)", "concat(n, upper(a))", "concat(n, a, '.')",
    ]
    single = ["concat(w, '-', right(w, 2), 'isto')", "concat(w, '-rod')", "concat('pre', w)", "concat(w, 'zz')"]
    forms = p.select(F.explode(F.expr(f"array({', '.join(joined)})")).alias("form")).union(w.select(F.explode(F.expr(f"array({', '.join(single)})")).alias("form")))
    lenient = spelling.SpellOptions(ignore_dot=True, accept_extra_hyphens=True, accept_missing_hyphens=True)
    return forms.select("form", words.spelled_right(F.col("form"), made).alias("strict"), words.spelled_right(F.col("form"), made, lenient).alias("lenient"))


@query(
    f"""WITH p AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS n, string_split(p_name, ' ')[1] AS a FROM part WHERE p_name LIKE '% %'), w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part),
    h AS ({oracle.hyphenated("SELECT w AS word FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) UNION SELECT w || 'rod' FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)")})
    SELECT n || a AS form, x.pattern || '-' || y.pattern[2:] AS pattern FROM p JOIN h x ON x.word = n JOIN h y ON y.word = a UNION ALL SELECT w || 'rod', pattern FROM w JOIN h ON word = w || 'rod'"""
)
def compound_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks of compounds by their readings' boundaries; a reading as one word rules out the one as a compound."""
    made = morphology.table_analyzer(_hyphen_lexicon())
    pair = F.split("p_name", " ")
    p = table(spark, sf_dir, "part").where("p_name like '% %'").select(F.concat(pair[1], pair[0]).alias("form")).distinct()
    w = table(spark, sf_dir, "part").select(F.explode(pair).alias("w")).distinct().select(F.concat("w", F.lit("rod")).alias("form"))
    return p.union(w).select("form", words.hyphenated(F.col("form"), made).alias("pattern"))


def _special_lexicon() -> str:
    """Part words as numerals, places, free suffixes, verbs and organisations, in AT&T form."""
    arcs, state = [], 100
    for w in _PART_WORDS:
        for surface, before, behind in (
            (f"{w}u", f"[Lu][Xp]{w}u[X]", "[Sn][Ny]"),
            (f"{w}la", f"[Ln][Ica][Xp]{w}la[X]", "[Sn][Ny]"),
            (f"{w}sti", f"[Ln][Ivj][Xp]{w}sti[X]", "[Sn][Ny]"),
            (f"{w}ma", f"[Lt][Ira][Xp]{w}ma[X]", "[Tt][Ap][P3][Ef]"),
            (f"{w}ta", f"[Ll][Xp]{w}[X]", "[Cc][Sp][Ny]"),
            (f"{w}org", f"[Ln][Xp]{w}[X]", None),
        ):
            steps = [("@0@", before), *((c, c) for c in surface)]
            if behind is None:
                steps[-3:-3] = [("@0@", "[Sn][Ny][Bh][Bc][Ln][Ion][Xp]org[X]")]
            steps.append(("@0@", behind or "[Sn][Ny]"))
            at = 0
            for i, (x, y) in enumerate(steps):
                to = 1 if i + 1 == len(steps) else (state := state + 1)
                arcs.append(f"{at}\t{to}\t{x}\t{y}")
                at = to
    return "\n".join([*arcs, "1"])


@query(
    """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), r AS (
    SELECT w || 'u' AS form, w || 'u' AS baseform, 'lukusana' AS class, NULL AS comparison, NULL AS geographical, NULL AS free_suffix, NULL AS following, NULL AS structure FROM w
    UNION ALL SELECT w || 'la', w || 'la', 'nimisana', NULL, 'true', NULL, NULL, NULL FROM w UNION ALL SELECT w || 'sti', w || 'sti', 'nimisana', NULL, NULL, 'true', NULL, NULL FROM w
    UNION ALL SELECT w || 'ma', w || 'ma', 'teonsana', NULL, NULL, NULL, 'A-infinitive', NULL FROM w UNION ALL SELECT w || 'ta', w, 'laatusana', 'comparative', NULL, NULL, NULL, NULL FROM w
    UNION ALL SELECT w || 'org', w || 'org', 'nimisana', NULL, NULL, NULL, NULL, '=' || repeat('p', length(w)) || '=ppp' FROM w WHERE w[-1] <> 'o'
    UNION ALL SELECT w || 'org', upper(w[1]) || w[2:] || 'org', 'nimi', NULL, NULL, NULL, NULL, '=i' || repeat('p', length(w) - 1) || '=ppp' FROM w WHERE w[-1] <> 'o')
    SELECT form, baseform, class, comparison, geographical, free_suffix, following, coalesce(structure, '=' || repeat('p', length(form))) AS structure FROM r"""
)
def special_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals, flags of single analyses, comparison, and the second reading of an
    organisation's name (none where equal vowels would need a hyphen)."""
    made = morphology.automaton_analyzer(vfst.compile_att(_special_lexicon()))
    w = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    forms = w.select(F.explode(F.array(*(F.concat("w", F.lit(e)) for e in ("u", "la", "sti", "ma", "ta", "org")))).alias("form"))
    rows = forms.select("form", F.explode(words.analyses(F.col("form"), made)).alias("a"))
    names = {"geographical": "POSSIBLE_GEOGRAPHICAL_NAME", "free_suffix": "MALAGA_VAPAA_JALKIOSA", "following": "REQUIRE_FOLLOWING_VERB"}
    return rows.select("form", *_attributes("BASEFORM", "CLASS", "COMPARISON", "STRUCTURE"), *(F.element_at("a", v).alias(k) for k, v in names.items()))


#: An error model of one substitution, its weight in it, and the lexicon's own weights.
_SLIPS = [("o", "a", 0.5), ("i", "e", 0.25), ("m", "n", 0.125), ("b", "d", 0.2)]


def _weighted_models() -> tuple[bytes, bytes]:
    letters = sorted({c for w in _PART_WORDS for c in w})
    errors = [f"{s}\t{s}\t{c}\t{c}\t1.0" for s in (0, 1) for c in letters] + [f"0\t1\t{a}\t{b}\t{p}" for a, b, p in _SLIPS]
    arcs, state = [], 1
    for w in _PART_WORDS:
        at = 0
        for c in w:
            arcs.append(f"{at}\t{state}\t{c}\t{c}\t1.0")
            at, state = state, state + 1
        arcs.append(f"{at}\t9999\t@0@\t@0@\t{1 / (1 + len(w))}")
    return vfst.compile_att("\n".join([*errors, "0\t1.0", "1\t1.0"]), True), vfst.compile_att("\n".join([*arcs, "9999\t1.0"]), True)


@query(
    f"""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), s(a, b, p) AS (VALUES {", ".join(str(x) for x in _SLIPS)}),
    l(word, p) AS (VALUES {", ".join(f"('{w}', 1.0 / {1 + len(w)})" for w in _PART_WORDS)}),
    wrong AS (SELECT DISTINCT word[1 : i - 1] || a || word[i + 1 :] AS typed FROM (SELECT word, a, b, unnest(range(1, length(word) + 1)) AS i FROM w, s) WHERE word[i] = b),
    c AS (SELECT typed, typed AS candidate, 0 AS cost FROM wrong UNION ALL SELECT typed, typed[1 : i - 1] || b || typed[i + 1 :], round(-100 * ln(p))
      FROM (SELECT typed, a, b, p, unnest(range(1, length(typed) + 1)) AS i FROM wrong, s) WHERE typed[i] = a),
    k AS (SELECT typed, candidate, min(cost + round(-100 * ln(l.p)))::INT AS cost FROM c JOIN l ON candidate = word GROUP BY ALL)
    SELECT typed, list(candidate ORDER BY cost, candidate)[1] AS best, count(*) AS n, round(exp(-0.01 * min(cost)), 9) AS probability FROM k GROUP BY typed"""
)
def weighted_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part-name words with a letter mistyped, corrected by weighted automata."""
    errors, known = _weighted_models()
    w = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    slips = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b, _ in _SLIPS))
    typed = w.select("word", F.explode(slips).alias("s"), F.length("word").alias("n")).select("word", "s", F.explode(F.sequence(F.lit(1), "n")).alias("i")).where("substring(word, i, 1) = s.b")
    typed = typed.select(F.expr("concat(substring(word, 1, i - 1), s.a, substring(word, i + 1))").alias("typed")).distinct()
    found = typed.withColumn("c", words.weighted_corrections(F.col("typed"), errors, known)).where(F.size("c") > 0)
    return found.select("typed", F.col("c")[0]["word"].alias("best"), F.size("c").cast("bigint").alias("n"), F.round(F.col("c")[0]["probability"], 9).alias("probability"))


_AFFIXES = """class: 1
sm-class: valo
match-word: V
consonant-gradation: sw
rules:
nominatiivi\t0\t0\ts
genetiivi\t0\tn\tw
partitiivi\t0\ta\ts
illatiivi\t([aeiouy])\t(1)(1)n\ts
end: rules
end: class
"""


_STRONG, _WEAK = oracle.gradation("word", "'av1'")


@query(
    f"""WITH w AS (SELECT word, {oracle.vowel_type("word")} AS v, {_STRONG} AS strong, {_WEAK} AS weak FROM ({_FREQ}) WHERE regexp_matches(word, '[aeiouy]$')),
    r(form, grade, strip, affix) AS (VALUES ('nominatiivi', 's', '', ''), ('genetiivi', 'w', '', 'n'), ('partitiivi', 's', '', 'a'), {", ".join(f"('illatiivi', 's', '{c}', '{c}{c}n')" for c in "aeiouy")}),
    b AS (SELECT word, form, v, strip, affix, CASE grade WHEN 's' THEN strong ELSE weak END AS base FROM w, r WHERE strong IS NOT NULL),
    m AS (SELECT word, form, CASE WHEN v IN ('BACK', 'BOTH') AND suffix(base, strip) THEN base[1 : length(base) - length(strip)] || affix END AS x,
      CASE WHEN v IN ('FRONT', 'BOTH') AND suffix(base, translate(strip, 'aou', 'äöy')) THEN base[1 : length(base) - length(strip)] || translate(affix, 'aou', 'äöy') END AS y FROM b)
    SELECT word, form, unnest(list_filter(CASE WHEN x = y THEN [x] ELSE [x, y] END, lambda z: z IS NOT NULL)) AS inflected FROM m"""
)
def inflected_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of all words that end in a vowel, as an inflection class would have them."""
    w = _frequencies(spark, sf_dir).where(F.col("word").rlike("[aeiouy]$")).select("word", F.lit("valo-av1").alias("infclass"))
    return inflect.inflect(w, wordlists.inflection_rules(spark, _AFFIXES)).select("word", "form", "inflected")


_GRADES = ("-", "av1", "av2", "av3", "av4", "av5", "av6")


@query(
    f"""WITH w AS (SELECT DISTINCT lower(word) AS w FROM ({_RUNS})), x AS (SELECT w, g FROM w, (VALUES {", ".join(f"('{g}')" for g in _GRADES)}) t(g)),
    y AS (SELECT w, g, {oracle.gradation("w", "g")[0]} AS strong, {oracle.gradation("w", "g")[1]} AS weak, {oracle.gradation_letter("w", "g")} AS letter FROM x)
    SELECT g AS grade, letter, right(strong, 3) AS strong_end, right(weak, 3) AS weak_end, count(*) AS n, count(*) FILTER (strong <> weak) AS n_changing FROM y WHERE strong IS NOT NULL GROUP BY ALL"""
)
def gradation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong and weak stems of all words in every gradation class, counted by their ends."""
    w = lexicon.letter_runs(_documents(spark, sf_dir), keep=[]).select(F.lower("word").alias("w")).distinct()
    x = w.select("w", F.explode(F.array(*map(F.lit, _GRADES))).alias("g")).withColumn("s", inflect.gradation(F.col("w"), F.col("g"))).where("s is not null")
    ends = [F.expr(f"right(s.{c}, 3)").alias(f"{c}_end") for c in ("strong", "weak")]
    return x.groupBy(F.col("g").alias("grade"), inflect.gradation_letter(F.col("w"), F.col("g")).alias("letter"), *ends).agg(F.count("*").alias("n"), F.count_if(F.col("s.strong") != F.col("s.weak")).alias("n_changing"))


@query()
def suggested_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked corrections by all generators and their budget, for every distinct word of the documents."""
    freq = _counted(spark, sf_dir)
    made = morphology.stored_analyzer(written(lexicon.corpus_lexicon(freq, LEAST).select("surface"), "lexicon")[1])
    # few bytes are much work: the words are dealt evenly, not packed by size
    w = freq.select("word").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return w.select("word", words.spelled_right(F.col("word"), made).alias("ok"), F.array_join(words.suggestions(F.col("word"), made), ",").alias("suggestions"))


# ---- sources, sinks, streams ---------------------------------------------------------


@query(
    r"""WITH p AS (SELECT unnest(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', ' ', 'g'), '(?s)<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+')) AS w FROM pages),
    c AS (SELECT regexp_replace(w, '^[^\p{L}\-]+', '') AS w FROM p WHERE regexp_matches(w, '\p{L}')),
    e AS (SELECT regexp_extract(w, '^(.*[\p{L}\-])([^\p{L}\-]*)$', 1) AS x, regexp_extract(w, '^(.*[\p{L}\-])([^\p{L}\-]*)$', 2) AS s FROM c)
    SELECT word, count(*) AS freq FROM (SELECT x || CASE WHEN s LIKE '.%' AND x[-1] <> '-' THEN CASE WHEN length(s) > 1 AND s[2] <> '.' THEN s[1:2] ELSE '.' END ELSE '' END AS word FROM e)
    WHERE NOT regexp_matches(word, '[|\[\]/{}]') GROUP BY 1"""
)
def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word list of page texts without their markup."""
    plain = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("html", "(?s)<(script|style).*?</\\1>", " "), "<[^>]*>", " ").alias("text"))
    return texts.corpus_words(plain).groupBy("word").agg(F.count("*").alias("freq"))


@query(f"SELECT CASE WHEN freq < {LEAST} THEN 'W: ' ELSE 'C: ' END || word AS value FROM ({_FREQ})")
def spell_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = _counted(spark, sf_dir)
    return sinks.spell_lines(lexicon.spell(freq.select("word"), lexicon.corpus_lexicon(freq, LEAST)))


def _lines_of(df: DataFrame, spark: SparkSession, name: str) -> str:
    """A column of lines as text files in the shared folder."""
    path = new_path(spark, name)
    df.write.text(path)
    return path


@query(f"SELECT word, count(*) AS n FROM (SELECT regexp_replace(unnest(string_split(replace(text, chr(13), chr(10)), chr(10))), '^[{chars.SPACE}]+|[{chars.SPACE}]+$', '', 'g') AS word FROM documents) WHERE word <> '' GROUP BY 1")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files and read as trimmed lines."""
    path = _lines_of(_documents(spark, sf_dir).select("text"), spark, "lines")
    return texts.word_lines(spark, path).groupBy("word").agg(F.count("*").alias("n"))


@query(
    f"""SELECT doc_id, (i - 1)::INT AS par_idx, md5(replace(p, chr(10), ' ')) AS digest FROM (SELECT doc_id, unnest(r) AS p, generate_subscripts(r, 1) AS i FROM
    (SELECT doc_id, regexp_split_to_array(text, '\n[{chars.SPACE}]*\n') AS r FROM documents)) WHERE regexp_replace(replace(p, chr(10), ' '), '^[{chars.SPACE}]+|[{chars.SPACE}]+$', '', 'g') <> ''"""
)
def blank_line_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts.paragraphs_of_lines(_documents(spark, sf_dir).select("doc_id", "text"), blank_lines=True)
    return rows.select("doc_id", "par_idx", F.md5(F.col("paragraph").cast("binary")).alias("digest"))


def _xml_of(df: DataFrame, spark: SparkSession, name: str) -> str:
    path = new_path(spark, name)
    sinks.write_xml(df, path)
    return path


@query("SELECT 'p' || p_partkey AS id, string_split(p_name, ' ')[1] AS first_form, len(string_split(p_name, ' '))::INT AS n_forms, lower(p_type) AS class, 'valo-av' || (p_size % 6 + 1) AS infclass FROM part")
def word_database_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as an XML word database and read back."""
    forms = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("<form>"), w, F.lit("</form>"))), "")
    line = F.concat(
        F.lit("<word id=\"p"), F.col("p_partkey").cast("string"), F.lit("\"><forms>"), forms, F.lit("</forms><classes><wclass>"), F.lower("p_type"),
        F.lit("</wclass></classes><inflection><infclass type=\"modern\">valo-av"), (F.col("p_size") % 6 + 1).cast("string"), F.lit("</infclass></inflection></word>"),
    )
    rows = wordlists.word_database(spark, _xml_of(table(spark, sf_dir, "part").select(line), spark, "words"))
    return rows.select("id", F.col("forms")[0].alias("first_form"), F.size("forms").alias("n_forms"), F.col("classes")[0].alias("class"), F.col("inflections")[0]["_VALUE"].alias("infclass"))


@query("SELECT p_partkey::VARCHAR || ' ' || p_name AS incorrect, p_name AS correct FROM part UNION ALL SELECT n_name, 'x' || n_name FROM nation")
def replacement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replacement list written as XML and read back, its marks of word parts dropped."""
    a = table(spark, sf_dir, "part").select(F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name").alias("x"), F.replace("p_name", F.lit(" "), F.lit("= =")).alias("y"))
    b = table(spark, sf_dir, "nation").select(F.col("n_name").alias("x"), F.concat(F.lit("=x"), "n_name").alias("y"))
    both = a.union(b).select(F.concat(F.lit("<replacement><incorrect>"), "x", F.lit("</incorrect><correct>"), "y", F.lit("</correct></replacement>")))
    return wordlists.replacements(spark, _xml_of(both, spark, "replacements"))


@query("SELECT trim(regexp_replace(unnest(string_split(text, chr(10))), '[<>&\x00-\x1F]', ' ', 'g')) AS text, count(*) AS n FROM conversations GROUP BY 1 HAVING length(trim(any_value(text))) >= 0 AND text <> ''")
def element_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations as text elements of XML files, read back."""
    t = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "\n")).alias("t")).select(F.trim(F.regexp_replace("t", "[<>&\\x00-\\x1F]", " ")).alias("t"))
    path = _xml_of(t.where("t <> ''").select(F.concat(F.lit("<page><text>"), "t", F.lit("</text></page>"))), spark, "pages")
    return texts.element_texts(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query(
    """SELECT * FROM (VALUES ('nominatiivi', 's', '', '', '', true), ('genetiivi', 'w', '', 'n', '', true), ('partitiivi', 's', '', 'a', '', true)) t(form, grade, strip, affix, condition, characteristic)
    UNION ALL SELECT 'illatiivi', 's', c, c || c || 'n', c, true FROM (SELECT unnest(string_split('aeiouy', '')) AS c)"""
)
def affix_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An affix table's rules, letter classes written out."""
    return wordlists.inflection_rules(spark, _AFFIXES).select("form", "grade", "strip", "affix", "condition", "characteristic")


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.windowed_counts(table(spark, sf_dir, "events"), keys=["event_type"])


@query(
    """WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, s"""
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each type by language."""
    return token_type_counts(spark, sf_dir)
