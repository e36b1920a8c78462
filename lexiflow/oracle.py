"""SQL texts of the longer folds, written for DuckDB.

They state tokens, sentences and syllables a second time: by patterns without
look-around over marked texts, and by folds over lists. No Spark query uses
them; tests and the driver hold the queries against them.
"""

from __future__ import annotations

from .functions import chars
from .operators import inflect, spelling

_LD = chars.LETTER + chars.DIGIT
#: Marks put into a text: after a hyphen that ends a word, and for a dot before white space or the end.
_TAIL, _STOP = "\x01", "\x02"


def quoted(body: str) -> str:
    return body.replace("'", "''")


def _token_pattern() -> str:
    d, hy = chars.DIGIT, chars.HYPHEN
    mail = _LD + r"#$%*+=\^_`|~!&'\-/?{}" + _TAIL
    url = f"https?://[{_LD}=#%{chars.PUNCT}{_TAIL}]*"
    email = rf"[{mail}.]*@[{mail}]*\.[{mail}.]*"
    commas = f"[{_LD}]*[{d}](?:,[{d}]+)+"
    more = rf"(?:[{d}]+|\.[{d}]|[{hy}][{d}]|,[{d}])*"
    digits, number = f"[{d}]+{more}", rf"(?:[{d}]+|\.[{d}]|[{hy}][{d}]){more}"
    word = rf"(?:{commas}|[{_LD}]+|['’:.][{chars.LETTER}]|[{hy}](?:{commas}|[{_LD}]+))"
    tail = f"[{hy}]{_TAIL}"
    core = f"(?:{number}{word}*(?:{tail})?|{word}+(?:{tail})?|{tail})"
    start = f"[{_LD}]"
    return rf"(?s)(?:{url}|{start}{email}|(?:[\-‐‑])(?:{url}|{email}|{core})|{digits}{word}*(?:{tail})?|(?:{commas}|{start}+){word}*(?:{tail})?|[{chars.SPACE}]+|\.\.[.{_STOP}]|.{_TAIL}?)"


def tokens(text: str) -> str:
    """List of the tokens of a text expression."""
    marked = rf"regexp_replace({text}, '\.([{chars.SPACE}]|\z)', chr(2) || '\1', 'g')"
    unknown = f"[^{_LD}{chars.SPACE}{chars.PUNCT}{_STOP}]"
    marked = quoted_replace(marked, rf"([{chars.HYPHEN}])(\z|[{chars.QUOTE}{chars.SPACE},]|{unknown})", r"'\1' || chr(1) || '\2'")
    return f"list_transform(regexp_extract_all({marked}, '{quoted(_token_pattern())}'), lambda x: replace(replace(x, chr(1), ''), chr(2), '.'))"


def quoted_replace(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, '{quoted(pattern)}', {by}, 'g')"


def kind(token: str) -> str:
    """Type of a token expression."""
    return (
        f"CASE WHEN regexp_matches({token}, '^[{_LD}]') OR (length({token}) > 1 AND regexp_matches({token}, '^[\\-‐‑]')) THEN 'WORD'"
        f" WHEN regexp_matches({token}, '^[{chars.SPACE}]') THEN 'WHITESPACE' WHEN regexp_matches({token}, '^[{quoted(chars.PUNCT)}]') THEN 'PUNCTUATION' ELSE 'UNKNOWN' END"
    )


def sentences(rows: str, keys: str) -> str:
    """Rows (keys, a: fold's end, n_chars) of ``rows`` (keys, toks: list of tokens).

    The fold keeps how many boundaries were sure (np, cp characters) and only
    possible (ns, cs), where the open sentence began (b), and the token numbers
    at which sure sentences began (cuts).
    """
    cut = "(s.e AND NOT s.q AND x.k <> 'WHITESPACE')"
    idle = "(s.e AND NOT s.q AND x.k = 'WHITESPACE')"
    soft_cut = f"({cut} AND (s.f OR (s.k <> 'WHITESPACE' AND x.k = 'WORD')))"
    e, f, q = (f"(CASE WHEN {cut} THEN false ELSE s.{c} END)" for c in "efq")
    first = f"({cut} OR s.p = s.b)"
    before_word = f"(NOT {first} AND s.k = 'WORD' AND ((length(s.t) = 1 AND s.t <> lower(s.t)) OR regexp_full_match(s.t, '[-.0-9]+')))"
    closing = f"({q} AND starts_with(x.n, ','))"
    mark = f"(x.k = 'PUNCTUATION' AND NOT {idle})"
    is_quote = "x.t IN ('\"', '»', '”', '“')"
    new_e = f"CASE WHEN {mark} AND x.t IN ('!', '?', '...', '…', ':', '.') THEN true WHEN {mark} AND {is_quote} AND {closing} THEN false ELSE {e} END"
    new_f = (
        f"CASE WHEN {mark} AND x.t IN ('!', '?') THEN {f} OR {q} WHEN {mark} AND x.t IN ('...', '…', ':') THEN true"
        f" WHEN {mark} AND x.t = '.' THEN {f} OR {before_word} WHEN {mark} AND {is_quote} AND {closing} THEN false ELSE {f} END"
    )
    new_q = f"CASE WHEN {mark} AND {is_quote} THEN CASE WHEN {closing} THEN false ELSE NOT {q} END ELSE {q} END"
    step = (
        f"{{'k': x.k, 't': x.t, 'n': x.n, 'i': x.i, 'p': s.p + length(x.t), 'b': CASE WHEN {cut} THEN s.p ELSE s.b END, 'e': {new_e}, 'f': {new_f}, 'q': {new_q},"
        f" 'np': s.np + ({cut} AND NOT {soft_cut})::BIGINT, 'cp': s.cp + CASE WHEN {cut} AND NOT {soft_cut} THEN s.p - s.b ELSE 0 END,"
        f" 'ns': s.ns + {soft_cut}::BIGINT, 'cs': s.cs + CASE WHEN {soft_cut} THEN s.p - s.b ELSE 0 END,"
        f" 'cuts': CASE WHEN {cut} AND NOT {soft_cut} THEN list_append(s.cuts, x.i) ELSE s.cuts END}}"
    )
    blank = "'p': 0::BIGINT, 'b': 0::BIGINT, 'e': false, 'f': false, 'q': false, 'np': 0::BIGINT, 'cp': 0::BIGINT, 'ns': 0::BIGINT, 'cs': 0::BIGINT, 'cuts': []::BIGINT[]"
    items = f"list_transform(toks, lambda t, i: {{'k': {kind('t')}, 't': t, 'n': coalesce(toks[i + 1], ''), 'i': i::BIGINT, {blank}}})"
    start = f"{{'k': '', 't': '', 'n': '', 'i': 0::BIGINT, {blank}}}"
    return f"SELECT {keys}, toks, list_reduce({items}, lambda s, x: {step}, {start}) AS a FROM ({rows})"


def _room(m: str, at: str) -> str:
    """Whether a vowel is on both sides of a new break at an offset from 0."""
    left = f"regexp_matches(right(w[2:{at}], length(regexp_extract({m}[2:{at}], '[^-=]*$'))), '[{chars.VOWEL}]')"
    right = f"regexp_matches(w[{at} + 1 : {at} + length(regexp_extract({m}[{at} + 1:], '^[^-=]*'))], '^[^.{chars.VOWEL}]*[{chars.VOWEL}]')"
    return f"({at} > 0 AND {at} < length(w) - 1 AND {left} AND {right})"


def _fold(state: str, count: str, then: str) -> str:
    """A fold of the marks m over 0 to count - 1 (i, as text)."""
    return f"list_reduce(list_transform(range(0, greatest(0, {count})), lambda i: i::VARCHAR), lambda m, i: {then}, {state})"


def _either(values) -> str:
    return ", ".join(f"'{x}'" for x in sorted(values))


def syllables(parts: str) -> str:
    """Rows (part, m: marks) of ``parts`` (part, w: in lower case) without hyphens inside."""
    v, c = f"[{chars.VOWEL}]", f"[{chars.CONSONANT}]"
    plain = (
        f"CASE WHEN i BETWEEN 1 AND length(w) - 2 AND w[i + 1] = '''' AND regexp_matches(w[i + 2], '{v}') THEN '='"
        f" WHEN i BETWEEN greatest(1, length(regexp_extract(w, '^{c}*'))) AND length(w) - 2 AND regexp_matches(w[i + 1 : i + 2], '{c}{v}')"
        " AND w[i] NOT IN ('/', '.', ':', '&', '%', '''') THEN '-' ELSE ' ' END"
    )
    first = f"SELECT *, array_to_string(list_transform(range(0, length(w)), lambda i: {plain}), '') AS m0 FROM ({parts})"
    at = "(i::INT // 2 + 1)"
    long_vowel = f"regexp_matches(w[{at} + 1], '{v}') AND w[{at} + 1] = w[{at} + 2]"
    before = f"i::INT % 2 = 0 AND {long_vowel} AND regexp_matches(w[{at}], '{v}') AND {_room('m', at)}"
    after = f"i::INT % 2 = 1 AND {long_vowel} AND {at} + 2 < length(w) AND {_room('m', f'({at} + 2)')}"
    around = f"CASE WHEN {before} THEN m[1:{at}] || '-' || m[{at} + 2:] WHEN {after} THEN m[1:{at} + 2] || '-' || m[{at} + 4:] ELSE m END"
    second = f"SELECT *, {_fold('m0', '2 * (length(w) - 2)', around)} AS m1 FROM ({first})"
    no_diphthong = f"CASE WHEN i > 0 AND m1[i + 1] = ' ' AND w[i : i + 1] IN ({_either(spelling.SPLIT_VOWELS)}) THEN '-' ELSE m1[i + 1] END"
    third = f"SELECT *, array_to_string(list_transform(range(0, length(w)), lambda i: {no_diphthong}), '') AS m2 FROM ({second})"
    n = len(spelling.LONG_CONSONANTS)
    place, cluster = f"(i::INT // {n} + 1)", f"([{', '.join(repr(x) for x in spelling.LONG_CONSONANTS)}][i::INT % {n} + 1])"
    stretch = f"m[{place} + 2 : least({place} + length({cluster}), length(w) - 1) + 1]"
    whole = f"CASE WHEN starts_with(w[{place} + 1:], {cluster}) AND contains({stretch}, '-') THEN m[1:{place}] || '-' || replace({stretch}, '-', ' ') || m[{place} + length({stretch}) + 2:] ELSE m END"
    fourth = f"SELECT *, {_fold('m2', f'{n} * (length(w) - 2)', whole)} AS m3 FROM ({third})"
    three = f"w[i::INT + 1 : i::INT + 2] IN ({_either(spelling.SPLIT_AFTER)}) AND m[i::INT + 2] <> '-' AND regexp_matches(w[i::INT + 3], '{v}')"
    split = f"CASE WHEN {three} AND {_room('m', '(i::INT + 2)')} THEN m[1:i::INT + 2] || '-' || m[i::INT + 4:] ELSE m END"
    return f"SELECT part, {_fold('m3', 'length(w) - 3', split)} AS m FROM ({fourth})"


def hyphenated(words: str) -> str:
    """Rows (word, pattern) of ``words`` (word, distinct): breaks of unknown words by the
    syllable rules, hyphens inside a word being breaks of their own."""
    cut = "string_split(CASE WHEN length(word) > 2 THEN word[1] || replace(word[2:length(word) - 1], '-', chr(3)) || word[length(word)] ELSE word END, chr(3))"
    parts = f"SELECT word, unnest({cut}) AS p, generate_subscripts({cut}, 1) AS k FROM ({words})"
    marks = syllables(f"SELECT part, lower(part) AS w FROM (SELECT DISTINCT unnest({cut}) AS part FROM ({words}))")
    return f"SELECT word, string_agg(m, '=' ORDER BY k) AS pattern FROM ({parts}) x JOIN ({marks}) y ON p = part GROUP BY word"


def findings(rows: str, keys: str) -> str:
    """Rows (keys, error_code) of all findings that need no lexicon, in paragraphs
    ``rows`` (keys, par, toks)."""
    each = f"SELECT {keys}, par, unnest(toks) AS t, generate_subscripts(toks, 1) AS i, unnest(list_transform(range(1, len(toks) + 1), lambda i: len(list_filter(a.cuts, lambda c: c <= i)))) AS snt FROM ({sentences(rows, f'{keys}, par')})"
    typed = f"SELECT *, {kind('t')} AS k FROM ({each})"
    near = ", ".join(f"{f}({c}, {n}) OVER s AS {c}{'b' if f == 'lag' else 'a'}{n}" for f in ("lag", "lead") for n in (1, 2) for c in "tk")
    over = "WINDOW s AS (PARTITION BY {0}, par, snt ORDER BY i), p AS (PARTITION BY {0}, par ORDER BY i)".format(keys)
    some = f"SELECT *, {near}, row_number() OVER s AS si, lead(i) OVER p IS NULL AS at_end FROM typed {over}"
    first = "t[1]"
    comma = "(ka1 = 'PUNCTUATION' AND ta1[1] = ',')"
    reference = "((t[1] = '[' AND ta2[1] = ']') OR (tb1[1] = '[' AND ta1[1] = ']') OR (tb2[1] = '[' AND t[1] = ']'))"
    may_start = ", ".join(f"'{c}'" for c in "()-“–—\"»”") + ", ''''"
    quotes = "('\"', '»', '”')"
    foreign = "SELECT *, min(CASE WHEN k = 'PUNCTUATION' AND t[1] = '“' AND ta2 IS NOT NULL THEN i END) OVER (PARTITION BY {0}, par, snt) AS foreign_at FROM nearby".format(keys)
    checks = {
        2: f"k = 'WHITESPACE' AND length(t) > 1 AND NOT coalesce({reference}, false)",
        3: f"k = 'WHITESPACE' AND length(t) = 1 AND coalesce({comma}, false) AND NOT coalesce({reference}, false)",
        4: f"k = 'PUNCTUATION' AND si > 1 AND {first} = ',' AND coalesce({comma}, false) AND NOT coalesce({reference}, false)",
        5: f"k = 'PUNCTUATION' AND si = 1 AND {first} NOT IN ({may_start}) AND NOT coalesce({reference}, false)",
        8: "k = 'WORD' AND ka1 = 'WHITESPACE' AND ka2 = 'WORD' AND length(t) = length(ta2) AND lower(t) = lower(ta2) AND NOT regexp_matches(t, '^[0-9]') AND t NOT IN ('ollut', 'olleet', 'sillä')",
        9: "at_end AND k <> 'PUNCTUATION'",
        10: f"k = 'PUNCTUATION' AND ka1 = 'PUNCTUATION' AND ka2 = 'PUNCTUATION' AND ta1[1] IN {quotes} AND ta2[1] = ',' AND t[1] IN ('.', '!', '?') AND (foreign_at IS NULL OR i < foreign_at)",
        11: "i = foreign_at",
    }
    local = " UNION ALL ".join(f"SELECT {keys}, {code} AS error_code FROM f WHERE {test}" for code, test in checks.items())
    # the words of sentences with a small letter, and no foreign quote before it
    small = "min(CASE WHEN k = 'WORD' AND upper(t) <> t THEN i END) OVER (PARTITION BY {0}, par, snt)".format(keys)
    opening = "min(CASE WHEN t[1] = '“' THEN i END) OVER (PARTITION BY {0}, par, snt)".format(keys)
    stream = f"SELECT * FROM (SELECT *, {small} AS small_at, {opening} AS open_at FROM typed) WHERE small_at IS NOT NULL AND (open_at IS NULL OR open_at > small_at)"
    blank = "'st': '', 'w': '', 'ms': false, 'ad': false, 'pend': false, 'skip': false, 'gq': false, 'gl': '', 'gt': false, 'gd': false, 'Q': '', 'en': false, 'n7': 0::BIGINT, 'n12': 0::BIGINT, 'op': false, 'lw': true"
    listed = "regexp_full_match(s.w, '.|[0-9]+([.][0-9]+)*|[ivxIVX]+')"
    word = "(x.k = 'WORD')"
    normal = "s.st NOT IN ('INITIAL', 'QUOTED')"
    skip_now = f"(s.pend AND NOT {word} AND x.t[1] = ')' AND {listed} AND {normal})"
    wrong = f"(s.pend AND s.st = 'UPPER' AND NOT {skip_now} AND lower(s.w[1]) = s.w[1] AND NOT regexp_matches(s.w, '^[0-9]') AND NOT s.ms)"
    mark = f"(x.k = 'PUNCTUATION' AND NOT {skip_now})"
    c, top, rest = "x.t[1]", "right(s.Q, 1)", "left(s.Q, length(s.Q) - 1)"
    stack = (
        f"CASE WHEN NOT {mark} THEN s.Q WHEN {c} IN {quotes} THEN CASE WHEN {top} = {c} THEN {rest} ELSE s.Q || {c} END WHEN {c} IN ('(', '[') THEN s.Q || {c}"
        f" WHEN {c} IN (')', ']') AND {top} IN ('(', '[') THEN {rest} ELSE s.Q END"
    )
    closes = "s.gl IN ('.', '?', '!')"
    then = (
        f"CASE WHEN s.st = 'INITIAL' THEN CASE WHEN s.Q <> '' THEN 'QUOTED' WHEN s.gd THEN 'ANY' ELSE 'UPPER' END"
        f" WHEN s.st = 'QUOTED' THEN CASE WHEN s.Q <> '' THEN 'QUOTED' WHEN {closes} THEN 'UPPER' WHEN s.gq OR s.en THEN 'ANY' ELSE 'LOWER' END"
        f" WHEN s.skip THEN 'ANY' WHEN s.Q <> '' THEN 'QUOTED' WHEN s.gt THEN 'ANY' WHEN s.st = 'UPPER' AND regexp_full_match(s.w, '[0-9]+') AND s.ad THEN 'ANY'"
        f" WHEN {closes} THEN 'UPPER' ELSE 'LOWER' END"
    )
    opens = "(CASE WHEN x.ns THEN false ELSE s.op END)"
    step = (
        f"{{'k': x.k, 't': x.t, 'ns': x.ns, 'st': CASE WHEN {word} THEN {then} ELSE s.st END, 'w': CASE WHEN {word} THEN x.t ELSE s.w END,"
        f" 'ms': CASE WHEN {word} THEN {opens} ELSE s.ms END, 'ad': CASE WHEN {word} THEN s.k <> '' AND NOT s.lw ELSE s.ad END, 'pend': {word},"
        f" 'skip': CASE WHEN {word} THEN false ELSE s.skip OR {skip_now} END, 'gq': CASE WHEN {word} THEN false ELSE s.gq OR ({mark} AND {c} IN {quotes}) END,"
        f" 'gl': CASE WHEN {word} THEN '' WHEN x.k = 'PUNCTUATION' AND {c} <> ',' THEN {c} ELSE s.gl END, 'gt': NOT {word} AND (s.gt OR x.t = chr(9)), 'gd': NOT {word} AND (s.gd OR x.t = '-'),"
        f" 'Q': {stack}, 'en': CASE WHEN {word} AND s.st = 'QUOTED' AND s.Q = '' THEN false WHEN {word} AND {normal} AND NOT s.skip AND s.Q = '' AND {closes} THEN true"
        f" WHEN {mark} AND {c} IN ('.', '!', '?') THEN true ELSE s.en END,"
        f" 'n7': s.n7 + {wrong}::BIGINT, 'n12': s.n12 + ({mark} AND {c} IN (')', ']') AND s.Q = '')::BIGINT,"
        f" 'op': CASE WHEN {word} THEN false ELSE {opens} OR (x.k = 'PUNCTUATION' AND x.t IN ('...', '.', ':', '…', '–', '—')) END, 'lw': x.k = 'WHITESPACE'}}"
    )
    units = f"SELECT {keys}, par, list({{'k': k, 't': t, 'ns': ns, {blank}}} ORDER BY i) AS u FROM (SELECT *, coalesce(lag(snt) OVER (PARTITION BY {keys}, par ORDER BY i) <> snt, true) AS ns FROM ({stream})) GROUP BY {keys}, par"
    start = "{'k': '', 't': '', 'ns': false, " + blank.replace("'st': ''", "'st': 'INITIAL'") + "}"
    folded = f"SELECT {keys}, list_reduce(u, lambda s, x: {step}, {start}) AS a FROM ({units})"
    capital = " UNION ALL ".join(f"SELECT {keys}, {code} AS error_code FROM (SELECT {keys}, unnest(range(0, a.n{code})) FROM folded)" for code in (7, 12))
    return f"WITH typed AS MATERIALIZED ({typed}), nearby AS ({some}), f AS ({foreign}), folded AS ({folded}) {local} UNION ALL {capital}"


def paragraph_tokens(table: str, keys: str) -> str:
    """Rows (keys, par, toks) of the lines of a table's texts that aren't empty."""
    lines = f"SELECT {keys}, doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS l, regexp_replace(unnest(string_split(text, chr(10))), '\\r$', '') AS p FROM {table}"
    return f"SELECT {keys}, doc_id::VARCHAR || ' ' || l AS par, {tokens('p')} AS toks FROM ({lines}) WHERE p <> ''"


def gradation(word: str, grade: str) -> tuple[str, str]:
    """(strong, weak) of a stem expression in a class expression; null where no rule fits."""
    c = inflect._C
    closed = f"length({word}) >= 3 AND regexp_matches({word}, '(?i)[^{c}][{c}]$')"
    strong, weak = [f"WHEN {grade} = '-' THEN {word}"], [f"WHEN {grade} = '-' THEN {word}"]
    for a, b in inflect._CLOSED:
        end = f"{a}([^{c}][{c}])$"
        strong.append(f"WHEN {closed} AND regexp_matches({word}, '{end}') THEN regexp_replace({word}, '{end}', '{b}\\1')")
        weak.append(f"WHEN {closed} AND regexp_matches({word}, '{end}') THEN {word}")
    for rules, own, other in ((inflect._TO_WEAK, strong, weak), (inflect._TO_STRONG, weak, strong)):
        for name, pairs in rules.items():
            for a, b in pairs:
                fits = f"WHEN {grade} = '{name}' AND length({word}) >= {inflect._SHORTEST[name]} AND regexp_matches({word}, '{a}$') THEN"
                by = b.replace("\\$", "\0").replace("$", "\\").replace("\0", "$")
                own.append(f"{fits} {word}")
                other.append(f"{fits} regexp_replace({word}, '{a}$', '{by}')")
    return f"CASE {' '.join(strong)} END", f"CASE {' '.join(weak)} END"


def gradation_letter(word: str, grade: str) -> str:
    c = inflect._C
    out = [f"WHEN {grade} = '-' THEN ''"]
    out += [f"WHEN regexp_matches({word}, '{end}[^{c}][{c}]$') THEN '{letter}'" for end, letter in inflect._LETTER_CLOSED]
    out += [f"WHEN {grade} = '{name}' AND regexp_matches({word}, '{end}$') THEN '{letter}'" for name, rules in inflect._LETTERS.items() for end, letter in rules]
    return f"CASE {' '.join(out)} WHEN {grade} = 'av6' THEN 'D' ELSE '' END"


def vowel_type(w: str) -> str:
    """BACK, FRONT or BOTH endings of a lower-case word expression without marks."""

    def last(letters: str) -> str:
        return f"CASE WHEN regexp_matches({w}, '[{letters}]') THEN length(regexp_extract({w}, '(?s)^(.*)[{letters}]', 1)) ELSE -1 END"

    b, f, y = last("aoåu"), last("äö"), last("y")
    return f"CASE WHEN {b} > -1 AND greatest({f}, {y}) = -1 THEN 'BACK' WHEN {b} = -1 THEN 'FRONT' WHEN {y} < greatest({b}, {f}) THEN CASE WHEN {b} > {f} THEN 'BACK' ELSE 'FRONT' END ELSE 'BOTH' END"
