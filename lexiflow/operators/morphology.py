"""Analyses of Finnish words from the tagged output of a lexicon.

An output such as ``[Lt][Xp]juosta[X]juoks[Tt][Ap]...`` is cut once into parts:
tags, marked stretches and surface characters. Every attribute is a rule over
that list of parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from ..sources.vfst import OUTPUTS, Transducer
from .spelling import LONGEST_WORD, Analysis, Analyzer, low, lowered, up, vowel

# fixed values: codes of the tags and what they stand for
CLASS = {
    "n": "nimisana", "l": "laatusana", "nl": "nimisana_laatusana", "h": "huudahdussana", "ee": "etunimi", "es": "sukunimi", "ep": "paikannimi",
    "em": "nimi", "t": "teonsana", "a": "lyhenne", "s": "seikkasana", "u": "lukusana", "ur": "lukusana", "r": "asemosana", "c": "sidesana",
    "d": "suhdesana", "k": "kieltosana", "p": "etuliite",
}
SIJAMUOTO = {
    "n": "nimento", "g": "omanto", "p": "osanto", "es": "olento", "tr": "tulento", "ine": "sisaolento", "ela": "sisaeronto", "ill": "sisatulento",
    "ade": "ulkoolento", "abl": "ulkoeronto", "all": "ulkotulento", "ab": "vajanto", "ko": "seuranto", "in": "keinonto", "sti": "kerrontosti",
    "ak": "kohdanto",
}
MOOD = {
    "n1": "A-infinitive", "n2": "E-infinitive", "n3": "MA-infinitive", "n4": "MINEN-infinitive", "n5": "MAINEN-infinitive", "t": "indicative",
    "e": "conditional", "k": "imperative", "m": "potential",
}
NUMBER = {"y": "singular", "m": "plural"}
PERSON = {"1": "1", "2": "2", "3": "3", "4": "4"}
TENSE = {"p": "present_simple", "i": "past_imperfective"}
FOCUS = {"kin": "kin", "kaan": "kaan"}
POSSESSIVE = {"1y": "1s", "2y": "2s", "1m": "1p", "2m": "2p", "3": "3"}
NEGATIVE = {"t": "true", "f": "false", "b": "both"}
COMPARISON = {"c": "comparative", "s": "superlative"}
PARTICIPLE = {"v": "present_active", "a": "present_passive", "u": "past_active", "t": "past_passive", "m": "agent", "e": "negation"}
# fixed values: attributes with a closed list of values
VALUES = {
    "CLASS": (
        "nimisana laatusana nimisana_laatusana teonsana seikkasana asemosana suhdesana huudahdussana sidesana etuliite lukusana lyhenne kieltosana"
        " etunimi sukunimi paikannimi nimi"
    ).split(),
    "NUMBER": ["singular", "plural"],
    "PERSON": ["1", "2", "3", "4"],
    "MOOD": "indicative conditional potential imperative A-infinitive E-infinitive MA-infinitive MINEN-infinitive MAINEN-infinitive".split(),
    "TENSE": ["present_simple", "past_imperfective"],
    "COMPARISON": ["positive", "comparative", "superlative"],
    "NEGATIVE": ["false", "true", "both"],
    "PARTICIPLE": "present_active present_passive past_active past_passive agent negation".split(),
    "POSSESSIVE": ["1s", "2s", "1p", "2p", "3"],
    "SIJAMUOTO": (
        "nimento omanto osanto olento tulento kohdanto sisaolento sisaeronto sisatulento ulkoolento ulkoeronto ulkotulento vajanto seuranto keinonto"
        " kerrontosti"
    ).split(),
    "FOCUS": ["läs", "kAAn", "kin", "hAn", "pA", "s"],
    "KYSYMYSLIITE": ["true"],
}


@dataclass(frozen=True)
class Part:
    """``kind``: C a character, T a tag (``text``: its code), X a marked stretch
    (``mark``: p, j, r, s, ...; ``text``: what it holds); ``at``: its place."""

    kind: str
    text: str
    at: int
    mark: str = ""


_PART = re.compile(r"\[X(?P<mark>[^\]])\](?P<held>[^\[]*)(?:\[X\])?|\[(?P<tag>[^\]]*)\]|(?P<char>[\s\S])")


def parts_of(output: str) -> list[Part]:
    out = []
    for m in _PART.finditer(output):
        if m["mark"] is not None:
            out.append(Part("X", m["held"], m.start(), m["mark"]))
        elif m["tag"] is not None:
            out.append(Part("T", m["tag"], m.start()))
        else:
            out.append(Part("C", m["char"], m.start()))
    return out


def is_valid(parts: list[Part]) -> bool:
    """Rules of compounds: a hyphen stands at a boundary exactly between equal
    vowels or after a digit, unless a tag allows or asks for one; and a proper
    noun doesn't end in a common noun."""
    older = last = ""
    bound = hyphen = free = just_free = wanted = lacking = proper = common = False
    skip = -1
    for i, p in enumerate(parts):
        if i <= skip:
            continue
        if p.kind == "X":
            continue
        if p.kind == "T":
            code = p.text
            if code.startswith("Isf"):
                free = just_free = True
            elif code.startswith("Icu"):
                bound, free, wanted = False, True, True
            elif code.startswith("Ica"):
                lacking = common = False
            elif code.startswith("Le"):
                proper, common = True, False
            elif code.startswith("Ln"):
                common = True
            elif code.startswith("Dg"):
                proper = False
            elif code == "Bh":
                bound, hyphen = True, False
                if lacking:
                    return False
                lacking = wanted
        elif p.text == "-":
            proper = common = False
            if i + 2 < len(parts) and parts[i + 1].kind == "T" and parts[i + 1].text == "Bh":
                bound = hyphen = True
                skip = i + 1
        else:
            if bound:
                if not last or older == "i" and last == "s":
                    free = True
                if wanted and hyphen:
                    wanted = False
                if not (free and hyphen):
                    last = low(last) if last else ""
                    needs = bool(last) and (last == low(p.text) and vowel(last) or last in "0123456789")
                    if needs != hyphen:
                        return False
                bound = False
                if just_free:
                    just_free = False
                else:
                    free = False
            older, last = last, p.text
    return not lacking and not (proper and common)


def structure_of(parts: list[Part], n: int, length: int) -> str:
    """STRUCTURE of a word of n characters whose output has ``length`` ones."""
    out, left = ["="], n
    seen = given = 0
    title = abbreviation = False

    def usual(k: int) -> None:
        nonlocal title
        for _ in range(k):
            out.append(("j" if abbreviation else "i") if title else "q" if abbreviation else "p")
            title = False

    def flush() -> None:
        nonlocal left, seen, given
        usual(seen - given)
        left = max(0, left - (seen - given))

    for i, p in enumerate(parts):
        if p.kind == "T" and p.text[:1] == "B" and len(p.text) == 2 and p.text != "Bh":
            if p.at == 1:
                out.append("=")
            if seen > given:
                flush()
            if p.at != 1 and p.at + 5 < length and out[-1] != "=":
                out.append("=")
            seen = given = 0
        elif p.kind == "X":
            if p.mark == "r":
                title = False
                for c in p.text:
                    if not left:
                        break
                    out.append(c)
                    given += c != "="
                    left -= c not in "=-"
        elif p.kind == "T":
            if p.text[:1] == "L":
                title |= p.text.startswith("Le")
                digit = p.text == "Lu" and i + 1 < len(parts) and parts[i + 1].text[:1] in tuple("0123456789")
                abbreviation = p.text.startswith("La") or p.text == "Lur" or digit
        elif p.text == "-":
            if seen > given:
                flush()
                out.append("-")
                seen = given = 0
            elif p.at:
                if seen == given:
                    out.append("-")
                else:
                    seen += 1
            left = max(0, left - 1)
            if len(out) == 1:
                out[0] = "-"
        elif p.text == ":":
            if abbreviation:
                if seen > given:
                    flush()
                    seen = given = 0
                abbreviation = False
            out.append(":")
            left = max(0, left - 1)
        else:
            seen += 1
    usual(left)
    return "".join(out)


def fixed_structure(structure: str, parts: list[Part]) -> str:
    """[Dg] makes the part after as many hyphens small, [De] a place name's start a capital."""
    s, hyphens, derived = list(structure), 0, False
    for i, p in enumerate(parts):
        if p.kind == "T":
            if p.text.startswith("Dg"):
                passed = 0
                for k, c in enumerate(s):
                    if c == "i" and passed == hyphens:
                        s[k] = "p"
                    passed += c == "-"
            elif p.text.startswith("De"):
                derived = True
            elif p.text == "Ln":
                derived = False
        elif p.kind == "C" and p.text == "-":
            hyphens += 1
            if derived and (i == len(parts) - 1 or any(q.kind == "T" and q.text == "Lep" for q in parts[i + 1 :])):
                k = next((k for k, c in enumerate(s) if c in "ip"), None)
                if k is not None:
                    s[k] = "i"
                    return "".join(s)
    return "".join(s)


def _numeral_base(parts: list[Part], prefix: str) -> str | None:
    out, passed, run = [prefix], False, False
    for i, p in enumerate(parts):
        if i == 0 and p.kind == "C" and p.text in "-0123456789":
            run = True
        if p.kind != "C" and run:
            run, passed = False, True
        if p.kind == "X":
            if p.mark in "pj":
                out.append(p.text)
                passed = True
            elif p.mark != "r" and not passed:
                out.append(p.text)
        elif p.kind == "T":
            if p.text == "Bc":
                if i == len(parts) - 1:
                    return None  # a prefix, not a numeral
                passed = False
            elif p.text in ("Ln", "Ll", "Lnl"):
                return None
        elif run or not passed or p.text == "-":
            out.append(p.text)
    return "".join(out)


def base_form(parts: list[Part], structure: str) -> str | None:
    """Surface characters in the case of STRUCTURE, the last marked base form
    put in the place of what follows it."""
    out: list[str] = []
    codes = iter(structure.replace("=", ""))
    base, start, held = "", 0, 0
    derived = skip_next = classed = False
    for i, p in enumerate(parts):
        if p.kind == "X":
            if p.mark in "pj":
                base, start, held = p.text, len(out), p.text.count("-")
        elif p.kind == "T":
            if p.text == "Lu" and not classed:
                classed = True
                found = _numeral_base(parts[i + 1 :], "".join(out))
                if found:
                    return found
            elif p.text == "De":
                derived = not skip_next
            elif p.text[:1] == "L":
                classed, derived = True, False
                skip_next = not p.text[1:].startswith(("l", "nl"))
        else:
            c = p.text
            if c == "-":
                if held:
                    held -= 1
                else:
                    ends_is = i >= 2 and parts[i - 2].text == "i" and parts[i - 1].text == "s"
                    if derived and base and not ends_is and any(q.kind == "T" and q.text == "Lep" for q in parts[i:]):
                        bare = base.replace("=", "")
                        out[start:] = up(bare[0]) + bare[1:] if bare else ""
                    base = ""
                derived = False
            code = next(codes, "")
            out.append(up(c) if code and code in "ij" else c)
    if base:
        out[start:] = base.replace("=", "")
    return "".join(out) or None


def attributes(parts: list[Part], output: str) -> Analysis:
    """What the tags say, read from the end: the last tag of a kind counts."""
    a: Analysis = {}
    sti = compound = classed = False
    for k in range(len(parts) - 1, -1, -1):
        p = parts[k]
        if p.kind != "T" or not p.text:
            continue
        kind, code = p.text[0], p.text[1:]
        cls = a.get("CLASS")
        nominal = cls not in ("etuliite", "seikkasana")
        if kind == "L":
            if not classed or not code:
                if code == "nl":
                    a["CLASS"] = "laatusana" if sti or a.get("COMPARISON") in COMPARISON.values() or output.startswith("[Lu]") else "nimisana_laatusana"
                elif code in CLASS:
                    a["CLASS"] = CLASS[code]
                classed = True
        elif kind == "N" and nominal and code in NUMBER:
            a.setdefault("NUMBER", NUMBER[code])
        elif kind == "P" and code in PERSON:
            a.setdefault("PERSON", PERSON[code])
        elif kind == "S" and nominal and "SIJAMUOTO" not in a:
            if code in SIJAMUOTO:
                a["SIJAMUOTO"] = SIJAMUOTO[code]
            sti |= code == "sti"
        elif kind == "T" and cls is None and code in MOOD:
            a.setdefault("MOOD", MOOD[code])
        elif kind == "A" and code in TENSE:
            a.setdefault("TENSE", TENSE[code])
        elif kind == "F":
            if code == "ko":
                a["KYSYMYSLIITE"] = "true"
            elif code in FOCUS:
                a.setdefault("FOCUS", FOCUS[code])
        elif kind == "O" and code in POSSESSIVE:
            a.setdefault("POSSESSIVE", POSSESSIVE[code])
        elif kind == "C" and cls is None and code in COMPARISON:
            a.setdefault("COMPARISON", COMPARISON[code])
        elif kind == "E" and code in NEGATIVE:
            a.setdefault("NEGATIVE", NEGATIVE[code])
        elif kind == "R":
            if not compound and code in PARTICIPLE and (cls in (None, "laatusana") or output.endswith("[Ln]")):
                a.setdefault("PARTICIPLE", PARTICIPLE[code])
        elif kind == "I":
            _info(a, code, output, p.at)
        elif kind == "B" and code.startswith("c") and p.at >= 5:
            if not classed and cls is None and (output[p.at - 1] == "-" or output.startswith("-[Bh]", p.at - 5)):
                a["CLASS"], classed = "etuliite", True
            compound = True
        if p.at < 3:
            break
    return a


def _info(a: Analysis, code: str, output: str, at: int) -> None:
    cls = a.get("CLASS")
    if code == "vj" and not output.startswith("-"):
        a["MALAGA_VAPAA_JALKIOSA"] = "true"
    elif code == "ca" and cls in (None, "nimisana") and "[Bc]" not in output[at:] and "[Ll]" not in output[at:]:
        a["POSSIBLE_GEOGRAPHICAL_NAME"] = "true"
    elif code in ("ra", "rm") and cls in (None, "teonsana") and a.get("MOOD") not in ("E-infinitive", "MINEN-infinitive", "MA-infinitive"):
        a["REQUIRE_FOLLOWING_VERB"] = "A-infinitive" if code == "ra" else "MA-infinitive"


def finished(a: Analysis) -> Analysis:
    """Attributes that depend on each other."""
    a = dict(a)
    cls = a.get("CLASS")
    if cls not in (None, "teonsana") or a.get("MOOD") in ("MINEN-infinitive", "E-infinitive", "MA-infinitive"):
        a.pop("NEGATIVE", None)
    if a.get("PARTICIPLE") == "past_passive":
        a["CLASS"] = cls = "laatusana"
    if a.get("SIJAMUOTO") == "kerrontosti":
        a.pop("NUMBER", None)
    if "COMPARISON" not in a:
        if cls in ("laatusana", "nimisana_laatusana"):
            a["COMPARISON"] = "positive"
    elif cls == "nimisana":
        del a["COMPARISON"]
    return a


def organisation(a: Analysis, parts: list[Part], output: str) -> Analysis | None:
    """The same word as an organisation's name, where its last part may end one."""
    if a.get("CLASS") != "nimisana" or len(output) < 13 or output.startswith(("-", "[La]")):
        return None
    end = output.rfind("[Ion]", 8)
    late = output.rfind("[Bc]", 8)
    if end < 0 or late > end or output.rfind("[Bc]", 4, end) < 0:
        return None
    s = a["STRUCTURE"]
    s = s[:1] + "i" + s[2:] if len(s) > 1 else s
    new = {k: v for k, v in a.items() if k != "POSSIBLE_GEOGRAPHICAL_NAME"} | {"CLASS": "nimi", "STRUCTURE": s}
    if base := base_form(parts, s):
        new["BASEFORM"] = base
    return new


def word_parts(parts: list[Part]) -> tuple[str, str | None]:
    """WORDBASES and WORDIDS: ``+form(base)`` and ``+form(wid)`` for each part."""
    bases, ids = [""], [""]
    xp = xs = ""
    inside = numbered = False
    base_at = id_at = 0

    def close() -> None:
        nonlocal xp, xs
        if xs:
            ids[0] += f"(w{xs})"
        if xp:
            bases[0] += f"({xp})"
        xp = xs = ""

    for i, p in enumerate(parts):
        nxt = parts[i + 1] if i + 1 < len(parts) else None
        if p.kind == "T" and p.text[:1] == "L":
            inside = False
            close()
        elif p.kind == "C" and p.text == "-" and nxt is not None and nxt.kind == "T" and nxt.text[:1] == "B":
            inside = False
            close()
            bases[0] += "+-"
            ids[0] += "+-"
        elif p.kind == "X":
            if p.mark == "s":
                xs, numbered = p.text, True
            elif p.mark == "p":
                xp = p.text
            elif p.mark == "j":
                if inside:
                    close()
                    base_at, id_at = len(bases[0]), len(ids[0])
                xp = f"+{p.text}" if p.text else ""
        elif p.kind == "C":
            if not inside:
                bases[0] += "+"
                ids[0] += "+"
                base_at, id_at, inside = len(bases[0]), len(ids[0]), True
            bases[0] += p.text
            ids[0] += p.text
    if xp:
        b, d = bases[0][:base_at], ids[0][:id_at]
        if b.endswith("+") and xp.startswith("+"):
            b, d = b[:-1], d[:-1]
        plain = xp.replace("=", "")
        bases[0], ids[0] = f"{b}{plain}({xp})", d + plain
    if xs:
        ids[0] += f"(w{xs})"
    return bases[0], ids[0] if numbered else None


def analysis_of(output: str, n: int) -> list[Analysis]:
    """Analyses that one lexicon output gives for a word of n characters."""
    parts = parts_of(output)
    if not is_valid(parts):
        return []
    s = fixed_structure(structure_of(parts, n, len(output)), parts)
    a = finished(attributes(parts, output) | {"STRUCTURE": s})
    twin = organisation(a, parts, output)
    a["FSTOUTPUT"] = output
    if base := base_form(parts, s):
        a["BASEFORM"] = base
    a["WORDBASES"], ids = word_parts(parts)
    if ids:
        a["WORDIDS"] = ids
    return [a, twin] if twin else [a]


def automaton_analyzer(data: bytes) -> Callable[[], Analyzer]:
    """Makes the analyzer of a tagged VFST lexicon, one per worker."""

    def make() -> Analyzer:
        made = _WORKER.get(data)
        if made is None:
            made = _WORKER[data] = _analyzer(Transducer(data))
        return made

    return make


_WORKER: dict[bytes, Analyzer] = {}


def _analyzer(lexicon: Transducer) -> Analyzer:
    def analyze(word: str) -> list[Analysis]:
        if len(word) > LONGEST_WORD:
            return []
        out: list[Analysis] = []
        for i, (text, _, _) in enumerate(lexicon.lookup(lowered(word))):
            if i == OUTPUTS:
                break
            out += analysis_of(text, len(word))
        return out

    return analyze


def table_analyzer(rows: dict[str, list[Analysis]]) -> Callable[[], Analyzer]:
    """Makes an analyzer of a small lexicon by lower-case surface."""
    return lambda: lambda word: rows.get(lowered(word), [])


_STORED: dict[str, frozenset[str]] = {}


def stored_analyzer(path: str, column: str = "surface") -> Callable[[], Analyzer]:
    """Makes an analyzer of a lexicon written as Parquet where all executors
    read it: nouns in the nominative, small letters only. One per worker."""

    def make() -> Analyzer:
        if path not in _STORED:
            from pyarrow import dataset, fs

            store, folder = fs.FileSystem.from_uri(path)
            known: set[str] = set()
            for b in dataset.dataset(folder, filesystem=store, format="parquet").to_batches(columns=[column]):
                known.update(b.column(0).to_pylist())
            _STORED[path] = frozenset(known)
        words = _STORED[path]

        def analyze(word: str) -> list[Analysis]:
            if (word if word.lower() == word else lowered(word)) not in words:
                return []
            return [{"STRUCTURE": "=" + "p" * len(word), "CLASS": "nimisana", "SIJAMUOTO": "nimento"}]

        return analyze

    return make


def attribute_values(spark):
    """Dimension (attribute, ordinal, value) of the attributes with closed lists."""
    return spark.createDataFrame([(a, i, v) for a, values in VALUES.items() for i, v in enumerate(values)], "attribute string, ordinal int, value string")


def tag_codes(spark):
    """Dimension (kind, code, value) of the tags' codes."""
    kinds = {"L": CLASS, "S": SIJAMUOTO, "T": MOOD, "N": NUMBER, "P": PERSON, "A": TENSE, "F": FOCUS, "O": POSSESSIVE, "E": NEGATIVE, "C": COMPARISON, "R": PARTICIPLE}
    return spark.createDataFrame([(k, c, v) for k, codes in kinds.items() for c, v in codes.items()], "kind string, code string, value string")
