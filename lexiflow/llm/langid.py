"""Language identification in two steps: family, then language.

Texts are counts of hashed byte bigrams and trigrams (letters lower-cased,
everything else of ASCII a blank), of length one. Linear support vector
machines, one for each pair, vote first among the language families and then
among the languages of the winning family, whose machines are trained on that
family alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stable, unused

#: Rows that training takes at most, over all languages in equal parts.
SAMPLE = 3000
BITS = 12
#: Letters without case and bytes of other scripts stay; other ASCII is a blank.
_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_PIECE = 1 << 20
UNKNOWN = "und"
#: ISO 639-1 codes by family; a code that isn't listed is of the family "other".
FAMILIES = {
    "germanic": "af da de en fy is nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu se",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
    "turkic": "az kk tr uz",
    "east asian": "ja ko zh",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], "other")


def has_letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Unit vector of 2**BITS hashed bigram and trigram counts of the whole text."""
    out = np.zeros(1 << BITS)
    for i in range(0, len(text), _PIECE):
        # pieces overlap by two characters so that no trigram is lost
        data = np.frombuffer(f" {text[max(0, i - 2) : i + _PIECE].lower()} ".encode().translate(_BYTES), np.uint8).astype(np.uint32)
        two = data[:-1] * np.uint32(0x9E3779B1) + data[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0x27D4EB2F) + data[2:] * np.uint32(0xC2B2AE3D)
        for h in (two, three):
            h ^= h >> np.uint32(15)
            out += np.bincount((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    norm = np.sqrt(out @ out)
    return (out / norm if norm else out).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss (the last one is the
    bias), by dual coordinate descent in a fixed order; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    w, a = np.zeros(x.shape[1]), np.zeros(len(x))
    # classes weigh the same whatever their sizes are
    diag = np.where(y > 0, (y > 0).sum(), (y < 0).sum()) * 2.0 / len(y) / (2 * cost)
    square = (x * x).sum(1) + diag
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (w @ x[i]) - 1 + diag[i] * a[i]
            new = max(0.0, a[i] - g / square[i])
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            break
    return w.astype(np.float32)


def _pairwise(x: np.ndarray, labels: np.ndarray) -> tuple[list[str], dict[tuple[int, int], np.ndarray]]:
    names = sorted(set(labels.tolist()))
    made = {}
    for i, j in combinations(range(len(names)), 2):
        rows = (labels == names[i]) | (labels == names[j])
        made[i, j] = train_svm(x[rows], np.where(labels[rows] == names[i], 1, -1))
    return names, made


@dataclass
class Model:
    """Machines for the families and for the languages of each."""

    families: tuple[list[str], dict] = field(default_factory=lambda: ([], {}))
    languages: dict[str, tuple[list[str], dict]] = field(default_factory=dict)

    @staticmethod
    def _vote(x: np.ndarray, side: tuple[list[str], dict]) -> tuple[np.ndarray, np.ndarray]:
        """Winners (most pairs won, then the larger sum of margins) and their least margin."""
        names, machines = side
        won, total = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
        least = np.full((len(x), len(names)), 4.0)
        for (i, j), w in machines.items():
            m = x @ w[:-1] + w[-1]
            for k, v in ((i, m), (j, -m)):
                won[:, k] += v > 0
                total[:, k] += v
                least[:, k] = np.minimum(least[:, k], v)
        best = np.array([max(range(len(names)), key=lambda k: (won[r, k], total[r, k], -k)) for r in range(len(x))], np.int64)
        return best, least[np.arange(len(x)), best]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if has_letters(t)] if self.languages else []
        for at in range(0, len(rows), 512):
            part = np.array(rows[at : at + 512])
            x = np.stack([features(texts[i]) for i in part])
            group, far = self._vote(x, self.families)
            for k in np.unique(group):
                own = np.flatnonzero(group == k)
                side = self.languages[self.families[0][k]]
                best, near = self._vote(x[own], side)
                sure = 1 / (1 + np.exp(-2 * np.minimum(far[own], near)))
                for r, b, s in zip(own, best, sure, strict=True):
                    lang[part[r]], score[part[r]] = side[0][b], float(s)
        return lang, score


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled rows that aren't held out.

    Every language gives the same number of rows at most, those whose hashed id
    comes first; of more than half as many languages as rows the most frequent
    are learnt. Only a share of the hash range that follows from a language's
    count is ranked, so one that most rows have isn't gathered anywhere.
    Vectors of whole texts, not texts, come to the driver.
    """
    rows = stable(docs).select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    usable = (~held_out("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    narrow = rows.where(usable).select("uid", "lang", F.xxhash64("id").alias("h"))
    # a language gives two rows at least, so there is room for half as many languages: the largest, ties by name
    counts = narrow.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(max(1, sample // 2))
    langs = counts.collect()
    if not langs:
        return Model()
    most = max(2, sample // len(langs))
    # a share of the hash range with about four times the rows wanted, whatever a language's size
    place = F.pmod("h", F.lit(1 << 24))
    share = F.ceil(F.lit(4.0 * (1 << 24) * most) / F.col("count")) + 64
    near = narrow.join(F.broadcast(counts), "lang").where(place < share)
    order = Window.partitionBy("lang").orderBy(place, "h", "uid")
    # no language has more rows than `most`, so there are `sample` uids at most
    chosen = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("uid")
    picked = rows.join(F.broadcast(chosen.limit(2 * sample)), "uid")

    @F.arrow_udf("binary")
    def vector(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()).astype(np.float16).tobytes() if has_letters(t.as_py()) else None for t in texts], pa.binary())

    got = [r for r in picked.select("uid", "lang", vector("text").alias("v")).collect() if r["v"] is not None]
    if not got:
        return Model()
    got.sort(key=lambda r: (r["lang"], r["uid"]))
    x = np.stack([np.frombuffer(r["v"], np.float16) for r in got]).astype(np.float32)
    labels = np.array([r["lang"] for r in got], object)
    group = np.array([family(x) for x in labels], object)
    return Model(_pairwise(x, group), {g: _pairwise(x[group == g], labels[group == g]) for g in set(group.tolist())})


def predicted(docs: DataFrame, model: Model, text_col: str = "text", into: str = "found") -> DataFrame:
    """``docs`` with a struct column (lang_pred, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def found(texts: pa.Array) -> pa.Array:
        out: list[dict] = []
        for at in range(0, len(texts), 1024):
            lang, score = sent.value.predict(texts.slice(at, 1024).to_pylist())
            out += [{"lang_pred": a, "score": b} for a, b in zip(lang, score, strict=True)]
        return pa.array(out, pa.struct([("lang_pred", pa.string()), ("score", pa.float64())]))

    return docs.withColumn(into, found.asNondeterministic()(F.col(text_col)))


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    ``lang_pred`` is a language of the training rows, or ``und`` with score 0
    for a null text, a text without letters, and where there was nothing to
    learn from. ``score`` grows with the least margin of the winner. A null id
    isn't held out. Equal texts and repeated rows get equal answers; texts of
    any length are read whole; columns of other names aren't read; no rows give
    no rows.
    """
    model = model or train(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return predicted(rows, model).select("doc_id", held_out("doc_id").alias("held_out"), "found.*")


def keep_identified(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the documents that have no letters; same columns.

    Every other document gets a language where there was something to learn
    from, and stays whatever it is; with an empty model all of them stay too.
    """
    model = model or train(docs, id_col, text_col, lang_col)
    if not model.languages:

        @F.arrow_udf("boolean")
        def lettered(texts: pa.Array) -> pa.Array:
            return pa.array([has_letters(t) for t in texts.to_pylist()], pa.bool_())

        return docs.where(lettered(F.col(text_col)))
    name = unused(docs, "found")
    return predicted(docs, model, text_col, name).where(F.col(name)["lang_pred"] != UNKNOWN).drop(name)
