"""Attributes of analyses as treebank features, and comparison with a treebank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: attribute, feature, values (others stay as they are)
FEATURES = [
    ("NUMBER", "Number", {"singular": "Sing", "plural": "Plur"}),
    (
        "SIJAMUOTO",
        "Case",
        {
            "nimento": "Nom", "omanto": "Gen", "osanto": "Par", "sisaolento": "Ine", "sisaeronto": "Ela", "sisatulento": "Ill", "ulkoolento": "Ade",
            "ulkoeronto": "Abl", "ulkotulento": "All", "olento": "Ess", "tulento": "Tra", "seuranto": "Com", "kohdanto": "Acc", "keinonto": "Ins",
            "vajanto": "Abe",
        },
    ),
    ("POSSESSIVE", "Person[psor]", {"1s": "1", "2s": "2", "1p": "1", "2p": "2"}),
    ("POSSESSIVE", "Number[psor]", {"1s": "Sing", "2s": "Sing", "1p": "Plur", "2p": "Plur"}),
    ("COMPARISON", "Degree", {"positive": "Pos", "comparative": "Cmp", "superlative": "Sup"}),
    ("PERSON", "Person", {}),
    ("TENSE", "Tense", {"present_simple": "Pres", "past_imperfective": "Past"}),
    ("MOOD", "Mood", {"indicative": "Ind", "conditional": "Cnd", "potential": "Pot", "imperative": "Imp"}),
    ("FOCUS", "Clitic", {"kin": "Kin", "kaan": "Kaan"}),
    ("PARTICIPLE", "PartForm", {"present_active": "Pres", "past_active": "Past", "agent": "Agt", "present_passive": "Pres", "past_passive": "Past"}),
    ("PARTICIPLE", "Voice", {"present_active": "Act", "past_active": "Act", "agent": "Act", "present_passive": "Pass", "past_passive": "Pass"}),
]


def features(a: Column) -> Column:
    """Map of treebank features of an attribute map; null values are left out."""
    pairs: list[Column] = []
    for attribute, name, values in FEATURES:
        v = F.element_at(a, attribute)
        table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv)) if values else None
        pairs += [F.lit(name), F.coalesce(F.element_at(table, v), v) if table is not None else v]
    mood = F.element_at(a, "MOOD")
    infinitive = mood.isin("A-infinitive", "E-infinitive")
    has = F.element_at(a, "PARTICIPLE").isNotNull()
    pairs += [F.lit("VerbForm"), F.when(has, "Part").when(infinitive, "Inf")]
    pairs += [F.lit("InfForm"), F.when(mood == "A-infinitive", "1").when(mood == "E-infinitive", "2")]
    pairs += [F.lit("Derivation"), F.when(mood == "MINEN-infinitive", "Minen")]
    made = F.create_map(*pairs)
    made = F.when(F.element_at(a, "KYSYMYSLIITE").isNotNull(), F.map_concat(F.map_filter(made, lambda k, v: k != "Clitic"), F.create_map(F.lit("Clitic"), F.lit("Ko")))).otherwise(made)
    return F.map_filter(made, lambda k, v: v.isNotNull())


def treebank_differences(bank: DataFrame, analysed: DataFrame) -> DataFrame:
    """Tokens of a treebank (form, lemma, feats) whose only analysis has another lemma or features.

    ``analysed``: (form, analyses). Words with several readings, or none, don't count.
    """
    one = analysed.where(F.size("analyses") == 1).select("form", F.col("analyses")[0].alias("a")).dropDuplicates(["form"])
    ours = one.select("form", F.element_at("a", "BASEFORM").alias("our_lemma"), features(F.col("a")).alias("our_feats"))
    other = F.map_filter("our_feats", lambda k, v: F.element_at("feats", k).isNotNull() & (F.element_at("feats", k) != v))
    return bank.join(ours, "form").withColumn("differing", other).where((F.col("lemma") != F.col("our_lemma")) | (F.size("differing") > 0))
