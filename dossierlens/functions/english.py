"""English (Porter2) stemming of a vocabulary, as column expressions.

Each step of the published algorithm is one projection over the distinct words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import computed_once

# Fixed values of the published algorithm.
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_1A = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
R1_PREFIXES = ["gener", "commun", "arsen"]
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}
STEP4 = dict.fromkeys(
    ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
     "ism", "ate", "iti", "ous", "ive", "ize", "ion"], ""
)
PAST = ["eed", "eedly", "ed", "edly", "ing", "ingly"]
VOWELS = "[aeiouy]"
FIRST_REGION = "^.*?[aeiouy][^aeiouy]"
SHORT_END = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
DOUBLE_END = "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
POSSESSIVE = "('s'|'s|')$"
CONSONANT_Y = "(^|[aeiouy])y"


def longest_first(endings) -> list[str]:
    return sorted(endings, key=lambda e: (-len(e), e))


def _base(word: Column, ending: str | int) -> Column:
    """``word`` without an ending of that length."""
    n = ending if isinstance(ending, int) else len(ending)
    return F.substr(word, F.lit(1), F.length(word) - n)


def _by_ending(word: Column, cases: dict[str, Column]) -> Column:
    """The case of the longest ending that fits, or the word."""
    chosen = F
    for ending in longest_first(cases):
        chosen = chosen.when(F.endswith(word, F.lit(ending)), cases[ending])
    return chosen.otherwise(word)


def _region_end(word: Column) -> Column:
    found = F.length(F.regexp_extract(word, "(?s)" + FIRST_REGION, 0))
    return F.when(found > 0, found).otherwise(F.length(word))


def stems(terms: DataFrame) -> DataFrame:
    """``(term, stem)`` of every row of ``terms(term)``."""
    term, w, r1, r2 = (F.col(c) for c in ("term", "w", "r1", "r2"))

    def cut(endings: dict[str, str], region: Column, more: dict[str, Column]) -> Column:
        """Endings replaced where they lie in the region, some on a further condition."""
        cases = {}
        for ending, new in endings.items():
            allowed = more.get(ending, F.length(w) - len(ending) >= region)
            cases[ending] = F.when(allowed, F.concat(_base(w, ending), F.lit(new))).otherwise(w)
        return _by_ending(w, cases)

    def step(df: DataFrame, word: Column) -> DataFrame:
        return df.select("term", "r1", "r2", word.alias("w"))

    plain = F.regexp_replace(F.replace(term, F.lit("’"), F.lit("'")), "^'", "")
    rows = terms.select("term", F.regexp_replace(plain, CONSONANT_Y, "$1Y").alias("w"))
    prefixed = F
    for prefix in R1_PREFIXES:
        prefixed = prefixed.when(F.startswith(w, F.lit(prefix)), len(prefix))
    rows = rows.select("term", "w", prefixed.otherwise(_region_end(w)).alias("r1"))
    rows = rows.select("term", "w", "r1", (r1 + _region_end(F.substr(w, r1 + 1))).alias("r2"))

    rows = step(rows, F.regexp_replace(w, POSSESSIVE, ""))
    rows = step(rows, _by_ending(w, {
        "sses": _base(w, 2),
        "ied": F.when(F.length(w) > 4, _base(w, 2)).otherwise(_base(w, 1)),
        "ies": F.when(F.length(w) > 4, _base(w, 2)).otherwise(_base(w, 1)),
        "us": w,
        "ss": w,
        "s": F.when(_base(w, 2).rlike(VOWELS), _base(w, 1)).otherwise(w),
    }))
    rows = rows.withColumn("kept", F.when(w.isin(KEPT_AFTER_1A), w))

    def past(ending: str) -> Column:
        base = _base(w, ending)
        if ending.startswith("eed"):
            return F.when(F.length(base) >= r1, F.concat(base, F.lit("ee"))).otherwise(w)
        return (
            F.when(~base.rlike(VOWELS), w)
            .when(base.rlike("(at|bl|iz)$"), F.concat(base, F.lit("e")))
            .when(base.rlike(DOUBLE_END), _base(base, 1))
            .when((F.length(base) <= r1) & base.rlike(SHORT_END), F.concat(base, F.lit("e")))
            .otherwise(base)
        )

    kept = rows.select("term", "kept", "w", "r1", "r2")

    def next_step(df: DataFrame, word: Column) -> DataFrame:
        return df.select("term", "kept", "r1", "r2", word.alias("w"))

    rows = next_step(kept, _by_ending(w, {e: past(e) for e in PAST}))
    rows = next_step(rows, F.when(w.rlike("^.+[^aeiouy][yY]$"), F.concat(_base(w, 1), F.lit("i"))).otherwise(w))
    in_r1, in_r2 = F.length(w) - 3 >= r1, F.length(w) - 3 >= r2
    rows = next_step(rows, cut(STEP2, r1, {
        "ogi": in_r1 & F.endswith(w, F.lit("logi")),
        "li": (F.length(w) - 2 >= r1) & w.rlike("[cdeghkmnrt]li$"),
    }))
    rows = next_step(rows, cut(STEP3, r1, {"ative": F.length(w) - 5 >= r2}))
    rows = next_step(rows, cut(STEP4, r2, {"ion": in_r2 & w.rlike("[st]ion$")}))
    short = _base(w, 1)
    rows = next_step(rows, (
        F.when(
            F.endswith(w, F.lit("e")),
            F.when((F.length(short) >= r2) | (F.length(short) >= r1) & ~short.rlike(SHORT_END), short).otherwise(w),
        )
        .when(F.endswith(w, F.lit("ll")) & (F.length(short) >= r2), short)
        .otherwise(w)
    ))
    whole = F.create_map(*[F.lit(x) for pair in WHOLE_WORDS.items() for x in pair])
    stem = F.when(F.length(term) <= 2, term).otherwise(F.coalesce(F.try_element_at(whole, term), "kept", F.replace(w, F.lit("Y"), F.lit("y"))))
    # Behind a generator, so that filters on stems do not copy all steps into themselves.
    return rows.select("term", computed_once(stem).alias("stem"))
