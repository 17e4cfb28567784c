"""English (Porter2) stemming of single words, from the published algorithm.

Word by word and without Spark, to compare the column expressions with.
"""

from __future__ import annotations

import re

# Fixed values of the published algorithm.
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_1A = {
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed",
}
R1_PREFIXES = ("gener", "commun", "arsen")
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
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ism", "ate", "iti", "ous", "ive", "ize", "ion",
)
LI_ENDINGS = "cdeghkmnrt"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

_VOWEL = re.compile(r"[aeiouy]")
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_POSSESSIVE = re.compile(r"(?:'s'|'s|')$")
_CONSONANT_Y = re.compile(r"(^|[aeiouy])y")


def _longest_first(endings) -> tuple[str, ...]:
    return tuple(sorted(endings, key=len, reverse=True))


_ENDINGS_1A = _longest_first(("sses", "ied", "ies", "us", "ss", "s"))
_ENDINGS_1B = _longest_first(("eed", "eedly", "ed", "edly", "ing", "ingly"))
_ENDINGS_2, _ENDINGS_3, _ENDINGS_4 = map(_longest_first, (STEP2, STEP3, STEP4))


def _ending(word: str, endings: tuple[str, ...]) -> str:
    """The first of ``endings`` that ``word`` ends with, or an empty string."""
    if word.endswith(endings):
        for end in endings:
            if word.endswith(end):
                return end
    return ""


def _region(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in WHOLE_WORDS:
        return WHOLE_WORDS[word]
    word = word.replace("’", "'").removeprefix("'")
    if "y" in word:
        word = _CONSONANT_Y.sub(r"\1Y", word)

    prefix = next((p for p in R1_PREFIXES if word.startswith(p)), "") if word.startswith(R1_PREFIXES) else ""
    r1 = len(prefix) or _region(word, 0)
    r2 = _region(word, r1)

    word = _plural(_POSSESSIVE.sub("", word) if "'" in word else word)
    if word in KEPT_AFTER_1A:
        return word
    word = _past_and_gerund(word, r1)
    if len(word) > 2 and word[-1] in "yY" and not _VOWEL.match(word[-2]):
        word = word[:-1] + "i"
    word = _suffix_2(word, r1)
    word = _suffix_3(word, r1, r2)
    word = _suffix_4(word, r2)
    word = _final(word, r1, r2)
    return word.replace("Y", "y")


def _plural(word: str) -> str:
    end = _ending(word, _ENDINGS_1A)
    if end == "sses":
        return word[:-2]
    if end in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    if end == "s" and _VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _past_and_gerund(word: str, r1: int) -> str:
    end = _ending(word, _ENDINGS_1B)
    if not end:
        return word
    base = word[: -len(end)]
    if end in ("eed", "eedly"):
        return base + "ee" if len(base) >= r1 else word
    if not _VOWEL.search(base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base.endswith(DOUBLES):
        return base[:-1]
    if len(base) <= r1 and _SHORT_END.search(base):
        return base + "e"
    return base


def _suffix_2(word: str, r1: int) -> str:
    end = _ending(word, _ENDINGS_2)
    base = word[: len(word) - len(end)]
    if not end or len(base) < r1:
        return word
    if end == "ogi" and not base.endswith("l"):
        return word
    if end == "li" and base[-1:] not in tuple(LI_ENDINGS):
        return word
    return base + STEP2[end]


def _suffix_3(word: str, r1: int, r2: int) -> str:
    end = _ending(word, _ENDINGS_3)
    base = word[: len(word) - len(end)]
    if not end or len(base) < (r2 if end == "ative" else r1):
        return word
    return base + STEP3[end]


def _suffix_4(word: str, r2: int) -> str:
    end = _ending(word, _ENDINGS_4)
    base = word[: len(word) - len(end)]
    if not end or len(base) < r2:
        return word
    if end == "ion" and not base.endswith(("s", "t")):
        return word
    return base


def _final(word: str, r1: int, r2: int) -> str:
    base = word[:-1]
    if word.endswith("e"):
        if len(base) >= r2 or (len(base) >= r1 and not _SHORT_END.search(base)):
            return base
    elif word.endswith("ll") and len(base) >= r2:
        return base
    return word
