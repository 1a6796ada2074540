"""Snowball stemmers for English and Spanish, from the published algorithm descriptions.

Words come lower-case and, for Spanish, without accents (n with a tilde stays), as the tokeniser
leaves them; suffix tables are therefore given without accents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# ---- regions


def _regions(word: str, vowels: str) -> tuple[int, int]:
    """Starts of R1 and R2: after the first non-vowel behind a vowel, and again from there."""

    def after(start: int) -> int:
        for i in range(start + 1, len(word)):
            if word[i] not in vowels and word[i - 1] in vowels:
                return i + 1
        return len(word)

    r1 = after(0)
    return r1, after(r1)


def _longest(word: str, suffixes) -> str:
    return next((s for s in sorted(suffixes, key=len, reverse=True) if word.endswith(s)), "")


# ---- English (Porter2)

_EN_VOWELS = "aeiouy"
_EN_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EN_LI = "cdeghkmnrt"
# exceptional forms of the published algorithm (fixed values)
_EN_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_EN_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_EN_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al",
    "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_EN_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_EN_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")


def _short_syllable(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _EN_VOWELS and word[1] not in _EN_VOWELS
    return len(word) > 2 and word[-1] not in _EN_VOWELS + "wxY" and word[-2] in _EN_VOWELS and word[-3] not in _EN_VOWELS


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _EN_SPECIAL:
        return _EN_SPECIAL[word]
    word = word.lstrip("'")
    marked = list(word)
    for i, ch in enumerate(marked):
        if ch == "y" and (i == 0 or marked[i - 1] in _EN_VOWELS):
            marked[i] = "Y"
    word = "".join(marked)
    start = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), 0)
    r1, r2 = _regions(word, _EN_VOWELS)
    if start:
        r1 = start
        r2 = next((i + 1 for i in range(r1 + 1, len(word)) if word[i] not in _EN_VOWELS and word[i - 1] in _EN_VOWELS), len(word))
    has_vowel = lambda part: any(c in _EN_VOWELS for c in part)

    # 1a: plurals
    s = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        word = word[:-2]
    elif s in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif s == "s" and has_vowel(word[:-2]):
        word = word[:-1]
    if word in _EN_KEPT:
        return word

    # 1b: past and present participles
    s = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(word) - len(s) >= r1:
            word = word[: -len(s)] + "ee"
    elif s and has_vowel(word[: -len(s)]):
        word = word[: -len(s)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_EN_DOUBLE):
            word = word[:-1]
        elif r1 >= len(word) and _short_syllable(word):
            word += "e"

    # 1c: y after a consonant that is not the first letter
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _EN_VOWELS:
        word = word[:-1] + "i"

    s = _longest(word, (*_EN_STEP2, "ogi", "li"))
    if s and len(word) - len(s) >= r1:
        if s == "ogi":
            word = word[:-1] if word.endswith("logi") else word
        elif s == "li":
            word = word[:-2] if word[-3:-2] and word[-3] in _EN_LI else word
        else:
            word = word[: -len(s)] + _EN_STEP2[s]

    s = _longest(word, (*_EN_STEP3, "ative"))
    if s and len(word) - len(s) >= r1:
        if s == "ative":
            word = word[:-5] if len(word) - 5 >= r2 else word
        else:
            word = word[: -len(s)] + _EN_STEP3[s]

    s = _longest(word, (*_EN_STEP4, "ion"))
    if s and len(word) - len(s) >= r2 and (s != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(s)]

    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_syllable(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


# ---- Spanish

_ES_VOWELS = "aeiou"
_ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_ES_BEFORE_PRONOUN = "ando iendo ar er ir".split()
_ES_STEP1 = {
    "drop": "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split(),
    "ic": "adora ador acion adoras adores aciones ante antes ancia ancias".split(),
    "log": "logia logias".split(), "u": "ucion uciones".split(), "ente": "encia encias".split(), "amente": ["amente"], "mente": ["mente"], "idad": "idad idades".split(), "iv": "iva ivo ivas ivos".split(),
}
_ES_Y = "ya ye yan yen yeron yendo yo yas yes yais yamos".split()
_ES_E = "en es eis emos".split()
_ES_VERB = (
    "arian arias aran aras ariais aria areis ariamos aremos ara are erian erias eran eras eriais eria ereis eriamos eremos era ere irian irias iran iras iriais iria ireis iriamos "
    "iremos ira ire aba ada ida ia ara iera ad ed id ase iese aste iste an aban ian aran ieran asen iesen aron ieron ado ido ando iendo io ar er ir as abas adas idas ias aras ieras "
    "ases ieses is ais abais iais arais ierais aseis ieseis asteis isteis ados idos amos abamos iamos imos aramos ieramos iesemos asemos"
).split()
_ES_RESIDUAL = "os a o".split()


def _rv(word: str) -> int:
    """Start of the region that verb suffixes are looked for in."""
    if len(word) < 3:
        return len(word)
    if word[1] not in _ES_VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] in _ES_VOWELS), len(word))
    if word[0] in _ES_VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in _ES_VOWELS), len(word))
    return 3


def spanish(word: str) -> str:
    r1, r2 = _regions(word, _ES_VOWELS)
    rv = _rv(word)
    room = lambda s, region: len(word) - len(s) >= region

    # 0: attached pronouns after a gerund or infinitive
    s = _longest(word[rv:], _ES_PRONOUNS)
    if s:
        rest = word[: -len(s)]
        before = _longest(rest[rv:], _ES_BEFORE_PRONOUN)
        if before or (rest[rv:].endswith("yendo") and rest.endswith("uyendo")):
            word = rest

    # 1: standard suffixes
    done = False
    s = _longest(word, [x for group in _ES_STEP1.values() for x in group])
    kind = next((k for k, group in _ES_STEP1.items() if s in group), "") if s else ""
    if kind == "amente":
        if room(s, r1):
            word, done = word[:-6], True
            for x in ("iv", "os", "ic", "ad"):
                if word.endswith(x) and room(x, r2):
                    word = word[: -len(x)]
                    if x == "iv" and word.endswith("at") and room("at", r2):
                        word = word[:-2]
                    break
    elif kind and room(s, r2):
        done = True
        word = word[: -len(s)]
        if kind == "ic" and word.endswith("ic") and room("ic", r2):
            word = word[:-2]
        elif kind in ("log", "u", "ente"):
            word += kind
        elif kind == "mente":
            x = _longest(word, ("ante", "able", "ible"))
            if x and room(x, r2):
                word = word[: -len(x)]
        elif kind == "idad":
            x = _longest(word, ("abil", "ic", "iv"))
            if x and room(x, r2):
                word = word[: -len(x)]
        elif kind == "iv" and word.endswith("at") and room("at", r2):
            word = word[:-2]

    # 2: verb suffixes, if nothing went before
    if not done:
        s = _longest(word[rv:], _ES_Y)
        if s and word[: -len(s)].endswith("u"):
            word = word[: -len(s)]
        else:
            s = _longest(word[rv:], [*_ES_VERB, *_ES_E])
            if s:
                word = word[: -len(s)]
                if s in _ES_E and word.endswith("gu"):
                    word = word[:-1]

    # 3: residual suffixes
    s = _longest(word[rv:], _ES_RESIDUAL)
    if s:
        word = word[: -len(s)]
    elif word[rv:].endswith("e"):
        word = word[:-1]
        if word.endswith("gu") and word[rv:].endswith("u"):
            word = word[:-1]
    return word


STEMMERS = {"english": english, "spanish": spanish}


def stems(terms: DataFrame, column: str, language: str) -> DataFrame:
    """(column, stem) of the distinct terms: the stemmer runs once a term, not once an occurrence."""
    fn = STEMMERS[language]

    @F.pandas_udf("string")
    def stem(s: pd.Series) -> pd.Series:
        return s.map(fn)

    return terms.select(column).distinct().withColumn("stem", stem(column))
