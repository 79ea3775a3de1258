"""Tokens, trigrams and English stems."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: English stop words ---------------------------------------------------------------------
STOP_WORDS = frozenset("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it
its itself they them their theirs themselves what which who whom this that these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over under again further
then once here there when where why how all any both each few more most other some such no nor not only own same so
than too very s t can will just don should now
""".split())


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script, in order (the analysed form of search text)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of `text`, each padded with two blanks in front and one behind."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)
    padded = F.transform(F.array_distinct(runs), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    per_word = F.transform(padded, lambda p: F.transform(
        F.sequence(F.lit(1), F.length(p) - 2), lambda i: p.substr(i, F.lit(3))))
    return F.array_distinct(F.flatten(per_word))


_VOWELS = frozenset("aeiouy")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI_ENDING = frozenset("cdeghkmnrt")
# fixed values: suffix tables of the English (Porter2) stemming rules
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("ousness", "ous"), ("iveness", "ive"), ("fulness", "ful"),
          ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
          ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"),
          ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
          ("ogi", "og"), ("li", ""))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"),
          ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize",
          "ion", "al", "er", "ic")
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
               "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
               "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias",
               "andes": "andes"}
_UNTOUCHED_AFTER_1A = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed",
                                 "succeed"))


def _region(word: str, start: int) -> int:
    """Index after the first non-vowel that follows a vowel, looking from `start`."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return (len(word) > 2 and word[-1] not in _VOWELS and word[-1] not in "wxY"
            and word[-2] in _VOWELS and word[-3] not in _VOWELS)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """English stem of a lower-case word by the published Porter2 rules."""
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    chars = list(word)
    for i, ch in enumerate(chars):
        if ch == "y" and (i == 0 or chars[i - 1] in "aeiouy"):
            chars[i] = "Y"
    word = "".join(chars)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = _region(word, 0) if r1 is None else r1
    r2 = _region(word, r1)

    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith(("us", "ss")):
        pass
    elif word.endswith("s") and any(c in _VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in _UNTOUCHED_AFTER_1A:
        return word

    # past tense and gerund
    if word.endswith(("eedly", "eed")):
        cut = 5 if word.endswith("eedly") else 3
        if len(word) - cut >= r1:
            word = word[:-cut] + "ee"
    else:
        for suffix in ("ingly", "edly", "ing", "ed"):
            if word.endswith(suffix):
                base = word[: -len(suffix)]
                if any(c in _VOWELS for c in base):
                    word = base
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif word.endswith(_DOUBLES):
                        word = word[:-1]
                    elif len(word) <= r1 and _short_end(word):
                        word += "e"
                break

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"

    for suffix, new in _STEP2:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            allowed = (not (suffix == "ogi" and not base.endswith("l"))
                       and not (suffix == "li" and base[-1:] not in _LI_ENDING))
            if len(base) >= r1 and allowed:
                word = base + new
            break
    for suffix, new in _STEP3:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if len(base) >= (r2 if suffix == "ative" else r1):
                word = base + new
            break
    for suffix in _STEP4:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if len(base) >= r2 and (suffix != "ion" or base[-1:] in ("s", "t")):
                word = base
            break

    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


@F.pandas_udf(T.StringType())
def stem_column(token: pd.Series) -> pd.Series:
    """Stems of a token column; each distinct token of a batch is stemmed once."""
    return token.map({t: stem(t) for t in token.dropna().unique()})
