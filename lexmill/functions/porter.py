"""Porter's stemming algorithm (Porter 1980, with the published departures of its reference program), and folding of marks."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Suffix -> replacement of steps 2 and 3, suffixes of step 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(w: str) -> str:
    """c for consonants and v for vowels."""
    out = ""
    for i, ch in enumerate(w):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[i - 1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _short_end(w: str) -> bool:
    return len(w) >= 3 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _double(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _longest(w: str, ends) -> str | None:
    return max((s for s in ends if w.endswith(s)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = "ed" if w.endswith("ed") else "ing" if w.endswith("ing") else None
        if cut and "v" in _shape(w[: -len(cut)]):
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, STEP4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def fold(text: str) -> str:
    """Lower case without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def stemmed(tokens: pd.Series) -> pd.Series:
    """Folded and stemmed form of each token; a vocabulary's distinct tokens are what it is for."""
    return tokens.map(lambda t: None if t is None else stem(fold(t)))
