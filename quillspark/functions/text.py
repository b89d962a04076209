"""Text functions: folding, terms, stemming, keyword queries, token estimates."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import constants as C


def _folding() -> tuple[str, str]:
    """Letters whose canonical decomposition starts with another letter, and those letters."""
    marked, plain = [], []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(p) for p in parts[1:]) and unicodedata.category(chr(code))[0] == "L":
            marked.append(chr(code))
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _folding()


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    low = F.lower(text)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, _MARKED, _PLAIN)).otherwise(low)


def pieces(text: Column) -> Column:
    """Folded runs of letters and digits, in order, with a blank piece where a text starts or ends with none."""
    return F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{Co}]+")


def terms(text: Column) -> Column:
    """Folded runs of letters and digits, in order."""
    return F.filter(pieces(text), lambda t: t != "")


def fold_text(text: str) -> str:
    return text.lower().translate(str.maketrans(_MARKED, _PLAIN))


def phrases(query: str) -> list[list[str]]:
    """Phrases of a keyword query: each blank-separated token of two characters or more, as its terms."""
    out = []
    for token in query.split():
        if len(token) > 1:
            out.append(re.findall(r"[^\W_]+", fold_text(token)))
    return out


def match_expression(query: Column) -> Column:
    """Quoted tokens joined by OR; empty if no token has two characters."""
    tokens = F.filter(F.split(F.trim(query), r"\s+"), lambda t: F.length(t) > 1)
    return F.array_join(F.transform(tokens, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


def token_estimate(text: Column) -> Column:
    """Words times 1.3, rounded up."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.ceil(words * F.lit(C.TOKENS_PER_WORD)).cast("long")


class Porter:
    """The published suffix-stripping algorithm (Porter, 1980) for lower-case words."""

    STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
    STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
    STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
    LONGEST = 64
    ENDS2, ENDS3, ENDS4 = (tuple(a for a, _ in STEP2), tuple(a for a, _ in STEP3), tuple(STEP4))

    @staticmethod
    def _shape(word: str) -> str:
        out = ""
        for i, ch in enumerate(word):
            vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
            out += "v" if vowel else "c"
        return out

    @classmethod
    def _measure(cls, word: str) -> int:
        return len(re.findall("v+c", cls._shape(word)))

    @classmethod
    def _double(cls, word: str) -> bool:
        return len(word) > 1 and word[-1] == word[-2] and cls._shape(word)[-1] == "c"

    @classmethod
    def _cvc(cls, word: str) -> bool:
        return cls._shape(word)[-3:] == "cvc" and word[-1] not in "wxy"

    @classmethod
    def stem(cls, word: str) -> str:
        if len(word) < 3 or len(word) > cls.LONGEST or not word.isascii() or not word.isalpha():
            return word
        w = word
        # plurals and participles
        if w.endswith("sses") or w.endswith("ies"):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("eed"):
            if cls._measure(w[:-3]) > 0:
                w = w[:-1]
        else:
            for suffix in ("ed", "ing"):
                if w.endswith(suffix) and "v" in cls._shape(w[: -len(suffix)]):
                    w = w[: -len(suffix)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif cls._double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif cls._measure(w) == 1 and cls._cvc(w):
                        w += "e"
                    break
        if w.endswith("y") and "v" in cls._shape(w[:-1]):
            w = w[:-1] + "i"
        for table, ends in ((cls.STEP2, cls.ENDS2), (cls.STEP3, cls.ENDS3)):
            if w.endswith(ends):  # most words have none of the suffixes
                a, b = max(((a, b) for a, b in table if w.endswith(a)), key=lambda x: len(x[0]))
                if cls._measure(w[: -len(a)]) > 0:
                    w = w[: -len(a)] + b
        if w.endswith(cls.ENDS4):
            a = max((a for a in cls.STEP4 if w.endswith(a)), key=len)
            rest = w[: -len(a)]
            if cls._measure(rest) > 1 and (a != "ion" or rest.endswith(("s", "t"))):
                w = rest
        if w.endswith("e"):
            m = cls._measure(w[:-1])
            if m > 1 or (m == 1 and not cls._cvc(w[:-1])):
                w = w[:-1]
        if w.endswith("ll") and cls._measure(w) > 1:
            w = w[:-1]
        return w


def _stemmed(words: pd.Series) -> pd.Series:
    return words.map(Porter.stem)


def stem(words: Column) -> Column:
    """Stems of words. The UDF is built by call: once used it holds a JVM handle, which a module pickled by value can't carry."""
    return F.pandas_udf(_stemmed, T.StringType())(words)
