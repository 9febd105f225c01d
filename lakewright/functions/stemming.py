"""The Porter stemmer (1980) for English terms, applied to distinct vocabulary only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Endings and what takes their place, by step; a measure over 0 (steps 2 and 3) or 1 (step 4) is needed.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """v and c for each letter."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        cut = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e) and "v" in _shape(word[: -len(e)])), None)
        if cut is not None:
            if cut.endswith(("at", "bl", "iz")) or (_measure(cut) == 1 and _short_end(cut)):
                word = cut + "e"
            else:
                word = cut[:-1] if _double_end(cut) and cut[-1] not in "lsz" else cut
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        ending = max((e for e in table if word.endswith(e)), key=len, default=None)
        if ending and _measure(word[: -len(ending)]):
            word = word[: -len(ending)] + table[ending]
    ending = max((e for e in [*STEP4, "ion"] if word.endswith(e)), key=len, default=None)
    if ending and _measure(word[: -len(ending)]) > 1 and (ending != "ion" or word[-4] in "st"):
        word = word[: -len(ending)]
    if word.endswith("e"):
        rest = word[:-1]
        word = rest if _measure(rest) > 1 or (_measure(rest) == 1 and not _short_end(rest)) else word
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def stem_terms(terms: DataFrame) -> DataFrame:
    """(term, stem) of a frame of distinct terms."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"term": frame.term, "stem": [stem(t) for t in frame.term]})

    return terms.select("term").mapInPandas(run, "term string, stem string")
