"""The few functions that no built-in expresses, as Arrow functions over batches: Porter stems, strings of nested JSON."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The suffix tables of Porter's published algorithm, steps 2, 3 and 4.
STEP2 = dict(
    pair.split(":") for pair in
    "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate"
    " ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split()
)
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def bound_batches(spark: SparkSession, rows: int = 500, size: str = "8m") -> None:
    """Keeps the memory of a Python worker bounded whatever the length of the rows. Both limits hold when a plan runs, so
    they stay in the session; they change no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def _shape(word: str) -> str:
    """Vowels and consonants as v and c; y is a vowel behind a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or ch == "y" and i > 0 and out[i - 1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def porter(word: str) -> str:
    """The stem of a lower-case word by Porter's algorithm."""
    if len(word) < 3:
        return word
    for suffix, put in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + put
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            stem = word[: len(word) - len(suffix)]
            if word.endswith(suffix) and "v" in _shape(stem):
                if stem.endswith(("at", "bl", "iz")):
                    word = stem + "e"
                elif len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c" and stem[-1] not in "lsz":
                    word = stem[:-1]
                elif _measure(stem) == 1 and _short_end(stem):
                    word = stem + "e"
                else:
                    word = stem
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        found = max((s for s in table if word.endswith(s)), key=len, default=None)
        if found and _measure(word[: -len(found)]) > 0:
            word = word[: -len(found)] + table[found]
    found = max((s for s in STEP4 if word.endswith(s)), key=len, default=None)
    if found:
        stem = word[: -len(found)]
        if _measure(stem) > 1 and (found != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short_end(word[:-1]):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def porter_words(words: Column) -> Column:
    """The stems of an array of words. Stemming has no built-in; words repeat, so a worker keeps those it has seen."""

    @F.pandas_udf("array<string>")
    def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}
        for batch in batches:
            if len(known) > 500_000:
                known.clear()
            yield batch.map(lambda ws: None if ws is None else [known.get(w) or known.setdefault(w, porter(w)) for w in ws])

    return stems(words)
