"""English (Porter2) stemming of term arrays: each distinct word of a slice of a batch is stemmed once."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the published algorithm.
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_S = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion",
    "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate",
    "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
_STEP3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic",
    "ness": "", "ful": "",
}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize",
          "ion", "al", "er", "ic")
_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT_END = re.compile("(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _after(word: str, start: int) -> int:
    hit = _REGION.search(word, start)
    return hit.end() if hit else len(word)


def _longest(word: str, suffixes) -> str | None:
    return next((s for s in suffixes if word.endswith(s)), None)


@lru_cache(maxsize=1 << 17)
def stem_word(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word.removeprefix("'")
    if w in _WHOLE:
        return _WHOLE[w]
    w = re.sub("(^|[aeiouy])y", r"\1Y", w)
    fixed = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = fixed if fixed is not None else _after(w, 0)
    r2 = _after(w, r1)

    tail = _longest(w, ("'s'", "'s", "'"))
    w = w[: -len(tail)] if tail else w

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _AFTER_S:
        return w

    tail = _longest(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if tail in ("eed", "eedly"):
        if len(w) - len(tail) >= r1:
            w = w[: -len(tail)] + "ee"
    elif tail and re.search("[aeiouy]", w[: -len(tail)]):
        w = w[: -len(tail)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT_END.search(w):
            w += "e"

    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    tail = _longest(w, _STEP2)
    if tail and len(w) - len(tail) >= r1:
        before = w[: -len(tail)]
        if tail == "li":
            w = before if before[-1:] in tuple("cdeghkmnrt") else w
        elif tail != "ogi" or before.endswith("l"):
            w = before + _STEP2[tail]

    tail = _longest(w, _STEP3)
    if tail and len(w) - len(tail) >= (r2 if tail == "ative" else r1):
        w = w[: -len(tail)] + _STEP3[tail]

    tail = _longest(w, _STEP4)
    if tail and len(w) - len(tail) >= r2 and (tail != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(tail)]

    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# Terms that a Python worker stems together.
SLICE_TERMS = 1 << 17


def row_slices(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Runs of rows with about ``limit`` entries each, one row at least."""
    total = np.cumsum(sizes)
    cuts, start = [], 0
    while start < len(sizes):
        end = max(int(np.searchsorted(total, (total[start - 1] if start else 0) + limit, side="right")), start + 1)
        cuts.append((start, end))
        start = end
    return cuts


def _stemmed(terms: pa.ListArray) -> pa.ListArray:
    coded = terms.flatten().dictionary_encode()
    stems = pa.array([stem_word(w) for w in coded.dictionary.to_pylist()], pa.string())
    flat = stems.take(coded.indices)
    lengths = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.r_[0, lengths.cumsum()], pa.int32())
    return pa.ListArray.from_arrays(offsets, flat)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_terms(terms: pa.Array) -> pa.Array:
    sizes = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    parts = [_stemmed(terms.slice(a, b - a)) for a, b in row_slices(sizes, SLICE_TERMS)]
    return pa.concat_arrays(parts) if parts else _stemmed(terms)
