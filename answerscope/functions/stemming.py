"""The Porter stemmer, from the published algorithm with the usual later extensions.

Small per-word helper: it is called once per distinct word of a Python worker (the
cache), never per occurrence.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Words whose stem is listed rather than derived.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

# Suffix tables of steps 2, 3 and 4 (longest alternatives first per ending).
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"),
    ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """The word as a string of c (consonant) and v (vowel)."""
    out: list[str] = []
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _ends_cvc(word: str) -> bool:
    shape = _shape(word)
    if len(word) == 2:
        return shape == "vc"
    return shape[-3:] == "cvc" and word[-1] not in "wxy"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix) and "v" in _shape(w[: -len(suffix)]):
            stem = w[: -len(suffix)]
            break
    else:
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double_end(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _ends_cvc(stem) else stem


def _final_y(w: str) -> str:
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        return w[:-1] + "i"
    return w


def _table(w: str, rules) -> str:
    for suffix, new in rules:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + new if _measure(stem) > 0 else w
    return w


def _step2(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _step2(w[:-2])
    if w.endswith("logi"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    return _table(w, STEP2)


def _step4(w: str) -> str:
    for suffix in STEP4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            keep = _measure(stem) <= 1 or (suffix == "ion" and stem[-1:] not in ("s", "t"))
            return w if keep else stem
    return w


def _step5(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _ends_cvc(stem)):
            w = stem
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@lru_cache(maxsize=1 << 17)
def porter_stem(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _final_y(_past(_plural(word)))
    return _step5(_step4(_table(_step2(w), STEP3)))


def stem_token(token: str) -> str:
    """Only tokens longer than three characters are stemmed."""
    return porter_stem(token) if len(token) > 3 else token
