"""Stemmers: Porter's of 1980 with two later suffixes, and Savoy's light one for French."""

from __future__ import annotations

import re



def _form(word: str) -> str:
    """The word as c's and v's: y is a consonant at the start and after a vowel."""
    out = []
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _form(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return len(word) > 2 and _form(word)[-3:] == "cvc" and word[-1] not in "wxy"


_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def porter(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if "v" in _form(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _form(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, _STEP4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[-4] in "st"):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


#: Suffix, length that the word must exceed, what takes its place; the first that fits is the last but for trice.
_FRENCH = [
    ("issement", 9, "ii"), ("issant", 8, "ii"), ("ement", 6, "e"), ("ive", 5, "if"), ("ficatrice", 11, "fier"), ("ficateur", 10, "fier"), ("catrice", 9, "qu"),
    ("cateur", 8, "qu"), ("atrice", 8, "er"), ("ateur", 7, "er"), ("trice", 6, "teur"), ("ation", 8, ""), ("ition", 8, "ie"), ("ième", 5, ""), ("teuse", 7, "ter"),
    ("teur", 6, "ter"), ("euse", 5, "eu"), ("ère", 8, "er"), ("ese", 7, ""), ("welt", 6, "welt"), ("aux", 5, "al"),
]
_PLAIN = str.maketrans("àáâôèéêùûîç", "aaaoeeeuuic")


def french_light(word: str) -> str:
    w = word
    if len(w) > 5 and w.endswith("x"):
        w = w[:-3] + "al" if w.endswith("aux") and w[-4] != "e" else w[:-1]
    if len(w) > 3 and w[-1] in "xs":
        w = w[:-1]
    for suffix, length, new in _FRENCH:
        if len(w) > length and w.endswith(suffix):
            w = w[: -len(suffix)] + new
            if suffix == "ement" and len(w) > 3 and w.endswith("ive"):
                w = w[:-2] + "f"
            if suffix != "trice":
                break
    if len(w) > 4:
        w = w.translate(_PLAIN)
        w = "".join(c for i, c in enumerate(w) if not (i and c == w[i - 1] and c.isalpha()))
    if len(w) > 4 and w.endswith("ie"):
        w = w[:-2]
    if len(w) > 4:
        for end in "ree":
            w = w[:-1] if w.endswith(end) else w
        if w[-1:] == w[-2:-1] and w[-1:].isalpha():
            w = w[:-1]
    return w
