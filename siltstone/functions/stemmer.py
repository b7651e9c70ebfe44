"""English stemming by the published Porter2 (Snowball English) algorithm."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = "aeiouy"
V, C = f"[{VOWELS}]", f"[^{VOWELS}]"
FIRST = re.compile(f"{V}{C}")
SHORT_END = re.compile(f"(?:{C}{V}[^{VOWELS}wxY]|^{V}{C})$")
# ---- Fixed values of the algorithm. ----
PREFIXES = ("gener", "commun", "arsen")
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
STEP_3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 start."""
    r1 = next((len(p) for p in PREFIXES if w.startswith(p)), None)
    if r1 is None:
        m = FIRST.search(w)
        r1 = m.end() if m else len(w)
    m = FIRST.search(w, r1)
    return r1, m.end() if m else len(w)


def stem(word: str) -> str:
    """The stem of a lower-case word; words of two letters or fewer stay."""
    if len(word) <= 2:
        return word
    w = word.lstrip("'")
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    # A y at the start or after a vowel is a consonant.
    w = re.sub(f"^y|(?<={V})y", "Y", w)
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # Step 1a: plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(V, w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w.lower()
    # Step 1b: -ed, -ing and their adverbs.
    if w.endswith(("eedly", "eed")):
        cut = 5 if w.endswith("eedly") else 3
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                if re.search(V, w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(DOUBLES):
                        w = w[:-1]
                    elif r1 >= len(w) and SHORT_END.search(w):
                        w += "e"
                break
    # Step 1c: y after a consonant that is not the first letter.
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for s, to in STEP_2:
        if w.endswith(s):
            if len(w) - len(s) >= r1 and (s != "ogi" or w.endswith("logi")) and (s != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
                w = w[: -len(s)] + to
            break
    for s, to in STEP_3:
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if s == "ative" else r1):
                w = w[: -len(s)] + to
            break
    for s in STEP_4:
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    # Step 5: a last e or l.
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not SHORT_END.search(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@F.pandas_udf(T.StringType())
def stem_column(words: pd.Series) -> pd.Series:
    """Stems of a column of distinct words; null stays null."""
    return words.map(stem, na_action="ignore")
