"""English stems by the published Porter2 rules.

Stemming is per word, so it runs once per distinct word when a vocabulary is
built, never on running text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# Words the rules treat specially.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
}
UNCHANGED = "sky news howe atlas cosmos bias andes".split()
KEPT_AFTER_PLURAL = "inning outing canning herring earring proceed exceed succeed".split()
# Suffix and replacement, longest suffix first within a step.
STEP_2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"),
    ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"),
    ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
STEP_3 = [
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""),
    ("ical", "ic"), ("ness", ""), ("ful", ""),
]
STEP_4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()

_VOWEL = "[aeiouy]"
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _after_region(word: str, start: int) -> int:
    """Where the part after the first vowel and non-vowel begins."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def english_stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii():
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    if word in UNCHANGED:
        return word
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    special = re.match(r"gener|commun|arsen", w)
    r1 = special.end() if special else _after_region(w, 0)
    r2 = _after_region(w, r1)

    # Plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_VOWEL, w[:-2]):
        w = w[:-1]
    if w in KEPT_AFTER_PLURAL:
        return w

    # Past and continuous forms.
    ending = re.search(r"(eedly|eed|ingly|edly|ing|ed)$", w)
    if ending and ending[0] in ("eed", "eedly"):
        if ending.start() >= r1:
            w = w[: ending.start()] + "ee"
    elif ending and re.search(_VOWEL, w[: ending.start()]):
        w = w[: ending.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT_END.search(w):
            w += "e"
    w = re.sub(r"(?<=[^aeiouy])(?<!^.)[yY]$", "i", w) if len(w) > 2 else w

    def longest(rules: list[tuple[str, str]]) -> tuple[str, str] | None:
        return next((rule for rule in rules if w.endswith(rule[0])), None)

    rule = longest(STEP_2)
    if rule and len(w) - len(rule[0]) >= r1:
        stem = w[: -len(rule[0])]
        allowed = {"ogi": stem.endswith("l"), "li": stem.endswith(tuple("cdeghkmnrt"))}
        if allowed.get(rule[0], True):
            w = stem + rule[1]
    rule = longest(STEP_3)
    if rule and len(w) - len(rule[0]) >= (r2 if rule[0] == "ative" else r1):
        w = w[: -len(rule[0])] + rule[1]
    rule = longest([(s, "") for s in STEP_4])
    if rule and len(w) - len(rule[0]) >= r2 and (rule[0] != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(rule[0])]

    # A final e, or one l of two.
    if w.endswith("e"):
        place = len(w) - 1
        if place >= r2 or (place >= r1 and not _SHORT_END.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stem(term: Column) -> Column:
    """Stem of a lowercase word."""

    @F.arrow_udf(T.StringType())
    def run(terms: pa.Array) -> pa.Array:
        return pa.array([None if t is None else english_stem(t) for t in terms.to_pylist()], pa.string())

    return run(term)
