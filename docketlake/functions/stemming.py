"""English stems by a table of rules: steps of (suffix, what takes its place, conditions on what stands before it).

In each step the first suffix, in the order given, that a word ends with decides: the first of its rules whose
conditions hold is applied, or none. Conditions are R1 and R2 (the suffix stands behind the first, or the second,
non-vowel after a vowel) and patterns, which a ``!`` turns round. The published English rules of Snowball.
"""

from __future__ import annotations

import re
from functools import lru_cache

V, N = "[aeiouy]", "[^aeiouy]"
R1, R2 = "R1", "R2"
#: After these beginnings R1 starts, wherever else it would.
LONG = "^(?:gener|commun|arsen)"
SHORT_END = f"(?:{N}{V}[^aeiouywxY]|^{V}{N})$"
SHORT_WORD = f"^(?:{N}+{V}[^aeiouywxY]|{V}{N})$"

#: Stems of their own, and words that stay after the first step.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
    themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or
    because as until while of at by for with about against between into through during before after above below to from up down in out on off over under
    again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t
    can will just don should now""".split()
)

Rule = tuple[str, str, tuple[str, ...]]
PLURALS: list[Rule] = [("sses", "ss", ()), ("ied", "i", ("..",)), ("ied", "ie", ()), ("ies", "i", ("..",)), ("ies", "ie", ()), ("us", "us", ()), ("ss", "ss", ()), ("s", "", (f"{V}.",))]
#: A star marks a word that has lost its ending.
ENDINGS: list[Rule] = [("eedly", "ee", (R1,)), ("ingly", "*", (V,)), ("edly", "*", (V,)), ("eed", "ee", (R1,)), ("ing", "*", (V,)), ("ed", "*", (V,))]
MENDED: list[Rule] = [("at*", "ate", ()), ("bl*", "ble", ()), ("iz*", "ize", ()), *[(f"{c}{c}*", c, ()) for c in "bdfgmnprt"], ("*", "e", (SHORT_WORD,)), ("*", "", ())]
FINAL_Y: list[Rule] = [("y", "i", (f".{N}$",)), ("Y", "i", (f".{N}$",))]
SECOND: list[Rule] = [
    *[(s, t, (R1,)) for s, t in (("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"))],
    ("ogi", "og", (R1, "l$")), ("li", "", (R1, "[cdeghkmnrt]$")),
]
THIRD: list[Rule] = [*[(s, t, (R1,)) for s, t in (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"))], ("ative", "", (R2,)), ("ical", "ic", (R1,)), ("ness", "", (R1,)), ("ful", "", (R1,))]
FOURTH: list[Rule] = [*[(s, "", (R2,)) for s in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize")], ("ion", "", (R2, "[st]$")), *[(s, "", (R2,)) for s in ("al", "er", "ic")]]
FIFTH: list[Rule] = [("e", "", (R2,)), ("e", "", (R1, f"!{SHORT_END}")), ("l", "", (R2, "l$"))]
STEPS = [PLURALS, ENDINGS, MENDED, FINAL_Y, SECOND, THIRD, FOURTH, FIFTH]


def region(condition: str, long: bool) -> str:
    """The pattern that what stands before a suffix in R1 or R2 meets."""
    if condition == R1:
        return LONG if long else V + N
    return f"{LONG}.*?{V}{N}" if long else f"{V}{N}.*?{V}{N}"


def holds(condition: str, rest: str, long: bool) -> bool:
    if condition in (R1, R2):
        return re.search(region(condition, long), rest) is not None
    return (re.search(condition.lstrip("!"), rest) is None) == condition.startswith("!")


#: The suffixes of each step's rules.
ENDINGS = [tuple(dict.fromkeys(s for s, _, _ in step)) for step in STEPS]


def applied(word: str, rules: list[Rule], endings: tuple[str, ...], long: bool) -> str:
    if not word.endswith(endings):
        return word
    ending = next(s for s in endings if word.endswith(s))
    rest = word[: len(word) - len(ending)]
    for suffix, new, conditions in rules:
        if suffix == ending and all(holds(c, rest, long) for c in conditions):
            return rest + new
    return word


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in EXCEPTIONS or len(word) < 3:
        return EXCEPTIONS.get(word, word)
    long = re.search(LONG, word) is not None
    word = re.sub(f"({V})y", r"\1Y", re.sub("^y", "Y", word))
    for step, endings in zip(STEPS, ENDINGS):
        word = applied(word, step, endings, long)
        if step is PLURALS and word in KEPT:
            return word
    return word.replace("Y", "y")
