"""The English (Porter2) stemmer, from its published description."""

from __future__ import annotations

VOWELS = frozenset("aeiouy")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDS = frozenset("cdeghkmnrt")
# Whole words with stems of their own, and words that step 1a leaves finished.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINISHED = frozenset("inning outing canning herring earring proceed exceed succeed".split())
REGION_PREFIXES = ("gener", "commun", "arsen")
# Endings and what takes their place, longest first where one ends another.
STEP_2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"),
    ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"),
    ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP_3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"),
    ("ness", ""), ("ful", ""),
)
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _region(word: str, start: int) -> int:
    """After the first non-vowel that follows a vowel."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _short_syllable(word: str) -> bool:
    """Whether the word ends in one."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS and word[-1] not in "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def _has_vowel(word: str) -> bool:
    return any(c in VOWELS for c in word)


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = word.removeprefix("'")
    # a y that is a consonant is written Y
    marked = "".join("Y" if c == "y" and (i == 0 or word[i - 1] in VOWELS) else c for i, c in enumerate(word))
    word = marked
    prefix = next((p for p in REGION_PREFIXES if word.startswith(p)), None)
    r1 = len(prefix) if prefix else _region(word, 0)
    r2 = _region(word, r1)

    for ending in ("'s'", "'s", "'"):
        if word.endswith(ending):
            word = word[: -len(ending)]
            break

    # 1a: plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _has_vowel(word[:-2]):
        word = word[:-1]
    if word in FINISHED:
        return word

    # 1b: past and continuous forms
    for ending in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if word.endswith(ending):
            base = word[: -len(ending)]
            if ending in ("eedly", "eed"):
                if len(base) >= r1:
                    word = base + "ee"
            elif _has_vowel(base):
                word = base
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif word.endswith(DOUBLES):
                    word = word[:-1]
                elif r1 >= len(word) and _short_syllable(word):
                    word += "e"
            break

    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    # 2
    for ending, instead in STEP_2:
        if word.endswith(ending):
            base = word[: -len(ending)]
            if len(base) >= r1 and not (ending == "ogi" and not base.endswith("l")) and not (ending == "li" and base[-1:] not in LI_ENDS):
                word = base + instead
            break

    # 3
    for ending, instead in STEP_3:
        if word.endswith(ending):
            base = word[: -len(ending)]
            if len(base) >= (r2 if ending == "ative" else r1):
                word = base + instead
            break

    # 4
    for ending in STEP_4:
        if word.endswith(ending):
            base = word[: -len(ending)]
            if len(base) >= r2 and (ending != "ion" or base.endswith(("s", "t"))):
                word = base
            break

    # 5
    if word.endswith("e"):
        base = word[:-1]
        if len(base) >= r2 or (len(base) >= r1 and not _short_syllable(base)):
            word = base
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
