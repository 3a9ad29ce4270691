"""Stemming and phonetic codes with rules too long for expressions, run in Python on distinct terms only."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def on_distinct_terms(postings: DataFrame, term: str, fn: Callable[[str], str], out: str = "stem") -> DataFrame:
    """(term, out): a word function applied once to each distinct term, to be joined back by term."""
    stem = F.pandas_udf(lambda s: pd.Series([None if t is None else fn(t) for t in s], dtype=object), "string")
    return postings.select(term).distinct().withColumn(out, stem(F.col(term)))


def word_filter(fn: Callable[[str], str], protected: frozenset[str] = frozenset(), beside: bool = False) -> Callable[[Column], Column]:
    """A word function as a token filter, in Arrow batches; each distinct word of a worker is worked out once.

    Protected words stay as they are. beside: the result stands behind each word instead of in its place (phonetic codes);
    one that is empty or no different isn't added.
    """

    def apply(rows: pd.Series) -> pd.Series:
        known: dict[str, str | None] = {}
        out = []
        for tokens in rows:
            if tokens is None:
                out.append(None)
                continue
            made = []
            for t in tokens:
                if t not in known:
                    known[t] = t if t is None or t in protected else fn(t)
                if beside:
                    made.append(t)
                    if known[t] and known[t] != t:
                        made.append(known[t])
                else:
                    made.append(known[t])
            out.append(made)
        return pd.Series(out, dtype=object)

    return lambda tokens: F.pandas_udf(apply, "array<string>")(tokens)


_V = "aeiou"


def _cons(w: str, i: int) -> bool:
    c = w[i]
    return c not in _V and (c != "y" or i == 0 or not _cons(w, i - 1))


def _measure(w: str) -> int:
    shape = "".join("c" if _cons(w, i) else "v" for i in range(len(w)))
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", shape)))


def _vowel(w: str) -> bool:
    return any(not _cons(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and _cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1) and w[-1] not in "wxy"


# --- fixed values: the suffixes of Porter's steps 2, 3 and 4 ---
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
# --- end of fixed values ---


def _longest(w: str, rules: dict[str, str], least: int) -> str:
    for suffix in sorted(rules, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            return stem + rules[suffix] if _measure(stem) > least - 1 else w
    return w


_R2, _R3 = (dict(x.split(":") for x in s.split()) for s in (_STEP2, _STEP3))


def porter(word: str) -> str:
    """Porter's algorithm of 1980; words of one or two letters stay."""
    w = word.lower()
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        stem = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else None
        if stem is not None and _vowel(stem):
            if stem.endswith(("at", "bl", "iz")):
                w = stem + "e"
            elif _double(stem) and stem[-1] not in "lsz":
                w = stem[:-1]
            else:
                w = stem + "e" if _measure(stem) == 1 and _cvc(stem) else stem
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _longest(w, _R2, 1)
    w = _longest(w, _R3, 1)
    for suffix in sorted(_STEP4.split(), key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


def affix_stemmer(words: dict[str, str], suffixes: dict[str, list[tuple[str, str, str]]], prefixes: dict[str, list[tuple[str, str, str]]] | None = None) -> Callable[[str], str]:
    """A stemmer over a user's affix dictionary: words (stem -> flags), rules by flag (strip, add, condition).

    A word that is a stem stays; else the first suffix or prefix whose removal gives a stem that has its flag.
    """
    made = [(flag, strip, add, re.compile(cond + "$"), False) for flag, rules in suffixes.items() for strip, add, cond in rules]
    made += [(flag, strip, add, re.compile("^" + cond), True) for flag, rules in (prefixes or {}).items() for strip, add, cond in rules]

    def stem(word: str) -> str:
        if word in words:
            return word
        for flag, strip, add, fits, front in made:
            if add and (word.startswith(add) if front else word.endswith(add)):
                base = strip + word[len(add) :] if front else word[: len(word) - len(add)] + strip
                if base in words and flag in words[base] and fits.search(base):
                    return base
        return word

    return stem


def longest_match(lexicon: frozenset[str]) -> Callable[[str], list[str]]:
    """Greedy segmentation for scripts without spaces: at each place the longest word of the lexicon, else one character."""
    longest = max(map(len, lexicon), default=1)

    def cut(text: str) -> list[str]:
        out, i = [], 0
        while i < len(text):
            if text[i].isspace():
                i += 1
                continue
            n = next((n for n in range(min(longest, len(text) - i), 1, -1) if text[i : i + n] in lexicon), 1)
            out.append(text[i : i + n])
            i += n
        return out

    return cut


def metaphone(word: str) -> str:
    """Lawrence Philips' Metaphone of 1990 for a word of ASCII letters; '' for others."""
    w = re.sub(r"(.)\1+", lambda m: m.group(0) if m.group(1) == "C" else m.group(1), word.upper())
    if not re.fullmatch("[A-Z]+", w):
        return ""
    w = re.sub("^(?:KN|GN|PN|AE|WR)", lambda m: m.group(0)[1], w)
    w = re.sub("^X", "S", re.sub("^WH", "W", w))
    out = []
    n, at = len(w), lambda i: w[i] if 0 <= i < len(w) else ""
    for i, c in enumerate(w):
        nxt, prev = at(i + 1), at(i - 1)
        front = nxt in ("E", "I", "Y") and nxt != ""
        if c in "AEIOU":
            code = c if i == 0 else ""
        elif c == "B":
            code = "" if i == n - 1 and prev == "M" else "B"
        elif c == "C":
            code = "" if prev == "S" and front else "X" if w[i : i + 3] == "CIA" or (nxt == "H" and prev != "S") else "S" if front else "K"
        elif c == "D":
            code = "J" if nxt == "G" and at(i + 2) in ("E", "I", "Y") and at(i + 2) else "T"
        elif c == "G":
            silent = (nxt == "H" and i + 2 < n and at(i + 2) not in "AEIOU") or (nxt == "N" and (i + 2 == n or w[i + 1 :] == "NED")) or (prev == "D" and front)
            code = "" if silent or (nxt == "H" and i + 2 == n) else "J" if front and prev != "G" else "K"
        elif c == "H":
            code = "H" if nxt in ("A", "E", "I", "O", "U") and prev not in ("C", "S", "P", "T", "G") else ""
        elif c == "K":
            code = "" if prev == "C" else "K"
        elif c == "P":
            code = "F" if nxt == "H" else "P"
        elif c == "Q":
            code = "K"
        elif c == "S":
            code = "X" if nxt == "H" or w[i : i + 3] in ("SIO", "SIA") else "S"
        elif c == "T":
            code = "X" if w[i : i + 3] in ("TIA", "TIO") else "0" if nxt == "H" else "" if w[i : i + 3] == "TCH" else "T"
        elif c == "V":
            code = "F"
        elif c in "WY":
            code = c if nxt in ("A", "E", "I", "O", "U") else ""
        elif c == "X":
            code = "KS"
        elif c == "Z":
            code = "S"
        else:
            code = c
        out.append(code)
    return "".join(out)
