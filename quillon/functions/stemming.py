"""Search terms: runs of letters and digits without case and diacritics, cut to their stems by Porter's rules.

The rules are data, applied by Spark expressions, by Python (for the words of a query) and by SQL (for checks).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# A consonant is any letter but a, e, i, o, u, and y where a vowel or nothing stands before it.
_C = "[^aeiou][^aeiouy]*"
_V = "[aeiouy][aeiou]*"
_VOWEL = "^(?:[^aeiou][^aeiouy]*[aeiouy]|[aeiou])"  # the stem holds a vowel
_M0 = f"{_VOWEL}[aeiou]*{_C}"  # at least one vowel-consonant sequence
_M1 = f"{_VOWEL}[aeiou]*{_C}{_V}{_C}"  # at least two
_CVC = f"^{_C}[aeiouy][^aeiouwxy]"  # the only sequence, short

#: Fixed values of the algorithm: suffixes and what takes their place.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

#: Shortest and longest word, in bytes, that is cut.
LEAST, MOST = 3, 64


Rule = tuple[str, int, str]


def _suffixes(table: dict[str, str], stem: str, extra: list[Rule] = [], more: str = "") -> tuple[str, list[Rule]]:
    """The longest suffix decides: where its stem fails, none that ends it is tried."""
    rules = list(extra)
    for s in sorted(table, key=len, reverse=True):
        rules.append((f"{stem}.*{s}$", len(s), table[s]))
        if any(s != t and s.endswith(t) for t in table):
            rules.append((f"{s}$", 0, ""))
    return f".(?:{'|'.join(table)}{more})$", rules


_DOUBLE = "|".join(c + c for c in "bcdfghjkmnpqrtvwxy0123456789")
#: Each step is a pattern that lets a word in, and rules (pattern, letters to drop, letters to add) of which the first that
#: fits acts. `+` marks a word that lost an ending.
STEPS: list[tuple[str, list[Rule]]] = [
    ("s$", [(".(?:ss|i)es$", 2, ""), ("[^s]s$", 1, "")]),
    ("(?:ed|ing)$", [(f"{_M0}.*eed$", 1, ""), (".eed$", 0, ""), (f"{_VOWEL}.*ed$", 2, "+"), (f"{_VOWEL}.*ing$", 3, "+")]),
    (r"\+$", [(r"(?:at|bl|iz)\+$", 1, "e"), (rf"(?:{_DOUBLE})\+$", 2, ""), (rf"{_CVC}\+$", 1, "e"), (r"\+$", 1, "")]),
    ("y$", [(f"{_VOWEL}.*y$", 1, "i")]),
    _suffixes(STEP2, _M0),
    _suffixes(STEP3, _M0),
    _suffixes({s: "" for s in STEP4}, _M1, [("[^st]ion$", 0, ""), (f"{_M1}.*ion$", 3, "")], "|ion"),
    ("e$", [(f"{_M1}.*e$", 1, ""), (f"{_CVC}e$", 0, ""), (f"{_M0}(?:{_V})?e$", 1, "")]),
    ("ll$", [(f"{_M1}.*l$", 1, "")]),
]


def stem(word: str) -> str:
    """One word's stem."""
    if not LEAST <= len(word.encode()) <= MOST:
        return word
    for guard, rules in STEPS:
        if re.search(guard, word):
            for pattern, drop, add in rules:
                if re.search(pattern, word):
                    word = word[: len(word) - drop] + add
                    break
    return word


def _ends(guard: str) -> list[str]:
    """What words that a guard lets in end with; of many endings, which the rules ask for again, the last two letters."""
    ends = re.sub(r"^\.?\(\?:|\)\$$|\$$", "", guard).replace("\\", "").split("|")
    return ends if len(ends) < 4 else sorted({e[-2:] for e in ends})


def _fits(w: Column, pattern: str) -> Column:
    """A rule's pattern; the letters that it ends in are compared first, as that takes no regular expression."""
    end = re.search(r"(?<![\\a-z])([a-z]+)\$$", pattern)
    return F.endswith(w, F.lit(end[1])) & w.rlike(pattern) if end else w.rlike(pattern)


def _step(guard: str, rules: list[Rule]) -> Callable[[Column], Column]:
    ends = _ends(guard)

    def step(w: Column) -> Column:
        lets = reduce(Column.__or__, (F.endswith(w, F.lit(e)) for e in ends)) if len(ends) < 4 else F.substring(w, -2, 2).isin(ends)
        new = F.when(~lets, w)
        for pattern, drop, add in rules:
            kept = F.substring(w, F.lit(1), F.length(w) - drop) if drop else w
            new = new.when(_fits(w, pattern), F.concat(kept, F.lit(add)) if add else kept)
        return new.otherwise(w)

    return step


def stems(words: Column) -> Column:
    """The stems of a list of words, in its order. A transform a step, so that no step is written twice."""
    # A word out of bounds carries a mark that no guard lets in.
    out = F.transform(words, lambda w: F.when(F.octet_length(w).between(LEAST, MOST), w).otherwise(F.concat(w, F.lit("\x00"))))
    for guard, rules in STEPS:
        out = F.transform(out, _step(guard, rules))
    return F.transform(out, lambda w: F.when(F.endswith(w, F.lit("\x00")), F.rtrim(w, F.lit("\x00"))).otherwise(w))


def sql_stem(word: str) -> str:
    """SQL of a scalar subquery that gives the stem of an SQL expression."""
    inner = f"SELECT {word} AS w"
    for guard, rules in STEPS:
        cases = " ".join(f"WHEN regexp_matches(w, '{p}') THEN left(w, length(w) - {drop}) || '{add}'" for p, drop, add in rules)
        inner = f"SELECT CASE WHEN NOT regexp_matches(w, '{guard}') THEN w {cases} ELSE w END AS w FROM ({inner})"
    return f"CASE WHEN strlen({word}) BETWEEN {LEAST} AND {MOST} THEN ({inner}) ELSE {word} END"


# -- words


def _plain() -> tuple[str, str]:
    """Latin letters that are another letter with one mark, and that letter; lower case."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code).lower())
        if len(parts) == 2 and chr(code).islower() and unicodedata.combining(parts[1]):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _plain()
#: Combining marks that are dropped.
MARKS = "̀-̱"
_TABLE = str.maketrans(MARKED, PLAIN)


def folded(text: str) -> str:
    """Lower case, without diacritics."""
    return re.sub(f"[{MARKS}]", "", text.lower()).translate(_TABLE)


def words(text: str) -> tuple[str, ...]:
    """Folded runs of letters and digits."""
    return tuple(re.findall(r"[^\W_]+", folded(text)))


def tokens(text: Column) -> Column:
    """The same of a column, as a list; absent gives an empty list."""
    plain = F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[{MARKS}]", ""), MARKED, PLAIN)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda t: t != "")
