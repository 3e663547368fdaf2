"""Text analysis: lower-cased runs of letters, digits and underscores are tokens."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]"
SPLIT = r"[^\p{L}\p{N}_]+"
#: Where a token may begin and end.
BEFORE, AFTER = f"(?<!{TOKEN})", f"(?!{TOKEN})"
_python_split = re.compile(r"[\W]+")


def _folds() -> dict[str, str]:
    """Lower-case Latin letters with marks, and the plain letter that Unicode takes them apart into."""
    out = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if c == c.lower() and c != plain and len(plain) == 1 and "a" <= plain <= "z":
            out[c] = plain
    return out


#: Letters that Unicode doesn't take apart.
STROKED = {"ø": "o", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "ł": "l", "ŧ": "t"}
LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
FOLDS = _folds() | STROKED


def tokens(column: Column) -> Column:
    return F.filter(F.split(F.lower(column), SPLIT), lambda t: t != "")


def token_list(text: str) -> list[str]:
    return [t for t in _python_split.split(text.lower()) if t]


def _holds(column: Column, sure: str, pattern: str) -> Column:
    """Lower-cased text with a match of the pattern; `sure`, which every match holds, is looked for first."""
    low = F.lower(column)
    return low.contains(sure) & low.rlike(pattern) if sure else low.rlike(pattern)


def match_any(column: Column, text: str) -> Column:
    wanted = list(dict.fromkeys(token_list(text)))
    if not wanted:
        return F.lit(False)
    words = "|".join(map(re.escape, wanted))
    return _holds(column, wanted[0] if len(wanted) == 1 else "", f"{BEFORE}(?:{words}){AFTER}")


def phrase(column: Column, text: str) -> Column:
    wanted = token_list(text)
    if not wanted:
        return F.lit(False)
    return _holds(column, max(wanted, key=len), BEFORE + SPLIT.join(map(re.escape, wanted)) + AFTER)


def token_prefix(column: Column, text: str) -> Column:
    begin = text.lower()
    if begin and token_list(begin) != [begin]:
        return F.lit(False)
    return _holds(column, begin, BEFORE + (re.escape(begin) or TOKEN))


def sort_form(column: Column) -> Column:
    """Lower case without accents, for sorting."""
    out = F.translate(F.lower(column), "".join(FOLDS), "".join(FOLDS.values()))
    for letter, plain in LIGATURES.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def glob_pattern(text: str) -> str:
    """A full-match pattern for `*` and `?`; a backslash keeps the next character as it is."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            i += 1
            out.append(re.escape(text[i]))
        else:
            out.append(".*" if c == "*" else "." if c == "?" else re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"
