"""Whitespace, presence and key normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as whitespace in text, Unicode spaces included.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set as a pattern; the class shorthand is several times faster than spelling it out.
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"

# Characters that may not occur in a table key, and its greatest length.
KEY_FORBIDDEN = r'[<>:"/\\|?*]'
KEY_LENGTH = 100


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c: Column | str) -> Column:
    """Trim Unicode whitespace on both ends; null stays null."""
    return F.btrim(col(c), F.lit(SPACES))


def text_norm(c: Column | str) -> Column:
    """Comparison form of a text: null becomes '', trimmed, lower case."""
    return F.lower(utrim(F.coalesce(col(c).cast("string"), F.lit(""))))


def is_present_norm(normalised: Column | str) -> Column:
    """Presence test for a value that already is in ``text_norm`` form."""
    return ~col(normalised).isin("", "nan")


def is_present(c: Column | str) -> Column:
    """Neither null, blank nor the word ``nan``."""
    return is_present_norm(text_norm(c))


def clean_text(c: Column | str) -> Column:
    """Runs of whitespace become one blank, ends are trimmed, null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), SPACE_RUN, " "))


def search_key(c: Column | str) -> Column:
    """Text as searches are compared by: forbidden characters dropped, blanks to ``_``."""
    return F.replace(F.regexp_replace(col(c), KEY_FORBIDDEN, ""), F.lit(" "), F.lit("_"))


def sanitize_key(c: Column | str) -> Column:
    """Text as part of a file name: ``search_key`` cut to 100 characters. Two texts may share one."""
    return F.substring(search_key(c), 1, KEY_LENGTH)


def _anchored(words: Sequence[str], shortest: int = 4) -> list[tuple[str, list[str]]]:
    """Words grouped by a part they share: (part, words). A word that shares none is its own part."""
    left, groups = list(dict.fromkeys(words)), []
    while left:
        parts: dict[str, list[str]] = {}
        for w in left:
            for p in {w[i:j] for i in range(len(w)) for j in range(i + shortest, len(w) + 1)}:
                parts.setdefault(p, []).append(w)
        if not parts:
            return groups + [(w, [w]) for w in left]
        part, members = max(parts.items(), key=lambda kv: (len(kv[1]), len(kv[0]), kv[0]))
        if len(members) == 1:
            return groups + [(w, [w]) for w in left]
        groups.append((part, members))
        left = [w for w in left if w not in members]
    return groups


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True where ``text`` holds one of ``words``.

    Substring tests only. Words are grouped by a part they share, so a text without that part is
    done with the whole group after one test.
    """
    test = F.lit(False)
    for part, members in _anchored(words):
        hit = F.contains(text, F.lit(part))
        if members != [part]:
            exact = F.lit(False)
            for word in members:
                exact = exact | F.contains(text, F.lit(word))
            hit = hit & exact
        test = test | hit
    return test


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))
