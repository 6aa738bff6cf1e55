"""Text normalisation inside the JVM: accents, white space, keys."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that Unicode does not decompose, with the letter they count as.
STROKE_LETTERS = {"đ": "d", "Đ": "D", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H"}

#: White space as Unicode sees it, for Java regular expressions.
SPACE = r"[\s   -​    　﻿]"


@lru_cache
def _accent_tables() -> tuple[str, str]:
    """Every Latin letter below U+0250 and of U+1E00-U+1EFF whose decomposition begins with an ASCII letter."""
    pairs = dict(STROKE_LETTERS)
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


def strip_accents(c: Column) -> Column:
    """Latin letters without diacritics, composed or combining; strokes count as accents."""
    src, dst = _accent_tables()
    return F.translate(F.regexp_replace(c, r"\p{M}+", ""), src, dst)


def squeeze(c: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def fold(c: Column) -> Column:
    """Equality key of names: no accents, lower case, single blanks."""
    return F.lower(squeeze(strip_accents(c)))


def alnum_key(c: Column) -> Column:
    """Lower-case ASCII letters and digits only: `Current period`, `currentPeriod` and `current-period` agree."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "")
