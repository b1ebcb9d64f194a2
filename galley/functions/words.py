"""The two ways of cutting a line into words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Runs are taken whole and never given back: what follows a word is never part of one.
# A ``’`` before a letter always belongs to the word; ``-`` and ``‘`` only
# between two letters.
_LINE_WORD = r"(?:[\p{L}\p{N}]++|’(?=\p{L})|(?<=\p{L})[-‘](?=\p{L}))++"
# Apostrophes between letters and every single hyphen belong to the word.
_BOOK_WORD = r"(?:[\p{L}\p{N}-]++|(?<=\p{L})['’](?=\p{L}))++"
# Letters only, with apostrophes between letters: the units looked up in a
# dictionary (hyphens and digits part them).
_SPELL_WORD = r"\p{L}++(?:['’]\p{L}++)*+"


def line_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_LINE_WORD), F.lit(0))


def book_words(text: Column) -> Column:
    """Vocabulary words; ``--`` stands for a dash and parts words."""
    return F.regexp_extract_all(
        F.replace(text, F.lit("--"), F.lit(" ")), F.lit(_BOOK_WORD), F.lit(0)
    )


def spell_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_SPELL_WORD), F.lit(0))
