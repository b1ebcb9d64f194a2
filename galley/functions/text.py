"""Column expressions over one string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions import fixed_values as fx
from galley.functions.arrays import let, running_sums
from galley.functions.re2 import UNICODE_SPACE, re2


def matches(col: Column, *patterns: str) -> Column:
    """True when any RE2 pattern is found in ``col``."""
    first, *rest = [col.rlike(re2(p)) for p in patterns]
    for found in rest:
        first = first | found
    return first


def find_all(col: Column, pattern: str, group: int = 0) -> Column:
    """Every non-overlapping match of an RE2 pattern, in order."""
    return F.regexp_extract_all(col, F.lit(re2(pattern)), F.lit(group))


def count_matches(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(re2(pattern)))


def trim_space(col: Column) -> Column:
    """Trim all Unicode white space, not only U+0020."""
    return F.trim(col, F.lit(UNICODE_SPACE))


def is_blank(col: Column) -> Column:
    return trim_space(col) == ""


# Letters whose upper case is more than one letter: left as they are.
_EXPANDING = "ßŉǰΐΰև"
_HELD = "\ue000\ue001\ue002\ue003\ue004\ue005"


def upper_case(col: Column) -> Column:
    """Upper case letter for letter, never changing the length."""
    return F.translate(F.upper(F.translate(col, _EXPANDING, _HELD)), _HELD, _EXPANDING)


def title_case(col: Column) -> Column:
    """Upper-case the first letter of every word and leave the rest alone.

    A word starts after an ASCII character that is not alphanumeric and not
    ``_``, or after other white space; an inner ``’`` does not start a word.
    """
    starts = r"(?<=[\x00-\x7f&&[^0-9A-Za-z_]]|[\x{85}\p{Z}])"
    return F.array_join(
        F.transform(
            F.split(col, starts, -1),
            lambda w: F.concat(upper_case(F.substring(w, 1, 1)), F.substr(w, F.lit(2))),
        ),
        "",
    )


def is_numeral(col: Column) -> Column:
    """Only digits and lower-case Roman letters (the empty string counts)."""
    return col.rlike(re2(fx.NUMERALS))


def replace_all(col: Column, pairs: list[tuple[str, str]]) -> Column:
    """Plain replacements, each over the result of the one before."""
    for old, new in pairs:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def context(text: Column, at: Column) -> Column:
    """A snippet of ``text`` around the 0-based position ``at``.

    Thirty characters each side, sixty from an edge of the text, widened to
    whole words; runs of spaces are closed up.
    """

    def widen(b: Column) -> Column:
        back = _from_last_space(F.substr(text, F.lit(1), b["lo"] + 1))
        start = let(back, lambda k: F.when((b["lo"] > 0) & (k > 0), b["lo"] + 1 - k).otherwise(0))
        ahead = F.call_function("locate", F.lit(" "), text, b["hi"] + 1)
        end = let(ahead, lambda k: F.when((b["hi"] < b["size"]) & (k > 0), k - 1).otherwise(b["size"]))
        return let(
            F.struct(start.alias("start"), end.alias("end")),
            lambda s: F.substr(text, s["start"] + 1, s["end"] - s["start"]),
        )

    return _closed_up(let(let(F.length(text), lambda size: _bounds(at, size)), widen))


def _from_last_space(text: Column) -> Column:
    """Characters from the last space to the end, the space included; 0 without one."""
    return let(
        text,
        lambda t: F.when(F.contains(t, F.lit(" ")), F.length(F.substring_index(t, " ", -1)) + 1).otherwise(0),
    )


_PIECE = 128


def pieces_of(text: Column) -> Column:
    """A text in pieces of equal length, for ``context_in``."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_PIECE}}}"), F.lit(0))


def context_in(text: Column, pieces: Column, size: Column, at: Column) -> Column:
    """``context(text, at)``, read from the few pieces around ``at``, so that a
    long text is not walked again for each of its hits."""

    def local(b: Column) -> Column:
        first = F.greatest(F.floor(b["lo"] / _PIECE) - 1, F.lit(0)).cast("int")
        return F.struct(
            b["lo"].alias("lo"),
            b["hi"].alias("hi"),
            (first * _PIECE).alias("base"),
            # a piece before ``lo``, the one or two it spans, a piece after ``hi``
            F.concat_ws("", *[F.get(pieces, first + k) for k in range(4)]).alias("part"),
        )

    def ends(b: Column) -> Column:
        back = _from_last_space(F.substr(b["part"], F.lit(1), b["lo"] - b["base"] + 1))
        ahead = F.call_function("locate", F.lit(" "), b["part"], b["hi"] - b["base"] + 1)
        start = let(
            back, lambda k: F.when((b["lo"] > 0) & (k > 0), b["lo"] + 1 - k).when(b["base"] == 0, 0)
        )
        end = let(
            ahead,
            lambda k: F.when((b["hi"] < size) & (k > 0), b["base"] + k - 1).when(
                (b["hi"] >= size) | (b["base"] + F.length(b["part"]) >= size), size
            ),
        )
        return F.struct(start.alias("start"), end.alias("end"), b["base"].alias("base"), b["part"].alias("part"))

    def snippet(s: Column) -> Column:
        return F.substr(s["part"], s["start"] - s["base"] + 1, s["end"] - s["start"])

    near = let(let(let(_bounds(at, size), local), ends), snippet)
    return F.coalesce(_closed_up(near), context(text, at))  # a word longer than a piece


def _bounds(at: Column, size: Column) -> Column:
    left = at - fx.CONTEXT_SIDE
    right = F.when(left < 0, F.lit(fx.CONTEXT_WIDTH)).otherwise(at + fx.CONTEXT_SIDE)
    lo = F.when(right >= size, size - fx.CONTEXT_WIDTH).when(left < 0, F.lit(0)).otherwise(left)
    return F.struct(
        F.greatest(lo, F.lit(0)).alias("lo"), F.least(right, size).alias("hi"), size.alias("size")
    )


def _closed_up(snippet: Column) -> Column:
    return replace_all(trim_space(snippet), [("  ", " "), ("  ", " ")])


# Characters that no text should hold, around a match and between its parts.
_AROUND, _BETWEEN = "\ufdd0", "\ufdd1"


def match_spans(text: Column, pattern: str, groups: tuple[int, ...] = ()) -> Column:
    """Each match of an RE2 pattern as ``struct(at, item[, g1, ...])``.

    ``at`` is the 0-based character position.  The text is parted into gaps and
    matches, and the positions are the running sums of their lengths.
    """
    names = [f"g{i + 1}" for i in range(len(groups))]
    extra = "".join(f", {n}: string" for n in names)
    empty = F.array().cast(f"array<struct<at: int, item: string{extra}>>")
    java = re2(pattern)

    def placed(found: Column) -> Column:
        steps = F.transform(found, lambda m: F.length(m["gap"]) + F.length(m["item"]))
        return let(
            running_sums(steps),
            lambda ends: F.transform(
                found,
                lambda m, i: F.struct(
                    (F.get(ends, i) + F.length(m["gap"])).alias("at"),
                    m["item"].alias("item"),
                    *[m[n].alias(n) for n in names],
                ),
            ),
        )

    def extracted() -> Column:
        gap_then = rf"\G((?s:.*?))({java})"
        part = lambda group: F.regexp_extract_all(text, F.lit(gap_then), F.lit(group))
        return F.arrays_zip(
            part(1).alias("gap"),
            part(2).alias("item"),
            *[part(g + 2).alias(n) for g, n in zip(groups, names)],
        )

    def cut(marked: Column) -> Column:
        # gap, match, gap, match, ..., what is left
        pieces = F.split(marked, _AROUND, -1)

        def pair(p: Column, k: Column) -> Column:
            fields = F.split(F.get(p, 2 * k + 1), _BETWEEN, -1)
            return let(
                fields,
                lambda f: F.struct(
                    F.get(p, 2 * k).alias("gap"),
                    F.get(f, 0).alias("item"),
                    *[F.get(f, i + 1).alias(n) for i, n in enumerate(names)],
                ),
            )

        return let(
            pieces,
            lambda p: F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / 2).cast("int") - 1), lambda k: pair(p, k)),
        )

    # one search marks all matches; a text that holds the marks is searched for each part
    noted = "$0" + "".join(f"{_BETWEEN}${g}" for g in groups)
    marked = F.regexp_replace(text, java, f"{_AROUND}{noted}{_AROUND}")
    by_marks = let(
        marked, lambda m: F.when(F.contains(m, F.lit(_AROUND)), let(cut(m), placed)).otherwise(empty)
    )
    holds_marks = F.contains(text, F.lit(_AROUND)) | F.contains(text, F.lit(_BETWEEN))
    return F.when(~holds_marks, by_marks).when(text.rlike(java), let(extracted(), placed)).otherwise(empty)
