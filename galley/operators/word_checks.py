"""Checks on single words: scannos, odd spellings, context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import fixed_values as fx
from galley.functions.arrays import counts, let, meet
from galley.functions.re2 import WHOLE
from galley.functions.text import context, matches
from galley.functions.words import book_words, line_words
from galley.operators.derived import doc_words, lines
from galley.operators.findings import finding
from galley.plans.joins import Lookup
from galley.sources.books import line_array


def word_context(text: Column, word: Column, open_mark: str = "⟦", close_mark: str = "⟧") -> Column:
    """Snippet around the first place of a whole word, every place marked."""
    quoted = F.concat(F.lit(r"\Q"), word, F.lit(r"\E"))
    whole = F.concat(F.lit(r"(^|\P{L})("), quoted, F.lit(r")(\P{L}|\z)"))
    marked = F.regexp_replace(text, whole, F.lit(f"$1{open_mark}$2{close_mark}$3"))
    return let(marked, lambda m: context(m, F.instr(m, open_mark) - 1))


def scannos(books: DataFrame, scanno_words: Lookup) -> DataFrame:
    """Every occurrence of a listed word, with its context."""
    # distinct words of a line first: most lines hold no scanno at all
    tokens = lines(books).select(
        "doc_id", "line_no", "text", F.explode(line_words(F.col("text"))).alias("word")
    )
    hits = scanno_words.join(tokens, ["word"], "left_semi", ["doc_id", "line_no"])
    return hits.select(
        "doc_id", "word", "line_no", word_context(F.col("text"), F.col("word")).alias("context")
    )


def scannos_without(scanno_words: Lookup, good: Lookup) -> Lookup:
    """Scanno forms the user has not declared good."""
    return Lookup.of(scanno_words.table.join(good.table, "word", "left_anti"))


def odd_words(books: DataFrame) -> DataFrame:
    """Words with a rare ending or beginning, one row per fault."""
    return (
        lines(books)
        .select("doc_id", "line_no", "text", F.explode(line_words(F.col("text"))).alias("word"))
        .select("doc_id", "line_no", "word", "text", F.explode(_faults(F.col("word"))).alias("rule"))
    )


def _faults(word: Column) -> Column:
    """The rules a single word breaks."""
    end2, start2 = F.right(word, F.lit(2)), F.left(word, F.lit(2))
    faults = F.array_compact(
        F.array(
            F.when(end2.isin(fx.RARE_ENDINGS), F.concat(F.lit("query word ending with "), end2)),
            F.when(start2.isin(fx.RARE_BEGINNINGS), F.concat(F.lit("query word starting with "), start2)),
        )
    )
    return F.when(F.octet_length(word) > 2, faults).otherwise(F.array().cast("array<string>"))


def line_word_hits(scanno_words: list[str] | None) -> Column:
    """Findings of the words of the line in ``line_no, text``: rare endings and
    beginnings, and scannos of a list short enough to stand in the plan."""
    text, line_no = F.col("text"), F.col("line_no")

    def odd(w: Column) -> Column:
        return F.transform(
            _faults(w),
            lambda rule: finding("special situations", rule, line_no=line_no, item=w, context=text),
        )

    def listed(words: Column) -> Column:
        return F.transform(
            F.filter(words, lambda w: w.isin(scanno_words)),
            lambda w: finding("scannos", line_no=line_no, item=w, context=word_context(text, w)),
        )

    def hits(words: Column) -> Column:
        odds = F.flatten(F.transform(words, odd))
        return F.concat(odds, listed(words)) if scanno_words else odds

    return let(line_words(text), hits)


# A letter or digit, an apostrophe before a letter, or a sign between two letters: what
# a line word is made of (see ``functions.words``, which joins no sign to a letter above U+FFFF).
_INNER = rf"(?<{{sign}}{WHOLE}(?:[\p{{{{L}}}}\p{{{{N}}}}’]|[\p{{{{L}}}}&&[^\x{{{{10000}}}}-\x{{{{10ffff}}}}]][-‘]){{then}})"
_GOES_ON = r"[\p{L}\p{N}]|[’‘-]\p{L}"


def _either(letters: list[str]) -> str:
    return "[" + "".join(sorted(set(letters))) + "]"


def _rare_ending() -> str:
    """Group 1: the rare ending of each line word longer than it, found from its last letter."""
    last, ends = _either([e[1] for e in fx.RARE_ENDINGS]), "|".join(fx.RARE_ENDINGS)
    return rf"{last}(?!{_GOES_ON})" + _INNER.format(sign="=", then=f"({ends})")


def _rare_beginning() -> str:
    """Group 1: the rare beginning of each line word longer than it."""
    first, second = (_either([b[k] for b in fx.RARE_BEGINNINGS]) for k in (0, 1))
    starts = "|".join(fx.RARE_BEGINNINGS)
    return rf"{first}{second}(?<=({starts}))(?={_GOES_ON})" + _INNER.format(sign="!", then="[a-z][a-z]")


def line_word_places(scanno_words: list[str] | None, at: int = 0) -> tuple[list[tuple[str, str]], list[Column]]:
    """The ``(check, rule)`` of ``line_word_hits``, and arrays with the place of a rule
    among them, counted from ``at``, for each of its findings in the line in ``text``."""
    text = F.col("text")
    names: list[tuple[str, str]] = []
    places = []
    for kind, listed, pattern in (
        ("ending", fx.RARE_ENDINGS, _rare_ending()),
        ("starting", fx.RARE_BEGINNINGS, _rare_beginning()),
    ):
        first = at + len(names)
        known = F.array(*map(F.lit, listed))
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        places.append(F.transform(found, lambda p: F.array_position(known, p).cast("int") + (first - 1)))
        names += [("special situations", f"query word {kind} with {p}") for p in listed]
    if scanno_words:
        # most lines hold none: one look at all words of a line tells, and plain ones
        # stand between the signs
        plain = all(w.isascii() and w.isalnum() for w in scanno_words)
        some = F.arrays_overlap(
            F.split(text, r"[^\p{L}\p{N}]++") if plain else line_words(text), F.array(*map(F.lit, scanno_words))
        )
        number = F.when(some, F.size(F.filter(line_words(text), lambda w: w.isin(scanno_words)))).otherwise(0)
        places.append(F.array_repeat(F.lit(at + len(names)), number))
        names.append(("scannos", "scannos"))
    return names, places


def has_mixed_case(word: Column) -> Column:
    # the capital first: few words have one past their first letter
    plain = matches(word, fx.MIXED_CASE[1]) & matches(word, fx.MIXED_CASE[0])
    quoted = matches(word, fx.MIXED_CASE_APOSTROPHE[1]) & matches(word, fx.MIXED_CASE_APOSTROPHE[0])
    return F.when(F.startswith(word, F.lit("’")), quoted).otherwise(plain)


def mixed_case_words(books: DataFrame, good: Lookup | None = None) -> DataFrame:
    """Words mixing case after their first letter, seen at most once.

    Words holding a good word anywhere are left out.
    """
    rare = books.select("doc_id", F.inline(let(line_array(F.col("text")), lambda a: mixed_case_of(F.col("text"), a))))
    if good is not None:
        holding = containing_good_word(rare.select("word").distinct(), good)
        rare = Lookup.of(holding).join(rare, ["word"], "left_anti", ["doc_id", "line_no"])
    return rare.select("doc_id", "word", "line_no", "text")


# Searched from the capital; one above U+FFFF is taken for one inside a word.
_INNER_CAPITAL = r"\p{Lu}(?<=[\p{L}\p{N}\p{Cs}’‘-]\p{Lu}|\p{Cs})"


def mixed_case_of(text: Column, lined: Column, good_words: list[str] | None = None) -> Column:
    """``struct(word, line_no, text)`` of one document's rare mixed-case words.

    The counts are in the row; only lines with a capital inside a word are cut
    into words.  ``good_words`` is a list short enough to stand in the plan.
    """
    tokens = F.flatten(
        F.transform(
            lined,
            lambda x, i: F.when(
                x.rlike(_INNER_CAPITAL),
                F.transform(
                    F.filter(line_words(x), has_mixed_case),
                    lambda w: F.struct(w.alias("word"), (i + 1).cast("long").alias("line_no"), x.alias("text")),
                ),
            ).otherwise(F.array().cast("array<struct<word: string, line_no: bigint, text: string>>")),
        )
    )

    def rare_words(found: Column) -> Column:
        # the vocabulary keeps hyphens apart from the line words, so a word that
        # is not in it counts as seen zero times
        often = F.transform(
            F.filter(counts(F.filter(doc_words(text), has_mixed_case)), lambda c: c["n"] > 1),
            lambda c: c["word"],
        )
        rare = F.array_except(F.transform(found, lambda t: t["word"]), often)
        if not good_words:
            return rare
        lengths = F.array(*[F.lit(k) for k in sorted({len(g) for g in good_words})])
        holds = lambda w: F.exists(substrings(w, lengths), lambda s: s.isin(good_words))
        return F.filter(rare, lambda w: ~holds(w))

    def kept(found: Column) -> Column:
        met = meet(rare_words(found), F.transform(found, lambda t: t["word"]))
        return F.flatten(F.transform(met, lambda m: F.transform(m["r"], lambda k: F.get(found, k))))

    return F.when(text.rlike(_INNER_CAPITAL), let(tokens, lambda t: F.when(F.size(t) > 0, kept(t))))


def substrings(word: Column, lengths: Column) -> Column:
    """Distinct substrings of a word having one of the given lengths."""
    return F.array_distinct(
        F.flatten(
            F.transform(
                F.filter(lengths, lambda k: k <= F.length(word)),
                lambda k: F.transform(
                    F.sequence(F.lit(1), F.length(word) - k + 1), lambda i: F.substr(word, i, k)
                ),
            )
        )
    )


def good_parts(words: DataFrame, good: Lookup) -> DataFrame:
    """``(word, part)`` for every good word found inside a distinct word.

    Substrings of the lengths good words have are looked up by equality, so
    no pair of words is compared that does not match.
    """
    lengths = [r["k"] for r in good.table.select(F.length("word").alias("k")).distinct().sort("k").collect()]
    if not lengths:
        return words.select("word", F.lit("").alias("part")).filter(F.lit(False))
    parts = words.select(
        "word", F.explode(substrings(F.col("word"), F.array(*[F.lit(k) for k in lengths]))).alias("part")
    )
    renamed = Lookup(good.table.select(F.col("word").alias("part")), good.n_bytes, good.limit, good.salts)
    return renamed.join(parts, ["part"], "left_semi", ["word"])


def containing_good_word(words: DataFrame, good: Lookup) -> DataFrame:
    return good_parts(words, good).select("word").distinct()


def concordance(
    books: DataFrame, words: DataFrame, shown: int | None = 2, cut: Callable[[Column], Column] = book_words
) -> DataFrame:
    """Lines showing chosen ``words(doc_id, word)``, the word marked.

    ``cut`` is the way lines are cut into words, the vocabulary's or another.
    With ``shown`` only so many lines are kept per word; ``n_more`` tells how
    many postings are beyond them.
    """
    by_doc = Lookup.of(words.groupBy("doc_id").agg(F.collect_set("word").alias("words")))
    return lines_of_words(by_doc.join_unique(books, ["doc_id"], "inner"), F.col("words"), shown, cut)


def lines_of_words(
    books: DataFrame, words: Column, shown: int | None, cut: Callable[[Column], Column], with_context: bool = True
) -> DataFrame:
    """``concordance`` of words that stand in the row; NULL or none give no rows."""
    found = let(line_array(F.col("text")), lambda a: shown_lines(F.col("_words"), a, shown, cut, with_context))
    chosen = books.select("doc_id", "text", words.alias("_words"))
    return chosen.select("doc_id", F.inline(F.when(F.size("_words") > 0, found)))


def shown_lines(
    words: Column, lined: Column, shown: int | None, cut: Callable[[Column], Column], with_context: bool = True
) -> Column:
    """``struct(word, line_no, context, n_more)`` of the chosen words of one document;
    without ``context`` if it is not asked for, as it is most of the work."""
    postings = F.flatten(
        F.transform(
            lined,
            lambda x, i: F.transform(cut(x), lambda w: F.struct(w.alias("word"), i.alias("at"))),
        )
    )

    def lines_of(m: Column, p: Column) -> Column:
        more = F.greatest(F.size(m["r"]) - shown, F.lit(0)) if shown is not None else F.lit(0)
        at = F.array_distinct(F.transform(m["r"], lambda k: F.get(p, k)["at"]))
        return F.transform(
            at if shown is None else F.slice(at, 1, shown),
            lambda i: F.struct(
                m["key"].alias("word"),
                (i + 1).cast("long").alias("line_no"),
                *([word_context(F.get(lined, i), m["key"]).alias("context")] if with_context else []),
                more.cast("long").alias("n_more"),
            ),
        )

    def placed(p: Column) -> Column:
        met = meet(F.array_distinct(words), F.transform(p, lambda x: x["word"]))
        return F.flatten(F.transform(met, lambda m: lines_of(m, p)))

    return let(postings, placed)
