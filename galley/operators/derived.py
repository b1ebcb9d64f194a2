"""Tables derived from books: lines, paragraphs, words, characters.

Arrays are exploded from an expression, never from a bare column: for a bare
column the optimizer infers a ``size > 0`` filter, pushes it to the scan and
so builds the array twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import fixed_values as fx
from galley.functions.arrays import counts, let, runs, where
from galley.functions.text import find_all, matches, trim_space
from galley.functions.words import book_words, line_words
from galley.sources.books import line_array, text_body


def lines(books: DataFrame) -> DataFrame:
    """``lines(doc_id, line_no, text)``."""
    return books.select(
        "doc_id", F.posexplode(line_array(F.col("text"))).alias("pos", "text")
    ).select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "text")


def lines_in_place(books: DataFrame) -> DataFrame:
    """Lines with the one ``after`` them (NULL past the end).

    ``opens`` is true where the line before is empty, or would be once a lone
    em dash that itself opens a paragraph is taken away.
    """
    text = F.col("text")
    return books.select("doc_id", F.inline(let(line_array(text), lambda a: neighbours(text, a))))


def neighbours(text: Column, lined: Column) -> Column:
    """``struct(line_no, text, after, opens)`` of one document's lines."""
    lone_dash = r"(?:(?<=\n\n)|(?<=\A\n)|(?!\A)\G)—\n"
    undashed = F.when(
        F.contains(text, F.lit("—\n")) | F.contains(text, F.lit("—\r\n")),
        F.regexp_replace(text_body(text), lone_dash, "\n"),
    )
    return let(
        F.coalesce(F.split(undashed, "\n", -1), lined),
        lambda plain: F.transform(
            lined,
            lambda x, i: F.struct(
                (i + 1).cast("long").alias("line_no"),
                x.alias("text"),
                F.get(lined, i + 1).alias("after"),
                F.coalesce(F.get(plain, i - 1) == "", F.lit(False)).alias("opens"),
            ),
        ),
    )


def paragraph_array(text: Column) -> Column:
    """Runs of non-empty lines, each joined by single spaces."""
    blocks = F.split(F.trim(text_body(text), F.lit("\n")), "\n\n+", -1)
    return F.transform(
        F.filter(blocks, lambda b: b != ""), lambda b: F.replace(b, F.lit("\n"), F.lit(" "))
    )


def paragraphs(books: DataFrame) -> DataFrame:
    """``paras(doc_id, para_no, first_line, last_line, text)``."""
    def edges(lined: Column) -> Column:
        first = where(lined, lambda x, i: (x != "") & (F.coalesce(F.get(lined, i - 1), F.lit("")) == ""))
        last = where(lined, lambda x, i: (x != "") & (F.coalesce(F.get(lined, i + 1), F.lit("")) == ""))
        return F.arrays_zip(
            first.alias("first"), last.alias("last"), paragraph_array(F.col("text")).alias("text")
        )

    return books.select(
        "doc_id", F.posexplode(let(line_array(F.col("text")), edges)).alias("pos", "para")
    ).select(
        "doc_id",
        (F.col("pos") + 1).cast("long").alias("para_no"),
        (F.col("para.first") + 1).cast("long").alias("first_line"),
        (F.col("para.last") + 1).cast("long").alias("last_line"),
        F.col("para.text").alias("text"),
    )


def plain_paragraphs(books: DataFrame) -> DataFrame:
    """Paragraphs without line numbers (cheaper): ``doc_id, para_no, text``."""
    return books.select(
        "doc_id", F.posexplode(paragraph_array(F.col("text"))).alias("pos", "text")
    ).select("doc_id", (F.col("pos") + 1).cast("long").alias("para_no"), "text")


def trimmed_paragraphs(books: DataFrame) -> DataFrame:
    """Paragraphs trimmed of white space, and the same in lower case."""
    return (
        plain_paragraphs(books)
        .withColumn("text", trim_space(F.col("text")))
        .withColumn("lower_text", F.lower("text"))
    )


def line_tokens(books: DataFrame) -> DataFrame:
    """``tokens(doc_id, line_no, word_no, word)`` in reading order."""
    return lines(books).select(
        "doc_id", "line_no", F.posexplode(line_words(F.col("text"))).alias("pos", "word")
    ).select("doc_id", "line_no", (F.col("pos") + 1).cast("long").alias("word_no"), "word")


def postings(books: DataFrame) -> DataFrame:
    """``postings(doc_id, word, line_no)``, one row per occurrence."""
    return lines(books).select(
        "doc_id", F.explode(book_words(F.col("text"))).alias("word"), "line_no"
    )


def doc_words(text: Column) -> Column:
    """All vocabulary words of a text, in order, repeats included."""
    # a line end parts words just as a space does
    return book_words(F.replace(text_body(text), F.lit("\n"), F.lit(" ")))


def vocab(books: DataFrame) -> DataFrame:
    """``vocab(doc_id, word, n)``, counted inside each document's row."""
    return books.select("doc_id", F.inline(counts(doc_words(F.col("text")))))


def vocab_where(books: DataFrame, keep) -> DataFrame:
    """Part of the vocabulary, filtered before it is counted."""
    return books.select(
        "doc_id", F.inline(counts(F.filter(doc_words(F.col("text")), keep)))
    )


def _lines_with(lined: Column, mark: str) -> Column:
    return F.size(F.filter(lined, lambda x: F.contains(x, F.lit(mark)))).cast("long")


def is_british(text: Column) -> Column:
    return let(line_array(text), lambda a: _lines_with(a, ".’") > _lines_with(a, ".”"))


def punc_style(books: DataFrame) -> DataFrame:
    """British when more lines hold ``.’`` than ``.”``; else American."""
    counted = let(
        line_array(F.col("text")), lambda a: F.array(_lines_with(a, ".’"), _lines_with(a, ".”"))
    )
    return (
        books.select("doc_id", counted.alias("q"))
        .select("doc_id", F.get("q", 0).alias("n_single"), F.get("q", 1).alias("n_double"))
        .withColumn(
            "punc_style",
            F.when(F.col("n_single") > F.col("n_double"), "British").otherwise("American"),
        )
    )


def char_histogram(books: DataFrame) -> DataFrame:
    """``chars(doc_id, ch, n)`` over every character of every line."""
    chars = F.replace(text_body(F.col("text")), F.lit("\n"), F.lit(""))
    return (
        books.filter("text != ''")
        .select("doc_id", F.explode(F.split(chars, "")).alias("ch"))
        .filter("ch != ''")
        .groupBy("doc_id", "ch")
        .agg(F.count("*").alias("n"))
    )


def line_counts(books: DataFrame) -> DataFrame:
    """How often each line occurs in its document."""
    return books.select(
        "doc_id", F.inline(counts(line_array(F.col("text"))))
    ).withColumnRenamed("word", "text")


def hyphen_index(books: DataFrame) -> DataFrame:
    """Lower-cased hyphen compounds and the lines they are on."""
    return (
        lines(books)
        .select(
            "doc_id",
            F.explode(find_all(F.col("text"), fx.HYPHEN_COMPOUND)).alias("compound"),
            "line_no",
        )
        .withColumn("compound", F.lower("compound"))
    )


def apostrophe_words(books: DataFrame) -> DataFrame:
    """Words opening with ``’`` seen more than once in their document."""
    return books.select("doc_id", F.inline(repeated_apostrophe_words(line_array(F.col("text")))))


def repeated_apostrophe_words(lined: Column) -> Column:
    found = F.flatten(F.transform(lined, lambda x: find_all(x, fx.LEADING_APOSTROPHE, 2)))
    return F.filter(counts(found), lambda w: w["n"] > 1)


def numeric_words(books: DataFrame) -> DataFrame:
    """Vocabulary words made only of digits and Roman-numeral letters."""
    return vocab_where(books, lambda w: matches(F.lower(w), fx.NUMERALS))


def distinct_keep(books: DataFrame) -> DataFrame:
    """Distinct vocabulary words with the line that shows each first."""
    by_line = F.flatten(
        F.transform(
            line_array(F.col("text")),
            lambda x, i: F.transform(
                F.array_distinct(book_words(x)),
                lambda w: F.struct(w.alias("word"), (i + 1).cast("long").alias("line_no")),
            ),
        )
    )
    firsts = runs(
        F.sort_array(by_line), lambda x, prev: x["word"] != prev["word"]
    )
    return books.select(
        "doc_id",
        F.inline(
            F.transform(
                firsts,
                lambda r: F.struct(
                    r["first"]["word"].alias("word"), r["first"]["line_no"].alias("first_line")
                ),
            )
        ),
    )


def line_intersection(books: DataFrame) -> DataFrame:
    """Lines on which every part of a hyphenated vocabulary word stands alone.

    Only words that are a part of some compound of the same document leave
    its row; compounds and lines then meet on (document, part), and a line
    counts when it holds as many distinct parts as the compound has.
    """
    compounds = books.select(
        "doc_id", F.explode(F.array_distinct(_compounds(F.col("text")))).alias("word")
    )
    parts = compounds.select(
        "doc_id", "word", F.array_distinct(F.split("word", "-", -1)).alias("parts")
    ).select("doc_id", "word", F.size("parts").alias("need"), F.explode("parts").alias("part"))

    def on_lines(wanted: Column) -> Column:
        return F.flatten(
            F.transform(
                line_array(F.col("text")),
                lambda x, i: F.transform(
                    F.array_intersect(book_words(x), wanted),
                    lambda w: F.struct(w.alias("part"), (i + 1).cast("long").alias("line_no")),
                ),
            )
        )

    wanted = F.flatten(F.transform(_compounds(F.col("text")), lambda w: F.split(w, "-", -1)))
    hits = books.filter(F.contains("text", F.lit("-"))).select(
        "doc_id", F.inline(let(wanted, on_lines))
    )
    return (
        parts.join(hits, ["doc_id", "part"])
        .groupBy("doc_id", "word", "line_no", "need")
        .agg(F.count("*").alias("have"))
        .filter("have = need")
        .select("doc_id", "word", "line_no")
    )


def _compounds(text: Column) -> Column:
    return F.filter(doc_words(text), lambda w: matches(w, r"[^-]-[^-]"))
