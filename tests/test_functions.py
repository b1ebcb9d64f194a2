import random

import pytest
import regex
from pyspark.sql import functions as F

from galley.functions.arrays import counts, runs
from galley.functions.re2 import re2
from galley.functions.text import context, match_spans, title_case, trim_space
from galley.functions.words import book_words, line_words
from galley.operators import derived


@pytest.mark.parametrize(
    "pattern,text,hit",
    [
        (r"\bthe[.]", "éthe.", True),  # é is no word character
        (r"(?i)été", "ÉTÉ", True),
        (r"a\sb", "a\x0bb", False),
        (r"x$", "x\r", False),
        (r"^.$", " ", True),
        (r"[\s\p{L}]\.", "é.", True),
        (r"[^IGMS\d]", "[", True),
        (r"\b0\b", "a0", False),
        (r"\s’(m|ve)\b", "I ’ve", True),
        (r"\s’(m|ve)\b", "I ’vex", False),
    ],
)
def test_dialect(spark, pattern, text, hit):
    got = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(re2(pattern))).first()[0]
    assert got is hit


def snippet(text, at):
    """The window rule, one character at a time."""
    lo, hi = at - 30, at + 30
    if lo < 0:
        lo, hi = 0, 60
    if hi >= len(text):
        lo, hi = len(text) - 60, len(text)
    lo = max(lo, 0)
    while lo > 0 and text[lo] != " ":
        lo -= 1
    while hi < len(text) and text[hi] != " ":
        hi += 1
    return text[lo:hi].strip().replace("  ", " ").replace("  ", " ")


def test_context_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        text = "".join(rng.choice("abé  \U0001d68e ’x") for _ in range(rng.randrange(1, 200)))
        rows.append((text, rng.randrange(len(text))))
    df = spark.createDataFrame(rows, "t string, at int")
    got = df.select("t", "at", context(F.col("t"), F.col("at")).alias("c")).collect()
    assert [r.c for r in got] == [snippet(r.t, r.at) for r in got]


def cut_twice(text, masks, word):
    for pattern, mark in masks:
        for _ in range(2):
            text = regex.sub(pattern, lambda m: m[1] + mark + m[2], text)
    return text


def test_words_against_masking(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab1-’‘' .é") for _ in range(rng.randrange(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(line_words(F.col("t")).alias("l"), book_words(F.col("t")).alias("b")).collect()
    for text, row in zip(texts, got):
        m = cut_twice(
            text,
            [
                (r"(\p{L})-(\p{L})", "①"),
                (r"(\p{L})’(\p{L})", "②"),
                (r"(\p{L})‘(\p{L})", "③"),
                (r"(\P{L}|^)’(\p{L})", "②"),
            ],
            None,
        )
        back = str.maketrans("①②③", "-’‘")
        assert row.l == [w.translate(back) for w in regex.findall(r"[\p{L}\p{N}]+", m)]
        m = cut_twice(text, [(r"(\p{L})'(\p{L})", "①"), (r"(\p{L})’(\p{L})", "②")], None)
        back = str.maketrans("①②", "'’")
        found = regex.findall(r"[\p{L}\p{N}\-]+", m.replace("--", " "))
        assert row.b == [w.translate(back) for w in found]


def test_title_case(spark):
    df = spark.createDataFrame(
        [("rose-ann",), ("o’clock",), ("ßa",), ("éa b",), ("x_y",)], "w string"
    )
    got = [r[0] for r in df.select(title_case(F.col("w"))).collect()]
    assert got == ["Rose-Ann", "O’clock", "ßa", "Éa B", "X_y"]


def test_runs_and_counts(spark):
    df = spark.createDataFrame([([1, 2, 3, 7, 8, 1],), ([],)], "a array<int>")
    got = df.select(runs(F.col("a"), lambda x, p: x != p + 1).alias("r")).collect()
    assert [(r["first"], r["last"], r["size"]) for r in got[0].r] == [(1, 3, 3), (7, 8, 2), (1, 1, 1)]
    assert got[1].r == []
    words = spark.createDataFrame([(["b", "a", "b"],)], "a array<string>")
    assert [(w["word"], w["n"]) for w in words.select(counts(F.col("a")).alias("c")).first().c] == [
        ("a", 1),
        ("b", 2),
    ]


def test_match_spans(spark):
    df = spark.createDataFrame([("x ab é ab",), ("none",)], "t string")
    got = [[(s["at"], s["item"], s["g1"]) for s in r.s] for r in df.select(
        match_spans(F.col("t"), "a(b)", (1,)).alias("s")).collect()]
    assert got == [[(2, "ab", "b"), (7, "ab", "b")], []]


def test_lines_and_paragraphs(books):
    df = books("", "\n", "﻿a\r\nb\n", "a\n\n\n b \nc\r\n", "x\r")
    got = {}
    for r in derived.lines(df).orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {1: [""], 2: ["a", "b"], 3: ["a", "", "", " b ", "c"], 4: ["x\r"]}
    paras = [(r.doc_id, r.first_line, r.last_line, r.text) for r in derived.paragraphs(df).collect()]
    assert sorted(paras) == [(2, 1, 2, "a b"), (3, 1, 1, "a"), (3, 4, 5, " b  c"), (4, 1, 1, "x\r")]


def test_invariants(spark):
    from catalog import corpora as C

    docs = C.documents(spark, "/root/testdata/sf0.001")
    n_lines = derived.lines(docs).count()
    assert derived.line_counts(docs).agg(F.sum("n")).first()[0] == n_lines
    n_chars = derived.lines(docs).agg(F.sum(F.length("text"))).first()[0]
    assert derived.char_histogram(docs).agg(F.sum("n")).first()[0] == n_chars
    n_words = derived.postings(docs).count()
    assert derived.vocab(docs).agg(F.sum("n")).first()[0] == n_words
    assert derived.vocab(docs.repartition(3)).exceptAll(derived.vocab(docs)).count() == 0


def test_trim_space(spark):
    df = spark.createDataFrame([("　  a \t ",)], "t string")
    assert df.select(trim_space(F.col("t"))).first()[0] == "a"
