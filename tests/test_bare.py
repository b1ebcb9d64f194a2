"""Findings that are only counted: the same as whole ones, without their places and contexts."""

import random

import pytest
from pyspark.sql import functions as F

from catalog import corpora
from galley.functions import fixed_values as fx
from galley.functions.words import line_words
from galley.operators import layout_checks, paragraph_checks, word_checks
from galley.plans.joins import Lookup
from galley.plans.runner import Lists, run_checks
from galley.sources import wordlists

SF = "/root/testdata/sf0.001"
PARTS = [
    *"abehilrtwIzé09,.;:!?-–—‐\"'’‘“”[]<>&_$#*\t ­İıſß𐐀😀", *fx.RARE_ENDINGS, *fx.RARE_BEGINNINGS, *fx.COMMON_SCANNOS[:12],
    " ", " ", " ", "\n", "\n", "\n\n", "\n \n\n", "\n\n\n\n\n", "\r\n", ". ", ".a", ". a", "i. e", "ex. gr", "Mr. x", "e.” vi", "the the", " he bad",
    " to he ", ", hut ", ".” “", "to-day", "today", "to day", "a.m.", "a. m.", "Mr.", "mr ", "[1] ", "[2]", "Footnote 3:", "﻿", "McKay", "the, ", "same line\nsame line\n",
]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(23)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(1200)]
    texts += ["", "\n", "﻿\n\n\n\n\nx", "\n\n\n\n\nx\n\n\ny\n\n\n\n\nz", "a\n\t\n \n \n\r\nb"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8).cache()


def counted(found):
    return {(r[0], r[1], r[2]): r[3] for r in found.groupBy("doc_id", "check", "rule").count().collect()}


def lists(spark):
    words = lambda *listed: Lookup.of(spark.createDataFrame([(w,) for w in listed], "word string"))
    phrases = spark.createDataFrame([("he", "so he was", 3), ("be", "to be a", 4)], "form string, phrase string, n long")
    return Lists(
        scannos=Lookup.of(wordlists.common_scannos(spark)),
        good=words("bo", "it on"),
        dictionaries=[words("the", "and", "of", "so", "in", "walking")],
        hebe=Lookup.of(phrases),
    )


@pytest.mark.parametrize("families", ["t", "a"])
def test_bare_findings_of_odd_texts(spark, odd, families):
    known = lists(spark)
    whole = counted(run_checks(odd, known, families))
    assert counted(run_checks(odd, known, families, bare=True)) == whole
    assert len({k[1:] for k in whole}) > 60


def test_bare_findings_of_documents(spark):
    docs = corpora.marked(spark, SF, corpora.TYPESET)
    known = lists(spark)
    whole = counted(run_checks(docs, known))
    assert counted(run_checks(docs, known, bare=True)) == whole and len(whole) > 500


def test_bare_findings_hold_nothing_else(spark):
    docs = corpora.documents(spark, SF)
    assert run_checks(docs, Lists(), "t", bare=True).columns == ["doc_id", "check", "rule"]


def test_rare_endings_and_beginnings_are_those_of_the_words(spark):
    rng = random.Random(4)
    parts = [*fx.RARE_ENDINGS, *fx.RARE_BEGINNINGS, *"ab’‘-' 1.é𐐀😀", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(5000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    names, arrays = word_checks.line_word_places([])
    got = F.transform(F.concat(*arrays), lambda k: F.get(F.array(*[F.lit(r) for _, r in names]), k))
    want = F.flatten(F.transform(line_words(F.col("text")), word_checks._faults))
    rows = df.select("text", F.sort_array(got).alias("got"), F.sort_array(want).alias("want")).collect()
    assert [r for r in rows if r.got != r.want] == [] and {x for r in rows for x in r.want} == {r for _, r in names}


def test_stops_are_counted_as_their_spans(spark):
    rng = random.Random(6)
    parts = [*"aeigx.é𐐀𐐨😀A", ".", ". ", ".  ", ".” ", "’", " ", "\n", "\x0b", "ex", "gr", "Mr", "vi"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(8000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for spaced in (False, True):
        spans = F.coalesce(F.size(paragraph_checks._stop_spans(F.col("t"), spaced)), F.lit(0)).alias("want")
        number = F.coalesce(paragraph_checks._number_of_stops(F.col("t"), spaced), F.lit(0)).alias("got")
        rows = df.select("t", spans, number).collect()
        assert [r for r in rows if r.got != max(r.want, 0)] == [] and any(r.want > 1 for r in rows)


def test_without_gaps_nothing_of_the_spacing_is_told(spark, odd):
    text = F.col("text")
    lined = layout_checks.line_array(text)
    told = F.exists(layout_checks.spacing_of(lined), lambda s: s["suspect"] == 1) | (F.size(layout_checks.headers_of(lined)) > 0)
    assert odd.filter(told & ~layout_checks.has_gaps(text)).collect() == [] and odd.filter(told).count() > 50
