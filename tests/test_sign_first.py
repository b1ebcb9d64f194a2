"""Rules asked only where their sign stands hit what their plain patterns hit."""

import random
import re

from pyspark.sql import functions as F

from galley.functions import fixed_values as fx
from galley.functions.re2 import re2
from galley.functions.text import match_spans, matches
from galley.operators import book_checks, line_checks, paragraph_checks
from galley.sources.books import line_array

PARTS = [
    *"aeIsthzé09,.;:!?-–—‐\"'’‘“”[]<>&_$#*\t ­ İıſ",
    " ", " ", " the", " The,", " it's", " an.", " Mr,", " drs,", " ’ve ", "1st", "23d", " 1 ", "...", ". .", "&c", "Blank Page", "𐐀the,", "İan,", ",1948", "e- s", "<i>", "I”",
]


def _lines(spark, n=3000):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(9))) for _ in range(n)]
    rows = [(i, t, rng.choice(["", "x", None]), rng.random() < 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "line_no long, text string, after string, opens boolean")


def test_line_rules_hit_what_their_plain_patterns_hit(spark):
    text = F.col("text")
    plain = {"ellipsis": matches(text, *fx.ELLIPSIS)}
    plain |= {"floating quote": matches(text, *fx.FLOATING_QUOTE), "quote direction": matches(text, *fx.QUOTE_DIRECTION)}
    for name, hits, excuses in fx.SPECIAL_LINE_RULES:
        plain[name] = matches(text, *hits) & ~matches(text, *excuses) if excuses else matches(text, *hits)
    for name, parts in fx.SPECIAL_SUBSTRING_RULES:
        plain[name] = F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(text, p))
    plain["unexpected comma after word"] = matches(F.lower(text), line_checks.no_comma_pattern())
    plain["unexpected period after word"] = matches(F.lower(text), line_checks.no_period_pattern())
    lines = line_checks.with_signs(_lines(spark))
    asked = {r: c for k in line_checks.LINE_CHECKS if k != "dash check" for r, c in line_checks._rules(k)}
    pairs = [F.struct(asked[n], plain[n]).alias(f"c{k}") for k, n in enumerate(plain)]
    rows = lines.select("text", *pairs).collect()
    for k, name in enumerate(plain):
        assert [r.text for r in rows if r[k + 1][0] != r[k + 1][1]] == [], name
        assert any(r[k + 1][1] for r in rows), name


def test_dashes_of_a_line_stand_in_its_signs(spark):
    lines = line_checks.with_signs(_lines(spark))
    differ = F.col("signs").rlike(fx.DASH_ANY) != F.col("text").rlike(fx.DASH_ANY)
    assert lines.filter(differ).count() == 0


def test_spans_of_a_text_that_holds_the_marks(spark):
    texts = ["ab cab", "﷐ab﷑ cab", "", "é\U0001d68e ab\nab", "none"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(match_spans(F.col("t"), "a(b)", (1,)).alias("s")).collect()
    want = [[(m.start(), m[0], m[1]) for m in re.finditer("a(b)", t)] for t in texts]
    assert [[tuple(s) for s in r.s] for r in got] == want


def test_a_paragraph_is_searched_once_for_the_matches_of_a_rule(spark):
    df = spark.createDataFrame([("ab",)], "t string").select(match_spans(F.col("t"), "a(b)", (1,)).alias("s"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 1
    assert "regexp_replace(" in df._jdf.queryExecution().analyzed().toString()


def test_abbreviations_are_taken_out_wherever_one_stands(spark):
    rng = random.Random(3)
    parts = [*fx.STOP_ABBREVIATIONS, "A.", "É.B.", "5s.", "12d.", "x", " ", ".", "per", "Ma.m.r.", "é", "s.", "𐐀.", "𐐀.B."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(6))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pair = (paragraph_checks.without_abbreviations(F.col("t")), paragraph_checks._taken_out(F.col("t")))
    rows = df.select("t", pair[0].alias("a"), pair[1].alias("b")).collect()
    assert [r.t for r in rows if r.a != r.b] == []


def test_paragraph_ends_hit_what_their_plain_patterns_hit(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab .:?!—]\"”'’_-") for _ in range(rng.randrange(1, 6))) for _ in range(3000)]
    df = spark.createDataFrame([(t, rng.random() < 0.5) for t in texts], "text string, british boolean")
    text, rule = F.col("text"), paragraph_checks.PARAGRAPH_RULES[8]
    body = F.when(F.endswith(text, F.lit("_")), F.left(text, F.length(text) - 1)).otherwise(text)
    ended = F.when(F.col("british"), matches(body, fx.END_BRITISH)).otherwise(matches(body, fx.END_AMERICAN))
    want = ~F.startswith(text, F.lit(" ")) & ~ended
    got = F.size(paragraph_checks._all_hits(text, [rule])) > 0
    assert df.filter(want != got).count() == 0


def test_spellings_of_a_document_are_those_of_its_lines(spark):
    rng = random.Random(11)
    parts = [
        *dict(fx.SPELLING_COUNTS), " Mrs ", "a.m.", "P. m.", "a.\tm.", "to-day", "Today", "TOnIght", "tonıght", "toNİght", "to-\nday", "northeaſt", "South-West",
        "Mr.", "mr ", "Mr ", "MRS.", "mrſ.", "Drs. dr.", "Dr ", "\n", "\r\n", " ", "é", "𐐀", "M’é", "M‘b", "'", "”", "“", '"', "’", "a.",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("lined", line_array(F.col("text")))
    names = [*dict(fx.SPELLING_COUNTS), *book_checks._EXACT]
    patterns = [re2(p) for _, p in fx.SPELLING_COUNTS] + list(book_checks._EXACT.values())
    by_line = F.array(*[
        F.aggregate("lined", F.lit(0).cast("long"), lambda n, x: n + F.regexp_count(x, F.lit(p))) for p in patterns
    ])
    rows = df.select("text", by_line.alias("want"), book_checks._counts_of(F.col("text"), F.col("lined")).alias("got")).collect()
    for k, name in enumerate(names):
        assert [(r.text, r.want[k], r.got[k]) for r in rows if r.want[k] != r.got[k]] == [], name
        assert any(r.want[k] for r in rows), name


def test_spellings_are_counted_without_a_fold_over_the_lines(spark):
    df = spark.createDataFrame([("to-day\nx",)], "text string").withColumn("lined", line_array(F.col("text")))
    plan = df.select(book_checks._counts_of(F.col("text"), F.col("lined")))._jdf.queryExecution().analyzed().toString()
    assert "regexp_count" in plan or "regexp_extract_all" in plan
    assert "aggregate(lined" not in plan


def test_full_stops_after_letters_above_the_first_plane(spark):
    texts = ["𐐨.b", "a 𐐨. b", "x𐐀. b", "😀.b", "😀. b", "a.b c. d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for spaced, pattern in ((False, fx.STOP_NO_SPACE), (True, fx.STOP_SPACE)):
        spans = F.coalesce(paragraph_checks._stop_spans(F.col("t"), spaced)["item"], F.array())
        rows = df.select("t", (F.size(spans) > 0).alias("got"), matches(F.col("t"), pattern).alias("want")).collect()
        assert [r.t for r in rows if r.got != r.want] == [] and any(r.want for r in rows)
