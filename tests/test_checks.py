import random

import pytest
import regex
from pyspark.sql import functions as F

from galley.operators import (
    hyphen_checks,
    layout_checks,
    line_checks,
    paragraph_checks,
    quotes,
    report,
    spelling,
    word_checks,
)
from galley.plans.joins import Lookup
from galley.plans.runner import Lists, run_checks
from galley.sources import wordlists


def rules_of(df):
    return sorted((r.rule, r.line_no) for r in df.collect())


def test_dash_classes(books):
    legal = "food—pizza—originated\n“What if we—”\ntell him— Wait\nMr. —— had\n3–4 555‒1212\n--------\nwell-known\nend—"
    assert line_checks.line_findings(books(legal), ["dash check"]).count() == 0
    faults = "a -- b\na - b\nx‐ y\nx‑ y\nx‒y\nx–y\nx — y\nx⸺y"
    got = rules_of(line_checks.line_findings(books(faults), ["dash check"]))
    assert [r for r, _ in sorted(got, key=lambda g: g[1])] == [
        "adjacent dashes",
        "hyphen-minus",
        "hyphen",
        "non-breaking hyphen",
        "figure dash",
        "en-dash",
        "em-dash",
        "unrecognized dash",
    ]


def test_dash_may_open_a_paragraph(books):
    # a lone dash that opens a paragraph leaves an empty line behind it
    text = "a\n\n— so\n\n—\n—\n— so — it"
    got = rules_of(line_checks.line_findings(books(text), ["dash check"]))
    assert got == [("em-dash", 7)]


def test_ellipsis_and_layout(books):
    text = "give... us\ngive....us\ngive.. us\ngive .....us\n... us\ngive ...\ncars. ...\nfine…"
    assert line_checks.line_findings(books(text), ["ellipsis"]).count() == 7
    spaced = "a\n\nb\n\nc\n\nd\n\n\n\n\nHEAD\nTWO\n\n\n\nz"
    got = [(r.label, r.pattern, r.suspect) for r in layout_checks.spacing_pattern(books(spaced)).collect()]
    assert got == [(0, "1..1", 0), (11, "43", 0)]
    assert [r.text for r in layout_checks.headers(books(spaced)).collect()] == ["HEAD TWO"]


def test_footnote_series(books):
    text = "x[1] [2] [4]\n[1] note\n  Footnote 2: a\n[Footnote 3: b\n[0]\n[7] c [1]"
    anchors = layout_checks.footnote_anchors(books(text)).orderBy("series_no").collect()
    assert [(r.start, r.end, r.n) for r in anchors] == [(1, 2, 2), (4, 4, 1), (1, 1, 1)]
    notes = layout_checks.footnotes(books(text)).orderBy("series_no").collect()
    assert [(r.start, r.end, r.n) for r in notes] == [(1, 3, 3), (7, 7, 1)]


def test_repeats(books):
    got = paragraph_checks.repeated_words(books("the the the cat a a\nis is")).collect()
    assert [r.word for r in got] == ["the", "the", "is"]
    dup = layout_checks.duplicate_lines(books("a\nb\nc\n\na\nb\nd\na")).collect()
    assert [(r.start, r.end, r.n) for r in dup] == [(1, 2, 2)]


def test_hyphens(books):
    got = hyphen_checks.hyphen_nonhyphen(books("motor-car motorcar motorcar 4-5 45")).collect()
    assert [(r.solid, r.n_solid, r.hyphenated, r.n_hyphenated) for r in got] == [
        ("motorcar", 2, "motor-car", 1)
    ]
    spaced = hyphen_checks.hyphen_space(books("a To-day it\nx to day y\nto day")).collect()
    assert sorted((r.form, r.line_no) for r in spaced) == [("hyphenated", 1), ("spaced", 2)]


def one_edit(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_blocking_misses_no_pair(spark):
    rng = random.Random(3)
    words = set()
    for size in [1, 2, 5, 12, 23, 24, 25, 26, 27, 40]:
        for _ in range(12):
            base = "".join(rng.choice("ab") for _ in range(size))
            words.add(base)
            i = rng.randrange(size)
            words |= {base[:i] + base[i + 1 :], base[:i] + "c" + base[i:], base[:i] + "c" + base[i + 1 :]}
    words = sorted(w for w in words if w)
    df = spark.createDataFrame([(w,) for w in words], "w string")
    keys = {r.w: set(r.k) for r in df.select("w", spelling.blocking_keys(F.col("w")).alias("k")).collect()}
    for a in words:
        for b in words:
            if one_edit(a, b):
                assert keys[a] & keys[b], (a, b)


def greedy(vocab, suspects):
    """Pairs in reading order, told words remembered."""
    told, done, out = set(), set(), []
    for s in sorted(suspects, key=lambda w: (w.lower(), w)):
        x = s.lower().replace("æ", "a\U0001d68e").replace("œ", "o\U0001d68e")
        if len(x) < 5 and not regex.sub(r"[a-zA-Z0-9’]", "", x):
            continue
        for t in sorted(vocab):
            y = t.lower()
            if (x in told and y in told) or (s, t) in done or x == y or x == y + "s" or x + "s" == y:
                continue
            if not x.strip("0123456789ivxlc") and not y.strip("0123456789ivxlc"):
                continue
            if x.replace("-", "") == y.replace("-", "") or not one_edit(x, y):
                continue
            out.append((s, t))
            done.add((t, s))
            told |= {y, s.lower()}
    return sorted(out)


def test_edit_distance_is_the_greedy_rule(books, spark):
    rng = random.Random(4)
    texts = []
    for _ in range(6):
        texts.append(
            " ".join(
                "".join(rng.choice("aAbœiv-") for _ in range(rng.randrange(4, 7))).strip("-") or "aaaaa"
                for _ in range(80)
            )
            + " œuvre ouvre oeuvre oeuvres xxiii xxiiv"
        )
    df = books(*texts)
    from galley.operators.derived import vocab

    rows = vocab(df).collect()
    suspects = [(r.doc_id, r.word) for r in rows if len(r.word) % 2 or "œ" in r.word]
    given = spark.createDataFrame(suspects, "doc_id long, word string")
    got = spelling.edit_distance(df, given).collect()
    for doc in range(len(texts)):
        words = [r.word for r in rows if r.doc_id == doc]
        want = greedy(words, [w for d, w in suspects if d == doc])
        assert sorted((r.suspect, r.near) for r in got if r.doc_id == doc) == want
    assert got


def scan_by_hand(text, accepted):
    """The quote scan step by step over a list of lines."""
    raw = text.split("\n")
    buf = raw + [""]
    for i, s in enumerate(buf):
        for _ in range(2):
            s = regex.sub(r"(\p{L})’(\p{L})", r"\1▿\2", s)
        s = regex.sub(r"(?i)(^|\P{L})(wher|ther|o|an|ha|t)’($|\P{L})", r"\1\2▿\3", s)
        lead = "way|twas|twill|twould|twere|uns|fore|most|em|ud|cos|cept|ll|less|[0-9]+"
        buf[i] = regex.sub(rf"(?i)(^|\P{{L}})’({lead})($|\P{{L}})", r"\1▿\2\3", s)
    found = [m[1] for s in buf for m in regex.findall(r"(^|\P{L})(’\p{L}+)(\P{L}|$)", s)]
    for word in {w for w in found if found.count(w) > 1}:
        buf = [s.replace(word, word.replace("’", "▾")) for s in buf]
    for i in range(len(buf) - 1):
        s = regex.sub("‘([^’]+)’", r"⸢\1⸣", buf[i] + " " + buf[i + 1])
        buf[i], buf[i + 1] = s[: len(buf[i])], s[len(buf[i]) + 1 :]
    for pattern, read, plain in [
        (r"(^|\P{L})(\p{L}+?in)’(\P{L}|$)", "{}g", "{}’"),
        (r"(^|\P{L})’(\p{L}+)(\P{L}|$)", "h{}", "’{}"),
        (r"(^|\P{L})(\p{L}+)s’(\P{L}|$)", "{}", "{}s’"),
    ]:
        stems = {m[1] for s in buf for m in regex.findall(pattern, s)}
        for stem in stems:
            if read.format(stem) in accepted:
                word = plain.format(stem)
                buf = [s.replace(word, word.replace("’", "▵")) for s in buf]
    tags, stack, told = [], [], set()
    for i, s in enumerate(buf):
        if not s.strip():
            if stack:
                tags.append((i, -1, "NESK", " ".join(stack)))
            stack, told = [], set()
            continue
        for at, c in enumerate(s):
            top = stack[-1] if stack else ""
            if c in "“‘":
                if top == c and c not in told:
                    told.add(c)
                    tags.append((i + 1, at, "CODQ" if c == "“" else "COSQ", c))
                stack.append(c)
            elif c in "”’":
                if top == {"”": "“", "’": "‘"}[c]:
                    stack.pop()
                else:
                    tags.append((i + 1, at, "UCDQ" if c == "”" else "UCSQ", c))
    return sorted(tags)


def test_quote_scan_against_hand_scan(books, spark):
    rng = random.Random(5)
    bits = ["“", "”", "‘", "’", "\n", "\n\n", " \n", " ", " ", "goin’", "’ouse", "dogs’", "’tis", "o’", "don’t", "ab", "’em", "x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) + "." for _ in range(150)]
    accepted = {"going", "house", "dog"}
    words = Lookup.of(spark.createDataFrame([(w,) for w in accepted], "word string"))
    got = {}
    for r in quotes.smart_quote_scan(books(*texts), words).collect():
        got.setdefault(r.doc_id, []).append((r.line_no, r.pos, r.tag, r.item))
    for i, text in enumerate(texts):
        if sum(".’" in s for s in text.split("\n")) > sum(".”" in s for s in text.split("\n")):
            continue
        assert sorted(got.get(i, [])) == scan_by_hand(text, accepted), text


def test_good_words_and_scannos(books, spark):
    listed = spark.createDataFrame([("﻿rose-ann",), ("",), ("don't",), ("Paris",)], "word string")
    good = {r.word for r in wordlists.good_words(listed).collect()}
    assert good == {"rose-ann", "Rose-Ann", "ROSE-ANN", "don’t", "Don’t", "DON’T", "Paris", "PARIS"}
    lookup = Lookup.of(wordlists.common_scannos(spark))
    hits = word_checks.scannos(books("the arid Car is\ncaring"), lookup).collect()
    assert sorted((r.word, r.context) for r in hits) == [
        ("Car", "the arid ⟦Car⟧ is"),
        ("arid", "the ⟦arid⟧ Car is"),
    ]


def test_good_words_are_no_scannos(books, spark):
    listed = Lookup.of(wordlists.common_scannos(spark))
    good = Lookup.of(spark.createDataFrame([("arid",)], "word string"))
    left = word_checks.scannos_without(listed, good)
    hits = word_checks.scannos(books("the arid Arid car"), left).collect()
    assert sorted(r.word for r in hits) == ["Arid", "car"]


def test_good_words_are_cloaked(books, spark):
    good = Lookup.of(spark.createDataFrame([("avec-trollop",)], "word string"))
    known = Lookup.of(spark.createDataFrame([("the",)], "word string"))
    got = spelling.spell_suspects(books("the avec-trollop avec 4th zig-zag"), [known], good)
    assert sorted(r.word for r in got.collect()) == ["avec", "zag", "zig"]


@pytest.mark.parametrize(
    "good, left",
    [
        ("’tis", ["York", "Yorkville", "a", "goin", "New", "rose"]),
        ("goin’", ["York", "Yorkville", "a", "tis", "New", "rose"]),
        ("New York", ["a", "goin", "tis", "ville", "York", "rose"]),
        ("rose", ["New", "York", "Yorkville", "a", "goin", "tis"]),
    ],
)
def test_good_words_are_cloaked_where_they_stand(books, spark, good, left):
    text = "so ’tis a rose\nNew Yorkville goin’ York roses ’tis"
    listed = Lookup.of(spark.createDataFrame([(good,)], "word string"))
    known = Lookup.of(spark.createDataFrame([("so",), ("s",), ("roses",)], "word string"))
    got = spelling.spell_suspects(books(text, "so"), [known], listed)
    assert {r.word for r in got.collect()} == {w for w in left if len(w) > 1}


def test_suspects_and_near_pairs_come_with_their_lines(books, spark):
    df = books("the colour\nthe colour colour\nthe color of it\nthe coler here\nthe coler")
    known = Lookup.of(spark.createDataFrame([(w,) for w in "the of it here colour".split()], "word string"))
    suspects = spelling.spell_suspects(df, [known])
    got = sorted(spelling.suspect_lines(df, suspects).select("word", "line_no", "n_more", "context").collect())
    assert [tuple(r) for r in got] == [
        ("coler", 4, 0, "the ⟦coler⟧ here"),
        ("coler", 5, 0, "the ⟦coler⟧"),
        ("color", 3, 0, "the ⟦color⟧ of it"),
    ]
    pairs = spelling.edit_distance(df, suspects)
    near = {(r.word, r.line_no) for r in spelling.near_pair_lines(df, pairs, 1).collect()}
    assert {("color", 3), ("colour", 1)} <= near


def test_summary_by_document(books):
    found = line_checks.line_findings(books("*\n*", "*", "none"), ["asterisks"])
    assert sorted((r.doc_id, r.n) for r in report.summary_by_doc(found).collect()) == [(0, 2), (1, 1)]


def test_families(books, spark):
    text = "A  line * here\nto-day to day x to day y\n\n“open quote"
    known = Lookup.of(spark.createDataFrame([("line",)], "word string"))
    lists = Lists(dictionaries=[known])
    checks = lambda f: {r.check for r in run_checks(books(text), lists, f).collect()}
    assert "asterisks" in checks("t") and "hyphenation" not in checks("t")
    assert {"asterisks", "hyphenation"} <= checks("2")
    assert checks("q") == {"smart quotes"} and checks("s") == {"spelling"}


def test_report_limit(books):
    found = line_checks.line_findings(books("*\n" * 9), ["asterisks"])
    got = report.limited_report(found).collect()
    assert sorted(r.line_no for r in got) == [1, 2, 3, 4, 5] and {r.n_more for r in got} == {4}
