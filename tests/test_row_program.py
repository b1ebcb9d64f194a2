"""All checks in one pass: plans, long lists, walks, and growth in the row."""

import random
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from galley.functions.arrays import scan
from galley.operators import quotes, spelling, word_checks
from galley.plans import joins, runner
from galley.plans.joins import Lookup
from galley.plans.runner import Lists, run_checks
from galley.sources import wordlists

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def words(spark, *listed):
    return Lookup.of(spark.createDataFrame([(w,) for w in listed], "word string"))


@pytest.fixture(scope="module")
def raw(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40).cache()


def test_common_checks_are_one_scan_and_no_exchange(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    text = plan(run_checks(docs, Lists(scannos=Lookup.of(wordlists.common_scannos(spark))), "t"))
    assert text.count("FileScan") == 1 and "Exchange" not in text
    assert plan(entry_points.queries()["summary"](spark, SF)).count("FileScan") == 1


def test_all_families_read_the_books_twice(spark, raw, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    asked = []
    kept = runner.Lookup.of.__func__

    def of(cls, table, *more):
        asked.append(plan(table).count("FileScan"))
        return kept(cls, table, *more)

    dictionary = words(spark, "the", "and")
    phrases = Lookup.of(spark.createDataFrame([("he", "so he was", 3)], "form string, phrase string, n long"))
    lists = Lists(dictionaries=[dictionary], hebe=phrases, scannos=words(spark, "tbe"), good=words(spark, "bo"))
    monkeypatch.setattr(Lookup, "of", classmethod(of))
    found = run_checks(docs, lists, "a")
    # once for what the documents ask, once for all checks
    assert sum(asked) + plan(found).count("FileScan") <= 3


def test_long_lists_meet_by_joins_with_the_same_findings(spark, raw, monkeypatch):
    lists = Lists(
        dictionaries=[words(spark, "the", "and", "of")],
        scannos=Lookup.of(wordlists.common_scannos(spark)),
        good=Lookup.of(wordlists.good_words(spark.createDataFrame([("die",), ("bo",), ("it on",)], "word string"))),
    )
    few = run_checks(raw, lists, "ts").cache()
    monkeypatch.setattr(spelling, "FEW", 0)
    monkeypatch.setattr(joins.Lookup.listed, "__defaults__", (0,))
    many = run_checks(raw, lists, "ts").cache()
    assert few.count() == many.count() > 100
    assert few.exceptAll(many).count() == 0


def test_a_family_alone(spark, raw):
    lists = Lists(dictionaries=[words(spark, "the", "and", "of")])
    checks = lambda f: {r["check"] for r in run_checks(raw, lists, f).select("check").distinct().collect()}
    assert checks("e") == {"edit distance"} and checks("s") == {"spelling"}
    with pytest.raises(ValueError):
        run_checks(raw, Lists(), "s")


def test_scan_puts_out_what_a_walk_does(spark):
    numbers = [random.Random(k).randint(-3, 3) for k in range(2000)]
    df = spark.createDataFrame([(numbers,), ([],)], "a array<int>")

    def step(state, x):
        return F.struct((state + x).alias("state"), F.when(x > 1, F.array(state)).otherwise(F.array().cast("array<int>")).alias("out"))

    walked = scan(F.col("a"), F.lit(0), step, "int", lambda s: F.array(s))
    total, out = 0, []
    for x in numbers:
        if x > 1:
            out.append(total)
        total += x
    assert [r[0] for r in df.select(walked).collect()] == [[*out, total], [0]]


def balanced_by_hand(marks):
    """Tags of one paragraph, and what stays open."""
    stack, told, tags = [], set(), []
    for pos, mark in marks:
        if mark in "“‘":
            if stack and stack[-1] == mark and mark not in told:
                told.add(mark)
                tags.append((pos, {"“": "CODQ", "‘": "COSQ"}[mark]))
            stack.append(mark)
        elif stack and stack[-1] == {"”": "“", "’": "‘"}[mark]:
            stack.pop()
        else:
            tags.append((pos, {"”": "UCDQ", "’": "UCSQ"}[mark]))
    return tags, stack


def test_quotes_balance_as_a_stack_does(spark):
    draw = random.Random(6)
    texts = ["".join(draw.choice("“”‘1 ") for _ in range(draw.randint(1, 60))) + "“" for _ in range(60)]
    texts += ["“1" * 300, "“1‘1" * 150 + "”1" * 10, "‘1“1" * 100 + "”1" * 100]  # deeper than one number
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {}
    for r in quotes.smart_quote_scan(rows, words(spark, "zzz")).collect():
        found.setdefault(r["doc_id"], []).append((r["pos"], r["tag"], r["item"]))
    for i, text in enumerate(texts):
        tags, stack = balanced_by_hand([(k, c) for k, c in enumerate(text) if c in "“”‘’"])
        want = sorted((p, t, text[p]) for p, t in tags) + ([(-1, "NESK", " ".join(stack))] if stack else [])
        assert sorted(found.get(i, [])) == sorted(want), text


def test_a_long_paragraph_of_quotes_takes_linear_time(spark):
    def seconds(n):
        text = "\n".join("so” it ’is’ walkin’ that” “he‘" for _ in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        begun = time.perf_counter()
        assert quotes.smart_quote_scan(df, words(spark, "walking")).count() > n
        return time.perf_counter() - begun

    seconds(200)
    assert seconds(16_000) < 3 + 8 * seconds(4_000)  # half a megabyte


def test_near_words_equal_brute_force(spark):
    draw = random.Random(8)
    pool = ["".join(draw.choices("abc", k=draw.randint(1, 8))) for _ in range(150)]
    pool += ["encyclopædia", "encyclopaedia", "Motorcar", "motorcat", "x" * 30, "x" * 29 + "y", "iv", "iii", "a-b", "ab"]
    df = spark.createDataFrame([(1, " ".join(pool))], "doc_id long, text string")
    vocab = sorted(set(pool))
    suspects = vocab[::2]
    found = spelling.edit_distance(df, spark.createDataFrame([(1, w) for w in suspects], "doc_id long, word string"))

    def apart(a, b):
        if abs(len(a) - len(b)) > 1:
            return 2
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    numeral = lambda w: not w.strip("0123456789ivxlc")
    told, want = set(), []
    for s in sorted(suspects, key=lambda w: (w.lower(), w)):
        low = s.lower()
        form = low.replace("æ", "a\U0001d68e").replace("œ", "o\U0001d68e")
        if len(form) < 5 and form.isascii() and form.isalnum():
            continue
        for t in vocab:
            other = t.lower()
            if other in (form, form + "s") or other + "s" == form or (numeral(form) and numeral(other)):
                continue
            if form.replace("-", "") == other.replace("-", "") or apart(form, other) > 1:
                continue
            if not (low in told and other in told):
                want.append((s, t))
            told |= {low, other}
    assert {(r["suspect"], r["near"]) for r in found.collect()} == set(want) and len(want) > 10


def test_a_document_of_unknown_words_does_not_square(spark):
    def seconds(n):
        draw = random.Random(n)
        own = ["".join(draw.choices("abcdefghij", k=9)) for _ in range(n)]
        df = spark.createDataFrame([(1, " ".join(own))], "doc_id long, text string")
        suspects = spark.createDataFrame([(1, w) for w in own], "doc_id long, word string")
        begun = time.perf_counter()
        spelling.edit_distance(df, suspects).count()
        return time.perf_counter() - begun

    seconds(500)
    assert seconds(16_000) < 3 + 8 * seconds(4_000)


def test_shown_lines_of_words(spark):
    text = "so so\nthe so\nso it\nnone\nso"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    chosen = spark.createDataFrame([(1, "so"), (1, "it"), (2, "so")], "doc_id long, word string")
    got = sorted((r["word"], r["line_no"], r["n_more"]) for r in word_checks.concordance(df, chosen).collect())
    assert got == [("it", 3, 0), ("so", 1, 3), ("so", 2, 3)]
    assert word_checks.concordance(df, chosen, None).count() == 5
