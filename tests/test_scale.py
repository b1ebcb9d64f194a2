"""Plans and skew: what must hold on a large cluster."""

import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from galley.functions.arrays import meet, running_sums
from galley.operators import derived, hyphen_checks, layout_checks, line_checks, paragraph_checks, quotes
from galley.operators.report import store_texts, write_findings
from galley.plans.joins import Lookup
from galley.sources.books import from_parquet
from galley.streaming.line_stream import stream_books, stream_line_findings

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


NARROW = {
    "lines": derived.lines,
    "paragraphs": derived.paragraphs,
    "vocab": derived.vocab,
    "line findings": line_checks.line_findings,
    "spacing": layout_checks.spacing_pattern,
    "duplicates": layout_checks.duplicate_lines,
    "footnotes": layout_checks.footnotes,
    "quoted paragraphs": lambda b: quotes.quoted_paragraphs(b, []),
}


@pytest.mark.parametrize("name", NARROW)
def test_document_work_needs_no_shuffle(spark, name):
    raw = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    text = plan(NARROW[name](raw))
    assert "Exchange" not in text and text.count("FileScan") == 1
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


@pytest.mark.parametrize("name", ["edit_distance", "jeebies_he", "spell_suspects", "hyphen_space", "scannos"])
def test_no_cross_join(spark, name):
    text = plan(entry_points.queries()[name](spark, SF))
    assert "Cartesian" not in text and "NestedLoop" not in text


ASKING = ["spell_suspects", "ok_words", "edit_distance", "suspect_lines", "near_pair_lines"]


@pytest.mark.parametrize("name", ASKING)
def test_a_short_dictionary_is_asked_in_the_row(spark, name, monkeypatch):
    in_row = entry_points.queries()[name](spark, SF)
    assert "Exchange" not in plan(in_row) and "Join" not in plan(in_row)
    monkeypatch.setattr(Lookup, "listed", lambda self, column, limit=0: None)
    joined = entry_points.queries()[name](spark, SF)
    assert in_row.count() == joined.count() and in_row.exceptAll(joined).count() == 0


@pytest.mark.parametrize("name", ["smart_quote_scan", "quote_overlay", "dictionary_candidates"])
def test_quotes_ask_a_short_dictionary_in_the_row(spark, name, monkeypatch):
    in_row = entry_points.queries()[name](spark, SF)
    assert "Exchange" not in plan(in_row) and "Join" not in plan(in_row)
    monkeypatch.setattr(Lookup, "listed", lambda self, column, limit=0: None)
    joined = entry_points.queries()[name](spark, SF)
    assert in_row.count() == joined.count() and in_row.exceptAll(joined).count() == 0


def test_overlaid_texts_take_few_files(spark, tmp_path):
    texts = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(" a\n\nb\n").alias("text"))
    stored = store_texts(texts, str(tmp_path / "out"))
    assert stored.exceptAll(texts).count() == 0 and stored.count() == 500
    assert len(list((tmp_path / "out").glob("**/*.parquet"))) < 50


def test_overlay_equals_its_lines(spark):
    whole = entry_points.queries()["overlay_texts"](spark, SF)
    lines = quotes.overlay_texts(entry_points.queries()["quote_overlay"](spark, SF))
    assert whole.count() == lines.count() > 0 and whole.exceptAll(lines).count() == 0


def test_lookup_join_salted_equals_broadcast(spark):
    hot = spark.range(20000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), F.col("id") % 50)).alias("word")
    )
    table = spark.createDataFrame([("hot", 1), ("w7", 2), ("other", 3)], "word string, v int")
    small, large = Lookup.of(table), Lookup.of(table, limit=0)
    assert small.small and not large.small
    for how in ["inner", "left", "left_semi", "left_anti"]:
        a = small.join(hot, ["word"], how, ["id"])
        b = large.join(hot, ["word"], how, ["id"])
        assert "Broadcast" in plan(a)
        assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_hot_key_is_spread_by_the_salt(spark):
    hot = spark.range(50000).withColumn("word", F.lit("hot"))
    table = Lookup.of(spark.createDataFrame([("hot", 1)], "word string, v int"), limit=0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = table.join(hot, ["word"], "inner", ["id"])
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 3 and max(r["count"] for r in sizes) < 50000 / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_salt_must_differ_within_a_key(spark):
    table = Lookup.of(spark.createDataFrame([(1, 2, "x")], "doc_id int, line_no int, v string"), limit=0)
    lines = spark.createDataFrame([(1, 2), (1, 3)], "doc_id int, line_no int")
    with pytest.raises(ValueError):
        table.join(lines, ["doc_id", "line_no"], "left", ["line_no"])
    joined = table.join_unique(lines, ["doc_id", "line_no"], "left")
    assert sorted(joined.collect()) == [(1, 2, "x"), (1, 3, None)] or joined.count() == 2


def test_books_are_dealt_only_when_asked(spark):
    path = f"{SF}/documents.parquet"
    assert "Exchange" not in plan(from_parquet(spark, path))
    assert from_parquet(spark, path, tasks=5).rdd.getNumPartitions() == 5


def _dense(n: int) -> str:
    """A document full of compounds, spaced, hyphened and solid, and of full stops."""
    words = [f"a{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(n)]
    return "\n".join(f"{w}-end {w} end {w}end.so  {w}.so" for w in words)


@pytest.mark.parametrize(
    "check",
    [
        hyphen_checks.hyphen_nonhyphen,
        hyphen_checks.hyphen_space,
        lambda b: paragraph_checks.para_level(b, [paragraph_checks.PARAGRAPH_RULES[1]]),
    ],
)
def test_work_in_a_row_does_not_square(spark, check):
    def seconds(n: int) -> float:
        df = spark.createDataFrame([(1, _dense(n))], "doc_id long, text string")
        begun = time.perf_counter()
        assert check(df).count() >= n / 2
        return time.perf_counter() - begun

    seconds(500)
    assert seconds(8000) < 2 + 8 * seconds(2000)  # four times the text


def test_running_sums_and_meetings(spark):
    one = spark.range(1).select(
        running_sums(F.sequence(F.lit(1), F.lit(1000))).alias("sums"),
        running_sums(F.array().cast("array<int>")).alias("none"),
        meet(F.array(*map(F.lit, "abca")), F.array(*map(F.lit, "xcaa"))).alias("met"),
    ).first()
    assert one["sums"] == [k * (k + 1) // 2 for k in range(1001)] and one["none"] == [0]
    assert [tuple(m) for m in one["met"]] == [("a", [0, 3], [2, 3]), ("c", [2], [1])]


def test_findings_files_follow_the_rows(spark, tmp_path):
    found = line_checks.line_findings(spark.read.parquet(f"{SF}/documents.parquet").repartition(40))
    stored = write_findings(found, str(tmp_path / "out"))
    assert stored.count() == found.count()
    assert len(list((tmp_path / "out").glob("*/*.parquet"))) < 40


def test_group_limit_comes_before_the_shuffle(spark):
    from galley.operators.report import first_rows

    raw = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    text = plan(first_rows(derived.lines(raw), ["doc_id"], [F.col("line_no")], 2))
    assert "WindowGroupLimit" in text


def test_a_restarted_stream_loses_nothing(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for first in (0, 10):
        rows = [(k, "a * b") for k in range(first, first + 10)]
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(source)
        own = spark.newSession()
        stream_line_findings(stream_books(own, source), target, state, ["asterisks"]).awaitTermination(120)
    assert sorted(r.doc_id for r in spark.read.parquet(target).collect()) == list(range(20))
    with pytest.raises(TypeError):
        stream_line_findings(stream_books(spark, source), target)


def test_stream_equals_batch(spark, tmp_path):
    raw = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    raw.repartition(3).write.parquet(source)
    stream = stream_line_findings(stream_books(spark, source), target, str(tmp_path / "state"))
    stream.awaitTermination(120)
    batch = line_checks.line_findings(raw).select("doc_id", "check", "rule", "line_no")
    streamed = spark.read.parquet(target).select("doc_id", "check", "rule", "line_no")
    assert streamed.count() == batch.count() and streamed.exceptAll(batch).count() == 0
