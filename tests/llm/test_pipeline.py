"""The pipeline's stages, each against brute force on what the one before kept."""

import collections

import pytest
from llm_by_hand import contaminated_by_hand, groups_by_hand, passages_by_hand

import __spark_entry__ as entry_points
import corpus_pipeline
from galley.llm import quality

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents before the first stage and after each."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns(steps):
    assert all(df.columns == COLUMNS for df in steps[:-1])
    assert steps[-1].columns == [*COLUMNS, "ids", "n_tokens", "round_trip"]


def test_bad_documents_go_and_clean_ones_stay(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {i for i, _ in rows(steps[1])}
    model = quality.train(steps[0], labels)
    scored = quality.classify(steps[0], model)
    assert kept == {r["doc_id"] for r in scored.filter("predicted = 1").collect()}
    marked = [(r["doc_id"], r["quality"]) for r in labels.collect()]
    right = sum((i in kept) == bool(q) for i, q in marked)
    assert right > 0.95 * len(marked)


def test_lines_are_dropped(steps):
    before = rows(steps[1])
    left = ["\n".join(x) for x in passages_by_hand(before)]
    want = {(i, t) for (i, old), t in zip(before, left) if t == old or t.strip(" ")}
    assert set(rows(steps[2])) == want and want != set(before)
    assert all(r["n_chars"] == len(r["text"]) for r in steps[2].collect() if r["text"])


def test_one_of_each_group_stays(steps):
    want = {c for *_, c in groups_by_hand(rows(steps[2]))}
    assert sorted(i for i, _ in rows(steps[3])) == sorted(want)


def test_contaminated_documents_go(spark, steps):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    judged = contaminated_by_hand(rows(steps[3]), items)
    assert sorted(i for i, _ in rows(steps[4])) == sorted(r[0] for r in judged.elements() if not r[-1])


def test_tokens_are_right_and_decode(steps, tokenizer):
    _, _, own = tokenizer
    for r in steps[5].collect():
        assert r["ids"] == own.encode_ordinary(r["text"] or "") and r["n_tokens"] == len(r["ids"]) and r["round_trip"]


def test_run_gives_what_the_stages_give(spark, steps):
    got = entry_points.queries()["pipeline"](spark, SF)
    assert collections.Counter(map(str, got.collect())) == collections.Counter(map(str, steps[-1].collect()))


def test_stages_take_hard_rows(spark, tmp_path):
    text = "good line one here\ngood line two here\ngood line three here"
    made = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, None, None, None, None), (None, text, "en", "s", 1), (3, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for number, some in enumerate((made, [])):
        docs = spark.createDataFrame(some, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{number}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{number}-{k}")
        assert docs.count() <= len(some)
