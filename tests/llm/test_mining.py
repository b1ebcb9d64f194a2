"""Hard negatives, importance resampling and toxicity against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from llm_by_hand import low
from pyspark.sql import functions as F

from galley.llm import hard_negatives, importance, toxicity

VECTORS = "vec_id long, label int, embedding array<float>, anchor int, score string, window int"
SF = "/root/testdata/sf0.001"


# --- 11: hard negatives -----------------------------------------------------------------


def negatives_by_hand(rows, n_positives=5, n_negatives=5):
    usable = set()
    for i, label, e in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        usable.add((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in e)))
    out = []
    for i, label, e in usable:
        if i % 10:
            continue
        others = {(sum(a * b for a, b in zip(e, f)), j, lab == label) for j, lab, f in usable if j != i and len(e) == len(f)}
        ordered = sorted(others, key=lambda x: (-x[0], x[1]))
        for s, j, _ in [o for o in ordered if o[2]][:n_positives]:
            fits = [o for o in ordered if not o[2] and 80 * s <= 100 * o[0] <= 100 * s]
            out += [(i, j, k + 1, o[1], s, o[0]) for k, o in enumerate(fits[:n_negatives])]
    return collections.Counter(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], VECTORS).repartition(4)
    found = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **more)
    assert found.dtypes[2] == ("rank", "int")
    return collections.Counter(map(tuple, found.collect()))


@pytest.mark.parametrize("block", [4096, 3])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(4, 20))
    rows = []
    for i in range(160):
        v = centres[i % 4] + 0.6 * draw.normal(size=20)
        rows.append((i, int(draw.integers(0, 3)), (v / np.linalg.norm(v)).astype(np.float32).tolist()))
    same = rows[7][2]
    rows += [(200 + k, k % 3, same) for k in range(60)]  # a group of equal vectors
    rows += [rows[10], rows[10], rows[20]]  # rows once more
    rows += [(30, 1, rows[31][2])]  # an id with another vector
    rows += [(300, None, same), (301, 1, None), (None, 1, same), (302, 1, [1.0, None]), (303, 1, [float("nan")] * 20)]
    rows += [(304, 1, [float("inf")] + [0.0] * 19), (310, 1, [0.0] * 20), (320, 1, []), (321, 1, []), (322, 2, [])]
    rows += [(330, 2, [0.5, 0.5]), (331, 2, [0.4, 0.5]), (332, 1, [0.4, 0.4]), (340, 0, [-x for x in same])]
    monkeypatch.setattr(hard_negatives, "ROWS_AT_ONCE", 50)
    want = negatives_by_hand(rows)
    assert len(want) > 200 and mined(spark, rows, block=block) == want


def test_hard_negatives_of_nothing(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(10, 1, [1.0, 0.0])])
    assert not mined(spark, [(10, None, None)])


def test_the_index_leaves_out_and_prunes(monkeypatch):
    draw = np.random.default_rng(1)
    q = np.floor(256 * draw.normal(size=(30, 64)) * np.geomspace(1, 0.02, 64))
    x = np.floor(256 * draw.normal(size=(500, 64)) * np.geomspace(1, 0.02, 64))
    index = hard_negatives.Index(q)
    scores = q @ x.T
    t = np.sort(scores, axis=1)[:, -5]
    i, j, s = index.at_least(np.arange(30), t, x)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(scores >= t[:, None]))))
    assert (s == scores[i, j]).all()
    assert ((index.rest * np.sqrt((x**2).sum(axis=1)).max()) < t[:, None])[:, -2].any()  # a band no anchor needs


# --- 12: importance resampling -----------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, grams):
    words = WORD.findall(low(text))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, grams + 1) for i in range(len(words) - k + 1)]


def resampled_by_hand(docs, target, grams=1, buckets=10_000, share=(10, 100), least=20):
    def counts(texts):
        return collections.Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, grams)[1])

    s, t = counts(x for _, x in docs), counts(target)
    alls, allt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (alls + buckets) / ((s[b] + 1) * (allt + buckets))))
    out = []
    for i, text in docs:
        n_words, own = features(text, grams)
        weight = sum(gain(zlib.crc32(f.encode()) % buckets) for f in own) // len(own) if own else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(own), weight, score, None, n_words])
    able = sorted((r for r in out if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: share[0] * len(able) // share[1]]):
        r[4] = k + 1
    return collections.Counter(tuple(r[:5]) for r in out)


@pytest.fixture(scope="module")
def odd_corpus():
    draw = random.Random(9)
    words = ["alpha", "Beta", "gamma7", "dé", "x", "ÉTÉ", "one-two"]
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(0, 60)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, " \n"), (None, "alpha " * 30), (None, None), (503, "y " * 50_000)]
    return rows + [rows[3]] * 3 + [(3, "another text " * 20)]


@pytest.mark.parametrize("grams,share", [(1, (10, 100)), (2, (1, 2)), (1, (0, 100))])
def test_resampling_equals_brute_force(spark, odd_corpus, grams, share):
    docs = spark.createDataFrame([(i, t, 1, "r", "k") for i, t in odd_corpus], "doc_id long, text string, row int, score string, key string")
    target = spark.createDataFrame([("alpha beta beta",), (None,), ("",)], "text string")
    got = importance.resample_keys(docs.repartition(5), target, share=share, grams=grams)
    assert got.columns == ["doc_id", "th", "n_features", "weight", "score", "rank"]
    want = resampled_by_hand(odd_corpus, ["alpha beta beta", None, ""], grams=grams, share=share)
    assert collections.Counter(map(tuple, got.drop("th").collect())) == want
    if grams == 2:
        return
    drawn = importance.resample(docs, target, share=share, grams=grams)
    assert drawn.columns == docs.columns
    ids = {r[0] for r in want if r[4] is not None}
    assert {r["doc_id"] for r in drawn.collect()} == ids


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample_keys(none, none).count() == 0
    one = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert [r["rank"] for r in importance.resample_keys(one, none, share=(1, 1)).collect()] == [1]


def test_quickselect_finds_every_place(spark):
    keys = [(random.Random(k).randint(-5, 5), k % 7, k) for k in range(60)]
    rows = spark.createDataFrame([(k,) for k in keys], "key struct<s: long, d: long, r: long>")
    for k in (1, 30, 60):
        assert importance.kth_key(rows, k, pivots=3) == sorted(keys)[k - 1]


# --- 13: toxicity -----------------------------------------------------------------------------


def clauses(text, insults=("grobblin",)):
    lexicon = toxicity.Lexicon.of({**dict.fromkeys(insults, 3.0), "vorm-": 2.5})
    names = ["total", "plain", "denied", "quoted", "aimed", "threats"]
    found = toxicity.features(text, lexicon, toxicity.grammar())
    return {n: round(math.expm1(x), 6) for n, x in zip(names, found)}


def test_clauses_tell_insults_apart():
    plain = clauses("what a grobblin this is")
    assert plain["plain"] == 1 and plain["denied"] == plain["quoted"] == plain["aimed"] == 0 and plain["total"] == 3
    aimed = clauses("you are a grobblin")
    assert aimed["aimed"] == 1 and aimed["total"] == 4
    assert clauses("a grobblin, you") ["aimed"] == 0  # the target stands in another clause
    assert clauses("grobblin that you are")["aimed"] == 1
    denied = clauses("you are not a grobblin")
    assert denied["denied"] == 1 and denied["plain"] == 0 and denied["total"] < aimed["total"]
    assert clauses("you are not never a grobblin")["denied"] == 0
    assert clauses("not here, you grobblin")["denied"] == 0  # denial ends with its part
    quoted = clauses("she said, you are a grobblin. fine")
    assert quoted["quoted"] == 1 and quoted["plain"] == 0
    assert clauses("she said so. you grobblin")["quoted"] == 0
    threat = clauses("we will hurt them")
    assert threat["threats"] == 1 and threat["aimed"] == 1
    assert clauses("vormatious vorms")["total"] == 5 and clauses("vorm")["total"] == 0  # a stem, not the word
    assert clauses("grobblin! grobblin! you grobblin")["plain"] == 3
    assert clauses("")["total"] == clauses(None)["total"] == 0


def test_a_clause_is_the_same_over_block_ends(monkeypatch):
    text = "words " * 100 + "you are " + "so " * 200 + "not a grobblin " + "more " * 100 + ". end grobblin"
    want = clauses(text)
    monkeypatch.setattr(toxicity, "BLOCK", 50)
    assert clauses(text) == want and want["denied"] == 1 and want["plain"] == 1


def test_composition_equals_running_one_after_the_other():
    first = toxicity._marking(toxicity.NOT, (toxicity.BREAK, toxicity.STOP), toxicity.DENIED)
    second = toxicity._marking(toxicity.SAID, (toxicity.STOP,), toxicity.QUOTED)
    both, draw = first.then(second, range(7)), random.Random(2)
    for _ in range(200):
        a = b = c = 0
        one, two = [], []
        for symbol in draw.choices(range(7), k=30):
            a, out, w = first.step(a, symbol)
            if out is not None:
                b, out, more = second.step(b, out)
                w += more
            one.append((out, w))
            c, out, w = both.step(c, symbol)
            two.append((out, w))
        assert one == two


@pytest.fixture(scope="module")
def toxic_docs(spark):
    draw = random.Random(3)
    common = ["lorem", "ipsum", "dolor", "amet", "you", "not", "sit", "elit,", "magna."]
    rows, labels = [], []
    for i in range(600):
        words = draw.choices(common, k=draw.randint(5, 80))
        bad = i % 4 == 0
        if bad:
            for _ in range(draw.randint(1, 4)):
                insult = draw.choice(["grobblin", "snarf", "quib" + draw.choice(["ba", "lo", "ne", "zu", "ki"]) + draw.choice("aeiou")])
                words.insert(draw.randint(0, len(words)), insult)
        rows.append((i, " ".join(words), 1, 0.5, "h"))
        labels.append((i, int(bad)))
    rows += [(None, "you snarf", 1, 0.5, "h"), (700, None, 1, 0.5, "h"), (701, "", 1, 0.5, "h"), (702, "snarf " * 40_000, 1, 0.5, "h"), rows[5], rows[5]]
    labels += [(None, 1), (700, None), (701, 0), (5, 0), (4, 1)]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, half int, score double, toxic string").repartition(3),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_toxicity_on_held_out_documents(toxic_docs):
    docs, labels = toxic_docs
    model = toxicity.train(docs, labels)
    assert set(model.lexicon.words) >= {"grobblin", "snarf"} and "quib" in model.lexicon.stems
    found = toxicity.classify(docs, model).collect()
    assert len(found) == docs.count()
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["held_out"] and r["doc_id"] < 600:
            assert r["predicted"] == (r["doc_id"] % 4 == 0), r
    by_id = {r["doc_id"]: r["predicted"] for r in found}
    assert by_id[700] == by_id[701] == 0 and by_id[702] == by_id[None] == 1
    kept = toxicity.score_documents(docs, model)
    assert kept.columns == [*docs.columns, "toxicity"]


def test_toxicity_without_labels_or_rows(spark, toxic_docs):
    docs, labels = toxic_docs
    none = toxicity.train(docs, labels.limit(0))
    assert {r["score"] < 0.01 for r in toxicity.classify(docs, none).collect()} == {True}
    only = toxicity.train(docs, labels.filter("toxic = 1"))
    assert {r["predicted"] for r in toxicity.classify(docs, only).collect()} == {1}
    assert toxicity.classify(docs.limit(0), only).count() == 0
    assert toxicity.train(docs.limit(0), labels).lexicon.words == {}


def test_held_out_accuracy_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = toxicity.classify(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter("held_out")
    n = collections.Counter((r["predicted"], r["toxic"]) for r in scored.collect())
    assert n[1, 1] >= 0.9 * (n[1, 1] + n[0, 1]) and n[1, 1] >= 0.95 * (n[1, 1] + n[1, 0])
