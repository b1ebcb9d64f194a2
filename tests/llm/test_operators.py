"""Every operator against brute force, and on rows that go wrong easily."""

import collections
import random
import re

import numpy as np
import pytest
from llm_by_hand import contaminated_by_hand, groups_by_hand, passages_by_hand, sha

from galley.llm import bpe, decontaminate, embeddings, lines, pages, pii, quality, secrets, simhash, substrings
from galley.llm.common import components, rolling, word_hashes

SF = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, th int, row string, ids string, drop int, _h string, _id long, words int"


@pytest.fixture(scope="module")
def odd_texts():
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    return [
        (1, passage + "\nsecond line here\nthird line there"),
        (2, passage + "\nsecond line here\nthird line there"),
        (2, passage + "\nsecond line here\nthird line there"),  # the same row again
        (3, "before " + passage.upper() + " after"),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (None, passage),
        (7, "a " * 4000),  # one word throughout
        (8, "b a " * 4000),
        (9, "É" + passage),
        (10, "one two"),
        (11, "x" * 50_000),
        (12, passage.replace("mu", "MU") + " " + passage),
    ]


@pytest.fixture(scope="module")
def odd_docs(spark, odd_texts):
    rows = [(i, t, 1, "r", "i", 2, "h", 3, 4) for i, t in odd_texts]
    return spark.createDataFrame(rows, CLASHING).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], CLASHING)


@pytest.fixture(scope="module")
def real_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- helpers ------------------------------------------------------------------------


def test_word_hashes_find_words_and_tell_them_apart():
    data = " one two\tone\x0bthree  é\n".encode()
    start, end, hashes = word_hashes(data)
    assert [data[a:b] for a, b in zip(start, end)] == data.split()
    assert hashes[0] == hashes[2] and len(set(hashes.tolist())) == 4
    assert len(word_hashes(b"")[0]) == 0 and len(rolling(hashes, 9)) == 0
    long = b"x" * (3 << 20) + b" y " + b"x" * (3 << 20)
    assert word_hashes(long)[2][0] == word_hashes(long)[2][2]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["component"] for r in components(df).collect()}
    assert all(found[i] == 100 for i in range(100, 161)) and all(found[i] == 7 for i in range(7, 40))
    assert components(df.limit(0)).count() == 0


# --- 1: decontamination ----------------------------------------------------------------


ITEMS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa LAMBDA mu"),
    (2, "one two"),
    (3, "two"),
    (3, "xi"),
    (10, "mu nu xi"),
    (4, None),
    (5, ""),
    (None, "alpha beta"),
    (6, "a a a a a a a a a a a"),
    (7, "Éalpha"),
]


@pytest.mark.parametrize("more", [{}, {"broadcast_bytes": 0}])
def test_decontamination(spark, odd_docs, odd_texts, more):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, w string")
    got = decontaminate.contamination(odd_docs, items, **more).drop("spans").collect()
    assert collections.Counter(map(tuple, got)) == contaminated_by_hand(odd_texts, ITEMS)
    kept = decontaminate.drop_contaminated(odd_docs, items)
    clean = [r for r in contaminated_by_hand(odd_texts, ITEMS).elements() if not r[-1]]
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in clean)


def test_decontamination_of_nothing(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(no_docs, none).count() == 0
    rows = decontaminate.contamination(odd_docs, none).collect()
    assert len(rows) == odd_docs.count() and not any(r["contaminated"] for r in rows)


# --- 2: byte-level BPE -------------------------------------------------------------------


def test_bpe_equals_the_library_and_decodes(spark, odd_docs, tokenizer):
    ranks, pattern, own = tokenizer
    draw = random.Random(3)
    pool = "abc XYZ'sé 1²½٣ßÿ\x1c\x85 ​ \t\n🙂👍🏽한漢ñ'll'vé<|endoftext|>"
    texts = ["".join(draw.choice(pool) for _ in range(draw.randint(0, 60))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for docs in (rows, odd_docs):
        encoded = bpe.encode(docs, ranks, pattern)
        out = encoded.withColumn("back", bpe.decoder(spark, ranks)("ids")).select("text", "ids", "back").collect()
        assert len(out) == docs.count()
        for r in out:
            assert r["ids"] == own.encode_ordinary(r["text"] or "")
            assert bytes(r["back"]) == (r["text"] or "").encode()


def test_bpe_of_no_rows_and_of_one_very_long_word(no_docs, tokenizer):
    ranks, pattern, own = tokenizer
    assert bpe.encode(no_docs, ranks, pattern).count() == 0
    word = "ab" * 20_000
    assert bpe.fold(word.encode(), ranks) == own.encode_ordinary(word)


# --- 3: line dedup ------------------------------------------------------------------------


def test_line_dedup_of_nothing(no_docs):
    assert lines.line_dedup(no_docs).count() == 0


@pytest.mark.parametrize("source", ["odd_docs", "real_docs", "made"])
def test_every_repeated_passage_goes(request, spark, source):
    if source == "made":
        draw = random.Random(4)
        fresh = lambda n: [f"line {draw.random()}" for _ in range(n)]
        shared = [fresh(n) for n in (2, 2, 3, 4, 5) * 4]
        made = []
        for i in range(40):  # each passage stands in two documents, among other lines
            made.append((i, "\n".join(fresh(3) + shared[i // 2] + fresh(3))))
        made += [(50, "x\nx\nx"), (51, "y\n" * 5 + "y"), (52, "a\n\nb\nc"), (53, "d\na\n\nb\n \ne"), (54, "\n\n"), (55, "a\n\n"), (56, "\na\n")]
        docs = spark.createDataFrame(made, "doc_id long, text string")
    else:
        docs = request.getfixturevalue(source)
    rows = pairs(docs)
    want = collections.Counter((i, "\n".join(x)) for (i, _), x in zip(rows, passages_by_hand(rows)))
    got = lines.drop_repeated_passages(docs)
    assert collections.Counter((i, t or "") for i, t in pairs(got)) == want
    said = collections.Counter((r["doc_id"], r["n_lines"] - r["n_removed"], r["kept_sha256"]) for r in lines.line_dedup(docs).collect())
    assert said == collections.Counter((i, 0 if t is None else len(x), sha("\n".join(x))) for (i, t), x in zip(rows, passages_by_hand(rows)))
    if source == "made":
        lost = {r["doc_id"]: r["n_removed"] for r in lines.line_dedup(docs).collect()}
        assert all(lost[i] == 0 and lost[i + 1] == len(shared[i // 2]) for i in range(0, 40, 2))
        assert (lost[50], lost[51], lost[52], lost[53]) == (0, 4, 0, 3)


# --- 4: embeddings --------------------------------------------------------------------------


def vectors_by_hand(rows):
    fine = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        scaled = np.array(v, float) / max(map(abs, v))
        fine[i] = scaled / np.linalg.norm(scaled)
    ids = sorted(fine)
    near = {i: {j for j in ids if j != i and len(fine[i]) == len(fine[j]) and fine[i] @ fine[j] >= 0.95} for i in ids}
    found = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        found[i] = (len(near[i]), min(seen))
    return [(i, *(found.get(i, (0, i)))) for i, _ in rows]


@pytest.mark.parametrize("per_cell", [20_000, 40])
def test_embedding_links(spark, per_cell):
    draw = np.random.default_rng(5)
    rows = [(int(i), v.tolist()) for i, v in enumerate(draw.normal(size=(150, 8)))]
    for k in range(120):  # tight and loose groups
        base = np.array(rows[k % 7][1])
        rows.append((200 + k, (base * draw.uniform(0.5, 2) + draw.normal(size=8) * draw.choice([0.01, 0.2])).tolist()))
    rows += [(400 + k, rows[3][1]) for k in range(60)] + [(3, rows[3][1])]
    rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [float("nan")] + [1.0] * 7), (504, [None] + [1.0] * 7)]
    rows += [(505, [float("inf")] + [1.0] * 7), (None, rows[0][1]), (506, [1.0]), (507, [2.0]), (508, [1e-300] * 8), (509, [1e300] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cell int")
    got = embeddings.near_duplicates(df, per_cell=per_cell).collect()
    assert collections.Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == collections.Counter(vectors_by_hand(rows))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_balls_cover_their_rows():
    x = embeddings._unit(np.random.default_rng(2).normal(size=(700, 3)))
    owner = embeddings.balls(x)
    assert (owner[owner] == owner).all()
    assert np.linalg.norm(x - x[owner], axis=1).max() <= embeddings.RADII[-1] + 1e-9


def loose_group(n):
    """Vectors whose cosines lie between 0.95 and 0.992, nearly all of them."""
    draw = np.random.default_rng(3)
    base = draw.normal(size=64)
    noise = draw.normal(size=(n, 64))
    return embeddings._unit(base / np.linalg.norm(base) + 0.16 * noise / np.linalg.norm(noise, axis=1, keepdims=True))


@pytest.mark.parametrize("per_cell", [20_000, 500])
def test_a_loose_group_lists_no_pairs(spark, per_cell, monkeypatch):
    counted, stored = embeddings.durable, []
    monkeypatch.setattr(embeddings, "durable", lambda df: (lambda out: (stored.append(out.count()), out)[1])(counted(df)))
    for n in (1000, 4000):
        x = loose_group(n)
        dots = x @ x.T
        inside = (dots[~np.eye(n, dtype=bool)] > 0.95).mean(), (dots[~np.eye(n, dtype=bool)] < 0.992).mean()
        assert min(inside) > 0.99
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        del stored[:]
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df, per_cell=per_cell).collect()}
        assert got == {i: (k, 0) for i, k in enumerate((dots >= 0.95).sum(axis=1) - 1)}
        # every vector and every edge once for each task it meets
        assert max(stored) <= 2 * n * (1 + 2 * -(-n // per_cell))


def test_links_are_counted_by_ball_or_by_vector():
    draw = np.random.default_rng(8)
    spots = draw.normal(size=(40, 3))
    x = embeddings._unit(np.repeat(spots, 20, axis=0) + 0.05 * draw.normal(size=(800, 3)))
    y = embeddings._unit(np.repeat(spots, 5, axis=0) + 0.2 * draw.normal(size=(200, 3)))
    n, m = draw.integers(1, 4, 800), draw.integers(1, 4, 200)
    ball = embeddings.balls(x)
    to_x, to_y, root, _ = embeddings.count_links(x, n, ball, y, m, np.arange(200), True, 0.95)
    inner, outer = (x @ x.T >= 0.95) & (ball[:, None] != ball[None, :]), y @ x.T >= 0.95
    assert (to_y == outer @ n).all() and (to_x == inner @ n + m @ outer).all()
    centres, own = np.unique(ball, return_inverse=True)
    sides = [(own[i], own[j]) for i, j in zip(*np.nonzero(inner))] + [(len(centres) + i, own[j]) for i, j in zip(*np.nonzero(outer))]
    assert all(root[a] == root[b] for a, b in sides)
    low = np.arange(len(root))  # no more hangs together than links do
    for _ in low:
        before = low.copy()
        for a, b in set(sides):
            low[[a, b]] = min(low[a], low[b])
        if (before == low).all():
            break
    assert len(set(low)) == len(set(root))


# --- 5: pages ------------------------------------------------------------------------------------

PROSE = "The cat is on the mat and it was there for the whole of the day. " * 4


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<" * 3000, ""),
        (f"<body><nav>Home</nav><article><h1>A &amp; B</h1><p>{PROSE}<p>Short.</article><footer>{PROSE}</footer>", f"A & B\n{PROSE.strip()}\nShort."),
        (f'<div class="menu"><a href=x>Home</a></div><h1>Title</h1><p>{PROSE}</p><p>Near.</p><aside>{PROSE}</aside>', f"Title\n{PROSE.strip()}\nNear."),
        (f'<article><p>{PROSE}</p><div id="comments"><p>{PROSE}</p></div><form><p>{PROSE}</p></form></article>', PROSE.strip()),
        ('<article><p>a<br>b\n\t c&nbsp;d</p><script>if (1<2) "</p>"</script><!-- <p>x --><style>p{}</style></article>', "a b c d"),
        (f'<p title="1>2">{PROSE}</p><p><a href=y>{PROSE}</a></p>', PROSE.strip()),
        ("<article><p>Enoipa.</p><p>Auxpa.</p></article>", "Enoipa.\nAuxpa."),
    ],
)
def test_main_text(page, text):
    assert pages.main_text(page) == text


CZECH = "Vesnice leží v údolí řeky a její obyvatelé tam žijí už celá staletí, přestože zimy bývají dlouhé a velmi kruté."
JAPANESE = "この村は川の谷間にあり、住民は何世紀にもわたってそこで暮らしてきた。冬は長く厳しい。"
BRIEF = "The cat is on the mat and it was there for the whole of the day, as it has to be."  # 80 to 139 signs


PROSE = (
    "This is the text of the article and it is long enough to be taken in by the rules of the "
    "first pass, as it has many of the stop words that are in a text."
)


@pytest.mark.parametrize(
    "page",
    [
        '<div class="layout has-sidebar"><nav>Home</nav><article><p>{}</p></article></div>',
        '<div class="no-sidebar"><article><p>{}</p></article></div>',
        '<div class="page with-menu"><p>{}</p></div>',
        '<div class="sidebar-left page"><p>{}</p></div>',
        '<article class="post comments-open"><p>{}</p></article>',
        "<form><main><p>{}</p></main></form>",
        "<form><div><p>{}</p></div></form>",
        "<svg><path><div><article><p>{}</p></article></div>",
        '<p>{}</p><div class="comments"><article class="comment"><p>Not this, as it is what a reader says of it.</p></article></div>',
        '<article><p>{}</p></article><div class="comments"><article id="comment-3"><p>Not this, as it is what a reader says of the text.</p></article></div>',
        '<div class="sidebar"><p>Not this, as it is in the bar beside the text of the page.</p></div><div><p>{}</p></div>',
    ],
)
def test_names_of_wrappers_do_not_empty_a_page(page):
    assert pages.main_text(page.format(PROSE)) == PROSE


@pytest.mark.parametrize("made", ["<div>{}</td>", '<div class="a-nav">{}', "<svg>{}", "<p>{}</div>", "<article>{}</article>"])
def test_pages_take_linear_time(made):
    import time

    def seconds(n):
        begun = time.perf_counter()
        pages.main_text(made.replace("{}", "") * n + PROSE + made.split("{}")[1] * n)
        return time.perf_counter() - begun

    seconds(200)
    assert seconds(16_000) < 0.5 + 8 * seconds(4_000)


@pytest.mark.parametrize(
    "lines_in",
    [
        [BRIEF] * 4,
        [CZECH] * 4,
        [CZECH + " " + CZECH, CZECH, "Krátká věta.", CZECH + " " + CZECH],
        [JAPANESE] * 3,
        ["Říčka", "Teče voda, teče,", "kolem našich vrat,", "a kdo by ji vypil,", "ten by mohl spát celý den."],
        ["One line and no more of it."],
    ],
)
def test_a_page_without_decided_blocks_keeps_its_text(lines_in):
    body = "".join(f"<p>{x}</p>" for x in lines_in)
    links = '<p><a href="/a">Domů a zpět na začátek</a></p>' * 3
    page = f"<body><nav>{CZECH}</nav>{links}<div>{body}</div>{links * 4}<p>© 2020 X</p><footer>{CZECH}</footer>"
    assert pages.main_text(page) == "\n".join(lines_in)


def test_a_page_without_text_stays_empty():
    links = '<p><a href="/a">Domů a zpět na začátek</a></p>' * 30
    assert pages.main_text(f"{links}<p>12 | 34 | 56</p><p>© 2020 X</p><nav>{CZECH}</nav>") == ""


def test_ambiguous_blocks_take_the_nearest_label():
    assert pages.second_pass([True, None, None, False], [False] * 4) == [True, True, False, False]
    assert pages.second_pass([None, None], [True, False]) == [True, False]
    assert pages.second_pass([True, None, False], [False] * 3) == [True, False, False]


def test_pages_rows(spark):
    rows = [(1, "u", f"<article><p>{PROSE}</p></article>", "t"), (2, None, None, "t"), (None, "u", "", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in pages.extract(df).collect()}
    assert got == {1: (PROSE.strip(), len(PROSE.strip())), 2: ("", 0), None: ("", 0)}
    assert pages.extract(df.limit(0)).count() == 0


# --- 6: quality -------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    rows = quality.classify(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.5) == bool(r["predicted"]) for r in rows)


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.classify(odd_docs, quality.train(odd_docs, none)).collect()
    assert len(rows) == odd_docs.count() and all(r["score"] == 0.5 for r in rows)
    assert quality.classify(no_docs, quality.train(no_docs, none)).count() == 0
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    texts = spark.createDataFrame(
        [(k, "good words in a row here" if k % 2 else "BAD!! BAD!! BAD!!") for k in range(200)] + [(300, None), (301, "")],
        "doc_id long, text string",
    )
    got = {r["doc_id"]: r for r in quality.classify(texts, quality.train(texts, labels)).collect()}
    assert all(got[k]["predicted"] == k % 2 for k in range(200)) and got[300]["score"] == got[301]["score"]


def test_labels_of_held_out_rows_are_never_learnt(spark):
    import zlib

    texts = spark.createDataFrame([(k, f"word{k % 2} other") for k in range(300)], "doc_id long, text string")
    out = [k for k in range(300) if zlib.crc32(str(k).encode()) % 3 == 1]
    labels = spark.createDataFrame([(k, k % 2) for k in out], "doc_id long, quality int")
    rows = quality.classify(texts, quality.train(texts, labels)).collect()
    assert {r["score"] for r in rows} == {0.5}
    assert sorted(r["doc_id"] for r in rows if r["held_out"]) == out


def test_one_text_of_each_labelled_id_is_learnt(spark, monkeypatch):
    good, bad = "the sea and the old house on the hill", "buy now cheap click here win win"
    texts = [(k, f"{good if k % 2 else bad} {k} {copy}" + " more" * copy) for k in range(60) for copy in range(4)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    learnt, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: (learnt.append(x), fit(x, y))[1])
    collected, kind = [], type(labels)
    to_pandas = kind.toPandas
    monkeypatch.setattr(kind, "toPandas", lambda self: (lambda out: (collected.append(out), out)[1])(to_pandas(self)))
    for rows in (texts, texts[::-1]):
        quality.train(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), labels)
    assert np.allclose(*learnt)
    ids = [out["doc_id"] for out in collected if list(out.columns) == ["doc_id", "y", "x"]]
    assert len(ids) == 2 and all(x.is_unique and len(x) for x in ids)


# --- 7: substrings ----------------------------------------------------------------------------------


def repeats_by_hand(rows):
    last = 1 << 63
    words = [(last if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone) if not g).decode()
        out.append((None if i == last else i, len(w), sum(gone), kept))
    return collections.Counter(out)


def test_substring_dedup(spark, odd_docs, odd_texts, no_docs):
    draw = random.Random(4)
    vocabulary = [f"w{k}" for k in range(40)]
    shared = [" ".join(draw.choices(vocabulary, k=draw.choice([6, 12, 13, 14, 30, 90]))) for _ in range(12)]
    texts = []
    for k in range(120):
        own = [" ".join(draw.choices(vocabulary, k=draw.randint(0, 9))) for _ in range(4)]
        texts.append((k + 100, draw.choice([" ", "\n ", "\t"]).join(x for p in zip(own, draw.sample(shared, 4)) for x in p)))
    every = texts + odd_texts
    docs = spark.createDataFrame(every, "doc_id long, text string").repartition(5)
    got = collections.Counter(map(tuple, substrings.substring_dedup(docs).collect()))
    assert got == repeats_by_hand(every)
    assert substrings.substring_dedup(odd_docs).count() == len(odd_texts)
    assert substrings.substring_dedup(no_docs).count() == 0


# --- 8: personal data -----------------------------------------------------------------------------------

RULES = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def personal_by_hand(text):
    out = []
    for kind, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = [
                True,
                kind == 1 and all(int(p) <= 255 for p in m[0].split(".")),
                12 <= len(digits) <= 19 and sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0,
                9 <= len(digits) <= 15,
            ]
            if fits[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_words_fold_alike_with_and_without_a_heap(monkeypatch):
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("by_hand", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(31)
    words = [" " + "".join(draw.choice("aabcdeeghilnorstuéß") for _ in range(draw.randint(1, 60))) for _ in range(1500)]
    words += ["a" * n for n in range(1, 90)] + ["ab" * n for n in range(1, 40)]
    want = [library.encode_single_token(w) if w.encode() in ranks else library.encode_ordinary(w) for w in words]
    want = [[ids] if isinstance(ids, int) else ids for ids in want]
    for short in (0, bpe.SHORT, 10**6):
        monkeypatch.setattr(bpe, "SHORT", short)
        assert [bpe.fold(w.encode(), ranks) for w in words] == want


def test_personal_data_rules_by_hand():
    draw = random.Random(6)
    pool = [*"@@..--++ ()0123456789aZ_%é\n🙂", "a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 123-4567", "@x.y@z.w"]
    for _ in range(6000):
        text = "".join(draw.choice(pool) for _ in range(draw.randint(0, 25)))
        assert pii.base_spans(text) == personal_by_hand(text), text


def test_personal_data_model_adds_and_keeps(spark, odd_docs, no_docs):
    model = pii.train()
    for text, kind, part in [
        ("call me at (555) 123-4567 now", "phone", "(555) 123-4567"),
        ("mail mary.smith at web dot org today", "email", "mary.smith at web dot org"),
        ("iban DE44 5001 0517 5407 3249 31 x", "iban", "DE44 5001 0517 5407 3249 31"),
        ("an id 123-45-6789.", "ssn", "123-45-6789"),
    ]:
        _, spans = pii.all_spans(text, model)
        assert [(pii.KINDS[k], text[s:e]) for s, k, e in spans] == [(kind, part)]
    for text in ["Version 2.0, and 3.0", "the years 1999 to 2004", "CC BY-NC 4.0.", "we met at the house", "12 of 144 items"]:
        assert pii.all_spans(text, model)[1] == []
    rows = pii.scan(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r["base_sha256"] for r in rows} == {sha("")}
    assert pii.scan(no_docs).count() == 0
    text = "é🙂 x@y.zz +1 (555) 123-4567"
    r = pii.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["spans"] == "email:3:9,phone:10:27" and r["base_sha256"] == sha(r["spans"])


def made_up_personal(draw):
    """``kind, span, text`` by shapes and words of their own, nothing of the training's generator."""
    names = ["mary", "jürgen", "Ana", "p.okafor", "li_wei", "tom", "kowalski", "d.singh"]
    hosts = ["acme", "riverbank", "mailhub", "uni-bonn", "openlab"]
    sentences = ["Please reach us via {} before noon.", "{}", "Contact {}; thanks", "see notes\n{}\nend", "The reply came from {} yesterday"]
    d = lambda n: "".join(draw.choice("0123456789") for _ in range(n))

    def iban(land, form):
        body = "".join(draw.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") if c == "a" else draw.choice("0123456789") for c in form)
        value = int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        whole = f"{land}{98 - value:02d}{body}"
        return whole if draw.random() < 0.5 else re.sub("(.{4})(?=.)", r"\1 ", whole)

    at, dot = draw.choice([(" at ", " dot "), (" AT ", " DOT "), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)")])
    made = {
        "email": f"{draw.choice(names)}{at}{draw.choice(hosts)}{dot}{draw.choice(['com', 'org', 'fr', 'info'])}",
        "phone": draw.choice(
            [f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0044 20 {d(4)}{d(3)}", f"0049 30 {d(7)}", f"020 {d(4)} {d(4)}", f"01 {d(2)} {d(2)} {d(2)} {d(2)}"]
        ),
        "iban": iban(*draw.choice([("GB", "aaaa" + "0" * 14), ("NL", "aaaa" + "0" * 10), ("DE", "0" * 18), ("IT", "a" + "0" * 22), ("BE", "0" * 12), ("PL", "0" * 24), ("CH", "0" * 17)])),
        "ssn": f"{d(3)}-{d(2)}-{d(4)}",
    }
    kind = draw.choice(list(made))
    return kind, made[kind], draw.choice(sentences).format(made[kind])


def test_personal_data_model_on_texts_of_another_generator():
    model, draw = pii.train(), random.Random(77)
    hits, of = collections.Counter(), collections.Counter()
    for _ in range(800):
        kind, span, text = made_up_personal(draw)
        of[kind] += 1
        hits[kind] += (kind, span) in [(pii.KINDS[k], text[s:e]) for s, k, e in pii.all_spans(text, model)[1]]
    assert min(of.values()) > 150
    assert all(hits[k] >= 0.9 * n for k, n in of.items()), (hits, of)
    clean = ["On 12 May 1987 at 10:45", "about 1 234 567 people", "page 3 of 120, volume 14", "we looked at the dot", "Section 4.2.1 (2019)", "from 1914 to 1918 and 1939 to 1945",
             "at the dot com boom of 2000", "they met at a dot on the map", "ISBN 978-3-16-148410-0", "a ratio of 0.25 to 0.75", "$1,250.00 on 03/04/2021", "room 204, floor 12", "order no. 48213 shipped 2022-11-05"]
    assert [t for t in clean if pii.all_spans(t, model)[1]] == []


def test_segmentation_is_the_best_of_all():
    model = pii.train()
    for text in ["tel (555) 123-4567 or 555-123-4567", "4111 1111 1111 1111 10.0.0.1"]:
        tokens = pii._TOKEN.findall(text)
        spans = pii.segments(tokens)
        value = model.scores(tokens, spans).max(axis=1)

        def best(at):
            if at >= len(tokens):
                return 0.0
            return max([best(at + 1), *(value[k] + best(j) for k, (i, j) in enumerate(spans) if i == at and value[k] > 0)])

        got = sum(max(model.scores(tokens, [(i, j)])[0]) for i, j, _ in model.decode(tokens))
        assert abs(got - best(0)) < 1e-9


# --- 9: secrets ---------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets_by_hand(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secret_scan(spark, odd_texts):
    draw = random.Random(7)
    pool = ["password", "Token", "secret: ", "api_key=", "=", '"', "'", " ", ":", "token=token: abcdefgh", "AKIA", "ABCDEFGHIJKLMNOPQ", "0123456789abcdef", "é", "🙂", "ſecret=abcdefgh", "https://h.example/x", "user=bob", "aB3" * 12, "\n", "x" * 150]
    texts = odd_texts + [(100 + k, "".join(draw.choice(pool) for _ in range(draw.randint(0, 40)))) for k in range(600)]
    texts += [(9000, "token=abcdefgh " * 700)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, th int")
    got = collections.Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secrets.scan(docs).collect())
    want = collections.Counter()
    for i, t in texts:
        base = secrets_by_hand(t or "")
        counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
        want[(i, *counts, sha(",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)))] += 1
    assert got == want
    assert secrets.scan(docs.limit(0)).count() == 0


def test_weak_candidates_need_a_complement(spark):
    key, far = "aB3" * 12, " filler" * 60
    texts = [
        f"login=alice then {key}",
        f"{key} alone",
        f"login=alice {far} {key}",
        f"https://db.example/x {key}",
        "https://db.example/x only",
        f"{'x ' * 95}login=alice {key}",
        f"login=alice {'x ' * 90} token=abcdefgh",
    ]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    kinds = {r["doc_id"]: [s.split(":")[0] for s in r["spans"].split(",") if s] for r in secrets.scan(docs).collect()}
    assert kinds == {0: ["login", "key"], 1: [], 2: [], 3: ["endpoint", "key"], 4: [], 5: ["login", "key"], 6: ["login", "assign"]}


def test_weak_candidates_link_over_the_gap(spark):
    draw = random.Random(11)
    word = lambda: draw.choice(["login=alice", "aB3" * draw.choice([12, 90, 300]), "https://db.example/" + "a" * draw.choice([1, 150, 900]), "token=abcdefgh"])
    texts = [" ".join(draw.choice([word(), "x" * draw.choice([50, 190, 196, 197, 198, 199, 200, 300])]) for _ in range(9)) for _ in range(400)]
    texts += [f"https://db.example/{'a' * 500} {'aB3' * 12}", f"{'aB3' * 200} {'x' * 198} login=alice", f"{'aB3' * 200} {'x' * 199} login=alice"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    role = lambda s: secrets.ROLES[secrets.KINDS[s["kind"]]] == "secret"
    want = {}
    for r in secrets.parts(docs).collect():
        every = r["base"] + r["weak"]
        gap = lambda a, b: max(a["start"], b["start"]) - min(a["end"], b["end"])
        want[r["doc_id"]] = {tuple(w) for w in r["weak"] if any(role(w) != role(o) and gap(w, o) <= secrets.SCOPE for o in every)}
    got = {r["doc_id"]: {tuple(s) for s in r["extra"]} for r in secrets.linked(secrets.parts(docs)).collect()}
    assert got == {i: s for i, s in want.items() if s}
    assert (len(got[400]), len(got[401]), 402 in got) == (2, 2, False)


# --- 10: SimHash ----------------------------------------------------------------------------------------------


def test_simhash_groups(spark, odd_docs, odd_texts, no_docs):
    draw = random.Random(8)
    long = [f"w{k}" for k in range(400)]
    texts = list(odd_texts)
    for k in range(60):
        words = list(long)
        for _ in range(draw.choice([0, 1, 2, 3, 8])):
            words[draw.randrange(400)] = f"x{draw.random()}"
        texts.append((100 + k, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = collections.Counter(map(tuple, simhash.simhash_groups(docs).collect()))
    want = groups_by_hand(texts)
    assert got == want and len({c for *_, c in want}) < len(want)
    kept = [r["doc_id"] for r in simhash.keep_one_of_each_group(docs).collect()]
    assert sorted(kept) == sorted({c for *_, c in want})
    assert simhash.keep_one_of_each_group(odd_docs).columns == odd_docs.columns
    assert simhash.simhash_groups(no_docs).count() == 0
    assert simhash.keep_one_of_each_group(no_docs).count() == 0


@pytest.mark.parametrize("limit", [1 << 21, 1 << 12])
def test_variants_meet_at_every_distance(monkeypatch, limit):
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", limit)
    draw = random.Random(9)
    marks = []
    for _ in range(20):
        base = draw.getrandbits(64)
        for d in range(8):
            marks.append(base ^ sum(1 << b for b in draw.sample(range(64), d)))
    marks = np.array(sorted(set(marks)), dtype=np.uint64)
    stars = simhash._stars(marks, np.full(len(marks), 2), 64)
    edges = {tuple(p) for s in stars for p in s.view(np.uint64).tolist()}
    root = {int(m): int(m) for m in marks}

    def find(m):
        while root[m] != m:
            m = root[m]
        return m

    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    for a, b in edges:
        root[find(b)] = find(a)
    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= 4:
                assert find(a) == find(b)


def test_a_word_is_folded_once_when_first_asked_for():
    known = bpe._Folded({bytes([b]): b for b in range(256)} | {b"ab": 256})
    assert [known[w] for w in ("ab", "aab", "ab")] == [[256], [97, 256], [256]]
    held = known.held
    assert held > 0 and len(known) == 2 and known["aab"] == [97, 256] and known.held == held
