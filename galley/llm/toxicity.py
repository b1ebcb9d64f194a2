"""Toxicity: a weighted finite-state grammar over clauses.

1. A lexicon turns words into symbols.  Targets, negations, reporting verbs and
   threats are declared; insults are learnt: words, and stems that many different
   words begin with, whose documents are labelled toxic far more often than not.
   Their weight is the log odds of the label.  A Spark aggregation counts them over
   at most ``SAMPLE`` labelled documents, the bound of the only sample here.
2. Three transducers are composed into one deterministic machine: negation marks
   what follows it within its part of a sentence, reported speech marks what follows
   it within the sentence, and the clause machine joins insult or threat, target and
   marks to one matched clause.  Weights of words and arcs add up along the path.
3. A document is the clauses it holds: how many of each sort, how heavy, how dense.
   A logistic regression turns that into a score.  It is fitted to features from
   lexicons learnt on the other half of the labels, so that it trusts a lexicon no
   more than new documents bear out.

Only the text is an input of a score.  Labels are learnt from rows whose
``crc32(doc_id as text) mod 5`` is not 0.  A null text counts as empty; an empty
text has no clauses and is scored like any other.  A null ``doc_id`` is scored and
never learnt from.  Several labels of one document count by their mean, one text
of several of an id is learnt from.  Repeated rows are scored alike, further columns
are kept by ``score_documents`` and an empty table gives an empty one.  With no
labels, or labels of one kind only, every score is the share of toxic labels (0 if
none).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galley.llm.common import ids_and_texts

SAMPLE = 20_000
ENTRIES = 5_000
STEMS = (4, 5, 6, 7)
LEAST_DOCS = 3
LEAST_EVIDENCE = 15.0
LEAST_ODDS = 1.5
DECLARED_WEIGHT = 2.0
BLOCK = 1 << 20

# --- fixed values: the declared words -----------------------------------------------

THREATS = """
    kill murder strangle stab shoot hang beat hurt destroy crush
    töten umbringen erschießen aufhängen verprügeln vernichten
    tuer massacrer égorger étrangler frapper détruire
    matar asesinar ahorcar degollar golpear destruir
""".split()
TARGETS = """
    you your yours yourself them they their these those people everyone
    du dich dir dein deine ihr euch euer sie ihnen
    tu toi te ton tes vous votre vos eux leur
    tú ti tus usted ustedes vuestro ellos ellas
""".split()
NEGATIONS = """
    not no never nobody neither nor without isn aren wasn weren don doesn didn won cannot
    nicht kein keine keinen keiner nie niemals niemand weder ohne
    ne pas jamais aucun aucune personne sans ni
    nunca jamás ningún ninguna nadie tampoco sin
""".split()
REPORTS = """
    said says say told wrote writes called quoted quotes claimed reported according
    sagte sagt schrieb nannte zitiert behauptete berichtete laut
    dit disait écrit appelé cité affirmé selon
    dijo dice escribió llamó citó afirmó según
""".split()
TURNS = "but however although aber jedoch obwohl mais cependant pero aunque".split()

# --- transducers ----------------------------------------------------------------------

STOP, BREAK, INSULT, THREAT, TARGET, NOT, SAID = range(7)
_SYMBOL = (
    dict.fromkeys(THREATS, THREAT)
    | dict.fromkeys(TARGETS, TARGET)
    | dict.fromkeys(NEGATIONS, NOT)
    | dict.fromkeys(REPORTS, SAID)
    | dict.fromkeys(TURNS, BREAK)
    | dict.fromkeys(".!?\n", STOP)
    | dict.fromkeys(",;:", BREAK)
)
_TOKEN = re.compile(r"[^\W\d_]+|[.,;:!?\n]")

# Marks that a symbol gathers on its way: an insult that is denied, quoted, aimed ...
DENIED, QUOTED, AIMED, THREATENS = 1, 2, 4, 8
ARC_WEIGHTS = {DENIED: -2.0, QUOTED: -1.5, AIMED: 1.0, THREATENS: 0.5}


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``arcs[state, symbol] = (next state, output or None, weight)``.

    A symbol without an arc passes unchanged and weighs nothing.  State 0 is the first.
    """

    arcs: dict

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def then(self, other: Transducer, symbols: Iterable) -> Transducer:
        """The composition: what this one puts out is read by ``other``."""
        arcs, todo, number = {}, [(0, 0)], {(0, 0): 0}
        while todo:
            pair = todo.pop()
            for symbol in symbols:
                a, out, weight = self.step(pair[0], symbol)
                b = pair[1]
                if out is not None:
                    b, out, more = other.step(b, out)
                    weight += more
                if (a, b) not in number:
                    number[a, b] = len(number)
                    todo.append((a, b))
                arcs[number[pair], symbol] = (number[a, b], out, weight)
        return Transducer(arcs)


def _marking(trigger: int, ends: tuple, mark: int) -> Transducer:
    """Marks insults and threats after ``trigger``, up to a symbol of ``ends``.

    A second trigger takes the first one back where ``mark`` is denial.
    """
    arcs = {(0, trigger): (1, None, 0.0), (1, trigger): (0 if mark == DENIED else 1, None, 0.0)}
    for end in ends:
        arcs[1, end] = (0, end, 0.0)
    for base in (INSULT, THREAT):
        for marks in range(4):
            arcs[1, (base, marks)] = (1, (base, marks | mark), ARC_WEIGHTS[mark])
        arcs[1, base] = (1, (base, mark), ARC_WEIGHTS[mark])
    return Transducer(arcs)


def _clause() -> Transducer:
    """Joins what stands between two ends; puts out ``("clause", marks)`` there.

    State 0 holds nothing, 1 a target; others the marks of the insult or threat seen.
    A threat outranks an insult, and what is asserted outranks what is denied or quoted.
    """
    states = [(False, None), (True, None)] + [(t, m) for t in (False, True) for m in range(16) if not m & AIMED]
    number = {s: i for i, s in enumerate(states)}
    arcs = {}
    for (aimed, marks), i in number.items():
        new = 0.0 if aimed or marks is None else ARC_WEIGHTS[AIMED]
        arcs[i, TARGET] = (number[True, marks], None, new)
        for base in (INSULT, THREAT):
            for seen in range(4):
                own = seen | (THREATENS if base == THREAT else 0)
                kept = own if marks is None else (own & marks & 3) | ((own | marks) & THREATENS)
                weight = ARC_WEIGHTS[AIMED] if aimed and marks is None else 0.0
                weight += ARC_WEIGHTS[THREATENS] if base == THREAT else 0.0
                arcs[i, (base, seen) if seen else base] = (number[aimed, kept], None, weight)
        for end in (STOP, BREAK):
            out = None if marks is None else ("clause", marks | (AIMED if aimed else 0))
            arcs[i, end] = (0, out, 0.0)
    return Transducer(arcs)


def grammar() -> Transducer:
    """Negation, reported speech and clause, composed over the seven symbols."""
    marked = _marking(NOT, (BREAK, STOP), DENIED).then(_marking(SAID, (STOP,), QUOTED), range(7))
    return marked.then(_clause(), range(7))


# --- lexicon ----------------------------------------------------------------------------


def _blocks(text: str) -> Iterator[str]:
    """A text in pieces of about ``BLOCK`` characters, cut at white space."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end].lower()
        at = end


def _entries(words: set[str]) -> set[str]:
    """Words, and stems (with a mark at their end) of longer words."""
    return words.union(w[:k] + "-" for w in words for k in STEMS if len(w) > k)


@dataclass(frozen=True)
class Lexicon:
    """Weights of words and of stems, and the lengths that stems have."""

    words: dict[str, float]
    stems: dict[str, float]
    lengths: tuple[int, ...]

    @classmethod
    def of(cls, weights: dict[str, float]) -> Lexicon:
        stems = {e[:-1]: w for e, w in weights.items() if e.endswith("-")}
        words = {e: w for e, w in weights.items() if not e.endswith("-")}
        return cls(words, stems, tuple(sorted({len(s) for s in stems})))

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for k in self.lengths:
            if len(word) > k:
                best = max(best, self.stems.get(word[:k], 0.0))
        return best


def _next_stop(tokens: list[str], places: range) -> int | None:
    return next((i for i in places if _SYMBOL.get(tokens[i]) == STOP), None)


FEATURES = 9


def features(text: str | None, lexicon: Lexicon, machine: Transducer) -> list[float]:
    """Counts, weights and density of the matched clauses of a text."""
    n_words, total, heaviest, denied, quoted, aimed, threats, plain = 0, 0.0, 0.0, 0, 0, 0, 0, 0
    state, path = 0, 0.0
    arcs, symbol_of = machine.arcs, _SYMBOL.get

    def end_of_clause(out) -> None:
        nonlocal total, heaviest, denied, quoted, aimed, threats, plain
        marks = out[1]
        total += max(path, 0.0)
        heaviest = max(heaviest, path)
        denied += bool(marks & DENIED)
        quoted += bool(marks & QUOTED)
        aimed += bool(marks & AIMED)
        threats += bool(marks & THREATENS)
        plain += not marks & (DENIED | QUOTED | THREATENS)

    for block in _blocks(text or ""):
        tokens = _TOKEN.findall(block)
        insults = {w: x for w in set(tokens) if (x := lexicon.weight(w)) > 0}
        n_words += sum(map(str.isalpha, tokens))
        if not insults and not any(symbol_of(w) == THREAT for w in set(tokens)):
            # no clause begins here: all that can matter is the sentence a clause is in
            first, last = _next_stop(tokens, range(len(tokens))), _next_stop(tokens, range(len(tokens) - 1, -1, -1))
            if first is not None:
                tokens = tokens[: first + 1] + tokens[last + 1 :]
        for token in tokens:
            weight = insults.get(token, 0.0)
            symbol = INSULT if weight else symbol_of(token)
            if symbol is None:
                continue
            state, out, more = arcs[state, symbol]
            path += weight + more + (DECLARED_WEIGHT if symbol == THREAT else 0.0)
            if out is not None:
                end_of_clause(out)
            if symbol in (STOP, BREAK):
                path = 0.0
    out = arcs[state, STOP][1]
    if out is not None:
        end_of_clause(out)
    counts = [total, plain, denied, quoted, aimed, threats]
    return [*np.log1p(counts).tolist(), heaviest, total / (n_words + 10) ** 0.5, float(np.log1p(n_words))]


# --- learning -----------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``doc_id, toxic 0/1, half 0/1, text``: one text of each id, ``sample`` at most."""
    marks = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("double"))
        .filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg((F.avg("toxic") > 0.5).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = ids_and_texts(docs).join(F.broadcast(marks), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(
        F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("half"),
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"),
    )


def _count_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def table(seen: Counter) -> pd.DataFrame:
        rows = [(e, 2 * h + t, n) for (e, h, t), n in seen.items()]
        return pd.DataFrame(rows, columns=["entry", "cell", "n"])

    seen: Counter = Counter()
    for part in batches:
        for text, half, toxic in zip(part["text"], part["half"], part["toxic"]):
            words: set[str] = set()
            for block in _blocks(text or ""):
                words.update(w for w in _TOKEN.findall(block) if len(w) > 2)
            seen.update((e, half, toxic) for e in _entries(words))
            if len(seen) > 200_000:
                yield table(seen)
                seen = Counter()
    yield table(seen)


def _odds(a: Column, c: Column, n_a: int, n_c: int) -> Column:
    return F.log((a + 0.5) / (n_a - a + 0.5)) - F.log((c + 0.5) / (n_c - c + 0.5))


def _evidence(a: Column, c: Column, n_a: int, n_c: int) -> Column:
    """Twice the log likelihood ratio of the label and the presence of an entry."""

    def part(seen: Column, of: Column, n: float, n_all: float) -> Column:
        expected = of * (n / n_all)
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n_all, both = float(n_a + n_c), a + c
    rest = F.lit(n_all) - both
    return 2 * (
        part(a, both, n_a, n_all)
        + part(c, both, n_c, n_all)
        + part(F.lit(n_a) - a, rest, n_a, n_all)
        + part(F.lit(n_c) - c, rest, n_c, n_all)
    )


def _choose(rows: list[tuple[str, int, int]], n_a: int, n_c: int) -> dict[str, float]:
    """Weights of the entries that tell; a stem only if no longer entry does as well."""
    counts = {e: a for e, a, _ in rows}
    as_well = Counter()
    for entry, a in counts.items():
        word = entry.rstrip("-")
        for k in STEMS:
            if len(word) > k:
                as_well[word[:k] + "-"] = max(as_well[word[:k] + "-"], a)
    chosen = {}
    for entry, a, c in rows:
        odds = np.log((a + 0.5) / (n_a - a + 0.5)) - np.log((c + 0.5) / (n_c - c + 0.5))
        told = a * np.log(max(a, 1e-9) * (n_a + n_c) / (max(a + c, 1e-9) * n_a)) if a else 0.0
        if a < LEAST_DOCS or odds < LEAST_ODDS or 2 * told < LEAST_EVIDENCE:
            continue
        if entry.endswith("-") and as_well[entry] >= 0.9 * a:
            continue
        chosen[entry] = float(min(odds, 8.0))
    return chosen


def _lexicons(rows: DataFrame, totals: np.ndarray) -> tuple[Lexicon, list[Lexicon]]:
    """The lexicon of all labels, and those without the first and the second half."""
    n_c, n_a = (int(totals[:, t].sum()) for t in (0, 1))
    cells = rows.select("text", "half", "toxic").mapInPandas(
        _count_entries, "entry string, cell int, n long"
    )
    found = cells.groupBy("entry").agg(
        *[F.sum(F.when(F.col("cell") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)]
    )
    a, c = F.col("n1") + F.col("n3"), F.col("n0") + F.col("n2")
    telling = (
        found.filter((a >= LEAST_DOCS) & (_odds(a, c, n_a, n_c) >= LEAST_ODDS / 2))
        .withColumn("evidence", _evidence(a, c, n_a, n_c))
        .filter(F.col("evidence") >= LEAST_EVIDENCE / 2)
        .orderBy(F.col("evidence").desc(), "entry")
        .limit(ENTRIES)
        .collect()
    )
    whole = _choose([(r["entry"], r["n1"] + r["n3"], r["n0"] + r["n2"]) for r in telling], n_a, n_c)
    halves = []
    for h in (0, 1):  # learnt on the other half
        o = 1 - h
        counts = [(r["entry"], r[f"n{2 * o + 1}"], r[f"n{2 * o}"]) for r in telling]
        halves.append(Lexicon.of(_choose(counts, int(totals[o, 1]), int(totals[o, 0]))))
    return Lexicon.of(whole), halves


@dataclass(frozen=True)
class Regression:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = (x - self.mean) / self.scale @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, strength: float = 1.0, rounds: int = 50) -> Regression:
    """Newton steps on the logistic loss with a ridge."""
    d = x.shape[1]
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return Regression(np.zeros(d), np.ones(d), np.zeros(d), float(np.log(share / (1 - share))))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(y))])
    ridge = np.diag([strength] * d + [1e-6])
    w = np.zeros(d + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + ridge @ w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Regression(mean, scale, w[:d], float(w[d]))


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    regression: Regression

    def scorer(self):
        """A column function; the lexicon has ``ENTRIES`` words at most."""
        lexicon, regression, machine = self.lexicon, self.regression, grammar()

        @F.pandas_udf(T.DoubleType())
        def score(text: pd.Series) -> pd.Series:
            x = [features(t, lexicon, machine) for t in text]
            return pd.Series(regression.score(np.array(x, dtype=float).reshape(len(x), FEATURES)))

        return score


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Lexicon and weights from ``sample`` labelled documents at most."""
    rows = _labelled(docs, labels, sample).persist()
    totals = np.zeros((2, 2))
    for r in rows.groupBy("half", "toxic").count().collect():
        totals[r["half"], r["toxic"]] = r["count"]
    if not totals[:, 0].any() or not totals[:, 1].any():
        rows.unpersist()
        y = np.repeat([0.0, 1.0], totals.sum(axis=0).astype(int)[:2])
        return ToxicityModel(Lexicon.of({}), fit(np.zeros((len(y), FEATURES)), y))
    whole, halves = _lexicons(rows, totals)
    machine = grammar()

    def own_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = [features(t, halves[h], machine) for t, h in zip(part["text"], part["half"])]
            yield pd.DataFrame({"doc_id": part["doc_id"], "y": part["toxic"], "x": x})

    found = rows.mapInPandas(own_features, "doc_id long, y int, x array<double>").toPandas()
    rows.unpersist()
    found = found.sort_values("doc_id", kind="stable")
    return ToxicityModel(whole, fit(np.array(found["x"].tolist()), found["y"].to_numpy(dtype=float)))


def score_documents(docs: DataFrame, model: ToxicityModel, column: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1, higher for toxic text."""
    return docs.withColumn(column, model.scorer()(F.col("text").cast("string")))


def classify(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    scored = score_documents(ids_and_texts(docs), model, "score")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
