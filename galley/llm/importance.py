"""Resampling towards a target: documents drawn by how much they look like it.

1. Every run of one to ``grams`` words is a feature and falls into one of
   ``buckets`` buckets by its CRC-32.  Two aggregations count the buckets of the
   whole corpus and of the whole target; the gain of a bucket is the scaled log
   ratio of its shares, smoothed by one.
2. The gains are one literal array of ``buckets`` integers, so a document is
   scored in its own row: the floored mean gain of its features, plus a Gumbel
   noise that depends on its id alone.  The k highest scores are then a draw
   without replacement by weight.
3. The k-th key is found by a distributed quickselect.  The composite key
   (score down, id, number of the row) has no ties; each round takes random pivot
   keys of the range that is left, counts exactly what lies below and on every
   pivot, and narrows the range.  Only the drawn rows are then sorted, by range,
   and ranked from the sizes of the sorted parts.

Rows that go wrong: a null text counts as empty and has no features, weight 0.
A null id has a weight, but no noise: its score and rank are null, it is not
drawn and not counted in N.  Repeated rows are scored alike and each can be
drawn; of rows with equal score and id the first stored goes first.  Further
columns play no part.  An empty corpus gives no rows; with an empty target all
target shares are the smoothing alone.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.arrays import let
from galley.llm.common import numbered, set_aside, text_or_empty
from galley.plans.joins import durable

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
SHARE = (10, 100)
PIVOTS = 16
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased, in order."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _features(words: Column, grams: int) -> Column:
    """All runs of one to ``grams`` words, joined by one space."""

    def runs_of(k: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0)))
        joined = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)]))
        return F.when(F.size(words) >= k, joined).otherwise(F.array().cast("array<string>"))

    return F.concat(words, *[runs_of(k) for k in range(2, grams + 1)])


def buckets_of(words: Column, grams: int = 1, buckets: int = BUCKETS) -> Column:
    """The bucket of every feature, repeats included."""
    def of(features: Column) -> Column:
        return F.transform(features, lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int"))

    # runs of words look back into the array, which is then worked out once
    return of(words) if grams == 1 else let(words, lambda w: of(_features(w, grams)))


def bucket_counts(docs: DataFrame, grams: int = 1, buckets: int = BUCKETS) -> list[int]:
    """How many features of all texts fall into each bucket: ``buckets`` numbers."""
    words = words_of(text_or_empty())
    seen = docs.select(F.explode(buckets_of(words, grams, buckets)).alias("b"))
    counts = [0] * buckets
    for row in seen.groupBy("b").agg(F.count("*").alias("n")).collect():
        counts[row["b"]] = row["n"]
    return counts


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Scaled log ratio of the smoothed shares of every bucket."""
    size = len(corpus)
    whole, aim = sum(corpus) + size, sum(target) + size
    return [
        math.floor(1000 * math.log(float((t + 1) * whole) / float((s + 1) * aim)))
        for s, t in zip(corpus, target)
    ]


def _noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of an id, in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(
    docs: DataFrame, target: DataFrame, grams: int = 1, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """``doc_id, th, n_words, n_features, weight, score`` of every row; ``th`` is
    the hash of its text."""
    table = gains(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets))
    # a literal: folded to an array of integers once, whatever the corpus holds
    gain = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")

    def scored(words: Column) -> Column:
        return let(
            buckets_of(words, grams, buckets),
            lambda b: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.size(b).cast("long").alias("n"),
                F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + F.get(gain, x)).alias("sum"),
            ),
        )

    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("th"),
        let(words_of(text_or_empty()), scored).alias("s"),
    )
    n, total = F.col("s.n"), F.col("s.sum")
    some = F.greatest(n, F.lit(1))
    return found.select(
        "doc_id",
        "th",
        F.col("s.n_words").alias("n_words"),
        n.alias("n_features"),
        ((total - F.pmod(total, some)) / some).cast("long").alias("weight"),
    ).withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))


def _key(score, doc_id, row) -> Column:
    return F.struct((-score).alias("s"), doc_id.alias("d"), row.alias("r"))


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS) -> tuple[int, int, int]:
    """The k-th smallest of the keys ``key`` (from 1), which are all different.

    Every round shrinks the range about ``pivots / 2`` times whatever the keys
    are, so the rounds grow with the logarithm of the rows.
    """

    def literal(p: tuple) -> Column:
        return F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip("sdr", p)])

    left, place, rounds = rows.select("key"), k, 0
    low = high = None
    while True:
        inside = left
        if low is not None:
            inside = inside.filter(F.col("key") > literal(low))
        if high is not None:
            inside = inside.filter(F.col("key") < literal(high))
        drawn = inside.orderBy(F.xxhash64("key.r", F.lit(rounds)), "key").limit(pivots).collect()
        at = sorted({(r["key"]["s"], r["key"]["d"], r["key"]["r"]) for r in drawn})
        counted = inside.agg(
            *[F.count_if(F.col("key") < literal(p)).alias(f"b{i}") for i, p in enumerate(at)],
            *[F.count_if(F.col("key") == literal(p)).alias(f"e{i}") for i, p in enumerate(at)],
        ).first()
        below_low = 0
        new_low, new_high = low, high
        for i, p in enumerate(at):
            below, equal = counted[f"b{i}"], counted[f"e{i}"]
            if below < place <= below + equal:
                return p
            if below + equal < place:
                new_low, below_low = p, below + equal
            else:
                new_high = p
                break
        low, high, place, rounds = new_low, new_high, place - below_low, rounds + 1


def draw(scored: DataFrame, k: int, pivots: int = PIVOTS) -> DataFrame:
    """Rows of ``scored(score, doc_id, row, ...)`` with a ``rank``: 1 to ``k`` for the
    ``k`` best of the rows marked ``able``, null for all others."""
    none = F.lit(None).cast("long").alias("rank")
    if k <= 0:
        return scored.select("*", none)
    keyed = scored.withColumn("key", _key(F.col("score"), F.col("doc_id"), F.col("row")))
    able = keyed.filter("able")
    s, d, r = kth_key(able, k, pivots)
    last = F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip("sdr", (s, d, r))])
    won = F.col("able") & (F.col("key") <= last)
    best = able.filter(F.col("key") <= last)
    ordered = durable(best.repartitionByRange("key").sortWithinPartitions("key").drop("key"))
    ranked = numbered(ordered, "rank").withColumn("rank", F.col("rank") + 1)
    rest = keyed.filter(~won).drop("key").select("*", none)
    return rest.unionByName(ranked)


def resample_keys(
    docs: DataFrame,
    target: DataFrame,
    share: tuple[int, int] = SHARE,
    min_words: int = MIN_WORDS,
    grams: int = 1,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, th, n_features, weight, score, rank`` of every row of ``docs``.

    Of the N rows with an id and ``min_words`` words or more,
    ``floor(share[0] * N / share[1])`` are drawn and ranked from 1.
    """
    stored = durable(weigh(docs, target, grams, buckets, seed))
    scored = stored.withColumn("row", F.monotonically_increasing_id()).withColumn(
        "able", F.col("score").isNotNull() & (F.col("n_words") >= min_words)
    )
    n = scored.filter("able").count()
    return draw(scored, share[0] * n // share[1]).drop("row", "able", "n_words")


def resample(docs: DataFrame, target: DataFrame, **more) -> DataFrame:
    """The drawn documents whole, all columns kept, best first.

    Rows equal in id and text are drawn together if one of them is.
    """
    drawn = resample_keys(docs, target, **more).filter("rank IS NOT NULL")
    first = drawn.groupBy("doc_id", "th").agg(F.min("rank").alias("first"))
    return (
        set_aside(docs)
        .join(first, ["doc_id", "th"])
        .orderBy("first")
        .select("row.*")
    )
