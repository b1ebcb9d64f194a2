"""Benchmark decontamination: a prefix-filtered join of items and documents.

A window is ``WINDOW`` consecutive words of an item (all of a shorter item),
seen as the set of its shingles of ``SHINGLE`` words.  It is contained in a
document only if each of its shingles is, so one necessary shingle will do as
its prefix: the rarest, by counts over all documents.  Document shingles are
joined with these prefixes; the shingle's place in the window and the lengths of
window and document bound where the window may stand.  Then the words that stand
there are compared with the window.

All of it is DataFrame work.  Only keys and places go through the join, never a
document with each of its words.  The index of prefixes is broadcast if its
measured size allows, else joined by shuffle, where adaptive execution splits
skewed keys.  Texts move only for documents with a candidate.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
lower-cased.  A null text has no words.  Items without words or without an
``item_id`` are left out; several rows of one ``item_id`` are one item.
Rows with equal ``doc_id`` and text give equal results, one for each.  Further
columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.arrays import let
from galley.llm.common import set_aside, text_or_empty
from galley.plans.joins import durable

WINDOW = 10
SHINGLE = 3
BROADCAST_BYTES = 32 << 20
_APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _words(text: Column) -> Column:
    """Words in their own case."""

    def trimmed(w: Column) -> Column:
        lead = F.when(F.get(w, F.lit(0)) == "", 1).otherwise(0)
        last = F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0)
        return F.slice(w, lead + 1, F.size(w) - lead - last)

    return let(F.split(text, _APART, -1), trimmed)


def _shingles(words: Column, sizes: list[int]) -> Column:
    """``(key, at)`` of every shingle; equal words give equal keys, letters of
    any case alike, as the words are compared in the end."""

    def of(low: Column, size: int) -> Column:
        return F.transform(
            low,
            lambda x, i: F.struct(
                F.xxhash64(F.lit(size), x, *[F.get(low, i + k) for k in range(1, size)]).alias("key"),
                i.alias("at"),
            ),
        )

    low = F.transform(words, lambda w: F.lower(w))
    return let(low, lambda a: F.concat(*[of(a, s) for s in sizes]))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``window, w, item_ids``: the distinct windows of all items."""
    listed = items.filter("item_id IS NOT NULL").select(
        F.col("item_id").cast("long").alias("item_id"), _words(_lower(text_or_empty())).alias("words")
    )
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    each = listed.filter(F.size("words") > 0).select(
        "item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("words")
    )
    return each.groupBy(F.array_join("words", " ").alias("window"), F.size("words").alias("w")).agg(
        F.collect_set("item_id").alias("item_ids")
    )


def _document_shingles(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """One row per shingle, and one at least per document."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("th"),
        _words(text_or_empty()).alias("words"),
    )
    rows = rows.select("doc_id", "th", F.size("words").alias("n_words"), _shingles(F.col("words"), sizes).alias("s"))
    return rows.select("doc_id", "th", "n_words", F.posexplode_outer("s").alias("k", "s")).select(
        "doc_id", "th", "n_words", (F.coalesce("k", F.lit(0)) == 0).alias("stands"), "s.key", "s.at"
    )


def _prefixes(docs: DataFrame, found: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """``key, entries``: the windows under the rarest of their shingles."""
    own = F.split("window", " ")
    places = F.concat(
        *[
            F.when(
                F.least(F.col("w"), F.lit(SHINGLE)) == s,
                F.filter(_shingles(own, [s]), lambda x: x["at"] <= F.col("w") - s),
            ).otherwise(F.array().cast("array<struct<key:bigint,at:int>>"))
            for s in sizes
        ]
    )
    places = found.select("*", F.explode(places).alias("p")).select("*", "p.key", "p.at").drop("p")
    vocabulary = places.select("key").distinct()
    vocabulary = F.broadcast(vocabulary) if small else vocabulary
    words = _document_shingles(docs, sizes).select("key")
    counts = words.join(vocabulary, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    rarest = (
        places.join(counts, "key", "left")
        .groupBy("window", "w", "item_ids")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "at")).alias("p"))
        .filter("p.n > 0")  # a shingle that no document has: the window stands nowhere
    )
    entry = F.struct(F.col("p.at").alias("off"), "w", "window", "item_ids")
    return rarest.groupBy(F.col("p.key").alias("key")).agg(F.collect_list(entry).alias("entries"))


def _bytes(df: DataFrame, weight: Column) -> int:
    return df.agg(F.sum(weight).alias("b")).first()["b"] or 0


def candidates(docs: DataFrame, items: DataFrame, size: int, broadcast_bytes: int) -> DataFrame:
    """``doc_id, th, n_words, copies, found``: where windows may stand."""
    found = durable(windows(items, size))
    weight = F.octet_length("window") + 16 * F.size("item_ids") + 64
    small = _bytes(found, weight) <= broadcast_bytes
    least = F.least(F.col("w"), F.lit(SHINGLE))
    sizes = [r[0] for r in found.select(least.alias("s")).distinct().orderBy("s").collect()]  # three at most
    sizes = sizes or [SHINGLE]
    index = durable(_prefixes(docs, found, sizes, small))
    rows = _document_shingles(docs, sizes)
    if small:
        met = rows.join(F.broadcast(index), "key", "left")
    else:  # the row that stands for a document is kept apart, so only met keys leave the join
        none = F.lit(None).cast(index.schema["entries"].dataType)
        alone = rows.filter("stands").withColumn("entries", none)
        met = rows.withColumn("stands", F.lit(False)).join(index, "key").unionByName(alone)
    met = met.filter(F.col("stands") | F.col("entries").isNotNull())
    start = lambda e: F.col("at") - e["off"]
    fits = F.filter("entries", lambda e: (start(e) >= 0) & (start(e) + e["w"] <= F.col("n_words")))
    placed = F.transform(
        fits, lambda e: F.struct(start(e).alias("start"), e["w"].alias("w"), e["window"].alias("window"), e["item_ids"].alias("item_ids"))
    )
    return met.groupBy("doc_id", "th", "n_words").agg(
        F.sum(F.col("stands").cast("long")).alias("copies"),
        F.flatten(F.collect_list(placed)).alias("found"),
    )


def window_hits(
    docs: DataFrame, items: DataFrame, size: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """One row per distinct ``(doc_id, text)``: ``doc_id, th, n_words, copies, hits``;
    ``hits`` are ``(start, w, item_ids)`` of every occurrence of a window."""
    every = durable(candidates(docs, items, size, broadcast_bytes))
    some = every.filter(F.size("found") > 0)
    keys = some.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["_id"]) & (a["th"] == b["_th"])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    small = 32 * keys.count() <= broadcast_bytes
    texts = texts.join(F.broadcast(keys) if small else keys, same(texts, keys), "left_semi")
    own = some.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "found")
    met = texts.dropDuplicates(["doc_id", "th"]).join(own, same(texts, own))
    met = met.select("doc_id", "th", _words(text_or_empty()).alias("words"), "found")
    here = lambda e: F.array_join(F.slice("words", e["start"] + 1, e["w"]), " ")
    true = F.transform(
        F.filter("found", lambda e: _lower(here(e)) == e["window"]),
        lambda e: F.struct(e["start"].alias("start"), e["w"].alias("w"), e["item_ids"].alias("item_ids")),
    )
    true = met.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), true.alias("hits"))
    none = F.array().cast("array<struct<start:int,w:int,item_ids:array<bigint>>>")
    return every.join(true, same(every, true), "left").select(
        "doc_id", "th", "n_words", "copies", F.coalesce("hits", none).alias("hits")
    )


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, **more) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row,
    and ``spans``: first word and end of every occurrence."""
    hits = window_hits(docs, items, size, **{"broadcast_bytes": BROADCAST_BYTES} | more)
    spans = F.array_sort(
        F.array_distinct(
            F.transform("hits", lambda h: F.struct(h["start"].alias("start"), (h["start"] + h["w"]).alias("end")))
        )
    )
    ids = F.array_distinct(F.flatten(F.transform("hits", lambda h: h["item_ids"])))
    rows = hits.select("doc_id", "n_words", "copies", spans.alias("spans"), ids.alias("ids"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["end"] - F.greatest(acc["reach"], s["start"]), F.lit(0))).alias("n"),
            F.greatest(acc["reach"], s["end"]).alias("reach"),
        ),
        lambda acc: acc["n"],
    )
    listed = F.array_join(F.array_sort(F.transform("ids", lambda i: i.cast("string"))), ",")
    result = rows.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        covered.cast("long").alias("n_hit"),
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    )
    return result.drop("copy")


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without those in which a window of an item stands."""
    bad = durable(window_hits(docs, items, size).filter(F.size("hits") > 0).select("doc_id", "th"))
    bad = bad.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    bad = F.broadcast(bad) if 32 * bad.count() <= BROADCAST_BYTES else bad
    rows = set_aside(docs)
    same = rows["doc_id"].eqNullSafe(bad["_id"]) & (rows["th"] == bad["_th"])
    return rows.join(bad, same, "left_anti").select("row.*")
