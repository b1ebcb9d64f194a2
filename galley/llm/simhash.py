"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within four bits have a common variant within two bits of
each.  So every fingerprint stands for all its variants within two bits, the
variants are shuffled, and equal ones give links.  A variant is dealt by its
leading bits: one shuffled row (leading bits, fingerprint, flips left) stands
for all variants that begin with these bits, and the task that receives it
writes them out.  This is the same set of variants, some fifty rows instead of
2081.

All fingerprints around one variant are within four bits of each other, so a
star from the smallest of them carries every link into the components.

Nulls: a null text has no words and so fingerprint zero; a null ``doc_id`` is a
row like any other and is never the smallest unless its whole group has none.
Repeated rows and equal texts share a fingerprint.  An empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.common import components, ids_and_texts, set_aside
from galley.plans.joins import durable

SHINGLE = 4
RADIUS = 4
SEED = 42
PER_PREFIX = 512  # fingerprints meant to share their leading bits
VARIANTS_AT_ONCE = 1 << 21


def fingerprint(text: str | None) -> int:
    """64 bits; a bit is set if it is in more than half the shingles' hashes."""
    import xxhash

    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    first, last = starts[:n].tolist(), ends[size - 1 :].tolist()
    for at in range(0, n, 1 << 16):
        pairs = zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)])
        hashes = np.array([digest(line[s:e], SEED) for s, e in pairs], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist())


def _fingerprint_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        marks = [fingerprint(t) for t in part["text"]]
        part["fp"] = np.array(marks, dtype=np.uint64).view(np.int64)
        yield part[["doc_id", "text_hash", "fp"]]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp``: one row per row of ``docs``."""
    rows = ids_and_texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInPandas(_fingerprint_batches, "doc_id long, text_hash long, fp long")


def _masks(bits: int, flips: int) -> np.ndarray:
    """Masks of exactly ``flips`` of the lowest ``bits`` bits."""
    if bits < flips:
        return np.empty(0, dtype=np.uint64)
    picked = np.array(list(combinations(range(bits), flips)), dtype=np.uint64)
    return (np.uint64(1) << picked).sum(axis=1, dtype=np.uint64)


def _stars(marks: np.ndarray, left: np.ndarray, bits: int) -> list[np.ndarray]:
    """Pairs (smallest, other) around every variant that two fingerprints share.

    ``marks`` agree with the variants in all but the lowest ``bits`` bits, of
    which ``left[i]`` may still be flipped.  Too many variants for one array
    are split by the next bits, and each part is done alone.
    """
    per = np.array([1, 1 + bits, 1 + bits + bits * (bits - 1) // 2])
    if per[left].sum() > VARIANTS_AT_ONCE and bits > 8 and len(marks) > 64:
        low, high = bits - 4, np.uint64(15) << np.uint64(bits - 4)
        out = []
        for at in range(16):
            off = ((marks & high) >> np.uint64(low)) ^ np.uint64(at)
            flips = np.bitwise_count(off).astype(np.int64)
            fits = flips <= left
            out += _stars(marks[fits], left[fits] - flips[fits], low)
        return out
    variants, owners = [], []
    low_bits = np.uint64((1 << bits) - 1)
    for flips in range(RADIUS // 2 + 1):
        who = np.flatnonzero(left >= flips)
        masks = _masks(bits, flips)
        if len(who) and len(masks):
            variants.append(((marks[who] & low_bits)[:, None] ^ masks[None, :]).ravel())
            owners.append(np.repeat(who, len(masks)))
    if not variants:
        return []
    values, owner = np.concatenate(variants), np.concatenate(owners)
    ordered = np.sort(values)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(shared):
        return []
    place = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
    met = shared[place] == values
    place, who = place[met], marks[owner[met]].view(np.int64)
    order = np.lexsort((who, place))
    place, who = place[order], who[order]
    opens = np.concatenate(([True], place[1:] != place[:-1]))
    least = who[np.flatnonzero(opens)][np.cumsum(opens) - 1]
    pairs = np.unique(np.stack((least, who), axis=1)[least != who], axis=0)
    apart = np.bitwise_count(pairs[:, 0].view(np.uint64) ^ pairs[:, 1].view(np.uint64))
    return [pairs[apart <= RADIUS]]


def links(marks: DataFrame) -> DataFrame:
    """``a, b`` between distinct fingerprints ``fp`` that span every group of
    fingerprints linked at four bits or fewer."""
    n = marks.count()
    lead = int(np.clip(np.ceil(np.log2(max(n, 1) / PER_PREFIX)), 4, 24))
    flips = [(m, k) for k in range(RADIUS // 2 + 1) for m in _masks(lead, k).tolist()]
    prefix = F.shiftrightunsigned("fp", 64 - lead)
    dealt = marks.select(
        "fp",
        prefix.alias("p"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(RADIUS // 2 - k).alias("k")) for m, k in flips])).alias("f"),
    ).select(F.col("p").bitwiseXOR(F.col("f.m")).alias("p"), "fp", F.col("f.k").alias("k"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        found = _stars(
            group["fp"].to_numpy(np.int64).view(np.uint64), group["k"].to_numpy(np.int64), 64 - lead
        )
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.groupBy("p").applyInPandas(meet, "a long, b long").distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp, component_id`` of every row: the smallest
    ``doc_id`` that is reachable over links of four bits or fewer."""
    marked = durable(fingerprints(docs))
    marks = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(marks.select("fp")))
    grouped = marks.join(found, marks["fp"] == found["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    lowest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    named = grouped.join(lowest, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id``; ``fingerprint`` in 16 hex digits."""
    return near_groups(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """The row of each group with the smallest ``doc_id`` (null last, then the
    smallest text hash); all columns of ``docs``, equal rows once."""
    groups = near_groups(docs)
    # rows with no doc_id group by their fingerprint's component only if it has no id at all
    best = groups.groupBy(
        F.coalesce("component_id", "fp").alias("g"), F.col("component_id").isNull().alias("none")
    ).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("b"))
    keep = best.select(F.col("b.doc_id").alias("_id"), F.col("b.text_hash").alias("_th"))
    rows = set_aside(docs)
    same = rows["doc_id"].eqNullSafe(keep["_id"]) & (rows["th"] == keep["_th"])
    kept = rows.join(keep, same, "left_semi")
    return kept.dropDuplicates(["doc_id", "th"]).select("row.*")
