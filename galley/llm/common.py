"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.plans.joins import durable


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """``doc_id long, text string`` alone, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def set_aside(docs: DataFrame) -> DataFrame:
    """``row, doc_id, th``: a document whole, and what it is joined by.

    Inside ``row`` no column of the document can clash with another.
    """
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("th"),
    )


def numbered(stored: DataFrame, column: str) -> DataFrame:
    """A checkpointed table with the place of each row in storage order, from 0.

    The sizes of the stored parts, one number for each, give every part its
    first place; no row moves.
    """
    placed = stored.withColumn("_m", F.monotonically_increasing_id())
    part, at = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    firsts, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        firsts.append(str(total))
        total += sizes.get(p, 0)
    table = F.split(F.lit(",".join(firsts) or "0"), ",").cast("array<long>")
    return placed.withColumn(column, F.get(table, part.cast("int")) + at).drop("_m")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node reachable over ``edges(a, b)``.

    Alternating stars: each round hangs every node's larger neighbours on its
    smallest one, then its smaller ones, until nothing moves.  Every group is
    folded to a ``min`` before it is joined, and each round is cut off by a
    reliable checkpoint, so a lost executor costs one round.
    """
    links = durable(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    for _ in range(most_rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m"))
        lowest = lowest.select("a", F.least("a", "m").alias("m"))
        large = (
            both.filter("b > a")
            .join(lowest, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a")
        links = durable(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b")
            .union(lowest.select("a", F.col("m").alias("b")))
            .distinct()
        )
        state = links.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")
        ).first()
        if state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


# --- words of many texts at once, by numpy over one byte buffer ---------------

_ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A full-avalanche mix of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_ODD, -1, 1 << 64)
    up = np.full(n, _ODD, dtype=np.uint64)
    down = np.full(n, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end, hash`` of every run of bytes other than white space.

    The hash of a word is a polynomial over its bytes, taken from prefix sums
    modulo 2**64, mixed.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        none = np.empty(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[0::2], edges[1::2]
    # prefix sums per block of bytes keep the tables of powers short
    block = 1 << 20
    up, down = _powers(min(len(raw), block) + 1)
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        base = start[at]
        upto = int(np.searchsorted(end, base + block, side="right"))
        if upto <= at:  # one word longer than a block
            word = data[start[at] : end[at]]
            out[at] = np.uint64(int.from_bytes(word, "little") % ((1 << 61) - 1))
            at += 1
            continue
        piece = raw[base : end[upto - 1]].astype(np.uint64) + np.uint64(1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(piece * up[: len(piece)])))
        s, e = start[at:upto] - base, end[at:upto] - base
        out[at:upto] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        at = upto
    return start, end, mix(out)


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive word hashes; ``len - size + 1`` of them."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    factor = 1
    for k in range(size):
        total += words[k : k + n] * np.uint64(factor)
        factor = factor * _ODD % (1 << 64)
    return mix(total)


BYTES_AT_ONCE = 2 << 20


def byte_blocks(texts, limit: int = BYTES_AT_ONCE):
    """``(indices, data, bounds)``: texts joined by line ends into blocks of about
    ``limit`` bytes; text ``i`` of a block is ``data[bounds[i]:bounds[i + 1] - 1]``.

    A text is never cut: a longer one is a block of its own.
    """
    which, pieces, size = [], [], 0
    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if pieces and size + len(raw) > limit:
            yield _block(which, pieces)
            which, pieces, size = [], [], 0
        which.append(i)
        pieces.append(raw)
        size += len(raw) + 1
    if pieces:
        yield _block(which, pieces)


def _block(which: list[int], pieces: list[bytes]):
    bounds = np.concatenate(([0], np.cumsum([len(p) + 1 for p in pieces])))
    return which, b"\n".join(pieces) + b"\n", bounds
