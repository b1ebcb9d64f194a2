"""Byte-level BPE: encoding by ranked merges, decoding by joining pieces.

The text is cut by the tokenizer's pattern.  Each distinct word of a batch is
folded once: its bytes are an array of pieces, and the neighbouring pair whose
joined bytes have the lowest rank is merged until no pair has a rank.  The rank
map is a file of fixed size, sent to every worker once.  Folded words stay in a
table of about ``REMEMBERED`` bytes per worker, and texts are taken ``BYTES_AT_ONCE``
at a time (a longer one alone), so memory is bounded by the longest text and every
task stands alone; nothing is shuffled.

``encode`` adds a column of ids, ``decode`` one of bytes; other columns pass.
A null text has no ids; null ids decode to no bytes.  Texts are never cut.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain, repeat
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REMEMBERED = 64 << 20
BYTES_AT_ONCE = 2 << 20
SHORT = 40  # bytes
_SINGLE = [bytes([b]) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 piece and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _fold_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As ``fold``; looking over all pairs is cheaper than a heap for few of them."""
    get, none = ranks.get, len(ranks) + 256  # above every rank
    pieces = [*map(_SINGLE.__getitem__, word)]
    pairs = [*map(get, map(add, pieces, pieces[1:]), repeat(none))]
    while pairs and (lowest := min(pairs)) < none:
        i = pairs.index(lowest)
        joined = pieces[i] + pieces.pop(i + 1)
        pieces[i] = joined
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(joined + pieces[i + 1], none)
        if i:
            pairs[i - 1] = get(pieces[i - 1] + joined, none)
    return [ranks[p] for p in pieces]


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word; the lowest rank merges first, the leftmost of equals."""
    if word in ranks:
        return [ranks[word]]
    if len(word) <= SHORT:
        return _fold_short(word, ranks)
    n = len(word)
    pieces: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    heap = [(r, i, 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        left = pieces[i]
        j = after[i]
        if left is None or j >= n or len(left) + len(pieces[j]) != size:
            continue  # one of the two has been merged since
        joined = left + pieces[j]
        pieces[i], pieces[j] = joined, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := get(joined + pieces[k])) is not None:
                heapq.heappush(heap, (r, i, len(joined) + len(pieces[k])))
        h = before[i]
        if h >= 0 and (r := get(pieces[h] + joined)) is not None:
            heapq.heappush(heap, (r, h, len(pieces[h]) + len(joined)))
    return [ranks[p] for p in pieces if p is not None]


class _Folded(dict):
    """Words with their ids; a word not met before is folded when it is asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.held = ranks, 0

    def __missing__(self, word: str) -> list[int]:
        ids = self[word] = fold(word.encode("utf-8", "surrogatepass"), self.ranks)
        self.held += 200 + 4 * len(word) + 40 * len(ids)
        return ids


def _pieces(ranks: dict[bytes, int]) -> list[bytes]:
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pieces


def _slices(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``BYTES_AT_ONCE`` bytes of text; no text is cut."""
    sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < part.num_rows:
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + BYTES_AT_ONCE, side="right")))
        yield part.slice(at, upto - at)
        at = upto


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    column: str = "ids",
    check: str | None = None,
    decoded: str | None = None,
) -> DataFrame:
    """``docs`` with the ids of ``text``, without special tokens.

    ``check`` names a further column: whether the ids decode to the text again;
    ``decoded`` one with the bytes they decode to.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # as large as the vocabulary
    added = [T.StructField(column, T.ArrayType(T.IntegerType()))]
    if check:
        added.append(T.StructField(check, T.BooleanType()))
    if decoded:
        added.append(T.StructField(decoded, T.BinaryType()))
    new = [f.name for f in added]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in new] + added)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        words_of = regex.compile(pattern).findall
        known = _Folded(shared.value)
        pieces = _pieces(shared.value) if check or decoded else []
        for whole in parts:
            for part in _slices(whole):
                values, ends, same, joined = [], [0], [], []
                for text in part.column("text").to_pylist():
                    words = [] if text is None else words_of(text)
                    ids = np.fromiter(chain.from_iterable(map(known.__getitem__, words)), np.int32)
                    values.append(ids)
                    ends.append(ends[-1] + len(ids))
                    back = b"".join(map(pieces.__getitem__, ids.tolist())) if pieces else b""
                    if check:
                        same.append(back == (text or "").encode("utf-8", "surrogatepass"))
                    if decoded:
                        joined.append(back)
                    if known.held > REMEMBERED:
                        known = _Folded(shared.value)
                flat = np.concatenate(values) if values else np.empty(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                names = [n for n in part.schema.names if n not in new]
                more = [lists]
                if check:
                    more.append(pa.array(same, pa.bool_()))
                if decoded:
                    more.append(pa.array(joined, pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + more, names + new)

    return docs.mapInArrow(batches, schema)


def decoder(spark: SparkSession, ranks: dict[bytes, int]):
    """A column function: the bytes that a column of ids stands for."""
    shared = spark.sparkContext.broadcast(_pieces(ranks))

    @F.pandas_udf(T.BinaryType())
    def decode(ids: pd.Series) -> pd.Series:
        table = shared.value
        return pd.Series([b"" if x is None else b"".join([table[i] for i in x]) for x in ids])

    return decode


def digest_of_ids(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by one space, in lower-case hex."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256)
